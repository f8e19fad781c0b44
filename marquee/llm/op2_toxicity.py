"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

A text is a bag of units: its words (lower case, letters alone) and runs of
single letters joined.  Two units are alike by the subsequences of four letters (the mark before a word counts as one,
letters beyond a to z share five codes) that they share, each weighted by DECAY to the length it spans in either unit, so that gaps and inserted characters weaken a match but do not end it.

Training, on a bounded sample of labelled documents at the driver: units that mark toxic documents, whoever their
neighbours, are witnesses, units of clean documents are the other class; landmarks are drawn from both; units are mapped to
the landmarks' space (K_mm^-1/2 k_m(x)) and a linear machine with squared hinge loss is fitted.  Each further
round takes as witness the highest unit of each toxic document and as counter-examples the highest of clean ones.

Scoring: the machine is a weighted sum of kernels with the landmarks, hence one weight per subsequence; a unit's
margin is a sum over its own subsequences, exactly the kernel expansion.  A document's score is a logistic
function of its three highest margins; each distinct word is scored once per worker.

Defined results: a null or empty text, or one without letters, has the score of the lowest margin (LOWEST);
repeated rows score alike; an empty table gives an empty result; without labels of both kinds every score is 0;
a doc_id with two different labels is not learned from; other columns are ignored by ``scored`` and kept by ``filtered``.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import crc_mod, keeping_columns, one_label, pick, release, worker_store

#: The most toxic and the most other labelled documents that are learned from (those of the smallest hash of their id).
MAX_TOXIC, MAX_CLEAN = 2_000, 4_000
DECAY, ORDER, LONGEST = 0.6, 4, 20
LANDMARKS, ROUNDS = 200, 4
MAX_UNITS = 6_000
LOWEST, HIGHEST = -2.0, 1.0
TOP = 3
#: Words whose margins a worker keeps, and texts that it scores at a time.
KEPT_WORDS, TEXTS = 1 << 18, 256
#: Codes of letters: the mark, a to z, five for all others; every subsequence of ORDER codes has a number of its own.
CODES, MARK = 32, 0
SLOTS = CODES**ORDER
#: Words whose units the driver keeps while it reads the sample, units counted at a time, rows of a matrix product.
READ_WORDS, COUNTED, PRODUCT_ROWS = 1 << 16, 1 << 14, 1 << 11
#: Near copies among the sampled texts count as one: BANDS x BAND minimum hashes of their words, one equal band links.
BANDS, BAND = 8, 3


def code(c: str) -> int:
    """1-26 for a-z, 27-31 for other letters, 0 for the rest (left out)."""
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) * 7 % 5 if c.isalpha() else 0


def units(word: bytes) -> list[bytes]:
    """Codes of a word's letters with the mark before; long words as overlapping pieces."""
    codes = [c for c in map(code, word.decode("utf-8", "replace").lower()) if c]
    if len(codes) < ORDER - 1:
        return []
    codes = bytes([MARK, *codes])
    if len(codes) <= LONGEST:
        return [codes]
    return [codes[i : i + LONGEST] for i in range(0, len(codes) - LONGEST // 2, LONGEST // 2)]


def spelled(words: list[bytes]) -> list[bytes]:
    """Words made of three or more single characters in a row."""
    lengths = np.fromiter(map(len, words), np.int32, len(words))
    one = np.append(np.append(0, (lengths == 1).astype(np.int8)), 0)
    edges = np.flatnonzero(np.diff(one))
    return [b"".join(words[a:b]) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= 3]


@cache
def _triples(n: int):
    """Places of all subsequences of ORDER letters of a unit of length ``n``, their weights and the unit's usual norm."""
    at = np.array(list(combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER)
    weight = DECAY ** (at[:, -1] - at[:, 0] + 1.0)
    return at, weight / np.sqrt((weight**2).sum())


def embed(same_length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence numbers and weights of units of one length (rows of codes)."""
    at, weight = _triples(same_length.shape[1])
    number = np.zeros((len(same_length), len(at)), np.int32)
    for i in range(ORDER):
        number = number * CODES + same_length[:, at[:, i]]
    return number, np.broadcast_to(weight, number.shape)


def by_length(all_units: list[bytes]):
    """Places and code matrices of units, a length at a time, in blocks of bounded size."""
    lengths = np.fromiter(map(len, all_units), np.int32, len(all_units))
    for n in np.unique(lengths):
        places = np.flatnonzero(lengths == n)
        block = max(1, 500_000 // len(_triples(int(n))[1])) if n >= ORDER else len(places)
        for i in range(0, len(places), block):
            p = places[i : i + block]
            yield p, np.frombuffer(b"".join([all_units[j] for j in p]), np.uint8).reshape(len(p), n).astype(np.int32)


def highest(margins) -> list[float]:
    """The TOP highest margins, from the highest; LOWEST where there are fewer."""
    return sorted([*margins, *[LOWEST] * TOP], reverse=True)[:TOP]


@dataclass
class Machine:
    """weight of each subsequence, offset, and the logistic function of a text's highest margins."""

    weight: np.ndarray
    offset: float
    slopes: np.ndarray
    shift: float

    def margins(self, all_units: list[bytes]) -> np.ndarray:
        out = np.full(len(all_units), LOWEST)
        for p, codes in by_length(all_units):
            which, w = embed(codes)
            if which.size:
                out[p] = self.weight[which] @ w[0].astype(np.float32) + self.offset
        return np.clip(out, LOWEST, HIGHEST)

    def probability(self, margins: np.ndarray) -> np.ndarray:
        """From the highest margins of each text (a row)."""
        return 1 / (1 + np.exp(-(margins @ self.slopes + self.shift)))


def _kernel_rows(all_units, places_of: np.ndarray, width: int) -> np.ndarray:
    """Each unit's weights over the subsequences that landmarks have."""
    out = np.zeros((len(all_units), width + 1), np.float32)
    for p, codes in by_length(all_units):
        which, w = embed(codes)
        np.add.at(out, (p[:, None], places_of[which]), w)
    return out[:, :width]


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Squared hinge loss by Newton steps over the rows inside the margin; the last weight is the offset."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1]) * ridge
    keep[-1, -1] = 1e-6
    before = None
    for _ in range(50):
        active = y * (x @ w) < 1
        if before is not None and (active == before).all():
            break
        before = active
        h, g = keep.copy(), np.zeros(len(w))
        for at in np.array_split(np.flatnonzero(active), active.sum() // PRODUCT_ROWS + 1):
            a = x[at] * cost[at, None]
            h += a.T @ x[at]
            g += a.T @ y[at]
        w = np.linalg.solve(h, g)
    return w[:-1], float(w[-1])


def near_copies(texts: list[bytes]) -> list[int]:
    """A number for each text, the same for near copies."""
    seeds = np.random.default_rng(0).integers(1, 2**32, BANDS * BAND, dtype=np.uint64) | np.uint64(1)
    parent = list(range(len(texts)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    first: dict = {}
    for k, t in enumerate(texts):
        words = np.unique(np.fromiter((zlib.crc32(w) for w in t.split()), np.uint64))
        if len(words):
            least = np.array([((words * s) & np.uint64(0xFFFFFFFF)).min() for s in seeds]).reshape(BANDS, BAND)
            for i, band in enumerate(least.tolist()):
                parent[root(k)] = root(first.setdefault((i, *band), k))
    return [root(k) for k in range(len(texts))]


def different(bags: list[np.ndarray], of_text, n: int) -> np.ndarray:
    """How many different numbers each of ``n`` units has; ``of_text(k, a, b)`` has a number after the unit's (in the
    lower 32 bits) for each of places a to b of the sorted units bags[k]."""
    out = np.zeros(n, np.int64)
    for first in range(0, n, COUNTED):
        bounds = [np.searchsorted(bag, (first, first + COUNTED)) for bag in bags]
        parts = [of_text(k, a, b) for k, (a, b) in enumerate(bounds) if a < b]
        if parts:
            got = (np.unique(np.concatenate(parts)) >> 32) - first
            out[first : first + COUNTED] = np.bincount(got, minlength=min(COUNTED, n - first))
    return out


def train(texts: list[bytes], toxic: np.ndarray) -> Machine | None:
    """A machine from labelled texts; None without both kinds."""
    if not toxic.any() or toxic.all():
        return None
    number: dict[bytes, int] = {}  # units by number, in order of appearance
    of_word: dict[bytes, tuple[int, ...]] = {}
    bags, seen = [], []
    for t in texts:
        words, found, whole = t.split(), [], zlib.crc32(t)
        if len(of_word) > READ_WORDS:
            of_word.clear()
        for i, w in enumerate(words):
            if (got := of_word.get(w)) is None:
                got = of_word[w] = tuple(number.setdefault(u, len(number)) for u in units(w))
            if got:
                place = zlib.crc32(b" ".join((*words[max(0, i - 1) : i], *words[i + 1 : i + 2])))
                found += [(u << 32) + place for u in got]
        for w in spelled(words):
            found += [(number.setdefault(u, len(number)) << 32) + whole for u in units(w)]
        found = np.unique(np.array(found, np.int64))
        bags.append(np.unique(found >> 32).astype(np.int32))
        seen.append(found)
    del of_word
    distinct = list(number)
    del number
    # A unit counts by the different neighbours that it has in documents of a kind, or by the different documents (near
    # copies are one) where these are more: the words of a text that was copied many times count once, a word put into
    # many texts counts for each, if it stands in one phrase alone too.
    group = near_copies(texts)

    def counts(kind: bool) -> np.ndarray:
        of = np.flatnonzero(toxic == kind)
        neighbours = different([seen[k] >> 32 for k in of], lambda k, a, b: seen[of[k]][a:b], len(distinct))
        documents = different([bags[k] for k in of], lambda k, a, b: (bags[of[k]][a:b].astype(np.int64) << 32) + group[of[k]], len(distinct))
        return np.maximum(neighbours, documents)

    good, bad = counts(False), counts(True)
    del seen
    release()
    rate = (bad + 0.1) / (toxic.sum() + 1) / ((good + 0.1) / ((~toxic).sum() + 1))
    # First witnesses: units with three neighbours or more in toxic documents, ten times as usual there as in others.
    witnesses = {int(u): int(bad[u]) for u in np.flatnonzero((bad >= 3) & (rate >= 10))}
    counter = sorted(np.flatnonzero((good >= 1) & (rate < 3)).tolist(), key=lambda u: (-good[u], u))
    if not witnesses or not counter:
        return None
    rng = np.random.default_rng(0)
    common = counter[: MAX_UNITS // 2]
    rare = counter[MAX_UNITS // 2 :]
    others = set(common) | {rare[i] for i in rng.permutation(len(rare))[: MAX_UNITS // 2]}
    usual = [counter[i] for i in rng.permutation(min(len(counter), 4 * LANDMARKS))[: LANDMARKS // 4]]
    hard: list[int] = []
    for _ in range(ROUNDS):
        top = sorted(witnesses, key=lambda u: (-witnesses[u], u))[: LANDMARKS // 2]
        marks = [distinct[u] for u in dict.fromkeys(top + usual + hard[: LANDMARKS // 4])]
        which = np.unique(np.concatenate([embed(c)[0].ravel() for _, c in by_length(marks)]))
        places_of = np.full(SLOTS, len(which))
        places_of[which] = np.arange(len(which))
        landmark = _kernel_rows(marks, places_of, len(which)).astype(np.float64)
        values, vectors = np.linalg.eigh(landmark @ landmark.T)
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T  # K_mm^-1/2
        pos, neg = sorted(witnesses), sorted(others - witnesses.keys())
        x = np.vstack([_kernel_rows([distinct[k] for k in u[i : i + 128]], places_of, len(which)) @ landmark.T @ root for u in (pos, neg) for i in range(0, len(u), 128)])
        y = np.append(np.ones(len(pos)), -np.ones(len(neg)))
        # A unit counts by its neighbours, and both classes alike.
        cost = np.sqrt(np.append(bad[pos], good[neg]) + 1.0)
        for k in (y > 0, y < 0):
            cost[k] *= len(y) / 2 / cost[k].sum()
        w, offset = _svm(x, y, cost)
        del x, places_of
        release()
        weight = np.zeros(SLOTS, np.float32)
        weight[which] = (root @ w) @ landmark
        machine = Machine(weight, offset, np.zeros(TOP), 0.0)
        margin = machine.margins(distinct)
        for bag, kind in zip(bags, toxic, strict=True):
            if kind and len(bag):
                u = int(bag[np.argmax(margin[bag])])
                if rate[u] >= 3 and bad[u] >= 3:
                    witnesses[u] = witnesses.get(u, 0) + 1
        worst = sorted(np.flatnonzero((margin > -0.5) & (good > 0) & (rate < 3)).tolist(), key=lambda u: (-min(margin[u], 1) * good[u], u))
        others |= set(worst[: MAX_UNITS // 2])
        hard = worst
        release()
    x = np.array([highest(margin[bag].tolist()) for bag in bags])
    x, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(TOP + 1)
    for _ in range(60):  # logistic fit by Newton steps; weights below zero are held at zero
        p = 1 / (1 + np.exp(-(x @ w)))
        g = x.T @ (p - toxic) + np.append(np.full(TOP, 1e-2), 0) * w
        free = (w > 0) | (g < 0)
        free[-1] = True
        h = (x.T * np.maximum(p * (1 - p), 1e-9)) @ x + 1e-2 * np.eye(TOP + 1)
        step = np.zeros(TOP + 1)
        step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
        step *= min(1.0, 2.0 / max(abs(step).max(), 1e-9))
        w = w - step
        w[:-1] = np.maximum(w[:-1], 0)
        if abs(step).max() < 1e-9:
            break
    machine.slopes, machine.shift = w[:-1], float(w[-1])
    return machine


def learned(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Machine | None:
    """Trains on the texts of labelled rows (doc_id, toxic); those with crc32(doc_id) mod 5 = 0 are held out."""
    known = one_label(labels, "toxic").where(crc_mod("doc_id", 5) != 0)
    chosen = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, max_toxic), (0, max_clean))]
    rows = pick(docs, "doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    got = rows.select("doc_id", "toxic", F.col("text").cast("binary").alias("text")).toArrow().sort_by("doc_id")
    texts, toxic = [x or b"" for x in got.column("text").to_pylist()], np.array(got.column("toxic").to_pylist(), bool)
    del got
    release()
    machine = train(texts, toxic)
    release()
    if machine is not None:  # the sample has more toxic documents than the labels have
        n = known.agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count("*").alias("all")).first()
        machine.shift += float(np.log(n["toxic"] / (n["all"] - n["toxic"])) - np.log(toxic.sum() / (~toxic).sum()))
    return machine


def scorer(machine: Machine | None):
    """A function from a text column to its score column."""
    name = machine and hashlib.sha1(machine.weight.tobytes() + repr((machine.offset, machine.slopes.tolist(), machine.shift)).encode()).hexdigest()

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if machine is None:
            return pa.array(np.zeros(len(texts)))
        store = worker_store("margins")  # of one machine at a time
        if store.get("name") != name:
            store.clear()
            store.update(name=name, known={})
        known = store["known"]
        out = [probabilities(texts[i : i + TEXTS], known) for i in range(0, len(texts), TEXTS)]
        release()
        return pa.array(np.concatenate([np.zeros(0), *out]))

    def probabilities(texts: pa.Array, known: dict) -> np.ndarray:
        bags = []
        for x in texts:
            words = (x.as_py() or b"").split()
            bags.append({*words, *spelled(words)})
        if len(known) > KEPT_WORDS:
            known.clear()
        new = list(set().union(*bags).difference(known))
        owners, pieces = [], []
        for i, w in enumerate(new):
            for u in units(w):
                owners.append(i)
                pieces.append(u)
        best = np.full(len(new), LOWEST)
        np.maximum.at(best, np.array(owners, np.int64), machine.margins(pieces))
        known.update(zip(new, best.tolist(), strict=True))
        return machine.probability(np.array([highest(heapq.nlargest(TOP, map(known.__getitem__, b))) for b in bags]))

    return lambda text: score(text.cast("binary"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text)."""
    score = scorer(learned(docs, labels))
    rows = pick(docs, "doc_id", "text").select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    score = scorer(learned(docs, labels))
    return keeping_columns(docs, ("text",), lambda d: d.withColumn("_score", score(F.col("text"))).where(F.col("_score") < 0.5))
