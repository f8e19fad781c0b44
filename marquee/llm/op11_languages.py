"""Language ID: each document is a mixture of languages, fitted by expectation-maximisation.

A language is a distribution over letter trigrams (lower-cased, other characters are one blank), hashed to SLOTS and
counted by Spark over the whole texts of all learning documents, add-ALPHA.  For a document, EM estimates the languages'
proportions that make its trigrams likeliest.  The set of languages grows from the single best one: a language whose
likelihood gradient is not positive cannot help (the likelihood is concave), of the others the one that gains most is
added as long as the gain, for a third of the trigrams as each letter stands in three, is above PENALTY times half the
logarithm of their number.  The language of the largest proportion is the prediction.

Learned are the MAX_LANGS languages with the most documents; the model sent to tasks is bounded by that.  Defined results:
a null text or one without a letter is ``und`` with score 0, as are all where nothing can be learned; score is the
predicted language's proportion, drawn towards equal shares in short texts; equal proportions go to the likelier, then the
smaller language by code points; repeated rows are learned from and predicted each by itself; an empty table gives an
empty result; very long texts are read CHUNK characters at a time; other columns are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import crc_mod, pick, worker_store

SLOTS, ALPHA = 1 << 16, 0.2
MAX_LANGS = 256
PENALTY, PRIOR = 2.0, 0.5
STEPS, ENOUGH = 200, 1e-7
CHUNK = 1 << 18
#: Languages whose counts a task holds at a time.
HELD = 64


def letters() -> np.ndarray:
    """Whether each code point is a letter (made once a worker)."""
    store = worker_store("letters")
    if "table" not in store:
        store["table"] = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return store["table"]


def trigrams(text: str) -> list[np.ndarray]:
    """The slots of a text's letter trigrams, in pieces; none without a letter."""
    is_letter, tail, out = letters(), np.array([32], np.uint32), []
    for i in range(0, len(text), CHUNK):
        c = np.frombuffer(text[i : i + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.concatenate([tail, np.where(is_letter[c], c, np.uint32(32)), np.full(int(i + CHUNK >= len(text)), 32, np.uint32)])
        c = np.concatenate([c[:1], c[1:][(c[1:] != 32) | (c[:-1] != 32)]])
        if len(c) > 2:
            out.append(((c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA6B) ^ c[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F) >> np.uint32(16)).astype(np.uint16))
        tail = c[-2:]
    return out


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's different slots and how often each occurs."""
    got = trigrams(text)
    if len(got) > 1:
        total = sum(np.bincount(g, minlength=SLOTS) for g in got)
        slots = np.flatnonzero(total)
        return slots, total[slots].astype(np.float64)
    if not got:
        return np.zeros(0, np.int64), np.zeros(0)
    s = np.sort(got[0], kind="stable")
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[first], np.diff(np.append(first, len(s))).astype(np.float64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, slot, n over the whole texts of ``docs`` (lang, text)."""

    def of(batches):
        held: dict[str, np.ndarray] = {}

        def flush():
            for lang, total in held.items():
                slots = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), pa.array(slots.astype(np.int32)), pa.array(total[slots])], ["lang", "slot", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang not in held:
                    if len(held) >= HELD:
                        yield from flush()
                    held[lang] = np.zeros(SLOTS, np.int64)
                for g in trigrams(text.as_py()):
                    if len(g) * 8 > SLOTS:
                        held[lang] += np.bincount(g, minlength=SLOTS)
                    else:
                        np.add.at(held[lang], g, 1)
        yield from flush()

    return docs.select(F.col("lang").cast("string"), "text").mapInArrow(of, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def learned(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by code points and their log probabilities of the slots."""
    rows = pick(docs, "doc_id", "text", "lang").where("text is not null and lang is not null").where(crc_mod("doc_id", 4) != 2)
    most = rows.groupBy("lang").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "lang").limit(MAX_LANGS)
    counts = gram_counts(rows.join(F.broadcast(most.select("lang")), "lang"))
    got = counts.where("n > 0").toArrow()  # at most MAX_LANGS x SLOTS rows
    langs = sorted(set(got.column("lang").to_pylist()))
    place = {x: i for i, x in enumerate(langs)}
    total = np.zeros((len(langs), SLOTS))
    total[[place[x] for x in got.column("lang").to_pylist()], got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return langs, np.log((total + ALPHA) / (total.sum(axis=1, keepdims=True) + ALPHA * SLOTS)).astype(np.float32)


def em(p: np.ndarray, c: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions that maximise the likelihood of counts ``c`` under a mixture of the rows of ``p``, and its logarithm."""
    n, before = c.sum(), -np.inf
    for _ in range(STEPS):
        mix = share @ p
        now = float(c @ np.log(mix))
        if now - before <= ENOUGH * n:
            break
        before, share = now, share * (p @ (c / mix)) / n
    return share, now


def mixture(p: np.ndarray, c: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The languages chosen, in order of choice, their proportions, and all languages' own log likelihoods."""
    n, own = c.sum(), np.log(p) @ c
    chosen, share, best = [int(own.argmax())], np.ones(1), float(own.max())
    least = 3 * PENALTY * 0.5 * np.log(n) if n > 1 else np.inf
    while len(chosen) < len(p):
        slope = p @ (c / (share @ p[chosen])) - n  # of the log likelihood, towards each language
        found = None
        for k in np.flatnonzero(slope > 0).tolist():
            if k in chosen:
                continue
            s, value = em(p[[*chosen, k]], c, np.append(share * 0.9, 0.1))
            if value - best > least and (found is None or value > found[0]):
                found = (value, k, s)
        if found is None:
            break
        best, share = found[0], found[2]
        chosen.append(found[1])
    return chosen, share, own


def predict(docs: DataFrame, langs: list[str], log_p: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs, shares (the set, by falling proportion) of each row of ``docs`` (doc_id, text)."""
    rows = pick(docs, "doc_id", "text").select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    table, kind = docs.sparkSession.sparkContext.broadcast(log_p), rows.schema["doc_id"].dataType.simpleString()

    def one(text, logs) -> tuple:
        slots, c = counted(text or "")
        if not len(slots) or not len(logs):
            return "und", 0.0, [], []
        p = logs[:, slots].astype(np.float64)
        chosen, share, own = mixture(np.exp(p - p.max(axis=0)), c)  # each slot's probabilities relative to the largest: the same proportions
        order = sorted(range(len(chosen)), key=lambda k: (-share[k], -own[chosen[k]], chosen[k]))
        n, top = c.sum(), order[0]
        return langs[chosen[top]], float((n * share[top] + PRIOR) / (n + PRIOR * len(logs))), [langs[chosen[k]] for k in order], [float(share[k]) for k in order]

    def of(batches):
        logs = table.value
        for batch in batches:
            got = [one(t.as_py(), logs) for t in batch.column(2)]
            pred, score, names, shares = zip(*got, strict=True) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(names, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                                             ["doc_id", "held_out", "lang_pred", "score", "langs", "shares"])

    return rows.mapInArrow(of, f"doc_id {kind}, held_out boolean, lang_pred string, score double, langs array<string>, shares array<double>")


def identify(docs: DataFrame) -> DataFrame:
    """``predict`` over ``docs`` (doc_id, text, lang), learned from those that are not held out."""
    return predict(docs, *learned(docs))
