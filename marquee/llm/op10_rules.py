"""Quality rules: a learned decision list over statistics of whole texts.

Sequential covering on labelled rows: a rule is grown on two thirds of the rows by adding the threshold
condition of the highest information gain until it covers no good document, then pruned on the other third
by dropping last conditions; rows it covers are removed and the next rule is learned, until a rule is no
longer precise.  The list becomes one ordered Spark conditional expression.

Defined results: a null or empty text has all counts 0 (base_failed); repeated rows are judged alike; an
empty table gives an empty result; without labels of both kinds the list is empty and only the base rules
reject; a doc_id with two different labels is not learned from; other columns are ignored by ``judge`` and kept by ``filtered``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import crc_mod, keeping_columns, one_label, pick, pin, release

#: The most labelled rows that the list is learned from (those of the smallest hash of their id).
MAX_LABELLED = 20_000
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: A rule must be this precise on the rows kept for pruning, and cover so many bad rows.
MIN_PRECISION, MIN_COVER = 0.9, 5
MAX_RULES, MAX_CONDITIONS, CUTS = 24, 4, 24
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct", "n_stops")
STATS = "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">"


def _repeated(words: list[bytes], ids: np.ndarray, distinct: int) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    windows = ids[:-2] * distinct + ids[1:-1]
    if distinct >= 1 << 20:  # three ids would not fit 63 bits
        windows = np.unique(windows, return_inverse=True)[1].astype(np.int64)
    windows = windows * distinct + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    for k in range(3):
        twice[k : n - 2 + k] |= again
    return int(twice.sum())


def counts(text: bytes) -> tuple[int, ...]:
    words = text.split()
    first: dict[bytes, int] = {}
    ids = np.array([first.setdefault(w, len(first)) for w in words], np.int64)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    without = lambda chars: len(text) - len(text.translate(None, chars))
    return (len(words), len(text.translate(None, b" \t\n\x0b\x0c\r").decode()), without(b"#*$%&|<>"), len(lines) - len(set(lines)),
            _repeated(words, ids, len(first)), len(lines), without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), without(b"0123456789"), text.count(b"!") + text.count(b"?"), len(first),
            without(b".,;:"))


def stats(text: Column) -> Column:
    """A struct of COUNTS for a text column."""

    @F.arrow_udf(STATS)
    def of(texts: pa.Array) -> pa.Array:
        rows = [counts(x.as_py() or b"") for x in texts]
        release()
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in COUNTS]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], list(COUNTS))

    return of(text.cast("binary"))


def features(s) -> dict[str, Column]:
    """Ratios that conditions test, from a function that gives the column of a count."""
    per = lambda a, b: s(a) / F.greatest(s(b), F.lit(1))
    return {"chars_per_word": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"), "dup_line_share": per("n_dup_lines", "n_lines"),
            "repeat_share": per("n_repeat_words", "n_words"), "upper_share": per("n_upper", "word_chars"), "digit_share": per("n_digits", "word_chars"),
            "marks_per_word": per("n_marks", "n_words"), "distinct_share": per("n_distinct", "n_words"), "stops_per_word": per("n_stops", "n_words"), "words": s("n_words").cast("double")}


def base_failed(s) -> Column:
    return (s("n_words") < MIN_WORDS) | (100 * s("n_repeat_words") > REPEAT_PERCENT * s("n_words"))


Condition = tuple[str, str, float]  # feature, "<=" or ">", threshold


def _covered(x: dict[str, np.ndarray], rule: list[Condition]) -> np.ndarray:
    ok = np.ones(len(next(iter(x.values()))), bool)
    for f, op, t in rule:
        ok &= x[f] <= t if op == "<=" else x[f] > t
    return ok


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best = (1e-9, None, None)
        for f, v in x.items():
            values = np.unique(v[inside])
            at = np.searchsorted(values, np.unique(np.quantile(v[inside & bad], np.linspace(0, 1, CUTS), method="nearest")))
            # Thresholds lie midway between a bad row's value and the next value below or above.
            cuts = [(op, (values[i] + values[j]) / 2) for op, step in ((">", -1), ("<=", 1)) for i in at for j in [i + step] if 0 <= j < len(values)]
            for op, t in cuts:
                ok = inside & (v <= t if op == "<=" else v > t)
                p, n = (ok & bad).sum(), (ok & ~bad).sum()
                if p >= MIN_COVER:
                    gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                    if gain > best[0]:
                        best = (gain, (f, op, float(t)), ok)
        if best[1] is None:
            break
        rule.append(best[1])
        inside = best[2]
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, order: np.ndarray) -> list[list[Condition]]:
    """The ordered rules that reject; ``order`` (a hash of the row) deals rows to growing and pruning."""
    rules: list[list[Condition]] = []
    left = np.ones(len(bad), bool)
    grow_rows = order % 3 != 0
    while len(rules) < MAX_RULES and (left & bad & grow_rows).sum() >= MIN_COVER:
        g = left & grow_rows
        rule = _grow({f: v[g] for f, v in x.items()}, bad[g])
        if not rule:
            break
        q = left & ~grow_rows

        def worth(r, q=q):
            ok = _covered(x, r) & q
            p, n = (ok & bad).sum(), (ok & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) > worth(rule):
            rule = rule[:-1]
        ok = _covered(x, rule) & left
        if (ok & bad).sum() < MIN_COVER or worth(rule) < 2 * MIN_PRECISION - 1 or (ok & bad).sum() < MIN_PRECISION * ok.sum():
            break
        rules.append(rule)
        left &= ~ok
    return rules


def reject_expression(rules: list[list[Condition]], feature: dict[str, Column]) -> Column:
    """The list as one ordered conditional: true where a rule rejects."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for f, op, t in rule:
            test = test & (feature[f] <= t if op == "<=" else feature[f] > t)
        out = F.when(test, True) if out is None else out.when(test, True)
    return F.lit(False) if out is None else out.otherwise(False)


def learned_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[list[Condition]]:
    """Learns from labelled rows (doc_id, quality) that pass the base rules; those with crc32(doc_id) mod 5 = 0 are held out."""
    chosen = one_label(labels, "quality").where(crc_mod("doc_id", 5) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", stats(F.col("text")).alias("s"))
    # Written before it is filtered: a filter on the counts would go below the join and count every row there, and again
    # above it in a second Python worker of each task (workers outlive their tasks).
    rows = pin(rows, "labelled")
    s = lambda c: F.col(f"s.{c}")
    got = rows.where(~base_failed(s)).select("quality", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3000)).alias("part"), *(c.alias(f) for f, c in features(s).items())).toPandas()
    got = got.sort_values(list(got.columns))
    bad = (got["quality"] == 0).to_numpy()
    if not bad.any() or bad.all():
        return []
    return learn({f: got[f].to_numpy() for f in got.columns[2:]}, bad, got["part"].to_numpy())


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of each row of ``docs`` (doc_id, text)."""
    rules = learned_rules(docs, labels)
    rows = pick(docs, "doc_id", "text").select("doc_id", stats(F.col("text")).alias("s")).select("doc_id", "s.*")
    failed = base_failed(F.col)
    return rows.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & ~reject_expression(rules, features(F.col))).alias("kept"))


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    rules, s = learned_rules(docs, labels), lambda c: F.col(f"_stats.{c}")
    kept = ~base_failed(s) & ~reject_expression(rules, features(s))
    return keeping_columns(docs, ("text",), lambda d: d.withColumn("_stats", stats(F.col("text"))).where(kept))
