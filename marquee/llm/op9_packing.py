"""Packing documents into sequences by cutting-stock column generation.

A document's ids are cut into whole sequences and one remainder.  Remainders are counted by length (in
units of UNIT ids, rounded up).  Over that histogram the driver solves the cutting-stock linear program:
a pattern says how many remainders of each length share a sequence; new patterns are priced by a knapsack
dynamic program on the dual prices until none improves.  Pattern counts are rounded down, what is left is
placed first-fit by falling length.  The histogram's size depends on the sequence length alone.

Remainders are ranked within their length class (rank within the writing partition plus the count of the
partitions before it) and a rank says which pattern, sequence and place it gets: no search over documents.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm.common import batch_rows, pick, pin, releasing
from marquee.llm.tokens import Encoder

SEQUENCE, UNIT, END_ID = 2048, 16, 1
#: The linear program ends within this share of its optimum, or after so many new patterns.
GAP, MAX_COLUMNS = 1e-3, 4000
#: Rows (whole texts, or pieces with their ids) that a Python worker gets at a time.
ROWS = 1_000
PIECES = "shard long, class int, rank long, doc_id long, start long, length long, doc_tokens long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int = END_ID, sequence: int = SEQUENCE, unit: int = UNIT, keep_ids: bool = False) -> DataFrame:
    """The pieces of each row of ``docs`` (doc_id, text), with their ids (little-endian unsigned 32-bit integers) if
    ``keep_ids``; class is the length in units, rank counts the shard's pieces of a class."""
    end = np.array([end_id], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard, ranks = Encoder.of(vocabulary), TaskContext.get().partitionId(), {}
        rows, held = [], 0
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(texts), strict=True):
                ids = np.concatenate([ids, end])
                n = len(ids)
                for start in range(0, n, sequence):
                    piece = ids[start : start + sequence]
                    kind = -(-len(piece) // unit)
                    rank = ranks.get(kind, 0)
                    ranks[kind] = rank + 1
                    rows.append((shard, kind, rank, doc_id, start, len(piece), n, zlib.crc32(piece), *[piece.tobytes()] * keep_ids))
                held += n if keep_ids else 0
                if held >= 1 << 20 or len(rows) >= 10_000:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    def made(rows) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6, *[pa.binary()] * keep_ids]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                          ["shard", "class", "rank", "doc_id", "start", "length", "doc_tokens", "ids_crc32", *["ids"] * keep_ids])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(releasing(cut), PIECES + ", ids binary" * keep_ids)


def best_pattern(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of the highest price within the capacity."""
    worth_of = np.full(capacity + 1, -np.inf)  # by length
    worth_of[lengths] = prices
    row_of = np.zeros(capacity + 1, np.int64)
    row_of[lengths] = np.arange(len(lengths))
    best, choice = np.zeros(capacity + 1), [0] * (capacity + 1)
    for c in range(1, capacity + 1):
        worth = worth_of[1 : c + 1] + best[c - 1 :: -1] if c > 1 else worth_of[1:2] + best[:1]
        j = int(worth.argmax())
        if worth[j] > best[c - 1] + 1e-12:
            best[c], choice[c] = worth[j], j + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if choice[c]:
            pattern[row_of[choice[c]]] += 1
        c -= choice[c] or 1
    return float(best[capacity]), pattern


def cutting_stock(lengths: np.ndarray, demand: np.ndarray, capacity: int, max_columns: int = MAX_COLUMNS, gap: float = GAP) -> list[tuple[int, np.ndarray]]:
    """(times, pattern) that place exactly ``demand[i]`` pieces of ``lengths[i]`` units, each pattern within ``capacity``."""
    m = len(lengths)
    if m == 0:
        return []
    # The first basis: each pattern has one length, as often as it fits.
    fits = capacity // lengths
    columns = [np.eye(m, dtype=np.int64)[i] * fits[i] for i in range(m)]
    inverse, x = np.diag(1.0 / fits), demand / fits
    for step in range(max_columns):
        prices = inverse.sum(axis=0)  # duals: every pattern costs one sequence
        worth, pattern = best_pattern(prices, lengths, capacity)
        # Prices over ``worth`` are a feasible dual (Farley), so their sum bounds the optimum from below.
        if worth <= 1 + 1e-9 or x.sum() <= (1 + gap) * (prices @ demand) / worth:
            break
        d = inverse @ pattern
        ratio = np.where(d > 1e-10, x / np.where(d > 1e-10, d, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        columns[out] = pattern
        pivot = inverse[out] / d[out]
        inverse -= np.outer(d, pivot)
        inverse[out] = pivot
        if step % 100 == 99:  # Newton's step for an inverse takes rounding errors out, by products alone
            basis = np.array(columns, float).T
            for _ in range(2):
                inverse = inverse @ (2 * np.eye(m) - basis @ inverse)
        x = np.maximum(inverse @ demand, 0)
    # Whole times of each pattern; it never places more of a length than there are.
    left, out_patterns = demand.astype(np.int64).copy(), []
    for times, pattern in sorted(zip(np.floor(x + 1e-7).astype(np.int64).tolist(), columns, strict=True), key=lambda p: -p[0]):
        used = pattern > 0
        times = min(times, int((left[used] // pattern[used]).min())) if used.any() else 0
        if times > 0:
            out_patterns.append((times, pattern))
            left -= times * pattern
    # The rest: a few pieces of each pattern; fill sequences by falling length.
    falling = np.argsort(-lengths)
    while left.any():
        free, pattern = capacity, np.zeros(m, np.int64)
        for i in falling:
            k = min(int(left[i]), free // int(lengths[i]))
            pattern[i], free = k, free - k * int(lengths[i])
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out_patterns.append((times, pattern))
        left -= times * pattern
    return out_patterns


def places(patterns: list[tuple[int, np.ndarray]], classes: np.ndarray) -> tuple[dict[int, tuple], int]:
    """For each class, its runs of ranks: (first rank, pieces in a sequence, first sequence); and the count of sequences."""
    runs, used, at = {int(c): [] for c in classes}, np.zeros(len(classes), np.int64), 0
    for times, pattern in patterns:
        for i in np.flatnonzero(pattern):
            runs[int(classes[i])].append((int(used[i]), int(pattern[i]), at))
            used[i] += times * pattern[i]
        at += times
    return {c: tuple(np.array(col, np.int64) for col in zip(*r, strict=True)) for c, r in runs.items() if r}, at


def pack(docs: DataFrame, vocabulary: str, end_id: int = END_ID, sequence: int = SEQUENCE, unit: int = UNIT, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32 of each piece; with ``keep_ids`` also ids."""
    spark = docs.sparkSession
    with batch_rows(spark, ROWS):
        cut = pin(pieces(docs, vocabulary, end_id, sequence, unit, keep_ids), "pieces")
    counts = pin(cut.groupBy("class", "shard").agg(F.count("*").alias("n")), "classes")
    before = Window.partitionBy("class").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = pin(counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "firsts")
    demand = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # sequence / unit rows at most
    classes = np.array(sorted(demand), np.int64)
    runs, _ = places(cutting_stock(classes, np.array([demand[c] for c in classes.tolist()], np.int64), -(-sequence // unit)), classes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            seq, slot = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
            for c in np.unique(kind):
                at = np.flatnonzero(kind == c)
                first, each, begin = runs[int(c)]
                r = np.searchsorted(first, rank[at], side="right") - 1
                past = rank[at] - first[r]
                seq[at], slot[at] = begin[r] + past // each[r], (sequence - c) * sequence + past % each[r]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:7], pa.array(seq), pa.array(slot), *batch.columns[7:]],
                                             ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "slot", *["ids"] * keep_ids])

    ranked = cut.join(firsts, ["class", "shard"]).select("class", (F.col("rank") + F.col("first")).alias("rank"), "doc_id", "start", "length", "doc_tokens", "ids_crc32", *["ids"] * keep_ids)
    placed = ranked.mapInArrow(assign, "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, sequence_id long, slot long" + ", ids binary" * keep_ids)
    with batch_rows(spark, ROWS if keep_ids else 10_000):
        placed = pin(placed, "placed")
    upto = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(upto), F.lit(0))).drop("slot")
