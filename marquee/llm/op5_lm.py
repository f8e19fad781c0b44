"""Language-model scoring of whole documents by a gated recurrent network.

Word counts are taken over all training documents.  The SYMBOLS - 2 most frequent words, the end and OTHER are the
network's symbols; a word that is no symbol has the probability of OTHER times its add-one share of the words that
are none, so that all counts of the corpus take part in a score.

Training: the network reads every training document whole, once, its state carried from window to window.  The
documents are dealt to ROUNDS rounds by a hash of their id; in each round every partition trains a copy of the network
by truncated backpropagation on its documents of the round, and the copies are averaged by their numbers of symbols
(so that the network, though not the counts, depends on how the documents are dealt to partitions).
Scoring reads whole documents, the state carried from window to window.

Counts of the KNOWN most frequent words travel to the workers (a bounded table); the rest of a document's words are
joined with the counts table, so that neither the vocabulary nor a document's words meet in one task.

Defined results: a null or empty text is the end alone; repeated rows are counted and scored each; a null doc_id has
the hash of the empty text; an empty table gives an empty result; without training rows all counts are 0; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import gru
from marquee.llm.common import crc_mod, pick, pin

KNOWN, ROUNDS = 100_000, 3
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 300_000
END = b""  # no word is empty


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (binary; A-Z lower-cased, null: none) in a row, and where each text's begin and end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string())))
    words = lists.flatten()
    some = pc.not_equal(words, "")
    upto = np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))
    return words.filter(some), upto[lists.offsets.to_numpy()]


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), n over the rows of ``docs`` (text binary); each row has an end."""

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def count(batches):
        held, rows = [], 0
        for batch in batches:
            words, _ = words_of(batch.column(0))
            found = words.value_counts()
            held.append(pa.table([found.field(0).view(pa.binary()), found.field(1)], ["word", "n"]))
            held.append(pa.table([pa.array([END], pa.binary()), pa.array([batch.num_rows], pa.int64())], ["word", "n"]))
            rows += len(found) + 1
            if rows > HELD_WORDS:
                held = [summed(held)]
                rows = held[0].num_rows
                if rows > HELD_WORDS // 2:
                    yield from held[0].to_batches(max_chunksize=100_000)
                    held, rows = [], 0
        if held:
            yield from summed(held).to_batches(max_chunksize=100_000)

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The most frequent words with their counts, and the totals of all."""

    def __init__(self, counts: DataFrame):
        whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
        self.tokens, self.distinct = whole["n"] or 0, whole["v"]
        rows = counts.where(F.col("word") != END).orderBy(F.desc("n"), "word").limit(KNOWN).toArrow()
        self.words = rows.column("word").to_pylist()
        self.counts = rows.column("n").to_numpy().astype(np.int64)
        end = counts.where(F.col("word") == END).first()
        self.end_count = end["n"] if end else 0
        # Symbols: 0 the end, then words by falling count, the last one OTHER.
        self.in_network = min(len(self.words), gru.SYMBOLS - 2)
        self.other = gru.SYMBOLS - 1
        head = int(self.counts[: self.in_network].sum()) + self.end_count
        self.other_tokens, self.other_distinct = self.tokens - head, max(0, self.distinct - self.in_network - 1)
        self.symbol_counts = np.zeros(gru.SYMBOLS)
        self.symbol_counts[0] = self.end_count
        self.symbol_counts[1 : 1 + self.in_network] = self.counts[: self.in_network]
        self.symbol_counts[-1] = self.other_tokens

    def plain(self) -> dict:
        """What tasks need, in types that a worker without this package can load."""
        return {k: getattr(self, k) for k in ("words", "counts", "in_network", "other", "other_tokens", "other_distinct", "end_count")}


def _ranked(texts: pa.Array, known: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts, their ranks among ``known`` (-1: none), and where each text's words begin and end."""
    words, bounds = words_of(texts)
    return words, pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64), bounds


def _with_ends(values: np.ndarray, bounds: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """``values`` of words with ``end`` behind each text's, and where each text begins."""
    return np.insert(values, bounds[1:], end), bounds[:-1] + np.arange(len(bounds) - 1)


def _symbols(ranks: np.ndarray, vocab: dict) -> np.ndarray:
    """Symbols of words given by rank (-1: not among the known)."""
    inside = (ranks >= 0) & (ranks < vocab["in_network"])
    return np.where(inside, ranks + 1, vocab["other"]).astype(np.int16)


def sequences(docs: DataFrame, vocabulary) -> DataFrame:
    """round, symbols (16-bit numbers) of each row of ``docs`` (doc_id, text), whole."""

    def read(batches):
        vocab = vocabulary.value
        known = pa.array(vocab["words"][: vocab["in_network"]], pa.binary()).view(pa.string())
        for batch in batches:
            _, ranks, bounds = _ranked(batch.column(1), known)
            symbols, begin = _with_ends(_symbols(ranks, vocab), bounds, 0)
            offsets = (2 * np.append(begin, len(symbols))).astype(np.int32)
            out = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(symbols)])
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["round", "symbols"])

    return docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)).cast("int").alias("round"), "text").mapInArrow(read, "round int, symbols binary")


def trained(parts: DataFrame, flat: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The network after ``rounds`` of training copies by partition on the round's ``parts`` and averaging them."""
    spark = parts.sparkSession
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(flat)

        def fit(batches, sent=sent, k=k):
            new, n = gru.train(sent.value, (np.frombuffer(x.as_buffer(), np.int16) for b in batches for x in b.column(0)), 0, rate=0.01 / (1 + k))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(gru.SIZE)), pa.array(new.astype(np.float64) * n), pa.array(np.full(gru.SIZE, n, np.float64))], ["at", "w", "n"])

        # One row per weight: copies are summed by Spark, the driver gets the network alone.
        copies = parts.where(F.col("round") == k).select("symbols").mapInArrow(fit, "at long, w double, n double")
        mean = copies.groupBy("at").agg((F.sum("w") / F.sum("n")).alias("w")).toArrow()
        if mean.num_rows:
            flat = np.zeros(gru.SIZE, np.float32)
            flat[mean.column("at").to_numpy()] = mean.column("w").to_numpy()
        sent.destroy()
    return flat


def _scored(docs: DataFrame, vocabulary, network) -> DataFrame:
    """For each row of ``docs`` (doc_id, held_out, text): what the known words give, and the other words with their numbers."""

    def read(batches):
        from pyspark import TaskContext

        vocab, row = vocabulary.value, TaskContext.get().partitionId() << 33
        known_words, inside = pa.array(vocab["words"], pa.binary()).view(pa.string()), vocab["in_network"]
        log_count = np.append(np.log10(vocab["counts"] + 1.0), 0.0)  # the last one (-1) for words that are not known
        outside = np.log10(vocab["other_tokens"] + vocab["other_distinct"] + 1.0)
        end = (np.log10(vocab["end_count"] + 1.0), int(vocab["end_count"] > 0))
        for batch in batches:
            n = batch.num_rows
            words, ranks, bounds = _ranked(batch.column(2), known_words)
            symbols, begin = _with_ends(_symbols(ranks, vocab), bounds, 0)
            score = gru.score(network.value, np.split(symbols, begin[1:]) if n else [], 0) / np.log(10)
            per_text = lambda values, last: np.add.reduceat(_with_ends(values, bounds, last)[0], begin) if n else np.zeros(0)  # noqa: B023, E731
            logs = log_count[ranks]
            known = per_text((ranks >= 0).astype(np.int64), end[1])
            no_symbol = per_text(np.where((ranks < 0) | (ranks >= inside), logs - outside, 0.0), 0.0)
            # The other words of each text, each different one once; Arrow's groups come in no order.
            rest = np.flatnonzero(ranks < 0)
            owner = np.searchsorted(bounds, rest, side="right") - 1
            groups = pa.table([pa.array(owner), words.take(pa.array(rest)).view(pa.binary())], ["at", "word"]).group_by(["at", "word"], use_threads=False).aggregate([("word", "count")])
            groups = groups.take(pa.array(np.argsort(groups.column("at").to_numpy(), kind="stable")))
            offsets = np.append(0, np.cumsum(np.bincount(groups.column("at").to_numpy(), minlength=n))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), groups.column(c).combine_chunks()) for c in ("word", "word_count")]
            numbers = [pa.array(row + np.arange(n)), pa.array(np.diff(bounds) + 1), pa.array(known.astype(np.int64)), pa.array(per_text(logs, end[0])), pa.array(no_symbol)]
            row += n
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score), *numbers, *lists],
                                             ["doc_id", "held_out", "network", "row", "n_tokens", "known", "log_counts", "no_symbol", "rest", "times"])

    return docs.mapInArrow(read, "doc_id long, held_out boolean, network double, row long, n_tokens long, known long, log_counts double, no_symbol double, rest array<binary>, times array<long>")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text)."""
    sc = docs.sparkSession.sparkContext
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 7) == 2).alias("held_out"), F.col("text").cast("binary").alias("text"))
    training = rows.where(~F.col("held_out"))
    counts = pin(word_counts(training), "counts")
    vocab = Vocabulary(counts)
    vocabulary = sc.broadcast(vocab.plain())
    parts = pin(sequences(training, vocabulary), "sequences")
    network = sc.broadcast(trained(parts, gru.initial(vocab.symbol_counts)))
    scored = pin(_scored(rows, vocabulary, network), "scored")
    rest = scored.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    found = rest.join(counts, "word", "left")
    by_row = found.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("more_logs"))
    out = scored.drop("rest", "times").join(pin(by_row, "rest"), "row", "left")
    logs = F.coalesce("more_logs", F.lit(0.0))
    total = float(np.log10(vocab.tokens + vocab.distinct + 1.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
                      (F.col("log_counts") + logs - F.col("n_tokens") * F.lit(total)).alias("base_score"), (F.col("network") + F.col("no_symbol") + logs).alias("score"))
