"""Token ids of documents in Simple-8b shard files, and reading them back.

Documents are dealt out by ranges of doc_id and sorted within; each task writes one shard, so that shards
in order hold all ids in ascending doc_id order.  A shard file is

    b"S8B1", block, block, ..., index, length of the index (8 bytes), b"S8B1"

and its index (an Arrow stream) has one row per block: byte offset, words, escapes, ids; and one per
document: doc_id, ids.  A block decodes by itself.  Memory is bounded by a block and the shard's index.

Defined results: a null or empty text has the end id alone; rows with equal doc_id follow each other in an
order fixed by their text; null doc_ids come first; an empty table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm import files, simple8b
from marquee.llm.common import batch_rows, pick, pin, shared_path
from marquee.llm.tokens import Encoder

MAGIC = b"S8B1"
END_ID = 2
#: Texts that a Python worker gets at a time, and bytes of them that are split at once.
ROWS, AT_ONCE = 2_000, 1 << 23


class ShardWriter:
    def __init__(self, uri: str):
        self.file, self.held, self.size = files.Writer(uri), [], 0
        self.file.write(MAGIC)
        self.blocks, self.docs = [], []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= simple8b.BLOCK:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([np.zeros(0, "<u4"), *self.held])
        end = len(ids) if last else len(ids) // simple8b.BLOCK * simple8b.BLOCK
        for i in range(0, end, simple8b.BLOCK):
            part = ids[i : min(end, i + simple8b.BLOCK)]
            words, places, values = simple8b.pack(part)
            self.blocks.append((self.file.at, len(words), len(places), len(part)))
            self.file.write(words.astype("<u8").tobytes() + places.astype("<u4").tobytes() + values.astype("<u8").tobytes())
        rest = ids[end:].copy()
        self.held, self.size = [rest], len(rest)

    def close(self) -> tuple[int, int]:
        self._flush(last=True)
        table = lambda names, rows: pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})
        sink = pa.BufferOutputStream()
        for t in (table(("offset", "words", "escapes", "ids"), self.blocks), table(("doc_id", "ids"), self.docs)):
            with pa.ipc.new_stream(sink, t.schema) as w:
                w.write_table(t)
        index = sink.getvalue().to_pybytes()
        self.file.write(index + len(index).to_bytes(8, "little") + MAGIC)
        self.file.close()
        return len(self.docs), sum(n for _, n in self.docs)


def read_shard(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of each document of a shard, in order; holds a document and a block at a time."""
    fs, path = files.opened(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        f.seek(size - 12)
        tail = f.read(12)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not a complete shard")
        length = int.from_bytes(tail[:8], "little")
        f.seek(size - 12 - length)
        source = pa.BufferReader(f.read(length))
        blocks, docs = (pa.ipc.open_stream(source).read_all() for _ in range(2))
        held, block = np.zeros(0, np.uint64), iter(zip(*(c.to_pylist() for c in blocks.columns), strict=True))
        for doc_id, n in zip(*(c.to_pylist() for c in docs.columns), strict=True):
            parts, have = [held], len(held)
            while have < n:
                offset, words, escapes, ids = next(block)
                f.seek(offset)
                raw = f.read(8 * words + 12 * escapes)
                got = simple8b.unpack(np.frombuffer(raw, "<u8", words), ids, np.frombuffer(raw, "<u4", escapes, 8 * words),
                                      np.frombuffer(raw, "<u8", escapes, 8 * words + 4 * escapes))
                parts.append(got)
                have += ids
            whole = np.concatenate(parts) if len(parts) > 1 else held
            held = whole[n:]
            yield doc_id, whole[:n].astype("<u4")


def write_shards(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Encodes every text of ``docs`` (doc_id, text) into shard files; returns shard, path, docs, ids, start (ids before it)."""
    folder = shared_path(docs.sparkSession, "tokens")
    end = np.array([end_id], "<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard, out = Encoder.of(vocabulary), TaskContext.get().partitionId(), None
        path = f"{folder}/shard-{shard:06d}.s8b"
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(texts, AT_ONCE), strict=True):
                out = out or ShardWriter(path)
                out.add(doc_id, np.concatenate([ids, end]))
        if out:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "path": [path], "docs": pa.array([n_docs], pa.int64()), "ids": pa.array([n_ids], pa.int64())})

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    placed = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    with batch_rows(docs.sparkSession, ROWS):
        shards = pin(placed.mapInArrow(write, "shard long, path string, docs long, ids long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return shards.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_ids(shards: DataFrame, digest: bool = False) -> DataFrame:
    """Reads shard files: doc_id, start, n_tokens and, from the ids read, ids (array) or ids_crc32."""
    import zlib

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list = []
                held = 0
                for doc_id, ids in read_shard(path):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()) if digest else ids))
                    start, held = start + len(ids), held + len(ids)
                    if len(rows) >= 4096 or held >= 1 << 20:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    def made(rows) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        last = pa.array(cols[3], pa.int64() if digest else pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    # One shard to a task: its row is all that is shuffled.
    n = max(1, shards.count())
    tasks = shards.select("path", "start", "shard").repartitionByRange(n, "shard").select("path", "start")
    return tasks.mapInArrow(load, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>"))
