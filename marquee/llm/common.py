"""Helpers that the operators of this folder share."""

from __future__ import annotations

import gc
import sys
import types
import uuid
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.session import ensure_checkpoint_dir

WORD = "[^\\x20\\x09-\\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` once as Parquet in the shared folder and read it back.

    Unlike a checkpoint it is computed once without caching, and later reads prune columns."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns ``names`` by exact name; other columns, also ones that differ in case only or
    repeat a name (the first one counts), cannot make them ambiguous."""
    if len({c.lower() for c in df.columns}) < len(df.columns):
        cols, df = df.columns, df.toDF(*(f"_{i}" for i in range(len(df.columns))))
        return df.select(*(F.col(f"_{cols.index(n)}").alias(n) for n in names))
    return df.select(*names)


def keeping_columns(docs: DataFrame, needs: tuple[str, ...], rows_of) -> DataFrame:
    """``rows_of`` a frame in which only the columns ``needs`` have their names; it drops or repeats rows, and
    all columns come back as they were, whatever they are called."""
    cols = docs.columns
    names = [c if c in needs and cols.index(c) == i else f"_other{i}" for i, c in enumerate(cols)]
    return rows_of(docs.toDF(*names)).select(*names).toDF(*cols)


def crc_mod(column: str, n: int):
    """crc32 of the column's text, modulo ``n`` (a null counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, label (0 or 1) of each doc_id that has one label; ids with two different ones are left out."""
    known = pick(labels, "doc_id", column).where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    return known.groupBy("doc_id").agg(F.min(column).alias(column), F.max(column).alias("_other")).where(F.col(column) == F.col("_other")).drop("_other")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def release() -> None:
    """Gives memory that Arrow and malloc hold free back to the system (a worker process outlives its tasks)."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # malloc_trim is glibc's
        ctypes.CDLL(None).malloc_trim(0)


def releasing(task):
    """``task`` (batches -> batches), after which the worker gives free memory back."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            release()

    return run


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker process.

    The package's functions travel by value, so their module globals are new in each task; what a
    worker may use again in later tasks (tokenizers, words seen) is kept in a module of its own.
    Only the last name's store is kept: what an earlier operator held is freed."""
    module = sys.modules.setdefault("_marquee_llm_worker", types.ModuleType("_marquee_llm_worker"))
    if getattr(module, "of", None) != name:
        held = hasattr(module, "of")
        module.of, module.store = name, {}
        if held:
            gc.collect()
            release()
    return module.store


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Jobs that run inside send at most so many rows at a time to a Python worker (rows that hold whole texts or sets)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
