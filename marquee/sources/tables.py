"""Typed scans, seed load, version-gated rebuild and drops (A1, A3, A4, A5).

A table store is a folder holding one Parquet folder per table plus a
``_meta`` table with the schema version.  A table's folder may hold folders of
batches (each written as a whole by one stream batch).  A table that has been
replaced has numbered snapshots beside its folder; readers take the newest one that
is complete, so that a writer never touches what a reader may be reading.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.money import with_order_totals
from marquee.schema import LOAD_ORDER, SCHEMAS
from marquee.sources import seed

SCHEMA_VERSION = 2
META = "_meta"
SNAPSHOTS, VERSION = "__snapshots", "v-"


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def versions(spark: SparkSession, folder: str) -> dict[int, bool]:
    """The numbered folders in ``folder``, and whether each is complete (its success marker is written last)."""
    fs, path = file_system(spark, folder)
    if not fs.exists(path):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return {int(n.removeprefix(VERSION)): exists(spark, f"{folder}/{n}/_SUCCESS") for n in names if n.startswith(VERSION) and n.removeprefix(VERSION).isdigit()}


def version_path(folder: str, version: int) -> str:
    return f"{folder}/{VERSION}{version:010d}"


def current_path(spark: SparkSession, root: str, name: str) -> str:
    """Where a table's rows are: its newest complete snapshot, else its folder."""
    folder = table_path(root, name) + SNAPSHOTS
    complete = [v for v, done in versions(spark, folder).items() if done]
    return version_path(folder, max(complete)) if complete else table_path(root, name)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A1: typed scan of one table (explicit schema, nothing inferred), batch folders included."""
    return spark.read.schema(SCHEMAS[name]).option("recursiveFileLookup", "true").parquet(current_path(spark, root, name))


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, root, name) for name in LOAD_ORDER}


def seed_frames(spark: SparkSession) -> dict[str, DataFrame]:
    """A3: the seed rows as typed DataFrames; order tax and total are derived."""
    rows = seed.seed_rows()
    frames = {name: spark.createDataFrame(data, SCHEMAS[name]) for name, data in rows.items()}
    src = spark.createDataFrame(
        [(n, c, Decimal(s), Decimal(d)) for n, c, s, d in seed.ORDER_SOURCE],
        "order_number bigint, order_customer_id string, subtotal decimal(10,2), discount decimal(10,2)")
    orders = (with_order_totals(src)
              .withColumn("created_at", F.lit(seed.SEED_ORDER_CREATED_AT).cast("timestamp_ntz")))
    frames["orders"] = orders.select([F.col(f.name).cast(f.dataType) for f in SCHEMAS["orders"].fields])
    return {name: frames[name] for name in LOAD_ORDER}


def write_tables(frames: dict[str, DataFrame], root: str, mode: str = "overwrite") -> None:
    """Write tables parents first.  ``mode='ignore'`` creates only what is missing."""
    for name in LOAD_ORDER:
        if name in frames:
            frames[name].write.mode(mode).parquet(table_path(root, name))


def stored_version(spark: SparkSession, root: str) -> int:
    """The recorded schema version; 0 only if none was ever recorded.  A version that cannot be read is an error."""
    if not exists(spark, table_path(root, META)):
        return 0
    return int(spark.read.schema("version int").parquet(table_path(root, META)).agg(F.max("version")).first()[0] or 0)


def init_store(spark: SparkSession, root: str, version: int = SCHEMA_VERSION) -> str:
    """A4: rebuild from seed when the stored version is lower, else create only
    what is missing.  Returns ``'rebuilt'`` or ``'kept'``."""
    if stored_version(spark, root) < version:
        drop_tables(spark, root)
        write_tables(seed_frames(spark), root, "overwrite")
        spark.createDataFrame([(version,)], "version int").write.mode("overwrite").parquet(table_path(root, META))
        return "rebuilt"
    empty = {name: spark.createDataFrame([], SCHEMAS[name]) for name in LOAD_ORDER}
    write_tables(empty, root, "ignore")
    return "kept"


def drop_tables(spark: SparkSession, root: str) -> list[str]:
    """A5: remove the tables children first, skipping absent ones."""
    dropped = []
    for name in list(reversed(LOAD_ORDER)) + [META]:
        # Snapshots first: a drop that is cut off never brings back rows that a snapshot has replaced.
        found = [remove(spark, table_path(root, name) + SNAPSHOTS), remove(spark, table_path(root, name))]
        if any(found):
            dropped.append(name)
    return dropped


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a folder if it is there; one that stays is an error."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return False
    if not fs.delete(p, True) and fs.exists(p):
        raise OSError(f"cannot remove {path}")
    return True


def file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object of ``path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)

