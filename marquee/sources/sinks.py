"""Sinks: named result sets as JSON (A8), appends (A9), seat snapshots (A10).

A snapshot is never written over the path it is read from: it gets a numbered folder of
its own, which counts from the moment its success marker is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.schema import DEFAULTS, SCHEMAS
from marquee.sources.tables import SNAPSHOTS, current_path, remove, table_path, version_path, versions


def write_named_json(sets: dict[str, DataFrame], root: str, mode: str = "overwrite") -> list[str]:
    """One JSON folder per named result set (rows keep all their columns, also
    null ones; an empty set still writes its folder)."""
    written = []
    for name, df in sets.items():
        df.write.mode(mode).option("ignoreNullFields", "false").json(f"{root.rstrip('/')}/{name}")
        written.append(name)
    return written


def conform_to(df: DataFrame, table: str) -> DataFrame:
    """Project rows onto a table's schema, filling declared defaults."""
    defaults = DEFAULTS.get(table, {})
    cols = []
    for f in SCHEMAS[table].fields:
        if f.name in df.columns:
            c = F.col(f.name)
            if f.name in defaults:
                c = F.coalesce(c, F.lit(defaults[f.name]))
        else:
            c = F.lit(defaults.get(f.name))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(cols)


def append_rows(df: DataFrame, root: str, table: str) -> None:
    """Append rows to a stored table."""
    conform_to(df, table).write.mode("append").parquet(current_path(df.sparkSession, root, table))


def append_batch(df: DataFrame, root: str, table: str, batch: str) -> None:
    """Append the rows of one batch as a whole, in a folder of its own.  Appending the batch again replaces
    what the first time wrote, so that no stored row has to be read to find out what is there already."""
    conform_to(df, table).write.mode("overwrite").parquet(f"{current_path(df.sparkSession, root, table)}/{batch}")


def replace_table(df: DataFrame, root: str, table: str) -> None:
    """A10: write a new snapshot of a table.  A crash at any point leaves the old or the new snapshot in effect, and a
    folder that was cut off never counts.  The snapshot before stays for those who are reading it; older ones go.
    Of two writers at once the second fails: both would write the same number."""
    spark, folder = df.sparkSession, table_path(root, table) + SNAPSHOTS
    before = versions(spark, folder)
    new = max(before, default=0) + 1
    conform_to(df, table).write.mode("errorifexists").parquet(version_path(folder, new))
    last = max((v for v, done in before.items() if done), default=0)
    for v in before:
        if v != last:
            remove(spark, version_path(folder, v))
