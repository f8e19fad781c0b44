"""Gap-free numbering and running offsets in one global order, in the JVM.

W1 numbers rows across the whole table: they are ranged on the order keys (so a hot
key is split across ranges) and pinned with their place; a count is the place plus the
rows of earlier ranges, a weighted sum is a window over the range plus the weights of
earlier ranges.  The table of earlier ranges has one row per range, which bounds the
broadcast.  Callers pass the few columns that the numbering needs.

W3 numbers rows within a key: ranges of whole keys, so that the numbering window and the
final order by key need one exchange together.  Only keys with more rows than a task
should sort are ranged by their rows as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.session import materialize

#: A key with more rows than this is numbered by several tasks.
HOT_ROWS = 1_000_000
#: ``monotonically_increasing_id``: the partition stands above, the row's place in it below this bit.
PLACE_BITS = 33


def pinned_ranges(df: DataFrame, order_cols: list[str]) -> DataFrame:
    """Range-partition and sort on ``order_cols``; add the range ``_pid`` and the row's place ``_at`` in it.

    The result is checkpointed, so partition contents survive any recomputation and
    several consumers see the same ranges."""
    # No partition count is named: adaptive execution merges small ranges.
    ranged = (df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_id", F.monotonically_increasing_id())
              .withColumns({"_pid": F.shiftright("_id", PLACE_BITS).cast("int"),
                            "_at": F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))}).drop("_id"))
    return materialize(ranged)


def global_prefix(df: DataFrame, order_cols: list[str], weights: dict[str, Column | None]) -> DataFrame:
    """Add, for each ``name -> weight``, the column ``name`` = sum of the weight
    over all rows strictly before this one in the global order (weight None = 1; a null weight counts 0).
    ``order_cols`` must identify rows uniquely for the result to be deterministic."""
    summed = {k: w for k, w in weights.items() if w is not None}
    wcols = {f"_w_{k}": F.coalesce(w.cast("bigint"), F.lit(0)) for k, w in summed.items()}
    ranged = pinned_ranges(df.withColumns(wcols) if wcols else df, order_cols)
    of_range = lambda k: F.sum(f"_w_{k}") if k in summed else F.count(F.lit(1))
    totals = ranged.groupBy("_pid").agg(*[of_range(k).alias(f"_t_{k}") for k in weights])
    # One row per range: the window over it is bounded by the number of ranges.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in weights])
    within = Window.partitionBy("_pid").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({f"_l_{k}": F.coalesce(F.sum(f"_w_{k}").over(within), F.lit(0)) if k in summed else F.col("_at") for k in weights})
    out = local.join(F.broadcast(offsets), "_pid")
    out = out.withColumns({k: (F.col(f"_o_{k}") + F.col(f"_l_{k}")).cast("bigint") for k in weights})
    return out.drop("_pid", "_at", *wcols, *[f"_l_{k}" for k in weights], *[f"_o_{k}" for k in weights])


def consecutive_ids(df: DataFrame, order_cols: list[str], start: Column | int, name: str = "id") -> DataFrame:
    """Number rows ``start + 1, start + 2, ...`` in the global order."""
    start_col = start if isinstance(start, Column) else F.lit(start)
    out = global_prefix(df, order_cols, {"_n": None})
    return out.withColumn(name, (start_col + F.col("_n") + 1).cast("bigint")).drop("_n")


def row_number_within(df: DataFrame, keys: list[str], order_cols: list[str], name: str = "row_no", sizes: DataFrame | None = None) -> DataFrame:
    """``row_number() OVER (PARTITION BY keys ORDER BY order_cols)``, ordered by keys and number (keys must not be null).

    Rows are ranged on the keys: the window and the order by keys and number need no other exchange.  Keys with more than
    HOT_ROWS rows (``sizes``: keys, n, an upper bound that is cheaper to get; else they are counted) are numbered apart:
    ranged on keys and order, numbered within each range by Spark's own window, and shifted by the rows of the key in
    earlier ranges (at most two such rows per range: each range ends at most one hot key and begins another)."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if sizes is None else sizes.groupBy(*keys).agg(F.sum("n").alias("n"))
    hot = sizes.where(F.col("n") > HOT_ROWS).select(*keys)
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order_cols)).cast("bigint")
    if hot.isEmpty():
        # The window's partitions are the ranges of the keys, and so are those of the final order.
        return df.repartitionByRange(*keys).withColumn(name, number(*keys)).orderBy(*keys, name)
    hot = materialize(hot)
    cold = df.join(hot, keys, "left_anti").withColumn(name, number(*keys))
    ranged = pinned_ranges(df.join(hot, keys, "left_semi"), [*keys, *order_cols]).drop("_at")
    counts = ranged.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", *keys, F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_off"))
    numbered = ranged.withColumn(name, number(*keys, "_pid")).join(F.broadcast(offsets), ["_pid", *keys])
    # BIGINT: a hot key at scale can hold more than 2**31 rows.
    numbered = numbered.withColumn(name, (F.col(name) + F.col("_off")).cast("bigint")).drop("_pid", "_off")
    return cold.unionByName(numbered).orderBy(*keys, name)
