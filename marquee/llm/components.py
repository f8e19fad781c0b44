"""Connected components of an edge table by contraction in random order (joins and aggregations only).

Each round, every node goes to the neighbour (or itself) of the smallest hash in that round; edges are carried to
the new nodes, loops and repeats go.  A round leaves a constant share of the nodes, whatever the graph's shape.  All
inputs of joins are written tables, so that a hot node's rows can be split over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import pin

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) for each end of ``edges`` (a, b long, not null)."""
    left = pin(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    goes = None
    for k in range(MAX_ROUNDS):
        if left.isEmpty():
            break
        rank = lambda c, k=k: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("to"))
        both = left.select(F.col("a").alias("id"), rank("b").alias("r")).unionAll(left.select(F.col("b").alias("id"), rank("a").alias("r")))
        step = both.groupBy("id").agg(F.min("r").alias("r"))
        step = pin(step.select("id", F.least("r", rank("id")).getField("to").alias("to")), "step")
        goes = step.withColumnRenamed("to", "root") if goes is None else pin(
            goes.join(step.select(F.col("id").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root")), "roots")
        at_a = pin(left.join(step.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").select("x", "b"), "moved")
        moved = at_a.join(step.select(F.col("id").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        left = pin(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("contraction has not ended")
    if goes is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    goes = goes if k > 1 else pin(goes, "roots")
    least = pin(goes.groupBy("root").agg(F.min("id").alias("component")), "least")
    return goes.join(least, "root").select("id", "component")
