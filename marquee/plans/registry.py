"""Data sets picked by name; an unknown name gives no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marquee.plans import cinema

EMPTY_SCHEMA = "dataset string"


def cinema_datasets(tables: dict[str, DataFrame]) -> dict[str, Callable[[], DataFrame]]:
    """The explorer's 11 overview sets over the venue tables."""
    return {name: (lambda df=df: df) for name, df in cinema.overview(tables).items()}


def dataset_by_name(spark: SparkSession, registry: dict[str, Callable[[], DataFrame]], name: str) -> DataFrame:
    fn = registry.get(name)
    return fn() if fn is not None else spark.createDataFrame([], EMPTY_SCHEMA)


def explorer_view(df: DataFrame) -> DataFrame:
    """B11/G7/G14 over a whole data set: every cell as display text (null -> dash,
    date-like text -> fixed date-time pattern, anything else as is)."""
    from pyspark.sql import functions as F

    from marquee.functions import columns as C

    return df.select([C.display_cell(F.col(c).cast("string")).alias(c) for c in df.columns])
