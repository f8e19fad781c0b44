"""Conform tables of the older layout to the final one.

The reference drops and reloads; here old rows are mapped column by column, and rows
that cannot satisfy a final NOT NULL rule go to a reject frame that says which ones.
A folder may hold files of both layouts: they are read with the columns of both (a
column that a file lacks is null there), and each row takes the final column where it
has one, else what the old columns give.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.money import TAX_FACTOR, money, tax_of, total_of
from marquee.schema import DEFAULTS, SCHEMAS, required_columns

# Columns that only the older layout has.
OLD_COLUMNS = {
    "customers": "city string",
    "orders": "order_total decimal(10,2), order_discount decimal(10,2)",
    "concessions": "stock int",
    "shifts": "",
}
SOURCE_FILE = "source_file"


def read_mixed(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The rows of a folder with files of either layout, or of both, and the file of each row."""
    old = T._parse_datatype_string(OLD_COLUMNS[table]).fields if OLD_COLUMNS[table] else []
    both = T.StructType([T.StructField(f.name, f.dataType, True) for f in [*SCHEMAS[table].fields, *old]])
    return spark.read.schema(both).parquet(path).select("*", F.col("_metadata.file_path").alias(SOURCE_FILE))


def _final(df: DataFrame, table: str, **values) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy the final rules, and the others with a reason (the required columns that are missing)."""
    defaults = DEFAULTS.get(table, {})
    cols = []
    for f in SCHEMAS[table].fields:
        c = values.get(f.name, F.col(f.name) if f.name in df.columns else F.lit(None))
        c = c.cast(f.dataType)
        cols.append((F.coalesce(c, F.lit(defaults[f.name])) if f.name in defaults else c).alias(f.name))
    df = df.select(*cols, *[c for c in (SOURCE_FILE,) if c in df.columns])
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required_columns(table)]))
    df = df.withColumn("reason", F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))))
    return df.where(F.col("reason").isNull()).select(*SCHEMAS[table].names), df.where(F.col("reason").isNotNull())


def _first(df: DataFrame, *names: str):
    """The first of the columns that has a value; columns that the frame lacks count as null."""
    return F.coalesce(*[F.col(n) if n in df.columns else F.lit(None) for n in names], F.lit(None))


def conform_customers(old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``city`` becomes ``home_city``; membership defaults to false."""
    return _final(old, "customers", home_city=_first(old, "home_city", "city"))


def conform_orders(old: DataFrame, derive_subtotal: bool = False) -> tuple[DataFrame, DataFrame]:
    """``order_total``/``order_discount`` to subtotal/tax/discount/total.

    The old total has no subtotal split; it is derived as (total + discount) / 1.08
    only when asked, otherwise subtotal stays null and the row is rejected."""
    old_discount = _first(old, "order_discount").cast("decimal(10,2)")
    derived = money((_first(old, "order_total").cast("decimal(10,2)") + F.coalesce(old_discount, F.lit(Decimal("0.00")))) / F.lit(TAX_FACTOR))
    subtotal = F.coalesce(_first(old, "subtotal").cast("decimal(10,2)"), derived if derive_subtotal else F.lit(None).cast("decimal(10,2)"))
    df = old.withColumns({"subtotal": subtotal, "discount": F.coalesce(_first(old, "discount").cast("decimal(10,2)"), old_discount)})
    return _final(df, "orders", tax=F.coalesce(_first(df, "tax").cast("decimal(10,2)"), tax_of("subtotal")),
                  total=F.coalesce(_first(df, "total").cast("decimal(10,2)"), total_of("subtotal", "discount")))


def conform_concessions(old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``stock`` is gone from the final layout."""
    return _final(old, "concessions")


def conform_shifts(old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``shift_department_id`` became NOT NULL: shifts without one are rejected."""
    return _final(old, "shifts")
