"""Request bodies as VARIANT, read with the reference's rules.

A body that is not a JSON object counts as an empty object, so every field is
missing.  Missing (SQL null) and JSON null stay distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST = 2**63 - 1


def parse_bodies(df: DataFrame, body: str = "body", out: str = "payload") -> DataFrame:
    """Add ``out``: the body as VARIANT when it is a JSON object, else null.
    (Two steps, so each body is parsed once.)"""
    parsed = df.withColumn("_parsed", F.try_parse_json(F.col(body)))
    return (parsed.withColumn(out, F.when(F.schema_of_variant("_parsed").startswith("OBJECT"), F.col("_parsed")))
            .drop("_parsed"))


def arrival(name: str) -> Column:
    """The arrival time, or the present if there is none."""
    return F.coalesce(F.col(name), F.current_timestamp().cast("timestamp_ntz")).alias(name)


def field(v: Column, name: str) -> Column:
    """Field value as VARIANT; SQL null when missing (JSON null stays a VARIANT null)."""
    return F.try_variant_get(v, f"$[\"{name}\"]", "variant")


def kind(v: Column) -> Column:
    """Type name of a VARIANT value (``VOID`` for JSON null)."""
    return F.schema_of_variant(v)


def truthy(v: Column) -> Column:
    """Python truthiness of a JSON value; missing and null are false."""
    t = kind(v)
    return (F.when(v.isNull() | (t == "VOID"), F.lit(False))
            .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
            .when(t == "STRING", F.try_variant_get(v, "$", "string") != "")
            .when(t.startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
            .when(t.startswith("OBJECT"), t != "OBJECT<>")
            .otherwise(F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(True))))


def py_int(v: Column, default: int = 0) -> tuple[Column, Column]:
    """``int(payload.get(name, default))`` -> (value, failed).

    Numbers truncate toward zero, booleans give 0/1, strings must hold an
    integer; null, fractional strings, arrays and objects fail."""
    t = kind(v)
    # Text as Python reads it: white space around, a sign, digits that single underscores may part.
    written = F.try_variant_get(v, "$", "string")
    digits = F.when(written.rlike(r"^\s*[+-]?\d+(_\d+)*\s*$"), F.regexp_replace(written, r"[\s_]", ""))
    # Whole numbers beyond BIGINT are kept at its ends: every later test has the same outcome for them.
    far = lambda x: F.when(x > 0, F.lit(LARGEST)).otherwise(F.lit(-LARGEST))
    number = F.coalesce(F.try_variant_get(v, "$", "bigint"), far(F.try_variant_get(v, "$", "double")))
    num = F.when(t == "STRING", F.when(digits.isNotNull(), F.coalesce(digits.try_cast("bigint"), far(digits.try_cast("double"))))).otherwise(number)
    value = F.when(v.isNull(), F.lit(default).cast("bigint")).otherwise(num)
    failed = v.isNotNull() & ((t == "VOID") | num.isNull() | t.startswith("ARRAY") | t.startswith("OBJECT"))
    return F.when(~failed, value), failed


def text(v: Column) -> Column:
    """Scalar JSON value as text (numbers print as JSON does); null otherwise."""
    return F.when(~kind(v).startswith("ARRAY") & ~kind(v).startswith("OBJECT"), F.try_variant_get(v, "$", "string"))


def str_or_blank(v: Column) -> Column:
    """``(payload.get(name) or '')`` for text fields: the string, else ''.
    (A truthy non-string makes the reference fail; it reads as '' here.)"""
    return F.coalesce(F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")), F.lit(""))


def items_crash(v: Column) -> Column:
    """True when iterating the item list the reference's way would fail:
    a null, a non-empty string or object, a number or boolean, or an array
    holding anything but objects.  Missing means an empty list."""
    t = kind(v)
    arr = F.try_variant_get(v, "$", "array<variant>")
    bad_elem = F.exists(arr, lambda x: ~F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))
    return (F.when(v.isNull(), F.lit(False))
            .when(t == "VOID", F.lit(True))
            .when(t.startswith("ARRAY"), F.coalesce(bad_elem, F.lit(False)))
            .when(t == "STRING", F.try_variant_get(v, "$", "string") != "")
            .when(t.startswith("OBJECT"), t != "OBJECT<>")
            .otherwise(F.lit(True)))


def explode_items(df: DataFrame, payload: str = "payload", name: str = "concessions",
                  keys: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """One row per element of the item list: (keys..., item_pos, item)."""
    arr = F.try_variant_get(field(F.col(payload), name), "$", "array<variant>")
    return df.select(*keys, F.posexplode(arr).alias("item_pos", "item"))
