"""B12, G10, G11, P1 arithmetic: exact DECIMAL money, HALF_UP to the cent."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.columns import col

# Pricing constants of the venue model.
TAX_RATE = Decimal("0.08")
TAX_FACTOR = Decimal("1.08")
REWARDS_DISCOUNT_RATE = Decimal("0.10")
TICKET_UNIT_PRICE = Decimal("12.00")


def money(c) -> Column:
    """Round HALF_UP to DECIMAL(10,2)."""
    return col(c).cast("decimal(10,2)")


def tax_of(subtotal) -> Column:
    """Tax is on the pre-discount subtotal."""
    return money(money(subtotal) * F.lit(TAX_RATE))


def total_of(subtotal, discount) -> Column:
    """``subtotal * 1.08 - discount`` (null discount counts as 0), to the cent."""
    return money(money(subtotal) * F.lit(TAX_FACTOR) - F.coalesce(money(discount), F.lit(Decimal("0.00"))))


def rewards_discount(subtotal, member) -> Column:
    """10 % of the subtotal for members, else 0.00."""
    return F.when(col(member), money(money(subtotal) * F.lit(REWARDS_DISCOUNT_RATE))) \
        .otherwise(F.lit(Decimal("0.00")).cast("decimal(10,2)"))


def with_order_totals(df: DataFrame, subtotal: str = "subtotal", discount: str = "discount") -> DataFrame:
    """Derive ``tax`` and ``total`` from subtotal and discount."""
    return df.withColumn("tax", tax_of(subtotal)).withColumn("total", total_of(subtotal, discount))


def decimals_as_double(df: DataFrame) -> DataFrame:
    """Output edge for engine-neutral comparison: DECIMAL columns -> DOUBLE.
    Values are exact decimals until here, so the double is the nearest one."""
    return df.select([F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
                      else F.col(f.name) for f in df.schema.fields])
