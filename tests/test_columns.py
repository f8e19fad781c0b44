"""Scalar column functions: names, ids, display text, money."""

from decimal import Decimal

from conftest import rows
from pyspark.sql import functions as F

from marquee.functions import columns as C
from marquee.functions import money as M


def test_split_full_name(spark):
    df = spark.createDataFrame([("   ",), ("Cher",), ("Ana  de la Cruz",), ("\tBo Li ",), (None,)], "n string")
    got = rows(df.select(C.split_full_name("n").alias("s")).select("s.firstname", "s.lastname"))
    assert got == [("Guest", "Customer"), ("Cher", "Customer"), ("Ana", "de la Cruz"), ("Bo", "Li"),
                   ("Guest", "Customer")]


def test_choose_name(spark):
    df = spark.createDataFrame([("Jo", "", "x y"), ("", "Lee", "x y"), ("", " ", "x y")], "f string, l string, n string")
    got = rows(df.select(C.choose_name("f", "l", "n").alias("s")).select("s.firstname", "s.lastname"))
    assert got == [("Jo", "Customer"), ("Guest", "Lee"), ("x", "y")]


def test_ids_and_text(spark):
    df = spark.createDataFrame([("C007",), ("C1000",), ("X9",), ("C12a",)], "id string")
    assert rows(df.select(C.customer_id_number("id"))) == [(7,), (1000,), (None,), (None,)]
    assert rows(spark.range(3).select(C.customer_id_text(F.col("id") * 999))) == [("C000",), ("C999",), ("C1998",)]


def test_display_datetime(spark):
    df = spark.createDataFrame([(None,), ("",), ("2026-04-17T12:00:00",), ("2026-04-17 12:00:00.5",),
                                ("2026-04-17",), ("TBD later in Theatre 2",)], "v string")
    assert rows(df.select(C.display_cell("v"))) == [
        ("—",), ("",), ("2026-04-17 12:00:00",), ("2026-04-17 12:00:00",), ("2026-04-17",),
        ("TBD later in Theatre 2",)]
    assert rows(df.select(C.display_datetime("v"))) == [
        (None,), ("",), ("2026-04-17 12:00:00",), ("2026-04-17 12:00:00",), ("2026-04-17 00:00:00",),
        ("TBD later in Theatre 2",)]


def test_or_dash_and_labels(spark):
    df = spark.createDataFrame([(None,), ("",), ("Large",)], "s string")
    assert rows(df.select(C.or_dash("s"))) == [("—",), ("—",), ("Large",)]


def test_money_half_up(spark):
    df = spark.createDataFrame([(Decimal("0.15"), True), (Decimal("0.35"), True), (Decimal("24.00"), True),
                                (Decimal("27.00"), False)], "s decimal(10,2), m boolean")
    out = rows(df.select(M.rewards_discount("s", "m"), M.tax_of("s"),
                         M.total_of("s", M.rewards_discount("s", "m"))))
    assert [tuple(str(x) for x in r) for r in out] == [("0.02", "0.01", "0.14"), ("0.04", "0.03", "0.34"),
                                                       ("2.40", "1.92", "23.52"), ("0.00", "2.16", "29.16")]
