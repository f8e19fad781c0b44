"""Star binding: the synthetic star tables seen through venue column roles.

Each view is a projection (plus, where noted, a filter or a join) that Catalyst
folds into the scan, so filters and pruning still reach Parquet.  The SQL
text beside each view is the same definition for the DuckDB oracle.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.money import REWARDS_DISCOUNT_RATE, money, with_order_totals

STAR_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Fixed values of the binding (shared with the oracle SQL).
MEMBER_BALANCE = 5000
SHOW_BASE_TS = "2026-04-17 10:00:00"
FILM_BASE_DATE = "2026-04-16"
SEAT_BASE, SEAT_SPREAD = 25, 32


# Declared schemas of the star tables: scans need no inference.
STAR_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


class StarTables(dict):
    """Table name -> DataFrame, each scan created on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __missing__(self, name: str) -> DataFrame:
        df = self.spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")
        self[name] = df
        return df


def load(spark: SparkSession, sf_dir: str) -> StarTables:
    return StarTables(spark, sf_dir)


def _c(name):
    return F.col(name)


# ---- films -------------------------------------------------------------------
def films_from_part(part: DataFrame) -> DataFrame:
    return part.select(
        _c("p_partkey").alias("film_id"), _c("p_name").alias("film_title"), _c("p_brand").alias("film_rating"),
        _c("p_size").alias("film_length_minutes"), _c("p_type").alias("film_language"),
        F.when(_c("p_size") % 10 != 0, F.date_add(F.lit(FILM_BASE_DATE).cast("date"), _c("p_size"))
               .cast("timestamp_ntz")).alias("film_last_showing_date"))


FILMS_FROM_PART = f"""SELECT p_partkey AS film_id, p_name AS film_title, p_brand AS film_rating,
  p_size AS film_length_minutes, p_type AS film_language,
  CASE WHEN p_size % 10 <> 0 THEN CAST(DATE '{FILM_BASE_DATE}' + p_size AS TIMESTAMP) END AS film_last_showing_date
  FROM part"""


def films_from_customer(customer: DataFrame) -> DataFrame:
    return customer.select(_c("c_custkey").alias("film_id"), _c("c_name").alias("film_title"))


FILMS_FROM_CUSTOMER = "SELECT c_custkey AS film_id, c_name AS film_title FROM customer"


# ---- showings ------------------------------------------------------------------
def showings_from_orders(orders: DataFrame) -> DataFrame:
    return orders.select(
        _c("o_orderkey").alias("showing_id"), _c("o_custkey").alias("film_id"),
        (_c("o_orderkey") % 7 + 1).cast("int").alias("film_theatre_number"),
        _c("o_orderdate").alias("film_showing_datetime"),
        (_c("o_orderkey") % 50).cast("int").alias("film_available_seats"))


SHOWINGS_FROM_ORDERS = """SELECT o_orderkey AS showing_id, o_custkey AS film_id,
  CAST(o_orderkey % 7 + 1 AS INTEGER) AS film_theatre_number, o_orderdate AS film_showing_datetime,
  CAST(o_orderkey % 50 AS INTEGER) AS film_available_seats FROM orders"""


def showings_from_part(part: DataFrame) -> DataFrame:
    return part.select(
        _c("p_partkey").alias("showing_id"), _c("p_partkey").alias("film_id"),
        (_c("p_size") % 7 + 1).cast("int").alias("film_theatre_number"),
        (F.lit(SHOW_BASE_TS).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), _c("p_size")))
        .alias("film_showing_datetime"),
        _c("p_size").alias("film_available_seats"))


SHOWINGS_FROM_PART = f"""SELECT p_partkey AS showing_id, p_partkey AS film_id,
  CAST(p_size % 7 + 1 AS INTEGER) AS film_theatre_number,
  TIMESTAMP '{SHOW_BASE_TS}' + to_hours(p_size) AS film_showing_datetime,
  p_size AS film_available_seats FROM part"""


def showings_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Showings for the seat schedule: one per line, available = quantity."""
    return lineitem.select(
        (_c("l_orderkey") * 8 + _c("l_linenumber")).alias("showing_id"), _c("l_partkey").alias("film_id"),
        _c("l_suppkey").alias("film_theatre_number"), _c("l_shipdate").alias("film_showing_datetime"),
        _c("l_quantity").cast("int").alias("film_available_seats"))


# ---- people --------------------------------------------------------------------
def email_of(segment, nation):
    return F.concat(F.lower(segment), F.lit("."), nation.cast("string"), F.lit("@mail.com"))


def customers_from_customer(customer: DataFrame) -> DataFrame:
    return customer.select(
        _c("c_custkey").alias("customer_id"), _c("c_mktsegment").alias("firstname"), _c("c_name").alias("lastname"),
        email_of(_c("c_mktsegment"), _c("c_nationkey")).alias("email"),
        F.lit(None).cast("string").alias("phone"), F.concat(F.lit("City "), _c("c_nationkey").cast("string"))
        .alias("home_city"), (_c("c_acctbal") >= MEMBER_BALANCE).alias("rewards_member"),
        F.lit(None).cast("string").alias("pref_pymt_method"))


CUSTOMERS_FROM_CUSTOMER = f"""SELECT c_custkey AS customer_id, c_mktsegment AS firstname, c_name AS lastname,
  lower(c_mktsegment) || '.' || CAST(c_nationkey AS VARCHAR) || '@mail.com' AS email,
  CAST(NULL AS VARCHAR) AS phone, 'City ' || CAST(c_nationkey AS VARCHAR) AS home_city,
  c_acctbal >= {MEMBER_BALANCE} AS rewards_member, CAST(NULL AS VARCHAR) AS pref_pymt_method FROM customer"""


def customers_from_supplier(supplier: DataFrame) -> DataFrame:
    return supplier.select(_c("s_suppkey").alias("customer_id"),
                           F.split_part(_c("s_name"), F.lit("#"), F.lit(1)).alias("firstname"),
                           F.split_part(_c("s_name"), F.lit("#"), F.lit(2)).alias("lastname"))


def employees_from_supplier(supplier: DataFrame) -> DataFrame:
    return supplier.select(
        _c("s_suppkey").alias("employee_id"), F.split_part(_c("s_name"), F.lit("#"), F.lit(1)).alias("firstname"),
        F.split_part(_c("s_name"), F.lit("#"), F.lit(2)).alias("lastname"),
        F.when(_c("s_acctbal") > 5000, "Department Supervisor").when(_c("s_acctbal") > 0, "Usher")
        .otherwise("Trainee").alias("job_title"),
        F.when(_c("s_suppkey") % 3 == 0, "Part time").otherwise("Full time").alias("status"),
        F.when(_c("s_suppkey") % 5 != 0, _c("s_nationkey")).alias("supervisor_id"), _c("s_nationkey").alias("department_id"))


EMPLOYEES_FROM_SUPPLIER = """SELECT s_suppkey AS employee_id, split_part(s_name, '#', 1) AS firstname,
  split_part(s_name, '#', 2) AS lastname,
  CASE WHEN s_acctbal > 5000 THEN 'Department Supervisor' WHEN s_acctbal > 0 THEN 'Usher' ELSE 'Trainee' END AS job_title,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Part time' ELSE 'Full time' END AS status,
  CASE WHEN s_suppkey % 5 <> 0 THEN s_nationkey END AS supervisor_id, s_nationkey AS department_id FROM supplier"""


def employees_by_region(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Employees whose department is the region of their nation (roster)."""
    e = employees_from_supplier(supplier)
    n = nation.select(_c("n_nationkey"), _c("n_regionkey"))
    return (e.join(n, e.department_id == n.n_nationkey)
            .select(*[e[c] for c in e.columns if c != "department_id"], n.n_regionkey.alias("department_id")))


def departments_from_nation(nation: DataFrame) -> DataFrame:
    return nation.select(_c("n_nationkey").alias("department_id"), _c("n_name").alias("department_name"))


def departments_from_region(region: DataFrame) -> DataFrame:
    return region.select(_c("r_regionkey").alias("department_id"), _c("r_name").alias("department_name"))


def supervisors_from_nation(nation: DataFrame) -> DataFrame:
    return nation.select(_c("n_nationkey").alias("supervisor_id"), _c("n_name").alias("firstname"),
                         F.lit("Lead").alias("lastname"), _c("n_regionkey").alias("department_id"))


SUPERVISORS_FROM_NATION = """SELECT n_nationkey AS supervisor_id, n_name AS firstname, 'Lead' AS lastname,
  n_regionkey AS department_id FROM nation"""


def employees_from_customer(customer: DataFrame) -> DataFrame:
    return customer.select(_c("c_custkey").alias("employee_id"), _c("c_mktsegment").alias("firstname"),
                           _c("c_name").alias("lastname"))


def shifts_from_events(events: DataFrame) -> DataFrame:
    return events.select(
        _c("event_id").alias("shift_id"), _c("user_id").alias("employee_id"),
        F.when(_c("event_type").isin("view", "click"), (_c("event_id") % 100).cast("int")).alias("showing_id"),
        _c("ts").alias("shift_start_datetime"),
        (_c("ts") + F.make_dt_interval(F.lit(0), F.lit(4))).alias("shift_end_datetime"),
        F.when(_c("user_id") % 6 != 0, (_c("user_id") % 25).cast("int")).alias("shift_department_id"))


def concessions_from_customer(customer: DataFrame) -> DataFrame:
    return customer.select(_c("c_custkey").alias("concession_id"), _c("c_name").alias("concession_name"),
                           _c("c_mktsegment").alias("concession_size"))


def order_concessions_from_events(events: DataFrame) -> DataFrame:
    return events.select(_c("event_id").alias("order_number"), _c("user_id").alias("concession_id"),
                         F.floor("value").cast("int").alias("quantity"))


# ---- theatres, concessions, orders, tickets ---------------------------------------
def theatres_from_supplier(supplier: DataFrame) -> DataFrame:
    return supplier.select(
        _c("s_suppkey").alias("theatre_number"),
        (F.lit(SEAT_BASE) + _c("s_suppkey") % SEAT_SPREAD).cast("int").alias("theatre_seat_count"),
        (_c("s_nationkey") % 2 == 0).alias("accessible_seating"), (_c("s_acctbal") > 0).alias("status"),
        F.when(_c("s_acctbal") <= 0, F.concat(F.lit("Closed: "), _c("s_name"))).alias("status_notes"))


THEATRES_FROM_SUPPLIER = f"""SELECT s_suppkey AS theatre_number,
  CAST({SEAT_BASE} + s_suppkey % {SEAT_SPREAD} AS INTEGER) AS theatre_seat_count,
  s_nationkey % 2 = 0 AS accessible_seating, s_acctbal > 0 AS status,
  CASE WHEN s_acctbal <= 0 THEN 'Closed: ' || s_name END AS status_notes FROM supplier"""


def concessions_from_part(part: DataFrame) -> DataFrame:
    return part.select(
        _c("p_partkey").alias("concession_id"), _c("p_name").alias("concession_name"),
        F.when(_c("p_size") <= 10, "Regular").when(_c("p_size") <= 30, "Medium").when(_c("p_size") <= 45, "Large")
        .alias("concession_size"), _c("p_type").alias("concession_type"),
        money(_c("p_retailprice")).alias("concession_price"))


CONCESSIONS_FROM_PART = """SELECT p_partkey AS concession_id, p_name AS concession_name,
  CASE WHEN p_size <= 10 THEN 'Regular' WHEN p_size <= 30 THEN 'Medium' WHEN p_size <= 45 THEN 'Large' END AS concession_size,
  p_type AS concession_type, CAST(p_retailprice AS DECIMAL(10,2)) AS concession_price FROM part"""


def order_concessions_from_lineitem(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(_c("l_orderkey").alias("order_number"), _c("l_partkey").alias("concession_id"),
                           _c("l_quantity").cast("int").alias("quantity"))


ORDER_CONCESSIONS_FROM_LINEITEM = """SELECT l_orderkey AS order_number, l_partkey AS concession_id,
  CAST(l_quantity AS INTEGER) AS quantity FROM lineitem"""


def orders_from_orders(orders: DataFrame) -> DataFrame:
    sub = money(_c("o_totalprice"))
    base = orders.select(
        _c("o_orderkey").alias("order_number"), _c("o_custkey").alias("order_customer_id"), sub.alias("subtotal"),
        F.when(_c("o_orderstatus") == "P", F.lit(None).cast("decimal(10,2)"))
        .when(_c("o_orderstatus") == "F", money(sub * F.lit(REWARDS_DISCOUNT_RATE)))
        .otherwise(F.lit(Decimal("0.00")).cast("decimal(10,2)")).alias("discount"),
        _c("o_orderdate").alias("created_at"))
    return with_order_totals(base).select("order_number", "order_customer_id", "subtotal", "tax", "discount",
                                          "total", "created_at")


ORDERS_FROM_ORDERS = """SELECT order_number, order_customer_id, subtotal,
  CAST(subtotal * 0.08 AS DECIMAL(10,2)) AS tax, discount,
  CAST(subtotal * 1.08 - coalesce(discount, 0) AS DECIMAL(10,2)) AS total, created_at
FROM (SELECT o_orderkey AS order_number, o_custkey AS order_customer_id,
        CAST(o_totalprice AS DECIMAL(10,2)) AS subtotal,
        CASE WHEN o_orderstatus = 'P' THEN NULL
             WHEN o_orderstatus = 'F' THEN CAST(CAST(o_totalprice AS DECIMAL(10,2)) * 0.10 AS DECIMAL(10,2))
             ELSE CAST(0 AS DECIMAL(10,2)) END AS discount,
        o_orderdate AS created_at FROM orders)"""


def tickets_from_lineitem(lineitem: DataFrame, showing: str, customer: str = "l_suppkey") -> DataFrame:
    return lineitem.select(
        (_c("l_orderkey") * 8 + _c("l_linenumber")).alias("ticket_id"), _c(customer).alias("ticket_customer_id"),
        _c(showing).alias("ticket_showing_id"), _c("l_orderkey").alias("ticket_order_number"))


def TICKETS_FROM_LINEITEM(showing: str, customer: str = "l_suppkey", where: str = "") -> str:
    return f"""SELECT l_orderkey * 8 + l_linenumber AS ticket_id, {customer} AS ticket_customer_id,
  {showing} AS ticket_showing_id, l_orderkey AS ticket_order_number FROM lineitem {where}"""
