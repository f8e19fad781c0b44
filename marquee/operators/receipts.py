"""Receipt header and lines for any set of orders, in one job.

The reference renders one receipt per request; here a DataFrame of order
numbers selects the receipts (all orders when none is given).  A requested
order that does not exist yields no header, and ``missing_receipts`` names it
with the reason ``order_not_found``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import columns as C
from marquee.functions.money import TICKET_UNIT_PRICE, money
from marquee.operators.sequencing import row_number_within

# Receipt labels.
TICKETS_LABEL = "Tickets — "
CONCESSION_DETAIL = "Concession"
ORDER_NOT_FOUND = "order_not_found"
DETAIL_PATTERN = "yyyy-MM-dd'T'HH:mm:ss"

LINE_COLUMNS = ["order_number", "line_no", "label", "detail", "qty", "unit", "line"]


def _only(df: DataFrame, key: str, wanted: DataFrame | None) -> DataFrame:
    if wanted is None:
        return df
    return df.join(wanted.select(F.col("order_number").alias(key)).distinct(), key, "left_semi")


def receipt_header(orders: DataFrame, customers: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Every order column, customer facts and money text."""
    o, c = _only(orders, "order_number", wanted).alias("o"), customers.alias("c")
    return (o.join(c, F.col("c.customer_id") == F.col("o.order_customer_id"))
            .select("o.*", "c.firstname", "c.lastname", "c.email", "c.rewards_member",
                    C.full_name("c.firstname", "c.lastname").alias("customer_name"),
                    C.money_text("o.subtotal").alias("subtotal_text"),
                    C.money_text("o.discount").alias("discount_text"),
                    C.money_text("o.tax").alias("tax_text"),
                    C.money_text("o.total").alias("total_text")))


def missing_receipts(orders: DataFrame, customers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested order numbers without a header row, with the refusal reason."""
    found = receipt_header(orders, customers, wanted).select("order_number")
    return (wanted.select("order_number").distinct().join(found, "order_number", "left_anti")
            .select("order_number", F.lit(ORDER_NOT_FOUND).alias("reason")))


def receipt_ticket_lines(tickets: DataFrame, showings: DataFrame, films: DataFrame,
                         wanted: DataFrame | None = None) -> DataFrame:
    """Ticket count per (order, showing); unit price is the
    fixed ticket price.  Counted per (order, showing) before the joins."""
    counts = (_only(tickets, "ticket_order_number", wanted)
              .groupBy("ticket_order_number", "ticket_showing_id").agg(F.count(F.lit(1)).alias("qty")))
    s, f = showings.alias("s"), films.alias("f")
    shows = (s.join(f, F.col("f.film_id") == F.col("s.film_id"))
             .select("s.showing_id", "f.film_title", "s.film_showing_datetime"))
    unit = F.lit(TICKET_UNIT_PRICE).cast("decimal(10,2)")
    return (counts.join(shows, counts.ticket_showing_id == shows.showing_id)
            .select(F.col("ticket_order_number").alias("order_number"),
                    C.label(TICKETS_LABEL, F.col("film_title")).alias("label"),
                    F.date_format("film_showing_datetime", DETAIL_PATTERN).alias("detail"),
                    F.col("qty"), unit.alias("unit"), money(F.col("qty") * unit).alias("line"),
                    F.col("showing_id").cast("string").alias("_item"),
                    F.col("showing_id").cast("bigint").alias("_showing")))


def receipt_item_lines(order_concessions: DataFrame, concessions: DataFrame,
                       wanted: DataFrame | None = None) -> DataFrame:
    """One line per ordered concession, quantity x price."""
    oc, c = _only(order_concessions, "order_number", wanted).alias("oc"), concessions.alias("c")
    return (oc.join(c, F.col("c.concession_id") == F.col("oc.concession_id"))
            .select(F.col("oc.order_number").alias("order_number"),
                    C.label(F.col("c.concession_name"), " (", C.or_dash("c.concession_size"), ")").alias("label"),
                    F.lit(CONCESSION_DETAIL).alias("detail"),
                    F.col("oc.quantity").cast("bigint").alias("qty"),
                    F.col("c.concession_price").alias("unit"),
                    money(F.col("oc.quantity") * F.col("c.concession_price")).alias("line"),
                    F.col("c.concession_id").alias("_item_key")))


def receipt_lines(ticket_lines: DataFrame, item_lines: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Ticket lines first, then concession lines, numbered per order.

    Tickets are ordered by showing, concessions by their key; the remaining
    sort keys cover every output column, so identical lines tie only with
    identical lines.  ``sizes`` (order_number, n) bounds the lines of an order from above,
    without the joins that the lines took; an order with very many lines
    is split over several tasks (``row_number_within``).
    """
    t = ticket_lines.select("order_number", F.lit(0).alias("_kind"), "_showing",
                            F.lit(None).cast(item_lines.schema["_item_key"].dataType).alias("_item_key"),
                            "label", "detail", "qty", "unit", "line")
    i = item_lines.select("order_number", F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_showing"),
                          "_item_key", "label", "detail", "qty", "unit", "line")
    order = ["_kind", "_showing", "_item_key", "label", "detail", "qty", "unit", "line"]
    return row_number_within(t.unionByName(i), ["order_number"], order, "line_no", sizes).select(*LINE_COLUMNS)


def line_bounds(tickets: DataFrame, order_concessions: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """order_number, n: at least the number of lines of each order, counted from its tickets and items alone."""
    of = lambda df, key: _only(df, key, wanted).groupBy(F.col(key).alias("order_number")).agg(F.count(F.lit(1)).alias("n"))
    return of(tickets, "ticket_order_number").unionByName(of(order_concessions, "order_number"))
