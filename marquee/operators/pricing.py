"""P1 (with B8, C13, D11): order pricing.

subtotal = 12.00 x tickets + sum(price x qty of usable items); members get 10 %
off the subtotal; tax is on the pre-discount subtotal.  Item prices come from
one join with the concession table (the reference looks each item up alone).  Rows are
requests: one that stands twice, under one request_id or two, is priced twice.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.money import TICKET_UNIT_PRICE, money, rewards_discount, tax_of, total_of
from marquee.sources import requests as Q

#: The largest subtotal whose total with tax fits DECIMAL(10,2), and the largest quantity of an item.
LARGEST_SUBTOTAL, LARGEST_INT = Decimal("92592592.58"), 2**31 - 1


def with_items(requests: DataFrame, concessions: DataFrame, payload: str = "payload", key: str = "_row") -> DataFrame:
    """The requests with their usable items (a truthy id, an integer quantity > 0, a known id) as ``items``
    (an array of item_pos, concession_id, quantity, price) instead of the payload, and of these the subtotal (exact, however
    large), the number, the largest quantity and whether one concession appears twice (a composite-key violation).

    ``key`` tells rows apart: two rows of one request_id are two requests.  Each body's items are read once; the request's
    other columns travel with them, so that one join with the menu and one aggregation give everything."""
    rest = [c for c in requests.columns if c != payload]
    listed = F.try_variant_get(Q.field(F.col(payload), "concessions"), "$", "array<variant>")
    items = requests.select(*rest, F.posexplode_outer(listed).alias("item_pos", "_item"))
    is_object = F.coalesce(F.schema_of_variant("_item").startswith("OBJECT"), F.lit(False))
    items = items.select(*rest, "item_pos", F.when(is_object, Q.field(F.col("_item"), "id")).alias("_vid"), F.when(is_object, Q.field(F.col("_item"), "qty")).alias("_vq"))
    q, bad = Q.py_int(F.col("_vq"), 0)
    items = items.select(*rest, "item_pos", F.when(Q.truthy(F.col("_vid")), Q.text(F.col("_vid"))).alias("_item_id"), F.when(~bad, q).alias("quantity"))
    menu = concessions.select("concession_id", F.col("concession_id").cast("string").alias("_menu_id"), F.col("concession_price").alias("price"))
    found = items.join(menu, (F.col("_item_id") == F.col("_menu_id")) & (F.col("quantity") > 0), "left")
    known = F.col("concession_id").isNotNull()
    item = F.when(known, F.struct("item_pos", "concession_id", "quantity", "price"))
    return found.groupBy(*rest).agg(
        F.sum(F.col("price") * F.col("quantity").cast("decimal(19,0)")).alias("concession_subtotal"),
        F.max(F.when(known, F.col("quantity"))).alias("max_quantity"),
        F.count("concession_id").alias("item_count"),
        F.array_sort(F.collect_list(item)).alias("items")).withColumn(
        "has_duplicate", F.col("item_count") > F.size(F.array_distinct(F.transform("items", lambda x: x["concession_id"]))))


def usable_items(priced: DataFrame, *keys: str) -> DataFrame:
    """One row for each usable item of ``with_items`` rows: (keys, item_pos, concession_id, quantity, price)."""
    return priced.select(*keys, F.inline("items"))


def price_orders(requests: DataFrame, ticket_qty: str = "ticket_qty", member: str = "member") -> DataFrame:
    """Add subtotal, discount, tax, total (DECIMAL(10,2)) to ``with_items`` rows.

    Amounts are summed in a wide decimal; a request whose total would not fit, or with an item
    quantity beyond INT, gets null amounts and ``too_large``, and no other request is touched."""
    conc = F.coalesce(F.col("concession_subtotal"), F.lit(0)).cast("decimal(36,2)")
    df = requests.withColumn("_wide", F.col(ticket_qty).cast("decimal(19,0)") * F.lit(TICKET_UNIT_PRICE) + conc)
    fits = (F.abs("_wide") <= F.lit(LARGEST_SUBTOTAL)) & (F.abs(conc) <= F.lit(LARGEST_SUBTOTAL))
    return (df.withColumn("too_large", F.coalesce(~fits, F.lit(False)) | (F.coalesce("max_quantity", F.lit(0)) > LARGEST_INT))
            .withColumn("_conc", conc)
            .withColumn("subtotal", money(F.when(~F.col("too_large"), F.col("_wide"))))
            .withColumn("concession_subtotal", money(F.when(~F.col("too_large"), F.col("_conc"))))
            .withColumn("discount", rewards_discount("subtotal", F.coalesce(F.col(member), F.lit(False))))
            .withColumn("tax", tax_of("subtotal"))
            .withColumn("total", total_of("subtotal", "discount"))
            .drop("_wide", "_conc", "max_quantity"))
