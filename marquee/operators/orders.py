"""Order intake for a whole batch (or micro-batch) of requests.

Rules, in the order the reference tests them (first failure wins):
 1 showingId / ticketQty not integers            -> bad_number
 2 customerId falsy                              -> customer_required
 3 showing <= 0 or quantity <= 0                 -> showing_and_qty_required
 4 unknown customer                              -> customer_not_found
 5 unknown showing                               -> showing_not_found
 6 seats left (after earlier accepted orders) < quantity -> not_enough_seats
 7 unusable items are dropped
 8 item list not iterable                        -> bad_concessions (no seats taken)
 9 same concession twice                         -> duplicate_concession (no seats taken)
10 amounts or an item quantity beyond the columns -> amount_too_large (no seats taken)
Accepted orders get consecutive order numbers in arrival order, one ticket per
seat with consecutive ids, their items, and the seats come off the showing.

Every row is a request of its own, as every call is to the reference: a body sent twice,
under one request_id or two, is two orders (the second may find no seats).  Requests of
equal arrival and id are taken in the order in which they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators.pricing import price_orders, usable_items, with_items
from marquee.operators.seats import allocate_seats
from marquee.operators.sequencing import global_prefix
from marquee.session import materialize
from marquee.sources import requests as Q

# Refusal reasons.
BAD_NUMBER = "bad_number"
CUSTOMER_REQUIRED = "customer_required"
SHOWING_AND_QTY_REQUIRED = "showing_and_qty_required"
CUSTOMER_NOT_FOUND = "customer_not_found"
SHOWING_NOT_FOUND = "showing_not_found"
NOT_ENOUGH_SEATS = "not_enough_seats"
BAD_CONCESSIONS = "bad_concessions"
DUPLICATE_CONCESSION = "duplicate_concession"
AMOUNT_TOO_LARGE = "amount_too_large"
ACCEPTED, REFUSED = "accepted", "refused"

# The answers to refused requests (status, error); a failure inside the reference has no error text.
ANSWERS = {
    BAD_NUMBER: (400, "Showing and ticket quantity must be valid numbers."),
    CUSTOMER_REQUIRED: (400, "Customer is required."),
    SHOWING_AND_QTY_REQUIRED: (400, "Showing and ticket quantity are required."),
    CUSTOMER_NOT_FOUND: (404, "Customer not found."),
    SHOWING_NOT_FOUND: (404, "Showing not found."),
    NOT_ENOUGH_SEATS: (400, "Not enough seats available for this showing."),
    BAD_CONCESSIONS: (500, None),
    DUPLICATE_CONCESSION: (500, None),
    AMOUNT_TOO_LARGE: (500, None),
}
CREATED = 201

ARRIVAL = ["arrived_at", "request_id"]
DECISION_COLUMNS = ["request_id", "arrived_at", "status", "reason", "order_number", "customer_id", "showing_id",
                    "ticket_qty", "subtotal", "discount", "tax", "total", "rewards_discount_applied"]


def _max_or_zero(df: DataFrame, c: str) -> Column:
    return df.select(F.coalesce(F.max(c), F.lit(0)).cast("bigint")).scalar()


def screen(requests: DataFrame, customers: DataFrame, showings: DataFrame) -> DataFrame:
    """Steps 1-5 on parsed requests (request_id, arrived_at, payload); a request without arrival time arrives now.
    ``_row`` tells rows apart.  Request fields are materialised first so each parse expression is built once."""
    p = F.col("payload")
    df = requests.select(F.monotonically_increasing_id().alias("_row"), "request_id", Q.arrival("arrived_at"), "payload", Q.field(p, "showingId").alias("_vs"),
                         Q.field(p, "ticketQty").alias("_vq"), Q.field(p, "customerId").alias("_vc"),
                         Q.field(p, "concessions").alias("_vi"))
    showing, bad_s = Q.py_int(F.col("_vs"), 0)
    qty, bad_q = Q.py_int(F.col("_vq"), 0)
    df = df.select("_row", "request_id", "arrived_at", "payload", showing.alias("showing_id"), qty.alias("ticket_qty"),
                   (bad_s | bad_q).alias("_bad"), Q.text(F.col("_vc")).alias("customer_id"),
                   Q.truthy(F.col("_vc")).alias("_has_customer"), Q.items_crash(F.col("_vi")).alias("_crash"))
    df = df.withColumn("_static", F.when(F.col("_bad"), F.lit(BAD_NUMBER))
                       .when(~F.col("_has_customer"), F.lit(CUSTOMER_REQUIRED))
                       .when((F.col("showing_id") <= 0) | (F.col("ticket_qty") <= 0), F.lit(SHOWING_AND_QTY_REQUIRED)))
    c = customers.select(F.col("customer_id").cast("string").alias("_cid"), F.col("customer_id").alias("_ckey"),
                         F.coalesce(F.col("rewards_member"), F.lit(False)).alias("member"))
    s = showings.select(F.col("showing_id").alias("_sid"), F.col("film_available_seats").cast("bigint").alias("seats0"))
    df = (df.join(c, df.customer_id == c._cid, "left").join(s, df.showing_id == s._sid, "left"))
    reason = F.coalesce(F.col("_static"),
                        F.when(F.col("_cid").isNull(), F.lit(CUSTOMER_NOT_FOUND)),
                        F.when(F.col("_sid").isNull(), F.lit(SHOWING_NOT_FOUND)))
    return df.withColumn("reason", reason).drop("_cid", "_sid", "_static", "_bad", "_has_customer")


def decide(requests: DataFrame, customers: DataFrame, showings: DataFrame, concessions: DataFrame,
           orders: DataFrame, tickets: DataFrame) -> DataFrame:
    """The decision on each request, in internal form (with first_ticket_id, the customer key and the usable items).

    The screened and priced requests are pinned once.  The seat fold and the numbering see the eligible ones
    only, and of them the columns that they need (none is ever null); their verdicts are joined back."""
    screened = screen(requests, customers, showings)
    # The items of requests that are refused already are not read.
    screened = screened.withColumn("payload", F.when(F.col("reason").isNull(), F.col("payload")))
    priced = materialize(price_orders(with_items(screened, concessions)))
    arrival = [*ARRIVAL, "_row"]
    seated = allocate_seats(
        priced.where(F.col("reason").isNull()).select(
            *arrival, "showing_id", "ticket_qty", "seats0",
            (F.col("_crash") | F.col("has_duplicate") | F.col("too_large")).alias("_blocked")),
        key="showing_id", order_cols=tuple(arrival), qty="ticket_qty", seats="seats0", blocked="_blocked")
    one = F.when(F.col("accepted"), 1)
    numbered = global_prefix(seated.select(*arrival, "ticket_qty", "seat_ok", "accepted"), arrival, {"_n": one, "_t": one * F.col("ticket_qty")})
    out = priced.join(numbered.select("_row", "seat_ok", "accepted", "_n", "_t"), "_row", "left")
    accepted = F.coalesce("accepted", F.lit(False))
    reason = F.coalesce(F.col("reason"), F.when(accepted, None).when(~F.col("seat_ok"), NOT_ENOUGH_SEATS).when(F.col("_crash"), BAD_CONCESSIONS)
                        .when(F.col("has_duplicate"), DUPLICATE_CONCESSION).when(F.col("too_large"), AMOUNT_TOO_LARGE))
    of_accepted = lambda c: F.when(accepted, c)
    return out.select(
        *ARRIVAL, F.when(accepted, ACCEPTED).otherwise(REFUSED).alias("status"), reason.alias("reason"),
        of_accepted(_max_or_zero(orders, "order_number") + F.col("_n") + 1).alias("order_number"),
        of_accepted(_max_or_zero(tickets, "ticket_id") + F.col("_t") + 1).alias("first_ticket_id"),
        "customer_id", "_ckey", "showing_id", "ticket_qty", *[of_accepted(F.col(c)).alias(c) for c in ("subtotal", "discount", "tax", "total")],
        of_accepted(F.col("member")).alias("rewards_discount_applied"), of_accepted(F.col("items")).alias("items"))


def outputs(decisions: DataFrame, showings: DataFrame) -> dict[str, DataFrame]:
    """Orders, tickets, items, answers and the seat snapshot implied by decisions (internal form)."""
    ok = decisions.where(F.col("status") == ACCEPTED)
    new_orders = ok.select("order_number", F.col("_ckey").alias("order_customer_id"), "subtotal", "tax",
                           "discount", "total", F.col("arrived_at").alias("created_at"))
    new_tickets = ok.select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ticket_qty") - 1)).alias("_i"), "first_ticket_id",
        "_ckey", "showing_id", "order_number").select(
        (F.col("first_ticket_id") + F.col("_i")).alias("ticket_id"), F.col("_ckey").alias("ticket_customer_id"),
        F.col("showing_id").alias("ticket_showing_id"), F.col("order_number").alias("ticket_order_number"))
    new_items = usable_items(ok, "order_number").select("order_number", "concession_id", F.col("quantity").cast("int").alias("quantity"))
    return {"decisions": decisions.select(*DECISION_COLUMNS), "responses": responses(decisions), "answers": answers(decisions),
            "orders": new_orders, "tickets": new_tickets, "items": new_items, "seats": seats_left(showings, ok)}


def answer_of(reasons: dict, field: int):
    """The part ``field`` of the answer to each reason."""
    out = None
    for reason, answer in reasons.items():
        test = F.col("reason") == reason
        out = F.when(test, F.lit(answer[field])) if out is None else out.when(test, F.lit(answer[field]))
    return out


def answers(decisions: DataFrame) -> DataFrame:
    """What each request is answered with: the status, the error text of refused ones, the order of accepted ones."""
    ok = F.col("status") == ACCEPTED
    return decisions.select(
        "request_id", "arrived_at", F.when(ok, CREATED).otherwise(answer_of(ANSWERS, 0)).alias("http_status"), answer_of(ANSWERS, 1).alias("error"),
        F.col("order_number").alias("orderNumber"), "subtotal", "tax", "discount", "total",
        F.col("rewards_discount_applied").alias("rewardsDiscountApplied"), _receipt_url().alias("receiptUrl"))


def _receipt_url() -> Column:
    return F.concat(F.lit("/receipt/"), F.col("order_number").cast("string"))


def responses(decisions: DataFrame) -> DataFrame:
    """What an accepted request is answered with."""
    return decisions.where(F.col("status") == ACCEPTED).select(
        F.col("order_number").alias("orderNumber"), "subtotal", "tax", "discount", "total",
        F.col("rewards_discount_applied").alias("rewardsDiscountApplied"),
        _receipt_url().alias("receiptUrl"))


def seats_left(showings: DataFrame, accepted: DataFrame) -> DataFrame:
    """A10: seats minus the accepted quantity per showing (aggregated first)."""
    taken = accepted.groupBy(F.col("showing_id").alias("_sid")).agg(F.sum("ticket_qty").alias("_taken"))
    return (showings.join(taken, showings.showing_id == taken._sid, "left")
            .withColumn("film_available_seats",
                        (F.col("film_available_seats") - F.coalesce(F.col("_taken"), F.lit(0))).cast("int"))
            .drop("_sid", "_taken"))


def intake(requests: DataFrame, customers: DataFrame, showings: DataFrame, concessions: DataFrame,
           orders: DataFrame, tickets: DataFrame, pin: bool = True) -> dict[str, DataFrame]:
    """All outputs of one intake run: decisions, orders, tickets, items, seats.

    With ``pin`` (needed when the outputs are written back into the input
    tables) the decisions are checkpointed, so every output sees one run even
    after ``orders``/``tickets`` have grown.  Read-only callers may skip it:
    the decisions are then recomputed deterministically from pinned parts."""
    decisions = decide(requests, customers, showings, concessions, orders, tickets)
    if pin:
        decisions = materialize(decisions)
    out = outputs(decisions, showings)
    out["internal"] = decisions
    return out
