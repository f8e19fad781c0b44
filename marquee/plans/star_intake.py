"""Star-binding queries for text columns, ids and the two intake pipelines.

Requests are built from ``events`` as JSON bodies and go through the same
parsing as real requests; the oracle SQL computes the decisions from the raw
columns directly (a recursive query replays the seat fold).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import columns as C
from marquee.operators import customers as CU
from marquee.operators.audit import union_all
from marquee.operators import orders as OR
from marquee.operators.pricing import price_orders, with_items
from marquee.plans import star_views as V
from marquee.plans.registry import dataset_by_name
from marquee.plans.star import SQL, _with, query
from marquee.sources import requests as RQ
from marquee.sources.conform import conform_concessions, conform_customers, conform_orders, conform_shifts

# Fixed values of the binding (shared with the oracle SQL).
FAR = 10_000_000         # added to a key, it names nobody
SHOWING_MARGIN, ITEM_MARGIN = 4, 50  # requests name so many showings and parts beyond the last
FAR_CUSTOMER_MOD, FAR_CUSTOMER_AT = 83, 8
HUGE_QTY_MOD, HUGE_QTY_AT, HUGE_ITEM_AT, HUGE_QTY = 101, 9, 10, 20_000_000  # far beyond all seats and amounts
BAD_QTY_MOD, BAD_QTY_AT, TEXT_QTY_AT = 97, 5, 6
NO_CUSTOMER_MOD, NO_CUSTOMER_AT = 89, 7
REPEAT_MOD, REPEAT_BELOW, REPEAT_SPAN = 20, 8, 4  # of 20 events the first eight carry the id of one in four: request ids repeat
REQUEST_ID_SQL = f"CASE WHEN event_id % {REPEAT_MOD} < {REPEAT_BELOW} THEN event_id - event_id % {REPEAT_SPAN} ELSE event_id END"


def _request_id():
    k = F.col("event_id")
    return F.when(k % REPEAT_MOD < REPEAT_BELOW, k - k % REPEAT_SPAN).otherwise(k)


# ---- G3-G6 names, B6/C12 e-mails, G7/G14 display, D10/G8 ids ----------------------
def _full_names(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    full = (F.when(k % 6 == 0, F.lit("   ")).when(k % 6 == 1, F.col("c_mktsegment"))
            .when(k % 6 == 2, F.concat(F.lit("  "), F.regexp_replace("c_name", "#", "  "), F.lit(" x ")))
            .otherwise(F.regexp_replace("c_name", "#", " ")))
    return customer.select(k.alias("customer_id"), full.alias("full_name"))


@query("name_parse", r"""
WITH n AS (SELECT c_custkey AS customer_id,
             CASE c_custkey % 6 WHEN 0 THEN '   ' WHEN 1 THEN c_mktsegment
                  WHEN 2 THEN '  ' || replace(c_name, '#', '  ') || ' x ' ELSE replace(c_name, '#', ' ') END AS full_name
           FROM customer),
s AS (SELECT *, regexp_replace(full_name, '^\s+|\s+$', '', 'g') AS t FROM n)
SELECT customer_id, full_name,
       CASE WHEN t = '' THEN 'Guest' ELSE regexp_extract(t, '^(\S+)', 1) END AS firstname,
       CASE WHEN t = '' OR NOT regexp_matches(t, '\s') THEN 'Customer' ELSE regexp_replace(t, '^\S+\s+', '') END AS lastname
FROM s""")
def name_parse(t):
    """Blank, one-word and padded multi-word names."""
    n = _full_names(t["customer"])
    stripped = n.withColumn("_t", F.coalesce(C.py_strip("full_name"), F.lit("")))  # strip once per row
    parts = stripped.withColumn("_p", C.split_stripped(F.col("_t")))
    return parts.select("customer_id", "full_name", F.col("_p.firstname").alias("firstname"),
                        F.col("_p.lastname").alias("lastname"))


@query("email_duplicates", """
WITH told AS (SELECT c_custkey, lower(c_mktsegment) || '.' || c_nationkey || '@mail.com' AS email FROM customer),
asked AS (SELECT c_custkey AS request_id, upper(CASE c_custkey % 3 WHEN 0 THEN 'new.' ELSE '' END || email) AS email FROM told)
SELECT request_id, email, (SELECT min(c_custkey) FROM told WHERE told.email = lower(asked.email)) AS existing_customer_id
FROM asked WHERE lower(email) IN (SELECT email FROM told)""")
def email_duplicates(t):
    """All customers' e-mails in upper case, a third of them changed, against all customers."""
    c = V.customers_from_customer(t["customer"])
    changed = F.concat(F.when(F.col("customer_id") % 3 == 0, "new.").otherwise(""), F.col("email"))
    return CU.email_conflicts(c.select(F.col("customer_id").alias("request_id"), F.upper(changed).alias("email")), c)


def _display_raw(events: DataFrame) -> DataFrame:
    k, ts = F.col("event_id"), F.col("ts")
    raw = (F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 7 == 1, F.lit("not a date"))
           .when(k % 7 == 2, F.lit("")).when(k % 7 == 3, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
           .when(k % 7 == 4, F.date_format(ts, "yyyy-MM-dd")).when(k % 7 == 5, F.lit("TBD pending Theatre refit"))
           .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    return events.select("event_id", raw.alias("raw_value"))


@query("display_values", r"""
WITH r AS (SELECT event_id,
             CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'not a date' WHEN 2 THEN ''
                  WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 4 THEN strftime(ts, '%Y-%m-%d')
                  WHEN 5 THEN 'TBD pending Theatre refit' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS raw_value
           FROM events),
d AS (SELECT *, regexp_matches(raw_value, '^\d{4}-\d{2}-\d{2}T') OR regexp_matches(raw_value, '^\d{4}-\d{2}-\d{2} ')
               OR (strpos(raw_value, 'T') > 0 AND length(raw_value) >= 19) AS is_datelike FROM r)
SELECT event_id, raw_value, is_datelike,
       CASE WHEN raw_value IS NULL THEN '—'
            WHEN is_datelike THEN coalesce(strftime(TRY_CAST(raw_value AS TIMESTAMP), '%Y-%m-%d %H:%M:%S'), raw_value)
            ELSE raw_value END AS cell_value,
       coalesce(strftime(TRY_CAST(raw_value AS TIMESTAMP), '%Y-%m-%d %H:%M:%S'), raw_value) AS display_value
FROM d""")
def display_values(t):
    """Event times as text, with null, empty and malformed variants, by both display rules."""
    r = _display_raw(t["events"])
    return r.select("event_id", "raw_value", C.is_datelike("raw_value").alias("is_datelike"),
                    C.display_cell("raw_value").alias("cell_value"), C.display_datetime("raw_value").alias("display_value"))


@query("next_customer_id", r"""
WITH ids AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'X' || CAST(c_custkey AS VARCHAR)
                         WHEN c_custkey % 10 = 1 THEN 'C' || CAST(c_custkey AS VARCHAR) || 'a'
                         ELSE 'C' || CAST(c_custkey AS VARCHAR) END AS customer_id FROM customer),
m AS (SELECT coalesce(max(TRY_CAST(regexp_extract(customer_id, '^C(\d+)$', 1) AS BIGINT)), 0) AS max_number FROM ids)
SELECT max_number, printf('C%03d', max_number + 1) AS next_customer_id FROM m""")
def next_customer_id(t):
    """Highest C<digits> id, ignoring other forms."""
    k = F.col("c_custkey").cast("string")
    ids = t["customer"].select(
        F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("X"), k))
        .when(F.col("c_custkey") % 10 == 1, F.concat(F.lit("C"), k, F.lit("a")))
        .otherwise(F.concat(F.lit("C"), k)).alias("customer_id"))
    return CU.max_customer_number(ids)


# ---- P3 customer intake -------------------------------------------------------------
def signup_requests(events: DataFrame) -> DataFrame:
    k, u = F.col("event_id"), F.col("user_id").cast("string")
    body = F.to_json(F.struct(
        F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.concat(F.lit("Cher"), u))
        .otherwise(F.concat(F.lit("Ana"), u, F.lit("  de la Cruz"))).alias("name"),
        F.when(k % 5 == 0, F.concat(F.lit("First"), u)).alias("firstName"),
        F.when(k % 13 == 0, F.lit("  ")).otherwise(F.concat(F.lit("  user"), (F.col("user_id") + F.when(k % 3 == 0, 0)
            .otherwise(FAR)).cast("string"), F.lit("@mail.com "))).alias("email"),
        (F.col("value") > 50).alias("rewardsMember")))
    raw = events.where(F.col("event_type") == "signup").select(_request_id().alias("request_id"), F.col("ts").alias("arrived_at"),
                                                               body.alias("body"))
    return RQ.parse_bodies(raw)


def _existing_for_signup(customer: DataFrame) -> DataFrame:
    return customer.select(
        C.customer_id_text("c_custkey").alias("customer_id"),
        F.concat(F.lit("USER"), F.col("c_custkey").cast("string"), F.lit("@MAIL.COM")).alias("email"))


@query("customer_intake", f"""
WITH rq AS (
  SELECT event_id AS row_key, {REQUEST_ID_SQL} AS request_id, ts AS arrived_at,
    CASE WHEN event_id % 5 = 0 THEN 'First' || CAST(user_id AS VARCHAR)
         WHEN event_id % 4 = 0 THEN 'Guest'
         WHEN event_id % 4 = 1 THEN 'Cher' || CAST(user_id AS VARCHAR)
         ELSE 'Ana' || CAST(user_id AS VARCHAR) END AS firstname,
    CASE WHEN event_id % 5 = 0 OR event_id % 4 IN (0, 1) THEN 'Customer' ELSE 'de la Cruz' END AS lastname,
    CASE WHEN event_id % 13 = 0 THEN '' ELSE 'user' || (user_id + CASE event_id % 3 WHEN 0 THEN 0 ELSE {FAR} END) || '@mail.com' END AS email,
    value > 50 AS rewards_member
  FROM events WHERE event_type = 'signup'),
ex AS (SELECT lower('USER' || CAST(c_custkey AS VARCHAR) || '@MAIL.COM') AS k, min(c_custkey) AS holder
       FROM customer GROUP BY 1),
base AS (SELECT coalesce(max(c_custkey), 0) AS m FROM customer),
j AS (SELECT rq.*, lower(rq.email) AS k, ex.holder FROM rq LEFT JOIN ex ON lower(rq.email) = ex.k),
w AS (SELECT row_key, request_id, k, arrived_at FROM (
        SELECT row_key, request_id, k, arrived_at, row_number() OVER (PARTITION BY k ORDER BY arrived_at, request_id, row_key) AS rn
        FROM j WHERE email <> '' AND holder IS NULL) WHERE rn = 1),
wn AS (SELECT k, row_key AS winner,
         printf('C%03d', (SELECT m FROM base) + row_number() OVER (ORDER BY arrived_at, request_id, row_key)) AS new_id FROM w),
d AS (SELECT j.*, CASE WHEN j.email = '' THEN 'email_required'
                       WHEN j.holder IS NOT NULL OR wn.winner <> j.row_key THEN 'duplicate_email' END AS reason,
             CASE WHEN j.email = '' THEN NULL WHEN j.holder IS NOT NULL THEN printf('C%03d', j.holder)
                  ELSE wn.new_id END AS customer_id
      FROM j LEFT JOIN wn ON wn.k = j.k)
SELECT request_id, arrived_at, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'refused' END AS status, reason,
       customer_id, firstname, lastname, email, rewards_member
FROM d""")
def customer_intake(t):
    """Sign-up events as requests; e-mails repeat inside the batch."""
    return CU.intake_customers(signup_requests(t["events"]), _existing_for_signup(t["customer"]))["decisions"]


@query("customer_responses", f"""SELECT customer_id AS "customerId", firstname, lastname, email
FROM ({SQL["customer_intake"]}) WHERE status = 'accepted'""")
def customer_responses(t):
    """What accepted customer requests are answered with."""
    return CU.intake_customers(signup_requests(t["events"]), _existing_for_signup(t["customer"]))["responses"]


# ---- P1 pricing, P2 intake ------------------------------------------------------------
def purchase_requests(t: dict[str, DataFrame], with_variants: bool) -> DataFrame:
    """Purchase events as JSON order bodies (text built column by column)."""
    e = t["events"].where(F.col("event_type") == "purchase")
    k = F.col("event_id")
    u = (F.col("user_id") + F.when(k % FAR_CUSTOMER_MOD == FAR_CUSTOMER_AT, FAR).otherwise(0)).cast("string")
    qty = F.when(k % HUGE_QTY_MOD == HUGE_QTY_AT, HUGE_QTY).otherwise(F.lit(1) + F.floor("value") % 12).cast("bigint")
    n_sup, n_part = (t[n].select(F.count(F.lit(1))).scalar() for n in ("supplier", "part"))
    k1 = F.get_json_object("props", "$.k").cast("bigint")
    k2 = F.when(k % 10 == 3, k1).otherwise(k * 7 % (n_part + ITEM_MARGIN))
    q1 = F.when(k % HUGE_QTY_MOD == HUGE_ITEM_AT, HUGE_QTY).otherwise(k % 3 + 1)
    items = F.concat(F.lit('[{"id": '), k1.cast("string"), F.lit(', "qty": '), q1.cast("string"),
                     F.lit('}, {"id": '), k2.cast("string"), F.lit(', "qty": '),
                     (k % 4).cast("string"), F.lit("}]"))
    if with_variants:
        qty_json = (F.when(k % BAD_QTY_MOD == BAD_QTY_AT, F.lit('"x"'))
                    .when(k % BAD_QTY_MOD == TEXT_QTY_AT, F.concat(F.lit('"'), qty.cast("string"), F.lit('"')))
                    .otherwise(qty.cast("string")))
        cust = F.when(k % NO_CUSTOMER_MOD == NO_CUSTOMER_AT, F.lit("")) \
            .otherwise(F.concat(F.lit('"customerId": '), u, F.lit(", ")))
    else:
        qty_json, cust = qty.cast("string"), F.concat(F.lit('"customerId": '), u, F.lit(", "))
    body = F.concat(F.lit("{"), cust, F.lit('"showingId": '), (k % (n_sup + SHOWING_MARGIN)).cast("string"), F.lit(', "ticketQty": '),
                    qty_json, F.lit(', "concessions": '), items, F.lit("}"))
    return RQ.parse_bodies(e.select(_request_id().alias("request_id"), F.col("ts").alias("arrived_at"), body.alias("body")))


def _menu(t):
    return V.concessions_from_part(t["part"])


PRICING_CTES = f"""menu AS (SELECT p_partkey AS concession_id, CAST(p_retailprice AS DECIMAL(10,2)) AS price
         FROM part),
items AS (SELECT row_key, k1 AS concession_id, q1 AS qty FROM rq UNION ALL SELECT row_key, k2, q2 FROM rq),
kept AS (SELECT i.row_key, i.concession_id, i.qty, m.price FROM items i JOIN menu m ON m.concession_id = i.concession_id
         WHERE i.concession_id <> 0 AND i.qty > 0),
agg AS (SELECT row_key, count(*) AS item_count, count(DISTINCT concession_id) AS n_distinct,
          sum(CAST(qty AS DECIMAL(18,0)) * price) AS conc FROM kept GROUP BY 1)"""

RQ_SQL = f"""rq AS (SELECT event_id AS row_key, {REQUEST_ID_SQL} AS request_id, ts AS arrived_at,
         user_id + CASE event_id % {FAR_CUSTOMER_MOD} WHEN {FAR_CUSTOMER_AT} THEN {FAR} ELSE 0 END AS user_id,
         event_id % (SELECT count(*) + {SHOWING_MARGIN} FROM supplier) AS showing_id,
         CASE event_id % {HUGE_QTY_MOD} WHEN {HUGE_QTY_AT} THEN {HUGE_QTY} ELSE 1 + CAST(floor(value) AS BIGINT) % 12 END AS q,
         event_id % {BAD_QTY_MOD} = {BAD_QTY_AT} AS bad_qty, event_id % {NO_CUSTOMER_MOD} = {NO_CUSTOMER_AT} AS no_customer,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k1,
         CASE event_id % {HUGE_QTY_MOD} WHEN {HUGE_ITEM_AT} THEN {HUGE_QTY} ELSE 1 + event_id % 3 END AS q1,
         CASE event_id % 10 WHEN 3 THEN CAST(json_extract(props, '$.k') AS BIGINT)
              ELSE event_id * 7 % (SELECT count(*) + {ITEM_MARGIN} FROM part) END AS k2, event_id % 4 AS q2
       FROM events WHERE event_type = 'purchase')"""


def _money_sql(member: str, sub: str = "subtotal") -> dict[str, str]:
    disc = f"CASE WHEN {member} THEN CAST({sub} * 0.10 AS DECIMAL(10,2)) ELSE CAST(0 AS DECIMAL(10,2)) END"
    return {"discount": disc, "tax": f"CAST({sub} * 0.08 AS DECIMAL(10,2))",
            "total": f"CAST({sub} * 1.08 - {disc} AS DECIMAL(10,2))"}


LARGEST = "92592592.58"  # with tax it still fits DECIMAL(10,2)
_M = _money_sql("member")


@query("order_pricing", f"""
WITH {RQ_SQL},
{PRICING_CTES},
mem AS (SELECT c_custkey, c_acctbal >= {V.MEMBER_BALANCE} AS member FROM customer),
p AS (SELECT rq.request_id, rq.q AS ticket_qty, coalesce(agg.item_count, 0) AS item_count,
        coalesce(agg.item_count > agg.n_distinct, false) AS has_duplicate,
        CASE WHEN rq.q * 12.00 + coalesce(agg.conc, 0) <= {LARGEST} THEN CAST(coalesce(agg.conc, 0) AS DECIMAL(10,2)) END AS concession_subtotal,
        CASE WHEN rq.q * 12.00 + coalesce(agg.conc, 0) <= {LARGEST} THEN CAST(rq.q * 12.00 + coalesce(agg.conc, 0) AS DECIMAL(10,2)) END AS subtotal, coalesce(mem.member, false) AS member
      FROM rq LEFT JOIN agg USING (row_key) LEFT JOIN mem ON mem.c_custkey = rq.user_id)
SELECT request_id, ticket_qty, item_count, has_duplicate, CAST(concession_subtotal AS DOUBLE) AS concession_subtotal,
       CAST(subtotal AS DOUBLE) AS subtotal, CAST({_M['discount']} AS DOUBLE) AS discount,
       CAST({_M['tax']} AS DOUBLE) AS tax, CAST({_M['total']} AS DOUBLE) AS total
FROM p""")
def order_pricing(t):
    """Purchase bodies priced; zero-quantity, unknown and repeated items occur."""
    req = purchase_requests(t, with_variants=False)
    p = F.col("payload")
    req = req.select("request_id", "payload", RQ.field(p, "ticketQty").alias("_vq"),
                     RQ.field(p, "customerId").alias("_vc"))
    qty, _ = RQ.py_int(F.col("_vq"), 0)
    cust = V.customers_from_customer(t["customer"]).select(
        F.col("customer_id").cast("string").alias("_cid"), F.col("rewards_member").alias("member"))
    base = (req.select(F.monotonically_increasing_id().alias("_row"), "request_id", "payload", qty.alias("ticket_qty"), RQ.text(F.col("_vc")).alias("_c"))
            .join(cust, F.col("_c") == F.col("_cid"), "left"))
    priced = price_orders(with_items(base.drop("_c", "_cid"), _menu(t)))
    return priced.select("request_id", "ticket_qty", "item_count", "has_duplicate", "concession_subtotal",
                         "subtotal", "discount", "tax", "total")


def _intake(t) -> dict[str, DataFrame]:
    customers = V.customers_from_customer(t["customer"])
    showings = t["supplier"].select(
        F.col("s_suppkey").alias("showing_id"),
        (F.lit(V.SEAT_BASE) + F.col("s_suppkey") % V.SEAT_SPREAD).cast("int").alias("film_available_seats"))
    return OR.intake(purchase_requests(t, with_variants=True), customers, showings, _menu(t),
                     V.orders_from_orders(t["orders"]), V.tickets_from_lineitem(t["lineitem"], "l_partkey"),
                     pin=False)


_MA = _money_sql("member")
INTAKE_SQL = f"""
WITH RECURSIVE {RQ_SQL},
{PRICING_CTES},
cust AS (SELECT c_custkey, c_acctbal >= {V.MEMBER_BALANCE} AS member FROM customer),
shows AS (SELECT s_suppkey AS showing_id, CAST({V.SEAT_BASE} + s_suppkey % {V.SEAT_SPREAD} AS BIGINT) AS seats0
          FROM supplier),
s1 AS (SELECT rq.*, CASE WHEN bad_qty THEN 'bad_number'
                         WHEN no_customer OR user_id = 0 THEN 'customer_required'
                         WHEN rq.showing_id <= 0 OR q <= 0 THEN 'showing_and_qty_required'
                         WHEN cust.c_custkey IS NULL THEN 'customer_not_found'
                         WHEN shows.showing_id IS NULL THEN 'showing_not_found' END AS reason0,
              cust.member, shows.seats0, coalesce(agg.item_count > agg.n_distinct, false) AS dup,
              rq.q * 12.00 + coalesce(agg.conc, 0) > {LARGEST} AS huge,
              CASE WHEN rq.q * 12.00 + coalesce(agg.conc, 0) <= {LARGEST} THEN CAST(rq.q * 12.00 + coalesce(agg.conc, 0) AS DECIMAL(10,2)) END AS subtotal
       FROM rq LEFT JOIN cust ON cust.c_custkey = rq.user_id LEFT JOIN shows ON shows.showing_id = rq.showing_id
       LEFT JOIN agg USING (row_key)),
el AS (SELECT *, row_number() OVER (PARTITION BY showing_id ORDER BY arrived_at, request_id, row_key) AS rn
       FROM s1 WHERE reason0 IS NULL),
rec AS (SELECT showing_id, rn, row_key, q <= seats0 AS ok,
               CASE WHEN q <= seats0 AND NOT dup AND NOT huge THEN seats0 - q ELSE seats0 END AS after FROM el WHERE rn = 1
        UNION ALL
        SELECT e.showing_id, e.rn, e.row_key, e.q <= r.after,
               CASE WHEN e.q <= r.after AND NOT e.dup AND NOT e.huge THEN r.after - e.q ELSE r.after END
        FROM rec r JOIN el e ON e.showing_id = r.showing_id AND e.rn = r.rn + 1),
fold AS (SELECT el.*, rec.ok, rec.ok AND NOT el.dup AND NOT el.huge AS accepted FROM el JOIN rec USING (row_key)),
acc AS (SELECT *, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY arrived_at, request_id, row_key) AS order_number,
               CAST((SELECT max(l_orderkey * 8 + l_linenumber) FROM lineitem) + 1
                 + coalesce(sum(q) OVER (ORDER BY arrived_at, request_id, row_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 AS BIGINT) AS first_ticket_id
        FROM fold WHERE accepted),
decisions AS (
  SELECT request_id, arrived_at, 'accepted' AS status, CAST(NULL AS VARCHAR) AS reason, order_number,
         CAST(user_id AS VARCHAR) AS customer_id, showing_id, q AS ticket_qty,
         CAST(subtotal AS DOUBLE) AS subtotal, CAST({_MA['discount']} AS DOUBLE) AS discount,
         CAST({_MA['tax']} AS DOUBLE) AS tax, CAST({_MA['total']} AS DOUBLE) AS total, member AS rewards_discount_applied
  FROM acc
  UNION ALL
  SELECT request_id, arrived_at, 'refused', CASE WHEN NOT ok THEN 'not_enough_seats' WHEN dup THEN 'duplicate_concession' ELSE 'amount_too_large' END,
         NULL, CAST(user_id AS VARCHAR), showing_id, q, NULL, NULL, NULL, NULL, NULL
  FROM fold WHERE NOT accepted
  UNION ALL
  SELECT request_id, arrived_at, 'refused', reason0, NULL,
         CASE WHEN no_customer THEN NULL ELSE CAST(user_id AS VARCHAR) END, showing_id,
         CASE WHEN bad_qty THEN NULL ELSE q END, NULL, NULL, NULL, NULL, NULL
  FROM s1 WHERE reason0 IS NOT NULL)
"""


@query("intake_decisions", INTAKE_SQL + "SELECT * FROM decisions")
def intake_decisions(t):
    """P2 steps 1-9, W2: purchases as orders against suppliers as showings."""
    return _intake(t)["decisions"]


@query("order_responses", INTAKE_SQL + """
SELECT order_number AS "orderNumber", subtotal, tax, discount, total, rewards_discount_applied AS "rewardsDiscountApplied",
       '/receipt/' || order_number AS "receiptUrl"
FROM decisions WHERE status = 'accepted'""")
def order_responses(t):
    """What accepted order requests are answered with."""
    return _intake(t)["responses"]


def _answer_sql(reasons: dict, field: int) -> str:
    quoted = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"
    return "CASE reason " + " ".join(f"WHEN '{r}' THEN {quoted(a[field])}" for r, a in reasons.items()) + " END"


@query("order_answers", INTAKE_SQL + f"""
SELECT request_id, arrived_at, CASE status WHEN 'accepted' THEN {OR.CREATED} ELSE {_answer_sql(OR.ANSWERS, 0)} END AS http_status,
       {_answer_sql(OR.ANSWERS, 1)} AS error, order_number AS "orderNumber", subtotal, tax, discount, total,
       rewards_discount_applied AS "rewardsDiscountApplied", '/receipt/' || order_number AS "receiptUrl"
FROM decisions""")
def order_answers(t):
    """The answer to every order request, refused ones included."""
    return _intake(t)["answers"]


@query("customer_answers", f"""
SELECT request_id, arrived_at, CASE status WHEN 'accepted' THEN {CU.CREATED} ELSE {_answer_sql(CU.ANSWERS, 0)} END AS http_status,
       {_answer_sql(CU.ANSWERS, 1)} AS error, customer_id AS "customerId", CASE status WHEN 'accepted' THEN firstname END AS firstname,
       CASE status WHEN 'accepted' THEN lastname END AS lastname, CASE status WHEN 'accepted' THEN email END AS email
FROM ({SQL["customer_intake"]})""")
def customer_answers(t):
    """The answer to every customer request, refused ones with the holder's id included."""
    return CU.intake_customers(signup_requests(t["events"]), _existing_for_signup(t["customer"]))["answers"]


@query("intake_orders", INTAKE_SQL + """
SELECT d.order_number, a.user_id AS order_customer_id, d.subtotal, d.tax, d.discount, d.total,
       d.arrived_at AS created_at
FROM decisions d JOIN acc a USING (order_number)""")
def intake_orders(t):
    """Accepted orders numbered after the existing ones."""
    return _intake(t)["orders"]


@query("intake_tickets", INTAKE_SQL + """
SELECT first_ticket_id + unnest(range(q)) AS ticket_id, user_id AS ticket_customer_id,
       showing_id AS ticket_showing_id, order_number AS ticket_order_number FROM acc""")
def intake_tickets(t):
    """One ticket per seat, ids continuing the existing ones."""
    return _intake(t)["tickets"]


@query("intake_items", INTAKE_SQL + """
SELECT a.order_number, k.concession_id, CAST(k.qty AS INTEGER) AS quantity FROM acc a JOIN kept k USING (row_key)""")
def intake_items(t):
    """The usable items of accepted orders."""
    return _intake(t)["items"]


@query("intake_seats", INTAKE_SQL + """
SELECT s.showing_id, CAST(s.seats0 - coalesce(x.taken, 0) AS INTEGER) AS film_available_seats
FROM shows s LEFT JOIN (SELECT showing_id, sum(q) AS taken FROM acc GROUP BY 1) x USING (showing_id)""")
def intake_seats(t):
    """A10: the new seat snapshot."""
    return _intake(t)["seats"]


# ---- A6 conform, A11 registry ------------------------------------------------------------
@query("conform_old_layout", f"""
SELECT c_custkey AS customer_id, c_mktsegment AS firstname, c_name AS lastname,
       lower(c_mktsegment) || '.' || CAST(c_nationkey AS VARCHAR) || '@mail.com' AS email,
       CAST(NULL AS VARCHAR) AS phone, CAST(NULL AS INTEGER) AS age, CAST(NULL AS VARCHAR) AS gender,
       'City ' || CAST(c_nationkey AS VARCHAR) AS home_city, c_acctbal >= {V.MEMBER_BALANCE} AS rewards_member,
       CAST(NULL AS VARCHAR) AS pref_pymt_method
FROM customer""")
def conform_old_layout(t):
    """Customers in the older layout (``city``) conformed to the final one."""
    c = t["customer"]
    old = c.select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("firstname"),
                   F.col("c_name").alias("lastname"), V.email_of(F.col("c_mktsegment"), F.col("c_nationkey")).alias("email"),
                   F.lit(None).cast("string").alias("phone"), F.lit(None).cast("int").alias("age"),
                   F.lit(None).cast("string").alias("gender"),
                   F.concat(F.lit("City "), F.col("c_nationkey").cast("string")).alias("city"),
                   F.lit(None).cast("string").alias("pref_pymt_method"),
                   (F.col("c_acctbal") >= V.MEMBER_BALANCE).alias("rewards_member"))
    conformed, _ = conform_customers(old)
    return conformed.withColumn("customer_id", F.col("customer_id").cast("bigint"))


# Fixed values of the binding: rows of the older layout (even keys), and those that lack a required value.
NO_EMAIL_MOD, NO_TOTAL_MOD = 50, 10


@query("conform_mixed_layouts", f"""
SELECT 'customers' AS table_name, CAST(c_custkey AS VARCHAR) AS row_key, 'City ' || c_nationkey AS value,
       CASE WHEN c_custkey % {NO_EMAIL_MOD} = 0 THEN 'missing: email' END AS reason FROM customer
UNION ALL
SELECT 'orders', CAST(o_orderkey AS VARCHAR),
       CAST(CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_totalprice AS DECIMAL(10,2))
                 WHEN o_orderkey % {NO_TOTAL_MOD} > 0 THEN CAST(round(CAST(CAST(o_totalprice AS DECIMAL(10,2)) + CASE o_orderstatus WHEN 'F' THEN 1.00 ELSE 0 END AS DOUBLE) / 1.08, 2) AS DECIMAL(10,2)) END AS VARCHAR),
       CASE WHEN o_orderkey % {NO_TOTAL_MOD} = 0 THEN 'missing: subtotal, tax, total' END FROM orders
UNION ALL
SELECT 'shifts', CAST(event_id AS VARCHAR), CASE WHEN user_id % 6 <> 0 THEN CAST(user_id % 25 AS VARCHAR) END,
       CASE WHEN user_id % 6 = 0 THEN 'missing: shift_department_id' END FROM events
UNION ALL
SELECT 'concessions', CAST(p_partkey AS VARCHAR), CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS VARCHAR), NULL FROM part""")
def conform_mixed_layouts(t):
    """Rows of both layouts conformed, with the reject reasons: customers, orders, shifts and concessions."""
    text = lambda c: F.col(c).cast("string")
    c = V.customers_from_customer(t["customer"]).withColumn("email", F.when(F.col("customer_id") % NO_EMAIL_MOD != 0, F.col("email")))
    even = F.col("customer_id") % 2 == 0
    customers = c.where(~even).unionByName(c.where(even).withColumnRenamed("home_city", "city").drop("rewards_member"), allowMissingColumns=True)
    o, even = t["orders"], F.col("o_orderkey") % 2 == 0
    shared = [F.col("o_orderkey").alias("order_number"), F.col("o_custkey").cast("string").alias("order_customer_id"), F.col("o_orderdate").alias("created_at")]
    amount = F.col("o_totalprice").cast("decimal(10,2)")
    new = o.where(~even).select(*shared, amount.alias("subtotal"))
    old = o.where(even).select(*shared, F.when(F.col("o_orderkey") % NO_TOTAL_MOD != 0, amount).alias("order_total"),
                               F.when(F.col("o_orderstatus") == "F", 1).cast("decimal(10,2)").alias("order_discount"))
    part, even = V.concessions_from_part(t["part"]), F.col("concession_id") % 2 == 0
    concessions = part.where(~even).unionByName(part.where(even).withColumn("stock", F.lit(1)), allowMissingColumns=True)
    done = {"customers": ("customer_id", "home_city", conform_customers(customers)),
            "orders": ("order_number", "subtotal", conform_orders(new.unionByName(old, allowMissingColumns=True), derive_subtotal=True)),
            "shifts": ("shift_id", "shift_department_id", conform_shifts(V.shifts_from_events(t["events"]))),
            "concessions": ("concession_id", "concession_price", conform_concessions(concessions))}
    out = []
    for name, (key, value, (kept, rejected)) in done.items():
        for df, reason in ((kept, F.lit(None).cast("string")), (rejected, F.col("reason"))):
            out.append(df.select(F.lit(name).alias("table_name"), text(key).alias("row_key"), text(value).alias("value"), reason.alias("reason")))
    return union_all(out)


@query("dataset_by_name", SQL["concession_units"])
def dataset_by_name_query(t):
    """The overview set named 'concessionSales', picked from the registry."""
    from marquee.plans import star
    return dataset_by_name(t.spark, star.overview_sets(t), "concessionSales")
