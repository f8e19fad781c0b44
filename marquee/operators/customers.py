"""P3 customer intake, B6/C12 e-mail conflicts, D10/G8 next customer id.

Within a batch the requests are decided as if sent one at a time in arrival
order: the first arrival of an e-mail (case folded as SQLite folds: ASCII
only) wins unless an existing customer holds it; later ones are refused with
the holder's id.  Winners get consecutive ``C%03d`` ids after the highest
existing numeric id.  Every row is a request of its own, whatever its request_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import columns as C
from marquee.operators.orders import answer_of
from marquee.operators.sequencing import global_prefix
from marquee.session import materialize
from marquee.sources import requests as Q

# Refusal reasons.
EMAIL_REQUIRED = "email_required"
DUPLICATE_EMAIL = "duplicate_email"
ACCEPTED, REFUSED = "accepted", "refused"
# The answers to refused requests (status, error).
ANSWERS = {EMAIL_REQUIRED: (400, "Email is required."), DUPLICATE_EMAIL: (409, "A customer with that email already exists.")}
CREATED = 201

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
ARRIVAL = ["arrived_at", "request_id"]


def ascii_lower(c):
    """SQLite ``lower()``: folds ASCII letters only."""
    return F.translate(C.col(c), _UPPER, _LOWER)


def email_holders(customers: DataFrame) -> DataFrame:
    """First customer per folded e-mail: (email_key, holder_id).  "First" is the
    lowest numeric id suffix (insertion order of ``C%03d`` ids); ids of another form come after, by id."""
    n = C.customer_id_number(F.col("customer_id").cast("string"))
    order = F.struct(n.isNull().alias("other"), n.alias("n"), F.col("customer_id").alias("id"))
    return (customers.groupBy(ascii_lower("email").alias("email_key"))
            .agg(F.min(order)["id"].alias("holder_id")))


def email_conflicts(requests: DataFrame, customers: DataFrame) -> DataFrame:
    """Requests whose e-mail matches an existing customer, case-insensitively.
    Customers are reduced to one row per e-mail, pinned so that a hot e-mail's requests can be split."""
    holders = materialize(email_holders(customers))
    return (requests.join(holders, ascii_lower("email") == holders.email_key)
            .select("request_id", "email", F.col("holder_id").alias("existing_customer_id")))


def max_customer_number(customers: DataFrame) -> DataFrame:
    """Highest numeric suffix of ``C<digits>`` ids (0 if none) and the next id."""
    m = customers.agg(F.coalesce(F.max(C.customer_id_number("customer_id")), F.lit(0)).alias("max_number"))
    return m.select("max_number", C.customer_id_text(F.col("max_number") + 1).alias("next_customer_id"))


def parse_customer_requests(requests: DataFrame) -> DataFrame:
    """Names, stripped e-mail and membership from the bodies.
    Fields are materialised stage by stage so each expression is built once."""
    p = F.col("payload")
    fields = {"_first": "firstName", "_last": "lastName", "_name": "name", "_email": "email", "_rew": "rewardsMember"}
    df = requests.select("request_id", Q.arrival("arrived_at"), *[Q.field(p, f).alias(c) for c, f in fields.items()])
    df = df.select("request_id", "arrived_at", *[Q.str_or_blank(F.col(c)).alias(c) for c in fields if c != "_rew"],
                   Q.truthy(F.col("_rew")).alias("rewards_member"))
    # Strip every text once, then decide the names from the stripped columns.
    df = df.select("request_id", "arrived_at", "rewards_member",
                   *[F.coalesce(C.py_strip(c), F.lit("")).alias(c) for c in ("_first", "_last", "_name", "_email")])
    df = df.select("request_id", "arrived_at", "rewards_member", "_first", "_last", F.col("_email").alias("email"),
                   C.split_stripped(F.col("_name")).alias("_parsed"))
    given = (F.col("_first") != "") | (F.col("_last") != "")
    return df.select(
        "request_id", "arrived_at",
        F.when(given, F.when(F.col("_first") != "", F.col("_first")).otherwise(F.lit(C.GUEST_FIRST)))
        .otherwise(F.col("_parsed.firstname")).alias("firstname"),
        F.when(given, F.when(F.col("_last") != "", F.col("_last")).otherwise(F.lit(C.GUEST_LAST)))
        .otherwise(F.col("_parsed.lastname")).alias("lastname"),
        "email", "rewards_member")


def intake_customers(requests: DataFrame, customers: DataFrame) -> dict[str, DataFrame]:
    """Decide a batch of parsed customer requests; return decisions and new rows."""
    # Parsed requests are read twice: parse once and pin (narrow rows).
    r = parse_customer_requests(requests).withColumn("email_key", ascii_lower("email"))
    r = materialize(r.withColumn("_row", F.monotonically_increasing_id()))
    # One row per e-mail: its first arrival (aggregated map-side, so a hot e-mail is no hot task) and its holder.
    arrival = [*ARRIVAL, "_row"]
    firsts = (r.where(F.col("email") != "").groupBy("email_key").agg(F.min(F.struct(*arrival)).alias("first"))
              .join(email_holders(customers), "email_key", "left"))
    firsts = firsts.select("email_key", "holder_id", *[F.col(f"first.{c}").alias(c) for c in arrival])
    base = max_customer_number(customers).select("max_number").scalar()
    numbered = global_prefix(firsts, arrival, {"_n": F.when(F.col("holder_id").isNull(), 1)})
    lookup = numbered.select("email_key", "holder_id", F.when(F.col("holder_id").isNull(), C.customer_id_text(base + F.col("_n") + 1)).alias("new_id"), F.col("_row").alias("_winner"))
    known = r.where(F.col("email") != "").join(lookup, "email_key")
    known = (known.withColumn("reason", F.when(F.col("holder_id").isNotNull() | (F.col("_winner") != F.col("_row")),
                                               F.lit(DUPLICATE_EMAIL)))
             .withColumn("customer_id", F.coalesce(F.col("holder_id").cast("string"), F.col("new_id"))))
    blank = r.where(F.col("email") == "").withColumns({"reason": F.lit(EMAIL_REQUIRED), "customer_id": F.lit(None).cast("string")})
    columns = [*r.columns, "reason", "customer_id"]
    d = known.select(*columns).unionByName(blank.select(*columns))
    d = d.withColumn("status", F.when(F.col("reason").isNull(), F.lit(ACCEPTED)).otherwise(F.lit(REFUSED)))
    decisions = d.select("request_id", "arrived_at", "status", "reason", "customer_id", "firstname", "lastname",
                         "email", "rewards_member")
    return {"decisions": decisions, "responses": responses(decisions), "answers": answers(decisions), "customers": new_customers(decisions)}


def answers(decisions: DataFrame) -> DataFrame:
    """What each request is answered with: the status, the error text and the holder's id of refused ones, the
    customer of accepted ones."""
    ok = F.col("status") == ACCEPTED
    return decisions.select("request_id", "arrived_at", F.when(ok, CREATED).otherwise(answer_of(ANSWERS, 0)).alias("http_status"), answer_of(ANSWERS, 1).alias("error"),
                            F.col("customer_id").alias("customerId"), *[F.when(ok, F.col(c)).alias(c) for c in ("firstname", "lastname", "email")])


def responses(decisions: DataFrame) -> DataFrame:
    """What an accepted request is answered with."""
    return decisions.where(F.col("status") == ACCEPTED).select(
        F.col("customer_id").alias("customerId"), "firstname", "lastname", "email")


def new_customers(decisions: DataFrame) -> DataFrame:
    """The customer rows of accepted decisions."""
    return decisions.where(F.col("status") == ACCEPTED).select(
        "customer_id", "firstname", "lastname", "email", F.lit(None).cast("string").alias("phone"),
        F.lit(None).cast("int").alias("age"), F.lit(None).cast("string").alias("gender"),
        F.lit(None).cast("string").alias("home_city"), "rewards_member",
        F.lit(None).cast("string").alias("pref_pymt_method"))
