"""Order intake as a Structured Streaming job (``foreachBatch``).

Each micro-batch runs the batch operator (P2).  What it needs of the past is kept as state:
the seats taken per showing, and the highest order number and ticket id.  A batch reads the
state that the batch before left and writes its own beside it, so the files that a batch
lists and reads do not grow with the number of batches.  While the stream runs, it is the
only writer of orders, tickets, items and showings.

The job is safe to replay after a failure at any point of a batch:

1. the batch's decisions are recorded first (with their order numbers, ticket ids and
   items) in a folder of the batch, overwritten until its success marker is there; a replay
   reuses a complete record instead of deciding again, and decides again over an incomplete one;
2. orders, tickets and items of a batch are written as a whole in folders of its own inside
   the tables: writing them again replaces them;
3. the stream never rewrites ``showings``: the seats in effect are the stored seats minus
   those that the state names;
4. the state after the batch is written from the state before it, which stays until then;
5. the batch id is recorded last; a fully applied batch is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.customers import intake_customers, new_customers
from marquee.operators.orders import intake, outputs, seats_left
from marquee.sources.requests import parse_bodies
from marquee.sources.sinks import append_batch
from marquee.sources.tables import exists, read_table, remove, table_path, version_path, versions

REQUEST_SCHEMA = "request_id bigint, arrived_at timestamp_ntz, body string"
BATCHES = "_order_batches"
DECISIONS = "_order_decisions"
STATE = "_order_state"
CUSTOMER_DECISIONS = "_customer_decisions"
#: State: the seats taken of a showing, or (no showing) the highest number given out.
STATE_SCHEMA = "name string, showing_id int, amount bigint"
SEATS, ORDERS, TICKETS = "seats", "orders", "tickets"


def _batch_name(batch_id: int) -> str:
    return f"batch-{batch_id}"


def _batch_path(root: str, name: str, batch_id: int) -> str:
    return f"{table_path(root, name)}/{_batch_name(batch_id)}"


def _initial_state(spark: SparkSession, root: str) -> DataFrame:
    """Before the first batch: no seats taken, and the highest numbers stored."""
    top = lambda name, table, column: read_table(spark, root, table).agg(F.coalesce(F.max(column), F.lit(0)).alias("amount")).select(
        F.lit(name).alias("name"), F.lit(None).cast("int").alias("showing_id"), "amount")
    return top(ORDERS, "orders", "order_number").unionByName(top(TICKETS, "tickets", "ticket_id"))


def state_path(spark: SparkSession, root: str, batch_id: int | None = None) -> str:
    """The newest complete state (before a batch: version n is the state before batch n).  The first one is
    written before any batch writes a row, so it never counts a batch's own rows."""
    folder = table_path(root, STATE)
    if batch_id is not None and exists(spark, f"{version_path(folder, batch_id)}/_SUCCESS"):
        return version_path(folder, batch_id)
    complete = [v for v, done in versions(spark, folder).items() if done and (batch_id is None or v <= batch_id)]
    if not complete:
        _initial_state(spark, root).write.mode("overwrite").parquet(version_path(folder, 0))
    return version_path(folder, max(complete, default=0))


def _state(spark: SparkSession, root: str, batch_id: int | None = None) -> DataFrame:
    return spark.read.schema(STATE_SCHEMA).parquet(state_path(spark, root, batch_id))


def _showings(spark: SparkSession, root: str, state: DataFrame) -> DataFrame:
    taken = state.where(F.col("name") == SEATS).select("showing_id", F.col("amount").alias("ticket_qty"))
    return seats_left(read_table(spark, root, "showings"), taken)


def current_showings(spark: SparkSession, root: str) -> DataFrame:
    """Stored showings with the seats taken by the stream removed."""
    return _showings(spark, root, _state(spark, root))


def _state_after(before: DataFrame, accepted: DataFrame) -> DataFrame:
    seats = accepted.select(F.lit(SEATS).alias("name"), F.col("showing_id").cast("int").alias("showing_id"), F.col("ticket_qty").alias("amount"))
    top = lambda name, c: accepted.agg(F.max(c).alias("amount")).where("amount is not null").select(
        F.lit(name).alias("name"), F.lit(None).cast("int").alias("showing_id"), "amount")
    marks = top(ORDERS, F.col("order_number")).unionByName(top(TICKETS, F.col("first_ticket_id") + F.col("ticket_qty") - 1))
    amount = F.when(F.first("name") == SEATS, F.sum("amount")).otherwise(F.max("amount"))
    return before.unionByName(seats).unionByName(marks).groupBy("name", "showing_id").agg(amount.alias("amount"))


def process_batch(batch: DataFrame, batch_id: int, root: str, record: bool = True) -> None:
    """Run P2 on one micro-batch and apply its writes to the store (replay-safe).
    ``record=False`` stops before the batch id is recorded (a crash at the last step)."""
    spark = batch.sparkSession
    if exists(spark, f"{_batch_path(root, BATCHES, batch_id)}/_SUCCESS"):
        return
    state = _state(spark, root, batch_id)
    decisions = _batch_path(root, DECISIONS, batch_id)
    if not exists(spark, f"{decisions}/_SUCCESS"):
        mark = lambda name, column: state.where(F.col("name") == name).select(F.col("amount").alias(column))
        out = intake(parse_bodies(batch), read_table(spark, root, "customers"), _showings(spark, root, state), read_table(spark, root, "concessions"),
                     mark(ORDERS, "order_number"), mark(TICKETS, "ticket_id"), pin=False)
        out["internal"].write.mode("overwrite").parquet(decisions)
    mine = spark.read.parquet(decisions)
    out = outputs(mine, read_table(spark, root, "showings"))
    for name, table in (("orders", "orders"), ("tickets", "tickets"), ("items", "order_concessions")):
        append_batch(out[name], root, table, _batch_name(batch_id))
    folder = table_path(root, STATE)
    _state_after(state, mine.where(F.col("status") == "accepted")).write.mode("overwrite").parquet(version_path(folder, batch_id + 1))
    if not record:
        return
    spark.createDataFrame([(batch_id,)], "batch_id long").write.mode("overwrite").parquet(_batch_path(root, BATCHES, batch_id))
    for v in versions(spark, folder):  # the state before stays for those who are reading it
        if v < batch_id:
            remove(spark, version_path(folder, v))


def process_customers(batch: DataFrame, batch_id: int, root: str) -> None:
    """P3 on one micro-batch: decide, record, append the accepted customers (replay-safe like orders)."""
    spark = batch.sparkSession
    decisions = _batch_path(root, CUSTOMER_DECISIONS, batch_id)
    if not exists(spark, f"{decisions}/_SUCCESS"):
        decided = intake_customers(parse_bodies(batch), read_table(spark, root, "customers"))["decisions"]
        decided.write.mode("overwrite").parquet(decisions)
    append_batch(new_customers(spark.read.parquet(decisions)), root, "customers", _batch_name(batch_id))


def start(spark: SparkSession, source_dir: str, root: str, checkpoint: str, available_now: bool = True, process=process_batch):
    """Stream JSON-lines request files from ``source_dir`` into the store (``process``: orders, or ``process_customers``)."""
    stream = spark.readStream.schema(REQUEST_SCHEMA).json(source_dir)
    writer = (stream.writeStream.foreachBatch(lambda df, bid: process(df, bid, root))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
