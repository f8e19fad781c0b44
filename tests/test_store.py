"""Store lifecycle (A3-A5), sinks (A8-A10), conform (A6), registry (A11), stream."""

import datetime as dt
import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from marquee.operators.orders import seats_left
from marquee.plans.registry import cinema_datasets, dataset_by_name
from marquee.sources import sinks
from marquee.sources.conform import conform_customers, conform_orders, conform_shifts
from marquee.sources.tables import drop_tables, init_store, read_table, read_tables, stored_version


def test_rebuild_and_keep(spark, scratch):
    root = os.path.join(scratch, "store")
    assert init_store(spark, root) == "rebuilt"
    assert stored_version(spark, root) == 2
    assert read_table(spark, root, "employees").count() == 20
    assert init_store(spark, root) == "kept"
    assert read_table(spark, root, "orders").count() == 10
    assert "order_concessions" in drop_tables(spark, root)
    assert stored_version(spark, root) == 0


def test_append_json_and_snapshot(spark, scratch):
    root = os.path.join(scratch, "store")
    init_store(spark, root)
    t = read_tables(spark, root)
    sinks.append_rows(spark.createDataFrame([(11, "C001", 1)], "order_number long, concession_id string, x int")
                      .drop("x"), root, "order_concessions")
    assert rows(read_table(spark, root, "order_concessions").where("order_number = 11"), "quantity") == [(1,)]
    taken = spark.createDataFrame([(7, 5)], "showing_id int, ticket_qty long")
    sinks.replace_table(seats_left(t["showings"], taken), root, "showings")
    assert rows(read_table(spark, root, "showings").where("showing_id = 7"), "film_available_seats") == [(15,)]
    out = os.path.join(scratch, "json")
    sinks.write_named_json({"films": t["films"], "empty": t["films"].limit(0)}, out)
    assert len(spark.read.json(os.path.join(out, "films")).collect()) == 10
    sinks.write_named_json({"theatres": t["theatres"]}, out)
    lines = spark.read.text(os.path.join(out, "theatres")).collect()
    assert all(set(json.loads(r.value)) == set(t["theatres"].columns) for r in lines)  # nulls keep their keys


def test_unreadable_version_drops_nothing(spark, scratch):
    root = os.path.join(scratch, "store")
    init_store(spark, root)
    meta = os.path.join(root, "_meta")
    for name in os.listdir(meta):
        if name.endswith(".parquet"):
            with open(os.path.join(meta, name), "w") as f:
                f.write("damaged")
    with pytest.raises(Exception):
        init_store(spark, root)
    assert read_table(spark, root, "customers").count() == 20


def test_snapshots_survive_crashes_and_readers(spark, scratch):
    from marquee.sources.tables import SNAPSHOTS, version_path, versions
    root = os.path.join(scratch, "store")
    init_store(spark, root)
    folder = os.path.join(root, "films" + SNAPSHOTS)
    reader = read_table(spark, root, "films")
    sinks.replace_table(reader.limit(3), root, "films")
    assert read_table(spark, root, "films").count() == 3 and reader.count() == 10   # a reader keeps what it has found
    reader = read_table(spark, root, "films")
    half = version_path(folder, 2)
    read_table(spark, root, "films").limit(1).write.parquet(half)
    os.remove(os.path.join(half, "_SUCCESS"))                                       # a writer that was cut off
    assert read_table(spark, root, "films").count() == 3
    sinks.replace_table(read_table(spark, root, "films").limit(2), root, "films")   # reads the table that it replaces
    assert read_table(spark, root, "films").count() == 2 and reader.count() == 3
    assert versions(spark, folder) == {1: True, 3: True}                            # the leftover folder is gone
    sinks.append_rows(read_table(spark, root, "films").limit(1), root, "films")
    assert read_table(spark, root, "films").count() == 3
    sinks.append_batch(read_table(spark, root, "films").limit(1), root, "films", "batch-7")
    sinks.append_batch(read_table(spark, root, "films").limit(1), root, "films", "batch-7")
    assert read_table(spark, root, "films").count() == 4                            # a batch appended twice is there once
    assert "films" in drop_tables(spark, root) and not os.path.exists(folder)
    assert init_store(spark, root) == "rebuilt" and read_table(spark, root, "films").count() == 10


def test_conform_old_layout(spark):
    old = spark.createDataFrame([("C1", "A", "B", "a@x", None, None, None, "Utica", None, None),
                                 ("C2", "A", "B", None, None, None, None, "Utica", None, True)],
                                "customer_id string, firstname string, lastname string, email string, phone string, "
                                "age int, gender string, city string, pref_pymt_method string, rewards_member boolean")
    ok, bad = conform_customers(old)
    assert rows(ok, "customer_id", "home_city", "rewards_member") == [("C1", "Utica", False)]
    assert rows(bad, "customer_id", "reason") == [("C2", "missing: email")]
    orders = spark.createDataFrame([(1, "C1", "24.84", "0.00")],
                                   "order_number long, order_customer_id string, order_total string, order_discount string")
    orders = orders.selectExpr("order_number", "order_customer_id", "cast(order_total as decimal(10,2)) order_total",
                               "cast(order_discount as decimal(10,2)) order_discount",
                               "timestamp_ntz'2026-04-17 18:00:00' created_at")
    ok, bad = conform_orders(orders, derive_subtotal=True)
    assert [str(x) for x in rows(ok, "subtotal", "tax", "total")[0]] == ["23.00", "1.84", "24.84"]
    ok, bad = conform_orders(orders)
    assert ok.count() == 0 and bad.count() == 1
    shifts = spark.createDataFrame([(1, "E01", None, dt.datetime(2026, 4, 17, 9), dt.datetime(2026, 4, 17, 12), None)],
                                   "shift_id long, employee_id string, showing_id int, shift_start_datetime "
                                   "timestamp_ntz, shift_end_datetime timestamp_ntz, shift_department_id int")
    ok, bad = conform_shifts(shifts)
    assert ok.count() == 0 and bad.count() == 1


def test_files_of_both_layouts_in_one_folder(spark, scratch, seed):
    from marquee.sources.conform import conform_concessions, read_mixed
    folder = os.path.join(scratch, "orders")
    seed["orders"].limit(4).coalesce(1).write.parquet(folder)
    old = spark.createDataFrame([(50, "C001", "24.84", "0.00"), (51, "C002", None, "1.00"), (52, "C003", "10.80", None)],
                                "order_number long, order_customer_id string, order_total string, order_discount string")
    old.selectExpr("order_number", "order_customer_id", "cast(order_total as decimal(10,2)) order_total", "cast(order_discount as decimal(10,2)) order_discount",
                   "timestamp_ntz'2026-04-17 18:00:00' created_at").coalesce(1).write.mode("append").parquet(folder)
    both = read_mixed(spark, folder, "orders")
    ok, bad = conform_orders(both, derive_subtotal=True)
    assert ok.columns == seed["orders"].columns and ok.count() == 6
    assert sorted(rows(ok.where("order_number < 50"))) == sorted(rows(spark.read.parquet(folder).where("order_number < 50").select(*ok.columns)))
    assert sorted(rows(ok.where("order_number >= 50").selectExpr("order_number", "string(subtotal)", "string(tax)", "string(total)"))) == [
        (50, "23.00", "1.84", "24.84"), (52, "10.00", "0.80", "10.80")]
    assert rows(bad, "order_number", "reason") == [(51, "missing: subtotal, tax, total")]
    assert bad.first()["source_file"].endswith(".parquet")
    ok, bad = conform_orders(both)
    assert ok.count() == 4 and bad.count() == 3
    folder = os.path.join(scratch, "concessions")
    seed["concessions"].withColumn("stock", F.lit(3)).write.parquet(folder)
    ok, bad = conform_concessions(read_mixed(spark, folder, "concessions"))
    assert sorted(rows(ok)) == sorted(rows(seed["concessions"])) and bad.count() == 0


def test_registry(spark, seed):
    reg = cinema_datasets(seed)
    assert len(reg) == 11
    assert dataset_by_name(spark, reg, "topFilms").count() == 8
    assert dataset_by_name(spark, reg, "nope").count() == 0


def _write_requests(folder, reqs):
    os.makedirs(folder)
    with open(os.path.join(folder, "a.json"), "w") as fh:
        fh.write("\n".join(json.dumps(r) for r in reqs))


REQS = [{"request_id": 1, "arrived_at": "2026-04-17T09:00:00",
         "body": json.dumps({"customerId": "C002", "showingId": 7, "ticketQty": 12,
                             "concessions": [{"id": "CN001", "qty": 2}]})},
        {"request_id": 2, "arrived_at": "2026-04-17T09:00:01",
         "body": json.dumps({"customerId": "C004", "showingId": 7, "ticketQty": 12})}]


def _state(spark, root):
    from marquee.streaming.intake import current_showings
    return (read_table(spark, root, "orders").count(), read_table(spark, root, "tickets").count(),
            read_table(spark, root, "order_concessions").count(),
            rows(current_showings(spark, root).where("showing_id = 7"), "film_available_seats"))


def test_streaming_intake(spark, scratch):
    from marquee.streaming.intake import DECISIONS, process_batch, start
    root, src = os.path.join(scratch, "store"), os.path.join(scratch, "requests")
    init_store(spark, root)
    _write_requests(src, REQS)
    q = start(spark, src, root, os.path.join(scratch, "ckpt"))
    q.awaitTermination(300)
    assert _state(spark, root) == (11, 27, 13, [(8,)])
    batch = spark.read.schema("request_id bigint, arrived_at timestamp_ntz, body string").json(src)
    process_batch(batch, 0, root)          # a fully applied batch is skipped
    assert _state(spark, root) == (11, 27, 13, [(8,)])
    assert rows(spark.read.parquet(os.path.join(root, DECISIONS, "batch-0")).orderBy("request_id"), "reason") == [
        (None,), ("not_enough_seats",)]


def test_streaming_replay_after_crash(spark, scratch):
    from marquee.streaming.intake import process_batch
    root, src = os.path.join(scratch, "store"), os.path.join(scratch, "requests")
    init_store(spark, root)
    _write_requests(src, REQS)
    batch = spark.read.schema("request_id bigint, arrived_at timestamp_ntz, body string").json(src)
    process_batch(batch, 0, root, record=False)   # writes done, batch id not recorded
    assert _state(spark, root) == (11, 27, 13, [(8,)])
    process_batch(batch, 0, root)                 # the replay adds nothing
    assert _state(spark, root) == (11, 27, 13, [(8,)])


def test_incomplete_decisions_are_decided_again(spark, scratch):
    from marquee.streaming.intake import DECISIONS, process_batch
    root, src = os.path.join(scratch, "store"), os.path.join(scratch, "requests")
    init_store(spark, root)
    _write_requests(src, REQS)
    batch = spark.read.schema("request_id bigint, arrived_at timestamp_ntz, body string").json(src)
    half = os.path.join(root, DECISIONS, "batch-0")
    spark.range(1).write.parquet(half)            # a record that was cut off: no success marker
    os.remove(os.path.join(half, "_SUCCESS"))
    process_batch(batch, 0, root)
    assert _state(spark, root) == (11, 27, 13, [(8,)])


def test_files_of_a_batch_do_not_grow(spark, scratch):
    """The state that a batch reads and lists stays the same size; repeated ids and replays of late batches change nothing."""
    from marquee.sources.tables import table_path, versions
    from marquee.streaming import intake as stream
    root, schema = os.path.join(scratch, "store"), "request_id bigint, arrived_at timestamp_ntz, body string"
    init_store(spark, root)
    body = json.dumps({"customerId": "C002", "showingId": 7, "ticketQty": 3})
    seen = []
    for b in range(8):
        batch = spark.createDataFrame([(1, dt.datetime(2026, 4, 17, 9, b), body)], schema)  # one request id in every batch
        seen.append((len(stream._state(spark, root, b).inputFiles()), len(versions(spark, table_path(root, stream.STATE)))))
        stream.process_batch(batch, b, root, record=b != 5)
        if b == 5:
            stream.process_batch(batch, b, root)
    assert max(seen[3:]) == min(seen[3:]) and seen[-1][1] <= 2
    assert _state(spark, root) == (16, 33, 12, [(2,)])                              # six orders of three seats, then none fits
    last = spark.read.parquet(os.path.join(root, stream.DECISIONS, "batch-7"))
    assert rows(last, "reason") == [("not_enough_seats",)]
    numbers = [r[0] for r in rows(read_table(spark, root, "orders").where("order_number > 10").orderBy("order_number"), "order_number")]
    assert numbers == list(range(11, 17))
    assert read_table(spark, root, "tickets").agg({"ticket_id": "max"}).first()[0] == 33
    from marquee.operators.audit import audit_all
    audit = audit_all(read_tables(spark, root))                                     # the store holds its keys and references
    assert audit["pk_duplicates"].count() == audit["fk_orphans"].count() == 0


def test_streaming_customers(spark, scratch):
    from marquee.streaming.intake import process_customers, start
    root, src = os.path.join(scratch, "store"), os.path.join(scratch, "requests")
    init_store(spark, root)
    bodies = [{"name": "Ana Lima", "email": "ana@x.org"}, {"name": "Ana L", "email": "ANA@x.org"}, {"email": ""}]
    _write_requests(src, [{"request_id": i, "arrived_at": f"2026-04-17T09:00:0{i}", "body": json.dumps(b)} for i, b in enumerate(bodies)])
    start(spark, src, root, os.path.join(scratch, "ckpt"), process=process_customers).awaitTermination(300)
    assert rows(read_table(spark, root, "customers").where("customer_id = 'C021'"), "firstname", "email") == [("Ana", "ana@x.org")]
    batch = spark.read.schema("request_id bigint, arrived_at timestamp_ntz, body string").json(src)
    process_customers(batch, 0, root)             # a replay adds nothing
    assert read_table(spark, root, "customers").count() == 21


def test_explorer_view(spark, seed):
    from marquee.plans.registry import explorer_view
    shifts = explorer_view(cinema_datasets(seed)["shifts"]())
    got = {r["shift_id"]: (r["showing_id"], r["shift_start_datetime"]) for r in shifts.collect()}
    assert got["12"] == ("—", "2026-04-17 21:00:00")
