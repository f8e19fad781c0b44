"""Properties from SURVEY §5: batch-cut invariance of order intake, and the
request number rule against Python's own ``int()``."""

import datetime as dt
import json
import os
import random

from conftest import rows

from marquee.operators import orders as OR
from marquee.sources import requests as Q
from marquee.sources.requests import parse_bodies
from marquee.sources.tables import init_store, read_table


def _random_requests(n, seed=11):
    rnd = random.Random(seed)
    t0 = dt.datetime(2026, 4, 17, 9)
    out = []
    for i in range(n):
        body = {"customerId": f"C{rnd.randint(1, 22):03d}", "showingId": rnd.choice([7, 10, 7, 5, 99]),
                "ticketQty": rnd.randint(1, 9)}
        if rnd.random() < 0.5:
            body["concessions"] = [{"id": f"CN{rnd.randint(1, 21):03d}", "qty": rnd.randint(0, 3)}
                                   for _ in range(rnd.randint(1, 2))]
        out.append((i + 1, (t0 + dt.timedelta(seconds=i)).isoformat(), json.dumps(body)))
    return out


def test_one_batch_equals_several(spark, seed, scratch):
    from marquee.streaming.intake import DECISIONS, current_showings, process_batch
    reqs = _random_requests(60)
    schema = "request_id bigint, arrived_at string, body string"
    whole = OR.intake(parse_bodies(spark.createDataFrame(reqs, schema).selectExpr(
        "request_id", "cast(arrived_at as timestamp_ntz) arrived_at", "body")), seed["customers"], seed["showings"],
        seed["concessions"], seed["orders"], seed["tickets"])
    root = os.path.join(scratch, "store")
    init_store(spark, root)
    for b, part in enumerate([reqs[:17], reqs[17:40], reqs[40:]]):
        df = spark.createDataFrame(part, schema).selectExpr("request_id", "cast(arrived_at as timestamp_ntz) arrived_at",
                                                          "body")
        process_batch(df, b, root)
    cut = spark.read.parquet(os.path.join(root, DECISIONS, "batch-*"))
    assert sorted(rows(whole["decisions"], "request_id", "status", "reason", "order_number")) == \
        sorted(rows(cut, "request_id", "status", "reason", "order_number"))
    assert sorted(rows(whole["tickets"])) == sorted(rows(read_table(spark, root, "tickets").where("ticket_id > 15")))
    assert sorted(rows(whole["seats"], "showing_id", "film_available_seats")) == \
        sorted(rows(current_showings(spark, root), "showing_id", "film_available_seats"))
    seats = dict(rows(whole["seats"], "showing_id", "film_available_seats"))
    assert min(seats.values()) >= 0
    taken = sum(r[0] for r in rows(whole["decisions"].where("status = 'accepted'"), "ticket_qty"))
    assert taken == whole["tickets"].count()


def _py_int(value, present=True):
    """The reference's rule: int(payload.get(name, 0)) -> (value, failed)."""
    if not present:
        return 0, False
    try:
        return int(value), False
    except (TypeError, ValueError):
        return None, True


def test_int_rule_matches_python(spark):
    values = [0, 1, -3, 2.7, -2.7, 1e3, True, False, None, "3", " 4 ", "-5", "+6", "2.7", "x", "", "1e3",
              [1], {"a": 1}, 123456789012]
    bodies = [(i, json.dumps({"q": v})) for i, v in enumerate(values)] + [(len(values), json.dumps({}))]
    df = parse_bodies(spark.createDataFrame(bodies, "request_id long, body string"))
    v, bad = Q.py_int(Q.field(df.payload, "q"), 0)
    got = dict((r[0], (r[1], r[2])) for r in rows(df.select("request_id", v, bad)))
    for i, value in enumerate(values):
        assert got[i] == _py_int(value), (value, got[i])
    assert got[len(values)] == _py_int(None, present=False)
