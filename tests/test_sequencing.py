"""W1/W2 against brute force: numbering, prefix sums and the seat fold,
with one hot key holding a large share of the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import seats
from marquee.operators.seats import allocate_seats
from marquee.operators.sequencing import consecutive_ids, global_prefix


def _requests(seed, n, hot_share):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        show = 1 if rnd.random() < hot_share else rnd.randint(2, 30)
        out.append((i, rnd.randint(0, n // 2), show, rnd.randint(1, 12), rnd.random() < 0.1, 20 + show % 40))
    return out


def _brute(rows_):
    rem, exp = {}, {}
    for rid, ts, sh, q, blocked, s0 in sorted(rows_, key=lambda r: (r[1], r[0])):
        cur = rem.get(sh, s0)
        ok = q <= cur
        acc = ok and not blocked
        exp[rid] = (cur, ok, acc)
        rem[sh] = cur - q if acc else cur
    return exp


@pytest.mark.parametrize("seed,hot", [(1, 0.0), (2, 0.35), (3, 0.9)])
def test_seat_fold_matches_sequential(spark, seed, hot):
    data = _requests(seed, 2500, hot)
    df = spark.createDataFrame(data, "request_id long, arrived_at long, showing_id long, qty long, blocked boolean, "
                                     "seats0 long")
    got = {r.request_id: (r.seats_before, r.seat_ok, r.accepted) for r in allocate_seats(df).collect()}
    assert got == _brute(data)


def test_seat_fold_properties(spark):
    data = _requests(4, 2000, 0.5)
    df = spark.createDataFrame(data, "request_id long, arrived_at long, showing_id long, qty long, blocked boolean, "
                                     "seats0 long")
    out = allocate_seats(df).collect()
    taken, initial = {}, {}
    for r in out:
        initial[r.showing_id] = r.seats0
        assert r.seats_before >= 0
        if r.accepted:
            taken[r.showing_id] = taken.get(r.showing_id, 0) + r.qty
    for sh, t in taken.items():
        assert t <= initial[sh]


def test_consecutive_ids_and_prefix(spark):
    rnd = random.Random(5)
    data = [(i, rnd.randint(0, 50), rnd.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(data, "rid long, ts long, w long")
    got = {r.rid: (r.id, r.before) for r in
           global_prefix(consecutive_ids(df, ["ts", "rid"], 100, "id"), ["ts", "rid"],
                         {"before": F.col("w")}).collect()}
    order = sorted(data, key=lambda r: (r[1], r[0]))
    run = 0
    for i, (rid, _, w) in enumerate(order):
        assert got[rid] == (101 + i, run)
        run += w


def test_numbering_keeps_large_and_null_ids(spark):
    """Numbers above 2^53, nulls, text and late years pass unchanged."""
    data = [(i, 2**53 + 1 + i if i % 3 else None, f"t{i}", "9999-12-31 23:59:59", i % 5 if i % 4 else None) for i in range(500)]
    df = spark.createDataFrame(data, "rid long, big long, t string, late string, w long").selectExpr("rid", "big", "t", "cast(late as timestamp_ntz) late", "w")
    out = global_prefix(df, ["rid"], {"n": None, "s": F.col("w")})
    assert "InPandas" not in out._jdf.queryExecution().toString() and dict(out.dtypes)["big"] == "bigint"
    run = 0
    for r, d in zip(out.selectExpr("rid", "big", "t", "cast(late as string) late", "n", "s").orderBy("rid").collect(), data, strict=True):
        assert tuple(r) == (*d[:4], d[0], run)
        run += d[4] or 0


@pytest.mark.parametrize("hot_rows", [10**6, 50])
def test_row_number_within_a_hot_key(spark, monkeypatch, hot_rows):
    from marquee.operators import sequencing
    monkeypatch.setattr(sequencing, "HOT_ROWS", hot_rows)
    rnd = random.Random(9)
    data = [(1 if rnd.random() < 0.6 else rnd.randint(2, 80), rnd.randint(0, 20), i) for i in range(4000)]
    df = spark.createDataFrame(data, "k long, a long, i long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = sequencing.row_number_within(df, ["k"], ["a", "i"], "rn")
        got = [(r.k, r.rn, r.i) for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    exp = []
    for k in sorted({d[0] for d in data}):
        exp += [(k, n, d[2]) for n, d in enumerate(sorted((d for d in data if d[0] == k), key=lambda d: (d[1], d[2])), 1)]
    assert got == exp  # also in order
    if hot_rows > len(data):
        assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange rangepartitioning") == 1


def test_seat_functions_compose():
    rnd = random.Random(3)
    for _ in range(200):
        s0 = rnd.randint(0, 40)
        q = np.array([rnd.randint(1, 15) for _ in range(rnd.randint(0, 30))], np.int64)
        b = np.array([rnd.random() < 0.2 for _ in q], bool)

        def left(start, q=q, b=b):
            for x, blocked in zip(q, b):
                if x <= start and not blocked:
                    start -= int(x)
            return start

        k = rnd.randint(0, len(q))
        whole = seats.transfer(s0, q, b)
        parts = seats.compose(seats.transfer(s0, q[:k], b[:k]), seats.transfer(s0, q[k:], b[k:]), s0)
        for start in range(s0 + 1):
            assert seats.after(whole, start) == seats.after(parts, start) == left(start)
            before, ok, rem = seats.fold(start, q, b)
            now = start
            for x, blocked, y, fits in zip(q, b, before, ok):
                assert (y, fits) == (now, x <= now)
                now -= int(x) if x <= now and not blocked else 0
            assert rem == now


def test_seat_fold_of_a_hot_showing_over_many_ranges(spark, monkeypatch):
    """50,000 seats over many ranges: neighbours are merged in a tree, few functions to a task."""
    monkeypatch.setattr(seats, "FAN", 4)
    rnd = random.Random(12)
    data = [(i, i // 3, 1 if i % 10 else 2, rnd.choice([1, 2, 3, 90, 40_000]), rnd.random() < 0.05, 50_000) for i in range(30_000)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = allocate_seats(spark.createDataFrame(data, "request_id long, arrived_at long, showing_id long, qty long, blocked boolean, seats0 long"))
        got = {r.request_id: (r.seats_before, r.seat_ok, r.accepted) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == _brute(data)


def test_seat_fold_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        folded = {r.request_id: r.accepted for r in allocate_seats(spark.createDataFrame(
            _requests(6, 1500, 0.7), "request_id long, arrived_at long, showing_id long, qty long, "
                                     "blocked boolean, seats0 long")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert folded == {k: v[2] for k, v in _brute(_requests(6, 1500, 0.7)).items()}
