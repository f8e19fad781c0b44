"""First-come seat allocation per showing, exact and skew-safe.

A request is accepted when its quantity fits the seats left after the earlier
accepted requests of its showing; a refused request takes no seats, and a
``blocked`` request (refused for a reason tested after the seat check) passes
or fails the seat test but takes no seats either.  A plain running sum would
let refused requests consume seats.  But the seats left after a run of requests
are a function of the seats before it, and such functions compose associatively.

Plan (no group is collected whole):
1. range-partition requests on (showing, arrival) and checkpoint: a hot
   showing spreads over many ranges;
2. per range (Arrow batches), the function ``seats in -> seats out`` of its
   first and last showing segment (at most two rows per range), as breakpoints:
   a request adds at most one;
3. per showing, FAN neighbouring functions at a time are composed into one, until
   few are left; from there the seats that each segment starts with go down
   the same tree.  No task holds more than FAN functions of a showing;
4. per range, the rows are decided from that start (interior segments start
   from the showing's initial seats): accepted runs by prefix sums up to the next
   refusal, refused runs by searching the next request that fits.  Steps 2-4 are
   narrow or bounded, and other columns only pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators.sequencing import pinned_ranges
from marquee.session import materialize

#: Functions of one showing that a task composes.
FAN = 64
#: Rows that a search looks at first (then twice as many, and so on).
STEP = 256

# A function of the seats 0..s0: breakpoints (at, left); from one to the next, a seat more at the start is a seat more left.
Breaks = tuple[np.ndarray, np.ndarray]
IDENTITY: Breaks = (np.zeros(1, np.int64), np.zeros(1, np.int64))


def compose(first: Breaks, then: Breaks, s0: int) -> Breaks:
    """``then`` after ``first``."""
    at, left = first
    cut, to = then
    end = left + np.diff(np.append(at, s0 + 1))
    low, high = np.searchsorted(cut, left, "right"), np.searchsorted(cut, end, "left")
    n = np.maximum(high - low, 0)  # breakpoints of ``then`` inside each piece
    piece = np.repeat(np.arange(len(at)), n)
    inner = cut[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
    at, left = np.concatenate([at, at[piece] + inner - left[piece]]), np.concatenate([left, inner])
    order = np.argsort(at, kind="stable")
    at, left = at[order], left[order]
    k = np.searchsorted(cut, left, "right") - 1
    left = to[k] + left - cut[k]
    keep = np.concatenate([[True], np.diff(left) != np.diff(at)])
    return at[keep], left[keep]


def _next(hit, start: int, n: int) -> int:
    """The first place from ``start`` on where ``hit(from, to)`` is true, else ``n``."""
    step = STEP
    while start < n:
        found = np.flatnonzero(hit(start, min(n, start + step)))
        if len(found):
            return start + int(found[0])
        start, step = min(n, start + step), step * 2
    return n


def transfer(s0: int, q: np.ndarray, blocked: np.ndarray) -> Breaks:
    """Seats left after the requests for every possible start 0..s0.  Each request that any start can still
    serve lowers the most seats left, so at most ``s0`` of them are composed."""
    f, top, i = IDENTITY, s0, 0
    takes = ~blocked & (q > 0)
    while top > 0 and (i := _next(lambda a, b: takes[a:b] & (q[a:b] <= top), i, len(q))) < len(q):  # noqa: B023
        f = compose(f, (np.array([0, q[i]]), np.zeros(2, np.int64)), s0)
        top, i = int((f[1] + np.diff(np.append(f[0], s0 + 1))).max()) - 1, i + 1
    return f


def after(f: Breaks, start: int) -> int:
    """Seats left for ``start`` seats."""
    k = np.searchsorted(f[0], start, "right") - 1
    return int(f[1][k] + start - f[0][k])


def fold(rem: int, q: np.ndarray, blocked: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Seats before each request, whether it fits, and the seats left in the end."""
    n, i, step = len(q), 0, STEP
    takes = np.where(blocked, 0, q)
    before, ok = np.empty(n, np.int64), np.ones(n, bool)
    while i < n:
        j = min(n, i + step)
        left = rem - np.cumsum(takes[i:j]) + takes[i:j]
        refused = np.flatnonzero(q[i:j] > left)
        k = int(refused[0]) if len(refused) else j - i
        before[i : i + k] = left[:k]
        if k == j - i:
            rem, i, step = int(left[-1] - takes[j - 1]), j, step * 2
            continue
        rem, i, step = int(left[k]), i + k, STEP
        j = _next(lambda a, b: q[a:b] <= rem, i + 1, n)  # noqa: B023
        before[i:j], ok[i:j] = rem, False
        i = j
    return before, ok, rem


def _pack(f: Breaks) -> list[int]:
    return np.column_stack(f).ravel().tolist()


def _unpack(table) -> Breaks:
    t = np.asarray(table, np.int64).reshape(-1, 2)
    return (t[:, 0], t[:, 1]) if len(t) else IDENTITY


def _runs(keys: list) -> list[tuple[int, int]]:
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    return list(zip(cuts, cuts[1:], strict=False)) if keys else []


def _segment_starts(tables: DataFrame, key: str, ranges: int) -> DataFrame:
    """(key, _pid, _start) of each segment of ``tables`` (key, _seg, _s0, _table)."""
    key_field = tables.schema[key]

    def composed(t: pa.Table) -> pa.Table:
        rows = sorted(t.select(["_seg", "_s0", "_table"]).to_pylist(), key=lambda r: r["_seg"])
        s0 = next((r["_s0"] for r in rows if r["_s0"] is not None), None)
        f = IDENTITY
        for r in rows if s0 is not None else []:
            f = compose(f, _unpack(r["_table"]), s0)
        return pa.table([t.column(key).slice(0, 1), pa.array([rows[0]["_seg"] // FAN], pa.int64()), pa.array([s0], pa.int64()), pa.array([_pack(f)], pa.list_(pa.int64()))],
                        names=[key, "_seg", "_s0", "_table"])

    def started(t: pa.Table) -> pa.Table:
        rows = sorted(t.select(["_seg", "_s0", "_table", "_start"]).to_pylist(), key=lambda r: r["_seg"])
        now = rows[0]["_start"]
        if now is None:
            now = next((r["_s0"] for r in rows if r["_s0"] is not None), 0)
        starts = []
        for r in rows:
            starts.append(now)
            now = after(_unpack(r["_table"]), now) if now >= 0 else now
        return pa.table([pa.chunked_array([t.column(key).slice(0, 1).combine_chunks()] * len(rows)), pa.array([r["_seg"] for r in rows], pa.int64()), pa.array(starts, pa.int64())],
                        names=[key, "_seg", "_start"])

    table_schema = T.StructType([key_field, T.StructField("_seg", T.LongType()), T.StructField("_s0", T.LongType()), T.StructField("_table", T.ArrayType(T.LongType()))])
    start_schema = T.StructType([key_field, T.StructField("_seg", T.LongType()), T.StructField("_start", T.LongType())])
    levels = [tables]
    while ranges > FAN:
        levels[-1] = materialize(levels[-1])
        above = levels[-1].withColumn("_group", F.floor(F.col("_seg") / FAN)).groupBy(key, "_group").applyInArrow(composed, table_schema)
        levels.append(above)
        ranges = -(-ranges // FAN)
    starts = levels.pop().withColumn("_start", F.lit(None).cast("bigint")).groupBy(key).applyInArrow(started, start_schema)
    while levels:
        below = levels.pop().withColumn("_group", F.floor(F.col("_seg") / FAN))
        of_group = starts.select(key, F.col("_seg").alias("_group"), "_start")
        starts = below.join(of_group, [key, "_group"]).groupBy(key, "_group").applyInArrow(started, start_schema)
    return starts.select(F.col("_seg").cast("int").alias("_pid"), key, "_start")


def allocate_seats(df: DataFrame, key: str = "showing_id", order_cols=("arrived_at", "request_id"),
                   qty: str = "qty", seats: str = "seats0", blocked: str = "blocked",
                   eligible: str | None = None) -> DataFrame:
    """Add ``seats_before`` (seats left when the request is reached), ``seat_ok``
    (quantity fits) and ``accepted`` (fits and not blocked).  Rows whose
    ``eligible`` column is false pass through untouched (null seat columns,
    not accepted) and take no part in the fold.  Quantities are positive."""
    if eligible is None:
        df = df.withColumn("_elig", F.lit(True))
        eligible = "_elig"
    ranged = pinned_ranges(df, [key, *order_cols])
    columns = [f.name for f in ranged.schema.fields]

    def facts(batch: pa.RecordBatch, names: list[str]):
        """Keys, eligibility, quantities, blocked flags and initial seats of a batch."""
        c = {n: batch.column(i) for i, n in enumerate(names)}
        numbers = lambda n, null: c[n].cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)
        flags = lambda n: c[n].fill_null(False).to_numpy(zero_copy_only=False)
        return c[key].to_pylist(), flags(eligible), numbers(qty, 0), flags(blocked), numbers(seats, -1)

    narrow = ["_pid", key, qty, seats, blocked, eligible]

    def edge_tables(batches):
        out, now, first_done, pid = [], None, False, None

        def row():  # a segment: range, key, initial seats and function (none without an eligible row)
            if now[1] is None or now[1] < 0:
                return pid, now[0], now[1], []
            return pid, now[0], now[1], _pack(transfer(now[1], np.concatenate(now[2]), np.concatenate(now[3])))

        for batch in batches:
            if not batch.num_rows:
                continue
            pid = batch.column(0)[0].as_py()
            keys, el, q, b, s0 = facts(batch, narrow)
            for s, e in _runs(keys):
                if now is not None and now[0] != keys[s]:
                    if not first_done:
                        out.append(row())
                        first_done = True
                    now = None
                if now is None:
                    now = [keys[s], None, [], []]
                m = el[s:e]
                if m.any():
                    if now[1] is None:
                        now[1] = int(s0[s:e][m][0])
                    now[2].append(q[s:e][m])
                    now[3].append(b[s:e][m])
        if now is not None:
            out.append(row())
            pids, ks, s0s, tables = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ks, batch.schema.types[1]), pa.array(pids, pa.int64()), pa.array(s0s, pa.int64()), pa.array(tables, pa.list_(pa.int64()))], [key, "_seg", "_s0", "_table"])

    table_schema = T.StructType([ranged.schema[key], T.StructField("_seg", T.LongType()), T.StructField("_s0", T.LongType()), T.StructField("_table", T.ArrayType(T.LongType()))])
    tables = ranged.select(*narrow).mapInArrow(edge_tables, table_schema)
    starts = _segment_starts(tables, key, ranged.rdd.getNumPartitions())

    keep = [n for n in columns if n not in ("_pid", "_at")]
    out_schema = T.StructType([ranged.schema[n] for n in keep] + [
        T.StructField("seats_before", T.LongType()), T.StructField("seat_ok", T.BooleanType()), T.StructField("accepted", T.BooleanType())])

    def replay(batches):
        now, rem = object(), None
        for batch in batches:
            keys, el, q, b, s0 = facts(batch, keep)
            start = batch.column(len(keep)).to_pylist()
            before, ok = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
            for s, e in _runs(keys):
                if keys[s] != now:
                    now, rem = keys[s], None
                m = s + np.flatnonzero(el[s:e])
                if len(m):
                    if rem is None:
                        rem = int(s0[m[0]]) if start[m[0]] is None else start[m[0]]
                    before[m], ok[m], rem = fold(rem, q[m], b[m])
            none = ~el.astype(bool)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(before, mask=none), pa.array(ok, mask=none), pa.array(ok & ~b.astype(bool) & ~none)],
                                             [*keep, "seats_before", "seat_ok", "accepted"])

    # `starts` has at most two rows per range: a proven bound for the broadcast.
    # The broadcast join keeps the stream side's partitions; the local sort
    # restores arrival order inside each range without a shuffle.
    joined = ranged.join(F.broadcast(starts), ["_pid", key], "left").sortWithinPartitions("_at")
    return joined.select(*keep, "_start").mapInArrow(replay, out_schema)
