"""Embedding whitening: spectral divide and conquer of the covariance, components broadcast to all rows.

Spark makes each vector integers (x = floor(64 c) + 1,000,000), keeps every different one once (the fit list) and adds up
their sums and, centred on the rounded mean, their products: each task one small matrix, added in Spark as exact
decimals, so that the covariance is the exactly rounded one whatever the number of tasks.  The driver holds that matrix
alone; ``qdwh`` splits it into components.  A last pass over the fit list measures how far the whitened vectors'
covariance is from the identity, and all rows are projected in tasks with the components sent along.

Defined results: vectors that are null or hold null or non-finite entries are left out; repeated rows and null vec_ids
give their rows each; vectors of different lengths are whitened apart, each length with its own fit list; an empty vector
has no component; components whose eigenvalue is zero within rounding are not returned (fewer than 16 then, none for a
fit list of one vector); entries beyond 2**34 count as 2**34 in size; a deviation too large for a long is null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import pick, pin
from marquee.llm.qdwh import EPS, leading_eigenvectors

SCALE, SHIFT, LARGEST = 64, 1_000_000, 2**40
COMPONENTS = 16
#: Vectors that a task holds as numbers at a time.
AT_ONCE = 2_048
EXACT = 2**53


def integers(v):
    """x of a vector column; null where the vector is null or holds null or non-finite entries."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(float(-LARGEST))), F.lit(float(LARGEST)))).cast("long") + SHIFT
    return F.when(F.coalesce(F.forall(v, fine), F.lit(False)), F.transform(v, whole))


def blocks(column: pa.Array):
    """Places and matrix of the vectors of each length, AT_ONCE at a time."""
    length = np.diff(column.offsets.to_numpy())
    for d in np.unique(length[length > 0]).tolist():
        at = np.flatnonzero(length == d)
        for k in range(0, len(at), AT_ONCE):
            part = at[k : k + AT_ONCE]
            yield part, column.take(pa.array(part)).flatten().to_numpy().reshape(-1, d)


def products(y: np.ndarray) -> np.ndarray:
    """The exact y'y of integers: in floating point where no sum can be rounded, else in Python's integers."""
    top = int(np.abs(y).max(initial=0))
    if top * top * len(y) < EXACT:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    big = y.astype(object)
    return big.T @ big


def sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length of vector: how many, and their sums per dimension."""

    def of(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in blocks(batch.column(0)):
                d = x.shape[1]
                total[d] = total.get(d, 0) + np.array([len(x), *x.sum(axis=0).tolist()], object)
        for d, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 1), pa.int32()), pa.array(range(d + 1), pa.int32()), _decimals(s)], ["d", "i", "s"])

    got = fit.mapInArrow(of, "d int, i int, s decimal(38,0)").groupBy("d", "i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()  # length + 1 rows
    out: dict[int, list[int]] = {}
    for r in sorted(got, key=lambda r: (r["d"], r["i"])):
        out.setdefault(r["d"], []).append(int(r["s"]))
    return {d: (s[0], s[1:]) for d, s in out.items()}


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def covariances(fit: DataFrame, totals: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """The covariance (divisor n) of each length's vectors: exact integer sums of centred products, rounded once."""
    centre = {d: [round(s / n) for s in t] for d, (n, t) in totals.items()}

    def of(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in blocks(batch.column(0)):
                d = x.shape[1]
                total[d] = total.get(d, 0) + products(x - np.array(centre[d], np.int64))
        for d, g in total.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(i), pa.int32()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), _decimals(g[i, j])], ["d", "i", "j", "g"])

    got = fit.mapInArrow(of, "d int, i int, j int, g decimal(38,0)").groupBy("d", "i", "j").agg(F.sum("g").cast("decimal(38,0)").alias("g")).collect()  # one matrix
    out = {d: np.zeros((d, d)) for d in totals}
    rest = {d: [s - n * c for s, c in zip(t, centre[d], strict=True)] for d, (n, t) in totals.items()}
    for r in got:
        d, i, j = r["d"], r["i"], r["j"]
        n = totals[d][0]
        out[d][i, j] = out[d][j, i] = (n * int(r["g"]) - rest[d][i] * rest[d][j]) / (n * n)
    return out


class Whitener:
    """Components of one length of vector, and what its rows share.  Sent to tasks as plain arrays (``parts``)."""

    def __init__(self, n: int, total: list[int], covariance: np.ndarray):
        values, vectors = leading_eigenvectors(covariance, min(COMPONENTS, len(total)))
        trace = float(np.trace(covariance))
        some = values > len(total) * EPS * trace
        self.values, self.vectors = values[some], vectors[:, some]
        self.explained = self.values / trace if trace else self.values
        self.n, self.total = n, total

    def parts(self) -> tuple:
        centre = [round(s / self.n) for s in self.total]
        off = [(s - self.n * c) / self.n for s, c in zip(self.total, centre, strict=True)]  # the mean's distance to the centre
        return np.array(centre, np.int64), np.array(off), self.vectors / np.sqrt(self.values), self.explained, self.n, self.total


def whitened(x: np.ndarray, parts: tuple) -> np.ndarray:
    centre, off, weight = parts[:3]
    return ((x - centre).astype(np.float64) - off) @ weight


def deviations(x: np.ndarray, n: int, total: list[int]) -> pa.Array:
    """The exact sum of (n x - S)^2 of each vector, from numbers near zero; null where a long cannot hold it."""
    near = [round(s / n) for s in total]
    rest = [s - n * c for s, c in zip(total, near, strict=True)]
    y = x - np.array(near, np.int64)
    top = int(np.abs(y).max(initial=0)) * n + max(abs(r) for r in rest)
    if top * top * x.shape[1] < 2**63:
        return pa.array(((n * y - np.array(rest, np.int64)) ** 2).sum(axis=1))
    exact = ((n * y.astype(object) - np.array(rest, object)) ** 2).sum(axis=1)
    return pa.array([v if v < 2**63 else None for v in exact.tolist()], pa.int64())


def identity_errors(fit: DataFrame, parts: dict[int, tuple]) -> dict[int, float]:
    """For each length: the largest absolute entry of the covariance of the whitened fit list minus the identity."""

    def of(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in blocks(batch.column(0)):
                d = x.shape[1]
                z = whitened(x, parts[d])
                z = np.hstack([np.ones((len(z), 1)), z])
                total[d] = total.get(d, 0) + z.T @ z
        for d, g in total.items():
            i, j = np.triu_indices(len(g))
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(i), pa.int32()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(g[i, j])], ["d", "i", "j", "g"])

    got = fit.mapInArrow(of, "d int, i int, j int, g double").groupBy("d", "i", "j").agg(F.sum("g").alias("g")).collect()  # one matrix of 17 x 17
    out = {}
    for d, p in parts.items():
        k = p[2].shape[1]
        g = np.zeros((k + 1, k + 1))
        for r in got:
            if r["d"] == d:
                g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["g"]
        mean = g[0, 1:] / p[4]
        out[d] = float(np.abs(g[1:, 1:] / p[4] - np.outer(mean, mean) - np.eye(k)).max(initial=0))
    return out


def fitted(fit: DataFrame) -> dict[int, Whitener]:
    """The components of each length of vector in ``fit`` (x: different integer vectors)."""
    totals = sums(fit)
    return {d: Whitener(*totals[d], v) for d, v in covariances(fit, totals).items()}


def whiten(vectors: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each valid vector and component."""
    rows = pick(vectors, "vec_id", "embedding").select("vec_id", integers(F.col("embedding")).alias("x")).where("x is not null")
    fit = pin(rows.select("x").distinct(), "fit")
    parts = {d: w.parts() for d, w in fitted(fit).items()}
    error = identity_errors(fit, parts)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def project(batches):
        for batch in batches:
            for at, x in blocks(batch.column(1)):
                p = parts[x.shape[1]]
                z, k = whitened(x, p), p[2].shape[1]
                if not k:
                    continue
                each = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, p[4])),
                    deviations(x, p[4], p[5]).take(each), pa.array(z.ravel()), pa.array(np.tile(p[3], len(x))), pa.array(np.full(len(x) * k, error[x.shape[1]]))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
