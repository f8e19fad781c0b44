"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within and between cells.

Equal vectors are one class from here on.  Centroids are fitted on a bounded sample; the nearest one is a class's home,
and classes of one home are compared there, in blocks of BLOCK x BLOCK by matrix products in double precision.  A class
also visits every later cell that could hold a vector linked with it, and is compared with those at home there, so that
each pair of the table meets once or is ruled out.  A block yields each vector's count of links and links that span what
it connects, never all pairs; components of the links give the groups, whose smallest vec_id is kept.

Two bounds rule a cell out for a vector, both exact.  Its members are within the cell's radius of its centre: by the
triangle inequality, a vector farther from the centre than radius and link angle together links with none.  And its
members are nearer to its centre than to the vector's own: a vector farther than the link angle from the plane midway
links with none.  Centroids thus decide the work, never the result: clustered vectors visit few cells, vectors without
any structure visit up to all of them (every pair is then multiplied).  Centroids nearer than CENTRE_GAP to one another
are merged, so that a large group of copies cannot fill the cells of its own with one cell each.  Cells may be of any
size: a large one only has more blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
vectors of different lengths; repeated rows are vectors of their own that link; a null vec_id is judged alone
(component_id null, kept true); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import pick, pin
from marquee.llm.components import components

THRESHOLD = 0.9
#: Vectors of a block (a vector is dealt to as many blocks as it must meet, so large blocks are few copies), and of a tile of it.
BLOCK, TILE = 8_192, 1_024
#: What is added to an angle or a distance before a bound is trusted.
SLACK = 1e-6
#: Vectors that centroids are fitted on (those of the smallest hash), and the most centroids.
MAX_SAMPLE, MAX_CELLS = 20_000, 4_096
PER_CELL, ROUNDS, CENTRE_GAP = 8_192, 8, 0.8
#: Vectors that are compared with all centres at a time.
AT_ONCE = 512


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither very large nor very small numbers lose their norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means on unit vectors; at most ``cells`` centroids, none near another."""
    c = sample[np.random.default_rng(0).permutation(len(sample))[:cells]]
    for _ in range(ROUNDS):
        home = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, home, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    kept: list[int] = []
    for i in range(len(c)):
        if not kept or (c[kept] @ c[i]).max() < CENTRE_GAP:
            kept.append(i)
    return c[kept]


def valid(v):
    """Not null, no null or non-finite component, not all zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.coalesce(F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False))


def placed(classes: DataFrame, threshold: float) -> DataFrame:
    """class, rep, weight, v, home and cells (home and those visited); lengths other than the usual one have a single cell."""
    usual = classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    d, n = (usual["d"], usual["n"]) if usual else (0, 0)
    got = classes.where(F.size("v") == d).orderBy(F.xxhash64("v"), "class").limit(MAX_SAMPLE).select("v").toArrow().column("v")
    sample = unit(got.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)) if n else np.zeros((0, 1))
    centres = centroids(sample, int(min(MAX_CELLS, max(1, n // PER_CELL)))) if n else sample

    def products(v):
        """Places of the vectors of the usual length, and their products with all centres, AT_ONCE at a time."""
        at = np.flatnonzero(np.diff(v.offsets.to_numpy()) == d)
        for k in range(0, len(at), AT_ONCE):
            part = at[k : k + AT_ONCE]
            yield part, unit(v.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)) @ centres.T

    def settle(batches):
        for batch in batches:
            home, angle = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for part, x in products(batch.column(3)):
                home[part] = x.argmax(axis=1)
                angle[part] = np.arccos(np.clip(x.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(home), pa.array(angle)], ["class", "rep", "weight", "v", "home", "angle"])

    kind = f"class long, rep long, weight long, v array<{classes.schema['v'].dataType.elementType.simpleString()}>, home int"
    settled = pin(classes.select("class", "rep", "weight", "v").mapInArrow(settle, f"{kind}, angle double"), "homes")
    radius = np.full(len(centres), -np.inf)  # a cell that is nobody's home is not visited
    for r in settled.where(F.size("v") == d).groupBy("home").agg(F.max("angle").alias("angle")).collect():  # MAX_CELLS rows
        radius[r["home"]] = r["angle"]
    link = np.arccos(np.clip(threshold, -1, 1))
    farthest = radius + link + SLACK
    least = np.where(farthest < 0, np.inf, np.where(farthest < np.pi, np.cos(np.clip(farthest, 0, np.pi)), -np.inf))
    reach = np.sin(link) if link < np.pi / 2 else np.inf

    def visit(batches):
        number = np.arange(len(centres))
        for batch in batches:
            home = batch.column(4).to_numpy()
            cells = [[h] for h in home.tolist()]
            for part, x in products(batch.column(3)):
                own = home[part]
                apart = np.sqrt(np.maximum(0, 2 - 2 * centres[own] @ centres.T))
                may = (number[None, :] > own[:, None]) & (x >= least[None, :] - SLACK)
                may &= x[np.arange(len(own)), own][:, None] - x <= reach * apart + SLACK
                for i, row in zip(part.tolist(), may, strict=True):
                    cells[i] += np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(cells, pa.list_(pa.int32()))], ["class", "rep", "weight", "v", "home", "cells"])

    return settled.drop("angle").mapInArrow(visit, f"{kind}, cells array<int>")


def block_links(group: pa.Table, threshold: float) -> pa.Table:
    """Links between the two blocks (or within the one) of a group: class, links (weighted count), or a, b (a spanning link).

    Blocks are multiplied a tile at a time, so that memory does not grow with the square of a block."""
    i, j = (group.column(c)[0].as_py() for c in ("i", "j"))
    mine = group.column("block").to_numpy()
    d = group.column("d")[0].as_py()
    v = unit(group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
    ids, rep, weight = (group.column(c).to_numpy() for c in ("class", "rep", "weight"))
    left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    count, label, spans = np.zeros(len(ids)), np.arange(len(ids)), []
    for p in range(0, len(left), TILE):
        for q in range(p if i == j else 0, len(right), TILE):
            x, y = left[p : p + TILE], right[q : q + TILE]
            near = v[x] @ v[y].T >= threshold
            if i == j and p == q:
                near = np.triu(near, 1)
            rows = np.flatnonzero(near.any(axis=1))
            if not len(rows):
                continue
            count[x] += near @ weight[y]
            count[y] += weight[x] @ near
            for k in rows.tolist():
                met = y[near[k]]
                of = label[met]
                for other in np.unique(of[of != label[x[k]]]).tolist():
                    spans.append((int(rep[x[k]]), int(rep[met[of == other][0]])))
                    label[label == other] = label[x[k]]
    some = np.flatnonzero(count)
    none = [None] * len(spans)
    return pa.table({"class": pa.array([*ids[some].tolist(), *none], pa.int64()), "links": pa.array([*count[some].astype(np.int64).tolist(), *none], pa.int64()),
                     "a": pa.array([*[None] * len(some), *(s for s, _ in spans)], pa.int64()), "b": pa.array([*[None] * len(some), *(t for _, t in spans)], pa.int64())})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``vectors`` (vec_id, embedding)."""
    rows = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    rows = pin(rows.withColumn("ok", valid(F.col("v")) & F.col("vec_id").isNotNull()), "vectors")
    good = rows.where("ok")
    classes = good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = pin(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    cells = pin(placed(classes, threshold).withColumn("d", F.size("v")), "cells")
    posted = cells.withColumn("cell", F.explode("cells")).withColumn("here", F.col("cell") == F.col("home"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = pin(posted.groupBy("d", "cell").agg(blocks(F.count_if("here")).alias("own"), blocks(F.count_if(~F.col("here"))).alias("visiting")), "sizes")  # MAX_CELLS rows a length
    posted = posted.join(sizes, ["d", "cell"])
    # Blocks of those at home come first and meet all blocks; visitors' blocks meet those of home only.
    mine = F.pmod(F.xxhash64("class"), F.when(F.col("here"), F.col("own")).otherwise(F.col("visiting"))).cast("int")
    posted = posted.withColumn("block", F.when(F.col("here"), mine).otherwise(F.col("own") + mine))
    met = F.col("own") + F.when(F.col("here"), F.col("visiting")).otherwise(0)
    dealt = posted.withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
    dealt = dealt.select("d", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", "rep", "weight", "v")
    found = pin(dealt.groupBy("d", "cell", "i", "j").applyInArrow(lambda t: block_links(t, threshold), "class long, links long, a long, b long"), "links")
    counts = pin(found.where("links is not null").groupBy("class").agg(F.sum("links").alias("links")), "counts")
    merged = components(_with_shared_ids(found.where("a is not null").select("a", "b"), good, classes))
    # Several classes may have one rep (a repeated vec_id): a class's component is its rep's.
    of = classes.select("v", "class", "rep", "weight").join(counts, "class", "left")
    of = pin(of.join(merged.withColumnRenamed("id", "rep"), "rep", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "results")
    out = rows.where("ok").join(of, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _with_shared_ids(links: DataFrame, good: DataFrame, classes: DataFrame) -> DataFrame:
    """``links`` and, for each vec_id that stands in several classes, links between their reps."""
    twice = pin(good.select("vec_id", F.xxhash64("v").alias("h")).groupBy("vec_id").agg(F.count_distinct("h").alias("n")).where("n > 1").select("vec_id"), "twice")
    if twice.isEmpty():
        return links
    in_class = good.join(twice, "vec_id").join(classes.select("v", "rep"), "v")
    return links.unionAll(in_class.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
