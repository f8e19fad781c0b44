"""MinHash near-duplicates by a signature-coordinate inverted join.

Every document's set of 3-word shingles gives COORDINATES minimum hashes.  Documents with equal sets are one class
from here on.  A class is posted under each (coordinate, value) pair that others share; a link of the wanted
similarity needs a number of equal coordinates that follows from the similarity (``matches_at``: a pair at the threshold
itself has fewer with a chance of at most MISS; below a similarity of about 0.2 not even one is that sure), so two linked
classes share one of the COORDINATES - matches + 1 rarest pairs of each: only this prefix is posted.

First merging: in each posting all are paired with the smallest class, its head; pairs whose signatures collide in
that many coordinates are confirmed on full sets; the links give components.  Then skip merging: classes that shared a
posting met the same head, so a head's members that are not in its component are compared with all its members of a
size that can be similar, in blocks of BLOCK x BLOCK classes by products of their shingle incidence.  What is in one component already is not
compared again.  Blocks yield links that span what they connect, never all pairs.

Defined results: null or blank texts have no shingles and link with nothing (each row its own component); rows that
repeat a doc_id are one node; rows with a null doc_id are judged alone (component_id null, kept true); an empty table
gives an empty result; other columns are ignored by ``near_duplicates`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import batch_rows, keeping_columns, pick, pin, releasing, worker_store
from marquee.llm.components import components

COORDINATES, MISS = 48, 5e-5
SHINGLE, PERCENT = 3, 85
#: Classes of a block, and shingles of all of them (8 bytes each): long texts are compared in smaller blocks.
BLOCK, BLOCK_SHINGLES = 64, 1 << 20
#: A band of sizes spans so many times the ratio that two similar sets' sizes have at most.
BAND = 3
#: Tables of ids up to this many rows (16 bytes each) are broadcast.
BROADCAST_IDS = 1 << 20
KEPT_WORDS = 1 << 17
#: Rows that a Python worker gets at a time.
ROWS = 1_000
SEED = 20_240_607


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    import xxhash

    known = worker_store("word_hashes")
    words = text.lower().split()
    got = [known.get(w) for w in words]
    if None in got:
        if len(known) > KEPT_WORDS:
            known.clear()
        for i, x in enumerate(got):
            if x is None:
                got[i] = known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    h = np.array(got, np.uint64)
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h[:width]), np.uint64)  # a short text's sequence is not a longer text's shingle
    for i in range(min(width, len(h))):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A number for each (coordinate, minimum hash) pair."""
    least = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1 << 14):
        x = hashes[None, i : i + (1 << 14)] * seeds[:, None]
        x ^= x >> np.uint64(32)
        least = np.minimum(least, (x * seeds[::-1, None]).min(axis=1))
    return (least >> np.uint64(7)).astype(np.int64) * len(seeds) + np.arange(len(seeds))


def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)


def signed(docs: DataFrame, width: int = SHINGLE, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, text_hash, n_shingles, key (of the whole set), pairs (the signature) of each row of ``docs`` (doc_id, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seeds = _seeds(coordinates)
        for batch in batches:
            sizes, keys, pairs = [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py() or b"", width)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                pairs.append(signature(s, seeds) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(pairs, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_shingles", "key", "pairs"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(releasing(sign), "doc_id long, text_hash long, n_shingles long, key binary, pairs array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """class, hashes (binary): the full set of each class in ``wanted`` (class, rep, text_hash, key), from a row of its rep."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, out = [], []
            for number, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = shingles(text.as_py() or b"", width).tobytes()
                if xxhash.xxh3_128_digest(s) == key:
                    ids.append(number)
                    out.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["class", "hashes"])

    small = F.broadcast if wanted.count() <= BROADCAST_IDS else (lambda x: x)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_hash"))
    sets = pin(rows.join(small(wanted), ["rep", "text_hash"]).select("class", "key", "text").mapInArrow(releasing(load), "class long, hashes binary"), "full_sets")
    return sets if sets.select("class").distinct().count() == sets.count() else pin(sets.dropDuplicates(["class"]), "full_sets")


def matches_at(percent: int, coordinates: int = COORDINATES) -> int:
    """The most equal coordinates that a pair at the threshold has but for a chance of MISS (binomial); one at least."""
    p, below = percent / 100, 0.0
    for m in range(coordinates):
        below += math.comb(coordinates, m) * p**m * (1 - p) ** (coordinates - m)  # the chance of m or fewer
        if below > MISS:
            return max(1, m)
    return coordinates


def similar(inter, a, b, percent: int):
    return 100 * inter >= percent * (a + b - inter)


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose class is among ``ids`` (class): what a join does not need is not shuffled for it."""
    ids = pin(ids.distinct(), "ids")
    small = F.broadcast if ids.count() <= BROADCAST_IDS else (lambda x: x)
    return rows.join(small(ids), "class", "left_semi")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose full sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], ["a", "b"])

    with_b = pin(pairs.join(only(sets, pairs.select(F.col("b").alias("class"))).select(F.col("class").alias("b"), F.col("hashes").alias("y")), "b"), "pair_sets")
    both = with_b.join(only(sets, pairs.select(F.col("a").alias("class"))).select(F.col("class").alias("a"), F.col("hashes").alias("x")), "a").select("a", "b", "x", "y")
    return both.mapInArrow(releasing(check), "a long, b long")


def _incidence(columns: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), len(columns)), np.float32)
    for row, s in zip(out, sets, strict=True):
        s = s[np.searchsorted(s, columns[0]) : np.searchsorted(s, columns[-1], side="right")]
        at = np.searchsorted(columns, s)
        row[at[columns[at] == s]] = 1
    return out


def spanning_links(ids: np.ndarray, sets: list[np.ndarray], other_ids: np.ndarray, other_sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between two blocks of classes, as few as connect the same."""
    columns = np.intersect1d(np.unique(np.concatenate(sets)), np.unique(np.concatenate(other_sets)), assume_unique=True)
    inter = np.zeros((len(sets), len(other_sets)), np.float32)
    for i in range(0, len(columns), 1 << 15):
        part = columns[i : i + (1 << 15)]
        inter += _incidence(part, sets) @ _incidence(part, other_sets).T
    n, m = (np.array([len(s) for s in side], np.float64) for side in (sets, other_sets))
    linked = similar(inter.astype(np.float64), n[:, None], m[None, :], percent) & (ids[:, None] != other_ids[None, :])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = int(ids[i]), int(other_ids[j])
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def by_size(members: DataFrame, percent: int) -> DataFrame:
    """head, band, class, asks, n_shingles: the members (head, class, apart, n_shingles) of each head by bands of sizes.

    A class that is apart asks in the band of its own size; every class is told in each band that a similar set's size can
    be in, if one of those that ask there has such a size.  Bands without two classes go."""
    width = max(BAND * math.log(100 / percent), 0.01)
    band = lambda size, more=0.0: F.floor(F.log(size) / width + more).cast("int")
    n = F.col("n_shingles")
    told = members.withColumn("band", F.explode(F.sequence(band(n * percent / 100, -1e-6), band(n * 100 / percent, 1e-6))))
    told = pin(told.select("head", "band", "class", (F.col("apart") & (F.col("band") == band(n))).alias("asks"), "n_shingles"), "told")
    sizes = F.when(F.col("asks"), n)
    asked = told.groupBy("head", "band").agg(F.min(sizes).alias("least"), F.max(sizes).alias("most"), F.count("*").alias("n")).where("least is not null and n > 1")
    fits = (n * 100 >= F.col("least") * percent) & (n * percent <= F.col("most") * 100)
    return told.join(pin(asked, "asked").drop("n"), ["head", "band"]).where(fits).drop("least", "most")


def block_rows(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """head, band, i, j, class, hashes, asks, told: what block (i, j) of those that ask and of all in a band compares, once each."""
    key = ["head", "band"]
    blocks = lambda some: F.ceil(F.greatest(F.count_if(some) / BLOCK, F.sum(F.when(some, F.col("n_shingles")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    banded = pin(by_size(members, percent), "banded")
    sizes = pin(banded.groupBy(key).agg(blocks(F.lit(True)).alias("n_all"), blocks(F.col("asks")).alias("n_apart"), F.count("*").alias("n")).where("n > 1").drop("n"), "head_sizes")
    m = pin(banded.join(sizes, key), "members").withColumns({"in_all": F.pmod(F.xxhash64("class"), F.col("n_all")), "in_apart": F.pmod(F.xxhash64("class", F.lit(1)), F.col("n_apart"))})
    m = m.join(only(sets, banded.select("class")), "class")
    asked = m.where("asks").select(*key, F.col("in_apart").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("j"), "in_all", "class", "hashes", F.lit(True).alias("asks"), F.lit(False).alias("told"))
    told = m.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_apart") - 1))).select(*key, "i", F.col("in_all").cast("int").alias("j"), "class", "hashes", (F.col("asks") & (F.col("i") == F.col("in_apart"))).alias("asks"), F.lit(True).alias("told"))
    return asked.where("j <> in_all").drop("in_all").unionByName(told)


def blocked_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the members (head, class, apart, n_shingles) that are apart from their head's component with all members of the head."""

    def compare(group: pa.Table) -> pa.Table:
        asks, told = (group.column(c).to_numpy() for c in ("asks", "told"))
        number, sets_ = group.column("class").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("hashes")]
        parts = [([number[k] for k in at], [sets_[k] for k in at]) for at in (np.flatnonzero(asks), np.flatnonzero(told))]
        links = spanning_links(np.array(parts[0][0]), parts[0][1], np.array(parts[1][0]), parts[1][1], percent) if parts[0][0] and parts[1][0] else []
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return block_rows(members, sets, percent).groupBy("head", "band", "i", "j").applyInArrow(compare, "a long, b long")


def links(docs: DataFrame, classes: DataFrame, percent: int = PERCENT, width: int = SHINGLE, coordinates: int = COORDINATES) -> DataFrame:
    """a, b: links between ``classes`` (class, rep, text_hash, key, pairs, n_shingles) that connect all that similar sets connect."""
    matches = matches_at(percent, coordinates)
    posted = pin(classes.select("class", F.explode("pairs").alias("pair")), "posted")
    shared = pin(posted.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    common = posted.join(shared, "pair").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("n", "pair"))).alias("common"))  # COORDINATES at most
    # The rarest pairs come first; those of one document only are before all others and need no posting.
    room = F.lit(coordinates - matches + 1 - coordinates) + F.size("common")
    prefix = pin(common.where(room > 0).select("class", F.explode(F.slice("common", F.lit(1), room)).alias("x")).select("class", F.col("x.pair").alias("pair")), "prefix")
    heads = pin(prefix.groupBy("pair").agg(F.min("class").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n"), "heads")
    members = pin(prefix.join(heads, "pair").select("head", "class").distinct(), "met")
    signatures = only(classes.select("class", "pairs"), members.select("class"))
    pairs = members.where("head <> class").join(signatures, "class").withColumnRenamed("pairs", "mine")
    pairs = pin(pairs, "pairs").join(signatures.select(F.col("class").alias("head"), "pairs"), "head")
    close = pin(pairs.where(F.size(F.array_intersect("mine", "pairs")) >= matches).select(F.col("head").alias("a"), F.col("class").alias("b")), "close")
    wanted = members.select("class").distinct().join(classes.select("class", "rep", "text_hash", "key"), "class")
    sets = full_sets(docs, pin(wanted, "wanted"), width)
    first = pin(confirmed(close, sets, percent), "first_links")
    found = pin(components(first), "first_components")
    of = lambda c, name: found.select(F.col("id").alias(c), F.col("component").alias(name))
    m = pin(members.join(of("class", "mine"), "class", "left"), "members").join(of("head", "heads"), "head", "left")
    # Heads in one component are one head from here on.
    m = m.select(F.coalesce("heads", "head").alias("head"), "class", (F.coalesce("mine", "class") != F.coalesce("heads", "head")).alias("apart"))
    m = pin(m.distinct(), "members")
    open_heads = pin(m.groupBy("head").agg(F.count_if("apart").alias("n")).where("n > 0").select("head"), "open_heads")
    open_members = m.join(open_heads, "head").join(classes.select("class", "n_shingles"), "class")
    second = blocked_links(pin(open_members, "open_members"), sets, percent)
    return first.unionAll(pin(second, "second_links"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    with batch_rows(docs.sparkSession, ROWS):  # every job with Python runs in here
        return _near_duplicates(docs, percent, width)


def _near_duplicates(docs: DataFrame, percent: int, width: int) -> DataFrame:
    rows = pin(signed(docs, width), "signed")
    sets = rows.where("n_shingles > 0 and doc_id is not null")
    # Classes have numbers of their own: a doc_id that repeats with different texts is in several.
    classes = sets.groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("pairs").alias("pairs"), F.first("n_shingles").alias("n_shingles"))
    classes = classes.select("key", F.col("first.doc_id").alias("rep"), "first.text_hash", "pairs", "n_shingles")
    classes = pin(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    found = links(docs, classes, percent, width)
    twice = pin(sets.groupBy("doc_id").agg(F.count_distinct("key").alias("n")).where("n > 1").select("doc_id"), "twice")
    if not twice.isEmpty():  # such an id links its classes
        of_id = pin(sets.join(twice, "doc_id").select("doc_id", "key").distinct().join(classes.select("key", "class"), "key").select("doc_id", "class"), "classes_of_id")
        found = found.unionAll(of_id.join(of_id.groupBy("doc_id").agg(F.min("class").alias("a")), "doc_id").select("a", F.col("class").alias("b")).where("a <> b"))
    merged = pin(components(found), "components")
    of_class = classes.select("key", "class", "rep").join(merged.withColumnRenamed("id", "class"), "class", "left").select("key", "rep", F.coalesce("component", "class").alias("group"))
    of_class = pin(of_class, "groups")
    least = pin(of_class.groupBy("group").agg(F.min("rep").alias("component")), "least")
    by_key = pin(of_class.join(least, "group").select("key", "component"), "class_components")
    out = rows.join(by_key, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def deduplicated(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` with all their columns, one document (all rows of its doc_id) of each group."""
    near = near_duplicates(docs, percent, width)
    gone = pin(near.where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    small = F.broadcast if gone.count() <= BROADCAST_IDS else (lambda x: x)
    return keeping_columns(docs, ("doc_id",), lambda d: d.join(small(gone), F.col("doc_id") == F.col("_gone"), "left_anti"))
