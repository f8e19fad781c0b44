"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Each document d of source s gets a rate r_d >= 0 that is as near as possible, in relative entropy,
to 1 under the token constraint  sum r_d * size_d = target_s  and the bound r_d <= ``cap``.  The dual
has one multiplier per source; its solution is an exponentially tilted rate

    r_d = min(cap, exp(lambda_s * size_d / mean_size_s)).

All multipliers are found together by safeguarded Newton iterations, each one aggregation over the
distributed (source, size) histogram.  Rates are then rounded into whole copies: every document gets
floor(r) copies, and one more when its fixed hash number lies enough below the fraction; the cut per
source is found by refining a histogram, so that the words taken meet the target to about one document.

Defined results: null or empty text has size 0 and takes 0; a null source is a source of its own and
comes last; a source of size 0 has target 0; rows of equal source, doc_id and size are numbered among
themselves and drawn by id and number, each for itself, so that they meet their target too (which of
them stands for which number does not matter to the result where they are the same); a problem that Newton
steps do not solve is an error; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm.common import WORD, keeping_columns, pick, pin

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Tables by source up to this many rows are broadcast (about 100 bytes each); larger ones are joined by shuffle.
BROADCAST_SOURCES = 20_000
TOLERANCE = 1e-7
MAX_STEPS = 60
BINS, ROUNDS = 256, 3


def ranked_sources(docs: DataFrame) -> DataFrame:
    """source, source_size, n_docs, position: 0, 1, ... by code point, null last.

    Sorted by range partitions; a partition's first position is the count of rows before it, so that
    no task holds all sources."""
    by = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    placed = pin(by.sort(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    placed = placed.withColumn("part", F.shiftright("at", 33)).withColumn("within", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(before), "part").select("source", "source_size", "n_docs", (F.col("first") + F.col("within")).alias("position"))


def with_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds target: ``share`` of all words by weight; a source stops at ``cap`` times its size and what
    it cannot take goes to the others by weight, until none is above."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("position") % len(weights) + 1).cast("int"))
    s = pin(sources.withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size")), "weighted")
    total = s.agg((share * F.sum("source_size")).alias("t"), F.sum("weight").alias("w")).first()
    level = (total["t"] or 0.0) / (total["w"] or 1.0)
    while True:  # each round fixes one source more at least
        full = F.col("most") <= F.lit(level) * F.col("weight")
        r = s.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("most"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        new = (total["t"] - r["most"]) / r["w"] if r["w"] else level
        if not r["w"] or new <= level * (1 + 1e-12):
            break
        level = new
    return s.withColumn("target", F.least(F.col("most"), F.lit(level) * F.col("weight")))


def _rate() -> Column:
    z = F.col("size") / F.col("mean")
    tilted = F.least(F.col("cap"), F.exp(F.least(F.col("lam") * z, F.lit(700.0))))
    return F.when(F.col("size") == 0, 0.0).when(F.col("target") >= F.col("most"), F.col("cap")).when(F.col("target") <= 0, 0.0).otherwise(tilted)


def multipliers(docs: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """Adds lam, the multiplier of each source, to ``sources``."""
    hint = F.broadcast if small else (lambda x: x)
    hist = pin(docs.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    mean = F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9))
    state = sources.withColumns({"mean": mean, "lam": F.lit(0.0), "lo": F.lit(-1e7), "hi": F.lit(1e7)})
    keep = state.columns
    for _ in range(MAX_STEPS):
        x = hist.join(hint(state.withColumnRenamed("source", "key")), F.col("source").eqNullSafe(F.col("key")), "inner")
        rate, words = _rate(), F.col("n") * F.col("size")
        slope = F.when(rate < F.col("cap"), words * rate * F.col("size") / F.col("mean")).otherwise(0.0)
        got = x.groupBy("source").agg(F.sum(words * rate).alias("got"), F.sum(slope).alias("slope")).withColumnRenamed("source", "key")
        y = state.join(hint(got), F.col("source").eqNullSafe(F.col("key")), "left")
        off = F.when((F.col("target") <= 0) | (F.col("target") >= F.col("most")), 0.0).otherwise(F.coalesce("got", F.lit(0.0)) - F.col("target"))
        y = y.withColumn("off", off).withColumns({"lo": F.when(F.col("off") < 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("off") > 0, F.col("lam")).otherwise(F.col("hi"))})
        step = F.col("lam") - F.col("off") / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        y = y.withColumn("next", F.when(F.col("off") == 0, F.col("lam")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2))
        y = pin(y.withColumn("error", F.abs("off") / F.greatest(F.col("target"), F.lit(1.0))), "newton")
        if (y.agg(F.max("error")).first()[0] or 0.0) <= TOLERANCE:
            # Sums of doubles depend on their order in the last digits; without these, reruns agree.
            return y.select(*keep).withColumn("lam", F.round("lam", 10))
        state = y.withColumn("lam", F.col("next")).select(*keep)
    raise RuntimeError(f"the multipliers have not been found in {MAX_STEPS} steps")


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _drawn(rows: DataFrame) -> DataFrame:
    """Adds rate, whole (copies in any case) and rank: a document's number in [0, 1), fixed by its id (and its number among
    equal ones), less the rate's fraction."""
    drawn = F.when(F.col("tie") == 0, F.xxhash64("doc_id", "size")).otherwise(F.xxhash64("doc_id", "size", "tie"))
    number = F.pmod(drawn, F.lit(1 << 52)) / F.lit(float(1 << 52))
    rows = rows.withColumn("rate", _rate()).withColumn("whole", F.floor("rate").cast("long"))
    return rows.withColumn("rank", number - (F.col("rate") - F.col("whole")))


SAME = ("source", "doc_id", "size")


def ties(base: DataFrame) -> DataFrame | None:
    """The (source, doc_id, size) that several rows of ``base`` have; None if there are none."""
    found = pin(base.groupBy(*SAME).agg(F.count("*").alias("n")).where("n > 1").select(*(F.col(c).alias(f"_tied_{c}") for c in SAME)), "ties")
    return None if found.isEmpty() else found


def numbered(rows: DataFrame, tied: DataFrame | None) -> DataFrame:
    """Adds tie: 0, 1, ... among rows of equal source, doc_id and size, counted by task and then over tasks, so that
    no task holds all of them."""
    if tied is None:
        return rows.withColumn("tie", F.lit(0).cast("long"))
    columns = rows.columns
    same = lambda c: F.col(c).eqNullSafe(F.col(f"_tied_{c}"))
    marked = rows.withColumn("_task", F.spark_partition_id()).join(tied.withColumn("_tied", F.lit(True)), same("source") & same("doc_id") & same("size"), "left")
    alone = marked.where("_tied is null").select(*columns, F.lit(0).cast("long").alias("tie"))
    several = pin(marked.where("_tied").select(*columns, "_task"), "tied")  # read twice: a row keeps its task
    counts = several.groupBy(*SAME, "_task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*SAME).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select(*(F.col(c).alias(f"_tied_{c}") for c in SAME), F.col("_task").alias("_of"), before.alias("_first"))
    within = F.row_number().over(Window.partitionBy(*SAME, "_task").orderBy("_task")) - 1
    several = several.withColumn("_within", within).join(first, same("source") & same("doc_id") & same("size") & (F.col("_task") == F.col("_of")))
    return alone.unionByName(several.select(*columns, (F.col("_first") + F.col("_within")).alias("tie")))


def source_plan(base: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> tuple[DataFrame, bool]:
    """For each source of ``base`` (doc_id, source, size, tie): key, source_size, target, most, mean, cap, lam, and cut: a document
    whose rank is below it is taken once more.  The flag says that the table is small enough to broadcast."""
    sources = pin(with_targets(ranked_sources(base), weights, share, cap).withColumn("cap", F.lit(float(cap))), "targets")
    small = sources.count() <= BROADCAST_SOURCES
    hint = F.broadcast if small else (lambda x: x)
    solved = pin(multipliers(base, sources, small), "multipliers").withColumnRenamed("source", "key")
    rated = pin(_drawn(base.join(hint(solved), F.col("source").eqNullSafe(F.col("key")))).select("key", "size", "target", "rate", "whole", "rank"), "rates")
    open_ = F.col("rate") > F.col("whole")
    cut = rated.groupBy("key").agg((F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("need")).withColumn("from", F.lit(-1.0))
    width = 2.0
    for k in range(ROUNDS):  # the cut lies in [from, from + width)
        width /= BINS
        x = rated.where(open_).select(F.col("key").alias("source"), "size", "rank").join(hint(cut), F.col("source").eqNullSafe(F.col("key")))
        bin_ = F.floor((F.col("rank") - F.col("from")) / F.lit(width))
        sums = x.where((bin_ >= 0) & (bin_ < BINS)).groupBy("key", "need", "from", bin_.alias("bin")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        whole_bins = sums.withColumn("upto", upto).groupBy("key").agg(
            F.max(F.when(F.col("upto") <= F.col("need"), F.col("upto"))).alias("used"),
            F.min(F.when(F.col("upto") > F.col("need"), F.col("upto"))).alias("over"),
            F.min(F.when(F.col("upto") > F.col("need"), F.col("bin"))).alias("bin")).withColumnRenamed("key", "key2")
        new = cut.join(hint(whole_bins), F.col("key").eqNullSafe(F.col("key2")), "left")
        used = F.coalesce("used", F.lit(0))
        bins = F.coalesce("bin", F.lit(BINS))  # all documents left are taken if none goes over
        if k == ROUNDS - 1:  # the document on the cut goes to the nearer side
            bins = bins + F.when(F.col("over") - F.col("need") < F.col("need") - used, 1).otherwise(0)
        moved = F.when(F.coalesce("used", "over").isNull(), 0).otherwise(bins) * F.lit(width)
        cut = pin(new.select("key", (F.col("need") - used).alias("need"), (F.col("from") + moved).alias("from")), "cut")
    plan = solved.join(hint(cut.select(F.col("key").alias("key2"), F.col("from").alias("cut"))), F.col("key").eqNullSafe(F.col("key2"))).drop("key2")
    return pin(plan, "plan"), small


def with_copies(rows: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """Adds the plan of each row's source, rate and copies to ``rows`` (doc_id, source, size, tie)."""
    drawn = _drawn(rows.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("key"))))
    extra = ((F.col("rate") > F.col("whole")) & (F.col("rank") < F.col("cut"))).cast("long")
    return drawn.withColumn("copies", F.col("whole") + extra)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken, rate, copies for each row of ``docs`` (doc_id, source, text)."""
    base = pin(pick(docs, "doc_id", "source", "text").select("doc_id", "source", _size(F.col("text")).alias("size")), "sizes")
    base = numbered(base, tied) if (tied := ties(base)) is None else pin(numbered(base, tied), "numbered")
    out = with_copies(base, *source_plan(base, weights, share, cap))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it."""
    base = pin(pick(docs, "doc_id", "source", "text").select("doc_id", "source", _size(F.col("text")).alias("size")), "sizes")
    tied = ties(base)
    base = numbered(base, tied) if tied is None else pin(numbered(base, tied), "numbered")
    plan, small = source_plan(base, weights, share, cap)

    def taken(d: DataFrame) -> DataFrame:
        rows = d.select(F.struct(*d.columns).alias("_row"), "doc_id", "source", _size(F.col("text")).alias("size"))
        times = with_copies(numbered(rows, tied), plan, small).where("copies > 0")
        return times.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")

    return keeping_columns(docs, ("doc_id", "source", "text"), taken)
