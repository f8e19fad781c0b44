"""Conversation structure repair: grammar-compressed dynamic programming over role/fault sequences.

Equal rows of a turn are one row with a count before anything is dealt out; rows are then ranged by conversation and turn,
so that a long conversation spans many tasks.  Its part in one range is a string with one symbol a row (role and first
fault).  Re-Pair rules are learned over all parts, every round in Spark: count the pairs of symbols, name the most
frequent ones that share no symbol.  Each rule has one min-plus transfer matrix with an audit rope (``repair_dp``), made
bottom-up and shared by all conversations; a conversation in one part is solved there, the parts of others become
matrices that are put together by conversation.  Rows with their texts are dealt out once, by conversation and part, to
apply the audits; ``digests`` streams the repaired rows (of a conversation in several parts as chunks, in order).

Defined results: a null conv_id is a conversation of its own; in role, text, conv_id and turn of the damage key a null
reads as one space, and so do a null role and text; rows of one turn (repeated or null ones) come by role, then by the md5
of their text; a role without a first letter among s, u and a can be reroled or deleted only; conversations without rows
after damage have zeros, an empty audit and the hash of the empty text; an empty table gives an empty result; texts are
read whole, one row at a time; other columns are ignored.  The table of boundaries sent to tasks has at most one entry for
each range and the rules are at most MAX_RULES.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import repair_dp
from marquee.llm.common import batch_rows, pick, pin

SPACE = " \t\n\x0b\x0c\r"
#: Re-Pair: rounds, rules named in a round, rules in all, and how often a pair must occur.
MAX_ROUNDS, PER_ROUND, MAX_RULES, LEAST_PAIRS = 12, 32, 256, 4
CHUNK = 1 << 20
#: Symbols of rows by role (s, u, a, other): well, truncated, blank, duplicate.
WELL, CUT, BLANK, TWICE = "suao", "SUAO", "0123", "4567"
_ROLE = str.maketrans(CUT + BLANK + TWICE, WELL * 3)
_EDIT = str.maketrans(BLANK + TWICE, "D" * 8)
LEGAL = ("su", "ua", "au")
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (2 for a repeated row) after damage."""
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    rows = rows.withColumn("_kind", kind).where("_kind <> 0")
    words = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(F.col("_kind") == 4, "user").otherwise(space("role")).alias("role"), words.alias("text"),
                       F.when(F.col("_kind") == 3, 2).otherwise(1).alias("copies"))


ORDER = ("conv_id", "turn", "role", "h")


def ordered(rows: DataFrame) -> DataFrame:
    """The rows without texts, equal ones of a turn counted, in order of ``pos``; ``part`` is their range."""
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    role = F.substring("role", 1, 1)
    narrow = rows.select(*ORDER[:3], F.unhex(F.md5("text")).alias("h"), (end == "").alias("blank"), F.right(end, F.lit(1)).isin(".", "!", "?").alias("ended"), "copies")
    narrow = narrow.groupBy(*ORDER, "blank", "ended").agg(F.sum("copies").alias("copies"))
    narrow = narrow.withColumn("role_no", F.when(role == "s", 1).when(role == "u", 2).when(role == "a", 3).otherwise(4))
    keys = [F.col(c).asc_nulls_first() for c in ORDER]
    narrow = narrow.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pos", F.monotonically_increasing_id())
    return narrow.withColumn("part", F.shiftright("pos", 33))


def parts(rows: DataFrame) -> DataFrame:
    """conv_id, part, its rows as a string, the first row's key, least, greatest and number of different turns of ``ordered`` rows."""
    firsts = rows.where("not blank").groupBy("conv_id", "role", "h").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    letter = lambda of: F.substring(F.lit(of), F.col("role_no"), F.lit(1))
    again = F.when(F.col("blank"), letter(BLANK)).otherwise(letter(TWICE))
    own = F.when(F.col("blank") | F.col("is_first").isNull(), again).when(F.col("ended"), letter(WELL)).otherwise(letter(CUT))
    piece = F.concat(own, F.repeat(again, (F.col("copies") - 1).cast("int")))
    marked = rows.join(firsts, "pos", "left").select("conv_id", "part", "turn", "pos", "role", "h", piece.alias("piece"))
    got = marked.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("pieces"), F.min("turn").alias("low"), F.max("turn").alias("high"),
                                                F.size(F.collect_set("turn")).cast("long").alias("turns"), F.min(F.struct("pos", "turn", "role", "h")).alias("first"))
    return got.select("conv_id", "part", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("rows"), "low", "high", "turns", "first.turn", "first.role", "first.h")


def grammar(sequences: DataFrame) -> list[str]:
    """Re-Pair rules over ``sequences`` (rows, n times): for each rule the two symbols it stands for."""
    rules: list[str] = []

    def pairs(batches):
        of = repair_dp.Repairs(rules).compressed
        for batch in batches:
            rows = batch.column(0).to_pylist()
            all_rows = of("\n".join(rows) + "\n")
            c = np.frombuffer(all_rows.encode("utf-32-le"), np.uint32).astype(np.int64)
            line = np.concatenate([[0], np.cumsum(c == 10)[:-1]])
            a, b, weight = c[:-1], c[1:], batch.column(1).to_numpy()[np.minimum(line[:-1], len(rows) - 1)]
            at = np.arange(len(a))
            begins = np.maximum.accumulate(np.where(np.concatenate([[True], c[1:] != c[:-1]]), np.arange(len(c)), 0))[:-1]
            ok = (a != 10) & (b != 10) & ((a != b) | ((at - begins) % 2 == 0))  # in a run of one symbol every other pair
            keys, back = np.unique(a[ok] << 32 | b[ok], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(back, weight[ok], len(keys)).astype(np.int64))], ["pair", "n"])

    for _ in range(MAX_ROUNDS):
        counts = sequences.mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_PAIRS)
        used, before = set(), len(rules)
        for r in counts.orderBy(F.desc("n"), "pair").limit(4 * MAX_RULES).collect():
            pair = {chr(r["pair"] >> 32), chr(r["pair"] & 0xFFFFFFFF)}
            if not pair & used and len(rules) < min(before + PER_ROUND, MAX_RULES):
                used |= pair
                rules.append(chr(r["pair"] >> 32) + chr(r["pair"] & 0xFFFFFFFF))
        if len(rules) == before:
            break
    return rules


def faults(rows: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and illegal neighbours within."""
    roles = rows.translate(_ROLE)
    count = lambda letters: sum(rows.count(x) for x in letters)
    return count(BLANK), count(TWICE), count(CUT), max(0, len(roles) - 1) - sum(roles[i : i + 2] in LEGAL for i in range(len(roles) - 1))


SOLVED = "part long, state int, blank long, duplicate long, truncated long, illegal long, gaps long, cost long, audit string"


def solved(segments: DataFrame, rules: list[str]) -> DataFrame:
    """For each part: the state before it and its audit; a conversation's counts and cost (null but in its first part)."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    many = segments.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("_conv"), F.lit(True).alias("many"))
    tagged = segments.join(many, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    none = lambda x: [None if v is None else int(v) for v in x]

    def whole(batches):
        repairs, known = repair_dp.Repairs(rules), {}
        for batch in batches:
            out = []
            for rows in batch.column(2).to_pylist():
                got = known.get(rows)
                if got is None:
                    cost, _, audits = repair_dp.best([repairs.product(rows.translate(_EDIT))])
                    got = (*faults(rows), cost, audits[0])
                    if len(rows) <= repair_dp.SHORT and len(known) < 100_000:
                        known[rows] = got
                out.append(got)
            blank, duplicate, truncated, illegal, cost, audit = zip(*out, strict=True) if out else [()] * 6
            long = lambda x: pa.array(x, pa.int64())
            gaps = [0 if low is None else high - low + 1 - n for low, high, n in zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([0] * len(out), pa.int32()), *map(long, (blank, duplicate, truncated, illegal, gaps, cost)), pa.array(audit, pa.string())],
                                             ["conv_id", "part", "state", "blank", "duplicate", "truncated", "illegal", "gaps", "cost", "audit"])

    def matrices(batches):
        repairs = repair_dp.Repairs(rules)
        for batch in batches:
            for k, rows in enumerate(batch.column(2).to_pylist()):
                m = repairs.product(rows.translate(_EDIT))
                roles = rows.translate(_ROLE)
                here = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([here.column(0), here.column(1), pa.array([[p for p, _ in m]], pa.list_(pa.int32())), pa.array([[q for _, q in m]], pa.list_(pa.int32())),
                                                  pa.array([[c for c, _ in m.values()]], pa.list_(pa.int64())), pa.array([[repair_dp.text(a) for _, a in m.values()]], pa.list_(pa.string())),
                                                  pa.array([faults(rows)], pa.list_(pa.int64())), pa.array([roles[0] + roles[-1]]), here.column(3), here.column(4), here.column(5)],
                                                 ["conv_id", "part", "p", "q", "cost", "audit", "faults", "ends", "low", "high", "turns"])

    def together(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["part"])
        cost, states, audits = repair_dp.best([{(p, q): (c, a) for p, q, c, a in zip(r["p"], r["q"], r["cost"], r["audit"], strict=True)} for r in rows])
        counts = [sum(x) for x in zip(*(r["faults"] for r in rows), strict=True)]
        counts[3] += sum(a["ends"][1] + b["ends"][0] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
        known = [r for r in rows if r["low"] is not None]
        turns = sum(r["turns"] for r in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:], strict=False))
        gaps = known[-1]["high"] - known[0]["low"] + 1 - turns if known else 0
        first = [[x] + [None] * (len(rows) - 1) for x in (*counts, gaps, cost)]
        return pa.table([t.column("conv_id"), pa.array([r["part"] for r in rows], pa.int64()), pa.array(states, pa.int32()), *(pa.array(none(x), pa.int64()) for x in first), pa.array(audits, pa.string())],
                        names=["conv_id", "part", "state", "blank", "duplicate", "truncated", "illegal", "gaps", "cost", "audit"])

    columns = ("conv_id", "part", "rows", "low", "high", "turns")
    one = tagged.where("many is null").select(*columns).mapInArrow(whole, f"conv_id {kind}, {SOLVED}")
    pieces = tagged.where("many").select(*columns).mapInArrow(matrices, f"conv_id {kind}, part long, p array<int>, q array<int>, cost array<bigint>, audit array<string>, faults array<bigint>, ends string, low long, high long, turns long")
    return one.unionAll(pieces.groupBy("conv_id").applyInArrow(together, f"conv_id {kind}, {SOLVED}"))


def _key(turn, role: bytes, h: bytes) -> tuple:
    return turn is not None, turn or 0, role, h


def repaired(rows: DataFrame, segments: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id, part, several (whether the conversation has more parts), role, text: the repaired rows, in order within tasks."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    many = segments.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("_conv"), F.lit(True).alias("several"))
    tagged = lambda df: df.join(many, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv").withColumn("several", F.coalesce("several", F.lit(False)))
    starts: dict = {}
    for r in tagged(segments).where("several").select("conv_id", "part", "turn", "role", "h").collect():  # at most one for each end of a range
        starts.setdefault(str(r["conv_id"]) if r["conv_id"] is not None else None, []).append((_key(r["turn"], r["role"].encode(), bytes(r["h"])), r["part"]))
    for s in starts.values():
        s.sort()

    @F.arrow_udf("long")
    def part_of(conv: pa.Array, turn: pa.Array, role: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array([s[bisect.bisect_right(s, (_key(t, r.encode(), x), 1 << 62)) - 1][1] if (s := starts.get(c)) else None
                         for c, t, r, x in zip(conv.to_pylist(), turn.to_pylist(), role.to_pylist(), h.to_pylist(), strict=True)], pa.int64())

    texts = tagged(rows.withColumn("h", F.unhex(F.md5("text"))))
    part = part_of(F.col("conv_id").cast("string"), "turn", "role", "h") if starts else F.lit(None).cast("long")
    texts = texts.select("conv_id", "several", F.when(F.col("several"), part).alias("part"), F.lit(1).alias("kind"), *ORDER[1:], "copies", "text", F.lit(0).alias("state"))
    heads = tagged(repairs).select("conv_id", "several", F.when(F.col("several"), F.col("part")).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long"), F.lit(""), F.lit(None).cast("binary"), F.lit(0),
                                   F.col("audit"), "state")
    dealt = heads.unionAll(texts).toDF(*texts.columns).repartition("conv_id", "part").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("part"), "kind", *(F.col(c).asc_nulls_first() for c in ORDER[1:]))
    dealt = dealt.select("conv_id", "part", "several", "kind", "role", "copies", "text", "state")

    def stream(batches):
        """Heads and rows one after another, each as (place in its batch, batch, kind, role, copies, text, state)."""
        for batch in batches:
            for k, (kind_, role, copies, state) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5, 7)), strict=True)):
                yield batch, k, kind_, role, copies, batch.column(6)[k].as_py(), state

    def edit(batches):
        left = stream(batches)
        row = next(left, None)
        held, size = [], 0
        while row is not None:
            batch, k, _, _, _, audit, state = row  # a head
            ids = [c[0] for c in (x.to_pylist() for x in batch.slice(k, 1).columns[:3])]

            def of_head():
                nonlocal row
                while (row := next(left, None)) is not None and row[2] == 1:
                    yield row[3], row[5], row[4]

            for role, words in repair_dp.applied(state, audit, of_head()):
                held.append((*ids, role, words))
                size += len(words)
                if size > CHUNK or len(held) >= 10_000:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    schema = f"conv_id {kind}, part long, several boolean, role string, text string"
    arrow = _arrow_schema(rows, kind)

    def batch_of(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), arrow, strict=True)], ["conv_id", "part", "several", "role", "text"])

    return dealt.mapInArrow(edit, schema)


def _arrow_schema(rows: DataFrame, kind: str) -> list:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(rows.schema["conv_id"].dataType), pa.int64(), pa.bool_(), pa.string(), pa.string()]


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of ``repaired`` rows (as they are ordered within tasks); conversations without rows are absent."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def hashed(batches):
        now, sha, chunk, n = None, None, [], 0

        def done():
            conv, part, several = now
            yield conv, None if several else sha.hexdigest(), part, n, b"".join(chunk) if several else None

        for batch in batches:
            out = []
            for conv, part, several, role, words in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if now is None or now != (conv, part, several):
                    if now is not None:
                        out += done()
                    now, sha, chunk, n = (conv, part, several), hashlib.sha256(), [], 0
                    first = True
                data = f"{role}:{words}".encode("utf-8", "surrogatepass")
                if several:
                    chunk += [b"\n", data]
                    if sum(map(len, chunk)) > CHUNK:
                        out += done()
                        chunk, n = [], n + 1
                else:
                    sha.update(data if first else b"\n" + data)
                    first = False
            yield batch_of(out)
        if now is not None:
            yield batch_of(list(done()))

    arrow = [_arrow_schema(rows, kind)[0], pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(arrow)], ["conv_id", "repaired_sha256", "part", "n", "chunk"])

    def together(batches):
        now, sha, out = None, None, []
        for batch in batches:
            for k, conv in enumerate(batch.column(0).to_pylist()):
                if now is None or now != (conv,):
                    if now is not None:
                        out.append((now[0], sha.hexdigest(), None, None, None))
                    now, sha, first = (conv,), hashlib.sha256(), True
                data = batch.column(4)[k].as_py()
                sha.update(data[1:] if first and data else data)
                first = first and not data
        if now is not None:
            out.append((now[0], sha.hexdigest(), None, None, None))
        yield batch_of(out)

    names = "repaired_sha256 string, part long, n long, chunk binary"
    got = pin(rows.mapInArrow(hashed, f"conv_id {kind}, {names}"), "digests")
    chunks = got.where("chunk is not null").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "n")
    with batch_rows(rows.sparkSession, 16):
        rest = pin(chunks.select("conv_id", "repaired_sha256", "part", "n", "chunk").mapInArrow(together, f"conv_id {kind}, {names}"), "chunk_digests")
    return got.where("chunk is null").unionAll(rest).select("conv_id", "repaired_sha256")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The damaged conversations' repairs (a row for each conversation) and their repaired rows."""
    rows = damaged(conversations)
    segments = pin(parts(pin(ordered(rows), "ordered")), "parts")
    sequences = pin(segments.select(F.translate("rows", BLANK + TWICE, "D" * 8).alias("rows")).groupBy("rows").agg(F.count("*").alias("n")), "sequences")
    repairs = pin(solved(segments, grammar(sequences)), "repairs")
    fixed = repaired(rows, segments, repairs)
    total = repairs.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                                           F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    everyone = pick(conversations, "conv_id").distinct()
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    hashes = digests(fixed)
    out = everyone.join(total, same(everyone, total), "left").join(hashes, same(everyone, hashes), "left")
    zero = lambda c: F.coalesce(total[c], F.lit(0).cast("long")).alias(c)
    return out.select(everyone["conv_id"], *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce(total["audit"], F.lit("")).alias("audit"),
                      F.coalesce(hashes["repaired_sha256"], F.lit(EMPTY_HASH)).alias("repaired_sha256")), fixed
