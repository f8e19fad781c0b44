"""Integrity audits in place of enforced constraints.

Keys and references are audited as one multiset of tagged keys: every key column becomes
rows (tag, typed key), all are reduced by one partial aggregation and one shuffle, and no
table is joined.  A key column is read once, however many references it takes part in:
columns that references tie together share a domain, and a domain's keys are counted per
column.  Keys stay numbers where they are numbers; text is made of the findings only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.schema import FOREIGN_KEYS, PRIMARY_KEYS, required_columns

INTEGERS = {"tinyint", "smallint", "int", "bigint"}


def _is_integer(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.simpleString() in INTEGERS


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _literal_of(tag: str, names: Sequence[str]) -> Column:
    """The name that belongs to each value of ``tag`` (0, 1, ...)."""
    return F.element_at(F.array(*map(F.lit, names)), F.col(tag) + 1)


def key_duplicates(tables: dict[str, DataFrame], keys: dict[str, Sequence[str]]) -> DataFrame:
    """Key values held by more than one row, of all tables at once: (table_name, key_value, n_rows).

    Null parts are equal to one another and read NULL in the text."""
    names = list(keys)
    slots: dict[str, list[str]] = {}  # of each table, where its key's parts stand: l0, l1, ... (numbers), s0, s1, ... (text)
    for name in names:
        slots[name], used = [], {"l": 0, "s": 0}
        for c in keys[name]:
            kind = "l" if _is_integer(tables[name], c) else "s"
            slots[name].append(f"{kind}{used[kind]}")
            used[kind] += 1
    columns = sorted({s for ss in slots.values() for s in ss})
    kind_of = lambda slot: "bigint" if slot[0] == "l" else "string"
    frames = []
    for tag, name in enumerate(names):
        part = dict(zip(slots[name], keys[name], strict=True))
        frames.append(tables[name].selectExpr(f"{tag} as tag", *[f"cast({_quoted(part[s]) if s in part else 'null'} as {kind_of(s)}) as {s}" for s in columns]))
    found = union_all(frames).groupBy("tag", *columns).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)
    text = None
    for tag, name in enumerate(names):
        one = F.concat_ws("|", *[F.coalesce(F.col(s).cast("string"), F.lit("NULL")) for s in slots[name]])
        text = F.when(F.col("tag") == tag, one) if text is None else text.when(F.col("tag") == tag, one)
    return found.select(_literal_of("tag", names).alias("table_name"), text.alias("key_value"), "n_rows")


def _domains(references: Sequence[tuple[str, str, str, str]]) -> list[list[tuple[str, str]]]:
    """The columns (table, column) that references tie together, directly or through others."""
    groups: list[list[tuple[str, str]]] = []
    for child, column, parent, key in references:
        ends = [(child, column), (parent, key)]
        tied = [g for g in groups if any(e in g for e in ends)]
        groups = [g for g in groups if g not in tied] + [list(dict.fromkeys([c for g in tied for c in g] + ends))]
    return groups


def orphans(tables: dict[str, DataFrame], references: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """C14: non-null child keys without a parent row, of all references (child, column, parent, key) at once:
    (child_table, fk_column, parent_table, key_value, n_rows)."""
    domains = _domains(references)
    numbers = [all(_is_integer(tables[t], c) for t, c in domain) for domain in domains]
    kinds = ([("l", "bigint")] if any(numbers) else []) + ([("s", "string")] if not all(numbers) else [])
    places = [f"n{i}" for i in range(max(map(len, domains)))]
    frames = []
    for tag, domain in enumerate(domains):
        for place, (table, column) in enumerate(domain):
            keys = [f"cast({_quoted(column) if (kind == 'l') == numbers[tag] else 'null'} as {dtype}) as {kind}" for kind, dtype in kinds]
            frames.append(tables[table].selectExpr(f"{tag} as tag", f"{place} as place", *keys))
    slots = [kind for kind, _ in kinds]
    rows = union_all(frames).where(" or ".join(f"{s} is not null" for s in slots))
    counted = rows.groupBy("tag", *slots).agg(*[F.count_if(F.col("place") == i).alias(p) for i, p in enumerate(places)])
    text = F.coalesce(*[F.col(s).cast("string") for s in slots])
    broken, found = F.lit(False), []
    for child, column, parent, key in references:
        tag = next(i for i, d in enumerate(domains) if (child, column) in d)
        mine, theirs = (places[domains[tag].index(e)] for e in ((child, column), (parent, key)))
        test = (F.col("tag") == tag) & (F.col(mine) > 0) & (F.col(theirs) == 0)
        broken = broken | test
        found.append(F.when(test, F.struct(F.lit(child).alias("child_table"), F.lit(column).alias("fk_column"), F.lit(parent).alias("parent_table"),
                                           text.alias("key_value"), F.col(mine).alias("n_rows"))))
    return counted.where(broken).select(F.explode(F.array(*found)).alias("x")).where(F.col("x").isNotNull()).select("x.*")


def null_audit(df: DataFrame, table: str, required: list[str]) -> DataFrame:
    """Null count of each required column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return (counts.unpivot([], required, "column_name", "null_count")
            .select(F.lit(table).alias("table_name"), "column_name", F.col("null_count").cast("bigint")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Frames of equal columns as one, joined by halves (a chain is analysed again with each frame)."""
    while len(frames) > 1:
        frames = [a.union(b[0]) if b else a for a, *b in (frames[i : i + 2] for i in range(0, len(frames), 2))]
    return frames[0]


def audit_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All three audits over the 12 venue tables."""
    return {
        "pk_duplicates": key_duplicates(tables, PRIMARY_KEYS),
        "fk_orphans": orphans(tables, [(fk.child, fk.column, fk.parent, fk.parent_column) for fk in FOREIGN_KEYS]),
        "null_audit": union_all([null_audit(tables[t], t, required_columns(t)) for t in PRIMARY_KEYS]),
    }
