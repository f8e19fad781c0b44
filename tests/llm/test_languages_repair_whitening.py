"""Language mixtures, conversation repair and embedding whitening against brute force, with nulls, ties and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm import op11_languages, op12_repair, op13_whitening, repair_dp
from marquee.llm.qdwh import leading_eigenvectors, polar


@contextmanager
def conf(spark, **kw):
    before = {k: spark.conf.get(k.replace("__", ".")) for k in kw}
    for k, v in kw.items():
        spark.conf.set(k.replace("__", "."), v)
    yield
    for k, v in before.items():
        spark.conf.set(k.replace("__", "."), v)


# --- 11: languages

SYLLABLES = {"aa": ["ka", "to", "mi", "ne"], "bb": ["sch", "ung", "ei", "der"], "cc": ["ño", "que", "los", "ia"]}


def said(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(3)
    rows = [(i, said(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(5, 80)), lang) for i in range(300)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_of_held_out_documents_and_mixtures(spark, spoken):
    rows, docs = spoken
    got = {r["doc_id"]: r for r in op11_languages.identify(docs).collect()}
    assert {i for i, r in got.items() if r["held_out"]} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(got[i]["lang_pred"] == lang and 0.5 < got[i]["score"] <= 1 for i, _, lang in rows)
    rng = random.Random(4)
    mixed = [(k, said(rng, a, 60) + "\n" + said(rng, b, 30), a, b) for k, (a, b) in enumerate([("aa", "bb"), ("bb", "cc"), ("cc", "aa")] * 10)]
    out = op11_languages.predict(spark.createDataFrame([m[:2] for m in mixed], "doc_id long, text string"), *op11_languages.learned(docs)).collect()
    for r, (_, _, a, b) in zip(sorted(out, key=lambda r: r["doc_id"]), mixed, strict=True):
        assert r["lang_pred"] == a and set(r["langs"]) == {a, b} and abs(sum(r["shares"]) - 1) < 1e-9 and r["shares"] == sorted(r["shares"], reverse=True)


def test_languages_edges(spark, spoken):
    _, docs = spoken
    odd = [(1, None, "aa"), (2, "", "aa"), (3, " 12 $%\n", "bb"), (4, "katomine", None), (4, "katomine", None), (None, "schungder", "zz"), (5, "kato " * 120_000, "aa"), (6, "😀", None)]
    rows = spark.createDataFrame([(*r, 1, "x") for r in odd], "doc_id long, text string, lang string, Score int, LANGS string")
    langs, log_p = op11_languages.learned(docs)
    got = op11_languages.predict(rows, langs, log_p).collect()
    assert len(got) == len(odd)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert all(by[i][0]["lang_pred"] == "und" and by[i][0]["score"] == 0 for i in (1, 2, 3, 6))
    assert [r["lang_pred"] for r in by[4]] == ["aa", "aa"] and by[None][0]["lang_pred"] == "bb" and by[5][0]["lang_pred"] == "aa"
    assert {r["lang_pred"] for r in op11_languages.identify(rows.where("doc_id < 4")).collect()} == {"und"} and op11_languages.identify(docs.limit(0)).count() == 0


def test_trigrams_of_long_texts_do_not_depend_on_the_pieces(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abcÉß  .\n1") for _ in range(5000))
    whole = np.concatenate(op11_languages.trigrams(text))
    monkeypatch.setattr(op11_languages, "CHUNK", 7)
    assert (np.concatenate(op11_languages.trigrams(text)) == whole).all()
    slots, counts = op11_languages.counted(text)
    assert (np.repeat(slots, counts.astype(int)) == np.sort(whole)).all()
    words = re.findall(r"[a-zéß]+", text.lower())
    assert len(whole) == sum(map(len, words)) + len(words) - 1


def test_em_equals_a_grid_search():
    rng = np.random.default_rng(1)
    for _ in range(20):
        p, c = rng.dirichlet(np.ones(30), 2), rng.integers(1, 20, 30).astype(float)
        share, value = op11_languages.em(p, c, np.array([0.5, 0.5]))
        grid = np.linspace(0, 1, 2001)[1:-1]
        values = [(c * np.log(t * p[0] + (1 - t) * p[1])).sum() for t in grid]
        assert value >= max(values) - 1e-3 and abs(share[0] - grid[int(np.argmax(values))]) < 0.02


# --- 12: conversations


def repaired_by_brute_force(rows) -> dict:
    """conv_id -> the contract's columns, by damage in Python and a Viterbi search that keeps audits as strings."""
    conversations: dict = defaultdict(list)
    space = lambda x: " " if x is None else x
    for conv, turn, role, text in rows:
        mine = conversations[conv]
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, mine in conversations.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, symbols, count = set(), [], [0, 0, 0]
        for _, role, text in mine:
            end = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            initial = role[0] if role[:1] and role[0] in "sua" else "o"
            fault = 0 if not end else 1 if (role, text) in seen else 2 if end[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                count[fault] += 1
            symbols.append("D" if fault in (0, 1) else initial.upper() if fault == 2 else initial)
        initials = [r[1][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = {r[0] for r in mine if r[0] is not None}
        after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        wanted = lambda p: "a" if p == "u" else "u"

        def with_insertions(at):
            for _ in range(2):
                for p, (cost, audit, rows_) in list(at.items()):
                    q = wanted(p)
                    new = (cost + 5, audit + "I", [*rows_, ("assistant" if q == "a" else "user", "")])
                    if q not in at or new[:2] < at[q][:2]:
                        at[q] = new
            return at

        at = {"": (0, "", [])}
        for symbol, (_, role, text) in zip(symbols, mine, strict=True):
            new: dict = {}
            for p, (cost, audit, rows_) in with_insertions(at).items():
                ways = [(p, cost + 2, "D", [])]
                if symbol != "D":
                    more = 5 if symbol.isupper() else 0
                    q = wanted(p)
                    ways.append((q, cost + 1 + more, "R", [("assistant" if q == "a" else "user", text)]))
                    if (p, symbol.lower()) in after:
                        ways.append((after[p, symbol.lower()], cost + more, "K", [(role, text)]))
                for q, total, edit, row in ways:
                    found = (total, audit + edit, rows_ + row)
                    if q not in new or found[:2] < new[q][:2]:
                        new[q] = found
            at = new
        at = with_insertions(at)
        cost, audit, rows_ = min((at[p] for p in ("", "a") if p in at), key=lambda x: x[:2])
        text = "\n".join(f"{r}:{t}" for r, t in rows_)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(), rows_)
    return out


TALK = "conv_id long, turn long, role string, text string"


def talk(rng) -> list[tuple]:
    words = ["Yes.", "No", "Why?", "Fine!", "", " \t", "so it is.", "so it is. \n", "é.", "long " * 50 + "."]
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "u", "User"]), rng.choice(words) if rng.random() < 0.5 else f"{rng.random()}.") for c in range(120) for t in range(rng.randint(1, 9))]
    rows += [(c, t, ["system", "user", "assistant"][t if t < 1 else 2 - t % 2], f"{c} {t}.") for c in range(200, 260) for t in range(9)]
    rows += [(None, t, "user", "x.") for t in (None, 3, 3, 7)] + [(300, None, None, None), (300, None, "user", "a."), (300, 2**40, "assistant", "b."), (301, 5, "", "c."), (302, 1, "user", None)]
    return rows + rows[:15]


def checked(spark, rows, got) -> None:
    expected = repaired_by_brute_force(rows)
    assert len(got) == len(expected)
    for r in got:
        assert tuple(r)[1:] == expected[r["conv_id"]][:8], (r["conv_id"], r, expected[r["conv_id"]])


def test_repair_equals_brute_force(spark):
    rows = talk(random.Random(6))
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], TALK + ", part long, Audit string").repartition(3)
    digests, fixed = op12_repair.repair(frame)
    checked(spark, rows, digests.collect())
    expected, got = repaired_by_brute_force(rows), defaultdict(list)
    for r in fixed.collect():
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert {c: e[8] for c, e in expected.items() if e[8]} == got
    assert op12_repair.repair(frame.limit(0))[0].count() == 0


def test_repair_of_a_conversation_over_many_parts(spark):
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "no", f"{t}."])) for t in range(3000)] + [(7, 100, "user", "same.")] * 400
    rows += [(c, t, ["user", "assistant"][t % 2], f"{t}.") for c in (6, 8) for t in range(4)]
    with conf(spark, spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="6"):
        frame = spark.createDataFrame(rows, TALK).repartition(4)
        parts = op12_repair.parts(op12_repair.ordered(op12_repair.damaged(frame)))
        assert parts.where("conv_id = 7").count() > 3
        op12_repair.CHUNK, before = 5_000, op12_repair.CHUNK
        try:
            checked(spark, rows, op12_repair.repair(frame)[0].collect())
        finally:
            op12_repair.CHUNK = before


def test_grammar_rules_stand_for_their_rows(spark):
    rng = random.Random(9)
    rows = ["".join(rng.choice(["sua", "ua", "uaua", "uD", "DDDD", "S"]) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    counted = spark.createDataFrame([(r, 3) for r in rows], "rows string, n long")
    rules = op12_repair.grammar(counted)
    assert 5 < len(rules) <= op12_repair.MAX_RULES
    repairs, plain = repair_dp.Repairs(rules), repair_dp.Repairs([])

    def expanded(s):
        return "".join(c if ord(c) < repair_dp.FIRST_RULE else expanded(rules[ord(c) - repair_dp.FIRST_RULE]) for c in s)

    assert sum(len(repairs.compressed(r)) for r in rows) < 0.5 * sum(map(len, rows))
    for r in rows[:60]:
        assert expanded(repairs.compressed(r)) == r and repair_dp.best([repairs.product(r)]) == repair_dp.best([plain.product(s) for s in r][:1] if len(r) == 1 else [plain.product(r)])


def test_ropes_compare_as_texts():
    rng = random.Random(10)

    def rope(s):
        if len(s) < 4 or rng.random() < 0.2:
            return s
        k = rng.randint(1, len(s) - 1)
        return rope(s[:k]), rope(s[k:]), len(s)

    for _ in range(500):
        a = "".join(rng.choice("DK") for _ in range(rng.randint(0, 12)))
        b = a[: rng.randint(0, len(a))] + "".join(rng.choice("DK") for _ in range(rng.randint(0, 6)))
        x, y = rope(a), rope(b)
        assert repair_dp.text(x) == a and repair_dp.less(x, y) == (a < b)


# --- 13: whitening


def test_eigenvectors_equal_the_library():
    rng = np.random.default_rng(0)
    for d in (1, 2, 3, 20, 64):
        a = rng.standard_normal((d, 3 * d))
        v = a @ a.T
        w, u = leading_eigenvectors(v, min(16, d))
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
        assert np.allclose(w, values, rtol=1e-12) and np.abs(u - vectors * np.sign((u * vectors).sum(axis=0))).max() < 1e-11
        q = polar(a[:, :d])
        assert np.allclose(q.T @ q, np.eye(d), atol=1e-12) and np.linalg.eigvalsh((q.T @ a[:, :d] + a[:, :d].T @ q) / 2).min() > 0
    for v in (np.eye(5), np.diag([3.0, 2, 1, 2, 3]), np.zeros((4, 4)), np.ones((6, 6)), np.diag([1e8, 1, 1e-8])):
        w, u = leading_eigenvectors(v, 16)
        assert np.allclose(u.T @ u, np.eye(len(v)), atol=1e-12) and np.allclose(v @ u, u * w, atol=1e-12 * max(1, np.abs(v).max())) and (np.diff(w) <= 1e-12).all()


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("N", T.StringType()), T.StructField("component", T.IntegerType())])


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    base = (rng.standard_normal((200, 20)) * np.linspace(2, 0.1, 20)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(500 + i, base[3].tolist()) for i in range(90)] + [(None, base[4].tolist()), (3, base[5].tolist())]
    odd = [(900, None), (901, [None] * 20), (902, [float("nan")] * 20), (903, [float("inf")] * 20), (904, [])]
    other = [(950 + i, [float(i), float(i * i % 7), 1.0]) for i in range(9)]
    got = op13_whitening.whiten(spark.createDataFrame([(*r, "x", 1) for r in rows + odd + other], VECTORS).repartition(5)).collect()
    for mine, dims in ((rows, 16), (other, 2)):  # the third component of the short ones never varies
        x = np.floor(64 * np.array([v for _, v in mine], np.float32).astype(float)).astype(np.int64) + 1_000_000
        fit = np.unique(x, axis=0)
        n, total = len(fit), fit.sum(axis=0)
        v = (fit - total / n).T @ (fit - total / n) / n
        w, u = np.linalg.eigh(v)
        w, u = w[::-1][:dims], u[:, ::-1][:, :dims]
        z, dev = (x - total / n) @ u / np.sqrt(w), ((n * x - total) ** 2).sum(axis=1)
        ids = {i for i, _ in mine}
        out = sorted((r for r in got if r["vec_id"] in ids and r["n"] == n), key=lambda r: r["component"])
        assert len(out) == len(mine) * dims and {r["component"] for r in out} == set(range(1, dims + 1))
        for k in range(dims):
            column = [r for r in out if r["component"] == k + 1]
            key = lambda i: -1 if i is None else i
            a = sorted((key(r["vec_id"]), r["deviation"], round(abs(r["whitened"]), 8)) for r in column)
            b = sorted((key(i), int(d), round(abs(float(y)), 8)) for (i, _), d, y in zip(mine, dev, z[:, k], strict=True))
            assert [p[:2] for p in a] == [p[:2] for p in b] and np.allclose([p[2] for p in a], [p[2] for p in b], atol=1e-7)
            assert all(abs(r["explained"] - w[k] / np.trace(v)) < 1e-12 and r["identity_error"] < 1e-9 for r in column)
    assert len(got) == len(rows) * 16 + len(other) * 2


def test_whitening_edges(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], "x", 1)] * 3, VECTORS)
    assert op13_whitening.whiten(one).count() == 0 and op13_whitening.whiten(one.limit(0)).count() == 0
    big = spark.createDataFrame([(1, [3e38, 1.0], "x", 1), (2, [-3e38, 2.0], "x", 1), (3, [0.0, 0.5], "x", 1)], VECTORS)
    got = op13_whitening.whiten(big).collect()
    assert len(got) == 3 * 2 or len(got) == 3
    assert all(r["deviation"] is None for r in got if r["vec_id"] != 3 and r["component"] == 1)
    many = np.random.default_rng(1).integers(-2**20, 2**20, (50, 3))
    assert (op13_whitening.products(many) == many.T @ many).all() and (op13_whitening.products(many << 30) == (many.astype(object).T @ many.astype(object)) * 2**60).all()
    assert op13_whitening.whiten(big.select("vec_id", F.col("embedding").cast("array<double>"))).count() == len(got)
