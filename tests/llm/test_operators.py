"""Each operator on a small fixture with nulls, empty and long texts, ties, repeated rows, clashing columns and empty
tables, against brute force."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm import op1_tokens, op2_toxicity, op3_warc, op4_vectors, op5_lm, op6_mixing, op7_minhash, op8_urls, op9_packing, op10_rules, simple8b
from marquee.llm.components import components
from marquee.llm.tokens import Encoder, public_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()), T.StructField("TEXT", T.StringType()), T.StructField("score", T.DoubleType())])


def texts() -> list[tuple]:
    """(doc_id, text, source), with near copies of 0.7 to 1 of one text, exact copies, odd and long texts."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(400)] + ["École", "straße", "naïve", "don't", "x.", "42", "日本"]
    rows, base = [], [rng.choice(vocab) for _ in range(120)]
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(1, 200))]
        rows.append((100 + i, " ".join(w + ("\n" if rng.random() < 0.08 else "") for w in words), f"s{i % 4}"))
    for i in range(40):
        copy = list(base)
        for _ in range(i // 3):
            copy[rng.randrange(len(copy))] = rng.choice(vocab)
        rows.append((200 + i, " ".join(copy), "hot"))
    rows += [(300 + i, "Same line\nSame line\nthe same text again the same text again", "hot") for i in range(5)]
    rows += [(400, None, None), (401, "", "s1"), (402, " \t\n ", None), (403, "one", "s2"), (404, "one two", "s2"), (405, "ONE\x0btwo", "s2"), (406, "a  b\u00a0c <|endoftext|>\n\n", "s3"),
             (407, "long " * 9000, "s0"), (408, " ".join(rng.choice(vocab) for _ in range(6000)), "s0"), (409, "word", ""), (409, "word", "")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, len(t or ""), "x", "other", None) for i, t, s in texts()]
    with_case(spark, True)
    yield spark.createDataFrame(rows, DOCS).repartition(3)
    with_case(spark, False)


def with_case(spark, on: bool) -> None:
    spark.conf.set("spark.sql.caseSensitive", str(on).lower())


def clashing(docs):
    """The frame with its clashing column, when names do not tell case apart."""
    with_case(docs.sparkSession, False)
    return docs


def collected(df) -> list:
    return [r.asDict() for r in df.collect()]


def words(t) -> list[bytes]:
    return (t or "").encode().lower().split()


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for high in (1, 2, 300, 49_408, 2**31, 2**32):
        for n in (0, 1, 59, 1000, simple8b.BLOCK):
            ids = rng.integers(0, high, n).astype(np.uint32)
            w, p, v = simple8b.pack(ids)
            assert (simple8b.unpack(w, n, p, v) == ids).all()
    mixed = np.array([3, 2**32 - 1] * 50 + [0] * 300, np.uint32)  # escapes among narrow ids
    w, p, v = simple8b.pack(mixed)
    assert len(p) == 50 and (simple8b.unpack(w, len(mixed), p, v) == mixed).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    e, rng = Encoder.of(public_path(name)), random.Random(2)
    odd = ["", "a  b", "\n\nx  y\n ", " lead", "trail ", "Don't we'll 'tis", "x\x1cy", "<|endoftext|> hi <|endoftext|>\n\nfoo", "İ ẞ ΑΣ É. é́", "tab\tend\r\n", "foo###$$$ a\u00a0\u2003b"]
    odd += ["".join(rng.choice("ab é\n \t.'!1   sdA#$\u0301") for _ in range(rng.randint(1, 25))) for _ in range(500)]
    for t in odd + [t for _, t, _ in texts() if t]:
        assert e.encode(t.encode()) == np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_encoder_splits_texts_together(monkeypatch):
    """The ids do not depend on how many bytes are split at once; the more, the fewer parts are looked up."""
    e, some, looked_up = Encoder(public_path("word_bpe_49k.json")), [(t or "").encode() for _, t, _ in texts()], []
    ids_of = e._ids_of
    monkeypatch.setattr(e, "_ids_of", lambda parts: looked_up.append(len(parts)) or ids_of(parts))
    got = [(b"".join(x.tobytes() for x in e.encode_all(some, n)), sum(looked_up)) for n in (1 << 12, 1 << 20)]
    assert got[0][0] == got[1][0] == b"".join(map(e.encode, some))
    assert len(looked_up) > 2 and got[1][1] - got[0][1] < got[0][1] / 2


def test_op1_files_hold_all_ids(docs):
    vocabulary = public_path("word_bpe_49k.json")
    shards = op1_tokens.write_shards(clashing(docs), vocabulary)
    rows = collected(op1_tokens.read_ids(shards))
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(i for i, _, _ in texts())
    e, at = Encoder.of(vocabulary), 0
    ids_of = {i: [*np.frombuffer(e.encode((t or "").encode()), "<u4").tolist(), 2] for i, t, _ in texts()}
    for r in rows:
        assert (r["start"], r["n_tokens"], r["ids"]) == (at, len(ids_of[r["doc_id"]]), ids_of[r["doc_id"]])
        at += r["n_tokens"]
    digests = {(r["doc_id"], r["ids_crc32"]) for r in collected(op1_tokens.read_ids(shards, digest=True))}
    assert digests == {(i, zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids_of.items()}
    assert op1_tokens.read_ids(op1_tokens.write_shards(docs.limit(0), vocabulary)).count() == 0


def labelled(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(700):
        ws = ["".join(rng.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(50, 90))]
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                ws.insert(rng.randrange(len(ws)), rng.choice(["idiot", "stupid", "clown", "moron", "scum"]))
        if i % 7 == 0:
            ws = [w + "###" for w in ws]
        rows.append((i, " ".join(ws)))
        labels.append((i, int(i % 7 != 0), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_op2_kernel_equals_brute_force():
    """The sum over numbered subsequences is the kernel: subsequences of four codes, by the span that they take."""
    from itertools import combinations
    rng = random.Random(3)

    def features(unit):
        out = Counter()
        for at in combinations(range(len(unit)), op2_toxicity.ORDER):
            out[tuple(unit[i] for i in at)] += op2_toxicity.DECAY ** (at[-1] - at[0] + 1.0)
        norm = math.sqrt(sum((op2_toxicity.DECAY ** (at[-1] - at[0] + 1.0)) ** 2 for at in combinations(range(len(unit)), op2_toxicity.ORDER)))
        return {k: v / norm for k, v in out.items()}

    pairs = [("abcd", "ebca"), ("idiot", "iidiiot"), ("stupid", "st" "uzpid"), ("straße", "strasse")]
    pairs += [tuple("".join(rng.choice("abcdeéøzyx") for _ in range(rng.randint(3, 12))) for _ in range(2)) for _ in range(200)]
    for x, y in pairs:
        (u,), (v,) = op2_toxicity.units(x.encode()), op2_toxicity.units(y.encode())
        f, g = features(u), features(v)
        rows = []
        for unit in (u, v):
            which, w = op2_toxicity.embed(np.array([list(unit)], np.int32))
            rows.append(np.bincount(which[0], w[0], op2_toxicity.SLOTS))
        assert abs(rows[0] @ rows[1] - sum(w * g.get(k, 0.0) for k, w in f.items())) < 1e-6
    a, b = (op2_toxicity.embed(np.array([list(op2_toxicity.units(w)[0])], np.int32))[0][0, -1] for w in (b"abcd", b"ebca"))
    assert a != b
    letters = [np.array([[1 + k % 26, 1 + k // 26 % 26, 1 + k // 676, 1 + k % 7] for k in range(17_576)], np.int32)]
    assert len(np.unique(op2_toxicity.embed(letters[0])[0])) == 17_576


def test_op2_counts_by_ranges_of_units(monkeypatch):
    monkeypatch.setattr(op2_toxicity, "COUNTED", 7)
    rng = np.random.default_rng(3)
    bags = [np.unique(rng.integers(0, 40, rng.integers(0, 20))) for _ in range(30)]
    group = rng.integers(0, 4, len(bags)).tolist()
    got = op2_toxicity.different(bags, lambda k, a, b: (bags[k][a:b].astype(np.int64) << 32) + group[k], 41)
    assert got.tolist() == [len({g for bag, g in zip(bags, group, strict=True) if u in bag}) for u in range(41)]


def test_op2_an_insult_in_one_phrase_and_labels_in_conflict(spark):
    """An insult that many documents hold in one phrase is learned; copies of one document are one witness."""
    d, labels = labelled(spark)
    rng = random.Random(13)
    texts_ = [" ".join("".join(rng.choice(["th", "er", "on", "an"]) for _ in range(3)) for _ in range(60)) for _ in range(400)]
    phrase = [(10_000 + i, t + (" zzz wretch zzz" if i % 2 else ""), i % 2) for i, t in enumerate(texts_)]
    rows = spark.createDataFrame([r[:2] for r in phrase], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, y) for i, _, y in phrase] + [(10_000, 1, 1), (10_001, 1, 0)], "doc_id long, quality int, toxic int")
    got = collected(op2_toxicity.scored(rows, marks))
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] - 10_000) % 2 for r in held) >= 0.97 * len(held)
    assert op2_toxicity.near_copies([b"a b c d", b"a b c d", b"x y z w", b""]) == [0, 0, 2, 3]
    from marquee.llm.common import one_label
    assert {r["doc_id"] for r in one_label(marks, "toxic").where("doc_id in (10000, 10001, 10002)").collect()} == {10_002}


def test_op2_held_out_accuracy_and_edges(spark):
    d, labels = labelled(spark)
    odd = spark.createDataFrame([(5001, None), (5002, ""), (5003, "you i.d.i.o.t and st-upid clo*wn"), (5004, "you iddiot and stuppid cloown"), (5005, "the " * 30000), (None, "the idiot"), (5004, "you iddiot and stuppid cloown")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in collected(op2_toxicity.scored(d.unionByName(odd), labels))}
    held = [i for i in range(700) if got[i]["held_out"]]
    assert held == [i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert got[5003]["predicted"] == got[5004]["predicted"] == 1 and got[5001]["predicted"] == got[5002]["predicted"] == got[5005]["predicted"] == 0
    assert op2_toxicity.scored(d, labels.limit(0)).where("score <> 0").count() == 0
    assert op2_toxicity.scored(d.limit(0), labels).count() == 0
    kept = op2_toxicity.filtered(d.select("*", F.lit("x").alias("Text")), labels)
    assert kept.columns == ["doc_id", "text", "Text"] and 500 <= kept.count() <= 580


def test_op3_archives(spark):
    html = [(1, "http://a/ b", "<p>é</p>" * 50_000), (2, None, "same"), (3, "u", "same"), (4, "u", None), (5, "u", ""), (None, "u", "same"), (6, "u\r\nx", "WARC/1.1\r\n\r\n"), (2, None, "same")]
    pages = spark.createDataFrame(html, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    chunks = op3_warc.chunk_table(op3_warc.write_archives(pages), size=1000).cache()
    rows = collected(op3_warc.records(chunks))
    exp = []
    for i, _, h in html:
        b = (h or "").encode()
        first = min(j for j, _, x in html if (x or "").encode() == b and j is not None)
        exp.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    key = lambda r: str(r)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=key) == sorted(exp, key=key)
    one = sorted((r["chunk"], r["payload"], r["digest_so_far"]) for r in collected(chunks.where("page_id = 1")))
    sha = hashlib.sha1()
    for _, payload, so_far in one:
        sha.update(payload)
        assert base64.b32encode(sha.digest()).decode() == so_far and len(payload) <= 1000
    assert b"".join(p for _, p, _ in one).decode() == html[0][2]
    named = [(r["record"], r["chunk"]) for r in collected(chunks)]
    assert len(set(named)) == len(named)  # also of repeated page_ids
    least = collected(op3_warc.records(op3_warc.chunk_table(op3_warc.write_archives(pages, min_bytes=5))))
    assert all(r["record_type"] == "response" for r in least if r["payload_bytes"] < 5)
    assert op3_warc.chunk_table(op3_warc.write_archives(pages.limit(0))).count() == 0


def linked(n: int, links) -> list[int]:
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize(("block", "tile"), [(8192, 1024), (256, 100)])
def test_op4_against_brute_force(spark, monkeypatch, block, tile):
    monkeypatch.setattr(op4_vectors, "BLOCK", block)
    monkeypatch.setattr(op4_vectors, "TILE", tile)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    near = [b + rng.normal(size=16) * s for b in base[:20] for s in (0.05, 0.15, 0.3, 0.4)]
    hot = [base[0] + rng.normal(size=16) * 0.08 for _ in range(700)]  # more than a block
    vectors = [v.astype(np.float32).tolist() for v in [*base, *near, *hot, *[base[1]] * 30, base[2] * 7, base[3] * 1e30]]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    rows = [(i, v) for i, v in enumerate(vectors + odd)]
    df = spark.createDataFrame([*rows, (None, vectors[0])], "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("class", F.lit("x"))
    got = {r["vec_id"]: r for r in collected(op4_vectors.near_duplicates(df))}
    x = np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = np.argwhere(np.triu(x @ x.T >= 0.9, 1))
    deg, root = Counter(pairs.ravel().tolist()), linked(len(rows), pairs.tolist())
    found = sum(got[i]["n_links"] for i, _ in rows)
    assert found >= 0.999 * 2 * len(pairs)
    wrong = [i for i, _ in rows if (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) != (deg[i], root[i], root[i] == i)]
    assert not wrong
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, True)
    twice = op4_vectors.near_duplicates(spark.createDataFrame([(1, vectors[0]), (1, vectors[0]), (2, vectors[1])], "vec_id long, embedding array<float>"))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in collected(twice)) == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]
    assert op4_vectors.near_duplicates(df.limit(0)).count() == 0


def test_op4_finds_all_pairs_among_many_cells(spark, monkeypatch):
    """Pairs just above the threshold, without other structure, in some 150 cells: the nearest cells of the two often differ."""
    for name, n in (("PER_CELL", 8), ("MAX_SAMPLE", 300), ("BLOCK", 128), ("TILE", 50)):
        monkeypatch.setattr(op4_vectors, name, n)
    rng, cos = np.random.default_rng(40), 0.8001
    one, aside = (op4_vectors.unit(rng.normal(size=(600, 64))) for _ in range(2))
    aside = op4_vectors.unit(aside - (aside * one).sum(axis=1, keepdims=True) * one)
    vectors = np.concatenate([one, cos * one + np.sqrt(1 - cos**2) * aside])
    df = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in collected(op4_vectors.near_duplicates(df, 0.8))}
    pairs = np.argwhere(np.triu(vectors @ vectors.T >= 0.8, 1)).tolist()
    deg, root = Counter(i for p in pairs for i in p), linked(len(vectors), pairs)
    assert len(pairs) >= 600
    assert [i for i in range(len(vectors)) if (got[i]["n_links"], got[i]["component_id"]) != (deg[i], root[i])] == []


def test_op5_base_and_model(docs):
    rows = collected(op5_lm.score(clashing(docs)))
    toks = [(i, [*words(t), b""], zlib.crc32(str(i).encode()) % 7 == 2) for i, t, _ in texts()]
    c = Counter(w for _, ws, held in toks if not held for w in ws)
    n, v = sum(c.values()), len(c)
    exp = {i: (held, len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws, held in toks}
    assert len(rows) == len(toks)
    for r in rows:
        held, k, known, base = exp[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, k, known, n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] < 0 and math.isfinite(r["score"])
    assert op5_lm.score(docs.limit(0)).count() == 0


def test_op5_words_beyond_the_table_count_for_their_own_text(spark, monkeypatch):
    """Most words are beyond the table that travels to the workers, many texts are read at a time."""
    monkeypatch.setattr(op5_lm, "KNOWN", 5)
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{int(3_000 * rng.random() ** 3)}" for _ in range(rng.randint(0, 60)))) for i in range(600)]
    toks = {i: [*words(t), b""] for i, t in rows}
    c = Counter(w for i, ws in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    got = collected(op5_lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)))
    assert sorted(r["doc_id"] for r in got) == sorted(toks)
    wrong = [r for r in got if r["n_known"] != sum(c[w] > 0 for w in toks[r["doc_id"]]) or abs(r["base_score"] - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks[r["doc_id"]])) > 1e-6 * abs(r["base_score"])]
    assert wrong == []


def test_op5_training_covers_whole_texts(spark, monkeypatch):
    """The rounds' texts together are all texts, whole; the network trains on each symbol of them once."""
    from marquee.llm import gru
    rows = [(i, " ".join(f"w{(i * 7 + k) % 40}" for k in range(n))) for i, n in enumerate([0, 1, 47, 48, 49, 1000, 3, 16, 15])] + [(None, "w1 w2"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.col("text").cast("binary").alias("text"))
    vocab = op5_lm.Vocabulary(op5_lm.word_counts(df))
    got = collected(op5_lm.sequences(df, spark.sparkContext.broadcast(vocab.plain())))
    place = {w: i for i, w in enumerate(vocab.words)}
    exp = [[*op5_lm._symbols(np.array([place[w] for w in (t or "").lower().encode().split()], np.int64), vocab.plain()).tolist(), 0] for _, t in rows]
    assert sorted(np.frombuffer(r["symbols"], np.int16).tolist() for r in got) == sorted(exp)
    assert {r["round"] for r in got} == set(range(op5_lm.ROUNDS))
    seen, lanes = [], {}
    def watch(p, g, into, out, mask, h):
        for j in range(out.shape[1]):
            if not h[j].any():  # a new text begins without a state
                seen.append([])
                assert into[0, j] == 0
            else:
                assert into[0, j] == seen[lanes[h[j, 0]]][-1]
            at = lanes[h[j, 0]] if h[j].any() else len(seen) - 1
            seen[at] += out[mask[:, j], j].tolist()
            h[j] = at + 1
            lanes[h[j, 0]] = at
        return h
    monkeypatch.setattr(gru, "gradient", watch)
    _, n = gru.train(gru.initial(vocab.symbol_counts), (np.array(x, np.int16) for x in exp), 0, rows=3)
    assert sorted(seen) == sorted(exp) and n == sum(map(len, exp))


def test_gru_gradient_and_carried_state():
    from marquee.llm import gru
    rng = np.random.default_rng(0)
    flat = gru.initial(np.ones(gru.SYMBOLS)) + rng.normal(size=gru.SIZE).astype(np.float32) * 0.05
    out = rng.integers(0, gru.SYMBOLS, (5, 3))
    into = np.vstack([np.zeros((1, 3), int), out[:-1]])
    grad, h = np.zeros_like(flat), np.zeros((3, gru.STATE), np.float32)
    gru.gradient(gru.views(flat), gru.views(grad), into, out, np.ones((5, 3), bool), h)

    def loss(f):
        return -gru.score(f, [out[:, j] for j in range(3)], 0).sum() / 15

    for i in [0, 20, gru.SYMBOLS * gru.EMBED + 5, gru.SYMBOLS * gru.EMBED + 800, gru.SIZE - 1, gru.SIZE - gru.SYMBOLS - 3, *np.argsort(-abs(grad))[:5]]:
        d = np.zeros_like(flat)
        d[i] = 1e-2
        assert abs((loss(flat + d) - loss(flat - d)) / 2e-2 - grad[i]) < 2e-3 + 0.05 * abs(grad[i])
    long = rng.integers(0, gru.SYMBOLS, 101)  # windows do not change a score, nor do other texts
    whole = gru.score(flat, [long], 0, window=1000)[0]
    assert abs(gru.score(flat, [long[:7], long, long[:50]], 0, window=8)[1] - whole) < 1e-3 * abs(whole)


def test_op6_targets_and_bounds(docs):
    rows = collected(op6_mixing.mix(clashing(docs)))
    exp = {i: len(WORD.findall(t or "")) for i, t, _ in texts()}
    src = {i: s for i, _, s in texts()}
    sizes = defaultdict(int)
    for i, t, s in texts():
        sizes[s] += len(WORD.findall(t or ""))
    order = [*sorted((s for s in sizes if s is not None), key=lambda s: s.encode()), None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not full:
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        free -= full
    target |= {s: weight[s] * level for s in free}
    taken = Counter()
    for r in rows:
        s = src[r["doc_id"]]
        assert r["size"] == exp[r["doc_id"]] and r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    for s in order:
        largest = max(exp[i] for i in exp if src[i] == s)
        assert abs(taken[s] - target[s]) <= largest
    again = {(r["doc_id"], r["taken"]) for r in collected(op6_mixing.mix(docs.repartition(5)))}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}
    out = op6_mixing.mixed(docs)
    assert out.columns == docs.columns
    assert sum(len(WORD.findall(r["text"] or "")) for r in collected(out.toDF(*[c if c != "TEXT" else "other" for c in docs.columns]))) == sum(taken.values())
    assert op6_mixing.mix(docs.limit(0)).count() == 0


def test_op6_many_equal_rows_meet_their_target(spark):
    rows = [(None, "a", "one two three four five")] * 100 + [(7, "b", "x y z")] * 40 + [(i, "b", "x y z w v u t s r q") for i in range(30)] + [(1, None, "k l")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = collected(op6_mixing.mix(frame))
    assert len(got) == len(rows)
    for size, words_ in (("a", 5), ("b", 10), (None, 2)):
        mine = [r for r in got if (r["source_size"] == {"a": 500, "b": 420, None: 6}[size])]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= words_ and all(r["taken"] <= 2 * r["size"] for r in mine)
    again = collected(op6_mixing.mix(frame.repartition(3)))
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sum(len(r["text"].split()) for r in op6_mixing.mixed(frame).collect()) == sum(r["taken"] for r in got)


def test_op5_beats_the_base_on_held_out_text(spark):
    """Words follow one another by a rule that counts alone cannot see; the network's scores are sent without this package's classes."""
    rng = random.Random(21)
    nouns, verbs = [f"n{i}" for i in range(20)], [f"v{i}" for i in range(20)]
    rows = [(i, " ".join(f"the {rng.choice(nouns)} {rng.choice(verbs)} ." for _ in range(rng.randint(30, 60)))) for i in range(700)]
    got = collected(op5_lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)))
    held = [r for r in got if r["held_out"]]
    assert len(held) > 60 and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert sum(r["score"] > r["base_score"] for r in held) > 0.9 * len(held)
    counts = spark.createDataFrame([(b"a", 3), (b"", 2)], "word binary, n long")
    import pickle
    import pickletools
    assert "marquee" not in "".join(str(arg) for _, arg, _ in pickletools.genops(pickle.dumps(op5_lm.Vocabulary(counts).plain())))


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    ids = sorted(sets)
    links = [(a, b) for a in range(len(ids)) for b in range(a) if sets[ids[a]] and 100 * len(sets[ids[a]] & sets[ids[b]]) >= percent * len(sets[ids[a]] | sets[ids[b]])]
    root = linked(len(ids), links)
    return {i: (len(sets[i]), ids[root[k]]) for k, i in enumerate(ids)}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_op7_against_brute_force(docs, width, percent):
    got = collected(op7_minhash.near_duplicates(clashing(docs), percent, width))
    exp = brute_components([(i, t) for i, t, _ in texts()], width, percent)
    assert len(got) == len(texts())
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (*exp[r["doc_id"]], exp[r["doc_id"]][1] == r["doc_id"])
    kept = op7_minhash.deduplicated(docs, percent, width)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == sorted(i for i, _, _ in texts() if exp[i][1] == i)


def test_op7_compares_only_sizes_that_fit(spark):
    """Members of a head whose sizes cannot be similar are not sent to a block; those that can, once each."""
    sizes = {0: [10, 20, 40, 80, 160, 320], 10: [100, 100, 100], 20: [85, 100, 118, 50], 30: [1, 1]}
    rows = [(head, head + k, k > 0, n) for head, ns in sizes.items() for k, n in enumerate(ns)]
    members = spark.createDataFrame(rows, "head long, class long, apart boolean, n_shingles long")
    sets = spark.createDataFrame([(c, np.arange(n, dtype=np.uint64).tobytes()) for _, c, _, n in rows], "class long, hashes binary")
    got = collected(op7_minhash.block_rows(members, sets, 85))
    met = {(r["head"], r["class"]) for r in got}
    assert met == {(10, 10), (10, 11), (10, 12), (20, 20), (20, 21), (20, 22), (30, 30), (30, 31)}
    assert sum(r["head"] == 10 for r in got) == 3 and sum(r["head"] == 30 for r in got) == 2
    links = {frozenset((r["a"], r["b"])) for r in collected(op7_minhash.blocked_links(members, sets, 85))}
    assert {c for x in links for c in x} == {10, 11, 12, 20, 21, 30, 31}


def test_op7_pairs_at_the_threshold_of_80(spark):
    """Pairs at similarity 0.8 exactly that have 27 to 29 equal coordinates; no other text shares any."""
    seeds, rows = op7_minhash._seeds(op7_minhash.COORDINATES), []
    for s in (305, 376, 1946, 2286):
        pair = [[f"w{s}x{i}" for i in range(49)] for _ in range(2)]
        pair[1][24] = "other"
        rows += [(2 * s + k, " ".join(ws)) for k, ws in enumerate(pair)]
        mine, its = (op7_minhash.signature(op7_minhash.shingles(t.encode(), 5), seeds) for _, t in rows[-2:])
        assert 27 <= (mine == its).sum() < 30
    kept = op7_minhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), 80, 5)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in rows[::2])


def test_op7_ids_repeated_over_different_texts(spark):
    """An id in several classes links them, and no class loses the links of its own text."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(500)]
    one, two, three = ([rng.choice(vocab) for _ in range(120)] for _ in range(3))
    near = lambda ws, k: " ".join([*ws[:k], "changed", *ws[k + 1 :]])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, near(one, 50)), (3, near(two, 60)), (4, " ".join(three)), (5, near(three, 9)), (1, " ".join(one)), (6, near(three, 70)), (6, "alone")]
    exp = brute_components(rows, 3, 85)
    for order in (rows, rows[::-1]):
        got = collected(op7_minhash.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(4)))
        assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}


def test_op7_bound_on_missed_pairs():
    assert op7_minhash.matches_at(85) == 30 and op7_minhash.matches_at(100) == 48
    for percent in (60, 70, 80, 85, 95):
        m, p = op7_minhash.matches_at(percent), percent / 100
        miss = lambda m, p=p: sum(math.comb(48, k) * p**k * (1 - p) ** (48 - k) for k in range(m))
        assert miss(m) <= 5e-5 < miss(m + 1)


def test_op7_group_larger_than_blocks(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocab) for _ in range(150)]
    rows = []
    for i in range(260):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(150)] = rng.choice(vocab)
        rows.append((i, " ".join(copy)))
    rows.append((None, rows[0][1]))
    got = {r["doc_id"]: r for r in collected(op7_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))}
    exp = brute_components(rows[:-1], 3, 85)
    assert {i: got[i]["component_id"] for i in exp} == {i: c for i, (_, c) in exp.items()} and len({c for _, c in exp.values()}) > 1
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert op7_minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_shapes(spark):
    path, star = [(i, i + 1) for i in range(50)], [(100, 100 + i) for i in range(1, 200)]
    rows = {r["id"]: r["component"] for r in collected(components(spark.createDataFrame([*path, *star, (7, 7), (5, 4)], "a long, b long")))}
    assert rows == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(200)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op8_against_sql(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?a#b", "http://example.com", "http://example.com?x", "http://a.example.com/en/", "x://y.net/es/1", "http://net/fr/", "http://notnet/fr/",
            "http://www.casino-win.example.org/1", "https://casino-win.example.org/1/?utm_source=a&ref=b", "http://ok.org/casino", "http://a.com://b.net/es/", "http://ÄB.net/fr/é", "http://bets.org/\n?b=2&a=1", "http://bets.org?b=2"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls[5:8])], "page_id long, url string").withColumn("host", F.lit("x")).withColumn("URL2", F.lit(1))
    got = collected(op8_urls.judge(pages, op8_urls.spam_list(pages)))
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    exp = con.execute(op8_urls.SQL).fetchall()
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got), key=str) == sorted(exp, key=str)
    free = collected(op8_urls.judge(pages, pages.limit(0)))
    assert all(r["verdict"] == "allow" for r in free if r["rule"] is None)
    assert op8_urls.judge(pages.limit(0), pages).count() == 0


def test_op8_list_entries_with_and_without_scheme(spark):
    urls = [None, "", "no scheme", "http://bad.org/x", "https://www.bad.org/x/?ref=1", "http://bad.org/y", "http://other.org", "http://OTHER.org/z", "://", "http:///x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("bad.org/x",), ("http://other.org",), ("",), (None,), ("no scheme",), ("http://",), ("/x",)], "url string")
    got = {r["page_id"]: r["verdict"] for r in collected(op8_urls.judge(pages, listed))}
    assert {i for i, v in got.items() if v == "block"} == {3, 4, 6} and len(got) == len(urls)


def test_op8_filter_lets_few_others_pass(spark):
    listed = spark.range(20_000).select(F.concat(F.lit("http://h.org/"), "id").alias("url"))
    names = listed.select(op8_urls.canonical(F.col("url")).alias("canon"))
    blocks = 20_000 * op8_urls.BITS_PER_URL // 256
    bloom = op8_urls.bloom_filter(names, blocks)

    def passing(frame):
        rows = frame.withColumn("block", op8_urls._block(F.col("canon"), blocks)).join(bloom, "block")
        test = F.lit(True)
        for i, b in enumerate(op8_urls._bits(F.col("canon"))):
            test = test & (F.col(f"b{i}").bitwiseAND(b) == b)
        return rows.where(test).count()

    assert passing(names) == 20_000
    assert passing(spark.range(20_000).select(F.concat(F.lit("o.org/"), "id").alias("canon"))) < 400


def test_op9_pieces_and_padding(docs):
    vocabulary = public_path("byte_bpe_50k.json")
    rows = collected(op9_packing.pack(clashing(docs), vocabulary, keep_ids=True))
    e = Encoder.of(vocabulary)
    whole = {i: e.encode((t or "").encode()) + (1).to_bytes(4, "little") for i, t, _ in texts()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["ids"] == whole[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])] and r["ids_crc32"] == zlib.crc32(r["ids"])
        assert r["doc_tokens"] == len(whole[r["doc_id"]]) // 4
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    times = Counter(i for i, _, _ in texts())
    for i, parts in by_doc.items():
        assert sum(n for _, n in parts) == times[i] * len(whole[i]) // 4
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    tokens = sum(n for parts in by_seq.values() for _, n in parts)
    assert len(by_seq) <= 1.05 * tokens / 2048 + 1
    assert op9_packing.pack(docs.limit(0), vocabulary).count() == 0


def test_cutting_stock_near_optimum():
    rng = np.random.default_rng(3)
    lengths = np.arange(1, 65)
    for demand in (rng.integers(0, 500, 64), np.where(lengths % 7 == 3, 1000, 0), np.eye(64, dtype=int)[40] * 5):
        used = demand > 0
        patterns = op9_packing.cutting_stock(lengths[used], demand[used], 64)
        assert (sum(t * p for t, p in patterns) == demand[used]).all() and all((p * lengths[used]).sum() <= 64 for _, p in patterns)
        halves = demand[lengths > 32].sum()
        assert sum(t for t, _ in patterns) <= max((demand * lengths).sum() / 64, halves) * 1.05 + 65 / 2
    assert op9_packing.cutting_stock(np.array([], int), np.array([], int), 64) == []


def brute_counts(t):
    ws = WORD.findall(t or "")
    tri, rep = Counter(zip(ws, ws[1:], ws[2:], strict=False)), [0] * len(ws)
    for i in range(len(ws) - 2):
        if tri[ws[i], ws[i + 1], ws[i + 2]] > 1:
            rep[i] = rep[i + 1] = rep[i + 2] = 1
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, sum(rep)


def test_op10_counts_and_list(spark, docs):
    d, labels = labelled(spark)
    rows = collected(op10_rules.judge(clashing(docs), labels))
    exp = {i: brute_counts(t) for i, t, _ in texts()}
    for r in rows:
        n, chars, symbols, dup, rep = exp[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n) and not (r["base_failed"] and r["kept"])
    judged = {r["doc_id"]: r for r in collected(op10_rules.judge(d, labels))}
    held = [i for i in judged if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(judged[i]["kept"] == (i % 7 != 0) for i in held)
    kept = op10_rules.filtered(d.select("*", F.lit("x").alias("Text")), labels)
    assert kept.columns == ["doc_id", "text", "Text"] and kept.count() == 600
    assert op10_rules.judge(d, labels.limit(0)).where("kept").count() == 700 and op10_rules.judge(d.limit(0), labels).count() == 0


def test_op10_counts_sampled_texts_once(spark, tmp_path, monkeypatch):
    """The list is learned from one count of each sampled text; no other text is counted, and a task needs one worker."""
    d, labels = labelled(spark)
    counts, seen = op10_rules.counts, f"{tmp_path}/seen"

    def noted(text):
        with open(seen, "a") as f:
            f.write("x\n")
        return counts(text)

    monkeypatch.setattr(op10_rules, "counts", noted)
    op10_rules.learned_rules(d, labels, 50)
    with open(seen) as f:
        assert len(f.readlines()) == 50
