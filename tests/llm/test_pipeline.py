"""The pipeline on a small fixture, stage by stage against what each stage's operator or brute force says."""

from __future__ import annotations

import random
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

import corpus_pipeline
from marquee.llm import op2_toxicity, op6_mixing, op10_rules
from marquee.llm import queries as llm
from marquee.llm.common import pin, read
from marquee.llm.tokens import Encoder, public_path
from test_operators import brute_components

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """A folder of the tables that the pipeline reads; a third of the rows are near copies of one text."""
    rng, out = random.Random(11), str(tmp_path_factory.mktemp("sf"))
    vocab = ["".join(rng.choice(["ba", "do", "ki", "mu", "re", "sa", "tel", "vin"]) for _ in range(rng.randint(1, 4))) for _ in range(900)]
    base, rows, labels = [rng.choice(vocab) for _ in range(130)], [], []
    for i in range(600):
        if i % 3 == 0:
            ws = list(base)
            for _ in range(rng.randint(0, 3)):
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
        else:
            ws = [rng.choice(vocab) for _ in range(rng.randint(55, 160))]
        bad, junk = i % 10 == 1, i % 9 == 2
        if bad:
            for _ in range(4):
                ws.insert(rng.randrange(len(ws)), rng.choice(["idiot", "stupid", "clown", "moron", "scum"]))
        if junk:
            ws = [w + "&&&" for w in ws]
        text = " ".join(ws)
        rows.append((i, text, "en", f"src{i % 5}", len(text)))
        labels.append((i, int(not junk), int(bad)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "src0", 0), (1002, "short", "en", None, 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_each_stage(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "minhash_near_dedup", "mixing", "packing"]
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = pin(stage(spark, docs, sf_dir), name)
        before, after = ({r["doc_id"]: r["text"] for r in docs.collect()}, None) if name != "packing" else (None, None)
        if name != "packing":
            assert out.columns == columns
            after = Counter(r["doc_id"] for r in out.collect())
        if name == "toxicity":
            scored = {r["doc_id"]: r["predicted"] for r in op2_toxicity.scored(docs, labels).collect()}
            assert after == Counter(i for i in before if not scored[i]) and sum(i % 10 == 1 and i < 1000 for i in after) <= 2
            assert sum(i % 10 != 1 and i < 1000 for i in after) >= 535
        elif name == "quality_rules":
            judged = {r["doc_id"]: r["kept"] for r in op10_rules.judge(docs, labels).collect()}
            assert after == Counter(i for i in before if judged[i]) and not any(i >= 1000 or i % 9 == 2 for i in after)
            assert all(i in after for i in before if i < 1000 and i % 9 != 2)
        elif name == "minhash_near_dedup":
            exp = brute_components(list(before.items()), 5, 80)
            assert after == Counter(i for i in before if exp[i][1] == i) and len(after) < len(before)
        elif name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in op6_mixing.mix(docs).collect()}
            assert after == Counter({i: c for i, c in copies.items() if c}) and max(copies.values()) == 2
            kept = out.collect()
        else:
            e, ids, pieces = Encoder.of(public_path("byte_bpe_50k.json")), {}, defaultdict(list)
            for r in kept:
                ids[r["doc_id"]] = len(e.encode(r["text"].encode())) // 4 + 1
            for r in out.collect():
                assert r["doc_tokens"] == ids[r["doc_id"]]
                pieces[r["doc_id"]].append(r["length"])
            times = Counter(r["doc_id"] for r in kept)
            assert {i: sum(p) for i, p in pieces.items()} == {i: n * ids[i] for i, n in times.items()}
        docs = out
    whole = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "start", "length", "doc_tokens", "ids_crc32"]
    assert Counter(map(tuple, whole.select(*key).collect())) == Counter(map(tuple, docs.select(*key).collect()))


def test_empty_tables(spark, sf_dir, tmp_path):
    for t in ("documents", "labels"):
        read(spark, sf_dir, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_query_for_each_operator():
    numbers = [int(n[2:].split("_")[0]) for n in llm.QUERIES]
    assert sorted(numbers) == list(range(1, 14)) and set(llm.SQL) <= set(llm.QUERIES)


def test_entry_without_this_folder():
    """With the folder and the pipeline gone, the entry module still offers the other queries."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("marquee.llm"):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
