"""Corpus pipeline: operators of marquee.llm in a row, each stage over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes it as Parquet in the shared folder and
rereads it as the next stage's docs.  All stages but the last return the columns of documents.

* toxicity: documents that the machine predicts toxic go.
* quality_rules: documents that fail the base rules or the decision list go.
* minhash_near_dedup: one document of each group of near copies (five-word shingles, similarity 0.8) stays.
* mixing: documents are repeated or left out so that each source comes near its target share.
* packing: the rest is packed into sequences; one row per piece: document, start, length, sequence and offset.

Defined results of every stage: documents with null or empty texts are not toxic and fail the base rules of quality;
near-dedup and mixing, which never see them in ``run``, keep them (no shingles) and take none of them (no words).  Rows that
repeat a doc_id are judged each by their own text, stay or go together in near-dedup, and are mixed and packed each; equal
near copies tie on the smallest doc_id; a null doc_id is judged alone; a null source is a source of its own.  An empty table
passes through as an empty table.  Extra columns, also ones that clash with names used here, are kept up to packing.

Labels are read from sf_dir; those of held-out documents (crc32 of doc_id, modulo 5, is 0) are not learned from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marquee.llm import op2_toxicity, op6_mixing, op7_minhash, op9_packing, op10_rules
from marquee.llm.common import pin, read
from marquee.llm.tokens import public_path

SHINGLE, PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_toxicity.filtered(docs, read(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_rules.filtered(docs, read(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_minhash.deduplicated(docs, PERCENT, SHINGLE)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_mixing.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_packing.pack(docs, public_path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("quality_rules", quality_rules), ("minhash_near_dedup", minhash_near_dedup), ("mixing", mixing), ("packing", packing)]
#: No SQL: four of the stages learn or draw by hash; tests run the pipeline against brute force on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
