"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marquee.llm import op1_tokens, op2_toxicity, op3_warc, op4_vectors, op5_lm, op6_mixing, op7_minhash, op8_urls, op9_packing, op10_rules, op11_languages, op12_repair, op13_whitening
from marquee.llm.common import read
from marquee.llm.tokens import public_path


def op1_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = op1_tokens.write_shards(read(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))
    return op1_tokens.read_ids(shards, digest=True)


def op2_toxicity_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_warc.records(op3_warc.chunk_table(op3_warc.write_archives(read(spark, sf_dir, "pages"))))


def op4_spherical_kmeans_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


def op5_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_lm.score(read(spark, sf_dir, "documents"))


def op6_mixing_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_mixing.mix(read(spark, sf_dir, "documents")).drop("rate", "copies")


def op7_minhash_coordinate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return op8_urls.judge(pages, op8_urls.spam_list(pages))


def op9_packing_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_packing.pack(read(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op10_quality_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_languages.identify(read(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_repair.repair(read(spark, sf_dir, "conversations"))[0]


def op13_whitening_qdwh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_simple8b_tokens, op2_toxicity_string_kernel, op3_warc_chunks, op4_spherical_kmeans_duplicates, op5_recurrent_lm, op6_mixing_entropy_balancing, op7_minhash_coordinate_join, op8_url_filter, op9_packing_cutting_stock, op10_quality_decision_list, op11_language_mixture, op12_conversation_repair, op13_whitening_qdwh)}
SQL = {"op8_url_filter": op8_urls.SQL}
