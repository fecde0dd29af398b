"""The corpus operators as queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, clustering, decontaminate, divergence, line_dedup, lm, near_dup, ngram_join, quality, sharding, suffix_dedup, token_counts, toxicity
from plumbline.llm.common import read_table
from plumbline.llm.tokens import default_path


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read_table(spark, sf_dir, "documents"), default_path())


def op2_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(read_table(spark, sf_dir, "documents"))


def op3_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"), k=3, similar=85)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), default_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1")
    return quality.quality_rules(read_table(spark, sf_dir, "documents"), trusted)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read_table(spark, sf_dir, "documents"), ~lm.held_out(F.col("doc_id")))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read_table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(read_table(spark, sf_dir, "embeddings"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(read_table(spark, sf_dir, "documents"), k=4, similar=85)


QUERIES = {f.__name__: f for f in (op1_bpe_encode_decode, op2_balanced_shards, op3_minhash_near_dups, op4_token_counts, op5_toxicity, op6_benchmark_leaks, op7_quality_rules, op8_line_dedup, op9_lm_scores, op10_suffix_array_dedup, op11_source_divergence, op12_centroid_clusters, op13_ngram_jaccard_join)}
SQL = {"op8_line_dedup": line_dedup.LINE_DEDUP_SQL, "op11_source_divergence": divergence.DIVERGENCE_SQL, "op12_centroid_clusters": clustering.CLUSTER_SQL}
