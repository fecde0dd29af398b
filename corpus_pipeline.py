"""A corpus pipeline of five stages; each works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, line_dedup, near_dup, quality
from plumbline.llm.common import materialize, read_table, same
from plumbline.llm.tokens import default_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels").where("quality = 1"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier three-line window; n_chars follows the text."""
    out = line_dedup.drop_repeated_lines(docs.drop("n_lines", "n_removed"))
    counted = {"n_chars": F.char_length("text").cast(dict(docs.dtypes)["n_chars"]).alias("n_chars")} if "n_chars" in docs.columns else {}
    return out.select(*[counted.get(c, F.col(f"`{c}`")) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): that of the smallest doc_id. Texts under one doc_id, null too, are judged each by itself; repeated rows are one document."""
    found = near_dup.near_duplicates(docs, k=5, similar=80).where("first").select("doc_id", "digest").distinct()
    mine = F.xxhash64("a.text") == F.col("b.digest")
    out = docs.alias("a").join(found.alias("b"), same("doc_id") & mine, "left_semi")
    turn = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("text"))
    return out.withColumn("__turn", turn).where("__turn = 1").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; texts under one doc_id, null too, are judged each by itself."""
    found = decontaminate.found_in(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id", "digest").distinct()
    mine = F.xxhash64("a.text") == F.col("b.digest")
    return docs.alias("a").join(found.alias("b"), same("doc_id") & mine, "left_anti")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and the decoded text."""
    return bpe.encode(docs, default_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]

#: The quality ratio, MinHash and BPE aren't SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return docs
