"""Token counts through a digest cache.

The cache is a Parquet folder of (content, version, n_tokens): digests of normalised content and of
the tokenizer. Only distinct content that isn't there is encoded, and is then appended.

Defined results: null counts as empty (0 tokens); repeated rows get a row each; a null doc_id is a
document; an empty table gives an empty one. Of the input only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scratch import new_path
from plumbline.llm.common import pieces, same, text_buffer
from plumbline.llm.tokens import tokenizer, version_digest

CACHE = "content binary, version string, n_tokens long"


def content_digest(text) -> F.Column:
    """SHA-256 of the content. The tokenizer drops white space: runs of it count as one blank."""
    return F.unhex(F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")), 256))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """content, n_tokens. Two jobs may have appended the same content: one row for each is read."""
    return spark.read.schema(CACHE).parquet(path).where(F.col("version") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs. cache: the folder, by default a new one in the shared folder."""
    spark = docs.sparkSession
    cache = cache or new_path(spark, "token-cache")
    version = version_digest(tokenizer_path)
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)  # so that it exists
    d = docs.select("doc_id", "text", content_digest(F.col("text")).alias("content"))
    keys = d.select("doc_id", "content", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    known = read_cache(spark, cache, version)
    misses = keys.groupBy("content").agg(F.min("doc_id").alias("doc_id")).join(known, "content", "left_anti")
    texts = d.alias("a").join(misses.alias("b"), same("content", "doc_id"), "left_semi").select("content", F.coalesce("text", F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        for b in pieces(batches, 2 << 20):
            data, off = text_buffer(b.column("text"))
            raw = data.tobytes()
            n = tok.counts([raw[s:e] for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("content"), pa.array(n, pa.int64())], ["content", "n_tokens"])

    fresh = texts.mapInArrow(count, "content binary, n_tokens long")
    fresh.select("content", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    out = keys.join(read_cache(spark, cache, version), "content")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
