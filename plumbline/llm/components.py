"""Connected components of a link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for every node of links (a, b).

    Alternating stars: each round ties every node's larger neighbours, then its smaller ones, to
    the smallest; rounds are as the logarithm of the longest chain. Tables are cut by writing.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = large.join(least, "a").select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))
        after = materialize(small.distinct(), "links")
        # A star forest stays as it is: every node has one link, and no root is below another.
        if least.where("n > 1").limit(1).count() == 0 and after.join(after.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() == 0:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = after
