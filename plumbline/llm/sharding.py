"""Sharding by balanced label propagation.

Documents that share a link move, round by round, to the shard where most of what they are linked
with lies; a shard takes in no more than its quota. Then each shard keeps its capacity's worth of
linked documents, and the rest, with the unlinked ones, fills what is left: row counts of shards
differ by one at most.

Defined results: null and empty texts have size 1 and crc32 0; null texts aren't linked, empty
ones are linked with each other; repeated rows are documents of their own; an empty table gives an
empty one. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import materialize

#: Parts that the rows of one hash are dealt to, so that no task ranks all copies of a text.
PARTS = 64


def ranked(df: DataFrame, by: list[str], order: Column, weight: str = "__rank") -> DataFrame:
    """df with the 0-based rank of each row among those of equal `by`, in the order of a hash, then part, then __id.

    Rows are numbered inside the parts of each hash. Where a part begins comes from counts: those of the 512
    ranges of hashes (a bounded table), and inside a range those of its hashes and parts, which are added up before.
    """
    d = df.withColumn("__o", order).withColumn("__r", F.shiftright("__o", 55) + 256).withColumn("__p", F.pmod(F.xxhash64("__id"), F.lit(PARTS)).cast("int"))
    part = [*by, "__r", "__o", "__p"]
    counts = d.groupBy(*part).agg(F.count("*").alias("__n"))
    sums = counts.groupBy(*by, "__r").agg(F.sum("__n").alias("__all_n"))
    sums = sums.withColumn("__off", F.sum("__all_n").over(Window.partitionBy(*by).orderBy("__r")) - F.col("__all_n")).drop("__all_n")
    inside = counts.withColumn("__off2", F.sum("__n").over(Window.partitionBy(*by, "__r").orderBy("__o", "__p")) - F.col("__n")).drop("__n")
    d = d.join(inside.join(F.broadcast(sums), [*by, "__r"]), part)
    w = Window.partitionBy(*part).orderBy("__id")
    return d.withColumn(weight, F.col("__off") + F.col("__off2") + F.row_number().over(w) - 1).drop("__o", "__r", "__p", "__off", "__off2")


def propagate(nodes: DataFrame, shards: int, caps: list[int], rounds: int, slack: float) -> DataFrame:
    """nodes: __id, link. The label (shard) of each after some rounds of moves under quotas."""
    state = ranked(nodes.withColumn("__all", F.lit(0)), ["__all"], F.xxhash64("link")).select("__id", "link", (F.col("__rank") % shards).cast("int").alias("label"))
    state = materialize(state, "shard-labels")
    for _ in range(rounds):
        loads = dict(state.groupBy("label").count().collect())
        room = [int(c * (1 + slack)) + 1 - loads.get(i, 0) for i, c in enumerate(caps)]
        rooms = F.array(*[F.lit(r) for r in room])
        votes = state.groupBy("link", "label").agg(F.count("*").alias("n"))
        # A shard without room can't be a target, but the one that a document is in always may be.
        best = votes.groupBy("link").agg(F.max(F.struct(F.when(F.get(rooms, F.col("label")) > 0, F.col("n")).otherwise(F.lit(0)).alias("n"), (-F.col("label")).alias("label"))).alias("b"))
        own = state.join(votes, ["link", "label"]).join(best, "link")
        wish = own.select("__id", "link", "label", F.when(F.col("b.n") > F.col("n"), -F.col("b.label")).when((F.col("b.n") == F.col("n")) & (-F.col("b.label") < F.col("label")), -F.col("b.label")).otherwise(F.col("label")).cast("int").alias("to"))
        moves = ranked(wish.where("to <> label"), ["to"], F.xxhash64("link")).where(F.col("__rank") < F.get(rooms, F.col("to"))).select("__id", "to")
        after = state.join(moves, "__id", "left").select("__id", "link", F.coalesce("to", "label").alias("label"), F.col("to").isNotNull().alias("moved"))
        after = materialize(after, "shard-labels")
        moved = after.where("moved").limit(1).count()
        state = after.drop("moved")
        if not moved:
            break
    return state


def balanced_shards(docs: DataFrame, shards: int = 16, rounds: int = 4, slack: float = 0.25) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null) for each row of docs."""
    spark = docs.sparkSession
    t = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.when(F.col("text").isNotNull(), F.unhex(F.md5("text"))).alias("link"))
    base = materialize(base.withColumn("__id", F.struct("doc_id", "text_crc32", "size")), "shard-rows")
    # Rows alike in all of it are told apart by a number among themselves.
    base = materialize(base.withColumn("__id", F.struct("__id", F.row_number().over(Window.partitionBy("__id").orderBy("__id")).alias("k"))), "shard-rows")
    total = base.count()
    caps = [total // shards + (i < total % shards) for i in range(shards)]
    linked = base.where("link is not null").join(base.where("link is not null").groupBy("link").agg(F.count("*").alias("n")).where("n > 1").select("link"), "link", "left_semi")
    state = propagate(linked.select("__id", "link"), shards, caps, rounds, slack)
    limit = F.array(*[F.lit(c) for c in caps])
    kept = materialize(ranked(state, ["label"], F.xxhash64("link")).withColumn("stays", F.col("__rank") < F.get(limit, F.col("label"))).select("__id", "label", "stays"), "shard-kept")
    loads = dict(kept.where("stays").groupBy("label").count().collect())
    ends, end = [], 0
    for i, c in enumerate(caps):
        end += c - loads.get(i, 0)
        ends.append(end)
    placed = kept.where("stays").select("__id", F.col("label").alias("shard"))
    rest = base.join(placed, "__id", "left_anti").select("__id", "link").withColumn("__all", F.lit(0))
    fill = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("__rank"))).cast("int")
    rest = ranked(rest, ["__all"], F.xxhash64("link", "__all")).select("__id", fill.alias("shard"))
    out = base.join(placed.unionByName(rest), "__id")
    out = ranked(out, ["shard"], F.xxhash64("__id"), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
