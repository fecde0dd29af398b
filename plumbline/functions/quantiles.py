"""Exact quantiles by distributed selection: no task sees or sorts all values of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scratch import written

#: Ranges that a cell is cut into in each round.
RANGES = 4096


def exact_quantiles(df: DataFrame, x: str, qs: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """by, q and value: the quantile q of column x of each group, between the two nearest values by proportion.

    A round counts the values of a cell (at first all of a group) in RANGES ranges, and goes on with those
    ranges that hold a wanted rank, by their own lowest and highest value, until these are the same. Nulls
    and NaN don't count; a group without values has no row. df is read once for each round: hand over a written table.
    """
    g, v = [f"__{c}" for c in by], F.col("__x")
    d = df.select(*[F.col(c).alias(k) for c, k in zip(by, g, strict=True)], F.col(x).cast("double").alias("__x")).where(v.isNotNull() & ~F.isnan(v))
    total = d.groupBy(*g).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).where("n > 0")
    q = F.explode(F.array(*[F.lit(float(p)) for p in qs]))
    at = total.select(*g, "n", "lo", "hi", q.alias("q")).withColumn("pos", F.col("q") * (F.col("n") - 1))
    at = written(at.select(*g, "lo", "hi", "q", F.floor("pos").alias("down"), F.ceil("pos").alias("up"), (F.col("pos") - F.floor("pos")).alias("share")), "quantile-ranks")
    rank = F.explode(F.array_distinct(F.array("down", "up")))
    open_ = at.select(*g, "lo", "hi", rank.alias("rank")).distinct().withColumn("left", F.col("rank"))
    done = None
    while True:
        open_ = written(open_, "quantile-open")
        now = open_.where("lo = hi").select(*g, "rank", F.col("lo").alias("value"))
        done = now if done is None else done.unionByName(now)
        open_ = open_.where("lo < hi")
        if open_.limit(1).count() == 0:
            break
        # Cells of a group don't overlap; without groups there are two for each quantile at most.
        cells = open_.select(*[F.col(k).alias(f"{k}c") for k in g], "lo", "hi").distinct()
        same = [F.col(k).eqNullSafe(F.col(f"{k}c")) for k in g]
        inside = (v >= F.col("lo")) & (v <= F.col("hi"))
        for s in same:
            inside = inside & s
        part = F.least(F.floor((v / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * RANGES), F.lit(RANGES - 1))
        held = d.join(cells if by else F.broadcast(cells), inside).groupBy(*g, "lo", "hi", part.alias("part")).agg(F.count("*").alias("c"), F.min(v).alias("low"), F.max(v).alias("high"))
        upto = F.sum("c").over(Window.partitionBy(*g, "lo", "hi").orderBy("part"))
        held = held.withColumn("upto", upto).withColumnsRenamed({k: f"{k}h" for k in [*g, "lo", "hi"]})
        on = (F.col("left") >= F.col("upto") - F.col("c")) & (F.col("left") < F.col("upto"))
        for k in [*g, "lo", "hi"]:
            on = on & F.col(k).eqNullSafe(F.col(f"{k}h"))
        open_ = open_.join(held, on).select(*g, "rank", F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("left") - F.col("upto") + F.col("c")).alias("left"))
    out = at
    for name in ("down", "up"):
        found = done.select(*[F.col(k).alias(f"{k}f") for k in g], F.col("rank").alias(f"{name}f"), F.col("value").alias(f"v_{name}"))
        on = F.col(name) == F.col(f"{name}f")
        for k in g:
            on = on & F.col(k).eqNullSafe(F.col(f"{k}f"))
        out = out.join(found, on).drop(f"{name}f", *[f"{k}f" for k in g])
    value = F.col("v_down") + (F.col("v_up") - F.col("v_down")) * F.col("share")
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, g, strict=True)], "q", value.alias("value"))


def with_quantiles(summary: DataFrame, df: DataFrame, x: str, named: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """summary (one row for each group) with a column for each named quantile of x."""
    found = exact_quantiles(df, x, sorted(set(named.values())), by)
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("q") == p, F.col("value"))).alias(c) for c, p in named.items()])
    if not by:
        return summary.crossJoin(F.broadcast(wide))  # one row each
    on = None
    for c in by:
        s = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        on = s if on is None else on & s
    return summary.alias("a").join(wide.alias("b"), on, "left").select("a.*", *[f"b.{c}" for c in named])
