"""Ranking metrics and portfolio analytics, all shifted starts at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scratch import written
from plumbline.functions.windows import pct_rank
from plumbline.operators.fundamentals import QUALITY, passes


def rank_metrics(scored: DataFrame, y: str, p: str, n: int, by: tuple[str, ...] = ("split",)) -> DataFrame:
    """rmse, ic, decile_spread, topn_mean and topn_sharpe for each group."""
    d = scored.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    day = Window.partitionBy(*by, "date")
    d = d.withColumns({"__ry": pct_rank(y, *by, "date"), "__rp": pct_rank(p, *by, "date"), "__up": F.row_number().over(day.orderBy(F.col(p).desc(), "ticker")), "__n": F.count("*").over(day)})
    d = d.withColumn("__down", F.col("__n") - F.col("__up") + 1).withColumn("__k", F.floor(F.col("__n") / 10))
    mean = lambda cond: F.avg(F.when(cond, F.col(y)))
    per = d.groupBy(*by, "date").agg(
        (F.covar_samp("__ry", "__rp") / F.nullif(F.stddev_samp("__ry") * F.stddev_samp("__rp"), F.lit(0.0))).alias("ic"),
        F.when(F.max("__n") >= 10, mean(F.col("__up") <= F.col("__k")) - mean(F.col("__down") <= F.col("__k"))).alias("spread"),
        F.when(F.max("__n") >= n, mean(F.col("__up") <= n)).alias("top"), F.sum(F.pow(F.col(y) - F.col(p), 2)).alias("se"), F.count("*").alias("n"),
    )
    sd = F.stddev_samp("top")
    return per.groupBy(*by).agg(F.sqrt(F.sum("se") / F.sum("n")).alias("rmse"), F.avg("ic").alias("ic"), F.avg("spread").alias("decile_spread"), F.avg("top").alias("topn_mean"), F.when(F.count("top") >= 2, F.when(sd > 0, F.avg("top") / F.nullif(sd, F.lit(0.0))).otherwise(0.0)).alias("topn_sharpe"))


def top_picks(scored: DataFrame, n: int, score: str = "predicted_return") -> DataFrame:
    w = Window.partitionBy("date").orderBy(F.col(score).desc_nulls_last(), "ticker")
    return scored.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)


def weighted(picks: DataFrame, mode: str = "equal", score: str = "predicted_return") -> DataFrame:
    day = Window.partitionBy("date")
    equal = 1 / F.count("*").over(day)
    if mode == "equal":
        return picks.withColumn("weight", equal)
    if mode != "pred":
        raise ValueError(f"unknown weighting: {mode}")
    p = F.greatest(F.coalesce(F.col(score), F.lit(0.0)), F.lit(0.0))
    total = F.sum(p).over(day)
    return picks.withColumn("weight", F.when(total > 0, p / F.nullif(total, F.lit(0.0))).otherwise(equal))


def exposure(vol, target: float = 0.20):
    return F.when(vol.isNull() | (vol <= 0), 1.0).otherwise(F.least(F.lit(1.0), target / F.nullif(vol, F.lit(0.0))))


def backtest(panel: DataFrame, market: DataFrame, n: int = 40, hold: int = 21, cost: float = 0.0005, target: float = 0.20, mode: str = "equal", eligible: Column | None = None) -> DataFrame:
    """variant, offset, date, nav, exposure, holdings for the overlay and raw variants and all shifted starts.

    panel: date, ticker, predicted_return, ret_1d of the test dates. market: date, spy_vol_20d. eligible: which rows may be picked. The day's
    return goes to the old weights; then the basket of a rebalance day replaces them and its turnover is charged.

    Each date is the rebalance day of one shifted start. So a date's basket, what it earns on each day
    that it may be held, and its turnover against the basket `hold` dates before belong to the date
    alone: they are worked out once, in tables of dates x hold rows, and the starts only pick from them.
    """
    panel = written(panel.select("date", "ticker", "predicted_return", "ret_1d", (F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))).alias("eligible")), "backtest-panel")
    # One row a date: the unpartitioned window is over the calendar, not the panel.
    dates = panel.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    dates = written(dates.join(market.select("date", "spy_vol_20d"), "date", "left").withColumn("x", exposure(F.col("spy_vol_20d"), target)).select("date", "i", "x"), "backtest-dates")
    basket = written(weighted(top_picks(panel.where("eligible"), n), mode).select("date", "ticker", "weight"), "backtest-baskets")
    # Only what a basket holds once matters from here on: n rows a date name those tickers.
    d = panel.drop("eligible", "predicted_return").join(F.broadcast(basket.select("ticker").distinct()), "ticker", "left_semi")
    d = written(d.join(F.broadcast(dates), "date").join(basket, ["date", "ticker"], "left"), "backtest-held")
    # What a ticker returns on a day goes to those of its baskets that are still held then.
    near = Window.partitionBy("ticker").orderBy("i")
    held_by = F.collect_list(F.when(F.col("weight").isNotNull(), F.struct("i", "weight"))).over(near.rangeBetween(-hold, -1))
    earned = d.withColumn("held_by", held_by).select(F.col("i").alias("day"), F.coalesce("ret_1d", F.lit(0.0)).alias("r"), F.explode("held_by").alias("b")).groupBy(F.col("b.i").alias("at"), "day").agg(F.sum(F.col("b.weight") * F.col("r")).alias("r"))
    # A name's weight changes on a date where it is in this basket, or was in the one before.
    w = d.where("weight is not null").select("i", "ticker", "weight", "x")
    change = w.select("i", "ticker", "weight", "x", F.lit(0.0).alias("weight0"), F.lit(0.0).alias("x0")).unionByName(w.select((F.col("i") + hold).alias("i"), "ticker", F.lit(0.0).alias("weight"), F.lit(0.0).alias("x"), F.col("weight").alias("weight0"), F.col("x").alias("x0")))
    change = change.groupBy("i", "ticker").agg(*[F.sum(c).alias(c) for c in ("weight", "x", "weight0", "x0")])
    moved = lambda a, b: F.sum(F.abs(a - b))
    turnover = change.groupBy("i").agg(moved(F.col("weight"), F.col("weight0")).alias("raw"), moved(F.col("weight") * F.col("x"), F.col("weight0") * F.col("x0")).alias("overlay"))
    names = d.where("weight is not null").groupBy("i").agg(F.array_join(F.array_sort(F.collect_list("ticker")), ",").alias("holdings"))
    earned, day = written(earned, "backtest-earned"), written(dates.join(turnover, "i", "left").join(names, "i", "left"), "backtest-days")
    starts = dates.select("date", "i", F.explode(F.sequence(F.lit(0), F.lit(hold - 1))).alias("offset"))
    gone = F.pmod(F.col("i") - F.col("offset") - 1, F.lit(hold))  # dates since the day after the last rebalance
    at = F.col("i") - gone - 1
    starts = starts.withColumn("at", F.when(at >= F.col("offset"), at)).withColumn("now", F.when(F.col("i") >= F.col("offset"), F.col("i") - F.pmod(F.col("i") - F.col("offset"), F.lit(hold))))
    s = starts.join(earned.withColumnRenamed("day", "i"), ["at", "i"], "left")
    s = s.join(day.select(F.col("i").alias("at"), F.col("x").alias("held_x")), "at", "left").join(day.select(F.col("i").alias("now"), "x", "raw", "overlay", "holdings"), "now", "left")
    new, r = F.col("now") == F.col("i"), F.coalesce("r", F.lit(0.0))
    step = lambda r, turn: (1 + r) * F.when(new, 1 - F.coalesce(turn, F.lit(0.0)) * cost).otherwise(1.0)
    curve = lambda v, r, turn, x: F.struct(F.lit(v).alias("variant"), step(r, turn).alias("step"), F.when(F.col("now").isNull(), 0.0).otherwise(x).alias("exposure"))
    both = F.array(curve("overlay", r * F.coalesce("held_x", F.lit(1.0)), F.col("overlay"), F.col("x")), curve("raw", r, F.col("raw"), F.lit(1.0)))
    d = s.select("offset", "date", F.when(F.col("offset") == 0, F.coalesce("holdings", F.lit(""))).otherwise("").alias("holdings"), F.inline(both))
    w = Window.partitionBy("variant", "offset").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("variant", "offset", "date", F.product("step").over(w).alias("nav"), "exposure", "holdings")


def performance(nav: DataFrame, by: tuple[str, ...] = ("variant", "offset")) -> DataFrame:
    """cagr, vol, sharpe (cagr over vol), max_drawdown, final_nav of each curve."""
    w = Window.partitionBy(*by).orderBy("date")
    d = nav.withColumn("r", F.col("nav") / F.nullif(F.lag("nav").over(w), F.lit(0.0)) - 1).withColumn("dd", F.col("nav") / F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    s = d.groupBy(*by).agg(F.max_by("nav", "date").alias("final_nav"), F.count("r").alias("n"), (F.stddev_samp("r") * math.sqrt(252)).alias("vol"), F.min("dd").alias("max_drawdown"))
    years = F.when(F.col("n") > 0, F.col("n") / 252).otherwise(1.0)
    s = s.withColumn("cagr", F.when(F.col("final_nav") > 0, F.pow("final_nav", 1 / years) - 1).otherwise(-1.0))
    return s.select(*by, "cagr", "vol", F.when(F.col("vol") > 0, F.col("cagr") / F.nullif(F.col("vol"), F.lit(0.0))).otherwise(0.0).alias("sharpe"), "max_drawdown", "final_nav")


def offset_band(nav: DataFrame) -> DataFrame:
    return nav.groupBy("variant", "date").agg(F.avg("nav").alias("mean_nav"), F.expr("percentile(nav, 0.1)").alias("p10"), F.expr("percentile(nav, 0.9)").alias("p90"))


def buy_and_hold(market: DataFrame, start: str, end: str | None = None) -> DataFrame:
    d = market.withColumn("__m", F.lit(0)).where(F.col("date") >= start)
    d = d.where(F.col("date") <= end) if end else d
    return d.withColumn("nav", F.product(1 + F.coalesce("spy_ret_1d", F.lit(0.0))).over(Window.partitionBy("__m").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))).select("date", "nav")


def time_in_market(nav: DataFrame) -> DataFrame:
    """variant, time_in_market, avg_exposure: means over the days of each start, then over the starts. Days before a start's first basket count as out."""
    per = nav.groupBy("variant", "offset").agg(F.avg((F.col("exposure") > 0).cast("double")).alias("t"), F.avg("exposure").alias("e"))
    return per.groupBy("variant").agg(F.avg("t").alias("time_in_market"), F.avg("e").alias("avg_exposure"))


def stats_report(nav: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each variant, of the mean of its starts, and one for the benchmark, up to the last day of the variants.

    cagr, vol, sharpe, max_drawdown, final_nav, time_in_market, avg_exposure, offset_cagr_min, offset_cagr_max, end_date.
    """
    mean = nav.groupBy("variant", "date").agg(F.avg("nav").alias("nav"))
    end = nav.agg(F.max("date").alias("end_date"))
    clipped = benchmark.crossJoin(F.broadcast(end)).where(F.col("date") <= F.col("end_date")).select(F.lit("benchmark").alias("variant"), "date", "nav")
    stats = performance(mean.unionByName(clipped), by=("variant",))
    starts = performance(nav).groupBy("variant").agg(F.min("cagr").alias("offset_cagr_min"), F.max("cagr").alias("offset_cagr_max"))
    return stats.join(time_in_market(nav), "variant", "left").join(starts, "variant", "left").crossJoin(F.broadcast(end))


def nav_table(nav: DataFrame, benchmark: DataFrame) -> DataFrame:
    """date, spy, raw, overlay, overlay_p10, overlay_p90 and the names held by the starts at offset 0, for each date of either side."""
    band = offset_band(nav)
    of = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    bands = band.groupBy("date").agg(of("raw", "mean_nav").alias("raw"), of("overlay", "mean_nav").alias("overlay"), of("overlay", "p10").alias("overlay_p10"), of("overlay", "p90").alias("overlay_p90"))
    names = nav.where("offset = 0").groupBy("date").agg(of("overlay", "holdings").alias("overlay_picks"), of("raw", "holdings").alias("raw_picks"))
    return benchmark.select("date", F.col("nav").alias("spy")).join(bands, "date", "full").join(names, "date", "full")


def live_picks(scored: DataFrame, market: DataFrame, n: int = 40, mode: str = "equal", target: float = 0.20, limits: dict | None = None, score: str = "predicted_return") -> DataFrame:
    """date, ticker, score, weight of the latest scored date: quality filter, best n, weights times the exposure of the latest market row. No exposure, no picks."""
    # Which date is the latest is known once all are scored: each leaves at most n rows, those that pass the filter first, so that the scores are worked out once.
    ok = passes(scored.columns, QUALITY if limits is None else limits)
    best = Window.partitionBy("date").orderBy(F.desc("__ok"), F.desc(score), "ticker")
    d = scored.where(F.col(score).isNotNull()).select("date", "ticker", score, ok.alias("__ok"))
    d = written(d.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= max(n, 1)), "best-by-date")
    today = d.join(F.broadcast(d.agg(F.max("date").alias("date"))), "date", "left_semi").where("__ok")
    now = market.agg(F.max_by("spy_vol_20d", "date").alias("vol")).select(exposure(F.col("vol"), target).alias("__x"))
    p = weighted(top_picks(today, n, score), mode, score).crossJoin(F.broadcast(now)).where("__x > 0")
    return p.select("date", "ticker", score, (F.col("weight") * F.col("__x")).alias("weight"))


def basket_mean(picks: DataFrame, score: str = "predicted_return") -> DataFrame:
    return picks.groupBy("date").agg(F.count("*").alias("n"), F.avg(score).alias("mean_prediction"))


def picks_before(picks: DataFrame, day: str | None = None) -> DataFrame:
    """The picks of the latest date strictly before a day (by default before the picks' own latest)."""
    dates = picks.select("date").distinct()
    edge = F.lit(day).cast("date") if day else None
    if edge is None:
        last = dates.agg(F.max("date").alias("__last"))
        dates = dates.crossJoin(F.broadcast(last)).where("date < __last")
    else:
        dates = dates.where(F.col("date") < edge)
    return picks.join(F.broadcast(dates.agg(F.max("date").alias("date"))), "date", "left_semi")


def filter_hits(df: DataFrame, limits: dict | None = None) -> DataFrame:
    """n_before, n_after of the quality filter and the share it drops, in one pass."""
    kept = passes(df.columns, QUALITY if limits is None else limits)
    d = df.agg(F.count("*").alias("n_before"), F.count_if(kept).alias("n_after"))
    return d.withColumn("dropped", (F.col("n_before") - F.col("n_after")) / F.nullif(F.col("n_before"), F.lit(0)))


def picks_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    b, a = before.select("ticker", F.lit(1).alias("b")), after.select("ticker", F.lit(1).alias("a"))
    return b.join(a, "ticker", "full").select("ticker", F.when(F.col("a").isNull(), "SELL").when(F.col("b").isNull(), "BUY").otherwise("HOLD").alias("action"))


def stability(importance: DataFrame, seeds: list[int]) -> DataFrame:
    """Importance by feature and seed: mean, spread, how often zero, and whether it is zero for all seeds."""
    d = importance.groupBy("feature").pivot("seed", seeds).agg(F.first("importance"))
    s = importance.groupBy("feature").agg(F.avg("importance").alias("mean"), F.stddev_samp("importance").alias("std"), F.count_if(F.col("importance") == 0).alias("zero_count"), F.count("*").alias("n"))
    return d.join(s, "feature").withColumn("drop", F.col("zero_count") == F.col("n")).drop("n")
