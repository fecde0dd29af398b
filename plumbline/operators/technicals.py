"""Per-ticker indicators; rows are trading rows, windows emit null until full."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.windows import by_key, ewm_mean, ewm_means, rolled, rolling

YEAR = math.sqrt(252)


def ret(n: int, x: str = "close") -> Column:
    return F.col(x) / F.lag(x, n).over(by_key()) - 1


def rolling_technicals(bars: DataFrame) -> DataFrame:
    """Returns, volatility, volume ratio, distances to means and highs, trend, z-scores, money flow."""
    c = F.col("close")
    d = bars.withColumn("log_ret", F.ln(c / F.lag("close").over(by_key()))).withColumn("typical", (F.col("high") + F.col("low") + c) / 3)
    step = F.col("typical") - F.lag("typical").over(by_key())
    flow = F.col("typical") * F.col("volume")
    d = d.withColumn("up_flow", F.when(step > 0, flow).otherwise(0.0)).withColumn("down_flow", F.when(step < 0, flow).otherwise(0.0))
    d = rolled(d, {
        **{f"__sma{n}": ("avg", "close", n) for n in (20, 50, 60, 200)}, **{f"__sd{n}": ("std", "close", n) for n in (20, 60)},
        **{f"__vol{n}": ("std", "log_ret", n) for n in (20, 60)}, "__volume20": ("avg", "volume", 20), "__high": ("max", "close", 252), "__up": ("sum", "up_flow", 14), "__down": ("sum", "down_flow", 14),
    })
    sma, up, down = {n: F.col(f"__sma{n}") for n in (20, 50, 60, 200)}, F.col("__up"), F.col("__down")
    z = lambda n: (c - sma[n]) / F.nullif(F.col(f"__sd{n}"), F.lit(0.0))
    d = d.withColumns(
        {f"ret_{n}d": ret(n) for n in (1, 5, 21, 63)}
        | {f"vol_{n}d": F.col(f"__vol{n}") * YEAR for n in (20, 60)}
        | {
            "vol_ratio": F.col("volume") / F.nullif(F.col("__volume20"), F.lit(0.0)),
            "dist_sma50": c / sma[50] - 1, "dist_sma200": c / sma[200] - 1, "dist_52w_high": c / F.col("__high") - 1,
            "trend_regime": F.coalesce(sma[50] > sma[200], F.lit(False)).cast("double"), "zscore_20d": z(20), "zscore_60d": z(60),
            "mfi_14": F.when(down > 0, 100 - 100 / (1 + up / F.nullif(down, F.lit(0.0)))).when(up > 0, 100.0),
        }
    )
    return d.drop("log_ret", "typical", "up_flow", "down_flow", *[x for x in d.columns if x.startswith("__")])


def _rsi(gain: Column, loss: Column) -> Column:
    return F.when(loss > 0, 100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0)))).when(gain > 0, 100.0)


def _gain_and_loss(df: DataFrame, x: str, key: str = "ticker") -> DataFrame:
    step = F.col(x) - F.lag(x).over(by_key(key))
    return df.withColumns({"__g": F.greatest(step, F.when(step.isNotNull(), 0.0)), "__l": F.greatest(-step, F.when(step.isNotNull(), 0.0))})


def rsi(df: DataFrame, x: str, out: str, key: str = "ticker") -> DataFrame:
    d = ewm_means(_gain_and_loss(df, x, key), {"__mg": ("__g", 1 / 14), "__ml": ("__l", 1 / 14)}, key)
    return d.withColumn(out, _rsi(F.col("__mg"), F.col("__ml"))).drop("__g", "__l", "__mg", "__ml")


def exponential_technicals(bars: DataFrame) -> DataFrame:
    """rsi_14, macd_hist and atr_pct. All means share one sort."""
    before = F.lag("close").over(by_key())
    d = _gain_and_loss(bars, "close").withColumn("__tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    d = ewm_means(d, {"__mg": ("__g", 1 / 14), "__ml": ("__l", 1 / 14), "__fast": ("close", 2 / 13), "__slow": ("close", 2 / 27), "__atr": ("__tr", 1 / 14)})
    d = ewm_mean(d.withColumn("__macd", F.col("__fast") - F.col("__slow")), "__macd", 0.2, "__signal")
    out = {"rsi_14": _rsi(F.col("__mg"), F.col("__ml")), "macd_hist": F.col("__macd") - F.col("__signal"), "atr_pct": F.col("__atr") / F.col("close")}
    return d.withColumns(out).select(*bars.columns, *out)


def technicals(bars: DataFrame) -> DataFrame:
    return exponential_technicals(rolling_technicals(bars))


def spy_returns(market: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Returns on the market's own calendar; one row per date (and keys), so the unpartitioned window is small."""
    m = market.where("spy_close is not null").withColumn("__m", F.lit(0))
    w = Window.partitionBy("__m", *keys).orderBy("date")
    r = lambda n: F.col("spy_close") / F.lag("spy_close", n).over(w) - 1
    return m.select("date", *keys, r(1).alias("spy_1d"), r(5).alias("spy_5d"), r(21).alias("spy_21d"))


def market_context(bars: DataFrame, market: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """beta_60d and excess returns; market returns are aligned to the ticker's dates by a left join.

    keys: columns by which both tables hold several calendars side by side. The market has a row a date: it is broadcast.
    """
    d = bars.join(F.broadcast(spy_returns(market, keys)), ["date", *keys], "left").withColumns({f"ret_{n}d": ret(n) for n in (1, 5, 21)})
    d = rolled(d, {"__cov": ("cov", "ret_1d", "spy_1d", 60), "__var": ("var", "spy_1d", 60)})
    beta = F.col("__cov") / F.nullif(F.col("__var"), F.lit(0.0))
    return d.withColumns({"beta_60d": beta, "excess_ret_5d": F.col("ret_5d") - F.col("spy_5d"), "excess_ret_21d": F.col("ret_21d") - F.col("spy_21d")}).drop("spy_1d", "spy_5d", "spy_21d", "__cov", "__var")


def features(bars: DataFrame, market: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """All per-ticker features."""
    return technicals(market_context(bars, market, keys))


def regime(market: DataFrame) -> DataFrame:
    """Market-wide columns by date: returns, trend, RSI, volatility index and its z-score."""
    m = market.where("spy_close is not null").withColumn("__m", F.lit("market"))
    roll = lambda agg, x, n: rolling(agg, F.col(x), n, "__m")
    m = m.withColumns({
        "spy_ret_21d": F.col("spy_close") / F.lag("spy_close", 21).over(by_key("__m")) - 1,
        "spy_trend_regime": F.coalesce(roll(F.avg, "spy_close", 50) > roll(F.avg, "spy_close", 200), F.lit(False)).cast("double"),
        "vix_level": F.col("vix_close"), "vix_zscore_20d": (F.col("vix_close") - roll(F.avg, "vix_close", 20)) / F.nullif(roll(F.stddev_samp, "vix_close", 20), F.lit(0.0)),
    })
    return rsi(m, "spy_close", "spy_rsi_14", "__m").drop("__m", "spy_close", "vix_close")


def market_frame(market: DataFrame) -> DataFrame:
    """spy_ret_1d, spy_sma200, spy_vol_20d (of simple returns) and the gate that a trend and a calm index open."""
    m = market.withColumn("__m", F.lit(0)).withColumn("spy_ret_1d", F.col("spy_close") / F.lag("spy_close").over(by_key("__m")) - 1)
    m = m.withColumn("spy_sma200", rolling(F.avg, F.col("spy_close"), 200, "__m")).withColumn("spy_vol_20d", rolling(F.stddev_samp, F.col("spy_ret_1d"), 20, "__m") * YEAR)
    return m.withColumn("gate", F.coalesce((F.col("spy_close") > F.col("spy_sma200")) & (F.col("vix_close") < 25), F.lit(False))).drop("__m")


def macro_aligned(macro: DataFrame, dates: DataFrame) -> DataFrame:
    """Spreads on trading dates; each series is carried forward, never back. macro: series, date, value ('.' is missing)."""
    wide = macro.select("series", "date", F.expr("try_cast(value as double)").alias("v")).where("v is not null").groupBy("date").pivot("series", ["BAA10Y", "DGS10", "DGS3MO", "T5YIFR"]).agg(F.first("v"))
    days = dates.select("date").distinct().withColumn("__day", F.lit(True))
    w = by_key("__m").rowsBetween(Window.unboundedPreceding, 0)
    d = wide.join(days, "date", "full").withColumn("__m", F.lit(0))
    d = d.select("date", "__day", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in ("BAA10Y", "DGS10", "DGS3MO", "T5YIFR")]).where("__day")
    return d.select("date", (F.col("DGS10") - F.col("DGS3MO")).alias("term_spread_10y3m"), F.col("BAA10Y").alias("ig_credit_spread"), F.col("T5YIFR").alias("inflation_5y5y"))
