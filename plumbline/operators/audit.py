"""No-lookahead audit: features recomputed from history cut at a sampled date must be the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scratch import written
from plumbline.operators.membership import seeded_keys


class LookaheadError(ValueError):
    """A feature changes once later rows are gone."""


def lookahead_pairs(bars: DataFrame, market: DataFrame, compute: Callable[[DataFrame, DataFrame, tuple[str, ...]], DataFrame], columns: list[str], n: int = 20, seed: int = 7, start: str = "1900-01-01", tol: float = 1e-6, keys: DataFrame | None = None) -> DataFrame:
    """ticker, date, feature, full, cut, same: each sampled value beside the one computed from bars and market up to its date.

    compute(bars, market, keys) gives features by `ticker` and `date`; market has one row a date (and keys). A date without a market row is skipped. Two nulls are the same, one isn't.
    keys: ticker and date of each bar, perhaps repeated, where that costs less than the bars. Sampled tickers are named to the bars, so that
    the bars of others are left out where their rows are read.
    """
    market = written(market, "audit-market")  # a row a date
    trading = market.where("spy_close is not null").select("date")
    keys = (bars if keys is None else keys).where(F.col("date") >= start)
    picked = written(seeded_keys(keys.join(F.broadcast(trading), "date", "left_semi"), n, seed), "audited")  # n rows
    bars = bars.where(F.col("ticker").isin([r["ticker"] for r in picked.select("ticker").distinct().collect()]))
    full = compute(bars, market, ()).select("ticker", "date", *columns)
    # Each sample becomes a ticker of its own with a market of its own, both cut at its date, so that all are recomputed in one job.
    at = F.broadcast(picked.select("ticker", F.col("date").alias("cut_date")))
    cut = bars.join(at, "ticker").where("date <= cut_date").withColumn("ticker", F.concat_ws("@", "ticker", "cut_date"))
    early = market.join(F.broadcast(picked.select(F.col("date").alias("cut_date")).distinct()), F.col("date") <= F.col("cut_date"))
    again = compute(cut, early, ("cut_date",))
    again = again.where("date = cut_date").select(F.split("ticker", "@")[0].alias("ticker"), "date", *columns)
    long = lambda d, v: d.unpivot(["ticker", "date"], columns, "feature", v)
    both = long(full.join(F.broadcast(picked), ["ticker", "date"], "left_semi"), "full").join(long(again, "cut"), ["ticker", "date", "feature"], "left")
    same = (F.col("full").isNull() & F.col("cut").isNull()) | F.coalesce(F.abs(F.col("full") - F.col("cut")) <= tol + tol * F.abs("full"), F.lit(False))
    return both.withColumn("same", same)


def lookahead_summary(pairs: DataFrame) -> DataFrame:
    """feature, n_compared, n_values (not null), n_mismatched."""
    return pairs.groupBy("feature").agg(F.count("*").alias("n_compared"), F.count("full").alias("n_values"), F.count_if(~F.col("same")).alias("n_mismatched"))


def require_no_lookahead(pairs: DataFrame) -> None:
    """Raises LookaheadError with the features that look ahead."""
    if bad := lookahead_summary(pairs).where("n_mismatched > 0").orderBy("feature").collect():
        raise LookaheadError(", ".join(f"{r.feature}: {r.n_mismatched} of {r.n_compared}" for r in bad))


#: When a row of each dated input became known. Splits aren't cut, as prices are adjusted for all of them; nor are sectors, which have no date.
KNOWN_FROM = {"bars": "date", "market": "date", "members": "date", "earnings": "report_date", "trades": "filing_date", "facts": "filed", "macro": "date"}
#: Columns that tell the future by what is scheduled.
SCHEDULED = ("days_to_earnings",)


def panel_pairs(inputs: dict[str, DataFrame], dates: list, compute: Callable[..., DataFrame], columns: list[str], tol: float = 1e-6, told: bool = False) -> DataFrame:
    """ticker, date, feature, full, cut, same: every row of the dates, from all inputs and from inputs cut at what was known on that date.

    compute(**inputs) gives the panel. All tickers of a date are computed again, so ranks and sector means are compared too. A date is a job of its own.
    told: compute is told the `days` whose rows are wanted, so that it can leave out what these don't need.
    """
    wanted = (lambda days: {"days": days}) if told else (lambda days: {})
    full = compute(**inputs, **wanted(dates)).where(F.col("date").isin(dates)).select("ticker", "date", *columns)
    again = None
    for day in dates:
        known = {k: d.where(F.col(KNOWN_FROM[k]) <= F.lit(day)) if k in KNOWN_FROM else d for k, d in inputs.items()}
        rows = written(compute(**known, **wanted([day])).where(F.col("date") == F.lit(day)).select("ticker", "date", *columns), "cut-panel")
        again = rows if again is None else again.unionByName(rows)
    if again is None:
        again = full.limit(0)
    long = lambda d, v: d.select("ticker", "date", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["ticker", "date"], columns, "feature", v).withColumn(f"__{v}", F.lit(True))
    both = long(full, "full").join(long(again, "cut"), ["ticker", "date", "feature"], "full")
    value = (F.col("full").isNull() & F.col("cut").isNull()) | F.coalesce(F.abs(F.col("full") - F.col("cut")) <= tol + tol * F.abs("full"), F.lit(False))
    return both.withColumn("same", value & F.col("__full").isNotNull() & F.col("__cut").isNotNull()).drop("__full", "__cut")
