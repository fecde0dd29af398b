"""Point-in-time membership, sectors, labels, splits of time."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scratch import written
from plumbline.functions.windows import by_key, clean_ticker, pct_rank, pct_ranks


def intervals(membership: DataFrame) -> DataFrame:
    """ticker, start, end (null: open) for each run of consecutive snapshots that list it."""
    dates = membership.select("date").distinct()
    snaps = dates.select("date", F.row_number().over(Window.orderBy("date")).alias("k"), F.lead("date").over(Window.orderBy("date")).alias("next"))
    d = membership.distinct().join(F.broadcast(snaps), "date").withColumn("island", F.col("k") - F.row_number().over(by_key()))
    last = F.max_by("next", "k")
    return d.groupBy("ticker", "island").agg(F.min("date").alias("start"), F.date_sub(last, 1).alias("end")).drop("island")


def filter_members(panel: DataFrame, membership: DataFrame) -> DataFrame:
    """Rows whose ticker is in the snapshot in force on their date."""
    i = intervals(membership).withColumnRenamed("ticker", "__t")
    return panel.join(i, (F.col("ticker") == F.col("__t")) & (F.col("date") >= F.col("start")) & (F.col("end").isNull() | (F.col("date") <= F.col("end"))), "left_semi")


def members_on(membership: DataFrame, day: str) -> DataFrame:
    latest = membership.where(F.col("date") <= F.lit(day).cast("date")).agg(F.max("date").alias("date"))
    return membership.join(F.broadcast(latest), "date", "left_semi").select("ticker").distinct()


def tickers_since(membership: DataFrame, since: str) -> DataFrame:
    return membership.where(F.col("date") >= F.lit(since).cast("date")).select("ticker").distinct()


def from_lists(lists: DataFrame) -> DataFrame:
    """date, tickers (comma list of all members from that date on) to one row a member; codes as `clean_ticker` writes them."""
    return lists.select("date", F.explode(F.split("tickers", ",")).alias("ticker")).select("date", clean_ticker(F.col("ticker")).alias("ticker")).where("ticker <> ''").distinct()


def append_snapshot(membership: DataFrame, today: DataFrame, day: str) -> DataFrame:
    """membership (date, ticker, synthetic) with today's tickers as a synthetic snapshot of that day, if the day is past the last authoritative one.

    A snapshot that is already there for that day, from an earlier run, is replaced; synthetic ones of other days stay.
    """
    d = F.lit(day).cast("date")
    late = membership.agg(F.coalesce(F.max(F.when(~F.col("synthetic"), F.col("date"))) < d, F.lit(True)).alias("late"))
    marked = membership.select("date", "ticker", "synthetic").crossJoin(F.broadcast(late))
    new = today.select(d.alias("date"), clean_ticker(F.col("ticker")).alias("ticker"), F.lit(True).alias("synthetic")).distinct().crossJoin(F.broadcast(late))
    return marked.where(~F.col("late") | (F.col("date") != d)).unionByName(new.where("late")).drop("late")


def sector_dimension(raw: DataFrame, as_of: str) -> DataFrame:
    """The scraped roster (Symbol, Security, GICS Sector, GICS Sub-Industry, more) as ticker, security, gics_sector, gics_sub_industry, as_of."""
    return raw.select(clean_ticker(F.col("Symbol")).alias("ticker"), F.col("Security").alias("security"), F.col("GICS Sector").alias("gics_sector"), F.col("GICS Sub-Industry").alias("gics_sub_industry"), F.lit(as_of).cast("date").alias("as_of"))


def cik_map(raw: DataFrame) -> DataFrame:
    """payload: a JSON object of numbered entries {cik_str, ticker}. ticker and its ten-digit cik; of a ticker's entries the first wins."""
    entries = raw.select(F.explode(F.from_json("payload", "map<string, struct<cik_str: string, ticker: string>>")).alias("no", "e"))
    d = entries.select(F.expr("try_cast(no as int)").alias("no"), clean_ticker(F.upper("e.ticker")).alias("ticker"), F.lpad("e.cik_str", 10, "0").alias("cik"))
    w = Window.partitionBy("ticker").orderBy("no", "cik")
    return d.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("ticker", "cik")


def summary(membership: DataFrame) -> DataFrame:
    """n_snapshots, n_synthetic, n_tickers, first_date, last_date and the size of the latest snapshot."""
    dates = membership.groupBy("date").agg(F.count("*").alias("n"), F.max("synthetic").alias("synthetic"))
    d = dates.agg(F.count("*").alias("n_snapshots"), F.count_if("synthetic").alias("n_synthetic"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max_by("n", "date").alias("n_latest"))
    return d.crossJoin(F.broadcast(membership.agg(F.countDistinct("ticker").alias("n_tickers"))))


def with_sector(panel: DataFrame, sectors: DataFrame) -> DataFrame:
    return panel.join(sectors.select("ticker", "gics_sector"), "ticker", "left").withColumn("gics_sector", F.coalesce("gics_sector", F.lit("Unknown")))


def sector_relative(panel: DataFrame) -> DataFrame:
    w = Window.partitionBy("date", "gics_sector")
    r = lambda n: F.col(f"ret_{n}d") - F.avg(f"ret_{n}d").over(w)
    return panel.withColumns({"excess_ret_5d_vs_sector": r(5), "excess_ret_21d_vs_sector": F.when(F.col("gics_sector") != "Unknown", r(21))})


def ranks(panel: DataFrame, columns: list[str]) -> DataFrame:
    return panel.withColumns({f"{c}_rank": pct_rank(c, "date") for c in columns})


def ranks_of_dates(panel: DataFrame, columns: list[str]) -> DataFrame:
    """ranks of numbers, of rows that are dealt by date: a date is sorted once, and its columns are ranked one by one as arrays, so that wide rows aren't sorted again for each."""

    def ranked(rows: pa.Table) -> pa.Table:
        for c in columns:
            rows = rows.append_column(f"{c}_rank", pct_ranks(rows.column(c)))
        return rows

    kinds = [*[f"`{c}` {t}" for c, t in panel.dtypes], *[f"`{c}_rank` double" for c in columns]]
    return panel.groupBy("date").applyInArrow(ranked, ", ".join(kinds))


#: A forward return beyond it is cut off there.
CLIP = 0.5


def clipped(x: Column, clip: float = CLIP) -> Column:
    """x within both limits; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(clip)), F.lit(-clip)))


def label(panel: DataFrame, horizon: int = 21, clip: float = CLIP) -> DataFrame:
    """Forward return over the ticker's panel rows: shift (unless the panel holds `future_close`), drop, clip, then less its date's mean (that of the clipped returns; the panel may hold it as `future_mean`)."""
    future = F.col("future_close") if "future_close" in panel.columns else F.lead("close", horizon).over(by_key())
    d = panel.withColumn("forward_21d_return", future / F.col("close") - 1).drop("future_close").where("forward_21d_return is not null")
    d = d.withColumn("clipped", F.abs("forward_21d_return") > clip).withColumn("forward_21d_return", clipped(F.col("forward_21d_return"), clip))
    mean = F.col("future_mean") if "future_mean" in panel.columns else F.avg("forward_21d_return").over(Window.partitionBy("date"))
    return d.withColumn("forward_21d_return_demeaned", F.col("forward_21d_return") - mean).drop("future_mean")


def time_split(panel: DataFrame, train_end: str = "1998-12-31", test_start: str = "2000-01-01", test_end: str | None = None) -> DataFrame:
    """`split`: train, val or test; rows after test_end belong to none and go."""
    d = panel.where(F.col("date") <= test_end) if test_end else panel
    return d.withColumn("split", F.when(F.col("date") <= train_end, "train").when(F.col("date") < test_start, "val").otherwise("test"))


def matrix(panel: DataFrame, features: list[str], target: str) -> DataFrame:
    """The feature columns and the target `y`, row by row."""
    return panel.select(*features, F.col(target).alias("y"))


def tail(panel: DataFrame, ticker: str, n: int = 5) -> DataFrame:
    """The last n rows of one ticker."""
    return panel.where(F.col("ticker") == ticker).orderBy(F.desc("date")).limit(n)


def valid_rows(panel: DataFrame, required: list[str], start: str | None = None) -> DataFrame:
    d = panel.dropna(subset=required)
    return d.where(F.col("date") >= start) if start else d


def coverage(bars: DataFrame, as_of: str, least: int = 500, held: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Rows, last date and state of each ticker after a refresh.

    held: the bars before it; wanted: the tickers asked for. failed: no bars; short: fewer than `least`;
    fresh: held bars end a day before as_of at most, or nothing came; updated: held bars got later ones; new: nothing was held.
    Without held, a ticker whose last bar is older than that is stale.
    """
    d = bars.groupBy("ticker").agg(F.count("*").alias("n_rows"), F.max("date").alias("last_date"))
    if wanted is not None:
        d = wanted.select("ticker").distinct().join(d, "ticker", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    edge = F.date_sub(F.lit(as_of).cast("date"), 1)
    lacking = F.when(F.col("n_rows") == 0, "failed").when(F.col("n_rows") < least, "short")
    if held is None:
        return d.withColumn("status", lacking.when(F.col("last_date") >= edge, "fresh").otherwise("stale"))
    d = d.join(held.groupBy("ticker").agg(F.max("date").alias("held_to")), "ticker", "left")
    state = lacking.when(F.col("held_to").isNull(), "new").when((F.col("held_to") >= edge) | (F.col("last_date") <= F.col("held_to")), "fresh").otherwise("updated")
    return d.withColumn("status", state).drop("held_to")


def staleness(panel: DataFrame, as_of: str, most: int = 7) -> DataFrame:
    """last_date, days_old and whether that is more than `most` days."""
    d = panel.agg(F.max("date").alias("last_date")).withColumn("days_old", F.datediff(F.lit(as_of).cast("date"), "last_date"))
    return d.withColumn("stale", F.col("days_old") > most)


def with_history(bars: DataFrame, least: int = 500) -> DataFrame:
    return bars.withColumn("__n", F.count("*").over(Window.partitionBy("ticker"))).where(F.col("__n") >= least).drop("__n")


def merge_tail(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both, with the later delivery winning per key."""
    both = old.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("__batch"), *[F.col(c) for c in old.columns if c not in keys])
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__batch")


def null_counts(df: DataFrame, top: int = 10) -> DataFrame:
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column", "n_null").orderBy(F.desc("n_null"), "column").limit(top)


def seeded_sample(df: DataFrame, n: int, seed: int, keys: tuple[str, ...] = ("ticker", "date")) -> DataFrame:
    """n rows, the same on each run: those of lowest MD5 of key and seed."""
    return df.orderBy(_mark(seed, keys), *keys).limit(n)


def _mark(seed: int, keys: tuple[str, ...]) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def seeded_keys(rows: DataFrame, n: int, seed: int, keys: tuple[str, ...] = ("ticker", "date")) -> DataFrame:
    """seeded_sample of the distinct keys of rows, in which a key may stand often.

    Only keys with an MD5 below a bound are brought together. The bound lets some 64 rows through for each key that is wanted;
    where these hold too few keys it rises, at last over all.
    """
    rows = rows.select(*keys)
    part = 64 * n / max(rows.count(), 1)
    while part < 1:
        low = written(rows.where(_mark(seed, keys) < f"{int(part * (1 << 32)):08x}").distinct(), "low-keys")
        if low.count() >= n:
            return seeded_sample(low, n, seed, keys)
        part *= 16
    return seeded_sample(rows.distinct(), n, seed, keys)
