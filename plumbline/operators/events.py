"""Filings, earnings distances, insider activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.windows import clean_ticker, day_of, unstacked

# Forms that report a period, and those that report an event; symbols that mean there is none.
PERIODIC, CURRENT = ("10-K", "10-K/A", "10-Q", "10-Q/A"), ("8-K", "8-K/A")
NO_SYMBOL = ("", "NONE", "N/A", "NA", "NULL")


def is_earnings(form: Column, items: Column) -> Column:
    return form.isin(*PERIODIC) | (form.isin(*CURRENT) & F.array_contains(F.split(items, ","), "2.02"))


_BLOCK = "form array<string>, filingDate array<string>, accessionNumber array<string>, items array<string>"


def flatten_submissions(raw: DataFrame) -> DataFrame:
    """ticker, payload to one row a filing. A payload holds parallel arrays, of the recent filings or, in further pages, at its top; short item lists are padded with ''."""
    recent = F.from_json("payload", f"filings struct<recent struct<{_BLOCK}>>").getField("filings").getField("recent")
    page = F.from_json("payload", _BLOCK)
    d = raw.select("ticker", F.explode(F.array(recent, page)).alias("r"))
    rows = F.arrays_zip(*[F.col(f"r.{c}").alias(c) for c in ("form", "filingDate", "accessionNumber", "items")])
    d = d.select("ticker", F.inline(rows)).where("accessionNumber is not null")
    return d.select("ticker", F.expr("try_cast(filingDate as date)").alias("report_date"), "form", F.col("accessionNumber").alias("accession"), F.coalesce("items", F.lit("")).alias("items"))


def upcoming(calendar: DataFrame, as_of: str) -> DataFrame:
    """ticker, report_date of announced dates on or after as_of, each once."""
    return calendar.select("ticker", F.to_date("report_date").alias("report_date")).where(F.col("report_date") >= F.lit(as_of).cast("date")).distinct()


def earnings_dates(filings: DataFrame, window: int = 60) -> DataFrame:
    """Earnings filings, one per accession; periodic ones only if no 8-K came in the window before (same day counts)."""
    one = Window.partitionBy("ticker", "accession").orderBy("report_date", "form")
    d = filings.where(is_earnings(F.col("form"), F.col("items"))).withColumn("__r", F.row_number().over(one)).where("__r = 1").drop("__r")
    d = d.withColumn("is_8k", F.col("form").isin(*CURRENT))
    seen = Window.partitionBy("ticker").orderBy("report_date", F.desc("is_8k"), "accession").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("is_8k"), F.col("report_date"))).over(seen)
    return d.withColumn("last_8k", last).where(F.col("is_8k") | F.col("last_8k").isNull() | (F.datediff("report_date", "last_8k") > window)).drop("last_8k")


def merge_calendars(past: DataFrame, coming: DataFrame) -> DataFrame:
    """One row per (ticker, report_date); the past calendar wins."""
    both = past.select("ticker", "report_date", F.lit("filing").alias("source"), "form", F.lit(0).alias("p")).unionByName(coming.select("ticker", "report_date", F.lit("calendar").alias("source"), F.lit(None).cast("string").alias("form"), F.lit(1).alias("p")))
    w = Window.partitionBy("ticker", "report_date").orderBy("p", "form")
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "p")


def earnings_distance(panel: DataFrame, dates: DataFrame, cap: int = 90) -> DataFrame:
    """Days to the next event (on the day counts) and since the last one (strictly before), and the drift flag. Rows and events are stacked once, which is dealt by ticker and read in both directions."""
    e = dates.select("ticker", F.col("report_date").alias("date")).where("date is not null").distinct()
    kind = panel.select(F.struct("*").alias("row")).schema["row"].dataType
    both = e.select("ticker", "date", F.col("date").alias("__event"), F.lit(None).cast(kind).alias("row")).unionByName(panel.select("ticker", "date", F.lit(None).cast("date").alias("__event"), F.struct("*").alias("row")))
    key, is_event = Window.partitionBy("ticker"), F.col("row").isNull()
    upto = lambda *order: key.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # The next event on or after a day is the last one before it once time runs backwards; what is read last leaves the rows in the order of time.
    d = both.withColumn("__next", F.last("__event", ignorenulls=True).over(upto(F.desc("date"), is_event.desc())))
    d = d.withColumn("__last", F.last("__event", ignorenulls=True).over(upto("date", is_event))).where("row is not null")
    d = d.select(*unstacked(panel, "row", {"ticker": "ticker", "date": "date"}), "__last", "__next")
    since = F.datediff("date", "__last")
    return d.withColumns({
        "days_to_earnings": F.when(F.col("__next").isNotNull() & F.col("date").isNotNull(), F.least(F.datediff("__next", "date"), F.lit(cap))),
        "days_since_earnings": F.when(F.col("__last").isNotNull(), F.least(since, F.lit(cap))),
        "post_earnings_drift_window": F.coalesce(since.between(1, 5), F.lit(False)).cast("int"),
    }).drop("__last", "__next")


def insider_trades(submissions: DataFrame, trades: DataFrame) -> DataFrame:
    """Direct purchases and sales on forms 4, joined by accession and freed of duplicates. Dates are text like 31-OCT-2025.

    submissions: ACCESSION_NUMBER, FILING_DATE, DOCUMENT_TYPE, ISSUERTRADINGSYMBOL. trades: ACCESSION_NUMBER,
    TRANS_DATE, TRANS_CODE, TRANS_SHARES, TRANS_PRICEPERSHARE, DIRECT_INDIRECT_OWNERSHIP.
    """
    s = submissions.where(F.col("DOCUMENT_TYPE").isin("4", "4/A")).select("ACCESSION_NUMBER", clean_ticker(F.upper("ISSUERTRADINGSYMBOL")).alias("ticker"), day_of(F.col("FILING_DATE")).alias("filing_date"))
    s = s.where(~F.col("ticker").isin(*NO_SYMBOL) & F.col("filing_date").isNotNull())
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} as double)"), F.lit(0.0))
    t = trades.where(F.col("TRANS_CODE").isin("P", "S") & (F.col("DIRECT_INDIRECT_OWNERSHIP") == "D"))
    t = t.select("ACCESSION_NUMBER", day_of(F.col("TRANS_DATE")).alias("transaction_date"), F.col("TRANS_CODE").alias("transaction_code"), number("TRANS_SHARES").alias("shares"), number("TRANS_PRICEPERSHARE").alias("price_per_share"))
    d = s.join(t, "ACCESSION_NUMBER").dropDuplicates(["ticker", "filing_date", "transaction_date", "transaction_code", "shares", "price_per_share"])
    return d.select("ticker", "filing_date", "transaction_date", "transaction_code", "shares", "price_per_share", F.round(F.col("shares") * F.col("price_per_share"), 2).alias("value"))


def trade_counts(trades: DataFrame, tickers: list[str] | None = None) -> DataFrame:
    """Rows of each ticker, or of those named."""
    d = trades.where(F.col("ticker").isin(*tickers)) if tickers else trades
    return d.groupBy("ticker").agg(F.count("*").alias("n"))


def insider_days(trades: DataFrame) -> DataFrame:
    """Trades added up by ticker and day of filing: purchases b, sales s, net value v, p the day if anything was bought."""
    buy = F.col("transaction_code") == "P"
    v = F.col("value").cast("decimal(18,2)")
    return trades.groupBy("ticker", F.col("filing_date").alias("date")).agg(F.count_if(buy).alias("b"), F.count_if(~buy).alias("s"), F.sum(F.when(buy, v).otherwise(-v)).alias("v"), F.max(F.when(buy, F.col("filing_date"))).alias("p"))


def activity_of_days(panel: DataFrame, days: DataFrame, window: int = 60, cap: int = 365) -> DataFrame:
    """Counts and net value over (D - window, D] and days since the last purchase, from totals by ticker and day."""
    kind = panel.select(F.struct("*").alias("row")).schema["row"].dataType
    zero = {"b": F.lit(0).cast("long"), "s": F.lit(0).cast("long"), "v": F.lit(0).cast("decimal(28,2)"), "p": F.lit(None).cast("date")}
    both = days.withColumn("row", F.lit(None).cast(kind)).unionByName(panel.select("ticker", "date", F.struct("*").alias("row")).withColumns(zero))
    both = both.withColumn("n", F.datediff("date", F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy("ticker").orderBy("n")
    near, all_ = w.rangeBetween(1 - window, 0), w.rangeBetween(Window.unboundedPreceding, 0)
    d = both.withColumns({"b60": F.sum("b").over(near), "s60": F.sum("s").over(near), "v60": F.sum("v").over(near), "lastp": F.max("p").over(all_)}).where("row is not null")
    return d.select(*unstacked(panel, "row", {"ticker": "ticker"}), F.col("b60").alias("insider_buy_count_60d"), F.col("s60").alias("insider_sell_count_60d"), F.col("v60").cast("double").alias("insider_net_dollar_60d"), F.when(F.col("lastp").isNotNull(), F.least(F.datediff(F.col("date"), F.col("lastp")), F.lit(cap))).alias("days_since_last_insider_buy"))


def insider_activity(panel: DataFrame, trades: DataFrame, window: int = 60, cap: int = 365) -> DataFrame:
    """activity_of_days of trades: they are added up first, so that a busy ticker's window holds a row a day."""
    return activity_of_days(panel, insider_days(trades), window, cap)
