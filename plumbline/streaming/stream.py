"""Streams of bars and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from plumbline.functions.scratch import written
from plumbline.operators import events
from plumbline.operators.membership import merge_tail
from plumbline.streaming.months import MonthTable


def upsert_bars(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that merges each micro-batch (ticker, date, delivered, more) into a MonthTable; of a key's deliveries the last wins."""
    schema = stream.schema

    def merge(batch: DataFrame, n: int) -> None:
        w = Window.partitionBy("ticker", "date").orderBy(F.desc("delivered"), *[F.desc(c) for c in batch.columns if c not in ("ticker", "date", "delivered")])
        new = written(batch.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r"), "delivery")
        MonthTable(batch.sparkSession, path, schema).merge(new, n, lambda old, new: merge_tail(old, new, ["ticker", "date"]))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_bars(spark: SparkSession, path: str, schema) -> DataFrame:
    return MonthTable(spark, path, schema).read()


_DAYS = "ticker string, date date, b long, s long, v decimal(28,2), p date"
_ACTIVITY = "ticker string, date date, insider_buy_count_60d long, insider_sell_count_60d long, insider_net_dollar_60d double, days_since_last_insider_buy int"


def insider_stream(stream: DataFrame, panel: DataFrame, path: str, checkpoint: str, **how):
    """Start a query that keeps insider activity of panel rows (ticker, date) up to date with a stream of trades.

    Three MonthTables under path: the trades themselves, so that what is delivered again counts once; totals by ticker and
    day; and activity. A batch adds its new trades to the totals of their days. A late trade changes what
    follows it: the rows of its ticker from its day on are worked out again, of other tickers and earlier days none.
    """
    trade = StructType([*[f for f in stream.schema if f.name != "date"], StructField("date", DateType())])

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        tables = [MonthTable(spark, f"{path}/{name}", kind) for name, kind in (("trades", trade), ("days", _schema(_DAYS)), ("activity", _schema(_ACTIVITY)))]
        trades, days, rows = tables
        got = written(batch.where("filing_date is not null").withColumn("date", F.col("filing_date")).distinct(), "delivered-trades")
        months = {r[0] for r in got.select(F.date_format("date", "yyyy-MM")).distinct().collect()}
        held = trades.read(n, months)
        same = None
        for c in trade.names:
            e = got[c].eqNullSafe(held[c])
            same = e if same is None else same & e
        new = written(got.join(held, same, "left_anti"), "new-trades")
        fresh = written(events.insider_days(new), "new-days")
        days.merge(fresh, n, _added)
        since = fresh.groupBy("ticker").agg(F.min("date").alias("__since"))
        stale = panel.join(since, "ticker").where("date >= __since").select("ticker", "date")
        known = days.read().join(since.select("ticker"), "ticker", "left_semi")  # the version that this batch has just published
        again = written(events.activity_of_days(stale, known, **how), "activity")
        rows.merge(again, n, lambda old, new: merge_tail(old, new, ["ticker", "date"]))
        trades.merge(new, n, lambda old, new: old.unionByName(new))  # last: a batch that failed before this finds its trades new again

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _schema(text: str) -> StructType:
    return StructType.fromDDL(text)


def _added(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.unionByName(new.select(*old.columns))
    return both.groupBy("ticker", "date").agg(*[F.sum(c).cast(t).alias(c) for c, t in (("b", "long"), ("s", "long"), ("v", "decimal(28,2)"))], F.max("p").alias("p"))


def read_insider(spark: SparkSession, panel: DataFrame, path: str) -> DataFrame:
    """panel with its activity; rows that no trade has touched have none."""
    held = MonthTable(spark, f"{path}/activity", _schema(_ACTIVITY)).read()
    none = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("insider_buy_count_60d", "insider_sell_count_60d", "insider_net_dollar_60d")}
    return panel.join(held, ["ticker", "date"], "left").select(*[none.get(c, F.col(c)) for c in [*panel.columns, *[f for f in held.columns if f not in panel.columns]]])


def activity(stream: DataFrame, delay: str = "2 days", window: str = "1 day") -> DataFrame:
    """Counts and values of events by key and day, late ones up to `delay`."""
    d = stream.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "event_type")
    return d.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("value")).select(F.col("w.start").cast("date").alias("day"), "event_type", "n", F.col("value").cast("double").alias("value"))


def activity_table(stream: DataFrame, path: str, checkpoint: str, **how):
    """Start a query that writes what changed in `activity` with each micro-batch, under the batch's number."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return activity(stream, **how).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of each day and kind."""
    w = Window.partitionBy("day", "event_type").orderBy(F.desc("batch"))
    return spark.read.parquet(path).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "batch")
