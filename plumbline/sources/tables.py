"""Reading and writing of panel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.windows import clean_ticker


#: What read_per_ticker finds a ticker by in the folders of write_per_ticker.
TICKER_FOLDER = r"of=([^/]+)/"


def write_per_ticker(df: DataFrame, path: str) -> None:
    """A folder for each ticker, whose rows no longer hold it; a ticker's rows are written together, a busy one's in several files."""
    df.withColumnRenamed("ticker", "of").hint("rebalance", F.col("of")).write.mode("overwrite").partitionBy("of").parquet(path)


def read_per_ticker(spark: SparkSession, path: str, pattern: str = r"([^/]+)\.parquet") -> DataFrame:
    """One table of a folder of files that are named by their ticker, which becomes a column."""
    # Folders named like of=A would become a column of a guessed type.
    return spark.read.option("recursiveFileLookup", True).parquet(path).select("*", clean_ticker(F.regexp_extract("_metadata.file_path", pattern, 1)).alias("ticker"))


def read_delimited(spark: SparkSession, path: str, separator: str = "|") -> DataFrame:
    """A text table with a header, all columns as text; lines that don't fit are left out."""
    return spark.read.option("header", True).option("sep", separator).option("mode", "DROPMALFORMED").csv(path)


def write_panel(df: DataFrame, path: str) -> None:
    """Parquet by year of `date`, so that a range of dates reads its years alone. Writing again replaces only the years that df holds."""
    years = df.withColumn("year", F.year("date"))
    years.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def read_panel(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    d = spark.read.parquet(path)
    for bound, after in ((start, True), (end, False)):
        if bound:
            day, year = F.lit(bound).cast("date"), F.year(F.lit(bound).cast("date"))
            d = d.where((F.col("year") >= year) & (F.col("date") >= day) if after else (F.col("year") <= year) & (F.col("date") <= day))
    return d.drop("year")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
