"""Landed text files whose headers differ, read into one table with an account of every line that isn't in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.windows import day_of

_BAD = "__corrupt"


def headers(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """The distinct first lines of the files under path, each with its files. A line a file reaches the driver."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    first = lines.where("start = 0").withColumn("at", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "at").alias("header"))
    held = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    return [(r["header"], r["files"]) for r in held]


def plain(name: str) -> str:
    """A header's name without case and whatever isn't a letter or digit."""
    return "".join(c for c in name.lower() if c.isalnum())


def read_landed(spark: SparkSession, path: str, names: dict[str, tuple[str, ...] | None], separator: str = ",", file_as: tuple[str, str] | None = None, rules: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of the files under path.

    names: column -> the plain header names it may have, the first found counts; None: the first column that no other
    one takes. A file without one of them is rejected whole. Columns are text. file_as: a column filled from each file's path by a pattern
    with one group. rules: reason -> condition under which a line is rejected; a line counts under its first reason.
    rejects: file, reason, n; `malformed` are lines with too few or too many fields, `header` those of files whose columns aren't known.
    """
    parts = []
    for header, files in headers(spark, path):
        columns = [h.strip().strip('"') for h in header.split(separator)]
        found: dict[str, str | None] = {}
        for c, known in names.items():
            if known:
                found[c] = next((h for k in known for h in columns if plain(h) == k), None)
        for c, known in names.items():
            if not known:
                found[c] = next((h for h in columns if h not in found.values()), None)
        unique = [f"c{i}" for i in range(len(columns))]
        schema = ", ".join([f"{u} string" for u in unique] + [f"{_BAD} string"])
        d = spark.read.schema(schema).option("header", True).option("sep", separator).option("mode", "PERMISSIVE").option("columnPruning", False).option("columnNameOfCorruptRecord", _BAD).csv(files)  # fields can't be counted when some aren't split off
        known = None not in found.values()
        at = {c: F.col(unique[columns.index(found[c])]) if known else F.lit(None).cast("string") for c in names}
        # Spark refuses a scan of the corrupt lines alone: the first field is read beside them.
        bad = F.col(_BAD).isNotNull() & (F.length(F.coalesce(unique[0], F.lit(""))) >= 0)
        reason = F.when(F.lit(not known), "header").when(bad, "malformed")
        file = F.col("_metadata.file_path")
        more = {file_as[0]: F.regexp_extract(file, file_as[1], 1)} if file_as else {}
        parts.append(d.select(*[at[c].alias(c) for c in names], *[v.alias(k) for k, v in more.items()], file.alias("__file"), reason.alias("__reason")))
    if not parts:
        empty = ", ".join(f"{c} string" for c in [*names, *([file_as[0]] if file_as else [])])
        return spark.createDataFrame([], empty), spark.createDataFrame([], "file string, reason string, n long")
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    reason = F.col("__reason")
    why = F.when(reason.isNotNull(), reason)
    for name, cond in (rules or {}).items():
        why = why.when(F.coalesce(cond, F.lit(False)), name)
    lines = lines.withColumn("__reason", why)
    rejects = lines.where("__reason is not null").groupBy(F.col("__file").alias("file"), F.col("__reason").alias("reason")).agg(F.count("*").alias("n"))
    return lines.where("__reason is null").drop("__file", "__reason"), rejects


# The headers of a macro series' date, old and new; the value stands in the other column.
MACRO_DATE = ("observationdate", "date")


def read_macro(spark: SparkSession, path: str, series: str = r"([^/]+)\.csv") -> tuple[DataFrame, DataFrame]:
    """series, date, value of macro files named by their series, and the rejects: a value that is no number is missing, a date that is none unreadable."""
    rules = {"date": F.expr("try_cast(date as date) is null"), "missing": F.expr("try_cast(value as double) is null")}
    rows, rejects = read_landed(spark, path, {"date": MACRO_DATE, "value": None}, file_as=("series", series), rules=rules)
    return rows.select("series", F.col("date").cast("date").alias("date"), F.col("value").cast("double").alias("value")), rejects


# The columns of the two insider files that are read, by their plain names.
INSIDER_SUBMISSION = {"ACCESSION_NUMBER": ("accessionnumber",), "FILING_DATE": ("filingdate",), "DOCUMENT_TYPE": ("documenttype",), "ISSUERTRADINGSYMBOL": ("issuertradingsymbol",)}
INSIDER_TRANS = {"ACCESSION_NUMBER": ("accessionnumber",), "TRANS_DATE": ("transdate",), "TRANS_CODE": ("transcode",), "TRANS_SHARES": ("transshares",), "TRANS_PRICEPERSHARE": ("transpricepershare",), "DIRECT_INDIRECT_OWNERSHIP": ("directindirectownership",)}


def read_insider(spark: SparkSession, submissions: str, trades: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The two tables that `events.insider_trades` joins, from tab-separated files, and the rejects of both."""
    s, no_s = read_landed(spark, submissions, INSIDER_SUBMISSION, "\t", rules={"date": day_of(F.col("FILING_DATE")).isNull()})
    t, no_t = read_landed(spark, trades, INSIDER_TRANS, "\t")
    return s, t, no_s.unionByName(no_t)
