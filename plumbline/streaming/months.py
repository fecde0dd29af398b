"""A table by month that micro-batches merge into, with a manifest of what is live and a clean-up of what isn't."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The manifest: where the live rows of each month are, and how many.
MANIFEST = "month string, batch long, n_rows long"


class MonthTable:
    """Rows with a `date`, kept under path/data/month=M/batch=N. A month's rows are written together, a large month's in several files.

    A version of the table is a manifest, path/manifest/N, that names one batch for each month. Spark marks a
    written manifest as whole last of all, so a reader sees the version before a batch or the one after it,
    and opens the files of live batches alone; folders of older batches are never listed. A batch that is
    repeated after a failure starts from the version before it and writes the same again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path, schema
        self._jvm = spark._jvm
        self._fs = self._hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        where = self._hadoop(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def versions(self) -> list[int]:
        """Whole manifests, oldest first."""
        numbers = sorted(int(n) for n in self._names(f"{self.path}/manifest") if n.isdigit())
        return [n for n in numbers if self._fs.exists(self._hadoop(f"{self.path}/manifest/{n}/_SUCCESS"))]

    def live(self, before: int | None = None) -> dict[str, tuple[int, int]]:
        """month -> (batch, rows) of the newest version, or of the newest below a batch: as many entries as there are months."""
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{known[-1]}").collect()
        return {r["month"]: (r["batch"], r["n_rows"]) for r in rows}

    def read(self, before: int | None = None, months: set[str] | None = None) -> DataFrame:
        """The live rows, or those of some months."""
        held = [f"{self.path}/data/month={m}/batch={b}" for m, (b, n) in sorted(self.live(before).items()) if n and (months is None or m in months)]
        return self.spark.read.schema(self.schema).parquet(*held) if held else self.spark.createDataFrame([], self.schema)

    def merge(self, new: DataFrame, batch: int, how: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Put how(live rows of the months that `new` touches, new) in the place of those months' rows. new is read twice: hand over a written table."""
        month = F.date_format("date", "yyyy-MM")
        touched = {r[0] for r in new.select(month).distinct().collect()}  # at most as many as there are months
        live = self.live(before=batch)
        merged = how(self.read(batch, touched), new).select(*self.schema.names).withColumn("month", month)
        if touched:
            merged.withColumn("batch", F.lit(batch).cast("long")).hint("rebalance", F.col("month")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(f"{self.path}/data")
            held = [f"{self.path}/data/month={m}/batch={batch}" for m in touched if self._fs.exists(self._hadoop(f"{self.path}/data/month={m}/batch={batch}"))]
            rows = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data").parquet(*held).groupBy(month.alias("month")).count().collect() if held else []
            counts = {r["month"]: r["count"] for r in rows}
            live |= {m: (batch, counts.get(m, 0)) for m in touched}
        self._publish(live, batch)

    def _publish(self, live: dict[str, tuple[int, int]], batch: int) -> None:
        rows = [(m, b, n) for m, (b, n) in sorted(live.items())]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{batch}")

    def folders(self) -> int:
        """Batch folders that hold data, live or not."""
        return sum(n.startswith("batch=") for m in self._names(f"{self.path}/data") if m.startswith("month=") for n in self._names(f"{self.path}/data/{m}"))

    def clean(self, keep: int = 1) -> int:
        """Remove versions but the newest `keep`, and the batch folders that none of those names; how many folders went. Readers of an older version must be done."""
        known = self.versions()
        kept = known[-keep:]
        named = {(r["month"], r["batch"]) for v in kept for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{v}").collect()}
        gone = 0
        for m in self._names(f"{self.path}/data"):
            for b in self._names(f"{self.path}/data/{m}") if m.startswith("month=") else []:
                # A folder above the newest version belongs to a batch that isn't published yet.
                if b.startswith("batch=") and (m[6:], int(b[6:])) not in named and int(b[6:]) <= (kept[-1] if kept else -1):
                    self._fs.delete(self._hadoop(f"{self.path}/data/{m}/{b}"), True)
                    gone += 1
        for v in known[:-keep]:
            self._fs.delete(self._hadoop(f"{self.path}/manifest/{v}"), True)
        return gone
