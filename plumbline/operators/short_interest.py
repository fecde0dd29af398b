"""Short-interest files: one schema from several header styles, and when each row became public."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.windows import business_days_after, clean_ticker

#: Header names, without case, blanks and underscores, of each column; the first that a file has counts.
HEADERS = {
    "settlement_date": ("settlementdate",),
    "ticker": ("symbol", "symbolcode"),
    "current_short": ("currentshortpositionquantity", "currentshortinterest"),
    "avg_daily_volume": ("averagedailyvolumequantity", "avgdailyvolume"),
    "days_to_cover": ("daystocoverquantity", "daystocover"),
}
PUBLISHED_AFTER = 8


def normalise(raw: DataFrame) -> DataFrame:
    """settlement_date, ticker, current_short, avg_daily_volume, days_to_cover of a file of text columns; what can't be read is null, rows without date or ticker go."""
    plain = {re.sub(r"[\W_]+", "", c).casefold(): c for c in raw.columns}
    found = {k: next((plain[n] for n in names if n in plain), None) for k, names in HEADERS.items()}
    text = lambda k: F.col(f"`{found[k]}`") if found[k] else F.lit(None).cast("string")
    d = raw.select(*[text(k).cast("string").alias(k) for k in HEADERS])
    d = d.withColumns({"settlement_date": F.expr("try_cast(settlement_date as date)"), "ticker": clean_ticker(F.upper("ticker"))} | {k: F.expr(f"try_cast({k} as double)") for k in list(HEADERS)[2:]})
    return d.dropna(subset=["settlement_date", "ticker"])


def published(rows: DataFrame, min_year: int | None = 2007, order: str | None = None) -> DataFrame:
    """rows from min_year on with their publish_date; of a ticker's rows for one settlement the last by `order` (by default the largest values) is kept."""
    d = rows.where(F.year("settlement_date") >= min_year) if min_year else rows
    rest = [F.desc(c) for c in d.columns if c not in ("ticker", "settlement_date", order)]
    w = Window.partitionBy("ticker", "settlement_date").orderBy(*([F.desc(order)] if order else []), *rest)
    d = d.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return d.withColumn("publish_date", business_days_after(F.col("settlement_date"), PUBLISHED_AFTER))
