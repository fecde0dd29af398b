"""Reported facts: first filings, quarters, trailing sums, snapshots, splits, ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.windows import as_of, over_safe

FLOWS = ("revenue", "net_income", "operating_income")
SNAPSHOTS = ("assets", "assets_current", "liabilities_current", "equity", "lt_debt", "shares")


#: Tags under which each concept is reported, their unit and kind.
CONCEPTS = {
    "revenue": (("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet"), "USD", "flow"),
    "net_income": (("NetIncomeLoss",), "USD", "flow"),
    "operating_income": (("OperatingIncomeLoss",), "USD", "flow"),
    "assets": (("Assets",), "USD", "snapshot"),
    "assets_current": (("AssetsCurrent",), "USD", "snapshot"),
    "liabilities_current": (("LiabilitiesCurrent",), "USD", "snapshot"),
    "equity": (("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"), "USD", "snapshot"),
    "lt_debt": (("LongTermDebt", "LongTermDebtNoncurrent"), "USD", "snapshot"),
    "shares": (("CommonStockSharesOutstanding",), "shares", "snapshot"),
}


def concepts(spark: SparkSession) -> DataFrame:
    """concept, tag, unit, kind: the registry as a table of a fixed few rows."""
    return spark.createDataFrame([(c, t, unit, kind) for c, (tags, unit, kind) in CONCEPTS.items() for t in tags], "concept string, tag string, unit string, kind string")


def facts_from_json(raw: DataFrame, concepts: DataFrame) -> DataFrame:
    """ticker, payload to fact rows of the concepts (concept, tag, unit)."""
    item = "array<struct<start: string, end: string, filed: string, val: double, form: string, fp: string, fy: int, accn: string>>"
    tags = raw.select("ticker", F.explode(F.from_json("payload", f"facts map<string, map<string, struct<units: map<string, {item}>>>>").getField("facts")).alias("taxonomy", "tags")).select("ticker", F.explode("tags").alias("tag", "body"))
    units = tags.select("ticker", "tag", F.explode("body.units").alias("unit", "rows")).join(F.broadcast(concepts), ["tag", "unit"])
    d = units.select("ticker", "concept", "tag", F.inline("rows"))
    return clean_facts(d.select("ticker", "concept", "tag", F.col("start").alias("period_start"), F.col("end").alias("period_end"), "filed", F.col("val").alias("value"), "form", "fp", "fy", F.col("accn").alias("accession")))


def clean_facts(d: DataFrame) -> DataFrame:
    return d.withColumns({c: F.expr(f"try_cast({c} as date)") for c in ("period_start", "period_end", "filed")} | {"value": F.expr("try_cast(value as double)")}).dropna(subset=["period_end", "filed", "value"])


def first_filed(facts: DataFrame) -> DataFrame:
    tie = [F.col(c) for c in ("accession", "tag", "value") if c in facts.columns]
    w = Window.partitionBy("ticker", "concept", "period_end", "period_start").orderBy("filed", *tie)
    return facts.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def span_kind(start: Column, end: Column) -> Column:
    days = F.datediff(end, start) + 1
    return F.when(days.between(80, 100), "quarterly").when(days.between(350, 380), "annual").when(days.between(170, 200), "ytd_h1").when(days.between(260, 290), "ytd_q3").otherwise("unknown")


#: Days by which a quarter may begin before its year, and the longest year that quarters are sought in.
_EARLY, _YEAR = 2, 380


def _by_concept():
    return Window.partitionBy("ticker", "concept")


def _over_days(agg: str, first: int, last: int) -> Column:
    """agg over a concept's rows that end `first` to `last` days before, in the order by period_end that all windows of quarters share: a number of days as order would sort again."""
    return F.expr(f"{agg} over (partition by ticker, concept order by period_end range between interval '{first}' day preceding and interval '{last}' day preceding)")


def _by_day(days: str) -> Column:
    return F.datediff(days, F.lit("1970-01-01").cast("date"))


def quarterly(facts: DataFrame, snapshots: tuple[str, ...] = ()) -> DataFrame:
    """Quarters of the flow concepts: reported ones, and the fourth as the year less the three inside it. Rows of the snapshot concepts named pass as they are.

    A year sees the quarters that end before it in one range window, so nothing is joined; rows
    stay where the first exchange by ticker puts them.
    """
    flow = F.when(F.col("concept").isin(*FLOWS), span_kind(F.col("period_start"), F.col("period_end")))
    kind = F.when(F.col("concept").isin(*snapshots) & F.col("period_start").isNull(), "snapshot").otherwise(flow) if snapshots else flow
    d = facts.withColumn("kind", kind).where("kind in ('quarterly', 'annual', 'snapshot')")
    one = Window.partitionBy("ticker", "concept", "period_end", "kind").orderBy("filed", "period_start", "value")
    d = d.withColumn("__r", F.row_number().over(one)).where("__r = 1").drop("__r")
    quarter = F.when(F.col("kind") == "quarterly", F.struct("period_start", "period_end", "filed", "value"))
    d = d.withColumn("__quarter", quarter)
    d = d.withColumns({"__native": F.max(F.col("__quarter").isNotNull()).over(Window.partitionBy("ticker", "concept", "period_end")), "__inside": _over_days("collect_list(__quarter)", _YEAR, 1)})
    inside = F.filter("__inside", lambda q: q["period_start"] >= F.date_sub("period_start", _EARLY))
    d = d.withColumn("__inside", F.when((F.col("kind") == "annual") & ~F.col("__native"), inside)).where("kind <> 'annual' or size(__inside) = 3")
    rest = F.aggregate("__inside", F.lit(0.0), lambda s, q: s + q["value"])
    last = lambda f: F.array_max(F.transform("__inside", lambda q: q[f]))
    derived = F.col("kind") == "annual"
    return d.select(
        "ticker", "concept", F.when(derived, F.date_add(last("period_end"), 1)).otherwise(F.col("period_start")).alias("period_start"), "period_end",
        F.when(derived, F.greatest("filed", last("filed"))).otherwise(F.col("filed")).alias("filed"), F.when(derived, F.col("value") - rest).otherwise(F.col("value")).alias("value"),
    )


def ttm(quarters: DataFrame) -> DataFrame:
    """Sums of four quarter rows whose ends span 240 to 320 days, known once the last of them is filed. Other concepts' rows keep their value."""
    w = _by_concept().orderBy("period_end").rowsBetween(-3, 0)
    flow = F.col("concept").isin(*FLOWS)
    d = quarters.select(
        "ticker", "concept", "period_end", F.when(flow, F.sum("value").over(w)).otherwise(F.col("value")).alias("ttm"), F.when(flow, F.max("filed").over(w)).otherwise(F.col("filed")).alias("asof"),
        (~flow | ((F.count("*").over(w) == 4) & F.datediff("period_end", F.min("period_end").over(w)).between(240, 320))).alias("__whole"),
    )
    return d.where("__whole").drop("__whole")


def year_before(t: DataFrame) -> DataFrame:
    """t with the trailing sum of the row nearest to a year before (30 days at most, the earlier one on ties)."""
    near = _over_days("collect_list(struct(period_end, ttm))", 395, 335)
    off = lambda x: F.struct(F.abs(F.datediff(x["period_end"], F.date_sub("period_end", 365))).alias("off"), x["period_end"].alias("end"), x["ttm"].alias("ttm"))
    return t.withColumn("__near", near).select(*t.columns, F.array_min(F.transform("__near", off)).getField("ttm").alias("ttm_prior"))


def split_factor(rows: DataFrame, splits: DataFrame, asof: str) -> DataFrame:
    """rows with the product of the ratios of splits after their date (1 without any); both sides are stacked and read by one window."""
    kind = rows.select(F.struct("*").alias("row")).schema["row"].dataType
    day = splits.groupBy("ticker", F.col("date").alias("__d")).agg(F.product("ratio").alias("__ratio"))
    both = day.withColumn("__row", F.lit(None).cast(kind)).unionByName(rows.select("ticker", F.col(asof).alias("__d"), F.lit(1.0).alias("__ratio"), F.struct("*").alias("__row")))
    after = Window.partitionBy("ticker").orderBy(_by_day("__d")).rangeBetween(1, Window.unboundedFollowing)
    # A row without a date has nothing after it, nor is it after anything.
    factor = F.when(F.col("__d").isNull(), 1.0).otherwise(F.coalesce(F.product("__ratio").over(after), F.lit(1.0)))
    return both.withColumn("split_factor", factor).where("__row is not null").select("__row.*", "split_factor")


def fundamentals(facts: DataFrame, splits: DataFrame) -> DataFrame:
    """One row per ticker and flow period end: trailing sums, a year before, latest snapshots, adjusted shares.

    Facts are dealt by ticker once. All windows below, and the pivot, partition by the ticker and
    more, so that they need no exchange of their own.
    """
    t = year_before(ttm(quarterly(first_filed(facts.repartition("ticker")), SNAPSHOTS)))
    # Flows and snapshots of a ticker meet in one row a period end.
    of = lambda c, x: F.first(F.when(F.col("concept") == c, F.col(x)), ignorenulls=True)
    wide = t.groupBy("ticker", "period_end").agg(*[of(c, x).alias(f"{c}_{x}") for c in FLOWS for x in ("ttm", "ttm_prior", "asof")], *[of(c, x).alias(f"{c}_{x}") for c in SNAPSHOTS for x in ("ttm", "asof")])
    # The columns of a snapshot date may be missing one by one: each is carried forward by itself.
    so_far = Window.partitionBy("ticker").orderBy("period_end").rowsBetween(Window.unboundedPreceding, 0)
    d = wide.withColumns({f"{c}_{x}": F.last(f"{c}_{x}", ignorenulls=True).over(so_far) for c in SNAPSHOTS for x in ("ttm", "asof")})
    asof = F.greatest(*[F.col(f"{c}_asof") for c in (*FLOWS, *SNAPSHOTS)])
    d = d.select("ticker", "period_end", asof.alias("asof_date"), *[F.col(f"{c}_ttm").alias(f"ttm_{c}") for c in FLOWS], *[F.col(f"{c}_ttm_prior").alias(f"ttm_{c}_prior") for c in FLOWS], *[F.col(f"{c}_ttm").alias("shares" if c == "shares" else f"mrq_{c}") for c in SNAPSHOTS])
    d = split_factor(d.dropna(how="all", subset=[f"ttm_{c}" for c in FLOWS]), splits, "asof_date")
    return d.withColumn("shares_adj", F.col("shares") * F.col("split_factor")).drop("split_factor")


FUNDAMENTAL_INPUTS = [*[f"ttm_{c}" for c in FLOWS], "ttm_revenue_prior", "ttm_operating_income_prior", *[f"mrq_{c}" for c in SNAPSHOTS[:-1]], "shares_adj"]


def attach_fundamentals(panel: DataFrame, fund: DataFrame) -> DataFrame:
    """panel with the seven ratios, as known on each date."""
    d = as_of(panel, fund, "ticker", "date", "asof_date", FUNDAMENTAL_INPUTS, ["period_end"])
    c = F.col
    cap = c("shares_adj") * c("close")
    return d.withColumns({
        "earnings_yield": over_safe(c("ttm_net_income"), cap), "book_to_market": over_safe(c("mrq_equity"), cap), "roa": over_safe(c("ttm_net_income"), c("mrq_assets")),
        "debt_to_equity": over_safe(c("mrq_lt_debt"), c("mrq_equity")), "current_ratio": over_safe(c("mrq_assets_current"), c("mrq_liabilities_current")),
        "sales_growth_yoy": over_safe(c("ttm_revenue"), c("ttm_revenue_prior")) - 1, "op_income_growth_yoy": over_safe(c("ttm_operating_income"), c("ttm_operating_income_prior")) - 1,
    }).drop(*FUNDAMENTAL_INPUTS)


# Column, sign (1: too large, -1: too small) and limit of the quality filter; null passes.
QUALITY = {"debt_to_equity": (1, 10.0), "current_ratio": (-1, 0.3), "sales_growth_yoy": (-1, -0.5), "insider_net_dollar_60d": (-1, -50_000_000.0)}


def passes(columns: list[str], limits: dict[str, tuple[int, float]] = QUALITY, min_roa: float | None = None) -> Column:
    """Whether a row keeps within the limits of those columns that are there."""
    limits = limits | ({"roa": (-1, min_roa)} if min_roa is not None else {})
    ok = F.lit(True)
    for col, (sign, limit) in limits.items():
        if col in columns:
            ok = ok & ~F.coalesce(F.col(col) > limit if sign > 0 else F.col(col) < limit, F.lit(False))
    return ok


def quality_filter(df: DataFrame, limits: dict[str, tuple[int, float]] = QUALITY, min_roa: float | None = None) -> DataFrame:
    return df.where(passes(df.columns, limits, min_roa))
