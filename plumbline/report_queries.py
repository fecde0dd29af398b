"""Further queries: landed JSON, the assembled panel, reports, the audit, streams, the ranker."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.scratch import drop, new_path, written
from plumbline.functions.windows import day_of, quarter_of, quarters
from plumbline.operators import audit, events, fundamentals, membership, panel, portfolio, technicals
from plumbline.plans import model
from plumbline.queries import LIMITS, N, PASSES, PERF, RATIOS, RAW, STATS, _market, _nav, _PERF_OFFSET, _RANKED, _trades, query, rounded, scored
from plumbline.sources import landed, tables
from plumbline.sources.bindings import SELECTS, bar_keys, bars_until, bind
from plumbline.streaming import stream
from plumbline.streaming.months import MonthTable

# ---- landed JSON


@query("select ticker, accession, report_date, form, items from {filings}")
def filings_flattened(spark, d):
    f = bind(spark, d, "filings").withColumn("recent", F.col("report_date") >= F.lit("1999-01-01").cast("date"))
    cols = {"form": "form", "filingDate": "report_date", "accessionNumber": "accession", "items": "items"}
    block = f.groupBy("ticker", "recent").agg(F.array_sort(F.collect_list(F.struct("accession", "form", "report_date", "items"))).alias("all"))
    page = F.struct(*[F.col(f"all.{c}").cast("array<string>").alias(k) for k, c in cols.items()])
    payload = F.when(F.col("recent"), F.to_json(F.struct(F.struct(page.alias("recent")).alias("filings")))).otherwise(F.to_json(page))
    return events.flatten_submissions(block.select("ticker", payload.alias("payload"))).select("ticker", "accession", "report_date", "form", "items")


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """facts_raw under the tags of the registry; later revenue of every fifth ticker under its second tag."""
    f = bind(spark, d, "facts_raw")
    late = (F.col("concept") == "revenue") & (F.col("ticker").cast("long") % 5 == 0) & (F.year("period_end") > 1998)
    first = F.create_map(*[F.lit(x) for c, (tags, _, _) in fundamentals.CONCEPTS.items() for x in (c, tags[0])])
    unit = F.create_map(*[F.lit(x) for c, (_, u, _) in fundamentals.CONCEPTS.items() for x in (c, u)])
    return f.select("*", F.when(late, fundamentals.CONCEPTS["revenue"][0][1]).otherwise(first[F.col("concept")]).alias("tag"), unit[F.col("concept")].alias("unit"))


@query("select ticker, concept, period_start, period_end, filed, round(value, 4) as value from {facts_raw}")
def facts_flattened(spark, d):
    f = _tagged(spark, d)
    row = F.struct(F.col("period_start").cast("string").alias("start"), F.col("period_end").cast("string").alias("end"), F.col("filed").cast("string").alias("filed"), F.col("value").alias("val"), F.lit("10-Q").alias("form"))
    units = f.groupBy("ticker", "tag", "unit").agg(F.collect_list(row).alias("rows"))
    tags = units.groupBy("ticker", "tag").agg(F.struct(F.map_from_entries(F.collect_list(F.struct("unit", "rows"))).alias("units")).alias("body"))
    payload = tags.groupBy("ticker").agg(F.to_json(F.struct(F.create_map(F.lit("us-gaap"), F.map_from_entries(F.collect_list(F.struct("tag", "body")))).alias("facts"))).alias("payload"))
    out = fundamentals.facts_from_json(payload, fundamentals.concepts(spark).drop("kind"))
    return out.select("ticker", "concept", "period_start", "period_end", "filed", F.round("value", 4).alias("value"))


@query("select ticker, concept, period_start, period_end, filed, round(value, 4) as value from {facts_raw} where day(filed) % 7 <> 0 and month(period_end) <> 6 and year(filed) <> 1997")
def facts_cleaned(spark, d):
    """Facts as text with unreadable numbers, ends and filing dates, which go."""
    f = bind(spark, d, "facts_raw")
    text = lambda c: F.col(c).cast("string")
    raw = f.select("ticker", "concept", text("period_start").alias("period_start"), F.when(F.month("period_end") == 6, "soon").otherwise(text("period_end")).alias("period_end"), F.when(F.year("filed") == 1997, "").otherwise(text("filed")).alias("filed"), F.when(F.dayofmonth("filed") % 7 == 0, "n/a").otherwise(text("value")).alias("value"))
    return fundamentals.clean_facts(raw).withColumn("value", F.round("value", 4))


# ---- the assembled panel

def _rank_sql(c: str) -> str:
    return f"case when {c} is not null then round((rank() over (partition by date order by {c} nulls last) + (count({c}) over (partition by date, {c}) - 1) / 2.0) / count({c}) over (partition by date), 6) end"


_RANKS = ", ".join(f"{_rank_sql(c)} as {c}_rank" for c in panel.RANKED)
_PANEL = {
    "q_context": RAW["market_context"][0], "q_regime": RAW["market_regime"][0], "q_macro": RAW["macro_regime"][0], "q_earnings": RAW["earnings_distance"][0], "q_insider": RAW["insider_activity"][0],
    "all_features": "select t.*, e.macd_hist, e.atr_pct, c.beta_60d, c.excess_ret_5d, c.excess_ret_21d, n.days_to_earnings, n.days_since_earnings, i.insider_buy_count_60d, i.insider_sell_count_60d, i.insider_net_dollar_60d, i.days_since_last_insider_buy, "
    + ", ".join(f"r.{c}" for c in panel.FUNDAMENTAL)
    + " from {tech} t join {exponential} e using (ticker, date) join {q_context} c using (ticker, date) join {q_earnings} n using (ticker, date) join {q_insider} i using (ticker, date) join {ratios} r using (ticker, date)",
    "member_features": "select t.*, coalesce(s.gics_sector, 'Unknown') as gics_sector, s.gics_sector is not null as known from {all_features} t join {inforce} i on i.date = t.date join {membership} m on m.date = i.snap and m.ticker = t.ticker left join {sectors} s on s.ticker = t.ticker",
    "panel": "select p.*, case when known then ret_21d - avg(ret_21d) over (partition by p.date, gics_sector) end as excess_ret_21d_vs_sector, g.spy_ret_21d, g.spy_rsi_14, g.vix_level, x.term_spread_10y3m, x.ig_credit_spread, x.inflation_5y5y from {member_features} p left join {q_regime} g on g.date = p.date left join {q_macro} x on x.date = p.date",
    **{k: v for q in ("market_context", "market_regime", "macro_regime", "earnings_distance", "insider_activity") for k, v in RAW[q][1].items()},
}
_PLAIN = [c for c in panel.COLUMNS if not c.endswith("_rank")]
_places = lambda c: 9 if c in panel.FUNDAMENTAL else 2 if c == "insider_net_dollar_60d" else 6
_WHOLE = ("date", "ticker", "gics_sector", *panel.EARNINGS, *panel.INSIDER)


def feature_table(spark: SparkSession, d: str, until: str | None = None, **more) -> DataFrame:
    """The panel, or its rows up to a day: what a row holds of bars and trades lies before it, so later ones of these aren't sent."""
    b = lambda name: bind(spark, d, name)
    trades = _trades(spark, d)
    trades = trades.where(F.col("filing_date") <= F.lit(until).cast("date")) if until else trades
    return panel.feature_panel(bars_until(spark, d, until), _market(spark, d), b("membership"), b("sectors"), events.earnings_dates(b("filings")), trades, b("facts_raw"), b("splits"), b("macro_long"), calendar=bar_keys(spark, d), **more)


@query("select " + ", ".join(c if c in _WHOLE else f"round({c}, {_places(c)}) as {c}" for c in _PLAIN if c != "insider_net_dollar_60d") + ", round(insider_net_dollar_60d, 2) as insider_net_dollar_60d, " + _RANKS + " from {panel}", **_PANEL)
def feature_panel(spark, d):
    p = feature_table(spark, d)
    whole = {"days_to_earnings": "long", "days_since_earnings": "long", "days_since_last_insider_buy": "long"}
    cols = [F.col(c).cast(whole[c]).alias(c) if c in whole else F.round(c, _places(c)).alias(c) if t == "double" else F.col(c) for c, t in p.dtypes]
    return p.select(*cols)


_VALID = "select * from {scored} where " + " and ".join(f"{c} is not null" for c in ("ret_63d", "vol_60d", "dist_52w_high"))


@query("select ticker, date from {valid} where date >= date '1997-01-01'", valid=_VALID)
def valid_panel(spark, d):
    return membership.valid_rows(scored(spark, d), ["ret_63d", "vol_60d", "dist_52w_high"], "1997-01-01").select("ticker", "date")


@query("select split, round(ret_63d, 6) as ret_63d, round(vol_60d, 6) as vol_60d, round(f2, 6) as y from (select *, greatest(least(f, 0.5), -0.5) as f2, case when date <= date '1998-12-31' then 'train' when date < date '2000-01-01' then 'val' else 'test' end as split from {fwd} where f is not null) q where date <= date '2001-03-31'")
def training_matrix(spark, d):
    p = membership.time_split(membership.label(scored(spark, d, 21)), test_end="2001-03-31")
    return rounded(membership.matrix(p, ["split", "ret_63d", "vol_60d"], "forward_21d_return"), "split", "ret_63d", "vol_60d", "y")


@query("select max(date) as last_date, date_diff('day', max(date), date '2001-12-31') as days_old, date_diff('day', max(date), date '2001-12-31') > 7 as stale from {scored}")
def panel_staleness(spark, d):
    return membership.staleness(scored(spark, d), "2001-12-31").withColumn("days_old", F.col("days_old").cast("long"))


@query("select ticker, date, round(close, 6) as close from {bars} where ticker = '1' order by date desc limit 5")
def recent_rows(spark, d):
    return rounded(membership.tail(bind(spark, d, "bars"), "1"), "ticker", "date", "close")


@query("select ticker, date from (select ticker, date, row_number() over (order by md5(concat(ticker, '|', cast(date as varchar), '|7')), ticker, date) as r from {bars} where date >= date '1996-01-01') q where r <= 200")
def sampled_rows(spark, d):
    return membership.seeded_keys(bar_keys(spark, d).where("date >= '1996-01-01'"), 200, 7)


AUDITED = ["ret_1d", "ret_5d", "ret_21d", "ret_63d", "rsi_14", "mfi_14", "macd_hist", "atr_pct", "vol_20d", "vol_60d", "vol_ratio", "dist_sma50", "dist_sma200", "dist_52w_high", "trend_regime", "zscore_20d", "zscore_60d", "beta_60d", "excess_ret_5d", "excess_ret_21d"]


@query(
    "select feature, count(*) as n_compared, count(v) as n_values, 0 as n_mismatched from (select " + ", ".join(f"cast({c} as double) as {c}" for c in AUDITED) + " from {sample} s join {tech} t using (ticker, date) join {exponential} e using (ticker, date) join {q_context} c using (ticker, date)) q unpivot include nulls (v for feature in (" + ", ".join(AUDITED) + ")) group by feature",
    q_context=RAW["market_context"][0], sample="select ticker, date from (select ticker, date, row_number() over (order by md5(concat(ticker, '|', cast(date as varchar), '|7')), ticker, date) as r from {bars}) q where r <= 40", **RAW["market_context"][1],
)
def lookahead_audit(spark, d):
    pairs = audit.lookahead_pairs(bind(spark, d, "bars"), _market(spark, d), technicals.features, AUDITED, n=40, keys=bar_keys(spark, d))
    return audit.lookahead_summary(pairs)


_AUDITED_DAYS = 2
_WHOLE_AUDIT = [c for c in [*panel.NUMERIC, "ret_1d", "close"] if c not in audit.SCHEDULED]
_SUMMED = ", ".join(f"cast(round({_rank_sql(c.removesuffix('_rank')) if c.endswith('_rank') else c}, 6) as decimal(28, 6)) as {c}" for c in _WHOLE_AUDIT)


def panel_inputs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    b = lambda name: bind(spark, d, name)
    return {"bars": b("bars"), "market": _market(spark, d), "members": b("membership"), "sectors": b("sectors"), "earnings": events.earnings_dates(b("filings")), "trades": _trades(spark, d), "facts": b("facts_raw"), "splits": b("splits"), "macro": b("macro_long")}


@query(
    "select feature, count(*) as n_compared, count(v) as n_values, round(cast(sum(v) as double), 3) as sum_cut, 0 as n_mismatched from (select " + _SUMMED + " from {panel} p where date in (select date from {audit_days})) q unpivot include nulls (v for feature in (" + ", ".join(_WHOLE_AUDIT) + ")) group by feature",
    audit_days=f"select date from (select date, row_number() over (order by md5(concat(cast(date as varchar), '|7')), date) as r from (select distinct date from {{bars}} where date >= date '1998-01-01') q) k where r <= {_AUDITED_DAYS}", **_PANEL,
)
def panel_audit(spark, d):
    """All columns of all members on sampled dates, computed again from what was known by then; their sums are those of the cut inputs."""
    inputs = {k: written(v, f"audit-{k}") for k, v in panel_inputs(spark, d).items()}
    days = inputs["bars"].where("date >= '1998-01-01'").select("date").distinct()
    days = [r["date"] for r in days.orderBy(F.md5(F.concat(F.col("date").cast("string"), F.lit("|7"))), "date").limit(_AUDITED_DAYS).collect()]
    pairs = written(audit.panel_pairs(inputs, days, panel.feature_panel, _WHOLE_AUDIT, told=True), "audit-pairs")
    sums = pairs.groupBy("feature").agg(F.round(F.sum(F.round("cut", 6).cast("decimal(28,6)")).cast("double"), 3).alias("sum_cut"))
    return audit.lookahead_summary(pairs).join(sums, "feature").select("feature", "n_compared", "n_values", "sum_cut", "n_mismatched")


@query(
    "select series, case when day(date) % 9 = 5 then 'malformed' when day(date) % 9 = 7 then 'date' when value = '.' then 'missing' else 'row' end as kind, count(*) as n, case when max(case when day(date) % 9 not in (5, 7) and value <> '.' then 1 else 0 end) = 1 then round(cast(sum(cast(case when value <> '.' then value end as decimal(18, 4))) as double), 4) end as total from {macro_long} group by series, kind"
)
def landed_macro(spark, d):
    """Macro series landed as text under both date headers, some lines with a field too many or a date that is none: what is read, and what is rejected why."""
    m, path = bind(spark, d, "macro_long"), new_path(spark, "landed-macro")
    day = F.dayofmonth("date") % 9
    date = F.when(day == 7, "soon").otherwise(F.col("date").cast("string"))
    new_style = F.col("series").isin("DGS10", "T5YIFR")
    line = F.when(new_style, F.concat_ws(",", date, "value")).otherwise(F.concat_ws(",", "value", date))
    lines = m.select("series", F.lit(1).alias("turn"), F.when(day == 5, F.concat(line, F.lit(",more"))).otherwise(line).alias("value"))
    heads = m.select("series").distinct().select("series", F.lit(0).alias("turn"), F.when(new_style, F.concat(F.lit("observation_date,"), F.col("series"))).otherwise(F.concat(F.col("series"), F.lit(",DATE"))).alias("value"))
    both = lines.unionByName(heads).repartition("series").sortWithinPartitions("series", "turn")
    both.drop("turn").write.partitionBy("series").text(path)
    rows, rejects = landed.read_macro(spark, path, r"series=([^/]+)/")
    read = rows.groupBy("series").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 4).alias("total")).select("series", F.lit("row").alias("kind"), "n", "total")
    lost = rejects.groupBy(F.regexp_extract("file", r"series=([^/]+)/", 1).alias("series"), F.col("reason").alias("kind")).agg(F.sum("n").alias("n")).withColumn("total", F.lit(None).cast("double"))
    return read.unionByName(lost)


_LOST = "cast(accession as bigint) % 13 = 0"


@query(
    "select q.quarter, coalesce(t.n, 0) as n_trades, coalesce(t.value, 0) as value, coalesce(b.n, 0) as n_malformed from (select concat(cast(year(d) as varchar), 'q', cast(quarter(d) as varchar)) as quarter from (select cast(unnest(generate_series(date '1994-10-01', date '2002-01-01', interval 3 month)) as date) as d) r) q"
    " left join (select concat(cast(year(filing_date) as varchar), 'q', cast(quarter(filing_date) as varchar)) as quarter, count(*) as n, round(cast(sum(cast(value as decimal(18, 2))) as double), 2) as value from {trades} group by 1) t on t.quarter = q.quarter"
    " left join (select concat(cast(year(filing_date) as varchar), 'q', cast(quarter(filing_date) as varchar)) as quarter, count(*) as n from {all_raw} where " + _LOST + " group by 1) b on b.quarter = q.quarter",
    all_raw=SELECTS["insider_raw"], insider_raw=SELECTS["insider_raw"].replace("from {events}", "from {events} where event_id % 13 <> 0"),
)
def landed_insider(spark, d):
    """Insider files of each quarter landed as text, some submissions a field short: trades, their value and lost lines for every quarter, also for those without files."""
    path = new_path(spark, "landed-insider")
    s, t = bind(spark, d, "insider_submission"), bind(spark, d, "insider_trans")
    filed = s.select("ACCESSION_NUMBER", quarter_of(day_of(F.col("FILING_DATE"))).alias("quarter"))
    for name, table, style in (("submission", s, str.upper), ("trans", t.join(filed, "ACCESSION_NUMBER"), str.lower)):
        d1 = table if "quarter" in table.columns else table.withColumn("quarter", quarter_of(day_of(F.col("FILING_DATE"))))
        cols = [c for c in table.columns if c != "quarter"]
        whole, short = F.concat_ws("\t", *cols), F.concat_ws("\t", *cols[:-1])
        line = F.when(F.expr("cast(ACCESSION_NUMBER as bigint) % 13 = 0"), short).otherwise(whole) if name == "submission" else whole
        lines = d1.select("quarter", F.lit(1).alias("turn"), line.alias("value"))
        head = d1.select("quarter").distinct().select("quarter", F.lit(0).alias("turn"), F.lit(style("\t".join(cols))).alias("value"))
        lines.unionByName(head).repartition("quarter").sortWithinPartitions("quarter", "turn").drop("turn").write.partitionBy("quarter").text(f"{path}/{name}")
    subs, trans, rejects = landed.read_insider(spark, f"{path}/submission", f"{path}/trans")
    trades = events.insider_trades(subs, trans).groupBy(quarter_of(F.col("filing_date")).alias("quarter")).agg(F.count("*").alias("n_trades"), F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2).alias("value"))
    lost = rejects.where("reason = 'malformed'").groupBy(F.regexp_extract("file", "quarter=([^/]+)/", 1).alias("quarter")).agg(F.sum("n").alias("n_malformed"))
    return quarters(spark, "1994-12-31", "2002-01-01").select("quarter").join(trades, "quarter", "left").join(lost, "quarter", "left").na.fill(0, ["n_trades", "n_malformed"]).na.fill(0.0, ["value"])


@query("select kind, ticker, count(*) as n, round(cast(sum(cast(round(close, 4) as decimal(18, 4))) as double), 4) as total from {bars} cross join (select unnest(['csv', 'json', 'per_ticker']) as kind) k group by kind, ticker")
def sinks_round_trip(spark, d):
    """Bars written as CSV, as JSON and as a folder a ticker, and read back; in the last the ticker is in the files' names alone."""
    bars = written(bind(spark, d, "bars").select("ticker", "date", F.round("close", 4).alias("close")), "rounded-bars")
    path = new_path(spark, "sinks")
    tables.write_csv(bars, f"{path}/csv")
    tables.write_json(bars, f"{path}/json")
    tables.write_per_ticker(bars, f"{path}/per_ticker")
    back = {
        "csv": spark.read.option("header", True).schema(bars.schema).csv(f"{path}/csv"),
        "json": spark.read.schema(bars.schema).json(f"{path}/json"),
        "per_ticker": tables.read_per_ticker(spark, f"{path}/per_ticker", tables.TICKER_FOLDER),
    }
    out = [r.select(F.lit(k).alias("kind"), "ticker", "close") for k, r in back.items()]
    both = out[0].unionByName(out[1]).unionByName(out[2])
    return both.groupBy("kind", "ticker").agg(F.count("*").alias("n"), F.round(F.sum(F.col("close").cast("decimal(18,4)")).cast("double"), 4).alias("total"))


# ---- reports


@query(f"select (select count(*) from {{scored}}) as n_before, (select count(*) from {{scored}} where {PASSES}) as n_after, round(1 - (select count(*) from {{scored}} where {PASSES}) / (select count(*) from {{scored}}), 6) as dropped")
def filter_hit_rate(spark, d):
    out = portfolio.filter_hits(scored(spark, d), LIMITS)
    return rounded(out, *out.columns)


@query("select q.date, count(*) as n, round(avg(s.predicted_return), 6) as mean_prediction from {best} q join {scored} s using (date, ticker) group by q.date", best=_RANKED)
def basket_means(spark, d):
    out = portfolio.basket_mean(portfolio.top_picks(scored(spark, d), N))
    return rounded(out, *out.columns)


_FILTERED = {"basket": f"select date, i, ticker, 1.0 / count(*) over (partition by date) as weight from (select t.*, row_number() over (partition by t.date order by t.predicted_return desc nulls last, t.ticker) as p from {{test}} t join {{scored}} s on s.date = t.date and s.ticker = t.ticker where not coalesce(s.vol_60d > 0.9, false) and not coalesce(s.dist_sma200 < -0.2, false)) q where p <= {N}"}


@query('select variant, off as "offset", date, round(nav, 6) as nav from {nav}', **_FILTERED)
def filtered_navs(spark, d):
    """The backtest with the quality filter ahead of the ranking."""
    p = scored(spark, d).where("date >= '2000-01-01'")
    out = portfolio.backtest(p, technicals.market_frame(_market(spark, d)), n=N, eligible=fundamentals.passes(p.columns, LIMITS))
    return out.select("variant", "offset", "date", F.round("nav", 6).alias("nav"))


_HELD_DAYS = {
    "names": "select i, string_agg(ticker, ',' order by ticker) as holdings from {basket} group by i",
    "lev": "select t.date, t.i, least(1.0, case when m.spy_vol_20d is null or m.spy_vol_20d <= 0 then 1.0 else 0.2 / m.spy_vol_20d end) as x from {tdates} t left join {mframe} m on m.date = t.date",
    "held_days": """select v.variant, o.o as off, d.date, d.i, case when d.i >= o.o then case when v.variant = 'raw' then 1.0 else (select x from {lev} l where l.i = d.i - (d.i - o.o) % 21) end else 0.0 end as exposure, case when d.i >= o.o and o.o = 0 then (select holdings from {names} n where n.i = d.i - (d.i - o.o) % 21) else '' end as holdings
                    from {tdates} d cross join (select unnest(range(0, 21)) as o) o cross join (select 'raw' as variant union all select 'overlay') v""",
    "spy_nav": RAW["benchmark_nav"][0],
}


@query("select variant, date, round(exposure, 6) as exposure, holdings from {held_days} where off = 0", **_HELD_DAYS)
def holdings_log(spark, d):
    return rounded(_nav(spark, d).where("offset = 0"), "variant", "date", "exposure", "holdings")


@query(
    "select s.variant, " + ", ".join(f"round(s.{c}, 5) as {c}" for c in STATS) + ", round(t.t, 5) as time_in_market, round(t.e, 5) as avg_exposure, round(c.lo, 5) as offset_cagr_min, round(c.hi, 5) as offset_cagr_max, (select max(date) from {tdates}) as end_date from {mean_perf} s left join {tim} t on t.variant = s.variant left join {spread} c on c.variant = s.variant",
    perf=_PERF_OFFSET, curves="select variant, date, avg(nav) as nav from {nav} group by variant, date union all select 'benchmark', date, nav from {spy_nav} where date <= (select max(date) from {tdates})",
    mean_perf="select variant, " + PERF.replace("{by}", "variant").replace("{nav}", "{curves}"),
    tim="select variant, avg(t) as t, avg(e) as e from (select variant, off, avg(case when exposure > 0 then 1.0 else 0.0 end) as t, avg(exposure) as e from {held_days} group by variant, off) q group by variant",
    spread="select variant, min(cagr) as lo, max(cagr) as hi from {perf} group by variant", **_HELD_DAYS,
)
def stats_report(spark, d):
    b = portfolio.buy_and_hold(technicals.market_frame(_market(spark, d)), "2000-01-01")
    return rounded(portfolio.stats_report(written(_nav(spark, d), "navs"), b), "variant", *STATS, "time_in_market", "avg_exposure", "offset_cagr_min", "offset_cagr_max", "end_date", places=5)


@query(
    "select coalesce(b.date, n.date) as date, round(b.nav, 6) as spy, round(n.raw, 5) as raw, round(n.overlay, 5) as overlay, round(n.p10, 5) as overlay_p10, round(n.p90, 5) as overlay_p90, h.op as overlay_picks, h.rp as raw_picks from {spy_nav} b full join {bands} n on n.date = b.date left join {logs} h on h.date = n.date",
    bands="select date, avg(case when variant = 'raw' then nav end) as raw, avg(case when variant = 'overlay' then nav end) as overlay, quantile_cont(nav, 0.1) filter (where variant = 'overlay') as p10, quantile_cont(nav, 0.9) filter (where variant = 'overlay') as p90 from {nav} group by date",
    logs="select date, max(case when variant = 'overlay' then holdings end) as op, max(case when variant = 'raw' then holdings end) as rp from {held_days} where off = 0 group by date", **_HELD_DAYS,
)
def nav_table(spark, d):
    b = portfolio.buy_and_hold(technicals.market_frame(_market(spark, d)), "2000-01-01")
    out = portfolio.nav_table(written(_nav(spark, d), "navs"), b)
    return out.select(*[F.round(c, 6 if c == "spy" else 5).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


_IMPORTANCE = "select f as feature, cast(l_linenumber as int) as seed, case when f = '3' and l_linenumber <> 4 or f = '5' then 0.0 else cast(sum(cast(l_quantity as decimal(18, 2))) as double) / 1000000 end as importance from (select cast(l_suppkey % 8 as string) as f, l_linenumber, l_quantity from {lineitem} where l_linenumber <= 4) as q group by f, l_linenumber"


@query(
    "select feature, " + ", ".join(f'round(max(case when seed = {k} then importance end), 8) as "{k}"' for k in (1, 2, 3, 4)) + ", round(avg(importance), 8) as mean, round(stddev_samp(importance), 8) as std, count(case when importance = 0 then 1 end) as zero_count, bool_and(importance = 0) as drop from {importance} group by feature", importance=_IMPORTANCE
)
def importance_stability(spark, d):
    """The stability table over an importance table that lineitem stands in for."""
    i = spark.sql(_IMPORTANCE, lineitem=bind(spark, d, "lineitem"))
    out = portfolio.stability(i, [1, 2, 3, 4])
    return rounded(out, *out.columns, places=8)


@query("select ticker, date, round(close, 6) as close from {bars} where date between date '1997-06-01' and date '1999-02-28'")
def panel_round_trip(spark, d):
    """The bars written by year and read back for a range of dates; what is written again replaces its years."""
    path = new_path(spark, "panel")
    bars = bind(spark, d, "bars").select("ticker", "date", "close")
    tables.write_panel(bars, path)
    tables.write_panel(bars.where("year(date) = 1998"), path)
    return rounded(tables.read_panel(spark, path, "1997-06-01", "1999-02-28"), "ticker", "date", "close")


# ---- streams


@query("select cast(ts as date) as day, event_type, count(*) as n, round(cast(sum(cast(value as decimal(18, 2))) as double), 2) as value from {events} group by 1, 2")
def streamed_activity(spark, d):
    """Counts and values by day and kind from a stream of the events, written by micro-batch."""
    source = spark.readStream.schema(bind(spark, d, "events").schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    path = new_path(spark, "activity")
    stream.activity_table(source, path, new_path(spark, "activity-checkpoint")).awaitTermination()
    return stream.read_activity(spark, path).withColumn("value", F.round("value", 2))


@query("select ticker, date, round(close, 6) as close, date >= date '2000-06-01' as late from {bars}")
def streamed_upsert(spark, d):
    """Bars delivered as a stream of two batches that overlap; the later delivery of a ticker's date wins."""
    bars = written(bind(spark, d, "bars").select("ticker", "date", F.round("close", 6).alias("close")), "rounded-bars")  # both deliveries are read from it
    landed, table = new_path(spark, "landed"), new_path(spark, "bars")
    old = bars.where("date < '2001-01-01'").select("*", F.lit(False).alias("late"), F.lit(1).alias("delivered"))
    new = bars.where("date >= '2000-06-01'").select("*", F.lit(True).alias("late"), F.lit(2).alias("delivered"))
    checkpoint = new_path(spark, "bars-checkpoint")
    for part in (old, new):
        part.write.mode("append").parquet(landed)
        stream.upsert_bars(spark.readStream.schema(part.schema).parquet(landed), table, checkpoint).awaitTermination()
    return stream.read_bars(spark, table, new.schema).select("ticker", "date", "close", "late")


@query(
    "select 'merged' as state, o.n + w.n as n_folders, 2 as n_versions, r.n as n_rows, r.s as sum_close from {o} o, {w} w, {r} r union all select 'cleaned', a.n, 1, r.n, r.s from {a} a, {r} r",
    o="select count(distinct date_trunc('month', date)) as n from {bars} where date < date '2001-01-01'", w="select count(distinct date_trunc('month', date)) as n from {bars} where date >= date '2000-06-01'",
    a="select count(distinct date_trunc('month', date)) as n from {bars}", r="select count(*) as n, cast(sum(cast(round(close, 4) as decimal(18, 4))) as double) as s from {bars}",
)
def table_upkeep(spark, d):
    """Folders, versions and rows of the streamed bars before and after what no reader needs is removed."""
    bars = written(bind(spark, d, "bars").select("ticker", "date", F.round("close", 4).alias("close")), "rounded-bars")  # both deliveries are read from it
    table = MonthTable(spark, new_path(spark, "upkeep"), bars.schema)
    table.merge(bars.where("date < '2001-01-01'"), 0, lambda old, new: membership.merge_tail(old, new, ["ticker", "date"]))
    table.merge(bars.where("date >= '2000-06-01'"), 1, lambda old, new: membership.merge_tail(old, new, ["ticker", "date"]))
    seen = []
    for state in ("merged", "cleaned"):
        if state == "cleaned":
            table.clean()
        counts = table.read().agg(F.count("*").alias("n_rows"), F.sum(F.col("close").cast("decimal(18,4)")).cast("double").alias("sum_close"))
        seen.append(written(counts.select(F.lit(state).alias("state"), F.lit(table.folders()).cast("long").alias("n_folders"), F.lit(len(table.versions())).alias("n_versions"), "n_rows", "sum_close"), "upkeep-state"))
    return seen[0].unionByName(seen[1])


@query(RAW["insider_activity"][0], **RAW["insider_activity"][1])
def streamed_insider_activity(spark, d):
    """Insider activity from two deliveries of trades that overlap; the second one also brings late trades of all years."""
    trades, rows = written(_trades(spark, d), "trades"), bind(spark, d, "bars").select("ticker", "date")
    rows = written(rows, "panel-rows")
    landed, table, checkpoint = (new_path(spark, x) for x in ("landed-trades", "insider", "insider-checkpoint"))
    late = F.pmod(F.xxhash64("ticker", "filing_date", "shares"), F.lit(3)) == 0
    for part in (trades.where((F.col("filing_date") < "2000-06-01") & ~late), trades.where((F.col("filing_date") >= "1999-06-01") | late)):
        part.write.mode("append").parquet(landed)
        stream.insider_stream(spark.readStream.schema(trades.schema).parquet(landed), rows, table, checkpoint).awaitTermination()
    return stream.read_insider(spark, rows, table).withColumn("insider_net_dollar_60d", F.round("insider_net_dollar_60d", 2))


# ---- the ranker: trained here, so there is no statement to hold it against

TARGET = "forward_21d_return_demeaned"


def _labelled_panel(spark: SparkSession, d: str) -> DataFrame:
    p = membership.time_split(membership.label(feature_table(spark, d, horizon=21)))
    return written(p.select(*dict.fromkeys([*_KEPT, *panel.NUMERIC, *panel.CATEGORICAL])), "labelled-panel")


_ONCE: dict[tuple, object] = {}


def _once(spark: SparkSession, d: str, what: str, make):
    """What the ranker's queries share is made once for a session and a data folder."""
    key = spark.sparkContext.applicationId, d, what
    if key not in _ONCE:
        _ONCE[key] = make()
    return _ONCE[key]


#: What is read of the prepared table beside its features: the limits of the filter, and what baskets earn.
_KEPT = ["date", "ticker", "split", "ret_1d", TARGET, *[c for c in fundamentals.QUALITY if c in panel.COLUMNS]]


def _prepared(spark: SparkSession, d: str) -> model.Prepared:
    def make() -> model.Prepared:
        p = _labelled_panel(spark, d)
        out = model.prepare(p, panel.NUMERIC, panel.CATEGORICAL, TARGET, keep=_KEPT)
        drop(p)  # its values are as bins in the prepared table from here on
        return out

    return _once(spark, d, "prepared", make)


def _fitted(spark: SparkSession, d: str) -> tuple[model.Trees, int, DataFrame]:
    return _once(spark, d, "fitted", lambda: model.fit_ranked(_prepared(spark, d), TARGET, N))


def _ranked_panel(spark: SparkSession, d: str) -> DataFrame:
    """The labelled panel with the prediction of as many rounds as rank the val rows best."""
    trees, k, _ = _fitted(spark, d)
    return model.score(trees, _prepared(spark, d).table, k)


@query()
def boosted_ranker(spark, d):
    return _ranked_panel(spark, d).select("ticker", "date", "split", TARGET, "predicted_return")


@query()
def ranker_rounds(spark, d):
    """The metrics of val after each round, and the round that training is stopped at."""
    _, k, rounds = _fitted(spark, d)
    return rounds.select("k", "topn_mean", "rmse", (F.col("k") == k).alias("best"))


@query()
def ranker_evaluation(spark, d):
    """rmse, ic, decile spread, top-n mean and ratio of the model on train, val and test."""
    return portfolio.rank_metrics(_ranked_panel(spark, d), TARGET, "predicted_return", N)


@query()
def ranker_stats(spark, d):
    """The stats report of baskets that the model picks after the quality filter."""
    p = _ranked_panel(spark, d).where("split = 'test'")
    market = technicals.market_frame(_market(spark, d))
    nav = portfolio.backtest(p, market, n=N, eligible=fundamentals.passes(p.columns))
    return portfolio.stats_report(written(nav, "navs"), portfolio.buy_and_hold(market, "2000-01-01"))


@query()
def ranker_picks(spark, d):
    return portfolio.live_picks(_ranked_panel(spark, d), technicals.market_frame(_market(spark, d)), N)


@query()
def ranker_importances(spark, d):
    """Importances by seed, and which features are zero for all five and so may go."""
    seeds = [1, 2, 3, 4, 5]
    return portfolio.stability(model.importances(_prepared(spark, d), TARGET, seeds), seeds)


@query()
def ranker_search(spark, d):
    """Twenty trials over all seven parameters, few rounds each, with the best round's mean return of the best n on val."""
    return model.search_table(_prepared(spark, d), TARGET, N, trials=20, first=10, ranges={"n_estimators": (3, 8, False), "learning_rate": (0.02, 0.3, True)})


_BINNED = ["vol_60d", "earnings_yield", "roa", "days_to_earnings", "days_since_last_insider_buy", "gap"]


@query(
    "select feature, bin, count(*) as n from (select r.feature, case when r.x is null then -1 else (select count(*) from {edges} e where e.feature = r.feature and e.edge <= r.x) end as bin from {long} r) q group by feature, bin",
    picked="select round(vol_60d, 6) as vol_60d, round(earnings_yield, 9) as earnings_yield, round(roa, 9) as roa, cast(days_to_earnings as double) as days_to_earnings, cast(days_since_last_insider_buy as double) as days_since_last_insider_buy, case when cast(ticker as int) % 3 > 0 then round(ret_63d, 6) end as gap from {panel} where date <= date '1998-12-31'",
    long="select * from {picked} unpivot include nulls (x for feature in (" + ", ".join(_BINNED) + "))",
    edges="select distinct feature, unnest(quantile_cont(x, [" + ", ".join(f"{i / 8}" for i in range(1, 8)) + "])) as edge from {long} where x is not null group by feature", **_PANEL,
)
def ranker_bins(spark, d):
    """How many train rows each bin of a feature holds, missing values (-1) too."""
    p = feature_table(spark, d, "1998-12-31", ranked=[]).withColumns({"split": F.lit("train"), "gap": F.when(F.col("ticker").cast("int") % 3 > 0, F.col("ret_63d"))})
    p = written(p.select("split", F.lit(0.0).alias("y"), *[F.round(F.col(c).cast("double"), 9 if c in panel.FUNDAMENTAL else 6).alias(c) for c in _BINNED]), "binned")
    q = model.prepare(p, _BINNED, [], "y", 8)
    bins = q.table.select(F.posexplode(vector_to_array("__features")).alias("i", "bin"))
    names = F.array(*[F.lit(c) for c in _BINNED])
    low = F.create_map(*[x for c in _BINNED for x in (F.lit(c), F.lit(float(q.missing[c])))])
    return bins.where(F.col("i") < len(_BINNED)).select(names[F.col("i")].alias("feature"), "bin").groupBy("feature", F.when(F.col("bin") == low[F.col("feature")], -1).otherwise(F.col("bin")).cast("long").alias("bin")).agg(F.count("*").alias("n"))


# Three small trees over three ranks, for holding staged scores against a statement.
_STATED = model.Trees(
    feature=[np.array([0, 1, 0, 0, 0]), np.array([2, 0, 0]), np.array([1, 0, 2, 0, 0])],
    threshold=[np.array([0.5, 0.3, 0, 0, 0]), np.array([0.7, 0, 0]), np.array([0.6, 0, 0.25, 0, 0])],
    categories=[[None] * 5, [None] * 3, [None] * 5],
    left=[np.array([1, 2, 2, 3, 4]), np.array([1, 1, 2]), np.array([1, 1, 3, 3, 4])],
    right=[np.array([4, 3, 2, 3, 4]), np.array([2, 1, 2]), np.array([2, 1, 4, 3, 4])],
    value=[np.array([0, 0, 0.02, -0.01, 0.03]), np.array([0, -0.005, 0.01]), np.array([0, 0.004, 0, -0.02, 0.006])],
)


@query(
    "select k, round(avg(top), 6) as topn_mean, round(sqrt(sum(se) / sum(n)), 6) as rmse from (select k, date, case when max(c) >= 5 then avg(case when r <= 5 then y end) end as top, sum((y - p) * (y - p)) as se, count(*) as n from (select *, row_number() over (partition by k, date order by p desc, ticker) as r, count(*) over (partition by k, date) as c from {stages}) q group by k, date) d group by k",
    steps="select ticker, date, forward_21d_return as y, case when a <= 0.5 then case when b <= 0.3 then 0.02 else -0.01 end else 0.03 end as p1, case when c <= 0.7 then -0.005 else 0.01 end as p2, case when b <= 0.6 then 0.004 when c <= 0.25 then -0.02 else 0.006 end as p3 from (select ticker, date, forward_21d_return, coalesce(round(dist_52w_high_rank, 6), -1) as a, coalesce(round(vol_60d_rank, 6), -1) as b, coalesce(round(ret_63d_rank, 6), -1) as c from {labelled}) q",
    stages="select ticker, date, y, 1 as k, p1 as p from {steps} union all select ticker, date, y, 2, p1 + p2 from {steps} union all select ticker, date, y, 3, p1 + p2 + p3 from {steps}",
)
def staged_rank_metrics(spark, d):
    """Metrics after each of three stated trees."""
    p = membership.label(scored(spark, d, 21))
    x = F.array(*[F.coalesce(F.round(c, 6), F.lit(-1.0)) for c in ("dist_52w_high_rank", "vol_60d_rank", "ret_63d_rank")])
    out = model.round_metrics(model.staged(_STATED, p.select("ticker", "date", "forward_21d_return", x.alias("__features"))), "forward_21d_return", N)
    return rounded(out, *out.columns)
