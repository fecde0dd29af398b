"""The panel operators as queries over the generated tables, each with its DuckDB equivalent.

The oracle statements are written apart from the Spark plans: exponential means by recursion,
membership by the latest snapshot, activity by range joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.quantiles import with_quantiles
from plumbline.functions.scratch import written
from plumbline.functions.windows import by_key, dotted_ticker
from plumbline.operators import events, fundamentals, membership, portfolio, short_interest, technicals
from plumbline.sources.bindings import bind, with_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Each statement before its tables are filled in, so that others may build on it.
RAW: dict[str, tuple[str, dict[str, str]]] = {}
N, DAY = 5, "1999-06-30"


def query(sql: str | None = None, **more: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            RAW[f.__name__] = sql, more
            SQL[f.__name__] = with_tables(sql, **(TABLES | more))
        return f

    return add


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.select(*cols).dtypes])


def _roll(agg: str, x: str, n: int, key: str = "partition by ticker ") -> str:
    w = f"over ({key}order by date rows between {n - 1} preceding and current row)"
    return f"case when count({x}) {w} = {n} then {agg}({x}) {w} end"


def _market(spark: SparkSession, d: str) -> DataFrame:
    return bind(spark, d, "spy").join(bind(spark, d, "vix"), "date", "full")


TECH = ["ret_1d", "ret_5d", "ret_21d", "ret_63d", "vol_20d", "vol_60d", "vol_ratio", "dist_sma50", "dist_sma200", "dist_52w_high", "trend_regime", "zscore_20d", "zscore_60d", "mfi_14"]
TABLES = {
    "market": "select coalesce(s.date, v.date) as date, s.spy_close, v.vix_close from {spy} s full join {vix} v on s.date = v.date",
    "rets": """select *, close / lag(close) over w - 1 as ret_1d, close / lag(close, 5) over w - 1 as ret_5d, close / lag(close, 21) over w - 1 as ret_21d, close / lag(close, 63) over w - 1 as ret_63d,
               ln(close / lag(close) over w) as lr, (high + low + close) / 3 as tp, row_number() over w as rn from {bars} window w as (partition by ticker order by date)""",
    "flows": "select *, case when tp > lag(tp) over w then tp * volume else 0.0 end as uf, case when tp < lag(tp) over w then tp * volume else 0.0 end as df from {rets} window w as (partition by ticker order by date)",
    "tech0": "select ticker, date, close, ret_1d, ret_5d, ret_21d, ret_63d, volume, " + ", ".join(f"{_roll(a, x, n)} as {name}" for a, x, n, name in (
        ("stddev_samp", "lr", 20, "s20"), ("stddev_samp", "lr", 60, "s60"), ("avg", "volume", 20, "v20"), ("avg", "close", 50, "m50"), ("avg", "close", 200, "m200"), ("avg", "close", 20, "m20"), ("avg", "close", 60, "m60"),
        ("stddev_samp", "close", 20, "c20"), ("stddev_samp", "close", 60, "c60"), ("max", "close", 252, "hi"), ("sum", "uf", 14, "up"), ("sum", "df", 14, "down"))) + " from {flows}",
    "tech": """select ticker, date, close, ret_1d, ret_5d, ret_21d, ret_63d, s20 * sqrt(252) as vol_20d, s60 * sqrt(252) as vol_60d, volume / nullif(v20, 0) as vol_ratio, close / m50 - 1 as dist_sma50, close / m200 - 1 as dist_sma200,
               close / hi - 1 as dist_52w_high, case when m50 > m200 then 1.0 else 0.0 end as trend_regime, (close - m20) / nullif(c20, 0) as zscore_20d, (close - m60) / nullif(c60, 0) as zscore_60d,
               case when down > 0 then 100 - 100 / (1 + up / down) when up > 0 then 100.0 end as mfi_14 from {tech0}""",
    "steps": """select ticker, date, close, rn, greatest(close - lag(close) over w, 0) as g0, case when rn > 1 then greatest(close - lag(close) over w, 0) end as g, case when rn > 1 then greatest(lag(close) over w - close, 0) end as l,
             case when rn = 1 then high - low else greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) end as tr from {rets} window w as (partition by ticker order by date)""",
    "ewm": """select ticker, date, rn, close, cast(null as double) as mg, cast(null as double) as ml, close as fast, close as slow, cast(0 as double) as sig, tr as atr from {steps} where rn = 1 union all
           select s.ticker, s.date, s.rn, s.close, case when e.mg is null then s.g else e.mg * 13 / 14 + s.g / 14 end, case when e.ml is null then s.l else e.ml * 13 / 14 + s.l / 14 end,
                  e.fast * 11 / 13 + s.close * 2 / 13, e.slow * 25 / 27 + s.close * 2 / 27, e.sig * 0.8 + 0.2 * ((e.fast * 11 / 13 + s.close * 2 / 13) - (e.slow * 25 / 27 + s.close * 2 / 27)), e.atr * 13 / 14 + s.tr / 14
           from ewm e join {steps} s on s.ticker = e.ticker and s.rn = e.rn + 1""",
    "exponential": "select ticker, date, case when ml > 0 then 100 - 100 / (1 + mg / ml) when mg > 0 then 100.0 end as rsi_14, fast - slow - sig as macd_hist, atr / close as atr_pct from {ewm}",
    "spyrows": "select date, spy_close - lag(spy_close) over (order by date) as st, row_number() over (order by date) as rn from {spy}",
    "spyewm": """select date, rn, cast(null as double) as mg, cast(null as double) as ml from {spyrows} where rn = 1 union all
              select s.date, s.rn, case when e.mg is null then greatest(s.st, 0) else e.mg * 13 / 14 + greatest(s.st, 0) / 14 end, case when e.ml is null then greatest(-s.st, 0) else e.ml * 13 / 14 + greatest(-s.st, 0) / 14 end from spyewm e join {spyrows} s on s.rn = e.rn + 1""",
    "snapdates": "select distinct date from {membership}",
    "inforce": "select b.date, max(s.date) as snap from (select distinct date from {bars}) b join {snapdates} s on s.date <= b.date group by b.date",
    "pit": "select t.* from {tech} t join {inforce} i on i.date = t.date join {membership} m on m.date = i.snap and m.ticker = t.ticker",
    "ranked": "select *, " + ", ".join(f"case when {c} is not null then (rank() over (partition by date order by {c} nulls last) + (count({c}) over (partition by date, {c}) - 1) / 2.0) / count({c}) over (partition by date) end as {c}_rank" for c in ("dist_52w_high", "vol_60d", "ret_63d")) + " from {pit}",
    "scored": "select *, round(dist_52w_high_rank - vol_60d_rank, 6) as predicted_return from {ranked}",
    "fwd": "select *, lead(close, 21) over (partition by ticker order by date) / close - 1 as f from {scored}",
    "labelled": """select *, greatest(least(f, 0.5), -0.5) as forward_21d_return, greatest(least(f, 0.5), -0.5) - avg(greatest(least(f, 0.5), -0.5)) over (partition by date) as forward_21d_return_demeaned,
                   case when date <= date '1998-12-31' then 'train' when date < date '2000-01-01' then 'val' else 'test' end as split from {fwd} where f is not null""",
    "mframe": f"select *, {_roll('stddev_samp', 'r', 20, '')} * sqrt(252) as spy_vol_20d, {_roll('avg', 'spy_close', 200, '')} as sma from (select *, spy_close / lag(spy_close) over (order by date) - 1 as r from {{market}}) q",
    "earn0": "select * from {filings} where form in ('10-K', '10-Q') or (form = '8-K' and list_contains(string_split(items, ','), '2.02'))",
    "earn": "select ticker, accession, report_date, form, form = '8-K' as is_8k from {earn0} e where form = '8-K' or not exists (select 1 from {earn0} k where k.ticker = e.ticker and k.form = '8-K' and k.report_date between e.report_date - interval '60' day and e.report_date)",
    "trades": """select distinct upper(trim(symbol)) as ticker, filing_date, transaction_date, code as transaction_code, shares, price as price_per_share, round(shares * price, 2) as value
                 from {insider_raw} where form = '4' and code in ('P', 'S') and ownership = 'D'""",
    "firsts": "select * from (select *, row_number() over (partition by ticker, concept, period_end, period_start order by filed, value) as r from {facts_raw}) q where r = 1",
    "q0": "select * from {firsts} where period_start is not null and date_diff('day', period_start, period_end) + 1 between 80 and 100",
    "y0": "select * from {firsts} where period_start is not null and date_diff('day', period_start, period_end) + 1 between 350 and 380",
    "quarters_all": """select ticker, concept, period_start, period_end, filed, value from {q0} union all
        select y.ticker, y.concept, cast(max(q.period_end) + 1 as date), y.period_end, greatest(y.filed, max(q.filed)), y.value - sum(q.value) from {y0} y join {q0} q on q.ticker = y.ticker and q.concept = y.concept and q.period_start >= y.period_start - interval '2' day and q.period_end < y.period_end
        where not exists (select 1 from {q0} z where z.ticker = y.ticker and z.concept = y.concept and z.period_end = y.period_end) group by y.ticker, y.concept, y.period_end, y.filed, y.value having count(*) = 3""",
    "ttm0": """select ticker, concept, period_end, s as ttm, f as asof from (select *, sum(value) over w as s, max(filed) over w as f, count(*) over w as n, min(period_end) over w as p from {quarters_all} window w as (partition by ticker, concept order by period_end rows between 3 preceding and current row)) q
              where n = 4 and date_diff('day', p, period_end) between 240 and 320""",
    "ttm": """select a.*, (select b.ttm from {ttm0} b where b.ticker = a.ticker and b.concept = a.concept and b.period_end < a.period_end and abs(date_diff('day', a.period_end - 365, b.period_end)) <= 30
                           order by abs(date_diff('day', a.period_end - 365, b.period_end)), b.period_end limit 1) as ttm_prior from {ttm0} a""",
    "ends": "select distinct ticker, period_end from {ttm}",
    "fund": "select e.ticker, e.period_end, " + ", ".join(f"max(case when t.concept = '{c}' then t.ttm end) as ttm_{c}, max(case when t.concept = '{c}' then t.ttm_prior end) as ttm_{c}_prior" for c in fundamentals.FLOWS) + ", max(t.asof) as flow_asof from {ends} e join {ttm} t on t.ticker = e.ticker and t.period_end = e.period_end group by e.ticker, e.period_end",
    "snaps": "select ticker, period_end as d, concept, value, filed from {firsts} where period_start is null",
    "fund2": "select f.*, " + ", ".join(f"(select s.value from {{snaps}} s where s.ticker = f.ticker and s.concept = '{c}' and s.d <= f.period_end order by s.d desc limit 1) as {'shares' if c == 'shares' else 'mrq_' + c}" for c in fundamentals.SNAPSHOTS)
    + ", greatest(f.flow_asof, (select max(x.filed) from {snaps} x where x.ticker = f.ticker and x.d = (select max(y.d) from {snaps} y where y.ticker = f.ticker and y.d <= f.period_end))) as asof_date from {fund} f",
    "fund3": "select *, shares * coalesce((select product(s.ratio) from {splits} s where s.ticker = f.ticker and s.date > f.asof_date), 1.0) as shares_adj from {fund2} f",
    "ratios": """select b.ticker, b.date, f.ttm_net_income / case when f.shares_adj * b.close > 0 then f.shares_adj * b.close end as earnings_yield, f.mrq_equity / case when f.shares_adj * b.close > 0 then f.shares_adj * b.close end as book_to_market,
        f.ttm_net_income / case when f.mrq_assets > 0 then f.mrq_assets end as roa, f.mrq_lt_debt / case when f.mrq_equity > 0 then f.mrq_equity end as debt_to_equity, f.mrq_assets_current / case when f.mrq_liabilities_current > 0 then f.mrq_liabilities_current end as current_ratio,
        f.ttm_revenue / case when f.ttm_revenue_prior > 0 then f.ttm_revenue_prior end - 1 as sales_growth_yoy, f.ttm_operating_income / case when f.ttm_operating_income_prior > 0 then f.ttm_operating_income_prior end - 1 as op_income_growth_yoy
        from {bars} b left join lateral (select * from {fund3} f where f.ticker = b.ticker and f.asof_date <= b.date order by f.asof_date desc, f.period_end desc limit 1) f on true""",
    "tdates": "select date, row_number() over (order by date) - 1 as i from (select distinct date from {scored} where date >= date '2000-01-01') q",
    "test": "select s.date, s.ticker, s.predicted_return, s.ret_1d, t.i from {scored} s join {tdates} t on t.date = s.date",
    "basket": f"select date, i, ticker, 1.0 / count(*) over (partition by date) as weight from (select *, row_number() over (partition by date order by predicted_return desc nulls last, ticker) as p from {{test}}) q where p <= {N}",
    "held": """select v.variant, o.o as off, (b.i - o.o) // 21 as turn, b.i, b.ticker, b.weight * case when v.variant = 'raw' or m.spy_vol_20d is null or m.spy_vol_20d <= 0 then 1.0 else least(1.0, 0.2 / m.spy_vol_20d) end as w
              from {basket} b join (select unnest(range(0, 21)) as o) o on b.i >= o.o and (b.i - o.o) % 21 = 0 cross join (select 'raw' as variant union all select 'overlay') v left join {mframe} m on m.date = b.date""",
    "turnover": "select variant, off, turn, sum(abs(dw)) as t from (select variant, off, turn, ticker, sum(x) as dw from (select variant, off, turn, ticker, w as x from {held} union all select variant, off, turn + 1, ticker, -w from {held}) a group by 1, 2, 3, 4) b group by 1, 2, 3",
    "daily": """select v.variant, o.o as off, d.date, d.i, coalesce((select sum(h.w * coalesce(t.ret_1d, 0)) from {held} h join {test} t on t.ticker = h.ticker and t.i = d.i where h.variant = v.variant and h.off = o.o and h.i < d.i and h.i >= d.i - 21), 0) as r
               from {tdates} d cross join (select unnest(range(0, 21)) as o) o cross join (select 'raw' as variant union all select 'overlay') v""",
    "nav": """select d.variant, d.off, d.date, exp(sum(ln((1 + d.r) * (1 - case when d.i >= d.off and (d.i - d.off) % 21 = 0 then coalesce(t.t, 0) * 0.0005 else 0 end))) over (partition by d.variant, d.off order by d.date)) as nav
             from {daily} d left join {turnover} t on t.variant = d.variant and t.off = d.off and t.turn = (d.i - d.off) // 21 and d.i >= d.off""",
}


@query("select ticker, date, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, volume from {bars} qualify count(*) over (partition by ticker) >= 500")
def price_scan(spark, d):
    return rounded(membership.with_history(bind(spark, d, "bars")), "ticker", "date", "open", "high", "low", "close", "volume")


@query("select date, round(spy_close, 6) as spy_close, round(vix_close, 6) as vix_close from {market}")
def market_scan(spark, d):
    return rounded(_market(spark, d), "date", "spy_close", "vix_close")


@query(
    """select w.ticker, coalesce(b.n, 0) as n_rows, b.last_date, case when coalesce(b.n, 0) = 0 then 'failed' when b.n < 500 then 'short' when h.last_date is null then 'new' when h.last_date >= date '2001-10-31' or b.last_date <= h.last_date then 'fresh' else 'updated' end as status
       from {wanted} w left join (select ticker, count(*) as n, max(date) as last_date from {bars} group by ticker) b on b.ticker = w.ticker left join (select ticker, max(date) as last_date from {held_bars} group by ticker) h on h.ticker = w.ticker""",
    wanted="select cast(s_suppkey as string) as ticker from {supplier} union select cast(s_suppkey + 100000000 as string) from {supplier} where s_suppkey <= 3",
    held_bars="select * from {bars} where date < date '2001-11-10' and cast(ticker as int) % 3 <> 0",
)
def coverage_report(spark, d):
    bars, s = bind(spark, d, "bars"), bind(spark, d, "supplier")
    held = bars.where("date < '2001-11-10' and cast(ticker as int) % 3 <> 0")
    wanted = s.select(F.explode(F.when(F.col("s_suppkey") <= 3, F.array("s_suppkey", F.col("s_suppkey") + 100000000)).otherwise(F.array("s_suppkey"))).alias("k")).select(F.col("k").cast("string").alias("ticker"))
    return membership.coverage(bars, "2001-11-01", held=held, wanted=wanted)


@query("select ticker, date, round(close, 6) as close, close > 0 as late from {bars} where date >= date '2000-06-01' union all select ticker, date, round(close, 6), false from {bars} where date < date '2000-06-01'")
def tail_merge(spark, d):
    bars = bind(spark, d, "bars").select("ticker", "date", F.round("close", 6).alias("close"))
    old = bars.where("date < '2001-01-01'").withColumn("late", F.lit(False))
    return membership.merge_tail(old, bars.where("date >= '2000-06-01'").withColumn("late", F.lit(True)), ["ticker", "date"])


@query("select ticker, min(date) as first_date, max(date) as last_date, count(*) as n_days from {pit} group by ticker")
def pit_filter(spark, d):
    kept = membership.filter_members(bind(spark, d, "bars"), bind(spark, d, "membership"))
    return kept.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_days"))


@query(f"select ticker from {{membership}} where date = (select max(date) from {{membership}} where date <= date '{DAY}')")
def members_on_day(spark, d):
    return membership.members_on(bind(spark, d, "membership"), DAY)


@query(f"select distinct ticker from {{membership}} where date >= date '{DAY}'")
def tickers_since_day(spark, d):
    return membership.tickers_since(bind(spark, d, "membership"), DAY)


@query("select date, ticker, false as synthetic from {membership} union all select date '2029-12-31', ticker, true from {membership} where date = (select min(date) from {membership}) union all select date '2030-01-01', ticker, true from {membership} where date = (select max(date) from {membership})")
def snapshot_append(spark, d):
    m = written(bind(spark, d, "membership").withColumn("synthetic", F.lit(False)), "membership")
    first = m.join(F.broadcast(m.agg(F.min("date").alias("date"))), "date", "left_semi").select("ticker")  # one row
    last = membership.members_on(m, "2100-01-01")
    m = membership.append_snapshot(m, first, "2029-12-31")
    m = membership.append_snapshot(m, first, "2030-01-01")
    m = membership.append_snapshot(m, last, "2030-01-01")  # a second run on that day replaces the first
    return membership.append_snapshot(m, first, "1999-06-30")  # inside the authoritative range: nothing changes


@query("select cast(s_suppkey as string) || '-B' as ticker, s_name as security, r_name as gics_sector, n_name as gics_sub_industry, date '2001-01-01' as as_of from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey")
def sector_roster(spark, d):
    s, n, r = (bind(spark, d, x) for x in ("supplier", "nation", "region"))
    raw = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".B ")).alias("Symbol"), F.col("s_name").alias("Security"), F.col("r_name").alias("GICS Sector"), F.col("n_name").alias("GICS Sub-Industry"), "s_nationkey")
    return membership.sector_dimension(raw, "2001-01-01")


@query("select ticker, replace(ticker, '-', '.') as dotted, lpad(cast(min(s_suppkey) as varchar), 10, '0') as cik from (select 'T' || cast(s_nationkey as varchar) || '-' || chr(cast(65 + s_suppkey % 2 as int)) as ticker, s_suppkey from {supplier}) q group by ticker")
def ticker_ciks(spark, d):
    s = bind(spark, d, "supplier").select("s_suppkey", F.format_string("t%d.%s", "s_nationkey", F.when(F.col("s_suppkey") % 2 == 0, "a").otherwise("b")).alias("ticker"))
    # The registry is one JSON object; here one a nation, whose entries are numbered by key.
    entry = F.struct(F.col("s_suppkey").cast("string").alias("no"), F.struct(F.col("s_suppkey").cast("string").alias("cik_str"), "ticker").alias("e"))
    raw = s.groupBy(F.regexp_extract("ticker", "^t(\\d+)", 1)).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("payload"))
    return membership.cik_map(raw).select("ticker", dotted_ticker(F.col("ticker")).alias("dotted"), "cik")


@query("select s.ticker, s.security, s.gics_sector, s.gics_sub_industry from {sectors} s where s.ticker in (select ticker from {membership} where date = (select max(date) from {membership}))")
def current_universe(spark, d):
    return bind(spark, d, "sectors").join(membership.members_on(bind(spark, d, "membership"), "2100-01-01"), "ticker", "left_semi").select("ticker", "security", "gics_sector", "gics_sub_industry")


@query("select date, ticker from (select date, unnest(string_split(t, ',')) as ticker from (select date, string_agg(ticker, ',') as t from {membership} group by date) q) r")
def membership_from_lists(spark, d):
    lists = bind(spark, d, "membership").groupBy("date").agg(F.array_join(F.sort_array(F.collect_list("ticker")), ",").alias("tickers"))
    return membership.from_lists(lists)


@query("select ticker, date, " + ", ".join(f"round({c}, 6) as {c}" for c in TECH) + " from {tech}")
def rolling_technicals(spark, d):
    return rounded(technicals.rolling_technicals(bind(spark, d, "bars")), "ticker", "date", *TECH)


@query("select ticker, date, round(rsi_14, 6) as rsi_14, round(macd_hist, 6) as macd_hist, round(atr_pct, 6) as atr_pct from {exponential}")
def exponential_technicals(spark, d):
    return rounded(technicals.exponential_technicals(bind(spark, d, "bars")), "ticker", "date", "rsi_14", "macd_hist", "atr_pct")


@query(
    "select ticker, date, round(case when n = 60 then cv end / nullif(case when ns = 60 then vs end, 0), 6) as beta_60d, round(ret_5d - s5, 6) as excess_ret_5d, round(ret_21d - s21, 6) as excess_ret_21d from {joined}",
    sret="select date, spy_close / lag(spy_close) over (order by date) - 1 as s1, spy_close / lag(spy_close, 5) over (order by date) - 1 as s5, spy_close / lag(spy_close, 21) over (order by date) - 1 as s21 from {spy}",
    joined="select r.ticker, r.date, ret_5d, ret_21d, s5, s21, covar_samp(ret_1d, s1) over w as cv, var_samp(s1) over w as vs, count(s1) over w as ns, count(ret_1d + s1) over w as n from {rets} r left join {sret} s on s.date = r.date window w as (partition by r.ticker order by r.date rows between 59 preceding and current row)",
)
def market_context(spark, d):
    return rounded(technicals.market_context(bind(spark, d, "bars"), _market(spark, d)), "ticker", "date", "beta_60d", "excess_ret_5d", "excess_ret_21d")


@query(
    f"select date, round(spy_close / lag(spy_close, 21) over (order by date) - 1, 6) as spy_ret_21d, case when {_roll('avg', 'spy_close', 50, '')} > {_roll('avg', 'spy_close', 200, '')} then 1.0 else 0.0 end as spy_trend_regime, round(vix_close, 6) as vix_level, round((vix_close - {_roll('avg', 'vix_close', 20, '')}) / nullif({_roll('stddev_samp', 'vix_close', 20, '')}, 0), 6) as vix_zscore_20d, round(spy_rsi_14, 6) as spy_rsi_14 from {{market}} left join (select date, case when ml > 0 then 100 - 100 / (1 + mg / ml) when mg > 0 then 100.0 end as spy_rsi_14 from {{spyewm}}) r using (date)"
)
def market_regime(spark, d):
    return rounded(technicals.regime(_market(spark, d)), "date", "spy_ret_21d", "spy_trend_regime", "vix_level", "vix_zscore_20d", "spy_rsi_14")


@query("select date, round(r, 6) as spy_ret_1d, round(sma, 6) as spy_sma200, round(spy_vol_20d, 6) as spy_vol_20d, coalesce(spy_close > sma and vix_close < 25, false) as gate from {mframe}")
def market_frame(spark, d):
    return rounded(technicals.market_frame(_market(spark, d)), "date", "spy_ret_1d", "spy_sma200", "spy_vol_20d", "gate")


def scored(spark: SparkSession, d: str, horizon: int | None = None) -> DataFrame:
    """The filtered panel with ranks and the stand-in score. horizon: add `future_close`, looked up so many of the ticker's rows later while rows still lie by ticker."""
    p = membership.filter_members(technicals.rolling_technicals(bind(spark, d, "bars")), bind(spark, d, "membership"))
    if horizon is not None:
        p = p.withColumn("future_close", F.lead("close", horizon).over(by_key()))
    p = membership.ranks(p, ["dist_52w_high", "vol_60d", "ret_63d"])
    return p.withColumn("predicted_return", F.round(F.col("dist_52w_high_rank") - F.col("vol_60d_rank"), 6))


@query("select ticker, date, round(dist_52w_high_rank, 6) as dist_52w_high_rank, round(vol_60d_rank, 6) as vol_60d_rank, round(ret_63d_rank, 6) as ret_63d_rank, predicted_return from {scored}")
def cross_sectional_ranks(spark, d):
    return scored(spark, d).select("ticker", "date", *[F.round(c, 6).alias(c) for c in ("dist_52w_high_rank", "vol_60d_rank", "ret_63d_rank")], "predicted_return")


@query("select p.ticker, p.date, coalesce(s.gics_sector, 'Unknown') as gics_sector, round(ret_5d - avg(ret_5d) over w, 6) as excess_ret_5d_vs_sector, case when s.gics_sector is not null then round(ret_21d - avg(ret_21d) over w, 6) end as excess_ret_21d_vs_sector from {pit} p left join {sectors} s on s.ticker = p.ticker window w as (partition by p.date, coalesce(s.gics_sector, 'Unknown'))")
def sector_relative(spark, d):
    p = membership.filter_members(technicals.rolling_technicals(bind(spark, d, "bars")), bind(spark, d, "membership"))
    return rounded(membership.sector_relative(membership.with_sector(p, bind(spark, d, "sectors"))), "ticker", "date", "gics_sector", "excess_ret_5d_vs_sector", "excess_ret_21d_vs_sector")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return membership.time_split(membership.label(scored(spark, d, 21)))


@query("select ticker, date, split, round(forward_21d_return, 6) as forward_21d_return, round(forward_21d_return_demeaned, 6) as forward_21d_return_demeaned from {labelled}")
def forward_labels(spark, d):
    return rounded(labelled(spark, d), "ticker", "date", "split", "forward_21d_return", "forward_21d_return_demeaned")


@query("select split, count(*) as n_rows, min(date) as first_date, max(date) as last_date, count(distinct ticker) as n_tickers, round(avg(forward_21d_return), 6) as mean, round(stddev_samp(forward_21d_return), 6) as std, round(median(forward_21d_return), 6) as median, round(avg(case when forward_21d_return > 0 then 1.0 else 0.0 end), 6) as positive from {labelled} group by split")
def split_summary(spark, d):
    y = F.col("forward_21d_return")
    p = written(labelled(spark, d).select("split", "date", "ticker", "forward_21d_return"), "labelled")
    s = p.groupBy("split").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("ticker").alias("n_tickers"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.avg((y > 0).cast("double")).alias("positive"))
    s = with_quantiles(s, p, "forward_21d_return", {"median": 0.5}, ("split",))
    return rounded(s, *s.columns)


@query("select count(*) as n, round(avg(forward_21d_return), 6) as mean, round(min(forward_21d_return), 6) as low, round(quantile_cont(forward_21d_return, 0.25), 6) as q25, round(median(forward_21d_return), 6) as median, round(stddev_samp(forward_21d_return), 6) as std, round(quantile_cont(forward_21d_return, 0.75), 6) as q75, round(max(forward_21d_return), 6) as high, sum(case when abs(f) > 0.5 then 1 else 0 end) as n_clipped from {labelled}")
def label_describe(spark, d):
    p = written(labelled(spark, d).select("forward_21d_return", "clipped"), "labelled")
    s = p.agg(F.count("*").alias("n"), F.avg("forward_21d_return").alias("mean"), F.min("forward_21d_return").alias("low"), F.stddev_samp("forward_21d_return").alias("std"), F.max("forward_21d_return").alias("high"), F.count_if("clipped").alias("n_clipped"))
    s = with_quantiles(s, p, "forward_21d_return", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return rounded(s, *s.columns)


@query("select 'ret_63d' as column_name, count(*) - count(ret_63d) as n_null from {tech} union all select 'dist_52w_high', count(*) - count(dist_52w_high) from {tech} union all select 'vol_20d', count(*) - count(vol_20d) from {tech}")
def null_report(spark, d):
    return membership.null_counts(technicals.rolling_technicals(bind(spark, d, "bars")).select("ret_63d", "dist_52w_high", "vol_20d")).withColumnRenamed("column", "column_name")


@query("select count(distinct date) + 1 as n_snapshots, 1 as n_synthetic, count(distinct ticker) as n_tickers, min(date) as first_date, date '2030-01-01' as last_date, (select count(*) from {membership} where date = (select max(date) from {membership})) as n_latest from {membership}")
def membership_summary(spark, d):
    m = bind(spark, d, "membership").withColumn("synthetic", F.lit(False))
    m = written(m, "membership")
    return membership.summary(membership.append_snapshot(m, membership.members_on(m, "2029-12-31"), "2030-01-01"))


@query("select gics_sector, count(*) as n from {sectors} group by gics_sector")
def sector_counts(spark, d):
    return bind(spark, d, "sectors").groupBy("gics_sector").agg(F.count("*").alias("n"))


@query("select (select count(*) from {bars}) as n_before, (select count(*) from {pit}) as n_after")
def pit_drop_count(spark, d):
    b = bind(spark, d, "bars")
    kept = membership.filter_members(b, bind(spark, d, "membership")).agg(F.count("*").alias("n_after"))
    return b.agg(F.count("*").alias("n_before")).crossJoin(F.broadcast(kept))


@query("select ticker, accession, report_date, form, is_8k from {earn}")
def earnings_dates(spark, d):
    return events.earnings_dates(bind(spark, d, "filings")).select("ticker", "accession", "report_date", "form", "is_8k")


@query("select ticker, report_date, source, form from (select ticker, report_date, source, form, row_number() over (partition by ticker, report_date order by p, form) as r from (select ticker, report_date, 'filing' as source, form, 0 as p from {earn} where report_date < date '2001-01-01' union all select ticker, report_date, 'calendar', null, 1 from {filings} where form = '8-K' and items like '2.02%' and report_date >= date '2001-01-01') u) q where r = 1")
def earnings_calendar(spark, d):
    f = bind(spark, d, "filings")
    coming = events.upcoming(f.where("form = '8-K' and array_contains(split(items, ','), '2.02')"), "2001-01-01")
    return events.merge_calendars(events.earnings_dates(f).where("report_date < '2001-01-01'"), coming)


@query("select b.ticker, b.date, case when nx is not null then least(date_diff('day', b.date, nx), 90) end as days_to_earnings, case when la is not null then least(date_diff('day', la, b.date), 90) end as days_since_earnings, case when date_diff('day', la, b.date) between 1 and 5 then 1 else 0 end as post_earnings_drift_window from (select ticker, date, (select min(report_date) from {earn} e where e.ticker = x.ticker and e.report_date >= x.date) as nx, (select max(report_date) from {earn} e where e.ticker = x.ticker and e.report_date < x.date) as la from {bars} x) b")
def earnings_distance(spark, d):
    p = bind(spark, d, "bars").select("ticker", "date")
    return events.earnings_distance(p, events.earnings_dates(bind(spark, d, "filings"))).select("ticker", "date", F.col("days_to_earnings").cast("long").alias("days_to_earnings"), F.col("days_since_earnings").cast("long").alias("days_since_earnings"), "post_earnings_drift_window")


def _trades(spark: SparkSession, d: str) -> DataFrame:
    return events.insider_trades(bind(spark, d, "insider_submission"), bind(spark, d, "insider_trans"))


@query("select ticker, filing_date, transaction_date, transaction_code, shares, price_per_share, value from {trades}")
def insider_trades(spark, d):
    return _trades(spark, d)


@query("select ticker, count(*) as n from {trades} group by ticker")
def insider_row_counts(spark, d):
    return events.trade_counts(_trades(spark, d))


@query("""select b.ticker, b.date, count(case when t.transaction_code = 'P' and t.filing_date > b.date - interval '60' day then 1 end) as insider_buy_count_60d, count(case when t.transaction_code = 'S' and t.filing_date > b.date - interval '60' day then 1 end) as insider_sell_count_60d,
    round(coalesce(sum(case when t.filing_date > b.date - interval '60' day then case when t.transaction_code = 'P' then t.value else -t.value end end), 0), 2) as insider_net_dollar_60d, case when count(case when t.transaction_code = 'P' then 1 end) > 0 then least(date_diff('day', max(case when t.transaction_code = 'P' then t.filing_date end), b.date), 365) end as days_since_last_insider_buy
    from {bars} b left join {trades} t on t.ticker = b.ticker and t.filing_date <= b.date group by b.ticker, b.date""")
def insider_activity(spark, d):
    out = events.insider_activity(bind(spark, d, "bars").select("ticker", "date"), _trades(spark, d))
    return out.withColumn("insider_net_dollar_60d", F.round("insider_net_dollar_60d", 2)).withColumn("days_since_last_insider_buy", F.col("days_since_last_insider_buy").cast("long"))


def _macro_sql(s: str) -> str:
    return f"(select try_cast(value as double) from {{macro_long}} m where m.series = '{s}' and m.value <> '.' and m.date <= t.date order by m.date desc limit 1)"


@query(f"select date, round({_macro_sql('DGS10')} - {_macro_sql('DGS3MO')}, 6) as term_spread_10y3m, round({_macro_sql('BAA10Y')}, 6) as ig_credit_spread, round({_macro_sql('T5YIFR')}, 6) as inflation_5y5y from (select distinct date from {{bars}}) t")
def macro_regime(spark, d):
    out = technicals.macro_aligned(bind(spark, d, "macro_long"), bind(spark, d, "bars"))
    return rounded(out, *out.columns)


@query("select ticker, concept, period_start, period_end, filed, round(value, 2) as value, restated from {firsts}")
def facts_first_filed(spark, d):
    return fundamentals.first_filed(bind(spark, d, "facts_raw")).select("ticker", "concept", "period_start", "period_end", "filed", F.round("value", 2).alias("value"), "restated")


@query("select case when period_start is null then 'unknown' when date_diff('day', period_start, period_end) + 1 between 80 and 100 then 'quarterly' when date_diff('day', period_start, period_end) + 1 between 350 and 380 then 'annual' else 'unknown' end as kind, count(*) as n from {facts_raw} group by 1")
def fact_spans(spark, d):
    return bind(spark, d, "facts_raw").groupBy(fundamentals.span_kind(F.col("period_start"), F.col("period_end")).alias("kind")).agg(F.count("*").alias("n"))


@query("select ticker, concept, period_start, period_end, filed, round(value / 1000, 6) as value from {quarters_all}")
def quarterly_series(spark, d):
    return fundamentals.quarterly(fundamentals.first_filed(bind(spark, d, "facts_raw"))).select("ticker", "concept", "period_start", "period_end", "filed", F.round(F.col("value") / 1000, 6).alias("value"))


@query("select ticker, concept, period_end, round(ttm.ttm / 1000, 6) as ttm, ttm.asof as known, round(ttm_prior / 1000, 6) as ttm_prior from {ttm}")
def ttm_sums(spark, d):
    t = fundamentals.year_before(fundamentals.ttm(fundamentals.quarterly(fundamentals.first_filed(bind(spark, d, "facts_raw")))))
    return t.select("ticker", "concept", "period_end", F.round(F.col("ttm") / 1000, 6).alias("ttm"), F.col("asof").alias("known"), F.round(F.col("ttm_prior") / 1000, 6).alias("ttm_prior"))


@query("select ticker, period_end, asof_date, round(ttm_revenue / 1000, 6) as ttm_revenue, round(ttm_revenue_prior / 1000, 6) as ttm_revenue_prior, round(mrq_equity / 1000, 6) as mrq_equity, shares, shares_adj from {fund3}")
def fundamentals_panel(spark, d):
    return fundamentals.fundamentals(bind(spark, d, "facts_raw"), bind(spark, d, "splits")).select("ticker", "period_end", "asof_date", *[F.round(F.col(c) / 1000, 6).alias(c) for c in ("ttm_revenue", "ttm_revenue_prior", "mrq_equity")], "shares", "shares_adj")


RATIOS = ["earnings_yield", "book_to_market", "roa", "debt_to_equity", "current_ratio", "sales_growth_yoy", "op_income_growth_yoy"]


@query("select ticker, date, " + ", ".join(f"round({c}, 9) as {c}" for c in RATIOS) + " from {ratios}")
def fundamental_ratios(spark, d):
    fund = fundamentals.fundamentals(bind(spark, d, "facts_raw"), bind(spark, d, "splits"))
    return rounded(fundamentals.attach_fundamentals(bind(spark, d, "bars").select("ticker", "date", "close"), fund), "ticker", "date", *RATIOS, places=9)


@query("select ticker, period_end from {fund3} where not coalesce(mrq_lt_debt / nullif(greatest(mrq_equity, 0), 0) > 10, false) and not coalesce(ttm_revenue / nullif(greatest(ttm_revenue_prior, 0), 0) - 1 < -0.05, false)")
def quality_filtered(spark, d):
    f = fundamentals.fundamentals(bind(spark, d, "facts_raw"), bind(spark, d, "splits"))
    f = f.withColumn("debt_to_equity", fundamentals.over_safe(F.col("mrq_lt_debt"), F.col("mrq_equity"))).withColumn("sales_growth_yoy", fundamentals.over_safe(F.col("ttm_revenue"), F.col("ttm_revenue_prior")) - 1)
    return fundamentals.quality_filter(f, {"debt_to_equity": (1, 10.0), "sales_growth_yoy": (-1, -0.05), "absent": (1, 0.0)}).select("ticker", "period_end")


@query(
    """select split, round(sqrt(sum(se) / sum(n)), 6) as rmse, round(avg(ic), 6) as ic, round(avg(spread), 6) as decile_spread, round(avg(top), 6) as topn_mean, round(case when count(top) >= 2 then case when stddev_samp(top) > 0 then avg(top) / stddev_samp(top) else 0 end end, 6) as topn_sharpe from {perdate} group by split""",
    rk="""select split, date, y, p, (rank() over (partition by split, date order by y) + (count(*) over (partition by split, date, y) - 1) / 2.0) as ry, (rank() over (partition by split, date order by p) + (count(*) over (partition by split, date, p) - 1) / 2.0) as rp,
          row_number() over (partition by split, date order by p desc, ticker) as u, count(*) over (partition by split, date) as n from (select split, date, ticker, forward_21d_return_demeaned as y, predicted_return as p from {labelled} where predicted_return is not null) q""",
    perdate=f"""select split, date, covar_samp(ry, rp) / nullif(stddev_samp(ry) * stddev_samp(rp), 0) as ic, case when max(n) >= 10 then avg(case when u <= n // 10 then y end) - avg(case when n - u + 1 <= n // 10 then y end) end as spread,
          case when max(n) >= {N} then avg(case when u <= {N} then y end) end as top, sum((y - p) * (y - p)) as se, count(*) as n from {{rk}} group by split, date""",
)
def ranking_metrics(spark, d):
    m = portfolio.rank_metrics(labelled(spark, d), "forward_21d_return_demeaned", "predicted_return", N)
    return rounded(m, *m.columns)


@query(f"select date, ticker, pick, predicted_return, round(case when t > 0 then greatest(coalesce(predicted_return, 0), 0) / t else 1.0 / n end, 6) as weight from (select date, ticker, predicted_return, pick, sum(greatest(coalesce(predicted_return, 0), 0)) over (partition by date) as t, count(*) over (partition by date) as n from (select *, row_number() over (partition by date order by predicted_return desc nulls last, ticker) as pick from {{scored}}) q where pick <= {N}) r")
def weighted_picks(spark, d):
    return portfolio.weighted(portfolio.top_picks(scored(spark, d), N), "pred").select("date", "ticker", "pick", "predicted_return", F.round("weight", 6).alias("weight"))


def _nav(spark: SparkSession, d: str) -> DataFrame:
    panel = scored(spark, d).where("date >= '2000-01-01'").select("date", "ticker", "predicted_return", "ret_1d")
    return portfolio.backtest(panel, technicals.market_frame(_market(spark, d)), n=N)


@query('select variant, off as "offset", date, round(nav, 6) as nav from {nav}')
def shifted_start_navs(spark, d):
    return _nav(spark, d).select("variant", "offset", "date", F.round("nav", 6).alias("nav"))


PERF = """case when fn > 0 then pow(fn, 252.0 / n) - 1 else -1 end as cagr, vol, case when vol > 0 then (case when fn > 0 then pow(fn, 252.0 / n) - 1 else -1 end) / vol else 0 end as sharpe, dd as max_drawdown, fn as final_nav from
    (select {by}, arg_max(nav, date) as fn, count(r) as n, stddev_samp(r) * sqrt(252) as vol, min(nav / hi - 1) as dd from (select *, nav / lag(nav) over w - 1 as r, max(nav) over w as hi from {nav} window w as (partition by {by} order by date)) q group by {by}) s"""
STATS = ["cagr", "vol", "sharpe", "max_drawdown", "final_nav"]
_PERF_OFFSET = "select variant, off, " + PERF.replace("{by}", "variant, off")


@query("select variant, off as \"offset\", " + ", ".join(f"round({c}, 5) as {c}" for c in STATS) + " from {perf}", perf=_PERF_OFFSET)
def performance_stats(spark, d):
    return rounded(portfolio.performance(_nav(spark, d)), "variant", "offset", *STATS, places=5)


@query("select variant, date, round(avg(nav), 5) as mean_nav, round(quantile_cont(nav, 0.1), 5) as p10, round(quantile_cont(nav, 0.9), 5) as p90 from {nav} group by variant, date")
def offset_bands(spark, d):
    return rounded(portfolio.offset_band(_nav(spark, d)), "variant", "date", "mean_nav", "p10", "p90", places=5)


@query("select date, round(exp(sum(ln(1 + coalesce(r, 0))) over (order by date)), 6) as nav from {mframe} where date >= date '2000-01-01'")
def benchmark_nav(spark, d):
    return rounded(portfolio.buy_and_hold(technicals.market_frame(_market(spark, d)), "2000-01-01"), "date", "nav")


_RANKED = f"select date, ticker from (select date, ticker, row_number() over (partition by date order by predicted_return desc nulls last, ticker) as pick from {{scored}}) q where pick <= {N}"


@query(
    "select coalesce(a.ticker, b.ticker) as ticker, case when a.ticker is null then 'SELL' when b.ticker is null then 'BUY' else 'HOLD' end as action from {after_} a full join {before_} b on a.ticker = b.ticker",
    best=_RANKED,
    after_="select ticker from {best} where date = (select max(date) from {best} where date <= date '2001-03-30')",
    before_="select ticker from {best} where date = (select max(date) from {best} where date < (select max(date) from {best} where date <= date '2001-03-30'))",
)
def picks_difference(spark, d):
    p = written(portfolio.top_picks(scored(spark, d).where("date <= '2001-03-30'"), N).select("date", "ticker"), "picks")  # N rows a date, read several times
    today = p.join(F.broadcast(p.agg(F.max("date").alias("date"))), "date", "left_semi")
    return portfolio.picks_diff(portfolio.picks_before(p), today)


LIMITS = {"vol_60d": (1, 0.9), "dist_sma200": (-1, -0.2)}
PASSES = "not coalesce(vol_60d > 0.9, false) and not coalesce(dist_sma200 < -0.2, false)"


@query(
    f"select date, ticker, predicted_return, round(least(1.0, case when v is null or v <= 0 then 1.0 else 0.2 / v end) / count(*) over (), 6) as weight from (select s.date, s.ticker, s.predicted_return, row_number() over (order by s.predicted_return desc nulls last, s.ticker) as p, (select arg_max(spy_vol_20d, date) from {{mframe}} where spy_vol_20d is not null) as v from {{scored}} s where s.predicted_return is not null and {PASSES} and s.date = (select max(date) from {{scored}} where predicted_return is not null)) q where p <= {N}"
)
def live_picks(spark, d):
    p = portfolio.live_picks(scored(spark, d), technicals.market_frame(_market(spark, d)), N, limits=LIMITS)
    return p.withColumn("weight", F.round("weight", 6))


@query(
    """select ticker, settlement_date, (select max(dd) from (select cast(settlement_date + cast(x as int) as date) as dd, row_number() over (order by x) as k from (select unnest(range(1, 20)) as x) r where dayofweek(settlement_date + cast(x as int)) not in (0, 6)) z where k <= 8) as publish_date,
       cast(n as double) as current_short, round(volume, 4) as avg_daily_volume, round(n / volume, 8) as days_to_cover from {settled} where year(settlement_date) >= 1996""",
    settled="""select ticker, settlement_date, n, t / n as volume from (select ticker, settlement_date, count(*) as n, sum(cast(o_totalprice as decimal(18, 2))) as t from (
        select 'S' || cast(o_custkey % (select count(*) from {supplier}) as varchar) || '-A' as ticker, o_totalprice, case when day(cast(o_orderdate as date)) <= 15 then cast(date_trunc('month', cast(o_orderdate as date)) + interval '14' day as date) else last_day(cast(o_orderdate as date)) end as settlement_date from {orders}) a group by ticker, settlement_date) b""",
)
def short_interest_published(spark, d):
    count = bind(spark, d, "supplier").agg(F.count("*").alias("k"))
    o = bind(spark, d, "orders").crossJoin(F.broadcast(count)).select(F.format_string("s%d.a ", F.col("o_custkey") % F.col("k")).alias("code"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    o = o.withColumn("settled", F.when(F.dayofmonth("day") <= 15, F.date_add(F.trunc("day", "month"), 14)).otherwise(F.last_day("day")))
    s = o.groupBy("code", "settled").agg(F.count("*").alias("n"), F.sum("price").alias("t")).withColumn("volume", F.col("t").cast("double") / F.col("n"))
    # Two styles of files: the later one is delivered again with the rows of the first, which it replaces.
    text = lambda c: F.col(c).cast("string")
    old = s.select(text("settled").alias("Settlement Date"), F.col("code").alias("Symbol Code"), F.lit("0").alias("Current Short Interest"), text("volume").alias("Avg Daily Volume"), F.lit("n/a").alias("Days To Cover"))
    new = s.select(text("settled").alias("settlementDate"), F.col("code").alias("symbol"), text("n").alias("currentShortPositionQuantity"), text("volume").alias("averageDailyVolumeQuantity"), (F.col("n") / F.col("volume")).cast("string").alias("daysToCoverQuantity"))
    rows = short_interest.normalise(old).withColumn("file_no", F.lit(1)).unionByName(short_interest.normalise(new).withColumn("file_no", F.lit(2)))
    out = short_interest.published(rows, 1996, "file_no")
    return out.select("ticker", "settlement_date", "publish_date", "current_short", F.round("avg_daily_volume", 4).alias("avg_daily_volume"), F.round("days_to_cover", 8).alias("days_to_cover"))


def momentum_picks(spark: SparkSession, sf_dir: str, n: int = N) -> DataFrame:
    """Flagship: indicators, membership without hindsight, ranks, the best n of each date."""
    return portfolio.top_picks(scored(spark, sf_dir), n).select("date", "ticker", "pick", F.round("ret_21d", 6).alias("ret_21d"), F.round("vol_20d", 6).alias("vol_20d"), F.round("dist_sma200", 6).alias("dist_sma200"), "predicted_return")


query(f"select date, ticker, pick, round(ret_21d, 6) as ret_21d, round(vol_20d, 6) as vol_20d, round(dist_sma200, 6) as dist_sma200, predicted_return from (select *, row_number() over (partition by date order by predicted_return desc nulls last, ticker) as pick from {{scored}}) q where pick <= {N}")(momentum_picks)
