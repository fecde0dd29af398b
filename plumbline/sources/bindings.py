"""Canonical panel tables derived from the generated tables.

Each derivation is one portable SELECT over tables named in braces; Spark fills the braces with
DataFrames, a test oracle with its own names. Money is summed as decimals and divided once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.windows import dealt

N_TICKERS = "(select count(*) from {supplier})"

SELECTS = {
    "bars": """
        select ticker, date, coalesce(lag(close) over (partition by ticker order by date), close) as open, close * (1 + disc / 2) as high,
               close * (1 - disc / 2) as low, close, volume
        from (select ticker, date, volume, disc, cast(sum(e) over w as double) / cast(sum(q) over w as double) as close
              from (select cast(l_suppkey as string) as ticker, cast(l_shipdate as date) as date, sum(cast(l_extendedprice as decimal(18, 2))) as e,
                           sum(cast(l_quantity as decimal(18, 2))) as q, cast(sum(cast(l_quantity as decimal(18, 2))) as double) as volume,
                           cast(sum(cast(l_discount as decimal(18, 2))) as double) / count(*) as disc
                    from {lineitem} group by l_suppkey, cast(l_shipdate as date)) as d
              window w as (partition by ticker order by date rows between 19 preceding and current row)) as c""",
    "market_all": """
        select date, cast(sum(e) over w as double) / cast(sum(q) over w as double) as spy_close, 10 + 100 * disc as vix_close
        from (select cast(l_shipdate as date) as date, sum(cast(l_extendedprice as decimal(18, 2))) as e, sum(cast(l_quantity as decimal(18, 2))) as q,
                     cast(sum(cast(l_discount as decimal(18, 2))) as double) / count(*) as disc
              from {lineitem} group by cast(l_shipdate as date)) as d
        window w as (order by date rows between 19 preceding and current row)""",
    "spy": "select date, spy_close from {market_all}",
    "vix": "select date, vix_close from {market_all} where dayofyear(date) % 50 <> 0",
    "membership": """
        select date, ticker from (
          select nq as date, ticker, row_number() over (partition by nq order by v desc, ticker) as r, count(*) over (partition by nq) as n
          from (select cast(l_suppkey as string) as ticker, cast(date_trunc('quarter', cast(l_shipdate as date)) + interval '3' month as date) as nq,
                       sum(cast(l_quantity as decimal(18, 2))) as v from {lineitem} group by 1, 2) as a) as b
        where r <= 0.8 * n and date < (select max(cast(l_shipdate as date)) from {lineitem})""",
    "sectors": """
        select cast(s_suppkey as string) as ticker, s_name as security, r_name as gics_sector, n_name as gics_sub_industry
        from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey where r_name <> 'MIDDLE EAST'""",
    "filings": """
        select cast(o_custkey % (select count(*) from {supplier}) as string) as ticker, cast(o_orderdate as date) as report_date, cast(o_orderkey as string) as accession,
               case o_orderpriority when '1-URGENT' then '8-K' when '2-HIGH' then '8-K' when '3-MEDIUM' then '10-Q' when '4-NOT SPECIFIED' then '10-K' else '4' end as form,
               case o_orderpriority when '1-URGENT' then '2.02,9.01' when '2-HIGH' then '5.02' else '' end as items
        from {orders}""",
    "insider_raw": """
        select cast(event_id as string) as accession, cast(user_id % (select count(*) from {supplier}) as string) as symbol,
               date_add(date '1995-01-02', cast(event_id % 2499 as int)) as filing_date, date_add(date '1995-01-02', cast(event_id % 2499 - user_id % 4 as int)) as transaction_date,
               case when event_id % 11 = 0 then '5' else '4' end as form,
               case event_type when 'purchase' then 'P' when 'signup' then 'S' else 'A' end as code, case when event_id % 7 = 0 then 'I' else 'D' end as ownership,
               cast(regexp_replace(props, '[^0-9]', '', 'g') as double) as shares, value as price from {events}""",
    "splits": """
        select cast(p_partkey % (select count(*) from {supplier}) as string) as ticker, date_add(date '1995-01-02', cast(p_partkey % 2499 as int)) as date, 2.0 as ratio
        from {part} where p_size = 50""",
    "macro_long": """
        select case o_orderpriority when '1-URGENT' then 'DGS10' when '2-HIGH' then 'DGS3MO' when '3-MEDIUM' then 'BAA10Y' else 'T5YIFR' end as series, cast(o_orderdate as date) as date,
               case when day(cast(o_orderdate as date)) = 13 then '.' else cast(cast(floor((cast(sum(cast(o_totalprice as decimal(18, 2))) * 100 as bigint) + 50 * count(*)) / cast(100 * count(*) as double)) / 10000 as decimal(18, 4)) as string) end as value
        from {orders} where o_orderpriority <> '5-LOW' group by 1, cast(o_orderdate as date)""",
    "quarters": """
        select cast(l_suppkey as string) as ticker, l_suppkey as k, cast(date_trunc('quarter', cast(l_shipdate as date)) as date) as qs,
               sum(cast(l_extendedprice as decimal(18, 2))) as e, sum(cast(l_quantity as decimal(18, 2))) as q,
               sum(cast(l_extendedprice as decimal(18, 2)) * (1 - cast(l_discount as decimal(18, 2)))) as rev
        from {lineitem} group by 1, 2, 3""",
    "facts_first": """
        select ticker, concept, ps as period_start, date_add(pe, 0) as period_end, date_add(pe, lag0) as filed, cast(round(v, 2) as double) as value from (
          select ticker, qs as ps, date_add(cast(qs + interval '3' month as date), -1) as pe, cast(30 + k % 20 as int) as lag0, concept, case concept when 'revenue' then rev when 'net_income' then rev - e * 0.9 else rev - e * 0.85 end as v
          from {quarters} cross join (select 'revenue' as concept union all select 'net_income' union all select 'operating_income') as c where month(qs) <> 10
          union all
          select ticker, min(qs), date_add(cast(date_trunc('year', min(qs)) + interval '12' month as date), -1), 60, concept, sum(case concept when 'revenue' then rev when 'net_income' then rev - e * 0.9 else rev - e * 0.85 end)
          from {quarters} cross join (select 'revenue' as concept union all select 'net_income' union all select 'operating_income') as c group by ticker, year(qs), concept having count(*) = 4
          union all
          select ticker, cast(null as date), date_add(cast(qs + interval '3' month as date), -1), cast(30 + k % 20 as int), concept,
                 case concept when 'assets' then 10 * e when 'assets_current' then 3 * e when 'liabilities_current' then 200 * q when 'equity' then 4 * e - 5000000 when 'lt_debt' then 2 * e else 1000 + k end
          from {quarters} cross join (select 'assets' as concept union all select 'assets_current' union all select 'liabilities_current' union all select 'equity' union all select 'lt_debt' union all select 'shares') as c) as u""",
    "facts_raw": """
        select ticker, concept, period_start, period_end, filed, value, 0 as restated from {facts_first}
        union all select ticker, concept, period_start, period_end, date_add(filed, 365), value * 1.01, 1 from {facts_first}""",
}
BASE = ("region", "nation", "supplier", "part", "orders", "lineitem", "events")


_MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"


def _as_text(day: str) -> str:
    return f"lpad(cast(day({day}) as string), 2, '0') || '-' || substr('{_MONTHS}', month({day}) * 3 - 2, 3) || '-' || cast(year({day}) as string)"


#: Insider filings as they are landed: two tables of text.
SELECTS["insider_submission"] = f"select accession as ACCESSION_NUMBER, {_as_text('filing_date')} as FILING_DATE, form as DOCUMENT_TYPE, ' ' || symbol as ISSUERTRADINGSYMBOL from {{insider_raw}}"
SELECTS["insider_trans"] = f"select accession as ACCESSION_NUMBER, {_as_text('transaction_date')} as TRANS_DATE, code as TRANS_CODE, cast(shares as string) as TRANS_SHARES, cast(price as string) as TRANS_PRICEPERSHARE, ownership as DIRECT_INDIRECT_OWNERSHIP from {{insider_raw}}"

#: Reported concepts of a quarter: flows over it (not of the fourth, which is left to the year) and values at its end.
_FLOW = {"revenue": "rev", "net_income": "rev - e * 0.9", "operating_income": "rev - e * 0.85"}
_STOCK = {"assets": "10 * e", "assets_current": "3 * e", "liabilities_current": "200 * q", "equity": "4 * e - 5000000", "lt_debt": "2 * e", "shares": "1000 + k"}


def _concepts(of: dict[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('concept', '{c}', 'v', cast({v} as decimal(28, 4)))" for c, v in of.items()) + ")"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """facts_raw by one pass over the quarters: each ticker's year is one row of at most four, from which its facts are written out."""
    flow = spark.sql(f"select ticker, k, year(qs) as y, struct(qs, {_concepts(_FLOW)} as flows, {_concepts(_STOCK)} as stocks) as one from {{quarters}}", quarters=bind(spark, sf_dir, "quarters"))
    year = flow.groupBy("ticker", "k", "y").agg(F.array_sort(F.collect_list("one")).alias("all"))
    end = "date_add(cast(x.qs + interval '3' month as date), -1)"
    fact = lambda start, end, lag, f: f"named_struct('concept', {f}.concept, 'period_start', {start}, 'period_end', {end}, 'lag', {lag}, 'value', cast(round({f}.v, 2) as double))"
    quarters = f"flatten(transform(filter(all, x -> month(x.qs) <> 10), x -> transform(x.flows, f -> {fact('x.qs', end, '30 + k % 20', 'f')})))"
    stocks = f"flatten(transform(all, x -> transform(x.stocks, f -> {fact('cast(null as date)', end, '30 + k % 20', 'f')})))"
    total = "named_struct('concept', f.concept, 'v', aggregate(all, cast(0 as decimal(28, 4)), (s, x) -> cast(s + x.flows[i].v as decimal(28, 4))))"
    first = "all[0].qs"
    year_end = f"date_add(cast(date_trunc('year', {first}) + interval '12' month as date), -1)"
    years = f"if(size(all) = 4, transform(transform(all[0].flows, (f, i) -> {total}), f -> {fact(first, year_end, '60', 'f')}), array())"
    rows = year.selectExpr("ticker", f"inline(concat({quarters}, {years}, {stocks}))")
    both = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("restated"))
    again = F.col("restated") == 1
    filed = F.date_add("period_end", F.col("lag").cast("int") + F.when(again, 365).otherwise(0))
    return both.select("ticker", "concept", "period_start", "period_end", filed.alias("filed"), F.when(again, F.col("value") * 1.01).otherwise(F.col("value")).alias("value"), "restated")


def cents(x: str) -> Column:
    """x in whole hundredths, rounded as a decimal of two places is. A double that is a number of hundredths already, as money is, needs no decimal arithmetic."""
    near = f"rint({x} * 100)"
    return F.expr(f"case when abs({near}) < 1e15 and {near} / 100 = {x} then cast({near} as bigint) else cast(cast({x} as decimal(18, 2)) * 100 as bigint) end")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, k (its key), date of the lines, with extended price e, quantity q and discount disc in hundredths."""
    return bind(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("ticker"), F.col("l_suppkey").alias("k"), F.col("l_shipdate").cast("date").alias("date"), cents("l_extendedprice").alias("e"), cents("l_quantity").alias("q"), cents("l_discount").alias("disc")
    )


def _near(d: DataFrame, key: list[str], n: int = 20) -> DataFrame:
    """d with e and q summed over the last n rows of a key: what has been summed so far less what had been n rows before, in whole numbers. Null where all n are."""
    w = Window.partitionBy(*key).orderBy("date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"__{c}": F.sum(F.coalesce(c, F.lit(0))).over(so_far) for c in "eq"} | {f"__{c}n": F.count(c).over(so_far) for c in "eq"})
    d = d.withColumns({f"__{x}_back": F.coalesce(F.lag(f"__{x}", n).over(w), F.lit(0)) for x in ("e", "q", "en", "qn")})
    return d.withColumns({c: F.when(F.col(f"__{c}n") > F.col(f"__{c}n_back"), F.col(f"__{c}") - F.col(f"__{c}_back")) for c in "eq"})


def _per_day() -> list[Column]:
    return [*[F.sum(c).alias(c) for c in ("e", "q", "disc")], F.count("*").alias("n")]


def _money(c: str) -> Column:
    return F.col(c).cast("double") / 100


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_until(spark, sf_dir)


def bars_until(spark: SparkSession, sf_dir: str, day: str | None = None) -> DataFrame:
    """Bars up to a day (all): no bar depends on later lines, so these go before anything is sent.

    Lines are sent once, by ticker; days, rolling sums and what follows by ticker and date stay there.
    """
    d = _lines(spark, sf_dir)
    d = d.where(F.col("date") <= F.lit(day).cast("date")) if day else d
    d = d.select("ticker", "date", "e", "q", "disc")
    d = dealt(d).groupBy("ticker", "date").agg(*_per_day())
    d = _near(d.withColumn("volume", _money("q")), ["ticker"]).select("ticker", "date", "volume", (_money("disc") / F.col("n")).alias("disc"), (_money("e") / _money("q")).alias("close"))
    c = F.col("close")
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))
    return d.select("ticker", "date", F.coalesce(before, c).alias("open"), (c * (1 + F.col("disc") / 2)).alias("high"), (c * (1 - F.col("disc") / 2)).alias("low"), "close", "volume")


def bar_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker and date of the bars, as often as there are lines."""
    return _lines(spark, sf_dir).select("ticker", "date")


def _market_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a date, so the window over all of them is as long as the calendar."""
    d = _near(_lines(spark, sf_dir).groupBy("date").agg(*_per_day()).withColumn("__m", F.lit(0)), ["__m"])
    return d.select("date", (_money("e") / _money("q")).alias("spy_close"), (10 + 100 * (_money("disc") / F.col("n"))).alias("vix_close"))


def _membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    # By key, a number: shorter and quicker to group by than the ticker that it spells.
    v = lines.groupBy(F.trunc("date", "quarter").alias("q0"), "k").agg(F.sum("q").alias("v")).select(F.add_months("q0", 3).alias("date"), F.col("k").cast("string").alias("ticker"), "v")
    day = Window.partitionBy("date")
    d = v.withColumns({"r": F.row_number().over(day.orderBy(F.desc("v"), "ticker")), "n": F.count("*").over(day)})
    last = lines.agg(F.max("date").alias("last"))
    return d.where("r <= 0.8 * n").crossJoin(F.broadcast(last)).where("date < last").select("date", "ticker")


def _quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _lines(spark, sf_dir).withColumn("rev", F.col("e") * (100 - F.col("disc")))
    d = d.groupBy("ticker", "k", F.trunc("date", "quarter").alias("qs")).agg(*[F.sum(c).alias(c) for c in ("e", "q", "rev")])
    scaled = lambda c, unit: F.expr(f"cast({c} as decimal(19, 0)) * {unit}").alias(c)
    return d.select("ticker", "k", "qs", scaled("e", "0.01"), scaled("q", "0.01"), scaled("rev", "0.0001"))


#: Tables that Spark derives in fewer passes than their statements, or in whole numbers, which the oracle keeps.
NATIVE = {"facts_raw": _facts, "bars": _bars, "market_all": _market_all, "membership": _membership, "quarters": _quarters}


def needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical table as a DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in NATIVE:
        return NATIVE[name](spark, sf_dir)
    sql = SELECTS[name].replace(", '', 'g')", ", '')")
    return spark.sql(sql, **{x: bind(spark, sf_dir, x) for x in needs(sql)})


def with_tables(final: str, **more: str) -> str:
    """A statement for the oracle: final, with the derivations that it names in braces (and more) as common table expressions."""
    done: dict[str, str] = {}

    def add(sql: str) -> str:
        for x in needs(sql):
            source = more.get(x) or SELECTS.get(x)
            if x not in done and source:
                done[x] = ""
                text = add(source)
                done.pop(x)
                done[x] = text
        return re.sub(r"\{(\w+)\}", r"\1", sql)

    last = add(final)
    last = last.replace("date_add(", "plus_days(")
    recursive = "recursive " if any(re.search(rf"\bfrom {x}\b", s) for x, s in done.items()) else ""
    ctes = ", ".join(f"{x} as ({s})" for x, s in done.items())
    text = (f"with {recursive}{ctes} " if done else "") + last
    return _plus_days(text)


def _plus_days(sql: str) -> str:
    """date_add(d, n) with whole days as DuckDB writes it."""
    sql = sql.replace("plus_days(", "date_add(")
    while (at := sql.find("date_add(")) >= 0:
        depth, i, parts, begin = 0, at + len("date_add("), [], at + len("date_add(")
        while True:
            c = sql[i]
            if c == "(":
                depth += 1
            elif c == ")" and depth == 0:
                parts.append(sql[begin:i])
                break
            elif c == ")":
                depth -= 1
            elif c == "," and depth == 0:
                parts.append(sql[begin:i])
                begin = i + 1
            i += 1
        sql = f"{sql[:at]}cast(({parts[0].strip()}) + ({parts[1].strip()}) as date){sql[i + 1 :]}"
    return sql
