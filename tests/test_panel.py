import datetime as dt
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline import queries, report_queries  # noqa: F401
from plumbline.functions.scratch import drop, written
from plumbline.functions.windows import as_of, business_days_after, ewm_mean, pct_rank, rolled
from plumbline.operators import audit, events, fundamentals, membership, panel, portfolio, technicals
from plumbline.sources import bindings, tables
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
D = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", ["market_scan", "coverage_report", "pit_filter", "rolling_technicals", "market_context", "sector_relative", "earnings_dates", "insider_activity", "macro_regime", "quarterly_series", "ranking_metrics", "performance_stats", "live_picks", "short_interest_published", "fundamental_ratios", "snapshot_append", "facts_flattened", "stats_report", "streamed_upsert"])
def test_oracle(spark, con, name):
    assert compare(spark, con, SF, queries.QUERIES[name], queries.SQL[name]).startswith("ok")


def test_ewm_gaps(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([None, 1.0, 2.0, None, None, 3.0])], "ticker string, date int, x double")
    got = [r.y for r in ewm_mean(df, "x", 0.5, "y").orderBy("date").collect()]
    assert got[0] is None and got[1:] == pytest.approx([1, 1.5, 1.5, 1.5, 2.7])


def test_ewm_long_gap(spark):
    rows = [("a", i, 4.0 if i == 0 else 10.0 if i == 1500 else None) for i in range(1502)]
    got = [r.y for r in ewm_mean(spark.createDataFrame(rows, "ticker string, date int, x double"), "x", 0.1, "y").orderBy("date").collect()]
    assert got[0] == got[1] == got[1499] == 4 and got[1500] == got[1501] == pytest.approx(10)


def test_exponential_means_share_one_sort(spark):
    bars = spark.createDataFrame([("a", 1, 3.0, 1.0, 2.0)], "ticker string, date int, high double, low double, close double")
    plan = technicals.exponential_technicals(bars)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Sort [") == 1


def test_pct_rank_ties(spark):
    df = spark.createDataFrame([(1, x) for x in (3.0, 1.0, 1.0, None)], "d int, x double").withColumn("r", pct_rank("x", "d"))
    assert sorted((r.r for r in df.collect() if r.r is not None)) == [0.5, 0.5, 1.0] and df.where("x is null and r is null").count() == 1


def test_as_of_strictness_and_ties(spark):
    left = spark.createDataFrame([("a", D(5)), ("b", D(5))], "k string, d date")
    right = spark.createDataFrame([("a", D(5), 1, 10), ("a", D(5), 2, 20), ("a", D(1), 0, 5)], "k string, e date, t int, v int")
    assert {r.k: r.v for r in as_of(left, right, "k", "d", "e", ["v"], ["t"]).collect()} == {"a": 20, "b": None}
    assert {r.k: r.v for r in as_of(left, right, "k", "d", "e", ["v"], ["t"], strict=True).collect()} == {"a": 5, "b": None}


def test_stacked_rows_stay_dealt_and_sorted(spark):
    rows = spark.createDataFrame([("a", D(5), 1.0), ("a", D(1), 2.0)], "ticker string, date date, close double")
    dates = spark.createDataFrame([("a", D(3)), ("a", D(5))], "ticker string, report_date date")
    d = events.earnings_distance(rows, dates)
    assert [(r.days_to_earnings, r.days_since_earnings) for r in d.orderBy("date").collect()] == [(2, None), (0, 2)]
    w = F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))
    for more in (d, as_of(rows, dates, "ticker", "date", "report_date", ["report_date"], [])):
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (more, more.withColumn("before", w))]
        assert all(plans[0].count(s) == plans[1].count(s) for s in ("Exchange", "Sort ["))


def test_panel_sends_rows_once_by_date(spark):
    p = report_queries.feature_table(spark, SF)
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 2 and "panel-by-ticker" not in plan  # facts by ticker, rows by date
    day = p.select("date").distinct().orderBy("date").collect()[40].date
    some = panel.feature_panel(**report_queries.panel_inputs(spark, SF), days=[day])
    assert sorted(map(tuple, some.collect()), key=str) == sorted(map(tuple, p.where(F.col("date") == day).collect()), key=str)


def test_label_goes_with_the_panel(spark):
    """F4-F9: the label looked up before rows are dealt by date is that of the finished panel's valid rows, and sends no wide row again."""
    plain, carried = report_queries.feature_table(spark, SF), membership.label(report_queries.feature_table(spark, SF, horizon=21))
    p = written(plain, "plain-panel")
    after = membership.label(membership.valid_rows(p, panel.REQUIRED))
    columns = ["ticker", "date", "ret_63d_rank", "forward_21d_return", "clipped", "forward_21d_return_demeaned"]
    got, want = (sorted(map(tuple, d.select(*columns).collect()), key=lambda r: r[:2]) for d in (carried, after))
    assert carried.columns == after.columns and len(want) > 1000 and [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], abs=1e-12)
    exchanges = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(carried) <= exchanges(membership.label(membership.valid_rows(plain, panel.REQUIRED))) - 2


def test_member_that_comes_back(spark):
    m = spark.createDataFrame([(D(0), "a"), (D(0), "b"), (D(10), "b"), (D(20), "a"), (D(20), "b")], "date date, ticker string")
    p = spark.createDataFrame([("a", D(n)) for n in (-1, 0, 9, 10, 19, 20, 99)], "ticker string, date date")
    assert sorted(r.date for r in membership.filter_members(p, m).collect()) == [D(0), D(9), D(20), D(99)]


def test_event_bounds(spark):
    f = spark.createDataFrame([("x", D(60), "10-Q", "a1", ""), ("x", D(0), "8-K", "a0", "2.02"), ("x", D(61), "10-Q", "a2", ""), ("y", D(1), "10-K", "a3", ""), ("x", D(70), "8-K", "a4", "9.01, 2.02")], "ticker string, report_date date, form string, accession string, items string")
    assert sorted(r.accession for r in events.earnings_dates(f).collect()) == ["a0", "a2", "a3"]
    t = spark.createDataFrame([("x", D(0), "P", 1.0, 1.0, 5.0)], "ticker string, filing_date date, transaction_code string, shares double, price_per_share double, value double")
    got = {r.date: (r.insider_buy_count_60d, r.days_since_last_insider_buy) for r in events.insider_activity(spark.createDataFrame([("x", D(n)) for n in (-1, 0, 59, 60)], "ticker string, date date"), t).collect()}
    assert got == {D(-1): (0, None), D(0): (1, 0), D(59): (1, 59), D(60): (0, 60)}


def test_business_days(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 15),), (dt.date(2024, 3, 31),)], "d date").select(business_days_after(F.col("d"), 8).alias("p"))
    assert [r.p for r in df.collect()] == [dt.date(2024, 3, 27), dt.date(2024, 4, 10)]


def test_weights_and_filter(spark):
    p = spark.createDataFrame([(D(0), "a", -1.0), (D(0), "b", -2.0), (D(1), "a", 3.0), (D(1), "b", -1.0)], "date date, ticker string, predicted_return double")
    assert {(r.date, r.ticker): r.weight for r in portfolio.weighted(p, "pred").collect()} == {(D(0), "a"): 0.5, (D(0), "b"): 0.5, (D(1), "a"): 1.0, (D(1), "b"): 0.0}
    with pytest.raises(ValueError):
        portfolio.weighted(p, "other")
    assert fundamentals.quality_filter(spark.createDataFrame([(11.0,), (None,), (1.0,)], "debt_to_equity double")).count() == 2


def test_audit_finds_a_leak_in_bars_and_market(spark):
    bars = spark.createDataFrame([("a", D(n), float(n * n + 1)) for n in range(30)], "ticker string, date date, close double")
    market = spark.createDataFrame([(D(n), float(n % 7)) for n in range(30)], "date date, spy_close double")
    of = lambda w, c: (lambda b, m, keys: b.join(m, ["date", *keys], "left").withColumn("x", w(c).over(Window.partitionBy("ticker").orderBy("date"))))
    late = lambda b, m, keys: b.join(m.withColumn("x", F.lead("spy_close").over(Window.partitionBy(F.lit(0), *keys).orderBy("date"))), ["date", *keys], "left")
    pairs = lambda f: audit.lookahead_pairs(bars, market, f, ["x"], n=10)
    assert audit.lookahead_summary(pairs(of(F.lag, "close"))).first()["n_mismatched"] == 0
    audit.require_no_lookahead(pairs(of(F.lag, "close")))
    for leaky in (of(F.lead, "close"), late):
        with pytest.raises(audit.LookaheadError):
            audit.require_no_lookahead(pairs(leaky))


def test_as_of_ties_are_numbers(spark):
    left = spark.createDataFrame([("a", D(5))], "k string, d date")
    right = spark.createDataFrame([("a", D(5), 9, 1), ("a", D(5), 10, 2), ("a", D(5), None, 3)], "k string, e date, t int, v int")
    assert as_of(left, right, "k", "d", "e", ["v"], ["t"]).first().v == 2


def test_snapshot_of_a_day_is_replaced_and_authority_wins(spark):
    m = spark.createDataFrame([(D(0), "a", False), (D(10), "b", False), (D(20), "old", True), (D(30), "x", True)], "date date, ticker string, synthetic boolean")
    today = spark.createDataFrame([("c.d",)], "ticker string")
    rows = lambda day: sorted((r.date, r.ticker, r.synthetic) for r in membership.append_snapshot(m, today, str(D(day))).collect())
    assert rows(30) == [(D(0), "a", False), (D(10), "b", False), (D(20), "old", True), (D(30), "c-d", True)]
    assert rows(10) == rows(5) == sorted((r.date, r.ticker, r.synthetic) for r in m.collect())


def test_insider_rows_differ_by_their_trade_date(spark):
    s = spark.createDataFrame([("1", "31-OCT-2024", "4", " brk.b "), ("2", "31-OCT-2024", "4", "NONE"), ("3", "x", "4", "a")], "ACCESSION_NUMBER string, FILING_DATE string, DOCUMENT_TYPE string, ISSUERTRADINGSYMBOL string")
    t = spark.createDataFrame([("1", d, "P", "5", p, "D") for d, p in (("29-OCT-2024", "2"), ("30-OCT-2024", "2"), ("30-OCT-2024", "2"), ("30-OCT-2024", None))] + [(k, "29-OCT-2024", "P", "1", "1", "D") for k in "23"], "ACCESSION_NUMBER string, TRANS_DATE string, TRANS_CODE string, TRANS_SHARES string, TRANS_PRICEPERSHARE string, DIRECT_INDIRECT_OWNERSHIP string")
    got = sorted((r.ticker, str(r.transaction_date), r.value) for r in events.insider_trades(s, t).collect())
    assert got == [("BRK-B", "2024-10-29", 10.0), ("BRK-B", "2024-10-30", 0.0), ("BRK-B", "2024-10-30", 10.0)]


def test_short_item_lists_are_padded(spark):
    raw = spark.createDataFrame([("a", '{"filings": {"recent": {"form": ["8-K", "10-Q"], "filingDate": ["2020-01-02", "soon"], "accessionNumber": ["1", "2"], "items": ["2.02"]}}}'), ("a", '{"form": ["4"], "filingDate": ["2019-01-02"], "accessionNumber": ["0"], "items": []}'), ("b", "{}")], "ticker string, payload string")
    assert sorted((r.accession, str(r.report_date), r.items) for r in events.flatten_submissions(raw).collect()) == [("0", "2019-01-02", ""), ("1", "2020-01-02", "2.02"), ("2", "None", "")]


def test_tables_round_trip(spark, tmp_path):
    p = str(tmp_path)
    df = spark.createDataFrame([("BRK.B", D(n), float(n)) for n in (0, 200, 400)], "ticker string, date date, close double")
    df.where("close = 0").drop("ticker").coalesce(1).write.parquet(f"{p}/raw")
    (next((tmp_path / "raw").glob("part-*"))).rename(tmp_path / "raw" / "BRK.B.parquet")
    assert tables.read_per_ticker(spark, f"{p}/raw").first().ticker == "BRK-B"
    tables.write_panel(df, f"{p}/panel")
    assert [r.close for r in tables.read_panel(spark, f"{p}/panel", str(D(100)), str(D(300))).collect()] == [200.0]
    tables.write_csv(df, f"{p}/csv")
    assert tables.read_delimited(spark, f"{p}/csv", ",").count() == 3
    tables.write_json(df, f"{p}/json")
    assert spark.read.json(f"{p}/json").count() == 3


def test_backtest_by_hand(spark):
    """Two names, one pick, hold 2: offset 0 buys on day 0 and turns over on day 2, offset 1 a day later."""
    days = [("a", 0, 2.0, 0.0), ("b", 0, 1.0, 0.0), ("a", 1, 1.0, 0.1), ("b", 1, 2.0, 0.5), ("a", 2, 1.0, 0.2), ("b", 2, 2.0, 0.3), ("a", 3, 1.0, None), ("b", 3, 2.0, 0.4)]
    p = spark.createDataFrame([(t, D(d), s, r) for t, d, s, r in days], "ticker string, date date, predicted_return double, ret_1d double")
    market = spark.createDataFrame([(D(n), 0.4) for n in range(4)], "date date, spy_vol_20d double")
    got = {(r.variant, r.offset, (r.date - D(0)).days): (round(r.nav, 10), r.exposure, r.holdings) for r in portfolio.backtest(p, market, n=1, hold=2, cost=0.01).collect()}
    c = 1 - 0.01
    assert got["raw", 0, 0] == (round(c, 10), 1.0, "a") and got["raw", 0, 2] == (round(c * 1.1 * 1.2 * (1 - 0.02), 10), 1.0, "b") and got["raw", 0, 3][0] == round(c * 1.1 * 1.2 * (1 - 0.02) * 1.4, 10)
    assert got["raw", 1, 0] == (1.0, 0.0, "") and got["raw", 1, 3] == (round(c * 1.3 * 1.4, 10), 1.0, "")
    h = 1 - 0.005
    assert got["overlay", 0, 3] == (round(h * 1.05 * 1.1 * (1 - 0.01) * 1.2, 10), 0.5, "b")


def test_native_tables_are_their_statements(spark, tmp_path):
    """Also with prices that are no whole hundredths, nulls over a whole window, and discounts that are missing."""
    day = lambda i: dt.datetime(1995, 1, 2) + dt.timedelta(7 * i)
    rows = [(k, day(i), None if k == 1 and i < 25 else 1.0 + i % 7, None if i == 3 else 100.005 * (i + 1), None if i % 5 == 0 else 0.05) for k in (0, 1, 2) for i in range(60)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    for sf in (str(tmp_path), SF):
        for name in ("bars", "market_all", "membership", "quarters"):
            got = bindings.bind(spark, sf, name)
            told = spark.sql(bindings.SELECTS[name], lineitem=bindings.bind(spark, sf, "lineitem")).select(*[F.col(c).cast(t).alias(c) for c, t in got.dtypes])
            assert got.count() == told.count() > 0 and got.exceptAll(told).count() == 0


def test_bars_are_sent_once(spark):
    plan = bindings.bind(spark, SF, "bars")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Sort [") == 1


def test_live_picks_work_scores_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [("a", D(1), 0.9, 20.0), ("b", D(1), 0.5, 1.0), ("c", D(0), 0.8, 1.0), ("d", D(2), None, 1.0)]
    p = spark.createDataFrame(rows, "ticker string, date date, predicted_return double, debt_to_equity double").mapInArrow(told, "ticker string, date date, predicted_return double, debt_to_equity double")
    market = spark.createDataFrame([(D(1), 0.1)], "date date, spy_vol_20d double")
    assert [(r.ticker, r.weight) for r in portfolio.live_picks(p, market, 2).collect()] == [("b", 1.0)] and seen.value == 4


def test_facts_share_sorts(spark):
    f = fundamentals.fundamentals(bindings.bind(spark, SF, "facts_raw"), bindings.bind(spark, SF, "splits"))
    assert f._jdf.queryExecution().executedPlan().toString().count("Sort [ticker") <= 5


def test_bars_until_a_day_send_no_later_line(spark):
    day = "1998-12-31"
    whole, cut = bindings.bind(spark, SF, "bars").where(F.col("date") <= day), bindings.bars_until(spark, SF, day)
    assert whole.count() == cut.count() > 0 and whole.exceptAll(cut).count() == 0
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" in plan[plan.index("RepartitionByExpression"):].split("Filter")[1]


def test_dropped_tables_leave_others(spark):
    a, b = written(spark.range(3), "gone"), written(spark.range(2), "kept")
    drop(a)
    assert b.count() == 2
    with pytest.raises(Exception, match="exist|PATH_NOT_FOUND|FAILED_READ_FILE"):
        a.collect()


def test_audit_sends_lines_of_sampled_tickers_alone(spark):
    """40 rows are audited: neither the lines of other tickers nor the keys that can't be sampled are sent."""
    whole = membership.seeded_sample(bindings.bind(spark, SF, "bars").select("ticker", "date"), 40, 7)
    keys = membership.seeded_keys(bindings.bar_keys(spark, SF), 40, 7)
    assert whole.count() == keys.count() == 40 and whole.exceptAll(keys).count() == 0
    repeated = spark.createDataFrame([("a", D(n % 3)) for n in range(9000)] + [("b", D(0))], "ticker string, date date")
    assert membership.seeded_keys(repeated, 4, 7).count() == membership.seeded_keys(repeated, 9, 7).count() == 4
    pairs = report_queries.audit.lookahead_pairs(bindings.bind(spark, SF, "bars"), queries._market(spark, SF), technicals.features, ["ret_1d"], n=3)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    sent = plan.split("RepartitionByExpression")[1:]
    assert len(sent) == 2 and all("l_suppkey" in x.split("Filter")[1].split("\n")[0] for x in sent)


def test_ranks_and_rolled_windows_pass_over_rows_seldom(spark):
    """Two doublings share a pass, a rank needs no frame that slides, and quarters are added up by number."""
    df = spark.createDataFrame([("a", 1, 2.0)], "ticker string, date int, x double")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert plan(rolled(df, {"h": ("max", "x", 252), "d": ("std", "x", 60)})).count("Window [") <= 6
    assert "currentrow$(), currentrow$()" not in plan(df.withColumn("r", pct_rank("x", "date")))
    m = bindings.bind(spark, SF, "membership")._jdf.queryExecution().optimizedPlan().toString()
    assert any("Aggregate [" in x and ", k#" in x.split("],")[0] for x in m.split("\n"))
    twice = spark.createDataFrame([("a", 1, float("nan")), ("b", 1, 0.0), ("c", 1, -0.0), ("d", 1, None), ("e", 1, 5.0)], "ticker string, date int, x double")
    assert {r.ticker: r.r for r in twice.withColumn("r", pct_rank("x", "date")).collect()} == {"a": 1.0, "b": 0.375, "c": 0.375, "d": None, "e": 0.75}


def test_sinks_hold_every_bar(spark, con):
    """all bars go through each of the three sinks, those before 2001 too."""
    got = {r.kind: r.n for r in report_queries.sinks_round_trip(spark, SF).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    n = bindings.bind(spark, SF, "bars").count()
    assert got == {"csv": n, "json": n, "per_ticker": n} and n > 1000
    assert compare(spark, con, SF, queries.QUERIES["sinks_round_trip"], queries.SQL["sinks_round_trip"]).startswith("ok")


def test_panel_stacks_send_no_bar_again(spark):
    """F9, F2-F7: bars are dealt by ticker once; what they are stacked with is dealt alike. Ranks of arrays are those of windows."""
    p = report_queries.feature_table(spark, SF)
    lines = p._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :|+-*"))
    bars = next(i for i, x in enumerate(lines) if "REPARTITION_BY_NUM" in x and "l_discount" in next(y for y in lines[i:] if "FileScan" in y))
    above = [x for k, x in enumerate(lines[:bars]) if all(depth(y) > depth(x) for y in lines[k + 1 : bars + 1])]
    assert [x.split("(")[1][:4] for x in above if "Exchange hash" in x] == ["date"] and sum(x.strip(" :|+-*") == "Union" for x in above) == 3
    rows = [("a", 1, float("nan")), ("b", 1, 0.0), ("c", 1, -0.0), ("d", 1, None), ("e", 1, 5.0), ("a", 2, None), ("b", None, 1.0), ("c", None, 1.0)]
    df = spark.createDataFrame(rows, "ticker string, date int, x double")
    told, got = ({(r.ticker, r.date): r.x_rank for r in f(df, ["x"]).collect()} for f in (membership.ranks, membership.ranks_of_dates))
    assert told == got and got["a", 1] == 1.0 and got["b", 1] == got["c", 1] == 0.375 and got["b", None] == 0.75


def test_written_tables_leave_no_shuffle(spark):
    """F2-F7: what was shuffled for a table goes once it is written, and the session's setting stays."""
    shuffles = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split() if "/shuffle_" in x}
    before = shuffles()
    t = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "tidy")
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before and t.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_panel_of_days_reads_the_tickers_of_these_days(spark, monkeypatch):
    """F8: a date's rows need all bars of the tickers that have one on it, and no bar of the others."""
    inputs = {k: written(v, "inputs") for k, v in report_queries.panel_inputs(spark, SF).items()}
    day = inputs["bars"].groupBy("date").count().where("date >= '1998-01-01'").orderBy("count", "date").first().date
    seen, features = [], technicals.features
    monkeypatch.setattr(technicals, "features", lambda bars, market: seen.append(bars) or features(bars, market))
    audit.panel_pairs(inputs, [day], panel.feature_panel, ["ret_21d"], told=True)
    of_day = inputs["bars"].where(F.col("date") == day).select("ticker").distinct()
    whole = inputs["bars"].join(of_day, "ticker", "left_semi")
    assert 0 < whole.count() < inputs["bars"].count()
    assert [d.count() for d in seen] == [whole.count(), whole.where(F.col("date") <= day).count()]
