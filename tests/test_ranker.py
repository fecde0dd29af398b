import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from plumbline.functions.quantiles import exact_quantiles, with_quantiles
from plumbline.functions.windows import rolled
from plumbline.plans import model
from plumbline.sources import landed
from plumbline.streaming.months import MonthTable
from tests.test_panel import D


def test_exact_quantiles(spark):
    rng = random.Random(3)
    values = [("a", rng.gauss(0, 1)) for _ in range(500)] + [("a", 0.5)] * 300 + [("b", 1e300), ("b", -1e300), ("b", 1e-300), (None, 2.0), ("c", None), ("a", float("nan"))]
    df = spark.createDataFrame(values, "g string, x double")
    qs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r.g, r.q): r.value for r in exact_quantiles(df, "x", qs, ("g",)).collect()}
    a = [x for g, x in values if g == "a" and x == x]
    assert {g for g, _ in got} == {"a", "b", None} and all(got["a", q] == pytest.approx(np.quantile(a, q), abs=1e-12) for q in qs)
    assert got["b", 0.5] == 1e-300 and got["b", 1.0] == 1e300 and got[None, 0.5] == 2.0
    one = with_quantiles(df.where("g = 'a'").agg(F.count("*").alias("n")), df.where("g = 'a'"), "x", {"m": 0.5}).first()
    assert (one.n, one.m) == (801, got["a", 0.5])
    assert exact_quantiles(df.where("g = 'zz'"), "x", [0.5]).count() == 0


def test_rolled_windows(spark):
    rng = random.Random(5)
    rows = [(t, D(i), None if rng.random() < 0.01 else 100 + rng.gauss(0, 1) if t == "a" else 0.1, rng.gauss(0, 1)) for t in ("a", "b") for i in range(330)]
    wanted = {"s": ("sum", "x", 14), "m": ("avg", "x", 200), "h": ("max", "x", 252), "d": ("std", "x", 20), "v": ("var", "x", 60), "c": ("cov", "x", "y", 60), "one": ("avg", "x", 1)}
    got = {(r.ticker, r.date): r for r in rolled(spark.createDataFrame(rows, "ticker string, date date, x double, y double"), wanted).collect()}
    plain = {"sum": sum, "avg": np.mean, "max": max, "std": lambda x: np.std(x, ddof=1), "var": lambda x: np.var(x, ddof=1)}
    for t in ("a", "b"):
        mine = [r for r in rows if r[0] == t]
        for i, r in enumerate(mine):
            for name, (kind, *cols, n) in wanted.items():
                seen, value = mine[max(0, i + 1 - n) : i + 1], getattr(got[t, r[1]], name)
                if len(seen) < n or any(s[2] is None for s in seen):
                    assert value is None
                elif kind == "cov":
                    assert value == pytest.approx(np.cov([s[2] for s in seen], [s[3] for s in seen])[0, 1], abs=1e-9)
                else:
                    assert value == pytest.approx(plain[kind]([s[2] for s in seen]), abs=1e-9)
    assert got["b", D(329)].d in (0.0, None)  # equal values don't deviate at all


def test_missing_values_are_a_signal(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        gone = rng.random() < 0.3
        rows.append((f"t{i % 20}", D(i // 20), "train" if i < 400 else "val", None if gone else rng.random(), rng.random(), "ab"[i % 2], 1.0 if gone else 0.0))
    p = model.prepare(spark.createDataFrame(rows, "ticker string, date date, split string, x double, z double, kind string, y double"), ["x", "z"], ["kind"], "y", 8)
    assert p.columns == ["x", "z", "x", "kind"]
    trees, k, rounds = model.fit_ranked(p, "y", 3, n_estimators=12, learning_rate=0.3)
    got = model.score(trees, p.table, k)
    gap = {r.gone: r.p for r in got.groupBy(F.col("x").isNull().alias("gone")).agg(F.avg("predicted_return").alias("p")).collect()}
    assert gap[True] - gap[False] > 0.3 and trees.importance["x"] > 0.9 and rounds.count() == 12
    # Staged scores are the model's own, round by round, and unseen rows are assembled alike.
    again = model.staged(trees, p.assemble(got.select("ticker", "date", "split", "x", "z", "kind", "y")).select("ticker", "date", "__features"))
    assert again.join(got.select("ticker", "date", "predicted_return"), ["ticker", "date"]).where(F.abs(F.element_at("stages", k) - F.col("predicted_return")) > 1e-12).count() == 0


def test_staged_scores_are_the_librarys(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.random(), rng.random()) for i in range(300)], "i int, a double, b double").withColumn("y", F.sin(F.col("a") * 6) + F.col("b"))
    d = VectorAssembler(inputCols=["a", "b"], outputCol="__features").transform(df)
    fitted = GBTRegressor(featuresCol="__features", labelCol="y", maxIter=7, maxDepth=3, seed=1).fit(d)
    mine = model.score(model.trees_of(fitted), d.select("i", "__features"))
    worst = fitted.transform(d).join(mine.withColumnRenamed("predicted_return", "mine"), "i").agg(F.max(F.abs(F.col("prediction") - F.col("mine"))).alias("e")).first().e
    assert worst < 1e-9
    shrunk = model.trees_of(fitted, reg_lambda=50.0)
    assert np.abs(np.concatenate(shrunk.value)).sum() < np.abs(np.concatenate(model.trees_of(fitted).value)).sum()


def test_round_metrics_against_duckdb(spark):
    import duckdb
    import pandas as pd

    rng = random.Random(4)
    table = pd.DataFrame([(f"t{i}", d, (i * 7 + d * 3) % 11 / 10, k, round(rng.random(), 1)) for d in range(4) for i in range(6) for k in (1, 2)], columns=["ticker", "date", "y", "k", "p"])
    wide = spark.createDataFrame(table).groupBy("ticker", "date").agg(F.first("y").alias("y"), F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda s: s["p"]).alias("stages"))
    got = {r.k: (r.topn_mean, r.rmse) for r in model.round_metrics(wide, "y", 3).collect()}
    sql = "select k, avg(top), sqrt(sum(se) / sum(n)) from (select k, date, avg(y) filter (r <= 3) as top, sum((y - p) ** 2) as se, count(*) as n from (select *, row_number() over (partition by k, date order by p desc, ticker) as r from table_) q group by k, date) d group by k"
    con = duckdb.connect()
    con.register("table_", table)
    assert {k: pytest.approx((a, b)) for k, a, b in con.sql(sql).fetchall()} == got


def test_round_metrics_send_no_row_for_each_stage(spark):
    """F4, F5, F7-F9: of 4,000 rows with 20 stages only those that may be among a date's best n leave the task that reads them."""
    d = spark.range(4000, numPartitions=2).select(F.concat(F.lit("t"), F.col("id") % 2000).alias("ticker"), (F.col("id") / 2000).cast("int").alias("date"), F.rand(1).alias("y"), F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.rand(2)).alias("stages"))
    got = model.round_metrics(d, "y", 3)
    assert got.count() == 20
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan[plan.rindex("Exchange") :]
    batches = d.toArrow().to_batches()
    sent = list(model._leading((pa.RecordBatch.from_arrays(b.columns, ["ticker", "date", "__y", "stages"]) for b in batches), 3))
    assert sum(b.num_rows for b in sent) <= 3 * 20 * 2 * len(batches) and sum(pc.sum(b.column("__n")).as_py() for b in sent) == 4000 * 20


def test_stop_and_search():
    assert model.best_round([(1, 0.1), (2, 0.3), (3, 0.2), (4, 0.3), (5, 0.9)], patience=2) == (2, 0.3)
    assert model.best_round([(1, None), (2, 0.3)]) == (2, 0.3) and model.best_round([]) == (1, None)
    rng = random.Random(1)
    # Trials that do well at a low learning rate and a deep tree draw proposals there.
    told = [({c: model._drawn(c, u, model.RANGES) for c in model.RANGES}, -u) for u in np.linspace(0, 1, 20)]
    drawn = [model._scaled("learning_rate", model.propose(told, model.RANGES, rng)["learning_rate"], model.RANGES) for _ in range(30)]
    assert np.mean(drawn) < 0.3
    for p in (model.propose(told, model.RANGES, rng) for _ in range(20)):
        assert all(lo <= p[c] <= hi for c, (lo, hi, _) in model.RANGES.items()) and isinstance(p["max_depth"], int)
    assert math.isclose(model._drawn("learning_rate", model._scaled("learning_rate", 0.005, model.RANGES), model.RANGES), 0.005)


def test_search_is_reproducible(spark):
    rng = random.Random(9)
    rows = [(f"t{i % 10}", D(i // 10), "train" if i < 200 else "val", rng.random(), rng.random()) for i in range(300)]
    p = model.prepare(spark.createDataFrame(rows, "ticker string, date date, split string, x double, y double"), ["x"], [], "y", 4)
    ranges = {"n_estimators": (1, 2, False)}
    first, second = (model.search_table(p, "y", 2, trials=5, first=3, at_once=2, ranges=ranges).collect() for _ in range(2))
    assert first == second and [r.place for r in first] == [1, 2, 3, 4, 5] and {r.trial for r in first} == {1, 2, 3, 4, 5}


def test_month_table(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(t, D(n), v) for t, n, v in x], "ticker string, date date, v int")
    put = lambda old, new: old.join(new, ["ticker", "date"], "left_anti").unionByName(new)
    t = MonthTable(spark, str(tmp_path / "table"), rows(("a", 0, 1)).schema)
    assert t.read().count() == 0 and t.clean() == 0
    t.merge(rows(("a", 0, 1), ("a", 40, 1)), 0, put)
    t.merge(rows(("a", 0, 2)), 1, put)
    t.merge(rows(("a", 0, 3)), 1, put)  # the batch again: it starts from the version before it
    held = lambda **k: sorted((r.ticker, r.date, r.v) for r in t.read(**k).collect())
    assert held() == [("a", D(0), 3), ("a", D(40), 1)] and held(before=1) == [("a", D(0), 1), ("a", D(40), 1)]
    assert t.folders() == 3 and t.versions() == [0, 1]
    t._fs.delete(t._hadoop(f"{t.path}/manifest/1/_SUCCESS"), False)  # a version that isn't whole doesn't count
    assert held() == [("a", D(0), 1), ("a", D(40), 1)] and t.clean() == 0 and t.folders() == 3
    t.merge(rows(("a", 0, 4)), 1, put)
    assert t.clean() == 1 and t.folders() == 2 and held() == [("a", D(0), 4), ("a", D(40), 1)]
    t.merge(rows(), 2, put)
    assert held() == [("a", D(0), 4), ("a", D(40), 1)]


def test_landed_lines(spark, tmp_path):
    (tmp_path / "A.csv").write_text("DATE,A\n2020-01-01,1\n2020-01-02,.\nsoon,3\n2020-01-03,4,5\n2020-01-04\n")
    (tmp_path / "B.csv").write_text("b,observation_date\n2.5,2020-01-01\n")
    (tmp_path / "C.csv").write_text("what,is this\n1,2\n3,4\n")
    rows, rejects = landed.read_macro(spark, str(tmp_path))
    assert sorted((r.series, r.value) for r in rows.collect()) == [("A", 1.0), ("B", 2.5)]
    assert sorted((r.file[-5:], r.reason, r.n) for r in rejects.collect()) == [("A.csv", "date", 1), ("A.csv", "malformed", 2), ("A.csv", "missing", 1), ("C.csv", "header", 2)]


def test_metrics_of_written_scores_against_duckdb(spark, tmp_path):
    """K4, K5: what the fitted ranker scores is written, and its metrics are those that the statement finds in the file."""
    import duckdb

    from plumbline import queries
    from plumbline.functions.scratch import written
    from plumbline.operators import membership, portfolio
    from plumbline.sources.bindings import with_tables

    sf = "/root/testdata/sf0.001"
    y = "forward_21d_return_demeaned"
    p = written(membership.time_split(membership.label(queries.scored(spark, sf).drop("predicted_return"))), "labelled")
    prepared = model.prepare(p, ["ret_63d", "vol_60d", "dist_52w_high"], [], y)
    trees, k, _ = model.fit_ranked(prepared, y, queries.N, n_estimators=6)
    model.score(trees, prepared.table, k).select("split", "date", "ticker", y, "predicted_return").write.parquet(str(tmp_path / "scores"))
    got = {r.split: r for r in portfolio.rank_metrics(spark.read.parquet(str(tmp_path / "scores")), y, "predicted_return", queries.N).collect()}
    sql, more = queries.RAW["ranking_metrics"]
    want = duckdb.connect().sql(with_tables(sql, **(queries.TABLES | more | {"labelled": f"select * from read_parquet('{tmp_path}/scores/*.parquet')"}))).df()
    assert set(want["split"]) == set(got) == {"train", "val", "test"}
    for r in want.to_dict("records"):
        for c in ("rmse", "ic", "decile_spread", "topn_mean", "topn_sharpe"):
            value = getattr(got[r["split"]], c)
            assert value is None if r[c] != r[c] else value == pytest.approx(r[c], abs=2e-6)


def test_panel_audit_finds_a_leak(spark):
    """Facts used before they were filed are found, and nothing else is; the true panel has no leak."""
    from plumbline import report_queries
    from plumbline.functions.scratch import written
    from plumbline.operators import audit, panel

    inputs = {k: written(v, "audit") for k, v in report_queries.panel_inputs(spark, "/root/testdata/sf0.001").items()}
    day = inputs["bars"].where("date >= '2000-03-01'").agg(F.min("date")).first()[0]
    columns = ["ret_21d", "earnings_yield", "roa", "roa_rank", "insider_buy_count_60d"]
    early = lambda **i: panel.feature_panel(**(i | {"facts": i["facts"].withColumn("filed", F.date_sub("filed", 120))}))
    pairs = written(audit.panel_pairs(inputs, [day], early, columns), "audit-pairs")
    bad = {r.feature: r.n_mismatched for r in audit.lookahead_summary(pairs).collect()}
    assert bad["roa"] > 0 and bad["earnings_yield"] > 0 and bad["ret_21d"] == 0 and bad["insider_buy_count_60d"] == 0
    with pytest.raises(audit.LookaheadError, match="roa"):
        audit.require_no_lookahead(pairs)


def test_quarters(spark):
    from plumbline.functions.windows import quarters

    got = [(r.quarter, str(r.first_day), str(r.last_day)) for r in quarters(spark, "2023-11-05", "2024-04-01").orderBy("first_day").collect()]
    assert got == [("2023q4", "2023-10-01", "2023-12-31"), ("2024q1", "2024-01-01", "2024-03-31"), ("2024q2", "2024-04-01", "2024-06-30")] and quarters(spark, "2024-01-01", "2023-01-01").count() == 0


def test_importances_fit_whole_rankers(spark, monkeypatch):
    """a model whose importances are compared takes as many rounds as the ranker itself."""
    from plumbline import report_queries

    asked, table = [], spark.range(1)

    def fit(prepared, label, seed=1, **params):
        asked.append((seed, (model.DEFAULTS | params)["n_estimators"]))
        return model.Trees([], [], [], [], [], [], {"a": float(seed), "b": 0.0})

    monkeypatch.setattr(model, "fit", fit)
    monkeypatch.setattr(report_queries, "_prepared", lambda spark, d: model.Prepared(table, None, ["a", "b"], {}))
    got = {r.feature: r["drop"] for r in report_queries.ranker_importances(spark, "").collect()}
    assert sorted(asked) == [(s, model.DEFAULTS["n_estimators"]) for s in (1, 2, 3, 4, 5)] and got == {"a": False, "b": True}
