import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.catalogue.common import hourly_bars
from tidemark.functions import pvalues as P
from tidemark.operators import abtest as A
from tidemark.operators import audit as N
from tidemark.operators import drift as D
from tidemark.operators import features as X
from tidemark.operators import forests
from tidemark.operators import indicators as I
from tidemark.operators import leakage as L
from tidemark.operators import metrics as M
from tidemark.operators import models as K
from tidemark.operators import quality as Q
from tidemark.operators import selection as S
from tidemark.plans.blocks import plain, with_rows
from tidemark.session import cut_lineage

START = dt.datetime(2024, 1, 1)


def series(spark, closes, symbol="A"):
    rows = [(symbol, "1h", START + dt.timedelta(hours=i), float(c), float(c) + 1, float(c) - 1, float(c), 10.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, interval string, timestamp timestamp, open double, high double, low double, close double, volume double")


# --- tail probabilities against printed tables ----------------------------------------


@pytest.mark.parametrize("fn,args,want", [
    (P.t_two_sided, (2.228139, 10), 0.05), (P.t_two_sided, (12.7062, 1), 0.05), (P.t_two_sided, (0.0, 5), 1.0),
    (P.chi2_tail, (3.841459, 1), 0.05), (P.chi2_tail, (18.307038, 10), 0.05), (P.chi2_tail, (0.0, 3), 1.0),
    (P.f_tail, (4.964603, 1, 10), 0.05), (P.f_tail, (2.978237, 10, 10), 0.05),
])
def test_tail_tables(fn, args, want):
    assert fn(*args) == pytest.approx(want, abs=2e-6)


def test_ks_tail(spark):
    lam = 1.3581  # 5% point of the limit distribution
    got = spark.range(1).select(P.ks_p(F.lit(lam / math.sqrt(50)), F.lit(100), F.lit(100)).alias("p")).first()["p"]
    assert got == pytest.approx(0.05, abs=1e-4)


# --- indicators: edge cases and properties --------------------------------------------


def test_empty_single_and_constant_series(spark):
    empty = series(spark, []).where("false")
    assert I.all_indicators(empty).count() == 0
    one = I.rsi(series(spark, [5]), n=3).first()
    assert one["RSI_3"] is None
    flat = I.rsi(series(spark, [5] * 10), n=3).orderBy("timestamp").collect()
    assert [r["RSI_3"] for r in flat] == [None] * 3 + [100.0] * 7


def test_bad_periods(spark):
    for call in (lambda: I.sma("close", 0), lambda: I.ema(series(spark, [1]), periods=[0]), lambda: I.macd(series(spark, [1]), fast=26, slow=12)):
        with pytest.raises(ValueError):
            call()


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(1, 1000), min_size=5, max_size=60))
def test_averages_stay_within_the_range(spark, values):
    out = I.ema(series(spark, values), periods=[3, 10]).toPandas()
    for c in ("EMA_3", "EMA_10"):
        assert out[c].between(min(values) - 1e-9, max(values) + 1e-9).all()


def test_layouts(spark, sf_dir):
    bars = hourly_bars(spark, sf_dir)
    table = X.engineer_features(bars, reference_columns=True)
    assert len(table.drop("symbol", "interval").columns) == 274
    names = X.feature_names(table)
    assert "SMA_50_lag_10" in names and "target_return_1" not in names and "symbol" not in names


def test_feature_table_columns_equal_the_single_operators(spark, sf_dir):
    bars = hourly_bars(spark, sf_dir)
    table = X.engineer_features(bars, block_rows=256)
    singles = [
        (I.ema(bars), ["EMA_3", "EMA_200"]), (I.macd(bars), ["MACD", "MACD_Signal", "MACD_Histogram"]), (I.rsi(bars), ["RSI_14"]),
        (I.adx(bars), ["ADX"]), (I.keltner(bars), ["KC_Upper"]), (I.obv(bars), ["OBV"]), (I.vwap(bars), ["VWAP"]),
        (I.parabolic_sar(bars), ["Parabolic_SAR"]), (X.volatility_regime(bars), ["volatility_regime", "volatility_percentile"]),
        (X.targets(bars), ["target_return_5", "target_direction_5", "target_volatility_5"]),
        (X.rolling_features(bars, ["volume"], [20]), ["volume_rolling_20_kurt"]),
    ]
    wanted = sorted({c for _, cs in singles for c in cs})
    whole = table.select("symbol", "timestamp", *wanted).toPandas().sort_values(["symbol", "timestamp"]).reset_index(drop=True)
    for df, columns in singles:
        part = df.select("symbol", "timestamp", *columns).toPandas().sort_values(["symbol", "timestamp"]).reset_index(drop=True)
        for c in columns:
            np.testing.assert_allclose(whole[c].astype(float), part[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=c)


def test_scaling_without_complete_rows_leaves_values(spark):
    df = series(spark, [1, 2, 3]).withColumn("close", F.lit(None).cast("double"))
    fitted = X.fit_scaling(df, ["close", "open"], "standard")
    assert [r["open"] for r in X.apply_scaling(df, ["close", "open"], fitted).orderBy("timestamp").collect()] == [1.0, 2.0, 3.0]
    with pytest.raises(ValueError):
        X.fit_scaling(df, ["open"], "other")


def test_name_check(spark):
    with pytest.raises(ValueError):
        X.check_feature_names(series(spark, [1]).withColumn("future_price", F.lit(1)))
    with pytest.raises(ValueError):
        X.lag_features(series(spark, [1]), ["close"], [11])


# --- quality, leakage, selection, drift -------------------------------------------------


def test_schema_check(spark):
    df = series(spark, [1])
    Q.check_schema(df, ["close"], {"close": "double"})
    with pytest.raises(ValueError):
        Q.check_schema(df, ["nothing"])
    with pytest.raises(ValueError):
        Q.check_schema(df, ["close"], {"close": "int"})


def test_naming_findings(spark):
    got = {(r["feature"], r["violation_type"]) for r in L.naming(spark, ["close", "future_close", "label_x", "SMA_5"]).collect()}
    assert got == {("future_close", "suspicious_naming"), ("label_x", "suspicious_naming"), ("label_x", "target_derived_feature")}
    assert L.rolling_named(["macd", "max_x", "close_ma_5", "volume"]) == ["max_x", "close_ma_5"]


def test_scan_and_clean(spark):
    rng = np.random.default_rng(1)
    df = series(spark, 50 + np.cumsum(rng.normal(0, 1, 80)))
    df = plain(with_rows(df, [{"ret": X.simple_return(), "future_ret": F.try_divide(I.following("close", 2), I.following("close")) - 1}], back=1, ahead=2))
    df = df.withColumn("target_next", F.col("ret"))
    found = L.scan(df, "target_next")
    critical = {r["feature"] for r in found.where("severity = 'critical'").collect()}
    assert "target_next" in critical
    assert "target_next" not in L.clean_features(df, found).columns
    assert L.report(found).where("severity is null and violation_type is null").first()["n_findings"] == found.count()


def test_elimination_and_reduction(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    pdf = pd.DataFrame(x, columns=["a", "b", "c", "d"])
    pdf["d"] = pdf["a"] * 3
    pdf["y"] = (pdf["a"] > 0).astype(float)
    df = spark.createDataFrame(pdf)
    assert "b" not in S.eliminate(df, ["a", "b", "c"], "y", keep=1, trees=5)
    out, shares = S.reduce_dimensions(df, ["a", "b", "c", "d"])
    assert len(shares) == 3 and sum(shares) >= 0.95
    centred = pdf[["a", "b", "c", "d"]] - pdf[["a", "b", "c", "d"]].mean()
    values = np.linalg.svd(centred.to_numpy(), compute_uv=False) ** 2
    np.testing.assert_allclose(shares, (values / values.sum())[:3], rtol=1e-9)
    got = np.array(out.select("components").toPandas()["components"].tolist())
    np.testing.assert_allclose(np.sort(got.var(axis=0))[::-1], (values / len(pdf))[:3], rtol=1e-9)


def test_correlation_with_missing_values(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame(rng.normal(1000, 1, (200, 3)), columns=["a", "b", "c"])
    pdf.loc[::7, "a"] = None
    pdf.loc[::5, "b"] = None
    got = {(r["feature_a"], r["feature_b"]): r["correlation"] for r in S.correlations(spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double").repartition(4), ["a", "b", "c"]).collect()}
    want = pdf.corr()
    for (a, b), r in got.items():
        assert r == pytest.approx(want.loc[a, b], rel=1e-9)


def test_drift_detects_a_shift(spark):
    rng = np.random.default_rng(4)
    old = spark.createDataFrame(pd.DataFrame({"f1": rng.normal(0, 1, 1000), "f2": rng.normal(0, 1, 1000)}))
    new = spark.createDataFrame(pd.DataFrame({"f1": rng.normal(3, 1, 100), "f2": rng.normal(0, 1, 100)}))
    got = {r["feature"]: r for r in D.continuous_drift(old, new, ["f1", "f2"]).collect()}
    assert got["f1"]["drift_detected"] and not got["f2"]["drift_detected"]
    assert got["f1"]["mean_shift"] == pytest.approx(3, abs=0.4)


# --- A/B, metrics, audit ----------------------------------------------------------------


def test_small_groups_are_not_tested(spark):
    rows = [("a", float(i)) for i in range(40)] + [("b", float(i)) for i in range(10)]
    got = {r["variant"]: r["p_value"] for r in A.significance(spark.createDataFrame(rows, "variant string, m double"), "m", "a").collect()}
    assert got == {"a": 1.0, "b": None}


def test_nested_redaction(spark):
    df = spark.sql("""SELECT named_struct('user', 'u', 'password', 'p', 'inner', map('token', 'x', 'k', 'v'),
        'list', array(named_struct('Api_Key', 'z', 'n', 1)), 'deep', map('auth', map('a', 'b'), 'open', map('secret', 's', 'a', 'b'))) AS e""")
    e = M.redact_column(df, "e").first()["e"].asDict(recursive=True)
    assert e["user"] == "u" and e["password"] == M.REDACTED and e["inner"] == {"token": M.REDACTED, "k": "v"}
    assert e["list"] == [{"Api_Key": M.REDACTED, "n": 1}]
    assert e["deep"] == {"auth": None, "open": {"secret": M.REDACTED, "a": "b"}}


def requests(spark, seed=6, n=300):
    rng = np.random.default_rng(seed)
    us = np.sort(rng.choice(40_000_000, n, replace=False))
    rows = [(int(i), int(rng.integers(0, 2)), START + dt.timedelta(microseconds=int(t) * 25)) for i, t in enumerate(us)]
    return rows, spark.createDataFrame(rows, "id long, user long, timestamp timestamp")


@pytest.mark.parametrize("block_rows", [None, 16])
def test_request_decisions_brute_force(spark, block_rows):
    rows, df = requests(spark)
    got = {r["id"]: r["allowed"] for r in M.request_decisions(df, 5, seconds=60, bucket_seconds=200, block_rows=block_rows).collect()}
    kept: dict[int, list] = {}
    for i, user, t in rows:
        recent = [x for x in kept.get(user, []) if t - x < dt.timedelta(seconds=60)]
        assert got[i] == (len(recent) < 5)
        kept[user] = recent + ([t] if got[i] else [])


def test_request_rates_brute_force(spark):
    rows, df = requests(spark)
    got = {r["id"]: r["n_recent"] for r in M.request_rates(df, 5, seconds=60, bucket_seconds=120).collect()}
    for i, user, t in rows:
        assert got[i] == sum(1 for _, u, x in rows if u == user and x <= t and t - x < dt.timedelta(seconds=60))


def test_alert_cycle_is_the_same_in_small_blocks(spark, sf_dir):
    metrics = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("name"), "value", F.col("ts").cast("timestamp").alias("timestamp"))
    rules = spark.createDataFrame([("r", "click", "gt", 20.0, True)], "rule string, metric string, condition string, threshold double, enabled boolean")
    run = lambda rows: sorted(map(tuple, M.alert_cycle(metrics, rules, 86400, block_rows=rows).collect()))
    assert run(None) == run(8)


def alert_states(rows, rest):
    """Walk over (time, hit) in order."""
    active, fired, out = False, None, []
    for now, hit in rows:
        if fired is not None and now - fired < rest:
            out.append("cooldown")
        elif hit:
            active, fired = True, now
            out.append("triggered")
        else:
            out.append("resolved" if active else "quiet")
            active = False
    return out


@pytest.mark.parametrize("rest", [0, 3, 50, 100000])
def test_alert_cycle_against_a_walk(spark, rest):
    rng = np.random.default_rng(rest)
    times = np.unique(rng.integers(0, 3000, 500)).tolist()
    hits = {n: rng.random(len(times)) < share for n, share in (("a", 0.1), ("b", 0.9), ("c", 0.0))}
    rows = [(n, START + dt.timedelta(seconds=t), float(h)) for n, own in hits.items() for t, h in zip(times, own.tolist())]
    metrics = spark.createDataFrame(rows, "name string, timestamp timestamp, value double")
    rules = spark.createDataFrame([(f"r{n}", n, "gt", 0.5, True) for n in hits], "rule string, metric string, condition string, threshold double, enabled boolean")
    got = M.alert_cycle(metrics, rules, rest, bucket_seconds=400, block_rows=64).orderBy("rule", "timestamp").collect()
    for n, own in hits.items():
        assert [r["state"] for r in got if r["rule"] == f"r{n}"] == alert_states(list(zip(times, own.tolist())), rest)


def test_alert_passes_grow_with_the_logarithm(spark, monkeypatch):
    """Steady hits and a cooldown that never lines up with the blocks."""
    counts = []
    for n in (64, 256, 1024):
        calls = []
        monkeypatch.setattr(M, "cut_lineage", lambda df, calls=calls: calls.append(1) or cut_lineage(df))
        hits = spark.range(n).selectExpr("'r' AS rule", "id + 1 AS _rn", "id * 7000000 AS _us")
        assert M.triggers(hits, 30_000_000, 1000).count() == -(-n // 5)
        counts.append(len(calls))
    assert counts[2] - counts[1] <= 6 and counts[1] - counts[0] <= 6


def test_scan_rules(spark):
    text = "x = eval ( y )\npassword = 'abc'; Password=\"d\"\nplain\nsubprocess.call(cmd, shell = True)"
    got = N.scan_text(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").collect()
    assert sorted((r["line_number"], r["title"], r["matched"]) for r in got) == [
        (1, "Code Injection Risk", "eval ("), (2, "Hardcoded Password", "Password=\"d\""), (2, "Hardcoded Password", "password = 'abc'"),
        (4, "Shell Injection Risk", "subprocess.call(cmd, shell = True"),
    ]


def test_dealt_out_columns_are_permutations(spark):
    df = series(spark, range(50)).select("symbol", "interval", "timestamp", "close", "volume")
    for rows in (7, 65536):
        got = K.dealt_out(df, ["close", "volume"], rows_per_bucket=rows).orderBy("timestamp").collect()
        new = [r["_new"]["close"] for r in got]
        assert sorted(new) == list(map(float, range(50))) and new != [r["close"] for r in got]


def test_scoring_loses_no_row(spark):
    df = series(spark, range(40)).withColumn("x", F.when(F.col("close") >= 5, F.col("close"))).withColumn("y", F.col("close") * 2)
    model, _ = K.train(df, ["x"], "y", "linear_regression", "regression")
    got = K.score(model, df).orderBy("timestamp").collect()
    assert [r["is_fallback"] for r in got] == [True] * 5 + [False] * 35
    assert all(r["prediction"] == (0 if r["is_fallback"] else pytest.approx(r["y"], abs=0.01)) for r in got)


def test_components_lose_no_row(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 4.0), (3.0, None), (4.0, 9.0)], "a double, b double")
    out, explained = S.reduce_dimensions(df, ["a", "b"], parts=1)
    assert out.count() == 4 and out.columns == ["a", "b", "components"] and len(explained) == 1


def test_short_series_only_train(spark):
    df = series(spark, range(3)).unionByName(series(spark, range(12)).withColumn("symbol", F.lit("long")))
    got = K.expanding_folds(df, 5).groupBy("symbol").agg(F.max("fold").alias("m")).collect()
    assert {r["symbol"]: r["m"] for r in got} == {"long": 5, next(r["symbol"] for r in got if r["symbol"] != "long"): 0}


def test_averages_stay_missing_after_a_missing_value(spark):
    df = series(spark, [10, 10, 20, 10, 10, 10]).withColumn("close", F.when(F.col("close") < 15, F.col("close")))
    for rows in (None, 2):
        out = I.ema(df, periods=[3], block_rows=rows).orderBy("timestamp").collect()
        assert [r["EMA_3"] for r in out] == [10, 10, None, None, None, None]
    numbered = df.withColumn("symbol", F.lit(7))
    assert [r["EMA_3"] for r in I.ema(numbered, periods=[3], block_rows=2).orderBy("timestamp").collect()][:2] == [10, 10]


def test_request_rates_of_a_window_longer_than_a_bucket(spark):
    rows = spark.range(60).selectExpr("1 AS user", "timestamp_micros(1700000000000000 + id * 59000000) AS timestamp")
    assert M.request_rates(rows, 5, seconds=3600, bucket_seconds=600).agg(F.max("n_recent")).first()[0] == 60


def test_unknown_interval_labels_raise(spark):
    with pytest.raises(Exception, match="no interval label"):
        I.ema(series(spark, range(5)).withColumn("interval", F.lit("tick")), periods=[3]).collect()


def test_search_draws_are_seeded():
    space = {"n": (1, 5), "x": (0.1, 0.2), "c": [1, 2]}
    assert K.draws(space, 3) == K.draws(space, 3)
    assert all(isinstance(d["n"], int) and 0.1 <= d["x"] <= 0.2 and d["c"] in (1, 2) for d in K.draws(space, 20))


@pytest.mark.parametrize("pattern, literal", [
    (r"eval\s*\(", "eval"), (r"https?://[a-z]+", "http"), (r"[a-z]+@x\.[a-z]+", "@x."), (r"Yaml\.load\(", "yaml.load("), (r"(ab)?cd", ""), (r"ab|cd", ""), (r"a{0,3}bc+d", "bc"), (r"\w+\d", ""),
])
def test_required_literals(pattern, literal):
    assert N.required_literal(pattern) == literal


def test_summary_of_a_clean_table(spark):
    df = series(spark, [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8]).select("symbol", "interval", "timestamp", "close")
    none = spark.createDataFrame([], "symbol string, interval string, feature string, violation_type string, severity string")
    row = L.summary(df, none, ["close"]).first()
    assert (row.n_rows, row.n_features, row.n_affected, row.affected_share, row.is_clean, row.advice) == (12, 1, 0, 0.0, True, [])
    assert row.first_timestamp < row.last_timestamp
    one = spark.createDataFrame([("a", "1h", "close", "high_future_correlation", "critical"), ("a", "1h", "close", "suspicious_naming", "warning")], none.schema)
    row = L.summary(df, one, ["close"]).first()
    assert not row.is_clean and row.affected_share == 1.0 and row.advice == [L.ADVICE["high_future_correlation"], L.ADVICE["suspicious_naming"]]


def test_next_hits_of_a_full_bucket_read_each_row_once(spark):
    """No frame may reach from a row to the end of its bucket: Spark reads such a frame anew for every row."""
    hits = spark.range(20000).selectExpr("'r' AS rule", "id + 1 AS _rn", "(id div 3) * 1000000 AS _us")
    found = M._next_hits(hits, 500_000_000, 86400)
    assert "unboundedfollowing" not in found._jdf.queryExecution().executedPlan().toString().lower()
    got = {r["_rn"]: r["_next"] for r in found.collect()}
    assert got == {i + 1: 3 * (i // 3 + 500) + 1 for i in range(20000) if i // 3 + 500 <= 19999 // 3}


def test_categorical_drift_names_its_new_categories(spark):
    old = spark.createDataFrame([("a", "x")] * 3 + [("b", "x")], "kind string, same string")
    new = spark.createDataFrame([("a", "x"), ("d", "x"), ("c", "x"), ("c", "x"), (None, "x")], "kind string, same string")
    got = {r["feature"]: (r["n_new_categories"], r["new_categories"]) for r in D.categorical_drift(old, new, ["kind", "same"]).collect()}
    assert got == {"kind": (2, ["c", "d"]), "same": (0, [])}


def test_parts_of_a_forest_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(S, "FOREST_PART_VALUES", 10_000)
    whole = spark.range(9000).coalesce(1)
    spread = S._in_parts(whole, trees=10)
    sizes = [r["n"] for r in spread.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 1000 and sum(sizes) == 9000 and spread.distinct().count() == 9000
    assert S._in_parts(whole, trees=1) is whole and S._in_parts(whole.limit(0), trees=10).count() == 0


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_forests_of_large_tables_count_equal_rows(spark, monkeypatch, task):
    """The counted forest finds what Spark ML's does, reads every row once and holds cells instead of rows."""
    rng = np.random.default_rng(1)
    n = 4000
    x = np.column_stack([rng.integers(0, 20, n), rng.integers(0, 8, n), rng.normal(size=n).round(1), rng.integers(0, 3, n)]).astype(float)
    y = 2 * (x[:, 0] > 11) + (x[:, 1] > 4) + rng.normal(scale=0.3, size=n)
    y = (y > 1.5).astype(float) if task == "classification" else y.round(1)
    columns = ["a", "b", "c", "d"]
    once = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], [*columns, "y"])
    df = once.crossJoin(spark.range(5).select(F.col("id").alias("copy"))).drop("copy")
    theirs = {r.feature: r.score for r in S.tree_importance(df, columns, "y", task, trees=40).collect()}
    made = []
    cells = forests.cells
    monkeypatch.setattr(forests, "cells", lambda *a: made.append(cells(*a)) or made[-1])
    monkeypatch.setattr(S, "FOREST_VALUES", 1000)
    monkeypatch.setattr(forests, "BLOCK_CELLS", 500)
    monkeypatch.setattr(forests, "PENDING_ROWS", 1500)
    monkeypatch.setattr(forests, "HISTOGRAM_BYTES", 200_000)
    first, again = ({r.feature: r.score for r in S.tree_importance(df, columns, "y", task, trees=40).collect()} for _ in range(2))
    counted = made[0].agg(F.sum("n"), F.count("*")).first()
    assert counted[0] == 5 * n and counted[1] <= n
    assert first == again and abs(sum(first.values()) - 1) < 1e-9
    assert all(abs(first[c] - theirs[c]) < 0.06 for c in columns)
    assert sorted(first, key=first.get)[2:] == sorted(theirs, key=theirs.get)[2:] and first["a"] > 0.4


def test_counted_forests_refuse_what_has_no_bin(spark):
    draw = lambda rows: forests.importances(spark.createDataFrame(rows, "a double, y double"), ["a"], "y", True, 2, 3, len(rows), 1)
    assert draw([(1.0, 0.0), (1.0, 1.0)] * 5).tolist() == [0.0] and draw([(float(i), float(i > 3)) for i in range(9)]).tolist() == [1.0]
    for rows in ([(float("inf"), 0.0)], [(1.0, 0.5)], [(1.0, -1.0)], [(1.0, None)]):
        with pytest.raises(Exception, match="labels must be|infinite values"):
            draw(rows)


def test_bins_of_a_forest():
    assert forests.thresholds(np.array([3.0, 1.0, 1.0, 2.0])).tolist() == [1.5, 2.5] and len(forests.thresholds(np.ones(5))) == 0
    values = np.random.default_rng(2).normal(size=20_000)
    sizes = np.bincount(np.searchsorted(forests.thresholds(values), values), minlength=32)
    assert len(sizes) == 32 and sizes.min() > 600 and sizes.max() < 650
