"""Cuts in time over series of different spans, and importance in one pass."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models as K
from tidemark.operators import selection as S

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def two_spans(spark):
    """One symbol trades all the time, another only late and more often, a third for a single bar."""
    rows = [("long", "1h", START + timedelta(hours=i)) for i in range(200)]
    rows += [("late", "15m", START + timedelta(hours=120, minutes=15 * i)) for i in range(240)] + [("one", "1h", START)]
    rng = random.Random(4)
    rows = [(*r, rng.gauss(0, 1), rng.gauss(0, 1)) for r in rows]
    return spark.createDataFrame([(*r, 3 * r[3] + 1.0) for r in rows], "symbol string, interval string, timestamp timestamp, x double, z double, y double").cache()


@pytest.mark.parametrize("gap", [0, 1, 6])
def test_no_training_row_sees_past_a_test_row(two_spans, gap):
    rows = K.time_split(two_spans, 0.8, gap).collect()
    length = {"1h": timedelta(hours=1), "15m": timedelta(minutes=15)}
    first = min(r.timestamp for r in rows if r.part == "test")
    assert all(r.timestamp + gap * length[r.interval] < first for r in rows if r.part == "train")
    times = sorted(r.timestamp for r in rows)
    cut = times[int(0.8 * len(times)) - 1]
    assert {r.timestamp > cut for r in rows if r.part == "test"} == {True}
    assert sum(r.part == "test" for r in rows) == sum(t > cut for t in times)
    want = {(r.symbol, r.timestamp) for r in rows if r.timestamp + gap * length[r.interval] <= cut}
    assert {(r.symbol, r.timestamp) for r in rows if r.part == "train"} == want


@pytest.mark.parametrize("gap", [0, 3])
def test_folds_train_on_earlier_rows_of_all_series(two_spans, gap):
    rows = K.time_folds(two_spans, 4, gap).collect()
    length = {"1h": timedelta(hours=1), "15m": timedelta(minutes=15)}
    times = sorted(r.timestamp for r in rows)
    size = len(times) // 5
    ends = [times[len(times) - (4 - j) * size - 1] for j in range(4)]
    for r in rows:
        assert r.fold == sum(r.timestamp > e for e in ends)
        assert r.trains_from == 1 + sum(r.timestamp + gap * length[r.interval] > e for e in ends)
    for i in range(1, 5):
        first = min(r.timestamp for r in rows if r.fold == i)
        trained = [r for r in rows if r.trains_from <= i]
        assert trained and all(r.timestamp + gap * length[r.interval] < first for r in trained)


def test_too_few_rows_for_folds_only_train(two_spans):
    rows = K.time_folds(two_spans.where("symbol = 'one'"), 5).collect()
    assert [(r.fold, r.trains_from) for r in rows] == [(0, 1)]
    assert K.time_split(two_spans.limit(0)).collect() == []


def test_importance_in_one_pass_equals_the_closed_form(two_spans):
    model = K.pipeline("linear_regression", ["x", "z"], "y", "regression").fit(two_spans)
    found = {r.feature: r.importance for r in K.permutation_importance(model, two_spans, ["x", "z"], "y", "regression").collect()}
    pairs = K.dealt_out(two_spans, ["x", "z"]).collect()
    assert sorted(r._new.x for r in pairs) == sorted(r.x for r in pairs) and all(r._new.x != r.x for r in pairs)
    # y = 3 x + 1 without noise: the loss of R squared is the mean squared change of 3 x over the variance of y.
    mean = sum(r.y for r in pairs) / len(pairs)
    variance = sum((r.y - mean) ** 2 for r in pairs) / len(pairs)
    want = sum((3 * (r._new.x - r.x)) ** 2 for r in pairs) / len(pairs) / variance
    assert found["x"] == pytest.approx(want, rel=1e-6)
    assert found["z"] == pytest.approx(0, abs=1e-6)


def test_small_buckets_still_deal_out_all_values(two_spans):
    pairs = K.dealt_out(two_spans, ["x"], rows_per_bucket=50).collect()
    assert sorted(r._new.x for r in pairs) == sorted(r.x for r in pairs)


def test_grid_has_every_combination():
    space = {"n": (1, 5), "x": (0.0, 1.0), "c": ["a", "b"]}
    found = K.grid(space, 3)
    assert len(found) == 18 and {d["n"] for d in found} == {1, 3, 5} and {d["x"] for d in found} == {0.0, 0.5, 1.0}
    assert K.grid({"n": (1, 2)}, 5) == [{"n": 1}, {"n": 2}]


def test_search_over_a_grid(two_spans):
    df = two_spans.withColumn("up", (F.col("y") > 1).cast("double"))
    found = K.search(df, ["x"], "up", ["logistic_regression"], k=2, spaces={"logistic_regression": {"regParam": [0.001, 100.0]}}, points=2).collect()
    scores = {r.params["regParam"]: r.score for r in found}
    assert len(found) == 2 and scores["0.001"] > 0.9


def slices_frame(spark, n=400):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 3, n).astype(float)
    a = rng.standard_normal(n) + y
    pdf = pd.DataFrame({
        "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "y": y, "a": a, "b": 2 * a + 0.01 * rng.standard_normal(n),
        "c": rng.standard_normal(n) * np.linspace(0.01, 3, n), "d": 1e6 + rng.standard_normal(n) - 0.5 * y, "e": np.ones(n),
    })
    pdf.loc[rng.random(n) < 0.1, "c"] = np.nan
    pdf = pdf.astype(object).where(pdf.notna(), None)
    schema = "ts timestamp, y double, a double, b double, c double, d double, e double"
    rows = [(t.to_pydatetime(), *rest) for t, *rest in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, schema).repartition(6)


def test_slices_equal_the_chain_on_their_rows(spark):
    """Sums of segments give what each step gives on the rows of a slice."""
    columns = ["a", "b", "c", "d", "e"]
    df = S.time_segments(slices_frame(spark), "ts", 4).persist()
    assert sorted(r["count"] for r in df.groupBy("segment").count().collect()) == [100] * 4
    got = {(r["slice"], r["step"]): r["features"] for r in S.slice_selections(df, columns, "y", k=2).collect()}
    assert len(got) == 12
    for s in range(4):
        own = df.where(F.col("segment").between(s, s + 1))
        varied = S._names(S.variances(own, columns))
        apart = S._names(S.correlation_selection(own, varied))
        best = S._names(S.best(S.f_scores(own, apart, "y"), k=2))
        assert got[s, "variance"] == sorted(varied)
        assert got[s, "correlation"] == sorted(apart)
        assert got[s, "univariate"] == sorted(best)
    df.unpersist()


def test_slices_without_rows_labels_or_features(spark):
    columns = ["a", "e"]
    df = S.time_segments(slices_frame(spark, 40), "ts", 2)
    assert S.slice_selections(df.where("segment > 9"), columns, "y").count() == 0
    blank = S.slice_selections(df.withColumn("y", F.lit(None).cast("double")), columns, "y").where("step = 'univariate'")
    assert {tuple(r["features"]) for r in blank.collect()} == {("a",)}
    none = S.slice_selections(df, ["e"], "y", trees=3)
    assert none.count() == 6 and none.where("size(features) > 0").count() == 0
    assert S.stability(none.where("step = 'univariate'").select("slice", "features"), neighbours=False).first()["n_pairs"] == 0


def test_stability_of_all_pairs(spark):
    rows = [(0, ["a", "b"]), (1, ["a"]), (2, ["c"]), (3, [])]
    df = spark.createDataFrame(rows, "slice long, features array<string>")
    assert S.stability(df, neighbours=False).first() == (pytest.approx(0.5 / 6), 6)
    assert S.stability(df).first() == (pytest.approx(0.5 / 3), 3)
