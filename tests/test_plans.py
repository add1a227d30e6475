"""The plans keep to few shuffles and reach the Parquet reader."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.catalogue.common import hourly_bars
from tidemark.operators import features as X
from tidemark.operators import indicators as I
from tidemark.plans import quantiles
from tidemark.plans.blocks import number_rows, with_rows
from tidemark.sources.files import load_parquet


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_window_stages_share_one_exchange(spark, sf_dir, tmp_path):
    number_rows(hourly_bars(spark, sf_dir)).write.parquet(f"{tmp_path}/bars")
    bars = spark.read.parquet(f"{tmp_path}/bars").withColumn("EMA_20", F.col("close"))
    stages, back = I.window_indicators()
    stages = I.merge_stages(stages, [X.lag_columns(["close"]) | X.rolling_columns(["close"])], X.trend_stages(), X.target_stages())
    text = plan(with_rows(bars, stages, back=back, ahead=5))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert len(re.findall(r"\bSort \[", text)) == 1


def test_scan_prunes_and_pushes_down(spark, sf_dir):
    text = plan(load_parquet(spark, f"{sf_dir}/orders.parquet", ["o_orderkey"], F.col("o_orderstatus") == "F"))
    assert "EqualTo(o_orderstatus,F)" in text
    assert "o_totalprice" not in text


def test_blocks_key_the_window_by_block(spark, sf_dir):
    text = plan(with_rows(hourly_bars(spark, sf_dir), [{"m": I.sma("close", 5)}], back=5))
    assert re.search(r"hashpartitioning\(symbol#\d+, [^()]*_blk#\d+", text)


def test_no_cartesian_products(spark, sf_dir):
    import __spark_entry__ as entry

    queries = entry.queries()
    for name in ["scale_standard", "variance_selection", "chi2_scores", "prediction_latency", "load_summary", "roc_auc", "drift_continuous"]:
        text = plan(queries[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


@pytest.mark.parametrize("block", [8, 4096])
def test_percentiles_of_split_brackets(spark, monkeypatch, block):
    """Brackets are ranked part by part; ties, missing values and one-valued groups included."""
    monkeypatch.setattr(quantiles, "BLOCK_VALUES", block)
    rng = np.random.default_rng(block)
    values = {"a": rng.standard_normal(500).round(2).tolist(), "b": [1.0] * 40, "c": [3.0]}
    rows = [(k, v) for k, own in values.items() for v in own] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = quantiles.exact_percentiles(df, ["v"], [0.1, 0.5, 0.99], ["k"]).collect()
    for r in got:
        assert r["value"] == pytest.approx(np.percentile(values[r["k"]], 100 * r["p"]), abs=1e-12)
    assert len(got) == 9
