"""Block-wise results equal plain loops over the whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as X
from tidemark.operators import indicators as I
from tidemark.plans.blocks import number_rows, plain, recurrences, running, with_rows
from tidemark.plans.quantiles import exact_percentiles
from tidemark.plans.ranks import cumulative, prefix_ranks

BLOCK = 64


@pytest.fixture(scope="module")
def frame():
    """Two hourly series with gaps, long enough for several blocks and time buckets."""
    rng = np.random.default_rng(3)
    parts = []
    for symbol, n in [("A", 500), ("B", 130), ("C", 1)]:
        hours = np.sort(rng.choice(12_000, n, replace=False))
        close = np.round(50 + np.cumsum(rng.normal(0, 1, n)), 2)
        opened = np.round(close + rng.normal(0, 0.5, n), 2)
        parts.append(pd.DataFrame({
            "symbol": symbol, "interval": "1h", "timestamp": pd.Timestamp("2020-01-01") + pd.to_timedelta(hours, "h"),
            "open": opened, "high": np.maximum(opened, close) + 1, "low": np.minimum(opened, close) - 1, "close": close,
            "volume": rng.integers(1, 9, n).astype(float),
        }))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def bars(spark, frame):
    return spark.createDataFrame(frame).repartition(4)


def collected(df, *columns):
    out = df.select("symbol", "timestamp", *columns).toPandas().sort_values(["symbol", "timestamp"])
    return out.reset_index(drop=True)


def by_symbol(frame, fn):
    return np.concatenate([np.asarray(fn(g), dtype=float) for _, g in frame.groupby("symbol", sort=True)])


def close_to(got, want):
    np.testing.assert_allclose(got.astype(float), want, rtol=1e-9, atol=1e-9, equal_nan=True)


def test_row_numbers(bars, frame):
    got = collected(number_rows(bars), "_rn")
    close_to(got["_rn"], by_symbol(frame, lambda g: np.arange(1, len(g) + 1)))


def test_windows_cross_blocks(bars, frame):
    out = with_rows(bars, [{"m": I.sma("close", 20), "p": I.previous("close", 7), "f": I.following("close", 3)}], back=20, ahead=3, block_rows=BLOCK)
    got = collected(out, "m", "p", "f")
    close_to(got["m"], by_symbol(frame, lambda g: g["close"].rolling(20).mean()))
    close_to(got["p"], by_symbol(frame, lambda g: g["close"].shift(7)))
    close_to(got["f"], by_symbol(frame, lambda g: g["close"].shift(-3)))


def test_context_wider_than_block_is_refused(bars):
    with pytest.raises(ValueError):
        with_rows(bars, [], back=BLOCK + 1, block_rows=BLOCK)


def test_running(bars, frame):
    out = running(with_rows(bars, [], block_rows=BLOCK), {"s": ("sum", F.col("volume")), "hi": ("max", F.col("close")), "lo": ("min", F.col("close"))})
    got = collected(out, "s", "hi", "lo")
    close_to(got["s"], by_symbol(frame, lambda g: g["volume"].cumsum()))
    close_to(got["hi"], by_symbol(frame, lambda g: g["close"].cummax()))
    close_to(got["lo"], by_symbol(frame, lambda g: g["close"].cummin()))


def ema_loop(values, n):
    out, a = [], 2.0 / (n + 1)
    for v in values:
        out.append(v if not out else a * v + (1 - a) * out[-1])
    return out


@pytest.mark.parametrize("fan_out", [4096, 2])
def test_ema_over_blocks(bars, frame, monkeypatch, fan_out):
    monkeypatch.setattr("tidemark.plans.blocks.FAN_OUT", fan_out)
    got = collected(I.ema(bars, "close", [1, 2, 3, 26, 200], block_rows=BLOCK), "EMA_1", "EMA_2", "EMA_3", "EMA_26", "EMA_200")
    for n in (1, 2, 3, 26, 200):
        close_to(got[f"EMA_{n}"], by_symbol(frame, lambda g: ema_loop(g["close"], n)))


def test_recurrence_with_fast_decay(bars, frame):
    out = recurrences(with_rows(bars, [], block_rows=BLOCK), {"y": (F.col("close"), 1e-6)}, block_rows=BLOCK)
    got = collected(plain(out), "y")
    close_to(got["y"], by_symbol(frame, lambda g: g["close"] + 1e-6 * g["close"].shift(1).fillna(0) + 1e-12 * g["close"].shift(2).fillna(0)))


def test_macd_equal_spans_takes_two_passes(bars, frame):
    got = collected(I.macd(bars, fast=9, slow=26, signal=9, block_rows=BLOCK), "MACD_Signal")

    def signal(g):
        line = np.array(ema_loop(g["close"], 9)) - np.array(ema_loop(g["close"], 26))
        return ema_loop(line, 9)

    close_to(got["MACD_Signal"], by_symbol(frame, signal))


def rsi_loop(values, n):
    change = np.diff(values)
    out = [np.nan] * len(values)
    if len(change) < n:
        return out
    gain, loss = np.maximum(change, 0), np.maximum(-change, 0)
    g, s = gain[:n].mean(), loss[:n].mean()
    for i in range(n, len(values)):
        if i > n:
            g, s = (g * (n - 1) + gain[i - 1]) / n, (s * (n - 1) + loss[i - 1]) / n
        out[i] = 100.0 if s == 0 else 100 - 100 / (1 + g / s)
    return out


def test_rsi_over_blocks(bars, frame):
    got = collected(I.rsi(bars, n=14, block_rows=BLOCK), "RSI_14")
    close_to(got["RSI_14"], by_symbol(frame, lambda g: rsi_loop(g["close"].to_numpy(), 14)))
    assert got["RSI_14"].dropna().between(0, 100).all()


def test_sar_settles_to_the_single_pass(bars, frame):
    whole = collected(I.parabolic_sar(bars), "Parabolic_SAR")
    split = collected(I.parabolic_sar(bars, block_rows=8), "Parabolic_SAR")
    close_to(split["Parabolic_SAR"], whole["Parabolic_SAR"].to_numpy())


def test_expanding_over_blocks(bars, frame):
    got = collected(X.expanding_features(bars, ["close"], block_rows=BLOCK), "close_expanding_mean", "close_expanding_std")
    close_to(got["close_expanding_mean"], by_symbol(frame, lambda g: g["close"].expanding().mean()))
    close_to(got["close_expanding_std"], by_symbol(frame, lambda g: g["close"].expanding().std()))


def test_rolling_moments_match_pandas(bars, frame):
    got = collected(X.rolling_features(bars, ["close"], [10], block_rows=BLOCK), "close_rolling_10_skew", "close_rolling_10_kurt")
    np.testing.assert_allclose(got["close_rolling_10_skew"], by_symbol(frame, lambda g: g["close"].rolling(10).skew()), atol=1e-6)
    np.testing.assert_allclose(got["close_rolling_10_kurt"], by_symbol(frame, lambda g: g["close"].rolling(10).kurt()), atol=1e-6)


def test_constant_window_moments(spark):
    rows = [("A", "1h", (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)).to_pydatetime(), 5.0) for i in range(8)]
    df = spark.createDataFrame(rows, "symbol string, interval string, timestamp timestamp, close double")
    got = collected(X.rolling_features(df, ["close"], [5]), "close_rolling_5_skew", "close_rolling_5_kurt").dropna()
    assert set(got["close_rolling_5_skew"]) == {0.0} and set(got["close_rolling_5_kurt"]) == {-3.0}


def test_percentiles_with_poor_and_good_brackets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.choice(["x", "y"], 4000, p=[0.9, 0.1]), "v": np.round(rng.lognormal(0, 2, 4000), 3)})
    df = spark.createDataFrame(pdf).repartition(5)
    for accuracy in (100_000, 20):
        monkeypatch.setattr("tidemark.plans.quantiles.ACCURACY", accuracy)
        got = {(r["k"], r["p"]): r["value"] for r in exact_percentiles(df, ["v"], [0.0, 0.25, 0.7, 0.99, 1.0], ["k"]).collect()}
        for k, g in pdf.groupby("k"):
            for p in (0.0, 0.25, 0.7, 0.99, 1.0):
                assert got[(k, p)] == pytest.approx(np.quantile(g["v"], p), rel=1e-12)


def test_cumulative_over_value_ranges(spark):
    pdf = pd.DataFrame({"k": ["a"] * 300 + ["b"] * 5, "v": [float(i) for i in range(300)] + [float(i) for i in range(5)]})
    pdf["n"] = 1
    got = cumulative(spark.createDataFrame(pdf).repartition(3), ["k"], "v", {"c": F.col("n")}, ranges=16).toPandas()
    assert (got["c"] == got["v"] + 1).all() and len(got) == 305


def test_other_spelling_of_the_time_zone(spark, bars, frame):
    spark.conf.set("spark.sql.session.timeZone", "Etc/UTC")
    try:
        assert I.parabolic_sar(bars).count() == len(frame)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("cell", [8, 64, 1 << 16])
def test_ranks_among_earlier_values(spark, cell):
    """Cut into many ranges and blocks or not at all; a third of one series is one value, others are missing."""
    rng = np.random.default_rng(cell)
    hot = np.where(rng.random(300) < 0.35, 0.0, rng.standard_normal(300).round(1))
    own = {"a": [None if rng.random() < 0.1 else float(v) for v in hot], "b": [2.0] * 30, "c": [None], "d": [float(-i) for i in range(50)]}
    rows = [(k, i + 1, v) for k, values in own.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, at long, v double").repartition(5)
    got = {(r["k"], r["at"]): (r["_seen"], r["_less"]) for r in prefix_ranks(df, ["k"], "at", "v", cell).collect()}
    want = {}
    for k, values in own.items():
        for i, v in enumerate(values):
            if v is not None:
                past = [x for x in values[: i + 1] if x is not None]
                want[k, i + 1] = (len(past), sum(x < v for x in past))
    assert got == want
    assert prefix_ranks(df.where("k = 'z'"), ["k"], "at", "v", cell).count() == 0


def test_expanding_volatility_threshold(spark, bars, frame, monkeypatch):
    """Equals the percentile of every prefix, with cells of any size."""
    for cell in (16, 1 << 16):
        monkeypatch.setattr("tidemark.plans.ranks.CELL_ROWS", cell)
        got = X.volatility_regime(bars, threshold="expanding").toPandas().sort_values(["symbol", "timestamp"])
        for symbol, g in got.groupby("symbol"):
            close = frame[frame["symbol"] == symbol].sort_values("timestamp")["close"]
            vol = close.pct_change().rolling(20).std()
            want = (vol > vol.expanding().quantile(0.7)).astype(int)
            assert g["volatility_regime"].tolist() == want.tolist()
    with pytest.raises(ValueError):
        X.volatility_regime(bars, threshold="other")


def test_percentiles_of_many_groups_by_salt(spark, monkeypatch):
    """Beyond the counted bound groups are joined under salts, with the same values."""
    monkeypatch.setattr("tidemark.plans.quantiles.FEW_GROUPS", 2)
    rows = [(f"k{i % 7}", float(i * i % 101)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v double")
    for r in exact_percentiles(df, ["v"], [0.5], ["k"]).collect():
        assert r["value"] == pytest.approx(np.percentile([v for k, v in rows if k == r["k"]], 50))


@pytest.mark.parametrize("rows", [3, 50, 1 << 20])
def test_cumulative_ranges_grow_with_the_values(spark, monkeypatch, rows):
    """As many ranges as the values ask for; a group may fill several, a range may hold several groups."""
    monkeypatch.setattr("tidemark.plans.ranks.RANGE_ROWS", rows)
    pdf = pd.DataFrame({"k": ["a"] * 200 + ["b"] * 5 + ["c"], "v": [float(i) for i in (*range(200), *range(5), 9)], "n": 2})
    got = cumulative(spark.createDataFrame(pdf).repartition(7), ["k"], "v", {"c": F.col("n")}).toPandas()
    first = got.groupby("k")["v"].transform("min")
    assert (got["c"] == 2 * (got["v"] - first + 1)).all() and len(got) == 206
