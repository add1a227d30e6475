"""State machines: results equal a plain walk, in few passes."""

import math
import random
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import indicators, metrics
from tidemark.plans import settle as S

START = datetime(2024, 1, 1)


def adding():
    """A machine that never forgets its start: the state is the sum of all values so far."""

    def walk(table, state):
        total = 0 if state is None else state["total"]
        out = []
        for x in table["x"].to_pylist():
            total += x
            out.append(total)
        return out, {"total": total}

    return walk


@pytest.mark.parametrize("n_blocks", [1, 2, 3, 8, 33])
def test_passes_grow_with_the_logarithm_of_the_blocks(spark, n_blocks):
    df = spark.range(n_blocks * 10).select(F.lit("a").alias("k"), F.floor(F.col("id") / 10).alias("_blk"), (F.col("id") + 1).alias("_rn"), (F.col("id") % 7).alias("x"))
    df = df.unionByName(df.where("_blk = 0").withColumn("k", F.lit("b")))
    states, passes = S.settled_states(df, adding(), "total bigint", ["k"])
    if n_blocks == 1:
        assert states is None
        return
    assert passes <= math.log2(n_blocks) + 3
    got = {(r.k, r._blk): r._state and r._state.total for r in states.collect()}
    assert got == {("a", b): sum(i % 7 for i in range(10 * b)) if b else None for b in range(n_blocks)} | {("b", 0): None}
    out = S.settle(df, adding(), "total bigint", "total", "bigint", ["x"], ["k"]).collect()
    assert {(r.k, r._rn): r.total for r in out if r.k == "a"} == {("a", n): sum(i % 7 for i in range(n)) for n in range(1, n_blocks * 10 + 1)}


def allowed_one_by_one(times, limit, span):
    recent, out = deque(), []
    for now in times:
        while recent and recent[0] <= now - span:
            recent.popleft()
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(now)
    return out


def test_steady_overload_that_never_lines_up(spark):
    """Every user asks at a steady rate above the limit, so blocks never see the same window twice."""
    rng = random.Random(5)
    rows, want = [], {}
    for user, gap in (("a", 0.7), ("b", 1.3), ("c", 0.9)):
        times = [START + timedelta(seconds=gap * i + rng.random() * 0.01) for i in range(640)]
        rows += [(user, t) for t in times]
        micros = [(t - START) // timedelta(microseconds=1) for t in times]
        want[user] = allowed_one_by_one(micros, 7, 60_000_000)
    df = spark.createDataFrame(rows, "user string, timestamp timestamp").repartition(3)
    passes = []
    plain = S.settled_states

    def watched(*args):
        states, n = plain(*args)
        passes.append(n)
        return states, n

    S.settled_states = watched
    try:
        got = metrics.request_decisions(df, 7, 60, block_rows=10).collect()
    finally:
        S.settled_states = plain
    by_user = {u: [r.allowed for r in sorted((r for r in got if r.user == u), key=lambda r: r.timestamp)] for u in want}
    assert by_user == want
    assert passes[0] <= math.log2(64) + 3


def sar_one_by_one(bars, step=0.02, maximum=0.2):
    out, state = [], None
    for high, low in bars:
        if state is None:
            stop, side, pace, extreme = low, 1, step, high
        else:
            stop, side, pace, extreme = state
            stop += pace * (extreme - stop)
            ahead, behind = (high, low) if side == 1 else (low, high)
            if side * (behind - stop) <= 0:
                stop, side, pace, extreme = extreme, -side, step, behind
            elif side * (ahead - extreme) > 0:
                extreme, pace = ahead, min(pace + step, maximum)
        state = stop, side, pace, extreme
        out.append(stop)
    return out


def test_stops_of_a_trend_longer_than_many_blocks(spark):
    """A trend that never turns keeps every start in doubt up to the end of the series."""
    bars = {"up": [(100 + i, 99.5 + i) for i in range(300)]}
    rng = random.Random(2)
    level, walk = 100.0, []
    for _ in range(300):
        level += rng.gauss(0, 1)
        walk.append((level + rng.random(), level - rng.random()))
    bars["walk"] = walk
    rows = [(s, "1h", START + timedelta(hours=i), float(h), float(lo)) for s, series in bars.items() for i, (h, lo) in enumerate(series)]
    df = spark.createDataFrame(rows, "symbol string, interval string, timestamp timestamp, high double, low double").repartition(3)
    got = indicators.parabolic_sar(df, block_rows=10).collect()
    for name, series in bars.items():
        assert [r.Parabolic_SAR for r in sorted((r for r in got if r.symbol == name), key=lambda r: r.timestamp)] == sar_one_by_one(series)
