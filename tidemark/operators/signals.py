"""Evaluation of trading signals as set operations, with fixed capital.

Frames keep ``_rn``, the position of a row in its series, so that no step has
to number rows again. Signals feed several branches of the ledger and the
equity curve and are therefore written once to the shared checkpoint folder.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import indicators as I
from tidemark.plans.blocks import number_rows, running, with_rows
from tidemark.schemas import KEYS
from tidemark.session import cut_lineage

# Costs in basis points, share of capital per trade, days per year.
SPREAD_BPS = 5.0
COMMISSION_BPS = 2.0
SLIPPAGE_BPS = 1.0
CAPITAL_SHARE = 0.25
TRADING_DAYS = 252


def cost_rate(spread: float = SPREAD_BPS, commission: float = COMMISSION_BPS, slippage: float = SLIPPAGE_BPS) -> float:
    """Cost of one side of a trade as a share of its value."""
    return (spread + commission + slippage) / 10_000


def crossover(bars: DataFrame, short: int = 50, long: int = 200, **kw) -> DataFrame:
    """``signal`` 1 or -1 while the short average is above or below the long one, else 0."""
    stages = [
        {"sma_short": I.sma("close", short), "sma_long": I.sma("close", long)},
        {"signal": F.expr("CASE WHEN sma_short > sma_long THEN 1 WHEN sma_short < sma_long THEN -1 ELSE 0 END")},
    ]
    return with_rows(bars, stages, back=long, **kw).drop("_blk")


def stored(signals: DataFrame) -> DataFrame:
    """The columns the evaluation reads, numbered and cut from their lineage."""
    return cut_lineage(number_rows(signals).select(*KEYS, "timestamp", "close", "signal", "_rn"))


def run_starts(signals: DataFrame, capital: float, **kw) -> DataFrame:
    """First row of every run of equal signals, with the units it would trade.

    ``_rn`` of the result is the number of the run in its series.
    """
    base = with_rows(signals, [{"_before": I.previous("signal")}], back=1, **kw)
    first = F.col("_before").isNull() | (F.col("_before") != F.col("signal"))
    base = base.withColumn("_first", first.cast("long"))
    starts = running(base, {"_run": ("sum", F.col("_first"))}).where("_first = 1")
    units = F.when(F.col("signal") != 0, F.floor(F.try_divide(F.lit(capital * CAPITAL_SHARE), F.col("close")))).otherwise(0)
    return starts.select(
        *KEYS, "timestamp", "close", "signal", F.coalesce(units, F.lit(0)).cast("long").alias("units"), F.col("_run").alias("_rn")
    )


def ledger(signals: DataFrame, capital: float = 100_000.0, **kw) -> DataFrame:
    """One row per trade: a run of equal non-zero signals.

    Entry is the first close of the run, exit the first close of the next run,
    or the last close of the series.
    """
    signals = stored(signals)
    starts = run_starts(signals, capital, **kw)
    nexts = with_rows(starts, [{"_exit_time": I.following("timestamp"), "_exit_price": I.following("close")}], ahead=1, **kw)
    last = signals.groupBy(*KEYS).agg(F.max("timestamp").alias("_last_time"), F.max_by("close", "timestamp").alias("_last_price"))
    trades = nexts.where((F.col("signal") != 0) & (F.col("units") > 0)).join(last, KEYS)
    open_run = F.col("_exit_time").isNull()
    rate = cost_rate()
    out = trades.select(
        *KEYS, F.col("timestamp").alias("entry_time"), F.col("close").alias("entry_price"), "signal", "units",
        F.when(open_run, F.col("_last_time")).otherwise(F.col("_exit_time")).alias("exit_time"),
        F.when(open_run, F.col("_last_price")).otherwise(F.col("_exit_price")).alias("exit_price"),
    )
    costs = (F.col("entry_price") + F.col("exit_price")) * F.col("units") * rate
    gain = F.col("signal") * F.col("units") * (F.col("exit_price") - F.col("entry_price"))
    return out.withColumn("costs", costs).withColumn("profit", gain - costs)


def equity_curve(signals: DataFrame, capital: float = 100_000.0, **kw) -> DataFrame:
    """Cash plus the open position at each close.

    Position and cash change only where a run starts, so both are running sums.
    """
    signals = stored(signals)
    starts = run_starts(signals, capital, **kw)
    held = F.col("signal") * F.col("units")
    changes = with_rows(starts.withColumn("_held", held), [{"_prev": I.previous("_held")}], back=1, **kw)
    before = F.coalesce("_prev", F.lit(0))
    traded = (F.abs("_held") + F.abs(before)) * F.col("close") * cost_rate()
    changes = changes.select(
        *KEYS, "timestamp", (F.col("_held") - before).alias("_dp"), (-(F.col("_held") - before) * F.col("close") - traded).alias("_dc")
    )
    rows = signals.join(changes, [*KEYS, "timestamp"], "left")
    base = with_rows(cut_lineage(rows), [], **kw)
    out = running(base, {
        "position": ("sum", F.coalesce("_dp", F.lit(0))), "cash": ("sum", F.coalesce("_dc", F.lit(0.0))),
    })
    equity = F.lit(capital) + F.col("cash") + F.col("position") * F.col("close")
    return out.select(*KEYS, "timestamp", "close", "signal", "position", equity.alias("equity"), "_rn")


def sharpe(curve: DataFrame, risk_free: float = 0.0, **kw) -> DataFrame:
    """Yearly ratio of mean return to its deviation, 0 without deviation."""
    base = with_rows(curve, [{"_p": I.previous("equity")}], back=1, **kw)
    change = F.try_divide(F.col("equity"), F.col("_p")) - 1
    out = base.groupBy(*KEYS).agg(F.avg(change).alias("m"), F.stddev_samp(change).alias("s"))
    ratio = F.when(F.col("s") == 0, 0.0).otherwise(math.sqrt(TRADING_DAYS) * F.try_divide(F.col("m") - risk_free, F.col("s")))
    return out.select(*KEYS, ratio.alias("sharpe"))


def max_drawdown(curve: DataFrame, **kw) -> DataFrame:
    """Lowest equity relative to the highest one before it."""
    out = running(with_rows(curve, [], **kw), {"_peak": ("max", F.col("equity"))})
    return out.groupBy(*KEYS).agg(F.min(F.try_divide(F.col("equity") - F.col("_peak"), F.col("_peak"))).alias("max_drawdown"))
