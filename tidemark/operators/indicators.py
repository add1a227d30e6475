"""Technical indicators.

The small functions return columns for use inside ``with_rows``: they refer to
the shared block window, so any number of them runs on one exchange and one
sort. A column is NULL until its window is full, and NULL where a ratio has a
zero denominator.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.blocks import number_rows, over, plain, recurrences, running, with_rows
from tidemark.plans.settle import settle
from tidemark.session import cut_lineage

# Default periods.
SMA_PERIODS = [2, 3, 5, 8, 10, 13, 15, 20, 30, 50, 100, 200]
EMA_PERIODS = [3, 5, 8, 10, 12, 15, 20, 25, 30, 35, 50, 100, 200]


def _positive(*windows: int) -> None:
    if any(w <= 0 for w in windows):
        raise ValueError("window must be positive")


def full_text(agg: str, c: str, n: int) -> str:
    w = over(n - 1)
    return f"CASE WHEN count({c}) {w} = {n} THEN {agg}({c}) {w} END"


def full(agg: str, c: str, n: int) -> Column:
    """``agg`` over the last n rows, NULL unless all n values are present."""
    return F.expr(full_text(agg, c, n))


def previous(c: str, n: int = 1) -> Column:
    return F.expr(f"lag({c}, {n}) {over()}")


def following(c: str, n: int = 1) -> Column:
    return F.expr(f"lead({c}, {n}) {over()}")


# --- trend -----------------------------------------------------------------


def sma(c: str, n: int) -> Column:
    _positive(n)
    return full("avg", c, n)


def ema_spec(c: str, n: int) -> tuple[Column, float]:
    """Recurrence of the exponential average, seeded with the first value."""
    _positive(n)
    alpha = 2.0 / (n + 1)
    return F.expr(f"CASE WHEN _rn = 1 THEN {c} ELSE {c} * {alpha!r}D END"), 1.0 - alpha


def ema(bars: DataFrame, c: str = "close", periods: Sequence[int] = EMA_PERIODS, block_rows: int | None = None) -> DataFrame:
    """Add ``EMA_n`` for every period."""
    base = with_rows(bars, [], block_rows=block_rows)
    return plain(recurrences(base, {f"EMA_{n}": ema_spec(c, n) for n in periods}, block_rows=block_rows))


def _signal(line_period: int, signal: int, name: str) -> Column:
    """EMA(signal) of EMA(line_period), from the two plain averages of the input.

    For decays a and s, EMA_s(EMA_a(x)) = q EMA_a(x) + (1 - q) EMA_s(x) with
    q = (1 - s) a / (a - s), because both sides obey the same recurrence.
    """
    a, s = 1 - 2.0 / (line_period + 1), 1 - 2.0 / (signal + 1)
    q = (1 - s) * a / (a - s)
    return q * F.col(name) + (1 - q) * F.col("_ema_signal")


def macd(bars: DataFrame, c: str = "close", fast: int = 12, slow: int = 26, signal: int = 9,
         block_rows: int | None = None) -> DataFrame:
    """Add ``MACD``, ``MACD_Signal`` and ``MACD_Histogram``."""
    if fast >= slow:
        raise ValueError("fast period must be less than slow period")
    base = with_rows(bars, [], block_rows=block_rows)
    specs = {"_ema_fast": ema_spec(c, fast), "_ema_slow": ema_spec(c, slow), "_ema_signal": ema_spec(c, signal)}
    if signal in (fast, slow):
        lines = recurrences(base, {k: specs[k] for k in ("_ema_fast", "_ema_slow")}, block_rows=block_rows)
        lines = lines.withColumn("MACD", F.col("_ema_fast") - F.col("_ema_slow"))
        out = recurrences(lines, {"MACD_Signal": ema_spec("MACD", signal)}, block_rows=block_rows)
    else:
        out = recurrences(base, specs, block_rows=block_rows)
        out = out.select("*", *macd_columns(fast, slow, signal))
    return plain(out.withColumn("MACD_Histogram", F.col("MACD") - F.col("MACD_Signal"))).drop(*specs)


def macd_columns(fast: int, slow: int, signal: int) -> list[Column]:
    return [
        (F.col("_ema_fast") - F.col("_ema_slow")).alias("MACD"),
        (_signal(fast, signal, "_ema_fast") - _signal(slow, signal, "_ema_slow")).alias("MACD_Signal"),
    ]


def true_range(high="high", low="low", close="close") -> Column:
    pc = f"lag({close}) {over()}"
    return F.expr(f"greatest({high} - {low}, abs({high} - {pc}), abs({low} - {pc}))")


def adx_stages(n: int = 14) -> list[dict[str, Column]]:
    """Directional movement; smoothing is the plain rolling mean."""
    _positive(n)
    up, down = F.col("high") - previous("high"), previous("low") - F.col("low")
    moves = {
        "_tr": true_range(),
        "_dmp": F.when(up > down, F.greatest(up, F.lit(0.0))).otherwise(0.0),
        "_dmm": F.when(down > up, F.greatest(down, F.lit(0.0))).otherwise(0.0),
    }
    lines = {
        "DI_Plus": F.try_divide(100 * sma("_dmp", n), sma("_tr", n)),
        "DI_Minus": F.try_divide(100 * sma("_dmm", n), sma("_tr", n)),
    }
    index = {"_dx": F.try_divide(100 * F.abs(F.col("DI_Plus") - F.col("DI_Minus")), F.col("DI_Plus") + F.col("DI_Minus"))}
    return [moves, lines, index, {"ADX": sma("_dx", n)}]


def adx(bars: DataFrame, n: int = 14, block_rows: int | None = None) -> DataFrame:
    out = with_rows(bars, adx_stages(n), back=2 * n, block_rows=block_rows)
    return plain(out).drop("_tr", "_dmp", "_dmm", "_dx")


def sar_step(state: dict | None, high: float | None, low: float | None, step: float, maximum: float) -> tuple[float | None, dict]:
    """Stop at one bar and the state after it. A bar without high or low has no stop and leaves the state as it was."""
    if high is None or low is None:
        return None, state or {"stop": None, "side": None, "pace": None, "extreme": None}
    if state is None or state["stop"] is None:
        stop, side, pace, extreme = low, 1, step, high
    else:
        stop, side, pace, extreme = state["stop"], state["side"], state["pace"], state["extreme"]
        stop += pace * (extreme - stop)
        # ``side`` turns falling bars into rising ones.
        ahead, behind = (high, low) if side == 1 else (low, high)
        if side * (behind - stop) <= 0:
            stop, side, pace, extreme = extreme, -side, step, behind
        elif side * (ahead - extreme) > 0:
            extreme, pace = ahead, min(pace + step, maximum)
    return stop, {"stop": stop, "side": side, "pace": pace, "extreme": extreme}


def parabolic_sar(bars: DataFrame, step: float = 0.02, maximum: float = 0.2, block_rows: int | None = None) -> DataFrame:
    """Add ``Parabolic_SAR``; the state of a block settles by repeated passes."""
    return plain(sar_on_blocks(bars, step, maximum, block_rows))


def sar_on_blocks(bars: DataFrame, step: float = 0.02, maximum: float = 0.2, block_rows: int | None = None) -> DataFrame:
    base = with_rows(bars, [], block_rows=block_rows)

    def walk(table: pa.Table, state: dict | None) -> tuple[list[float | None], dict]:
        out = []
        for high, low in zip(table["high"].to_pylist(), table["low"].to_pylist()):
            stop, state = sar_step(state, high, low, step, maximum)
            out.append(stop)
        return out, state

    state = "stop double, side int, pace double, extreme double"
    return settle(base, walk, state, "Parabolic_SAR", "double", ["high", "low"])


# --- momentum --------------------------------------------------------------


def rsi_stages(c: str = "close", n: int = 14) -> list[dict[str, Column]]:
    _positive(n)
    change = F.col(c) - previous(c)
    first = {"_gain": F.greatest(change, F.lit(0.0)), "_loss": F.greatest(-change, F.lit(0.0))}
    seeds = {"_gain_seed": full("avg", "_gain", n), "_loss_seed": full("avg", "_loss", n)}
    return [first, seeds]


def rsi_specs(n: int = 14) -> dict[str, tuple[Column, float]]:
    """Smoothed gain and loss: zero up to row n, then the mean, then the recurrence."""

    def spec(kind: str) -> tuple[Column, float]:
        start = F.when(F.col("_rn") <= n, 0.0).when(F.col("_rn") == n + 1, F.col(f"_{kind}_seed"))
        return start.otherwise(F.col(f"_{kind}") / n), 1.0 - 1.0 / n

    return {"_avg_gain": spec("gain"), "_avg_loss": spec("loss")}


def rsi_value(n: int = 14) -> Column:
    strength = F.try_divide(F.col("_avg_gain"), F.col("_avg_loss"))
    value = F.when(F.col("_avg_loss") == 0, 100.0).otherwise(100 - 100 / (1 + strength))
    return F.when(F.col("_rn") > n, value)


RSI_SCRATCH = ["_gain", "_loss", "_gain_seed", "_loss_seed", "_avg_gain", "_avg_loss"]


def rsi(bars: DataFrame, c: str = "close", n: int = 14, block_rows: int | None = None) -> DataFrame:
    base = with_rows(bars, rsi_stages(c, n), back=n, block_rows=block_rows)
    out = recurrences(base, rsi_specs(n), block_rows=block_rows).withColumn(f"RSI_{n}", rsi_value(n))
    return plain(out).drop(*RSI_SCRATCH)


def stochastic_stages(k: int = 14, d: int = 3) -> list[dict[str, Column]]:
    _positive(k, d)
    low, high = full("min", "low", k), full("max", "high", k)
    return [{"Stoch_K": F.try_divide(100 * (F.col("close") - low), high - low)}, {"Stoch_D": sma("Stoch_K", d)}]


def williams_r(n: int = 14) -> Column:
    _positive(n)
    low, high = full("min", "low", n), full("max", "high", n)
    return F.try_divide(-100 * (high - F.col("close")), high - low)


def roc(c: str = "close", n: int = 10) -> Column:
    _positive(n)
    return F.try_divide(F.col(c) - previous(c, n), previous(c, n)) * 100


def momentum(c: str = "close", n: int = 10) -> Column:
    _positive(n)
    return F.col(c) - previous(c, n)


# --- volatility ------------------------------------------------------------


def bollinger_stages(c: str = "close", n: int = 20, width: float = 2) -> list[dict[str, Column]]:
    _positive(n)
    deviation = full("stddev_samp", c, n) * width
    bands = {"BB_Upper": sma(c, n) + deviation, "BB_Middle": sma(c, n), "BB_Lower": sma(c, n) - deviation}
    gap = F.col("BB_Upper") - F.col("BB_Lower")
    return [bands, {"BB_Width": gap, "BB_Position": F.try_divide(F.col(c) - F.col("BB_Lower"), gap)}]


def atr_stages(n: int = 14) -> list[dict[str, Column]]:
    _positive(n)
    return [{"_tr": true_range()}, {f"ATR_{n}": sma("_tr", n)}]


def keltner(bars: DataFrame, n: int = 20, multiplier: float = 2, block_rows: int | None = None) -> DataFrame:
    base = with_rows(bars, [{"_tr": true_range()}, {"_atr": sma("_tr", n)}], back=n, block_rows=block_rows)
    out = recurrences(base, {"KC_Middle": ema_spec("close", n)}, block_rows=block_rows)
    return plain(out.select("*", *keltner_columns(F.col("KC_Middle"), F.col("_atr"), multiplier))).drop("_tr", "_atr")


def keltner_columns(middle: Column, spread: Column, multiplier: float) -> list[Column]:
    return [(middle + multiplier * spread).alias("KC_Upper"), (middle - multiplier * spread).alias("KC_Lower")]


# --- volume ----------------------------------------------------------------


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def signed_volume() -> Column:
    """Volume with the sign of the price change; zero on the first row."""
    change = F.col("close") - previous("close")
    return F.when(change > 0, F.col("volume")).when(change < 0, -F.col("volume")).otherwise(0.0)


def obv(bars: DataFrame, block_rows: int | None = None) -> DataFrame:
    base = with_rows(bars, [{"_signed": signed_volume()}], back=1, block_rows=block_rows)
    return plain(running(base, {"OBV": ("sum", F.col("_signed"))})).drop("_signed")


def mfi_stages(n: int = 14) -> list[dict[str, Column]]:
    _positive(n)
    flow = F.col("_tp") * F.col("volume")
    up = F.when(F.col("_tp") > previous("_tp"), flow).otherwise(0.0)
    down = F.when(F.col("_tp") < previous("_tp"), flow).otherwise(0.0)
    pos, neg = F.col("_pos_sum"), F.col("_neg_sum")
    value = F.when(neg != 0, 100 - 100 / (1 + F.try_divide(pos, neg))).when(pos > 0, 100.0)
    return [
        {"_tp": typical_price()},
        {"_up": up, "_down": down},
        {"_pos_sum": full("sum", "_up", n), "_neg_sum": full("sum", "_down", n)},
        {f"MFI_{n}": value},
    ]


MFI_SCRATCH = ["_tp", "_up", "_down", "_pos_sum", "_neg_sum"]


def cmf_stages(n: int = 20) -> list[dict[str, Column]]:
    _positive(n)
    spread = F.col("high") - F.col("low")
    weight = F.try_divide((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), spread)
    return [
        {"_mfv": weight * F.col("volume")},
        {f"CMF_{n}": F.try_divide(full("sum", "_mfv", n), full("sum", "volume", n))},
    ]


def vwap(bars: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Volume-weighted price from the start of the series."""
    base = with_rows(bars, [], block_rows=block_rows)
    totals = {"_pv": ("sum", typical_price() * F.col("volume")), "_v": ("sum", F.col("volume"))}
    return plain(running(base, totals).withColumn("VWAP", F.try_divide("_pv", "_v"))).drop("_pv", "_v")


# --- everything ------------------------------------------------------------


def merge_stages(*chains: Sequence[dict[str, Column]]) -> list[dict[str, Column]]:
    """Run several chains side by side: stage i of the result is stage i of all."""
    depth = max(len(c) for c in chains)
    return [{k: v for c in chains if i < len(c) for k, v in c[i].items()} for i in range(depth)]


def window_indicators() -> tuple[list[dict[str, Column]], int]:
    """Stages of every indicator that needs no running state, and their context.

    The Keltner lines read ``EMA_20``, which :func:`state_columns` provides.
    """
    chains = [
        [{f"SMA_{n}": sma("close", n) for n in SMA_PERIODS}],
        [{"Williams_R_14": williams_r(14), "ROC_10": roc("close", 10), "Momentum_10": momentum("close", 10)}],
        adx_stages(14), stochastic_stages(14, 3), bollinger_stages("close", 20, 2), atr_stages(14),
        [{}, {"_atr20": sma("_tr", 20)},
         {"KC_Upper": F.expr("EMA_20 + 2 * _atr20"), "KC_Lower": F.expr("EMA_20 - 2 * _atr20"), "KC_Middle": F.expr("EMA_20")}],
        mfi_stages(14), cmf_stages(20),
    ]
    return merge_stages(*chains), max(SMA_PERIODS)


# Columns beyond the 34 that a table with ``reference_columns`` has.
MULTI_OUTPUT = [
    "MACD", "MACD_Signal", "MACD_Histogram", "ADX", "DI_Plus", "DI_Minus", "Stoch_K", "Stoch_D",
    "BB_Upper", "BB_Middle", "BB_Lower", "BB_Width", "BB_Position", "KC_Upper", "KC_Middle", "KC_Lower",
]
SINGLE_OUTPUT = [
    *[f"SMA_{n}" for n in SMA_PERIODS], *[f"EMA_{n}" for n in EMA_PERIODS], "Parabolic_SAR", "RSI_14",
    "Williams_R_14", "ROC_10", "ATR_14", "OBV", "MFI_14", "CMF_20", "VWAP",
]


def state_columns(bars: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Indicators that carry a state from row to row, on a narrow frame that keeps ``_rn``.

    Several branches read the numbered bars, so bars that are not numbered yet
    are numbered once and written to the shared checkpoint folder.
    """
    bars = bars if "_rn" in bars.columns else cut_lineage(number_rows(bars))
    numbered = sar_on_blocks(bars, block_rows=block_rows).drop("_blk")
    stages = merge_stages(rsi_stages("close", 14), [{"_signed": signed_volume(), "_flow": typical_price() * F.col("volume")}])
    base = with_rows(numbered, stages, back=15, block_rows=block_rows)
    specs = {f"EMA_{n}": ema_spec("close", n) for n in EMA_PERIODS}
    specs |= {"_ema_slow": ema_spec("close", 26), "_ema_signal": ema_spec("close", 9), **rsi_specs(14)}
    out = recurrences(base, specs, block_rows=block_rows)
    out = running(out, {"OBV": ("sum", F.col("_signed")), "_pv": ("sum", F.col("_flow")), "_v": ("sum", F.col("volume"))})
    out = out.withColumn("_ema_fast", F.col("EMA_12"))
    return out.select(
        *numbered.columns, *[f"EMA_{n}" for n in EMA_PERIODS], "OBV", F.try_divide("_pv", "_v").alias("VWAP"),
        rsi_value(14).alias("RSI_14"), *macd_columns(12, 26, 9),
    ).withColumn("MACD_Histogram", F.col("MACD") - F.col("MACD_Signal"))


def all_indicators(bars: DataFrame, reference_columns: bool = False, block_rows: int | None = None) -> DataFrame:
    """Every indicator with its default periods.

    ``reference_columns`` leaves out the 16 columns of the multi-output
    indicators, which gives the narrower customary layout.
    """
    stages, back = window_indicators()
    out = with_rows(state_columns(bars, block_rows), stages, back=back, block_rows=block_rows)
    names = SINGLE_OUTPUT if reference_columns else [*SINGLE_OUTPUT, "Momentum_10", *MULTI_OUTPUT]
    return out.select(*bars.columns, *names)
