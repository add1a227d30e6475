"""Feature tables: lags, rolling statistics, interactions, regimes, calendar, targets, scaling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark.operators import indicators as I
from tidemark.operators.models import TRAIN_SHARE
from tidemark.plans.blocks import number_rows, over, plain, rows, running, with_rows
from tidemark.plans.quantiles import attach, exact_percentiles, percentile_columns
from tidemark.plans.ranks import prefix_ranks
from tidemark.schemas import BAR_VALUES, KEYS
from tidemark.session import cut_lineage

# Default settings of the feature table.
LAGS = [1, 2, 3, 5, 10]
WINDOWS = [5, 10, 20, 50]
HORIZONS = [1, 3, 5]
ROLLING_STATS = ["mean", "std", "min", "max", "skew", "kurt"]
EXPANDING_STATS = ["mean", "std", "min", "max"]
LOOK_AHEAD_NAMES = ["future_", "next_", "lead_", "forward_", "ahead_"]
NO_FEATURE_NAMES = ["target_", "timestamp", "symbol"]
NOT_SCALED_NAMES = ["target", "timestamp", "symbol", "interval", "regime"]


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


# --- column builders -----------------------------------------------------------


def lag_columns(columns: Sequence[str], lags: Sequence[int] = LAGS) -> dict[str, Column]:
    return {f"{c}_lag_{k}": I.previous(c, k) for c in columns for k in lags}


def diff_columns(columns: Sequence[str], periods: Sequence[int] = (1, 2, 5)) -> dict[str, Column]:
    return {f"{c}_diff_{k}": F.col(c) - I.previous(c, k) for c in columns for k in periods}


def rolling_columns(
    columns: Sequence[str], windows: Sequence[int] = WINDOWS, stats: Sequence[str] = ROLLING_STATS
) -> dict[str, Column]:
    """Rolling statistics; skew and kurtosis are corrected for bias."""

    plain_aggregates = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}

    def one(c: str, n: int, stat: str) -> Column:
        w = over(n - 1)
        flat = f"min({c}) {w} = max({c}) {w}"
        if stat == "skew":
            value = f"CASE WHEN {flat} THEN 0D ELSE skewness({c}) {w} * {math.sqrt(n * (n - 1)) / (n - 2)!r}D END"
        elif stat == "kurt":
            factor = (n - 1) / ((n - 2) * (n - 3))
            value = f"CASE WHEN {flat} THEN -3D ELSE ({n + 1} * kurtosis({c}) {w} + 6) * {factor!r}D END"
        else:
            value = f"{plain_aggregates[stat]}({c}) {w}"
        return F.expr(f"CASE WHEN count({c}) {w} = {n} THEN {value} END")

    return {f"{c}_rolling_{n}_{s}": one(c, n, s) for c in columns for n in windows for s in stats}


def ratio_columns(numerators: Sequence[str], denominators: Sequence[str]) -> dict[str, Column]:
    return {
        f"{a}_div_{b}": F.try_divide(F.col(a), F.col(b)) for a in numerators for b in denominators if a != b
    }


def product_columns(pairs: Sequence[tuple[str, str]]) -> dict[str, Column]:
    return {f"{a}_mult_{b}": F.col(a) * F.col(b) for a, b in pairs}


def power_columns(columns: Sequence[str], degrees: Sequence[int] = (2, 3)) -> dict[str, Column]:
    return {f"{c}_pow_{d}": F.pow(F.col(c), F.lit(d)) for c in columns for d in degrees}


def calendar_columns(ts: str = "timestamp") -> dict[str, Column]:
    day, month = F.weekday(ts), F.month(ts)
    turn = lambda f, x, n: f(x * (2 * math.pi) / n)
    whole = {
        "hour": F.hour(ts), "day_of_week": day, "day_of_month": F.dayofmonth(ts), "week_of_year": F.weekofyear(ts),
        "month": month, "quarter": F.quarter(ts), "year": F.year(ts),
    }
    flags = {
        "is_weekend": day >= 5, "is_month_start": F.dayofmonth(ts) <= 3, "is_month_end": F.dayofmonth(ts) >= 28,
        "is_quarter_start": month.isin(1, 4, 7, 10),
    }
    cycles = {
        f"{n}_{f.__name__}": turn(f, x, size)
        for n, x, size in [("hour", F.hour(ts), 24), ("day_of_week", day, 7), ("month", month, 12)]
        for f in (F.sin, F.cos)
    }
    return {**{k: v.cast("long") for k, v in whole.items()}, **cycles, **{k: v.cast("long") for k, v in flags.items()}}


def simple_return(c: str = "close", n: int = 1) -> Column:
    return F.try_divide(F.col(c), I.previous(c, n)) - 1


def target_stages(horizons: Sequence[int] = HORIZONS) -> list[dict[str, Column]]:
    """Forward return, direction and volatility; direction is 0 where the return is missing."""
    out: dict[str, Column] = {}
    for h in horizons:
        change = F.try_divide(I.following("close", h), F.col("close")) - 1
        ahead = rows(-1, h)
        out[f"target_return_{h}"] = change
        out[f"target_direction_{h}"] = F.coalesce(change > 0, F.lit(False)).cast("int")
        out[f"target_volatility_{h}"] = F.when(
            F.count("_ret").over(ahead) == h, F.stddev_samp("_ret").over(ahead)
        )
    return [{"_ret": simple_return()}, out]


def volatility_stages(c: str = "close", n: int = 20, limit: str = "_vol_limit") -> list[dict[str, Column]]:
    """Rolling volatility, its rank in the last 2n values, and the regime flag against ``limit``."""
    w = rows(2 * n - 1)
    values = F.collect_list("_vol").over(w)
    less = F.size(F.filter(values, lambda v: v < F.col("_vol")))
    equal = F.size(F.filter(values, lambda v: v == F.col("_vol")))
    rank = (less + (equal + 1) / 2) / (2 * n)
    return [
        {"_ret": simple_return(c)},
        {"_vol": I.full("stddev_samp", "_ret", n)},
        {
            "volatility_regime": F.coalesce(F.col("_vol") > F.col(limit), F.lit(False)).cast("int"),
            "volatility_percentile": F.when(F.count("_vol").over(w) == 2 * n, rank),
        },
    ]


def trend_stages(c: str = "close", short: int = 10, long: int = 50) -> list[dict[str, Column]]:
    a, b = F.col("_ma_short"), F.col("_ma_long")
    regime = F.when(a > b, 1).when(a < b, -1).otherwise(0)
    return [
        {"_ma_short": I.sma(c, short), "_ma_long": I.sma(c, long)},
        {"trend_regime": regime, "trend_strength": F.try_divide(F.abs(a - b), b)},
    ]


# --- operators -------------------------------------------------------------------


def lag_features(df: DataFrame, columns: Sequence[str], lags: Sequence[int] = LAGS, **kw) -> DataFrame:
    if max(lags) > 10:
        raise ValueError("lags above 10 rows are not supported")
    return plain(with_rows(df, [lag_columns(present(df, columns), lags)], back=max(lags), **kw))


def diff_features(df: DataFrame, columns: Sequence[str], periods: Sequence[int] = (1, 2, 5), **kw) -> DataFrame:
    return plain(with_rows(df, [diff_columns(present(df, columns), periods)], back=max(periods), **kw))


def rolling_features(
    df: DataFrame, columns: Sequence[str], windows: Sequence[int] = WINDOWS,
    stats: Sequence[str] = ROLLING_STATS, **kw,
) -> DataFrame:
    stage = rolling_columns(present(df, columns), windows, stats)
    return plain(with_rows(df, [stage], back=max(windows), **kw))


def expanding_features(
    df: DataFrame, columns: Sequence[str], stats: Sequence[str] = EXPANDING_STATS, block_rows: int | None = None
) -> DataFrame:
    """Statistics of all rows so far.

    The standard deviation uses sums of distances from the first value of the
    series, which keeps the difference of squares small.
    """
    columns = present(df, columns)
    numbered = number_rows(df)
    firsts = numbered.where("_rn = 1").select(*KEYS, *[F.col(c).alias(f"_f_{c}") for c in columns])
    base = with_rows(numbered.join(firsts, KEYS), [], block_rows=block_rows)
    totals: dict[str, tuple[str, Column]] = {}
    for c in columns:
        gap = F.col(c) - F.col(f"_f_{c}")
        totals |= {
            f"_n_{c}": ("sum", F.col(c).isNotNull().cast("long")),
            f"_s_{c}": ("sum", gap), f"_q_{c}": ("sum", gap * gap),
            f"_lo_{c}": ("min", F.col(c)), f"_hi_{c}": ("max", F.col(c)),
        }
    out = running(base, totals)
    added = []
    for c in columns:
        n, s, sq = F.col(f"_n_{c}"), F.col(f"_s_{c}"), F.col(f"_q_{c}")
        spread = F.greatest(sq - F.try_divide(s * s, n), F.lit(0.0))
        value = {
            "mean": F.col(f"_f_{c}") + F.try_divide(s, n),
            "std": F.when(n > 1, F.sqrt(F.try_divide(spread, n - 1))),
            "min": F.col(f"_lo_{c}"), "max": F.col(f"_hi_{c}"),
        }
        added += [value[x].alias(f"{c}_expanding_{x}") for x in stats]
    return out.select(*df.columns, *added)


def ratio_features(df: DataFrame, numerators: Sequence[str], denominators: Sequence[str]) -> DataFrame:
    return df.withColumns(ratio_columns(present(df, numerators), present(df, denominators)))


def product_features(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.withColumns(product_columns([p for p in pairs if set(p) <= set(df.columns)]))


def power_features(df: DataFrame, columns: Sequence[str], degrees: Sequence[int] = (2, 3)) -> DataFrame:
    return df.withColumns(power_columns(present(df, columns), degrees))


def time_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumns(calendar_columns(ts))


def volatility_limit(df: DataFrame, c: str = "close", n: int = 20, percentile: float = 70,
                     block_rows: int | None = None) -> DataFrame:
    """Percentile of the rolling volatility of each whole series, as ``_vol_limit``."""
    narrow = df.select(*KEYS, "timestamp", c, *present(df, ["_rn"]))
    vol = with_rows(narrow, volatility_stages(c, n, c)[:2], back=n + 1, block_rows=block_rows)
    p = percentile / 100
    # The percentile reads its input three times; one stored column is cheaper than three window passes.
    long = exact_percentiles(cut_lineage(vol.select(*KEYS, "_vol")), ["_vol"], [p], KEYS)
    return percentile_columns(long, KEYS, {("_vol", p): "_vol_limit"})


def with_limit(df: DataFrame, limits: DataFrame) -> DataFrame:
    """Each row with the ``_vol_limit`` of its series."""
    return attach(df, limits, KEYS, "_limits", "left").select("*", F.col("_limits._vol_limit")).drop("_limits")


def volatility_regime(df: DataFrame, c: str = "close", n: int = 20, percentile: float = 70,
                      threshold: str = "series", block_rows: int | None = None) -> DataFrame:
    """Add ``volatility_regime`` and ``volatility_percentile``.

    ``threshold="series"`` compares with the percentile of the whole series,
    which looks ahead. ``threshold="expanding"`` compares with the percentile of all values up to
    the row's own, ``threshold="recent"`` flags a rank above the percentile
    among the last 2n values; both use the past only. A missing volatility counts as low.
    """
    stages = volatility_stages(c, n)
    if threshold not in ("series", "expanding", "recent"):
        raise ValueError(f"unknown threshold {threshold!r}")
    if threshold == "expanding":
        base = cut_lineage(with_rows(df.withColumn("_vol_limit", F.lit(None).cast("double")), stages, back=3 * n + 1,
                                     block_rows=block_rows))
        ranks = prefix_ranks(base, KEYS, "_rn", "_vol")
        # A value exceeds the interpolated percentile of m values that include it
        # if more than (m - 1) * p of them are smaller; the percentile itself need not be known. In hundredths, as p is seldom exact.
        high = F.coalesce(F.col("_less") * 100 > (F.col("_seen") - 1) * percentile, F.lit(False)).cast("int")
        out = base.join(ranks, [*KEYS, "_rn"], "left").withColumn("volatility_regime", high)
        return out.select(*[x for x in base.columns if x not in ("_rn", "_blk", "_ret", "_vol", "_vol_limit")])
    if threshold == "recent":
        base = with_rows(df.withColumn("_vol_limit", F.lit(None).cast("double")), stages, back=3 * n + 1,
                         block_rows=block_rows)
        late = F.coalesce(F.col("volatility_percentile") > percentile / 100, F.lit(False)).cast("int")
        out = base.withColumn("volatility_regime", late)
    else:
        limited = with_limit(df, volatility_limit(df, c, n, percentile, block_rows))
        out = with_rows(limited, stages, back=3 * n + 1, block_rows=block_rows)
    return plain(out).drop("_ret", "_vol", "_vol_limit")


def trend_regime(df: DataFrame, c: str = "close", short: int = 10, long: int = 50, **kw) -> DataFrame:
    return plain(with_rows(df, trend_stages(c, short, long), back=long, **kw)).drop("_ma_short", "_ma_long")


def targets(df: DataFrame, horizons: Sequence[int] = HORIZONS, **kw) -> DataFrame:
    out = with_rows(df, target_stages(horizons), back=1, ahead=max(horizons), **kw)
    return plain(out).drop("_ret")


# --- scaling ---------------------------------------------------------------------


def scalable(df: DataFrame) -> list[str]:
    return [
        f.name for f in df.schema
        if isinstance(f.dataType, NumericType) and not any(p in f.name for p in NOT_SCALED_NAMES)
    ]


def fit_scaling(df: DataFrame, columns: Sequence[str], kind: str = "robust") -> DataFrame:
    """One row of centre and scale per column, from rows without missing values."""
    whole = df.dropna(subset=list(columns))
    if kind == "standard":
        return whole.agg(
            *[F.avg(c).alias(f"centre_{c}") for c in columns], *[F.stddev_pop(c).alias(f"scale_{c}") for c in columns]
        )
    if kind == "minmax":
        return whole.agg(
            *[F.min(c).alias(f"centre_{c}") for c in columns],
            *[(F.max(c) - F.min(c)).alias(f"scale_{c}") for c in columns],
        )
    if kind != "robust":
        raise ValueError(f"unknown scaling {kind!r}")
    long = exact_percentiles(cut_lineage(whole.select(*columns)), columns, [0.25, 0.5, 0.75])
    labels = {(c, p): f"q{p}_{c}" for c in columns for p in (0.25, 0.5, 0.75)}
    wide = percentile_columns(long, [], labels)
    return wide.select(
        *[F.col(f"`q0.5_{c}`").alias(f"centre_{c}") for c in columns],
        *[(F.col(f"`q0.75_{c}`") - F.col(f"`q0.25_{c}`")).alias(f"scale_{c}") for c in columns],
    )


def apply_scaling(df: DataFrame, columns: Sequence[str], fitted: DataFrame) -> DataFrame:
    """Scale with fitted values; missing input counts as 0 and a zero scale as 1."""
    row = fitted.select(F.struct("*").alias("_fit")).scalar()
    framed = df.withColumn("_fit", row)
    fit = F.col("_fit")

    def scaled(c: str) -> Column:
        width = F.when(fit[f"scale_{c}"] == 0, 1.0).otherwise(fit[f"scale_{c}"])
        value = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - fit[f"centre_{c}"]) / width
        # Nothing to fit on: the column stays as it is.
        return F.when(fit[f"centre_{c}"].isNull(), F.col(c).cast("double")).otherwise(value)

    return framed.withColumns({c: scaled(c) for c in columns}).drop("_fit")


# --- the whole table --------------------------------------------------------------


def feature_names(df: DataFrame) -> list[str]:
    """Columns that are neither targets nor keys."""
    return [c for c in df.columns if not any(p in c for p in NO_FEATURE_NAMES) and c != "interval"]


def check_feature_names(df: DataFrame) -> None:
    """Raise for column names that announce a look ahead."""
    if "timestamp" not in df.columns:
        raise ValueError("column 'timestamp' not found")
    bad = [c for c in df.columns if any(p in c.lower() for p in LOOK_AHEAD_NAMES)]
    if bad:
        raise ValueError(f"columns that look ahead: {bad}")


def out_of_order(df: DataFrame, ingest: str, bucket: Column) -> DataFrame:
    """Per series: rows whose timestamp is before the one ingested just before."""
    base = with_rows(df, [{"_prev_ts": I.previous("timestamp")}], back=1, number={"order": [ingest], "bucket": bucket})
    return base.groupBy(*KEYS).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("timestamp") < F.col("_prev_ts")).alias("n_out_of_order")
    )


def engineer_features(
    bars: DataFrame,
    reference_columns: bool = False,
    threshold: str = "series",
    scaling: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """The full feature table: indicators, lags, rolling statistics, interactions,
    regimes, calendar and targets. All window columns share one exchange and one sort.
    """
    inputs = list(bars.columns)
    bars = bars if "_rn" in inputs else cut_lineage(number_rows(bars))
    narrow = I.state_columns(bars, block_rows)
    if threshold == "series":
        narrow = with_limit(narrow, volatility_limit(bars, block_rows=block_rows))
    else:
        narrow = narrow.withColumn("_vol_limit", F.lit(None).cast("double"))
    averages = [f"SMA_{n}" for n in I.SMA_PERIODS[:10]]
    window_stages, back = I.window_indicators()
    stages = I.merge_stages(
        window_stages,
        [lag_columns(BAR_VALUES) | rolling_columns(BAR_VALUES), lag_columns(averages)],
        volatility_stages(), trend_stages(), target_stages(),
    )
    out = with_rows(narrow, stages, back=back, ahead=max(HORIZONS), block_rows=block_rows)
    if threshold != "series":
        late = F.coalesce(F.col("volatility_percentile") > 0.7, F.lit(False)).cast("int")
        out = out.withColumn("volatility_regime", late)
    extra = {
        **ratio_columns(["high", "close"], ["low", "open"]),
        **product_columns([("volume", "close"), ("volume", "high"), ("volume", "low")]),
        **power_columns(["RSI_14", "close"], [2]),
        **calendar_columns(),
    }
    indicators = I.SINGLE_OUTPUT if reference_columns else [*I.SINGLE_OUTPUT, "Momentum_10", *I.MULTI_OUTPUT]
    built = [f"{c}_lag_{k}" for c in BAR_VALUES + averages for k in LAGS] + [
        f"{c}_rolling_{n}_{s}" for c in BAR_VALUES for n in WINDOWS for s in ROLLING_STATS
    ]
    regimes = ["volatility_regime", "volatility_percentile", "trend_regime", "trend_strength"]
    aims = [f"target_{kind}_{h}" for h in HORIZONS for kind in ("return", "direction", "volatility")]
    names = [*inputs, *indicators, *built, *extra, *regimes, *aims]
    table = out.withColumns(extra)
    if scaling:
        # Fitted on the training cut of each series only; the table is computed once.
        table = cut_lineage(table.select(*dict.fromkeys(["_rn", *names])))
        sizes = table.groupBy(*KEYS).agg(F.max("_rn").alias("_n"))
        train = table.join(sizes, KEYS).where(F.col("_rn") <= F.floor(F.col("_n") * TRAIN_SHARE))
        columns = scalable(table.select(*names))
        table = apply_scaling(table, columns, fit_scaling(train, columns, scaling))
    table = table.select(*names)
    check_feature_names(table)
    return table
