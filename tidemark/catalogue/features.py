"""Queries for feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.common import (
    BARS, KEY_SQL, NUMBERED, full_sql, hourly_bars, over, result, result_sql, rounded,
)
from tidemark.catalogue.indicators import RSI_SQL, SQL as INDICATOR_SQL, joined_sql
from tidemark.operators import features as X
from tidemark.operators import indicators as I
from tidemark.schemas import BAR_VALUES

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


S = 'OVER (PARTITION BY symbol ORDER BY "timestamp")'


def quoted(c: str) -> str:
    return f'"{c}"'


def sql_lag(c, k):
    return f'lag("{c}", {k}) {S}'


@query(result_sql(NUMBERED, {f"{c}_lag_{k}": sql_lag(c, k) for c in BAR_VALUES for k in X.LAGS}))
def lag_features(spark, d):
    out = X.lag_features(hourly_bars(spark, d), [*BAR_VALUES, "no_such_column"])
    return result(out, list(X.lag_columns(BAR_VALUES)))


@query(result_sql(NUMBERED, {f"{c}_diff_{k}": f'"{c}" - {sql_lag(c, k)}' for c in ["close", "volume"] for k in (1, 2, 5)}))
def diff_features(spark, d):
    return result(X.diff_features(hourly_bars(spark, d), ["close", "volume"]), list(X.diff_columns(["close", "volume"])))


def rolling_sql(c, n, s):
    flat = f'min("{c}") {over(n)} = max("{c}") {over(n)}'
    if s == "skew":
        value = f'CASE WHEN {flat} THEN 0 ELSE skewness("{c}") {over(n)} END'
    elif s == "kurt":
        value = f'CASE WHEN {flat} THEN -3 ELSE kurtosis("{c}") {over(n)} END'
    else:
        agg = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}[s]
        value = f'{agg}("{c}") {over(n)}'
    return f'CASE WHEN count("{c}") {over(n)} = {n} THEN {value} END'


ROLL = ["close", "volume"]


@query(result_sql(NUMBERED, {f"{c}_rolling_{n}_{s}": rolling_sql(c, n, s) for c in ROLL for n in X.WINDOWS for s in X.ROLLING_STATS}, 5))
def rolling_statistics(spark, d):
    return result(X.rolling_features(hourly_bars(spark, d), ROLL), list(X.rolling_columns(ROLL)), 5)


@query(result_sql(NUMBERED, {f"{c}_expanding_{s}": f'{a}("{c}") {over()}' for c in ["close", "volume"]
                             for s, a in [("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")]}))
def expanding_features(spark, d):
    names = [f"{c}_expanding_{s}" for c in ["close", "volume"] for s in X.EXPANDING_STATS]
    return result(X.expanding_features(hourly_bars(spark, d), ["close", "volume"]), names)


@query(result_sql(NUMBERED, {f"{a}_div_{b}": f'"{a}" / nullif("{b}", 0)' for a in ["high", "close"] for b in ["low", "open", "close"] if a != b}))
def ratio_features(spark, d):
    out = X.ratio_features(hourly_bars(spark, d), ["high", "close"], ["low", "open", "close"])
    return result(out, list(X.ratio_columns(["high", "close"], ["low", "open", "close"])))


@query(result_sql(NUMBERED, {f"volume_mult_{b}": f'volume * "{b}"' for b in ["close", "high", "low"]}))
def product_features(spark, d):
    pairs = [("volume", b) for b in ["close", "high", "low"]]
    return result(X.product_features(hourly_bars(spark, d), pairs), list(X.product_columns(pairs)))


@query(result_sql(NUMBERED, {f"{c}_pow_{k}": f'pow("{c}", {k})' for c in ["close", "volume"] for k in (2, 3)}, 4))
def power_features(spark, d):
    return result(X.power_features(hourly_bars(spark, d), ["close", "volume"]), list(X.power_columns(["close", "volume"])), 4)


VOL = NUMBERED + f""", v1 AS (SELECT *, "close" / nullif(pc, 0) - 1 AS ret FROM b),
  v2 AS (SELECT *, {full_sql("stddev_samp", "ret", 20)} AS vol FROM v1),
  v3 AS (SELECT *, list(vol) {over(40)} AS recent, count(vol) {over(40)} AS n_recent FROM v2),
  lim AS (SELECT symbol, quantile_cont(vol, 0.7) AS lim FROM v2 GROUP BY symbol)"""


@query(f"""WITH {VOL} SELECT {KEY_SQL}, CASE WHEN vol > lim THEN 1 ELSE 0 END::INTEGER AS volatility_regime,
  round(CASE WHEN n_recent = 40 THEN (len(list_filter(recent, lambda x: x < vol)) + (len(list_filter(recent, lambda x: x = vol)) + 1) / 2.0) / 40 END + 1e-9, 6)
  AS volatility_percentile FROM v3 JOIN lim USING (symbol)""")
def volatility_regime(spark, d):
    out = X.volatility_regime(hourly_bars(spark, d))
    return out.select("symbol", "interval", "timestamp", "volatility_regime",
                      F.round(F.col("volatility_percentile") + 1e-9, 6).alias("volatility_percentile"))


EXPANDING = f"""WITH {VOL}, v4 AS (SELECT *, quantile_cont(vol, 0.7) {over()} AS past FROM v3)
  SELECT {KEY_SQL}, CASE WHEN vol > past THEN 1 ELSE 0 END::INTEGER AS volatility_regime,
  round(CASE WHEN n_recent = 40 THEN (len(list_filter(recent, lambda x: x < vol)) + (len(list_filter(recent, lambda x: x = vol)) + 1) / 2.0) / 40 END + 1e-9, 6)
  AS volatility_percentile FROM v4"""


@query(EXPANDING)
def volatility_regime_expanding(spark, d):
    out = X.volatility_regime(hourly_bars(spark, d), threshold="expanding")
    return out.select("symbol", "interval", "timestamp", "volatility_regime",
                      F.round(F.col("volatility_percentile") + 1e-9, 6).alias("volatility_percentile"))


@query(f"""WITH {NUMBERED}, t AS (SELECT *, {full_sql("avg", quoted("close"), 10)} AS s, {full_sql("avg", quoted("close"), 50)} AS l FROM b)
  SELECT {KEY_SQL}, CASE WHEN s > l THEN 1 WHEN s < l THEN -1 ELSE 0 END::INTEGER AS trend_regime,
  round(abs(s - l) / nullif(l, 0) + 1e-9, 6) AS trend_strength FROM t""")
def trend_regime(spark, d):
    out = X.trend_regime(hourly_bars(spark, d))
    return out.select("symbol", "interval", "timestamp", "trend_regime",
                      F.round(F.col("trend_strength") + 1e-9, 6).alias("trend_strength"))


TS = '"timestamp"'
CAL = {
    "hour": f"hour({TS})", "day_of_week": f"isodow({TS}) - 1", "day_of_month": f"day({TS})", "week_of_year": f"week({TS})",
    "month": f"month({TS})", "quarter": f"quarter({TS})", "year": f"year({TS})",
    "is_weekend": f"(isodow({TS}) >= 6)", "is_month_start": f"(day({TS}) <= 3)", "is_month_end": f"(day({TS}) >= 28)",
    "is_quarter_start": f"(month({TS}) IN (1, 4, 7, 10))",
}
CYC = {f"{n}_{f}": f"round({f}(2 * pi() * ({CAL[n]}) / {size}) + 1e-9, 6)"
       for n, size in [("hour", 24), ("day_of_week", 7), ("month", 12)] for f in ("sin", "cos")}


@query(f"WITH {BARS} SELECT {KEY_SQL}, " + ", ".join([f"({e})::BIGINT AS {n}" for n, e in CAL.items()] + [f"{e} AS {n}" for n, e in CYC.items()]) + " FROM bars")
def calendar_features(spark, d):
    out = X.time_features(hourly_bars(spark, d))
    return out.select("symbol", "interval", "timestamp", *CAL, *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in CYC])


def target_sql(h):
    nxt = f'lead("close", {h}) {S} / nullif("close", 0) - 1'
    w = f'OVER (PARTITION BY symbol ORDER BY "timestamp" ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)'
    return [
        f"round({nxt} + 1e-9, 6) AS target_return_{h}",
        f"coalesce({nxt} > 0, false)::INTEGER AS target_direction_{h}",
        f"round(CASE WHEN count(ret) {w} = {h} THEN stddev_samp(ret) {w} END + 1e-9, 6) AS target_volatility_{h}",
    ]


@query(f"""WITH {NUMBERED}, v1 AS (SELECT *, "close" / nullif(pc, 0) - 1 AS ret FROM b) SELECT {KEY_SQL}, """
       + ", ".join(x for h in X.HORIZONS for x in target_sql(h)) + " FROM v1")
def targets(spark, d):
    out = X.targets(hourly_bars(spark, d))
    r = lambda c: F.round(F.col(c) + 1e-9, 6).alias(c)
    return out.select("symbol", "interval", "timestamp", *[
        r(c) if "direction" not in c else F.col(c) for c in X.target_stages()[1]])


SCALED = ["open", "close", "volume", "ROC_10", "Momentum_10"]
SCALE_SQL = NUMBERED + f""", f AS (SELECT *, ("close" - {sql_lag("close", 10)}) / nullif({sql_lag("close", 10)}, 0) * 100 AS "ROC_10",
  "close" - {sql_lag("close", 10)} AS "Momentum_10", count(*) OVER (PARTITION BY symbol) AS n FROM b),
  w AS (SELECT * FROM f WHERE rn <= floor(0.8 * n) AND "ROC_10" IS NOT NULL AND "Momentum_10" IS NOT NULL)"""
CENTRE = {"robust": "quantile_cont({c}, 0.5)", "standard": "avg({c})", "minmax": "min({c})"}
WIDTH = {"robust": "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)", "standard": "stddev_pop({c})", "minmax": "max({c}) - min({c})"}


def scale_sql(kind):
    fits = ", ".join(f'{CENTRE[kind].format(c=quoted(c))} AS "m_{c}", {WIDTH[kind].format(c=quoted(c))} AS "w_{c}"' for c in SCALED)
    cols = ", ".join(f'round((coalesce("{c}", 0) - "m_{c}") / CASE WHEN "w_{c}" = 0 THEN 1 ELSE "w_{c}" END + 1e-9, 6) AS "{c}"' for c in SCALED)
    return f"WITH {SCALE_SQL}, p AS (SELECT {fits} FROM w) SELECT {KEY_SQL}, {cols} FROM f, p"


def _scaled(spark, d, kind):
    from tidemark.operators.models import chronological_split
    from tidemark.plans.blocks import with_rows

    df = with_rows(hourly_bars(spark, d), [{"ROC_10": I.roc(), "Momentum_10": I.momentum()}], back=10)
    split = chronological_split(df)
    fitted = X.fit_scaling(split.where("is_train"), SCALED, kind)
    return result(X.apply_scaling(split, SCALED, fitted), SCALED)


@query(scale_sql("robust"))
def scale_robust(spark, d):
    return _scaled(spark, d, "robust")


@query(scale_sql("standard"))
def scale_standard(spark, d):
    return _scaled(spark, d, "standard")


@query(scale_sql("minmax"))
def scale_minmax(spark, d):
    return _scaled(spark, d, "minmax")


@query(f"""WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY event_type ORDER BY user_id * 10000000 + event_id) AS prev FROM events)
  SELECT event_type AS symbol, 'tick' AS "interval", count(*) AS n_rows, count(*) FILTER (ts < prev) AS n_out_of_order
  FROM e GROUP BY event_type""")
def timestamps_out_of_order(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(
        F.col("event_type").alias("symbol"), F.lit("tick").alias("interval"), F.col("ts").alias("timestamp"),
        (F.col("user_id") * 10000000 + F.col("event_id")).alias("ingest"))
    return X.out_of_order(e, "ingest", F.floor(F.col("ingest") / 10000000))


AVERAGES = [f"SMA_{n}" for n in I.SMA_PERIODS[:10]]
ROLLING_ALL = {f"{c}_rolling_{n}_{s}": rolling_sql(c, n, s) for c in BAR_VALUES for n in X.WINDOWS for s in X.ROLLING_STATS}
INTERACTIONS = {
    **{f"{a}_div_{b}": f'"{a}" / nullif("{b}", 0)' for a in ["high", "close"] for b in ["low", "open"]},
    **{f"volume_mult_{b}": f'volume * "{b}"' for b in ["close", "high", "low"]},
}
TABLE_SQL = joined_sql([
    f"WITH {BARS} SELECT * FROM bars", INDICATOR_SQL["all_indicators"], SQL["lag_features"],
    f"SELECT {KEY_SQL}, " + ", ".join(f'lag("{c}", {k}) {S} AS "{c}_lag_{k}"' for c in AVERAGES for k in X.LAGS) + f" FROM ({INDICATOR_SQL['sma']})",
    result_sql(NUMBERED, ROLLING_ALL, 5), result_sql(NUMBERED, INTERACTIONS),
    result_sql(NUMBERED, {"close_pow_2": 'pow("close", 2)'}, 4),
    f"SELECT {KEY_SQL}, round(pow(v, 2) + 1e-5, 2) AS \"RSI_14_pow_2\" FROM ({RSI_SQL})",
    SQL["volatility_regime"], SQL["trend_regime"], SQL["calendar_features"], SQL["targets"],
])


@query(TABLE_SQL)
def feature_table(spark, d):
    out = X.engineer_features(hourly_bars(spark, d))
    digits = {"OBV": 4, "VWAP": 4, "close_pow_2": 4, "RSI_14_pow_2": 2, **dict.fromkeys(ROLLING_ALL, 5)}
    whole = {"symbol", "interval", "timestamp", *BAR_VALUES, *CAL, "volatility_regime", "trend_regime", *[f"target_direction_{h}" for h in X.HORIZONS]}
    return out.select(*[F.col(c) if c in whole else rounded([c], digits.get(c, 6))[0] for c in out.columns])
