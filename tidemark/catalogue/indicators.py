"""Queries for trend, momentum, volatility and volume indicators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.catalogue.common import (
    KEY_SQL, NUMBERED, ema_sql, full_sql, hourly_bars, over, result, result_sql, rounded,
)
from tidemark.operators import indicators as I
from tidemark.plans.blocks import number_rows, with_rows
from tidemark.session import checkpoint_root
from tidemark.streaming import indicators as S

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


# --- SQL pieces --------------------------------------------------------------

TR = "greatest(high - low, abs(high - pc), abs(low - pc))"
UP, DOWN = "(high - ph)", "(pl - low)"
ADX1 = NUMBERED + f""", a1 AS (SELECT *, {TR} AS tr,
  CASE WHEN {UP} > {DOWN} THEN greatest({UP}, 0) ELSE 0 END::DOUBLE AS dmp,
  CASE WHEN {DOWN} > {UP} THEN greatest({DOWN}, 0) ELSE 0 END::DOUBLE AS dmm FROM b)"""
ADX = ADX1 + f""", a2 AS (SELECT *, 100 * {full_sql("avg", "dmp", 14)} / nullif({full_sql("avg", "tr", 14)}, 0) AS dip,
  100 * {full_sql("avg", "dmm", 14)} / nullif({full_sql("avg", "tr", 14)}, 0) AS dim FROM a1),
  a3 AS (SELECT *, 100 * abs(dip - dim) / nullif(dip + dim, 0) AS dx FROM a2)"""
RSI = NUMBERED + """, g AS (SELECT *, list(greatest("close" - pc, 0)) OVER s AS gains,
  list(greatest(pc - "close", 0)) OVER s AS losses FROM b
  WINDOW s AS (PARTITION BY symbol ORDER BY "timestamp")),
  sm AS (SELECT *, CASE WHEN rn > 14 THEN list_reduce(gains[16:], lambda p, x: p * 13.0::DOUBLE / 14 + x / 14, list_avg(gains[2:15])) END AS ag,
  CASE WHEN rn > 14 THEN list_reduce(losses[16:], lambda p, x: p * 13.0::DOUBLE / 14 + x / 14, list_avg(losses[2:15])) END AS al FROM g)"""
STOCH = NUMBERED + f""", s1 AS (SELECT *, 100 * ("close" - {full_sql("min", "low", 14)}) /
  nullif({full_sql("max", "high", 14)} - {full_sql("min", "low", 14)}, 0) AS k FROM b)"""
BB = NUMBERED + f""", b1 AS (SELECT *, {full_sql("avg", '"close"', 20)} AS mid, 2 * {full_sql("stddev_samp", '"close"', 20)} AS dev FROM b),
  b2 AS (SELECT *, (mid + dev) - (mid - dev) AS width FROM b1)"""
ATR1 = NUMBERED + f", a1 AS (SELECT *, {TR} AS tr FROM b)"
MFI = NUMBERED + f""", m1 AS (SELECT *, lag(tp) OVER (PARTITION BY symbol ORDER BY "timestamp") AS ptp FROM b),
  m2 AS (SELECT *, CASE WHEN tp > ptp THEN tp * volume ELSE 0 END AS up, CASE WHEN tp < ptp THEN tp * volume ELSE 0 END AS dn FROM m1),
  m3 AS (SELECT *, {full_sql("sum", "up", 14)} AS p, {full_sql("sum", "dn", 14)} AS n FROM m2)"""
CMF = NUMBERED + """, c1 AS (SELECT *, (("close" - low) - (high - "close")) / nullif(high - low, 0) * volume AS mfv FROM b)"""


@query(result_sql(NUMBERED, {f"SMA_{n}": full_sql("avg", '"close"', n) for n in I.SMA_PERIODS}))
def sma(spark, d):
    out = with_rows(hourly_bars(spark, d), [{f"SMA_{n}": I.sma("close", n) for n in I.SMA_PERIODS}], back=200)
    return result(out, [f"SMA_{n}" for n in I.SMA_PERIODS])


BROKEN = NUMBERED + """, x AS (SELECT * REPLACE (CASE WHEN hour("timestamp") <> 3 OR rn <= 40 THEN "close" END AS "close") FROM b)"""
WHOLE = f"CASE WHEN count(*) FILTER (\"close\" IS NULL) {over()} = 0 THEN "


@query(result_sql(BROKEN, {f"EMA_{n}": f"{WHOLE}{ema_sql(chr(34) + 'close' + chr(34), n)} END" for n in I.EMA_PERIODS}, source="x"))
def ema_missing(spark, d):
    """After the first missing close the average stays missing."""
    bars = number_rows(hourly_bars(spark, d))
    bars = bars.withColumn("close", F.when((F.hour("timestamp") != 3) | (F.col("_rn") <= 40), F.col("close")))
    return result(I.ema(bars), [f"EMA_{n}" for n in I.EMA_PERIODS])


@query(result_sql(NUMBERED, {f"EMA_{n}": ema_sql('"close"', n) for n in I.EMA_PERIODS}))
def ema(spark, d):
    return result(I.ema(hourly_bars(spark, d)), [f"EMA_{n}" for n in I.EMA_PERIODS])


@query(f"""WITH {NUMBERED}, m AS (SELECT *, {ema_sql('"close"', 12)} - {ema_sql('"close"', 26)} AS macd FROM b),
  s AS (SELECT *, {ema_sql("macd", 9)} AS sig FROM m)
  SELECT {KEY_SQL}, round(macd + 1e-9, 6) AS "MACD", round(sig + 1e-9, 6) AS "MACD_Signal", round(macd - sig + 1e-9, 6) AS "MACD_Histogram" FROM s""")
def macd(spark, d):
    return result(I.macd(hourly_bars(spark, d)), ["MACD", "MACD_Signal", "MACD_Histogram"])


@query(f"""WITH {ADX} SELECT {KEY_SQL}, round(dip + 1e-9, 6) AS "DI_Plus", round(dim + 1e-9, 6) AS "DI_Minus",
  round({full_sql("avg", "dx", 14)} + 1e-9, 6) AS "ADX" FROM a3""")
def adx(spark, d):
    return result(I.adx(hourly_bars(spark, d)), ["DI_Plus", "DI_Minus", "ADX"])


@query(f"""WITH RECURSIVE {NUMBERED}, w AS (
  SELECT symbol, "interval", "timestamp", rn, low AS sar, 1 AS side, 0.02::DOUBLE AS af, high AS ep FROM b WHERE rn = 1
  UNION ALL
  SELECT n.symbol, n."interval", n."timestamp", n.rn,
    CASE WHEN n.flip THEN n.ep ELSE n.nsar END,
    CASE WHEN n.flip THEN -n.side ELSE n.side END,
    CASE WHEN n.flip THEN 0.02 WHEN n.side * (n.ahead - n.ep) > 0 THEN least(n.af + 0.02, 0.2) ELSE n.af END::DOUBLE,
    CASE WHEN n.flip THEN n.behind WHEN n.side * (n.ahead - n.ep) > 0 THEN n.ahead ELSE n.ep END
  FROM (SELECT b.symbol, b."interval", b."timestamp", b.rn, w.side, w.af, w.ep, w.sar + w.af * (w.ep - w.sar) AS nsar,
      CASE WHEN w.side = 1 THEN b.high ELSE b.low END AS ahead, CASE WHEN w.side = 1 THEN b.low ELSE b.high END AS behind,
      w.side * (CASE WHEN w.side = 1 THEN b.low ELSE b.high END - (w.sar + w.af * (w.ep - w.sar))) <= 0 AS flip
    FROM w JOIN b ON b.symbol = w.symbol AND b.rn = w.rn + 1) n)
  SELECT {KEY_SQL}, round(sar + 1e-9, 6) AS "Parabolic_SAR" FROM w""")
def parabolic_sar(spark, d):
    return result(I.parabolic_sar(hourly_bars(spark, d)), ["Parabolic_SAR"])


RSI_SQL = f"""WITH {RSI} SELECT {KEY_SQL}, CASE WHEN rn <= 14 THEN NULL WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END AS v FROM sm"""


@query(f"""WITH {RSI} SELECT {KEY_SQL}, round(CASE WHEN rn <= 14 THEN NULL WHEN al = 0 THEN 100
  ELSE 100 - 100 / (1 + ag / al) END + 1e-9, 6) AS "RSI_14" FROM sm""")
def rsi(spark, d):
    return result(I.rsi(hourly_bars(spark, d)), ["RSI_14"])


@query(f"""WITH {STOCH} SELECT {KEY_SQL}, round(k + 1e-9, 6) AS "Stoch_K", round({full_sql("avg", "k", 3)} + 1e-9, 6) AS "Stoch_D" FROM s1""")
def stochastic(spark, d):
    return result(with_rows(hourly_bars(spark, d), I.stochastic_stages(), back=16), ["Stoch_K", "Stoch_D"])


@query(result_sql(NUMBERED, {"Williams_R_14": f"""-100 * ({full_sql("max", "high", 14)} - "close") /
  nullif({full_sql("max", "high", 14)} - {full_sql("min", "low", 14)}, 0)"""}))
def williams_r(spark, d):
    return result(with_rows(hourly_bars(spark, d), [{"Williams_R_14": I.williams_r()}], back=13), ["Williams_R_14"])


LAG10 = 'lag("close", 10) OVER (PARTITION BY symbol ORDER BY "timestamp")'


@query(result_sql(NUMBERED, {"ROC_10": f'("close" - {LAG10}) / nullif({LAG10}, 0) * 100'}))
def rate_of_change(spark, d):
    return result(with_rows(hourly_bars(spark, d), [{"ROC_10": I.roc()}], back=10), ["ROC_10"])


@query(result_sql(NUMBERED, {"Momentum_10": f'"close" - {LAG10}'}))
def momentum(spark, d):
    return result(with_rows(hourly_bars(spark, d), [{"Momentum_10": I.momentum()}], back=10), ["Momentum_10"])


@query(f"""WITH {BB} SELECT {KEY_SQL}, round(mid + dev + 1e-9, 6) AS "BB_Upper", round(mid + 1e-9, 6) AS "BB_Middle",
  round(mid - dev + 1e-9, 6) AS "BB_Lower", round(width + 1e-9, 6) AS "BB_Width",
  round(("close" - (mid - dev)) / nullif(width, 0) + 1e-9, 6) AS "BB_Position" FROM b2""")
def bollinger_bands(spark, d):
    names = ["BB_Upper", "BB_Middle", "BB_Lower", "BB_Width", "BB_Position"]
    return result(with_rows(hourly_bars(spark, d), I.bollinger_stages(), back=19), names)


@query(result_sql(ATR1, {"ATR_14": full_sql("avg", "tr", 14)}, source="a1"))
def average_true_range(spark, d):
    return result(with_rows(hourly_bars(spark, d), I.atr_stages(), back=14), ["ATR_14"])


@query(result_sql(ATR1 + f""", k AS (SELECT *, {ema_sql('"close"', 20)} AS mid, {full_sql("avg", "tr", 20)} AS atr FROM a1)""",
                  {"KC_Upper": "mid + 2 * atr", "KC_Middle": "mid", "KC_Lower": "mid - 2 * atr"}, source="k"))
def keltner_channels(spark, d):
    return result(I.keltner(hourly_bars(spark, d)), ["KC_Upper", "KC_Middle", "KC_Lower"])


@query(result_sql(NUMBERED, {"OBV": f"""sum(CASE WHEN "close" > pc THEN volume WHEN "close" < pc THEN -volume ELSE 0 END) {over()}"""}, 4))
def on_balance_volume(spark, d):
    return result(I.obv(hourly_bars(spark, d)), ["OBV"], 4)


@query(result_sql(MFI, {"MFI_14": "CASE WHEN n <> 0 THEN 100 - 100 / (1 + p / n) WHEN p > 0 THEN 100 END"}, source="m3"))
def money_flow_index(spark, d):
    return result(with_rows(hourly_bars(spark, d), I.mfi_stages(), back=14), ["MFI_14"])


@query(result_sql(CMF, {"CMF_20": f"""{full_sql("sum", "mfv", 20)} / nullif({full_sql("sum", "volume", 20)}, 0)"""}, source="c1"))
def chaikin_money_flow(spark, d):
    return result(with_rows(hourly_bars(spark, d), I.cmf_stages(), back=19), ["CMF_20"])


@query(result_sql(NUMBERED, {"VWAP": f"sum(tp * volume) {over()} / nullif(sum(volume) {over()}, 0)"}, 4))
def volume_weighted_price(spark, d):
    return result(I.vwap(hourly_bars(spark, d)), ["VWAP"], 4)


PIECES = {
    "sma": 6, "ema": 6, "macd": 6, "adx": 6, "parabolic_sar": 6, "rsi": 6, "stochastic": 6, "williams_r": 6, "rate_of_change": 6,
    "momentum": 6, "bollinger_bands": 6, "average_true_range": 6, "keltner_channels": 6, "on_balance_volume": 4, "money_flow_index": 6,
    "chaikin_money_flow": 6, "volume_weighted_price": 4,
}


def joined_sql(pieces) -> str:
    """One wide query from the queries of single operators, joined on the bar keys."""
    first, *rest = pieces
    joins = " ".join(f'JOIN ({sql}) q{i} USING ({KEY_SQL})' for i, sql in enumerate(rest))
    return f"SELECT * FROM ({first}) p {joins}"


FOUR_DIGITS = ["OBV", "VWAP"]


@query(joined_sql([SQL[name] for name in PIECES]))
def all_indicators(spark, d):
    out = I.all_indicators(hourly_bars(spark, d))
    names = [*I.SINGLE_OUTPUT, "Momentum_10", *I.MULTI_OUTPUT]
    return out.select("symbol", "interval", "timestamp", *rounded([n for n in names if n not in FOUR_DIGITS]), *rounded(FOUR_DIGITS, 4))


STREAMED = result_sql(NUMBERED, {f"EMA_{n}": ema_sql('"close"', n) for n in (12, 26)})


@query(joined_sql([STREAMED, SQL["macd"], SQL["rsi"], SQL["parabolic_sar"]]))
def streaming_indicators(spark, d):
    """The bars as a stream in two spans of time, the second one from the state of the first."""
    folder = f"{checkpoint_root(spark)}/tidemark/stream-{uuid.uuid4().hex}"
    hourly_bars(spark, d).write.parquet(f"{folder}/bars")
    out = S.backfill(spark.read.parquet(f"{folder}/bars"), folder)
    return result(out, ["EMA_12", "EMA_26", "MACD", "MACD_Signal", "MACD_Histogram", "RSI_14", "Parabolic_SAR"])
