"""Queries for leakage, selection and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.common import NUMBERED, full_sql, hourly_bars, over, table
from tidemark.operators import drift as D
from tidemark.operators import indicators as I
from tidemark.operators import leakage as L
from tidemark.operators import selection as S
from tidemark.plans.blocks import plain, rows, with_rows
from tidemark.schemas import KEYS

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def r6(*columns):
    return [F.expr(f"round({c} + 1e-9D, 6) AS {c}") for c in columns]


def union(columns, line):
    return " UNION ALL ".join(line.replace("{c}", c) for c in columns)


# --- leakage ------------------------------------------------------------------------

COLUMNS = ["close", "volume", "SMA_5", "close_lag_2", "row_index", "rolling_mean_3"]
SCANNED = [*COLUMNS, "future_close"]


def suspect(spark, d):
    """Bars with clean and leaking columns."""
    stage = {
        "SMA_5": I.sma("close", 5), "close_lag_2": I.previous("close", 2), "row_index": F.col("_rn").cast("double") * 2,
        "rolling_mean_3": F.avg("close").over(rows(2)), "future_close": I.following("close", 1),
        "target_return_1": F.try_divide(I.following("close", 2), I.following("close", 1)) - 1,
    }
    return plain(with_rows(hourly_bars(spark, d), [stage], back=5, ahead=2))


W = 'OVER (PARTITION BY symbol ORDER BY "timestamp")'
SUSPECT = NUMBERED + f""", x AS (SELECT symbol, "interval", "timestamp", rn, "close", volume, {full_sql("avg", '"close"', 5)} AS "SMA_5",
  lag("close", 2) {W} AS close_lag_2, rn * 2.0::DOUBLE AS row_index, avg("close") {over(3)} AS rolling_mean_3,
  lead("close") {W} AS future_close, lead("close", 2) {W} / nullif(lead("close", 1) {W}, 0) - 1 AS target_return_1 FROM b)"""
K = 'symbol, "interval"'


@query(f"WITH {SUSPECT} SELECT {K}, feature, n_rows, round(step_std + 1e-9, 6) AS step_std, round(step_mean + 1e-9, 6) AS step_mean, "
       "round(autocorrelation + 1e-9, 6) AS autocorrelation, coalesce(n_rows >= 10 AND ((step_std = 0 AND step_mean <> 0) OR abs(autocorrelation) > 0.99), false) AS flagged FROM ("
       + union(SCANNED, f"""SELECT {K}, '{{c}}' AS feature, count(*) AS n_rows, stddev_samp(v - p) AS step_std, avg(v - p) AS step_mean, corr(v, p) AS autocorrelation
       FROM (SELECT {K}, "{{c}}" AS v, lag("{{c}}") {W} AS p FROM x) GROUP BY {K}""") + ")")
def leakage_forward_looking(spark, d):
    out = L.forward_looking(suspect(spark, d), SCANNED)
    return out.select(*KEYS, "feature", "n_rows", *r6("step_std", "step_mean", "autocorrelation"), "flagged")


ROLLED = ["SMA_5", "rolling_mean_3"]


@query(f"WITH {SUSPECT} " + union(ROLLED, f"""SELECT {K}, '{{c}}' AS feature, bool_or(rn = 1 AND "{{c}}" IS NOT NULL) AS first_filled, count("{{c}}") AS n_filled,
  (bool_or(rn = 1 AND "{{c}}" IS NOT NULL) OR count("{{c}}") = 0) AS flagged FROM x GROUP BY {K}"""))
def leakage_rolling_warm_up(spark, d):
    return L.rolling_without_warm_up(suspect(spark, d), COLUMNS).drop("n_rows")


@query(f"""WITH {SUSPECT}, y AS (SELECT *, "close" AS volume_lag_3 FROM x) """ + " UNION ALL ".join(
    f"""SELECT {K}, '{c}' AS feature, count(*) FILTER (rn <= {k} AND "{c}" IS NOT NULL) AS n_early, {k}::BIGINT AS lag,
    (count(*) > {k} AND count(*) FILTER (rn <= {k} AND "{c}" IS NOT NULL) > 0) AS flagged FROM y GROUP BY {K}"""
    for c, k in [("close_lag_2", 2), ("volume_lag_3", 3)]))
def leakage_unshifted_lags(spark, d):
    df = suspect(spark, d).withColumn("volume_lag_3", F.col("close"))
    return L.unshifted_lags(df, ["close", "close_lag_2", "volume_lag_3"]).drop("n_rows")


@query(f"WITH {SUSPECT}, y AS (SELECT *, lead(target_return_1) {W} AS nxt FROM x) SELECT {K}, feature, round(r + 1e-9, 6) AS correlation, coalesce(abs(r) > 0.8, false) AS flagged FROM ("
       + union([*COLUMNS, "future_close"], f"""SELECT {K}, '{{c}}' AS feature, corr("{{c}}", nxt) AS r FROM y GROUP BY {K}""") + ")")
def leakage_target_correlation(spark, d):
    out = L.target_correlation(suspect(spark, d), "target_return_1", [*COLUMNS, "future_close"])
    return out.select(*KEYS, "feature", *r6("correlation"), "flagged")


@query(f"WITH {SUSPECT} SELECT {K}, feature, n_filled, constant, round(trend + 1e-9, 6) AS trend, coalesce(constant OR (n_filled > 2 AND abs(trend) > 0.999), false) AND n_rows >= 10 AS flagged FROM ("
       + union(SCANNED, f"""SELECT {K}, '{{c}}' AS feature, count(*) AS n_rows, count(v) AS n_filled, min(v) = max(v) AS constant, corr(pos, v) AS trend
       FROM (SELECT {K}, "{{c}}" AS v, CASE WHEN "{{c}}" IS NOT NULL THEN count("{{c}}") {over()} END AS pos FROM x) GROUP BY {K}""") + ")")
def leakage_unrealistic(spark, d):
    out = L.unrealistic(suspect(spark, d), SCANNED)
    return out.select(*KEYS, "feature", "n_filled", "constant", *r6("trend"), "flagged")


def found_sql(name, kind, severity):
    """Findings of a check's own SQL."""
    return f"SELECT feature, '{kind}' AS violation_type, '{severity}' AS severity FROM ({SQL[name]}) WHERE flagged"


def named_sql(words, kind, severity):
    marks = " OR ".join(f"contains(lower(feature), '{w}')" for w in words)
    return f"SELECT feature, '{kind}', '{severity}' FROM (SELECT unnest({SCANNED}) AS feature) WHERE {marks}"


FOUND = " UNION ALL ".join([
    found_sql("leakage_forward_looking", "forward_looking_pattern", "warning"), found_sql("leakage_unrealistic", "unrealistic_predictive_power", "warning"),
    found_sql("leakage_rolling_warm_up", "suspicious_rolling_calculation", "warning"), found_sql("leakage_target_correlation", "high_future_correlation", "critical"),
    named_sql(L.SUSPICIOUS_WORDS, "suspicious_naming", "warning"), named_sql(L.TARGET_PREFIXES, "target_derived_feature", "critical"),
])


@query(f"""WITH f AS ({FOUND}) SELECT severity, violation_type, count(*) AS n_findings, count(DISTINCT feature) AS n_features FROM f
  GROUP BY GROUPING SETS ((severity, violation_type), (severity), ())""")
def leakage_report(spark, d):
    return L.report(L.scan(suspect(spark, d), "target_return_1", SCANNED))


@query(f"""WITH {SUSPECT}, f AS ({FOUND}), k AS (SELECT DISTINCT violation_type, severity FROM f), t AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in L.ADVICE.items())}) a(violation_type, text))
  SELECT (SELECT count(*) FROM x) AS n_rows, (SELECT min("timestamp") FROM x) AS first_timestamp, (SELECT max("timestamp") FROM x) AS last_timestamp, {len(SCANNED)}::BIGINT AS n_features,
  count(DISTINCT feature) AS n_affected, round(count(DISTINCT feature) / {len(SCANNED)} + 1e-9, 6) AS affected_share, count(*) AS n_findings, count(*) FILTER (severity = 'critical') AS n_critical,
  count(*) FILTER (severity = 'warning') AS n_warnings, count(*) FILTER (severity = 'critical') = 0 AS is_clean,
  (SELECT string_agg(text, ' ' ORDER BY severity <> 'critical', violation_type) FROM k JOIN t USING (violation_type)) AS advice FROM f""")
def leakage_summary(spark, d):
    df = suspect(spark, d)
    out = L.summary(df, L.scan(df, "target_return_1", SCANNED), SCANNED)
    return out.withColumns({"affected_share": F.expr("round(affected_share + 1e-9D, 6)"), "advice": F.array_join("advice", " ")})


@query(f"""WITH {NUMBERED} SELECT symbol, "interval", "timestamp", "close", round(lag("close", 2) {W} + 1e-9, 6) AS close_lag_2,
  round({full_sql("avg", '"close"', 5)} + 1e-9, 6) AS "SMA_5" FROM b""")
def leakage_repair(spark, d):
    bad = hourly_bars(spark, d).withColumns({"close_lag_2": F.col("close"), "SMA_5": F.col("close")})
    return L.repair(bad).select(*KEYS, "timestamp", "close", *r6("close_lag_2", "SMA_5"))


# --- selection ---------------------------------------------------------------------

ITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "twice_price", "noisy_price"]


def items(spark, d):
    """Line items with a doubled and a shifted copy of the price; the class is the return flag."""
    li = table(spark, d, "lineitem")
    return li.select("l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.col("l_linenumber").cast("double").alias("l_linenumber"),
                     (F.col("l_extendedprice") * 2).alias("twice_price"), (F.col("l_extendedprice") + F.col("l_quantity") * 100).alias("noisy_price"))


ITEMS = """i AS (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber::DOUBLE AS l_linenumber,
  l_extendedprice * 2 AS twice_price, l_extendedprice + l_quantity * 100 AS noisy_price FROM lineitem)"""


@query(f"WITH {ITEMS} SELECT feature, round(v + 1e-7, 4) AS variance, v > 0.01 AS selected FROM (" + union(ITEM, "SELECT '{c}' AS feature, var_samp({c}) AS v FROM i") + ")")
def variance_selection(spark, d):
    out = S.variances(items(spark, d), ITEM)
    return out.select("feature", F.round(F.col("variance") + 1e-7, 4).alias("variance"), "selected")


PAIRS = [(a, b) for i, a in enumerate(ITEM) for b in ITEM[i + 1:]]


@query(f"WITH {ITEMS} " + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}) + 1e-9, 6) AS correlation FROM i" for a, b in PAIRS))
def correlation_pairs(spark, d):
    out = S.correlations(items(spark, d), ITEM)
    return out.select("feature_a", "feature_b", *r6("correlation"))


@query(f"WITH {ITEMS}, v AS (" + union(ITEM, "SELECT '{c}' AS feature, var_samp({c}) AS v FROM i") + "), p AS ("
       + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM i" for a, b in PAIRS)
       + """), gone AS (SELECT DISTINCT CASE WHEN va.v < vb.v THEN a ELSE b END AS feature FROM p JOIN v va ON va.feature = a JOIN v vb ON vb.feature = b WHERE abs(r) > 0.95)
  SELECT feature, feature NOT IN (SELECT feature FROM gone) AS selected FROM v""")
def correlation_selection(spark, d):
    return S.correlation_selection(items(spark, d), ITEM).drop("variance")


@query(f"WITH {ITEMS}, c AS (" + union(ITEM, "SELECT '{c}' AS feature, l_returnflag AS y, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM i GROUP BY y")
       + """), t AS (SELECT feature, sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS gm, sum(n * v) AS w FROM c GROUP BY feature)
  SELECT feature, round((sum(c.n * (m - gm) * (m - gm)) / (any_value(k) - 1)) / (any_value(w) / (any_value(t.n) - any_value(k))) + 1e-7, 4) AS score
  FROM c JOIN t USING (feature) GROUP BY feature""")
def f_test_scores(spark, d):
    out = S.f_scores(items(spark, d), ITEM, "l_returnflag")
    return out.select("feature", F.round(F.col("score") + 1e-7, 4).alias("score"))


OTHERS = [c for c in ITEM if c not in ("l_extendedprice", "twice_price")]


@query(f"WITH {ITEMS} SELECT feature, round(ln(1 + r * r / (1 - r * r) * (n - 2)) + 1e-9, 6) AS log_score FROM ("
       + union(OTHERS, "SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS r, count(*) AS n FROM i") + ")")
def f_test_scores_regression(spark, d):
    out = S.f_scores_regression(items(spark, d), OTHERS, "l_extendedprice")
    # The logarithm: scores of nearly collinear columns have few certain digits after the point.
    return out.select("feature", F.round(F.ln(1 + F.col("score")) + 1e-9, 6).alias("log_score"))


@query(f"WITH {ITEMS}, c AS (" + union(ITEM, "SELECT '{c}' AS feature, l_returnflag AS y, count(*) AS n, sum({c} - (SELECT min({c}) FROM i) + 1e-6) AS o FROM i GROUP BY y")
       + """), t AS (SELECT feature, sum(o) AS t, sum(n) AS n FROM c GROUP BY feature)
  SELECT feature, round(sum((o - t * c.n / t.n) * (o - t * c.n / t.n) / (t * c.n / t.n)) + 1e-7, 4) AS score FROM c JOIN t USING (feature) GROUP BY feature""")
def chi2_scores(spark, d):
    out = S.chi2_scores(items(spark, d), ITEM, "l_returnflag")
    return out.select("feature", F.round(F.col("score") + 1e-7, 4).alias("score"))


@query(f"WITH {ITEMS}, c AS (" + union(ITEM, "SELECT '{c}' AS feature, quantile_cont({c}, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS cuts FROM i")
       + "), j AS (" + union(ITEM, "SELECT '{c}' AS feature, len(list_filter(cuts, lambda e: e < {c})) AS bin, l_returnflag AS y FROM i, c WHERE c.feature = '{c}'")
       + """), n AS (SELECT feature, bin, y, count(*) AS n FROM j GROUP BY ALL),
  p AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny FROM n)
  SELECT feature, round(sum(n::DOUBLE / t * ln(n::DOUBLE * t / (nb * ny))) + 1e-9, 6) AS score FROM p GROUP BY feature""")
def mutual_information(spark, d):
    out = S.mutual_information(items(spark, d), ITEM, "l_returnflag")
    return out.select("feature", *r6("score"))


@query()
def tree_importance(spark, d):
    df = items(spark, d).withColumn("is_r", (F.col("l_returnflag") == "R").cast("double"))
    return S.tree_importance(df, ITEM, "is_r")


@query()
def principal_components(spark, d):
    out, _ = S.reduce_dimensions(items(spark, d), ITEM)
    return out.select("l_quantity", "l_extendedprice", "components")


@query()
def feature_selection(spark, d):
    df = items(spark, d).withColumn("is_r", (F.col("l_returnflag") == "R").cast("double"))
    steps = S.select_features(df, ITEM, "is_r")
    return spark.createDataFrame([(k, v) for k, v in steps.items()], "step string, features array<string>")


SLICED = ["open", "high", "low", "close", "volume", "range", "SMA_5", "SMA_10", "momentum_10"]
SLICES = 4
SLICE_LIMITS = {"variance": 0.01, "correlation": 0.8, "k": 4}


def sliced(spark, d):
    """Bars with features, the direction of the last change, and the quarter of the time they lie in."""
    stage = {
        "range": F.col("high") - F.col("low"), "SMA_5": I.sma("close", 5), "SMA_10": I.sma("close", 10),
        "momentum_10": F.col("close") - I.previous("close", 10),
        "up": F.coalesce(F.col("close") > I.previous("close", 1), F.lit(False)).cast("double"),
    }
    return S.time_segments(plain(with_rows(hourly_bars(spark, d), [stage], back=10)), "timestamp", SLICES)


def slices_sql():
    """All steps on the rows of each slice."""
    values = union(SLICED, """SELECT slice, '{c}' AS f, up, "{c}"::DOUBLE AS x FROM w""")
    pairs = " UNION ALL ".join(
        f"""SELECT slice, '{a}' AS a, '{b}' AS b, corr("{a}", "{b}") AS r FROM w GROUP BY slice"""
        for i, a in enumerate(SLICED) for b in SLICED[i + 1:])
    return f"""{NUMBERED}, f AS (SELECT *, high - low AS "range", {full_sql("avg", '"close"', 5)} AS "SMA_5", {full_sql("avg", '"close"', 10)} AS "SMA_10",
    "close" - lag("close", 10) {W} AS momentum_10, CASE WHEN "close" > pc THEN 1 ELSE 0 END AS up FROM b),
  q AS (SELECT quantile_cont(epoch_us("timestamp")::DOUBLE, [0.25, 0.5, 0.75]) AS cuts FROM f),
  g AS (SELECT f.*, len(list_filter(cuts, lambda c: c < epoch_us("timestamp")::DOUBLE)) AS seg FROM f, q),
  w AS (SELECT s.slice, g.* FROM g JOIN (SELECT unnest(range({SLICES})) AS slice) s ON g.seg BETWEEN s.slice AND s.slice + 1),
  x AS ({values}), v AS (SELECT slice, f, var_samp(x) AS v FROM x GROUP BY ALL HAVING var_samp(x) > {SLICE_LIMITS["variance"]}),
  p AS ({pairs}), gone AS (SELECT DISTINCT p.slice, CASE WHEN va.v < vb.v THEN a ELSE b END AS f FROM p
    JOIN v va ON va.slice = p.slice AND va.f = a JOIN v vb ON vb.slice = p.slice AND vb.f = b WHERE abs(r) > {SLICE_LIMITS["correlation"]}),
  c AS (SELECT v.* FROM v ANTI JOIN gone USING (slice, f)),
  y AS (SELECT slice, f, up, count(*) AS n, avg(coalesce(x, 0)) AS m, var_pop(coalesce(x, 0)) AS vp FROM x GROUP BY ALL),
  z AS (SELECT y.*, sum(n * m) OVER k / sum(n) OVER k AS mean FROM y WINDOW k AS (PARTITION BY slice, f)),
  s AS (SELECT slice, f, (sum(n * (m - mean) * (m - mean)) / (count(*) - 1)) / (sum(n * vp) / (sum(n) - count(*))) AS score FROM z GROUP BY slice, f),
  u AS (SELECT slice, f FROM c JOIN s USING (slice, f) QUALIFY row_number() OVER (PARTITION BY slice ORDER BY score DESC NULLS LAST, f) <= {SLICE_LIMITS["k"]}),
  chosen AS (SELECT slice, 'variance' AS step, f FROM v UNION ALL SELECT slice, 'correlation', f FROM c UNION ALL SELECT slice, 'univariate', f FROM u)"""


@query(f"WITH {slices_sql()} SELECT slice, step, string_agg(f, ',' ORDER BY f) AS features FROM chosen GROUP BY slice, step")
def selection_slices(spark, d):
    out = S.slice_selections(sliced(spark, d), SLICED, "up", **SLICE_LIMITS)
    return out.select("slice", "step", F.array_join("features", ",").alias("features"))


@query(f"""WITH {slices_sql()}, l AS (SELECT slice, list(f) AS fs FROM u GROUP BY slice)
  SELECT round(avg(len(list_intersect(a.fs, b.fs)) / len(list_distinct(list_concat(a.fs, b.fs)))) + 1e-9, 6) AS mean_jaccard, count(*) AS n_pairs
  FROM l a JOIN l b ON b.slice > a.slice""")
def selection_stability(spark, d):
    chosen = S.slice_selections(sliced(spark, d), SLICED, "up", **SLICE_LIMITS).where("step = 'univariate'")
    out = S.stability(chosen.select("slice", "features"), neighbours=False)
    return out.select(*r6("mean_jaccard"), "n_pairs")


@query()
def selection_stability_trees(spark, d):
    """The whole chain with the forest of each slice."""
    chosen = S.slice_selections(sliced(spark, d), SLICED, "up", **SLICE_LIMITS, trees=50).where("step = 'tree'")
    return S.stability(chosen.select("slice", "features"), neighbours=False)


# --- drift -------------------------------------------------------------------------

HALF = "2024-01-16"


def halves(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", (F.col("event_id") % 2).alias("parity"))
    cut = F.lit(HALF).cast("timestamp")
    return e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut)


@query("""SELECT 'event_type' AS feature, 'categorical' AS feature_type FROM events UNION SELECT 'value', CASE WHEN count(DISTINCT value) < 10 THEN 'categorical' ELSE 'continuous' END FROM events
  UNION SELECT 'user_id', CASE WHEN count(DISTINCT user_id) < 10 THEN 'categorical' ELSE 'continuous' END FROM events
  UNION SELECT 'parity', CASE WHEN count(DISTINCT event_id % 2) < 10 THEN 'categorical' ELSE 'continuous' END FROM events""")
def feature_types(spark, d):
    e = table(spark, d, "events").withColumn("parity", F.col("event_id") % 2)
    return D.feature_types(e, ["event_type", "value", "user_id", "parity"])


@query(f"SELECT feature, n, " + ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in ["mean", "std", "min", "max", "q25", "q50", "q75"]) + " FROM (" + union(
    ["value", "user_id"], f"""SELECT '{{c}}' AS feature, count({{c}}) AS n, avg({{c}}) AS mean, stddev_samp({{c}}) AS std, min({{c}})::DOUBLE AS min, max({{c}})::DOUBLE AS max,
  quantile_cont({{c}}, 0.25) AS q25, quantile_cont({{c}}, 0.5) AS q50, quantile_cont({{c}}, 0.75) AS q75 FROM events WHERE ts < TIMESTAMP '{HALF}'""") + ")")
def reference_profile(spark, d):
    out = D.reference_profile(halves(spark, d)[0], ["value", "user_id"])
    return out.select("feature", "n", *r6("mean", "std", "min", "max", "q25", "q50", "q75"))


@query(f"""SELECT 'event_type' AS feature, event_type AS category, count(*) AS n, round(count(*) / sum(count(*)) OVER () + 1e-9, 6) AS share
  FROM events WHERE ts < TIMESTAMP '{HALF}' GROUP BY event_type""")
def reference_shares(spark, d):
    return D.category_shares(halves(spark, d)[0], ["event_type"]).select("feature", "category", "n", *r6("share"))


@query(f"""SELECT md5(event_id::VARCHAR) AS h, value FROM events WHERE ts < TIMESTAMP '{HALF}' ORDER BY h LIMIT 1000""")
def reference_sample(spark, d):
    return D.reference_sample(halves(spark, d)[0], "value", F.col("event_id"))


def ks_sql(c):
    return f"""SELECT '{c}' AS feature, max(abs(c0 / t0 - c1 / t1)) AS st, any_value(t0) AS n0, any_value(t1) AS n1 FROM (
  SELECT v, sum(n0) OVER (ORDER BY v) AS c0, sum(n1) OVER (ORDER BY v) AS c1, sum(n0) OVER () AS t0, sum(n1) OVER () AS t1 FROM (
    SELECT {c} AS v, count(*) FILTER (ts < TIMESTAMP '{HALF}')::DOUBLE AS n0, count(*) FILTER (ts >= TIMESTAMP '{HALF}')::DOUBLE AS n1 FROM events GROUP BY v))"""


@query(f"WITH k AS ({ks_sql('value')} UNION ALL {ks_sql('user_id')}), p AS (SELECT *, st * sqrt(n0 * n1 / (n0 + n1)) AS lam FROM k), " + "m AS (" + union(
    ["value", "user_id"], f"""SELECT '{{c}}' AS feature, avg({{c}}) FILTER (ts >= TIMESTAMP '{HALF}') - avg({{c}}) FILTER (ts < TIMESTAMP '{HALF}') AS mean_shift,
  stddev_samp({{c}}) FILTER (ts >= TIMESTAMP '{HALF}') - stddev_samp({{c}}) FILTER (ts < TIMESTAMP '{HALF}') AS std_shift FROM events""") + """),
  q AS (SELECT *, least(1.0, greatest(0.0, list_sum(list_transform(range(1, 102), lambda j: (CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * j * j * lam * lam))))) AS p_value FROM p)
  SELECT feature, 'kolmogorov_smirnov' AS test, round(st + 1e-9, 6) AS statistic, round(p_value::DOUBLE + 1e-9, 6) AS p_value, p_value < 0.05 AS drift_detected,
  round(mean_shift + 1e-9, 6) AS mean_shift, round(std_shift + 1e-9, 6) AS std_shift FROM q JOIN m USING (feature)""")
def drift_continuous(spark, d):
    out = D.continuous_drift(*halves(spark, d), ["value", "user_id"])
    return out.select("feature", "test", *r6("statistic", "p_value"), "drift_detected", *r6("mean_shift", "std_shift"))


CHI = f"""s AS (SELECT event_type AS c, count(*) FILTER (ts < TIMESTAMP '{HALF}' AND event_type <> 'view')::DOUBLE AS o, count(*) FILTER (ts >= TIMESTAMP '{HALF}')::DOUBLE AS n FROM events GROUP BY c),
  t AS (SELECT *, sum(o) OVER () AS ot, sum(n) OVER () AS nt FROM s), e AS (SELECT *, greatest(o / ot * nt, 1e-6) AS ex, greatest(n, 1e-6) AS ob FROM t),
  x AS (SELECT sum((ob - ex) * (ob - ex) / ex) AS st, count(*) FILTER (o = 0) AS fresh FROM e)"""
LISTED = CHI.replace("AS fresh", "AS fresh, string_agg(c, ',' ORDER BY c) FILTER (o = 0) AS listed")


@query(f"""WITH {LISTED} SELECT 'event_type' AS feature, 'chi_square' AS test, round(st / 1e6, 3) AS statistic, round(exp(-st / 2) * (1 + st / 2), 6) AS p_value,
  exp(-st / 2) * (1 + st / 2) < 0.05 AS drift_detected, fresh AS n_new_categories, listed AS new_categories FROM x""")
def drift_categorical(spark, d):
    old, new = halves(spark, d)
    out = D.categorical_drift(old.where("event_type <> 'view'"), new, ["event_type"])
    return out.select("feature", "test", F.round(F.col("statistic") / 1e6, 3).alias("statistic"), F.round("p_value", 6).alias("p_value"), "drift_detected", "n_new_categories",
                      F.when(F.size("new_categories") > 0, F.array_join("new_categories", ",")).alias("new_categories"))


@query(f"""WITH o AS (SELECT DISTINCT event_type, (event_id % 3)::VARCHAR AS kind FROM events WHERE ts < TIMESTAMP '{HALF}' AND event_type <> 'view' AND event_id % 3 < 2),
  c AS (SELECT event_type, (event_id % 3)::VARCHAR AS kind FROM events WHERE ts >= TIMESTAMP '{HALF}'),
  l AS (SELECT 'event_type' AS feature, event_type AS category, count(*) AS n FROM c WHERE event_type NOT IN (SELECT event_type FROM o) GROUP BY event_type
  UNION ALL SELECT 'kind', kind, count(*) FROM c WHERE kind NOT IN (SELECT kind FROM o) GROUP BY kind)
  SELECT feature, category, n, round(n / (SELECT count(*) FROM c) + 1e-9, 6) AS share FROM l""")
def drift_new_categories(spark, d):
    old, new = [half.withColumn("kind", (F.col("event_id") % 3).cast("string")) for half in halves(spark, d)]
    out = D.new_categories(old.where("event_type <> 'view' AND event_id % 3 < 2"), new, ["event_type", "kind"])
    return out.select("feature", "category", "n", *r6("share"))


@query(f"""WITH {CHI.replace(" AND event_type <> 'view'", "")}, k AS ({ks_sql('value')} UNION ALL {ks_sql('user_id')}), p AS (SELECT *, st * sqrt(n0 * n1 / (n0 + n1)) AS lam FROM k),
  q AS (SELECT list_sum(list_transform(range(1, 102), lambda j: (CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * j * j * lam * lam))) < 0.05 AS dr FROM p
    UNION ALL SELECT exp(-st / 2) * (1 + st / 2) < 0.05 FROM x)
  SELECT count(*) AS features_tested, count(*) FILTER (dr) AS features_with_drift, round(count(*) FILTER (dr) / count(*) + 1e-9, 6) AS drift_ratio, count(*) FILTER (dr) > 0 AS drift_detected FROM q""")
def drift_rollup(spark, d):
    out = D.rollup(D.drift_results(*halves(spark, d), ["value", "user_id"], ["event_type"]))
    return out.select("features_tested", "features_with_drift", *r6("drift_ratio"), "drift_detected")


@query("""WITH h AS (SELECT event_type AS feature, date_trunc('hour', ts) AS t, avg(value) > 30 AS dr FROM events GROUP BY ALL),
  r AS (SELECT feature, count(*) AS n_tests, count(*) FILTER (dr) AS n_drift, count(*) FILTER (dr) / count(*) AS rate FROM h WHERE t >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY feature)
  SELECT feature, n_tests, n_drift, round(rate + 1e-9, 6) AS drift_rate FROM r ORDER BY rate DESC, feature LIMIT 10""")
def drift_history(spark, d):
    e = table(spark, d, "events")
    hist = e.groupBy(F.col("event_type").alias("feature"), F.date_trunc("hour", "ts").alias("timestamp")).agg((F.avg("value") > 30).alias("drift_detected"))
    return D.history_summary(hist, "2024-01-31 00:00:00", 264).select("feature", "n_tests", "n_drift", *r6("drift_rate"))


PERF = f"""b AS (SELECT event_type AS metric, avg(value) AS bv FROM events WHERE ts < TIMESTAMP '{HALF}' GROUP BY metric),
  r AS (SELECT event_type AS metric, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS i FROM events),
  c AS (SELECT metric, avg(value) AS cv, bv, (avg(value) - bv) / nullif(bv, 0) AS ch FROM r JOIN b USING (metric) WHERE i <= 100 GROUP BY metric, bv HAVING count(*) >= 100)"""


def _performance(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("metric"), F.col("ts").alias("timestamp"), "value")
    base = e.where(F.col("timestamp") < F.lit(HALF).cast("timestamp")).groupBy("metric").agg(F.avg("value").alias("baseline_value"))
    return D.performance_drift(e, base)


@query(f"""WITH {PERF} SELECT metric, round(bv + 1e-9, 6) AS baseline_value, round(cv + 1e-9, 6) AS current_value, round(ch + 1e-9, 6) AS relative_change, abs(ch) > 0.05 AS drift_detected FROM c""")
def performance_drift(spark, d):
    return _performance(spark, d).select("metric", *r6("baseline_value", "current_value", "relative_change"), "drift_detected")


@query(f"""WITH {PERF}, {CHI.replace(" AND event_type <> 'view'", "")}, z AS (SELECT (SELECT exp(-st / 2) * (1 + st / 2) < 0.05 FROM x) AS s, (SELECT bool_or(abs(ch) > 0.05) FROM c) AS p)
  SELECT s AS statistical_drift, p AS performance_drift, CASE WHEN s AND p THEN 'critical' WHEN s OR p THEN 'warning' ELSE 'healthy' END AS status FROM z""")
def monitoring_status(spark, d):
    return D.overall_status(D.categorical_drift(*halves(spark, d), ["event_type"]), _performance(spark, d))


def latencies(spark, d):
    return table(spark, d, "events").select(F.col("ts").alias("timestamp"), F.col("value").alias("latency"))


@query("""WITH l AS (SELECT ts, nullif(value, 0) AS v FROM events ORDER BY ts DESC LIMIT 100)
  SELECT round(avg(v) + 1e-9, 6) AS avg_latency, max(v) AS max_latency, min(v) AS min_latency, round(quantile_cont(v, 0.95) + 1e-9, 6) AS p95_latency,
  round(count(*) / greatest(1, epoch(max(ts) - min(ts))) + 1e-9, 6) AS predictions_per_second, (SELECT count(*) FROM events) AS total_predictions FROM l""")
def prediction_latency(spark, d):
    out = D.latency_summary(latencies(spark, d))
    return out.select(*r6("avg_latency"), "max_latency", "min_latency", *r6("p95_latency", "predictions_per_second"), "total_predictions")


@query("""WITH l AS (SELECT nullif(value, 0) AS v, row_number() OVER (ORDER BY ts DESC) AS i FROM events)
  SELECT round(avg(v) FILTER (i <= 50) + 1e-9, 6) AS recent_avg, round(avg(v) FILTER (i > 50) + 1e-9, 6) AS older_avg, avg(v) FILTER (i <= 50) > 1.5 * avg(v) FILTER (i > 50) AS degraded FROM l WHERE i <= 100""")
def latency_regression(spark, d):
    return D.latency_regression(latencies(spark, d)).select(*r6("recent_avg", "older_avg"), "degraded")


def importance(spark, d, late=None):
    """Importance of part brands: their share of revenue, by return flag as the model."""
    li = table(spark, d, "lineitem")
    if late is not None:
        li = li.where((F.year("l_shipdate") >= 1995) if late else (F.year("l_shipdate") < 1995))
    joined = li.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    keys = [F.col("p_brand").alias("feature")] + ([] if late is not None else [F.col("l_returnflag").alias("model")])
    return joined.groupBy(*keys).agg((F.sum("l_extendedprice") / 1e6).alias("importance"))


def importance_sql(where, model=""):
    return f"SELECT p_brand AS feature{model}, sum(l_extendedprice) / 1e6 AS importance FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {where} GROUP BY ALL"


IMP = f"""n AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) <= 10 AS top FROM ({importance_sql('year(l_shipdate) >= 1995')})),
  o AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) <= 10 AS top FROM ({importance_sql('year(l_shipdate) < 1995')})),
  f AS (SELECT feature, coalesce(n.importance, 0) AS current, coalesce(o.importance, 0) AS previous, abs(coalesce(n.importance, 0) - o.importance) / o.importance AS ch,
    n.importance IS NOT NULL AS present, coalesce(n.top, false) AS nt, coalesce(o.top, false) AS ot FROM n FULL JOIN o USING (feature))"""


@query(f"""WITH {IMP} SELECT feature, round(current + 1e-9, 6) AS current, round(previous + 1e-9, 6) AS previous, round(ch + 1e-9, 6) AS change_ratio, coalesce(ch > 0.1 AND present, false) AS changed,
  nt AS in_current_top, ot AS in_previous_top FROM f""")
def importance_changes(spark, d):
    out = D.importance_changes(importance(spark, d, True), importance(spark, d, False))
    return out.select("feature", *r6("current", "previous", "change_ratio"), "changed", "in_current_top", "in_previous_top")


@query(f"""WITH {IMP}, a AS (SELECT count(*) FILTER (ch > 0.1 AND present) AS n_changed, count(*) FILTER (nt AND ot) / count(*) FILTER (nt) AS ov FROM f)
  SELECT n_changed, round(ov + 1e-9, 6) AS top_overlap, n_changed > 0 OR ov < 0.8 AS drift_detected FROM a""")
def importance_drift(spark, d):
    out = D.importance_drift(importance(spark, d, True), importance(spark, d, False))
    return out.select("n_changed", *r6("top_overlap"), "drift_detected")


MODELS = ["A", "N", "R"]
WIDE = f"""i AS ({importance_sql('true', ', l_returnflag AS model')}), w AS (SELECT feature, """ + ", ".join(
    f"""coalesce(max(importance) FILTER (model = '{m}'), 0) AS "{m}" """ for m in MODELS) + " FROM i GROUP BY feature)"


@query(f"""WITH {WIDE} SELECT feature, round("A" + 1e-9, 6) AS "A", round("N" + 1e-9, 6) AS "N", round("R" + 1e-9, 6) AS "R", round(list_avg(["A", "N", "R"]) + 1e-9, 6) AS mean,
  round(list_stddev_samp(["A", "N", "R"]) + 1e-9, 6) AS std FROM w""")
def importance_comparison(spark, d):
    return D.compare_importance(importance(spark, d), MODELS).select("feature", *r6("A", "N", "R", "mean", "std"))


@query(f"WITH {WIDE} " + " UNION ALL ".join(f"""SELECT '{a}' AS model_a, '{b}' AS model_b, round(corr("{a}", "{b}") + 1e-9, 6) AS correlation FROM w""" for a, b in [("A", "N"), ("A", "R"), ("N", "R")]))
def importance_correlation(spark, d):
    return D.importance_correlation(importance(spark, d), MODELS).select("model_a", "model_b", *r6("correlation"))
