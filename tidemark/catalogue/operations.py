"""Queries for A/B tests, metrics, logs, audit tables and trading signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.common import NUMBERED, full_sql, hourly_bars, table
from tidemark.operators import abtest as A
from tidemark.operators import audit as N
from tidemark.operators import metrics as M
from tidemark.operators import signals as O
from tidemark.schemas import KEYS
from tidemark.sources import datasets as V

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


def q6(*columns):
    return ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in columns)


# --- A/B tests --------------------------------------------------------------------

VARIANTS = [("control", 2.0), ("fast", 1.0), ("deep", 1.0)]
HASH = "('0x' || substr(md5({k}), 1, 8))::BIGINT"
EXPOSED = f"""h AS (SELECT *, {HASH.format(k="'pricing:' || user_id")}::DOUBLE / 4294967295 AS u FROM events),
  x AS (SELECT *, CASE WHEN u <= 0.5 THEN 'control' WHEN u <= 0.75 THEN 'fast' ELSE 'deep' END AS variant FROM h)"""


def exposures(spark, d):
    e = table(spark, d, "events")
    shown = e.select(
        "event_id", "user_id", F.col("value").alias("latency_ms"), F.lit(1).alias("prediction"),
        F.when(F.col("event_type") != "error", F.col("event_id") % 2).alias("actual"), (F.col("value") * 2).alias("impact_score"),
    )
    return A.assign(shown, F.col("user_id"), "pricing", VARIANTS)


@query(f"WITH {EXPOSED} SELECT event_id, user_id, variant FROM x")
def ab_assignment(spark, d):
    return exposures(spark, d).select("event_id", "user_id", "variant")


@query("""WITH v AS (SELECT l_returnflag AS test, l_linestatus AS variant, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL)
  SELECT test, variant, round(weight / sum(weight) OVER (PARTITION BY test) + 1e-9, 6) AS share,
  round(sum(weight) OVER (PARTITION BY test ORDER BY variant) / sum(weight) OVER (PARTITION BY test) + 1e-9, 6) AS upper FROM v""")
def ab_weights(spark, d):
    v = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("test"), F.col("l_linestatus").alias("variant")).agg(F.sum("l_quantity").alias("weight"))
    return A.normalise_weights(v.withColumn("ord", F.col("variant"))).select("test", "variant", *r6("share", "upper"))


@query(f"SELECT event_id, CASE WHEN {HASH.format(k='event_id::VARCHAR')} % 100 < 30 THEN 'a' ELSE 'b' END AS model FROM events")
def ab_traffic_split(spark, d):
    return A.split_traffic(table(spark, d, "events").select("event_id"), F.col("event_id"), 0.3)


@query(f"""WITH {EXPOSED} SELECT variant, count(*) AS n, round(avg(value) + 1e-9, 6) AS latency_ms,
  round(avg(CASE WHEN event_type <> 'error' THEN (event_id % 2 = 1)::INT END) + 1e-9, 6) AS accuracy, round(avg(value * 2) + 1e-9, 6) AS business_impact FROM x GROUP BY variant""")
def ab_metrics(spark, d):
    return A.variant_metrics(exposures(spark, d)).select("variant", "n", *r6("latency_ms", "accuracy", "business_impact"))


TTEST = EXPOSED + """, g AS (SELECT variant, count(*) AS n, avg(value) AS mean, var_samp(value) AS var FROM x GROUP BY variant),
  b AS (SELECT n AS n0, mean AS m0, var AS v0 FROM g WHERE variant = 'control'),
  t AS (SELECT variant, n, mean, n0 + n - 2 AS df, (m0 - mean) / sqrt(((n0 - 1) * v0 + (n - 1) * var) / (n0 + n - 2) * (1.0 / n0 + 1.0 / n)) AS t FROM g, b),
  a AS (SELECT *, atan(abs(t) / sqrt(df)) AS th FROM t),
  p AS (SELECT variant, n, mean, CASE WHEN variant <> 'control' THEN t END AS t_statistic, CASE WHEN variant <> 'control' THEN df::DOUBLE END AS df,
    CASE WHEN variant = 'control' THEN 1.0 WHEN df % 2 = 0 THEN 1 - sin(th) * list_sum(list_transform(range(0, df // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - 0.5 * ln(pi()) + 2 * k * ln(cos(th)))))
    ELSE 1 - 2 / pi() * (th + sin(th) * cos(th) * list_sum(list_transform(range(0, (df - 1) // 2), lambda k: exp(0.5 * ln(pi()) + lgamma(k + 1) - lgamma(k + 1.5) - ln(2) + 2 * k * ln(cos(th)))))) END::DOUBLE AS p_value FROM a)"""


@query(f"WITH {TTEST} SELECT variant, n, {q6('mean', 't_statistic')}, df, {q6('p_value')} FROM p")
def ab_significance(spark, d):
    out = A.significance(exposures(spark, d), "latency_ms", "control")
    return out.select("variant", "n", *r6("mean", "t_statistic"), "df", *r6("p_value"))


@query(f"""WITH {TTEST}, w AS (SELECT arg_min(variant, mean) AS best, arg_min(p_value, mean) AS p_value FROM p)
  SELECT best, {q6('p_value')}, CASE WHEN p_value < 0.05 THEN best END AS winner, round(CASE WHEN p_value < 0.05 THEN 1 - p_value END + 1e-9, 6) AS confidence FROM w""")
def ab_winner(spark, d):
    out = A.winner(A.significance(exposures(spark, d), "latency_ms", "control"), higher_is_better=False)
    return out.select("best", *r6("p_value"), "winner", *r6("confidence"))


@query(f"WITH {EXPOSED}, c AS (SELECT event_type, count(x.event_id) AS n FROM (SELECT DISTINCT event_type FROM events) t LEFT JOIN x USING (event_type) GROUP BY event_type) SELECT min(n) AS smallest, min(n) >= 100 AS ready FROM c")
def ab_readiness(spark, d):
    e = table(spark, d, "events")
    return A.readiness(e.select(F.col("event_type").alias("variant")), e.select(F.col("event_type").alias("variant")).distinct(), 100)


@query("""SELECT event_type AS model, count(*) AS n, round(avg(nullif(value, 0)) + 1e-9, 6) AS avg_latency_ms, round(quantile_cont(nullif(value, 0), 0.95) + 1e-9, 6) AS p95_latency_ms FROM events GROUP BY model""")
def ab_model_latency(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("value").alias("latency_ms"))
    return A.model_latency(e).select("model", "n", *r6("avg_latency_ms", "p95_latency_ms"))


# --- metrics ----------------------------------------------------------------------


def metric_rows(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("name"), "value", F.col("ts").cast("timestamp").alias("timestamp"))


@query("""SELECT event_type AS name, round(avg(value) + 1e-9, 6) AS value, count(*) AS n, max(ts) AS "timestamp", 'avg' AS aggregation FROM events GROUP BY event_type
  UNION ALL SELECT event_type, round(arg_max(value, ts) + 1e-9, 6), count(*), max(ts), 'latest' FROM events GROUP BY event_type""")
def metric_summary(spark, d):
    m = metric_rows(spark, d)
    return M.summary(m).unionByName(M.summary(m, "latest")).withColumn("value", F.expr("round(value + 1e-9D, 6)"))


@query("""WITH f AS (SELECT *, min(ts) OVER (PARTITION BY event_type) AS t0 FROM events), s AS (SELECT *, floor((epoch_us(ts) - epoch_us(t0)) / 3600000000)::BIGINT AS k FROM f)
  SELECT event_type AS name, t0 + to_microseconds(k * 3600000000) AS "timestamp", round(avg(value) + 1e-9, 6) AS value, count(*) AS n FROM s GROUP BY event_type, t0, k""")
def metric_time_series(spark, d):
    return M.time_series(metric_rows(spark, d), 60).select("name", "timestamp", *r6("value"), "n")


@query("""SELECT event_type AS name, value, ts AS "timestamp" FROM events WHERE event_type = 'view' ORDER BY ts DESC LIMIT 50""")
def latest_metrics(spark, d):
    return M.latest_metrics(metric_rows(spark, d), "view", 50)


@query("""SELECT event_id, printf('%.1f%%', value + 0.001) AS percentage, CASE WHEN b >= 1073741824 THEN printf('%.1f GB', b / 1073741824) WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576) ELSE printf('%.0f B', b) END AS bytes,
  printf('%.2f', value) AS number FROM (SELECT event_id, value, value * value * 100000 + 0.001 AS b FROM events)""")
def format_values(spark, d):
    size = F.col("value") * F.col("value") * 100000 + 0.001
    return table(spark, d, "events").select("event_id", M.format_value(F.col("value") + 0.001, "percentage").alias("percentage"),
                                            M.format_value(size, "bytes").alias("bytes"), M.format_value(F.col("value"), "number").alias("number"))


def rules(spark):
    """A fixed set of alert rules."""
    return spark.createDataFrame([
        ("high_click", "click", "gt", 30.0, "warning", True), ("low_view", "view", "lte", 5.0, "critical", True),
        ("any_error", "error", "gte", 10.0, "critical", True), ("off", "purchase", "gt", 0.0, "warning", False),
        ("low_signup", "signup", "lt", 100.0, "info", True),
    ], "rule string, metric string, condition string, threshold double, severity string, enabled boolean")


RULES = """rules(rule, metric, condition, threshold, severity, enabled) AS (VALUES ('high_click', 'click', 'gt', 30.0::DOUBLE, 'warning', true), ('low_view', 'view', 'lte', 5.0, 'critical', true),
  ('any_error', 'error', 'gte', 10.0, 'critical', true), ('off', 'purchase', 'gt', 0.0, 'warning', false), ('low_signup', 'signup', 'lt', 100.0, 'info', true))"""
MET = "CASE condition WHEN 'gt' THEN {v} > threshold WHEN 'gte' THEN {v} >= threshold WHEN 'lt' THEN {v} < threshold WHEN 'lte' THEN {v} <= threshold ELSE false END"


@query(f"""WITH {RULES}, l AS (SELECT event_type AS metric, arg_max(value, ts) AS current_value, max(ts) AS "timestamp" FROM events GROUP BY event_type)
  SELECT rule, metric, condition, threshold, severity, current_value, "timestamp" FROM rules JOIN l USING (metric) WHERE enabled AND {MET.format(v='current_value')}""")
def alert_rules(spark, d):
    return M.evaluate_rules(metric_rows(spark, d), rules(spark))


@query(f"""WITH RECURSIVE {RULES}, e AS (SELECT rule, ts, value, {MET.format(v='value')} AS met, epoch_us(ts) AS us, row_number() OVER (PARTITION BY rule ORDER BY ts) AS rn FROM events JOIN rules ON event_type = metric WHERE enabled),
  w AS (SELECT rule, ts, value, rn, met AS active, CASE WHEN met THEN us END AS fired, CASE WHEN met THEN 'triggered' ELSE 'quiet' END AS state FROM e WHERE rn = 1
  UNION ALL SELECT e.rule, e.ts, e.value, e.rn, CASE WHEN e.us - w.fired < 86400000000 THEN w.active ELSE e.met END, CASE WHEN e.us - w.fired < 86400000000 THEN w.fired WHEN e.met THEN e.us ELSE w.fired END,
    CASE WHEN e.us - w.fired < 86400000000 THEN 'cooldown' WHEN e.met THEN 'triggered' WHEN w.active THEN 'resolved' ELSE 'quiet' END
  FROM w JOIN e ON e.rule = w.rule AND e.rn = w.rn + 1)
  SELECT rule, ts AS "timestamp", value, state FROM w""")
def alert_cycle(spark, d):
    return M.alert_cycle(metric_rows(spark, d), rules(spark), cooldown=86400)


@query("""WITH a AS (SELECT event_id::VARCHAR AS rule, event_type AS severity, ts, event_id % 3 = 0 AS resolved FROM events WHERE value > 100)
  SELECT rule, severity, ts AS "timestamp", (SELECT count(*) FROM a) AS total_alerts, (SELECT count(*) FROM a WHERE NOT resolved) AS active_alerts FROM a WHERE NOT resolved ORDER BY ts DESC LIMIT 10""")
def alert_view(spark, d):
    e = table(spark, d, "events").where("value > 100")
    alerts = e.select(F.col("event_id").cast("string").alias("rule"), F.col("event_type").alias("severity"), F.col("ts").alias("timestamp"), (F.col("event_id") % 3 == 0).alias("resolved"))
    return M.alert_view(alerts, show_resolved=False)


@query("""WITH s AS (SELECT event_id, value AS processing_time_ms, (user_id % 20)::DOUBLE AS error_rate_percent FROM events), u AS (
  SELECT event_id, 'processing_time_ms' AS metric, processing_time_ms AS value, 100.0::DOUBLE AS threshold FROM s UNION ALL SELECT event_id, 'error_rate_percent', error_rate_percent, 5.0 FROM s)
  SELECT *, CASE WHEN value < threshold * 1.5 THEN 'warning' ELSE 'critical' END AS severity FROM u WHERE value > threshold""")
def threshold_check(spark, d):
    s = table(spark, d, "events").select("event_id", F.col("value").alias("processing_time_ms"), (F.col("user_id") % 20).cast("double").alias("error_rate_percent"))
    return M.threshold_check(s, {"processing_time_ms": 100, "error_rate_percent": 5})


@query("SELECT metric, " + q6("avg", "max", "min", "std") + " FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS metric, avg({c}) AS avg, max({c})::DOUBLE AS max, min({c})::DOUBLE AS min, stddev_samp({c}) AS std FROM lineitem" for c in ["l_quantity", "l_extendedprice", "l_linenumber"]) + ")")
def resource_summary(spark, d):
    return M.resource_summary(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_linenumber"]).select("metric", *r6("avg", "max", "min", "std"))


def request_rows(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("value").alias("latency"), (F.col("user_id") % 10 != 0).alias("ok"))


@query("SELECT " + q6("avg_response", "min_response", "max_response", "requests_per_second", "error_rate", "p95_response", "p99_response") + """ FROM (
  SELECT avg(value) FILTER (ok) AS avg_response, min(value) FILTER (ok) AS min_response, max(value) FILTER (ok) AS max_response, count(*) FILTER (ok) / 3600.0 AS requests_per_second, count(*) FILTER (NOT ok) / count(*) AS error_rate,
  quantile_cont(value, 0.95) FILTER (ok) AS p95_response, quantile_cont(value, 0.99) FILTER (ok) AS p99_response FROM (SELECT *, user_id % 10 <> 0 AS ok FROM events))""")
def load_summary(spark, d):
    return M.load_summary(request_rows(spark, d), 3600.0).select(*r6("avg_response", "min_response", "max_response", "requests_per_second", "error_rate", "p95_response", "p99_response"))


@query("""WITH m AS (SELECT event_type, count(*) AS n, count(*) FILTER (user_id % 10 <> 0) AS ok, avg(value) FILTER (user_id % 10 <> 0) AS mean FROM events GROUP BY event_type)
  SELECT sum(n)::BIGINT AS total_requests, sum(ok)::BIGINT AS successful_requests, (sum(n) - sum(ok))::BIGINT AS failed_requests, round(sum(ok) / sum(n) * 100 + 1e-9, 6) AS success_rate,
  round(avg(mean) FILTER (mean > 0) + 1e-9, 6) AS avg_processing_ms, count(*) AS n_models FROM m""")
def serving_summary(spark, d):
    return M.serving_summary(request_rows(spark, d)).select("total_requests", "successful_requests", "failed_requests", *r6("success_rate", "avg_processing_ms"), "n_models")


def logs(spark, d):
    return table(spark, d, "events").select(
        F.col("ts").alias("timestamp"), F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"),
        F.concat(F.lit("user "), F.col("user_id") % 7).alias("source"), F.col("props").alias("message"), (F.col("value") * 10).alias("memory_mb"))


@query("""SELECT coalesce(level, 'total') AS level, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level FROM events) GROUP BY ROLLUP (level)""")
def log_counts(spark, d):
    return M.log_counts(logs(spark, d))


@query("""WITH e AS (SELECT props AS message, 'user ' || (user_id % 7) AS source FROM events WHERE event_type = 'error' ORDER BY ts DESC LIMIT 1000),
  c AS (SELECT 'message' AS kind, message AS text, count(*) AS n FROM e GROUP BY message UNION ALL SELECT 'source', source, count(*) FROM e GROUP BY source),
  r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, text) AS rank FROM c) SELECT * FROM r WHERE rank <= 10""")
def error_patterns(spark, d):
    return M.error_patterns(logs(spark, d))


@query("""WITH l AS (SELECT event_type = 'error' AS err, value * 10 AS mem FROM events ORDER BY ts DESC LIMIT 1000),
  v AS (SELECT 'high_error_rate' AS anomaly, count(*) FILTER (err) / count(*) AS value, 0.1::DOUBLE AS threshold FROM l UNION ALL SELECT 'high_memory_usage', max(mem), 1000 * 0.9 FROM l)
  SELECT anomaly, round(value + 1e-9, 6) AS value, threshold FROM v WHERE value > threshold""")
def log_anomalies(spark, d):
    return M.log_anomalies(logs(spark, d), 1000).select("anomaly", *r6("value"), "threshold")


@query("""SELECT event_id, (props->>'$.k') AS k, '***REDACTED***' AS api_key, '***REDACTED***' AS auth_token, event_type AS kind FROM events""")
def redact_props(spark, d):
    e = table(spark, d, "events")
    extra = F.create_map(F.lit("API_Key"), F.col("user_id").cast("string"), F.lit("auth_token"), F.md5(F.col("event_id").cast("string")), F.lit("kind"), F.col("event_type"))
    m = e.select("event_id", F.map_concat(F.from_json("props", "map<string,string>"), extra).alias("props"))
    p = M.redact_column(m, "props")
    return p.select("event_id", F.col("props")["k"].alias("k"), F.col("props")["API_Key"].alias("api_key"), F.col("props")["auth_token"].alias("auth_token"), F.col("props")["kind"].alias("kind"))


@query("""SELECT event_id, user_id AS "user", count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n_recent,
  count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) > 2 AS over_limit FROM events""")
def request_rates(spark, d):
    r = table(spark, d, "events").select("event_id", F.col("user_id").alias("user"), F.col("ts").alias("timestamp"))
    return M.request_rates(r, 2, seconds=3600, bucket_seconds=600).drop("timestamp")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id AS "user", epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events),
  w AS (SELECT event_id, "user", us, rn, true AS allowed, us AS newest, -1000000000000000000::BIGINT AS second FROM e WHERE rn = 1
    UNION ALL SELECT e.event_id, e."user", e.us, e.rn, w.second <= e.us - 3600000000,
      CASE WHEN w.second <= e.us - 3600000000 THEN e.us ELSE w.newest END, CASE WHEN w.second <= e.us - 3600000000 THEN w.newest ELSE w.second END
    FROM w JOIN e ON e."user" = w."user" AND e.rn = w.rn + 1)
  SELECT event_id, "user", allowed FROM w""")
def request_decisions(spark, d):
    r = table(spark, d, "events").select("event_id", F.col("user_id").alias("user"), F.col("ts").alias("timestamp"))
    return M.request_decisions(r, 2, seconds=3600, bucket_seconds=86400 * 10).select("event_id", "user", "allowed")


# --- audit ------------------------------------------------------------------------


def audit_events(spark, d):
    kind = F.when(F.col("event_type") == "signup", "auth").when(F.col("event_type") == "purchase", "data").otherwise("access")
    return table(spark, d, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("timestamp"), kind.alias("event_type"), F.col("user_id").cast("string").alias("user_id"),
        F.when(F.col("value") < 1, "failure").otherwise("success").alias("result"))


AUDIT = """a AS (SELECT event_id, ts, CASE event_type WHEN 'signup' THEN 'auth' WHEN 'purchase' THEN 'data' ELSE 'access' END AS event_type, user_id::VARCHAR AS user_id,
  CASE WHEN value < 1 THEN 'failure' ELSE 'success' END AS result FROM events)"""


@query(f"""WITH {AUDIT} SELECT event_id, ts AS "timestamp", event_type, user_id, result FROM a WHERE event_type = 'access' AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' ORDER BY ts DESC LIMIT 100""")
def audit_search(spark, d):
    return N.search(audit_events(spark, d), "access", start="2024-01-10", end="2024-01-20")


@query(f"""WITH {AUDIT} SELECT event_type, result, count(*) AS n, count(*) FILTER (event_type = 'auth' AND result IN ('failure', 'denied')) AS failed_auth,
  round(count(*) FILTER (result = 'success') / count(*) * 100 + 1e-9, 6) AS success_rate FROM a WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY GROUPING SETS ((event_type), (result), ())""")
def audit_summary(spark, d):
    out = N.audit_summary(audit_events(spark, d), "2024-01-05")
    return out.select("event_type", "result", "n", "failed_auth", *r6("success_rate"))


@query(f"""WITH {AUDIT} SELECT count(*) FILTER (ts > TIMESTAMP '2024-01-29') AS n_recent, 2::BIGINT AS n_required_seen, false AS complete FROM a""")
def audit_coverage(spark, d):
    return N.trail_coverage(audit_events(spark, d), "2024-01-29", ["access", "auth", "system_change"])


def processing(spark, d):
    c = table(spark, d, "customer")
    segment = F.col("c_mktsegment")
    categories = (F.when(segment == "BUILDING", F.array(F.lit("trading_data"), F.lit("system_logs"))).when(segment == "MACHINERY", F.array(F.lit("user_profiles"), F.lit("audit_trails")))
                  .when(segment == "HOUSEHOLD", F.array(F.lit("user_profiles"))).when(segment == "FURNITURE", F.array(F.lit("model_predictions"))).otherwise(F.array(F.lit("unknown"))))
    return c.select(
        (F.col("c_custkey") % 500).cast("string").alias("subject"), F.concat(F.lit("p"), F.col("c_custkey")).alias("record_id"), categories.alias("categories"),
        F.concat(F.lit("serve "), segment).alias("purpose"), F.when(F.col("c_acctbal") < 0, "legal_obligation").otherwise("consent").alias("legal_basis"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("c_custkey") * 3600).alias("processed_at"))


PROC = """p AS (SELECT (c_custkey % 500)::VARCHAR AS subject, 'p' || c_custkey AS record_id, c_mktsegment AS seg, 'serve ' || c_mktsegment AS purpose,
  CASE WHEN c_acctbal < 0 THEN 'legal_obligation' ELSE 'consent' END AS legal_basis, TIMESTAMP '2024-01-01' + to_hours(c_custkey) AS processed_at FROM customer)"""


@query(f"""WITH {PROC}, y AS (SELECT *, CASE seg WHEN 'BUILDING' THEN 7 WHEN 'MACHINERY' THEN 10 WHEN 'HOUSEHOLD' THEN 5 ELSE 1 END AS yr FROM p)
  SELECT record_id, yr::INTEGER AS retention_years, processed_at + to_years(yr) AS expires_at FROM y""")
def retention_periods(spark, d):
    return N.retention(processing(spark, d)).select("record_id", "retention_years", "expires_at")


def requested(spark, d):
    return table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select((F.col("o_custkey") % 500).cast("string").alias("subject")).distinct()


REQ = "r AS (SELECT DISTINCT (o_custkey % 500)::VARCHAR AS subject FROM orders WHERE o_orderpriority = '1-URGENT')"


@query(f"""WITH {PROC}, {REQ} SELECT subject, 'processing' AS kind, record_id, purpose || '|' || legal_basis AS detail FROM p WHERE subject IN (SELECT subject FROM r)
  UNION ALL SELECT (o_custkey % 500)::VARCHAR, 'consent', 'c' || o_orderkey, o_orderstatus FROM orders WHERE (o_custkey % 500)::VARCHAR IN (SELECT subject FROM r)""")
def subject_access(spark, d):
    o = table(spark, d, "orders")
    consents = o.select((F.col("o_custkey") % 500).cast("string").alias("subject"), F.concat(F.lit("c"), "o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("purpose"))
    return N.subject_records(processing(spark, d), consents, requested(spark, d))


@query(f"""WITH {PROC}, {REQ}, b AS (SELECT subject, string_agg(DISTINCT purpose, ',' ORDER BY purpose) AS obligations FROM p WHERE legal_basis IN ('legal_obligation', 'public_task') GROUP BY subject)
  SELECT subject, CASE WHEN obligations IS NULL THEN 'pending' ELSE 'rejected' END AS status, coalesce(obligations, '') AS obligations FROM r LEFT JOIN b USING (subject)""")
def erasure_decisions(spark, d):
    out = N.erasure_decisions(processing(spark, d), requested(spark, d))
    return out.select("subject", "status", F.array_join("obligations", ",").alias("obligations"))


def transactions(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("client"), F.col("l_partkey").alias("instrument"), F.concat(F.lit("venue "), F.col("l_suppkey") % 3).alias("venue"),
        F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.when(F.col("l_returnflag") == "A", "twap").alias("algorithm"), F.col("l_shipdate").cast("timestamp").alias("timestamp"))


TRADES = """t AS (SELECT 'venue ' || (l_suppkey % 3) AS venue, l_quantity AS quantity, l_extendedprice / l_quantity AS price, l_returnflag = 'A' AS alg, l_shipdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"""WITH {TRADES} SELECT venue, count(*) AS n, count(*) FILTER (alg) AS n_algorithmic, round(count(*) FILTER (alg) / count(*) * 100 + 1e-9, 6) AS algorithmic_percent
  FROM t WHERE ts BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' GROUP BY ROLLUP (venue)""")
def transaction_report(spark, d):
    return N.transaction_report(transactions(spark, d), "1995-01-01", "1996-12-31").select("venue", "n", "n_algorithmic", *r6("algorithmic_percent"))


@query(f"WITH {TRADES} SELECT venue, round(sum(quantity * price) + 1e-5, 2) AS value FROM t GROUP BY ROLLUP (venue)")
def traded_value(spark, d):
    return N.traded_value(transactions(spark, d)).select("venue", F.expr("round(value + 1e-5D, 2) AS value"))


@query("""WITH h AS (SELECT o_custkey AS "user", bool_or(o_orderpriority = '1-URGENT') AS dev, bool_or(o_orderpriority = '2-HIGH') AS app, bool_or(o_orderpriority = '5-LOW') AS dep FROM orders GROUP BY ALL)
  SELECT "user", 'Developer cannot be approver' AS violation FROM h WHERE dev AND app UNION ALL SELECT "user", 'Approver cannot be deployer' FROM h WHERE app AND dep""")
def duty_conflicts(spark, d):
    p = F.col("o_orderpriority")
    role = F.when(p == "1-URGENT", "developer").when(p == "2-HIGH", "approver").when(p == "5-LOW", "deployer").otherwise("viewer")
    return N.duty_conflicts(table(spark, d, "orders").select(F.col("o_custkey").alias("user"), role.alias("role")))


@query("""WITH c AS (SELECT c_mktsegment AS standard, CASE WHEN c_acctbal >= 0 THEN 'pass' WHEN c_acctbal < -500 THEN 'fail' ELSE 'warning' END AS status FROM customer)
  SELECT standard, count(*) AS n_checks, count(*) FILTER (status = 'pass') AS n_passed, count(*) FILTER (status = 'fail') AS n_failed, count(*) FILTER (status = 'warning') AS n_warnings,
  round(count(*) FILTER (status = 'pass') / count(*) * 100 + 1e-9, 6) AS percent, count(*) FILTER (status = 'pass') / count(*) * 100 >= 90 AS compliant FROM c GROUP BY ROLLUP (standard)""")
def compliance_rollup(spark, d):
    b = F.col("c_acctbal")
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("standard"), F.when(b >= 0, "pass").when(b < -500, "fail").otherwise("warning").alias("status"))
    return N.check_rollup(c).select("standard", "n_checks", "n_passed", "n_failed", "n_warnings", *r6("percent"), "compliant")


TEXT_RULES = [*N.SCAN_RULES, ("contact", "E-mail Address", "low", r"[a-z0-9._]+@[a-z0-9-]+\.[a-z]+"), ("contact", "Web Link", "low", r"https?://[a-z0-9./]+")]
LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_number FROM documents)"


def _rule_sql(rule):
    category, title, severity, pattern = rule
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, line_number, '{category}' AS category, '{title}' AS title, '{severity}' AS severity, unnest(regexp_extract_all(line, '(?i){p}')) AS matched, trim(line, ' ') AS snippet FROM l"""


SCAN = f"{LINES}, m AS (" + " UNION ALL ".join(_rule_sql(r) for r in TEXT_RULES) + ")"


@query(f"WITH {SCAN} SELECT * FROM m")
def text_scan(spark, d):
    return N.scan_text(table(spark, d, "documents"), "doc_id", "text", TEXT_RULES)


@query(f"WITH {SCAN} SELECT severity, category, count(*) AS n FROM m GROUP BY GROUPING SETS ((severity), (category), ())")
def text_scan_summary(spark, d):
    return N.finding_counts(N.scan_text(table(spark, d, "documents"), "doc_id", "text", TEXT_RULES))


# --- signals ----------------------------------------------------------------------

CLOSE = '"close"'
SIGNAL = NUMBERED + f""", sg AS (SELECT *, {full_sql("avg", CLOSE, 10)} AS s, {full_sql("avg", CLOSE, 50)} AS l FROM b),
  sig AS (SELECT *, CASE WHEN s > l THEN 1 WHEN s < l THEN -1 ELSE 0 END AS signal FROM sg)"""
S = 'PARTITION BY symbol ORDER BY "timestamp"'
RUNS = SIGNAL + f""", p AS (SELECT *, lag(signal) OVER ({S}) AS ps FROM sig),
  st AS (SELECT *, CASE WHEN signal <> 0 THEN coalesce(floor(25000 / nullif("close", 0)), 0) ELSE 0 END AS units FROM p WHERE ps IS NULL OR ps <> signal),
  lst AS (SELECT symbol, max("timestamp") AS lt, arg_max("close", "timestamp") AS lp FROM b GROUP BY symbol),
  nx AS (SELECT *, lead("timestamp") OVER ({S}) AS xt, lead("close") OVER ({S}) AS xp, lag(signal * units) OVER ({S}) AS held FROM st)"""
TRADE = RUNS + """, tr AS (SELECT symbol, "interval", "timestamp" AS entry_time, "close" AS entry_price, signal::INTEGER AS signal, units::BIGINT AS units, coalesce(xt, lt) AS exit_time, CASE WHEN xt IS NULL THEN lp ELSE xp END AS exit_price
  FROM nx JOIN lst USING (symbol) WHERE signal <> 0 AND units > 0)"""
EQUITY = RUNS + f""", ch AS (SELECT symbol, "timestamp", signal * units - coalesce(held, 0) AS dp, -(signal * units - coalesce(held, 0)) * "close" - (abs(signal * units) + abs(coalesce(held, 0))) * "close" * 0.0008 AS dc FROM nx),
  eq AS (SELECT symbol, "interval", "timestamp", sum(coalesce(dp, 0)) OVER ({S} ROWS UNBOUNDED PRECEDING) AS position,
  100000 + sum(coalesce(dc, 0)) OVER ({S} ROWS UNBOUNDED PRECEDING) + sum(coalesce(dp, 0)) OVER ({S} ROWS UNBOUNDED PRECEDING) * "close" AS equity FROM sig LEFT JOIN ch USING (symbol, "timestamp"))"""


def _signals(spark, d):
    return O.crossover(hourly_bars(spark, d), 10, 50)


@query(f'WITH {SIGNAL} SELECT symbol, "interval", "timestamp", signal::INTEGER AS signal FROM sig')
def crossover_signal(spark, d):
    return _signals(spark, d).select(*KEYS, "timestamp", "signal")


@query(f"WITH {TRADE} SELECT symbol, entry_time, entry_price, signal, exit_time, exit_price FROM tr")
def trade_ledger(spark, d):
    return O.ledger(_signals(spark, d)).select("symbol", "entry_time", "entry_price", "signal", "exit_time", "exit_price")


@query(f"""WITH {TRADE} SELECT symbol, entry_time, round((entry_price + exit_price) * units * 0.0008 + 1e-7, 4) AS costs,
  round(signal * units * (exit_price - entry_price) - (entry_price + exit_price) * units * 0.0008 + 1e-7, 4) AS profit FROM tr""")
def trade_costs(spark, d):
    r4 = lambda c: F.expr(f"round({c} + 1e-7D, 4) AS {c}")
    return O.ledger(_signals(spark, d)).select("symbol", "entry_time", r4("costs"), r4("profit"))


@query(f"WITH {TRADE} SELECT symbol, entry_time, units FROM tr")
def position_sizes(spark, d):
    return O.ledger(_signals(spark, d)).select("symbol", "entry_time", "units")


@query(f"""WITH {EQUITY} SELECT symbol, "interval", "timestamp", position::BIGINT AS position, round(equity + 1e-7, 4) AS equity FROM eq""")
def equity_curve(spark, d):
    return O.equity_curve(_signals(spark, d)).select(*KEYS, "timestamp", "position", F.expr("round(equity + 1e-7D, 4) AS equity"))


@query(f"""WITH {EQUITY}, ret AS (SELECT *, equity / nullif(lag(equity) OVER ({S}), 0) - 1 AS r FROM eq)
  SELECT symbol, "interval", round(CASE WHEN stddev_samp(r) = 0 THEN 0 ELSE sqrt(252) * avg(r) / stddev_samp(r) END + 1e-9, 6) AS sharpe FROM ret GROUP BY ALL""")
def sharpe_ratio(spark, d):
    return O.sharpe(O.equity_curve(_signals(spark, d))).select(*KEYS, *r6("sharpe"))


@query(f"""WITH {EQUITY}, pk AS (SELECT *, max(equity) OVER ({S} ROWS UNBOUNDED PRECEDING) AS peak FROM eq)
  SELECT symbol, "interval", round(min((equity - peak) / nullif(peak, 0)) + 1e-9, 6) AS max_drawdown FROM pk GROUP BY ALL""")
def max_drawdown(spark, d):
    return O.max_drawdown(O.equity_curve(_signals(spark, d))).select(*KEYS, *r6("max_drawdown"))


# --- catalogue of datasets ----------------------------------------------------------


@query("""WITH e AS (SELECT o_orderpriority AS dataset_id, o_orderkey, o_orderdate, o_orderstatus AS status, o_custkey % 2 AS half FROM orders),
  r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id || '-' || (o_orderkey % 97) ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM e)
  SELECT dataset_id || '-' || (o_orderkey % 97) AS dataset_id, o_orderdate::TIMESTAMP + to_microseconds(o_orderkey) AS registered_at, status FROM r WHERE i = 1 AND status = 'F' AND half = 1""")
def catalog_list(spark, d):
    """Newest entry of every dataset whose metadata fits; orders stand for registrations."""
    o = table(spark, d, "orders")
    name = F.concat("o_orderpriority", F.lit("-"), F.col("o_orderkey") % 97)
    at = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey"))
    metadata = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("half"), (F.col("o_custkey") % 2).cast("string"))
    entries = o.select(name.alias("dataset_id"), at.alias("registered_at"), metadata.alias("metadata"))
    found = V.matching(V.latest_entries(entries), {"status": "F", "half": "1"})
    return found.select("dataset_id", "registered_at", F.col("metadata")["status"].alias("status"))
