"""Queries for model training, validation and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.common import NUMBERED, hourly_bars, table
from tidemark.operators import features as X
from tidemark.operators import indicators as I
from tidemark.operators import models as K
from tidemark.plans.blocks import plain, with_rows
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


def q6(*columns):
    return ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in columns)


COLUMNS = ["ROC_10", "Momentum_10", "Williams_R_14", "volume"]


def training_rows(spark, d):
    stages = I.merge_stages([{"ROC_10": I.roc(), "Momentum_10": I.momentum(), "Williams_R_14": I.williams_r()}], X.target_stages([1]))
    out = plain(with_rows(hourly_bars(spark, d), stages, back=14, ahead=1))
    return out.select(*KEYS, "timestamp", *COLUMNS, F.col("target_direction_1").cast("double").alias("target_direction_1"), "target_return_1")


@query(f"""WITH {NUMBERED} SELECT symbol, "interval", "timestamp", rn <= floor(0.8 * count(*) OVER (PARTITION BY symbol)) AS is_train FROM b""")
def chronological_split(spark, d):
    return K.chronological_split(hourly_bars(spark, d)).select(*KEYS, "timestamp", "is_train")


@query(f"""WITH {NUMBERED}, n AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM b)
  SELECT symbol, "interval", "timestamp", CASE WHEN n < 6 THEN 0 ELSE greatest(0, 5 - (n - rn) // (n // 6)) END::INTEGER AS fold FROM n""")
def expanding_folds(spark, d):
    return K.expanding_folds(hourly_bars(spark, d), 5).select(*KEYS, "timestamp", "fold")


@query(f"""WITH {NUMBERED}, c AS (SELECT "timestamp" AS t, count(*) AS n FROM b GROUP BY t), u AS (SELECT t, sum(n) OVER (ORDER BY t) AS upto FROM c),
  cut AS (SELECT min(t) AS cut FROM u WHERE upto >= floor((SELECT count(*) FROM b) * 0.8::DOUBLE))
  SELECT symbol, "interval", "timestamp", CASE WHEN "timestamp" > cut THEN 'test' WHEN "timestamp" + INTERVAL 4 HOUR <= cut THEN 'train' ELSE 'gap' END AS part FROM b, cut""")
def time_split(spark, d):
    return K.time_split(hourly_bars(spark, d), gap=4).select(*KEYS, "timestamp", "part")


@query(f"""WITH {NUMBERED}, c AS (SELECT "timestamp" AS t, count(*) AS n FROM b GROUP BY t), u AS (SELECT t, sum(n) OVER (ORDER BY t) AS upto, sum(n) OVER () AS total FROM c),
  e AS (SELECT j, min(t) AS t FROM u, range(5) r(j) WHERE upto >= total - (5 - j) * (total // 6) GROUP BY j),
  f AS (SELECT "timestamp" AS t, (SELECT count(*) FROM e WHERE b."timestamp" > e.t) AS fold, (SELECT count(*) FROM e WHERE b."timestamp" + INTERVAL 1 HOUR > e.t) + 1 AS trains_from FROM b)
  SELECT i::INTEGER AS fold, count(*) FILTER (trains_from <= i) AS n_train, max(t) FILTER (trains_from <= i) AS last_train, count(*) FILTER (fold = i) AS n_test,
  min(t) FILTER (fold = i) AS first_test, max(t) FILTER (fold = i) AS last_test FROM f, range(1, 6) r(i) GROUP BY i""")
def fold_bounds(spark, d):
    rows = K.time_folds(hourly_bars(spark, d), 5, gap=1).select("timestamp", "fold", "trains_from")
    each = rows.withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(1, 6)])))
    trains, tests = F.col("trains_from") <= F.col("i"), F.col("fold") == F.col("i")
    at = lambda f, which, name: f(F.when(which, F.col("timestamp"))).alias(name)
    return each.groupBy(F.col("i").alias("fold")).agg(
        F.count_if(trains).alias("n_train"), at(F.max, trains, "last_train"), F.count_if(tests).alias("n_test"), at(F.min, tests, "first_test"), at(F.max, tests, "last_test")
    )


def predictions(spark, d):
    return table(spark, d, "labels").select(F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction"))


CELLS = """c AS (SELECT quality AS label, 1 - toxic AS prediction, count(*) AS n FROM labels GROUP BY ALL),
  t AS (SELECT label AS class, sum(n) AS support, coalesce(sum(n) FILTER (label = prediction), 0) AS tp FROM c GROUP BY label),
  s AS (SELECT prediction AS class, sum(n) AS predicted FROM c GROUP BY prediction),
  r AS (SELECT class, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(support, 0)::BIGINT AS support, coalesce(tp, 0) AS tp FROM t FULL JOIN s USING (class)),
  f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r)"""


@query("SELECT quality AS label, count(*) FILTER (1 - toxic = 0) AS predicted_0, count(*) FILTER (1 - toxic = 1) AS predicted_1 FROM labels GROUP BY quality")
def confusion_matrix(spark, d):
    cells = K.confusion(predictions(spark, d))
    wide = cells.groupBy("label").pivot("prediction", [0, 1]).agg(F.sum("n")).na.fill(0)
    return wide.select("label", F.col("0").alias("predicted_0"), F.col("1").alias("predicted_1"))


@query(f"WITH {CELLS} SELECT class, {q6('precision', 'recall', 'f1')}, support FROM f")
def class_report(spark, d):
    return K.class_report(predictions(spark, d)).select("class", *r6("precision", "recall", "f1"), "support")


@query(f"""WITH {CELLS}, a AS (SELECT sum(tp) / sum(support) AS accuracy, sum(precision * support) / sum(support) AS precision, sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1 FROM f)
  SELECT {q6('accuracy', 'precision', 'recall', 'f1')} FROM a""")
def classification_metrics(spark, d):
    return K.classification_metrics(predictions(spark, d)).select(*r6("accuracy", "precision", "recall", "f1"))


@query("""WITH e AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem), m AS (SELECT avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, var_pop(y) AS v FROM e)
  SELECT round(mse + 1e-5, 2) AS mse, round(sqrt(mse) + 1e-7, 4) AS rmse, round(mae + 1e-7, 4) AS mae, round(1 - mse / v + 1e-9, 6) AS r2 FROM m""")
def regression_metrics(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction"))
    out = K.regression_metrics(p)
    return out.select(F.expr("round(mse + 1e-5D, 2) AS mse"), F.expr("round(rmse + 1e-7D, 4) AS rmse"), F.expr("round(mae + 1e-7D, 4) AS mae"), *r6("r2"))


@query("""WITH s AS (SELECT l_extendedprice AS score, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS pos, count(*) FILTER (l_returnflag <> 'R')::DOUBLE AS neg FROM lineitem GROUP BY score),
  c AS (SELECT *, sum(neg) OVER (ORDER BY score) AS upto FROM s) SELECT round(sum(pos * (upto - neg / 2)) / (sum(pos) * sum(neg)) + 1e-9, 6) AS auc FROM c""")
def roc_auc(spark, d):
    p = table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return K.roc_auc(p, "l_extendedprice").select(*r6("auc"))


def model_scores(spark, d):
    """Accuracy-like shares of line items by ship year, one row per return flag as the model."""
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(F.avg("l_discount").alias("accuracy"), F.avg("l_quantity").alias("rmse"))


@query("""WITH m AS (SELECT l_returnflag AS model, avg(l_discount) AS accuracy, avg(l_quantity) AS rmse FROM lineitem GROUP BY model)
  SELECT model, round(accuracy + 1e-9, 6) AS accuracy, round(rmse + 1e-9, 6) AS rmse, row_number() OVER (ORDER BY rmse, model) AS rank FROM m""")
def model_comparison(spark, d):
    return K.compare_models(model_scores(spark, d), "rmse").select("model", *r6("accuracy", "rmse"), "rank")


@query("""WITH m AS (SELECT l_returnflag AS model, avg(l_discount) AS accuracy FROM lineitem GROUP BY model) SELECT model, round(accuracy + 1e-9, 6) AS accuracy FROM m ORDER BY accuracy DESC, model LIMIT 1""")
def best_model(spark, d):
    return K.best_model(model_scores(spark, d)).select("model", *r6("accuracy"))


@query("""WITH m AS (SELECT l_returnflag AS model, avg(l_discount) AS accuracy, avg(l_quantity) AS rmse, CASE WHEN l_returnflag <> 'A' THEN avg(l_tax) END AS auc FROM lineitem GROUP BY model),
  l AS (SELECT model, 'accuracy' AS metric, accuracy AS value FROM m UNION ALL SELECT model, 'rmse', rmse FROM m UNION ALL SELECT model, 'auc', auc FROM m),
  k AS (SELECT *, count(*) FILTER (value IS NULL) OVER (PARTITION BY metric) AS gone FROM l)
  SELECT model, metric, round(value + 1e-9, 6) AS value, rank() OVER (PARTITION BY metric ORDER BY CASE WHEN metric IN ('rmse', 'mae') THEN value ELSE -value END) AS rank FROM k WHERE gone = 0""")
def metric_rankings(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(F.avg("l_discount").alias("accuracy"), F.avg("l_quantity").alias("rmse"), F.avg("l_tax").alias("auc"))
    m = m.withColumn("auc", F.when(F.col("model") != "A", F.col("auc")))
    long = m.select("model", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ["accuracy", "rmse", "auc"]])).alias("x")).select("model", "x.*")
    return K.metric_rankings(long).select("model", "metric", *r6("value"), "rank")


@query("""WITH i AS (SELECT lower(replace(p_brand, '#', '_')) || p_size AS feature, sum(p_retailprice) / 1000 AS importance FROM part GROUP BY feature),
  g AS (SELECT regexp_extract(feature, '^([a-zA-Z]+)[_0-9]', 1) AS prefix, importance FROM i)
  SELECT prefix, count(*) AS n_features, round(sum(abs(importance)) + 1e-7, 4) AS total_importance, round(sum(abs(importance)) / count(*) + 1e-9, 6) AS average_importance FROM g WHERE prefix <> '' GROUP BY prefix HAVING count(*) > 1""")
def group_importance(spark, d):
    p = table(spark, d, "part")
    name = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), "p_size")
    i = p.groupBy(name.alias("feature")).agg((F.sum("p_retailprice") / 1000).alias("importance"))
    return K.group_importance(i).select("prefix", "n_features", F.expr("round(total_importance + 1e-7D, 4) AS total_importance"), *r6("average_importance"))


@query("""SELECT event_id, CASE WHEN value > 1 AND event_type <> 'error' THEN value / 2 ELSE 0 END AS prediction, NOT (value > 1 AND event_type <> 'error') AS is_fallback FROM events""")
def fallback_scores(spark, d):
    e = table(spark, d, "events").select("event_id", "value", "event_type")
    out = K.with_fallback(e, (F.col("value") > 1) & (F.col("event_type") != "error"), F.col("value") / 2)
    return out.select("event_id", "prediction", "is_fallback")


@query("""WITH t AS (SELECT l_returnflag AS model, l_linenumber AS trial, avg(l_discount) AS score FROM lineitem GROUP BY ALL), b AS (SELECT model, max(score) AS score, count(*) AS n_trials FROM t GROUP BY model)
  SELECT model, round(score + 1e-9, 6) AS score, n_trials, row_number() OVER (ORDER BY score DESC, model) AS rank FROM b""")
def algorithm_ranking(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("trial")).agg(F.avg("l_discount").alias("score"))
    return K.rank_algorithms(t).select("model", *r6("score"), "n_trials", "rank")


@query()
def train_classifier(spark, d):
    model, scored = K.train(training_rows(spark, d), COLUMNS, "target_direction_1", "random_forest", numTrees=100, maxDepth=5)
    return K.score(model, scored.select(*KEYS, "timestamp", *COLUMNS)).select(*KEYS, "timestamp", "prediction", "confidence")


@query(f"""WITH {NUMBERED}, p AS (SELECT symbol, lag("close", 10) OVER (PARTITION BY symbol ORDER BY "timestamp") AS p10 FROM b)
  SELECT symbol, count(*) AS n_rows, count(*) FILTER (p10 IS NULL OR p10 = 0) AS n_fallback FROM p GROUP BY symbol""")
def scored_rows(spark, d):
    """Scoring gives a row for every bar; those in the warm-up of a feature are flagged."""
    rows = training_rows(spark, d)
    model, _ = K.train(rows, COLUMNS[:2], "target_return_1", "linear_regression", "regression")
    scored = K.score(model, rows.select(*KEYS, "timestamp", *COLUMNS[:2]))
    return scored.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.count_if("is_fallback").alias("n_fallback"))


@query()
def train_regressor(spark, d):
    _, rmse = K.train_regression(training_rows(spark, d), COLUMNS, "target_return_1", "ridge")
    return spark.range(1).select(F.lit(rmse).alias("rmse"))


@query()
def cross_validation(spark, d):
    return K.cross_validate(training_rows(spark, d), COLUMNS, "target_direction_1", "logistic_regression")


@query()
def permutation_importance(spark, d):
    model, scored = K.train(training_rows(spark, d), COLUMNS, "target_direction_1", "logistic_regression")
    rows = scored.select(*KEYS, "timestamp", *COLUMNS, "target_direction_1")
    return K.permutation_importance(model, rows, COLUMNS, "target_direction_1")


@query()
def partial_dependence(spark, d):
    model, scored = K.train(training_rows(spark, d), COLUMNS, "target_return_1", "linear_regression", "regression")
    return K.partial_dependence(model, scored.select(*KEYS, "timestamp", *COLUMNS), "ROC_10")


@query()
def parameter_search(spark, d):
    return K.search(training_rows(spark, d), COLUMNS, "target_direction_1", list(K.SEARCH_SPACES), trials=3)
