"""Model training, validation and scoring on Spark ML."""

from __future__ import annotations

import itertools
import random
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.blocks import interval_seconds, number_rows
from tidemark.plans.ranks import cumulative
from tidemark.schemas import KEYS
from tidemark.session import cut_lineage

# Seed, split, and measures that are better when smaller.
SEED = 42
TRAIN_SHARE = 0.8
LOWER_IS_BETTER = ["rmse", "mae"]
GRID_POINTS = 20

AT_ONCE = 4  # trials of a search
FILLED = "_filled_"  # prefix of feature columns without missing values

CLASSIFIERS = {
    "random_forest": lambda **p: C.RandomForestClassifier(seed=SEED, **p),
    "gradient_boosting": lambda **p: C.GBTClassifier(seed=SEED, **p),
    "logistic_regression": lambda **p: C.LogisticRegression(**p),
    "linear_svm": lambda **p: C.LinearSVC(**p),
}
REGRESSORS = {
    "random_forest": lambda **p: R.RandomForestRegressor(seed=SEED, **p),
    "gradient_boosting": lambda **p: R.GBTRegressor(seed=SEED, **p),
    "linear_regression": lambda **p: R.LinearRegression(**p),
    "ridge": lambda **p: R.LinearRegression(**{"regParam": 1.0, "elasticNetParam": 0.0, **p}),
    "lasso": lambda **p: R.LinearRegression(**{"regParam": 1.0, "elasticNetParam": 1.0, **p}),
}
# Search spaces: (low, high) ranges, or lists of choices.
SEARCH_SPACES = {
    "random_forest": {"numTrees": (10, 100), "maxDepth": (3, 10), "minInstancesPerNode": (1, 10)},
    "gradient_boosting": {"maxIter": (10, 50), "maxDepth": (2, 8), "stepSize": (0.01, 0.3)},
    "logistic_regression": {"regParam": (0.0001, 1.0), "elasticNetParam": [0.0, 0.5, 1.0]},
    "linear_svm": {"regParam": (0.0001, 1.0), "maxIter": (20, 100)},
}


def chronological_split(df: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    """Flag the first ``share`` of each series as training rows."""
    return _sized(df).withColumn("is_train", F.col("_rn") <= F.floor(F.col("_n") * share)).drop("_n")


def _time_bounds(df: DataFrame, ranks: Sequence[Column]) -> DataFrame:
    """One row ``_b``: for each rank, a column of the number of rows ``_n``, the earliest time up to which so many rows lie."""
    counts = df.groupBy(F.unix_micros("timestamp").alias("_us")).agg(F.count("*").alias("_rows"))
    upto = cumulative(counts, [], "_us", {"_upto": F.col("_rows")}).withColumn("_n", df.select(F.count("*")).scalar())
    return upto.agg(F.struct(*[F.min(F.when(F.col("_upto") >= r, F.col("_us"))).alias(f"b{i}") for i, r in enumerate(ranks)]).alias("_b"))


def _seen(gap: int) -> Column:
    """Time of the last bar that a target of ``gap`` bars ahead looks at."""
    return F.unix_micros("timestamp") + interval_seconds(F.col("interval")) * 1_000_000 * gap


def time_split(df: DataFrame, share: float = TRAIN_SHARE, gap: int = 0) -> DataFrame:
    """Add ``part``: ``train``, ``gap`` or ``test``, by one cut in time for all series.

    Rows after the cut, the earliest time that leaves at least ``share`` of all rows (rounded down) up to it, are test rows. Training
    rows lie before it by ``gap`` bars, so that no target of that horizon looks past the cut. Rows of the same time stay together.
    """
    cut = _time_bounds(df, [F.floor(F.col("_n") * share)]).scalar()["b0"]
    part = F.when(F.unix_micros("timestamp") > cut, "test").when(_seen(gap) <= cut, "train").otherwise("gap")
    return df.withColumn("part", part)


def time_folds(df: DataFrame, k: int = 5, gap: int = 0) -> DataFrame:
    """Add ``fold``, the test fold 1 to k of a row or 0, and ``trains_from``, the first fold whose training rows it belongs to.

    Folds are cut in time over all series: the last k parts of n div (k + 1) rows, rows of the same time together. Each fold
    trains on all rows whose target, ``gap`` bars ahead, lies before it; the last fold's rows train nothing (k + 1).
    With k rows or fewer all rows only train.
    """
    size = F.floor(F.col("_n") / (k + 1))
    bounds = _time_bounds(df, [F.col("_n") - (k - j) * size for j in range(k)]).scalar()
    ends = [bounds[f"b{j}"] for j in range(k)]
    after = lambda us: sum((us > end).cast("int") for end in ends)
    return df.withColumns({"fold": after(F.unix_micros("timestamp")), "trains_from": after(_seen(gap)) + 1})


def _sized(df: DataFrame) -> DataFrame:
    numbered = number_rows(df)
    sizes = numbered.groupBy(*KEYS).agg(F.max("_rn").alias("_n"))
    return numbered.join(sizes, KEYS)


# --- training -----------------------------------------------------------------------


def pipeline(name: str, columns: Sequence[str], label: str, task: str = "classification", **params) -> Pipeline:
    """Steps of a model. Missing features count as 0, so no row is lost; see :func:`score` for the flag."""
    kinds = CLASSIFIERS if task == "classification" else REGRESSORS
    if name not in kinds:
        raise ValueError(f"unknown model {name!r}")
    learner = kinds[name](featuresCol="features", labelCol=label, **params)
    filled = ", ".join(f"coalesce(`{c}`, 0D) AS `{FILLED}{c}`" for c in columns)
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
        VectorAssembler(inputCols=[f"{FILLED}{c}" for c in columns], outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True), learner,
    ])


def train(df: DataFrame, columns: Sequence[str], label: str, name: str, task: str = "classification", gap: int = 1, **params):
    """Fit on the rows before the cut in time that leaves 80% of all rows; returns the model and the scored rows after it.

    ``gap`` is the horizon of the target in bars: training rows whose target looks past the cut are left out.
    """
    split = cut_lineage(time_split(df.select(*KEYS, "timestamp", label, *columns).dropna(), gap=gap))
    model = pipeline(name, columns, label, task, **params).fit(split.where("part = 'train'"))
    return model, model.transform(split.where("part = 'test'"))


def train_regression(df: DataFrame, columns: Sequence[str], target: str, name: str = "random_forest", **params):
    model, scored = train(df, columns, target, name, "regression", **params)
    rmse = RegressionEvaluator(labelCol=target, predictionCol="prediction", metricName="rmse").evaluate(scored)
    return model, rmse


# --- measures -----------------------------------------------------------------------


def confusion(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return predictions.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def class_report(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a denominator is 0."""
    cells = confusion(predictions, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    truth = cells.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    said = cells.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("predicted"))
    both = truth.join(said, "class", "full").na.fill(0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = zero(F.try_divide("tp", "predicted")), zero(F.try_divide("tp", "support"))
    out = both.select("class", p.alias("precision"), r.alias("recall"), "support", "tp")
    return out.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def classification_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and the class measures weighted by support."""
    report = class_report(predictions, label, prediction)
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    return report.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), weighted("precision"), weighted("recall"), weighted("f1"))


def regression_metrics(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, e = F.col(label), F.col(label) - F.col(prediction)
    out = predictions.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("_v"))
    return out.select("mse", F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide(F.col("mse"), F.col("_v"))).alias("r2"))


def roc_auc(predictions: DataFrame, score: str, label: str = "label") -> DataFrame:
    """Exact area under the curve from counts per distinct score; ties count half."""
    counts = predictions.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    ranked = cumulative(counts, [], "score", {"upto": F.col("neg")})
    wins = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    return ranked.agg((wins / (F.sum("pos").cast("double") * F.sum("neg"))).alias("auc"))


# --- validation ---------------------------------------------------------------------


def expanding_folds(df: DataFrame, k: int = 5) -> DataFrame:
    """Test fold of every row (1..k), or 0 for the rows only used for training.

    The last k blocks of n div (k + 1) rows are the folds; each trains on all earlier rows.
    A series of k rows or fewer is too short for folds and only trains.
    """
    size = F.floor(F.col("_n") / (k + 1))
    from_end = F.coalesce(F.floor(F.try_divide(F.col("_n") - F.col("_rn"), size)), F.lit(k))
    return _sized(df).withColumn("fold", F.greatest(F.lit(0), k - from_end).cast("int")).drop("_n")


def cross_validate(
    df: DataFrame, columns: Sequence[str], label: str, name: str, task: str = "classification", k: int = 5, gap: int = 1, **params
) -> DataFrame:
    """Mean, deviation and range of each measure over expanding folds in time, see :func:`time_folds`."""
    data = df.select(*KEYS, "timestamp", label, *columns).dropna()
    folds = cut_lineage(time_folds(data, k, gap))
    parts = None
    measure = classification_metrics if task == "classification" else regression_metrics
    for i in range(1, k + 1):
        model = pipeline(name, columns, label, task, **params).fit(folds.where(F.col("trains_from") <= i))
        part = measure(model.transform(folds.where(F.col("fold") == i)), label).withColumn("fold", F.lit(i))
        parts = part if parts is None else parts.unionByName(part)
    names = [c for c in parts.columns if c != "fold"]
    long = parts.select("fold", F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names
    ])).alias("x")).select("fold", "x.*")
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def compare_models(scores: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Models by one measure, best first."""
    value = F.col(metric).asc() if metric in LOWER_IS_BETTER else F.col(metric).desc()
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(value, "model")).cast("long"))


def best_model(scores: DataFrame, metric: str = "accuracy") -> DataFrame:
    return compare_models(scores, metric).where("rank = 1")


def metric_rankings(scores: DataFrame) -> DataFrame:
    """Rank of each model per measure in a long table; measures missing for a model are left out."""
    every = Window.partitionBy("metric")
    whole = scores.withColumn("_missing", F.count_if(F.col("value").isNull()).over(every)).where("_missing = 0").drop("_missing")
    better = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("value")).otherwise(-F.col("value"))
    return whole.withColumn("rank", F.rank().over(Window.partitionBy("metric").orderBy(better)).cast("long"))


# --- importance ---------------------------------------------------------------------


def native_importance(model: PipelineModel, columns: Sequence[str]) -> dict[str, float] | None:
    """Importances or coefficients of the last stage, scaled by the largest; None if it has neither."""
    learner = model.stages[-1]
    if hasattr(learner, "featureImportances"):
        values = learner.featureImportances.toArray()
    elif hasattr(learner, "coefficients"):
        values = learner.coefficients.toArray()
    else:
        return None
    top = max(abs(v) for v in values) or 1.0
    return {c: float(v / top) for c, v in zip(columns, values)}


def dealt_out(df: DataFrame, columns: Sequence[str], seed: int = SEED, rows_per_bucket: int = 65536) -> DataFrame:
    """``df`` with ``_new``, a struct of ``columns`` taken from another row.

    Rows are dealt to buckets of bounded size and put in a hash order; each takes the values of the next one, the last
    those of the first.
    """
    buckets = max(1, -(-df.count() // rows_per_bucket))
    key = [F.col(c) for c in (*KEYS, "timestamp")]
    keyed = df.withColumn("_hb", F.pmod(F.xxhash64(*key, F.lit(seed + 1)), F.lit(buckets))).withColumn("_h", F.xxhash64(*key, F.lit(seed)))
    order = Window.partitionBy("_hb").orderBy("_h")
    values = F.struct(*columns)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return keyed.withColumn("_new", F.coalesce(F.lead(values).over(order), F.first(values).over(every))).drop("_hb", "_h")


def permutation_importance(
    model: PipelineModel, df: DataFrame, columns: Sequence[str], label: str, task: str = "classification", seed: int = SEED
) -> DataFrame:
    """Loss of accuracy (or R squared) when a column takes the values of other rows.

    Every row is scored as it is and once for each column with that column's value exchanged, in one pass.
    """
    pairs = dealt_out(cut_lineage(df), columns, seed)
    variants = pairs.withColumn("_variant", F.explode(F.array(F.lit(""), *[F.lit(c) for c in columns])))
    changed = variants.withColumns({c: F.when(F.col("_variant") == c, F.col("_new")[c]).otherwise(F.col(c)) for c in columns})
    scored = model.transform(changed.drop("_new")).groupBy("_variant")
    if task == "classification":
        value = F.avg((F.col(label) == F.col("prediction")).cast("double"))
    else:
        value = 1 - F.try_divide(F.avg(F.pow(F.col(label) - F.col("prediction"), 2)), F.var_pop(label))
    # One row per column; cut, so that the variants are scored once for base and columns.
    values = cut_lineage(scored.agg(value.alias("_value")))
    base = values.where("_variant = ''").select("_value").scalar()
    return values.where("_variant <> ''").select(F.col("_variant").alias("feature"), (base - F.col("_value")).alias("importance"))


def partial_dependence(model: PipelineModel, df: DataFrame, column: str, points: int = GRID_POINTS) -> DataFrame:
    """Mean prediction with one column set to each point of a grid over its range."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).select(F.struct("*")).scalar()
    lo, width = F.col("_ends.lo"), F.col("_ends.hi") - F.col("_ends.lo")
    grid = F.array(*[lo + width * (i / (points - 1)) for i in range(points)])
    spread = df.withColumn("_ends", ends).withColumn(column, F.explode(grid)).drop("_ends")
    return model.transform(spread).groupBy(F.col(column).alias("grid")).agg(F.avg("prediction").alias("mean_prediction"))


def group_importance(importance: DataFrame) -> DataFrame:
    """Importance of features that share a name prefix, for prefixes of two or more features."""
    prefix = F.regexp_extract("feature", r"^([a-zA-Z]+)[_0-9]", 1)
    grouped = importance.withColumn("prefix", prefix).where("prefix <> ''").groupBy("prefix")
    total = F.sum(F.abs("importance"))
    out = grouped.agg(F.count("*").alias("n_features"), total.alias("total_importance"), (total / F.count("*")).alias("average_importance"))
    return out.where("n_features > 1")


# --- search -------------------------------------------------------------------------


def draws(space: Mapping, n: int, seed: int = SEED) -> list[dict]:
    """Seeded random parameter sets; integer ranges stay integer."""
    rng = random.Random(seed)

    def one(bounds):
        if isinstance(bounds, list):
            return rng.choice(bounds)
        low, high = bounds
        return rng.randint(low, high) if isinstance(low, int) else rng.uniform(low, high)

    return [{name: one(bounds) for name, bounds in space.items()} for _ in range(n)]


def grid(space: Mapping, points: int = 3) -> list[dict]:
    """All combinations of the choices and of ``points`` even steps over each range; integer ranges stay integer."""

    def steps(bounds) -> list:
        if isinstance(bounds, list):
            return bounds
        low, high = bounds
        values = [low + (high - low) * i / max(1, points - 1) for i in range(points)]
        return sorted({round(v) for v in values}) if isinstance(low, int) else values

    return [dict(zip(space, chosen)) for chosen in itertools.product(*[steps(b) for b in space.values()])]


def search(
    df: DataFrame, columns: Sequence[str], label: str, names: Sequence[str], trials: int = 10, k: int = 3,
    metric: str = "accuracy", task: str = "classification", seed: int = SEED, spaces: Mapping = SEARCH_SPACES, points: int | None = None,
) -> DataFrame:
    """One row per trial: algorithm, parameters and the cross-validated score.

    Parameters are ``trials`` seeded random draws, or with ``points`` the whole :func:`grid`. Trials are independent Spark jobs, a few of which run at a time.
    """
    data = cut_lineage(df.select(*KEYS, "timestamp", label, *columns).dropna())

    def run(trial: tuple[str, int, dict]) -> tuple:
        name, i, params = trial
        found = cross_validate(data, columns, label, name, task, k, **params)
        score = found.where(F.col("metric") == metric).first()["mean"]
        return name, i, {p: str(v) for p, v in params.items()}, float(score)

    sets = lambda space: draws(space, trials, seed) if points is None else grid(space, points)
    todo = [(name, i, params) for name in names for i, params in enumerate(sets(spaces[name]))]
    with ThreadPool(AT_ONCE) as pool:
        history = pool.map(run, todo)
    return df.sparkSession.createDataFrame(history, "model string, trial int, params map<string,string>, score double")


def rank_algorithms(trials: DataFrame) -> DataFrame:
    """Best trial of each algorithm, best algorithm first."""
    best = trials.groupBy("model").agg(F.max("score").alias("score"), F.count("*").alias("n_trials"))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "model")).cast("long"))


# --- scoring ------------------------------------------------------------------------


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """One row per input row: prediction, highest class probability as confidence, and ``is_fallback``.

    Rows with a missing feature get the fallback prediction 0 and no confidence.
    """
    columns = [c.removeprefix(FILLED) for c in model.stages[1].getInputCols()]
    valid = F.lit(True)
    for c in columns:
        valid = valid & F.col(f"`{c}`").isNotNull()
    out = with_fallback(model.transform(df), valid, F.col("prediction"))
    if "probability" in out.columns:
        out = out.withColumn("confidence", F.when(~F.col("is_fallback"), F.array_max(vector_to_array("probability"))))
    return out.drop(*[f"{FILLED}{c}" for c in columns])


def with_fallback(df: DataFrame, valid: Column, prediction: Column) -> DataFrame:
    """The prediction for valid rows; the constant 0 and a flag for the others."""
    ok = F.coalesce(valid, F.lit(False))
    return df.withColumns({"prediction": F.when(ok, prediction).otherwise(F.lit(0.0)), "is_fallback": ~ok})
