"""Feature selection and reduction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.pvalues import chi2_p, f_p
from tidemark.functions.stats import correlation
from tidemark.operators import forests
from tidemark.operators.quality import long_form
from tidemark.plans.quantiles import exact_percentiles
from tidemark.session import cut_lineage

# Default limits of the selectors.
VARIANCE_LIMIT = 0.01
CORRELATION_LIMIT = 0.95
IMPORTANCE_LIMIT = 0.01
CHI2_SHIFT = 1e-6
PCA_SHARE = 0.95
SEED = 42
FOREST_PART_VALUES = 1 << 25  # draws, one per row and tree, that a task of a forest holds
FOREST_VALUES = 1 << 28  # draws that Spark ML stores; beyond them equal rows are counted
FOREST_DEPTH = 10  # up to which counts by node are small


def variances(df: DataFrame, columns: Sequence[str], limit: float = VARIANCE_LIMIT) -> DataFrame:
    wide = df.agg(*[F.var_samp(c).alias(c) for c in columns])
    out = long_form(wide, [], [{"feature": F.lit(c), "variance": F.col(c)} for c in columns])
    return out.withColumn("selected", F.coalesce(F.col("variance") > limit, F.lit(False)))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of every pair of columns over the rows where both are filled.

    Each task reduces its rows to sums of products by matrix multiplication, so
    only one small matrix per task is shuffled.
    """
    columns = list(columns)
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).select(F.struct("*")).scalar()
    centred = df.select(*[(F.col(c) - means[c]).cast("double").alias(c) for c in columns])
    k = len(columns)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((5, k, k))
        for batch in batches:
            x = np.column_stack([batch.column(j).to_numpy(zero_copy_only=False) for j in range(k)]).astype(float)
            have = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            square = x * x
            total += np.stack([have.T @ have, x.T @ have, have.T @ x, square.T @ have, x.T @ x])
        i, j = np.triu_indices(k, 1)
        parts = [pa.array(i), pa.array(j), *[pa.array(total[p][i, j]) for p in range(5)], pa.array(total[3][j, i])]
        yield pa.RecordBatch.from_arrays(parts, names=["i", "j", "n", "sx", "sy", "sxx", "sxy", "syy"])

    schema = "i long, j long, n double, sx double, sy double, sxx double, sxy double, syy double"
    pairs = centred.mapInArrow(sums, schema).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ["n", "sx", "sy", "sxx", "sxy", "syy"]]
    )
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    cov = F.col("sxy") - F.try_divide(sx * sy, n)
    spread = F.sqrt(F.greatest(F.col("sxx") - F.try_divide(sx * sx, n), F.lit(0.0))) * F.sqrt(
        F.greatest(F.col("syy") - F.try_divide(sy * sy, n), F.lit(0.0))
    )
    names = F.array(*[F.lit(c) for c in columns])
    return pairs.select(
        names[F.col("i")].alias("feature_a"), names[F.col("j")].alias("feature_b"), F.try_divide(cov, spread).alias("correlation")
    )


def correlation_selection(df: DataFrame, columns: Sequence[str], limit: float = CORRELATION_LIMIT) -> DataFrame:
    """Of every strongly correlated pair the column with the lower variance goes, ties the second."""
    spread = variances(df, columns).select("feature", "variance")
    close = correlations(df, columns).where(F.abs("correlation") > limit)
    a = spread.select(F.col("feature").alias("feature_a"), F.col("variance").alias("va"))
    b = spread.select(F.col("feature").alias("feature_b"), F.col("variance").alias("vb"))
    loser = F.when(F.col("va") < F.col("vb"), F.col("feature_a")).otherwise(F.col("feature_b"))
    dropped = close.join(a, "feature_a").join(b, "feature_b").select(loser.alias("feature")).distinct()
    return spread.join(dropped.withColumn("_gone", F.lit(True)), "feature", "left").select(
        "feature", "variance", F.col("_gone").isNull().alias("selected")
    )


def _filled(columns: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns]


def f_scores(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """One-way analysis of variance of each feature by class."""
    data = df.select(F.col(label).alias("_y"), *_filled(columns))
    groups = data.groupBy("_y").agg(
        F.count("*").alias("_n"), *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.var_pop(c).alias(f"v_{c}") for c in columns]
    )
    n = F.col("_n")
    long = long_form(groups, ["_y", "_n"], [
        {"feature": F.lit(c), "m": F.col(f"m_{c}"), "v": F.col(f"v_{c}")} for c in columns
    ])
    mean = long.groupBy("feature").agg(
        F.sum(n).alias("n"), F.count("*").alias("k"), (F.sum(n * F.col("m")) / F.sum(n)).alias("mean"),
        F.sum(n * F.col("v")).alias("within"),
    )
    between = long.join(mean, "feature").groupBy("feature", "n", "k", "within").agg(
        F.sum(n * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))).alias("between")
    )
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    score = F.try_divide(F.col("between") / d1, F.col("within") / d2)
    return between.select("feature", score.alias("score"), d1.alias("d1"), d2.alias("d2")).select(
        "feature", "score", f_p("score", F.col("d1").cast("double"), F.col("d2").cast("double")).alias("p_value")
    )


def f_scores_regression(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    data = df.select(F.col(target).cast("double").alias("_y"), *_filled(columns))
    wide = data.agg(F.count("*").alias("_n"), *[correlation(c, "_y").alias(c) for c in columns])
    long = long_form(wide, ["_n"], [{"feature": F.lit(c), "r": F.col(c)} for c in columns])
    r2, d2 = F.col("r") * F.col("r"), F.col("_n") - 2
    scored = long.select("feature", F.try_divide(r2, 1 - r2).alias("q"), d2.cast("double").alias("d2"))
    scored = scored.select("feature", (F.col("q") * F.col("d2")).alias("score"), "d2")
    return scored.select("feature", "score", f_p("score", F.lit(1.0), "d2").alias("p_value"))


def chi2_scores(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Class sums of each feature, shifted to be positive, against their expectation."""
    data = df.select(F.col(label).alias("_y"), *_filled(columns))
    lows = data.agg(*[F.min(c).alias(c) for c in columns]).select(F.struct("*")).scalar()
    shifted = data.select("_y", *[(F.col(c) - lows[c] + CHI2_SHIFT).alias(c) for c in columns])
    groups = shifted.groupBy("_y").agg(F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in columns])
    long = long_form(groups, ["_y", "_n"], [{"feature": F.lit(c), "o": F.col(c)} for c in columns])
    totals = long.groupBy("feature").agg(F.sum("o").alias("t"), F.sum("_n").alias("n"), F.count("*").alias("k"))
    expected = F.col("t") * F.col("_n") / F.col("n")
    gap = F.col("o") - expected
    out = long.join(totals, "feature").groupBy("feature", "k").agg(F.sum(F.try_divide(gap * gap, expected)).alias("score"))
    return out.select("feature", "score", chi2_p("score", (F.col("k") - 1).cast("double")).alias("p_value"))


def mutual_information(df: DataFrame, columns: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information with the class over equally filled bins.

    Bins replace the nearest-neighbour estimate: they need one shuffle of counts.
    """
    data = cut_lineage(df.select(F.col(label).alias("_y"), *_filled(columns)))
    cuts = exact_percentiles(data, columns, [i / bins for i in range(1, bins)])
    cut_map = cuts.groupBy("column_name").agg(F.sort_array(F.collect_list("value")).alias("c"))
    table = cut_map.agg(F.map_from_entries(F.collect_list(F.struct("column_name", "c")))).scalar()
    framed = data.withColumn("_cuts", table)
    cells = framed.select("_y", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.size(F.filter(F.col("_cuts")[c], lambda e: e < F.col(c))).alias("bin"))
        for c in columns
    ])).alias("x")).select("_y", "x.*")
    joint = cells.groupBy("feature", "bin", "_y").agg(F.count("*").alias("n"))
    by = lambda *k: Window.partitionBy(*k)
    n, all_n = F.col("n"), F.sum("n").over(by("feature"))
    term = n / all_n * F.ln(n * all_n / (F.sum("n").over(by("feature", "bin")) * F.sum("n").over(by("feature", "_y"))))
    return joint.select("feature", term.alias("t")).groupBy("feature").agg(F.greatest(F.sum("t"), F.lit(0.0)).alias("score"))


def best(scores: DataFrame, k: int | None = None, percentile: float | None = None) -> DataFrame:
    """Flag the best k, or the best percentage, of a score table of one row per feature."""
    order = Window.orderBy(F.col("score").desc_nulls_last(), "feature")
    ranked = scores.withColumn("rank", F.row_number().over(order).cast("long"))
    if k is not None:
        return ranked.withColumn("selected", F.col("rank") <= k)
    size = F.count("*").over(Window.partitionBy())
    return ranked.withColumn("selected", F.col("rank") <= F.floor(size * percentile / 100))


def assembled(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="skip").transform(df)


def _in_parts(df: DataFrame, trees: int) -> DataFrame:
    """``df`` in so many parts that none has more than ``FOREST_PART_VALUES`` draws of a forest; as it is if it has them.

    Spark ML stores a number per row and tree, so a part of a file of fixed bytes is read many times as large by every level.
    """
    rows = FOREST_PART_VALUES // trees
    parts = df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    most, total = parts.agg(F.max("n"), F.sum("n")).first()
    return df.repartition(-(-total // (rows // 2))) if (most or 0) > rows else df


def tree_importance(
    df: DataFrame, columns: Sequence[str], label: str, task: str = "classification", trees: int = 100,
    depth: int = 5, limit: float = IMPORTANCE_LIMIT, most: int = 100,
) -> DataFrame:
    """Random-forest importance, best first; selected up to ``most`` at or above the limit.

    Forests of up to ``FOREST_VALUES`` rows times trees are Spark ML's, larger ones those of :mod:`forests`, whose draws differ.
    """
    filled = df.select(label, *_filled(columns))
    rows = filled.count()
    if rows * trees > FOREST_VALUES and depth <= FOREST_DEPTH:
        weights = forests.importances(filled, columns, label, task == "classification", trees, depth, rows, SEED)
    else:
        forest = RandomForestClassifier if task == "classification" else RandomForestRegressor
        spread = _in_parts(filled, trees)
        model = forest(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=SEED).fit(assembled(spread, columns))
        weights = model.featureImportances.toArray()
    scores = df.sparkSession.createDataFrame([(c, float(w)) for c, w in zip(columns, weights)], "feature string, score double")
    return best(scores, k=most).withColumn("selected", F.col("selected") & (F.col("score") >= limit))


def eliminate(df: DataFrame, columns: Sequence[str], label: str, keep: int, task: str = "classification", **kw) -> list[str]:
    """Recursive elimination: refit and drop the weakest tenth until ``keep`` columns remain."""
    left = list(columns)
    while len(left) > keep:
        ranked = tree_importance(df, left, label, task, **kw).orderBy("rank").select("feature").collect()
        drop = max(1, min(len(left) - keep, len(left) // 10))
        gone = {r["feature"] for r in ranked[-drop:]}
        left = [c for c in left if c not in gone]
    return left


def reduce_dimensions(df: DataFrame, columns: Sequence[str], parts: int | None = None, share: float = PCA_SHARE):
    """Principal components of centred columns; as many as explain ``share`` unless given.

    Missing values count as 0, so every row gets its components.
    Returns the frame with array column ``components`` and the explained shares.
    The sign of a component is free: the largest loading is made positive.
    """
    k = parts or len(columns)
    zeros = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_zero_{c}") for c in columns]
    df = df.select("*", *zeros)
    steps = Pipeline(stages=[
        VectorAssembler(inputCols=[f"_zero_{c}" for c in columns], outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=False),
        PCA(k=k, inputCol="_centred", outputCol="_pc"),
    ])
    model = steps.fit(df)
    pca = model.stages[-1]
    explained = pca.explainedVariance.toArray()
    if parts is None:
        k = int(np.searchsorted(np.cumsum(explained), share - 1e-12) + 1)
        k = min(k, len(columns))
    loadings = pca.pc.toArray()
    signs = [float(np.sign(loadings[np.argmax(np.abs(loadings[:, j])), j]) or 1.0) for j in range(k)]
    out = model.transform(df).withColumn("_pc", vector_to_array("_pc"))
    out = out.withColumn("components", F.array(*[F.col("_pc")[j] * signs[j] for j in range(k)]))
    return out.drop("_raw", "_centred", "_pc", *[f"_zero_{c}" for c in columns]), explained[:k].tolist()


def _names(selected: DataFrame) -> list[str]:
    """Selected names; their number is bounded by the schema."""
    return [r["feature"] for r in selected.where("selected").select("feature").collect()]


def select_features(
    df: DataFrame, columns: Sequence[str], label: str, task: str = "classification", k: int = 100,
    trees: int = 50, importance: float = IMPORTANCE_LIMIT,
) -> dict[str, list[str]]:
    """Variance, correlation, univariate and tree selection in turn; names left after each step."""
    narrow = df.select(label, *columns).persist()
    try:
        left: dict[str, list[str]] = {}
        left["variance"] = _names(variances(narrow, columns))
        left["correlation"] = _names(correlation_selection(narrow, left["variance"]))
        scores = (f_scores if task == "classification" else f_scores_regression)(narrow, left["correlation"], label)
        left["univariate"] = _names(best(scores, k=k))
        left["tree"] = _names(tree_importance(narrow, left["univariate"], label, task, trees=trees, limit=importance))
        return {step: sorted(names) for step, names in left.items()}
    finally:
        narrow.unpersist()


# --- selection over slices of time ---------------------------------------------------


def time_segments(df: DataFrame, time: str, segments: int) -> DataFrame:
    """Add ``segment``: consecutive spans of time, from 0, with about equally many rows; equal times stay together."""
    micros = F.unix_micros(time).cast("double")
    if segments < 2:
        return df.withColumn("segment", F.lit(0).cast("long"))
    cuts = exact_percentiles(df.select(micros.alias("_t")), ["_t"], [i / segments for i in range(1, segments)])
    found = cuts.agg(F.collect_list("value")).scalar()
    return df.withColumn("_cuts", found).withColumn(
        "segment", F.size(F.filter("_cuts", lambda c: c < micros)).cast("long")
    ).drop("_cuts")


def segment_moments(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Sums from which variance, correlation and F scores of any union of segments follow, in one pass over the rows.

    One row per (segment, i, j) of columns i <= j over rows where both are filled, ``y`` NULL; and one per
    (segment, y, i) for class y, where a missing value counts as 0. Values are taken less the column's overall mean.
    Rows without a segment are left out; rows without a label are in no class.
    """
    columns = list(columns)
    k = len(columns)
    held = df.where("segment IS NOT NULL").select("segment", F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in columns])
    overall = held.agg(*[F.avg(F.nanvl(c, F.lit(None))).alias(c) for c in columns]).first()
    means = np.array([overall[c] or 0.0 for c in columns])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict = {}
        classes: dict = {}
        for batch in batches:
            segment, y, *values = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(k + 2)]
            x = np.column_stack(values).astype(float) - means
            for s in np.unique(segment):
                rows = x[segment == s]
                have = ~np.isnan(rows)
                z, h = np.where(have, rows, 0.0), have.astype(float)
                square = z * z
                pairs[s] = pairs.get(s, 0) + np.stack([h.T @ h, z.T @ h, h.T @ z, square.T @ h, z.T @ z, h.T @ square])
                full, of = np.where(have, rows, -means), y[segment == s]
                for c in np.unique(of[~np.isnan(of)]):
                    own = full[of == c]
                    classes[s, c] = classes.get((s, c), 0) + np.stack([np.full(k, float(len(own))), own.sum(0), (own * own).sum(0)])
        i, j = np.triu_indices(k)
        for s, m in pairs.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([s] * len(i), pa.int64()), pa.nulls(len(i), pa.float64()), pa.array(i), pa.array(j), *[pa.array(p[i, j]) for p in m]], names=names
            )
        at = np.arange(k)
        for (s, c), (n, sx, sxx) in classes.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([s] * k, pa.int64()), pa.array([c] * k, pa.float64()), *map(pa.array, (at, at, n, sx, sx, sxx, sxx, sxx))], names=names
            )

    names = ["segment", "y", "i", "j", *MOMENTS]
    schema = "segment long, y double, i long, j long, " + ", ".join(f"{m} double" for m in MOMENTS)
    return held.mapInArrow(sums, schema).groupBy("segment", "y", "i", "j").agg(*[F.sum(m).alias(m) for m in MOMENTS])


MOMENTS = ["n", "sx", "sy", "sxx", "sxy", "syy"]


def slice_selections(
    df: DataFrame, columns: Sequence[str], label: str, span: int = 2, variance: float = VARIANCE_LIMIT,
    correlation: float = CORRELATION_LIMIT, k: int = 100, trees: int | None = None,
) -> DataFrame:
    """The steps of :func:`select_features` for classes on overlapping slices of time: (slice, step, features).

    ``df`` has a ``segment`` (:func:`time_segments`). Slice s covers ``span`` segments from s on, the last ones
    fewer. All slices share one pass over the rows: a slice's moments are the sum of its segments'. With
    ``trees`` a forest of that size is fitted on the rows of every slice as the last step.
    """
    columns = list(columns)
    held = cut_lineage(df.select("segment", label, *columns))
    by_segment = cut_lineage(segment_moments(held, columns, label))
    covered = F.explode(F.sequence(F.greatest(F.col("segment") - (span - 1), F.lit(0).cast("long")), F.col("segment")))
    sums = by_segment.withColumn("slice", covered).groupBy("slice", "y", "i", "j").agg(*[F.sum(m).alias(m) for m in MOMENTS])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    shared = sums.where("y IS NULL")
    spread = shared.where("i = j").select("slice", "i", F.try_divide(F.col("sxx") - F.try_divide(sx * sx, n), n - 1).alias("v"))
    varied = spread.where(F.col("v") > variance)
    root = lambda s, q: F.sqrt(F.greatest(F.col(q) - F.try_divide(F.col(s) * F.col(s), n), F.lit(0.0)))
    r = F.try_divide(F.col("sxy") - F.try_divide(sx * sy, n), root("sx", "sxx") * root("sy", "syy"))
    close = shared.where("i < j").select("slice", "i", "j", r.alias("r")).where(F.abs("r") > correlation)
    close = close.join(varied.withColumnRenamed("v", "va"), ["slice", "i"]).join(
        varied.select("slice", F.col("i").alias("j"), F.col("v").alias("vb")), ["slice", "j"])
    loser = F.when(F.col("va") < F.col("vb"), F.col("i")).otherwise(F.col("j"))
    apart = varied.join(close.select("slice", loser.alias("i")).distinct(), ["slice", "i"], "left_anti")
    groups = sums.where("y IS NOT NULL").groupBy("slice", "i").agg(
        (F.sum(sx * sx / n) - F.sum("sx") * F.sum("sx") / F.sum("n")).alias("between"), F.sum(F.col("sxx") - sx * sx / n).alias("within"),
        F.count("*").alias("classes"), F.sum("n").alias("rows"),
    )
    score = F.try_divide(F.try_divide(F.col("between"), F.col("classes") - 1), F.try_divide(F.col("within"), F.col("rows") - F.col("classes")))
    names = F.array(*[F.lit(c) for c in columns])
    scored = apart.join(groups.select("slice", "i", score.alias("score")), ["slice", "i"], "left")
    order = Window.partitionBy("slice").orderBy(F.col("score").desc_nulls_last(), names[F.col("i")])
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    every = by_segment.select(F.col("segment").alias("slice")).distinct()
    out = None
    for step, chosen in (("variance", varied), ("correlation", apart), ("univariate", ranked)):
        sets = chosen.groupBy("slice").agg(F.sort_array(F.collect_list(names[F.col("i")])).alias("features"))
        part = every.join(sets, "slice", "left").select(
            "slice", F.lit(step).alias("step"), F.coalesce("features", F.array().cast("array<string>")).alias("features"))
        out = part if out is None else out.unionByName(part)
    if not trees:
        return out
    out = cut_lineage(out)
    fitted = [
        (s["slice"], "tree", sorted(_names(tree_importance(
            held.where(F.col("segment").between(s["slice"], s["slice"] + span - 1)).dropna(subset=[label]), s["features"], label, trees=trees))))
        for s in out.where("step = 'univariate' AND size(features) > 0").orderBy("slice").collect()  # one row per slice
    ]
    return out.unionByName(df.sparkSession.createDataFrame(fitted, out.schema))


def stability(selections: DataFrame, neighbours: bool = True) -> DataFrame:
    """Mean Jaccard similarity of the feature sets of neighbouring slices, or of all pairs of slices.

    ``selections`` has columns slice (long) and features (array<string>), one row per slice. A pair without
    any feature is left out.
    """
    if neighbours:
        before = F.array(F.col("slice") - 1)
    else:
        first = selections.select(F.min("slice")).scalar()
        before = F.when(F.col("slice") > first, F.sequence(first, F.col("slice") - 1))
    other = selections.select(F.explode(before).alias("slice"), F.col("features").alias("next"))
    pairs = selections.join(other, "slice").where(F.size(F.array_union("features", "next")) > 0)
    jaccard = F.size(F.array_intersect("features", "next")) / F.size(F.array_union("features", "next"))
    return pairs.agg(F.avg(jaccard).alias("mean_jaccard"), F.count("*").alias("n_pairs"))
