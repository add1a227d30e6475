"""Exact percentiles of groups of any size.

Spark's exact ``percentile`` holds every distinct value of a group in one task.
Here one mergeable sketch brackets the percentiles of all columns and groups. A second
pass counts the values below each bracket and ranks those inside. The two passes share the
small table of brackets, which is stored; rows meet it without a shuffle while its groups are few
(their number is counted, not assumed) and by salted keys beyond that. Should a bracket miss its rank,
its group is ranked once more over the whole range, so the result is exact in all cases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

ACCURACY = 100_000
BLOCK_VALUES = 4096  # values of a bracket that are ranked together
FEW_GROUPS = 10_000  # a table of at most so many rows is sent to all executors
SALTS = 64


def exact_percentiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Long table (keys, column_name, p, value, n) of linearly interpolated percentiles.

    Missing values are ignored, and so are groups with a missing key or without values. Without ``keys``
    the whole frame is one group. ``df`` is read three times: store it first if it is expensive.
    The result is stored, one row per group, column and percentile.
    """
    keys, columns, probs = list(keys), list(columns), [float(p) for p in probs]
    frame = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=keys)
    eps = 3.0 / ACCURACY
    edges = ", ".join(f"{e!r}D" for p in probs for e in (max(0.0, p - eps), min(1.0, p + eps)))
    sketch = cut_lineage(frame.groupBy(*keys).agg(*[
        F.expr(x) for c in columns for x in (
            f"percentile_approx(`{c}`, array({edges}), {ACCURACY}) AS `e_{c}`",
            f"min(`{c}`) AS `min_{c}`", f"max(`{c}`) AS `max_{c}`", f"count(`{c}`) AS `n_{c}`",
        )
    ]))
    narrow = {(c, j): (f"_s.`e_{c}`[{2 * j}]", f"_s.`e_{c}`[{2 * j + 1}]") for c in columns for j in range(len(probs))}
    found = cut_lineage(_ranked(frame, sketch, probs, keys, narrow, 2 * eps))
    missed = found.where(~F.col("sure")).select(*keys, "column_name", "p")
    wrong = {(r[0], r[1]) for r in missed.select("column_name", "p").distinct().collect()}  # bounded by the arguments
    if wrong:
        whole = {(c, j): (f"_s.`min_{c}`", f"_s.`max_{c}`") for c, j in narrow if (c, probs[j]) in wrong}
        again = _ranked(frame, sketch, probs, keys, whole, 1.0).join(missed, [*keys, "column_name", "p"], "left_semi")
        found = cut_lineage(found.where("sure").unionByName(again))
    return found.drop("sure")


def _ranked(
    frame: DataFrame, sketch: DataFrame, probs: list[float], keys: list[str], brackets: dict[tuple[str, int], tuple[str, str]],
    share: float,
) -> DataFrame:
    """Percentiles of ``brackets``, (column, number of the percentile) to SQL of both edges in ``_s``, the row of ``sketch``.

    A bracket holds about ``share`` of the values; ``sure`` says whether it holds the ranks on both sides.
    """
    cells = attach(frame, sketch, keys)
    tags = [(c, j, lo, hi) for (c, j), (lo, hi) in brackets.items()]
    below = cells.groupBy(*keys).agg(*[F.expr(f"count_if(`{c}` < {lo}) AS `lt_{c}_{j}`") for c, j, lo, _ in tags])
    plans = below.join(sketch, keys) if keys else below.withColumn("_s", sketch.select(F.struct("*")).scalar()).select("*", "_s.*").drop("_s")
    plans = plans.select(*keys, F.explode(F.array(*[
        F.expr(f"struct('{c}' AS column_name, {j} AS _j, {probs[j]!r}D AS p, `n_{c}` AS n, (`n_{c}` - 1) * {probs[j]!r}D AS rank, "
               f"`lt_{c}_{j}` AS below)") for c, j, _, _ in tags
    ])).alias("x")).select(*keys, "x.*").where("n > 0")

    # The values of a bracket are dealt to equal parts of its width, so no window holds a whole bracket.
    def part(c: str, lo: str, hi: str) -> str:
        parts = f"(1 + CAST(_s.`n_{c}` * {share!r}D / {BLOCK_VALUES} AS BIGINT))"
        return f"coalesce(least(floor(try_divide(`{c}` - {lo}, {hi} - {lo}) * {parts}), {parts} - 1), 0L)"

    hits = ", ".join(
        f"if(`{c}` BETWEEN {lo} AND {hi}, struct('{c}' AS column_name, {j} AS _j, {part(c, lo, hi)} AS _part, `{c}` AS _v), NULL)"
        for c, j, lo, hi in tags
    )
    group = [*keys, "column_name", "_j"]
    inside = cells.select(*keys, F.expr(f"explode(array_compact(array({hits}))) AS x")).select(*keys, "x.*")
    counted = inside.groupBy(*group, "_part", "_v").agg(F.count("*").alias("_cnt"))
    up_to = Window.partitionBy(*group, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    local = counted.withColumn("_upto", F.sum("_cnt").over(up_to))
    # A row per part: about one of BLOCK_VALUES values of a bracket, which itself holds few of all.
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy(*group, "_part").agg(F.sum("_cnt").alias("_cnt"))
    offsets = totals.select(*group, "_part", F.coalesce(F.sum("_cnt").over(earlier), F.lit(0)).alias("_off"))
    ranked = local.join(offsets, [*group, "_part"]).join(plans, group)
    upto = F.col("below") + F.col("_off") + F.col("_upto")
    at = lambda r: F.max(F.when((upto - F.col("_cnt") <= r) & (r < upto), F.col("_v")))
    low, high = F.floor("rank"), F.ceil("rank")
    out = ranked.groupBy(*group, "p", "n", "rank").agg(at(low).alias("_v0"), at(high).alias("_v1"))
    value = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("rank") - low)
    return out.select(*keys, "column_name", "p", value.alias("value"), "n",
                      (F.col("_v0").isNotNull() & F.col("_v1").isNotNull()).alias("sure"))


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], name: str = "_s", how: str = "inner") -> DataFrame:
    """Give each row of ``df`` the struct of its group in ``small``, a stored table with one row per group.

    Without ``keys`` the one row becomes a scalar subquery. Few groups are broadcast, after counting them.
    With many, every group is repeated under ``SALTS`` salts and rows choose one by the hash of their
    columns, so a frequent group is spread over that many tasks.
    """
    keys = list(keys)
    rest = [c for c in small.columns if c not in keys]
    packed = small.select(*keys, F.struct(*rest).alias(name))
    if not keys:
        return df.withColumn(name, packed.scalar())
    if small.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS:
        return df.join(F.broadcast(packed), keys, how)
    salted = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = df.withColumn("_salt", (F.xxhash64(*[c for c, t in df.dtypes if not t.startswith(("map", "variant"))]) % SALTS + SALTS) % SALTS)
    return spread.join(salted.withColumn("_salt", F.col("_salt").cast("long")), [*keys, "_salt"], how).drop("_salt")


def percentile_columns(long: DataFrame, keys: Sequence[str], labels: dict[tuple[str, float], str]) -> DataFrame:
    """Wide form: one column per (column_name, p) of ``labels``."""
    return long.groupBy(*keys).agg(
        *[
            F.max(F.when((F.col("column_name") == name) & (F.col("p") == float(p)), F.col("value"))).alias(label)
            for (name, p), label in labels.items()
        ]
    )
