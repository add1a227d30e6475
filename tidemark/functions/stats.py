"""Small aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over rows with both values; NULL for a constant side.

    Spark's ``corr`` raises on a zero variance in ANSI mode.
    """
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    x, y = F.when(y.isNotNull(), x).cast("double"), F.when(x.isNotNull(), y).cast("double")
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
