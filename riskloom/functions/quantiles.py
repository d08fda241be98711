"""Exact quantiles without gathering values: counts by value, distributed running counts, and one aggregate that picks the order statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.ranking import running


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Linear quantiles of the values that are neither null nor NaN; an empty list if there are none."""
    x = F.col(column).cast("double")
    steps = df.select(x.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("v").agg(F.count("*").alias("c"))
    n = steps.agg(F.sum("c")).first()[0]
    if not n or not shares:
        return []
    places = [s * (n - 1) for s in shares]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    found = running(steps, "v", {"upto": F.col("c")}).agg(*[F.min(F.when(F.col("upto") > r, F.col("v"))) for r in ranks]).first()
    at = dict(zip(ranks, found))
    return [float(at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p))) for p in places]
