"""Group moments: one shuffle with map-side partials, so a hot group costs no more than a cold one."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from statweave.plans.common import num, ratio, sq


def group_moments(df: DataFrame, y, group: str | Sequence[str], by: Sequence[str] = (),
                  shape: bool = False) -> DataFrame:
    """(by, group) -> n, mean, var[, skew, kurt, lo, hi] over non-null values of ``y``."""
    keys = [group] if isinstance(group, str) else list(group)
    y = num(y)
    extra = [F.skewness("_y").alias("skew"), F.kurtosis("_y").alias("kurt"),
             F.min("_y").alias("lo"), F.max("_y").alias("hi")] if shape else []
    src = df.select(*by, *keys, y.alias("_y")).where(F.col("_y").isNotNull())
    for k in keys:
        src = src.where(F.col(k).isNotNull())
    return src.groupBy(*by, *keys).agg(
        F.count("_y").alias("n"), F.avg("_y").alias("mean"), F.var_samp("_y").alias("var"), *extra)


def pair_moments(df: DataFrame, y, group: str, levels: Sequence[str],
                 by: Sequence[str] = ()) -> DataFrame:
    """One row per stratum: n1, m1, v1, n2, m2, v2 of the two named groups."""
    src = (df.where(F.col(group).cast("string").isin(list(levels)))
             .select(*by, F.col(group).cast("string").alias("_g"), num(y).alias("_y")))
    aggs = []
    for i, lv in enumerate(levels, 1):
        v = F.when(F.col("_g") == lv, F.col("_y"))
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.var_samp(v).alias(f"v{i}")]
    return src.groupBy(*by).agg(*aggs)


def sums_of_squares(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Between / within decomposition per stratum from a group-moment table."""
    w = Window.partitionBy(*(by or [F.lit(0)]))
    grand = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    return (moments.withColumn("_grand", grand).groupBy(*by).agg(
        F.count("n").alias("k"), F.sum("n").alias("total"), F.max("_grand").alias("grand"),
        F.sum(F.col("n") * sq(F.col("mean") - F.col("_grand"))).alias("ssb"),
        F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("ssw")))


def hedges_g(n1, m1, v1, n2, m2, v2) -> tuple[Column, Column, Column]:
    """Bias-corrected standardised mean difference and its normal-theory 95 % limits."""
    pooled = F.sqrt(ratio((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))
    d = F.when(pooled > 0, (m1 - m2) / pooled).when(pooled.isNotNull(), 0.0)
    g = d * (1 - F.lit(3.0) / (4 * (n1 + n2) - 9))
    half = 1.96 * F.sqrt(ratio(n1 + n2, n1 * n2) + sq(g) / (2 * (n1 + n2)))
    return g, g - half, g + half
