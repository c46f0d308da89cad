"""How many rows already look like the whole table: distance of repeated subsamples to the full
distribution along a ladder of sizes."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType

from statweave.operators.profile import distinct_counts
from statweave.plans.common import num
from statweave.plans.cumulate import cumulate
from statweave.plans.resample import permuted

c = F.col


def ladder(total: int, steps: int = 10, start: int = 100) -> list[int]:
    """Sizes at equal ratios from ``start`` to the whole."""
    if total <= start:
        return [total]
    step = (total / start) ** (1 / (steps - 1))
    return sorted({int(start * step ** i + 1e-9) for i in range(steps - 1)} | {total})


def _ks_terms(part, before, k, total):
    """Largest gap of each rung's steps to the whole's, just before a value and at it."""
    size, n, cum = np.cumsum(total)[:-1], part["n"].to_numpy(float), part["cum_n"].to_numpy(float)
    at, whole = np.cumsum(before + k, axis=2)[..., :-1] / size, part["tot_n"].to_numpy(float)
    pre = np.cumsum(before, axis=2)[..., :-1] / size
    gap = np.maximum(np.abs(at - ((cum + n) / whole)[:, None, None]), np.abs(pre - (cum / whole)[:, None, None]))
    return gap.max(axis=0)


def _wasserstein_terms(part, before, k, total):
    whole = (part["cum_n"].to_numpy(float) + part["n"].to_numpy(float)) / part["tot_n"].to_numpy(float)
    width = np.nan_to_num(part["next_value"].to_numpy(float) - part["v"].to_numpy(float))
    gap = np.abs(np.cumsum(before + k, axis=2)[..., :-1] / np.cumsum(total)[:-1] - whole[:, None, None])
    return np.einsum("i,irl->rl", width, gap)


def _tv_terms(part, before, k, total):
    """Shares on both sides sum to one, so the positive gaps alone make up half the absolute ones."""
    share = part["n"].to_numpy(float) / part["tot_n"].to_numpy(float)
    return np.maximum(np.cumsum(k, axis=2)[..., :-1] / np.cumsum(total)[:-1] - share[:, None, None], 0).sum(axis=0)


def distances(df: DataFrame, column: str, repeats: int = 20, sizes: Sequence[int] | None = None, metric: str | None = None, seed: int = 0) -> DataFrame:
    """(n, r, metric, d): distance of subsample r of n rows to the whole, ``ks`` or ``wasserstein`` for numbers, ``tv`` for categories; larger samples of a repeat contain smaller ones.

    A repeat is a relabelling whose labels are the rungs of the ladder, dealt to values by ``permuted``: no row is copied, and a task's bucket of values holds all repeats at once.
    Sizes that reach the table's are left out."""
    numeric = isinstance(df.schema[column].dataType, NumericType)
    metric = metric or ("ks" if numeric else "tv")
    terms = {"ks": _ks_terms, "wasserstein": _wasserstein_terms, "tv": _tv_terms}.get(metric)
    if terms is None:
        raise ValueError(f"unknown metric {metric!r}")
    # the order of categories does not matter: their hashes are the axis
    src = df.select((F.xxhash64(c(column).cast("string")).cast("double") if metric == "tv" else num(column)).alias("v"), c(column).isNotNull().alias("_ok")).where("_ok and v is not null").select("v")
    total = src.count()
    sizes = sorted({int(s) for s in (sizes or ladder(total)) if 0 < s < total})
    if not sizes:
        return df.sparkSession.createDataFrame([], "n int, r int, metric string, d double")
    table = cumulate(src, "v", {"n": F.count(F.lit(1))}, lead=True)
    rungs = [b - a for a, b in zip([0, *sizes], [*sizes, total])]
    names = [str(s) for s in sizes]
    out = permuted(table, "v", {(): rungs}, repeats, terms, names, seed=seed, how="max" if metric == "ks" else "sum")
    return out.unpivot("_rep", [f"`{x}`" for x in names], "n", "d").select(c("n").cast("int").alias("n"), c("_rep").alias("r"), F.lit(metric).alias("metric"), "d")


def distance_curve(df: DataFrame, column: str, key: Sequence[str] = (), repeats: int = 20, sizes: Sequence[int] | None = None,
                   metric: str | None = None, seed: int = 0) -> DataFrame:
    """(n) -> mean, smallest and largest distance to the whole. Subsamples are dealt to values, so rows need no key."""
    return distances(df, column, repeats, sizes, metric, seed).groupBy("n", "metric").agg(
        F.avg("d").alias("mean"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.percentile("d", 0.95).alias("p95"))


def enough_rows(curve: DataFrame, threshold: float) -> DataFrame:
    """First size whose mean distance and that of every larger size stay below the threshold."""
    last_bad = F.max(F.when(c("mean") > threshold, c("n")))
    s = curve.agg(F.coalesce(last_bad, F.lit(0)).alias("b")).select("b").scalar()
    return curve.where(c("n") > s).agg(F.min("n").alias("enough_n"))


def report(df: DataFrame, columns: Sequence[str], key: Sequence[str], repeats: int = 10, sizes: Sequence[int] | None = None, seed: int = 0) -> DataFrame:
    """Curves of several columns; text columns that identify rows are left out, since no sample of them
    resembles the whole."""
    text = [v for v in columns if not isinstance(df.schema[v].dataType, NumericType)]
    ids = set()
    if text:
        ids = {r["column"] for r in distinct_counts(df, text).where("n_unique >= 0.9 * n").select("column").collect()}
    from functools import reduce
    parts = [distance_curve(df, v, key, repeats, sizes, seed=seed).withColumn("column", F.lit(v)) for v in columns if v not in ids]
    return reduce(DataFrame.unionByName, parts)


def spread_at(df: DataFrame, column: str, key: Sequence[str], n: int, repeats: int = 50, seed: int = 0) -> DataFrame:
    """Distribution of the distance at one fixed size."""
    return distance_curve(df, column, key, repeats, [n], seed=seed)


def picked_vs_rest(df: DataFrame, column: str, key: Sequence[str], share: float = 0.5, seed: int = 0) -> DataFrame:
    """T-1204: a hash-picked part against the disjoint rest, KS for numbers and chi-square for categories."""
    from statweave.operators.rank_tests import ks_two_sample
    from statweave.operators.table_tests import chi_square
    u = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 53)) / float(1 << 53)
    src = df.withColumn("_part", F.when(u < share, "picked").otherwise("rest"))
    out = ks_two_sample(src, column, "_part", ["picked", "rest"]) if isinstance(df.schema[column].dataType, NumericType) else chi_square(src, column, "_part")
    return out.withColumn("test_id", F.lit("T-1204"))
