"""Row-wise vector math on ``array<double>`` columns: all inside the JVM, no Python per row."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from statweave.plans.common import num, ratio


def vec(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _zip_sum(a, b, fn) -> Column:
    return total(F.zip_with(vec(a), vec(b), fn))


def dot(a, b) -> Column:
    return _zip_sum(a, b, lambda x, y: x * y)


def norm2(a) -> Column:
    return F.sqrt(total(F.transform(vec(a), lambda x: x * x)))


def squared_euclidean(a, b) -> Column:
    return _zip_sum(a, b, lambda x, y: (x - y) * (x - y))


def euclidean(a, b) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a, b) -> Column:
    return _zip_sum(a, b, lambda x, y: F.abs(x - y))


def cosine_similarity(a, b) -> Column:
    return ratio(dot(a, b), norm2(a) * norm2(b))


def _per_element(a: Column, stat: Column, fn) -> Column:
    """fn(element, stat) with ``stat`` evaluated once per row: bound as a lambda variable, not
    re-derived for every element."""
    bound = F.array(F.struct(a.alias("a"), stat.alias("t")))
    return F.transform(bound, lambda s: F.transform(s["a"], lambda x: fn(x, s["t"])))[0]


def _centred(a: Column) -> Column:
    return _per_element(a, total(a) / F.size(a), lambda x, m: x - m)


def pearson_distance(a, b) -> Column:
    return 1 - cosine_similarity(_centred(vec(a)), _centred(vec(b)))


def bray_curtis(a, b) -> Column:
    return ratio(manhattan(a, b), _zip_sum(a, b, lambda x, y: x + y))


def jaccard(a, b) -> Column:
    """Distance of two sets given as arrays."""
    return 1 - ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def hamming(a, b) -> Column:
    return ratio(F.aggregate(F.zip_with(a, b, lambda x, y: (~x.eqNullSafe(y)).cast("double")), F.lit(0.0), lambda s, x: s + x), F.size(a))


def closure(a) -> Column:
    """Scaled to sum one."""
    return _per_element(vec(a), total(vec(a)), lambda x, t: F.try_divide(x, t))


def clr_vector(a) -> Column:
    logs = F.transform(vec(a), lambda x: F.ln(x))
    return _centred(logs)


def aitchison(a, b) -> Column:
    return euclidean(clr_vector(a), clr_vector(b))


def hellinger(a, b) -> Column:
    return F.sqrt(_zip_sum(closure(a), closure(b), lambda x, y: (F.sqrt(x) - F.sqrt(y)) * (F.sqrt(x) - F.sqrt(y)))) / F.sqrt(F.lit(2.0))


def _kl(p, q) -> Column:
    return _zip_sum(p, q, lambda x, y: F.when(x <= 0, 0.0).when(y <= 0, float("inf")).otherwise(x * F.ln(x / y)))


def kl_divergence(a, b) -> Column:
    """Natural-log KL(a || b) of the closed vectors; infinite where b lacks mass a has."""
    return _kl(closure(a), closure(b))


def jensen_shannon(a, b) -> Column:
    """Distance: root of the mean KL to the midpoint (both sides closed once per row)."""
    bound = F.array(F.struct(closure(a).alias("p"), closure(b).alias("q")))
    mid = F.transform(bound, lambda s: F.struct(s["p"].alias("p"), s["q"].alias("q"), F.zip_with(s["p"], s["q"], lambda x, y: (x + y) / 2).alias("m")))
    return F.transform(mid, lambda s: F.sqrt(F.greatest(F.lit(0.0), (_kl(s["p"], s["m"]) + _kl(s["q"], s["m"])) / 2)))[0]


def total_variation(a, b) -> Column:
    return manhattan(closure(a), closure(b)) / 2


def mahalanobis(cols: Sequence[str], centre: Sequence[float], inverse: Sequence[Sequence[float]]) -> Column:
    """Distance of scalar columns to ``centre`` under a p x p inverse covariance."""
    d = [num(v) - F.lit(float(m)) for v, m in zip(cols, centre)]
    q = sum((F.lit(float(inverse[i][j])) * d[i] * d[j] for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
    return F.sqrt(F.greatest(q, F.lit(0.0)))


def gower(numeric: dict[str, tuple[Column, Column, float]], nominal: dict[str, tuple[Column, Column]]) -> Column:
    """Mean of per-column partial distances: |x - y| / range, or 0 / 1 for categories; a column
    missing on either side does not count."""
    parts = []
    for x, y, width in numeric.values():
        parts.append(F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) / (width or 1.0)))
    for x, y in nominal.values():
        parts.append(F.when(x.isNotNull() & y.isNotNull(), (x != y).cast("double")))
    s = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    k = sum((p.isNotNull().cast("double") for p in parts), F.lit(0.0))
    return ratio(s, k)


def vector_entropy(a, base: float | None = None) -> Column:
    """Shannon entropy of a closed vector."""
    h = -total(F.transform(closure(a), lambda p: F.when(p > 0, p * F.ln(p)).otherwise(0.0)))
    return h if base is None else h / F.ln(F.lit(float(base)))


def top_k_hit(scores, classes, truth: Column, k: int) -> Column:
    """Is the true class among the k best-scored ones?"""
    pairs = F.arrays_zip(F.transform(vec(scores), lambda x: -x).alias("s"), (F.col(classes) if isinstance(classes, str) else classes).alias("c"))
    return F.array_contains(F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["c"]), truth)
