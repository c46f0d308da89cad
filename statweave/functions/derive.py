"""Column formulas for derived columns.

Row formulas return a ``Column``; formulas that need a statistic of the whole column take the
DataFrame too and embed that statistic as a scalar subquery, so the plan stays one lazy query and
the statistic is computed once.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from statweave.plans.common import num, ratio
from statweave.plans.cumulate import ranked

c = F.col


def divide(a: Column, b: Column) -> Column:
    """a / b with null at b = 0 (counted by ``preview``)."""
    return ratio(a, b)


def arcsinh(x) -> Column:
    return F.asinh(num(x))


def round_half_even(x, nd: int = 0) -> Column:
    f = 10.0 ** nd
    return F.rint(num(x) * f) / f


def floor_at(x, nd: int = 0) -> Column:
    f = 10.0 ** nd
    return F.floor(num(x) * f).cast("double") / f


def ceil_at(x, nd: int = 0) -> Column:
    f = 10.0 ** nd
    return F.ceil(num(x) * f).cast("double") / f


def trunc_at(x, nd: int = 0) -> Column:
    f = 10.0 ** nd
    v = num(x) * f
    return F.signum(v) * F.floor(F.abs(v)).cast("double") / f


def _step(step: float) -> float:
    if step <= 0:
        raise ValueError("step must be positive")
    return float(step)


def floor_to(x, step: float) -> Column:
    s = _step(step)
    return F.floor(num(x) / s).cast("double") * s


def ceil_to(x, step: float) -> Column:
    s = _step(step)
    return F.ceil(num(x) / s).cast("double") * s


def round_to(x, step: float) -> Column:
    s = _step(step)
    return F.rint(num(x) / s) * s


def bin_left(x, edges: Sequence[float]) -> Column:
    """Left edge of the bin, values outside clipped to the outer bins."""
    e = sorted(float(v) for v in edges)
    if len(e) < 2:
        raise ValueError("need at least two edges")
    v = num(x)
    out = F.when(v.isNull(), F.lit(None).cast("double"))
    for i in range(len(e) - 2, 0, -1):
        out = out.when(v >= e[i], e[i])
    return out.otherwise(e[0])


def logit(p, eps: float = 1e-12) -> Column:
    q = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), num(p)))
    return F.when(num(p).isNotNull(), F.ln(q / (1 - q)))


def bernoulli_variance(p) -> Column:
    return num(p) * (1 - num(p))


def percent_to_fraction(x) -> Column:
    return num(x) / 100


def clr(members: Sequence[str], part: str, eps: float = 0.0) -> Column:
    """ln(part) minus the mean log of the whole set."""
    logs = [F.ln(num(m) + eps) for m in members]
    return F.ln(num(part) + eps) - sum(logs[1:], logs[0]) / len(logs)


def alr(a, b, eps: float = 0.0) -> Column:
    return F.ln(ratio(num(a) + eps, num(b) + eps))


def ilr_first(members: Sequence[str], eps: float = 0.0) -> Column:
    d = len(members)
    return clr(members, members[0], eps) * (d / (d - 1)) ** 0.5


def ilr_basis(members: Sequence[str], eps: float = 0.0) -> list[Column]:
    """All D-1 coordinates of the sequential (pivot) basis."""
    logs = [F.ln(num(m) + eps) for m in members]
    d = len(logs)
    out = []
    for i in range(d - 1):
        rest = logs[i + 1:]
        k = d - i - 1
        out.append((logs[i] - sum(rest[1:], rest[0]) / k) * (k / (k + 1)) ** 0.5)
    return out


def set_sum(members: Sequence[str]) -> Column:
    return F.aggregate(F.array(*[num(m) for m in members]), F.lit(0.0), lambda a, x: a + x)


#: whole-column statistics usable inside formulas
COLUMN_STATS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "mean": F.avg, "sd": F.stddev_samp, "median": F.median, "min": F.min, "max": F.max,
    "count": F.count, "sd_pop": F.stddev_pop}


def column_stat(df: DataFrame, col: str, stat: str) -> Column:
    """Scalar subquery holding one statistic of one column."""
    return df.agg(COLUMN_STATS[stat](num(col)).alias("v")).scalar()


def with_share(df: DataFrame, col: str, out: str) -> DataFrame:
    return df.withColumn(out, ratio(num(col), column_stat(df, col, "sum")))


def with_zscore(df: DataFrame, col: str, out: str) -> DataFrame:
    return df.withColumn(out, ratio(num(col) - column_stat(df, col, "mean"), column_stat(df, col, "sd")))


def with_rank(df: DataFrame, col: str, out: str) -> DataFrame:
    """Average rank over the column (ties share)."""
    return ranked(df, col, out).drop(f"{out}_n")


def delta(df: DataFrame, x: str, group: str, subject: str, levels: Sequence[str]) -> DataFrame:
    """Per subject: value at the second level minus value at the first."""
    from statweave.plans.reshape import subject_by_occasion
    wide, _, _ = subject_by_occasion(df, subject, group, x, levels)
    return wide.select(c("_subject").alias(subject), (c("o1") - c("o0")).alias("delta"))


# ------------------------------------------------------------------ before committing a formula
def preview(df: DataFrame, formula: Column, source: str | None = None) -> DataFrame:
    """How a formula lands: infinite and missing counts, finite range, and for lossy formulas the
    number of distinct values before and after."""
    v = formula.cast("double")
    bad = v.isNull() | F.isnan(v)
    inf = v.isin(float("inf"), float("-inf")) & ~bad
    fin = F.when(~bad & ~inf, v)
    cols = [F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(inf, F.lit(False)).cast("long")).alias("n_inf"),
            F.sum(bad.cast("long")).alias("n_nan"), F.count(fin).alias("n_finite"),
            F.min(fin).alias("min"), F.max(fin).alias("max"), F.avg(fin).alias("mean")]
    if source:
        cols += [F.countDistinct(num(source)).alias("distinct_before"), F.countDistinct(fin).alias("distinct_after")]
    return df.agg(*cols)


def eps_advice(df: DataFrame, col: str, margin: int = 2, choices: int = 4) -> DataFrame:
    """Smallest positive value and the offset two decades below it, with smaller alternatives."""
    v = num(col)
    s = df.agg(F.min(F.when(v > 0, v)).alias("min_positive"),
               F.coalesce(F.sum((v == 0).cast("long")), F.lit(0)).alias("n_zeros"),
               F.coalesce(F.sum((v < 0).cast("long")), F.lit(0)).alias("n_negative"))
    e = F.floor(F.log10("min_positive")) - margin
    return s.select((c("n_zeros") > 0).alias("needed"), "min_positive", F.pow(F.lit(10.0), e.cast("double")).alias("recommended"),
                    F.array(*[F.pow(F.lit(10.0), (e - i).cast("double")) for i in range(choices)]).alias("candidates"),
                    "n_zeros", "n_negative")


def check_eps(given: float, recommended: float | None) -> None:
    if recommended is not None and given > recommended * 1.0000001:
        raise ValueError(f"eps {given} exceeds the recommended {recommended}")


#: result type of a formula family
RESULT_TYPES = {
    "log": "log-scale", "ln": "log-scale", "log2": "log-scale", "log10": "log-scale", "logit": "log-scale",
    "clr": "clr/alr", "alr": "clr/alr", "ilr": "clr/alr", "zscore": "z-score", "rank": "ordinal code",
    "bin": "ordinal code", "share": "proportion"}


def typed(col: Column, name: str, function: str | None = None, semantic_type: str | None = None) -> Column:
    """Alias carrying its semantic type as column metadata."""
    kind = semantic_type or RESULT_TYPES.get(function or "", "continuous")
    return col.alias(name, metadata={"semantic_type": kind})


def bind(formula: Callable[..., Column], **slots: str) -> Column:
    """Reuse a formula with its slots bound to columns."""
    return formula(**slots)
