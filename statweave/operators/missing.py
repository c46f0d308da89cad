"""Missing values: report, patterns, removal and imputation."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from statweave.plans.common import cut_lineage, num, ratio
from statweave.plans.cumulate import quantiles

c = F.col
HIGH = 0.30                 # share of missing worth a flag
MEAN_LIMIT = 0.10           # a mean fill shrinks the spread beyond this
METHODS = ("zero", "mean", "median", "mode", "group_mean", "group_median", "knn", "mice")


def is_missing(df: DataFrame, col: str) -> Column:
    """Null, or NaN in a floating column."""
    kind = dict(df.dtypes)[col]
    return (c(col).isNull() | F.isnan(c(col))) if kind in ("double", "float") else c(col).isNull()


def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column, from one aggregation over the table."""
    cols = list(columns or df.columns)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, col in enumerate(cols):
        aggs.append(F.sum(is_missing(df, col).cast("long")).alias(f"m{i}"))
        if isinstance(df.schema[col].dataType, NumericType):
            aggs.append(F.sum((num(col) == 0).cast("long")).alias(f"z{i}"))
    row = df.agg(*aggs)
    parts = [F.struct(F.lit(col).alias("column"), c(f"m{i}").alias("n_missing"),
                      (c(f"z{i}") if f"z{i}" in row.columns else F.lit(None).cast("long")).alias("zeros"))
             for i, col in enumerate(cols)]
    t = row.select("_n", F.explode(F.array(*parts)).alias("r")).select("_n", "r.*")
    rate, zero = ratio(c("n_missing"), c("_n")), ratio(c("zeros"), c("_n") - c("n_missing"))
    return t.select("column", "n_missing", rate.alias("ratio"), (rate > HIGH).alias("high"), zero.alias("zero_ratio"),
                    F.coalesce((zero > 0.5) & (rate > 0) & (rate < 0.5), F.lit(False)).alias("suspect_zero_filled"))


def missing_patterns(df: DataFrame, columns: Sequence[str] | None = None, top: int = 5) -> DataFrame:
    """Most frequent sets of columns missing together (ties by name)."""
    cols = list(columns or df.columns)
    combo = F.concat_ws(",", *[F.when(is_missing(df, col), F.lit(col)) for col in cols])
    t = df.groupBy(combo.alias("columns")).agg(F.count(F.lit(1)).alias("n"))
    total = t.agg(F.sum("n").alias("v")).scalar()
    return t.select("columns", "n", ratio(c("n"), total).alias("ratio")).where("columns <> ''") \
            .orderBy(c("n").desc(), "columns").limit(top)


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    bad = F.lit(False)
    for col in columns or df.columns:
        bad = bad | is_missing(df, col)
    return df.agg(F.sum((~bad).cast("long")).alias("complete_rows"), F.count(F.lit(1)).alias("n_rows"))


def drop_na(df: DataFrame, columns: Sequence[str] | None = None, how: str = "row") -> DataFrame:
    if how == "row":
        return df.dropna(subset=list(columns) if columns else None)
    if how != "column":
        raise ValueError(f"how must be row or column, not {how!r}")
    if columns is None:
        r = df.agg(*[F.max(is_missing(df, col)).alias(f"m{i}") for i, col in enumerate(df.columns)]).first()
        columns = [col for i, col in enumerate(df.columns) if r[f"m{i}"]]
    return df.drop(*columns)


def _mode(df: DataFrame, col: str) -> Column:
    """Most frequent value, smallest on ties."""
    t = df.where(~is_missing(df, col)).groupBy(c(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return t.agg(F.min(F.struct((-c("n")).alias("k"), c("v"))).getField("v").alias("v")).scalar()


def _fill(df: DataFrame, col: str, value: Column) -> Column:
    return F.when(is_missing(df, col), value.cast(df.schema[col].dataType)).otherwise(c(col))


def impute(df: DataFrame, method: str, columns: Sequence[str], group_by: str | None = None,
           key: str | None = None, k: int = 5, rounds: int = 10) -> DataFrame:
    """Fill ``columns``; group fills leave a group that is missing throughout as it is."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    cols = list(columns)
    if method == "zero":
        return df.withColumns({col: _fill(df, col, F.lit(0)) for col in cols})
    if method in ("mean", "median"):
        # integers become doubles: a mean need not be whole
        if method == "mean":
            stat = df.agg(*[F.avg(num(col)).alias(col) for col in cols])
            return df.withColumns({col: F.coalesce(num(col), stat.select(col).scalar()) for col in cols})
        return df.withColumns({col: F.coalesce(num(col), quantiles(df.select(num(col).alias("v")), "v", [0.5]).select("q0").scalar())
                               for col in cols})
    if method == "mode":
        return df.withColumns({col: _fill(df, col, _mode(df, col)) for col in cols})
    if method in ("group_mean", "group_median"):
        if not group_by:
            raise ValueError("group_by is required")
        out = df
        if method == "group_mean":
            fill = df.groupBy(c(group_by).alias("_g")).agg(*[F.avg(num(col)).alias(f"_f_{col}") for col in cols])
            out = df.join(fill, c(group_by) == c("_g"), "left")
        else:
            for i, col in enumerate(cols):
                med = quantiles(df.select(c(group_by).alias(f"_g{i}"), num(col).alias("v")), "v", [0.5], [f"_g{i}"])
                out = out.join(med.select(f"_g{i}", c("q0").alias(f"_f_{col}")), c(group_by) == c(f"_g{i}"), "left")
        return out.withColumns({col: F.coalesce(num(col), c(f"_f_{col}")) for col in cols}).select(*df.columns)
    if key is None:
        raise ValueError(f"{method} needs a row key")
    return _impute_knn(df, cols, key, k) if method == "knn" else _impute_mice(df, cols, key, rounds)


def _impute_knn(df: DataFrame, cols: list[str], key: str, k: int) -> DataFrame:
    """Mean of the k nearest donors (nan-Euclidean over ``cols``) per missing cell."""
    from statweave.plans.neighbours import nan_knn_mean
    filled = nan_knn_mean(df, key, cols, k)
    out = df.join(filled.withColumnRenamed(key, "_k"), c(key) == c("_k"), "left")
    return out.withColumns({col: F.coalesce(num(col), c(f"_f_{col}")) for col in cols}).select(*df.columns)


def _impute_mice(df: DataFrame, cols: list[str], key: str, rounds: int, tol: float = 1e-3) -> DataFrame:
    """Chained ridge regressions: every column in turn (fewest gaps first) is regressed on the
    others over its observed rows, from one Gram aggregation, and its gaps are re-predicted.
    Ridge strength and noise follow evidence updates on the p x p Gram matrix."""
    from statweave.plans.gram import gram, unpack
    gaps = df.agg(*[F.sum(is_missing(df, col).cast("long")).alias(col) for col in cols]).first().asDict()
    order = sorted((col for col in cols if gaps[col]), key=lambda v: gaps[v])
    stat = df.agg(*[F.avg(num(col)).alias(col) for col in cols])
    cur = df.select(key, *[is_missing(df, col).alias(f"_m_{col}") for col in cols],
                    *[F.coalesce(num(col), stat.select(col).scalar()).alias(col) for col in cols])
    last: dict[str, np.ndarray] = {}
    for _ in range(rounds):
        moved = 0.0
        for col in order:
            xs = [v for v in cols if v != col]
            n, m, s = unpack(gram(cur.where(~c(f"_m_{col}")), [*xs, col]).first(), len(cols))
            beta = _evidence_ridge(n, s)
            fit = F.lit(float(m[-1])) + sum((F.lit(float(b)) * (c(x) - F.lit(float(v))) for b, x, v in zip(beta, xs, m)), F.lit(0.0))
            cur = cur.withColumn(col, F.when(c(f"_m_{col}"), fit).otherwise(c(col)))
            moved = max(moved, float(np.max(np.abs(beta - last.get(col, np.full(len(xs), np.inf))))))
            last[col] = beta
        cur = cut_lineage(cur)
        if moved < tol:
            break
    filled = cur.select(c(key).alias("_k"), *[c(col).alias(f"_f_{col}") for col in order])
    out = df.join(filled, c(key) == c("_k"), "left")
    return out.withColumns({col: F.coalesce(num(col), c(f"_f_{col}")) for col in order}).select(*df.columns)


def _evidence_ridge(n: int, s: np.ndarray, steps: int = 300, tol: float = 1e-3) -> np.ndarray:
    """Bayesian ridge coefficients from centred cross products (last variable is the target)."""
    sxx, sxy, syy = s[:-1, :-1], s[:-1, -1], s[-1, -1]
    lam, vec = np.linalg.eigh(sxx)
    lam, proj = np.maximum(lam, 0.0), vec.T @ sxy
    alpha, lmb = 1.0 / max(syy / n, 1e-12), 1.0
    tiny, coef = 1e-6, np.zeros(len(sxy))
    for _ in range(steps):
        new = vec @ (proj / (lam + lmb / alpha))
        rss = max(float(syy - 2 * new @ sxy + new @ sxx @ new), 0.0)
        gamma = float(np.sum(alpha * lam / (lmb + alpha * lam)))
        lmb = (gamma + 2 * tiny) / (float(new @ new) + 2 * tiny)
        alpha = (n - gamma + 2 * tiny) / (rss + 2 * tiny)
        if np.sum(np.abs(new - coef)) < tol:
            return new
        coef = new
    return coef


def impute_report(before: DataFrame, after: DataFrame, columns: Sequence[str], method: str) -> DataFrame:
    """Filled and remaining cells with the method's warnings."""
    b = before.agg(*[F.sum(is_missing(before, col).cast("long")).alias(f"b_{col}") for col in columns],
                   *[F.min(num(col)).alias(f"lo_{col}") for col in columns], *[F.max(num(col)).alias(f"hi_{col}") for col in columns],
                   F.count(F.lit(1)).alias("_n"))
    a = after.agg(*[F.sum(is_missing(after, col).cast("long")).alias(f"a_{col}") for col in columns])
    from statweave.operators.regression import _paste
    t = _paste(b, a)
    parts = []
    for col in columns:
        share = ratio(c(f"b_{col}"), c("_n"))
        unit = (c(f"lo_{col}") >= 0) & (c(f"hi_{col}") <= 1)
        warn = F.when((F.lit(method) == "mean") & (share > MEAN_LIMIT), "mean fill on more than 10 % missing").when(
            (F.lit(method) == "zero") & unit, "zero is a meaningful value of a fraction")
        parts.append(F.struct(F.lit(col).alias("column"), (c(f"b_{col}") - c(f"a_{col}")).alias("n_filled"),
                              c(f"a_{col}").alias("n_remaining"), ratio(c(f"b_{col}") - c(f"a_{col}"), c("_n")).alias("ratio_filled"),
                              warn.alias("warning")))
    return t.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
