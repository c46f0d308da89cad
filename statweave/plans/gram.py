"""Cross-product tables: a p x p Gram matrix per stratum in one aggregation."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def complete_cases(df: DataFrame, cols: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    out = df.select(*by, *[c.alias(k) for k, c in cols.items()])
    return out.dropna(subset=[*by, *cols])


def gram(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per stratum: n, means ``m`` and centred cross products ``s`` (upper triangle, row-major).
    ``covar_pop`` is a one-pass co-moment aggregate, so no second centring scan is needed."""
    upper = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in names]).alias("m"),
        F.array(*[F.covar_pop(names[i], names[j]) for i, j in upper]).alias("c"))


def unpack(row, p: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, mean vector and centred cross-product matrix of one gram row."""
    n = int(row["n"])
    s = np.zeros((p, p))
    s[np.triu_indices(p)] = np.array([v if v is not None else np.nan for v in row["c"]], float)
    s = s + np.triu(s, 1).T
    return n, np.array([v if v is not None else np.nan for v in row["m"]], float), s * n


def per_row(rows: DataFrame, fn: Callable[[pd.Series], dict], schema: str) -> DataFrame:
    """Finish each sufficient-statistics row with numpy, still as a lazy DataFrame."""
    names = [f.name for f in rows.sparkSession.createDataFrame([], schema).schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [fn(r) for _, r in pdf.iterrows()]
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)


def least_squares(n: int, m: np.ndarray, s: np.ndarray) -> dict:
    """OLS of the last variable on the others (plus constant) from a gram row."""
    p = len(m) - 1
    sxx, sxy, syy = s[:p, :p], s[:p, p], s[p, p]
    inv = np.linalg.pinv(sxx)
    beta = inv @ sxy
    rss = max(float(syy - beta @ sxy), 0.0)
    dof = n - p - 1
    sigma2 = rss / dof if dof > 0 else float("nan")
    return {"beta": beta, "intercept": float(m[p] - m[:p] @ beta), "inv": inv, "rss": rss,
            "dof": dof, "se": np.sqrt(np.maximum(np.diag(inv) * sigma2, 0)),
            "r2": 1 - rss / syy if syy > 0 else float("nan"), "sigma2": sigma2}


def design(df: DataFrame, x: str, prefix: str | None = None,
           levels: Sequence[str] | None = None) -> dict[str, Column]:
    """Explanatory columns of ``x``: itself when numeric, else one indicator per level after the
    first (levels in natural order)."""
    from statweave.plans.common import levels_of, num
    from pyspark.sql.types import NumericType
    if isinstance(df.schema[x].dataType, NumericType):
        return {x: num(x)}
    levels = list(levels) if levels else levels_of(df, x, 100)
    if len(levels) < 2:
        raise ValueError(f"column {x!r} has fewer than two levels")
    txt = F.col(x).cast("string")
    return {f"{prefix or x}_{lv}": F.when(txt.isNotNull(), (txt == lv).cast("double"))
            for lv in levels[1:]}
