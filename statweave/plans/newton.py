"""Maximum likelihood by Newton steps: each step is one distributed aggregation of the
log-likelihood, gradient and Hessian; all strata advance in the same job."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

MAX_STRATA = 10_000


@dataclass
class Fit:
    theta: np.ndarray
    cov: np.ndarray
    loglik: float
    n: int
    converged: bool
    gradient: float = float("nan")        # largest entry of the mean score where the steps ended

    def wald(self, i: int) -> tuple[float, float, float]:
        se = float(np.sqrt(max(self.cov[i, i], 0)))
        est = float(self.theta[i])
        return est, se, est / se if se > 0 else float("nan")


def with_theta(df: DataFrame, thetas: dict[tuple, np.ndarray], by: Sequence[str]) -> DataFrame:
    """Parameters beside the rows: literals when there is one stratum, a join otherwise."""
    if not by:
        return df.withColumn("_theta", F.array(*[F.lit(float(v)) for v in thetas[()]]))
    rows = [(*[str(k) for k in key], [float(v) for v in th]) for key, th in thetas.items()]
    schema = ", ".join(f"`{c}` string" for c in by) + ", _theta array<double>"
    return df.join(df.sparkSession.createDataFrame(rows, schema), list(by))


def newton(df: DataFrame, by: Sequence[str], start: Callable[[dict], np.ndarray],
           terms: Callable[[list[Column]], tuple[Column, list[Column], dict]], size: int,
           prepare: dict[str, Column] | None = None, max_iter: int = 60, tol: float = 1e-10,
           totals: Callable[[DataFrame, list[Column]], DataFrame] | None = None) -> dict[tuple, Fit]:
    """``terms(theta) -> (loglik, gradient list, {(i, j): hessian})`` per row; ``prepare`` adds
    per-stratum summaries handed to ``start``.  Likelihoods that are not sums over rows give
    ``totals(rows with _theta, theta)`` instead: columns ll, g<i>, h<i>_<j> per stratum."""
    by = list(by)
    df = df.withColumns({c: F.col(c).cast("string") for c in by}).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"),
                                    *[c.alias(k) for k, c in (prepare or {}).items()])
        heads = first.limit(MAX_STRATA + 1).collect()
        if len(heads) > MAX_STRATA:
            raise ValueError(f"more than {MAX_STRATA} strata for an iterative fit")
        key = lambda r: tuple(r[c] for c in by)
        theta = {key(r): np.asarray(start(r.asDict()), float) for r in heads}
        count = {key(r): r["_n"] for r in heads}
        best: dict[tuple, float] = {}
        step: dict[tuple, np.ndarray] = {}
        fits: dict[tuple, Fit] = {}
        for it in range(max_iter):
            live = {k: v for k, v in theta.items() if k not in fits}
            if not live:
                break
            th = [F.element_at("_theta", i + 1) for i in range(size)]
            rows = with_theta(df, live, by)
            if totals is not None:
                table = totals(rows, th)
                hess = {(i, j): None for i in range(size) for j in range(i, size)}
            else:
                ll, grad, hess = terms(th)
                table = rows.groupBy(*by).agg(
                    F.sum(ll).alias("ll"), *[F.sum(g).alias(f"g{i}") for i, g in enumerate(grad)],
                    *[F.sum(h).alias(f"h{i}_{j}") for (i, j), h in hess.items()])
            for r in table.collect():
                k = key(r)
                now = r["ll"] if r["ll"] is not None and np.isfinite(r["ll"]) else -np.inf
                if k in best and now < best[k] - 1e-9 * max(1.0, abs(best[k])):
                    step[k] = step[k] / 2                     # overshoot: halve and retry
                    theta[k] = theta[k] - step[k]
                    if np.max(np.abs(step[k])) < 1e-12:
                        fits[k] = Fit(theta[k], np.full((size, size), np.nan), best[k], count[k], False)
                    continue
                g = np.array([r[f"g{i}"] or 0.0 for i in range(size)])
                h = np.zeros((size, size))
                for (i, j) in hess:
                    h[i, j] = h[j, i] = r[f"h{i}_{j}"] or 0.0
                delta = np.linalg.lstsq(-h, g, rcond=None)[0]
                best[k] = now
                done = float(abs(g @ delta)) < tol * max(1.0, abs(now)) * 1e-2 or np.max(np.abs(delta)) < 1e-9
                if done or it == max_iter - 1:
                    fits[k] = Fit(theta[k] + (delta if done else 0), np.linalg.pinv(-h), now, count[k], bool(done), float(np.max(np.abs(g))) / max(1, count[k]))
                else:
                    step[k] = delta
                    theta[k] = theta[k] + delta
        for k, v in theta.items():
            if k not in fits:
                fits[k] = Fit(v, np.full((size, size), np.nan), best.get(k, float("nan")), count[k], False)
        return fits
    finally:
        df.unpersist()


def linear(theta: list[Column], xs: Sequence[str]) -> Column:
    """intercept + sum of coefficients times columns."""
    eta = theta[0]
    for t, x in zip(theta[1:], xs):
        eta = eta + t * F.col(x)
    return eta


def outer(weight: Column, xs: Sequence[Column]) -> dict[tuple[int, int], Column]:
    return {(i, j): weight * xs[i] * xs[j] for i in range(len(xs)) for j in range(i, len(xs))}
