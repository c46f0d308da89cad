"""Rank, ECDF and ordered-pair tests; all of them read one ``cumulate`` table."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from statweave.functions import distributions as D
from statweave.plans.common import levels_of, natural_key, num, ratio, result, sq, two_levels
from statweave.plans.cumulate import count_where, cumulate
from statweave.plans.resample import permuted

c = F.col


def _clean(df, y, group, by=()):
    return df.select(*by, c(group).cast("string").alias("_g"), num(y).alias("_y")) \
             .dropna(subset=["_y", "_g", *by])


def two_sample_table(df: DataFrame, y, group: str, levels: Sequence[str], by: Sequence[str] = (),
                     lead: bool = False) -> DataFrame:
    """Distinct values with counts n1/n2, their exclusive running totals and the group sizes."""
    src = _clean(df, y, group, by).where(c("_g").isin(list(levels)))
    return cumulate(src, "_y", {"n1": count_where("_g", levels[0]), "n2": count_where("_g", levels[1])},
                    by, lead=lead)


def k_sample_table(df, y, group, levels, by=(), lead=False) -> DataFrame:
    src = _clean(df, y, group, by).where(c("_g").isin(list(levels)))
    sums = {f"n{i}": count_where("_g", lv) for i, lv in enumerate(levels)}
    return cumulate(src, "_y", {**sums, "n": F.count(F.lit(1))}, by, lead=lead)


def _tie_sum(t: Column) -> Column:
    t = t.cast("double")
    return F.sum(t * t * t - t)


def _u_summary(t: DataFrame, by: Sequence[str]) -> DataFrame:
    """Placement sums of a two-sample table: U, ties and the variance of the placements."""
    n1, n2 = c("n1").cast("double"), c("n2").cast("double")
    # share of the other sample below (half weight on ties) seen from each value
    p1 = (c("cum_n2") + c("n2") / 2) / c("tot_n2")
    p2 = (c("cum_n1") + c("n1") / 2) / c("tot_n1")
    return t.groupBy(*by).agg(
        F.sum(n1 * (c("cum_n2") + c("n2") / 2)).alias("u"), _tie_sum(c("n1") + c("n2")).alias("ties"),
        F.max("tot_n1").alias("N1"), F.max("tot_n2").alias("N2"),
        F.sum(n1 * p1).alias("s1"), F.sum(n1 * sq(p1)).alias("q1"),
        F.sum(n2 * p2).alias("s2"), F.sum(n2 * sq(p2)).alias("q2"))


def _placement_var(s, q, n):
    return ratio(q - sq(s) / n, n - 1)


def mann_whitney(df, y, group, levels=None, by=(), alternative="two-sided", test_id="T-103",
                 table: DataFrame | None = None, names=None) -> DataFrame:
    """U of the first group; rank-biserial effect with a placement-variance interval (the
    large-sample counterpart of resampling both groups)."""
    lv = names or two_levels(df, group, levels)
    s = _u_summary(table if table is not None else two_sample_table(df, y, group, lv, by), by)
    nm = c("N1").cast("double") * c("N2")
    rb = 2 * c("u") / nm - 1
    se = 2 * F.sqrt(_placement_var(c("s1"), c("q1"), c("N1")) / c("N1")
                    + _placement_var(c("s2"), c("q2"), c("N2")) / c("N2"))
    lo, hi = F.greatest(F.lit(-1.0), rb - 1.96 * se), F.least(F.lit(1.0), rb + 1.96 * se)
    return result(s, test_id, by=by, statistic=c("u"),
                  p=D.p_mann_whitney(c("u"), c("N1"), c("N2"), c("ties"), alternative),
                  effect_name="rank-biserial", effect=rb, ci=(lo, hi), n={lv[0]: c("N1"), lv[1]: c("N2")},
                  numbers={"tie_sum": c("ties"), "auc": c("u") / nm})


def brunner_munzel(df, y, group, levels=None, by=(), alternative="two-sided") -> DataFrame:
    lv = two_levels(df, group, levels)
    t = two_sample_table(df, y, group, lv, by)
    # overall minus within-group mid-rank is exactly the placement count, kept here as shares
    s = _u_summary(t, by)
    n1, n2 = c("N1").cast("double"), c("N2").cast("double")
    v1 = _placement_var(c("s1"), c("q1"), n1) * sq(n2)
    v2 = _placement_var(c("s2"), c("q2"), n2) * sq(n1)
    r1 = c("s1") / n1 * n2 + (n1 + 1) / 2
    r2 = c("s2") / n2 * n1 + (n2 + 1) / 2
    s = s.select("*", (n1 * v1 + n2 * v2).alias("pool"), v1.alias("v1"), v2.alias("v2"), (r2 - r1).alias("dr"))
    w = n1 * n2 * c("dr") / ((n1 + n2) * F.sqrt(c("pool")))
    dof = ratio(sq(c("pool")), sq(n1 * c("v1")) / (n1 - 1) + sq(n2 * c("v2")) / (n2 - 1))
    s = s.withColumn("w", w).withColumn("dof", dof)
    # the statistic grows when the second group is larger, so the tails swap
    tail = {"greater": "less", "less": "greater"}.get(alternative, alternative)
    return result(s, "T-104", by=by, statistic=c("w"), p=D.p_t(c("w"), c("dof"), tail),
                  effect_name="P(X>Y)", effect=c("u") / (n1 * n2), n={lv[0]: c("N1"), lv[1]: c("N2")},
                  numbers={"df": c("dof")})


def kruskal(df, y, group, levels=None, by=(), alternative="two-sided") -> DataFrame:
    lv = [str(v) for v in levels] if levels else levels_of(df, group)
    t = k_sample_table(df, y, group, lv, by)
    mid = c("cum_n") + (c("n") + 1) / 2
    s = t.groupBy(*by).agg(
        *[F.sum(c(f"n{i}") * mid).alias(f"r{i}") for i in range(len(lv))],
        *[F.max(f"tot_n{i}").alias(f"N{i}") for i in range(len(lv))],
        F.max("tot_n").alias("N"), _tie_sum(c("n")).alias("ties"))
    n = c("N").cast("double")
    rank_part = sum((F.coalesce(ratio(sq(c(f"r{i}")), c(f"N{i}")), F.lit(0.0)) for i in range(len(lv))), F.lit(0.0))
    k = sum(((c(f"N{i}") > 0).cast("int") for i in range(len(lv))), F.lit(0))
    corr = 1 - c("ties") / (n * sq(n) - n)
    s = s.select("*", k.alias("k"), ratio(12 / (n * (n + 1)) * rank_part - 3 * (n + 1), corr).alias("h"))
    eps = F.when(n > c("k"), F.greatest(F.lit(0.0), (c("h") - c("k") + 1) / (n - c("k")))).otherwise(0.0)
    return result(s, "T-123", by=by, statistic=c("h"), p=D.p_chi2(c("h"), c("k") - 1),
                  effect_name="epsilon^2", effect=eps, n={"groups": c("k"), "total": c("N")},
                  numbers={"df": c("k") - 1, **{f"mean_rank_{v}": ratio(c(f"r{i}"), c(f"N{i}"))
                                                for i, v in enumerate(lv)}})


def pooled_contrast(df, y, group, weights, levels=None, by=(), alternative="two-sided") -> DataFrame:
    """Positive-weight groups pooled against negative-weight groups, ranked."""
    from statweave.operators.group_tests import _need_three, check_weights
    lv = _need_three(df, group, levels)
    ws = check_weights(weights, lv)
    plus = [v for v, w in zip(lv, ws) if w > 0]
    minus = [v for v, w in zip(lv, ws) if w < 0]
    txt = c(group).cast("string")
    side = F.when(txt.isin(plus), "pooled+").when(txt.isin(minus), "pooled-")
    src = df.select(*by, side.alias("_side"), num(y).alias("_v"))
    return mann_whitney(src, "_v", "_side", ["pooled+", "pooled-"], by, alternative, "T-1104")


# ------------------------------------------------------------------ ordered alternatives
def jonckheere(df, y, group, levels=None, by=(), alternative="two-sided") -> DataFrame:
    lv = [str(v) for v in levels] if levels else levels_of(df, group)
    if len(lv) < 3:
        raise ValueError(f"need at least three ordered groups, found {len(lv)}")
    t = k_sample_table(df, y, group, lv, by)
    k = len(lv)
    below = lambda j: sum((c(f"cum_n{i}") for i in range(j)), F.lit(0))
    tied = lambda j: sum((c(f"n{i}") for i in range(j)), F.lit(0))
    jt = sum((c(f"n{j}").cast("double") * (below(j) + tied(j) / 2) for j in range(1, k)), F.lit(0.0))
    con = sum((c(f"n{j}").cast("double") * below(j) for j in range(1, k)), F.lit(0.0))
    tie_pair = sum((c(f"n{j}").cast("double") * tied(j) for j in range(1, k)), F.lit(0.0))
    nn = c("n").cast("double")
    s = t.groupBy(*by).agg(F.sum(jt).alias("jt"), F.sum(con).alias("con"), F.sum(tie_pair).alias("tp"),
                           F.sum(nn * (nn - 1) / 2).alias("ty"), F.max("tot_n").alias("N"),
                           *[F.max(f"tot_n{i}").alias(f"N{i}") for i in range(k)])
    sizes = [c(f"N{i}").cast("double") for i in range(k)]
    n = c("N").cast("double")
    mean = (sq(n) - sum((sq(v) for v in sizes), F.lit(0.0))) / 4
    var = (sq(n) * (2 * n + 3) - sum((sq(v) * (2 * v + 3) for v in sizes), F.lit(0.0))) / 72
    all_pairs = n * (n - 1) / 2
    tx = sum((v * (v - 1) / 2 for v in sizes), F.lit(0.0))
    between = all_pairs - tx                       # pairs in different groups
    dis = between - c("con") - c("tp")
    tau = ratio(c("con") - dis, F.sqrt(between * (all_pairs - c("ty"))))
    s = s.withColumn("z", F.coalesce(ratio(c("jt") - mean, F.sqrt(var)), F.lit(0.0))).withColumn("tau", tau)
    kk = sum(((v > 0).cast("int") for v in sizes), F.lit(0))
    return result(s, "T-501", by=by, statistic=c("z"), p=D.p_z(c("z"), alternative), effect_name="tau-b",
                  effect=c("tau"), n={"groups": kk, "total": c("N")}, numbers={"jt": c("jt")})


# ------------------------------------------------------------------ distribution shape
def ks_two_sample(df, y, group, levels=None, by=(), alternative="two-sided") -> DataFrame:
    lv = two_levels(df, group, levels)
    t = two_sample_table(df, y, group, lv, by)
    gap = (c("cum_n1") + c("n1")) / c("tot_n1") - (c("cum_n2") + c("n2")) / c("tot_n2")
    pick = {"greater": F.max(gap), "less": F.max(-gap)}.get(alternative, F.max(F.abs(gap)))
    s = t.groupBy(*by).agg(F.greatest(F.lit(0.0), pick).alias("d"), F.max("tot_n1").alias("N1"),
                           F.max("tot_n2").alias("N2"))
    return result(s, "T-701", by=by, statistic=c("d"), p=D.p_ks(c("d"), c("N1"), c("N2"), alternative),
                  effect_name="D", effect=c("d"), n={lv[0]: c("N1"), lv[1]: c("N2")})


def cramer_von_mises(df, y, group, levels=None, by=(), alternative="two-sided") -> DataFrame:
    lv = two_levels(df, group, levels)
    t = two_sample_table(df, y, group, lv, by)
    n1, n2 = c("n1").cast("double"), c("n2").cast("double")
    # average pooled rank of a tie block; within-sample ranks run through the block one by one
    rank = c("cum_n1") + c("cum_n2") + (n1 + n2 + 1) / 2

    def dev(n, cum):      # sum over i = 1..n of (rank - cum - i)^2
        a = rank - cum
        return n * sq(a) - a * n * (n + 1) + n * (n + 1) * (2 * n + 1) / 6

    s = t.groupBy(*by).agg(F.sum(dev(n1, c("cum_n1"))).alias("q1"), F.sum(dev(n2, c("cum_n2"))).alias("q2"),
                           F.max("tot_n1").alias("N1"), F.max("tot_n2").alias("N2"))
    a, b = c("N1").cast("double"), c("N2").cast("double")
    u = a * c("q1") + b * c("q2")
    s = s.withColumn("t", u / (a * b * (a + b)) - (4 * a * b - 1) / (6 * (a + b)))
    return result(s, "T-704", by=by, statistic=c("t"), p=D.p_cvm(c("t"), c("N1"), c("N2")),
                  n={lv[0]: c("N1"), lv[1]: c("N2")})


def _ad_stat(t: DataFrame, k: int, by) -> DataFrame:
    """Mid-rank Anderson-Darling sum over the pooled distinct values."""
    n, l = c("tot_n").cast("double"), c("n").cast("double")
    b = c("cum_n") + l / 2
    den = b * (n - b) - n * l / 4
    inner = F.lit(0.0)
    for i in range(k):
        mij = c(f"cum_n{i}") + c(f"n{i}") / 2
        inner = inner + F.coalesce(ratio(sq(n * mij - b * c(f"tot_n{i}")), c(f"tot_n{i}")), F.lit(0.0))
    term = F.coalesce(ratio(l / n * inner, den), F.lit(0.0))
    return t.groupBy(*by).agg((F.sum(term) * (F.max("tot_n") - 1) / F.max("tot_n")).alias("a2"), F.max("tot_n").alias("N"),
                              *[F.max(f"tot_n{i}").alias(f"N{i}") for i in range(k)])


def _harmonic(n: float) -> tuple[float, float]:
    """Sums of 1/i and of 1/i^2 up to n; from 32 on by their asymptotic series, which is exact there to rounding."""
    if n < 32:
        i = np.arange(1, int(n) + 1)
        return float(np.sum(1 / i)), float(np.sum(1 / i ** 2))
    h = math.log(n) + 0.57721566490153286 + 1 / (2 * n) - 1 / (12 * n ** 2) + 1 / (120 * n ** 4) - 1 / (252 * n ** 6)
    return h, math.pi ** 2 / 6 - 1 / n + 1 / (2 * n ** 2) - 1 / (6 * n ** 3) + 1 / (30 * n ** 5) - 1 / (42 * n ** 7)


def _ad_norm(n: float, sizes: Sequence[float]) -> tuple[float, float]:
    """Mean and sd of the statistic under the null (Scholz & Stephens 1987); its double sum over 1 / ((n - i) j) is H2(n) - (2 H(n) - 1/n) / n."""
    k, big_h = len(sizes), sum(1 / v for v in sizes)
    hn, h2 = _harmonic(n)
    h, g = hn - 1 / n, h2 - (2 * hn - 1 / n) / n
    a = (4 * g - 6) * (k - 1) + (10 - 6 * g) * big_h
    b = (2 * g - 4) * k ** 2 + 8 * h * k + (2 * g - 14 * h - 4) * big_h - 8 * h + 4 * g - 6
    d = (6 * h + 2 * g - 2) * k ** 2 + (4 * h - 4 * g + 6) * k + (2 * h - 6) * big_h + 4 * h
    e = (2 * h + 6) * k ** 2 - 4 * h * k
    var = (a * n ** 3 + b * n ** 2 + d * n + e) / ((n - 1) * (n - 2) * (n - 3))
    return k - 1, math.sqrt(var)


def _relabelled_p(table: DataFrame, s: DataFrame, stat: str, by: list[str], levels: Sequence[str], reps: int, seed: int, terms, scale: Column, slack: float,
                  bounds=None) -> DataFrame:
    """``s`` with column perm_p: how often ``scale`` of the summed terms reaches the statistic when labels are dealt anew in each stratum. ``bounds(deal, first, last, sizes)`` gives the
    least and the greatest statistic (reps each) that the label counts of buckets allow: replicates that these decide are not drawn further."""
    names = [f"N{i}" for i in range(len(levels))]
    sizes = {tuple(r[:len(by)]): list(r[len(by):]) for r in s.select(*[c(x).cast("string") for x in by], *names).collect()}
    sure: list[int] = []                                           # replicates that reach the statistic by their bounds

    def unsure(deal, first, last, whole):
        low, high = bounds(deal, first, last, whole)
        at = s.select(stat).first()[0] - slack
        margin = 1e-9 * abs(at)                                    # bounds are rounded otherwise than sums
        sure.append(int((low >= at + margin).sum()))
        return np.flatnonzero((low < at + margin) & (high >= at - margin))

    per = permuted(table, "_y", sizes, reps, terms, ["t"], by, seed, unsure=unsure if bounds and not by else None)
    if bounds and not by and sure:
        at = s.select(stat).first()[0] - slack
        return s.withColumn("perm_p", F.lit((sum(sure) + per.where(scale >= at).count() + 1) / (reps + 1)))
    seen = s.select(*[c(x).cast("string").alias(f"_s{i}") for i, x in enumerate(by)], stat, *names)
    joined = per.join(F.broadcast(seen), [c(x) == c(f"_s{i}") for i, x in enumerate(by)]) if by else per.crossJoin(F.broadcast(seen))
    p = joined.groupBy(*by).agg(((F.sum((scale >= c(stat) - slack).cast("long")) + 1) / (F.count("t") + 1)).alias("perm_p"))
    if not by:
        return s.withColumn("perm_p", F.lit(p.first()[0]))
    p = p.select(*[c(x).alias(f"_p{i}") for i, x in enumerate(by)], "perm_p")
    return s.join(p, [c(x).cast("string") == c(f"_p{i}") for i, x in enumerate(by)], "left").drop(*[f"_p{i}" for i in range(len(by))])


def _ad_terms(part: pd.DataFrame, before: np.ndarray, k: np.ndarray, total: np.ndarray) -> np.ndarray:
    n, ties = part["tot_n"].to_numpy(float), part["n"].to_numpy(float)
    b = part["cum_n"].to_numpy(float) + ties / 2
    den = b * (n - b) - n * ties / 4
    weight = np.divide(ties / n, den, out=np.zeros_like(den), where=den > 0)
    some = total > 0
    m = n[:, None, None] * (before[..., some] + k[..., some] / 2) - b[:, None, None] * total[some]
    return (weight[:, None] * (m ** 2 / total[some]).sum(axis=2)).sum(axis=0)[:, None]


def _energy_terms(part: pd.DataFrame, before: np.ndarray, k: np.ndarray, total: np.ndarray) -> np.ndarray:
    gap = ((before + k) / total) @ np.array([1.0, -1.0])
    width = np.nan_to_num(part["next_value"].to_numpy(float) - part["v"].to_numpy(float))
    return (gap ** 2 * width[:, None]).sum(axis=0)[:, None]


def _energy_bounds(deal: np.ndarray, first: np.ndarray, last: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest energy distance with these label counts per bucket: inside a bucket each distribution function lies between its values at the bucket's ends."""
    at = np.cumsum(deal, axis=0) / total
    pre = at - deal / total
    high, low = at[..., 0] - pre[..., 1], pre[..., 0] - at[..., 1]
    width = np.append(first[1:], last[-1]) - first
    least = np.where((low <= 0) & (high >= 0), 0.0, np.minimum(np.abs(low), np.abs(high)))
    return tuple(np.sqrt(2 * width @ gap ** 2) for gap in (least, np.maximum(np.abs(low), np.abs(high))))


def anderson_darling(df, y, group, levels=None, by=(), key: Sequence[str] | None = None,
                     permutations: int = 0, seed: int = 0) -> DataFrame:
    """k-sample statistic on the whole table, standardised as usual; p from ``permutations``
    exact relabellings when asked, otherwise left to the critical-value interpolation."""
    lv = [str(v) for v in levels] if levels else levels_of(df, group)
    table = k_sample_table(df, y, group, lv, by, lead=bool(permutations))
    s = _ad_stat(table, len(lv), by)

    @F.pandas_udf("struct<z double, p double>")
    def finish(a2: pd.Series, n: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        # fixed values: b0, b1, b2 of the published critical-value table at these levels
        sig = np.array([0.25, 0.1, 0.05, 0.025, 0.01, 0.005, 0.001])
        b0 = np.array([0.675, 1.281, 1.645, 1.96, 2.326, 2.573, 3.085])
        b1 = np.array([-0.245, 0.25, 0.678, 1.149, 1.822, 2.364, 3.615])
        b2 = np.array([-0.105, -0.305, -0.362, -0.391, -0.396, -0.345, -0.154])
        rows = []
        for v, m, ns in zip(a2, n, sizes):
            ns = [x for x in ns if x > 0]
            if len(ns) < 2 or m < 4:
                rows.append((float("nan"), float("nan")))
                continue
            mean, sd = _ad_norm(float(m), ns)
            z = (v - mean) / sd
            root = math.sqrt(len(ns) - 1)
            crit = b0 + b1 / root + b2 / (len(ns) - 1)
            fit = np.polyfit(crit, np.log(sig), 2)
            p = sig[0] if z < crit[0] else sig[-1] if z > crit[-1] else math.exp(np.polyval(fit, z))
            rows.append((z, float(p)))
        return pd.DataFrame(rows, columns=["z", "p"])

    s = s.withColumn("_f", finish("a2", "N", F.array(*[c(f"N{i}") for i in range(len(lv))])))
    p = c("_f.p")
    if permutations:
        s = _relabelled_p(table, s, "a2", list(by), lv, permutations, seed, _ad_terms, c("t") * (sum(c(f"N{i}") for i in range(len(lv))) - 1) / sum(c(f"N{i}") for i in range(len(lv))), 1e-9)
        p = c("perm_p")
    groups = sum(((c(f"N{i}") > 0).cast("int") for i in range(len(lv))), F.lit(0))
    return result(s, "T-702", by=by, statistic=c("_f.z"), p=p, n={"groups": groups, "total": c("N")},
                  numbers={"a2": c("a2")})


def _energy_of(t: DataFrame, by) -> DataFrame:
    gap = (c("cum_n1") + c("n1")) / c("tot_n1") - (c("cum_n2") + c("n2")) / c("tot_n2")
    width = F.coalesce(c("next_value") - c(t.columns[len(by)]), F.lit(0.0))
    return t.groupBy(*by).agg(F.sqrt(2 * F.sum(sq(gap) * width)).alias("e"), F.sum(F.abs(gap) * width).alias("w1"),
                              F.max("tot_n1").alias("N1"), F.max("tot_n2").alias("N2"))


def energy_distance(df, y, group, levels=None, by=(), key: Sequence[str] | None = None,
                    permutations: int = 999, seed: int = 0) -> DataFrame:
    """1-D energy distance (twice the squared CDF gap, integrated) and Wasserstein-1; p by ``permutations`` exact relabellings, none where that is 0. Labels are dealt to values, so
    rows need no key."""
    lv = two_levels(df, group, levels)
    table = two_sample_table(df, y, group, lv, by, lead=True)
    s = _energy_of(table, list(by))
    p = None
    if permutations:
        both = table.select(*by, "_y", (c("n1") + c("n2")).alias("n"), (c("cum_n1") + c("cum_n2")).alias("cum_n"), (c("tot_n1") + c("tot_n2")).alias("tot_n"), "next_value")
        s = _relabelled_p(both, s.withColumnsRenamed({"N1": "N0", "N2": "N1"}), "e", list(by), lv, permutations, seed, _energy_terms, F.sqrt(2 * c("t")), 1e-12, _energy_bounds).withColumnsRenamed({"N1": "N2", "N0": "N1"})
        p = c("perm_p")
    return result(s, "T-703", by=by, statistic=c("e"), p=p, effect_name="energy distance", effect=c("e"),
                  n={lv[0]: c("N1"), lv[1]: c("N2")}, numbers={"wasserstein": c("w1")})


def level_scores(levels: Sequence[str]) -> list[float]:
    """Scores of ordered levels: their own value when all are numbers, else 0, 1, 2, ..."""
    keys = [natural_key(v) for v in levels]
    return [k[1] for k in keys] if all(k[0] == 0 for k in keys) else [float(i) for i in range(len(levels))]
