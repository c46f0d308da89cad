"""Mean comparisons between groups: everything follows from one table of group moments."""
from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from statweave.functions import distributions as D
from statweave.plans.common import levels_of, num, ratio, result, sq, two_levels
from statweave.plans.cumulate import cumulate
from statweave.plans.moments import group_moments, hedges_g, pair_moments, sums_of_squares
from statweave.plans.resample import level_sums, permuted

c = F.col


def _welch_parts(n1, v1, n2, v2):
    a, b = ratio(v1, n1), ratio(v2, n2)
    return F.sqrt(a + b), ratio(sq(a + b), sq(a) / (n1 - 1) + sq(b) / (n2 - 1))


def mean_difference(df: DataFrame, y, group: str, levels=None, by: Sequence[str] = (),
                    alternative: str = "two-sided", test_id: str = "T-101",
                    equal_var: bool = False, effect: str = "g") -> DataFrame:
    lv = two_levels(df, group, levels)
    m = pair_moments(df, y, group, lv, by)
    n1, m1, v1, n2, m2, v2 = (c(k) for k in ("n1", "m1", "v1", "n2", "m2", "v2"))
    se, dof = _welch_parts(n1, v1, n2, v2)
    g, g_lo, g_hi = hedges_g(n1, m1, v1, n2, m2, v2)
    m = m.select("*", (m1 - m2).alias("diff"), se.alias("se"), dof.alias("wdf"),
                 g.alias("g"), g_lo.alias("g_lo"), g_hi.alias("g_hi"))
    half = D.q_t(0.975, c("wdf")) * c("se")
    if equal_var:
        pooled = ratio((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)
        m = m.withColumn("t", ratio(c("diff"), F.sqrt(pooled * (1 / n1 + 1 / n2)))).withColumn("df", n1 + n2 - 2)
    else:
        m = m.withColumn("t", ratio(c("diff"), c("se"))).withColumn("df", c("wdf"))
    eff = ("Hedges g", c("g"), (c("g_lo"), c("g_hi"))) if effect == "g" else (
        "mean diff", c("diff"), (c("diff") - half, c("diff") + half))
    return result(m, test_id, by=by, statistic=c("t"), p=D.p_t(c("t"), c("df"), alternative),
                  effect_name=eff[0], effect=eff[1], ci=eff[2], n={lv[0]: n1, lv[1]: n2},
                  numbers={"df": c("df"), "mean_diff": c("diff"), "se": c("se"),
                           "diff_ci_low": c("diff") - half, "diff_ci_high": c("diff") + half})


def welch_t(df, y, group, levels=None, by=(), alternative="two-sided", **kw):
    return mean_difference(df, y, group, levels, by, alternative, **kw)


def student_t(df, y, group, levels=None, by=(), alternative="two-sided"):
    return mean_difference(df, y, group, levels, by, alternative, "T-102", equal_var=True)


def _relabelled_sums(df: DataFrame, y: str, group: str, levels: Sequence[str], reps: int, seed: int, rows_per_block: int) -> tuple[DataFrame, list[int]]:
    """(b, s0, s1, ...): the sum of ``y`` in each level under exact relabellings, and the levels' sizes."""
    found = {r[0]: r[1] for r in df.groupBy(c(group).cast("string")).agg(F.count(F.lit(1))).collect()}
    sizes = [found.get(v, 0) for v in levels]
    table = cumulate(df, y, {"n": F.count(F.lit(1))}, lead=True)
    return permuted(table, y, {(): sizes}, reps, level_sums, [f"s{i}" for i in range(len(levels))], seed=seed, rows=rows_per_block), sizes


def permutation_t(df, y, group, key: Sequence[str] = (), levels=None, alternative="two-sided",
                  reps: int = 2000, seed: int = 0, rows_per_block: int = 20_000) -> DataFrame:
    """Mean difference against ``reps`` exact relabellings over the whole table; labels are dealt to values, so rows need no key."""
    lv = two_levels(df, group, levels)
    src = df.where(c(group).cast("string").isin(lv)).select(group, num(y).alias("_v")).dropna()
    base = welch_t(src, "_v", group, lv, effect="diff")
    s, sizes = _relabelled_sums(src, "_v", group, lv, reps, seed, rows_per_block)
    per = s.select((c("s0") / sizes[0] - c("s1") / sizes[1]).alias("d"))
    obs = base.first()
    d0 = float(obs["effect"]["value"])
    tol = 1e-12 * max(1.0, abs(d0))
    tails = per.agg(F.sum((c("d") >= d0 - tol).cast("long")).alias("ge"),
                    F.sum((c("d") <= d0 + tol).cast("long")).alias("le"), F.count("d").alias("k"))
    ge, le = (c("ge") + 1) / (c("k") + 1), (c("le") + 1) / (c("k") + 1)
    p = {"greater": ge, "less": le}.get(alternative, F.least(F.lit(1.0), 2 * F.least(ge, le)))
    e = obs["effect"]
    return result(tails, "T-105", statistic=F.lit(d0), p=p, effect_name="mean diff",
                  effect=F.lit(d0), ci=(F.lit(e["ci_low"]), F.lit(e["ci_high"])),
                  n={k: F.lit(v) for k, v in obs["n"].items()}, numbers={"reps": c("k")})


def anova(df, y, group, by=(), alternative="two-sided", test_id="T-121") -> DataFrame:
    s = sums_of_squares(group_moments(df, y, group, by), by)
    f = ratio(c("ssb") / (c("k") - 1), c("ssw") / (c("total") - c("k")))
    s = s.withColumn("f", f)
    return result(s, test_id, by=by, statistic=c("f"), p=D.p_f(c("f"), c("k") - 1, c("total") - c("k")),
                  effect_name="eta^2", effect=F.coalesce(ratio(c("ssb"), c("ssb") + c("ssw")), F.lit(0.0)),
                  n={"groups": c("k"), "total": c("total")},
                  numbers={"df1": c("k") - 1, "df2": c("total") - c("k"), "ssb": c("ssb"), "ssw": c("ssw")})


def alexander_govern(df, y, group, by=(), alternative="two-sided", test_id="T-122") -> DataFrame:
    """Heteroscedastic k-group comparison by normalised t scores."""
    m = group_moments(df, y, group, by)
    w = Window.partitionBy(*(by or [F.lit(0)]))
    inv = ratio(c("n"), c("var"))
    m = m.withColumn("pooled", F.sum(inv * c("mean")).over(w) / F.sum(inv).over(w))
    t = ratio(c("mean") - c("pooled"), F.sqrt(c("var") / c("n")))
    v = c("n") - 1
    a = v - 0.5
    b = 48 * sq(a)
    cc = F.sqrt(a * F.log1p(sq(t) / v))
    z = (cc + (F.pow(cc, F.lit(3.0)) + 3 * cc) / b
         - (4 * F.pow(cc, F.lit(7.0)) + 33 * F.pow(cc, F.lit(5.0)) + 240 * F.pow(cc, F.lit(3.0)) + 855 * cc)
         / (10 * sq(b) + 8 * b * F.pow(cc, F.lit(4.0)) + 1000 * b))
    grand = F.sum(c("n") * c("mean")).over(w) / F.sum("n").over(w)
    s = m.select("*", z.alias("z"), grand.alias("grand")).groupBy(*by).agg(
        F.sum(sq(c("z"))).alias("a"), F.count("z").alias("k"), F.sum("n").alias("total"),
        F.sum(c("n") * sq(c("mean") - c("grand"))).alias("ssb"), F.sum((c("n") - 1) * c("var")).alias("ssw"))
    return result(s, test_id, by=by, statistic=c("a"), p=D.p_chi2(c("a"), c("k") - 1),
                  effect_name="eta^2", effect=F.coalesce(ratio(c("ssb"), c("ssb") + c("ssw")), F.lit(0.0)),
                  n={"groups": c("k"), "total": c("total")}, numbers={"df": c("k") - 1})


def welch_anova(df, y, group, by=(), alternative="two-sided") -> DataFrame:
    """Welch's own heteroscedastic F."""
    m = group_moments(df, y, group, by)
    w = Window.partitionBy(*(by or [F.lit(0)]))
    wt = ratio(c("n"), c("var"))
    m = m.select("*", wt.alias("w"), F.sum(wt).over(w).alias("sw"),
                 (F.sum(wt * c("mean")).over(w) / F.sum(wt).over(w)).alias("gm"))
    s = m.groupBy(*by).agg(
        F.count("w").alias("k"), F.sum("n").alias("total"),
        F.sum(c("w") * sq(c("mean") - c("gm"))).alias("a"),
        F.sum(sq(1 - c("w") / c("sw")) / (c("n") - 1)).alias("lam"))
    k = c("k")
    s = s.withColumn("f", (c("a") / (k - 1)) / (1 + 2 * (k - 2) / (sq(k) - 1) * c("lam"))) \
         .withColumn("df2", (sq(k) - 1) / (3 * c("lam")))
    return result(s, "welch-anova", by=by, statistic=c("f"), p=D.p_f(c("f"), k - 1, c("df2")),
                  n={"groups": k, "total": c("total")}, numbers={"df1": k - 1, "df2": c("df2")})


def permutation_f(df, y, group, key: Sequence[str] = (), reps: int = 999, seed: int = 0,
                  rows_per_block: int = 20_000) -> DataFrame:
    """One-way F against exact relabellings; only SSB moves, so group sums per replicate do."""
    src = df.select(group, num(y).alias("_v")).dropna()
    lv = levels_of(src, group)
    obs = anova(src, "_v", group).first()
    s, sizes = _relabelled_sums(src, "_v", group, lv, reps, seed, rows_per_block)
    # for a fixed total, F is increasing in sum(s^2 / n)
    per = s.select(sum((sq(c(f"s{i}")) / n for i, n in enumerate(sizes)), F.lit(0.0)).alias("q"))
    mom = group_moments(src, "_v", group).agg(F.sum(sq(c("n") * c("mean")) / c("n"))).first()[0]
    hits = per.agg(F.sum((c("q") >= mom * (1 - 1e-12)).cast("long")).alias("ge"), F.count("q").alias("k"))
    return result(hits, "T-124", statistic=F.lit(obs["statistic"]), p=(c("ge") + 1) / (c("k") + 1),
                  effect_name="eta^2", effect=F.lit(obs["effect"]["value"]),
                  n={k: F.lit(v) for k, v in obs["n"].items()}, numbers={"reps": c("k")})


# ------------------------------------------------------------------ planned comparisons
def _contrast_rows(df, y, group, by, weights: dict[str, list[float]], levels) -> DataFrame:
    """(by, contrast) -> value, se, t, df for contrast name -> weights in level order."""
    m = group_moments(df, y, group, by).withColumn("_lv", c(group).cast("string"))
    pos = F.create_map(*[x for i, lv in enumerate(levels) for x in (F.lit(lv), F.lit(i))])
    w = Window.partitionBy(*(by or [F.lit(0)]))
    m = m.select("*", (F.sum((c("n") - 1) * c("var")).over(w) / (F.sum("n").over(w) - F.count("n").over(w))).alias("mse"),
                 (F.sum("n").over(w) - F.count("n").over(w)).alias("df"), pos[c("_lv")].alias("_i"))
    table = F.array(*[F.struct(F.lit(k).alias("contrast"), F.array(*[F.lit(float(v)) for v in ws]).alias("w"))
                      for k, ws in weights.items()])
    x = m.select("*", F.explode(table).alias("_t")).select(
        *by, "n", "mean", "mse", "df", c("_t.contrast").alias("contrast"), c("_t.w")[c("_i")].alias("wt"))
    s = x.groupBy(*by, "contrast").agg(
        F.sum(c("wt") * c("mean")).alias("value"), F.first("df").alias("df"), F.sum("n").alias("total"),
        F.sqrt(F.first("mse") * F.sum(sq(c("wt")) / c("n"))).alias("se"))
    return s.withColumn("t", F.coalesce(ratio(c("value"), c("se")), F.lit(0.0)))


def _need_three(df, group, levels):
    lv = [str(v) for v in levels] if levels else levels_of(df, group)
    if len(lv) < 3:
        raise ValueError(f"need at least three groups, found {len(lv)}")
    return lv


def check_weights(weights, levels) -> list[float]:
    if not weights or len(weights) != len(levels):
        raise ValueError(f"need one weight per level in order {levels}")
    if abs(sum(weights)) > 1e-9:
        raise ValueError("contrast weights must sum to 0")
    return [float(v) for v in weights]


def planned_contrast(df, y, group, weights, levels=None, by=(), alternative="two-sided") -> DataFrame:
    lv = _need_three(df, group, levels)
    s = _contrast_rows(df, y, group, by, {"planned": check_weights(weights, lv)}, lv)
    half = D.q_t(0.975, c("df")) * c("se")
    return result(s, "T-1101", by=by, statistic=c("t"), p=D.p_t(c("t"), c("df"), alternative),
                  effect_name="contrast", effect=c("value"), ci=(c("value") - half, c("value") + half),
                  n={"total": c("total")}, numbers={"df": c("df"), "se": c("se")})


def helmert(df, y, group, levels=None, by=(), alternative="two-sided") -> DataFrame:
    """One row per orthogonal contrast: each level against the mean of the later ones."""
    lv = _need_three(df, group, levels)
    k = len(lv)
    sets = {lv[j]: [0.0] * j + [float(k - j - 1)] + [-1.0] * (k - j - 1) for j in range(k - 1)}
    s = _contrast_rows(df, y, group, by, sets, lv)
    half = D.q_t(0.975, c("df")) * c("se")
    return result(s, "T-1103", by=[*by, "contrast"], statistic=c("t"), p=D.p_t(c("t"), c("df"), alternative),
                  effect_name="Helmert contrast", effect=c("value"), ci=(c("value") - half, c("value") + half),
                  n={"total": c("total")}, numbers={"df": c("df"), "se": c("se")})


def dunnett(df, y, group, control: str, levels=None, by=(), alternative="two-sided") -> DataFrame:
    """Every level against ``control`` with the simultaneous (max-t) p and interval."""
    lv = _need_three(df, group, levels)
    if str(control) not in lv:
        raise ValueError(f"control {control!r} is not one of {lv}")
    m = group_moments(df, y, group, by).withColumn("_lv", c(group).cast("string"))
    w = Window.partitionBy(*(by or [F.lit(0)]))
    is_c = c("_lv") == F.lit(str(control))
    ctl = lambda k: F.max(F.when(is_c, c(k))).over(w)
    dof = F.sum("n").over(w) - F.count("n").over(w)
    m = m.select("*", ctl("n").alias("nc"), ctl("mean").alias("mc"), dof.alias("df"),
                 (F.sum((c("n") - 1) * c("var")).over(w) / dof).alias("mse"),
                 F.collect_list(F.when(~is_c, c("n"))).over(w).alias("others"))
    m = m.where(~is_c).select("*", (c("mean") - c("mc")).alias("diff"),
                              F.sqrt(c("mse") * (1 / c("n") + 1 / c("nc"))).alias("se"))
    m = m.withColumn("t", ratio(c("diff"), c("se")))
    two = alternative == "two-sided"

    @F.pandas_udf("struct<p double, crit double>")
    def finish(t: pd.Series, nc: pd.Series, others: pd.Series, dof: pd.Series) -> pd.DataFrame:
        rows = []
        for tv, n0, no, d in zip(t, nc, others, dof):
            lam = [(v / (v + n0)) ** 0.5 for v in no]
            x = abs(tv) if two else (tv if alternative == "greater" else -tv)
            lo, hi = 0.0, 50.0
            for _ in range(50):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if D.dunnett_sf(mid, lam, d, two) > 0.05 else (lo, mid)
            rows.append((D.dunnett_sf(x, lam, d, two), hi))
        return pd.DataFrame(rows, columns=["p", "crit"])

    m = m.withColumn("_f", finish("t", "nc", "others", "df"))
    half = c("_f.crit") * c("se")
    lo = c("diff") - half if alternative != "less" else F.lit(float("-inf"))
    hi = c("diff") + half if alternative != "greater" else F.lit(float("inf"))
    return result(m.withColumn("comparison", c("_lv")), "T-1102", by=[*by, "comparison"], statistic=c("t"),
                  p=c("_f.p"), effect_name=f"difference from {control}", effect=c("diff"), ci=(lo, hi),
                  n={"level": c("n"), "control": c("nc")}, numbers={"df": c("df"), "se": c("se")})
