"""Association, trend over a numeric axis, and agreement of two measurements."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from statweave.functions import distributions as D
from statweave.plans.common import fisher_z_ci, num, ratio, result, sq
from statweave.plans.cumulate import cumulate, quantiles, ranked
from statweave.plans.dominance import concordance, pair_sums
from statweave.plans.gram import design, gram, per_row, unpack
from statweave.plans.resample import bootstrap_sums, percentile_ci
from statweave.plans.slopes import ascending_pairs, laid_out, slopes_of_chunks

c = F.col


def pairs(df: DataFrame, y, x, by: Sequence[str] = ()) -> DataFrame:
    return df.select(*by, num(y).alias("y"), num(x).alias("x")).dropna(subset=["y", "x", *by])


def _r_result(s, test_id, by, name, alternative, statistic=None, numbers=None, k=0):
    """``s`` holds r and n; p from the t transform with n-2-k degrees."""
    dof = c("n") - 2 - k
    s = s.withColumn("t", c("r") * F.sqrt(ratio(dof, 1 - sq(c("r")))))
    p = F.when(F.abs(c("r")) >= 1, 0.0).otherwise(D.p_t(c("t"), dof, alternative))
    return result(s, test_id, by=by, statistic=statistic if statistic is not None else c("r"), p=p,
                  effect_name=name, effect=c("r"), ci=fisher_z_ci(c("r"), c("n") - k), n={"pairs": c("n")},
                  numbers=numbers)


def pearson(df, y, x, by=(), alternative="two-sided") -> DataFrame:
    s = pairs(df, y, x, by).groupBy(*by).agg(F.corr("y", "x").alias("r"), F.count("y").alias("n"))
    return _r_result(s, "T-301", by, "r", alternative)


def spearman(df, y, x, by=(), alternative="two-sided") -> DataFrame:
    p = ranked(ranked(pairs(df, y, x, by), "y", "ry", by), "x", "rx", by)
    s = p.groupBy(*by).agg(F.corr("ry", "rx").alias("r"), F.count("y").alias("n"))
    return _r_result(s, "T-302", by, "rho", alternative)


def _tie_pairs(p: DataFrame, col: str, by) -> DataFrame:
    n = c("n").cast("double")
    t = p.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    return t.groupBy(*by).agg(F.sum(n * (n - 1) / 2).alias(f"t_{col}"),
                              F.sum(n * (n - 1) * (n - 2)).alias(f"t3_{col}"),
                              F.sum(n * (n - 1) * (2 * n + 5)).alias(f"t5_{col}"), F.sum("n").alias("n"))


def _merge(frames: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Join one-row-per-stratum summaries."""
    keys = list(by) or ["_one"]
    frames = [f if by else f.withColumn("_one", F.lit(1)) for f in frames]
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, keys)
    return out


def kendall(df, y, x, by=(), alternative="two-sided", test_id="T-303") -> DataFrame:
    """tau-b from exact pair counts in N log N (no pair is materialised)."""
    p = pairs(df, y, x, by)
    n = c("n").cast("double")
    n0 = n * (n - 1) / 2
    if by:
        s = _merge([concordance(p, "x", "y", by), _tie_pairs(p, "x", by), _tie_pairs(p, "y", by).drop("n")], by)
    else:                                                          # one stratum: its points move once, the descending pairs are the rest
        con, same = ascending_pairs(p.select("x", "y", F.lit(1).alias("n")))
        s = _merge([_tie_pairs(p, "x", by), _tie_pairs(p, "y", by).drop("n")], by).withColumn("con", F.lit(float(con)))
        s = s.withColumn("dis", F.coalesce(n0 - c("t_x") - c("t_y") + float(same) - c("con"), F.lit(0.0)))
    score = c("con") - c("dis")
    s = s.withColumn("s", score).withColumn("tau", ratio(score, F.sqrt((n0 - c("t_x")) * (n0 - c("t_y")))))
    m = n * (n - 1)
    var = ((m * (2 * n + 5) - c("t5_x") - c("t5_y")) / 18 + ratio(2 * c("t_x") * c("t_y"), m)
           + ratio(c("t3_x") * c("t3_y"), 9 * m * (n - 2)))
    s = s.withColumn("z", F.coalesce(ratio(c("s"), F.sqrt(var)), F.lit(0.0)))
    return result(s, test_id, by=by, statistic=c("tau") if test_id == "T-303" else c("s"),
                  p=D.p_z(c("z"), alternative), effect_name="tau", effect=c("tau"), n={"pairs": c("n")},
                  numbers={"s": c("s"), "z": c("z"), "tau": c("tau"), "var_s": var})


def sen_slope(df: DataFrame, y, x, var_s: float, sample: int = 100_000, listed: int = 2_000_000, seed: int = 0) -> tuple[float, float, float]:
    """Median pairwise slope with its 95 % limits, the slopes at ranks that follow from ``var_s``; one rule at every size (``plans/slopes.py``)."""
    p = pairs(df, y, x)
    box = p.agg(F.avg("x"), F.avg("y"), F.count("x")).first()
    n = box[2]
    points = p.select((c("x") - F.lit(box[0])).alias("x"), (c("y") - F.lit(box[1])).alias("y"), F.lit(1).alias("n")) if n else p.withColumn("n", F.lit(1))
    chunks, rows, weights, tied = laid_out(points)
    total = n * (n - 1) // 2 - tied
    if total == 0:
        return float("nan"), float("nan"), float("nan")
    half = 1.959963984540054 * math.sqrt(max(var_s, 0.0))
    lo = max(int(round((total - half) / 2)) - 1, 0)
    hi = min(int(round((total + half) / 2)), total - 1)
    a, b, low, high = slopes_of_chunks(points, chunks, weights, rows, [(total - 1) // 2, total // 2, lo, hi], total, sample, listed, seed)
    return (a + b) / 2, low, high


def mann_kendall(df, y, x, alternative="two-sided", slope: bool = True) -> DataFrame:
    base = kendall(df, y, x, alternative=alternative, test_id="T-503")
    if not slope:
        return base
    row = base.first()
    est, lo, hi = sen_slope(df, y, x, row["numbers"]["var_s"])
    one = df.sparkSession.range(1)
    return result(one, "T-503", statistic=F.lit(row["statistic"]), p=F.lit(row["p"]), effect_name="Sen slope",
                  effect=F.lit(est), ci=(F.lit(lo), F.lit(hi)), n={"points": F.lit(row["n"]["pairs"])},
                  numbers={"tau": F.lit(row["numbers"]["tau"])})


def trend_ols(df, y, x, by=(), alternative="two-sided") -> DataFrame:
    s = pairs(df, y, x, by).groupBy(*by).agg(
        F.count("y").alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"),
        F.regr_r2("y", "x").alias("r2"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"))
    dof = c("n") - 2
    s = s.withColumn("se", F.sqrt(ratio(c("syy") * (1 - c("r2")), dof * c("sxx"))))
    s = s.withColumn("t", ratio(c("b"), c("se")))
    half = D.q_t(0.975, dof) * c("se")
    return result(s, "T-504", by=by, statistic=c("t"), p=D.p_t(c("t"), dof, alternative), effect_name="slope",
                  effect=c("b"), ci=(c("b") - half, c("b") + half), n={"points": c("n")},
                  numbers={"r2": c("r2"), "intercept": c("a"), "se": c("se")})


# ------------------------------------------------------------------ distance correlation
def _row_means(p: DataFrame, col: str, by) -> DataFrame:
    """Per distinct value: mean distance to all rows, from running counts and sums."""
    t = cumulate(p, col, {"n": F.count(F.lit(1)).cast("double"), "s": F.sum(col)}, by)
    v = c(col)
    total = (v * (2 * c("cum_n") + c("n") - c("tot_n")) - (2 * c("cum_s") + c("s") - c("tot_s")))
    return t.select(*by, v.alias(f"_{col}v"), (total / c("tot_n")).alias(f"d{col}"))


def distance_parts(df: DataFrame, y, x, by: Sequence[str] = ()) -> DataFrame:
    """Per stratum: n and the squared distance (co)variances of the V-statistic."""
    by = list(by)
    p = pairs(df, y, x, by)
    mid = p.groupBy(*by).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    if by:
        p = p.join(mid, by).select(*by, (c("x") - c("_mx")).alias("x"), (c("y") - c("_my")).alias("y"))
    else:
        m = mid.first()
        p = p.select((c("x") - F.lit(m[0])).alias("x"), (c("y") - F.lit(m[1])).alias("y"))
    ax, ay = _row_means(p, "x", by), _row_means(p, "y", by)
    q = p.join(ax.withColumnsRenamed({b: f"_1{b}" for b in by}),
               [p[b].eqNullSafe(c(f"_1{b}")) for b in by] + [c("x") == c("_xv")])
    q = q.join(ay.withColumnsRenamed({b: f"_2{b}" for b in by}),
               [c(b).eqNullSafe(c(f"_2{b}")) for b in by] + [c("y") == c("_yv")])
    means = q.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("dx").alias("ax"), F.avg("dy").alias("ay"),
        F.avg(c("dx") * c("dy")).alias("axy"), F.avg(sq(c("dx"))).alias("axx"), F.avg(sq(c("dy"))).alias("ayy"),
        F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    n, xc, yc = c("n"), c("x"), c("y")
    sums = ["n", "x", "y", "xy"]
    t = pair_sums(p, "x", "y", {"n": n, "x": n * xc, "y": n * yc, "xy": n * xc * yc}, sums, sums, by)
    signed = lambda l, r: 2 * c(f"below_{l}_{r}") + c(f"tie_{l}_{r}") - c(f"all_{l}_{r}")
    term = signed("n", "xy") - signed("y", "x") - signed("x", "y") + signed("xy", "n")
    s = _merge([means, t.select(*by, term.alias("pxy"))], by)
    # mean of (a_ij)^2 over all ordered pairs is 2 var; same for b
    return s.select(*by, "n", (2 * c("pxy") / sq(c("n")) + c("ax") * c("ay") - 2 * c("axy")).alias("dxy"),
                    (2 * c("vx") + sq(c("ax")) - 2 * c("axx")).alias("dxx"),
                    (2 * c("vy") + sq(c("ay")) - 2 * c("ayy")).alias("dyy"),
                    "ax", "ay", "axx", "ayy", "axy", "pxy", "vx", "vy")


def distance_correlation(df, y, x, by=(), alternative="greater") -> DataFrame:
    """dCor of the whole table in N log N.  p from the chi-square bound on the bias-corrected
    statistic (n * bcdcor + 1 ~ chi2_1), which needs no relabelling of the table."""
    s = distance_parts(df, y, x, by)
    dcor = F.sqrt(F.greatest(F.lit(0.0), ratio(c("dxy"), F.sqrt(c("dxx") * c("dyy")))))
    n = c("n")

    def unbiased(mean_prod, a, b, cross):   # U-centred inner product from row and grand means
        return (sq(n) * mean_prod - 2 * sq(n) * n / (n - 2) * cross + sq(n) * sq(n) / ((n - 1) * (n - 2)) * a * b) / (n * (n - 3))

    uxy = unbiased(2 * c("pxy") / sq(n), c("ax"), c("ay"), c("axy"))
    uxx = unbiased(2 * c("vx"), c("ax"), c("ax"), c("axx"))
    uyy = unbiased(2 * c("vy"), c("ay"), c("ay"), c("ayy"))
    s = s.select(*by, "n", F.coalesce(dcor, F.lit(0.0)).alias("dcor"),
                 F.coalesce(ratio(uxy, F.sqrt(uxx * uyy)), F.lit(0.0)).alias("bc"))
    return result(s, "T-304", by=by, statistic=c("dcor"), p=D.p_chi2(F.greatest(F.lit(0.0), n * c("bc") + 1), F.lit(1.0)),
                  effect_name="dCor", effect=c("dcor"), n={"pairs": n}, numbers={"bias_corrected": c("bc")})


def bicor(df, y, x, by=(), alternative="two-sided") -> DataFrame:
    """Biweight midcorrelation: medians, then unscaled MADs, then one weighted aggregate."""
    by = list(by)
    p = pairs(df, y, x, by)

    def attach(frame, stats):
        if by:
            return frame.join(stats, by)
        r = stats.first()
        return frame.withColumns({k: F.lit(r[k]) for k in stats.columns})

    for v in ("y", "x"):
        p = attach(p, quantiles(p, v, [0.5], by).select(*by, c("q0").alias(f"m{v}")))
        dev = p.select(*by, F.abs(c(v) - c(f"m{v}")).alias("_d"))
        p = attach(p, quantiles(dev, "_d", [0.5], by).select(*by, c("q0").alias(f"d{v}")))

    def weighted(v, m, d):
        u = (c(v) - c(m)) / (9 * F.when(c(d) == 0, 1e-12).otherwise(c(d)))
        return F.when(F.abs(u) < 1, sq(1 - sq(u)) * (c(v) - c(m))).otherwise(0.0)

    p = p.select(*by, weighted("y", "my", "dy").alias("a"), weighted("x", "mx", "dx").alias("b"), "y", "x")
    s = p.groupBy(*by).agg(F.count("a").alias("n"), F.sum(c("a") * c("b")).alias("ab"),
                           F.sqrt(F.sum(sq(c("a")))).alias("sa"), F.sqrt(F.sum(sq(c("b")))).alias("sb"),
                           F.corr("y", "x").alias("pearson"))
    guard = lambda k: F.when(c(k) == 0, 1e-12).otherwise(c(k))
    s = s.withColumn("r", c("ab") / (guard("sa") * guard("sb")))
    t = c("r") * F.sqrt((c("n") - 2) / F.greatest(F.lit(1e-12), 1 - sq(c("r"))))
    return _r_result(s, "T-305", by, "bicor", alternative, statistic=t, numbers={"pearson": c("pearson")})


def partial_correlation(df, y, x, control: str, by=(), alternative="two-sided") -> DataFrame:
    """Correlation of y and x after both are regressed on ``control`` (numeric or indicators)."""
    z = design(df, control)
    from statweave.plans.gram import complete_cases
    names = [f"z{i}" for i in range(len(z))]
    data = complete_cases(df, {**dict(zip(names, z.values())), "x": num(x), "y": num(y)}, by)
    g = gram(data, [*names, "x", "y"], by)
    k = len(names)

    def finish(row):
        n, _, s = unpack(row, k + 2)
        zz, zv = s[:k, :k], s[:k, k:]
        rest = s[k:, k:] - zv.T @ np.linalg.pinv(zz) @ zv
        raw = s[k, k + 1] / math.sqrt(s[k, k] * s[k + 1, k + 1])
        return {**{b: row[b] for b in by}, "n": n, "raw": raw,
                "r": rest[0, 1] / math.sqrt(rest[0, 0] * rest[1, 1])}

    schema = ", ".join([f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by]
                       + ["n bigint", "raw double", "r double"])
    s = per_row(g, finish, schema)
    dof = c("n") - 2
    s = s.withColumn("t", c("r") * F.sqrt(ratio(dof, 1 - sq(c("r")))))
    return result(s, "T-311", by=by, statistic=c("r"), p=D.p_t(c("t"), dof, alternative), effect_name="partial r",
                  effect=c("r"), ci=fisher_z_ci(c("r"), c("n") - k), n={"pairs": c("n")}, numbers={"raw_r": c("raw")})


def proportionality(df, y, x, by=(), alternative="two-sided", test_id="T-321") -> DataFrame:
    """phi and rho_p of two positive parts; rows with a non-positive part are counted apart."""
    p = pairs(df, y, x, by)
    ok = (c("y") > 0) & (c("x") > 0)
    ly, lx = F.when(ok, F.ln("y")), F.when(ok, F.ln("x"))
    s = p.groupBy(*by).agg(F.var_samp(ly).alias("vy"), F.var_samp(lx).alias("vx"), F.var_samp(ly - lx).alias("vr"),
                           F.count(ly).alias("n"), F.sum((~ok).cast("long")).alias("dropped"))
    rho = F.when(c("vy") + c("vx") > 0, 1 - c("vr") / (c("vy") + c("vx"))).otherwise(0.0)
    return result(s, test_id, by=by, statistic=F.when(c("vy") > 0, c("vr") / c("vy")), effect_name="rho_p",
                  effect=rho, n={"pairs": c("n"), "dropped": c("dropped")}, numbers={"log_ratio_var": c("vr")})


# ------------------------------------------------------------------ agreement of measurements
def _pair_sums(df, y, x, by):
    p = pairs(df, y, x, by)
    return p.groupBy(*by).agg(F.count("y").alias("n"), F.avg("y").alias("my"), F.avg("x").alias("mx"),
                              F.var_pop("y").alias("vy"), F.var_pop("x").alias("vx"), F.covar_pop("y", "x").alias("cov"))


def _icc_exprs(n, my, mx, vy, vx, cov):
    """Two raters: mean squares of subjects, raters, residual from pair moments."""
    ms_r = n * (vy + vx + 2 * cov) / 2 / (n - 1)
    ms_c = n * sq(my - mx) / 2
    ms_e = n * (vy + vx - 2 * cov) / 2 / (n - 1)
    return ms_r, ms_e, F.coalesce(ratio(ms_r - ms_e, ms_r + ms_e + 2 * (ms_c - ms_e) / n), F.lit(0.0))


def _boot_pair(df, y, x, key, by, reps, seed, expr) -> DataFrame:
    p = df.select(*by, *key, num(y).alias("_y"), num(x).alias("_x"))
    off = p.agg(F.avg("_y"), F.avg("_x")).first()
    p = p.select(*by, *key, (c("_y") - F.lit(off[0])).alias("y"), (c("_x") - F.lit(off[1])).alias("x"))
    p = p.withColumns({"yy": sq(c("y")), "xx": sq(c("x")), "xy": c("x") * c("y")})
    b = bootstrap_sums(p, key, ["y", "x", "yy", "xx", "xy"], reps, by, seed)
    w = c("w")
    my, mx = c("s_y") / w, c("s_x") / w
    val = expr(w, my + F.lit(off[0]), mx + F.lit(off[1]), c("s_yy") / w - sq(my), c("s_xx") / w - sq(mx),
               c("s_xy") / w - my * mx)
    return percentile_ci(b.withColumn("v", val), c("v"), by)


def _with_boot(s, df, y, x, key, by, reps, seed, expr):
    if not key:
        return s.withColumns({"ci_low": F.lit(None).cast("double"), "ci_high": F.lit(None).cast("double")})
    ci = _boot_pair(df, y, x, list(key), list(by), reps, seed, expr)
    if by:
        s = s.withColumns({b: c(b).cast("string") for b in by})
    return _merge([s, ci], by)


def icc(df, y, x, by=(), alternative="two-sided", key: Sequence[str] = (), reps=500, seed=0) -> DataFrame:
    """ICC(2,1) of two ratings; bootstrap interval over rows when ``key`` identifies them."""
    s = _with_boot(_pair_sums(df, y, x, by), df, y, x, key, by, reps, seed, lambda *a: _icc_exprs(*a)[2])
    ms_r, ms_e, val = _icc_exprs(*(c(k) for k in ("n", "my", "mx", "vy", "vx", "cov")))
    s = s.select("*", val.alias("icc"), F.coalesce(ratio(ms_r, ms_e), F.lit(float("inf"))).alias("f"))
    return result(s, "T-601", by=by, statistic=c("f"), p=D.p_f(c("f"), c("n") - 1, c("n") - 1),
                  effect_name="ICC(2,1)", effect=c("icc"), ci=(c("ci_low"), c("ci_high")),
                  n={"subjects": c("n"), "raters": F.lit(2)})


def bland_altman(df, y, x, by=(), alternative="two-sided") -> DataFrame:
    d = c("y") - c("x")
    s = pairs(df, y, x, by).groupBy(*by).agg(F.count("y").alias("n"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd"),
                                             F.corr((c("y") + c("x")) / 2, d).alias("prop"))
    se = c("sd") / F.sqrt(c("n"))
    s = s.withColumn("t", ratio(c("bias"), se)).withColumn("se", se)
    half = D.q_t(0.975, c("n") - 1) * c("se")
    tp = c("prop") * F.sqrt(ratio(c("n") - 2, 1 - sq(c("prop"))))
    return result(s, "T-602", by=by, statistic=c("t"), p=D.p_t(c("t"), c("n") - 1, alternative), effect_name="bias",
                  effect=c("bias"), ci=(c("bias") - half, c("bias") + half), n={"pairs": c("n")},
                  numbers={"loa_low": c("bias") - 1.96 * c("sd"), "loa_high": c("bias") + 1.96 * c("sd"),
                           "proportional_r": c("prop"), "proportional_p": D.p_t(tp, c("n") - 2)})


def _ccc_expr(n, my, mx, vy, vx, cov):
    return F.coalesce(ratio(2 * cov, vy + vx + sq(my - mx)), F.lit(0.0))


def lins_ccc(df, y, x, by=(), alternative="two-sided", key: Sequence[str] = (), reps=500, seed=0) -> DataFrame:
    s = _with_boot(_pair_sums(df, y, x, by), df, y, x, key, by, reps, seed, _ccc_expr)
    s = s.withColumn("ccc", _ccc_expr(*(c(k) for k in ("n", "my", "mx", "vy", "vx", "cov"))))
    r = ratio(c("cov"), F.sqrt(c("vy") * c("vx")))
    return result(s, "T-603", by=by, effect_name="CCC", effect=c("ccc"), ci=(c("ci_low"), c("ci_high")),
                  n={"pairs": c("n")}, numbers={"r": r, "bias_factor": F.coalesce(ratio(c("ccc"), r), F.lit(0.0))})
