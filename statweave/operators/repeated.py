"""Repeated measures: paired tests, subject x occasion tables, random-intercept models."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from statweave.functions import distributions as D
from statweave.plans.common import levels_of, num, ratio, result, sq
from statweave.plans.cumulate import cumulate
from statweave.plans.gram import gram, per_row, unpack
from statweave.plans.reshape import subject_by_occasion

c = F.col


def paired_rows(df, y, group, subject, levels=None, by=()) -> tuple[DataFrame, list[str]]:
    """One row per subject with both occasions and the difference first minus second."""
    wide, cols, lv = subject_by_occasion(df, subject, group, y, levels, by)
    if len(lv) != 2:
        raise ValueError(f"need exactly two occasions, found {len(lv)}")
    return wide.select(*by, "_subject", c("o0").alias("a"), c("o1").alias("b"), (c("o0") - c("o1")).alias("d")), lv


def paired_t(df, y, group, subject, levels=None, by=(), alternative="two-sided") -> DataFrame:
    p, _ = paired_rows(df, y, group, subject, levels, by)
    s = p.groupBy(*by).agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("sd"))
    s = s.withColumn("t", ratio(c("m"), c("sd") / F.sqrt("n")))
    half = D.q_t(0.975, c("n") - 1) * c("sd") / F.sqrt("n")
    dz = F.coalesce(ratio(c("m"), c("sd")), c("m"))
    return result(s, "T-111", by=by, statistic=c("t"), p=D.p_t(c("t"), c("n") - 1, alternative), effect_name="dz",
                  effect=dz, n={"pairs": c("n")}, numbers={"mean_diff": c("m"), "diff_ci_low": c("m") - half, "diff_ci_high": c("m") + half})


def wilcoxon(df, y, group, subject, levels=None, by=(), alternative="two-sided") -> DataFrame:
    """Signed rank of non-zero differences; two-sided reports the smaller rank sum."""
    by = list(by)
    p, _ = paired_rows(df, y, group, subject, levels, by)
    zeros = p.groupBy(*by).agg(F.count("d").alias("pairs"), F.sum((c("d") == 0).cast("long")).alias("zeros"))
    nz = p.where("d <> 0").select(*by, F.abs("d").alias("_v"), (c("d") > 0).cast("long").alias("_pos"))
    t = cumulate(nz, "_v", {"n": F.count(F.lit(1)), "pos": F.sum("_pos")}, by)
    rank = c("cum_n") + (c("n") + 1) / 2
    n = c("n").cast("double")
    s = t.groupBy(*by).agg(F.sum(c("pos") * rank).alias("wp"), F.sum((c("n") - c("pos")) * rank).alias("wm"),
                           F.sum(n * n * n - n).alias("ties"), F.max("tot_n").alias("n"))
    from statweave.operators.association import _merge
    s = _merge([s, zeros], by)
    stat = F.least("wp", "wm") if alternative == "two-sided" else c("wp")
    return result(s, "T-112", by=by, statistic=stat, p=D.p_signed_rank(c("wp"), c("n"), c("ties"), c("zeros"), alternative),
                  effect_name="matched rank-biserial", effect=ratio(c("wp") - c("wm"), c("wp") + c("wm")),
                  n={"pairs": c("pairs"), "nonzero": c("n")}, numbers={"w_plus": c("wp"), "w_minus": c("wm")})


def sign_test(df, y, group, subject, levels=None, by=(), alternative="two-sided") -> DataFrame:
    p, _ = paired_rows(df, y, group, subject, levels, by)
    cnt = lambda cond: F.sum(cond.cast("long"))
    s = p.groupBy(*by).agg(F.count("d").alias("n"), cnt(c("d") > 0).alias("pos"), cnt(c("d") < 0).alias("neg"),
                           cnt(c("d") == 0).alias("tie"))
    m = c("pos") + c("neg")
    return result(s, "T-113", by=by, statistic=c("pos"), p=D.p_binom_half(c("pos"), m, alternative),
                  effect_name="share positive", effect=F.coalesce(ratio(c("pos"), m), F.lit(0.0)),
                  ci=(D.clopper_pearson(c("pos"), m, False), D.clopper_pearson(c("pos"), m, True)),
                  n={"pairs": c("n"), "+": c("pos"), "-": c("neg"), "tie": c("tie")})


def rm_anova(df, y, group, subject, levels=None, by=(), alternative="two-sided") -> DataFrame:
    """Occasion effect over complete subjects from row, column and grand sums of squares."""
    wide, cols, lv = subject_by_occasion(df, subject, group, y, levels, by)
    k = len(cols)
    row = sum((c(o) for o in cols), F.lit(0.0)) / k
    within = sum((sq(c(o) - row) for o in cols), F.lit(0.0))
    s = wide.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(within).alias("w"), *[F.avg(o).alias(o) for o in cols])
    grand = sum((c(o) for o in cols), F.lit(0.0)) / k
    sst = c("n") * sum((sq(c(o) - grand) for o in cols), F.lit(0.0))
    s = s.withColumn("sst", sst)
    d1, d2 = F.lit(float(k - 1)), (c("n") - 1) * float(k - 1)
    s = s.withColumn("d2", d2).withColumn("f", ratio(c("sst") / d1, (c("w") - c("sst")) / d2))
    return result(s, "T-131", by=by, statistic=c("f"), p=D.p_f(c("f"), d1, c("d2")), effect_name="partial eta^2",
                  effect=c("f") * d1 / (c("f") * d1 + c("d2")), n={"subjects": c("n"), "occasions": F.lit(k)},
                  numbers={f"mean_{v}": c(o) for v, o in zip(lv, cols)})


def _row_ranks(cols: Sequence[str]) -> list:
    """Mid-rank of each occasion inside its subject's row."""
    return [sum(((c(o) < c(q)).cast("double") + (c(o) == c(q)).cast("double") / 2 for o in cols), F.lit(0.5)) for q in cols]


def friedman(df, y, group, subject, levels=None, by=(), alternative="two-sided") -> DataFrame:
    wide, cols, lv = subject_by_occasion(df, subject, group, y, levels, by)
    if len(lv) < 3:
        raise ValueError(f"need at least three occasions, found {len(lv)}")
    k = len(cols)
    ranks = _row_ranks(cols)
    ties = sum((sq(sum(((c(o) == c(q)).cast("double") for o in cols), F.lit(0.0))) - 1 for q in cols), F.lit(0.0))
    s = wide.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(ties).alias("ties"),
                              *[F.sum(r).alias(f"r{i}") for i, r in enumerate(ranks)])
    n = c("n").cast("double")
    ssb = sum((sq(c(f"r{i}")) for i in range(k)), F.lit(0.0))
    corr = 1 - c("ties") / (n * k * (k * k - 1))
    s = s.withColumn("chi2", ratio(12 / (n * k * (k + 1)) * ssb - 3 * n * (k + 1), corr))
    return result(s, "T-132", by=by, statistic=c("chi2"), p=D.p_chi2(c("chi2"), F.lit(float(k - 1))), effect_name="Kendall W",
                  effect=c("chi2") / (n * (k - 1)), n={"subjects": c("n"), "occasions": F.lit(k)},
                  numbers={f"mean_rank_{v}": c(f"r{i}") / n for i, v in enumerate(lv)})


def cochran_q(df, y, group, subject, levels=None, by=(), alternative="two-sided") -> DataFrame:
    wide, cols, lv = subject_by_occasion(df, subject, group, y, levels, by, numeric=False)
    if len(lv) < 3:
        raise ValueError(f"need at least three occasions, found {len(lv)}")
    vals = levels_of(df, y, 2)
    hit = sorted(vals)[-1]
    one = [(c(o) == hit).cast("double") for o in cols]
    k = len(cols)
    row = sum(one, F.lit(0.0))
    s = wide.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("tot"), F.sum(sq(row)).alias("rr"),
                              *[F.sum(v).alias(f"c{i}") for i, v in enumerate(one)])
    cc = sum((sq(c(f"c{i}")) for i in range(k)), F.lit(0.0))
    s = s.withColumn("q", ratio((k - 1) * (k * cc - sq(c("tot"))), k * c("tot") - c("rr")))
    rates = [c(f"c{i}") / c("n") for i in range(k)]
    return result(s, "T-212", by=by, statistic=c("q"), p=D.p_chi2(c("q"), F.lit(float(k - 1))), effect_name="rate range",
                  effect=F.greatest(*rates) - F.least(*rates), n={"subjects": c("n"), "occasions": F.lit(k)},
                  numbers={f"rate_{v}": r for v, r in zip(lv, rates)})


def sphericity(df, y, group, subject, levels=None, limit: float = 3.0) -> DataFrame:
    """C-06: largest over smallest variance of pairwise occasion differences."""
    wide, cols, _ = subject_by_occasion(df, subject, group, y, levels)
    g = gram(wide, cols)
    k = len(cols)

    def finish(r):
        n, _, s = unpack(r, k)
        cov = s / (n - 1)
        v = [cov[i, i] + cov[j, j] - 2 * cov[i, j] for i in range(k) for j in range(i + 1, k)]
        return {"n": n, "ratio": max(v) / max(min(v), 1e-300)}

    s = per_row(g, finish, "n bigint, ratio double")
    return s.select(F.lit("C-06").alias("check"), F.when(c("ratio") < limit, "ok").otherwise("violated").alias("verdict"), "n", "ratio")


# ------------------------------------------------------------------ random intercept
def _dummies(levels: Sequence[str], col: str) -> list:
    return [(c(col) == v).cast("double") for v in levels[1:]]


def random_intercept(df, y, subject, terms: dict[str, Column], test_terms: Sequence[str], by=(),
                     reml: bool = True, test_id="T-133") -> DataFrame:
    """y on ``terms`` plus a random intercept per subject.

    Subjects reduce to sums (map-side partials, so one huge subject is no hot spot), subjects of
    equal size reduce to one outer-product row, and the variance ratio is a 1-D search."""
    by = list(by)
    names = list(terms)
    p = len(names) + 1
    src = df.select(*by, c(subject).alias("_s"), num(y).alias("_y"), *[v.alias(f"x{i}") for i, v in enumerate(terms.values())]).dropna()
    shift = src.agg(F.avg("_y")).first()[0] or 0.0
    src = src.withColumn("_y", c("_y") - F.lit(shift)).withColumn("one", F.lit(1.0))
    cols = ["one", *[f"x{i}" for i in range(len(names))], "_y"]
    pr = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    per = src.groupBy(*by, "_s").agg(*[F.sum(v).alias(f"s{i}") for i, v in enumerate(cols)],
                                     *[F.sum(c(cols[i]) * c(cols[j])).alias(f"q{i}_{j}") for i, j in pr])
    size = per.groupBy(*by, c("s0").alias("size")).agg(
        F.count(F.lit(1)).alias("m"), F.array(*[F.sum(f"q{i}_{j}") for i, j in pr]).alias("q"),
        F.array(*[F.sum(c(f"s{i}") * c(f"s{j}")) for i, j in pr]).alias("o"))
    rows = size.groupBy(*by).agg(F.collect_list(F.struct("size", "m", "q", "o")).alias("t"))
    want = [names.index(v) + 1 for v in test_terms]

    def finish(r):
        t = r["t"]
        get = lambda key: np.array([list(u[key]) if key in "qo" else u[key] for u in t], float)
        ni, m, q, o = get("size"), get("m"), get("q"), get("o")

        def square(v):
            a = np.zeros((p + 1, p + 1))
            for x, (i, j) in zip(v, pr):
                a[i, j] = a[j, i] = x
            return a

        big_n, total = float((ni * m).sum()), square(q.sum(axis=0))

        def at(rho):
            k = total - square((rho / (1 + ni * rho)) @ o)
            a, b, yy = k[:p, :p], k[:p, p], k[p, p]
            beta = np.linalg.lstsq(a, b, rcond=None)[0]
            rss = max(float(yy - b @ beta), 1e-300)
            logdet = float((m * np.log1p(ni * rho)).sum())
            dof = big_n - p if reml else big_n
            ll = -0.5 * (dof * np.log(rss / dof) + logdet + (np.linalg.slogdet(a)[1] if reml else 0.0))
            return ll, beta, a, rss / dof

        grid = np.concatenate([[-np.inf], np.linspace(-14, 8, 89)])
        vals = [at(np.exp(g))[0] for g in grid]
        best = int(np.argmax(vals))
        if best == 0:
            rho = 0.0
        else:
            lo, hi = grid[max(best - 1, 1)], grid[min(best + 1, len(grid) - 1)]
            gold = (np.sqrt(5) - 1) / 2
            for _ in range(80):
                u, v = hi - gold * (hi - lo), lo + gold * (hi - lo)
                lo, hi = (lo, v) if at(np.exp(u))[0] > at(np.exp(v))[0] else (u, hi)
            rho = float(np.exp((lo + hi) / 2))
        _, beta, a, s2 = at(rho)
        cov = s2 * np.linalg.pinv(a)
        sub = np.ix_(want, want)
        wald = float(beta[want] @ np.linalg.pinv(cov[sub]) @ beta[want])
        se = float(np.sqrt(cov[want[0], want[0]]))
        return {**{b: r[b] for b in by}, "wald": wald, "df": len(want), "b": float(beta[want[0]]), "se": se, "icc": rho / (1 + rho),
                "rows": int(big_n), "subjects": int(m.sum()), "coef": [float(v) for v in beta[want]]}

    s = per_row(rows, finish, ", ".join([f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by]
                                        + ["wald double", "df int", "b double", "se double", "icc double", "rows bigint",
                                           "subjects bigint", "coef array<double>"]))
    z = 1.959963984540054
    return result(s, test_id, by=by, statistic=c("wald"), p=D.p_chi2(c("wald"), c("df")), effect_name=test_terms[0], effect=c("b"),
                  ci=(c("b") - z * c("se"), c("b") + z * c("se")), n={"subjects": c("subjects"), "rows": c("rows")},
                  numbers={"icc": c("icc"), "df": c("df"), **{t: c("coef")[i] for i, t in enumerate(test_terms)}})


def mixed_repeated(df, y, group, subject, levels=None, by=(), alternative="two-sided") -> DataFrame:
    lv = [str(v) for v in levels] if levels else levels_of(df, group)
    if len(lv) < 2:
        raise ValueError("need at least two occasions")
    src = df.withColumn("_g", c(group).cast("string")).where(c("_g").isin(lv))
    terms = {f"{v} vs {lv[0]}": d for v, d in zip(lv[1:], _dummies(lv, "_g"))}
    return random_intercept(src, y, subject, terms, list(terms), by)


def mixed_interaction(df, y, a, b, subject, alternative="two-sided") -> DataFrame:
    """Full a x b fixed effects by maximum likelihood; Wald test of the product terms."""
    la, lb = levels_of(df, a), levels_of(df, b)
    src = df.withColumn("_a", c(a).cast("string")).withColumn("_b", c(b).cast("string"))
    da, db = dict(zip(la[1:], _dummies(la, "_a"))), dict(zip(lb[1:], _dummies(lb, "_b")))
    main = {f"{a}={k}": v for k, v in da.items()} | {f"{b}={k}": v for k, v in db.items()}
    prod = {f"{a}={i}:{b}={j}": u * v for i, u in da.items() for j, v in db.items()}
    if not prod:
        raise ValueError("need two factors with at least two levels each")
    return random_intercept(src, y, subject, main | prod, list(prod), reml=False, test_id="T-404")
