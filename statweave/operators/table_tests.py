"""Contingency-table tests, rates over ordered groups, and agreement of categories."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from statweave.functions import distributions as D
from statweave.operators.rank_tests import level_scores
from statweave.plans.common import levels_of, num, ratio, result, sq, two_levels
from statweave.plans.contingency import crosstab, observed, shape, with_margins

c = F.col


def _summary(df, y, group, by) -> DataFrame:
    """Per stratum: chi2, Yates chi2, G, table shape, total, and the four cells when 2x2."""
    by = list(by)
    cells = crosstab(df.dropna(subset=by) if by else df, y, group, by)
    size = shape(cells, by)
    g = observed(cells, by)
    g = g.join(size, by) if by else g.crossJoin(F.broadcast(size))
    o, e = c("o").cast("double"), c("row_n").cast("double") * c("col_n") / c("n")
    cell = lambda a, b: F.coalesce(F.sum(F.when((c("a") == c(f"a_{a}")) & (c("b") == c(f"b_{b}")), c("o"))), F.lit(0))
    s = g.groupBy(*by).agg(
        F.sum(sq(o) / e).alias("_q"), F.sum(2 * o * F.ln(o / e)).alias("g"), *[F.max(k).alias(k) for k in ("n", "r", "k", "small")],
        F.greatest(F.max(F.abs(o / c("col_n") - c("row_n") / c("n"))), F.max("bare")).alias("gap"),
        cell("first", "first").alias("a"), cell("first", "last").alias("b"), cell("last", "first").alias("c"), cell("last", "last").alias("d"))
    # sum of (o - e)^2 / e over all cells, empty ones too, is sum of o^2 / e less n; in a 2x2 table all |o - e| are equal
    apart = F.abs(c("a").cast("double") * c("d") - c("b").cast("double") * c("c")) / c("n")
    sides = (c("a") + c("b")).cast("double") * (c("c") + c("d")) * (c("a") + c("c")) * (c("b") + c("d"))
    s = s.select("*", F.greatest(F.lit(0.0), c("_q") - c("n")).alias("pearson"),
                 F.coalesce(ratio(sq(apart - F.least(F.lit(0.5), apart)) * F.pow(c("n").cast("double"), F.lit(3.0)), sides), F.lit(0.0)).alias("yates"))
    two = (c("r") == 2) & (c("k") == 2)
    df_ = (c("r") - 1) * (c("k") - 1)
    return s.select("*", two.alias("two"), df_.alias("df"),
                    F.when(two, c("yates")).otherwise(c("pearson")).alias("chi2")) \
            .withColumn("v", F.coalesce(F.sqrt(ratio(c("chi2"), c("n") * (F.least("r", "k") - 1))), F.lit(0.0)))


def chi_square(df, y, group, by=(), alternative="two-sided") -> DataFrame:
    """Independence; Yates on 2x2.  A 2x2 table reports a (directed) odds ratio, others Cramer V."""
    s = _summary(df, y, group, by)
    h = lambda k: c(k) + 0.5
    odds = h("a") * h("d") / (h("b") * h("c"))
    out = result(s, "T-201", by=by, statistic=c("chi2"), p=D.p_chi2(c("chi2"), c("df")),
                 effect_name="OR|Cramer V", effect=F.when(c("two"), odds).otherwise(c("v")),
                 n={"rows": c("r"), "cols": c("k"), "total": c("n")}, numbers={"df": c("df"), "cramer_v": c("v")})
    name = F.when((c("n")["rows"] == 2) & (c("n")["cols"] == 2), "OR").otherwise("Cramer V")
    return out.withColumn("effect", F.struct(name.alias("name"), c("effect.value").alias("value"),
                                             c("effect.ci_low").alias("ci_low"), c("effect.ci_high").alias("ci_high")))


def fisher_exact(df, y, group, by=(), alternative="two-sided") -> DataFrame:
    s = _summary(df, y, group, by).where(c("two"))
    odds = ratio(c("a").cast("double") * c("d"), c("b").cast("double") * c("c"))
    odds = F.when((c("b") * c("c") == 0) & (c("a") * c("d") > 0), F.lit(float("inf"))).otherwise(odds)
    full = F.least("a", "b", "c", "d") > 0
    half = F.when(full, 1.96 * F.sqrt(ratio(F.lit(1), c("a")) + ratio(F.lit(1), c("b"))
                                      + ratio(F.lit(1), c("c")) + ratio(F.lit(1), c("d"))))
    return result(s, "T-202", by=by, statistic=odds,
                  p=D.p_fisher(c("a"), c("b"), c("c"), c("d"), alternative), effect_name="OR", effect=odds,
                  ci=(F.exp(F.ln(odds) - half), F.exp(F.ln(odds) + half)), n={"total": c("n")})


def g_test(df, y, group, by=(), alternative="two-sided") -> DataFrame:
    s = _summary(df, y, group, by)
    return result(s, "T-203", by=by, statistic=c("g"), p=D.p_chi2(c("g"), c("df")), effect_name="Cramer V",
                  effect=c("v"), n={"rows": c("r"), "cols": c("k"), "total": c("n"), "small_expected": c("small")},
                  numbers={"df": c("df")})


def marginal_vs_conditional(df, y, group, by=(), alternative="two-sided") -> DataFrame:
    """Largest gap between P(Y) and P(Y | Z) with the independence test."""
    s = _summary(df, y, group, by)
    return result(s, "T-1006", by=by, statistic=c("chi2"), p=D.p_chi2(c("chi2"), c("df")),
                  effect_name="max |P(Y|Z)-P(Y)|", effect=c("gap"),
                  n={"rows": c("r"), "cols": c("k"), "total": c("n")}, numbers={"df": c("df")})


def conditional_rates(df, y, group) -> DataFrame:
    """P(Y) beside P(Y | Z) per cell."""
    g = with_margins(crosstab(df, y, group))
    return g.select(c("a").alias("y"), c("b").alias("z"), (c("row_n") / c("n")).alias("marginal"),
                    (c("o") / c("col_n")).alias("conditional"))


def mcnemar(df, y, group, by=(), alternative="two-sided") -> DataFrame:
    """Two binary columns of the same rows; exact below 25 discordant pairs, corrected chi2 above."""
    a, b = c(y).cast("string"), c(group).cast("string")
    lv = sorted(set(levels_of(df, y, 2)) | set(levels_of(df, group, 2)))
    if len(lv) != 2:
        raise ValueError(f"need the same two levels in {y!r} and {group!r}, found {lv}")
    s = df.where(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(((a == lv[0]) & (b == lv[1])).cast("long")).alias("b"),
        F.sum(((a == lv[1]) & (b == lv[0])).cast("long")).alias("c"))
    disc = c("b") + c("c")
    exact = disc < 25
    chi = F.coalesce(ratio(sq(F.abs(c("b") - c("c")).cast("double") - 1), disc), F.lit(0.0))
    stat = F.when(exact, F.least("b", "c").cast("double")).otherwise(chi)
    s = s.withColumn("stat", stat)
    p = F.when(exact, F.coalesce(D.p_binom_half(F.least("b", "c"), disc), F.lit(1.0))).otherwise(D.p_chi2(c("stat"), F.lit(1.0)))
    return result(s, "T-211", by=by, statistic=c("stat"), p=p, effect_name="(b-c)/n",
                  effect=F.coalesce(ratio(c("b") - c("c"), c("n")), F.lit(0.0)),
                  n={"pairs": c("n"), "b": c("b"), "c": c("c")})


def _wilson(x, n):
    z = F.lit(1.959963985)
    ph = ratio(x, n)
    d = 1 + z * z / n
    mid = ph + z * z / (2 * n)
    h = z * F.sqrt(ph * (1 - ph) / n + z * z / (4 * n * n))
    return (mid - h) / d, (mid + h) / d


def two_proportions(df, y, group, by=(), alternative="two-sided", hit=None, levels=None) -> DataFrame:
    """z of the difference of two rates with Newcombe's interval; the later level of y is a hit."""
    lv = two_levels(df, group, levels)
    hit = hit if hit is not None else sorted(levels_of(df, y, 2))[-1]
    g, v = c(group).cast("string"), c(y).cast("string")
    ok = v.isNotNull()
    s = df.groupBy(*by).agg(*[
        F.sum(cond.cast("long")).alias(k) for k, cond in {
            "n1": ok & (g == lv[0]), "n2": ok & (g == lv[1]),
            "x1": (g == lv[0]) & (v == str(hit)), "x2": (g == lv[1]) & (v == str(hit))}.items()])
    n1, n2 = c("n1").cast("double"), c("n2").cast("double")
    p1, p2 = ratio(c("x1"), n1), ratio(c("x2"), n2)
    l1, u1 = _wilson(c("x1"), n1)
    l2, u2 = _wilson(c("x2"), n2)
    se = F.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
    s = s.withColumn("z", F.coalesce(ratio(p1 - p2, se), F.lit(0.0)))
    return result(s, "T-221", by=by, statistic=c("z"), p=D.p_z(c("z"), alternative), effect_name="rate difference",
                  effect=p1 - p2, ci=((p1 - p2) - F.sqrt(sq(p1 - l1) + sq(u2 - p2)), (p1 - p2) + F.sqrt(sq(u1 - p1) + sq(p2 - l2))),
                  n={lv[0]: c("n1"), lv[1]: c("n2")}, numbers={"rate_1": p1, "rate_2": p2})


def cochran_armitage(df, y, group, levels=None, by=(), alternative="two-sided") -> DataFrame:
    """Trend of a binary rate over ordered groups; the larger value of y is a hit."""
    lv = [str(v) for v in levels] if levels else levels_of(df, group)
    if len(lv) < 3:
        raise ValueError(f"need at least three ordered groups, found {len(lv)}")
    vals = [r[0] for r in df.select(num(y).alias("v")).dropna().distinct().limit(3).collect()]
    if len(vals) != 2:
        raise ValueError(f"{y!r} is not binary")
    hi = max(vals)
    score = F.create_map(*[x for v, t in zip(lv, level_scores(lv)) for x in (F.lit(v), F.lit(t))])
    cells = (df.select(*by, c(group).cast("string").alias("g"), num(y).alias("v"))
               .where(c("v").isNotNull() & c("g").isin(lv)).groupBy(*by, "g")
               .agg(F.count("v").alias("n"), F.sum((c("v") == hi).cast("long")).alias("x"))
               .withColumn("t", score[c("g")]))
    n, x, t = c("n").cast("double"), c("x").cast("double"), c("t")
    s = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("N"), F.sum(x).alias("X"),
                               F.sum(t * x).alias("tx"), F.sum(t * n).alias("tn"), F.sum(t * t * n).alias("ttn"))
    pbar = ratio(c("X"), c("N"))
    num_ = c("tx") - c("tn") * pbar
    sxx = c("ttn") - ratio(sq(c("tn")), c("N"))
    s = s.withColumn("z", F.coalesce(ratio(num_, F.sqrt(pbar * (1 - pbar) * sxx)), F.lit(0.0))) \
         .withColumn("slope", ratio(num_, sxx))
    return result(s, "T-502", by=by, statistic=c("z"), p=D.p_z(c("z"), alternative), effect_name="rate per score",
                  effect=c("slope"), n={"groups": c("k"), "total": c("N")})


# ------------------------------------------------------------------ agreement of categories
def kappa_table(df, y, group, by=(), levels=None) -> DataFrame:
    """Observed pairs with both raters' margins and category positions (levels in text order)."""
    lv = list(levels) if levels else sorted(set(levels_of(df, y)) | set(levels_of(df, group)))
    if len(lv) < 2:
        raise ValueError("need at least two categories")
    pos = F.create_map(*[x for i, v in enumerate(lv) for x in (F.lit(v), F.lit(i))])
    cells = crosstab(df, y, group, by).select("*", pos[c("a")].alias("i"), pos[c("b")].alias("j"))
    k = len(lv)
    agg = [F.sum("o").alias("n"), F.sum(F.when(c("i") == c("j"), c("o")).otherwise(0)).alias("agree"),
           F.sum(F.abs(c("i") - c("j")) * c("o")).alias("dist"), F.lit(k).alias("k")]
    agg += [F.sum(F.when(c("i") == q, c("o")).otherwise(0)).alias(f"r{q}") for q in range(k)]
    agg += [F.sum(F.when(c("j") == q, c("o")).otherwise(0)).alias(f"c{q}") for q in range(k)]
    s = cells.groupBy(*by).agg(*agg)
    n = c("n").cast("double")
    pe = sum((c(f"r{q}") / n * c(f"c{q}") / n for q in range(k)), F.lit(0.0))
    wexp = sum((abs(p - q) / max(1, k - 1) * (c(f"r{p}") / n) * (c(f"c{q}") / n)
                for p in range(k) for q in range(k) if p != q), F.lit(0.0))
    half = sum((sq((c(f"r{q}") + c(f"c{q}")) / (2 * n)) for q in range(k)), F.lit(0.0))
    return s.select(*by, "n", "k", (c("agree") / n).alias("po"), pe.alias("pe"),
                    (c("dist") / (n * max(1, k - 1))).alias("wobs"), wexp.alias("wexp"), half.alias("pe_fleiss"))


def cohen_kappa(df, y, group, by=(), alternative="two-sided", levels=None) -> DataFrame:
    s = kappa_table(df, y, group, by, levels)
    k = F.coalesce(ratio(c("po") - c("pe"), 1 - c("pe")), F.lit(0.0))
    se = F.coalesce(F.sqrt(ratio(c("po") * (1 - c("po")), c("n") * sq(1 - c("pe")))), F.lit(0.0))
    kw = F.coalesce(1 - ratio(c("wobs"), c("wexp")), F.lit(0.0))
    s = s.withColumn("kappa", k).withColumn("se", se)
    s = s.withColumn("z", F.coalesce(ratio(c("kappa"), c("se")), F.lit(0.0)))
    return result(s, "T-604", by=by, statistic=c("z"), p=D.p_z(c("z")), effect_name="kappa", effect=c("kappa"),
                  ci=(c("kappa") - 1.96 * c("se"), c("kappa") + 1.96 * c("se")),
                  n={"pairs": c("n"), "categories": c("k")}, numbers={"weighted_kappa": kw, "agreement": c("po")})


def fleiss_kappa(df, y, group, by=(), alternative="two-sided", levels=None) -> DataFrame:
    """Two raters treated as exchangeable."""
    s = kappa_table(df, y, group, by, levels)
    k = F.coalesce(ratio(c("po") - c("pe_fleiss"), 1 - c("pe_fleiss")), F.lit(0.0))
    return result(s, "T-605", by=by, effect_name="Fleiss kappa", effect=k,
                  n={"subjects": c("n"), "raters": F.lit(2), "categories": c("k")})
