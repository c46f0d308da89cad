"""Multiplicity: p-value adjustment over families and all-pairs follow-ups."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from statweave.functions import distributions as D
from statweave.operators.rank_tests import k_sample_table
from statweave.plans.common import levels_of, ratio, result, sq
from statweave.plans.cumulate import cumulate, running_extreme, value_cuts
from statweave.plans.moments import group_moments

c = F.col
METHODS = ("none", "bonferroni", "sidak", "holm", "bh", "by")


def _harmonic(m: Column) -> Column:
    """Sum of 1/i for i = 1..m by the asymptotic series at m + 8."""
    x = m.cast("double") + 8
    far = F.ln(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * sq(x)) + 1 / (120 * sq(sq(x)))
    return far - sum((1 / (m + i) for i in range(1, 9)), F.lit(0.0))


def p_adjust(df: DataFrame, p: str = "p", method: str = "holm", family: Sequence[str] = (), out: str = "p_adj") -> DataFrame:
    """Adds the adjusted p per row; ranks run over distinct p inside each family, so a family of any
    size needs no single-task window.  Null p stay null and do not count."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    fam = list(family)
    if method == "none":
        return df.withColumn(out, c(p))
    pv = df.withColumn("_p", c(p).cast("double") + F.lit(0.0))
    if method in ("bonferroni", "sidak"):
        size = pv.groupBy(*fam).agg(F.count("_p").alias("_m"))
        if fam:
            s = size.withColumnsRenamed({f: f"_s_{f}" for f in fam})
            j = pv.join(s, [pv[f].eqNullSafe(s[f"_s_{f}"]) for f in fam]).drop(*[f"_s_{f}" for f in fam])
        else:
            j = pv.withColumn("_m", size.scalar())
        val = c("_p") * c("_m") if method == "bonferroni" else -F.expm1(c("_m") * F.log1p(-c("_p")))
        val = F.when(c("_p") >= 1, 1.0).otherwise(val)
        return j.withColumn(out, F.when(c("_p").isNotNull(), F.least(F.lit(1.0), val))).drop("_p", "_m")
    cuts = value_cuts(pv, "_p")
    t = cumulate(pv, "_p", {"n": F.count(F.lit(1))}, fam, cuts=cuts)
    m = c("tot_n")
    if method == "holm":
        t = t.withColumn("_raw", c("_p") * (m - c("cum_n")))
        t = running_extreme(t, "_p", "_raw", "prefix_max", fam, cuts)
    else:
        step = c("_p") * m / (c("cum_n") + c("n"))
        t = t.withColumn("_raw", step * _harmonic(m) if method == "by" else step)
        t = running_extreme(t, "_p", "_raw", "suffix_min", fam, cuts)
    t = t.select(*[c(f).alias(f"_s_{f}") for f in fam], c("_p").alias("_tp"), F.least(F.lit(1.0), c("run")).alias(out))
    j = pv.join(t, [pv[f].eqNullSafe(t[f"_s_{f}"]) for f in fam] + [pv["_p"] == t["_tp"]], "left")
    return j.drop("_p", "_tp", *[f"_s_{f}" for f in fam])


def alpha_per_test(n_tests: int, alpha: float = 0.05) -> float:
    """C-15: Bonferroni share of alpha."""
    return alpha / max(1, n_tests)


# ------------------------------------------------------------------ all-pairs follow-ups (k groups, k(k-1)/2 rows)
def _pairs(m: DataFrame, group: str, by: Sequence[str]) -> DataFrame:
    cols = [v for v in m.columns if v not in (*by, group)]
    a = m.select(*by, c(group).cast("string").alias("a"), *[c(v).alias(f"{v}1") for v in cols])
    b = m.select(*[c(v).alias(f"_b_{v}") for v in by], c(group).cast("string").alias("b"), *[c(v).alias(f"{v}2") for v in cols])
    cond = [a[v] == b[f"_b_{v}"] for v in by] + [a["a"] < b["b"]]
    return a.join(b, cond).drop(*[f"_b_{v}" for v in by])


def tukey(df, y, group, by: Sequence[str] = ()) -> DataFrame:
    from pyspark.sql import Window
    m = group_moments(df, y, group, by)
    w = Window.partitionBy(*(by or [F.lit(0)]))
    dof = F.sum("n").over(w) - F.count("n").over(w)
    m = m.select("*", (F.sum((c("n") - 1) * c("var")).over(w) / dof).alias("mse"), dof.alias("df"), F.count("n").over(w).alias("k"))
    p = _pairs(m, group, by)
    se = F.sqrt(c("mse1") / 2 * (1 / c("n1") + 1 / c("n2")))
    p = p.withColumn("q", F.abs(c("mean1") - c("mean2")) / se)
    return result(p, "P-211", by=[*by, "a", "b"], statistic=c("q"), p=D.p_tukey(c("q"), c("k1"), c("df1")), effect_name="mean diff",
                  effect=c("mean1") - c("mean2"), n={"a": c("n1"), "b": c("n2")}, numbers={"df": c("df1"), "se": se})


def games_howell(df, y, group, by: Sequence[str] = ()) -> DataFrame:
    from pyspark.sql import Window
    m = group_moments(df, y, group, by)
    m = m.withColumn("k", F.count("n").over(Window.partitionBy(*(by or [F.lit(0)]))))
    p = _pairs(m, group, by)
    a, b = c("var1") / c("n1"), c("var2") / c("n2")
    p = p.withColumn("q", F.abs(c("mean1") - c("mean2")) / F.sqrt((a + b) / 2)).withColumn(
        "df", sq(a + b) / (sq(a) / (c("n1") - 1) + sq(b) / (c("n2") - 1)))
    return result(p, "P-212", by=[*by, "a", "b"], statistic=c("q"), p=D.p_tukey(c("q"), c("k1"), c("df")), effect_name="mean diff",
                  effect=c("mean1") - c("mean2"), n={"a": c("n1"), "b": c("n2")}, numbers={"df": c("df")})


def dunn(df, y, group, method: str = "holm", levels=None) -> DataFrame:
    """Pairwise z of mean ranks with the pooled tie correction, adjusted over the pairs."""
    lv = [str(v) for v in levels] if levels else levels_of(df, group)
    t = k_sample_table(df, y, group, lv)
    n = c("n").cast("double")
    mid = c("cum_n") + (n + 1) / 2
    s = t.agg(*[F.sum(c(f"n{i}") * mid).alias(f"r{i}") for i in range(len(lv))], *[F.max(f"tot_n{i}").alias(f"size{i}") for i in range(len(lv))],
              F.max("tot_n").alias("total"), F.sum(n * n * n - n).alias("ties"))
    g = s.select("total", "ties", F.explode(F.array(*[F.struct(F.lit(v).alias("g"), ratio(c(f"r{i}"), c(f"size{i}")).alias("mr"), c(f"size{i}").alias("n"))
                                                  for i, v in enumerate(lv)])).alias("x")).select("x.g", "x.mr", "x.n", "total", "ties").where("n > 0")
    p = _pairs(g, "g", [])
    big = c("total1").cast("double")
    var = (big * (big + 1) / 12 - c("ties1") / (12 * (big - 1))) * (1 / c("n1") + 1 / c("n2"))
    p = p.withColumn("z", (c("mr1") - c("mr2")) / F.sqrt(var))
    out = result(p, "P-213", by=["a", "b"], statistic=c("z"), p=D.p_z(c("z")), effect_name="mean rank diff", effect=c("mr1") - c("mr2"),
                 n={"a": c("n1"), "b": c("n2")})
    return p_adjust(out, "p", method)
