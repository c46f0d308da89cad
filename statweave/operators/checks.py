"""Assumption checks: one row per (check, group) with a verdict ok / caution / violated / skipped."""
from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from statweave.functions import distributions as D
from statweave.operators.association import pearson, spearman
from statweave.plans.common import num, ratio, sq
from statweave.plans.cumulate import quantiles
from statweave.plans.gram import complete_cases, gram, per_row, unpack
from statweave.plans.moments import group_moments
from statweave.spec import Spec

c = F.col


def _rows(df: DataFrame, check: str, verdict: Column, numbers: dict[str, Column], group: Column | None = None,
          cause: Column | None = None, p: Column | None = None) -> DataFrame:
    return df.select(F.lit(check).alias("check"), (F.lit("all") if group is None else group).cast("string").alias("group"),
                     verdict.alias("verdict"), (F.lit(None) if cause is None else cause).cast("string").alias("cause"),
                     (F.lit(None) if p is None else p).cast("double").alias("p"),
                     F.create_map(*[x for k, v in numbers.items() for x in (F.lit(k), v.cast("double"))]).alias("numbers"))


# ------------------------------------------------------------------ C-01
def shapiro_p(x: np.ndarray) -> float:
    """Shapiro-Wilk by Royston's (1995) approximation, 4 <= n < 50 here."""
    x = np.sort(x)
    n = x.size
    m = D.norm_ppf((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    mm = float(m @ m)
    u = 1 / math.sqrt(n)
    # fixed values: published polynomial coefficients, highest power first
    a_n = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / math.sqrt(mm)], u)
    a_n1 = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(mm)], u)
    a = np.empty(n)
    if n > 5:
        phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a_n ** 2 - 2 * a_n1 ** 2)
        a[2:-2] = m[2:-2] / math.sqrt(phi)
        a[-2], a[1] = a_n1, -a_n1
    else:
        phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * a_n ** 2)
        a[1:-1] = m[1:-1] / math.sqrt(phi)
    a[-1], a[0] = a_n, -a_n
    ss = float(((x - x.mean()) ** 2).sum())
    if ss == 0:
        return 1.0
    w = float(a @ x) ** 2 / ss
    ln = math.log(n)
    if n <= 11:
        g = -2.273 + 0.459 * n
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sd = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        z = (-math.log(max(g - math.log1p(-w), 1e-300)) - mu) / sd
    else:
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
        sd = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
        z = (math.log1p(-w) - mu) / sd
    return float(D.norm_sf(z))


def dagostino_p(n: float, g1: float, ek: float) -> float:
    """K-squared from the sample size, skewness and excess kurtosis."""
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (b2 - 1))
    al = math.sqrt(2 / (w2 - 1))
    zs = math.asinh(y / al) / math.sqrt(0.5 * math.log(w2))
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (ek + 3 - 3 * (n - 1) / (n + 1)) / math.sqrt(var)
    sb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / sb * (2 / sb + math.sqrt(1 + 4 / sb ** 2))
    q = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    zk = ((1 - 2 / (9 * a)) - math.copysign(abs(q) ** (1 / 3), q)) / math.sqrt(2 / (9 * a))
    return float(D.chi2_sf(zs * zs + zk * zk, 2))


def _small_p(x: np.ndarray) -> float:
    if x.size < 50:
        return shapiro_p(x)
    d = x - x.mean()
    m2 = (d ** 2).mean()
    return dagostino_p(x.size, (d ** 3).mean() / m2 ** 1.5, (d ** 4).mean() / m2 ** 2 - 3) if m2 > 0 else 1.0


def normality(df: DataFrame, y: str, group: str | None = None, alpha: float = 0.05) -> DataFrame:
    """C-01: groups up to 300 rows are tested on their values (Shapiro below 50, else K-squared);
    larger ones are judged by skewness alone, where a p-value would only measure the size."""
    src = df.select((c(group).cast("string") if group else F.lit("all")).alias("g"), num(y).alias("y")).dropna()
    mom = src.groupBy("g").agg(F.count("y").alias("n"), F.skewness("y").alias("skew"))
    small = src.join(mom.where("n between 8 and 300").select("g"), "g")

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:      # at most 300 rows
        x = pdf["y"].to_numpy(float)
        p = _small_p(x)
        cause = None
        if p < alpha:
            q1, q3 = np.percentile(x, [25, 75])
            iqr = q3 - q1
            keep = (x >= q1 - 1.5 * iqr) & (x <= q3 + 1.5 * iqr)
            out = int((~keep).sum())
            d = x - x.mean()
            sk = (d ** 3).mean() / (d ** 2).mean() ** 1.5 if (d ** 2).mean() > 0 else 0.0
            cause = "skew" if abs(sk) >= 1 else "shape"
            if iqr > 0 and 0 < out <= max(2, 0.02 * x.size) and keep.sum() >= 8 and _small_p(x[keep]) >= 0.05:
                cause = "outliers"
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "p": [p], "cause": [cause]})

    tested = small.groupBy("g").applyInPandas(judge, "g string, p double, cause string")
    s = mom.join(tested, "g", "left")
    verdict = F.when(c("n") < 8, "caution").when(c("n") > 300, F.when(F.abs("skew") >= 1, "caution").otherwise("ok")) \
               .otherwise(F.when(c("p") < alpha, "violated").otherwise("ok"))
    return _rows(s, "C-01", verdict, {"n": c("n"), "skew": F.coalesce("skew", F.lit(0.0))}, c("g"), c("cause"), c("p"))


def qq_points(df: DataFrame, y: str, points: int = 40) -> DataFrame:
    """Sample quantiles beside standard normal ones."""
    probs = [(i + 0.5) / points for i in range(points)]
    q = quantiles(df.select(num(y).alias("y")), "y", probs)
    pts = F.array(*[F.struct(F.lit(float(D.norm_ppf(np.array([p]))[0])).alias("theoretical"), c(f"q{i}").alias("sample")) for i, p in enumerate(probs)])
    return q.select(F.explode(pts).alias("r")).select("r.*")


# ------------------------------------------------------------------ C-02 .. C-10
def equal_variance(df: DataFrame, y: str, group: str, alpha: float = 0.05) -> DataFrame:
    """C-02 Brown-Forsythe: one-way F of absolute deviations from the group medians."""
    from statweave.operators.group_tests import anova
    src = df.select(c(group).alias("g"), num(y).alias("y")).dropna()
    med = quantiles(src, "y", [0.5], ["g"]).where("n >= 2").select(c("g").alias("_g"), "q0")
    dev = src.join(med, c("g") == c("_g")).select("g", F.abs(c("y") - c("q0")).alias("d"))
    a = anova(dev, "d", "g")
    sd = group_moments(src, "y", "g").agg(F.sqrt(ratio(F.max("var"), F.min("var"))).alias("v")).scalar()
    verdict = F.when(c("p") < alpha, "violated").when(c("p").isNull(), "skipped").otherwise("ok")
    return _rows(a, "C-02", verdict, {"stat": c("statistic"), "sd_ratio": sd}, p=c("p"))


def outlier_share(df: DataFrame, y: str, limit: float = 0.05, scale: float = 1.4826) -> DataFrame:
    """C-03: share beyond 3 scaled MADs of the median."""
    src = df.select(num(y).alias("y")).dropna()
    med = quantiles(src, "y", [0.5]).select("q0").scalar()
    dev = src.select(F.abs(c("y") - med).alias("d"))
    mad = quantiles(dev, "d", [0.5]).select((c("q0") * scale).alias("m")).scalar()
    s = dev.withColumn("_m", mad).agg(F.count("d").alias("n"), F.first("_m").alias("mad"),
                                      F.sum(((c("_m") > 0) & (c("d") > 3 * c("_m"))).cast("long")).alias("out"))
    share = ratio(c("out"), c("n"))
    verdict = F.when(c("n") < 5, "skipped").when(share <= limit, "ok").otherwise("violated")
    return _rows(s, "C-03", verdict, {"ratio": share, "n": c("out"), "mad": c("mad")})


def shape_similarity(df: DataFrame, y: str, group: str) -> DataFrame:
    m = group_moments(df, y, group, shape=True).where("n >= 8")
    s = m.agg((F.max("skew") - F.min("skew")).alias("ds"), (F.max("kurt") - F.min("kurt")).alias("dk"), F.count("n").alias("k"))
    verdict = F.when(c("k") < 2, "skipped").when((c("ds") < 1) & (c("dk") < 2), "ok").otherwise("violated")
    return _rows(s, "C-04", verdict, {"d_skew": c("ds"), "d_kurt": c("dk")})


def independence(df: DataFrame, structure: dict[str, str] | None = None, subject: str | None = None) -> DataFrame:
    """C-05 from confirmed structure, or from repeats of a subject column."""
    if subject:
        s = df.where(c(subject).isNotNull()).groupBy(subject).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("m"), F.avg("n").alias("a"))
        return _rows(s, "C-05", F.when(c("m") > 1, "violated").otherwise("ok"), {"max_per_subject": c("m"), "mean_per_subject": c("a")})
    clustered = [k for k, v in (structure or {}).items() if v in ("cluster", "repeated")]
    verdict = "caution" if not structure else "violated" if clustered else "ok"
    return _rows(df.sparkSession.range(1), "C-05", F.lit(verdict), {"clustered_columns": F.lit(len(clustered))})


def collinearity(df: DataFrame, columns: Sequence[str], threshold: float = 5.0) -> DataFrame:
    """C-07: variance inflation of every column from one Gram matrix."""
    cols = list(columns)
    g = gram(complete_cases(df, {v: num(v) for v in cols}), cols)
    k = len(cols)

    def finish(r):
        n, _, s = unpack(r, k)
        sd = np.sqrt(np.diag(s))
        sd = np.where(sd > 0, sd, 1.0)
        corr = s / np.outer(sd, sd)
        out = []
        for i in range(k):
            rest = [j for j in range(k) if j != i]
            r2 = corr[i, rest] @ np.linalg.pinv(corr[np.ix_(rest, rest)]) @ corr[rest, i]
            out.append(1 / max(1e-12, 1 - float(r2)))
        return {"n": n, "vif": out}

    s = per_row(g, finish, "n bigint, vif array<double>").select("n", F.posexplode("vif").alias("i", "vif"))
    name = F.array(*[F.lit(v) for v in cols])[c("i")]
    return _rows(s, "C-07", F.when(c("vif") >= threshold, "violated").otherwise("ok"), {"vif": c("vif"), "n": c("n")}, name)


def linearity(df: DataFrame, y: str, x: str) -> DataFrame:
    from statweave.operators.regression import _paste
    s = _paste(pearson(df, y, x).select(sq(c("statistic")).alias("r2"), c("n")["pairs"].alias("n")),
               spearman(df, y, x).select(sq(c("statistic")).alias("rho2")))
    verdict = F.when(c("n") < 8, "skipped").when(c("rho2") - c("r2") < 0.10, "ok").otherwise("violated")
    return _rows(s, "C-08", verdict, {"r2": c("r2"), "rho2": c("rho2")})


def dispersion(df: DataFrame, y: str) -> DataFrame:
    v = num(y)
    s = df.agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("v"), F.avg((v == 0).cast("double")).alias("z"))
    r = ratio(c("v"), c("m"))
    verdict = F.when((c("n") < 5) | (c("m") <= 0), "skipped").when((r <= 1.5) & (c("z") < 0.5), "ok").otherwise("violated")
    return _rows(s, "C-10", verdict, {"var_mean_ratio": r, "zero_ratio": c("z")})


# ------------------------------------------------------------------ C-09 power
def t_power(d: float, n1: float, n2: float, alpha: float = 0.05) -> float:
    """Two-sided power of the pooled t test at standardised difference ``d``."""
    dof = n1 + n2 - 2
    crit = float(D.t_ppf(np.array(1 - alpha / 2), dof))
    delta = d * math.sqrt(n1 * n2 / (n1 + n2))
    if dof > 20_000:
        return float(D.norm_sf(crit - delta) + D.norm_sf(crit + delta))
    s, w = D._chi_scale_grid(dof)
    return float(np.sum(w * (D.norm_sf(crit * s - delta) + D.norm_sf(crit * s + delta))))


def minimum_detectable(n1: float, n2: float, alpha: float = 0.05, power: float = 0.8) -> float:
    lo, hi = 0.0, 100.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_power(mid, n1, n2, alpha) < power else (lo, mid)
    return hi


def n_per_group(d: float, alpha: float = 0.05, power: float = 0.8) -> int:
    lo, hi = 2, 4
    while t_power(d, hi, hi, alpha) < power:
        hi *= 2
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if t_power(d, mid, mid, alpha) < power else (lo, mid)
    return hi


def power_check(df: DataFrame, y: str, group: str, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    counts = df.select(c(group).cast("string").alias("g"), num(y).alias("y")).dropna(subset=["g"]).groupBy("g").agg(F.count("y").alias("n"))
    rows = counts.limit(3).collect()
    one = df.sparkSession.range(1)
    if len(rows) != 2:
        return _rows(one, "C-09", F.lit("skipped"), {"groups": F.lit(len(rows))})
    small = min(rows, key=lambda r: (r["n"], r["g"]))
    d = minimum_detectable(rows[0]["n"], rows[1]["n"], alpha, power)
    return _rows(one, "C-09", F.lit("caution" if d > 0.5 else "ok"),
                 {"min_detectable_d": F.lit(d), "n_per_group_for_d05": F.lit(n_per_group(0.5, alpha, power)), "smallest_n": F.lit(small["n"])},
                 F.lit(small["g"]))


def multiplicity(df: DataFrame, n_tests: int, alpha: float = 0.05) -> DataFrame:
    return _rows(df.sparkSession.range(1), "C-15", F.lit("ok" if n_tests == 1 else "caution"),
                 {"n_tests": F.lit(n_tests), "alpha_adjusted": F.lit(alpha / max(1, n_tests))})


# ------------------------------------------------------------------ bundles
def run_checks(df: DataFrame, spec: Spec, structure: dict[str, str] | None = None, others: Sequence[str] | None = None) -> DataFrame:
    """The checks that bear on the question, as one DataFrame. others: columns for collinearity, all numeric ones by default."""
    is_num = lambda v: bool(v) and isinstance(df.schema[v].dataType, NumericType)
    pairwise = spec.question in ("Q-03", "Q-08")
    parts = [normality(df, spec.y, None if pairwise else spec.group)]
    if pairwise and is_num(spec.group):
        parts += [normality(df, spec.group), linearity(df, spec.y, spec.group)]
        extra = [v for v in (df.columns if others is None else others) if is_num(v) and v not in (spec.y, spec.group)]
        parts.append(collinearity(df, [spec.y, spec.group, *extra]))
    if spec.group and spec.question != "Q-03":
        parts += [equal_variance(df, spec.y, spec.group), power_check(df, spec.y, spec.group)]
    if is_num(spec.y):
        parts.append(outlier_share(df, spec.y))
        v = num(spec.y)
        whole = df.agg(F.min(((v >= 0) & (v == F.floor(v))).cast("int"))).first()[0]
        if whole:
            parts.append(dispersion(df, spec.y))
    if spec.group and not pairwise:
        parts.append(shape_similarity(df, spec.y, spec.group))
        if spec.paired and spec.subject:
            from statweave.operators.repeated import sphericity
            s = sphericity(df, spec.y, spec.group, spec.subject)
            parts.append(_rows(s, "C-06", c("verdict"), {"var_ratio": c("ratio")}))
    if spec.question == "Q-09" and spec.event:
        from statweave.operators.survival import proportional_hazards
        s = proportional_hazards(df, spec.y, spec.group, spec.event)
        parts.append(_rows(s, "C-11", F.when(c("p") < 0.05, "violated").otherwise("ok"), {"chi2": c("statistic"), "r": c("effect.value")}, p=c("p")))
    parts += [independence(df, structure, spec.subject), multiplicity(df, spec.n_tests)]
    return reduce(DataFrame.unionByName, parts)


def checks_of(test_id: str) -> list[str]:
    """The checks a test leans on, as the rule rows of `advise.TESTS` name them, and independence."""
    from statweave.operators.advise import TESTS
    named = next((row[7] for row in TESTS if row[0] == test_id), "")
    return sorted({*named.split(","), "C-05"} - {""})


def checks_for_test(checks: DataFrame, test_id: str) -> DataFrame:
    return checks.where(c("check").isin(checks_of(test_id)))
