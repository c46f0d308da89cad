"""Compositional comparisons (parts of a whole) and proportionality."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from statweave.functions import distributions as D
from statweave.operators.association import proportionality
from statweave.operators.group_tests import anova, welch_t
from statweave.plans.common import levels_of, num, ratio, result, sq, two_levels
from statweave.plans.resample import uniforms

c = F.col


def positive_rows(df: DataFrame, members: Sequence[str]) -> DataFrame:
    """Rows where every member is present and positive (a log needs it; nothing is imputed)."""
    ok = F.lit(True)
    for m in members:
        ok = ok & F.coalesce(num(m) > 0, F.lit(False))
    return df.where(ok)


def centred_log(members: Sequence[str], part: str):
    return F.ln(num(part)) - sum((F.ln(num(m)) for m in members), F.lit(0.0)) / len(members)


def _compare(df, value, group, by, alternative, test_id, levels):
    src = df.withColumn("_v", value)
    lv = list(levels) if levels else levels_of(src, group)
    if len(lv) < 2:
        raise ValueError("need at least two groups")
    if len(lv) == 2:
        return welch_t(src, "_v", group, lv, by, alternative, test_id=test_id)
    return anova(src, "_v", group, by, test_id=test_id)


def clr_compare(df, y, group, members, levels=None, by=(), alternative="two-sided") -> DataFrame:
    return _compare(positive_rows(df, members), centred_log(members, y), group, by, alternative, "T-1001", levels)


def alr_reference(df, y, members) -> str:
    """The other member with the least variance of its logarithm."""
    others = [m for m in members if m != y]
    r = positive_rows(df, members).agg(*[F.var_samp(F.ln(num(m))).alias(f"v{i}") for i, m in enumerate(others)]).first()
    return min(zip(r, others), key=lambda v: v[0])[1]


def alr_compare(df, y, group, members, levels=None, by=(), alternative="two-sided") -> DataFrame:
    ref = alr_reference(df, y, members)
    out = _compare(positive_rows(df, members), F.ln(num(y) / num(ref)), group, by, alternative, "T-1002", levels)
    return out.withColumn("reference", F.lit(ref))


def bias_corrected(df, y, group, members, levels=None, by=(), alternative="two-sided") -> DataFrame:
    """clr difference minus the groups' difference in the mean of the other members."""
    lv = two_levels(df, group, levels)
    others = [m for m in members if m != y]
    base = sum((centred_log(members, m) for m in others), F.lit(0.0)) / len(others)
    src = positive_rows(df, members).select(*by, c(group).cast("string").alias("_g"), centred_log(members, y).alias("_v"), base.alias("_b"))
    aggs = []
    for i, v in enumerate(lv, 1):
        x = F.when(c("_g") == v, c("_v"))
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_samp(x).alias(f"v{i}"),
                 F.avg(F.when(c("_g") == v, c("_b"))).alias(f"b{i}")]
    s = src.groupBy(*by).agg(*aggs).withColumn("corr", c("b1") - c("b2"))
    a, b = c("v1") / c("n1"), c("v2") / c("n2")
    s = s.select("*", (c("m1") - c("m2") - c("corr")).alias("d"), F.sqrt(a + b).alias("se"),
                 ratio(sq(a + b), sq(a) / (c("n1") - 1) + sq(b) / (c("n2") - 1)).alias("df"))
    s = s.withColumn("t", ratio(c("d"), c("se")))
    return result(s, "T-1004", by=by, statistic=c("t"), p=D.p_t(c("t"), c("df"), alternative), effect_name="bias-corrected clr difference",
                  effect=c("d"), ci=(c("d") - 1.96 * c("se"), c("d") + 1.96 * c("se")), n={lv[0]: c("n1"), lv[1]: c("n2")},
                  numbers={"correction": c("corr"), "df": c("df")})


def _gamma(h: np.ndarray, alpha: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """(rows, draws) gamma variates by Marsaglia-Tsang with hash-driven uniforms: a row's draws do
    not depend on which partition it sits in."""
    boost = alpha < 1
    d = np.where(boost, alpha + 1, alpha)[:, None] - 1 / 3
    cc = 1 / np.sqrt(9 * d)
    out = np.full((len(h), draws), np.nan)
    for attempt in range(12):
        todo = np.isnan(out)
        if not todo.any():
            break
        reps = np.arange(draws) + 1000 * (attempt + 1)
        u1, u2, u3 = (uniforms(h, reps * 4 + q, seed) for q in (0, 1, 2))
        z = np.sqrt(-2 * np.log(np.maximum(u1, 1e-300))) * np.cos(2 * np.pi * u2)
        v = (1 + cc * z) ** 3
        ok = (v > 0) & (np.log(np.maximum(u3, 1e-300)) < 0.5 * z * z + d - d * v + d * np.log(np.maximum(v, 1e-300)))
        if attempt == 11:
            ok, v = np.ones_like(ok), np.where(v > 0, v, 1.0)
        out = np.where(todo & ok, d * v, out)
    u = uniforms(h, np.arange(draws) * 4 + 3, seed)
    return np.where(boost[:, None], out * np.maximum(u, 1e-300) ** (1 / np.maximum(alpha, 1e-12))[:, None], out)


def dirichlet_compare(df, y, group, members, key: Sequence[str], levels=None, alternative="two-sided",
                      draws: int = 128, prior: float = 0.5, seed: int = 0) -> DataFrame:
    """Counts as Dirichlet draws, clr, Welch per draw; each partition returns only per-draw sums."""
    lv = two_levels(df, group, levels)
    src = df.select(F.xxhash64(*key).alias("_h"), c(group).cast("string").alias("_g"), *[num(m).alias(m) for m in members]).dropna()
    src = src.where(c("_g").isin(lv))
    j = list(members).index(y)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = {v: np.zeros((draws, 3)) for v in lv}
        for pdf in batches:
            for lo in range(0, len(pdf), 2048):
                part = pdf.iloc[lo:lo + 2048]
                h = part["_h"].to_numpy()
                logs = np.stack([np.log(np.maximum(_gamma(h, part[m].to_numpy(float) + prior, draws, seed + 101 * i), 1e-300))
                                 for i, m in enumerate(members)])
                clr = logs[j] - logs.mean(axis=0)
                for v in lv:
                    x = clr[(part["_g"] == v).to_numpy()]
                    acc[v] += np.stack([np.full(draws, len(x)), x.sum(axis=0), (x * x).sum(axis=0)], axis=1)
        for v, a in acc.items():
            yield pd.DataFrame({"b": np.arange(draws), "g": v, "n": a[:, 0], "s": a[:, 1], "q": a[:, 2]})

    sums = src.mapInPandas(run, "b long, g string, n double, s double, q double").groupBy("b", "g").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    m = sums.select("b", "g", "n", (c("s") / c("n")).alias("m"), ((c("q") - sq(c("s")) / c("n")) / (c("n") - 1)).alias("v"))
    pick = lambda v, k: F.max(F.when(c("g") == v, c(k)))
    w = m.groupBy("b").agg(*[pick(v, k).alias(f"{k}{i}") for i, v in enumerate(lv, 1) for k in ("n", "m", "v")])
    a, b = c("v1") / c("n1"), c("v2") / c("n2")
    w = w.select("b", "n1", "n2", (c("m1") - c("m2")).alias("d"), ratio(c("m1") - c("m2"), F.sqrt(a + b)).alias("t"),
                 ratio(sq(a + b), sq(a) / (c("n1") - 1) + sq(b) / (c("n2") - 1)).alias("df"))
    w = w.withColumn("p", D.p_t(c("t"), c("df"), alternative))
    s = w.agg(F.median("p").alias("p"), F.max("p").alias("pmax"), F.median("d").alias("d"), F.percentile("d", 0.025).alias("lo"),
              F.percentile("d", 0.975).alias("hi"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    return result(s, "T-1003", p=c("p"), effect_name="clr difference", effect=c("d"), ci=(c("lo"), c("hi")),
                  n={lv[0]: c("n1"), lv[1]: c("n2")}, numbers={"draws": F.lit(draws), "p_max": c("pmax")})


def proportionality_of_parts(df, y, x, by=(), alternative="two-sided") -> DataFrame:
    return proportionality(df, y, x, by, alternative, test_id="T-1005")
