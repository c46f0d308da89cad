"""Metric values: errors, classification, diversity, entropy, information, normalisation,
variability and clinical measures.  Each is one aggregation (plus an ordered table where ranks or
quantiles are involved) and accepts ``by`` for one row per group."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from statweave.functions import distributions as D
from statweave.plans.common import beside, num, ratio, sq
from statweave.plans.cumulate import cumulate, quantiles, ranked
from statweave.plans.gram import complete_cases, gram, unpack

c = F.col


# ------------------------------------------------------------------ errors
def error_metrics(df: DataFrame, y, pred, by: Sequence[str] = (), delta: float = 1.0) -> DataFrame:
    """MAE, RMSE, MAPE, sMAPE, MSLE, R2, CCC, bias and Huber loss of one prediction column."""
    s = df.select(*by, num(y).alias("y"), num(pred).alias("p")).dropna(subset=["y", "p"])
    e = c("y") - c("p")
    ae = F.abs(e)
    ok = (c("y") > -1) & (c("p") > -1)
    log_gap = F.when(ok, F.log1p("y") - F.log1p("p"))
    out = s.groupBy(*by).agg(
        F.count("y").alias("n"), F.avg(ae).alias("mae"), F.sqrt(F.avg(sq(e))).alias("rmse"),
        (100 * F.avg(ratio(ae, F.abs("y")))).alias("mape"), F.sum((c("y") == 0).cast("long")).alias("zero_y"),
        (100 * F.avg(ratio(ae, (F.abs("y") + F.abs("p")) / 2))).alias("smape"), F.avg(sq(log_gap)).alias("msle"),
        F.sum(sq(e)).alias("_sse"), F.var_pop("y").alias("_vy"), F.var_pop("p").alias("_vp"), F.covar_pop("y", "p").alias("_c"),
        F.avg(c("p") - c("y")).alias("bias"),
        F.avg(F.when(ae <= delta, sq(e) / 2).otherwise(delta * (ae - delta / 2))).alias("huber"))
    return out.select(*by, "n", "mae", "rmse", "mape", "zero_y", "smape", "msle", F.sqrt("msle").alias("rmsle"),
                      (1 - ratio(c("_sse"), c("n") * c("_vy"))).alias("r2"),
                      ratio(2 * c("_c"), c("_vy") + c("_vp") + sq(c("bias"))).alias("ccc"), "bias", "huber")


def probability_errors(df: DataFrame, label, prob, by: Sequence[str] = (), clip: float = 1e-15) -> DataFrame:
    """Brier score and log loss of probabilities against a 0/1 label."""
    s = df.select(*by, num(label).alias("y"), num(prob).alias("p")).dropna(subset=["y", "p"])
    q = F.least(F.lit(1 - clip), F.greatest(F.lit(clip), c("p")))
    return s.groupBy(*by).agg(F.count("y").alias("n"), F.avg(sq(c("p") - c("y"))).alias("brier"),
                              (-F.avg(c("y") * F.ln(q) + (1 - c("y")) * F.ln(1 - q))).alias("log_loss"))


# ------------------------------------------------------------------ classification at a threshold
def confusion_metrics(df: DataFrame, label, score, threshold: float = 0.5, by: Sequence[str] = (), beta: float = 1.0) -> DataFrame:
    """Every measure of the 2x2 confusion table, from one conditional aggregation."""
    s = df.select(*by, num(label).alias("y"), num(score).alias("s")).dropna(subset=["y", "s"])
    hit, pos = c("s") >= threshold, c("y") > 0
    cnt = lambda cond: F.sum(cond.cast("double"))
    t = s.groupBy(*by).agg(cnt(hit & pos).alias("tp"), cnt(hit & ~pos).alias("fp"), cnt(~hit & pos).alias("fn"), cnt(~hit & ~pos).alias("tn"))
    tp, fp, fn, tn = (c(k) for k in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    sens, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    ppv, npv = ratio(tp, tp + fp), ratio(tn, tn + fn)
    pe = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / sq(n)
    b2 = beta * beta
    return t.select(*by, "tp", "fp", "fn", "tn", sens.alias("sensitivity"), spec.alias("specificity"), ppv.alias("ppv"), npv.alias("npv"),
                    ratio(sens, 1 - spec).alias("lr_plus"), ratio(1 - sens, spec).alias("lr_minus"), (sens + spec - 1).alias("youden_j"),
                    ratio((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp).alias("f_beta"),
                    ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
                    ((sens + spec) / 2).alias("balanced_accuracy"), ratio((tp + tn) / n - pe, 1 - pe).alias("kappa"),
                    (tp / n - fp / n * (threshold / (1 - threshold))).alias("net_benefit"))


def partial_auc(df: DataFrame, label, score, max_fpr: float = 0.1) -> DataFrame:
    """Area of the ROC polygon up to ``max_fpr`` with McClish's standardisation."""
    s = df.select((num(label) > 0).cast("long").alias("y"), (-num(score)).alias("s")).dropna()
    t = cumulate(s, "s", {"n": F.count(F.lit(1)), "pos": F.sum("y")})
    p, q = c("tot_pos").cast("double"), (c("tot_n") - c("tot_pos")).cast("double")
    f0, f1 = (c("cum_n") - c("cum_pos")) / q, (c("cum_n") - c("cum_pos") + c("n") - c("pos")) / q
    t0, t1 = c("cum_pos") / p, (c("cum_pos") + c("pos")) / p
    end = F.least(f1, F.lit(max_fpr))
    at_end = t0 + F.coalesce(ratio((t1 - t0) * (end - f0), f1 - f0), F.lit(0.0))
    area = F.when(f0 < max_fpr, (end - f0) * (t0 + at_end) / 2).otherwise(0.0)
    r = t.agg(F.sum(area).alias("pauc"))
    lo, hi = max_fpr * max_fpr / 2, max_fpr
    return r.select("pauc", (0.5 * (1 + (c("pauc") - lo) / (hi - lo))).alias("pauc_mcclish"))


def reclassification(df: DataFrame, label, old, new, cuts: Sequence[float] = (0.5,)) -> DataFrame:
    """Category NRI at the cut points and IDI."""
    cat = lambda v: sum(((v >= x).cast("int") for x in cuts), F.lit(0))
    s = df.select((num(label) > 0).alias("y"), num(old).alias("o"), num(new).alias("n")).dropna()
    up, down = (cat(c("n")) > cat(c("o"))).cast("double"), (cat(c("n")) < cat(c("o"))).cast("double")
    pos = lambda v: F.avg(F.when(c("y"), v))
    neg = lambda v: F.avg(F.when(~c("y"), v))
    return s.agg((pos(up) - pos(down) + neg(down) - neg(up)).alias("nri"),
                 ((pos(c("n")) - neg(c("n"))) - (pos(c("o")) - neg(c("o")))).alias("idi"))


# ------------------------------------------------------------------ distances between samples and categories
def total_variation(df: DataFrame, value: str, group: str, levels: Sequence[str]) -> DataFrame:
    v, g = c(value).cast("string"), c(group).cast("string")
    t = df.where(v.isNotNull() & g.isin(list(levels))).groupBy(v.alias("v")).agg(
        F.sum((g == levels[0]).cast("double")).alias("a"), F.sum((g == levels[1]).cast("double")).alias("b"))
    tot = t.agg(F.struct(F.sum("a").alias("a"), F.sum("b").alias("b"))).scalar()
    return t.withColumn("_t", tot).agg((F.sum(F.abs(c("a") / c("_t.a") - c("b") / c("_t.b"))) / 2).alias("tv"))


def mahalanobis_rows(df: DataFrame, cols: Sequence[str], out: str = "mahalanobis") -> DataFrame:
    """Distance of every row to the column means under the sample covariance."""
    from statweave.functions.vectors import mahalanobis
    n, m, s = unpack(gram(complete_cases(df, {v: num(v) for v in cols}), list(cols)).first(), len(cols))
    return df.withColumn(out, mahalanobis(cols, m, np.linalg.pinv(s / (n - 1))))


def mmd(df: DataFrame, vec: str, group: str, levels: Sequence[str], gamma: float, features: int = 0, key: str | None = None,
        block: int | None = None, seed: int = 0) -> DataFrame:
    """Squared maximum mean discrepancy (biased) under exp(-gamma d^2).

    Exact by default: kernel sums are accumulated block against block inside tasks, one row per
    block pair; a block has about a million numbers, at least 2,048 and at most 16,384 rows.  With ``features`` > 0 random Fourier features give a linear-time estimate."""
    g = c(group).cast("string")
    src = df.where(g.isin(list(levels))).select(g.alias("g"), c(vec).cast("array<double>").alias("v"), *([c(key).alias("_key")] if key else []))
    if features:
        dim = src.select(F.size("v")).first()[0]
        rng = np.random.default_rng(seed)
        w, b = rng.normal(size=(dim, features)) * math.sqrt(2 * gamma), rng.uniform(0, 2 * math.pi, features)

        def mean_map(batches):
            acc = {lv: np.zeros(features + 1) for lv in levels}
            for pdf in batches:
                x = np.stack(pdf["v"].to_numpy())
                z = math.sqrt(2 / features) * np.cos(x @ w + b)
                for lv in levels:
                    m = (pdf["g"] == lv).to_numpy()
                    acc[lv][:-1] += z[m].sum(axis=0)
                    acc[lv][-1] += m.sum()
            yield pd.DataFrame([(lv, i, float(a[i]), float(a[-1])) for lv, a in acc.items() for i in range(features)], columns=["g", "i", "s", "n"])

        t = src.select("g", "v").mapInPandas(mean_map, "g string, i int, s double, n double").groupBy("g", "i").agg((F.sum("s") / F.sum("n")).alias("m"))
        d = t.groupBy("i").agg(F.sum(F.when(c("g") == levels[0], c("m")).otherwise(-c("m"))).alias("d"))
        return d.agg(F.sum(sq(c("d"))).alias("mmd2"))
    size = src.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    block = block or min(16_384, max(2_048, (1 << 20) // max(1, size["dim"] or 1)))
    nb = max(1, math.ceil(size["n"] / block))
    # vectors move as they are stored; the kernel is symmetric, so a block meets itself and the blocks after it
    stored = df.where(g.isin(list(levels))).select(g.alias("g"), c(vec).alias("v"), *([c(key).alias("_key")] if key else []))
    pts = stored.select("g", "v", F.pmod(F.xxhash64("v", *(["_key"] if key else [])), F.lit(nb)).cast("int").alias("blk"))
    left = pts.select("g", "v", c("blk").alias("i"), F.explode(F.sequence(c("blk"), F.lit(nb - 1))).alias("j"))
    right = pts.where(c("blk") > 0).select("g", "v", c("blk").alias("j"), F.explode(F.sequence(F.lit(0), c("blk") - 1)).alias("i"))

    def sums(at, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        same = at[0] == at[1]
        b = a if same else b
        if len(a) and len(b):
            sides = [{p: np.stack(z.loc[z["g"] == p, "v"].to_numpy()).astype(np.float64) for p in levels if (z["g"] == p).any()} for z in (a, b)]
            for p, xs in sides[0].items():
                for q, y in sides[1].items():
                    total, y2 = 0.0, (y * y).sum(1)[None, :]
                    for k in range(0, len(xs), 256):
                        x = xs[k:k + 256]
                        total += float(np.exp(-gamma * np.maximum((x * x).sum(1)[:, None] + y2 - 2 * x @ y.T, 0)).sum())
                    rows += [(p, q, total, float(len(xs) * len(y)))] + ([] if same else [(q, p, total, float(len(xs) * len(y)))])
        return pd.DataFrame(rows, columns=["p", "q", "s", "n"])

    t = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(sums, "p string, q string, s double, n double")
    m = t.groupBy("p", "q").agg((F.sum("s") / F.sum("n")).alias("k"))
    return m.agg(F.sum(F.when(c("p") == c("q"), c("k")).otherwise(-c("k"))).alias("mmd2"))


# ------------------------------------------------------------------ diversity of a category column
def diversity(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None, alpha: float = 2.0, q: float = 2.0) -> DataFrame:
    """Shannon, Simpson, inverse Simpson, Renyi, Hill, richness, Chao1 and Pielou per group."""
    w = F.sum(num(weight)) if weight else F.count(F.lit(1)).cast("double")
    t = df.where(c(value).isNotNull()).groupBy(*by, value).agg(w.alias("n")).where("n > 0")
    # sums of powers of the counts serve all measures, so no task sees all values of a group: p = n / total comes in at the end
    power = lambda k: F.sum(F.pow(c("n"), F.lit(float(k))))
    s = t.groupBy(*by).agg(F.sum("n").alias("_t"), F.sum(c("n") * F.ln("n")).alias("_h"), F.sum(sq(c("n"))).alias("_2"), power(alpha).alias("_pa"), power(q).alias("_pq"),
                           F.count("n").alias("richness"), F.sum((c("n") == 1).cast("double")).alias("_f1"), F.sum((c("n") == 2).cast("double")).alias("_f2"))
    s = s.select(*by, "richness", "_f1", "_f2", (F.ln("_t") - c("_h") / c("_t")).alias("shannon"), (c("_2") / sq(c("_t"))).alias("_d"),
                 (c("_pa") / F.pow("_t", F.lit(float(alpha)))).alias("_a"), (c("_pq") / F.pow("_t", F.lit(float(q)))).alias("_q"))
    renyi = F.ln("_a") / (1 - alpha) if alpha != 1 else c("shannon")
    hill = F.pow("_q", F.lit(1 / (1 - q))) if q != 1 else F.exp("shannon")
    chao = c("richness") + F.when(c("_f2") > 0, sq(c("_f1")) / (2 * c("_f2"))).otherwise(c("_f1") * (c("_f1") - 1) / 2)
    return s.select(*by, "shannon", (1 - c("_d")).alias("simpson"), (1 / c("_d")).alias("inverse_simpson"), renyi.alias("renyi"), hill.alias("hill"),
                    "richness", chao.alias("chao1"), F.coalesce(ratio(c("shannon"), F.ln("richness")), F.lit(1.0)).alias("pielou"))


def gini_coefficient(df: DataFrame, value, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute pair difference over twice the mean, from the ordered table."""
    s = df.select(*by, num(value).alias("v"))
    t = cumulate(s, "v", {"n": F.count(F.lit(1)).cast("double")}, by)
    mid = c("cum_n") + (c("n") + 1) / 2
    g = t.groupBy(*by).agg(F.sum(c("v") * c("n") * (2 * mid - c("tot_n") - 1)).alias("a"), F.sum(c("v") * c("n")).alias("s"), F.max("tot_n").alias("N"))
    return g.select(*by, ratio(c("a"), c("N") * c("s")).alias("gini"))


# ------------------------------------------------------------------ differential entropies
def entropy_fits(df: DataFrame, value, by: Sequence[str] = ()) -> DataFrame:
    """Entropy of a column under normal, exponential, log-normal, gamma, beta, Student t, Cauchy and
    von Mises laws, each from moments (null where the law does not apply)."""
    v = num(value)
    s = df.select(*by, v.alias("v")).dropna(subset=["v"])
    pos = F.when(c("v") > 0, c("v"))
    m = s.groupBy(*by).agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("v"), F.kurtosis("v").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"),
                           F.avg(F.ln(pos)).alias("ml"), F.var_samp(F.ln(pos)).alias("vl"), F.avg(F.cos("v")).alias("cs"), F.avg(F.sin("v")).alias("sn"))
    q = quantiles(s, "v", [0.25, 0.75], by).select(*by, (c("q1") - c("q0")).alias("iqr"))
    from statweave.operators.association import _merge
    m = _merge([m, q], by)

    @F.pandas_udf("struct<gamma double, beta double, student_t double, von_mises double>")
    def special(x: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in x.itertuples():
            ga = be = st = vm = None
            if r.lo > 0 and r.v and r.v > 0:
                k, th = r.m ** 2 / r.v, r.v / r.m
                ga = k + math.log(th) + math.lgamma(k) + (1 - k) * float(D.digamma(k))
            if r.lo > 0 and r.hi < 1 and r.v and r.v > 0:
                f = r.m * (1 - r.m) / r.v - 1
                if f > 0:
                    a, b = r.m * f, (1 - r.m) * f
                    be = (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b) - (a - 1) * float(D.digamma(a)) - (b - 1) * float(D.digamma(b))
                          + (a + b - 2) * float(D.digamma(a + b)))
            if r.k and r.k > 0 and r.v > 0:
                nu = 4 + 6 / r.k
                scale = math.sqrt(r.v * (nu - 2) / nu)
                st = ((nu + 1) / 2 * float(D.digamma((nu + 1) / 2) - D.digamma(nu / 2)) + 0.5 * math.log(nu)
                      + math.lgamma(nu / 2) + math.lgamma(0.5) - math.lgamma((nu + 1) / 2) + math.log(scale))
            rr = math.hypot(r.cs, r.sn)
            if 0 < rr < 1:
                # A(kappa) = I1/I0 = rr by bisection on quadrature Bessel functions
                th = np.linspace(0, math.pi, 2001)
                bes = lambda kk, o: float(np.trapezoid(np.exp(kk * (np.cos(th) - 1)) * np.cos(o * th), th)) / math.pi
                lo, hi = 0.0, 700.0
                for _ in range(60):
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if bes(mid, 1) / bes(mid, 0) < rr else (lo, mid)
                i0 = bes(lo, 0)
                vm = math.log(2 * math.pi * i0) + lo - lo * bes(lo, 1) / i0
            rows.append((ga, be, st, vm))
        return pd.DataFrame(rows, columns=["gamma", "beta", "student_t", "von_mises"], dtype="float64")

    m = m.withColumn("_s", special(F.struct(*[c(k) for k in ("m", "v", "k", "lo", "hi", "cs", "sn")])))
    return m.select(*by, "n", (0.5 * F.ln(2 * math.pi * math.e * c("v"))).alias("normal"), F.when((c("lo") >= 0) & (c("m") > 0), 1 + F.ln("m")).alias("exponential"),
                    F.when(c("lo") > 0, c("ml") + 0.5 * F.ln(2 * math.pi * math.e * c("vl"))).alias("lognormal"), F.ln(4 * math.pi * c("iqr") / 2).alias("cauchy"),
                    "_s.gamma", "_s.beta", "_s.student_t", "_s.von_mises")


def multivariate_normal_entropy(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    n, _, s = unpack(gram(complete_cases(df, {v: num(v) for v in cols}), list(cols)).first(), len(cols))
    h = 0.5 * (len(cols) * math.log(2 * math.pi * math.e) + np.linalg.slogdet(s / (n - 1))[1])
    return df.sparkSession.createDataFrame([(n, float(h))], "n bigint, entropy double")


def dirichlet_entropy(df: DataFrame, members: Sequence[str], steps: int = 1000) -> DataFrame:
    """Maximum-likelihood Dirichlet from mean logs (fixed-point with Newton digamma inversion)."""
    from statweave.operators.composition import positive_rows
    src = positive_rows(df, members)
    tot = sum((num(m) for m in members), F.lit(0.0))
    r = src.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.ln(num(m) / tot)).alias(f"l{i}") for i, m in enumerate(members)],
                *[F.avg(num(m) / tot).alias(f"m{i}") for i, m in enumerate(members)], F.var_pop(num(members[0]) / tot).alias("v")).first()
    k = len(members)
    logp, mean = np.array([r[f"l{i}"] for i in range(k)]), np.array([r[f"m{i}"] for i in range(k)])
    a = mean * max(mean[0] * (1 - mean[0]) / max(r["v"], 1e-12) - 1, 1e-2)
    for _ in range(steps):
        target = D.digamma(a.sum()) + logp
        x = np.where(target >= -2.22, np.exp(target) + 0.5, -1 / (target + 0.5772156649))
        for _ in range(6):
            x = x - (D.digamma(x) - target) / D.trigamma(x)
        moved = np.max(np.abs(x - a))
        a = x
        if moved < 1e-10:
            break
    s = a.sum()
    h = sum(math.lgamma(v) for v in a) - math.lgamma(s) + (s - k) * float(D.digamma(s)) - float(np.sum((a - 1) * D.digamma(a)))
    return df.sparkSession.createDataFrame([(r["n"], [float(v) for v in a], float(h))], "n bigint, alpha array<double>, entropy double")


def spacing_entropy(df: DataFrame, value, by: Sequence[str] = ()) -> DataFrame:
    """Kozachenko-Leonenko with k = 1 on one column: nearest-neighbour gaps come from the ordered
    distinct values.  Rows that coincide with another have gap 0, carry no density information and
    are counted apart."""
    s = df.select(*by, num(value).alias("v"))
    t = cumulate(s, "v", {"n": F.count(F.lit(1))}, by, lead=True).withColumn("_gap", c("next_value") - c("v"))
    # the gap to the left is the previous row's gap: the axis is mirrored to read it by the same kernel
    m = cumulate(s.select(*by, (-c("v")).alias("v")), "v", {"n": F.count(F.lit(1))}, by, lead=True)
    left = m.select(*[c(b).alias(f"_l_{b}") for b in by], (-c("v")).alias("_lv"), (c("next_value") - c("v")).alias("_lgap"))
    j = t.join(left, [t[b].eqNullSafe(left[f"_l_{b}"]) for b in by] + [t["v"] == left["_lv"]])
    near = F.least(F.coalesce("_gap", "_lgap"), F.coalesce("_lgap", "_gap"))
    g = j.groupBy(*by).agg(F.avg(F.when(c("n") == 1, F.ln(near))).alias("a"), F.sum((c("n") == 1).cast("long")).alias("used"),
                           F.max("tot_n").alias("N"))
    # psi(N) - psi(1) + ln 2 + mean log gap, with psi(N) by its asymptotic series
    x = c("N").cast("double")
    psi = F.ln(x) - 1 / (2 * x) - 1 / (12 * sq(x)) + 1 / (120 * sq(sq(x)))
    return g.select(*by, (psi + 0.5772156649015329 + math.log(2) + c("a")).alias("entropy"), "used", (c("N") - c("used")).alias("tied_rows"))


def binned_entropy(df: DataFrame, value: str, most: int = 20) -> DataFrame:
    from statweave.operators.profile import histogram
    h = histogram(df, [value], most)
    n = h.agg(F.sum("count")).scalar()
    p = ratio(c("count"), c("_n"))
    return h.withColumn("_n", n).agg((-F.sum(F.when(c("count") > 0, p * F.ln(p)))).alias("entropy"))


# ------------------------------------------------------------------ information between categories
def information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information (nats), geometric-mean normalised MI, both entropies."""
    from statweave.plans.contingency import crosstab
    t = crosstab(df, a, b)
    ra = t.groupBy("a").agg(F.sum("o").alias("ra"))
    rb = t.groupBy("b").agg(F.sum("o").alias("rb"))
    n = t.agg(F.sum("o")).scalar()
    j = t.join(ra, "a").join(rb, "b").withColumn("n", n)
    mi = j.agg(F.sum(c("o") / c("n") * F.ln(c("o").cast("double") * c("n") / (c("ra").cast("double") * c("rb")))).alias("mi"))
    ha = ra.withColumn("n", n).agg((-F.sum(c("ra") / c("n") * F.ln(c("ra") / c("n")))).alias("ha"))
    hb = rb.withColumn("n", n).agg((-F.sum(c("rb") / c("n") * F.ln(c("rb") / c("n")))).alias("hb"))
    from statweave.operators.regression import _paste
    return _paste(_paste(mi, ha), hb).select("mi", ratio(c("mi"), F.sqrt(c("ha") * c("hb"))).alias("nmi"), "ha", "hb")


def cross_entropy(df: DataFrame, value: str, group: str, levels: Sequence[str]) -> DataFrame:
    """-sum p ln q of the first group's shares under the second's, and perplexity of the first."""
    v, g = c(value).cast("string"), c(group).cast("string")
    t = df.where(v.isNotNull() & g.isin(list(levels))).groupBy(v.alias("v")).agg(F.sum((g == levels[0]).cast("double")).alias("a"), F.sum((g == levels[1]).cast("double")).alias("b"))
    tot = t.agg(F.struct(F.sum("a").alias("a"), F.sum("b").alias("b"))).scalar()
    t = t.withColumn("_t", tot).select((c("a") / c("_t.a")).alias("p"), (c("b") / c("_t.b")).alias("q"))
    s = t.agg((-F.sum(F.when(c("p") > 0, F.when(c("q") > 0, c("p") * F.ln("q")).otherwise(float("-inf"))))).alias("cross_entropy"),
              (-F.sum(F.when(c("p") > 0, c("p") * F.log2("p")))).alias("_h"))
    return s.select("cross_entropy", F.pow(F.lit(2.0), c("_h")).alias("perplexity"))


# ------------------------------------------------------------------ normalisation
def cpm(df: DataFrame, sample: str, count: str, out: str = "cpm") -> DataFrame:
    lib = df.groupBy(c(sample).alias("_s")).agg(F.sum(num(count)).alias("_lib"))
    return df.join(lib, c(sample) == c("_s")).withColumn(out, ratio(num(count) * 1e6, c("_lib"))).drop("_s", "_lib")


def tpm(df: DataFrame, sample: str, count: str, length: str, out: str = "tpm") -> DataFrame:
    rate = ratio(num(count), num(length))
    lib = df.groupBy(c(sample).alias("_s")).agg(F.sum(rate).alias("_lib"))
    return df.join(lib, c(sample) == c("_s")).withColumn(out, ratio(rate * 1e6, c("_lib"))).drop("_s", "_lib")


def rpkm(df: DataFrame, sample: str, count: str, length: str, out: str = "rpkm") -> DataFrame:
    lib = df.groupBy(c(sample).alias("_s")).agg(F.sum(num(count)).alias("_lib"))
    return df.join(lib, c(sample) == c("_s")).withColumn(out, ratio(num(count) * 1e9, num(length) * c("_lib"))).drop("_s", "_lib")


def robust_z(df: DataFrame, col: str, out: str) -> DataFrame:
    """(x - median) / (1.4826 MAD)."""
    med = quantiles(df.select(num(col).alias("v")), "v", [0.5]).select("q0").scalar()
    dev = df.select(F.abs(num(col) - med).alias("v"))
    mad = quantiles(dev, "v", [0.5]).select("q0").scalar()
    return df.withColumn(out, ratio(num(col) - med, 1.4826 * mad))


def min_max(df: DataFrame, col: str, out: str) -> DataFrame:
    r = df.agg(F.struct(F.min(num(col)).alias("lo"), F.max(num(col)).alias("hi"))).scalar()
    return df.withColumn("_r", r).withColumn(out, ratio(num(col) - c("_r.lo"), c("_r.hi") - c("_r.lo"))).drop("_r")


def inverse_normal_rank(df: DataFrame, col: str, out: str, offset: float = 0.375) -> DataFrame:
    """Normal quantile of (rank - offset) / (n + 1 - 2 offset)."""
    r = ranked(df, col, "_rk")
    p = (c("_rk") - offset) / (c("_rk_n") + 1 - 2 * offset)
    return r.withColumn(out, D.q_norm(p)).drop("_rk", "_rk_n")


def quantile_normalise(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Gives every column the common distribution "mean of the r-th smallest values"; tied values
    share the mean over their ranks.  Ranks inside ties come from a second ordered pass over a key
    hash, so a value held by many rows stays spread out."""
    cols = list(cols)
    src = df.dropna(subset=cols)
    long = src.select(c(key).alias("_key"), F.explode(F.array(*[F.struct(F.lit(v).alias("column"), num(v).alias("v")) for v in cols])).alias("r")).select("_key", "r.*")
    place = cumulate(long, "v", {"n": F.count(F.lit(1))}, ["column"]).select(c("column").alias("_c"), c("v").alias("_v"), c("cum_n").alias("_before"))
    hashed = long.withColumn("_u", F.pmod(F.xxhash64("_key"), F.lit(1 << 52)).cast("double"))
    tie = cumulate(hashed, "_u", {"n": F.count(F.lit(1))}, ["column", "v"])
    # rank of each (column, value, hash); equal hashes would share consecutive ranks
    pos = tie.join(place, (c("column") == c("_c")) & (c("v") == c("_v"))).select("column", "v", (c("_before") + c("cum_n")).alias("r"), "n")
    each = pos.select("column", "v", F.explode(F.sequence(c("r") + 1, c("r") + c("n"))).alias("r"))
    mean = each.groupBy("r").agg(F.avg("v").alias("m"))
    table = each.join(mean, "r").groupBy("column", "v").agg(F.avg("m").alias("m"))
    out = src.select(key, *cols)
    for i, v in enumerate(cols):
        t = table.where(c("column") == v).select(c("v").alias(f"_v{i}"), c("m").alias(f"_m{i}"))
        out = out.join(t, num(v) == c(f"_v{i}"))
    return out.select(key, *[c(f"_m{i}").alias(v) for i, v in enumerate(cols)])


def power_transform(df: DataFrame, col: str, out: str, method: str = "box-cox", rounds: int = 4) -> tuple[DataFrame, float]:
    """Box-Cox or Yeo-Johnson with the likelihood searched on a grid per aggregation, refined around
    the best value."""
    x = num(col)

    def f(lam: float) -> Column:
        if method == "box-cox":
            return F.ln(x) if abs(lam) < 1e-9 else (F.pow(x, F.lit(lam)) - 1) / lam
        up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
        dn = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
        return F.when(x >= 0, up).otherwise(dn)

    jac = F.ln(x) if method == "box-cox" else F.signum(x) * F.log1p(F.abs(x))
    # the search reads logarithms, taken once per row and pass: a power is one exponential of them
    src = (df.where(x > 0) if method == "box-cox" else df.where(x.isNotNull())).select(jac.alias("_j"))
    j = c("_j")

    def of_log(lam: float) -> Column:
        up = j if abs(lam) < 1e-9 else F.exp(j * lam) / lam
        if method == "box-cox":
            return up
        up = up if abs(lam) < 1e-9 else up - 1 / lam
        return F.when(j >= 0, up).otherwise(j if abs(lam - 2) < 1e-9 else (1 - F.exp(j * (lam - 2))) / (2 - lam))

    def likelihoods(grid: np.ndarray) -> list[float]:
        r = src.agg(F.count(j).alias("n"), F.sum(j).alias("j"), *[F.var_pop(of_log(float(v))).alias(f"v{i}") for i, v in enumerate(grid)]).first()
        if not r["n"]:
            return [0.0] * len(grid)
        return [-0.5 * r["n"] * math.log(max(r[f"v{i}"], 1e-300)) + (v - 1) * r["j"] if r[f"v{i}"] is not None and math.isfinite(r[f"v{i}"]) else -math.inf for i, v in enumerate(grid)]

    lo, hi = -3.0, 3.0
    while True:                                     # twice as wide as long as the best value lies at an end
        grid = np.linspace(lo, hi, 25)
        k = int(np.argmax(likelihoods(grid)))
        if 0 < k < 24 or hi - lo > 1e3:
            break
        lo, hi = (2 * lo, hi) if k == 0 else (lo, 2 * hi)
    best, step = float(grid[k]), (hi - lo) / 24
    for _ in range(rounds - 1):
        grid = np.linspace(best - step, best + step, 25)
        best, step = float(grid[int(np.argmax(likelihoods(grid)))]), step / 12
    return df.withColumn(out, F.when(x > 0, f(best)) if method == "box-cox" else f(best)), best


def rarefy(df: DataFrame, members: Sequence[str], key: Sequence[str], depth: int, seed: int = 0) -> DataFrame:
    """Each row's counts thinned to ``depth`` individuals without replacement (rows below it drop
    out).  Draws are seeded by the row key."""
    members = list(members)
    tot = sum((num(m) for m in members), F.lit(0.0))
    src = df.where(tot >= depth).withColumn("_h", F.xxhash64(*key))

    def run(batches):
        for pdf in batches:
            rows = [np.random.default_rng([seed, int(h) & 0x7FFFFFFFFFFFFFFF]).multivariate_hypergeometric(v, depth)
                    for h, v in zip(pdf["_h"], pdf[members].to_numpy(dtype=np.int64))]
            yield pdf.drop(columns="_h").assign(**{m: [int(r[i]) for r in rows] for i, m in enumerate(members)})

    kinds = dict(df.dtypes)
    return src.mapInPandas(run, ", ".join(f"`{v}` {'bigint' if v in members else kinds[v]}" for v in df.columns))


# ------------------------------------------------------------------ variability and clinical
def variability(df: DataFrame, value, by: Sequence[str] = ()) -> DataFrame:
    """SD, CV, MAD, Bernoulli-scaled SD, Fano factor, IQR, SNR, skewness and excess kurtosis."""
    s = df.select(*by, num(value).alias("v")).dropna(subset=["v"])
    m = s.groupBy(*by).agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"), F.skewness("v").alias("skew"), F.kurtosis("v").alias("kurt"))
    q = quantiles(s, "v", [0.25, 0.5, 0.75], by).select(*[c(b).alias(f"_q_{b}") for b in by], c("q1").alias("med"), (c("q2") - c("q0")).alias("iqr"))
    if by:
        dev = beside(s, q, by, [f"_q_{b}" for b in by]).select(*by, F.abs(c("v") - c("med")).alias("d"))
    else:
        dev = s.select(F.abs(c("v") - q.select("med").scalar()).alias("d"))
    mad = quantiles(dev, "d", [0.5], by).select(*by, c("q0").alias("mad"))
    from statweave.operators.association import _merge
    t = _merge([m, q.withColumnsRenamed({f"_q_{b}": b for b in by}), mad], by)
    return t.select(*by, "n", "sd", (100 * ratio(c("sd"), c("m"))).alias("cv"), "mad", ratio(c("sd"), F.sqrt(c("m") * (1 - c("m")))).alias("bernoulli_scaled"),
                    ratio(sq(c("sd")), c("m")).alias("fano"), "iqr", ratio(c("m"), c("sd")).alias("snr"), "skew", "kurt")


def risk_measures(df: DataFrame, exposed, event, by: Sequence[str] = ()) -> DataFrame:
    """Risk difference, NNT, risk ratio and attributable fraction of the exposed."""
    e, y = num(exposed) > 0, num(event) > 0
    r = df.groupBy(*by).agg(F.avg(F.when(e, y.cast("double"))).alias("r1"), F.avg(F.when(~e, y.cast("double"))).alias("r0"))
    rr = ratio(c("r1"), c("r0"))
    return r.select(*by, (c("r1") - c("r0")).alias("risk_difference"), ratio(F.lit(1.0), F.abs(c("r1") - c("r0"))).alias("nnt"), rr.alias("risk_ratio"),
                    ratio(rr - 1, rr).alias("attributable_fraction"))


def incidence(df: DataFrame, event, time, by: Sequence[str] = (), per: float = 1000.0) -> DataFrame:
    r = df.groupBy(*by).agg(F.sum((num(event) > 0).cast("double")).alias("events"), F.sum(num(time)).alias("person_time"))
    return r.select(*by, "events", "person_time", (per * ratio(c("events"), c("person_time"))).alias("rate"))


def standardised_ratio(df: DataFrame, event, time, stratum: str, reference: DataFrame) -> DataFrame:
    """Observed over expected events; ``reference`` gives (stratum, rate per unit time)."""
    o = df.groupBy(c(stratum).alias("_s")).agg(F.sum((num(event) > 0).cast("double")).alias("o"), F.sum(num(time)).alias("t"))
    j = o.join(reference.select(c("stratum"), c("rate")), c("_s") == c("stratum"))
    return j.agg(F.sum("o").alias("observed"), F.sum(c("t") * c("rate")).alias("expected")).withColumn("sir", ratio(c("observed"), c("expected")))
