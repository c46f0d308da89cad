"""Regression tests: closed forms from one Gram matrix, likelihood fits by distributed Newton."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from statweave.functions import distributions as D
from statweave.plans.common import levels_of, num, natural_key, ratio, result, sq
from statweave.plans.cumulate import quantiles
from statweave.plans.gram import complete_cases, design, gram, least_squares, per_row, unpack
from statweave.plans.newton import Fit, linear, newton, outer

c = F.col
Z975 = 1.959963984540054


def _design(df, y, x, by, y_col: Column | None = None):
    xs = design(df, x)
    names = [f"x{i}" for i in range(len(xs))]
    data = complete_cases(df, {**dict(zip(names, xs.values())), "y": num(y) if y_col is None else y_col}, by)
    return data, names, list(xs)


def _fit_rows(df, test_id, fits: dict[tuple, Fit], by, labels, first: int, ratio_name: str | None,
              extra: dict[tuple, dict] | None = None, n_extra: dict[tuple, dict] | None = None) -> DataFrame:
    """Wald rows of iterative fits (one per stratum); further coefficients ride in ``numbers``."""
    rows = []
    for key, f in fits.items():
        est, se, z = f.wald(first)
        p = float(2 * D.norm_sf(abs(z))) if np.isfinite(z) else None
        back = np.exp if ratio_name else (lambda v: v)
        nums = {"se": se, "loglik": f.loglik, "converged": float(f.converged), "gradient": f.gradient}
        for i, name in enumerate(labels[1:], 1):
            e, s, _ = f.wald(first + i)
            nums.update({name: float(back(e)), f"{name}_low": float(back(e - Z975 * s)), f"{name}_high": float(back(e + Z975 * s))})
        nums.update((extra or {}).get(key, {}))
        rows.append((*key, z, p, float(back(est)), float(back(est - Z975 * se)), float(back(est + Z975 * se)),
                     {"rows": int(f.n), **(n_extra or {}).get(key, {})}, {k: float(v) for k, v in nums.items()}))
    schema = ", ".join([f"`{b}` string" for b in by] + ["z double", "p double", "e double", "lo double", "hi double",
                                                       "ns map<string,bigint>", "nums map<string,double>"])
    s = df.sparkSession.createDataFrame(rows, schema)
    name = f"{ratio_name} ({labels[0]})" if ratio_name else f"slope ({labels[0]})"
    return s.select(*by, F.lit(test_id).alias("test_id"), c("z").alias("statistic"), "p",
                    F.struct(F.lit(name).alias("name"), c("e").alias("value"), c("lo").alias("ci_low"),
                             c("hi").alias("ci_high")).alias("effect"), c("ns").alias("n"), c("nums").alias("numbers"))


# ------------------------------------------------------------------ least squares
def ols(df, y, x, by=(), alternative="two-sided", robust: bool = True) -> DataFrame:
    """OLS of y on x (numeric or indicators).  HC3 needs leverages, hence a second pass that joins
    each stratum's coefficients to its rows."""
    by = list(by)
    data, names, labels = _design(df, y, x, by)
    k = len(names)
    types = [f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by]

    def fit(row):
        n, m, s = unpack(row, k + 1)
        f = least_squares(n, m, s)
        adj = 1 - (1 - f["r2"]) * (n - 1) / f["dof"] if f["dof"] > 0 else float("nan")
        return {**{b: row[b] for b in by}, "n": n, "beta": [f["intercept"], *f["beta"]], "m": list(m[:k]),
                "inv": f["inv"].ravel().tolist(), "se": float(f["se"][0]), "dof": f["dof"], "r2": f["r2"], "adj": adj}

    fits = per_row(gram(data, [*names, "y"], by), fit, ", ".join(
        types + ["n bigint", "beta array<double>", "m array<double>", "inv array<double>", "se double", "dof bigint",
                 "r2 double", "adj double"]))
    s = fits
    if robust:
        meat = _hc3_meat(data, fits, names, by)
        s = fits.join(meat, by) if by else _paste(fits, meat)
    s = s.withColumn("b", c("beta")[1]).withColumn("t", ratio(c("beta")[1], c("se")))
    half = D.q_t(0.975, c("dof")) * c("se")
    nums = {"r2": c("r2"), "adj_r2": c("adj"), "se": c("se"), "intercept": c("beta")[0], "df": c("dof")}
    nums |= {lab: c("beta")[i + 2] for i, lab in enumerate(labels[1:])}
    if robust:
        nums["hc3_se"] = c("hc3_se")
        nums["hc3_p"] = D.p_t(ratio(c("b"), c("hc3_se")), c("dof"))
    return result(s, "T-802", by=by, statistic=c("t"), p=D.p_t(c("t"), c("dof"), alternative),
                  effect_name=f"slope ({labels[0]})", effect=c("b"), ci=(c("b") - half, c("b") + half),
                  n={"rows": c("n")}, numbers=nums)


def _paste(a: DataFrame, b: DataFrame) -> DataFrame:
    """Side by side of two one-row frames."""
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def _hc3_meat(data, fits, names, by) -> DataFrame:
    k = len(names)
    keep = fits.select(*by, "beta", "m", "inv", c("n").alias("_n"))
    if by:
        j = data.join(keep, list(by))
    else:
        r = keep.first()
        j = data.withColumns({"beta": F.array(*[F.lit(float(v)) for v in r["beta"]]), "m": F.array(*[F.lit(float(v)) for v in r["m"]]),
                              "inv": F.array(*[F.lit(float(v)) for v in r["inv"]]), "_n": F.lit(r["_n"])})
    d = [c(nm) - c("m")[i] for i, nm in enumerate(names)]
    proj = [sum((c("inv")[i * k + q] * d[q] for q in range(k)), F.lit(0.0)) for i in range(k)]   # (X'X)^-1 d
    lev = 1 / c("_n") + sum((d[i] * proj[i] for i in range(k)), F.lit(0.0))
    fitted = c("beta")[0] + sum((c("beta")[i + 1] * c(nm) for i, nm in enumerate(names)), F.lit(0.0))
    u = (c("y") - fitted) / F.greatest(1 - lev, F.lit(1e-12))
    return j.groupBy(*by).agg(F.sqrt(F.sum(sq(u * proj[0]))).alias("hc3_se"))


def interaction_regression(df, y, a: str, b: str, by=(), alternative="two-sided") -> DataFrame:
    """y on a, b and their product; numeric factors are centred so main effects stay readable."""
    by = list(by)
    da, db = design(df, a), design(df, b)
    cols, centre = {}, []
    for pre, d in (("a", da), ("b", db)):
        for i, col in enumerate(d.values()):
            cols[f"{pre}{i}"] = col
        if len(d) == 1 and next(iter(d)) in (a, b):
            centre.append(f"{pre}0")
    data = complete_cases(df, {**cols, "y": num(y)}, by)
    if centre:
        m = data.groupBy(*by).agg(*[F.avg(v).alias(f"_m{v}") for v in centre])
        if by:
            data = data.join(m, by)
        else:
            r = m.first()
            data = data.withColumns({f"_m{v}": F.lit(r[f"_m{v}"]) for v in centre})
        data = data.withColumns({v: c(v) - c(f"_m{v}") for v in centre})
    an, bn = [v for v in cols if v[0] == "a"], [v for v in cols if v[0] == "b"]
    inter = [(p, q) for p in an for q in bn]
    # interaction first, so coefficient 0 is the one reported
    names = [f"i{i}" for i in range(len(inter))] + an + bn
    data = data.withColumns({f"i{i}": c(p) * c(q) for i, (p, q) in enumerate(inter)})
    lab = {**dict(zip(an, da)), **dict(zip(bn, db))}
    k = len(names)

    def fit(row):
        n, m_, s = unpack(row, k + 1)
        f = least_squares(n, m_, s)
        return {**{v: row[v] for v in by}, "n": n, "b": float(f["beta"][0]), "se": float(f["se"][0]), "dof": f["dof"],
                "r2": f["r2"], "adj": 1 - (1 - f["r2"]) * (n - 1) / f["dof"], "all": [float(v) for v in f["beta"][:len(inter)]]}

    s = per_row(gram(data, [*names, "y"], by), fit, ", ".join(
        [f"`{v}` {df.schema[v].dataType.simpleString()}" for v in by]
        + ["n bigint", "b double", "se double", "dof bigint", "r2 double", "adj double", "all array<double>"]))
    s = s.withColumn("t", ratio(c("b"), c("se")))
    half = D.q_t(0.975, c("dof")) * c("se")
    title = [f"{lab[p]}:{lab[q]}" for p, q in inter]
    return result(s, "T-403", by=by, statistic=c("t"), p=D.p_t(c("t"), c("dof"), alternative),
                  effect_name=f"interaction ({title[0]})", effect=c("b"), ci=(c("b") - half, c("b") + half), n={"rows": c("n")},
                  numbers={"r2": c("r2"), "adj_r2": c("adj"), "se": c("se"),
                           **{t: c("all")[i + 1] for i, t in enumerate(title[1:])}})


# ------------------------------------------------------------------ likelihood fits
def logistic(df, y, x, by=(), alternative="two-sided") -> DataFrame:
    """Odds ratio of x; the larger of y's two values is the event."""
    vals = [r[0] for r in df.select(num(y).alias("v")).dropna().distinct().limit(3).collect()]
    if len(vals) != 2:
        raise ValueError(f"{y!r} is not binary")
    hit = (num(y) == max(vals)).cast("double")
    data, names, labels = _design(df, y, x, by, hit)
    cols = [F.lit(1.0), *[c(v) for v in names]]

    def terms(th):
        eta = linear(th, names)
        mu = 1 / (1 + F.exp(-eta))
        # log(1+e^eta) without overflow
        soft = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
        return c("y") * eta - soft, [(c("y") - mu) * v for v in cols], outer(-mu * (1 - mu), cols)

    size = len(names) + 1

    def start(r):
        p = min(max(r["m"], 1e-6), 1 - 1e-6)
        return np.array([np.log(p / (1 - p))] + [0.0] * (size - 1))

    fits = newton(data, by, start, terms, size, {"m": F.avg("y")})
    ev = {tuple(str(r[b]) for b in by): r for r in data.groupBy(*by).agg(F.sum("y").alias("e"), F.count("y").alias("n")).collect()}
    extra, counts = {}, {}
    for k in fits:
        e, n = ev[k]["e"], ev[k]["n"]
        null = e * np.log(e / n) + (n - e) * np.log(1 - e / n) if 0 < e < n else 0.0
        extra[k] = {"pseudo_r2": 1 - fits[k].loglik / null if null else float("nan"), "epv": min(e, n - e) / max(1, len(names))}
        counts[k] = {"events": int(e)}
    return _fit_rows(df, "T-801", fits, list(by), labels, 1, "OR", extra, counts)


def poisson(df, y, x, by=(), alternative="two-sided", dispersion_limit: float = 1.5) -> DataFrame:
    """Rate ratio of x; refitted as negative binomial where Pearson dispersion exceeds the limit."""
    by = list(by)
    data, names, labels = _design(df, y, x, by)
    bad = data.agg(F.sum(((c("y") < 0) | (F.abs(c("y") - F.rint("y")) > 1e-8)).cast("long"))).first()[0]
    if bad:
        raise ValueError(f"{y!r} must hold counts")
    cols = [F.lit(1.0), *[c(v) for v in names]]
    size = len(cols)

    def terms(th):
        eta = linear(th, names)
        mu = F.exp(eta)
        return c("y") * eta - mu, [(c("y") - mu) * v for v in cols], outer(-mu, cols)

    def start(r):
        return np.array([np.log(max(r["m"], 1e-8))] + [0.0] * (size - 1))

    fits = newton(data, by, start, terms, size, {"m": F.avg("y")})
    from statweave.plans.newton import with_theta
    typed = data.withColumns({b: c(b).cast("string") for b in by})
    th = [F.element_at("_theta", i + 1) for i in range(size)]
    mu = F.exp(linear(th, names))
    chi = with_theta(typed, {k: f.theta for k, f in fits.items()}, by).groupBy(*by).agg(
        F.sum(sq(c("y") - mu) / mu).alias("x2"), F.count("y").alias("n"), F.sum("y").alias("tot")).collect()
    extra, counts, over = {}, {}, {}
    for r in chi:
        k = tuple(r[b] for b in by)
        disp = r["x2"] / max(1, r["n"] - size)
        extra[k] = {"dispersion": disp, "negative_binomial": 0.0}
        counts[k] = {"total_count": int(r["tot"])}
        if disp > dispersion_limit:
            over[k] = disp
    if over:
        pick = typed
        if by:
            keys = df.sparkSession.createDataFrame([list(k) for k in over], ", ".join(f"`{b}` string" for b in by))
            pick = typed.join(keys, by, "left_semi")
        nb = _negative_binomial(pick, names, by, {k: (fits[k].theta, over[k]) for k in over})
        for k, f in nb.items():
            if f.converged:
                fits[k] = Fit(f.theta[:-1], f.cov[:-1, :-1], f.loglik, f.n, f.converged, f.gradient)
                extra[k] |= {"negative_binomial": 1.0, "alpha": float(np.exp(f.theta[-1]))}
    return _fit_rows(df, "T-803", fits, by, labels, 1, "IRR", extra, counts)


def _vec(fn, *cols: Column) -> Column:
    """Arrow-batched numpy special function inside the likelihood."""
    return D._wrap(fn, *cols)


def _negative_binomial(data, names, by, start_at: dict[tuple, tuple]) -> dict[tuple, Fit]:
    """NB2 with log alpha as the last parameter.  The special functions depend on (y, alpha) only,
    so rows collapse to distinct (y, x) before any Python runs."""
    data = data.groupBy(*by, *names, "y").agg(F.count(F.lit(1)).cast("double").alias("_w"))
    cols = [F.lit(1.0), *[c(v) for v in names]]
    size = len(cols) + 1

    def terms(th):
        eta = linear(th[:-1], names)
        mu, a = F.exp(eta), F.exp(th[-1])
        r = 1 / a
        y, w = c("y"), c("_w")
        lg = _vec(lambda u, v: D.lgamma(u + v) - D.lgamma(v), y, r)
        dg = _vec(lambda u, v: D.digamma(u + v) - D.digamma(v), y, r)
        tg = _vec(lambda u, v: D.trigamma(u + v) - D.trigamma(v), y, r)
        ll = w * (lg + r * F.ln(r / (r + mu)) + y * F.ln(mu / (r + mu)))
        e = w * (y - mu) / (1 + a * mu)
        g_r = dg + F.ln(r / (r + mu)) + (mu - y) / (r + mu)          # d ll / d r
        h_rr = tg + 1 / r - 1 / (r + mu) - (mu - y) / sq(r + mu)
        grad = [e * v for v in cols] + [w * g_r * (-r)]               # r = exp(-theta_a)
        hess = outer(-w * mu * (1 + a * y) / sq(1 + a * mu), cols)
        cross = w * (y - mu) * mu / sq(r + mu)                        # d2 ll / d eta d r
        for i, v in enumerate(cols):
            hess[(i, size - 1)] = cross * v * (-r)
        hess[(size - 1, size - 1)] = w * (h_rr * sq(r) + g_r * r)
        return ll, grad, hess

    def start(row):
        key = tuple(row[b] for b in by)
        theta, disp = start_at[key]
        return np.array([*theta, np.log(max((disp - 1) / max(np.exp(theta[0]), 1e-3), 1e-3))])

    fits = newton(data, by, start, terms, size)
    rows = {tuple(r[b] for b in by): r["n"] for r in data.groupBy(*by).agg(F.sum("_w").cast("long").alias("n")).collect()}
    for k, f in fits.items():
        f.n = rows[k]
    return fits


def ordinal(df, y, x, by=(), alternative="two-sided", levels: Sequence[str] | None = None) -> DataFrame:
    """Proportional odds with 3-20 ordered levels (numeric order when they are numbers)."""
    lv = [str(v) for v in levels] if levels else levels_of(df, y, 21)
    if not levels and not all(natural_key(v)[0] == 0 for v in lv):
        lv = sorted(lv)
    if not 3 <= len(lv) <= 20:
        raise ValueError(f"need 3 to 20 ordered levels, found {len(lv)}")
    pos = F.create_map(*[q for i, v in enumerate(lv) for q in (F.lit(v), F.lit(float(i)))])
    data, names, labels = _design(df, y, x, by, pos[c(y).cast("string")])
    k, m = len(lv), len(names)
    size = m + k - 1                         # slopes first, then increasing cut points

    def terms(th):
        xb = sum((th[i] * c(v) for i, v in enumerate(names)), F.lit(0.0))
        cuts = F.array(*th[m:])
        yi = c("y").cast("int")
        has_up, has_lo = yi < k - 1, yi > 0
        up = F.when(has_up, F.element_at(cuts, F.least(yi + 1, F.lit(k - 1))) - xb)
        lo = F.when(has_lo, F.element_at(cuts, F.greatest(yi, F.lit(1))) - xb)
        sig = lambda v: 1 / (1 + F.exp(-v))
        fu, fl = F.when(has_up, sig(up)).otherwise(1.0), F.when(has_lo, sig(lo)).otherwise(0.0)
        p = F.greatest(fu - fl, F.lit(1e-300))
        du, dl = fu * (1 - fu), fl * (1 - fl)
        gu, gl = du / p, -dl / p
        huu = du * (1 - 2 * fu) / p - sq(gu)
        hll = -dl * (1 - 2 * fl) / p - sq(gl)
        hul = -gu * gl
        # derivative of (up, lo) by each parameter
        dup = [-c(v) for v in names] + [((yi == j) & has_up).cast("double") for j in range(k - 1)]
        dlo = [-c(v) for v in names] + [((yi == j + 1) & has_lo).cast("double") for j in range(k - 1)]
        dup = [F.when(has_up, v).otherwise(0.0) for v in dup]
        dlo = [F.when(has_lo, v).otherwise(0.0) for v in dlo]
        grad = [gu * a + gl * b for a, b in zip(dup, dlo)]
        hess = {(i, j): huu * dup[i] * dup[j] + hll * dlo[i] * dlo[j] + hul * (dup[i] * dlo[j] + dlo[i] * dup[j])
                for i in range(size) for j in range(i, size)}
        return F.ln(p), grad, hess

    def start(r):
        cum = np.cumsum([max(r[f"c{j}"], 0.5) for j in range(k)])
        q = np.clip(cum[:-1] / cum[-1], 1e-6, 1 - 1e-6)
        return np.concatenate([np.zeros(m), np.log(q / (1 - q))])

    prep = {f"c{j}": F.sum((c("y") == j).cast("double")) for j in range(k)}
    fits = newton(data, by, start, terms, size, prep)
    return _fit_rows(df, "T-804", fits, list(by), labels, 0, "OR",
                     n_extra={key: {"categories": k} for key in fits})


def beta_regression(df, y, x, by=(), alternative="two-sided") -> DataFrame:
    """Mean on the logit scale with one precision; exact 0/1 are squeezed inwards."""
    by = list(by)
    data, names, labels = _design(df, y, x, by)
    facts = data.groupBy(*by).agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.count("y").alias("_c"),
                                  F.sum(((c("y") <= 0) | (c("y") >= 1)).cast("long")).alias("sq"))
    rng = facts.agg(F.min("lo"), F.max("hi")).first()
    if rng[0] < 0 or rng[1] > 1:
        raise ValueError(f"{y!r} must lie in [0, 1]")
    if by:
        data = data.join(facts, by)
    else:
        f = facts.first()
        data = data.withColumns({"_c": F.lit(f["_c"]), "sq": F.lit(f["sq"])})
    data = data.withColumn("y", F.when(c("sq") > 0, (c("y") * (c("_c") - 1) + 0.5) / c("_c")).otherwise(c("y")))
    data = data.select(*by, *names, "y", F.ln(c("y") / (1 - c("y"))).alias("ly"), F.log1p(-c("y")).alias("l1"))
    cols = [F.lit(1.0), *[c(v) for v in names]]
    size = len(cols) + 1

    def terms(th):
        eta = linear(th[:-1], names)
        mu, phi = 1 / (1 + F.exp(-eta)), F.exp(th[-1])
        a, b = mu * phi, (1 - mu) * phi
        ll = _vec(lambda p, u, v: D.lgamma(p) - D.lgamma(u) - D.lgamma(v), phi, a, b) + (a - 1) * (c("ly") + c("l1")) + (b - 1) * c("l1")
        da, db = _vec(D.digamma, a), _vec(D.digamma, b)
        ta, tb = _vec(D.trigamma, a), _vec(D.trigamma, b)
        ms = da - db                                        # expected logit
        w = mu * (1 - mu)
        gphi = mu * (c("ly") - ms) + c("l1") - db + _vec(D.digamma, phi)
        grad = [phi * (c("ly") - ms) * w * v for v in cols] + [gphi * phi]
        # expected information (Fisher scoring)
        hess = outer(-sq(phi * w) * (ta + tb), cols)
        cr = -phi * w * (mu * ta - (1 - mu) * tb) * phi
        for i, v in enumerate(cols):
            hess[(i, size - 1)] = cr * v
        hess[(size - 1, size - 1)] = -sq(phi) * (sq(mu) * ta + sq(1 - mu) * tb - _vec(D.trigamma, phi))
        return ll, grad, hess

    def start(r):
        m_, v = r["m"], max(r["v"] or 1e-4, 1e-8)
        return np.array([np.log(m_ / (1 - m_))] + [0.0] * (size - 2) + [np.log(max(m_ * (1 - m_) / v - 1, 0.1))])

    fits = newton(data, by, start, terms, size, {"m": F.avg("y"), "v": F.var_pop("y")})
    return _fit_rows(df, "T-805", fits, by, labels, 1, "OR",
                     extra={k: {"precision": float(np.exp(f.theta[-1]))} for k, f in fits.items()})


def huber(df, y, x, tuning: float = 1.345, max_iter: int = 50, tol: float = 1e-8, alternative="two-sided") -> DataFrame:
    """Huber regression by reweighting; scale = normal-consistent median absolute residual."""
    data, names, labels = _design(df, y, x, [])
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        k = len(names)
        n, m, s = unpack(gram(data, [*names, "y"]).first(), k + 1)
        first = least_squares(n, m, s)
        beta = np.array([first["intercept"], *first["beta"]])
        cols = [F.lit(1.0), *[c(v) for v in names]]
        d = [F.lit(1.0), *[c(v) - F.lit(float(m[i])) for i, v in enumerate(names)]]

        def resid(b):
            return c("y") - sum((F.lit(float(v)) * col for v, col in zip(b, cols)), F.lit(0.0))

        def scale_of(b):
            r = resid(b)
            med = quantiles(data.select(F.abs(r).alias("_r")), "_r", [0.5], total=n).first()
            return (med["q0"] or 0.0) / 0.6744897501960817       # normal quartile

        scale = scale_of(beta)
        converged = False
        for _ in range(max_iter):
            if scale == 0:
                converged = True
                break
            u = F.abs(resid(beta)) / scale
            w = F.when(u <= tuning, 1.0).otherwise(F.lit(tuning) / u)
            pr = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
            row = data.agg(*[F.sum(w * d[i] * d[j]) for i, j in pr], *[F.sum(w * d[i] * resid(beta)) for i in range(k + 1)]).first()
            xtx = np.zeros((k + 1, k + 1))
            for v, (i, j) in zip(row, pr):
                xtx[i, j] = xtx[j, i] = v
            step = np.linalg.solve(xtx, np.array(row[len(pr):], float))
            delta = step.copy()
            delta[0] = step[0] - float(step[1:] @ m[:k])
            beta = beta + delta
            scale = scale_of(beta)
            if np.max(np.abs(delta) / np.maximum(np.abs(beta), 1e-8)) < tol:
                converged = True
                break
        u = resid(beta) / (scale or 1.0)
        inside = F.abs(u) <= tuning
        psi = F.when(inside, u).otherwise(tuning * F.signum(u))
        facts = data.agg(F.avg(inside.cast("double")), F.sum(sq(psi)), F.sum((tuning / F.greatest(F.abs(u), F.lit(1e-12)) < 0.9).cast("long")),
                         F.var_pop(inside.cast("double")), *[F.avg(psi * v) for v in d]).first()
        mbar, p = facts[0], k + 1
        corr = 1 + p / n * facts[3] / mbar ** 2
        xtx_inv = np.linalg.pinv(s[:k, :k])
        cov = corr ** 2 * (facts[1] * scale ** 2 / (n - p)) / mbar ** 2 * xtx_inv
        se = float(np.sqrt(cov[0, 0]))
        z = float(beta[1] / se)
        one = df.sparkSession.range(1)
        return result(one, "T-806", statistic=F.lit(z), p=F.lit(float(2 * D.norm_sf(abs(z)))), effect_name=f"slope ({labels[0]})",
                      effect=F.lit(float(beta[1])), ci=(F.lit(float(beta[1] - Z975 * se)), F.lit(float(beta[1] + Z975 * se))),
                      n={"rows": F.lit(n), "down_weighted": F.lit(int(facts[2] or 0))},
                      numbers={"ols_slope": F.lit(float(first["beta"][0])), "scale": F.lit(float(scale)), "se": F.lit(se),
                               "converged": F.lit(float(converged)), "gradient": F.lit(float(np.max(np.abs(np.array(facts[4:], float) / np.array([1.0, *np.sqrt(np.maximum(np.diag(s)[:k] / n, 1e-300))])))))})
    finally:
        data.unpersist()
