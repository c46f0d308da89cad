"""Tail areas and quantiles of the reference distributions.

Small vectorised numpy routines plus ``Column`` wrappers.  They are only ever applied to
*result* rows (one per stratum or comparison), never to the input table, so the Arrow hop is
paid once per reported statistic.
"""
from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
_N01 = NormalDist()


# ---------------------------------------------------------------- scalar / array routines
def norm_sf(z):
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2.0))


def norm_ppf(q):
    q = np.asarray(q, float)
    out = np.full(q.shape, np.nan)
    ok = (q > 0) & (q < 1)
    out[ok] = [_N01.inv_cdf(v) for v in q[ok]]
    out[q == 0], out[q == 1] = -np.inf, np.inf
    return out if out.shape else float(out)


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def betainc(a, b, x):
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    bad = ~((a > 0) & (b > 0) & np.isfinite(a) & np.isfinite(b) & (x >= 0) & (x <= 1))
    a1, b1 = np.where(bad, 1.0, a), np.where(bad, 1.0, b)
    x1 = np.clip(np.where(bad, 0.5, x), 0.0, 1.0)
    inner = np.clip(x1, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a1 + b1) - _lgamma(a1) - _lgamma(b1)
                   + a1 * np.log(inner) + b1 * np.log1p(-inner))
    flip = inner > (a1 + 1) / (a1 + b1 + 2)
    p, q, z = np.where(flip, b1, a1), np.where(flip, a1, b1), np.where(flip, 1 - inner, inner)
    part = front * _beta_fraction(p, q, z) / p
    out = np.where(flip, 1 - part, part)
    out = np.where(x1 <= 0, 0.0, np.where(x1 >= 1, 1.0, out))
    return np.where(bad, np.nan, out)


def gammaincc(a, x):
    """Upper regularised incomplete gamma Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    bad = ~((a > 0) & np.isfinite(x))
    aa, xx = np.where(bad, 1.0, a), np.maximum(np.where(bad, 1.0, x), 1e-300)
    front = np.exp(aa * np.log(xx) - xx - _lgamma(aa))
    term = 1.0 / aa
    total, n = term.copy(), aa.copy()
    for _ in range(5000):
        n = n + 1
        term = term * xx / n
        total = total + term
        if np.all((np.abs(term) < 1e-16 * np.abs(total)) | (xx >= aa + 1)):
            break
    lower = front * total
    b = xx + 1 - aa
    c = np.full_like(xx, 1e300)
    d = 1.0 / np.where(b == 0, 1e-300, b)
    h = d.copy()
    for i in range(1, 2000):
        an = -i * (i - aa)
        b = b + 2
        d = an * d + b
        d = 1.0 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        step = d * c
        h = h * step
        if np.all((np.abs(step - 1) < 1e-15) | (xx < aa + 1)):
            break
    out = np.where(xx < aa + 1, 1 - lower, front * h)
    out = np.where(x <= 0, 1.0, out)
    return np.where(bad, np.where(np.isposinf(x), 0.0, np.nan), out)


def t_sf(t, df):
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    tail = 0.5 * betainc(df / 2, 0.5, df / (df + t * t))
    return np.where(np.isinf(t), np.where(t > 0, 0.0, 1.0), np.where(t >= 0, tail, 1 - tail))


def f_sf(f, d1, d2):
    f, d1, d2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (f, d1, d2)))
    return np.where(np.isinf(f), 0.0, betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0))))


def chi2_sf(x, df):
    return gammaincc(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def bisect(fn, target, lo, hi, steps=200):
    """Vectorised root of an increasing function ``fn(x) = target``."""
    for _ in range(steps):
        mid = (lo + hi) / 2
        below = fn(mid) < target
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def t_ppf(q, df):
    q, df = np.broadcast_arrays(np.asarray(q, float), np.asarray(df, float))
    side = np.sign(q - 0.5)
    tail = np.minimum(q, 1 - q)
    span = np.full(q.shape, 1.0)
    for _ in range(60):
        grow = t_sf(span, df) > tail
        if not np.any(grow):
            break
        span = np.where(grow, span * 2, span)
    return side * bisect(lambda v: -t_sf(v, df), -tail, np.zeros(q.shape), span, 80)


def beta_ppf(q, a, b):
    q = np.asarray(q, float)
    return bisect(lambda v: betainc(a, b, v), q, np.zeros(q.shape), np.ones(q.shape), 100)


def binom_sf(k, n, p=0.5):
    """P(X >= k)."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    return np.where(k <= 0, 1.0, np.where(k > n, 0.0,
                    betainc(np.maximum(k, 1), np.maximum(n - k + 1, 1e-9), p)))


def digamma(x):
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift = shift - np.where(low, 1 / x, 0.0)
        x = np.where(low, x + 1, x)
    i2 = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - i2 * (1 / 12 - i2 * (1 / 120 - i2 * (1 / 252 - i2 / 240)))


def trigamma(x):
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift = shift + np.where(low, 1 / (x * x), 0.0)
        x = np.where(low, x + 1, x)
    i1, i2 = 1 / x, 1 / (x * x)
    return shift + i1 + i2 / 2 + i1 * i2 * (1 / 6 - i2 * (1 / 30 - i2 * (1 / 42 - i2 / 30)))


lgamma = _lgamma


# ---------------------------------------------------------------- finite-sample null laws
def mann_whitney_p(u1, n1, n2, tie_sum, alternative="two-sided"):
    """p of U for the first sample; exact for a small untied sample, else normal with the
    half-unit continuity step and tie-corrected variance."""
    n1, n2 = int(n1), int(n2)
    if min(n1, n2) <= 8 and max(n1, n2) <= 400 and tie_sum == 0:
        ways = np.zeros(n1 * n2 + 1)
        ways[0] = 1.0
        small, large = min(n1, n2), max(n1, n2)
        for j in range(1, small + 1):          # q-binomial coefficient, factor by factor
            up, down = large + j, j
            for i in range(n1 * n2, up - 1, -1):
                ways[i] -= ways[i - up]
            for i in range(down, n1 * n2 + 1):
                ways[i] += ways[i - down]
        pmf = ways / ways.sum()
        ge = float(pmf[int(math.ceil(u1 - 1e-9)):].sum())
        le = float(pmf[: int(math.floor(u1 + 1e-9)) + 1].sum())
        return min(1.0, {"greater": ge, "less": le}.get(alternative, 2 * min(ge, le)))
    n = n1 + n2
    mu = n1 * n2 / 2
    sd = math.sqrt(max(n1 * n2 / 12 * ((n + 1) - tie_sum / (n * (n - 1))), 0.0))
    if sd == 0:
        return 1.0
    if alternative == "greater":
        return float(norm_sf((u1 - mu - 0.5) / sd))
    if alternative == "less":
        return float(norm_sf((mu - u1 - 0.5) / sd))
    return min(1.0, 2 * float(norm_sf((abs(u1 - mu) - 0.5) / sd)))


def signed_rank_p(w_plus, n, tie_sum, zeros, alternative="two-sided"):
    """Wilcoxon signed rank: exact for n <= 50 without ties or zeros, else normal."""
    n = int(n)
    if n == 0:
        return float("nan")
    if n <= 50 and tie_sum == 0 and zeros == 0:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k]
        pmf = ways / 2.0 ** n
        ge = float(pmf[int(math.ceil(w_plus - 1e-9)):].sum())
        le = float(pmf[: int(math.floor(w_plus + 1e-9)) + 1].sum())
        return min(1.0, {"greater": ge, "less": le}.get(alternative, 2 * min(ge, le)))
    mu, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - tie_sum / 48
    z = (w_plus - mu) / math.sqrt(var) if var > 0 else 0.0
    return float({"greater": norm_sf(z), "less": norm_sf(-z)}.get(alternative, 2 * norm_sf(abs(z))))


def ks_p(d, n1, n2, alternative="two-sided"):
    """Two-sample KS: exact lattice-path count while n1*n2 is small, else the limit law."""
    n1, n2 = int(n1), int(n2)
    if n1 * n2 == 0:
        return float("nan")
    if n1 * n2 <= 1_000_000:
        # share of monotone paths (0,0)->(n1,n2) that stay strictly inside |i/n1 - j/n2| < d
        j = np.arange(n2 + 1)
        row = np.zeros(n2 + 1)
        for i in range(n1 + 1):
            gap = i / n1 - j / n2
            inside = (np.abs(gap) if alternative == "two-sided"
                      else gap if alternative == "greater" else -gap) < d - 1e-12
            new = np.zeros(n2 + 1)
            for k in range(n2 + 1):
                if not inside[k]:
                    continue
                if i == 0 and k == 0:
                    new[k] = 1.0
                else:   # probabilities of the reversed walk keep the numbers in [0, 1]
                    left = new[k - 1] * k / (i + k) if k else 0.0
                    down = row[k] * i / (i + k) if i else 0.0
                    new[k] = left + down
            row = new
        return float(min(1.0, max(0.0, 1 - row[n2])))
    en = math.sqrt(n1 * n2 / (n1 + n2))
    if alternative != "two-sided":
        return min(1.0, math.exp(-2 * (en * d) ** 2))
    x = en * d
    if x < 0.2:
        return 1.0
    k = np.arange(1, 101)
    return float(min(1.0, max(0.0, 2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * (k * x) ** 2)))))


def cvm_p(t_stat, n1, n2):
    """Limit law of the two-sample Cramer-von Mises statistic after location/scale matching."""
    n = n1 + n2
    mean = (1 + 1 / n) / 6
    var = (n + 1) * (4 * n1 * n2 * n - 3 * (n1 ** 2 + n2 ** 2) - 2 * n1 * n2) / (
        45 * n ** 2 * 4 * n1 * n2)
    x = 1 / 6 + (t_stat - mean) / math.sqrt(45 * var)
    if x < 0.003:
        return 1.0
    s = np.linspace(0, 12, 6001)
    total = 0.0
    for k in range(40):
        arg = (4 * k + 1) ** 2 / (16 * x)
        bessel = float(np.trapezoid(np.exp(-arg * np.cosh(s)) * np.cosh(s / 4), s))
        total += (math.exp(math.lgamma(k + 0.5) - math.lgamma(k + 1)) / math.sqrt(math.pi)
                  * math.sqrt(4 * k + 1) * math.exp(-arg) * bessel)
    return float(min(1.0, max(0.0, 1 - total / (math.pi * math.sqrt(x)))))


def fisher_exact_p(a, b, c, d, alternative="two-sided"):
    """Hypergeometric tail of a 2x2 table, summed outwards until terms vanish."""
    a, b, c, d = (int(v) for v in (a, b, c, d))
    r1, c1, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, r1 + c1 - n), min(r1, c1)
    lg = math.lgamma
    base = lg(r1 + 1) + lg(n - r1 + 1) + lg(c1 + 1) + lg(n - c1 + 1) - lg(n + 1)

    def logp(x):
        return (base - lg(x + 1) - lg(r1 - x + 1) - lg(c1 - x + 1) - lg(n - r1 - c1 + x + 1))

    def tail(start, step):
        total, x = 0.0, start
        while lo <= x <= hi:
            xs = np.arange(x, x + step * 100_000, step)
            xs = xs[(xs >= lo) & (xs <= hi)].astype(float)
            terms = np.exp(base - _lgamma(xs + 1) - _lgamma(r1 - xs + 1)
                           - _lgamma(c1 - xs + 1) - _lgamma(n - r1 - c1 + xs + 1))
            total += float(terms.sum())
            if terms[-1] < 1e-18 * max(total, 1e-300) or terms[-1] == 0.0:
                break
            x += step * 100_000
        return total

    if alternative == "greater":
        return min(1.0, tail(a, 1))
    if alternative == "less":
        return min(1.0, tail(a, -1))
    mode = min(max((r1 + 1) * (c1 + 1) // (n + 2), lo), hi)
    cut = logp(a) + 1e-7
    step = -1 if a >= mode else 1            # the far tail starts where the mass drops to p(a)
    near = tail(a, -step)
    edge = lo if step == -1 else hi
    if logp(edge) > cut:
        return min(1.0, near)
    inside, outside = mode, edge             # invariant: p(outside) <= p(a) <= p(inside)
    if logp(mode) <= cut:
        return 1.0
    while abs(inside - outside) > 1:
        mid = (inside + outside) // 2
        inside, outside = (mid, outside) if logp(mid) > cut else (inside, mid)
    return min(1.0, near + tail(outside, step))


def studentized_range_sf(q, k, df):
    """P(range of k normals / chi-scale > q) by quadrature over the scale and the location."""
    if not np.isfinite(q) or q <= 0:
        return 1.0
    z = np.linspace(-8, 8, 801)
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    upper = 1 - norm_sf(z)

    def range_cdf(w):
        inner = upper - (1 - norm_sf(z - w))
        return k * np.trapezoid(phi * np.clip(inner, 0, 1) ** (k - 1), z)

    if df > 20_000:
        return float(np.clip(1 - range_cdf(q), 0, 1))
    s, weight = _chi_scale_grid(df)
    return float(np.clip(1 - np.sum(weight * [range_cdf(q * v) for v in s]), 0, 1))


def _chi_scale_grid(df):
    """Quadrature nodes and weights of S = sqrt(chi2_df / df)."""
    width = 8 / math.sqrt(2 * df)
    s = np.linspace(max(1e-4, 1 - width), 1 + width + 3 / df, 161)
    logd = (math.log(2) + (df / 2) * math.log(df / 2) - math.lgamma(df / 2)
            + (df - 1) * np.log(s) - df * s * s / 2)
    w = np.exp(logd)
    w = w * np.gradient(s)
    return s, w / w.sum()


def dunnett_sf(t_abs, lambdas, df, two_sided=True):
    """P(max |T_i| >= t) for k comparisons with one control; corr_ij = l_i * l_j."""
    z = np.linspace(-8, 8, 401)
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    lam = np.asarray(lambdas, float)
    root = np.sqrt(1 - lam ** 2)

    def inside(c):
        prod = np.ones_like(z)
        for l_i, r_i in zip(lam, root):
            up = 1 - norm_sf((c + l_i * z) / r_i)
            prod = prod * (up - (1 - norm_sf((-c + l_i * z) / r_i)) if two_sided else up)
        return np.trapezoid(phi * prod, z)

    if df > 20_000:
        return float(np.clip(1 - inside(t_abs), 0, 1))
    s, weight = _chi_scale_grid(df)
    return float(np.clip(1 - np.sum(weight * [inside(t_abs * v) for v in s]), 0, 1))


# ---------------------------------------------------------------- Column wrappers
def _wrap(fn, *cols, **kw) -> Column:
    """Apply a vectorised numpy routine to Columns; null in, null out."""
    @F.pandas_udf("double")
    def call(frame: pd.DataFrame) -> pd.Series:
        args = [frame[c].to_numpy(dtype=float, na_value=np.nan) for c in frame.columns]
        ok = ~np.any(np.isnan(args), axis=0)
        out = np.full(len(frame), np.nan)
        if ok.any():
            out[ok] = fn(*(a[ok] for a in args), **kw)
        return pd.Series(out).where(~np.isnan(out), None).astype("float64")

    packed = F.struct(*[F.coalesce(c.cast("double"), F.lit(float("nan"))).alias(f"a{i}")
                        for i, c in enumerate(cols)])
    value = call(packed)
    return F.when(~F.isnan(value), value)


def _rowwise(fn):
    return lambda *arrays, **kw: np.array([fn(*v, **kw) for v in zip(*arrays)], float)


def p_t(t: Column, df: Column, alternative: str = "two-sided") -> Column:
    if alternative == "greater":
        return _wrap(t_sf, t, df)
    if alternative == "less":
        return _wrap(t_sf, -t, df)
    return _wrap(lambda a, b: 2 * t_sf(np.abs(a), b), t, df)


def p_z(z: Column, alternative: str = "two-sided") -> Column:
    if alternative == "greater":
        return _wrap(norm_sf, z)
    if alternative == "less":
        return _wrap(norm_sf, -z)
    return _wrap(lambda a: 2 * norm_sf(np.abs(a)), z)


def p_chi2(x: Column, df: Column) -> Column:
    return _wrap(chi2_sf, x, df)


def p_f(f: Column, d1: Column, d2: Column) -> Column:
    return _wrap(f_sf, f, d1, d2)


def q_t(q: float, df: Column) -> Column:
    return _wrap(lambda d: t_ppf(q, d), df)


def q_norm(q: Column) -> Column:
    return _wrap(norm_ppf, q)


def p_mann_whitney(u, n1, n2, ties, alternative="two-sided"):
    return _wrap(_rowwise(mann_whitney_p), u, n1, n2, ties, alternative=alternative)


def p_signed_rank(w, n, ties, zeros, alternative="two-sided"):
    return _wrap(_rowwise(signed_rank_p), w, n, ties, zeros, alternative=alternative)


def p_ks(d, n1, n2, alternative="two-sided"):
    return _wrap(_rowwise(ks_p), d, n1, n2, alternative=alternative)


def p_cvm(t, n1, n2):
    return _wrap(_rowwise(cvm_p), t, n1, n2)


def p_fisher(a, b, c, d, alternative="two-sided"):
    return _wrap(_rowwise(fisher_exact_p), a, b, c, d, alternative=alternative)


def p_tukey(q, k, df):
    return _wrap(_rowwise(studentized_range_sf), q, k, df)


def p_binom_half(k, n, alternative="two-sided"):
    def run(x, m):
        ge, le = binom_sf(x, m), binom_sf(m - x, m)
        return np.minimum(1.0, {"greater": ge, "less": le}.get(alternative, 2 * np.minimum(ge, le)))
    return _wrap(run, k, n)


def clopper_pearson(k, n, upper: bool, level=0.95):
    tail = (1 - level) / 2

    def run(x, m):
        if upper:
            return np.where(x >= m, 1.0, beta_ppf(np.full(x.shape, 1 - tail), x + 1,
                                                  np.maximum(m - x, 1e-9)))
        return np.where(x <= 0, 0.0, beta_ppf(np.full(x.shape, tail), np.maximum(x, 1e-9), m - x + 1))
    return _wrap(run, k, n)
