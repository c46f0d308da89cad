"""Tail areas against published table values."""
import numpy as np
import pytest

from statweave.functions import distributions as D
from statweave.operators.checks import dagostino_p, minimum_detectable, n_per_group, shapiro_p


@pytest.mark.parametrize("got, want", [
    (D.t_sf(2.0, 10), 0.036694), (D.f_sf(3.0, 2, 20), 0.072538), (D.chi2_sf(3.841459, 1), 0.05), (D.t_ppf(np.array(0.975), 10), 2.228139),
    (D.fisher_exact_p(8, 2, 1, 5), 0.034965), (D.studentized_range_sf(3.877, 3, 10), 0.05), (D.dunnett_sf(2.568, [0.5 ** 0.5] * 2, 10), 0.05),
    (D.ks_p(0.5, 10, 10), 0.167821), (D.mann_whitney_p(0, 3, 3, 0), 0.1), (D.signed_rank_p(5, 8, 0, 0), 0.078125), (D.digamma(1.0), -0.577216),
    (D.trigamma(1.0), 1.644934), (D.norm_sf(1.959964), 0.025), (D.binom_sf(8, 10), 0.0546875)])
def test_table_values(got, want):
    assert float(got) == pytest.approx(want, abs=2e-4)


def test_power_constants():
    assert n_per_group(0.5) == 64
    assert minimum_detectable(64, 64) == pytest.approx(0.4992, abs=2e-3)


def test_normality_tests_separate_normal_from_skewed():
    r = np.random.default_rng(1)
    assert shapiro_p(r.normal(size=40)) > 0.05
    assert shapiro_p(r.exponential(size=40)) < 0.01
    x = r.normal(size=200)
    d = x - x.mean()
    m2 = (d ** 2).mean()
    assert dagostino_p(200, (d ** 3).mean() / m2 ** 1.5, (d ** 4).mean() / m2 ** 2 - 3) > 0.05


def test_fisher_two_sided_matches_enumeration():
    from math import comb
    a, b, c, d = 12, 5, 4, 11
    r1, c1, n = a + b, a + c, a + b + c + d
    pm = {k: comb(c1, k) * comb(n - c1, r1 - k) / comb(n, r1) for k in range(max(0, r1 + c1 - n), min(r1, c1) + 1)}
    want = sum(v for v in pm.values() if v <= pm[a] * (1 + 1e-7))
    assert D.fisher_exact_p(a, b, c, d) == pytest.approx(want)
