"""Numeric helpers against closed forms, tables and direct enumeration."""

import itertools
import math

import numpy as np
import pytest

from cohortile.functions import special as sp


def test_erfc_matches_stdlib():
    x = np.linspace(-8, 25, 4001)
    want = np.array([math.erfc(v) for v in x])
    assert np.max(np.abs(sp.erfc(x) - want) / want) < 1e-11


@pytest.mark.parametrize("df,t", [(1, 12.7062047361747), (2, 4.30265272974946), (5, 2.57058183563632),
                                  (20, 2.08596344726586), (120, 1.97993040508242)])
def test_t_tail_five_percent_points(df, t):
    assert sp.t_two_sided(np.array([t]), np.array([df]))[0] == pytest.approx(0.05, abs=1e-10)


def test_t_tail_extremes():
    p = sp.t_two_sided(np.array([0.0, np.nan, np.inf, 1.959963984540054, 3.0]), np.array([5.0, 5, 5, np.inf, 4e5]))
    assert p[0] == 1 and math.isnan(p[1]) and p[2] == 0
    assert p[3] == pytest.approx(0.05, abs=1e-12)
    # near the normal limit: p = p_normal + phi(t) (t^3 + t) / (2 df) to first order
    phi = math.exp(-4.5) / math.sqrt(2 * math.pi)
    assert p[4] == pytest.approx(math.erfc(3 / math.sqrt(2)) + phi * 30 / (2 * 4e5), rel=1e-9)
    # df = 2 has p = 1 - t / sqrt(2 + t^2); a far tail keeps its relative precision
    far = sp.t_two_sided(np.array([1e6]), np.array([2.0]))[0]
    assert far == pytest.approx(1e-12, rel=1e-6)


def test_chi2_tail():
    assert sp.chi2_tail(np.array([3.841458820694124]), np.array([1]))[0] == pytest.approx(0.05, abs=1e-12)
    assert sp.chi2_tail(np.array([7.814727903251179]), np.array([3]))[0] == pytest.approx(0.05, abs=1e-12)
    h = np.linspace(0, 40, 50)
    assert np.allclose(sp.chi2_tail(h, np.full(50, 4)), np.exp(-h / 2) * (1 + h / 2), atol=1e-14)


def test_polygamma():
    assert sp.digamma(1) == pytest.approx(-0.5772156649015329, abs=1e-13)
    assert sp.trigamma(1) == pytest.approx(math.pi**2 / 6, abs=1e-13)
    for v in (1e-4, 0.03, 0.7, 5.0, 900.0):
        assert sp.trigamma(sp.trigamma_inverse(v)) == pytest.approx(v, rel=1e-9)


@pytest.mark.parametrize("m,n", [(1, 1), (3, 4), (5, 2), (4, 4)])
def test_rank_sum_distribution_by_enumeration(m, n):
    counts = np.zeros(m * n + 1)
    for pick in itertools.combinations(range(1, m + n + 1), m):
        counts[sum(pick) - m * (m + 1) // 2] += 1
    assert np.allclose(sp.rank_sum_distribution(m, n), counts / counts.sum())


def test_rank_sum_exact_known():
    # complete separation of 5 and 5: 2 / C(10, 5)
    assert sp.rank_sum_exact(25, 5, 5) == pytest.approx(2 / 252)
    assert sp.rank_sum_distribution(49, 49).sum() == pytest.approx(1, abs=1e-12)


def test_shapiro_p_for_three_values():
    assert sp.shapiro_p(0.75, 3) == pytest.approx(0, abs=1e-12)
    assert sp.shapiro_p(1.0, 3) == pytest.approx(1, abs=1e-6)
