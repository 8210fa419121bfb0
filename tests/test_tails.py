"""Tail probabilities against published table values."""

import math

import pytest

from emberframe.functions.tails import beta_cdf, chi2_upper, f_upper, normal_two_sided, t_two_sided


@pytest.mark.parametrize("t, df, p", [(2.228139, 10, 0.05), (12.7062, 1, 0.05), (2.750, 30, 0.01), (1.959964, 1e9, 0.05)])
def test_t(t, df, p):
    assert t_two_sided(t, df) == pytest.approx(p, abs=2e-5)


@pytest.mark.parametrize("f, a, b, p", [(4.964603, 1, 10, 0.05), (2.866081, 4, 20, 0.05), (4.43069, 4, 20, 0.01)])
def test_f(f, a, b, p):
    assert f_upper(f, a, b) == pytest.approx(p, abs=2e-6)


@pytest.mark.parametrize("x, df, p", [(3.841459, 1, 0.05), (18.30704, 10, 0.05), (0.5, 1, 0.4795001), (40.0, 10, 1.69447e-05)])
def test_chi2(x, df, p):
    assert chi2_upper(x, df) == pytest.approx(p, rel=1e-5)


def test_normal_and_identities():
    assert normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-7)
    assert t_two_sided(1.3, 7) == pytest.approx(f_upper(1.69, 1, 7), rel=1e-12)
    assert beta_cdf(0.3, 2, 5) == pytest.approx(1 - beta_cdf(0.7, 5, 2), rel=1e-12)
    assert math.isnan(t_two_sided(float("nan"), 5))


@pytest.mark.parametrize("df", [1e6, 9.9e6, 1.1e7, 1e9])
def test_one_method_for_all_degrees_of_freedom(df):
    for t in (0.1, 1.6, 1.96, 5.0, 30.0):
        density = (t * t + 1) * t * math.exp(-t * t / 2) / math.sqrt(2 * math.pi) / (2 * df)  # first term of the expansion in 1/df
        if t < 6:
            assert t_two_sided(t, df) == pytest.approx(normal_two_sided(t) + density, rel=1e-6)
    assert f_upper(3.2, 4, df) == pytest.approx(chi2_upper(12.8, 4), rel=1e-4)
    assert t_two_sided(math.inf, df) == 0.0
