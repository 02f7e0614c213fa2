"""Quantiles of counts whose P(0) is no number any more."""

import math

import numpy as np

from precinct.operators import rates


def first(log_pmf, q):
    return int(np.argmax(np.cumsum([math.exp(log_pmf(k)) for k in range(20_000)]) >= q))


def test_quantiles_of_large_rates():
    for m in (700.5, 746.0, 1400.25, 11_000.0):
        for q in (0.05, 0.5, 0.95):
            assert rates.poisson_quantiles(np.array([1.0, m, 0.0]), q).tolist()[1:] == [first(lambda k: k * math.log(m) - m - math.lgamma(k + 1), q), 0]
    r, p = 900.0, 0.6  # (1 - p)^r is zero in doubles
    log_pmf = lambda k: math.lgamma(k + r) - math.lgamma(k + 1) - math.lgamma(r) + r * math.log(1 - p) + k * math.log(p)
    for q in (0.05, 0.5, 0.95):
        assert rates.negbin_quantiles(np.array([r]), np.array([p]), q)[0] == first(log_pmf, q)
