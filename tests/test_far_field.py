"""Sums over far boxes: eleven digits of the sums of all pairs, for clusters, shared places and any width, in a small part of the pairs' time."""

import time

import numpy as np
import pytest

from precinct.blocks import far_field
from precinct.operators import surfaces


@pytest.mark.parametrize("sigma", [1e-5, 1e-3, 0.01, 0.1, 0.5, 5.0])
def test_sums_of_all_pairs(sigma):
    g = np.random.default_rng(7)
    u = np.concatenate([g.normal(0, 0.01, (3000, 2)), g.uniform(0, 1, (500, 2)), [[9.0, -4.0]]])
    v = np.concatenate([u[:1500], g.uniform(0, 1, (2000, 2))])
    weights = g.uniform(0, 1, (len(v), 3))
    got = far_field.cauchy_sums(u, v, weights, [sigma, 0.02])
    assert np.allclose(got, surfaces._all_pairs(u, v, weights, [sigma, 0.02]), rtol=1e-11, atol=0)


def test_few_places():
    one = np.array([[51.5, 0.1]])
    assert np.isclose(far_field.cauchy_sums(one, one, np.ones((1, 1)), [0.01])[0, 0, 0], 1.0)
    assert np.isclose(far_field.cauchy_sums(one + [0, 0.01], one, np.ones((1, 1)), [0.01])[0, 0, 0], 0.5)


def test_work_grows_with_the_places():
    g = np.random.default_rng(8)
    n = 40_000
    t, places = np.sort(g.uniform(0, 10, 2 * n)), g.uniform(0, 0.5, (2 * n, 2))
    run = lambda r: (t[r], np.arange(2 * n)[r], places[r, 0], places[r, 1])
    late, early = run(slice(n, None)), run(slice(0, n))
    began = time.time()
    got = surfaces._whole(late, early, [(0.5, 0.01)])[0]
    spent = time.time() - began
    began = time.time()
    some = slice(0, n // 10)
    want = np.exp(-0.5 * (late[0][some] - early[0][-1])) * surfaces._all_pairs(places[n:][some], places[:n], (0.5 * np.exp(-0.5 * (early[0][-1] - early[0])))[:, None], [0.01])[0, :, 0]
    assert np.allclose(got[some], want, rtol=1e-11)
    assert spent < 5 * (time.time() - began)  # all pairs take ten times the tenth
