"""The fit's searches for beta and sigma interpolate between weighings, and nothing is weighed twice."""

import math

import numpy as np
import pytest

from precinct.operators import surfaces


@pytest.mark.parametrize("axis", [2, 3])
def test_interpolated_sums_are_those_of_all_pairs(axis):
    g = np.random.default_rng(3)
    d2, dt = 10 ** g.uniform(-12, 0, 500), 10 ** g.uniform(-4, 1.9, 500)
    value = lambda x: math.exp(x) * np.exp(-math.exp(x) * dt) if axis == 2 else math.exp(2 * x) / (d2 + math.exp(2 * x))
    low, high = map(math.log, surfaces.BOUNDS[axis])
    grid = np.linspace(low, high, 16)
    for k in range(16):
        nodes = surfaces._nodes(grid[max(k - 1, 0)], grid[min(k + 1, 15)], math.pi / 2)
        at = np.append(np.linspace(grid[max(k - 1, 0)], grid[min(k + 1, 15)], 7), nodes[2])
        assert len(nodes) < 3 * 16
        got, want = surfaces._mixed(nodes, at) @ np.array([value(x) for x in nodes]), np.array([value(x) for x in at])
        assert np.allclose(got, want, rtol=0, atol=1e-9 * max(1.0, math.exp(grid[k])))


def test_few_weighings(spark, monkeypatch):
    g = np.random.default_rng(6)
    rows = [(i, float(g.uniform(0, 40)), 51.5 + float(g.normal(0, 0.02)), float(g.normal(0, 0.02))) for i in range(60)]
    e = spark.createDataFrame(rows, "id long, t double, lat double, lon double")
    weighed, one = [], surfaces.excitation
    monkeypatch.setattr(surfaces, "excitation", lambda *a, **k: weighed.append(tuple(a[2])) or one(*a, **k))
    fit = surfaces.fit_hawkes(e, sweeps=2)
    assert len(weighed) == len(set(weighed)) <= 13  # 2 x 9 when each pass of a search weighed all pairs
    best = tuple(fit[k] for k in ("mu", "alpha", "beta", "sigma"))
    near = [tuple(v * (f if k == j else 1) for k, v in enumerate(best)) for j in (2, 3) for f in (0.98, 1.02)]
    near = [c for c in near if all(lo <= v <= hi for v, (lo, hi) in zip(c, surfaces.BOUNDS.values(), strict=True))]
    exact = surfaces.hawkes_nll(e, [best, *near])
    assert math.isclose(exact[0], fit["nll"], rel_tol=1e-9)
