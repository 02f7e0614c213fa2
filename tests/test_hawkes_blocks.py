"""What the pairs of blocks carry grows with the events, not with their square."""

import numpy as np

from precinct.operators import surfaces


def test_few_blocks_and_the_sums_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(surfaces, "BLOCK_EVENTS", 50)
    g = np.random.default_rng(5)
    n = 3000
    t = np.where(g.random(n) < 0.4, g.integers(0, 60, n), g.uniform(0, 60, n)).astype(float)
    t[:400] = 7.0  # one time holds many blocks' events
    y, x = 51.5 + g.integers(0, 30, n) / 500, g.integers(0, 30, n) / 500
    e = spark.createDataFrame([(i, float(t[i]), float(y[i]), float(x[i])) for i in range(n)], "id long, t double, lat double, lon double")
    assert surfaces._blocks(e, "early").count() <= surfaces.BLOCKS
    shapes, ids = [(0.5, 0.01), (3.0, 0.02)], np.arange(n)
    dt = t[:, None] - t
    d2 = (y[:, None] - y) ** 2 + (x[:, None] - x) ** 2
    for strict in (True, False):
        got = surfaces.excitation(e, e, shapes, strict).toPandas().set_index("id")
        before = dt > 0 if strict else (dt > 0) | ((dt == 0) & (ids < ids[:, None]))
        for k, (b, s) in enumerate(shapes):
            want = np.where(before & (dt <= surfaces._window(b)), b * np.exp(-b * np.maximum(dt, 0)) * s * s / (d2 + s * s), 0).sum(1)
            assert np.allclose(got[f"x{k}"].reindex(ids).fillna(0).to_numpy(), want, rtol=1e-9, atol=1e-12)
