"""Isotonic regression by merges against pooling one by one."""

import math
import random

from precinct.operators import evaluation


def test_isotonic_by_brute_force(spark):
    g = random.Random(6)
    for n, levels in ((400, 40), (300, 10**9), (5, 3), (1, 1)):
        rows = [(k, float(p), int(g.random() < 0.2 + 0.6 * p)) for k, p in enumerate(g.randint(0, levels) / levels for _ in range(n))]
        df = spark.createDataFrame([*rows, (10**6, None, 1)], "id long, pred double, y int")
        got = {r["id"]: r["calibrated"] for r in evaluation.isotonic(df).collect()}
        preds = sorted({p for _, p, _ in rows})
        means = {p: [y for _, q, y in rows if q == p] for p in preds}
        fitted = dict(zip([p for p in preds for _ in means[p]], evaluation.pool_adjacent([sum(means[p]) / len(means[p]) for p in preds for _ in means[p]]), strict=True))
        assert got.keys() == {k for k, _, _ in rows} and all(math.isclose(got[k], fitted[p], abs_tol=1e-9) for k, p, _ in rows)
    assert evaluation.isotonic(df.limit(0)).count() == 0
