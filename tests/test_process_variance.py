"""The process substitutes once, not in each batch, and its variances are those of the whole covariance."""

import numpy as np

from precinct.operators import surfaces


def test_variances_without_a_substitution_a_batch(spark, monkeypatch):
    g = np.random.default_rng(2)
    x, y = g.uniform(0, 1, (300, 2)), g.normal(0, 1, 300)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "seq long, x1 double, x2 double, y double")
    p = surfaces.FourierProcess(length=0.2, features=32).fit(df)
    sizes, one = [], surfaces.substituted
    monkeypatch.setattr(surfaces, "substituted", lambda root, b: sizes.append(b.shape) or one(root, b))
    predicted = p.predict(df, "seq")
    assert sizes == [(32, 32)]
    got = predicted.toPandas().set_index("seq").sort_index()
    f = p.amp * np.cos(x @ p.w.T + p.b)
    inverse = np.linalg.inv(f.T @ f + 0.01 * np.eye(32))
    assert np.allclose(got["mean"], f @ inverse @ f.T @ y, atol=1e-7)
    assert np.allclose(got["variance"], 0.01 * np.einsum("ij,jk,ik->i", f, inverse, f), atol=1e-9)
