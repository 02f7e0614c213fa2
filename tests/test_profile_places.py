"""Profiles of series: each member counts, though a place is summed up once, and only over the cells that it reaches."""

import numpy as np
import pandas as pd

from precinct.functions.geo import KM_PER_DEGREE
from precinct.operators import surfaces


def plain(points, lats, lons, b, f, g):
    d = np.sqrt((lats[None, :, None] - points[:, 0, None, None]) ** 2 + (lons[None, None, :] - points[:, 1, None, None]) ** 2)
    return np.where(d <= b, b ** (g - f) / np.maximum(2 * b - d, 1e-10) ** g, np.where(d < 4 * b, np.maximum(d, 1e-30) ** -f, 0)).sum(0)


def test_cells_in_reach_hold_the_whole_sum():
    g = np.random.default_rng(1)
    points = np.concatenate([g.uniform(0, 0.4, (200, 2)), [[0.2, 0.2]]])
    lats, lons = np.linspace(-0.05, 0.45, 41), np.linspace(-0.05, 0.45, 41)
    weights = g.integers(1, 5, len(points))
    frame = pd.DataFrame({"lat": points[:, 0], "lon": points[:, 1], "w": weights})
    want = plain(np.repeat(points, weights, axis=0), lats, lons, 0.5 / KM_PER_DEGREE, 1.2, 1.2)
    assert np.allclose(surfaces.rossmo(0.5, 1.2, 1.2)(frame, lats, lons), want, rtol=1e-12)


def test_a_place_of_many_members_is_summed_once(spark, monkeypatch):
    members = [("A", 51.5, 0.0)] * 40 + [("A", 51.51, 0.01)] * 9 + [("B", 51.5, 0.0)] * 2 + [("B", 51.6, 0.0)]
    df = spark.createDataFrame(members, "series_id string, lat double, lon double").repartition(4)
    rows = []
    made = surfaces.materialize
    monkeypatch.setattr(surfaces, "materialize", lambda d, name="step": rows.append(made(d, name)) or rows[-1])
    got = {r["series_id"]: r for r in surfaces.series_profiles(df, n=30).collect()}
    assert set(got) == {"A", "B"}
    for s in "AB":
        want = surfaces.profile_summary(surfaces.geographic_profile(df.filter(f"series_id = '{s}'"), 30)).first()
        assert all(np.isclose(got[s][c], want[c], rtol=1e-9) for c in ("lat", "lon", "peak_p", "area50_km2", "area80_km2"))
    assert [r.count() for r in rows if "w" in r.columns] == [4]  # places, not members
