"""Iterative and statistical operators against small plain models and hand cases."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from precinct.blocks.components import connected_components
from precinct.blocks.ranks import global_cumulate
from precinct.operators import cases, evaluation, network, quality, rates, series, surfaces
from precinct.sources import events as sources
from precinct.sources import people


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    g = random.Random(seed)
    edges = [(g.randrange(60), g.randrange(60)) for _ in range(40)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == {n: find(n) for n in root}
    assert connected_components(df.limit(0)).count() == 0


def test_global_cumulate(spark):
    rows = [(i, (i * 7919) % 101, i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x long, v long")
    got = sorted(global_cumulate(df, [F.desc("x"), F.asc("id")], {"s": "v"}).collect(), key=lambda r: r["rank"])
    want, total = sorted(rows, key=lambda r: (-r[1], r[0])), 0
    for k, (r, w) in enumerate(zip(got, want, strict=True), 1):
        total += w[2]
        assert (r["rank"], r["id"], r["s"]) == (k, w[0], total)


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id string, seq long, crime_type string, lat double, lon double, d double").withColumn("occurred_at", F.timestamp_seconds(F.lit(1704067200.0) + F.col("d") * 86400))


def test_two_series(spark):
    rows = [(f"a{i}", i, "burglary", 51.5 + 0.0005 * i, -0.1 + 0.0005 * i, 3.0 * i) for i in range(4)]
    rows += [(f"b{i}", 10 + i, "burglary", 51.6 + 0.0005 * i, -0.2 + 0.0005 * i, 50 + 3.0 * i) for i in range(4)]
    rows += [("far", 30, "burglary", 10.0, 10.0, 5.0), ("none", 31, "burglary", None, None, 5.0)]
    got = {r["event_id"]: r["series_id"] for r in series.detect_series(events(spark, rows)).collect()}
    assert got == {f"a{i}": "SERIES-0001" for i in range(4)} | {f"b{i}": "SERIES-0002" for i in range(4)}


def test_noise_has_no_series(spark):
    rows = [(f"n{i}", i, "theft", 40.0 + i, 1.0 + i, 30.0 * i) for i in range(5)]
    assert series.detect_series(events(spark, rows)).count() == 0


def brandes(adj):
    out = dict.fromkeys(adj, 0.0)
    for s in adj:
        order, dist, sigma, pred, queue = [], {s: 0}, {s: 1.0}, {}, [s]
        for v in queue:
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] = sigma.get(w, 0) + sigma[v]
                    pred.setdefault(w, []).append(v)
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in pred.get(w, []):
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                out[w] += delta[w]
    return out


@pytest.mark.parametrize("arcs", [0, 1000])
def test_betweenness(spark, monkeypatch, arcs):
    monkeypatch.setattr(network, "BROADCAST_ARCS", arcs)
    g = random.Random(5)
    pairs = {tuple(sorted((f"p{g.randrange(14)}", f"p{g.randrange(14)}"))) for _ in range(22)}
    pairs = {p for p in pairs if p[0] != p[1]}
    people_ = sorted({p for e in pairs for p in e})
    adj = {p: sorted({b if a == p else a for a, b in pairs if p in (a, b)}) for p in people_}
    e = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")
    who = spark.createDataFrame([(p,) for p in people_], "person_id string")
    n = len(people_)
    want = {p: v / ((n - 1) * (n - 2)) for p, v in brandes(adj).items()}
    got = {r["person_id"]: r["betweenness"] for r in network.betweenness(e, who).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p], abs_tol=1e-9) for p in want)


def test_pava_and_table():
    assert evaluation.pool_adjacent([1, 3, 2, 4]) == [1, 2.5, 2.5, 4]
    assert evaluation.pool_adjacent([]) == []


def test_quantiles_against_sums():
    for lam in (0.01, 0.7, 3.0, 25.0):
        pmf = np.exp(-lam) * np.cumprod(np.concatenate([[1], lam / np.arange(1, 200)]))
        for q in (0.05, 0.5, 0.95):
            assert rates.poisson_quantiles(np.array([lam]), q)[0] == int(np.argmax(np.cumsum(pmf) >= q))


def test_roots_and_substitution():
    g = np.random.default_rng(1)
    m = g.normal(size=(12, 12))
    a, b = m @ m.T + np.eye(12), g.normal(size=(12, 3))
    root = surfaces.cholesky(a)
    assert np.allclose(root @ root.T, a) and np.allclose(root, np.tril(root))
    assert np.allclose(root @ surfaces.substituted(root, b), b) and np.allclose(root.T @ surfaces.back_substituted(root, b), b)


def test_gaussian_process_recovers_a_plane(spark):
    g = np.random.default_rng(3)
    x = g.uniform(0, 1, (300, 2))
    rows = [(i, float(a), float(b), float(a + 2 * b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, x1 double, x2 double, y double")
    got = surfaces.FourierProcess(length=1.0, noise=0.05).fit(df).predict(df, "id").toPandas().set_index("id")
    assert max(abs(got["mean"][i] - y) for i, _, _, y in rows) < 0.15 and (got["variance"] > 0).all()


def hawkes_model(rows, mu, a, b, s, strict=False):
    w = min(20 / b, 90)
    out = {}
    for i, t, y, x in rows:
        before = [r for r in rows if (r[1] < t or (not strict and r[1] == t and r[0] < i)) and t - r[1] <= w]
        out[i] = mu + sum(a * b * math.exp(-b * (t - u)) * s * s / ((y - v) ** 2 + (x - z) ** 2 + s * s) for _, u, v, z in before)
    return out


def test_hawkes_fit_against_a_plain_model(spark, monkeypatch):
    """The likelihood of every candidate, over several blocks, and a fit that no neighbouring candidate beats."""
    monkeypatch.setattr(surfaces, "BLOCK_EVENTS", 7)
    g = random.Random(2)
    rows = [(i, g.choice([float(g.randrange(12)), g.uniform(0, 130)]), 51.5 + g.gauss(0, 0.02), g.gauss(0, 0.02)) for i in range(50)]
    e = spark.createDataFrame(rows, "id long, t double, lat double, lon double")
    ends = [r[1] for r in rows]

    def nll(mu, a, b, s):
        return -sum(map(math.log, hawkes_model(rows, mu, a, b, s).values())) + mu * (max(ends) - min(ends)) + sum(a * (1 - math.exp(-b * (max(ends) - t))) for t in ends)

    tries = [(0.1, 0.3, 0.5, 0.01), (0.4, 0.3, 0.5, 0.01), (0.2, 0.5, 2.0, 0.05)]
    assert all(math.isclose(x, nll(*c), rel_tol=1e-9) for x, c in zip(surfaces.hawkes_nll(e, tries), tries, strict=True))
    want = hawkes_model(rows, 0.1, 0.3, 0.5, 0.01, strict=True)
    got = {r["id"]: r["intensity"] for r in surfaces.hawkes_intensity(e, e, 0.1, 0.3, 0.5, 0.01).collect()}
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)
    fit = surfaces.fit_hawkes(e, sweeps=2, width=6, rounds=2)
    best = [fit[k] for k in ("mu", "alpha", "beta", "sigma")]
    assert math.isclose(fit["nll"], nll(*best), rel_tol=1e-6) and fit["nll"] < nll(0.1, 0.3, 0.5, 0.01)


def test_nearest_and_mean_distances(spark, monkeypatch):
    """Against all pairs: clusters, far rows that need wider tiles, repeats, and blocks smaller than a tile."""
    from precinct.blocks import nearest

    monkeypatch.setattr(nearest, "BLOCK", 9)
    g = np.random.default_rng(4)
    p = np.concatenate([g.normal(0, 0.1, (60, 5)), g.normal(3, 1, (40, 5)), np.zeros((5, 5)), [[50.0, 0, 0, 0, 0], [0, 0, -40.0, 0, 0]]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "id long, a double, b double, c double, d double, e double")
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    got = {r["id"]: r["nearest"] for r in nearest.nearest_distances(df, list("abcde"), 4, len(p)).collect()}
    assert all(np.allclose(got[i], sorted(x for x in d[i] if x >= 1e-12)[:4]) for i in range(len(p)))
    mean = {r["id"]: r["mean_d"] for r in nearest.mean_distances(df, df, list("abcde")).collect()}
    assert all(math.isclose(mean[i], np.mean([x for x in d[i] if x >= 1e-12]), rel_tol=1e-9) for i in range(len(p)))
    same = df.filter("id >= 100 and id < 105")
    assert all(r["nearest"] == [] for r in nearest.nearest_distances(same, list("abcde"), 4, 5).collect())
    assert nearest.nearest_distances(df.limit(0), list("abcde"), 4, 0).count() == 0


def test_pairs_near_poles_and_the_date_line(spark):
    """Cells as wide as they are at their own latitude, against all pairs by haversine."""
    g = random.Random(6)
    rows = [(f"e{i}", i, None, g.choice([0.0, 60.0, -60.0, 89.9, 51.5]) + g.uniform(-0.002, 0.002), (g.choice([179.999, -179.999, 0.0, 12.0]) + g.uniform(-0.003, 0.003) + 180) % 360 - 180, g.uniform(0, 20)) for i in range(150)]

    def metres(a, b):
        (y, x), (v, z) = ((math.radians(r[3]), math.radians(r[4])) for r in (a, b))
        h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((z - x) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(h)) * 1000

    want = {(a[0], b[0]) for a in rows for b in rows if b[1] < a[1] and abs(a[5] - b[5]) <= 14 and metres(a, b) <= 200}
    got = {(r["event_id"], r["prior_id"]) for r in series.near_repeats(events(spark, rows)).collect()}
    assert got == want and len(want) > 20


def test_series_profiles_equal_the_single_profile(spark):
    g = random.Random(3)
    rows = [(s, 51.5 + k / 10 + g.gauss(0, 0.01), g.gauss(0, 0.01)) for k, s in enumerate("AB") for _ in range(8)] + [("C", 51.0, 0.0), ("C", None, 0.0), ("C", 51.0, 0.1)]
    df = spark.createDataFrame(rows, "series_id string, lat double, lon double").repartition(3)
    got = {r["series_id"]: r for r in surfaces.series_profiles(df, n=30).collect()}
    assert set(got) == {"A", "B"}
    for s in "AB":
        one = surfaces.profile_summary(surfaces.geographic_profile(df.filter(F.col("series_id") == s), 30)).first()
        assert all(math.isclose(got[s][c], one[c], rel_tol=1e-9) for c in ("lat", "lon", "peak_p", "area50_km2", "area80_km2"))


def test_rossmo_by_hand():
    b, f = 0.5 / 111.0, 1.2
    p = __import__("pandas").DataFrame({"lat": [51.5, 51.501], "lon": [0.0, 0.003]})
    lats, lons = np.array([51.5, 51.51, 51.6]), np.array([0.0, 0.002])
    got = surfaces.rossmo(0.5, f, f)(p, lats, lons)
    for i, y in enumerate(lats):
        for j, x in enumerate(lons):
            want = 0.0
            for v, z in zip(p["lat"], p["lon"], strict=True):
                d = math.hypot(y - v, x - z)
                want += 1 / max(2 * b - d, 1e-10) ** f if d <= b else d**-f if d < 4 * b else 0.0
            assert math.isclose(got[i, j], want, rel_tol=1e-9)


def test_map_hotspots_need_three_points(spark):
    df = spark.createDataFrame([(51.5, 0.0), (51.6, 0.1), (None, 0.1)], "lat double, lon double")
    assert surfaces.map_hotspots(df).count() == 0
    assert surfaces.map_hotspots(df.union(df.filter("lat = 51.5"))).count() > 0


def test_case_leads(spark):
    """Two cases: one with a series beside its first event, one with two events only; all kinds of leads, ranked by score."""
    rows = [("k1", f"a{i}", i, "burglary", 51.5 + 0.0002 * i, -0.1, 2.0 * i, "smashed a window alone") for i in range(5)]
    rows += [("k2", "b0", 10, "theft", 51.9, 0.3, 1.0, "phone taken"), ("k2", "b1", 11, "theft", 51.2, 0.9, 25.0, "")]
    e = spark.createDataFrame([(*r, 0.9) for r in rows], "case_id string, event_id string, seq long, crime_type string, lat double, lon double, d double, narrative string, quality_score double")
    e = e.withColumn("occurred_at", F.timestamp_seconds(F.lit(1704067200.0) + F.col("d") * 86400))
    similar = spark.createDataFrame([("k1", "old", 0.8, "group of two"), ("k2", "weak", 0.1, "")], "case_id string, other string, score double, detail string")
    odd = spark.createDataFrame([("b1", True, 0.7, ["time"]), ("a1", False, 0.2, [])], "event_id string, is_anomaly boolean, score double, reasons array<string>")
    who = spark.createDataFrame([("k2", "p1", 0.99, "direct_participant")], "case_id string, person_id string, risk double, kind string")
    got = {}
    for r in cases.case_leads(e, similar, odd, who, grid=30).collect():
        got.setdefault(r["event_id"], []).append(r)
    assert {r["category"] for r in got["k1"]} == {"series", "mo", "geographic"} and {r["category"] for r in got["k2"]} == {"anomaly", "network"}
    link = next(r for r in got["k1"] if r["category"] == "series")
    assert link["headline"] == "Linked to SERIES-0001" and link["confidence"] > 0.2
    for rows_ in got.values():
        assert [r["rank"] for r in sorted(rows_, key=lambda r: (-round(r["score"], 9), r["lead_no"]))] == list(range(1, len(rows_) + 1))


def test_columns_of_known_headers():
    find = sources.detect_columns
    assert find("incident_id,occurred,offense,summary,y_coord,x_coord,block,resolution".split(",")) == {"id": "incident_id", "date": "occurred", "crime_type": "offense", "description": "summary", "lat": "y_coord", "lon": "x_coord", "address": "block", "outcome": "resolution"}
    assert find(["Crime type", "Last outcome category", "Context"]) == {"crime_type": "Crime type", "outcome": "Last outcome category"}
    assert find(["Date", "Updated On Date", "Crime Type", "Type"]) == {"date": "Date", "crime_type": "Crime Type"}
    assert find(["location type", "Location"]) == {"location": "location type"}
    assert find([]) == {}


def test_hawkes_intensity_decays(spark):
    e = spark.createDataFrame([(1, 0.0, 51.5, 0.0)], "id long, t double, lat double, lon double")
    t = spark.createDataFrame([(7, 1.0, 51.5, 0.0), (8, 5.0, 51.5, 0.0), (9, 0.0, 51.5, 0.0)], "id long, t double, lat double, lon double")
    got = {r["id"]: r["intensity"] for r in surfaces.hawkes_intensity(t, e, 0.1, 0.3, 0.5, 0.01).collect()}
    assert got[7] > got[8] > got[9] == 0.1
    assert math.isclose(got[7], 0.1 + 0.15 * math.exp(-0.5))


def test_csv_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ID,Date,Crime Type,Latitude,Longitude,Location\n1,03/04/2024,Theft,51.5,-0.1,"High St, ""A"""\n2,13/04/2024 10:30, BURGLARY ,95,-0.1,x\n3,,,1,1,y\n4,junk,fraud,,,\n')
    got = {r["event_id"]: r for r in sources.read_events_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert set(got) == {"csv_import_1", "csv_import_2", "csv_import_4"}
    assert str(got["csv_import_1"]["occurred_at"]) == "2024-03-04 00:00:00" and got["csv_import_1"]["location_raw"] == 'High St, "A"'
    assert str(got["csv_import_2"]["occurred_at"]) == "2024-04-13 10:30:00" and got["csv_import_2"]["lat"] is None and got["csv_import_2"]["crime_type"] == "burglary"
    assert got["csv_import_4"]["occurred_at"] is None


def test_json_sources(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"utc_offset_seconds": 3600, "hourly": {"time": ["2024-01-01T01:00", "2024-01-01T01:30", "2024-01-01T02:00"], "temperature_2m": [5, 25, 45], "precipitation": [0.2, 0.0], "windspeed_10m": [90, 90, 10]}}')
    got = {str(r["hour_utc"]): r for r in sources.read_weather_json(spark, str(tmp_path / "w.json")).collect()}
    assert got["2024-01-01 00:00:00"]["temperature"] == 25 and got["2024-01-01 00:00:00"]["extreme_wind"] and not got["2024-01-01 00:00:00"]["is_raining"]
    assert got["2024-01-01 01:00:00"]["discomfort"] == 1.0 and got["2024-01-01 01:00:00"]["visibility"] == 10000
    (tmp_path / "p.json").write_text('[{"id": "9", "month": "2024-02", "category": "drugs", "location": {"latitude": "51.5", "longitude": "bad", "street": {"name": "On X"}}, "outcome_status": null, "context": ""}]')
    row = sources.read_police_json(spark, str(tmp_path / "p.json")).first()
    assert (row["event_id"], row["crime_type"], row["lat"], row["lon"], row["location_raw"], row["outcome"]) == ("uk_9", "drug_offence", 51.5, None, "On X", None)


def test_people_sources(spark, tmp_path):
    (tmp_path / "p.csv").write_text("person_id,incident_id,role\na,1,suspect\nb,1,witness\n")
    assert {r["person_id"]: r["weight"] for r in people.read_person_csv(spark, str(tmp_path / "p.csv")).collect()} == {"a": 1.0, "b": 0.5}
    (tmp_path / "e.txt").write_text("# x\n1 2\n 3   4\n\n")
    assert {tuple(r) for r in people.read_edge_list(spark, str(tmp_path / "e.txt")).collect()} == {("person_1", "crime_2"), ("person_3", "crime_4")}


def test_empty_events(spark):
    e = events(spark, []).withColumns({"source": F.lit("x"), "suburb": F.lit("z"), "location_raw": F.lit("y"), "zone": F.lit("z")})
    assert quality.import_summary(quality.score_quality(e)).first()["total"] == 0
    assert rates.fit_poisson(e).count() == 0 and series.near_repeats(e).count() == 0


def test_likelihood_of_the_process(spark):
    """Exact for the kernel that the features stand for, and within one in a hundred of the squared-exponential one at n = 200."""
    g = np.random.default_rng(5)
    x = g.uniform(0, 3, (200, 2))
    y = np.sin(2 * x[:, 0]) + g.normal(0, 0.2, 200)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "x1 double, x2 double, y double").repartition(3)

    def exact(k):
        return -0.5 * (y @ np.linalg.solve(k, y) + np.linalg.slogdet(k)[1] + 200 * math.log(2 * math.pi))

    process = surfaces.FourierProcess(1.0, noise=0.2, features=1500).fit(df)
    f = process.phi(pd.DataFrame(x, columns=["x1", "x2"]))
    assert math.isclose(process.log_likelihood, exact(f @ f.T + 0.04 * np.eye(200)), rel_tol=1e-7)
    smooth = exact(np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 2) + 0.04 * np.eye(200))
    assert abs(process.log_likelihood - smooth) <= 0.01 * 200
    best, tried = surfaces.choose_kernel(df, [0.3, 1.0, 5.0], [0.2, 2.0], 300)
    assert len(tried) == 6 and best.noise == 0.2 and best.log_likelihood == max(t[2] for t in tried)
