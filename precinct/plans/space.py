"""Queries over places and times: series, near repeats, surfaces, self-exciting and ensemble models."""

from __future__ import annotations

from pyspark.sql import functions as F

from precinct import fixed
from precinct.functions.text import crime_bucket
from precinct.operators import ensemble as ensemble_
from precinct.operators import rates, series, surfaces
from precinct.plans.base import Register, rounded
from precinct.plans.core import QUANTILES, WHICH, _fit_sql
from precinct.plans.fixtures import CE, crime_events

R = Register()

_HAV = "2000 * 6371.0 * atan2(sqrt({h}), sqrt(greatest(1 - {h}, 0)))".format(h="(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))")
_LOC = f"{CE}, lo AS (SELECT *, (epoch(occurred_at) - 946684800) / 86400 AS t, CASE WHEN crime_type IS NULL THEN 200 WHEN crime_type = 'burglary' THEN 200 WHEN crime_type = 'assault' THEN 150 ELSE 300 END AS band_m, CASE crime_type WHEN 'assault' THEN 3 ELSE 14 END AS band_d, floor(lat / 0.003) AS cy FROM ce WHERE lat IS NOT NULL AND occurred_at IS NOT NULL), lx AS (SELECT *, unnest([cy - 1, cy, cy + 1]) AS ny FROM lo)"


@R("j01_near_repeats", f"""WITH {_LOC}, p AS (SELECT a.event_id, b.event_id AS prior_id, {_HAV} AS metres, abs(a.t - b.t) AS days, a.band_m, a.band_d FROM lx a JOIN lo b ON b.cy = a.ny AND b.seq < a.seq AND abs(a.t - b.t) <= a.band_d AND abs(a.lon - b.lon) < 0.01)
SELECT event_id, prior_id, round(metres, 4) AS metres, round(days, 4) AS days, round(exp(-metres / band_m) * exp(-days / band_d), 4) AS score FROM p WHERE metres <= band_m AND days <= band_d""")
def j01_near_repeats(spark, sf):
    return rounded(series.near_repeats(crime_events(spark, sf)), 4)


@R("j02_knox", f"""WITH {_LOC}, p AS (SELECT {_HAV} AS metres FROM lx a JOIN lo b ON b.cy = a.ny AND b.event_id < a.event_id AND abs(a.t - b.t) <= 14 AND abs(a.lon - b.lon) < 0.01), k AS (SELECT count(*) AS near FROM p WHERE metres <= 200),
x AS (SELECT count(*) AS n, min(lat) AS y0, max(lat) AS y1, min(lon) AS x0, max(lon) AS x1, min(t) AS t0, max(t) AS t1 FROM lo),
e AS (SELECT n, near, n * (n - 1) / 2 * least(1, pi() * 40000 / greatest(greatest((y1 - y0) * 111000, 1000) * greatest((x1 - x0) * 111000 * cos(radians((y0 + y1) / 2)), 1000), pi() * 40000)) * least(1, 14 / (t1 - t0)) AS expected FROM x, k)
SELECT n, near, round(expected, 4) AS expected, round(near / expected, 6) AS ratio FROM e""")
def j02_knox(spark, sf):
    return rounded(series.knox(crime_events(spark, sf)).withColumn("expected", F.round("expected", 4)))


def _series_sql(eps_km: float = 0.3, eps_days: float = 30.0, least: int = 3, burglary: float | None = None, name: str = "sr") -> str:
    """CTEs, the last of which (name) has event_id, seq and series_id."""
    base, scale = eps_km / 111.0, f"CASE WHEN grp = 'burglary' THEN {eps_km / (burglary or eps_km)!r}::DOUBLE ELSE 1.0::DOUBLE END"
    return f"""{name}_p AS (SELECT *, floor(x / {base * 1.001!r}) AS cx, floor(y / {base * 1.001!r}) AS cy FROM (SELECT event_id, seq, grp, lat * {scale} AS x, lon * {scale} AS y, floor((epoch(occurred_at) - 946684800) / 86400) * {base!r}::DOUBLE / {eps_days!r}::DOUBLE AS z
FROM (SELECT *, CASE WHEN crime_type = 'burglary' THEN 'burglary' WHEN crime_type = 'theft' THEN 'theft' WHEN crime_type = 'assault' THEN 'violent' ELSE 'other' END AS grp FROM ce WHERE lat IS NOT NULL AND occurred_at IS NOT NULL))),
{name}_n AS (SELECT a.seq AS a, b.seq AS b FROM (SELECT *, unnest([cx - 1, cx, cx + 1]) AS nx FROM {name}_p) a JOIN {name}_p b ON a.grp = b.grp AND a.nx = b.cx AND abs(a.cy - b.cy) <= 1 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= {base!r}::DOUBLE * {base!r}::DOUBLE),
{name}_c AS (SELECT a AS id FROM {name}_n GROUP BY a HAVING count(*) >= {least}),
{name}_e AS (SELECT a, b FROM {name}_n SEMI JOIN {name}_c x ON a = x.id SEMI JOIN {name}_c y ON b = y.id WHERE a <> b),
{name}_l(node, root) USING KEY (node) AS (SELECT id, id FROM {name}_c UNION SELECT e.b, min(l.root) FROM {name}_l l JOIN {name}_e e ON e.a = l.node JOIN recurring.{name}_l AS now ON now.node = e.b WHERE l.root < now.root GROUP BY e.b),
{name}_k AS (SELECT root, row_number() OVER (ORDER BY CASE grp WHEN 'burglary' THEN 1 WHEN 'theft' THEN 2 WHEN 'violent' THEN 3 ELSE 4 END, root) AS k FROM (SELECT DISTINCT root FROM {name}_l) JOIN {name}_p ON seq = root),
{name}_m AS (SELECT node AS seq, k FROM {name}_l JOIN {name}_k USING (root) UNION ALL SELECT n.a, min(k.k) FROM {name}_n n ANTI JOIN {name}_c c ON n.a = c.id JOIN {name}_l l ON l.node = n.b JOIN {name}_k k USING (root) GROUP BY n.a),
{name} AS (SELECT event_id, seq, printf('SERIES-%04d', k) AS series_id FROM {name}_m JOIN {name}_p USING (seq))"""


@R("a18_series", f"WITH RECURSIVE {CE}, {_series_sql()} SELECT event_id, series_id FROM sr")
def a18_series(spark, sf):
    """Members of series."""
    return series.detect_series(crime_events(spark, sf))


def _summary_sql(members: str) -> str:
    return f"""su AS (SELECT series_id, round(avg(lat) + 1e-9, 6) AS lat, round(avg(lon) + 1e-9, 6) AS lon, min(occurred_at)::DATE AS first_day, max(occurred_at)::DATE AS last_day, count(*) AS size FROM {members} JOIN ce USING (event_id) GROUP BY 1),
kd AS (SELECT series_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, kind) AS k FROM (SELECT series_id, coalesce(crime_type, '') AS kind, count(*) AS n FROM {members} JOIN ce USING (event_id) GROUP BY ALL)) WHERE k = 1)
SELECT su.series_id, lat, lon, first_day, last_day, size, kind AS dominant_type, CAST(last_day - first_day AS INT) AS span_days, CASE WHEN size >= 10 THEN 'CRITICAL' WHEN size >= 5 THEN 'HIGH' ELSE 'ACTIVE' END AS status FROM su JOIN kd USING (series_id)"""


def centred(summary):
    """Centres rounded a little off the ties that means of round numbers make."""
    return summary.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("lat", "lon")})


@R("a19_series_summary", f"WITH RECURSIVE {CE}, {_series_sql(burglary=0.2)}, {_summary_sql('sr')}")
def a19_series_summary(spark, sf):
    """Series with a radius of their own for burglaries."""
    e = crime_events(spark, sf)
    return centred(series.series_summary(series.detect_series(e, eps_by_bucket={"burglary": 0.2, "theft": 0.0}), e))


@R("j04_series_links", f"""WITH RECURSIVE {CE}, {_series_sql(0.15, 3.0, 8)}, mb AS (SELECT series_id, lat, lon, (epoch(occurred_at) - 946684800) / 86400 AS t FROM sr JOIN ce USING (event_id)),
dk AS (SELECT series_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, kind) AS k FROM (SELECT series_id, coalesce(crime_type, '') AS kind, count(*) AS n FROM sr JOIN ce USING (event_id) GROUP BY ALL)) WHERE k = 1),
bd AS (SELECT series_id, CASE kind WHEN 'burglary' THEN 200.0 WHEN 'assault' THEN 150.0 ELSE 300.0 END AS bm, CASE kind WHEN 'assault' THEN 3.0 ELSE 14.0 END AS bt, {{}} AS mult FROM dk),
pb AS (SELECT event_id, lat, lon, (epoch(occurred_at) - 946684800) / 86400 AS t FROM ce ANTI JOIN sr USING (event_id) WHERE lat IS NOT NULL AND occurred_at IS NOT NULL),
ps AS (SELECT a.event_id, b.series_id, min({_HAV}) / 1000 AS km, min(abs(a.t - b.t)) AS dt FROM pb a JOIN mb b ON abs(a.lat - b.lat) < 0.2 GROUP BY ALL HAVING min({_HAV}) <= 600),
sc AS (SELECT *, 0.35 * greatest(0, 1 - km * 1000 / bm) + 0.35 * greatest(0, 1 - dt / bt) AS c FROM ps JOIN bd USING (series_id))
SELECT event_id, series_id, round(km, 6) AS km, round(dt, 6) AS dt, round(least(0.95, 0.05 * mult * c / 0.5), 6) AS p FROM sc WHERE least(0.95, 0.05 * mult * c / 0.5) >= 0.2""".replace("{}", "CASE kind " + " ".join(f"WHEN '{k}' THEN {v[2]}::DOUBLE" for k, v in fixed.NEAR_REPEAT.items()) + f" ELSE {fixed.NEAR_REPEAT_DEFAULT[2]}::DOUBLE END"))
def j04_series_links(spark, sf):
    """Links of events outside the dense series to them."""
    e = crime_events(spark, sf)
    m = series.detect_series(e, eps_km=0.15, eps_days=3.0, min_samples=8)
    return rounded(series.link_probability(e.join(m, "event_id", "left_anti"), m, e))


def overridden(spark, sf):
    """Two series merged, one member split off."""
    e = crime_events(spark, sf)
    m = series.detect_series(e)
    first = m.filter("series_id = 'SERIES-0001'").select("event_id", F.lit("SERIES-0002").alias("new_series"))
    split = m.filter("series_id = 'SERIES-0003'").orderBy("event_id").limit(1).select("event_id", F.lit("SPLIT-SERIES-0003").alias("new_series"))
    return e, series.override_series(m, first.union(split))


_OVER = f"{CE}, {_series_sql()}, ov AS (SELECT event_id, CASE WHEN series_id = 'SERIES-0001' THEN 'SERIES-0002' WHEN event_id = (SELECT min(event_id) FROM sr WHERE series_id = 'SERIES-0003') THEN 'SPLIT-SERIES-0003' ELSE series_id END AS series_id FROM sr)"


@R("l09_series_overrides", f"WITH RECURSIVE {_OVER} SELECT * FROM ov")
def l09_series_overrides(spark, sf):
    return overridden(spark, sf)[1]


@R("l09_overridden_summary", f"WITH RECURSIVE {_OVER}, {_summary_sql('ov')}")
def l09_overridden_summary(spark, sf):
    """The summary computed anew after an analyst's changes."""
    e, m = overridden(spark, sf)
    return centred(series.series_summary(m, e))


_BOX = "bx AS (SELECT count(*) AS n, stddev_samp(lat) AS sy, stddev_samp(lon) AS sx, min(lat) AS y0, max(lat) AS y1, min(lon) AS x0, max(lon) AS x1 FROM ce WHERE lat IS NOT NULL)"
_KDE = f"""{CE}, {_BOX}, hw AS (SELECT *, greatest(1.06 * sy * pow(n, -0.2), (y1 - y0) / 40) AS hy, greatest(1.06 * sx * pow(n, -0.2), (x1 - x0) / 40) AS hx FROM bx),
g AS (SELECT r.range AS row, c.range AS col, y0 + (r.range + 0.5) * (y1 - y0) / 20 AS lat, x0 + (c.range + 0.5) * (x1 - x0) / 20 AS lon, hy, hx FROM hw, range(20) r, range(20) c),
k AS (SELECT g.row, g.col, g.lat, g.lon, sum(exp(-0.5 * pow((g.lat - ce.lat) / hy, 2)) * exp(-0.5 * pow((g.lon - ce.lon) / hx, 2))) AS v FROM g, ce WHERE ce.lat IS NOT NULL GROUP BY ALL), kd AS (SELECT row, col, lat, lon, v / sum(v) OVER () AS density FROM k)"""


@R("a10_kde", f"WITH {_KDE} SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, round(lat, 6) AS lat, round(lon, 6) AS lon, round(density, 8) AS density FROM kd")
def a10_kde(spark, sf):
    """A09, A10, J09."""
    s = surfaces.kde(crime_events(spark, sf), 20)
    return s.select("row", "col", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("density", 8).alias("density"))


def _hot_sql(n: int, top: int, spare: bool = False, radius: float = 0.02) -> str:
    """CTEs from ce to ht: greedy peaks of an n x n surface, each outside the radius of those before."""
    box = "y0 - greatest(0.1 * (y1 - y0), 0.01) AS y0, y1 + greatest(0.1 * (y1 - y0), 0.01) AS y1, x0 - greatest(0.1 * (x1 - x0), 0.01) AS x0, x1 + greatest(0.1 * (x1 - x0), 0.01) AS x1" if spare else "y0, y1, x0, x1"
    out = [f"bx AS (SELECT count(*) AS n, stddev_samp(lat) AS sy, stddev_samp(lon) AS sx, min(lat) AS y0, max(lat) AS y1, min(lon) AS x0, max(lon) AS x1 FROM ce WHERE lat IS NOT NULL), by_ AS (SELECT n, sy, sx, {box} FROM bx)"]
    out.append(f"hw AS (SELECT *, greatest(1.06 * sy * pow(n, -0.2), (y1 - y0) / {2 * n}) AS hy, greatest(1.06 * sx * pow(n, -0.2), (x1 - x0) / {2 * n}) AS hx FROM by_)")
    out.append(f"g AS (SELECT r.range AS row, c.range AS col, y0 + (r.range + 0.5) * (y1 - y0) / {n} AS lat, x0 + (c.range + 0.5) * (x1 - x0) / {n} AS lon, hy, hx FROM hw, range({n}) r, range({n}) c)")
    out.append("k AS (SELECT g.row, g.col, g.lat, g.lon, sum(exp(-0.5 * pow((g.lat - ce.lat) / hy, 2)) * exp(-0.5 * pow((g.lon - ce.lon) / hx, 2))) AS v FROM g, ce WHERE ce.lat IS NOT NULL GROUP BY ALL), kd AS MATERIALIZED (SELECT row, col, lat, lon, v / sum(v) OVER () AS density FROM k)")
    for i in range(1, top + 1):
        free = "".join(f" AND NOT EXISTS (FROM p{j} WHERE pow(kd.lat - p{j}.lat, 2) + pow(kd.lon - p{j}.lon, 2) <= {radius * radius!r})" for j in range(1, i))
        out.append(f"p{i} AS MATERIALIZED (SELECT {i} AS rank, lat, lon, density AS peak FROM kd WHERE density > 0{free} ORDER BY density DESC, row, col LIMIT 1)")
    out.append("pk AS (" + " UNION ALL ".join(f"FROM p{i}" for i in range(1, top + 1)) + ")")
    h = radius / 2
    inside = lambda t: f"{t}.lat BETWEEN pk.lat - {h!r} AND pk.lat + {h!r} AND {t}.lon BETWEEN pk.lon - {h!r} AND pk.lon + {h!r}"
    out.append(f"ht AS (SELECT CAST(rank AS INT) AS rank, round(lat, 6) AS lat, round(lon, 6) AS lon, round(peak, 6) AS peak, round(coalesce((SELECT sum(density) FROM kd WHERE {inside('kd')}), 0), 6) AS mass, (SELECT count(*) FROM ce WHERE {inside('ce')}) AS crimes FROM pk)")
    return ", ".join(out)


@R("a11_hotspots", f"WITH {CE}, {_hot_sql(40, 8)} FROM ht")
def a11_hotspots(spark, sf):
    """A11, J06."""
    e = crime_events(spark, sf)
    return rounded(surfaces.hotspots(surfaces.kde(e, 40), e, top_k=8))


@R("g08_map_hotspots", f"WITH {CE}, {_hot_sql(40, 8, spare=True)} FROM ht")
def g08_map_hotspots(spark, sf):
    return rounded(surfaces.map_hotspots(crime_events(spark, sf)))


@R("a12_area_fraction", f"WITH {_KDE}, o AS (SELECT row_number() OVER w AS k, sum(density) OVER w AS cum, count(*) OVER () AS n FROM kd WINDOW w AS (ORDER BY density DESC, row, col ROWS UNBOUNDED PRECEDING)) SELECT round(min(k) FILTER (cum >= 0.5) / max(n), 6) AS fraction FROM o")
def a12_area_fraction(spark, sf):
    return rounded(surfaces.area_fraction(surfaces.kde(crime_events(spark, sf), 20)))


_HEIGHT, _WIDTH = (51.7 - 51.3) / 20, (0.3 + 0.5) / 20
_BOTH = "CASE WHEN {0} = floor({0}) THEN [floor({0}) - 1, floor({0})] ELSE [floor({0})] END"


@R("j05_holdout_grid", f"""WITH {_KDE}, t AS (SELECT (lat - 51.3::DOUBLE) / {_HEIGHT!r}::DOUBLE AS y, (lon - -0.5::DOUBLE) / {_WIDTH!r}::DOUBLE AS x FROM (SELECT lat, lon FROM ce WHERE lat IS NOT NULL AND day(occurred_at) > 15 UNION ALL SELECT 51.3::DOUBLE + {_HEIGHT!r}::DOUBLE * (seq % 21), -0.5::DOUBLE + {_WIDTH!r}::DOUBLE * (seq % 20) + 0.01::DOUBLE FROM ce)),
u AS (SELECT x, unnest({_BOTH.format("y")}) AS r FROM t), v AS (SELECT r, unnest({_BOTH.format("x")}) AS c FROM u), h AS (SELECT r, c, count(*) AS hits FROM v GROUP BY ALL)
SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, coalesce(hits, 0) AS hits, CAST((hits IS NOT NULL) AS INT) AS y FROM kd LEFT JOIN h ON r = row AND c = col""")
def j05_holdout_grid(spark, sf):
    """Test events in the cells of a grid, and as many points on the grid's own lines, which belong to the cells on both sides."""
    e = crime_events(spark, sf)
    test = e.filter("day(occurred_at) > 15").select("lat", "lon")
    on_lines = e.select((F.lit(51.3) + F.lit(_HEIGHT) * (F.col("seq") % 21)).alias("lat"), (F.lit(-0.5) + F.lit(_WIDTH) * (F.col("seq") % 20) + F.lit(0.01)).alias("lon"))
    return surfaces.grid_hits(surfaces.kde(e, 20), test.union(on_lines), 20, (51.3, 51.7, -0.5, 0.3)).select("row", "col", "hits", "y")


_TAPS = ", ".join(f"({k - 5}, {float(w)!r}::DOUBLE)" for k, w in enumerate(surfaces._taps(1.5)))
_G04 = f"""{CE}, pt AS (SELECT lat, lon FROM ce WHERE lat IS NOT NULL AND crime_type = 'burglary'), cf AS (SELECT 0.5 / 111.0::DOUBLE AS b, 1.2::DOUBLE AS f), bx AS (SELECT min(lat) - any_value(greatest(0.05, 4 * b)) AS y0, max(lat) + any_value(greatest(0.05, 4 * b)) AS y1, min(lon) - any_value(greatest(0.05, 4 * b)) AS x0, max(lon) + any_value(greatest(0.05, 4 * b)) AS x1, any_value(b) AS b, any_value(f) AS f FROM pt, cf),
gr AS (SELECT r.range AS row, c.range AS col, y0 + r.range * (y1 - y0) / 59 AS lat, x0 + c.range * (x1 - x0) / 59 AS lon, b, f FROM bx, range(60) r, range(60) c), di AS (SELECT row, col, b, f, sqrt(pow(gr.lat - pt.lat, 2) + pow(gr.lon - pt.lon, 2)) AS d FROM gr, pt),
rw AS (SELECT row, col, sum(CASE WHEN d <= b THEN 1 / pow(greatest(2 * b - d, 1e-10), f) WHEN d < 4 * b THEN pow(d, -f) ELSE 0 END) AS v FROM di GROUP BY ALL), tp(o, w) AS (VALUES {_TAPS}),
s1 AS (SELECT a.row, a.col, sum(w * b.v) AS v FROM rw a, tp JOIN rw b ON b.row = a.row AND b.col = greatest(0, least(59, a.col + o)) GROUP BY ALL), s2 AS (SELECT a.row, a.col, sum(w * b.v) AS v FROM s1 a, tp JOIN s1 b ON b.col = a.col AND b.row = greatest(0, least(59, a.row + o)) GROUP BY ALL),
pp AS (SELECT row, col, gr.lat, gr.lon, v / sum(v) OVER () AS p FROM s2 JOIN gr USING (row, col)), oo AS (SELECT *, sum(p) OVER w AS cum, row_number() OVER w AS k FROM pp WINDOW w AS (ORDER BY p DESC, row, col ROWS UNBOUNDED PRECEDING)),
ar AS (SELECT (max(lat) - min(lat)) / 59 * 111 * (max(lon) - min(lon)) / 59 * 111 * cos(radians((min(lat) + max(lat)) / 2)) AS cell, min(k) FILTER (cum >= 0.5 - 1e-12) AS k50, min(k) FILTER (cum >= 0.8 - 1e-12) AS k80, arg_min(lat, k) AS lat, arg_min(lon, k) AS lon, arg_min(p, k) AS p FROM oo)"""


@R("g04_profile", f"WITH {_G04} SELECT round(lat, 5) AS lat, round(lon, 5) AS lon, round(p, 5) AS peak_p, round(k50 * cell, 5) AS area50_km2, round(k80 * cell, 5) AS area80_km2 FROM ar")
def g04_profile(spark, sf):
    """G01-G04, W07 over the located events."""
    return rounded(surfaces.profile_summary(surfaces.geographic_profile(crime_events(spark, sf).filter("crime_type = 'burglary'"), 60)), 5)


def hawkes_events(spark, sf):
    e = crime_events(spark, sf).filter("lat is not null and occurred_at is not null")
    return e.select(F.col("seq").alias("id"), series.days_since_2000(F.col("occurred_at")).alias("t"), "lat", "lon")


_HK = f"{CE}, hk AS (SELECT seq AS id, (epoch(occurred_at) - 946684800) / 86400 AS t, lat, lon FROM ce WHERE lat IS NOT NULL AND occurred_at IS NOT NULL)"
_XC = "0.3 * 0.5 * exp(-0.5 * (b.t - a.t)) * 0.0001 / (pow(b.lat - a.lat, 2) + pow(b.lon - a.lon, 2) + 0.0001)"


@R("a13_hawkes_intensity", f"WITH {_HK} SELECT b.id, round(0.1 + coalesce(sum({_XC}), 0), 6) AS intensity FROM hk b LEFT JOIN hk a ON a.t < b.t AND b.t - a.t <= 40 GROUP BY b.id")
def a13_hawkes_intensity(spark, sf):
    e = hawkes_events(spark, sf)
    return rounded(surfaces.hawkes_intensity(e, e, 0.1, 0.3, 0.5, 0.01).select("id", "intensity"))


@R("a14_hawkes_nll", f"""WITH {_HK}, x AS (SELECT b.id, any_value(b.t) AS t, coalesce(sum({_XC}), 0) AS x FROM hk b LEFT JOIN hk a ON (a.t < b.t OR (a.t = b.t AND a.id < b.id)) AND b.t - a.t <= 40 GROUP BY b.id), m AS (SELECT max(t) AS t1, min(t) AS t0 FROM hk)
SELECT round(-sum(ln(0.1 + x)) + 0.1 * (max(t1) - max(t0)) + sum(0.3 * (1 - exp(-0.5 * (t1 - t)))), 4) AS nll FROM x, m""")
def a14_hawkes_nll(spark, sf):
    e = hawkes_events(spark, sf)
    value = surfaces.hawkes_nll(e, [(0.1, 0.3, 0.5, 0.01)])[0]
    return e.agg(F.round(F.lit(value), 4).alias("nll"))


@R("a15_hawkes_fit")
def a15_hawkes_fit(spark, sf):
    """The fit on all located events: parameters as a row."""
    got = surfaces.fit_hawkes(hawkes_events(spark, sf))
    return rounded(spark.createDataFrame([got]), 4)


@R("a16_hawkes_surface", f"""WITH {_HK}, m AS (SELECT max(t) AS t1 FROM hk), g AS (SELECT r.range AS row, c.range AS col, 51.3 + r.range * 0.4 / 9 AS lat, -0.5 + c.range * 0.8 / 9 AS lon FROM range(10) r, range(10) c)
SELECT CAST(g.row AS INT) AS row, CAST(g.col AS INT) AS col, round(0.1 + sum(0.15 * exp(-0.5 * (t1 - a.t)) * 0.0001 / (pow(g.lat - a.lat, 2) + pow(g.lon - a.lon, 2) + 0.0001)), 6) AS intensity FROM g, hk a, m WHERE a.t < t1 AND t1 - a.t <= 40 GROUP BY ALL""")
def a16_hawkes_surface(spark, sf):
    e = hawkes_events(spark, sf)
    t = e.agg(F.max("t")).first()[0]
    return rounded(surfaces.hawkes_surface(e, t, (51.3, 51.7, -0.5, 0.3), 10, 0.1, 0.3, 0.5, 0.01).select("row", "col", "intensity"))


@R("a17_gaussian_process")
def a17_gaussian_process(spark, sf):
    d = crime_events(spark, sf).filter("lat is not null").select("seq", F.col("lat").alias("x1"), F.col("lon").alias("x2"), (F.col("value") / 500).alias("y"))
    return rounded(surfaces.FourierProcess(length=0.1).fit(d).predict(d, "seq"), 4)


@R("a17_kernel_choice")
def a17_kernel_choice(spark, sf):
    """Log marginal likelihood of each length and noise tried, and which is the greatest."""
    d = crime_events(spark, sf).filter("lat is not null").select("seq", F.col("lat").alias("x1"), F.col("lon").alias("x2"), (F.col("value") / 500).alias("y"))
    best, tried = surfaces.choose_kernel(d, [0.03, 0.1, 0.3], [0.1, 0.3, 1.0], 64)
    top = max(tried, key=lambda t: t[2])
    return spark.createDataFrame([(length, noise, round(value, 3), (length, noise) == top[:2]) for length, noise, value in tried], "length double, noise double, log_likelihood double, best boolean")


def ensemble(spark, sf):
    """Poisson and Hawkes parts of each dated, located event."""
    from precinct.plans.core import zoned

    z = zoned(spark, sf).filter("occurred_at is not null and lat is not null")
    rows = rates.bucketed(z).select(F.col("seq").alias("id"), *rates.BUCKET)
    e = hawkes_events(spark, sf)
    h = surfaces.hawkes_intensity(e, e, 0.1, 0.3, 0.5, 0.01).select("id", "intensity")
    return rates.predict_poisson(rows, rates.fit_poisson(zoned(spark, sf))).join(h, "id")


def _mix_sql(rows: str, key: str) -> str:
    """Of rows (key, the bucket, intensity): the ensemble's columns."""
    return f"""en AS (SELECT {key}, intensity, coalesce(rate, 0.01) AS ex, CASE WHEN rate IS NULL THEN 1 - exp(-0.01) WHEN r IS NOT NULL THEN 1 - pow(1 - p, r) ELSE 1 - exp(-rate) END AS pa, CASE WHEN rate IS NULL THEN 0 ELSE lo END AS lo, CASE WHEN rate IS NULL THEN 2 ELSE hi END AS hi FROM {rows} LEFT JOIN fit USING ({WHICH}) LEFT JOIN qn USING ({WHICH})),
eo AS (SELECT {key}, greatest(0, least(1, 0.6 * pa + 0.4 * (1 - exp(-intensity)))) AS prob, 0.6 * ex + 0.4 * intensity AS expected_count, (hi - lo) / 3.29 AS aleatoric, abs(pa - (1 - exp(-intensity))) / 2 AS epistemic FROM en)
SELECT {key}, round(prob, 6) AS prob, round(expected_count, 6) AS expected_count, round(aleatoric, 6) AS aleatoric, round(epistemic, 6) AS epistemic, round(0.65 * expected_count, 6) AS ci90_low, round(1.55 * expected_count, 6) AS ci90_high,
round(greatest(0, least(1, prob - 1.96 * sqrt(aleatoric * aleatoric + epistemic * epistemic))), 6) AS ci95_low, round(greatest(0, least(1, prob + 1.96 * sqrt(aleatoric * aleatoric + epistemic * epistemic))), 6) AS ci95_high, 'poisson' AS dominant FROM eo"""


@R("g07_risk_grid", f"""WITH {_HK}, {_fit_sql("''")}, {QUANTILES}, m AS (SELECT max(t) AS t1 FROM hk), gc AS (SELECT CAST(r.range AS INT) AS row, CAST(c.range AS INT) AS col, 51.3 + 0.01 + r.range * 0.38 / 19 AS lat, -0.5 + 0.02 + c.range * 0.76 / 19 AS lon FROM range(20) r, range(20) c),
gi AS (SELECT row, col, 'Z' || ((row + col) % 12) AS zone, 6 AS hour_block, 6 AS dow, 1 AS month, '' AS type, 0.1 + sum(CASE WHEN a.t < t1 AND t1 - a.t <= 40 THEN 0.15 * exp(-0.5 * (t1 - a.t)) * 0.0001 / (pow(gc.lat - a.lat, 2) + pow(gc.lon - a.lon, 2) + 0.0001) ELSE 0 END) AS intensity FROM gc, hk a, m GROUP BY ALL), {_mix_sql("gi", "row, col")}""")
def g07_risk_grid(spark, sf):
    """The ensemble at the centres of 20 x 20 cells, on a Sunday noon."""
    from precinct.plans.core import zoned

    e = hawkes_events(spark, sf)
    t = e.agg(F.max("t")).first()[0]
    model = rates.fit_poisson(zoned(spark, sf), F.lit(""))
    zone = F.concat(F.lit("Z"), ((F.col("row") + F.col("col")) % 12).cast("string"))
    return rounded(ensemble_.risk_grid(e, model, zone, "2024-01-28 12:00:00", t, (51.3, 51.7, -0.5, 0.3)).select("row", "col", *_MIXED))


_MIXED = ["prob", "expected_count", "aleatoric", "epistemic", "ci90_low", "ci90_high", "ci95_low", "ci95_high", "dominant"]


@R("g05_series_profiles")
def g05_series_profiles(spark, sf):
    """The likely anchor of every series."""
    e = crime_events(spark, sf)
    m = series.detect_series(e, eps_km=0.15, eps_days=3.0, min_samples=8)
    return rounded(surfaces.series_profiles(m.join(e.select("event_id", "lat", "lon"), "event_id")), 5)


@R("g06_ensemble", f"""WITH {_HK}, {_fit_sql("lower(coalesce(crime_type, ''))")}, {QUANTILES}, hi_ AS (SELECT b.id, 0.1 + coalesce(sum({_XC}), 0) AS intensity FROM hk b LEFT JOIN hk a ON a.t < b.t AND b.t - a.t <= 40 GROUP BY b.id),
gi AS (SELECT id, suburb AS zone, CAST(hour(occurred_at) // 2 AS INT) AS hour_block, CAST(isodow(occurred_at) - 1 AS INT) AS dow, CAST(month(occurred_at) AS INT) AS month, lower(coalesce(crime_type, '')) AS type, intensity FROM hi_ JOIN ce ON seq = id), {_mix_sql("gi", "id")}""")
def g06_ensemble(spark, sf):
    return rounded(ensemble_.combine(ensemble(spark, sf)).select("id", "prob", "expected_count", "aleatoric", "epistemic", "ci90_low", "ci90_high", "ci95_low", "ci95_high", "dominant"))


@R("g05_series_centres", f"WITH {CE} SELECT CASE WHEN crime_type = 'burglary' THEN 'burglary' WHEN crime_type = 'theft' THEN 'theft' WHEN crime_type = 'assault' THEN 'violent' ELSE 'other' END AS bucket, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM ce WHERE lat IS NOT NULL GROUP BY 1")
def g05_series_centres(spark, sf):
    """Mean place of each bucket; the series' profiles are g05_series_profiles."""
    e = crime_events(spark, sf).filter("lat is not null")
    return rounded(e.groupBy(crime_bucket(F.col("crime_type")).alias("bucket")).agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon")))
