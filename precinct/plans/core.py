"""Queries over the event table: store, quality, time features, counts and the forecast."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from precinct.functions import geo, time
from precinct.operators import evaluation, quality, rates, store
from precinct.plans.base import Register, rounded
from precinct.plans.fixtures import CE, crime_events, table

R = Register()
_REL = "CASE source WHEN 'uk_police_v1' THEN 0.9 WHEN 'csv_import' THEN 0.6 WHEN 'sfpd' THEN 0.8 ELSE 0.5 END"
_DEC = "length(rtrim(substr(printf('%.6f', abs({0}) - floor(abs({0}))), 3, 6), '0'))"
#: DuckDB's quality columns over ce.
Q = f"""q AS (SELECT *, CAST(greatest(0, least(1, 0.3 * completeness + 0.2 * CASE temporal_precision WHEN 'hour' THEN 1.0 WHEN 'day' THEN 0.75 WHEN 'month' THEN 0.5 ELSE 0 END
  + 0.2 * CASE spatial_precision WHEN 'exact' THEN 1.0 WHEN 'block' THEN 0.66 WHEN 'suburb' THEN 0.33 ELSE 0 END + 0.3 * reliability)) AS DOUBLE) AS quality_score FROM (
  SELECT *, CAST((occurred_at IS NOT NULL)::INT + (lat IS NOT NULL AND lon IS NOT NULL)::INT + (crime_type IS NOT NULL)::INT + 1 AS DOUBLE) / 4 AS completeness,
  CASE WHEN occurred_at IS NULL THEN 'unknown' WHEN occurred_at <> date_trunc('day', occurred_at) THEN 'hour' WHEN day(occurred_at) = 1 THEN 'month' ELSE 'day' END AS temporal_precision,
  CASE WHEN lat IS NULL OR lon IS NULL THEN 'unknown' WHEN d >= 4 THEN 'exact' WHEN d >= 2 THEN 'block' WHEN d >= 1 THEN 'suburb' ELSE 'unknown' END AS spatial_precision, CAST({_REL} AS DOUBLE) AS reliability
  FROM (SELECT *, least({_DEC.format("lat")}, {_DEC.format("lon")}) AS d FROM ce)))"""


def scored(spark, sf):
    return quality.score_quality(crime_events(spark, sf))


@R("e05_quality", f"WITH {CE}, {Q} SELECT event_id, completeness, temporal_precision, spatial_precision, reliability, round(quality_score, 6) AS quality_score, quality_score < 0.6 AS low FROM q")
def e05_quality(spark, sf):
    """The parts of the score and the composite."""
    return rounded(scored(spark, sf).select("event_id", "completeness", "temporal_precision", "spatial_precision", "reliability", "quality_score", (F.col("quality_score") < 0.6).alias("low")))


@R("e06_import_summary", f"WITH {CE}, {Q} SELECT count(*) AS total, count(*) FILTER (quality_score >= 0.7) AS passing, count(*) FILTER (quality_score < 0.7) AS quarantined, round(avg((quality_score >= 0.7)::INT), 6) AS pass_rate, round(avg(quality_score), 6) AS avg_quality FROM q")
def e06_import_summary(spark, sf):
    return rounded(quality.import_summary(quality.score_quality(crime_events(spark, sf), threshold=0.7)))


@R("e07_quarantine_split", f"WITH {CE}, {Q} SELECT event_id, quality_score < 0.7 AS quarantined FROM q")
def e07_quarantine_split(spark, sf):
    good, bad = quality.split_quarantine(quality.score_quality(crime_events(spark, sf), threshold=0.7))
    return good.union(bad).select("event_id", "quarantined")


def weather(spark, sf):
    """Hourly weather, with gaps."""
    w = table(spark, sf, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour_utc")).agg((F.avg("value") / 10).alias("temperature"), (F.count("*") % 5 / 10.0).alias("precipitation"), F.count("*").alias("n"))
    return w.filter("n % 7 <> 0").drop("n")


_W = "w AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour_utc, avg(value) / 10 AS temperature, CAST(count(*) % 5 AS DOUBLE) / 10 AS precipitation FROM events GROUP BY 1 HAVING count(*) % 7 <> 0)"


@R("e08_nearest_weather", f"""WITH {CE}, {_W}, o AS (SELECT unnest([0, 1, 2, 3, 4]) AS prio, unnest([0, -1, 1, -2, 2]) AS off),
t AS (SELECT event_id, prio, w.* FROM ce, o JOIN w ON w.hour_utc = date_trunc('hour', occurred_at) + to_hours(off)),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY prio) = 1)
SELECT ce.event_id, b.hour_utc AS weather_hour, round(b.temperature, 3) AS temperature, b.precipitation FROM ce LEFT JOIN b USING (event_id)""")
def e08_nearest_weather(spark, sf):
    return rounded(quality.nearest_weather(crime_events(spark, sf), weather(spark, sf)).select("event_id", "weather_hour", F.round("temperature", 3).alias("temperature"), "precipitation"))


@R("e09_weather_gate", f"WITH {CE} SELECT count(*) AS n, false AS any_weather FROM ce")
def e09_weather_gate(spark, sf):
    """With a box that not all located events lie in, no event gets weather."""
    out = quality.enrich_weather(crime_events(spark, sf), weather(spark, sf), bbox=(50.0, 51.31, -1.5, 1.5))
    return out.agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("weather").isNotNull()), F.lit(False)).alias("any_weather"))


@R("e10_zones", f"WITH {CE} SELECT coalesce(suburb, 'unknown') AS zone, 'g_' || floor(lat / 0.05)::BIGINT || '_' || floor(lon / 0.05)::BIGINT AS cell, count(*) AS n FROM ce WHERE lat IS NOT NULL GROUP BY ALL")
def e10_zones(spark, sf):
    e = crime_events(spark, sf).filter("lat is not null")
    return e.groupBy(quality.zone(e, "suburb", "lga").alias("zone"), geo.zone_from_grid(F.col("lat"), F.col("lon"), 0.05).alias("cell")).agg(F.count("*").alias("n"))


@R("q01_scan", f"WITH {CE}, {Q} SELECT event_id, crime_type, occurred_at FROM q WHERE crime_type = 'theft' AND occurred_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND lat BETWEEN 51.35 AND 51.6 AND lon BETWEEN -0.3 AND 0.2 AND quality_score >= 0.5")
def q01_scan(spark, sf):
    return store.scan_events(scored(spark, sf), "THEFT", "2024-01-05", "2024-01-20", (51.35, 51.6, -0.3, 0.2), 0.5).select("event_id", "crime_type", "occurred_at")


@R("q02_keyword_scan", f"WITH {CE} SELECT event_id FROM ce WHERE occurred_at >= TIMESTAMP '2024-01-03' AND occurred_at < TIMESTAMP '2024-01-21' AND (event_id ILIKE '%knife%' OR coalesce(crime_type ILIKE '%knife%', false) OR coalesce(location_raw ILIKE '%knife%', false) OR narrative ILIKE '%knife%')")
def q02_keyword_scan(spark, sf):
    return store.search_events(crime_events(spark, sf), "Knife", start="2024-01-03", end="2024-01-20").select("event_id")


@R("q03_contains", f"WITH {CE} SELECT event_id FROM ce WHERE contains(lower(event_id), 'street 1') OR coalesce(contains(lower(crime_type), 'street 1'), false) OR coalesce(contains(lower(location_raw), 'street 1'), false) OR contains(lower(suburb), 'street 1') OR contains(lower(narrative), 'street 1')")
def q03_contains(spark, sf):
    return store.contains_search(crime_events(spark, sf), "Street 1").select("event_id")


@R("q04_lookup", f"WITH {CE} SELECT event_id, suburb, crime_type FROM ce WHERE event_id = 'ev_42'")
def q04_lookup(spark, sf):
    return crime_events(spark, sf).filter("event_id = 'ev_42'").select("event_id", "suburb", "crime_type")


@R("q05_count", f"WITH {CE}, {Q} SELECT count(*) AS n, round(avg(quality_score), 6) AS avg_quality FROM q")
def q05_count(spark, sf):
    """Q05, Q14."""
    return rounded(scored(spark, sf).agg(F.count("*").alias("n"), F.avg("quality_score").alias("avg_quality")))


@R("q06_recent", f"WITH {CE}, {Q} SELECT event_id, occurred_at FROM q WHERE quality_score >= 0.3 ORDER BY occurred_at DESC NULLS LAST, event_id LIMIT 500")
def q06_recent(spark, sf):
    return store.scan_events(scored(spark, sf), min_quality=0.3, limit=500).select("event_id", "occurred_at")


@R("q07_upsert", f"WITH {CE} SELECT event_id, CASE WHEN seq % 3 = 0 THEN 'updated' ELSE outcome END AS outcome FROM ce UNION ALL SELECT event_id || '_new', 'updated' FROM ce WHERE seq % 50 = 0")
def q07_upsert(spark, sf):
    e = crime_events(spark, sf).select("event_id", "outcome", "seq")
    old = e.filter("seq % 3 = 0").select("event_id", F.lit("updated").alias("outcome"), "seq")
    new = e.filter("seq % 50 = 0").select(F.concat("event_id", F.lit("_new")).alias("event_id"), F.lit("updated").alias("outcome"), "seq")
    return store.upsert(e, old.union(new).union(old.withColumns({"outcome": F.lit("stale"), "seq": F.col("seq") - 1}))).select("event_id", "outcome")


@R("q08_delete", f"WITH {CE} SELECT event_id FROM ce WHERE seq % 5 <> 0")
def q08_delete(spark, sf):
    e = crime_events(spark, sf)
    return store.delete(e, e.filter("seq % 5 = 0")).select("event_id")


@R("q10_type_shares", f"WITH {CE}, c AS (SELECT crime_type, count(*) AS n FROM ce WHERE crime_type IS NOT NULL GROUP BY 1) SELECT crime_type, n, round(100.0 * n / sum(n) OVER (), 6) AS pct, row_number() OVER (ORDER BY n DESC, crime_type) = 1 AS is_top FROM c")
def q10_type_shares(spark, sf):
    """Q09, Q10."""
    return rounded(store.type_shares(crime_events(spark, sf)))


@R("q11_by_hour", f"WITH {CE} SELECT date_trunc('hour', occurred_at)::TIMESTAMP AS hour, count(*) AS n FROM ce WHERE occurred_at IS NOT NULL GROUP BY 1")
def q11_by_hour(spark, sf):
    return store.counts_by(crime_events(spark, sf), "hour")


@R("q12_hour_histogram", f"WITH {CE}, h AS (SELECT hour(occurred_at) AS hour, count(*) AS n FROM ce WHERE occurred_at IS NOT NULL GROUP BY 1), g AS (SELECT CAST(r.range AS INT) AS hour, coalesce(n, 0) AS n FROM range(24) r LEFT JOIN h ON h.hour = r.range) SELECT hour, n, row_number() OVER (ORDER BY n DESC, hour) = 1 AS is_peak FROM g")
def q12_hour_histogram(spark, sf):
    return store.hour_histogram(crime_events(spark, sf))


@R("q13_daily_trend", f"WITH {CE} SELECT date_trunc('day', occurred_at)::TIMESTAMP AS day, count(*) AS n FROM ce WHERE occurred_at IS NOT NULL GROUP BY 1")
def q13_daily_trend(spark, sf):
    return store.counts_by(crime_events(spark, sf), "day")


@R("q15_heatmap", f"""WITH {CE}, t AS (SELECT CAST(isodow(occurred_at) - 1 AS INT) AS dow, CAST(hour(occurred_at) AS INT) AS hour, CAST(month(occurred_at) AS INT) AS month FROM ce WHERE occurred_at IS NOT NULL)
SELECT 'cell' AS kind, dow, hour, NULL AS month, count(*) AS n FROM t GROUP BY dow, hour UNION ALL SELECT 'hour', NULL, hour, NULL, count(*) FROM t GROUP BY hour
UNION ALL SELECT 'dow', dow, NULL, NULL, count(*) FROM t GROUP BY dow UNION ALL SELECT 'month', NULL, NULL, month, count(*) FROM t GROUP BY month""")
def q15_heatmap(spark, sf):
    return store.heatmap(crime_events(spark, sf))


@R("q18_upgrade", f"WITH {CE} SELECT event_id, CAST(1.0 AS DOUBLE) AS quality_score, '' AS narrative_tags FROM ce")
def q18_upgrade(spark, sf):
    return store.upgrade(crime_events(spark, sf)).select("event_id", "quality_score", "narrative_tags")


@R("q19_case_events", f"""WITH {CE} SELECT event_id FROM ce WHERE contains(event_id, 'c7') OR coalesce(contains(lower(crime_type), 'c7'), false) OR coalesce(contains(lower(location_raw), 'c7'), false) OR contains(lower(narrative), 'c7')
UNION SELECT event_id FROM (SELECT * FROM ce ORDER BY occurred_at DESC NULLS LAST, event_id LIMIT 2000) WHERE contains(event_id, 'c7') OR contains(meta, '"caseId":"c7')""")
def q19_case_events(spark, sf):
    return store.case_events(crime_events(spark, sf), "C7").select("event_id")


@R("q20_leads_of_case", f"""WITH {CE}, c AS (SELECT event_id FROM ce WHERE seq % 10 < 4), l AS (SELECT seq, seq % 3 AS k, event_id FROM ce)
SELECT 'lead_' || seq AS lead_id FROM l WHERE (k = 0 AND event_id IN (FROM c)) OR (k = 1 AND event_id IN (FROM c)) OR k = 2""")
def q20_leads_of_case(spark, sf):
    e = crime_events(spark, sf)
    leads = e.select(
        F.concat(F.lit("lead_"), "seq").alias("lead_id"), F.when(F.col("seq") % 3 == 0, F.array("event_id", F.lit("ev_none"))).otherwise(F.array().cast("array<string>")).alias("related_event_ids"),
        F.when(F.col("seq") % 3 == 1, F.to_json(F.struct(F.col("event_id").alias("eventId")))).otherwise(F.lit("{}")).alias("supporting_data"),
    )
    return store.leads_of_case(leads, e.filter("seq % 10 < 4")).select("lead_id")


@R("q22_import_profile", f"WITH {CE}, {Q} SELECT count(*) AS total, count(lat) AS with_coords, count(occurred_at) AS with_date, count(crime_type) AS with_type, count(DISTINCT crime_type) AS types, count(*) FILTER (quality_score < 0.3) AS quarantined, round(avg((quality_score >= 0.3)::INT), 6) AS pass_rate, round(avg(quality_score), 6) AS mean_quality FROM q")
def q22_import_profile(spark, sf):
    return rounded(store.import_profile(scored(spark, sf)))


@R("s08_months", f"WITH {CE}, r AS (SELECT date_trunc('month', min(occurred_at))::DATE AS a, max(occurred_at)::DATE AS b FROM ce) SELECT unnest(generate_series(a, b, INTERVAL 1 MONTH))::DATE AS month FROM r")
def s08_months(spark, sf):
    """One unit of work for each month of the data's range."""
    r = crime_events(spark, sf).agg(F.trunc(F.to_date(F.min("occurred_at")), "MM").alias("a"), F.to_date(F.max("occurred_at")).alias("b"))
    return r.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))


@R("s16_since", f"WITH {CE} SELECT event_id, occurred_at FROM ce WHERE occurred_at >= TIMESTAMP '2024-01-15'")
def s16_since(spark, sf):
    return crime_events(spark, sf).filter(F.col("occurred_at") >= F.lit("2024-01-15").cast("timestamp")).select("event_id", "occurred_at")


@R("f05_time_features", f"""WITH {CE}, t AS (SELECT *, hour(occurred_at) AS h, isodow(occurred_at) - 1 AS w, month(occurred_at) AS m, dayofyear(occurred_at) AS y, date_diff('day', DATE '2000-01-06', occurred_at::DATE) AS l FROM ce WHERE occurred_at IS NOT NULL),
s AS (SELECT *, radians(-23.45 * cos(2 * pi() * (y + 10) / 365)) AS tilt, radians((h + minute(occurred_at) / 60.0 + floor(second(occurred_at)) / 3600.0 - 12) * 15) AS turn, radians(coalesce(lat, 51.5)) AS la FROM t),
u AS (SELECT *, degrees(asin(greatest(-1, least(1, sin(la) * sin(tilt) + cos(la) * cos(tilt) * cos(turn))))) AS alt FROM s)
SELECT event_id, round(sin(2 * pi() * h / 24), 6) AS hour_sin, round(cos(2 * pi() * w / 7), 6) AS dow_cos, round(sin(2 * pi() * (m - 1) / 12), 6) AS month_sin, round(cos(2 * pi() * y / 365), 6) AS doy_cos,
w >= 5 AS is_weekend, h >= 22 OR h <= 5 AS is_night, CAST(floor((day(occurred_at) - 1) / 7) + 1 AS BIGINT) AS week_of_month, CAST(least(y % 14, 14 - y % 14) AS INT) AS payday_distance,
round((l - 29.53059 * floor(l / 29.53059)) / 29.53059, 6) AS lunar_phase, round(alt, 6) AS sun_altitude, alt < -6 AS is_dark FROM u""")
def f05_time_features(spark, sf):
    """F01-F05."""
    out = time.temporal_features(crime_events(spark, sf).filter("occurred_at is not null"))
    return rounded(out.select("event_id", "hour_sin", "dow_cos", "month_sin", "doy_cos", "is_weekend", "is_night", "week_of_month", "payday_distance", "lunar_phase", "sun_altitude", "is_dark"))


_HAV = "2 * 6371.0 * atan2(sqrt({a}), sqrt(greatest(1 - ({a}), 0)))".format(a="pow(sin(radians(51.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(51.5)) * pow(sin(radians(-0.1 - lon) / 2), 2)")


@R("f06_haversine", f"WITH {CE}, d AS (SELECT event_id, {_HAV} AS km FROM ce WHERE lat IS NOT NULL) SELECT event_id, round(km, 6) AS km, round(CASE WHEN km > 5 THEN 0 ELSE exp(-km / 5) END, 6) AS weight FROM d")
def f06_haversine(spark, sf):
    """F06, F25."""
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(51.5), F.lit(-0.1))
    return rounded(crime_events(spark, sf).filter("lat is not null").select("event_id", km.alias("km")).withColumn("weight", geo.decay(F.col("km"), F.lit(5.0))))


def zoned(spark, sf):
    e = crime_events(spark, sf)
    return e.withColumn("zone", quality.zone(e, "suburb", "lga"))


#: DuckDB's fitted buckets; {type} is the bucket's type.
def _fit_sql(kind: str) -> str:
    return f"""b AS (SELECT suburb AS zone, CAST(hour(occurred_at) // 2 AS INT) AS hour_block, CAST(isodow(occurred_at) - 1 AS INT) AS dow, CAST(month(occurred_at) AS INT) AS month, {kind} AS type, occurred_at::DATE AS day, count(*) AS c FROM ce WHERE occurred_at IS NOT NULL GROUP BY ALL),
f AS (SELECT zone, hour_block, dow, month, type, count(*) AS n_days, sum(c) / count(*) AS rate, greatest(sum(c * c) / count(*) - pow(sum(c) / count(*), 2), 0) AS variance FROM b GROUP BY ALL),
g AS (SELECT *, CASE WHEN n_days > 5 AND variance > rate AND rate > 0 THEN rate * rate / (variance - rate) END AS r FROM f),
fit AS (SELECT *, rate / (rate + r) AS p FROM g)"""


@R("a02_poisson_fit", f"WITH {CE}, {_fit_sql("lower(coalesce(crime_type, ''))")} SELECT zone, hour_block, dow, month, type, n_days, round(rate, 6) AS rate, round(variance, 6) AS variance, round(r, 4) AS r, round(p, 6) AS p FROM fit")
def a02_poisson_fit(spark, sf):
    """A01, A02."""
    out = rates.fit_poisson(zoned(spark, sf))
    return rounded(out.withColumn("r", F.round("r", 4)))


WHICH = "zone, hour_block, dow, month, type"
#: Quantiles of the fitted counts, Poisson (F21) and negative binomial.
QUANTILES = f"""pm AS (SELECT {WHICH}, k.range AS k, sum(CASE WHEN r IS NULL THEN exp(k.range * ln(rate) - rate - lgamma(k.range + 1)) ELSE exp(lgamma(k.range + r) - lgamma(k.range + 1) - lgamma(r) + r * ln(1 - p) + k.range * ln(p)) END) OVER (PARTITION BY {WHICH} ORDER BY k.range) AS cdf FROM fit, range(200) k),
qn AS (SELECT {WHICH}, CAST(min(k) FILTER (cdf >= 0.05) AS DOUBLE) AS lo, CAST(min(k) FILTER (cdf >= 0.95) AS DOUBLE) AS hi FROM pm GROUP BY ALL)"""


@R("a03_poisson_predict", f"""WITH {CE}, {_fit_sql("lower(coalesce(crime_type, ''))")}, {QUANTILES},
rows AS (SELECT ce.event_id, suburb AS zone, CAST(hour(occurred_at) // 2 AS INT) AS hour_block, CAST(isodow(occurred_at) - 1 AS INT) AS dow, CAST(month(occurred_at) AS INT) AS month, CASE WHEN seq % 5 = 0 THEN 'other' ELSE lower(coalesce(crime_type, '')) END AS type FROM ce WHERE occurred_at IS NOT NULL)
SELECT event_id, round(coalesce(rate, 0.01), 6) AS lambda, round(coalesce(rate, 0.01), 6) AS expected, CASE WHEN rate IS NULL THEN 0 ELSE lo END AS ci90_lo, CASE WHEN rate IS NULL THEN 2 ELSE hi END AS ci90_hi, round(CASE WHEN rate IS NULL THEN 1 - exp(-0.01) WHEN r IS NOT NULL THEN 1 - pow(1 - p, r) ELSE 1 - exp(-rate) END, 6) AS p_any, coalesce(n_days, 0) AS n, CASE WHEN r IS NOT NULL THEN 'NegativeBinomial' ELSE 'NonHomogeneousPoisson' END AS model
FROM rows LEFT JOIN fit USING ({WHICH}) LEFT JOIN qn USING ({WHICH})""")
def a03_poisson_predict(spark, sf):
    """A03, J12; types that no bucket has get the prior."""
    e = zoned(spark, sf).filter("occurred_at is not null")
    rows = rates.bucketed(e, kind=F.when(F.col("seq") % 5 == 0, "other").otherwise(F.lower(F.coalesce("crime_type", F.lit("")))))
    return rounded(rates.predict_poisson(rows.select("event_id", *rates.BUCKET), rates.fit_poisson(e)).select("event_id", "lambda", "expected", "p_any", "ci90_lo", "ci90_hi", "n", "model"))


@R("f21_count_quantiles", f"""WITH {CE}, {_fit_sql("''")}, u AS (SELECT DISTINCT rate FROM fit WHERE r IS NULL), k AS (SELECT range AS k FROM range(200)),
c AS (SELECT rate, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY rate ORDER BY k) AS cdf FROM u, k)
SELECT round(rate, 6) AS rate, CAST(min(k) FILTER (cdf >= 0.05) AS DOUBLE) AS lo, CAST(min(k) FILTER (cdf >= 0.95) AS DOUBLE) AS hi FROM c GROUP BY rate""")
def f21_count_quantiles(spark, sf):
    """Poisson quantiles of the fitted rates."""
    m = rates.fit_poisson(zoned(spark, sf), F.lit("")).filter("r is null").select("rate").distinct()
    none = F.lit(None).cast("double")
    return rounded(m.select("rate", rates.count_quantile("rate", none, none, F.lit(0.05)).alias("lo"), rates.count_quantile("rate", none, none, F.lit(0.95)).alias("hi")))


_GP = f"""zc AS (SELECT suburb AS zone, count(*) AS k FROM ce GROUP BY 1), st AS (SELECT avg(k / 30.0) AS mu, var_samp(k / 30.0) AS s2 FROM zc),
pri AS (SELECT greatest(mu * mu / s2, 0.1) AS alpha0, greatest(mu / s2, 0.1) AS beta0 FROM st),
tq AS (SELECT sqrt(-2 * ln(0.05)) AS t), zq AS (SELECT t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t) AS z FROM tq),
post AS (SELECT zone, k, alpha0, beta0, alpha0 + k AS alpha, beta0 + 30 AS beta, z FROM zc, pri, zq)"""


@R("a05_gamma_poisson", f"""WITH {CE}, {_GP} SELECT zone, k, round(alpha / beta, 6) AS mean, round(alpha / (beta * beta), 6) AS var,
round(alpha * pow(1 - 1 / (9 * alpha) - z / (3 * sqrt(alpha)), 3) / beta, 6) AS lo, round(alpha * pow(1 - 1 / (9 * alpha) + z / (3 * sqrt(alpha)), 3) / beta, 6) AS hi,
round(alpha / beta * 7, 6) AS predicted, round((1 - k / (k + beta0)) * alpha0 / beta0 + k / (k + beta0) * alpha / beta, 6) AS shrunk FROM post""")
def a05_gamma_poisson(spark, sf):
    """A04, A05, A07, F24."""
    counts = zoned(spark, sf).groupBy("zone").agg(F.count("*").alias("k"))
    return rounded(rates.shrinkage(rates.fit_gamma_poisson(counts)).select("zone", "k", "mean", "var", "lo", "hi", "predicted", "shrunk"))


@R("a06_predictive", f"""WITH {CE}, {_GP}, ks AS (SELECT range AS i FROM range(5)) SELECT zone, round(1 - sum(exp(lgamma(i + alpha) - lgamma(i + 1) - lgamma(alpha) + i * ln(1 / (beta + 1)) + alpha * ln(beta / (beta + 1)))), 6) AS p_at_least
FROM post, ks GROUP BY zone""")
def a06_predictive(spark, sf):
    """P(5 or more events on a day)."""
    counts = zoned(spark, sf).groupBy("zone").agg(F.count("*").alias("k"))
    return rounded(rates.predictive_probability(rates.fit_gamma_poisson(counts), 5, 1.0).select("zone", "p_at_least"))


_START = "2024-01-28"
_FC = f"""{_fit_sql("''")}, tg AS (SELECT DISTINCT suburb AS zone, unnest(generate_series(DATE '{_START}', DATE '{_START}' + 6, INTERVAL 1 DAY))::DATE AS day FROM ce),
mx AS (SELECT max(occurred_at)::DATE AS latest FROM ce), dl AS (SELECT suburb AS zone, occurred_at::DATE AS seen, count(*) AS c FROM ce, mx WHERE occurred_at IS NOT NULL AND latest - occurred_at::DATE <= 30 GROUP BY ALL),
es AS (SELECT tg.zone, tg.day, 1 + least(coalesce(sum(c * exp(-0.1 * (day - seen))), 0) / 3, 1) AS escalation FROM tg LEFT JOIN dl ON dl.zone = tg.zone AND day - seen BETWEEN 0 AND 14 GROUP BY ALL),
fd AS (SELECT es.zone, es.day, escalation * CASE WHEN isodow(day) >= 5 THEN 1.2 ELSE 1.0 END * CASE WHEN month(day) >= 10 OR month(day) <= 2 THEN 1.1 ELSE 1.0 END AS factor,
  coalesce(rate, 0.01) AS lam, CASE WHEN rate IS NULL THEN 1 - exp(-0.01) WHEN r IS NOT NULL THEN 1 - pow(1 - p, r) ELSE 1 - exp(-rate) END AS p_any, escalation
  FROM es LEFT JOIN fit ON fit.zone = es.zone AND fit.hour_block = 6 AND fit.dow = isodow(day) - 1 AND fit.month = month(day) AND fit.type = ''),
fz AS (SELECT zone, day, greatest(0, least(1, p_any * factor)) AS risk, lam * factor AS expected FROM fd)"""


@R("w10_escalation", f"WITH {CE}, {_FC} SELECT zone, day, round(escalation, 6) AS escalation FROM es")
def w10_escalation(spark, sf):
    e = zoned(spark, sf)
    t = e.select("zone").distinct().withColumn("day", F.explode(F.sequence(F.lit(_START).cast("date"), F.date_add(F.lit(_START).cast("date"), 6))))
    return rounded(rates.escalation(e, t))


@R("w12_forecast_days", f"WITH {CE}, {_FC} SELECT zone, day, round(risk, 6) AS risk, round(expected, 6) AS expected FROM fz")
def w12_forecast_days(spark, sf):
    """W11, W12, X04 flat."""
    return rounded(rates.forecast_days(zoned(spark, sf), _START))


@R("w12_forecast", f"""WITH {CE}, {_FC} SELECT zone, round(avg(risk), 6) AS weekly_risk, round(sum(expected), 6) AS expected, round(max(risk), 6) AS peak_risk, arg_min(day, (-round(risk, 12), day)) AS peak_day,
CASE WHEN avg(risk) >= 0.75 THEN 'CRITICAL' WHEN avg(risk) >= 0.5 THEN 'HIGH' WHEN avg(risk) >= 0.3 THEN 'ELEVATED' ELSE 'NORMAL' END AS alert FROM fz GROUP BY zone""")
def w12_forecast(spark, sf):
    return rounded(rates.forecast(zoned(spark, sf), _START))


@R("w13_top_zones", f"WITH {CE}, {_GP} SELECT zone, round(alpha / beta, 6) AS mean, CASE WHEN alpha / beta > 2 * alpha0 / beta0 THEN 'hot' WHEN alpha / beta > 1.3 * alpha0 / beta0 THEN 'elevated' ELSE 'normal' END AS label, row_number() OVER (ORDER BY alpha / beta DESC, zone) AS rank FROM post QUALIFY rank <= 8")
def w13_top_zones(spark, sf):
    """The panel of the eight riskiest zones."""
    post = rates.fit_gamma_poisson(zoned(spark, sf).groupBy("zone").agg(F.count("*").alias("k")))
    g = F.col("alpha0") / F.col("beta0")
    top = rates.rank_zones(post, "mean", 8)
    return rounded(top.select("zone", "mean", F.when(F.col("mean") > 2 * g, "hot").when(F.col("mean") > 1.3 * g, "elevated").otherwise("normal").alias("label"), "rank"))


@R("w14_split", f"""WITH {CE}, l AS (SELECT event_id, row_number() OVER (ORDER BY occurred_at, event_id) AS k, count(*) OVER () AS n FROM (SELECT * FROM ce WHERE occurred_at IS NOT NULL ORDER BY occurred_at DESC, event_id LIMIT 500))
SELECT event_id, CASE WHEN k <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS part FROM l""")
def w14_split(spark, sf):
    """Temporal 80/20 split of the latest 500."""
    last = crime_events(spark, sf).filter("occurred_at is not null").orderBy(*store.newest()).limit(500)
    k = F.row_number().over(Window.orderBy("occurred_at", "event_id"))  # over 500 rows
    return last.withColumns({"k": k, "n": F.count("*").over(Window.partitionBy())}).select("event_id", F.when(F.col("k") <= F.floor(0.8 * F.col("n")), "train").otherwise("test").alias("part"))


@R("w15_month_split", f"WITH {CE} SELECT CASE WHEN occurred_at IS NULL THEN 'undated' WHEN day(occurred_at) <= 15 THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM ce GROUP BY 1")
def w15_holdout_split(spark, sf):
    """Holdout by date (the data has one month, so its first half is the training part); undated rows are counted."""
    part = F.when(F.col("occurred_at").isNull(), "undated").when(F.dayofmonth("occurred_at") <= 15, "train").otherwise("test")
    return crime_events(spark, sf).groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@R("w15_holdout", """WITH o AS (SELECT o_orderpriority AS zone, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END AS d FROM orders), p AS (SELECT zone, CASE WHEN d IS NULL THEN 'undated' WHEN month(d) <= 4 THEN 'train' ELSE 'test' END AS part FROM o),
s AS (SELECT count(*) FILTER (part = 'train') AS train, count(*) FILTER (part = 'test') AS test, count(*) FILTER (part = 'undated') AS undated, count(*) FILTER (part = 'train') >= 20 AND count(*) FILTER (part = 'test') >= 10 AS enough FROM p)
SELECT part, zone, count(*) AS n, s.* FROM p, s WHERE part <> 'undated' GROUP BY ALL""")
def w15_holdout(spark, sf):
    """January to April against the later months, of orders of several years; some have no date."""
    dated = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("zone"), F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate")).alias("d"))
    train, test, sizes = evaluation.month_holdout(dated, "d")
    parts = train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))
    return parts.groupBy("part", "zone").agg(F.count("*").alias("n")).crossJoin(F.broadcast(sizes))  # one row


@R("w16_badge", f"WITH {CE}, {Q} SELECT CASE WHEN quality_score >= 0.7 THEN 'High' WHEN quality_score >= 0.4 THEN 'Med' ELSE 'Low' END AS badge, count(*) AS n FROM q GROUP BY 1")
def w16_badge(spark, sf):
    q = F.col("quality_score")
    return scored(spark, sf).groupBy(F.when(q >= 0.7, "High").when(q >= 0.4, "Med").otherwise("Low").alias("badge")).agg(F.count("*").alias("n"))


