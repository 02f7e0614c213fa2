"""Linked series: DBSCAN by joins, near-repeat pairs, Knox ratio and event-to-series links."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from precinct import fixed
from precinct.blocks.band_join import METRES_PER_DEGREE, count_near, reach_join, rim_join, sides
from precinct.blocks.density import border_places, dense_places
from precinct.blocks.ranks import global_cumulate
from precinct.blocks.shared import materialize
from precinct.functions.geo import KM_PER_DEGREE, haversine_km
from precinct.functions.text import crime_bucket, near_repeat_band


def days_since_2000(ts: Column) -> Column:
    return (ts.cast("double") - 946684800) / 86400.0


def _located(events: DataFrame) -> DataFrame:
    return events.filter("lat is not null and lon is not null and occurred_at is not null").withColumn("t", days_since_2000(F.col("occurred_at")))


def near_repeats(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Alerts (event, prior, metres, days, score): pairs inside the later event's band. `seq` orders events.

    Cells are twice as wide as the widest band; an event goes to those that its own band reaches."""
    band = near_repeat_band(F.col("crime_type"))
    no_type = F.col("crime_type").isNull() | (F.trim("crime_type") == "")
    e = _located(events).withColumns({"band_m": F.when(no_type, 200.0).otherwise(band["metres"]), "band_d": F.when(no_type, 14.0).otherwise(band["days"])})
    widest = max(v[0] for v in [*fixed.NEAR_REPEAT.values(), fixed.NEAR_REPEAT_DEFAULT])
    longest = max(v[1] for v in [*fixed.NEAR_REPEAT.values(), fixed.NEAR_REPEAT_DEFAULT])
    a, b = sides(e.withColumnRenamed(seq, "seq_"), ["event_id", "seq_", "lat", "lon", "t", "band_m", "band_d"])
    pairs = reach_join(a, b.drop("b_band_m", "b_band_d"), widest, longest, F.col("b_seq_") < F.col("a_seq_"))
    metres = haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) * 1000
    out = pairs.withColumns({"metres": metres, "days": F.abs(F.col("a_t") - F.col("b_t"))}).filter("metres <= a_band_m and days <= a_band_d")
    score = F.exp(-F.col("metres") / F.col("a_band_m")) * F.exp(-F.col("days") / F.col("a_band_d"))
    return out.select(F.col("a_event_id").alias("event_id"), F.col("b_event_id").alias("prior_id"), "metres", "days", score.alias("score"))


def knox(events: DataFrame, metres: float = 200.0, days: float = 14.0) -> DataFrame:
    """One row: near pairs, expected pairs and their ratio."""
    e = _located(events)
    box = e.agg(F.count("*").alias("n"), F.min("lat").alias("y0"), F.max("lat").alias("y1"), F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    count = count_near(e.select("lat", "lon", "t"), metres, days)
    side = lambda span: F.greatest(span, F.lit(5.0 * metres))
    high = side((F.col("y1") - F.col("y0")) * METRES_PER_DEGREE)
    wide = side((F.col("x1") - F.col("x0")) * METRES_PER_DEGREE * F.cos(F.radians((F.col("y0") + F.col("y1")) / 2)))
    disc = math.pi * metres * metres
    share = F.least(F.lit(1.0), disc / F.greatest(high * wide, F.lit(disc))) * F.least(F.lit(1.0), days / F.greatest(F.col("t1") - F.col("t0"), F.lit(1e-9)))
    expected = F.col("n") * (F.col("n") - 1) / 2 * share
    one = box.crossJoin(F.broadcast(count)).withColumn("expected", expected)  # one row each
    ratio = F.when(F.col("n") < 2, 1.0).when(F.col("expected") < 1e-9, F.when(F.col("near") > 0, F.col("near").cast("double")).otherwise(1.0)).otherwise(F.col("near") / F.col("expected"))
    return one.select("n", "near", "expected", ratio.alias("ratio"))


BUCKET_ORDER = {"burglary": 1, "theft": 2, "violent": 3, "other": 4}


def detect_series(events: DataFrame, eps_km: float = 0.3, eps_days: float = 30.0, min_samples: int = 3, seq: str = "seq", null_island: bool = False, eps_by_bucket: dict[str, float] | None = None, within: str | None = None) -> DataFrame:
    """event_id, series_id for the members of series; noise is left out.

    Core points have min_samples neighbours, themselves included; series are the connected components of core points;
    a border point goes to the series that comes first. Missing places are dropped unless null_island. within: a column, such as
    the case, whose values have series of their own; the result has it, too."""
    e = events if null_island else events.filter("lat is not null and lon is not null")
    e = e.filter("occurred_at is not null").dropDuplicates(["event_id"])
    bucket = crime_bucket(F.col("crime_type"))
    base = eps_km / KM_PER_DEGREE
    scale = F.lit(1.0)  # wider or narrower buckets are brought to the common radius
    for name, km in (eps_by_bucket or {}).items():
        if km > 0:
            scale = F.when(bucket == name, eps_km / km).otherwise(scale)
    days = F.floor(days_since_2000(F.col("occurred_at")))
    scope = F.lit("") if within is None else F.col(within).cast("string")
    pts = e.select(F.col(seq).alias("id"), "event_id", scope.alias("scope"), bucket.alias("bucket"), F.concat_ws("|", scope, bucket).alias("grp"), (F.coalesce("lat", F.lit(0.0)) * scale).alias("x"), (F.coalesce("lon", F.lit(0.0)) * scale).alias("y"), (days * base / eps_days).alias("z"))
    pts = materialize(pts, "series-points")
    places = materialize(dense_places(pts.select("id", "grp", "x", "y", "z"), base, min_samples), "series-places")
    at = pts.join(places.select("grp", "x", "y", "z", F.col("id").alias("place"), "component"), ["grp", "x", "y", "z"])
    first = at.filter("component is not null").groupBy("scope", "bucket", "component").agg(F.min("id").alias("first"))
    order = F.element_at(F.create_map(*[F.lit(x) for kv in BUCKET_ORDER.items() for x in kv]), F.col("bucket"))
    first = first.withColumn("order", order)
    if within is None:
        numbered = global_cumulate(first, [F.asc("order"), F.asc("first")], {}, "k")
    else:
        numbered = first.withColumn("k", F.row_number().over(Window.partitionBy("scope").orderBy("order", "first")).cast("long"))
    name = F.concat(F.lit("SERIES-"), F.lpad(F.col("k").cast("string"), F.greatest(F.lit(4), F.length(F.col("k").cast("string"))), F.lit("0")))
    named = materialize(numbered.select("component", F.struct("k", name.alias("series_id")).alias("rank")), "series-names")
    border = border_places(places, named, base).select(F.col("id").alias("place"), "best")
    columns = ["event_id"] if within is None else [F.col("scope").alias(within), "event_id"]
    of_core = at.join(named, "component").select(*columns, "rank.series_id")
    return of_core.union(at.join(border, "place").select(*columns, "best.series_id"))


def series_summary(members: DataFrame, events: DataFrame) -> DataFrame:
    """A row a series: centroid, days, dominant type, size, span and status."""
    m = members.join(events.select("event_id", "crime_type", "lat", "lon", "occurred_at"), "event_id")
    kinds = m.groupBy("series_id", F.coalesce("crime_type", F.lit("")).alias("kind")).agg(F.count("*").alias("c"))
    top = kinds.groupBy("series_id").agg(F.min_by("kind", F.struct(-F.col("c"), F.col("kind"))).alias("dominant_type"))
    s = m.groupBy("series_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min(F.to_date("occurred_at")).alias("first_day"), F.max(F.to_date("occurred_at")).alias("last_day"), F.count("*").alias("size"))
    status = F.when(F.col("size") >= 10, "CRITICAL").when(F.col("size") >= 5, "HIGH").otherwise("ACTIVE")
    return s.join(top, "series_id").withColumns({"span_days": F.datediff("last_day", "first_day"), "status": status})


def override_series(members: DataFrame, overrides: DataFrame) -> DataFrame:
    """members with the analyst's assignments (event_id, new_series; null takes the event out) in their place."""
    out = members.join(overrides.withColumn("_o", F.lit(True)), "event_id", "full")
    return out.select("event_id", F.when(F.col("_o"), F.col("new_series")).otherwise(F.col("series_id")).alias("series_id")).filter("series_id is not null").distinct()


def _nearest_times(asked: DataFrame, times: DataFrame) -> DataFrame:
    """(series, t, dt): how far each of asked (series, t) lies from the nearest of the times (series, t) of its series.

    A day's times are sorted once; those of other days count by their first and last, so no window holds a series as a whole."""
    day = F.floor("t").cast("long").alias("day")
    every = times.select("series", day, "t", F.col("t").alias("of")).union(asked.select("series", day, "t", F.lit(None).cast("double").alias("of")))
    in_day = Window.partitionBy("series", "day")
    own = every.withColumns({"below": F.max("of").over(in_day.orderBy("t")), "above": F.min("of").over(in_day.orderBy(F.desc("t")))}).filter("of is null").drop("of")
    days = every.groupBy("series", "day").agg(F.min("of").alias("first"), F.max("of").alias("last"))
    others = lambda order: Window.partitionBy("series").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("series", "day", F.max("last").over(others(F.asc("day"))).alias("before"), F.min("first").over(others(F.desc("day"))).alias("after"))
    t = F.col("t")
    return own.join(days, ["series", "day"]).select("series", "t", F.least(t - F.col("below"), F.col("above") - t, t - F.col("before"), F.col("after") - t).alias("dt"))


def link_probability(probes: DataFrame, members: DataFrame, events: DataFrame, mo: DataFrame | None = None, least: float = 0.2, scope: str | None = None) -> DataFrame:
    """(event_id, series_id, km, dt, p) for probes near a series: nearest place and nearest time count independently, so they may be
    those of two members.

    mo: (event_id, series_id, mo), similarity of method from 0 to 1; without a row it is 0. scope: a column of probes and members,
    such as the case; only those of one value meet. Where neither method nor time alone reaches `least`, candidates are the
    series with a place in the space band, at whatever time; the pairs of mo are candidates, too, and below that `least` all pairs are.
    Places meet once for all events at them, and times once for all at them."""
    key = [scope] if scope else []
    at = events.select("event_id", "crime_type", "lat", "lon", "occurred_at")
    named = members.select(*key, "event_id", "series_id").withColumn("series", F.struct(*key, "series_id"))
    bands = series_summary(named.select("event_id", F.col("series").alias("series_id")), events).select(F.col("series_id").alias("series"), near_repeat_band(F.col("dominant_type")).alias("band"))
    bands = materialize(bands, "series-bands")
    m = named.join(at, "event_id").filter("lat is not null and lon is not null and occurred_at is not null")
    inside = materialize(m.select("series", F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), days_since_2000(F.col("occurred_at")).alias("t")), "series-members")
    places = materialize(inside.select("series", "b_lat", "b_lon").distinct(), "series-places")
    p = probes.filter("lat is not null and lon is not null and occurred_at is not null").select(F.col("event_id").alias("a_event_id"), *[F.col(c).alias(f"a_{c}") for c in key], F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), days_since_2000(F.col("occurred_at")).alias("t"))
    p = materialize(p, "series-probes")
    every = [*fixed.NEAR_REPEAT.values(), fixed.NEAR_REPEAT_DEFAULT]
    widest = max(v[0] for v in every)
    same = F.lit(True)
    for c in key:
        same = same & (F.col(f"a_{c}").cast("string") == F.col(f"series.{c}").cast("string"))
    spot = [*[f"a_{c}" for c in key], "a_lat", "a_lon"]
    km = haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    near = lambda x, most: F.greatest(F.lit(0.0), 1 - x / most)

    def prob(in_time: Column) -> Column:
        c = 0.35 * near(F.col("km") * 1000, F.col("band.metres")) + 0.35 * in_time + 0.30 * F.greatest(F.lit(0.0), F.least(F.col("mo"), F.lit(1.0)))
        return F.least(F.lit(0.95), 0.05 * F.col("band.multiplier") * c / 0.5)

    met = rim_join(p.select(*spot).distinct(), places, widest, same).withColumn("km", km).filter(F.col("km") * 1000 <= widest)
    met = met.groupBy(*spot, "series").agg(F.min("km").alias("km"))
    pairs = p.join(met, spot).select("a_event_id", "series", "t", "km")
    known = None if mo is None else mo.select(F.col("event_id").alias("a_event_id"), F.struct(*key, "series_id").alias("series"), F.col("mo").cast("double").alias("mo"))
    if least <= 0.05 * max(v[2] for v in every) * 0.35 / 0.5:
        wanted = p.join(bands.select("series"), same).select("a_event_id", "series")
    else:
        wanted = None if known is None else known.select("a_event_id", "series")
    if wanted is not None:  # pairs beyond the space band: all places of their series
        pairs = materialize(pairs, "series-pairs")
        far = wanted.distinct().join(pairs, ["a_event_id", "series"], "left_anti").join(p, "a_event_id").join(places, "series")
        pairs = pairs.union(far.groupBy("a_event_id", "series", "t").agg(F.min(km).alias("km")))
    pairs = pairs.withColumn("mo", F.lit(0.0)) if known is None else pairs.join(known, ["a_event_id", "series"], "left").withColumn("mo", F.coalesce("mo", F.lit(0.0)))
    pairs = materialize(pairs.join(bands, "series").filter(prob(F.lit(1.0)) >= least), "series-pairs")
    when = _nearest_times(pairs.select("series", "t").distinct(), inside.select("series", "t").distinct())
    g = pairs.join(when, ["series", "t"]).withColumn("p", prob(near(F.col("dt"), F.col("band.days"))))
    return g.select(F.col("a_event_id").alias("event_id"), *[f"series.{c}" for c in key], "series.series_id", "km", "dt", "p").filter(F.col("p") >= least)
