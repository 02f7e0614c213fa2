"""Quality scores, quarantine and weather enrichment of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precinct import fixed
from precinct.functions.geo import usable

THRESHOLD = 0.3


def completeness(df: DataFrame) -> Column:
    has = lambda c: (F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0) if c in df.columns else F.lit(False)
    place = has("location_raw") | has("address_normalised") | has("suburb")
    parts = [F.col("occurred_at").isNotNull(), usable(F.col("lat"), F.col("lon")), has("crime_type"), place]
    return sum((p.cast("int") for p in parts), F.lit(0)) / 4.0


def temporal_precision(ts: Column) -> Column:
    day = F.date_trunc("day", ts)
    return F.when(ts.isNull(), "unknown").when(ts != day, "hour").when(F.dayofmonth(ts) == 1, "month").otherwise("day")


def decimals(x: Column) -> Column:
    """Significant decimals, at most 6."""
    a = F.abs(x)
    return F.length(F.rtrim(F.substring(F.format_string("%.6f", a - F.floor(a)), 3, 6), F.lit("0")))


def spatial_precision(lat: Column, lon: Column) -> Column:
    n = F.least(decimals(lat), decimals(lon))
    return F.when(~usable(lat, lon), "unknown").when(n >= 4, "exact").when(n >= 2, "block").when(n >= 1, "suburb").otherwise("unknown")


def _lookup(c: Column, table: dict, default: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(default))


def score_quality(df: DataFrame, threshold: float = THRESHOLD, reliability: dict[str, float] | None = None) -> DataFrame:
    """df with the four parts, the composite quality_score and quarantined."""
    out = df.withColumns({
        "completeness": completeness(df), "temporal_precision": temporal_precision(F.col("occurred_at")),
        "spatial_precision": spatial_precision(F.col("lat"), F.col("lon")), "reliability": _lookup(F.col("source"), reliability or fixed.RELIABILITY, 0.5),
    })
    t = _lookup(F.col("temporal_precision"), {"hour": 1.0, "day": 0.75, "month": 0.5}, 0.0)
    s = _lookup(F.col("spatial_precision"), {"exact": 1.0, "block": 0.66, "suburb": 0.33}, 0.0)
    q = 0.3 * F.col("completeness") + 0.2 * t + 0.2 * s + 0.3 * F.col("reliability")
    return out.withColumn("quality_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), q))).withColumn("quarantined", F.col("quality_score") < threshold)


def split_quarantine(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    return scored.filter("not quarantined"), scored.filter("quarantined")


def import_summary(scored: DataFrame) -> DataFrame:
    n = F.count("*")
    bad = F.count_if(F.col("quarantined"))
    return scored.agg(n.alias("total"), (n - bad).alias("passing"), bad.alias("quarantined"), F.coalesce(F.try_divide(n - bad, n), F.lit(0.0)).alias("pass_rate"), F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("avg_quality"))


#: Hours tried, in this order, when the exact one is missing.
OFFSETS = (0, -1, 1, -2, 2)


def nearest_weather(events: DataFrame, weather: DataFrame, key: str = "event_id") -> DataFrame:
    """Each event with the weather of its hour or the first of the hours beside it that is known (else nulls)."""
    fields = [c for c in weather.columns if c != "hour_utc"]
    hour = F.date_trunc("hour", F.col("occurred_at"))
    tried = events.select(key, hour.alias("_h")).filter("_h is not null").withColumn("_p", F.explode(F.array(*[F.struct(F.lit(k).alias("prio"), F.lit(o).alias("off")) for k, o in enumerate(OFFSETS)])))
    tried = tried.select(key, F.col("_p.prio").alias("prio"), (F.col("_h") + F.make_interval(hours=F.col("_p.off"))).alias("hour_utc"))
    found = tried.join(weather, "hour_utc").groupBy(key).agg(F.min_by(F.struct("hour_utc", *fields), "prio").alias("w"))
    return events.join(found, key, "left").select("*", F.col("w.hour_utc").alias("weather_hour"), *[F.col(f"w.{f}").alias(f) for f in fields]).drop("w")


def enrich_weather(events: DataFrame, weather: DataFrame, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Adds `weather` (JSON) to events; with a bbox (lat, lat, lon, lon), only if all located events lie in it."""
    out = nearest_weather(events, weather)
    fields = [c for c in weather.columns if c != "hour_utc"]
    made = F.when(F.col("weather_hour").isNotNull(), F.to_json(F.struct(*fields)))
    if bbox:
        located = usable(F.col("lat"), F.col("lon"))
        box = events.filter(located).agg(F.coalesce((F.min("lat") >= bbox[0]) & (F.max("lat") <= bbox[1]) & (F.min("lon") >= bbox[2]) & (F.max("lon") <= bbox[3]), F.lit(False)).alias("_inside"))
        out = out.crossJoin(F.broadcast(box))  # one row
        made = F.when(F.col("_inside"), made)
    return out.withColumn("weather", made).select(*events.columns, "weather")


def zone(df: DataFrame, *columns: str, default: str = "unknown") -> Column:
    """The first of the columns that isn't blank."""
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    return F.coalesce(*[blank(c) for c in columns if c in df.columns], F.lit(default))
