"""Event sources: CSV with guessed headers, police JSON, weather JSON; batch, or as a stream of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from precinct import fixed
from precinct.blocks.shared import hinted
from precinct.sources.records import fields_of, read_records

#: Words that a header holds (lower-cased) if it may stand for a canonical column, in the order of the rules, and
#: a word that rules it out.
HEADERS = {
    "date": (("date", "occurred", "timestamp", "month"), None),
    "id": (("id", "case_number", "case number", "incident"), "date"),
    "location": (("location",), None),
    "crime_type": (("category", "offense", "offence", "type"), "location"),
    "description": (("description", "narrative", "detail", "summary"), None),
    "lat": (("lat", "y_coord"), None),
    "lon": (("lon", "lng", "x_coord"), None),
    "address": (("address", "street", "block"), None),
    "outcome": (("outcome", "resolution", "disposition", "arrest"), None),
}


def detect_columns(headers: list[str]) -> dict[str, str]:
    """Canonical name to header: each header takes the first rule that fits it and is still free."""
    out: dict[str, str] = {}
    for header in headers:
        h = header.lower()
        fits = (name for name, (words, never) in HEADERS.items() if name not in out and any(w in h for w in words) and not (never and never in h))
        if name := next(fits, None):
            out[name] = header
    return out


def parse_date(raw: Column) -> Column:
    """The first format that fits, read as UTC."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(raw), F.lit(f)) for f in fixed.DATE_FORMATS])


def map_rows(df: DataFrame, tag: str = "csv_import", columns: dict[str, str] | None = None) -> DataFrame:
    """Canonical events from raw text columns; rows with neither date nor crime type are dropped."""
    of = columns or detect_columns(df.columns)
    raw = lambda n: F.nullif(F.trim(F.col(f"`{of[n]}`"), F.lit(" \t\n\r\x0b\x0c")), F.lit("")) if n in of else F.lit(None).cast("string")
    number = lambda n, most: F.when(F.abs(raw(n).try_cast("double")) <= most, raw(n).try_cast("double"))
    kept = df.filter(raw("date").isNotNull() | raw("crime_type").isNotNull())
    return kept.select(
        F.concat(F.lit(tag + "_"), F.coalesce(raw("id"), F.uuid())).alias("event_id"), F.lit(tag).alias("source"), F.lit("1.0").alias("source_version"),
        parse_date(raw("date")).alias("occurred_at"), F.lower(raw("crime_type")).alias("crime_type"), raw("location").alias("location_raw"),
        raw("address").alias("address_normalised"), number("lat", 90).alias("lat"), number("lon", 180).alias("lon"), raw("description").alias("narrative"), raw("outcome").alias("outcome"),
    )


#: So many layouts of columns may stand in one folder.
LAYOUTS = 1000


def read_events_csv(spark: SparkSession, path: str, tag: str = "csv_import", limit: int | None = None) -> DataFrame:
    """Events of CSV files, each with a header of its own. Files are split between tasks, also where quoted fields hold line
    breaks (sources/records.py). Of columns with one name the first counts; fields beyond a record's end are missing."""
    records, heads = read_records(spark, path)
    layouts = [r["head"] for r in heads.select("head").distinct().limit(LAYOUTS + 1).collect()]
    if len(layouts) > LAYOUTS:
        raise ValueError(f"more than {LAYOUTS} different headers in {path}")
    if len(layouts) > 1:
        records = records.join(hinted(heads.withColumnRenamed("file", "_file")), F.col("file") == F.col("_file"))
    out = []
    for head in layouts or [""]:
        headers = fields_of(head)
        of = detect_columns(headers)
        mine = records.filter(F.col("head") == head) if len(layouts) > 1 else records
        raw = mine.select(*[F.get("fields", F.lit(headers.index(h))).alias(name) for name, h in of.items()])
        out.append(map_rows(raw, tag, {name: name for name in of}))
    every = reduce(DataFrame.union, out)
    return every.limit(limit) if limit else every


POLICE_SCHEMA = "id string, month string, category string, context string, location struct<latitude:string,longitude:string,street:struct<name:string>>, outcome_status struct<category:string>"


def police_events(raw: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for kv in fixed.POLICE_CATEGORIES.items() for x in kv])
    return raw.select(
        F.concat(F.lit("uk_"), "id").alias("event_id"), F.lit("uk_police_v1").alias("source"), F.try_to_timestamp(F.concat("month", F.lit("-01")), F.lit("yyyy-MM-dd")).alias("occurred_at"),
        F.coalesce(F.element_at(kinds, F.col("category")), F.col("category")).alias("crime_type"), F.col("location.latitude").try_cast("double").alias("lat"), F.col("location.longitude").try_cast("double").alias("lon"),
        F.nullif(F.col("location.street.name"), F.lit("")).alias("location_raw"), F.col("outcome_status.category").alias("outcome"), F.nullif(F.col("context"), F.lit("")).alias("narrative"),
    )


def read_police_json(spark: SparkSession, path: str) -> DataFrame:
    return police_events(spark.read.schema(POLICE_SCHEMA).json(path, multiLine=True))


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k,) for k in sorted(fixed.POLICE_CATEGORIES)], "category string")


_HOURLY = ("time:array<string>", "temperature_2m:array<double>", "precipitation:array<double>", "windspeed_10m:array<double>", "visibility:array<double>", "is_day:array<int>", "weathercode:array<int>")
WEATHER_SCHEMA = f"utc_offset_seconds int, hourly struct<{','.join(_HOURLY)}>"


def discomfort(t: Column) -> Column:
    return F.when(t < 10, 0.1).when(t < 20, 0.3 + 0.02 * (t - 10)).when(t < 30, 0.5 + 0.03 * (t - 20)).when(t < 40, 0.8 + 0.02 * (t - 30)).otherwise(1.0)


def weather_flags(df: DataFrame) -> DataFrame:
    made = {"discomfort": discomfort(F.col("temperature")), "is_raining": F.col("precipitation") > 0.1}
    made |= {"low_visibility": F.col("visibility") < 1000} if "visibility" in df.columns else {}
    made |= {"extreme_wind": F.col("wind_speed") > 80} if "wind_speed" in df.columns else {}
    return df.withColumns(made)


def weather_hours(raw: DataFrame) -> DataFrame:
    """A row an hour; a later entry for an hour replaces an earlier one; missing tails take defaults."""
    arrays = [F.coalesce(F.col(f"hourly.{c}"), F.array().cast(kind)).alias(c) for c, kind in (f.split(":") for f in _HOURLY)]
    z = raw.select("utc_offset_seconds", F.posexplode(F.arrays_zip(*arrays)).alias("pos", "h"))
    local = F.coalesce(F.try_to_timestamp("h.time", F.lit("yyyy-MM-dd'T'HH:mm")), F.try_to_timestamp("h.time", F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    utc = F.timestamp_seconds(F.unix_timestamp(local) - F.coalesce("utc_offset_seconds", F.lit(0)))
    v = lambda c, d: F.coalesce(f"h.{c}", F.lit(d))
    row = F.struct(v("temperature_2m", 0.0).alias("temperature"), v("precipitation", 0.0).alias("precipitation"), v("windspeed_10m", 0.0).alias("wind_speed"), v("visibility", 10000.0).alias("visibility"), (v("is_day", 1) != 0).alias("is_day"), v("weathercode", 0).alias("weather_code"))
    hours = z.filter(local.isNotNull()).groupBy(F.date_trunc("hour", utc).alias("hour_utc")).agg(F.max_by(row, "pos").alias("r"))
    return weather_flags(hours.select("hour_utc", "r.*"))


def read_weather_json(spark: SparkSession, path: str) -> DataFrame:
    return weather_hours(spark.read.schema(WEATHER_SCHEMA).json(path, multiLine=True))
