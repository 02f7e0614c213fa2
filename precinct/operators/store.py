"""Relational queries over the event table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def newest() -> list[Column]:
    return [F.desc_nulls_last("occurred_at"), F.asc("event_id")]


def scan_events(events: DataFrame, crime_type: str | None = None, start: str | None = None, end: str | None = None, bbox: tuple | None = None, min_quality: float = -1.0, limit: int | None = None) -> DataFrame:
    """Filtered scan, newest first. Only predicates that filter are added; limit is a top-k if given."""
    out = events
    if crime_type:
        out = out.filter(F.lower("crime_type") == crime_type.lower())
    if start:
        out = out.filter(F.col("occurred_at") >= F.lit(start).cast("timestamp"))
    if end:
        out = out.filter(F.col("occurred_at") <= F.lit(end).cast("timestamp"))
    if bbox and bbox != (-90, 90, -180, 180):
        out = out.filter(F.col("lat").between(*bbox[:2]) & F.col("lon").between(*bbox[2:]))
    if min_quality >= 0:
        out = out.filter(F.col("quality_score") >= min_quality)
    return out.orderBy(*newest()).limit(limit) if limit else out


def search_events(events: DataFrame, keyword: str = "", crime_type: str | None = None, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """Keyword scan with SQL wildcards over four fields; `end` is a whole day."""
    out = scan_events(events, crime_type, start)
    if end:
        out = out.filter(F.col("occurred_at") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    if keyword:
        out = out.filter(reduce(Column.__or__, [F.coalesce(F.col(c).ilike(f"%{keyword}%"), F.lit(False)) for c in ("event_id", "crime_type", "location_raw", "narrative") if c in events.columns]))
    return out.orderBy(*newest()).limit(limit) if limit else out


SEARCHED = ("event_id", "crime_type", "location_raw", "address_normalised", "location_description", "suburb", "narrative")


def contains_search(events: DataFrame, keyword: str) -> DataFrame:
    """Literal substring, case-insensitive, in any of the searched fields."""
    return events.filter(reduce(Column.__or__, [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(keyword.lower())), F.lit(False)) for c in SEARCHED if c in events.columns]))


def upsert(base: DataFrame, delta: DataFrame, key: str = "event_id", seq: str = "seq") -> DataFrame:
    """base with delta's rows in place of those with the same key; of delta's own repeats the last by seq wins."""
    last = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc(seq))
    both = base.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn", "_new")


def delete(events: DataFrame, ids: DataFrame, key: str = "event_id") -> DataFrame:
    return events.join(ids.select(key), key, "left_anti")


def type_counts(events: DataFrame) -> DataFrame:
    return events.filter("crime_type is not null").groupBy("crime_type").agg(F.count("*").alias("n"))


def type_shares(events: DataFrame) -> DataFrame:
    """Counts with their share of the total in per cent, and whether a type is the top one (ties: the alphabet)."""
    counts = type_counts(events)
    every = Window.partitionBy()  # over a row a type
    top = F.min(F.struct(-F.col("n"), F.col("crime_type"))).over(every)["crime_type"]
    return counts.select("crime_type", "n", (100.0 * F.col("n") / F.sum("n").over(every)).alias("pct"), (F.col("crime_type") == top).alias("is_top"))


def counts_by(events: DataFrame, unit: str) -> DataFrame:
    """Counts by truncated time: hour or day."""
    return events.filter("occurred_at is not null").groupBy(F.date_trunc(unit, "occurred_at").alias(unit)).agg(F.count("*").alias("n"))


def hour_histogram(events: DataFrame) -> DataFrame:
    """All 24 hours, with zeros, and whether the hour is the (first) peak."""
    hours = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    counts = events.filter("occurred_at is not null").groupBy(F.hour("occurred_at").alias("hour")).agg(F.count("*").alias("n"))
    dense = hours.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))
    peak = F.min(F.struct(-F.col("n"), F.col("hour"))).over(Window.partitionBy())["hour"]
    return dense.withColumn("is_peak", F.col("hour") == peak)


def heatmap(events: DataFrame) -> DataFrame:
    """Day of week by hour, with the marginals by hour, by day and by month, in one pass."""
    t = events.filter("occurred_at is not null").select(F.weekday("occurred_at").alias("dow"), F.hour("occurred_at").alias("hour"), F.month("occurred_at").alias("month"))
    g = t.groupingSets([["dow", "hour"], ["hour"], ["dow"], ["month"]], "dow", "hour", "month").agg(F.grouping_id("dow", "hour", "month").alias("gid"), F.count("*").alias("n"))
    kind = F.when(F.col("gid") == 1, "cell").when(F.col("gid") == 5, "hour").when(F.col("gid") == 3, "dow").otherwise("month")
    return g.select(kind.alias("kind"), "dow", "hour", "month", "n")


def upgrade(df: DataFrame) -> DataFrame:
    """Columns that older tables lack, with their defaults."""
    for name, value in (("quality_score", F.lit(1.0)), ("narrative_tags", F.lit(""))):
        if name not in df.columns:
            df = df.withColumn(name, value)
    return df


def case_events(events: DataFrame, case_id: str, recent: int = 2000, blank_recent: int = 100) -> DataFrame:
    """Events that a keyword search finds, or recent ones whose id or meta.caseId holds the case id."""
    if not case_id.strip():
        return events.orderBy(*newest()).limit(blank_recent)
    key = F.lit(case_id.lower())
    last = events.orderBy(*newest()).limit(recent)
    mine = F.contains(F.lower("event_id"), key) | F.coalesce(F.contains(F.lower(F.get_json_object("meta", "$.caseId")), key), F.lit(False))
    return search_events(events, case_id).unionByName(last.filter(mine)).dropDuplicates(["event_id"])


def leads_of_case(leads: DataFrame, case: DataFrame) -> DataFrame:
    """Leads with a related event in the case; those without any unless their supporting event is another's."""
    ids = case.select(F.col("event_id").alias("_e")).distinct()
    related = leads.select("lead_id", F.explode("related_event_ids").alias("_e")).join(ids, "_e", "left_semi").select("lead_id").distinct()
    none = leads.filter(F.size(F.coalesce("related_event_ids", F.array().cast("array<string>"))) == 0)
    support = F.get_json_object("supporting_data", "$.eventId")
    kept = none.withColumn("_s", support).join(ids, F.col("_s") == F.col("_e"), "left").filter("_s is null or _e is not null").select("lead_id")
    return leads.join(related.union(kept).distinct(), "lead_id", "left_semi")


def import_profile(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("total"), F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("with_coords"), F.count("occurred_at").alias("with_date"),
        F.count("crime_type").alias("with_type"), F.count_distinct("crime_type").alias("types"), F.count_if(F.col("quarantined")).alias("quarantined"),
        F.avg(F.when(F.col("quarantined"), 0.0).otherwise(1.0)).alias("pass_rate"), F.avg("quality_score").alias("mean_quality"),
    )


def top_n(df: DataFrame, by: str, n: int, key: str) -> DataFrame:
    return df.orderBy(F.desc(by), key).limit(n)
