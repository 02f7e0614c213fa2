"""Exports and the provenance trail. Writers are Spark's own; these give the rows to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def events_csv(events: DataFrame) -> DataFrame:
    number = lambda c, f: F.format_string(f, F.coalesce(F.col(c), F.lit(0.0)))
    return events.select(
        "event_id", F.coalesce("crime_type", F.lit("")).alias("crime_type"), F.coalesce("suburb", F.lit("")).alias("suburb"), number("lat", "%.6f").alias("lat"), number("lon", "%.6f").alias("lon"),
        F.coalesce(F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")).alias("occurred_at"), F.coalesce("outcome", F.lit("")).alias("outcome"), number("quality_score", "%.3f").alias("quality_score"),
    )


def events_table_csv(events: DataFrame) -> DataFrame:
    """The layout of the events table, with nine columns."""
    text = lambda c, name: F.coalesce(F.col(c), F.lit("")).alias(name)
    number = lambda c: F.format_string("%.6f", F.coalesce(F.col(c), F.lit(0.0))).alias(c)
    return events.select("event_id", _iso("occurred_at").alias("occurred_at"), text("crime_type", "crime_type"), text("location_raw", "location"), text("suburb", "suburb"), number("lat"), number("lon"), text("outcome", "outcome"), text("source", "source"))


def _iso(c: str) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def _number(c: str, digits: int = 6) -> Column:
    """A JSON number with so many decimals."""
    return F.coalesce(F.col(c), F.lit(0.0)).cast(f"decimal(20,{digits})")


def events_json(events: DataFrame) -> DataFrame:
    """One JSON object a row, always with its eight keys: missing coordinates are 0, missing texts empty."""
    text = lambda c, name: F.coalesce(F.col(c), F.lit("")).alias(name)
    fields = [F.col("event_id").alias("id"), text("crime_type", "type"), text("suburb", "suburb"), _number("lat").alias("lat"), _number("lon").alias("lon"), _iso("occurred_at").alias("occurredAt"), text("outcome", "outcome"), _number("quality_score", 3).alias("quality")]
    return events.select("event_id", F.to_json(F.struct(*fields)).alias("value"))


def events_since_json(events: DataFrame, since: str) -> DataFrame:
    """events_json of the events since a time, each row with their count."""
    found = events.filter(F.col("occurred_at") >= F.lit(since).cast("timestamp"))
    return events_json(found).crossJoin(F.broadcast(found.agg(F.count("*").alias("count"))))  # one row


def leads_json(leads: DataFrame) -> DataFrame:
    """One JSON object a lead, with its contradictions."""
    fields = ["rank", "category", "headline", F.coalesce("detail", F.lit("")).alias("detail"), _number("confidence", 4).alias("confidence"), F.col("messages").alias("contradictions")]
    return leads.select("event_id", "rank", F.to_json(F.struct(*fields)).alias("value"))


def leads_csv(leads: DataFrame) -> DataFrame:
    return leads.select("event_id", "rank", "category", "headline", F.format_string("%.4f", "confidence").alias("confidence"))


def forecast_json(days: DataFrame) -> DataFrame:
    """One object a zone with its days in order."""
    d = F.struct(F.date_format("day", "yyyy-MM-dd").alias("date"), F.round("risk", 4).cast("decimal(20,4)").alias("risk"), F.round("expected", 3).cast("decimal(20,3)").alias("expected"))
    return days.groupBy("zone").agg(F.array_sort(F.collect_list(d)).alias("days")).select("zone", F.to_json(F.struct("zone", "days")).alias("value"))


def _rows(by: str, line: Column, *order: Column) -> Column:
    """The lines of a group in order, one below the other."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("text")))), lambda x: x["text"]), "\n").alias(by)


#: Operators whose work a lead of each category rests on.
ORIGIN = {"series": "SeriesDetector", "mo": "MOAnalyser", "geographic": "GeographicProfiler", "anomaly": "AnomalyDetector", "network": "NetworkAnalyser"}


def case_report(leads: DataFrame, events: DataFrame | None = None, series: DataFrame | None = None) -> DataFrame:
    """One Markdown document a case (event_id) from its ranked leads, with the tables of its events and of its series where given.

    events: event_id (of the case), id, occurred_at, crime_type, suburb. series: event_id, series_id, size."""
    origin = F.element_at(F.create_map(*[F.lit(x) for kv in ORIGIN.items() for x in kv]), F.col("category"))
    detail = F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.col("detail"), F.lit("\n\n"))).otherwise("")
    lead = F.concat(F.format_string("### #%d: %s\n\n**%s**\n\n**Confidence:** %d%%\n\n", "rank", "category", "headline", F.round(F.col("confidence") * 100).cast("int")), detail, F.lit("*Provenance: "), origin, F.lit("*\n"))
    strong = F.count_if(F.col("confidence") >= 0.7)
    body = leads.groupBy("event_id").agg(F.count("*").alias("n"), strong.alias("strong"), _rows("body", lead, F.col("rank")))
    text = [F.format_string("# Case %s\n\n**Total leads:** %d (%d with high confidence)\n\n", "event_id", "n", "strong"), F.col("body")]
    if events is not None:
        line = F.format_string("| %s | %s | %s | %s |", "id", F.coalesce(F.date_format("occurred_at", "yyyy-MM-dd HH:mm"), F.lit("")), F.coalesce("crime_type", F.lit("")), F.coalesce("suburb", F.lit("")))
        body = body.join(events.groupBy("event_id").agg(_rows("events", line, F.col("occurred_at"), F.col("id"))), "event_id", "left")
        text.append(F.coalesce(F.concat(F.lit("\n## Events\n\n| id | time | type | area |\n| --- | --- | --- | --- |\n"), F.col("events"), F.lit("\n")), F.lit("")))
    if series is not None:
        line = F.format_string("| %s | %d |", "series_id", "size")
        body = body.join(series.groupBy("event_id").agg(_rows("series", line, F.col("series_id"))), "event_id", "left")
        text.append(F.coalesce(F.concat(F.lit("\n## Series\n\n| series | events |\n| --- | --- |\n"), F.col("series"), F.lit("\n")), F.lit("")))
    return body.select("event_id", F.concat(*text).alias("report"))


def bias_text(pairs: DataFrame) -> DataFrame:
    """A line a comparison. pairs: group_a, group_b, ratio, flagged."""
    state = F.when(F.col("flagged"), "FLAGGED").otherwise("OK")
    return pairs.select("group_a", "group_b", F.format_string("[%s] %s vs %s: ratio %.4f", state, "group_a", "group_b", "ratio").alias("value"))


PROVENANCE = ["ts", "event_id", "stage", "source", "model", "action", "detail"]


def provenance_hash(columns: list[str] = PROVENANCE) -> Column:
    """First 16 hex digits of the SHA-256 of the entry's JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 16)


def record(df: DataFrame, stage: str, action: str, detail: str, source: str = "", model: str = "") -> DataFrame:
    """An entry for each row of df (event_id), to be appended to the trail."""
    made = {"ts": F.current_timestamp(), "stage": F.lit(stage), "source": F.lit(source), "model": F.lit(model), "action": F.lit(action), "detail": F.lit(detail)}
    return df.select("event_id").distinct().withColumns(made).withColumn("hash", provenance_hash()).select(*PROVENANCE, "hash")


def entries(trail: DataFrame, stage: str | None = None, model: str | None = None, source: str | None = None, start=None, end=None, text: str | None = None, recent: int | None = None) -> DataFrame:
    """Entries newest first, by any of the filters; the time range is inclusive; text is sought in event or stage."""
    for c, v in (("stage", stage), ("model", model), ("source", source)):
        if v is not None:
            trail = trail.filter(F.col(c) == v)
    if start is not None:
        trail = trail.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        trail = trail.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    if text:
        trail = trail.filter(F.contains(F.lower("event_id"), F.lit(text.lower())) | F.contains(F.lower("stage"), F.lit(text.lower())))
    return trail.orderBy(F.desc("ts"), F.desc("event_id")).limit(recent) if recent else trail


def chain(trail: DataFrame, event_id: str) -> DataFrame:
    """An event's entries, oldest first."""
    return trail.filter(F.col("event_id") == event_id).orderBy("ts")


def entries_json(trail: DataFrame) -> DataFrame:
    """Empty keys are left out."""
    blank = [F.when(F.col(c).cast("string") != "", F.col(c)).alias(c) for c in trail.columns]
    return trail.select(F.to_json(F.struct(*blank), {"ignoreNullFields": "true"}).alias("value"))


def entries_csv(trail: DataFrame) -> DataFrame:
    """timestamp, eventId, stage, source, model, action, detail, dataHash as one CSV line a row, quoted where needed."""
    quoted = lambda c: F.when(c.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    cells = [_iso("ts"), *[quoted(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("event_id", "stage", "source", "model", "action", "detail", "hash")]]
    return trail.select("event_id", "ts", F.concat_ws(",", *cells).alias("value"))


def chain_text(trail: DataFrame) -> DataFrame:
    """event_id and its steps in the order of time: "stage (model) -> stage (model)"."""
    step = F.concat(F.col("stage"), F.when(F.coalesce("model", F.lit("")) != "", F.concat(F.lit(" ("), F.col("model"), F.lit(")"))).otherwise(""))
    steps = F.transform(F.array_sort(F.collect_list(F.struct("ts", step.alias("s")))), lambda x: x["s"])
    return trail.groupBy("event_id").agg(F.array_join(steps, " -> ").alias("value"))
