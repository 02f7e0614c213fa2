"""Streams give what the same operators give in batch."""

import pytest
from pyspark.sql import functions as F

from precinct.operators import rates, series
from precinct.plans.fixtures import crime_events
from precinct.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Events in time order, in three files, and one far later row that lets windows close."""
    path = str(tmp_path_factory.mktemp("landed"))
    e = crime_events(spark, SF).filter("occurred_at is not null").withColumn("zone", F.col("suburb"))
    e.orderBy("occurred_at", "seq").coalesce(1).write.mode("append").parquet(path)
    last = e.limit(1).withColumns({"occurred_at": F.lit("2030-01-01").cast("timestamp"), "event_id": F.lit("ev_last"), "lat": F.lit(None).cast("double")})
    last.coalesce(1).write.mode("append").parquet(path)
    return e, path


def rows(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_hourly_counts(spark, landed):
    e, path = landed
    got = streams.run_once(streams.hourly_counts(streams.read_stream(spark, path, e.schema)), "hourly").filter("hour < '2029-01-01'")
    want = e.groupBy(F.date_trunc("hour", "occurred_at").alias("hour"), "zone", "crime_type").agg(F.count("*").alias("n"))
    cols = ["hour", "zone", "crime_type", "n"]
    assert rows(got, cols) == rows(want, cols)


def test_dedup_and_score(spark, landed, tmp_path):
    e, path = landed
    for _ in range(2):  # every event twice, also inside a batch
        spark.read.parquet(path).coalesce(1).write.mode("append").parquet(f"{tmp_path}/twice")
    got = streams.run_once(streams.deduplicated(streams.read_stream(spark, f"{tmp_path}/twice", e.schema, files_per_batch=2)), "dedup")
    assert rows(got, ["event_id"]) == rows(spark.read.parquet(path), ["event_id"])
    model = rates.fit_poisson(e)
    scored = streams.run_once(streams.score_stream(streams.read_stream(spark, path, e.schema), model), "scored")
    want = rates.bucketed(spark.read.parquet(path)).join(model.select(*rates.BUCKET, "rate"), rates.BUCKET, "left").fillna(rates.PRIOR_RATE, ["rate"])
    assert rows(scored, ["event_id", "rate"]) == rows(want, ["event_id", "rate"]) and want.filter(F.col("rate") == rates.PRIOR_RATE).count()


def test_idle_zones_leave_the_state(spark, landed, tmp_path):
    e, path = landed
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = streams.run_batches(streams.live_escalation(streams.read_stream(spark, path, e.schema)), f"{tmp_path}/out", f"{tmp_path}/c")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(sizes) > 20 and sizes[-1] <= 4  # the far later row's zone alone: its count and its timer


def test_split(spark, landed, tmp_path):
    e, path = landed
    q = streams.write_split(streams.scored(streams.read_stream(spark, path, e.schema), 0.7), f"{tmp_path}/e", f"{tmp_path}/q", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    total = spark.read.parquet(f"{tmp_path}/e").count() + spark.read.parquet(f"{tmp_path}/q").count()
    assert total == e.count() + 1


def test_near_repeat_alerts(spark, landed):
    """The stream's pairs are the batch operator's."""
    e, path = landed
    got = streams.run_once(streams.near_repeat_alerts(streams.read_stream(spark, path, e.schema, files_per_batch=10)), "near")
    assert rows(got, ["event_id", "prior_id"]) == rows(series.near_repeats(e), ["event_id", "prior_id"])


def test_sliding_counts(spark, landed):
    e, path = landed
    got = streams.run_once(streams.fortnight_counts(streams.read_stream(spark, path, e.schema)), "sliding").filter("start < '2029-01-01'")
    want = e.groupBy(F.window("occurred_at", "14 days", "1 day").alias("w"), "zone").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "zone", "n")
    assert rows(got, ["start", "zone", "n"]) == rows(want, ["start", "zone", "n"])


def test_sessions(spark, landed):
    e, path = landed
    got = streams.run_once(streams.burst_sessions(streams.read_stream(spark, path, e.schema)), "sessions").filter("start < '2029-01-01'")
    want = e.groupBy(F.session_window("occurred_at", "6 hours").alias("w"), "zone").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "zone", "n")
    assert rows(got, ["start", "end", "zone", "n"]) == rows(want, ["start", "end", "zone", "n"])


def test_live_escalation_equals_batch(spark, tmp_path):
    """After every batch the factor of a zone's last day is the batch operator's, older days than a fortnight being forgotten."""
    days = {"A": [1, 1, 2, 10, 28], "B": [5, 6, 6, 7], "C": [1]}
    e = spark.createDataFrame([(z, d) for z, ds in days.items() for d in ds], "zone string, d int").select("zone", F.make_date(F.lit(2024), F.lit(1), "d").cast("timestamp").alias("occurred_at"))
    for part in (e.filter("day(occurred_at) < 6"), e.filter("day(occurred_at) >= 6")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = streams.run_once(streams.live_escalation(streams.read_stream(spark, f"{tmp_path}/in", e.schema, files_per_batch=10)), "live", "update")
    last = e.groupBy("zone").agg(F.to_date(F.max("occurred_at")).alias("day"))
    want = {r["zone"]: round(r["escalation"], 9) for z in days for r in rates.escalation(e.filter(F.col("zone") == z), last.filter(F.col("zone") == z)).collect()}
    assert {r["zone"]: round(r["escalation"], 9) for r in got.collect()} == want


def test_ingest_from_files(spark, tmp_path):
    """CSV rows as they arrive are mapped, scored and split as in batch."""
    lines = ["id,date,type,lat,lon", "1,2024-01-03 10:00:00,Theft,51.5123,-0.1234", "2,,Fraud,,", "3,,,1,1"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join(lines) + "\n")
    stream = streams.read_csv_stream(spark, f"{tmp_path}/in", lines[0].split(","))
    q = streams.write_split(streams.scored(stream, 0.5), f"{tmp_path}/e", f"{tmp_path}/q", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["event_id"] for r in spark.read.parquet(f"{tmp_path}/e").collect()] == ["csv_import_1"]
    assert [r["event_id"] for r in spark.read.parquet(f"{tmp_path}/q").collect()] == ["csv_import_2"]
