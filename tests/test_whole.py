"""Queries take all rows and whole texts."""

import os

from pyspark.sql import functions as F

from precinct import registry
from precinct.functions import text
from precinct.operators import network

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_mo_of_a_long_text(spark):
    df = spark.createDataFrame([("plain words " * 500 + "with a knife",)], "t string")
    got = df.select(text.mo_features(F.col("t"))["weapon_type"], text.mo_features(F.col("t"), 4096)["weapon_type"]).first()
    assert got[0] is not None and got[1] is None


def test_all_orders_and_events(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    run = lambda name: registry.QUERIES[name](spark, SF)
    orders, rows = read("lineitem").select("l_orderkey").distinct().count(), read("lineitem").count()
    assert run("a22_case_posterior").count() == orders and run("a21_running_posterior").count() == rows
    a = read("lineitem").select("l_orderkey", F.col("l_partkey").alias("a")).distinct()
    pairs = a.join(a.withColumnRenamed("a", "b"), "l_orderkey").filter("a < b").select("a", "b").distinct().count()
    assert run("j08_edges").count() == pairs
    assert run("a31_degrees").count() == read("lineitem").select("l_partkey").distinct().count()
    assert run("w09_lead_summary").count() == read("events").count()


def test_betweenness_from_all_people_in_blocks(spark, monkeypatch):
    """A path a-b-c-d-e, a block for every few sources, and the registered leads' own input."""
    e = spark.createDataFrame([(a, b, 1.0) for a, b in zip("abcd", "bcde")], "src string, dst string, weight double")
    who = spark.createDataFrame([(p,) for p in "abcde"], "person_id string")
    monkeypatch.setattr(network, "BLOCK_PAIRS", 10)
    monkeypatch.setattr(network, "BROADCAST_ARCS", 0)
    got = {r["person_id"]: round(r["betweenness"], 9) for r in network.betweenness(e, who).collect()}
    assert got == {"a": 0, "b": 0.5, "c": round(8 / 12, 9), "d": 0.5, "e": 0}
    from precinct.plans import network as plans

    w = spark.createDataFrame([("a", "i", 1.0), ("b", "i", 1.0), ("b", "j", 1.0), ("c", "j", 1.0), ("c", "k", 1.0), ("d", "k", 1.0)], "person_id string, incident_id string, w double")
    monkeypatch.setattr(plans, "weights", lambda *_: w)
    seen = {r["person_id"]: r["betweenness"] for r in registry.QUERIES["a29_betweenness"](spark, SF).collect()}
    assert seen == {"a": 0, "b": 0.666666667, "c": 0.666666667, "d": 0}
    kept = []
    monkeypatch.setattr(network, "network_leads", lambda w, nodes, e: kept.append(nodes) or nodes)
    registry.QUERIES["a33_network_leads"](spark, SF)
    assert {r["person_id"]: round(r["betweenness"], 9) for r in kept[0].collect()} == seen
