"""Domain inputs built from the given tables, as expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from precinct.blocks.shared import honest_sizes

NARRATIVES = [
    "Offender smashed a rear window of the house at night and took jewellery and cash alone",
    "Two men robbed a woman near the shop and demanded her phone and wallet with a knife",
    "Vehicle break-in reported at 14:30, window broken and laptop stolen",
    "Several youths fighting and drunk, a disturbance in the public square",
    "Suspect posed as staff to gain entry to the office and took keys and documents",
    "Cocaine and cannabis dealing reported near the flat, suspect arrested",
    "Graffiti and damage to premises, fire destroyed the store",
    "Victim beaten and stabbed, suspect wore gloves and a mask, dead at the scene",
    "Scam by phishing email, fake identity used, impersonation of a bank",
    "Noise nuisance and abusive harassment, resolved peacefully, area safe and clear",
    "Armed gang with a gun threatened to kill the owner, attack on elderly man",
    "",
]
_SOURCES = {0: "uk_police_v1", 1: "csv_import", 2: "sfpd", 3: "other"}
_CASES = lambda key, values: f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in values.items()) + " END"

CRIME_EVENT_COLUMNS = {
    "event_id": "concat('ev_', CAST(event_id AS STRING))",
    "seq": "event_id",
    "source": _CASES("event_id % 4", _SOURCES),
    "occurred_at": "CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 25 = 0 THEN CAST(date_trunc('month', ts) AS TIMESTAMP) WHEN event_id % 10 = 0 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) ELSE CAST(ts AS TIMESTAMP) END",
    "crime_type": "CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_type = 'click' THEN 'theft' WHEN event_type = 'view' THEN 'antisocial' WHEN event_type = 'signup' THEN 'fraud' WHEN event_type = 'purchase' THEN 'burglary' ELSE 'assault' END",
    "lat": "CASE WHEN event_id % 83 = 0 THEN NULL ELSE CAST(51.3 AS DOUBLE) + CAST(user_id * 7919 % 401 AS DOUBLE) / 1000 + CAST(event_id % 20 AS DOUBLE) / 20000 END",
    "lon": "CASE WHEN event_id % 83 = 0 THEN NULL ELSE CAST(-0.5 AS DOUBLE) + CAST(user_id * 104729 % 797 AS DOUBLE) / 1000 + CAST(event_id * 7 % 20 AS DOUBLE) / 20000 END",
    "suburb": "concat('Z', CAST(user_id % 12 AS STRING))",
    "outcome": "CASE WHEN event_id % 2 = 0 THEN 'resolved' ELSE 'unresolved' END",
    "location_raw": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('Street ', CAST(user_id % 50 AS STRING)) END",
    "narrative": _CASES("event_id % 12", dict(enumerate(NARRATIVES))),
    "meta": "CASE WHEN event_id % 3 = 0 THEN concat('{\"person_id\":\"p', CAST(user_id AS STRING), '\",\"role\":\"suspect\",\"caseId\":\"c', CAST(event_id % 40 AS STRING), '\"}') WHEN event_id % 3 = 1 THEN concat('{\"offender_id\":\" p', CAST(user_id AS STRING), ' \",\"caseId\":\"c', CAST(event_id % 40 AS STRING), '\"}') ELSE NULL END",
    "value": "value",
}


def _select(columns: dict[str, str], table: str, where: str = "") -> str:
    made = ", ".join(f"{e} AS {c}" for c, e in columns.items()).replace("AS STRING", "AS VARCHAR")
    return f"SELECT {made} FROM {table} {where}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return honest_sizes(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def crime_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {c}" for c, e in CRIME_EVENT_COLUMNS.items()])


PREDICTION_COLUMNS = {
    "id": "l_orderkey * 10 + l_linenumber",
    "y": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
    "pred": "CAST((l_orderkey * 31 + l_linenumber * 17) % 1000 AS DOUBLE) / 1000",
    "grp": "concat('S', CAST(l_suppkey % 5 AS STRING))",
}


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in PREDICTION_COLUMNS.items()])


PERSON_COLUMNS = {
    "person_id": "concat('p', CAST(l_partkey AS STRING))",
    "incident_id": "concat('o', CAST(l_orderkey AS STRING))",
    "role": "CASE WHEN l_linenumber = 1 THEN 'suspect' ELSE 'associate' END",
    "seq": "l_linenumber",
}


def person_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in PERSON_COLUMNS.items()])


#: DuckDB's side of the same inputs.
CE = f"ce AS ({_select(CRIME_EVENT_COLUMNS, 'events')})"
PRED = f"pr AS ({_select(PREDICTION_COLUMNS, 'lineitem')})"
PEOPLE = f"pi AS ({_select(PERSON_COLUMNS, 'lineitem')})"
