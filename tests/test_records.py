"""CSV records with line breaks: equal however many tasks read them."""

import random

import pytest

from precinct.sources import events as sources
from precinct.sources.records import fields_of, read_records


def plain_records(text):
    """Line by line, as one reader would."""
    lines = text.removeprefix("﻿").split("\n")
    lines = [x.removesuffix("\r") for x in (lines[:-1] if lines[-1] == "" else lines)]
    out, now = [], None
    for line in lines[1:]:
        if now is None and not line.strip():
            continue
        now = line if now is None else now + "\n" + line
        if now.count('"') % 2 == 0:
            out.append(fields_of(now))
            now = None
    return out + ([fields_of(now)] if now is not None else [])


def test_fields():
    assert fields_of('a, b ,"c, d"," e "') == ["a", "b", "c, d", " e "]
    assert fields_of('"say ""hi""",""""," ""') == ['say "hi"', '"', ' "']
    assert fields_of('x"y,z"w , ,') == ["xy,zw ", "", ""]
    assert fields_of("") == [""] and fields_of('""') == [""] and fields_of('"",a') == ["", "a"]


def some_file(g, rows):
    out = []
    for k in range(rows):
        told = "".join(g.choice(['"', ",", "\n", "\r\n", "\n\n\n", "word", " é ", "x" * 40]) for _ in range(g.choice([0, 3, 9, 60])))
        out.append(f'{k},2024-01-02,theft,"' + told.replace('"', '""') + f'",51.5,"-0.{k}"')
        if g.random() < 0.1:
            out.append("  ")
    return "﻿id,date,crime_type,narrative,lat,lon\r\n" + g.choice(["\n", "\r\n"]).join(out)


@pytest.mark.parametrize("split", [97, 1000, 10**8])
def test_records_in_any_number_of_tasks(spark, tmp_path, split):
    g = random.Random(split)
    texts = [some_file(g, 120), some_file(g, 1) + "\n", some_file(g, 40) + '\n99,2024-01-02,fraud,"never\nclosed', "id,date\n", ""]
    for k, t in enumerate(texts):
        (tmp_path / f"f{k}.csv").write_text(t, encoding="utf-8", newline="")
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        records, heads = read_records(spark, str(tmp_path))
        got = sorted((r["file"].rsplit("/", 1)[1], r["fields"]) for r in records.collect())
        assert got == sorted((f"f{k}.csv", x) for k, t in enumerate(texts) for x in plain_records(t))
        assert {r["head"] for r in heads.collect()} == {"id,date,crime_type,narrative,lat,lon", "id,date"}
        events = {r["event_id"]: r for r in sources.read_events_csv(spark, str(tmp_path / "f0.csv")).collect()}
        assert len(events) == 120 and events["csv_import_7"]["lat"] == 51.5
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_break_in_a_narrative(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ID,Date,Type,Narrative,Lat,Lon\n1,2024-01-02,theft,"line one\nline two, more",51.5,-0.1\n')
    row = sources.read_events_csv(spark, str(tmp_path / "a.csv")).collect()
    assert len(row) == 1 and row[0]["narrative"] == "line one\nline two, more" and row[0]["lat"] == 51.5


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert sources.read_events_csv(spark, str(tmp_path / "empty.csv")).count() == 0
