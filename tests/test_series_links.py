"""Links of events to series against all pairs: the nearest place and the nearest time of a series may be those of two members."""

import math
import random

import pytest
from pyspark.sql import functions as F

from precinct import fixed
from precinct.operators import series

EVENT = "event_id string, seq long, crime_type string, lat double, lon double, d double"


def metres(a, b):
    (y, x), (v, z) = ((math.radians(r[3]), math.radians(r[4])) for r in (a, b))
    h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((z - x) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h)) * 1000


def linked(probes, members, mo, least):
    """(event, series): (metres, days, p) by all pairs."""
    out = {}
    for a in probes:
        for s, group in members.items():
            kinds = [b[2] for b in group]
            kind = min(set(kinds), key=lambda k: (-kinds.count(k), k))
            m, d, times = fixed.NEAR_REPEAT.get(kind, fixed.NEAR_REPEAT_DEFAULT)
            far, days = min(metres(a, b) for b in group), min(abs(a[5] - b[5]) for b in group)
            c = 0.35 * max(0, 1 - far / m) + 0.35 * max(0, 1 - days / d) + 0.3 * mo.get((a[0], s), 0.0)
            if (p := min(0.95, 0.05 * times * c / 0.5)) >= least:
                out[a[0], s] = far, days, p
    return out


@pytest.mark.parametrize(("least", "with_mo"), [(0.2, False), (0.2, True), (0.1, False)])
def test_links_of_all_pairs(spark, least, with_mo):
    g = random.Random(5)
    event = lambda i, kind, y, x, d: (f"e{i}", i, kind, y, x, d)
    place = lambda s: (51.5 + 0.004 * s + g.uniform(-0.001, 0.001), -0.1 + g.uniform(-0.001, 0.001))
    members = {f"S{s}": [event(100 * s + k, g.choice(["burglary", "theft", "burglary"]), *place(s), g.uniform(0, 90)) for k in range(6)] for s in range(6)}
    # its only near member is years older than its only recent one, which lies a degree away
    members["S9"] = [event(900, "burglary", 52.5, 0.5, 0.0), event(901, "burglary", 53.5, 0.5, 900.0)]
    probes = [event(5000 + i, "theft", *place(g.randrange(6)), g.uniform(-20, 110)) for i in range(40)] + [event(9999, "theft", 52.5, 0.5001, 900.25)]
    rows = [*probes, *(b for group in members.values() for b in group)]
    mo = {(a[0], s): g.random() for a in probes for s in members if g.random() < 0.4} if with_mo else {}
    e = spark.createDataFrame(rows, EVENT).withColumn("occurred_at", F.timestamp_seconds(F.lit(1704067200.0) + F.col("d") * 86400))
    m = spark.createDataFrame([(b[0], s) for s, group in members.items() for b in group], "event_id string, series_id string")
    known = spark.createDataFrame([(*k, v) for k, v in mo.items()], "event_id string, series_id string, mo double") if with_mo else None
    got = {(r["event_id"], r["series_id"]): (1000 * r["km"], r["dt"], r["p"]) for r in series.link_probability(e.join(m, "event_id", "left_anti"), m, e, known, least).collect()}
    want = linked(probes, members, mo, least)
    assert set(got) == set(want) and ("e9999", "S9") in got
    assert all(math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-4) for k in want for x, y in zip(got[k], want[k], strict=True))
