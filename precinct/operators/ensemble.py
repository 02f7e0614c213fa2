"""Poisson and self-exciting parts of a risk, combined: for events, and for the cells of a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precinct.operators import rates, surfaces


def combine(df: DataFrame, w_poisson: float = 0.6, w_hawkes: float = 0.4) -> DataFrame:
    """Rows (p_any, expected, ci90_lo, ci90_hi, intensity) with prob, expected count, uncertainties, intervals and dominant model."""
    total = w_poisson + w_hawkes
    wp, wh = (0.5, 0.5) if total <= 0 else (w_poisson / total, w_hawkes / total)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    ph = 1 - F.exp(-F.col("intensity"))
    out = df.withColumns({"prob": clip(wp * F.col("p_any") + wh * ph), "expected_count": wp * F.col("expected") + wh * F.col("intensity"), "aleatoric": (F.col("ci90_hi") - F.col("ci90_lo")) / 3.29, "epistemic": F.abs(F.col("p_any") - ph) / 2})
    s = 1.96 * F.sqrt(F.col("aleatoric") * F.col("aleatoric") + F.col("epistemic") * F.col("epistemic"))
    model = "equal" if abs(wp - wh) < 1e-9 else "poisson" if wp > wh else "hawkes"
    return out.withColumns({"ci90_low": 0.65 * F.col("expected_count"), "ci90_high": 1.55 * F.col("expected_count"), "ci95_low": clip(F.col("prob") - s), "ci95_high": clip(F.col("prob") + s), "dominant": F.lit(model)})


def risk_grid(events: DataFrame, model: DataFrame, zone: Column, at: str, t: float, bbox: tuple, n: int = 20, hawkes: tuple = (0.1, 0.3, 0.5, 0.01)) -> DataFrame:
    """row, col, lat, lon and `combine`'s columns at the centres of n x n cells, for the time `at` (t in the events' days).

    events: id, t, lat, lon. model: a fitted count model without types. zone: of a cell, from row, col, lat and lon."""
    y0, y1, x0, x1 = bbox
    dy, dx = (y1 - y0) / n / 2, (x1 - x0) / n / 2
    cells = surfaces.hawkes_surface(events, t, (y0 + dy, y1 - dy, x0 + dx, x1 - dx), n, *hawkes)
    rows = rates.bucketed(cells.withColumn("zone", zone), ts=F.lit(at).cast("timestamp"), kind=F.lit(""))
    return combine(rates.predict_poisson(rows, model))
