"""Time features as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dow(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    angle = x * (2 * F.pi() / period)
    return F.sin(angle), F.cos(angle)


def payday_distance(ts: Column) -> Column:
    d = F.dayofyear(ts) % 14
    return F.least(d, 14 - d)


def lunar_phase(ts: Column) -> Column:
    days = F.datediff(F.to_date(ts), F.lit("2000-01-06").cast("date"))
    return F.pmod(days.cast("double"), F.lit(29.53059)) / 29.53059


def sun_altitude(ts: Column, lat: Column) -> Column:
    """Degrees above the horizon."""
    hour = F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0
    tilt = F.radians(-23.45 * F.cos(2 * F.pi() * (F.dayofyear(ts) + 10) / 365.0))
    turn = F.radians((hour - 12) * 15)
    s = F.sin(F.radians(lat)) * F.sin(tilt) + F.cos(F.radians(lat)) * F.cos(tilt) * F.cos(turn)
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))))


def temporal_features(df: DataFrame, ts: str = "occurred_at", lat: float = 51.5, holidays: DataFrame | None = None) -> DataFrame:
    """All time features of a row; holidays is an optional table (day date)."""
    t = F.col(ts)
    cycles = {"hour": (F.hour(t), 24), "dow": (dow(t), 7), "month": (F.month(t) - 1, 12), "doy": (F.dayofyear(t), 365)}
    made = {f"{n}_{f}": c for n, (x, p) in cycles.items() for f, c in zip(("sin", "cos"), cyclic(x, p), strict=True)}
    where = F.coalesce(F.col("lat"), F.lit(lat)) if "lat" in df.columns else F.lit(lat)
    sun = sun_altitude(t, where)
    made |= {
        "is_weekend": dow(t) >= 5, "is_night": (F.hour(t) >= 22) | (F.hour(t) <= 5), "week_of_month": F.floor((F.dayofmonth(t) - 1) / 7) + 1,
        "payday_distance": payday_distance(t), "lunar_phase": lunar_phase(t), "sun_altitude": sun, "is_dark": sun < -6,
    }
    out = df.withColumns(made)
    if holidays is None:
        return out.withColumn("is_holiday", F.lit(False))
    days = holidays.select(F.col("day").alias("_day")).distinct().withColumn("is_holiday", F.lit(True))
    return out.join(days, F.to_date(t) == F.col("_day"), "left").drop("_day").withColumn("is_holiday", F.coalesce("is_holiday", F.lit(False)))
