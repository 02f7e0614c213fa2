"""Count models: Poisson buckets, Gamma-Poisson hierarchy and the zone forecast. A fitted model is a DataFrame."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import DoubleType

BUCKET = ["zone", "hour_block", "dow", "month", "type"]
PRIOR_RATE = 0.01


def bucketed(events: DataFrame, ts: Column | None = None, kind: Column | None = None) -> DataFrame:
    t = F.col("occurred_at") if ts is None else ts
    kind = F.lower(F.coalesce("crime_type", F.lit(""))) if kind is None else kind
    return events.withColumns({"hour_block": F.floor(F.hour(t) / 2).cast("int"), "dow": F.weekday(t), "month": F.month(t), "type": kind})


def fit_poisson(events: DataFrame, kind: Column | None = None, exposure: str = "active_days") -> DataFrame:
    """A row for each (zone, two-hour block, weekday, month, type): n days, rate, and r, p where overdispersed.

    exposure "active_days" counts days with an event; "calendar" the days of that weekday and month in the data's range."""
    days = bucketed(events.filter("occurred_at is not null"), kind=kind).groupBy(*BUCKET, F.to_date("occurred_at").alias("day")).agg(F.count("*").alias("c"))
    out = days.groupBy(*BUCKET).agg(F.count("*").alias("n_days"), F.sum("c").alias("total"), F.sum(F.col("c") * F.col("c")).alias("squares"))
    if exposure == "calendar":
        span = events.agg(F.to_date(F.min("occurred_at")).alias("a"), F.to_date(F.max("occurred_at")).alias("b"))
        held = span.select(F.explode(F.sequence("a", "b")).alias("d")).groupBy(F.weekday("d").alias("dow"), F.month("d").alias("month")).agg(F.count("*").alias("held"))
        out = out.join(F.broadcast(held), ["dow", "month"]).withColumn("n_days", F.col("held")).drop("held")  # at most 84 rows
    mean = F.col("total") / F.col("n_days")
    var = F.greatest(F.col("squares") / F.col("n_days") - mean * mean, F.lit(0.0))
    over = (F.col("n_days") > 5) & (var > mean) & (mean > 0)
    r = F.when(over, mean * mean / (var - mean))
    return out.select(*BUCKET, "n_days", mean.alias("rate"), var.alias("variance"), r.alias("r"), F.when(over, mean / (mean + r)).alias("p"))


def _ppf(start: float, log_first, log_ratio, mean: float, spread: float, target: float) -> float:
    """Smallest k with CDF >= target < 1. Terms are added from far below the mean, where what lies before counts for nothing, as
    P(0) of a large mean is no number: log_first(k) is log P(k), log_ratio(k) those of P(k) / P(k - 1)."""
    k, width, below = start, int(8 * spread) + 64, 0.0
    log = log_first(k)
    while True:
        logs = np.concatenate([[log], log + np.cumsum(log_ratio(np.arange(k + 1, k + width)))])
        cdf = below + np.cumsum(np.exp(logs))
        at = int(np.searchsorted(cdf, target))
        if at < width:
            return float(k + at)
        if logs[-1] < -745 and k + width > mean:  # nothing comes any more: the rest is rounding
            return float(k + int(np.argmax(cdf)))
        below, log, k = cdf[-1], logs[-1] + float(log_ratio(np.array([k + width]))[0]), k + width


def _quantile(start_log, ratio, mean: float, variance: float, target: float) -> float:
    spread = math.sqrt(variance)
    return _ppf(max(0, math.floor(mean - 12 * spread)), start_log, lambda k: np.log(ratio(k)), mean, spread, target)


def poisson_quantiles(rate: np.ndarray, target: float) -> np.ndarray:
    """For each distinct rate once."""
    each, of = np.unique(rate, return_inverse=True)
    log_first = lambda m: lambda k: k * math.log(m) - m - math.lgamma(k + 1)
    return np.array([_quantile(log_first(m), lambda k, m=m: m / k, m, m, target) if m > 0 else 0.0 for m in each.tolist()])[of]


def negbin_quantiles(r: np.ndarray, p: np.ndarray, target: float) -> np.ndarray:
    """Counts with P(k) = C(k+r-1, k) p^k (1-p)^r."""
    each, of = np.unique(np.stack([r, p]), axis=1, return_inverse=True)
    log_first = lambda r, p: lambda k: math.lgamma(k + r) - math.lgamma(k + 1) - math.lgamma(r) + r * math.log1p(-p) + k * math.log(p)
    found = [_quantile(log_first(r, p), lambda k, r=r, p=p: p * (k - 1 + r) / k, r * p / (1 - p), r * p / (1 - p) ** 2, target) for r, p in each.T.tolist()]
    return np.array(found)[of.reshape(-1)]


@F.pandas_udf(DoubleType())
def count_quantile(rate: pd.Series, r: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
    """Quantile q of Poisson(rate), or of the negative binomial where r and p are given."""
    out = np.empty(len(rate))
    for target in q.unique():
        for over in (False, True):
            m = ((q == target) & (r.notna() == over)).to_numpy()
            if m.any():
                out[m] = negbin_quantiles(r[m].to_numpy(), p[m].to_numpy(), target) if over else poisson_quantiles(rate[m].to_numpy(), target)
    return pd.Series(out)


def poisson_pmf0(rate: Column) -> Column:
    return F.exp(-F.greatest(rate, F.lit(0.0)))


def predict_poisson(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows (with the bucket columns) with rate, expected, p_any, ci90, n and model; a prior where the model has none. Quantiles are
    found once for each bucket of the model, then joined."""
    lo, hi = (count_quantile("rate", "r", "p", F.lit(q)) for q in (0.05, 0.95))
    out = rows.join(model.drop("variance").withColumns({"_lo": lo, "_hi": hi}), BUCKET, "left")
    seen = F.col("rate").isNotNull()
    p_any = F.when(F.col("r").isNotNull(), 1 - F.pow(1 - F.col("p"), F.col("r"))).otherwise(1 - poisson_pmf0(F.col("rate")))
    return out.select(
        *rows.columns, F.coalesce("rate", F.lit(PRIOR_RATE)).alias("lambda"), F.coalesce("rate", F.lit(PRIOR_RATE)).alias("expected"),
        F.when(seen, p_any).otherwise(1 - F.exp(F.lit(-PRIOR_RATE))).alias("p_any"),
        F.when(seen, F.col("_lo")).otherwise(0.0).alias("ci90_lo"), F.when(seen, F.col("_hi")).otherwise(2.0).alias("ci90_hi"), F.coalesce("n_days", F.lit(0)).alias("n"),
        F.when(F.col("r").isNotNull(), "NegativeBinomial").otherwise("NonHomogeneousPoisson").alias("model"),
    )


def gamma_ppf(alpha: Column, beta: Column, p: float) -> Column:
    """Wilson-Hilferty with the rational normal quantile of Abramowitz and Stegun 26.2.23."""
    q = min(p, 1 - p)
    t = np.sqrt(-2 * np.log(q))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    z = float(z if p >= 0.5 else -z)
    h = 1 - 1 / (9 * alpha) + z / (3 * F.sqrt(alpha))
    return F.greatest(alpha * F.pow(h, F.lit(3)), F.lit(0.0)) / beta


def fit_gamma_poisson(zone_counts: DataFrame, exposure_days: float = 30.0) -> DataFrame:
    """zone_counts (zone, k) with the shared prior (alpha0, beta0) and each zone's posterior."""
    e = max(exposure_days, 1.0)
    rate = F.col("k") / e
    stats = zone_counts.agg(F.avg(rate).alias("mu"), F.when(F.count("*") > 1, F.var_samp(rate)).otherwise(1.0).alias("s2"))
    tiny = (F.col("s2") < 1e-9) | (F.col("mu") < 1e-9)
    s2 = F.when(tiny, F.greatest("s2", F.lit(1e-9))).otherwise(F.col("s2"))
    prior = stats.select(F.greatest(F.col("mu") * F.col("mu") / s2, F.lit(0.1)).alias("alpha0"), F.greatest(F.col("mu") / s2, F.lit(0.1)).alias("beta0"))
    out = zone_counts.crossJoin(F.broadcast(prior))  # one row
    a, b = F.col("alpha0") + F.col("k"), F.col("beta0") + e
    return out.withColumns({"alpha": a, "beta": b}).withColumns({"mean": a / b, "var": a / (b * b), "lo": gamma_ppf(a, b, 0.05), "hi": gamma_ppf(a, b, 0.95)})


def negbin_cdf(k: Column, r: Column, p: Column) -> Column:
    """P(X <= k) by recurrence, success probability p, stopping where a term no longer counts."""
    first = F.struct(F.pow(1 - p, r).alias("term"), F.pow(1 - p, r).alias("sum"))
    step = lambda s, i: F.struct((s["term"] * p * (i - 1 + r) / i).alias("term"), (s["sum"] + s["term"] * p * (i - 1 + r) / i).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), first, step)["sum"]
    return F.when(k < 0, 0.0).when(k == 0, F.pow(1 - p, r)).otherwise(F.least(total, F.lit(1.0)))


def predictive_probability(post: DataFrame, at_least: int, days: float) -> DataFrame:
    """P(Y >= m) of each zone over so many days."""
    p = days / (F.col("beta") + days)
    value = F.lit(1.0) if at_least <= 0 else 1 - negbin_cdf(F.lit(at_least - 1), F.col("alpha"), p)
    return post.withColumn("p_at_least", value)


def shrinkage(post: DataFrame, days: float = 7.0) -> DataFrame:
    w = F.col("k") / (F.col("k") + F.col("beta0"))
    return post.withColumns({"predicted": F.col("mean") * max(days, 0.0), "shrunk": (1 - w) * F.col("alpha0") / F.col("beta0") + w * F.col("mean")})


def zone_risk(post: DataFrame) -> DataFrame:
    """The stored table of zone risks: zone, mean, var, lo, hi, updated_at."""
    return post.select("zone", "mean", "var", "lo", "hi", F.current_timestamp().alias("updated_at"))


ESCALATION_DAYS = 14


def escalation(events: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (zone, day) with the factor 1 + min(sum of exp(-0.1 lag) / 3, 1) over recent events of the zone."""
    latest = events.agg(F.to_date(F.max("occurred_at")).alias("latest"))
    daily = events.filter("occurred_at is not null").crossJoin(F.broadcast(latest)).filter(F.datediff("latest", F.to_date("occurred_at")) <= 30)  # one row
    daily = daily.groupBy("zone", F.to_date("occurred_at").alias("seen")).agg(F.count("*").alias("c"))
    lag = F.datediff("day", "seen")
    near = targets.join(daily, "zone").withColumn("lag", lag).filter(f"lag between 0 and {ESCALATION_DAYS}").groupBy("zone", "day").agg(F.sum(F.col("c") * F.exp(-0.1 * F.col("lag"))).alias("w"))
    return targets.join(near, ["zone", "day"], "left").withColumn("escalation", 1 + F.least(F.coalesce("w", F.lit(0.0)) / 3, F.lit(1.0))).drop("w")


def temporal_multiplier(day: Column) -> Column:
    m = F.month(day)
    return F.when(F.weekday(day) >= 4, 1.2).otherwise(1.0) * F.when((m >= 10) | (m <= 2), 1.1).otherwise(1.0)


ALERTS = {"CRITICAL": 0.75, "HIGH": 0.5, "ELEVATED": 0.3}


def alert(risk: Column, levels: dict[str, float] = ALERTS) -> Column:
    out = F.lit("NORMAL")
    for name, at in reversed(list(levels.items())):
        out = F.when(risk >= at, name).otherwise(out)
    return out


def forecast_days(events: DataFrame, start: str, horizon: int = 7, untyped: str = "pool", hour: int = 12) -> DataFrame:
    """zone, day, risk, expected for each zone with events and each of the next days (at the given hour)."""
    kind = F.lit("") if untyped == "pool" else None
    model = fit_poisson(events, kind)
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.date_add(F.lit(start).cast("date"), max(horizon, 1) - 1)))
    targets = events.select("zone").distinct().withColumn("day", days)
    at = F.timestamp_seconds(F.unix_timestamp(F.col("day").cast("timestamp")) + hour * 3600)
    rows = bucketed(escalation(events, targets), ts=at, kind=F.lit(""))
    seen = predict_poisson(rows, model)
    factor = F.col("escalation") * temporal_multiplier(F.col("day"))
    return seen.select("zone", "day", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p_any") * factor)).alias("risk"), (F.col("expected") * factor).alias("expected"))


def forecast(events: DataFrame, start: str, horizon: int = 7, untyped: str = "pool") -> DataFrame:
    """A row a zone: mean risk, total expected, first peak day, alert level and rank."""
    days = forecast_days(events, start, horizon, untyped)
    zones = days.groupBy("zone").agg(F.avg("risk").alias("weekly_risk"), F.sum("expected").alias("expected"), F.min_by("day", F.struct(-F.round("risk", 12), F.col("day"))).alias("peak_day"), F.max("risk").alias("peak_risk"))
    return zones.withColumn("alert", alert(F.col("weekly_risk")))


def rank_zones(zones: DataFrame, by: str, n: int) -> DataFrame:
    return zones.orderBy(F.desc(by), "zone").limit(n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), "zone")))  # n rows
