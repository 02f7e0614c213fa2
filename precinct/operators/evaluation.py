"""Accuracy, ranking, calibration and fairness of predictions (id, y, pred, grp)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precinct import fixed
from precinct.blocks.ranks import global_cumulate
from precinct.blocks.shared import materialize

EPS = 1e-15


def errors(df: DataFrame) -> DataFrame:
    """MAE, RMSE, Brier score and clipped log-loss in one pass."""
    y, p = F.col("y").cast("double"), F.col("pred")
    c = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    sq = (y - p) * (y - p)
    return df.agg(F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg(sq)).alias("rmse"), F.avg(sq).alias("brier"), F.avg(-(y * F.log(c) + (1 - y) * F.log(1 - c))).alias("log_loss"))


def ranked(df: DataFrame) -> DataFrame:
    """y and pred by falling prediction (ties by id) with rank and running hits."""
    hit = df.select("id", "y", "pred").withColumn("hit", (F.col("y") >= 0.5).cast("long"))
    return global_cumulate(hit, [F.desc("pred"), F.asc("id")], {"hits": "hit"})


def ranking_report(df: DataFrame, fractions: tuple[float, ...] = (0.05, 0.10, 0.20)) -> DataFrame:
    """One row: PAI and PEI at the fractions, SER, AUC-ROC and AUC-PR."""
    rows = ranked(df)
    total = df.agg(F.count("*").alias("n"), F.sum(F.when(F.col("y") >= 0.5, 1).otherwise(0)).alias("pos"))
    r = rows.crossJoin(F.broadcast(total))  # one row
    n, pos, hits, rank, hit = (F.col(c) for c in ("n", "pos", "hits", "rank", "hit"))
    flagged = {f: F.greatest(F.lit(1), F.round(n * f).cast("long")) for f in fractions}
    name = lambda f: f"{round(100 * f)}"
    # A step's trapezoid: before and after each row. Lift: hits share over rank share; ROC: only negatives widen it.
    lift = (2 * hits - hit) / (2 * pos) / n
    roc = F.when(hit == 0, hits / pos / (n - pos)).otherwise(0.0)
    before_p = F.when(rank == 1, 1.0).otherwise((hits - hit) / F.greatest(rank - 1, F.lit(1)))
    pr = hit / pos * (before_p + hits / rank) / 2
    agg = [F.max("n").alias("n"), F.max("pos").alias("pos"), F.sum(lift).alias("lift"), F.sum(roc).alias("roc"), F.sum(pr).alias("auc_pr")]
    agg += [F.max(F.when(rank == flagged[f], hits)).alias(f"h_{name(f)}") for f in fractions] + [F.max(flagged[f]).alias(f"k_{name(f)}") for f in fractions]
    one = r.agg(*agg)
    made: dict[str, Column] = {}
    for f in fractions:
        made[f"pai_{name(f)}"] = F.coalesce(F.try_divide(F.col(f"h_{name(f)}") / F.col("pos"), F.lit(f)), F.lit(0.0))
        best = F.least(F.col(f"k_{name(f)}"), F.col("pos")) / F.col("pos") / f
        made[f"pei_{name(f)}"] = F.coalesce(F.try_divide(made[f"pai_{name(f)}"], best), F.lit(0.0))
    perfect = 1 - 0.5 * F.col("pos") / F.col("n") - 0.5
    made["ser"] = F.when((F.col("pos") == 0) | (perfect < 1e-12), 0.0).otherwise((F.col("lift") - 0.5) / perfect)
    made["auc_roc"] = F.when((F.col("pos") == 0) | (F.col("pos") == F.col("n")), 0.5).otherwise(F.col("roc"))
    made["auc_pr"] = F.coalesce("auc_pr", F.lit(0.0))
    return one.select(*[c.alias(k) for k, c in made.items()])


def full_report(df: DataFrame) -> DataFrame:
    """A row a metric: metric, value, target, status (pass; warn within 20 %; fail)."""
    one = ranking_report(df).crossJoin(F.broadcast(errors(df)))  # one row each
    metrics = [*fixed.TARGETS, "auc_pr", "mae", "rmse"]
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(fixed.TARGETS.get(m)).cast("double").alias("target")) for m in metrics])).alias("r")).select("r.*")
    low = F.col("metric") == "brier"
    good = F.when(low, F.col("value") <= F.col("target")).otherwise(F.col("value") >= F.col("target"))
    near = F.when(low, F.col("value") <= 1.2 * F.col("target")).otherwise(F.col("value") >= 0.8 * F.col("target"))
    return rows.withColumn("status", F.when(F.col("target").isNull(), "info").when(good, "pass").when(near, "warn").otherwise("fail"))


def hint_quality(ranks: DataFrame, top_k: int = 5) -> DataFrame:
    """One row from `rank` (0, negative or beyond top_k: a miss)."""
    r = F.col("rank")
    hit = (r >= 1) & (r <= top_k)
    at = lambda k: F.avg(F.when(hit & (r <= k), 1.0).otherwise(0.0))
    return ranks.agg(
        at(1).alias("p_at_1"), at(3).alias("p_at_3"), at(5).alias("p_at_5"), F.avg(F.when(hit, 1.0 / r).otherwise(0.0)).alias("mrr"),
        F.avg(F.when(hit, 1 / F.log2(r + 1.0)).otherwise(0.0)).alias("ndcg"), at(top_k).alias("coverage"), (1 - at(top_k)).alias("false_lead_rate"),
    )


def calibration_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """Populated equal-width bins: bin, n, avg_pred, empirical, midpoint."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("pred") * bins))).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("pred").alias("avg_pred"), F.avg(F.col("y").cast("double")).alias("empirical")).withColumn("midpoint", (F.col("bin") + 0.5) / bins)


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """One row: ECE, MCE, ACE, Brier, log-loss, sharpness and status."""
    gap = F.abs(F.col("avg_pred") - F.col("empirical"))
    one = calibration_bins(df, bins).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"), F.avg(gap).alias("ace"))
    more = errors(df).select("brier", "log_loss").crossJoin(F.broadcast(df.agg(F.var_pop("pred").alias("sharpness"))))  # one row each
    e = F.col("ece")
    return one.crossJoin(F.broadcast(more)).withColumn("status", F.when(e < 0.05, "EXCELLENT").when(e < 0.10, "GOOD").when(e < 0.20, "FAIR").otherwise("POOR"))


def _pooled(rows: pd.DataFrame) -> pd.DataFrame:
    """Blocks (part, low, s, n) with non-decreasing means s / n, of blocks in the order of low."""
    low, s, n = [], [], []
    for x, y, k in rows.sort_values("low")[["low", "s", "n"]].itertuples(index=False):
        while s and s[-1] * k >= y * n[-1]:  # a mean that isn't below the next one joins it
            y, k, x = y + s.pop(), k + n.pop(), low.pop()
        low.append(x)
        s.append(y)
        n.append(k)
    return pd.DataFrame({"part": np.full(len(low), rows["part"].iloc[0]), "low": low, "s": s, "n": n})


def isotonic(df: DataFrame) -> DataFrame:
    """id, pred, calibrated: the non-decreasing function of pred with the least squared error; equal predictions are one.

    Violators are pooled in ranges of pred, then the ranges' blocks are merged two by two, so a task holds blocks, of which few are
    left where values scatter. A prediction's block is the last that begins at or below it: blocks rise, so that is a
    running maximum over ranges, not a join by ranges. Rows without pred are left out; of none, none come out."""
    spark = df.sparkSession
    data = df.filter("pred is not null").groupBy("pred").agg(F.sum(F.col("y").cast("double")).alias("s"), F.count("*").cast("double").alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(data.repartitionByRange(parts, "pred").withColumn("part", F.spark_partition_id()), "predictions-by-range")
    blocks = ranged.select(F.col("part").cast("long"), F.col("pred").cast("double").alias("low"), "s", "n")
    while True:
        blocks = materialize(blocks.groupBy("part").applyInPandas(_pooled, "part long, low double, s double, n double"), "isotonic-blocks")
        if parts <= 1:
            break
        parts = (parts + 1) // 2
        blocks = blocks.withColumn("part", F.floor(F.col("part") / 2).cast("long"))
    begun = ranged.join(blocks.select(F.col("low").alias("pred"), (F.col("s") / F.col("n")).alias("value")), "pred", "left")
    tops = begun.groupBy("part").agg(F.max("value").alias("top"))
    before = F.max("top").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # over a row a range
    carried = tops.select("part", before.alias("carried"))
    inside = F.max("value").over(Window.partitionBy("part").orderBy("pred").rowsBetween(Window.unboundedPreceding, 0))
    value = begun.withColumn("inside", inside).join(F.broadcast(carried), "part").select("pred", F.coalesce(F.greatest("inside", "carried"), "inside", "carried").alias("calibrated"))
    return df.select("id", "pred").join(value, "pred").select("id", "pred", "calibrated")


def pool_adjacent(values: list[float]) -> list[float]:
    """Least-squares non-decreasing fit with unit weights."""
    blocks: list[list[float]] = []
    for v in values:
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            n = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / n, n])
    return [v for v, n in blocks for _ in range(int(n))]


def calibration_table(df: DataFrame, bins: int = 20, least: int = 10) -> list[tuple[float, float]]:
    """Knots of the ensemble's calibration: bin means made monotone, anchored at (0,0) and (1,1). At most 22 rows."""
    rows = sorted(calibration_bins(df, bins).collect(), key=lambda r: r["bin"])
    if sum(r["n"] for r in rows) < least:
        return []
    fitted = pool_adjacent([r["empirical"] for r in rows])
    return [(0.0, 0.0), *((r["avg_pred"], v) for r, v in zip(rows, fitted, strict=True)), (1.0, 1.0)]


def apply_calibration(p: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear between the knots."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    out = F.lit(None).cast("double")
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:], strict=False))):
        t = (p - x0) / (x1 - x0) if x1 - x0 > 1e-12 else F.lit(0.0)
        out = F.when((p >= x0) & (p <= x1), y0 + t * (y1 - y0)).otherwise(out)
    return clip(F.coalesce(out, p))


def group_stats(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    pos, flag = F.col("y") >= 0.5, F.col("pred") >= threshold
    c = F.count_if
    g = df.groupBy("grp").agg(F.count("*").alias("n"), c(flag).alias("flagged"), F.avg("pred").alias("mean_pred"), F.avg(F.col("y").cast("double")).alias("actual_rate"), c(flag & pos).alias("tp"), c(flag & ~pos).alias("fp"), c(~flag & pos).alias("fn"), c(~flag & ~pos).alias("tn"), F.min("id").alias("first_id"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    return g.withColumns({"flag_rate": F.col("flagged") / F.col("n"), "fpr": rate("fp", "tn"), "fnr": rate("fn", "tp"), "tpr": rate("tp", "fn")})


def _pairs(stats: DataFrame, value: str, before: str) -> DataFrame:
    """Pairs of groups (a before b by a column); the table has a row a group."""
    a = stats.select(F.col("grp").alias("group_a"), F.col(value).alias("va"), F.col(before).alias("ka"))
    b = stats.select(F.col("grp").alias("group_b"), F.col(value).alias("vb"), F.col(before).alias("kb"))
    return a.join(F.broadcast(b), F.col("ka") < F.col("kb")).drop("ka", "kb")


def disparate_impact(stats: DataFrame) -> DataFrame:
    hi, lo = F.greatest("va", "vb"), F.least("va", "vb")
    ratio = F.when(hi < 1e-12, 1.0).otherwise(lo / hi)
    return _pairs(stats, "flag_rate", "grp").select("group_a", "group_b", ratio.alias("ratio"), (ratio < 0.8).alias("flagged"))


def equal_opportunity(stats: DataFrame) -> DataFrame:
    """TPR ratios, groups in first-seen order."""
    ratio = F.when(F.col("vb") < 1e-12, F.lit(float("inf"))).otherwise(F.col("va") / F.col("vb"))
    return _pairs(stats, "tpr", "first_id").select("group_a", "group_b", ratio.alias("ratio"), ((ratio < 0.8) | (ratio > 1.25)).alias("flagged"))


def spread(stats: DataFrame) -> DataFrame:
    """One row: highest over lowest flag rate, and the spread of TPR."""
    low, high = F.min("flag_rate"), F.max("flag_rate")
    return stats.agg(F.when(low < 1e-12, 0.0).otherwise(high / low).alias("max_impact"), F.when(F.min(F.col("tp") + F.col("fn")) == 0, 0.0).otherwise(F.max("tpr") - F.min("tpr")).alias("odds_diff"))


def feedback_loop(trend: DataFrame, limit: float = 0.01) -> DataFrame:
    """Zones whose predictions rise while what happens doesn't. trend: zone, idx, pred, actual."""
    g = trend.groupBy("zone").agg(F.count("*").alias("n"), F.regr_slope("pred", F.col("idx").cast("double")).alias("slope_pred"), F.regr_slope("actual", F.col("idx").cast("double")).alias("slope_actual"))
    return g.withColumn("feedback", (F.col("n") >= 2) & (F.col("slope_pred") > limit) & (F.col("slope_actual") <= limit))


#: Fewest train and test events of a month holdout: for calibration, and for a surface.
HOLDOUT_LEAST, SURFACE_LEAST = (20, 10), (50, 20)


def month_part(at: Column, last_train: int = 4) -> Column:
    """train up to that month of any year, test after it, undated without a date."""
    return F.when(at.isNull(), "undated").when(F.month(at) <= last_train, "train").otherwise("test")


def month_holdout(events: DataFrame, at: str = "occurred_at", least: tuple[int, int] = HOLDOUT_LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, sizes): sizes is one row of train, test, undated and whether there are enough of the first two."""
    marked = events.withColumn("_part", month_part(F.col(at)))
    of = lambda name: marked.filter(F.col("_part") == name).drop("_part")
    sizes = marked.agg(*[F.count_if(F.col("_part") == name).alias(name) for name in ("train", "test", "undated")])
    return of("train"), of("test"), sizes.withColumn("enough", (F.col("train") >= least[0]) & (F.col("test") >= least[1]))
