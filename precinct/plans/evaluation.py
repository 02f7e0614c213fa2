"""Queries that audit predictions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from precinct.operators import evaluation as ev
from precinct.operators import export
from precinct.plans.base import Register, rounded
from precinct.plans.fixtures import CE, PRED, crime_events, predictions, table

R = Register()

_RANK = f"""{PRED}, rk AS (SELECT *, row_number() OVER w AS rank, sum(y) OVER w AS hits, count(*) OVER () AS n, sum(y) OVER () AS pos FROM pr WINDOW w AS (ORDER BY pred DESC, id ROWS UNBOUNDED PRECEDING)),
m AS (SELECT {", ".join(f"max(hits) FILTER (rank = greatest(1, round(n * {f / 100}))) / max(pos) / {f / 100} AS pai_{f}, least(greatest(1, round(max(n) * {f / 100})), max(pos)) / max(pos) / {f / 100} AS best_{f}" for f in (5, 10, 20))},
  sum((2 * hits - y) / (2 * pos) / n) AS lift, max(pos) AS pos, max(n) AS n, sum(CASE WHEN y = 0 THEN hits / pos / (n - pos) ELSE 0 END) AS auc_roc,
  sum(y / pos * (CASE WHEN rank = 1 THEN 1 ELSE (hits - y) / greatest(rank - 1, 1) END + hits / rank) / 2) AS auc_pr FROM rk),
er AS (SELECT avg(abs(y - pred)) AS mae, sqrt(avg((y - pred) * (y - pred))) AS rmse, avg((y - pred) * (y - pred)) AS brier FROM pr),
rep AS (SELECT pai_5, pai_10, pai_20, pai_10 / best_10 AS pei_10, (lift - 0.5) / (1 - 0.5 * pos / n - 0.5) AS ser, auc_roc, auc_pr, mae, rmse, brier, pai_5 / best_5 AS pei_5, pai_20 / best_20 AS pei_20 FROM m, er)"""


@R("w05_ranking", f"WITH {_RANK} SELECT round(pai_5, 4) AS pai_5, round(pei_5, 4) AS pei_5, round(pai_10, 4) AS pai_10, round(pei_10, 4) AS pei_10, round(pai_20, 4) AS pai_20, round(pei_20, 4) AS pei_20, round(ser, 4) AS ser, round(auc_roc, 4) AS auc_roc, round(auc_pr, 4) AS auc_pr FROM rep")
def w05_ranking(spark, sf):
    """W01-W05."""
    return rounded(ev.ranking_report(predictions(spark, sf)), 4)


_T = {"pai_5": 6.0, "pai_10": 4.5, "pai_20": 3.0, "pei_10": 0.6, "ser": 0.4, "auc_roc": 0.85}


@R("w06_report", f"""WITH {_RANK} SELECT metric, round(value, 4) AS value, target, CASE WHEN target IS NULL THEN 'info' WHEN value >= target THEN 'pass' WHEN value >= 0.8 * target THEN 'warn' ELSE 'fail' END AS status FROM (
{" UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS value, CAST({t} AS DOUBLE) AS target FROM rep" for m, t in (_T | {m: "NULL" for m in ("auc_pr", "mae", "rmse")}).items())})
UNION ALL SELECT 'brier', round(brier, 4), 0.1, CASE WHEN brier <= 0.1 THEN 'pass' WHEN brier <= 0.12 THEN 'warn' ELSE 'fail' END FROM rep""")
def w06_report(spark, sf):
    """W06, X05."""
    return rounded(ev.full_report(predictions(spark, sf)), 4)


@R("a39_errors", f"WITH {PRED} SELECT round(avg(abs(y - pred)), 6) AS mae, round(sqrt(avg(pow(y - pred, 2))), 6) AS rmse, round(avg(pow(y - pred, 2)), 6) AS brier, round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 6) AS log_loss FROM (SELECT *, greatest(1e-15::DOUBLE, least(1 - 1e-15::DOUBLE, pred)) AS c FROM pr)")
def a39_errors(spark, sf):
    return rounded(ev.errors(predictions(spark, sf)))


@R("a40_hint_quality", "WITH r AS (SELECT o_custkey % 8 AS r FROM orders) SELECT round(avg(CASE WHEN r = 1 THEN 1 ELSE 0 END), 6) AS p_at_1, round(avg(CASE WHEN r BETWEEN 1 AND 3 THEN 1 ELSE 0 END), 6) AS p_at_3, round(avg(CASE WHEN r BETWEEN 1 AND 5 THEN 1 ELSE 0 END), 6) AS p_at_5, round(avg(CASE WHEN r BETWEEN 1 AND 5 THEN 1.0 / r ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN r BETWEEN 1 AND 5 THEN 1 / log2(r + 1) ELSE 0 END), 6) AS ndcg, round(avg(CASE WHEN r BETWEEN 1 AND 5 THEN 1 ELSE 0 END), 6) AS coverage, round(1 - avg(CASE WHEN r BETWEEN 1 AND 5 THEN 1 ELSE 0 END), 6) AS false_lead_rate FROM r")
def a40_hint_quality(spark, sf):
    return rounded(ev.hint_quality(table(spark, sf, "orders").select((F.col("o_custkey") % 8).alias("rank"))))


_BINS = f"{PRED}, bn AS (SELECT CAST(greatest(0, least(9, floor(pred * 10))) AS INT) AS bin, count(*) AS n, avg(pred) AS avg_pred, avg(y) AS empirical FROM pr GROUP BY 1)"


@R("a41_calibration", f"""WITH {_BINS}, er AS (SELECT avg(pow(y - pred, 2)) AS brier, avg(-(y * ln(greatest(1e-15::DOUBLE, least(1 - 1e-15::DOUBLE, pred))) + (1 - y) * ln(1 - greatest(1e-15::DOUBLE, least(1 - 1e-15::DOUBLE, pred))))) AS log_loss, var_pop(pred) AS sharpness FROM pr),
c AS (SELECT sum(abs(avg_pred - empirical) * n) / sum(n) AS ece, max(abs(avg_pred - empirical)) AS mce, avg(abs(avg_pred - empirical)) AS ace FROM bn)
SELECT round(ece, 6) AS ece, round(mce, 6) AS mce, round(ace, 6) AS ace, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(sharpness, 6) AS sharpness, CASE WHEN ece < 0.05 THEN 'EXCELLENT' WHEN ece < 0.1 THEN 'GOOD' WHEN ece < 0.2 THEN 'FAIR' ELSE 'POOR' END AS status FROM c, er""")
def a41_calibration(spark, sf):
    """A41, A45."""
    return rounded(ev.calibration(predictions(spark, sf)))


@R("a42_reliability", f"WITH {_BINS} SELECT bin, n, round(avg_pred, 6) AS avg_pred, round(empirical, 6) AS empirical, round((bin + 0.5) / 10, 6) AS midpoint FROM bn")
def a42_reliability(spark, sf):
    return rounded(ev.calibration_bins(predictions(spark, sf)))


#: Monotone means as the greatest, over starts up to i, of the least mean over ends from i.
_PAVA = """cu AS (SELECT i, sum(w) OVER (ORDER BY i) AS w, sum(w * e) OVER (ORDER BY i) AS s FROM pt), sg AS (SELECT a.i + 1 AS a, b.i AS b, (b.s - a.s) / (b.w - a.w) AS m FROM (SELECT 0 AS i, 0 AS w, 0 AS s UNION ALL FROM cu) a JOIN cu b ON b.i > a.i),
mn AS (SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS m FROM sg), iso AS (SELECT i, max(m) AS v FROM mn GROUP BY i)"""


@R("a43_isotonic", f"WITH {PRED}, pt AS (SELECT row_number() OVER (ORDER BY pred) AS i, pred, count(*) AS w, avg(y) AS e FROM pr GROUP BY pred), {_PAVA} SELECT id, round(pr.pred, 6) AS pred, round(v, 6) AS calibrated FROM pr JOIN pt ON pt.pred = pr.pred JOIN iso USING (i)")
def a43_isotonic(spark, sf):
    return rounded(ev.isotonic(predictions(spark, sf)))


@R("a44_ensemble_calibration", f"""WITH {PRED}, pt AS (SELECT row_number() OVER (ORDER BY bin) AS i, 1 AS w, x, e FROM (SELECT greatest(0, least(19, floor(pred * 20))) AS bin, avg(pred) AS x, avg(y) AS e FROM pr GROUP BY 1)), {_PAVA},
kn AS (SELECT 0 AS i, 0.0::DOUBLE AS x, 0.0::DOUBLE AS v UNION ALL SELECT i, x, v FROM pt JOIN iso USING (i) UNION ALL SELECT (SELECT max(i) + 1 FROM pt), 1.0, 1.0), sl AS (SELECT i, x AS x0, v AS y0, lead(x) OVER (ORDER BY i) AS x1, lead(v) OVER (ORDER BY i) AS y1 FROM kn),
ap AS (SELECT p.pred, arg_min(CASE WHEN x1 - x0 > 1e-12 THEN y0 + (p.pred - x0) / (x1 - x0) * (y1 - y0) ELSE y0 END, i) AS c FROM (SELECT DISTINCT pred FROM pr) p JOIN sl ON p.pred BETWEEN x0 AND x1 GROUP BY 1)
SELECT id, round(pred, 6) AS pred, round(greatest(0, least(1, c)), 6) AS calibrated FROM pr JOIN ap USING (pred)""")
def a44_ensemble_calibration(spark, sf):
    p = predictions(spark, sf)
    return rounded(p.select("id", "pred", ev.apply_calibration(F.col("pred"), ev.calibration_table(p)).alias("calibrated")))


_GS = f"""{PRED}, gs AS (SELECT grp, count(*) AS n, count(*) FILTER (pred >= 0.5) AS flagged, avg(pred) AS mean_pred, avg(y) AS actual_rate, count(*) FILTER (pred >= 0.5 AND y = 1) AS tp, count(*) FILTER (pred >= 0.5 AND y = 0) AS fp,
count(*) FILTER (pred < 0.5 AND y = 1) AS fn, count(*) FILTER (pred < 0.5 AND y = 0) AS tn, min(id) AS first_id, count(*) FILTER (pred >= 0.5) / count(*) AS flag_rate FROM pr GROUP BY grp), gr AS (SELECT *, fp / (fp + tn) AS fpr, fn / (fn + tp) AS fnr, tp / (tp + fn) AS tpr FROM gs)"""


@R("a34_group_stats", f"WITH {_GS} SELECT grp, n, flagged, round(mean_pred, 6) AS mean_pred, round(actual_rate, 6) AS actual_rate, tp, fp, fn, tn, first_id, round(flag_rate, 6) AS flag_rate, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr, round(tpr, 6) AS tpr FROM gr")
def a34_group_stats(spark, sf):
    return rounded(ev.group_stats(predictions(spark, sf)))


@R("a35_disparate_impact", f"WITH {_GS} SELECT a.grp AS group_a, b.grp AS group_b, round(least(a.flag_rate, b.flag_rate) / greatest(a.flag_rate, b.flag_rate), 6) AS ratio, least(a.flag_rate, b.flag_rate) / greatest(a.flag_rate, b.flag_rate) < 0.8 AS flagged FROM gr a JOIN gr b ON a.grp < b.grp")
def a35_disparate_impact(spark, sf):
    """A35, J11."""
    return rounded(ev.disparate_impact(ev.group_stats(predictions(spark, sf))))


@R("x10_bias_text", f"""WITH {_GS}, p AS (SELECT a.grp AS group_a, b.grp AS group_b, least(a.flag_rate, b.flag_rate) / greatest(a.flag_rate, b.flag_rate) AS ratio FROM gr a JOIN gr b ON a.grp < b.grp)
SELECT group_a, group_b, '[' || CASE WHEN ratio < 0.8 THEN 'FLAGGED' ELSE 'OK' END || '] ' || group_a || ' vs ' || group_b || ': ratio ' || printf('%.4f', ratio) AS value FROM p""")
def x10_bias_text(spark, sf):
    return export.bias_text(ev.disparate_impact(ev.group_stats(predictions(spark, sf))))


@R("a36_equal_opportunity", f"WITH {_GS} SELECT a.grp AS group_a, b.grp AS group_b, round(a.tpr / b.tpr, 6) AS ratio, a.tpr / b.tpr < 0.8 OR a.tpr / b.tpr > 1.25 AS flagged FROM gr a JOIN gr b ON a.first_id < b.first_id")
def a36_equal_opportunity(spark, sf):
    return rounded(ev.equal_opportunity(ev.group_stats(predictions(spark, sf))))


@R("a38_spread", f"WITH {_GS} SELECT round(max(flag_rate) / min(flag_rate), 6) AS max_impact, round(max(tpr) - min(tpr), 6) AS odds_diff FROM gr")
def a38_spread(spark, sf):
    return rounded(ev.spread(ev.group_stats(predictions(spark, sf))))


@R("a37_feedback_loop", f"""WITH {CE}, d AS (SELECT suburb AS zone, occurred_at::DATE AS day, avg(value) / 500 AS pred, count(*) AS c FROM ce WHERE occurred_at IS NOT NULL GROUP BY ALL), t AS (SELECT zone, row_number() OVER (PARTITION BY zone ORDER BY day) AS idx, pred, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY zone) AS actual FROM d),
s AS (SELECT zone, count(*) AS n, regr_slope(pred, idx) AS slope_pred, regr_slope(actual, idx) AS slope_actual FROM t GROUP BY zone)
SELECT zone, n, round(slope_pred, 6) AS slope_pred, round(slope_actual, 6) AS slope_actual, slope_pred > 0.01 AND slope_actual <= 0.01 AS feedback FROM s""")
def a37_feedback_loop(spark, sf):
    d = crime_events(spark, sf).filter("occurred_at is not null").groupBy(F.col("suburb").alias("zone"), F.to_date("occurred_at").alias("day")).agg((F.avg("value") / 500).alias("pred"), F.count("*").alias("c"))
    w = Window.partitionBy("zone")
    t = d.select("zone", F.row_number().over(w.orderBy("day")).alias("idx"), "pred", (F.col("c") / F.sum("c").over(w)).alias("actual"))
    return rounded(ev.feedback_loop(t))
