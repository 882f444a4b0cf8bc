"""Evaluation queries."""

from pyspark.sql import functions as F

from trackloom import fixtures
from trackloom.operators import evaluate as ops
from trackloom.plans.base import cte, oracle, query, r6, rounded

THRESHOLD = 0.5


def sides(spark, sf):
    rows = fixtures.intervals(spark, sf)
    side = lambda s: rows.filter(F.col("side") == s).drop("side")
    return side("pred"), side("label")


cte("v_pred", "SELECT * EXCLUDE (side) FROM v_intervals WHERE side = 'pred'", ("v_intervals",))
cte("v_label", "SELECT * EXCLUDE (side) FROM v_intervals WHERE side = 'label'", ("v_intervals",))
cte("v_iou", """SELECT p.source_id, p.rally_id AS prediction_rally_id, l.rally_id AS label_rally_id, p.start_frame AS a_start, p.end_frame AS a_end, l.start_frame AS b_start, l.end_frame AS b_end,
    (least(p.end_frame, l.end_frame) - greatest(p.start_frame, l.start_frame) + 1)::DOUBLE / (greatest(p.end_frame, l.end_frame) - least(p.start_frame, l.start_frame) + 1) AS iou
    FROM v_pred p JOIN v_label l ON p.source_id = l.source_id AND p.start_frame <= l.end_frame AND l.start_frame <= p.end_frame""", ("v_pred", "v_label"))


@query("interval_iou")
def _(spark, sf):
    return rounded(ops.interval_iou(*sides(spark, sf)).select("source_id", "prediction_rally_id", "label_rally_id", "iou"))


oracle("interval_iou", f"SELECT source_id, prediction_rally_id, label_rally_id, {r6('iou')} FROM v_iou", ("v_iou",))


@query("match_intervals")
def matches(spark, sf):
    return rounded(ops.match_intervals(*sides(spark, sf), THRESHOLD))


# Within a side the fixture's intervals are disjoint and of similar length, so a pair of IoU >= 0.5 always
# beats what its members could get elsewhere in total: mutual best pairs are the optimum here.
cte("v_matches", """SELECT source_id, prediction_rally_id, label_rally_id, round(iou, 6) AS iou, a_start - b_start AS start_error, a_end - b_end AS end_error, 'matched' AS match_status
    FROM (SELECT *, max(iou) OVER (PARTITION BY prediction_rally_id) AS bp, max(iou) OVER (PARTITION BY label_rally_id) AS bl FROM v_iou) WHERE iou >= 0.5 AND iou = bp AND iou = bl""", ("v_iou",))
cte("v_details", """SELECT * FROM v_matches UNION ALL SELECT source_id, rally_id, NULL, 0.0, NULL, NULL, 'unmatched_prediction' FROM v_pred WHERE rally_id NOT IN (SELECT prediction_rally_id FROM v_matches)
    UNION ALL SELECT source_id, NULL, rally_id, 0.0, NULL, NULL, 'unmatched_label' FROM v_label WHERE rally_id NOT IN (SELECT label_rally_id FROM v_matches)""", ("v_matches", "v_pred", "v_label"))
oracle("match_intervals", "SELECT * FROM v_details", ("v_details",))


@query("interval_metrics")
def _(spark, sf):
    return rounded(ops.interval_metrics(ops.match_intervals(*sides(spark, sf), THRESHOLD), THRESHOLD))


oracle("interval_metrics", """SELECT matched_count, unmatched_prediction_count, unmatched_label_count, matched_count + unmatched_prediction_count AS prediction_count, matched_count + unmatched_label_count AS label_count,
    0.5::DOUBLE AS iou_threshold, round(matched_count::DOUBLE/(matched_count + unmatched_prediction_count), 6) AS "precision", round(matched_count::DOUBLE/(matched_count + unmatched_label_count), 6) AS recall,
    round(2.0::DOUBLE*matched_count/(2*matched_count + unmatched_prediction_count + unmatched_label_count), 6) AS f1, round(ms, 6) + 0.0 AS mean_start_boundary_error, round(me, 6) + 0.0 AS mean_end_boundary_error,
    round(ma, 6) AS mean_absolute_boundary_error, md AS median_absolute_boundary_error
    FROM (SELECT count(*) FILTER (match_status = 'matched') AS matched_count, count(*) FILTER (match_status = 'unmatched_prediction') AS unmatched_prediction_count, count(*) FILTER (match_status = 'unmatched_label') AS unmatched_label_count,
      avg(start_error) AS ms, avg(end_error) AS me FROM v_details), (SELECT avg(e) AS ma, median(e)::DOUBLE AS md FROM (SELECT unnest([abs(start_error), abs(end_error)]) AS e FROM v_matches))""", ("v_details", "v_matches"))


@query("split_merge_counts")
def _(spark, sf):
    pred, label = sides(spark, sf)
    wide = lambda df, k: df.withColumn("end_frame", F.col("end_frame") + F.when(F.col("rally_id") % k == 0, 90).otherwise(0))
    return ops.split_merge_counts(wide(pred, 5), wide(label, 4))


oracle("split_merge_counts", """, p AS (SELECT * EXCLUDE (end_frame), end_frame + CASE WHEN rally_id % 5 = 0 THEN 90 ELSE 0 END AS end_frame FROM v_pred),
    l AS (SELECT * EXCLUDE (end_frame), end_frame + CASE WHEN rally_id % 4 = 0 THEN 90 ELSE 0 END AS end_frame FROM v_label),
    j AS (SELECT p.rally_id AS pr, l.rally_id AS lr FROM p JOIN l ON p.source_id = l.source_id AND p.start_frame <= l.end_frame AND l.start_frame <= p.end_frame)
    SELECT (SELECT count(*) FROM (SELECT lr FROM j GROUP BY lr HAVING count(*) > 1)) AS false_split_count, (SELECT count(*) FROM (SELECT pr FROM j GROUP BY pr HAVING count(*) > 1)) AS false_merge_count""", ("v_pred", "v_label"))


@query("frame_metrics")
def _(spark, sf):
    pred, label = sides(spark, sf)
    wide = pred.withColumn("end_frame", F.col("end_frame") + F.when(F.col("rally_id") % 5 == 0, 90).otherwise(0))
    ranges = label.groupBy("source_id").agg((F.min("start_frame") + 10).alias("range_start"), (F.max("end_frame") + 50).alias("range_end"))
    return rounded(ops.frame_metrics(wide, label, ranges))


oracle("frame_metrics", """, r AS (SELECT source_id, min(start_frame) + 10 AS lo, max(end_frame) + 50 AS hi FROM v_label GROUP BY source_id),
    f AS (SELECT source_id, unnest(generate_series(lo, hi)) AS frame FROM r),
    p AS (SELECT DISTINCT source_id, unnest(generate_series(start_frame, end_frame + CASE WHEN rally_id % 5 = 0 THEN 90 ELSE 0 END)) AS frame, 1 AS p FROM v_pred),
    l AS (SELECT DISTINCT source_id, unnest(generate_series(start_frame, end_frame)) AS frame, 1 AS l FROM v_label),
    c AS (SELECT count(*) FILTER (p = 1 AND l = 1) AS tp, count(*) FILTER (p = 1 AND l IS NULL) AS fp, count(*) FILTER (p IS NULL AND l = 1) AS fn, count(*) FILTER (p IS NULL AND l IS NULL) AS tn
      FROM f LEFT JOIN p USING (source_id, frame) LEFT JOIN l USING (source_id, frame))
    SELECT tp AS frame_true_positive, fp AS frame_false_positive, fn AS frame_false_negative, tn AS frame_true_negative, round(tp::DOUBLE/(tp+fp), 6) AS frame_precision, round(tp::DOUBLE/(tp+fn), 6) AS frame_recall,
      round(2.0::DOUBLE*tp/(2*tp+fp+fn), 6) AS frame_f1 FROM c""", ("v_pred", "v_label"))


def scores(spark, sf):
    return fixtures.table(spark, sf, "events").select(
        F.when(F.col("event_type").isin("click", "purchase"), 1).otherwise(0).alias("truth"), (F.col("value") / 70.3).alias("score"))


@query("threshold_sweep")
def _(spark, sf):
    return rounded(ops.threshold_sweep(scores(spark, sf)))


oracle("threshold_sweep", """, s AS (SELECT CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS truth, value/70.3::DOUBLE AS score FROM events),
    t AS (SELECT round(0.30 + 0.01*i, 2)::DOUBLE AS threshold FROM range(40) r(i)),
    c AS (SELECT threshold, count(*) FILTER (score > threshold AND truth = 1) AS tp, count(*) FILTER (score > threshold AND truth = 0) AS fp, count(*) FILTER (score <= threshold AND truth = 1) AS fn FROM s, t GROUP BY threshold),
    f AS (SELECT *, CASE WHEN tp > 0 THEN 2.0::DOUBLE*tp/(2*tp+fp+fn) ELSE 0.0 END AS f1 FROM c)
    SELECT threshold, tp, fp, fn, round(f1, 6) AS f1, f1 > 0 AND row_number() OVER (ORDER BY f1 DESC, threshold) = 1 AS best FROM f""".replace(", s AS", "WITH s AS", 1))


def verdicts(spark, sf):
    return fixtures.table(spark, sf, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("prediction"))


@query("confusion_matrix")
def _(spark, sf):
    return ops.confusion_matrix(verdicts(spark, sf), [0, 1, 2])


oracle("confusion_matrix", """SELECT a.c AS truth, b.c AS prediction, count(doc_id) AS n FROM (VALUES (0), (1), (2)) a(c) CROSS JOIN (VALUES (0), (1), (2)) b(c)
    LEFT JOIN labels ON quality = a.c AND toxic = b.c GROUP BY 1, 2""")


@query("weighted_f1")
def _(spark, sf):
    return rounded(ops.weighted_f1(verdicts(spark, sf)))


oracle("weighted_f1", """WITH k AS (SELECT c, count(*) FILTER (quality = c) AS support, count(*) FILTER (toxic = c) AS predicted, count(*) FILTER (quality = c AND toxic = c) AS tp FROM labels, (VALUES (0), (1)) v(c) GROUP BY c)
    SELECT round(sum(tp)::DOUBLE/sum(support), 6) AS accuracy, round(sum(2.0::DOUBLE*tp/(support+predicted)*support)/sum(support), 6) AS weighted_f1 FROM k WHERE support > 0""")


@query("class_weights")
def _(spark, sf):
    return rounded(ops.class_weights(fixtures.table(spark, sf, "embeddings").select("label")))


oracle("class_weights", "SELECT label, count(*) AS n, round(count(*)::DOUBLE/sum(count(*)) OVER (), 6) AS share, round(1.0::DOUBLE/count(*), 6) AS weight FROM embeddings GROUP BY label")
