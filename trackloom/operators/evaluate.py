"""Interval and classification metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.components import connected_components
from trackloom.functions.ranges import merged, overlap_length, overlapping
from trackloom.session import materialize


def _overlaps(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    a = predictions.select("source_id", F.col("rally_id").alias("prediction_rally_id"),
                           F.col("start_frame").alias("a_start"), F.col("end_frame").alias("a_end"))
    b = labels.select("source_id", F.col("rally_id").alias("label_rally_id"),
                      F.col("start_frame").alias("b_start"), F.col("end_frame").alias("b_end"))
    return overlapping(a, b)


def interval_iou(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Inclusive IoU of every overlapping (prediction, label) pair of a source."""
    both = overlap_length("a_start", "a_end", "b_start", "b_end")
    union = (F.col("a_end") - F.col("a_start") + F.col("b_end") - F.col("b_start") + 2) - both
    return _overlaps(predictions, labels).withColumn("iou", both / union)


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-total one-to-one assignment of a gain matrix (shortest augmenting paths, O(n^3))."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        best, via, seen = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[j]:
            seen[j] = True
            free = ~seen[1:]
            slack = cost[owner[j] - 1] - u[owner[j]] - v[1:]
            closer = free & (slack < best[1:])
            best[1:][closer], via[1:][closer] = slack[closer], j
            nxt = int(np.argmin(np.where(free, best[1:], np.inf))) + 1
            step = best[nxt]
            u[owner[seen]] += step
            v[seen] -= step
            best[1:][free] -= step
            j = nxt
        while j:
            owner[j], j = owner[via[j]], via[j]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return [(j, i) for i, j in pairs] if flip else pairs


def match_intervals(predictions: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Assignment of maximum total IoU, thresholded afterwards; unmatched rows are kept with their side.

    Pairs that do not overlap add nothing to the total, so every overlap-connected component is solved
    alone. A component of one pair needs no search; rally ids are unique per source and side.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    pairs = materialize(interval_iou(predictions, labels), "pairs")
    # rally ids may repeat over sources; the separator keeps (1, 23) and (12, 3) apart
    node = lambda side, c: F.concat_ws("\x1f", F.lit(side), F.col("source_id").cast("string"), F.col(c).cast("string"))
    edges = pairs.select(node("p", "prediction_rally_id").alias("a"), node("l", "label_rally_id").alias("b"))
    groups = connected_components(edges).withColumnRenamed("node", "a")
    pairs = pairs.withColumn("a", node("p", "prediction_rally_id")).join(groups, "a").drop("a")
    sizes = pairs.groupBy("component").agg(F.count(F.lit(1)).alias("pairs_in"))
    pairs = pairs.join(sizes, "component")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["prediction_rally_id", "label_rally_id"]).reset_index(drop=True)
        rows, columns = (pdf[c].astype("category").cat.codes.to_numpy() for c in ("prediction_rally_id", "label_rally_id"))
        gain = np.zeros((rows.max() + 1, columns.max() + 1))
        gain[rows, columns] = pdf["iou"]
        chosen = set(best_assignment(gain))
        return pdf[[(r, c) in chosen for r, c in zip(rows, columns)]]

    columns = [c for c in pairs.columns if c not in ("component", "pairs_in")]
    alone = pairs.filter("pairs_in = 1").select(*columns)
    searched = pairs.filter("pairs_in > 1").groupBy("component").applyInPandas(assign, pairs.schema).select(*columns)
    chosen = alone.unionByName(searched).filter(F.col("iou") >= threshold).select(
        "source_id", "prediction_rally_id", "label_rally_id", F.round("iou", 6).alias("iou"),
        (F.col("a_start") - F.col("b_start")).alias("start_error"), (F.col("a_end") - F.col("b_end")).alias("end_error"),
        F.lit("matched").alias("match_status"))
    chosen = materialize(chosen, "matches")
    none = F.lit(None)

    def rest(side: DataFrame, mine: str, other: str, status: str) -> DataFrame:
        kind = dict(chosen.dtypes)[other]
        return side.withColumnRenamed("rally_id", mine).join(chosen.select("source_id", mine), ["source_id", mine], "left_anti").select(
            "source_id", mine, none.cast(kind).alias(other), F.lit(0.0).alias("iou"), none.cast("long").alias("start_error"),
            none.cast("long").alias("end_error"), F.lit(status).alias("match_status"))

    return (chosen.unionByName(rest(predictions, "prediction_rally_id", "label_rally_id", "unmatched_prediction"))
                  .unionByName(rest(labels, "label_rally_id", "prediction_rally_id", "unmatched_label")))


def interval_metrics(matches: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of precision, recall, F1 and boundary errors."""
    count = lambda status: F.count(F.when(F.col("match_status") == status, 1))
    both = F.array(F.abs("start_error"), F.abs("end_error"))
    errors = matches.filter("match_status = 'matched'").select(F.explode(both).alias("e")).agg(
        F.avg("e").alias("mean_absolute_boundary_error"), F.expr("percentile(e, 0.5)").alias("median_absolute_boundary_error"))
    totals = matches.agg(
        count("matched").alias("matched_count"), count("unmatched_prediction").alias("unmatched_prediction_count"),
        count("unmatched_label").alias("unmatched_label_count"),
        F.avg("start_error").alias("mean_start_boundary_error"), F.avg("end_error").alias("mean_end_boundary_error"))
    m, p, l = F.col("matched_count"), F.col("prediction_count"), F.col("label_count")
    return (totals.withColumn("iou_threshold", F.lit(threshold))
            .withColumn("prediction_count", m + F.col("unmatched_prediction_count"))
            .withColumn("label_count", m + F.col("unmatched_label_count"))
            .withColumns(_prf(m, p, l)).join(errors))  # two one-row aggregates


def _prf(hit, predicted, actual, prefix: str = "") -> dict:
    """precision, recall and F1 with empty denominators counted as 0."""
    return {f"{prefix}precision": F.when(predicted > 0, hit / predicted).otherwise(0.0),
            f"{prefix}recall": F.when(actual > 0, hit / actual).otherwise(0.0),
            f"{prefix}f1": F.when(hit > 0, 2 * hit / (predicted + actual)).otherwise(0.0)}


def split_merge_counts(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels hit by several predictions (splits) and predictions hitting several labels (merges)."""
    pairs = _overlaps(predictions, labels)
    many = lambda key, name: (pairs.groupBy("source_id", key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                              .select(F.lit(name).alias("kind")))
    kinds = many("label_rally_id", "split").unionByName(many("prediction_rally_id", "merge"))
    count = lambda k: F.count(F.when(F.col("kind") == k, 1))
    return kinds.agg(count("split").alias("false_split_count"), count("merge").alias("false_merge_count"))


def frame_metrics(predictions: DataFrame, labels: DataFrame, ranges: DataFrame) -> DataFrame:
    """Frame-level counts inside the inclusive source ranges, by interval arithmetic.

    ``ranges``: source_id, range_start, range_end. Overlapping intervals of a side count once.
    """
    def covered(side: DataFrame, p: str) -> DataFrame:
        cut = side.join(ranges, "source_id").select(
            "source_id", F.greatest("start_frame", "range_start").alias("start_frame"),
            F.least("end_frame", "range_end").alias("end_frame")).filter("start_frame <= end_frame")
        pieces = merged(cut, ["source_id"])
        return pieces.select("source_id", F.col("start_frame").alias(f"{p}_start"), F.col("end_frame").alias(f"{p}_end"))

    a, b = covered(predictions, "a"), covered(labels, "b")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    hit = overlapping(a, b).agg(zero(overlap_length("a_start", "a_end", "b_start", "b_end")).alias("tp"))
    predicted = a.agg(zero(F.col("a_end") - F.col("a_start") + 1).alias("p"))
    actual = b.agg(zero(F.col("b_end") - F.col("b_start") + 1).alias("l"))
    total = ranges.agg(zero(F.col("range_end") - F.col("range_start") + 1).alias("t"))
    row = hit.join(predicted).join(actual).join(total)  # four one-row aggregates
    tp, p, l, t = (F.col(c) for c in ("tp", "p", "l", "t"))
    return row.select(tp.alias("frame_true_positive"), (p - tp).alias("frame_false_positive"), (l - tp).alias("frame_false_negative"),
                      (t - p - l + tp).alias("frame_true_negative"), *[c.alias(n) for n, c in _prf(tp, p, l, "frame_").items()])


# -- classification ---------------------------------------------------------------------------

SWEEP = [round(0.30 + 0.01 * i, 2) for i in range(40)]


def threshold_sweep(scores: DataFrame, thresholds: list[float] = SWEEP) -> DataFrame:
    """F1 of ``score > t`` at each threshold; ``best`` marks the first maximum.

    Rows are reduced to a histogram over (truth, number of thresholds passed) before any per-threshold
    work, so the data is read once and never multiplied.
    """
    grid = sorted(thresholds)
    # grid is sorted, so the count of thresholds below the score says which ones it passes
    passed = F.aggregate(F.array(*[F.lit(t) for t in grid]), F.lit(0), lambda n, t: n + F.when(F.col("score") > t, 1).otherwise(0))
    histogram = scores.select(F.col("truth"), passed.alias("passed")).groupBy("truth", "passed").agg(F.count(F.lit(1)).alias("n"))
    table = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])
    rows = histogram.select("truth", "passed", "n", F.inline(table))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    over = F.col("passed") > F.col("rank")
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    result = rows.groupBy("rank", "threshold").agg(
        count(over & (F.col("truth") == 1)).alias("tp"), count(over & (F.col("truth") != 1)).alias("fp"),
        count(~over & (F.col("truth") == 1)).alias("fn")).withColumn("f1", f1)
    # at most one row per threshold from here on
    first = result.filter("f1 > 0").agg(F.max_by("rank", F.struct("f1", -F.col("rank"))).alias("top"))
    return result.join(F.broadcast(first)).select(
        "threshold", "tp", "fp", "fn", "f1", F.coalesce(F.col("rank") == F.col("top"), F.lit(False)).alias("best"))


def confusion_matrix(pairs: DataFrame, classes: list) -> DataFrame:
    """Zero-filled (truth, prediction) counts over a fixed class list."""
    counts = pairs.groupBy("truth", "prediction").agg(F.count(F.lit(1)).alias("n"))
    values = F.array(*[F.lit(c) for c in classes])
    grid = (pairs.sparkSession.range(1).select(F.explode(values).alias("truth"))
            .withColumn("prediction", F.explode(values)))
    return grid.join(counts, ["truth", "prediction"], "left").na.fill(0, ["n"])


def weighted_f1(pairs: DataFrame) -> DataFrame:
    """Accuracy and support-weighted F1 over the classes present."""
    counts = pairs.groupBy("truth", "prediction").agg(F.count(F.lit(1)).alias("n"))
    hit = F.sum(F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0))
    actual = counts.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    predicted = counts.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    rows = actual.join(predicted, "label", "left").na.fill(0, ["predicted"])
    f1 = 2 * F.col("tp") / (F.col("support") + F.col("predicted"))
    return rows.agg((F.sum("tp") / F.sum("support")).alias("accuracy"),
                    (F.sum(f1 * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def class_weights(labels: DataFrame) -> DataFrame:
    """Count, share and inverse-frequency weight of each class."""
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row per class
    return counts.select("label", "n", (F.col("n") / total).alias("share"), (1.0 / F.col("n")).alias("weight"))
