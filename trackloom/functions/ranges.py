"""Interval joins and interval arithmetic without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.chunks import chunk_of


def points_in_intervals(points: DataFrame, spans: DataFrame, key: str = "source_id", frame: str = "frame",
                        start: str = "start_frame", end: str = "end_frame", width: int = 512,
                        how: str = "inner") -> DataFrame:
    """Pair points with the inclusive spans that hold them.

    Spans are cut at multiples of ``width`` and equi-joined on (key, bin), so a hot key spreads over its
    bins and each task sees only the spans that touch its frames.
    """
    bins = F.explode(F.sequence(chunk_of(start, width), chunk_of(end, width)))
    cut = spans.withColumn("span_bin", bins)
    left = points.withColumn("span_bin", chunk_of(frame, width))
    hit = (left[frame] >= cut[start]) & (left[frame] <= cut[end])
    cond = (left[key] == cut[key]) & (left["span_bin"] == cut["span_bin"]) & hit
    joined = left.join(cut, cond, how)
    return joined.drop(cut[key]).drop("span_bin")


def overlapping(a: DataFrame, b: DataFrame, key: str = "source_id", width: int = 512) -> DataFrame:
    """Pairs of overlapping inclusive intervals (a_start, a_end) x (b_start, b_end) of the same key.

    Both sides are cut into bins; a pair is kept only in the bin where its overlap begins.
    """
    cut = lambda df, p: df.withColumn("ov_bin", F.explode(F.sequence(
        chunk_of(f"{p}_start", width), chunk_of(f"{p}_end", width))))
    pairs = cut(a, "a").join(cut(b, "b"), [key, "ov_bin"])
    begin = F.greatest("a_start", "b_start")
    return pairs.filter((begin <= F.least("a_end", "b_end")) & (chunk_of(begin, width) == F.col("ov_bin"))).drop("ov_bin")


def overlap_length(a_start, a_end, b_start, b_end) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start) + 1)


def merged(df: DataFrame, keys: list[str], start: str = "start_frame", end: str = "end_frame",
           width: int = 1 << 16) -> DataFrame:
    """Union of inclusive intervals per key, as disjoint non-touching-within-a-bin pieces.

    Intervals are cut at multiples of ``width`` and merged inside each (key, bin), so one key is never
    sorted whole. Pieces never overlap; their lengths add up to the covered frame count.
    """
    lo, hi = F.col("piece_bin") * width, (F.col("piece_bin") + 1) * width - 1
    cut = (df.withColumn("piece_bin", F.explode(F.sequence(chunk_of(start, width), chunk_of(end, width))))
             .select(*keys, "piece_bin", F.greatest(F.col(start), lo).alias("piece_start"),
                     F.least(F.col(end), hi).alias("piece_end")))
    w = Window.partitionBy(*keys, "piece_bin").orderBy("piece_start", "piece_end")
    reach = F.max("piece_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (reach.isNull() | (F.col("piece_start") > reach + 1)).cast("int")
    island = F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (cut.withColumn("fresh", fresh).withColumn("island", island)
               .groupBy(*keys, "piece_bin", "island")
               .agg(F.min("piece_start").alias(start), F.max("piece_end").alias(end))
               .drop("island"))
