"""Small hand-made scenarios with known outcomes."""

import pytest
from pyspark.sql import functions as F
from trackloom.operators import evaluate, labels, rallies, tracks
from trackloom.settings import RallySettings


def track(spark, visible, peak=0.9, source=1, step=3):
    rows = [(source, f, int(v), 50 + (step * f) % 400 if v else 0, 100 if v else 0, peak) for f, v in enumerate(visible)]
    return spark.createDataFrame(rows, "source_id long, frame long, visibility int, raw_x long, raw_y long, peak_value double")


def test_rally_start_is_backed_up(spark):
    frames = tracks.preprocess_tracks(tracks.normalize_tracks(track(spark, [0] * 40 + [1] * 90 + [0] * 130), 640, 360))
    row = rallies.segment_rallies(frames, 30.0).collect()
    assert len(row) == 1 and row[0].start_frame == 25 and row[0].rally_id == "1-0001"


def test_two_sources_together_equal_each_alone(spark, small_chunks):
    a, b = track(spark, [1] * 80 + [0] * 120 + [1] * 70), track(spark, ([1] * 9 + [0]) * 20, source=2)
    run = lambda df: {tuple(r) for r in rallies.segment_rallies(tracks.preprocess_tracks(tracks.normalize_tracks(df, 640, 360)), 30.0).collect()}
    assert run(a.unionByName(b)) == run(a) | run(b)


def test_low_peak_and_outside_points_are_named(spark):
    rows = spark.createDataFrame([(1, 0, 1, 10, 10, 0.1), (1, 1, 1, 900, 10, 0.9), (1, 2, 0, 0, 0, None), (1, 3, 1, 10, 10, None)],
                                 "source_id long, frame long, visibility int, raw_x long, raw_y long, peak_value double")
    got = [r.removal_reason for r in tracks.normalize_tracks(rows, 640, 360).orderBy("frame").collect()]
    assert got == ["low_peak", "invalid_coordinate", "", ""]


def test_flicker_loses_every_other_point(spark, small_chunks):
    """A long alternation crosses chunk borders; the parity of the run must carry over."""
    rows = [(1, f, 1, 600 if f % 2 else 20, 100, 0.9) for f in range(120)]
    df = spark.createDataFrame(rows, "source_id long, frame long, visibility int, raw_x long, raw_y long, peak_value double")
    kept = [r.frame for r in tracks.remove_jumps(tracks.normalize_tracks(df, 640, 360)).filter("cleaned").orderBy("frame").collect()]
    assert kept == [f for f in range(120) if f % 2 == 0 or f == 119]


@pytest.mark.parametrize("anchor,fps,count,frames", [(50, 29.97, 100, (35, 64)), (5, 2.5, 10, (4, 6)), (9, 4.0, 10, (6, 9))])
def test_burst_bounds(spark, anchor, fps, count, frames):
    eligible = spark.range(count).select(F.lit(1).cast("long").alias("source_id"), F.col("id").alias("frame"))
    src = spark.createDataFrame([(1, fps)], "source_id long, fps double")
    r = labels.frame_bursts(eligible, src).filter(F.col("anchor_frame") == anchor).first()
    assert (r.start_frame, r.end_frame) == frames


def test_frame_counts(spark):
    cols = "source_id long, start_frame long, end_frame long"
    pred = spark.createDataFrame([(1, 0, 2), (1, 1, 4)], cols)
    label = spark.createDataFrame([(1, 2, 6)], cols)
    ranges = spark.createDataFrame([(1, 0, 9)], "source_id long, range_start long, range_end long")
    r = evaluate.frame_metrics(pred, label, ranges).first()
    assert (r.frame_true_positive, r.frame_false_positive, r.frame_false_negative, r.frame_true_negative) == (3, 2, 2, 3)


def test_padding_is_clamped(spark):
    r = spark.createDataFrame([(1, 10, 90)], "source_id long, start_frame long, end_frame long")
    s = spark.createDataFrame([(1, 30.0, 100)], "source_id long, fps double, frame_count long")
    p = rallies.pad_bounds(r, s, 1.0, 1.0).first()
    assert (p.padded_start, p.padded_end) == (0, 99)


def test_audit_queue_refuses_more_than_fits(spark):
    eligible = spark.range(60).select(F.lit(1).cast("long").alias("source_id"), F.col("id").alias("frame"))
    src = spark.createDataFrame([(1, 30.0)], "source_id long, fps double")
    assert labels.audit_queue(eligible, src, 1, 2).count() == 2
    with pytest.raises(Exception, match="capacity"):
        labels.audit_queue(eligible, src, 1, 3).collect()


def test_settings_scale_with_the_frame_rate():
    s = RallySettings().for_fps(60)
    assert (s.start_confirmation, s.smoothing_window, s.minimum_rally) == (30, 15, 60)
    with pytest.raises(ValueError):
        RallySettings(smoothing_window=4)


def test_mixed_frame_rates_run_in_one_call(spark):
    frames = tracks.preprocess_tracks(tracks.normalize_tracks(track(spark, [1] * 200 + [0] * 200).unionByName(track(spark, [1] * 200 + [0] * 200, source=2)), 640, 360))
    src = spark.createDataFrame([(1, 30.0), (2, 60.0)], "source_id long, fps double")
    out = rallies.per_frame_rate(frames, src, lambda df, fps, s: rallies.segment_rallies(df, fps, s))
    assert {(r.source_id, "non_30_fps" in r.flags) for r in out.collect()} == {(1, False), (2, True)}
