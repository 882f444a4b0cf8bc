"""What looks back without bound is summed up per chunk before the rows are written; rows are built here."""

import random

from pyspark.sql import functions as F
from trackloom.operators import tracks


def test_rows_are_dealt_by_chunk_once(spark, small_chunks):
    """Streaks over many chunks; what is read last has no window left."""
    pick = random.Random(2)
    rows = [(s, f, pick.random() < 0.7) for s in (1, 2, 3) for f in range(200)]
    done = tracks.visibility_streaks(spark.createDataFrame(rows, "source_id long, frame long, cleaned boolean").orderBy(F.rand(4)))
    assert "Window" not in done._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.source_id, r.frame): (r.visible_streak, r.missing_count) for r in done.collect()}
    seen = missing = 0
    for s, f, ok in rows:
        seen, missing = (0, 0) if f == 0 else (seen, missing)
        seen, missing = (seen + 1, 0) if ok else (0, missing + 1)
        assert got[s, f] == (seen, missing)


def test_jumps_alternate_over_chunks(spark, small_chunks):
    """One run of jumps longer than two chunks: every second point of it goes."""
    rows = [(1, f, 0.1 if f % 2 else 0.9, 0.5, True, False, "") for f in range(120)]
    df = spark.createDataFrame(rows, "source_id long, frame long, x double, y double, cleaned boolean, removed boolean, removal_reason string")
    done = tracks.remove_jumps(df)
    assert "Window" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert {r.frame for r in done.filter("removal_reason = 'single_frame_jump'").collect()} == set(range(1, 119, 2))
