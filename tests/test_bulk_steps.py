"""Steps that must not cost a Python call, a copy or a repeated expression per group; rows are built here."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from trackloom import folds
from trackloom.operators import candidates, court


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_groups_of_sorted_batches_stay_whole():
    rows = [(None, 0)] * 3 + [(None, 1)] + [(1, 0)] * 5 + [(1, 2)] * 2 + [(7, 0)]
    for size in (1, 2, 3, 5, 100):
        batches = [pa.RecordBatch.from_pylist([{"source_id": s, "chunk_no": c, "at": i} for i, (s, c) in list(enumerate(rows))[k:k + size]],
                                              schema=pa.schema([("source_id", pa.int64()), ("chunk_no", pa.int64()), ("at", pa.int64())]))
                   for k in range(0, len(rows), size)]
        found = [t["at"].to_pylist()[a:b] for t, bounds in folds.whole_blocks(batches, ["source_id", "chunk_no"]) for a, b in zip(bounds, bounds[1:])]
        assert found == [[0, 1, 2], [3], [4, 5, 6, 7, 8], [9, 10], [11]], size


def test_nulls_of_one_group_leave_the_numbers_of_others_whole():
    table = pa.table({"a": pa.array([2**53 + 1, None, 3], pa.int64())})
    first, second = folds.group_frames(table, np.array([0, 1, 3]), ["a"])
    assert first["a"].tolist() == [2**53 + 1] and pd.isna(second["a"].iloc[0])


def test_fold_deals_sorted_chunks(spark, small_chunks):
    """A running sum as a machine: every chunk guesses wrong, and the rows of a frame come in order."""
    def machine(pdf, entry):
        sums = (int(entry) + pdf["v"].cumsum()).tolist()
        return {"frame": pdf["frame"].tolist(), "sum": sums}, str(sums[-1] if sums else entry)
    rows = [(s, f, (f * 7 + s) % 5) for s in range(6) for f in range(100 + s)]
    got, exits = folds.fold(spark.createDataFrame(rows, "source_id long, frame long, v long").orderBy(F.rand(3)), machine, "0", "frame long, sum long", warmup=3)
    want = {(s, f): sum((g * 7 + s) % 5 for g in range(f + 1)) for s in range(6) for f in range(100 + s)}
    assert {(r.source_id, r.frame): r["sum"] for r in got.collect()} == want
    assert {r.source_id: int(r.exit_state) for r in exits.collect()} == {s: want[s, 99 + s] for s in range(6)}


def test_court_regions_do_not_repeat_the_inverse(spark):
    cal = spark.createDataFrame([(1, 1280, 720, 0.01, 0.001, -3.2, 0.0005, 0.02, -3.6, 0.00001, 0.0003, 1.0)],
                                "source_id long, width int, height int, " + ", ".join(f"h{i} double" for i in range(9)))
    regions = court.court_regions(cal)
    assert len(plan(regions)) < 100_000
    row, m = regions.first(), np.linalg.inv(np.array([[0.01, 0.001, -3.2], [0.0005, 0.02, -3.6], [0.00001, 0.0003, 1.0]]))
    at = np.array([[x, y, 1.0] for x in (-3.05, 3.05) for y in (-6.7, 6.7)]) @ m.T
    x = at[:, 0] / at[:, 2]
    assert np.isclose(row.x_lo, x.min() - (x.max() - x.min()) * court.RallySettings.court_tolerance)


def test_maps_are_labelled_by_the_batch(spark):
    rows = [(s, f, x, y, 0.9) for s in range(3) for f in range(40) for x, y in ((0, 0), (1, 1), (4, 4))]
    found = candidates.extract_components(spark.createDataFrame(rows, "source_id long, frame long, x long, y long, value double"), 640, 360, 8, 8)
    assert "FlatMapGroupsInPandas" not in plan(found)
    areas = found.filter("threshold = 0.5").groupBy("source_id", "frame").agg(F.array_sort(F.collect_list("area")).alias("a")).collect()
    assert len(areas) == 120 and all(r.a == [1, 2] for r in areas)
