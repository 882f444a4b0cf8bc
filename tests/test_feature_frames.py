"""Pose gaps are filled without arrays in windows, and numbers are rounded without decimal text; rows are built here."""

import math
import random

from pyspark.sql import functions as F
from trackloom.operators import features
from trackloom.plans.base import rounded


def test_pose_gaps_are_found_by_position_alone(spark, small_chunks):
    """Gaps within and across chunks, at both ends, in a source without poses and in one without an id."""
    pick, rows = random.Random(5), []
    for source, size, share in ((1, 200, 0.1), (2, 150, 0.0), (3, 90, 0.9), (4, 1, 1.0), (None, 30, 0.3)):
        rows += [(source, p, [pick.random(), pick.random()] if pick.random() < share else None) for p in range(size)]
    filled = features.fill_pose_gaps(spark.createDataFrame(rows, "source_id long, position long, pose array<double>").orderBy(F.rand(2)), 2)
    assert "Window" not in filled._jdf.queryExecution().optimizedPlan().toString()  # done over positions, before arrays are looked up
    got = {(r.source_id, r.position): r.pose for r in filled.collect()}
    assert len(got) == len(rows)
    for source, p, pose in rows:
        known = [(q, v) for s, q, v in rows if s == source and v is not None]
        ends = [x for x in (max((k for k in known if k[0] <= p), default=None), min((k for k in known if k[0] >= p), default=None)) if x]
        want = pose or ([sum(v) / len(ends) for v in zip(*(v for _, v in ends))] if ends else [0.0, 0.0])
        assert got[source, p] == want, (source, p)


def test_rounding_is_that_of_decimal_text(spark):
    pick = random.Random(1)
    values = [None, 0.0, -0.0, math.nan, math.inf, -math.inf, 1e300, 5e-7, -5e-7, 4.9999999e-7, 0.1234565, 1.0000005, 123456789.1234565, 999999.9999995, 1e6, 1e12]
    values += [pick.choice((-1, 1)) * (k + 0.5) / 10 ** 6 for k in range(500)] + [pick.uniform(-10, 10) ** pick.randint(1, 9) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    both = df.select("v", (F.round("v", 6) + F.lit(0.0)).alias("want"))
    assert rounded(both).filter(~F.col("v").eqNullSafe(F.col("want"))).count() == 0
