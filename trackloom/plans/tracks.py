"""Track cleaning and kinematics queries."""

from pyspark.sql import functions as F

from trackloom import fixtures
from trackloom.operators import tracks as ops
from trackloom.plans.base import cte, oracle, query, r6, rounded

W, H = fixtures.WIDTH, fixtures.HEIGHT


def normalized(spark, sf):
    return ops.normalize_tracks(fixtures.tracks(spark, sf), W, H)


cte("t_norm", """SELECT *, CASE WHEN cleaned THEN raw_x / 641.0::DOUBLE END AS x, CASE WHEN cleaned THEN raw_y / 359.0::DOUBLE END AS y,
    visibility = 1 AND NOT cleaned AS removed,
    CASE WHEN cleaned OR visibility <> 1 THEN '' WHEN inside THEN 'low_peak' ELSE 'invalid_coordinate' END AS removal_reason
    FROM (SELECT *, inside AND peak >= 0.5 AS cleaned FROM (SELECT *,
      visibility = 1 AND raw_x >= 0 AND raw_x < 641 AND raw_y >= 0 AND raw_y < 359 AS inside FROM v_tracks))""", ("v_tracks",))
cte("t_iso", """SELECT source_id, frame, raw_x, raw_y, visibility, peak, cleaned AND NOT iso AS cleaned, removed OR iso AS removed,
    CASE WHEN iso THEN 'isolated' ELSE removal_reason END AS removal_reason,
    CASE WHEN cleaned AND NOT iso THEN x END AS x, CASE WHEN cleaned AND NOT iso THEN y END AS y
    FROM (SELECT *, cleaned AND sum(CAST(cleaned AS INT)) OVER (PARTITION BY source_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS iso FROM t_norm)""",
    ("t_norm",))
_JUMP = """SELECT source_id, frame, raw_x, raw_y, visibility, peak, cleaned AND NOT cut AS cleaned, removed OR cut AS removed,
    CASE WHEN cut THEN 'single_frame_jump' ELSE removal_reason END AS removal_reason,
    CASE WHEN NOT cut THEN x END AS x, CASE WHEN NOT cut THEN y END AS y
    FROM (SELECT *, jump AND row_number() OVER (PARTITION BY source_id, run ORDER BY frame) % 2 = 1 AS cut
      FROM (SELECT *, CASE WHEN jump THEN frame - row_number() OVER (PARTITION BY source_id, jump ORDER BY frame) END AS run
        FROM (SELECT *, coalesce(sqrt(pow(x-px,2)+pow(y-py,2)) > 0.35 AND sqrt(pow(nx-x,2)+pow(ny-y,2)) > 0.35
                AND sqrt(pow(nx-px,2)+pow(ny-py,2)) <= 0.35, false) AS jump
          FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny
            FROM {src} WINDOW w AS (PARTITION BY source_id ORDER BY frame)))))"""
cte("t_jump0", _JUMP.format(src="t_norm"), ("t_norm",))
cte("t_clean", _JUMP.format(src="t_iso"), ("t_iso",))
cte("t_interp", """SELECT source_id, frame, raw_x, raw_y, visibility, peak, cleaned, removed, removal_reason, coalesce(fill, false) AS interpolated,
    CASE WHEN fill THEN a.x + (frame - a.frame)::DOUBLE / (b.frame - a.frame) * (b.x - a.x) ELSE x END AS x,
    CASE WHEN fill THEN a.y + (frame - a.frame)::DOUBLE / (b.frame - a.frame) * (b.y - a.y) ELSE y END AS y
    FROM (SELECT *, NOT cleaned AND a IS NOT NULL AND b IS NOT NULL AND b.frame - a.frame - 1 <= 12 AS fill
      FROM (SELECT *, last_value(pt IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
          first_value(pt IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
        FROM (SELECT *, CASE WHEN cleaned THEN {'frame': frame, 'x': x, 'y': y} END AS pt FROM t_clean)))""", ("t_clean",))
cte("t_span", """SELECT *, count(*) OVER (PARTITION BY source_id, here, grp) AS n,
      row_number() OVER (PARTITION BY source_id, here, grp ORDER BY frame) - 1 AS pos
    FROM (SELECT *, frame - row_number() OVER (PARTITION BY source_id, here ORDER BY frame) AS grp
      FROM (SELECT *, cleaned OR interpolated AS here FROM t_interp))""", ("t_interp",))


def _fit(axis: str) -> str:
    """Smoothed value from fixed coefficient rows: interior, then the leading and trailing edge rows."""
    fixed = {5: (35, [-3, 12, 17, 12, -3], 35, [[31, 9, -3, -5, 3], [9, 13, 12, 6, -5]]),
             7: (21, [-2, 3, 6, 7, 6, 3, -2], 42,
                 [[32, 15, 3, -4, -6, -3, 5], [15, 12, 9, 6, 3, 0, -3], [3, 9, 12, 12, 9, 3, -6]])}
    at = lambda k: axis if k == 0 else f"{'lag' if k < 0 else 'lead'}({axis}, {abs(k)}) OVER s"
    total = lambda cs, first, div: "(" + " + ".join(f"{c}*{at(first + i)}" for i, c in enumerate(cs)) + f")/{div}.0::DOUBLE"
    whens = []
    for w, cond in ((7, "n >= 7"), (5, "n BETWEEN 5 AND 6")):
        div, mid, ediv, edges = fixed[w]
        for j, row in enumerate(edges):
            whens.append(f"WHEN {cond} AND pos = {j} THEN {total(row, -j, ediv)}")
            whens.append(f"WHEN {cond} AND n - 1 - pos = {j} THEN {total(row[::-1], j - w + 1, ediv)}")
        whens.append(f"WHEN {cond} THEN {total(mid, -(w // 2), div)}")
    return f"CASE WHEN NOT here THEN NULL {' '.join(whens)} ELSE {axis} END"


cte("t_smooth", f"""SELECT *, {_fit('x')} AS smooth_x, {_fit('y')} AS smooth_y
    FROM t_span WINDOW s AS (PARTITION BY source_id, here, grp ORDER BY frame)""", ("t_span",))
cte("t_kin", """SELECT *, sum(speed) OVER (PARTITION BY source_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS cumulative_distance,
      sum(speed) OVER (PARTITION BY source_id ORDER BY frame ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS recent_motion,
      CASE WHEN step IS NOT NULL THEN speed - lag(speed) OVER (PARTITION BY source_id ORDER BY frame) ELSE 0.0::DOUBLE END AS acceleration
    FROM (SELECT *, coalesce(step, 0.0::DOUBLE) AS speed FROM (SELECT *,
      sqrt(pow(smooth_x - lag(smooth_x) OVER w, 2) + pow(smooth_y - lag(smooth_y) OVER w, 2)) AS step
      FROM t_smooth WINDOW w AS (PARTITION BY source_id ORDER BY frame)))""", ("t_smooth",))
cte("t_streak", """SELECT *, CASE WHEN cleaned THEN run ELSE 0 END AS visible_streak, CASE WHEN cleaned THEN 0 ELSE run END AS missing_count
    FROM (SELECT *, row_number() OVER (PARTITION BY source_id, cleaned, grp2 ORDER BY frame) AS run
      FROM (SELECT *, frame - row_number() OVER (PARTITION BY source_id, cleaned ORDER BY frame) AS grp2 FROM t_kin))""", ("t_kin",))

CLEAN_COLUMNS = ["source_id", "frame", "cleaned", "removed", "removal_reason", "x", "y"]
CLEAN_SQL = "SELECT source_id, frame, cleaned, removed, removal_reason, " + r6("x", "y") + " FROM "


@query("normalize_tracks")
def _(spark, sf):
    return rounded(normalized(spark, sf).select(*CLEAN_COLUMNS))


oracle("normalize_tracks", CLEAN_SQL + "t_norm", ("t_norm",))


@query("remove_isolated")
def _(spark, sf):
    return rounded(ops.remove_isolated(normalized(spark, sf)).select(*CLEAN_COLUMNS))


oracle("remove_isolated", CLEAN_SQL + "t_iso", ("t_iso",))


@query("remove_jumps")
def _(spark, sf):
    return rounded(ops.remove_jumps(normalized(spark, sf)).select(*CLEAN_COLUMNS))


oracle("remove_jumps", CLEAN_SQL + "t_jump0", ("t_jump0",))


@query("clean_tracks")
def _(spark, sf):
    return rounded(ops.clean_tracks(normalized(spark, sf)).select(*CLEAN_COLUMNS))


oracle("clean_tracks", CLEAN_SQL + "t_clean", ("t_clean",))


def interpolated(spark, sf):
    return ops.interpolate_gaps(ops.clean_tracks(normalized(spark, sf)))


@query("interpolate_gaps")
def _(spark, sf):
    return rounded(interpolated(spark, sf).select("source_id", "frame", "interpolated", "x", "y"))


oracle("interpolate_gaps", f"SELECT source_id, frame, interpolated, {r6('x', 'y')} FROM t_interp", ("t_interp",))


@query("trajectory_spans")
def _(spark, sf):
    return ops.trajectory_spans(interpolated(spark, sf))


oracle("trajectory_spans", """SELECT source_id, min(frame) AS span_start, max(frame) AS span_end
    FROM t_span WHERE here GROUP BY source_id, grp""", ("t_span",))


@query("smooth_tracks")
def _(spark, sf):
    return rounded(ops.smooth_tracks(interpolated(spark, sf)).select("source_id", "frame", "smooth_x", "smooth_y"))


oracle("smooth_tracks", f"SELECT source_id, frame, {r6('smooth_x', 'smooth_y')} FROM t_smooth", ("t_smooth",))


@query("visibility_streaks")
def _(spark, sf):
    return ops.visibility_streaks(ops.clean_tracks(normalized(spark, sf))).select(
        "source_id", "frame", "visible_streak", "missing_count")


oracle("visibility_streaks", "SELECT source_id, frame, visible_streak, missing_count FROM t_streak", ("t_streak",))


@query("kinematics")
def _(spark, sf):
    return rounded(ops.kinematics(ops.smooth_tracks(interpolated(spark, sf))).select(
        "source_id", "frame", "speed", "acceleration", "cumulative_distance"))


oracle("kinematics", f"SELECT source_id, frame, {r6('speed', 'acceleration', 'cumulative_distance')} FROM t_kin", ("t_kin",))


@query("recent_motion")
def _(spark, sf):
    return rounded(ops.recent_motion(ops.preprocess_tracks(normalized(spark, sf))).select(
        "source_id", "frame", "recent_motion"))


oracle("recent_motion", f"SELECT source_id, frame, {r6('recent_motion')} FROM t_kin", ("t_kin",))

PREP = ["x", "y", "smooth_x", "smooth_y", "speed", "acceleration", "cumulative_distance"]


@query("preprocess_tracks")
def _(spark, sf):
    return rounded(ops.preprocess_tracks(normalized(spark, sf)).select(
        "source_id", "frame", "cleaned", "removed", "removal_reason", "interpolated", "visible_streak",
        "missing_count", *PREP))


oracle("preprocess_tracks", f"""SELECT source_id, frame, cleaned, removed, removal_reason, interpolated, visible_streak,
    missing_count, {r6(*PREP)} FROM t_streak""", ("t_streak",))


def sampled(spark, sf, step=1):
    """Scaled visible points, and the frames to sample them at."""
    seen = F.col("visibility") == 1
    rows = fixtures.tracks(spark, sf).select(
        "source_id", "frame", F.when(seen, F.col("raw_x") / F.lit(float(W))).otherwise(0.0).alias("x"),
        F.when(seen, F.col("raw_y") / F.lit(float(H))).otherwise(0.0).alias("y"),
        seen.cast("double").alias("visible"))
    return rows, rows.filter(F.col("frame") % step == 0).select(
        "source_id", (F.col("frame") / step).cast("long").alias("position"), "frame")


@query("kinematics7")
def _(spark, sf):
    return rounded(ops.kinematics7(*sampled(spark, sf, 2)).drop("position"))


cte("t_kin7", """SELECT source_id, position, frame, x, y, visible, vx, vy,
    CASE WHEN moving AND coalesce(lag(moving) OVER w, false) THEN (vx - lag(vx) OVER w) * 100 ELSE 0.0 END AS ax,
    CASE WHEN moving AND coalesce(lag(moving) OVER w, false) THEN (vy - lag(vy) OVER w) * 100 ELSE 0.0 END AS ay
  FROM (SELECT *, CASE WHEN moving THEN (x - lag(x) OVER w) * 100 ELSE 0.0 END AS vx,
      CASE WHEN moving THEN (y - lag(y) OVER w) * 100 ELSE 0.0 END AS vy
    FROM (SELECT *, visible = 1 AND coalesce(lag(visible) OVER w, 0) = 1 AS moving
      FROM (SELECT source_id, frame, CAST(frame // 2 AS BIGINT) AS position, visibility::DOUBLE AS visible,
          CASE WHEN visibility = 1 THEN raw_x / 641.0::DOUBLE ELSE 0.0::DOUBLE END AS x, CASE WHEN visibility = 1 THEN raw_y / 359.0::DOUBLE ELSE 0.0::DOUBLE END AS y
        FROM v_tracks WHERE frame % 2 = 0)
      WINDOW w AS (PARTITION BY source_id ORDER BY frame))
    WINDOW w AS (PARTITION BY source_id ORDER BY frame))
  WINDOW w AS (PARTITION BY source_id ORDER BY frame)""", ("v_tracks",))
oracle("kinematics7", f"SELECT source_id, frame, {r6('x', 'y', 'visible', 'vx', 'vy', 'ax', 'ay')} FROM t_kin7", ("t_kin7",))
