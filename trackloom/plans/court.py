"""Court projection and region-signal queries."""

from pyspark.sql import functions as F

from trackloom import fixtures
from trackloom.functions import geometry as geo
from trackloom.operators import court as ops
from trackloom.plans import tracks as track_plans
from trackloom.plans.base import cte, oracle, query, r6, rounded


def values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in r) + ")" for r in rows)


cte("v_cal", """SELECT s_suppkey AS source_id, 0.01::DOUBLE AS h0, 0.001::DOUBLE AS h1, -3.2::DOUBLE - (s_suppkey % 5)::DOUBLE/100 AS h2,
    0.0005::DOUBLE AS h3, 0.02::DOUBLE AS h4, -3.6::DOUBLE AS h5, 0.00001::DOUBLE AS h6, 0.0003::DOUBLE AS h7, 1.0::DOUBLE AS h8 FROM supplier""")
# inverse by Cramer's rule; projecting needs the matrix up to scale only
cte("v_inv", """SELECT *, h4*h8-h5*h7 AS i0, h2*h7-h1*h8 AS i1, h1*h5-h2*h4 AS i2, h5*h6-h3*h8 AS i3, h0*h8-h2*h6 AS i4,
    h2*h3-h0*h5 AS i5, h3*h7-h4*h6 AS i6, h1*h6-h0*h7 AS i7, h0*h4-h1*h3 AS i8 FROM v_cal""", ("v_cal",))
cte("v_landmarks", "SELECT * FROM (VALUES " + values(geo.court_landmark_rows()) + ") t(landmark, court_x, court_y)")
cte("v_lines", "SELECT * FROM (VALUES " + values(geo.court_line_rows()) + ") t(line, axis, court_at)")
cte("v_segments", "SELECT * FROM (VALUES " + values(geo.court_segment_rows()) + ") t(cx1, cy1, cx2, cy2)")


def fwd(x, y):
    return (f"(h0*{x}+h1*{y}+h2)/(h6*{x}+h7*{y}+h8)", f"(h3*{x}+h4*{y}+h5)/(h6*{x}+h7*{y}+h8)")


def inv(x, y):
    return (f"(i0*{x}+i1*{y}+i2)/(i6*{x}+i7*{y}+i8)", f"(i3*{x}+i4*{y}+i5)/(i6*{x}+i7*{y}+i8)")


def pixels(spark, sf):
    return fixtures.tracks(spark, sf).filter("visibility = 1").select(
        "source_id", "frame", F.col("raw_x").cast("double").alias("image_x"), F.col("raw_y").cast("double").alias("image_y"))


cte("v_pixels", "SELECT source_id, frame, raw_x::DOUBLE AS image_x, raw_y::DOUBLE AS image_y FROM v_tracks WHERE visibility = 1", ("v_tracks",))


@query("read_calibrations_checked")
def _(spark, sf):
    """Calibrations with some made invalid, validated."""
    k = F.col("source_id")
    cal = fixtures.calibrations(spark, sf)
    cal = cal.select("source_id", F.when(k % 11 == 0, 2).otherwise(1).alias("version"), "h0", "h1", "h2", "h3",
                     F.when(k % 7 == 0, 0.0).otherwise(F.col("h4")).alias("h4"), "h5", "h6",
                     F.when(k % 7 == 0, 0.0).otherwise(F.col("h7")).alias("h7"),
                     F.when(k % 5 == 0, 2.0).otherwise(F.col("h8")).alias("h8"),
                     "width", F.when(k % 13 == 0, 0).otherwise(F.col("height")).alias("height"))
    cal = cal.withColumn("h1", F.when(k % 7 == 0, 0.0).otherwise(F.col("h1")))
    return rounded(ops.validate_calibrations(cal).select("source_id", "error", "h0", "h2", "h4", "h8"), 9)


oracle("read_calibrations_checked", """SELECT source_id, error, round(CASE WHEN error IS NULL THEN h0/h8 ELSE h0 END, 9) + 0.0 AS h0,
      round(CASE WHEN error IS NULL THEN h2/h8 ELSE h2 END, 9) + 0.0 AS h2, round(CASE WHEN error IS NULL THEN h4/h8 ELSE h4 END, 9) + 0.0 AS h4,
      round(CASE WHEN error IS NULL THEN 1.0::DOUBLE ELSE h8 END, 9) + 0.0 AS h8
    FROM (SELECT *, CASE WHEN source_id % 11 = 0 THEN 'unsupported_version'
        WHEN abs(h0*(h4*h8-h5*h7) - h1*(h3*h8-h5*h6) + h2*(h3*h7-h4*h6)) < 1e-12 THEN 'singular_matrix'
        WHEN source_id % 13 = 0 THEN 'invalid_image_size' END AS error
      FROM (SELECT source_id, h0, CASE WHEN source_id % 7 = 0 THEN 0.0 ELSE h1 END AS h1, h2, h3, CASE WHEN source_id % 7 = 0 THEN 0.0 ELSE h4 END AS h4, h5, h6,
        CASE WHEN source_id % 7 = 0 THEN 0.0 ELSE h7 END AS h7, CASE WHEN source_id % 5 = 0 THEN 2.0 ELSE h8 END AS h8 FROM v_cal))""", ("v_cal",))


@query("project_to_court")
def _(spark, sf):
    return rounded(ops.project_to_court(pixels(spark, sf), fixtures.calibrations(spark, sf)).select(
        "source_id", "frame", "court_x", "court_y", "at_infinity"))


_X, _Y = fwd("image_x", "image_y")
cte("v_court", f"SELECT p.source_id, p.frame, {_X} AS court_x, {_Y} AS court_y FROM v_pixels p JOIN v_cal c USING (source_id)", ("v_pixels", "v_cal"))
oracle("project_to_court", f"SELECT source_id, frame, {r6('court_x', 'court_y')}, false AS at_infinity FROM v_court", ("v_court",))


@query("project_to_image")
def _(spark, sf):
    cal = fixtures.calibrations(spark, sf)
    points = ops.project_to_court(pixels(spark, sf), cal).select(
        "source_id", "frame", (F.col("court_x") * 0.9).alias("court_x"), (F.col("court_y") * 0.9).alias("court_y"))
    return rounded(ops.project_to_image(points, cal).select("source_id", "frame", "image_x", "image_y"))


_IX, _IY = inv("court_x", "court_y")
oracle("project_to_image", f"""SELECT source_id, frame, {r6('image_x', 'image_y')} FROM (SELECT source_id, frame, {_IX} AS image_x, {_IY} AS image_y
    FROM (SELECT source_id, frame, court_x*0.9::DOUBLE AS court_x, court_y*0.9::DOUBLE AS court_y FROM v_court) JOIN v_inv USING (source_id))""", ("v_court", "v_inv"))


@query("project_normalized")
def _(spark, sf):
    points = pixels(spark, sf).select("source_id", "frame", (F.col("image_x") / 700).alias("nx"), (F.col("image_y") / 400).alias("ny"))
    return rounded(ops.project_normalized(points, fixtures.calibrations(spark, sf)).select("source_id", "frame", "court_x", "court_y"))


_NX, _NY = fwd("nx", "ny")
oracle("project_normalized", f"""SELECT source_id, frame, {r6('court_x', 'court_y')} FROM (SELECT source_id, frame, {_NX} AS court_x, {_NY} AS court_y
    FROM (SELECT source_id, frame, image_x/700*641 AS nx, image_y/400*359 AS ny FROM v_pixels) JOIN v_cal USING (source_id))""", ("v_pixels", "v_cal"))


@query("court_landmarks")
def _(spark, sf):
    return rounded(ops.landmark_positions(fixtures.calibrations(spark, sf)), 5)


_LANDMARK_SQL = f"SELECT source_id, landmark, court_x, court_y, {_IX} AS image_x, {_IY} AS image_y FROM v_landmarks, v_inv"
cte("v_placed", _LANDMARK_SQL, ("v_landmarks", "v_inv"))
r5 = lambda *cs: ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in cs)
oracle("court_landmarks", f"SELECT source_id, landmark, {r5('court_x', 'court_y', 'image_x', 'image_y')} FROM v_placed", ("v_placed",))


@query("court_lines")
def _(spark, sf):
    return rounded(ops.line_positions(fixtures.calibrations(spark, sf)), 5)


_A = inv("(CASE WHEN axis='x' THEN court_at ELSE -3.05 END)", "(CASE WHEN axis='x' THEN -6.7 ELSE court_at END)")
_B = inv("(CASE WHEN axis='x' THEN court_at ELSE 3.05 END)", "(CASE WHEN axis='x' THEN 6.7 ELSE court_at END)")
cte("v_line_px", f"""SELECT source_id, line, axis, court_at, {_A[0]} AS x1, {_A[1]} AS y1, {_B[0]} AS x2, {_B[1]} AS y2
    FROM v_lines, v_inv""", ("v_lines", "v_inv"))
oracle("court_lines", f"SELECT source_id, line, axis, {r5('court_at', 'x1', 'y1', 'x2', 'y2')} FROM v_line_px", ("v_line_px",))


@query("court_segments")
def _(spark, sf):
    return rounded(ops.segment_positions(fixtures.calibrations(spark, sf)), 5)


_A, _B = inv("cx1", "cy1"), inv("cx2", "cy2")
oracle("court_segments", f"""SELECT source_id, {r5('cx1', 'cy1', 'cx2', 'cy2', 'x1', 'y1', 'x2', 'y2')} FROM (SELECT *, {_A[0]} AS x1, {_A[1]} AS y1,
    {_B[0]} AS x2, {_B[1]} AS y2 FROM v_segments, v_inv)""", ("v_segments", "v_inv"))


def observed_landmarks(spark, sf):
    """Landmark clicks: the true position plus a small offset that depends on the source and the name."""
    off = ((F.col("source_id") * 7 + F.length("landmark") * 3) % 11).cast("double") * 0.437
    return ops.landmark_positions(fixtures.calibrations(spark, sf)).select(
        "source_id", "landmark", "court_x", "court_y", (F.col("image_x") + off).alias("image_x"), "image_y")


@query("reprojection_errors")
def _(spark, sf):
    observed = observed_landmarks(spark, sf).select("source_id", "landmark", "image_x", "image_y")
    return rounded(ops.reprojection_errors(observed, fixtures.calibrations(spark, sf)).select(
        "source_id", "landmark", "error_px", "inlier"), 5)


cte("v_reproj", """SELECT source_id, landmark, ((source_id*7 + length(landmark)*3) % 11)*0.437::DOUBLE AS error_px
    FROM v_landmarks, v_cal""", ("v_landmarks", "v_cal"))
oracle("reprojection_errors", f"SELECT source_id, landmark, {r5('error_px')}, error_px <= 3 AS inlier FROM v_reproj", ("v_reproj",))


@query("reprojection_report")
def _(spark, sf):
    observed = observed_landmarks(spark, sf).select("source_id", "landmark", "image_x", "image_y")
    return rounded(ops.reprojection_report(ops.reprojection_errors(observed, fixtures.calibrations(spark, sf))), 5)


oracle("reprojection_report", """SELECT source_id, count(*) AS landmarks, CAST(sum(CASE WHEN error_px <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS inliers,
    round(avg(CASE WHEN error_px <= 3 THEN error_px END), 5) + 0.0 AS mean_inlier_error FROM v_reproj GROUP BY source_id""", ("v_reproj",))


@query("line_intersections")
def _(spark, sf):
    return rounded(ops.line_intersections(ops.line_positions(fixtures.calibrations(spark, sf))), 5)


oracle("line_intersections", f"""SELECT source_id, line_x || '__' || line_y AS intersection, CAST(NULL AS VARCHAR) AS error, {r5('court_x', 'court_y', 'image_x', 'image_y')}
    FROM (SELECT source_id, u.line AS line_x, v.line AS line_y, u.court_at AS court_x, v.court_at AS court_y,
        {inv('u.court_at', 'v.court_at')[0]} AS image_x, {inv('u.court_at', 'v.court_at')[1]} AS image_y
      FROM v_lines u, v_lines v, v_inv WHERE u.axis = 'x' AND v.axis = 'y')""", ("v_lines", "v_inv"))


@query("fit_calibrations")
def _(spark, sf):
    corners = [n for n, _, _ in geo.court_landmark_rows() if n.endswith(("doubles", "center"))]
    points = observed_landmarks(spark, sf).filter(F.col("landmark").isin(corners)).withColumnRenamed("landmark", "name")
    return rounded(ops.fit_calibrations(points), 5)


@query("resolve_clip_source")
def _(spark, sf):
    orders, k, c = fixtures.table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    clips = orders.select(
        F.when(k % 5 == 0, F.concat(F.lit("rally/Clip-S"), c % 40, F.lit("x"), k, F.lit("_pose.json")))
         .when(k % 5 == 1, F.concat(F.lit("Clip-S"), c % 40, F.lit("_"), k, F.lit("_features.npy")))
         .when(k % 5 == 2, F.concat(F.lit("s"), c % 40, F.lit("-s"), k % 40, F.lit("."), k, F.lit(".mp4")))
         .otherwise(F.concat(F.lit("a/b_s"), c % 40, F.lit("_"), k, F.lit("_pose"))).alias("clip"))
    ids = fixtures.table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("source"))
    overrides = orders.filter("o_orderkey % 10 = 3").select(
        F.concat(F.lit("b_s"), c % 40, F.lit("_"), k).alias("clip"), F.concat(F.lit("s"), k % 60).alias("source"))
    return ops.resolve_clip_source(clips, ids, overrides)


oracle("resolve_clip_source", """WITH clips AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'rally/Clip-S' || (o_custkey % 40) || 'x' || o_orderkey || '_pose.json'
      WHEN 1 THEN 'Clip-S' || (o_custkey % 40) || '_' || o_orderkey || '_features.npy' WHEN 2 THEN 's' || (o_custkey % 40) || '-s' || (o_orderkey % 40) || '.' || o_orderkey || '.mp4'
      ELSE 'a/b_s' || (o_custkey % 40) || '_' || o_orderkey || '_pose' END AS clip,
      CASE o_orderkey % 5 WHEN 0 THEN 'clip-s' || (o_custkey % 40) || 'x' || o_orderkey WHEN 1 THEN 'clip-s' || (o_custkey % 40) || '_' || o_orderkey
      WHEN 2 THEN 's' || (o_custkey % 40) || '-s' || (o_orderkey % 40) || '.' || o_orderkey ELSE 'b_s' || (o_custkey % 40) || '_' || o_orderkey END AS key,
      CASE WHEN o_orderkey % 10 = 3 THEN 's' || (o_orderkey % 60) END AS forced FROM orders),
    m AS (SELECT key, count(*) AS n, min('s' || s_suppkey) AS found FROM (SELECT DISTINCT key FROM clips), supplier
      WHERE regexp_matches(key, '(^|[^a-z0-9])s' || s_suppkey || '($|[^a-z0-9])') GROUP BY key)
    SELECT clip, CASE WHEN error IS NULL THEN coalesce(forced, found) END AS source, error FROM (
      SELECT clip, forced, found, CASE WHEN forced IS NOT NULL AND forced NOT IN (SELECT 's' || s_suppkey FROM supplier) THEN 'unknown_override_source'
        WHEN forced IS NULL AND n IS NULL THEN 'no_source' WHEN forced IS NULL AND n > 1 THEN 'ambiguous_source' END AS error
      FROM clips LEFT JOIN m USING (key))""")


def tracks_inside(spark, sf):
    return ops.shuttle_inside_region(track_plans.ops.clean_tracks(track_plans.normalized(spark, sf)), fixtures.calibrations(spark, sf))


@query("shuttle_inside_region")
def _(spark, sf):
    return tracks_inside(spark, sf).select("source_id", "frame", "inside_courtish")


_C = [inv(x, y) for x, y in (("-3.05", "-6.7"), ("3.05", "-6.7"), ("3.05", "6.7"), ("-3.05", "6.7"))]
cte("v_region", f"""SELECT source_id, xa - 0.2*(xb-xa) AS x_lo, xb + 0.2*(xb-xa) AS x_hi, ya - 0.2*(yb-ya) AS y_lo, yb + 0.2*(yb-ya) AS y_hi
    FROM (SELECT source_id, least({', '.join(c[0] for c in _C)}) AS xa, greatest({', '.join(c[0] for c in _C)}) AS xb,
      least({', '.join(c[1] for c in _C)}) AS ya, greatest({', '.join(c[1] for c in _C)}) AS yb FROM v_inv)""", ("v_inv",))
cte("v_inside", """SELECT source_id, frame, CASE WHEN cleaned THEN raw_x BETWEEN x_lo AND x_hi AND raw_y BETWEEN y_lo AND y_hi END AS inside_courtish
    FROM t_clean LEFT JOIN v_region USING (source_id)""", ("t_clean", "v_region"))
oracle("shuttle_inside_region", "SELECT * FROM v_inside", ("v_inside",))

cte("v_players", """SELECT source_id, rn AS frame, (q % 5 <> 0)::INT::DOUBLE AS player1_valid, (d <> 3)::INT::DOUBLE AS player2_valid,
    (pk % 640)::DOUBLE AS player1_foot_x, ((q*7) % 180)::DOUBLE AS player1_foot_y, ((pk*3) % 640)::DOUBLE AS player2_foot_x, (180 + (q*5) % 180)::DOUBLE AS player2_foot_y,
    (q % 20)::DOUBLE/47 AS player1_activity, (pk % 20)::DOUBLE/47 AS player2_activity, ((q % 20) + (pk % 20))::DOUBLE/47 AS player_activity FROM v_rows""", ("v_rows",))
_P1, _P2 = fwd("player1_foot_x", "player1_foot_y"), fwd("player2_foot_x", "player2_foot_y")
cte("v_on_court", f"""SELECT source_id, frame, on1::INT + on2::INT AS player_court_count, on1 OR on2 AS players_on_courtish,
    ((on1 AND y1 <= -1.98+0.2) OR (on2 AND y2 <= -1.98+0.2)) AND ((on1 AND y1 >= 1.98-0.2) OR (on2 AND y2 >= 1.98-0.2)) AS players_opposite_service_regions
    FROM (SELECT *, player1_valid > 0 AND abs(x1) <= 3.25 AND abs(y1) <= 6.9 AS on1, player2_valid > 0 AND abs(x2) <= 3.25 AND abs(y2) <= 6.9 AS on2
      FROM (SELECT v_players.*, {_P1[0]} AS x1, {_P1[1]} AS y1, {_P2[0]} AS x2, {_P2[1]} AS y2 FROM v_players JOIN v_cal USING (source_id)))""", ("v_players", "v_cal"))


@query("players_on_court")
def _(spark, sf):
    return ops.players_on_court(fixtures.player_rows(spark, sf), fixtures.calibrations(spark, sf)).drop("player_activity")


oracle("players_on_court", "SELECT * FROM v_on_court", ("v_on_court",))

# poses: source = label (0..9), calibrated by suppliers of the same number
cte("v_poses", """SELECT label::BIGINT AS source_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, vec_id,
    CASE WHEN vec_id % 6 <> 0 THEN embedding END AS e FROM embeddings""")


def kp(j: int, part: str) -> str:
    return (f"CASE WHEN e IS NOT NULL THEN e[{2*j + 1 if part == 'x' else 2*j + 2}]::DOUBLE END" if part in "xy"
            else f"CASE WHEN e IS NOT NULL THEN ((vec_id*7 + {j*3}) % 10)::DOUBLE/10 END")


def _foot(ground, ankle) -> tuple[str, str]:
    w = lambda j: f"(CASE WHEN {kp(j, 'v')} >= 0.5 THEN {kp(j, 'v')} ELSE 0 END)"
    total = " + ".join(w(j) for j in ground)
    ankle_ok = f"{kp(ankle, 'v')} >= 0.5"
    return tuple(f"CASE WHEN {total} > 0 THEN ({' + '.join(f'{w(j)}*coalesce({kp(j, a)}, 0)' for j in ground)}) / ({total}) WHEN {ankle_ok} THEN {kp(ankle, a)} END"
                 for a in "xy")


_L, _R = _foot((29, 31), 27), _foot((30,), 28)  # keypoint 32 is absent from the 32-point fixture
_PL, _PR = fwd("(lx*641)", "(ly*359)"), fwd("(rx*641)", "(ry*359)")
cte("v_anchor", f"""SELECT source_id, frame, (coalesce(plx, 0) + coalesce(prx, 0)) / nullif(n, 0) / 3.05 AS anchor_x, (coalesce(ply, 0) + coalesce(pry, 0)) / nullif(n, 0) / 6.7 AS anchor_y
  FROM (SELECT *, (lx IS NOT NULL)::INT + (rx IS NOT NULL)::INT AS n, {_PL[0]} AS plx, {_PL[1]} AS ply, {_PR[0]} AS prx, {_PR[1]} AS pry
    FROM (SELECT source_id, frame, {_L[0]} AS lx, {_L[1]} AS ly, {_R[0]} AS rx, {_R[1]} AS ry FROM v_poses) JOIN v_cal USING (source_id))""", ("v_poses", "v_cal"))


@query("foot_anchor")
def _(spark, sf):
    return rounded(ops.foot_anchor(fixtures.poses(spark, sf), fixtures.calibrations(spark, sf)))


oracle("foot_anchor", f"SELECT source_id, frame, {r6('anchor_x', 'anchor_y')} FROM v_anchor", ("v_anchor",))


@query("foot_anchor_series")
def _(spark, sf):
    """Clips of at most 12 frames, so that both kept and rejected clips occur."""
    anchors = ops.foot_anchor(fixtures.poses(spark, sf), fixtures.calibrations(spark, sf))
    clips = anchors.select((F.col("source_id") * 10000000000 + F.floor(F.col("frame") / 12)).alias("source_id"),
                           (F.col("frame") % 12).alias("frame"),
                           *[F.when((F.col("frame") + F.col("source_id")) % 31 > 5, F.col(c)).alias(c) for c in ("anchor_x", "anchor_y")])
    return rounded(ops.foot_anchor_series(clips))


cte("v_clip_anchor", """SELECT source_id*10000000000 + CAST(frame // 12 AS BIGINT) AS source_id, frame % 12 AS frame, CASE WHEN (frame + source_id) % 31 > 5 THEN anchor_x END AS anchor_x,
    CASE WHEN (frame + source_id) % 31 > 5 THEN anchor_y END AS anchor_y FROM v_anchor""", ("v_anchor",))
oracle("foot_anchor_series", f"""SELECT source_id, frame, {r6('anchor_x', 'anchor_y')}, observed, rejected FROM (SELECT source_id, frame, observed, rejected,
      {', '.join(f"CASE WHEN observed = 1 OR rejected THEN {c} WHEN a IS NULL THEN b.{c} WHEN b IS NULL THEN a.{c} ELSE a.{c} + (frame-a.frame)::DOUBLE/(b.frame-a.frame)*(b.{c}-a.{c}) END AS {c}" for c in ('anchor_x', 'anchor_y'))}
    FROM (SELECT *, bool_or(run > 5) OVER (PARTITION BY source_id) OR sum(observed) OVER (PARTITION BY source_id) = 0 AS rejected,
        last_value(pt IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
        first_value(pt IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
      FROM (SELECT *, CASE WHEN observed = 0 THEN count(*) OVER (PARTITION BY source_id, observed, frame - rnk) ELSE 0 END AS run
        FROM (SELECT *, row_number() OVER (PARTITION BY source_id, anchor_x IS NULL ORDER BY frame) AS rnk, (anchor_x IS NOT NULL)::INT::DOUBLE AS observed,
          CASE WHEN anchor_x IS NOT NULL THEN {{'frame': frame, 'anchor_x': anchor_x, 'anchor_y': anchor_y}} END AS pt FROM v_clip_anchor))))""", ("v_clip_anchor",))
