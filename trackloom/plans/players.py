"""Player role, pose and activity queries."""

from pyspark.sql import functions as F

from trackloom import fixtures
from trackloom.chunks import numbered
from trackloom.operators import players as ops
from trackloom.plans.base import cte, oracle, query, r6, rounded
from trackloom.session import materialize

FPS, W, H = fixtures.FPS, fixtures.WIDTH, fixtures.HEIGHT


def observations(spark, sf):
    """Boxes whose bottom centre is the fixture's foot position, in metres."""
    x, y = F.col("foot_x"), F.col("foot_y")
    return fixtures.person_obs(spark, sf).select("source_id", "frame", "track_id", F.array(x - 0.5, y - 2.0, x + 0.5, y).alias("bbox"), "confidence")


def identity(spark, sf):
    cal = fixtures.calibrations(spark, sf).select("source_id", "width", "height")
    return cal.withColumns({f"h{i}": F.lit(1.0 if i in (0, 4, 8) else 0.0) for i in range(9)})


def projected(spark, sf):
    return ops.project_observations(observations(spark, sf), identity(spark, sf))


def sources(spark, sf):
    return fixtures.sources(fixtures.person_obs(spark, sf))


cte("po", """SELECT *, [foot_x - 0.5::DOUBLE, foot_y - 2.0::DOUBLE, foot_x + 0.5::DOUBLE, foot_y] AS bbox, ((foot_x - 0.5) + (foot_x + 0.5))/2.0::DOUBLE AS court_x, foot_y AS court_y,
    abs(((foot_x - 0.5) + (foot_x + 0.5))/2.0::DOUBLE) <= 3.35 AND abs(foot_y) <= 7.0 AS in_court FROM v_person_obs""", ("v_person_obs",))
cte("psrc", "SELECT source_id, max(frame) + 1 AS frame_count FROM v_person_obs GROUP BY source_id", ("v_person_obs",))


@query("project_observations")
def _(spark, sf):
    return rounded(projected(spark, sf).select("source_id", "frame", "track_id", "court_x", "court_y", "in_court"))


oracle("project_observations", "SELECT source_id, frame, track_id, round(court_x, 6) + 0.0 AS court_x, round(court_y, 6) + 0.0 AS court_y, in_court FROM po", ("po",))

cte("pstats", """SELECT source_id, period, slot, track_id, count(*) AS observations, avg((sqrt(pow(court_x, 2) + pow(court_y - CASE slot WHEN 1 THEN -3.35 ELSE 3.35 END, 2)) <= 2.0)::INT) AS center_access,
      least(1.0::DOUBLE, count(DISTINCT CASE WHEN frame >= greatest(0, period*15 - 30) AND frame < least(frame_count, period*15 + 30) THEN frame END)::DOUBLE / greatest(1, any_value(least(frame_count, period*15 + 30) - greatest(0, period*15 - 30)))) AS occupancy_ratio,
      avg(confidence) AS mean_confidence
    FROM (SELECT p.*, frame_count, s.slot, w.period FROM po p JOIN psrc USING (source_id), (VALUES (1), (2)) s(slot), LATERAL (SELECT unnest(range(greatest(0, CAST(floor((p.frame - 75)/15.0) AS BIGINT) + 1), least(CAST(floor((p.frame + 75)/15.0) AS BIGINT), CAST(floor((frame_count - 1)/15.0) AS BIGINT)) + 1)) AS period) w
      WHERE in_court AND CASE s.slot WHEN 1 THEN court_y <= 0 ELSE court_y >= 0 END) GROUP BY source_id, period, slot, track_id""", ("po", "psrc"))
cte("prank", """SELECT *, 0.65*center_access + 0.25*occupancy_ratio + 0.10*mean_confidence AS score FROM pstats
    WHERE observations >= 15 AND center_access >= 0.1 AND 0.65*center_access + 0.25*occupancy_ratio + 0.10*mean_confidence >= 0.35""", ("pstats",))


def ranked(spark, sf):
    return ops.rank_slot_candidates(projected(spark, sf), sources(spark, sf))


@query("rank_slot_candidates")
def _(spark, sf):
    # shares of small counts: a prime divisor keeps them off rounding ties
    return rounded(ranked(spark, sf).withColumns({c: F.col(c) / 1.009 for c in SHARES}))


SHARES = ("center_access", "occupancy_ratio", "mean_confidence", "score")
oracle("rank_slot_candidates", "SELECT source_id, period, slot, track_id, observations, " + ", ".join(f"round({c}/1.009::DOUBLE, 6) + 0.0 AS {c}" for c in SHARES) + " FROM prank", ("prank",))


def choices(spark, sf):
    return ops.choose_slots(ranked(spark, sf), sources(spark, sf))


@query("choose_slots")
def _(spark, sf):
    return rounded(choices(spark, sf))


# one step per period; within it slot 1 first, then slot 2 without slot 1's track
cte("plists", """SELECT s.source_id, w.period, coalesce(list({'track_id': track_id, 'score': score}) FILTER (slot = 1), []) AS c1, coalesce(list({'track_id': track_id, 'score': score}) FILTER (slot = 2), []) AS c2
    FROM psrc s, LATERAL (SELECT unnest(range(0, CAST(floor((frame_count - 1)/15.0) AS BIGINT) + 1)) AS period) w LEFT JOIN prank p ON p.source_id = s.source_id AND p.period = w.period GROUP BY s.source_id, w.period""", ("psrc", "prank"))


_L = "list_sort(list_transform({c}, lambda x: {{'n': -x.score, 't': x.track_id}}))"
_DEC = """CASE WHEN len({l}) = 0 THEN {{'t': NULL::BIGINT, 'r': 'insufficient_observations', 's': 0.0::DOUBLE}}
    WHEN len(list_filter({l}, lambda x: x.t = {inc} AND x.n - {l}[1].n <= 0.08)) > 0 THEN {{'t': {inc}, 'r': CASE WHEN {l}[1].t <> {inc} THEN 'incumbent_retained' END, 's': -list_filter({l}, lambda x: x.t = {inc})[1].n}}
    WHEN len({l}) > 1 AND {l}[2].n - {l}[1].n <= 0.08 AND {l}[1].t IS DISTINCT FROM {inc} AND {l}[2].t IS DISTINCT FROM {inc} THEN {{'t': NULL::BIGINT, 'r': 'ambiguous_candidates', 's': 0.0::DOUBLE}}
    ELSE {{'t': {l}[1].t, 'r': NULL::VARCHAR, 's': -{l}[1].n}} END"""
cte("psm", f"""SELECT source_id, -1::BIGINT AS period, NULL::BIGINT AS i1, NULL::BIGINT AS i2, {{'t': NULL::BIGINT, 'r': NULL::VARCHAR, 's': 0.0::DOUBLE}} AS d1, {{'t': NULL::BIGINT, 'r': NULL::VARCHAR, 's': 0.0::DOUBLE}} AS d2 FROM psrc
    UNION ALL SELECT source_id, period, coalesce(d1.t, i1), coalesce(d2.t, i2), d1, d2 FROM (SELECT *, {_DEC.format(l='l2', inc='i2')} AS d2
      FROM (SELECT *, list_filter(a2, lambda x: x.t IS DISTINCT FROM d1.t) AS l2 FROM (SELECT *, {_DEC.format(l='l1', inc='i1')} AS d1
        FROM (SELECT p.source_id, p.period, i1, i2, {_L.format(c='c1')} AS l1, {_L.format(c='c2')} AS a2 FROM psm m JOIN plists p ON p.source_id = m.source_id AND p.period = m.period + 1))))""", ("plists", "psrc"))
cte("pchoice", """SELECT source_id, period, slot, period*15 AS start_frame, least(frame_count, period*15 + 15) AS end_frame, d.t AS track_id, d.r AS reason, d.s AS confidence
    FROM (SELECT source_id, period, 1 AS slot, d1 AS d FROM psm WHERE period >= 0 UNION ALL SELECT source_id, period, 2, d2 FROM psm WHERE period >= 0) JOIN psrc USING (source_id)""", ("psm", "psrc"))
oracle("choose_slots", "SELECT * REPLACE (round(confidence, 6) + 0.0 AS confidence) FROM pchoice", ("pchoice",), recursive=True)


@query("assign_slots")
def _(spark, sf):
    return rounded(ops.assign_slots(choices(spark, sf), projected(spark, sf)).drop("bbox", "detection_confidence"))


oracle("assign_slots", """SELECT source_id, frame, slot, CASE WHEN ok THEN track_id END AS track_id, round(CASE WHEN ok THEN court_x END, 6) + 0.0 AS court_x, round(CASE WHEN ok THEN court_y END, 6) + 0.0 AS court_y, round(confidence, 6) + 0.0 AS confidence,
    CASE WHEN here IS NULL AND track_id IS NOT NULL THEN 'selected_track_absent' WHEN here IS NULL THEN reason WHEN NOT in_court THEN 'outside_court' WHEN NOT half THEN 'wrong_half' ELSE reason END AS reason
    FROM (SELECT *, here AND in_court AND half AS ok FROM (SELECT c.source_id, c.frame, slot, c.track_id, confidence, reason, court_x, court_y, in_court, here, CASE slot WHEN 1 THEN court_y <= 0 ELSE court_y >= 0 END AS half
      FROM (SELECT *, unnest(range(start_frame, end_frame)) AS frame FROM pchoice) c LEFT JOIN (SELECT source_id, frame, track_id, court_x, court_y, in_court, true AS here FROM po) o USING (source_id, frame, track_id)))""", ("pchoice", "po"), recursive=True)


@query("track_handoff")
def _(spark, sf):
    seen, src = projected(spark, sf), materialize(sources(spark, sf), "sources")
    scores = materialize(ops.rank_slot_candidates(seen, src), "scores")
    return rounded(ops.track_handoff(ops.choose_slots(scores, src), scores, seen, src).drop("bbox", "detection_confidence"))


@query("bbox_iou")
def _(spark, sf):
    """Overlap of the boxes sharing a frame and a half (at most four observations per frame)."""
    rows = observations(spark, sf)
    a = rows.select("source_id", "frame", F.col("track_id").alias("a_id"), F.col("bbox").alias("a"))
    b = rows.select("source_id", "frame", F.col("track_id").alias("b_id"), F.col("bbox").alias("b"))
    return rounded(a.join(b, ["source_id", "frame"]).filter("a_id < b_id").select("source_id", "frame", "a_id", "b_id", ops.box_iou(F.col("a"), F.col("b")).alias("iou")))


oracle("bbox_iou", """SELECT source_id, frame, a_id, b_id, round(i/(4.0::DOUBLE - i), 6) + 0.0 AS iou FROM (SELECT a.source_id, a.frame, a.track_id AS a_id, b.track_id AS b_id,
    greatest(0.0::DOUBLE, 1 - abs(a.foot_x - b.foot_x))*greatest(0.0::DOUBLE, 2 - abs(a.foot_y - b.foot_y)) AS i FROM po a JOIN po b ON a.source_id = b.source_id AND a.frame = b.frame AND a.track_id < b.track_id)""", ("po",))


def pixel_boxes(spark, sf):
    """Boxes in pixels: the fixture's feet stretched over the image."""
    x, y = 300 + F.col("foot_x") * 90, 180 + F.col("foot_y") * 31
    return fixtures.person_obs(spark, sf).select("source_id", "frame", "track_id", F.array(x - 20, y - 80, x + 20, y).alias("bbox"), "confidence")


@query("select_on_court_tracks")
def _(spark, sf):
    return ops.select_on_court_tracks(pixel_boxes(spark, sf), sources(spark, sf))


cte("pscore", """SELECT source_id, track_id, count(*) FILTER (300 + foot_x*90 BETWEEN 0.08*641 AND 0.92*641 AND 180 + foot_y*31 BETWEEN 0.2*359 AND 1.02*359) AS score, count(*) FILTER (abs(foot_x) <= 3.35 AND abs(foot_y) <= 7.0) AS court_score,
    -median(180 + foot_y*31) AS depth, median(foot_y) AS court_depth FROM v_person_obs GROUP BY ALL""", ("v_person_obs",))
cte("psel", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, track_id DESC) AS place FROM pscore WHERE score > 0) WHERE place <= 2", ("pscore",))
cte("pcsel", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY court_score DESC, track_id DESC) AS place FROM pscore WHERE court_score > 0) WHERE place <= 2", ("pscore",))
oracle("select_on_court_tracks", "SELECT source_id, track_id, score, place FROM psel", ("psel",))


@query("select_on_court_tracks_calibrated")
def _(spark, sf):
    return ops.select_on_court_tracks(observations(spark, sf), sources(spark, sf), identity(spark, sf))


oracle("select_on_court_tracks_calibrated", "SELECT source_id, track_id, court_score AS score, place FROM pcsel", ("pcsel",))


@query("order_slots")
def _(spark, sf):
    rows = observations(spark, sf)
    chosen = ops.select_on_court_tracks(rows, sources(spark, sf), identity(spark, sf))
    return rounded(ops.order_slots(chosen, rows, identity(spark, sf)))


oracle("order_slots", "SELECT source_id, track_id, round(court_depth, 6) + 0.0 AS median, row_number() OVER (PARTITION BY source_id ORDER BY court_depth, track_id) AS slot FROM pcsel", ("pcsel",))


@query("visible_landmarks")
def _(spark, sf):
    return ops.visible_landmarks(fixtures.poses(spark, sf))


oracle("visible_landmarks", """SELECT label::BIGINT AS source_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame,
    CASE WHEN vec_id % 6 = 0 THEN 0 ELSE len(list_filter(range(32), lambda j: ((vec_id*7 + j*3) % 10)/10.0 >= 0.3)) END AS visible FROM embeddings""")


def landmark_poses(spark, sf):
    """Crop poses of two slots per label: landmarks from the embedding, box and gaps from the id."""
    v = F.col("vec_id")
    rows = fixtures.table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("source_id"), (v % 2 + 1).cast("int").alias("slot"), "embedding")
    rows = numbered(rows, ["source_id", "slot"], F.floor(v / 4096), ["vec_id"], "n")
    value = lambda i: F.element_at("embedding", i).cast("double") * 0.3 + 0.5
    marks = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.struct(
        value(2 * j + 1).alias("x"), value(2 * j + 2).alias("y"), (F.lit(0.0)).alias("z"),
        F.when((v + j) % 9 != 0, 0.3 + ((v * 7 + j * 3) % 8).cast("double") / 10.0).alias("visibility"),
        F.when((v + j) % 4 != 0, F.lit(0.6)).alias("presence")))
    x, y = ((v * 7) % 300).cast("double"), ((v * 3) % 100).cast("double")
    box = F.array(x, y, x + 101.0, y + 203.0)
    return rows.select("source_id", "slot", (F.col("n") - 1).alias("frame"), v.alias("track_id"), box.alias("bbox"), box.alias("pose_bbox"),
                       F.when(v % 6 != 0, marks).alias("landmarks"), (v % 11 != 0).alias("has_record"))


cte("lp", """SELECT label::BIGINT AS source_id, CAST(vec_id % 2 + 1 AS INT) AS slot, row_number() OVER (PARTITION BY label, vec_id % 2 ORDER BY vec_id) - 1 AS frame, vec_id AS track_id, vec_id,
    [((vec_id*7) % 300)::DOUBLE, ((vec_id*3) % 100)::DOUBLE, ((vec_id*7) % 300)::DOUBLE + 101, ((vec_id*3) % 100)::DOUBLE + 203] AS bbox,
    CASE WHEN vec_id % 6 <> 0 THEN list_transform(range(32), lambda j: {'j': j, 'x': embedding[2*j+1]::DOUBLE*0.3::DOUBLE + 0.5::DOUBLE, 'y': embedding[2*j+2]::DOUBLE*0.3::DOUBLE + 0.5::DOUBLE,
      'v': CASE WHEN (vec_id + j) % 9 <> 0 THEN 0.3::DOUBLE + ((vec_id*7 + j*3) % 8)::DOUBLE/10 END, 'p': CASE WHEN (vec_id + j) % 4 <> 0 THEN 0.6::DOUBLE END}) END AS marks FROM embeddings""")


@query("pose_quality")
def _(spark, sf):
    return rounded(landmark_poses(spark, sf).select("source_id", "slot", "frame", ops.pose_quality().alias("quality")))


_SIGHT = lambda ids: "(" + " + ".join(f"least(1.0::DOUBLE, coalesce(marks[{i + 1}].v, 0))" for i in ids) + f")/{len(ids)}"
oracle("pose_quality", f"""SELECT source_id, slot, frame, CASE WHEN marks IS NULL THEN 0.0::DOUBLE ELSE round(0.6::DOUBLE*{_SIGHT(ops.TORSO)} + 0.4::DOUBLE*{_SIGHT(ops.LIMBS)}, 6) END AS quality FROM lp""", ("lp",))


@query("normalize_landmarks")
def _(spark, sf):
    rows = landmark_poses(spark, sf).select("source_id", "slot", "frame", F.posexplode(ops.normalize_landmarks()).alias("landmark", "p"))
    return rounded(rows.select("source_id", "slot", "frame", "landmark", "p.x", "p.y", "p.visibility", "p.presence"))


oracle("normalize_landmarks", """SELECT source_id, slot, frame, CAST(m.j AS INT) AS landmark, round(m.x, 6) + 0.0 AS x, round(m.y, 6) + 0.0 AS y, round(coalesce(m.v, m.p, 0.0), 6) + 0.0 AS visibility, m.p AS presence FROM (SELECT source_id, slot, frame, unnest(marks) AS m FROM lp)""", ("lp",))


@query("expand_bbox")
def _(spark, sf):
    box = ops.expand_bbox(F.col("bbox"), F.lit(W), F.lit(H), 0.2)
    return rounded(pixel_boxes(spark, sf).select("source_id", "frame", "track_id", *[box[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]))


oracle("expand_bbox", """SELECT source_id, frame, track_id, round(greatest(0, 272 + foot_x*90), 6) + 0.0 AS x1, round(greatest(0, 84 + foot_y*31), 6) + 0.0 AS y1, round(least(641, 328 + foot_x*90), 6) + 0.0 AS x2, round(least(359, 196 + foot_y*31), 6) + 0.0 AS y2 FROM v_person_obs""", ("v_person_obs",))


@query("crop_to_image")
def _(spark, sf):
    points = ops.crop_to_image(F.col("landmarks"), F.col("bbox"))
    back = ops.image_to_crop(points, F.col("bbox"))
    rows = landmark_poses(spark, sf).select("source_id", "slot", "frame", F.explode(F.arrays_zip(points.alias("a"), back.alias("b"))).alias("z"))
    return rounded(rows.select("source_id", "slot", "frame", F.col("z.a.x").alias("x"), F.col("z.a.y").alias("y"), F.col("z.b.x").alias("crop_x"), F.col("z.b.y").alias("crop_y")))


oracle("crop_to_image", """SELECT source_id, slot, frame, round(bbox[1] + m.x*101, 6) + 0.0 AS x, round(bbox[2] + m.y*203, 6) + 0.0 AS y, round(m.x, 6) + 0.0 AS crop_x, round(m.y, 6) + 0.0 AS crop_y FROM (SELECT source_id, slot, frame, bbox, unnest(marks) AS m FROM lp)""", ("lp",))


def cache_rows(spark, sf):
    """Cached poses for most observations, under several fingerprints, in ingest order."""
    f, t = F.col("frame"), F.col("track_id")
    rows = pixel_boxes(spark, sf).filter((f + t) % 5 != 0)
    return rows.select("source_id", "frame", "track_id", "bbox", F.when(f % 4 == 0, "old").when(f % 4 == 1, "alias").otherwise("m1").alias("model_fingerprint"),
                       F.when(t % 7 == 0, "p0").otherwise("p1").alias("preprocessing_fingerprint"),
                       F.when(F.col("source_id") % 5 == 0, "stale").otherwise("raw").alias("raw_artifact_fingerprint"), (f * 100 + t).alias("seq"))


@query("pose_worklist")
def _(spark, sf):
    cache = cache_rows(spark, sf)
    raw = sources(spark, sf).select("source_id", F.lit("raw").alias("raw_fingerprint"))
    return ops.pose_worklist(pixel_boxes(spark, sf), cache, "m1", "p1", raw).select("source_id", "frame", "track_id")


oracle("pose_worklist", "SELECT DISTINCT source_id, frame, track_id FROM v_person_obs WHERE (frame + track_id) % 5 = 0 OR frame % 4 IN (0, 1) OR track_id % 7 = 0 OR source_id % 5 = 0", ("v_person_obs",))


@query("compact_pose_cache")
def _(spark, sf):
    rows = cache_rows(spark, sf)
    twice = rows.unionByName(rows.filter("frame % 4 = 1").withColumns({"model_fingerprint": F.lit("m1"), "seq": F.col("seq") + 5000000}))
    aliases = spark.createDataFrame([("alias", "m1")], "alias string, canonical string")
    return ops.compact_pose_cache(twice, aliases).select("source_id", "frame", "track_id", "model_fingerprint", "seq")


oracle("compact_pose_cache", """SELECT source_id, frame, track_id, CASE WHEN frame % 4 = 0 THEN 'old' ELSE 'm1' END AS model_fingerprint, max(frame*100 + track_id + CASE WHEN frame % 4 = 1 THEN 5000000 ELSE 0 END) AS seq
    FROM v_person_obs WHERE (frame + track_id) % 5 <> 0 GROUP BY source_id, frame, track_id""", ("v_person_obs",))


@query("pose_best_attempt")
def _(spark, sf):
    """Two attempts per observation."""
    f, t, c = F.col("frame"), F.col("track_id"), F.col("confidence")
    rows = fixtures.person_obs(spark, sf).withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    quality = F.when(F.col("attempt") == 1, c).when(f % 3 == 0, c).otherwise(1.3 - c)
    return rounded(ops.pose_best_attempt(rows.select("source_id", "frame", "track_id", "attempt", (quality * 0.7).alias("quality"), ((f + t + F.col("attempt")) % 5 != 0).alias("detected"),
                                                     F.when((f + t + F.col("attempt")) % 5 != 0, "detected").otherwise("no_pose").alias("status"))))


oracle("pose_best_attempt", """SELECT source_id, frame, track_id, attempt, round(quality, 6) AS quality, 2::BIGINT AS attempts, CASE WHEN det AND quality < 0.55 THEN 'low_quality' WHEN det THEN 'detected' ELSE 'no_pose' END AS status
    FROM (SELECT *, row_number() OVER (PARTITION BY source_id, frame, track_id ORDER BY quality DESC, attempt) AS n FROM (SELECT *, (frame + track_id + attempt) % 5 <> 0 AS det, 0.7::DOUBLE*CASE WHEN attempt = 1 OR frame % 3 = 0 THEN confidence ELSE 1.3::DOUBLE - confidence END AS quality
      FROM v_person_obs, (VALUES (1), (2)) a(attempt))) WHERE n = 1""", ("v_person_obs",))


def repaired(spark, sf):
    rows = landmark_poses(spark, sf).withColumn("quality", ops.pose_quality())
    return ops.temporal_pose_validation(rows, W, H)


@query("temporal_pose_validation")
def _(spark, sf):
    rows = repaired(spark, sf)
    mean = lambda a: F.aggregate("points", F.lit(0.0), lambda s, p: s + p[a]) / F.size("points")
    return rounded(rows.select("source_id", "slot", "frame", "temporal_status", "quality", mean("x").alias("mean_x"), mean("y").alias("mean_y")))


cte("tp_image", f"""SELECT *, (img[12].x + img[13].x + img[24].x + img[25].x)/4 AS tx, (img[12].y + img[13].y + img[24].y + img[25].y)/4 AS ty FROM (
    SELECT source_id, slot, frame, bbox, vec_id % 11 <> 0 AS has, marks,
      CASE WHEN vec_id % 11 <> 0 THEN list_transform(marks, lambda m: {{'x': bbox[1] + m.x*101, 'y': bbox[2] + m.y*203}}) END AS img,
      CASE WHEN marks IS NULL THEN 0.0::DOUBLE ELSE 0.6::DOUBLE*{_SIGHT(ops.TORSO)} + 0.4::DOUBLE*{_SIGHT(ops.LIMBS)} END AS q FROM lp)""", ("lp",))
cte("tp_next", """SELECT *, lead(img) OVER w AS nimg, lead(tx) OVER w AS ntx, lead(ty) OVER w AS nty, lead(q) OVER w AS nq FROM tp_image
    WINDOW w AS (PARTITION BY source_id, slot ORDER BY frame)""", ("tp_image",))
_APART = lambda x, y, u, v, limit: f"sqrt(pow({x} - {u}, 2) + pow({y} - {v}, 2)) <= {limit}*sqrt(({W}*{W} + {H}*{H})::DOUBLE)"
cte("tp", f"""SELECT source_id, slot, -1::BIGINT AS frame, NULL::VARCHAR AS status, NULL::STRUCT(x DOUBLE, y DOUBLE)[] AS img, NULL::DOUBLE AS tx, NULL::DOUBLE AS ty, NULL::DOUBLE AS q
    FROM (SELECT DISTINCT source_id, slot FROM tp_image)
  UNION ALL
  SELECT source_id, slot, frame, CASE WHEN NOT has THEN NULL WHEN NOT near THEN 'original' WHEN fits THEN 'validated' WHEN seen THEN 'rejected_jump_interpolated' ELSE 'interpolated_single_gap' END,
    CASE WHEN near AND NOT fits THEN list_transform(range(1, 33), lambda i: {{'x': (pimg[i].x + nimg[i].x)/2, 'y': (pimg[i].y + nimg[i].y)/2}}) ELSE img END,
    CASE WHEN near AND NOT fits THEN mx ELSE tx END, CASE WHEN near AND NOT fits THEN my ELSE ty END, CASE WHEN NOT has THEN NULL WHEN near AND NOT fits THEN least(pq, nq) ELSE q END
  FROM (SELECT *, coalesce(seen AND {_APART('tx', 'ty', 'mx', 'my', '0.10::DOUBLE')}, false) AS fits
    FROM (SELECT e.*, m.img AS pimg, m.q AS pq, (m.tx + e.ntx)/2 AS mx, (m.ty + e.nty)/2 AS my, e.img IS NOT NULL AND e.q >= 0.55 AS seen,
        coalesce(e.has AND m.img IS NOT NULL AND e.nimg IS NOT NULL AND {_APART('m.tx', 'm.ty', 'e.ntx', 'e.nty', '0.12::DOUBLE')}, false) AS near
      FROM tp m JOIN tp_next e ON e.source_id = m.source_id AND e.slot = m.slot AND e.frame = m.frame + 1))""", ("tp_next",))
oracle("temporal_pose_validation", f"""SELECT source_id, slot, frame, status AS temporal_status, round(q, 6) + 0.0 AS quality,
    round(list_avg(list_transform(img, lambda p: (p.x - bbox[1])/101)), 6) + 0.0 AS mean_x, round(list_avg(list_transform(img, lambda p: (p.y - bbox[2])/203)), 6) + 0.0 AS mean_y
  FROM (SELECT tp.*, bbox FROM tp JOIN tp_image USING (source_id, slot, frame))""", ("tp", "tp_image"), recursive=True)


def activity(spark, sf):
    return ops.player_activity(landmark_poses(spark, sf).filter("has_record"), W, H)


@query("player_activity")
def _(spark, sf):
    return rounded(activity(spark, sf))


cte("pa0", """SELECT *, CASE WHEN nf > 0 THEN sx/nf ELSE bbox[1] + 50.5 END AS foot_x, CASE WHEN nf > 0 THEN sy/nf ELSE bbox[4] END AS foot_y,
      CASE WHEN marks IS NOT NULL THEN list_transform(marks, lambda m: {'x': (bbox[1] + m.x*101)/641::DOUBLE, 'y': (bbox[2] + m.y*203)/359::DOUBLE}) END AS pose
    FROM (SELECT *, coalesce(len(feet), 0) AS nf, list_sum(list_transform(feet, lambda m: bbox[1] + m.x*101)) AS sx, list_sum(list_transform(feet, lambda m: bbox[2] + m.y*203)) AS sy
      FROM (SELECT *, list_filter(marks[30:33], lambda m: m.v >= 0.5) AS feet FROM lp WHERE vec_id % 11 <> 0))""", ("lp",))
cte("pact", """SELECT source_id, slot, frame, track_id, foot_x, foot_y, CASE WHEN pose IS NOT NULL AND lpose IS NOT NULL THEN list_avg(list_transform(range(1, 33), lambda i: sqrt(pow(pose[i].x - lpose[i].x, 2) + pow(pose[i].y - lpose[i].y, 2))))
      WHEN lx IS NOT NULL THEN sqrt(pow(foot_x - lx, 2) + pow(foot_y - ly, 2))/sqrt((641*641 + 359*359)::DOUBLE) ELSE 0.0::DOUBLE END AS activity
    FROM (SELECT *, last_value(pose IGNORE NULLS) OVER w AS lpose, last_value(foot_x) OVER w AS lx, last_value(foot_y) OVER w AS ly FROM pa0 WINDOW w AS (PARTITION BY source_id, slot ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", ("pa0",))
oracle("player_activity", f"SELECT source_id, slot, frame, track_id, {r6('foot_x', 'foot_y', 'activity')} FROM pact", ("pact",))


@query("activity_rollup")
def _(spark, sf):
    frames = ops.frame_spine(landmark_poses(spark, sf).groupBy("source_id").agg((F.max("frame") + 4).alias("frame_count")))
    quiet = activity(spark, sf).withColumn("activity", F.col("activity") * 0.01)
    return rounded(ops.activity_rollup(frames, quiet))


oracle("activity_rollup", """, f AS (SELECT source_id, unnest(range(max(frame) + 4)) AS frame FROM lp GROUP BY source_id),
    w AS (SELECT source_id, frame, max(track_id) FILTER (slot = 1) AS t1, max(foot_x) FILTER (slot = 1) AS x1, max(foot_y) FILTER (slot = 1) AS y1, max(activity*0.01) FILTER (slot = 1) AS a1, max(track_id) FILTER (slot = 2) AS t2, max(foot_x) FILTER (slot = 2) AS x2, max(foot_y) FILTER (slot = 2) AS y2, max(activity*0.01) FILTER (slot = 2) AS a2,
      sum(activity*0.01) AS total, max(activity*0.01) AS most FROM pact GROUP BY source_id, frame),
    r AS (SELECT f.source_id, f.frame, w.* EXCLUDE (source_id, frame), CASE WHEN total IS NULL THEN 0.0::DOUBLE ELSE least(1.0, total*20) END AS pa FROM f LEFT JOIN w USING (source_id, frame)),
    s AS (SELECT *, avg(pa) OVER o AS aw, count(*) OVER o AS n FROM r WINDOW o AS (PARTITION BY source_id ORDER BY frame ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
    SELECT source_id, frame, round(pa, 6) + 0.0 AS player_activity, CASE WHEN most IS NULL OR most < 0.001 THEN 1 ELSE 0 END AS players_inactive, round(aw, 6) + 0.0 AS activity_window, CASE WHEN n = 30 AND aw < 0.05 THEN 1 ELSE 0 END AS inactivity_window,
      t1 AS player1_track_id, (t1 IS NOT NULL)::INT AS player1_valid, round(x1, 6) + 0.0 AS player1_foot_x, round(y1, 6) + 0.0 AS player1_foot_y, round(a1, 6) + 0.0 AS player1_activity,
      t2 AS player2_track_id, (t2 IS NOT NULL)::INT AS player2_valid, round(x2, 6) + 0.0 AS player2_foot_x, round(y2, 6) + 0.0 AS player2_foot_y, round(a2, 6) + 0.0 AS player2_activity FROM s""", ("lp", "pact"))
