"""Feature, window and split queries."""

from pyspark.sql import functions as F

from trackloom import fixtures
from trackloom.operators import court
from trackloom.operators import features as ops
from trackloom.operators import tracks
from trackloom.plans import court as court_plans
from trackloom.plans import tracks as track_plans
from trackloom.plans.base import CTES, cte, oracle, query, r6, rounded
from trackloom.session import materialize


def pose_spine(spark, sf):
    rows = fixtures.poses(spark, sf)
    return rows.select("source_id", F.col("frame").alias("position"), "frame"), rows


def flat(df, n=6):
    """A few coordinates of the pose array and its sum, as scalars."""
    total = F.aggregate("pose", F.lit(0.0), lambda s, v: s + v)
    return rounded(df.select("source_id", "position", *[F.col("pose")[i].alias(f"p{i}") for i in (0, 1, 62, 63)], F.size("pose").alias("width"), total.alias("total")), n)


cte("fpose", """SELECT source_id, frame AS position, CASE WHEN e IS NOT NULL THEN list_transform(e, lambda v: v::DOUBLE) END AS pose FROM v_poses""", ("v_poses",))
cte("ffill", """SELECT source_id, position, CASE WHEN pose IS NOT NULL THEN pose WHEN a IS NOT NULL AND b IS NOT NULL THEN list_transform(range(1, 65), lambda i: (a[i] + b[i])/2) ELSE coalesce(a, b) END AS pose
    FROM (SELECT *, last_value(pose IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
      first_value(pose IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM fpose)""", ("fpose",))
_FLAT = "round(pose[1], 6) + 0.0 AS p0, round(pose[2], 6) + 0.0 AS p1, round(pose[63], 6) + 0.0 AS p62, round(pose[64], 6) + 0.0 AS p63, 66 AS width, round(list_sum(pose), 6) + 0.0 AS total"


@query("pose_features")
def _(spark, sf):
    frames, poses = pose_spine(spark, sf)
    found = ops.pose_vectors(frames, poses)
    zero = F.array_repeat(F.lit(0.0), 66)
    return flat(found.withColumn("pose", F.coalesce("pose", zero)))


oracle("pose_features", f"SELECT source_id, position, {_FLAT} FROM (SELECT source_id, position, coalesce(pose, list_transform(range(64), lambda i: 0.0::DOUBLE)) AS pose FROM fpose)", ("fpose",))


@query("fill_pose_gaps")
def _(spark, sf):
    return flat(ops.pose_features(*pose_spine(spark, sf)))


oracle("fill_pose_gaps", f"SELECT source_id, position, {_FLAT} FROM ffill", ("ffill",))


def clip_poses(spark, sf):
    """Clips of twelve rows."""
    frames, poses = pose_spine(spark, sf)
    rows = ops.pose_vectors(frames, poses)
    return rows.select((F.col("source_id") * 10000000000 + F.floor(F.col("frame") / 12)).alias("source_id"), (F.col("frame") % 12).alias("position"), "pose")


cte("fclip", """SELECT source_id*10000000000 + CAST(position // 12 AS BIGINT) AS source_id, position % 12 AS position, pose FROM fpose""", ("fpose",))
cte("flegacy", """SELECT source_id, position, CASE WHEN pose IS NOT NULL THEN pose WHEN src IS NULL THEN list_transform(range(64), lambda i: 0.0::DOUBLE) ELSE list_transform(src.pose, lambda v: v/pow(2.0::DOUBLE, least(position, 10) - src.position)) END AS pose
    FROM (SELECT *, last_value(CASE WHEN pose IS NOT NULL THEN {'position': position, 'pose': pose} END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS src FROM fclip)""", ("fclip",))


@query("pose_features_legacy")
def _(spark, sf):
    return flat(ops.pose_features_legacy(clip_poses(spark, sf), 11))


oracle("pose_features_legacy", f"SELECT source_id, position, {_FLAT} FROM flegacy", ("flegacy",))


def track_rows(spark, sf):
    frames = tracks.preprocess_tracks(track_plans.normalized(spark, sf))
    return court.shuttle_inside_region(frames, fixtures.calibrations(spark, sf))


@query("shuttle_features16")
def _(spark, sf):
    return rounded(ops.shuttle_features16(track_rows(spark, sf)))


_S = {"visible": "visibility", "confidence_available": "1.0::DOUBLE", "inside_courtish": "CASE WHEN inside_courtish THEN 1.0 WHEN NOT inside_courtish THEN -1.0 ELSE 0.0 END", "peak_value": "peak"}
_SH = ", ".join(f"round(coalesce(({_S.get(n[8:], n[8:])})::DOUBLE, 0.0), 6) + 0.0 AS {n}" for n in ops.SHUTTLE)
cte("f16", f"SELECT source_id, frame, {_SH} FROM t_streak LEFT JOIN v_inside USING (source_id, frame)", ("t_streak", "v_inside"))
oracle("shuttle_features16", "SELECT * FROM f16", ("f16",))


def player_rows(spark, sf):
    rows = fixtures.player_rows(spark, sf)
    return rows.withColumns({"players_inactive": (F.col("player_activity") < 0.1).cast("int"), "activity_window": F.lit(None).cast("double")})


@query("player_features9")
def _(spark, sf):
    return rounded(ops.player_features9(player_rows(spark, sf), fixtures.calibrations(spark, sf)))


def _pl(s):
    x, y = court_plans.fwd(f"player{s}_foot_x", f"player{s}_foot_y")
    return (f"CASE WHEN player{s}_valid > 0 THEN {x}/3.05::DOUBLE ELSE 0.0 END AS player{s}_court_x, CASE WHEN player{s}_valid > 0 THEN {y}/6.7::DOUBLE ELSE 0.0 END AS player{s}_court_y, (player{s}_valid > 0)::INT::DOUBLE AS player{s}_observed")


cte("f9", f"SELECT source_id, frame, player_activity, (player_activity < 0.1)::INT::DOUBLE AS players_inactive, 0.0::DOUBLE AS activity_window, {_pl(1)}, {_pl(2)} FROM v_players JOIN v_cal USING (source_id)", ("v_players", "v_cal"))
oracle("player_features9", f"SELECT source_id, frame, {r6(*ops.PLAYERS)} FROM f9", ("f9",))


@query("feature_frame91")
def _(spark, sf):
    poses = fixtures.poses(spark, sf)
    t = materialize(track_rows(spark, sf), "tracks")
    frames = t.select("source_id", F.col("frame").alias("position"), "frame")
    return rounded(ops.feature_frame91(frames, poses, t, player_rows(spark, sf), fixtures.calibrations(spark, sf)).drop("position"))


_KP = ", ".join(f"round(coalesce(pose[{2*i + (1 if a == 'x' else 2)}], 0.0), 6) + 0.0 AS pose_{i}_{a}" if i < 32 else f"0.0::DOUBLE AS pose_{i}_{a}" for i in range(33) for a in "xy")
cte("fwide", """SELECT source_id, frame, CASE WHEN pose IS NOT NULL THEN pose WHEN a IS NOT NULL AND b IS NOT NULL THEN list_transform(range(1, 65), lambda i: (a[i] + b[i])/2) ELSE coalesce(a, b) END AS pose
    FROM (SELECT *, last_value(pose IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, first_value(pose IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
      FROM (SELECT t.source_id, t.frame, pose FROM v_tracks t LEFT JOIN fpose p ON p.source_id = t.source_id AND p.position = t.frame))""", ("v_tracks", "fpose"))
oracle("feature_frame91", f"SELECT source_id, frame, {_KP}, {', '.join(ops.SHUTTLE)}, {r6(*ops.PLAYERS)} FROM fwide JOIN f16 USING (source_id, frame) JOIN f9 USING (source_id, frame)", ("fwide", "f16", "f9"))


@query("clip_features76")
def _(spark, sf):
    """Twelve-row clips: poses by the clip rule, kinematics of the matching track frames, foot anchors."""
    pose = ops.pose_features_legacy(clip_poses(spark, sf), 11)
    clip = lambda df, c="frame": df.withColumns({"source_id": F.col("source_id") * 10000000000 + F.floor(F.col(c) / 12), c: F.col(c) % 12})
    points, frames = track_plans.sampled(spark, sf)
    kin = tracks.kinematics7(clip(points), clip(frames.drop("position")).withColumn("position", F.col("frame")))
    anchors = court.foot_anchor_series(clip(court.foot_anchor(fixtures.poses(spark, sf), fixtures.calibrations(spark, sf))))
    return rounded(ops.clip_features76(pose, kin, anchors))


cte("ckin", """SELECT source_id, position, x, y, visible, vx, vy, CASE WHEN moving AND coalesce(lag(moving) OVER w, false) THEN (vx - lag(vx) OVER w)*100 ELSE 0.0 END AS ax, CASE WHEN moving AND coalesce(lag(moving) OVER w, false) THEN (vy - lag(vy) OVER w)*100 ELSE 0.0 END AS ay
    FROM (SELECT *, CASE WHEN moving THEN (x - lag(x) OVER w)*100 ELSE 0.0 END AS vx, CASE WHEN moving THEN (y - lag(y) OVER w)*100 ELSE 0.0 END AS vy FROM (SELECT *, visible = 1 AND coalesce(lag(visible) OVER w, 0) = 1 AS moving
      FROM (SELECT source_id*10000000000 + CAST(frame // 12 AS BIGINT) AS source_id, frame % 12 AS position, visibility::DOUBLE AS visible, CASE WHEN visibility = 1 THEN raw_x/641.0::DOUBLE ELSE 0.0::DOUBLE END AS x, CASE WHEN visibility = 1 THEN raw_y/359.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM v_tracks)
      WINDOW w AS (PARTITION BY source_id ORDER BY position)) WINDOW w AS (PARTITION BY source_id ORDER BY position)) WINDOW w AS (PARTITION BY source_id ORDER BY position)""", ("v_tracks",))
cte("canchor", """SELECT source_id, frame AS position, observed, """ + ", ".join(f"CASE WHEN observed = 1 THEN {c} WHEN a IS NULL THEN b.{c} WHEN b IS NULL THEN a.{c} ELSE a.{c} + (frame-a.frame)::DOUBLE/(b.frame-a.frame)*(b.{c}-a.{c}) END AS {c}" for c in ("anchor_x", "anchor_y")) + """
    FROM (SELECT *, bool_or(run > 5) OVER (PARTITION BY source_id) OR sum(observed) OVER (PARTITION BY source_id) = 0 AS rejected, last_value(pt IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
        first_value(pt IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
      FROM (SELECT *, CASE WHEN observed = 0 THEN count(*) OVER (PARTITION BY source_id, observed, frame - rnk) ELSE 0 END AS run FROM (SELECT *, row_number() OVER (PARTITION BY source_id, anchor_x IS NULL ORDER BY frame) AS rnk, (anchor_x IS NOT NULL)::INT::DOUBLE AS observed,
          CASE WHEN anchor_x IS NOT NULL THEN {'frame': frame, 'anchor_x': anchor_x, 'anchor_y': anchor_y} END AS pt FROM (SELECT source_id*10000000000 + CAST(frame // 12 AS BIGINT) AS source_id, frame % 12 AS frame, anchor_x, anchor_y FROM v_anchor)))) WHERE NOT rejected""", ("v_anchor",))
oracle("clip_features76", f"SELECT source_id, position, {_KP}, {r6('x', 'y', 'visible', 'vx', 'vy', 'ax', 'ay', 'anchor_x', 'anchor_y')}, observed FROM flegacy JOIN ckin USING (source_id, position) JOIN canchor USING (source_id, position)", ("flegacy", "ckin", "canchor"))


@query("combined_features")
def _(spark, sf):
    frames, poses = pose_spine(spark, sf)
    points, sampled = track_plans.sampled(spark, sf)
    labels = frames.select("source_id", "frame", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")).withColumn("label", (F.col("frame") + F.col("seq")) % 2)
    return rounded(ops.combined_features(ops.pose_features(frames, poses), tracks.kinematics7(points, sampled), labels.filter("frame % 5 <> 4")).drop("position"))


cte("fkin", CTES["t_kin7"][1].replace("WHERE frame % 2 = 0", "").replace("CAST(frame // 2 AS BIGINT) AS position", "frame AS position"), ("v_tracks",))
oracle("combined_features", f"SELECT source_id, position AS frame, {_KP}, {r6('x', 'y', 'visible', 'vx', 'vy', 'ax', 'ay')}, (position + 1) % 2 AS label FROM ffill JOIN fkin USING (source_id, position) WHERE position % 5 <> 4", ("ffill", "fkin"))


def labelled(spark, sf):
    frames = fixtures.tracks(spark, sf).select("source_id", "frame", "peak_value")
    intervals = fixtures.intervals(spark, sf).filter("side = 'label'")
    return ops.interval_labels(frames, intervals)


cte("flabel", """SELECT source_id, frame, peak, CASE WHEN EXISTS (SELECT 1 FROM v_intervals i WHERE i.side = 'label' AND i.source_id = t.source_id AND t.frame BETWEEN i.start_frame AND i.end_frame) THEN 1 ELSE 0 END AS label FROM v_tracks t""", ("v_tracks", "v_intervals"))


@query("interval_labels")
def _(spark, sf):
    return labelled(spark, sf).drop("peak_value")


oracle("interval_labels", "SELECT source_id, frame, label FROM flabel", ("flabel",))
L = 15


@query("build_sequences")
def _(spark, sf):
    rows = ops.build_sequences(labelled(spark, sf).withColumn("position", F.col("frame")), L, ("peak_value", "label"))
    weight = lambda c: F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return rounded(rows.select("source_id", "start_frame", "end_frame", F.size("label_seq").alias("length"), weight("peak_value_seq").alias("peaks"), weight("label_seq").alias("labels")))


oracle("build_sequences", """SELECT source_id, frame AS start_frame, frame + 14 AS end_frame, 15 AS length, round(list_sum(list_transform(range(1, 16), lambda i: p[i]*i)), 6) AS peaks, list_sum(list_transform(range(1, 16), lambda i: l[i]*i))::DOUBLE AS labels
    FROM (SELECT source_id, frame, list(peak) OVER w AS p, list(label) OVER w AS l FROM flabel WINDOW w AS (PARTITION BY source_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING)) WHERE len(p) = 15""", ("flabel",))


@query("edge_label_smoothing")
def _(spark, sf):
    rows = ops.build_sequences(labelled(spark, sf).withColumn("position", F.col("frame")), L, ("label",))
    rows = rows.withColumn("y", F.transform("label_seq", lambda v: v.cast("double")))
    rows = rows.select("source_id", "start_frame", F.posexplode(ops.edge_label_smoothing("y", L, 4, 0.2)).alias("t", "label"))
    return rounded(rows)


oracle("edge_label_smoothing", """SELECT source_id, frame AS start_frame, CAST(i - 1 AS INT) AS t, round(CASE WHEN i <= 4 AND l[i] <> l[i+1] OR i >= 12 AND l[i] <> l[i-1] THEN l[i]*0.8::DOUBLE + 0.1::DOUBLE ELSE l[i]::DOUBLE END, 6) AS label
    FROM (SELECT *, unnest(range(1, 16)) AS i FROM (SELECT source_id, frame, list(label) OVER (PARTITION BY source_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS l FROM flabel) WHERE len(l) = 15)""", ("flabel",))


@query("average_overlaps")
def _(spark, sf):
    rows = ops.build_sequences(labelled(spark, sf).withColumn("position", F.col("frame")), L, ("peak_value",))
    probs = F.transform("peak_value_seq", lambda v, i: v * 0.4 + i / 100.0)
    return rounded(ops.average_overlaps(rows.select("source_id", "position", probs.alias("probabilities"))))


oracle("average_overlaps", """SELECT source_id, position, round(avg(p), 6) AS probability, CASE WHEN avg(p) > 0.31 THEN 1 ELSE 0 END AS pred FROM (SELECT w.source_id, w.frame + i AS position, t.peak*0.4::DOUBLE + i/100.0::DOUBLE AS p
    FROM (SELECT source_id, frame, unnest(range(15)) AS i, max(frame) OVER (PARTITION BY source_id) AS last FROM flabel) w JOIN flabel t ON t.source_id = w.source_id AND t.frame = w.frame + i WHERE w.frame + 14 <= last) GROUP BY ALL""", ("flabel",))


@query("group_split")
def _(spark, sf):
    return ops.group_split(fixtures.tracks(spark, sf))


oracle("group_split", """SELECT source_id, n, CASE WHEN coalesce(b, 0) < greatest(1, CAST(round_even(total*0.2::DOUBLE, 0) AS BIGINT)) AND place < groups THEN 'validation' ELSE 'train' END AS split
    FROM (SELECT *, sum(n) OVER (ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, row_number() OVER (ORDER BY draw) AS place, count(*) OVER () AS groups, sum(n) OVER () AS total FROM (SELECT source_id, count(*) AS n, md5('42|' || source_id) AS draw FROM v_tracks GROUP BY source_id))""", ("v_tracks",))


@query("group_split_by_count")
def _(spark, sf):
    return ops.group_split_by_count(fixtures.tracks(spark, sf))


oracle("group_split_by_count", """SELECT source_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || source_id)) <= ceil(count(*) OVER ()*0.2::DOUBLE - 1e-9) THEN 'validation' ELSE 'train' END AS split FROM (SELECT DISTINCT source_id FROM v_tracks)""", ("v_tracks",))


@query("split_leakage")
def _(spark, sf):
    """Leakage of a split made by frame instead of by source: every source is on both sides."""
    rows = fixtures.tracks(spark, sf).select("source_id", F.when(F.col("frame") < 100, "validation").otherwise("train").alias("split"))
    return ops.split_leakage(rows)


oracle("split_leakage", "SELECT source_id FROM v_tracks GROUP BY source_id HAVING min(frame) < 100 AND max(frame) >= 100", ("v_tracks",))


@query("clip_label")
def _(spark, sf):
    clips = fixtures.table(spark, sf, "events").select(F.concat("event_type", F.lit("_s"), "user_id", F.lit("_"), "event_id").alias("clip"))
    return ops.clip_label(clips)


oracle("clip_label", "SELECT event_type || '_s' || user_id || '_' || event_id AS clip, event_type AS label, dense_rank() OVER (ORDER BY event_type) - 1 AS label_index FROM events")
