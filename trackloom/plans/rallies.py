"""Segmentation, decoding and correction queries."""

from pyspark.sql import functions as F

from trackloom import fixtures
from trackloom.operators import court
from trackloom.operators import rallies as ops
from trackloom.operators import tracks
from trackloom.plans import court as court_plans
from trackloom.plans import tracks as track_plans
from trackloom.plans.base import cte, oracle, query, r6, rounded
from trackloom.session import materialize

FPS = fixtures.FPS


def rally_frames(spark, sf):
    """Preprocessed tracks with the court-region and player signals joined on."""
    frames = tracks.preprocess_tracks(track_plans.normalized(spark, sf))
    cal = fixtures.calibrations(spark, sf)
    frames = court.shuttle_inside_region(frames, cal)
    return frames.join(court.players_on_court(fixtures.player_rows(spark, sf), cal), ["source_id", "frame"], "left")


def stored_frames(spark, sf):
    """``rally_frames`` written once, for queries that read them several times."""
    return materialize(rally_frames(spark, sf).select(
        "source_id", "frame", "visible_streak", "missing_count", "reliable", "removed", "speed", "smooth_x", "cleaned", "interpolated",
        "inside_courtish", "players_on_courtish", "players_opposite_service_regions", "player_activity"), "frames")


cte("r_frames", """SELECT t.*, inside_courtish AS inside, players_on_courtish AS on_court, players_opposite_service_regions AS serve,
    player_activity AS activity, smooth_x IS NOT NULL AND (cleaned OR interpolated) AS present
    FROM t_streak t LEFT JOIN v_inside USING (source_id, frame) LEFT JOIN v_on_court USING (source_id, frame) LEFT JOIN v_players USING (source_id, frame)""",
    ("t_streak", "v_inside", "v_on_court", "v_players"))

EV = """SELECT source_id, frame, cleaned, visible_streak >= 5 AS vis, missing_count > 12 AS lost,
    frame >= 44 AND motion45 <= 0.0015*45 AND NOT coalesce(act45 >= 0.15, false) AS stopped,
    missing_count > 30 AND motion30 < 0.015 AND NOT coalesce(act30 >= 0.25, false) AS quiet, missing_count >= 60 AS longgap,
    coalesce(NOT inside, false) AND NOT coalesce(on_court, false) AS tick, coalesce(inside, false) OR coalesce(on_court, false) AS back,
    cleaned AND motion30 >= 0.015 AND visible_streak >= 5 AS moving, serve IS NOT NULL AS sseen, coalesce(serve, false) AS sok,
    count(serve) OVER f5 > 0 AS sseen5, coalesce(bool_or(serve) OVER f5, false) AS sok5
  FROM (SELECT *, sum(speed) OVER f45 AS motion45, sum(speed) OVER f30 AS motion30, avg(activity) OVER f45 AS act45, avg(activity) OVER f30 AS act30 FROM {src}
    WINDOW f45 AS (PARTITION BY source_id ORDER BY frame ROWS BETWEEN 44 PRECEDING AND CURRENT ROW), f30 AS (PARTITION BY source_id ORDER BY frame ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
  WINDOW f5 AS (PARTITION BY source_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""
cte("r_ev", EV.format(src="r_frames"), ("r_frames",))

MACHINE = """SELECT source_id, -1::BIGINT AS frame, 'IDLE' AS st, 0::BIGINT AS cs, 0::BIGINT AS ce, '' AS rs, 0 AS os, false AS seen, false AS tru, NULL::BIGINT AS es, NULL::BIGINT AS ee
    FROM (SELECT DISTINCT source_id FROM {ev})
  UNION ALL
  SELECT source_id, frame,
    CASE st WHEN 'IDLE' THEN CASE WHEN vis THEN 'CANDIDATE_START' ELSE st END
      WHEN 'CANDIDATE_START' THEN CASE WHEN lost THEN 'IDLE' WHEN ready THEN CASE WHEN tru1 OR NOT seen1 THEN 'IN_RALLY' ELSE 'IDLE' END ELSE st END
      WHEN 'IN_RALLY' THEN CASE WHEN done THEN 'CANDIDATE_END' ELSE st END
      ELSE CASE WHEN rec THEN 'IN_RALLY' WHEN over THEN 'IDLE' ELSE st END END,
    CASE WHEN st = 'IDLE' AND vis THEN frame - 4 WHEN st = 'CANDIDATE_START' AND NOT lost AND ready AND (tru1 OR NOT seen1) THEN greatest(0, cs - 15) ELSE cs END,
    CASE WHEN st = 'IN_RALLY' AND done THEN frame ELSE ce END,
    CASE WHEN st = 'IN_RALLY' AND done THEN CASE WHEN os1 >= 30 THEN 'outside' WHEN longgap THEN 'long_gap' WHEN quiet THEN 'medium_gap' ELSE 'stopped' END ELSE rs END,
    CASE WHEN st = 'CANDIDATE_END' AND rec THEN 0 ELSE os1 END,
    CASE WHEN st = 'IDLE' THEN vis AND sseen5 ELSE seen1 END, CASE WHEN st = 'IDLE' THEN vis AND sok5 ELSE tru1 END,
    CASE WHEN (st = 'CANDIDATE_START' AND lost) OR (st = 'CANDIDATE_END' AND over AND NOT rec) THEN cs END,
    CASE WHEN st = 'CANDIDATE_START' AND lost THEN frame - 1 WHEN st = 'CANDIDATE_END' AND over AND NOT rec THEN greatest(cs, ce + 14) END
  FROM (SELECT *, stopped OR quiet OR longgap OR os1 >= 30 AS done, frame - cs + 1 >= 15 AS ready, frame - ce + 1 >= 45 AS over, CASE WHEN rs = 'outside' THEN back ELSE moving END AS rec
    FROM (SELECT e.*, st, cs, ce, rs, seen OR sseen AS seen1, tru OR sok AS tru1, CASE WHEN tick THEN os + 1 WHEN back THEN 0 ELSE os END AS os1
      FROM {sm} m JOIN {ev} e ON e.source_id = m.source_id AND e.frame = m.frame + 1))"""
SPANS = """SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY at_frame) AS number FROM (
    SELECT source_id, es AS start_frame, least(ee, last) AS end_frame, frame AS at_frame, false AS open_ended FROM {sm} JOIN (SELECT source_id, max(frame) AS last FROM {ev} GROUP BY source_id) USING (source_id) WHERE es IS NOT NULL
    UNION ALL SELECT source_id, cs, frame, frame + 1, true FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY frame DESC) AS back_no FROM {sm})
      WHERE back_no = 1 AND (st IN ('IN_RALLY', 'CANDIDATE_END') OR (st = 'CANDIDATE_START' AND (tru OR NOT seen))))"""
SCORED = """SELECT *, greatest(0, least(1, (reliable_frames::DOUBLE/n*0.4 + CASE WHEN steps > 0 THEN moving_steps::DOUBLE/steps ELSE 0 END*0.25 + coalesce(act*0.15, 0)) / CASE WHEN act IS NULL THEN 0.65 ELSE 0.8 END
      - 0.1*least(1.0::DOUBLE, longest/60.0::DOUBLE) - 0.1*removed_frames/n)) AS score FROM (
    SELECT s.source_id, s.number, any_value(s.start_frame) AS start_frame, any_value(s.end_frame) AS end_frame, any_value(s.open_ended) AS open_ended, count(*) AS n, count(*) FILTER (cleaned) AS reliable_frames,
      count(*) FILTER (removed) AS removed_frames, count(*) FILTER (present) AS steps, count(*) FILTER (present AND speed > 0.0015 AND speed <= 0.35) AS moving_steps,
      max(missing_count) AS longest, sum(speed) AS motion, avg(activity) AS act
    FROM {spans} s JOIN {src} f ON f.source_id = s.source_id AND f.frame BETWEEN s.start_frame AND s.end_frame GROUP BY s.source_id, s.number)"""
CLASSED = """SELECT source_id, source_id || '-' || lpad(number::VARCHAR, 4, '0') AS rally_id, start_frame, end_frame, round(start_frame/30.0::DOUBLE, 6) + 0.0 AS start_time, round(end_frame/30.0::DOUBLE, 6) + 0.0 AS end_time, status,
    round(score, 6) + 0.0 AS confidence, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS confidence_band,
    CASE WHEN status = 'review' AND NOT contains(fl, 'manual_review_needed') THEN concat_ws(';', nullif(fl, ''), 'manual_review_needed') ELSE fl END AS flags, reasons AS failure_reason,
    '' AS manual_start_frame, '' AS manual_end_frame, '' AS manual_decision
  FROM (SELECT *, CASE WHEN reasons <> '' THEN 'rejected' WHEN fl <> '' THEN 'review' ELSE 'accepted' END AS status
    FROM (SELECT *, concat_ws(';', CASE WHEN n < 60 THEN 'short_rally' END, CASE WHEN reliable_frames < 20 THEN 'insufficient_reliable_detections' END, CASE WHEN motion < 0.08 THEN 'insufficient_motion' END) AS reasons,
      concat_ws(';', {base} CASE WHEN open_ended THEN 'manual_review_needed' END, CASE WHEN reliable_frames::DOUBLE/n < 0.5 THEN 'low_shuttle_confidence' END,
        CASE WHEN longest >= 60 THEN 'large_missing_gap' END, CASE WHEN n < 60 THEN 'short_rally' END) AS fl FROM {scored}))"""


def machine_ctes(prefix: str, ev: str, frames: str, base: str = "") -> None:
    cte(f"{prefix}_sm", MACHINE.format(sm=f"{prefix}_sm", ev=ev), (ev,))
    cte(f"{prefix}_spans", SPANS.format(sm=f"{prefix}_sm", ev=ev), (f"{prefix}_sm",))
    cte(f"{prefix}_scored", SCORED.format(spans=f"{prefix}_spans", src=frames), (f"{prefix}_spans", frames))
    cte(f"{prefix}_rallies", CLASSED.format(scored=f"{prefix}_scored", base=base), (f"{prefix}_scored",))


machine_ctes("r", "r_ev", "r_frames")


@query("segment_rallies")
def segment_rallies(spark, sf):
    return rounded(ops.segment_rallies(rally_frames(spark, sf), FPS))


oracle("segment_rallies", "SELECT * FROM r_rallies", ("r_rallies",), recursive=True)


@query("segment_rallies_tracks_only")
def _(spark, sf):
    """The plain path: no court and no player evidence."""
    return rounded(ops.segment_rallies(tracks.preprocess_tracks(track_plans.normalized(spark, sf)), FPS))


cte("p_frames", """SELECT *, NULL::BOOLEAN AS inside, NULL::BOOLEAN AS on_court, NULL::BOOLEAN AS serve, NULL::DOUBLE AS activity,
    smooth_x IS NOT NULL AND (cleaned OR interpolated) AS present FROM t_streak""", ("t_streak",))
cte("p_ev", EV.format(src="p_frames"), ("p_frames",))
machine_ctes("p", "p_ev", "p_frames")
oracle("segment_rallies_tracks_only", "SELECT * FROM p_rallies", ("p_rallies",), recursive=True)


@query("frame_states")
def _(spark, sf):
    return ops.frame_states(ops.with_evidence(stored_frames(spark, sf)))


oracle("frame_states", "SELECT source_id, frame, st AS state FROM r_sm WHERE frame >= 0", ("r_sm",), recursive=True)


@query("service_start_gate")
def _(spark, sf):
    """Intervals found with the serve gate that the plain machine finds as well, and those it stops."""
    frames = stored_frames(spark, sf)
    gated = ops.rally_spans(ops.with_evidence(frames)).select("source_id", "start_frame", "end_frame", F.lit(True).alias("gated"))
    free = ops.rally_spans(ops.with_evidence(frames.drop("players_opposite_service_regions"))).select(
        "source_id", "start_frame", "end_frame", F.lit(True).alias("free"))
    both = gated.join(free, ["source_id", "start_frame", "end_frame"], "full")
    return both.select("source_id", "start_frame", "end_frame", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("gated", "free")])


cte("g_frames", "SELECT * EXCLUDE (serve), NULL::BOOLEAN AS serve FROM r_frames", ("r_frames",))
cte("g_ev", EV.format(src="g_frames"), ("g_frames",))
machine_ctes("g", "g_ev", "g_frames")
oracle("service_start_gate", """SELECT source_id, start_frame, end_frame, coalesce(gated, false) AS gated, coalesce(free, false) AS free FROM (SELECT source_id, start_frame, end_frame, true AS gated FROM r_spans)
    FULL JOIN (SELECT source_id, start_frame, end_frame, true AS free FROM g_spans) USING (source_id, start_frame, end_frame)""", ("r_spans", "g_spans"), recursive=True)


@query("score_rallies")
def _(spark, sf):
    """Scores of fixed-length intervals over every source."""
    frames = ops.with_presence(rally_frames(spark, sf))
    spans = frames.select("source_id", F.floor(F.col("frame") / 75).cast("long").alias("number")).distinct().select(
        "source_id", "number", (F.col("number") * 75).alias("start_frame"), (F.col("number") * 75 + 89).alias("end_frame"), F.lit(False).alias("open_ended"))
    return rounded(ops.score_rallies(spans, frames).select("source_id", "number", "start_frame", "end_frame", "reliable_frames", "motion", "score",
                                                           F.concat_ws(";", "score_flags").alias("score_flags")))


cte("f_spans", """SELECT DISTINCT source_id, CAST(frame // 75 AS BIGINT) AS number, CAST(frame // 75 AS BIGINT)*75 AS start_frame, CAST(frame // 75 AS BIGINT)*75 + 89 AS end_frame, false AS open_ended FROM t_streak""", ("t_streak",))
cte("f_scored", SCORED.format(spans="f_spans", src="r_frames"), ("f_spans", "r_frames"))
oracle("score_rallies", f"""SELECT source_id, number, start_frame, end_frame, reliable_frames, {r6('motion', 'score')},
    concat_ws(';', CASE WHEN reliable_frames::DOUBLE/n < 0.5 THEN 'low_shuttle_confidence' END, CASE WHEN longest >= 60 THEN 'large_missing_gap' END) AS score_flags FROM f_scored""", ("f_scored",))


@query("classify_rallies")
def _(spark, sf):
    frames = stored_frames(spark, sf)
    spans = ops.rally_spans(ops.with_evidence(frames))
    rows = ops.classify_rallies(ops.score_rallies(spans, ops.with_presence(frames)), 25.0, base_flags=["court_projection_unstable", "manual_review_needed"])
    return rows.groupBy("status", "confidence_band", "flags", "failure_reason").agg(F.count(F.lit(1)).alias("n"))


cte("c25", CLASSED.format(scored="r_scored", base="'court_projection_unstable', 'manual_review_needed', 'non_30_fps',"), ("r_scored",))
oracle("classify_rallies", """SELECT status, confidence_band, replace(replace(flags, 'non_30_fps;manual_review_needed', 'non_30_fps'), 'x', 'x') AS flags, failure_reason, count(*) AS n FROM c25 GROUP BY ALL""",
       ("c25",), recursive=True)


@query("player_activity_guard")
def _(spark, sf):
    players = fixtures.player_rows(spark, sf).select("source_id", "frame", F.when(F.col("player1_valid") > 0, F.col("player_activity")).alias("player_activity"))
    return rounded(ops.player_activity_guard(players).select("source_id", "frame", "activity_recent", "activity_stopped", "veto_quiet_gap", "veto_stopped"))


oracle("player_activity_guard", f"""SELECT source_id, frame, {r6('activity_recent', 'activity_stopped')}, coalesce(activity_recent >= 0.25, false) AS veto_quiet_gap, coalesce(activity_stopped >= 0.15, false) AS veto_stopped
    FROM (SELECT source_id, frame, avg(a) OVER (PARTITION BY source_id ORDER BY frame ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS activity_recent,
      avg(a) OVER (PARTITION BY source_id ORDER BY frame ROWS BETWEEN 44 PRECEDING AND CURRENT ROW) AS activity_stopped
      FROM (SELECT source_id, frame, CASE WHEN player1_valid > 0 THEN player_activity END AS a FROM v_players))""", ("v_players",))


def mixed_sources(spark, sf):
    """Source registrations with four frame rates."""
    k = F.col("s_suppkey")
    return fixtures.table(spark, sf, "supplier").select(k.alias("source_id"), F.when(k % 4 == 0, 30.0).when(k % 4 == 1, 25.0).when(k % 4 == 2, 59.94).otherwise(12.5).alias("fps"))


@query("scaled_thresholds")
def _(spark, sf):
    return ops.scaled_thresholds(mixed_sources(spark, sf))


def _scaled(value: int) -> str:
    return f"greatest(1, CAST(round_even({value}.0::DOUBLE*fps/30, 0) AS INT))"


oracle("scaled_thresholds", "SELECT source_id, fps, " + ", ".join(f"{_scaled(getattr(ops.DEFAULTS, n))} AS {n}" for n in ops.SCALED_FIELDS if n != "smoothing_window")
       + f""", greatest(3, CAST({_scaled(7)} + (1 - {_scaled(7)} % 2) AS INT)) AS smoothing_window, 2 AS smoothing_polyorder
    FROM (SELECT s_suppkey AS source_id, CASE s_suppkey % 4 WHEN 0 THEN 30.0::DOUBLE WHEN 1 THEN 25.0::DOUBLE WHEN 2 THEN 59.94::DOUBLE ELSE 12.5::DOUBLE END AS fps FROM supplier)""")


def probabilities(spark, sf):
    return fixtures.tracks(spark, sf).select(
        "source_id", "frame", F.when(F.col("visibility") == 1, F.col("peak_value")).otherwise(0.1).alias("probability"),
        ((F.col("raw_x") % 7).cast("double") / 1000.0).alias("motion"))


@query("decode_probabilities")
def _(spark, sf):
    return rounded(ops.decode_probabilities(probabilities(spark, sf), FPS, threshold=0.6))


cte("d_base", "SELECT source_id, frame, CASE WHEN visibility = 1 THEN peak ELSE 0.1 END >= 0.6 AS cleaned, (raw_x % 7)::DOUBLE/1000 AS speed FROM v_tracks", ("v_tracks",))
cte("d_frames", """SELECT *, cleaned AS present, false AS removed, CASE WHEN cleaned THEN run ELSE 0 END AS visible_streak, CASE WHEN cleaned THEN 0 ELSE run END AS missing_count,
    NULL::BOOLEAN AS inside, NULL::BOOLEAN AS on_court, NULL::BOOLEAN AS serve, NULL::DOUBLE AS activity
    FROM (SELECT *, row_number() OVER (PARTITION BY source_id, cleaned, grp ORDER BY frame) AS run
      FROM (SELECT *, frame - row_number() OVER (PARTITION BY source_id, cleaned ORDER BY frame) AS grp FROM d_base))""", ("d_base",))
cte("d_ev", EV.format(src="d_frames"), ("d_frames",))
machine_ctes("d", "d_ev", "d_frames", "'decoded_from_model_probabilities',")
oracle("decode_probabilities", "SELECT * FROM d_rallies", ("d_rallies",), recursive=True)


def binary(spark, sf):
    """1 where a block of frames is active, with scattered misses."""
    return fixtures.tracks(spark, sf).select("source_id", "frame", F.when(
        ((F.col("frame") + F.col("source_id") * 13) % 200 < 150) & ((F.col("frame") % 47 > 1) | (F.col("source_id") % 3 == 0)), 1).otherwise(0).alias("pred"))


cte("b_pred", """SELECT source_id, frame, CASE WHEN (frame + source_id*13) % 200 < 150 AND (frame % 47 > 1 OR source_id % 3 = 0) THEN 1 ELSE 0 END AS pred FROM v_tracks""", ("v_tracks",))


@query("smooth_binary")
def _(spark, sf):
    flips = binary(spark, sf).withColumn("pred", F.when(F.col("frame") % 3 == 0, 1 - F.col("pred")).otherwise(F.col("pred")))
    return ops.smooth_binary(flips).select("source_id", "frame", "smoothed")


oracle("smooth_binary", """SELECT f.source_id, f.frame, CASE WHEN sum(g.p * w) >= 3 THEN 1 ELSE 0 END AS smoothed
    FROM (SELECT source_id, max(frame) AS last FROM b_pred GROUP BY source_id) l JOIN b_pred f USING (source_id),
      LATERAL (SELECT t.j, CASE WHEN t.j < 0 THEN -1 - t.j WHEN t.j > last THEN 2*last + 1 - t.j ELSE t.j END AS k, 1 AS w FROM (SELECT f.frame + unnest([-2, -1, 0, 1, 2]) AS j) t) x
      JOIN (SELECT source_id AS gs, frame AS gf, CASE WHEN frame % 3 = 0 THEN 1 - pred ELSE pred END AS p FROM b_pred) g ON g.gs = f.source_id AND g.gf = x.k
    GROUP BY f.source_id, f.frame""", ("b_pred",))


@query("segment_binary")
def _(spark, sf):
    return ops.segment_binary(binary(spark, sf))


cte("b_ev", """SELECT *, min(pred) OVER a = 1 AND count(*) OVER (PARTITION BY source_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 30 FOLLOWING) = 31 AS soft, sum(pred) OVER a = 0 AS norec
    FROM b_pred WINDOW a AS (PARTITION BY source_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)""", ("b_pred",))
cte("b_sm", """SELECT source_id, -1::BIGINT AS frame, NULL::BIGINT AS rs, 0 AS g, NULL::BIGINT AS es FROM (SELECT DISTINCT source_id FROM b_ev)
    UNION ALL SELECT e.source_id, e.frame, CASE WHEN pred = 1 THEN CASE WHEN rs IS NULL AND soft THEN e.frame ELSE rs END WHEN rs IS NOT NULL AND g + 1 >= 3 AND norec THEN NULL ELSE rs END,
      CASE WHEN pred = 1 THEN CASE WHEN rs IS NULL THEN g ELSE 0 END WHEN rs IS NULL THEN g WHEN g + 1 >= 3 THEN 0 ELSE g + 1 END,
      CASE WHEN pred = 0 AND rs IS NOT NULL AND g + 1 >= 3 AND norec AND e.frame - rs >= 50 THEN rs END
    FROM b_sm m JOIN b_ev e ON e.source_id = m.source_id AND e.frame = m.frame + 1""", ("b_ev",))
oracle("segment_binary", """SELECT source_id, es AS start_frame, frame AS end_frame FROM b_sm WHERE es IS NOT NULL UNION ALL
    SELECT source_id, rs, frame FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY frame DESC) AS n FROM b_sm) WHERE n = 1 AND rs IS NOT NULL AND frame - rs >= 50""", ("b_sm",), recursive=True)


def predicted(spark, sf):
    return fixtures.intervals(spark, sf).filter("side = 'pred'").drop("side")


@query("pad_bounds")
def _(spark, sf):
    rows = predicted(spark, sf)
    src = rows.groupBy("source_id").agg((F.max("end_frame") + 10).alias("frame_count")).withColumn("fps", F.lit(25.0))
    return ops.pad_bounds(rows, src, 2.5, 0.5)


oracle("pad_bounds", """SELECT source_id, rally_id, start_frame, end_frame, greatest(0, start_frame - 62) AS padded_start, least(max(end_frame) OVER (PARTITION BY source_id) + 9, end_frame + 12) AS padded_end
    FROM v_intervals WHERE side = 'pred'""", ("v_intervals",))


@query("clip_windows")
def _(spark, sf):
    hits = predicted(spark, sf).select("source_id", "rally_id", F.col("start_frame").alias("frame"))
    src = hits.groupBy("source_id").agg((F.max("frame") + 10).alias("frame_count")).withColumn("fps", F.lit(29.97))
    return ops.clip_windows(hits, src)


oracle("clip_windows", """SELECT source_id, rally_id, frame, clip_start, least(clip_start + 35, last + 9) AS clip_end FROM (SELECT source_id, rally_id, start_frame AS frame,
    greatest(0, CAST(trunc(start_frame - 29.97*0.5) AS BIGINT)) AS clip_start, max(start_frame) OVER (PARTITION BY source_id) AS last FROM v_intervals WHERE side = 'pred')""", ("v_intervals",))


def reviewed(spark, sf):
    """Rallies as a reviewer left them: text columns, some of them wrong."""
    k = F.col("rally_id")
    text = lambda c: F.col(c).cast("string")
    return predicted(spark, sf).select(
        "source_id", F.concat(F.lit("r"), F.when(k % 97 == 5, k - 1).otherwise(k)).alias("rally_id"), (k + 2).alias("row_number"),
        F.when(k % 53 == 0, "x1").otherwise(text("start_frame")).alias("start_frame"), text("end_frame").alias("end_frame"),
        F.when(k % 3 == 0, "accepted").when(k % 3 == 1, "review").otherwise("rejected").alias("status"),
        F.when(k % 13 == 0, (F.col("start_frame") - 90).cast("string")).when(k % 29 == 0, " 12b").otherwise(" ").alias("manual_start_frame"),
        F.when(k % 17 == 0, (F.col("end_frame") + 75).cast("string")).otherwise("").alias("manual_end_frame"),
        F.when(k % 5 == 0, "reject").when((k % 5 == 1) | (k % 13 == 0), " Accept").when(k % 41 == 0, "maybe").otherwise("").alias("manual_decision"))


cte("v_reviewed", """SELECT source_id, 'r' || CASE WHEN k % 97 = 5 THEN k - 1 ELSE k END AS rally_id, k + 2 AS row_number,
    CASE WHEN k % 53 = 0 THEN 'x1' ELSE s::VARCHAR END AS start_frame, e::VARCHAR AS end_frame, CASE k % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'review' ELSE 'rejected' END AS status,
    CASE WHEN k % 13 = 0 THEN (s - 90)::VARCHAR WHEN k % 29 = 0 THEN ' 12b' ELSE ' ' END AS manual_start_frame, CASE WHEN k % 17 = 0 THEN (e + 75)::VARCHAR ELSE '' END AS manual_end_frame,
    CASE WHEN k % 5 = 0 THEN 'reject' WHEN k % 5 = 1 OR k % 13 = 0 THEN ' Accept' WHEN k % 41 = 0 THEN 'maybe' ELSE '' END AS manual_decision
    FROM (SELECT source_id, rally_id AS k, start_frame AS s, end_frame AS e FROM v_intervals WHERE side = 'pred')""", ("v_intervals",))


@query("validate_corrections")
def _(spark, sf):
    return ops.validate_corrections(reviewed(spark, sf), 60, 900)


oracle("validate_corrections", """, b AS (SELECT *, lower(trim(manual_decision)) AS d, trim(manual_start_frame) <> '' AS ms, trim(manual_end_frame) <> '' AS me,
      try_cast(start_frame AS BIGINT) IS NULL OR try_cast(end_frame AS BIGINT) IS NULL AS bad,
      CASE WHEN trim(manual_start_frame) <> '' THEN try_cast(trim(manual_start_frame) AS BIGINT) ELSE try_cast(start_frame AS BIGINT) END AS s,
      CASE WHEN trim(manual_end_frame) <> '' THEN try_cast(trim(manual_end_frame) AS BIGINT) ELSE try_cast(end_frame AS BIGINT) END AS e FROM v_reviewed),
    c AS (SELECT *, bad OR s IS NULL OR e IS NULL AS unr, row_number > min(row_number) OVER (PARTITION BY rally_id) AS dup FROM b)
    SELECT source_id, row_number, problem, NULL::BIGINT AS other_row FROM (
      SELECT *, 'invalid_decision' AS problem FROM c WHERE d NOT IN ('', 'accept', 'reject') UNION ALL SELECT *, 'boundaries_without_accept' FROM c WHERE d <> 'accept' AND (ms OR me)
      UNION ALL SELECT *, 'duplicate_rally_id' FROM c WHERE dup UNION ALL SELECT *, 'boundaries_not_integers' FROM c WHERE unr UNION ALL SELECT *, 'invalid_boundaries' FROM c WHERE NOT unr AND (s < 0 OR e < s)
      UNION ALL SELECT *, 'start_outside_source' FROM c WHERE NOT unr AND s < 60 UNION ALL SELECT *, 'end_outside_source' FROM c WHERE NOT unr AND e > 900)
    UNION ALL SELECT source_id, prow, 'overlap', row_number FROM (SELECT *, lag(e) OVER w AS pe, lag(row_number) OVER w AS prow FROM c WHERE NOT unr AND d <> 'reject'
      WINDOW w AS (PARTITION BY source_id ORDER BY s, e, row_number)) WHERE s <= pe""", ("v_reviewed",))


@query("finalize_rallies")
def _(spark, sf):
    good = reviewed(spark, sf).filter("start_frame <> 'x1' AND manual_start_frame <> ' 12b'")
    return rounded(ops.finalize_rallies(good, 29.97).drop("row_number"))


oracle("finalize_rallies", """SELECT source_id, rally_id, s AS start_frame, e AS end_frame, round(s/29.97::DOUBLE, 6) + 0.0 AS start_time, round(e/29.97::DOUBLE, 6) + 0.0 AS end_time, 'accepted' AS status, manual_start_frame, manual_end_frame, manual_decision
    FROM (SELECT *, CAST(coalesce(nullif(trim(manual_start_frame), ''), start_frame) AS BIGINT) AS s, CAST(coalesce(nullif(trim(manual_end_frame), ''), end_frame) AS BIGINT) AS e
      FROM v_reviewed WHERE start_frame <> 'x1' AND manual_start_frame <> ' 12b' AND lower(trim(manual_decision)) <> 'reject' AND (trim(manual_decision) <> '' OR status = 'accepted'))""", ("v_reviewed",))
