"""Evidence-fusion queries."""

from pyspark.sql import functions as F

from trackloom import fixtures
from trackloom.operators import fusion as ops
from trackloom.operators.players import frame_spine
from trackloom.plans.base import cte, oracle, query, r6, rounded

FPS, W, H = fixtures.FPS, fixtures.WIDTH, fixtures.HEIGHT


def slots(spark, sf):
    """Near and far player per frame: mostly still, with bursts, gaps and reasons."""
    rn, q, pk = F.col("rn"), F.col("q"), F.col("pk")
    rows = fixtures._supplier_rows(spark, sf).select(
        "source_id", rn.alias("frame"), F.explode(F.array(F.lit(1), F.lit(2))).alias("slot"), "q", "pk")
    f, s = F.col("frame"), F.col("slot")
    moving = (f + F.col("source_id") * 7) % 90 >= 50
    jitter = F.when(moving, (F.col("pk") % 50).cast("double") / 30.7).otherwise((F.col("pk") % 3).cast("double") / 3070.0)
    return rows.select(
        "source_id", "frame", "slot", F.when((F.col("q") != 7) | (s == 1), jitter).alias("court_x"),
        (F.when(s == 1, -3.0).otherwise(3.0) + F.when(F.col("pk") % 41 == 0, F.when(s == 1, 6.0).otherwise(-6.0)).otherwise(0.0)).alias("court_y"),
        F.when((f % 130 > 124) & (s == 2), "incumbent_retained").alias("reason"))


cte("fslots", """SELECT source_id, rn AS frame, slot, CASE WHEN q <> 7 OR slot = 1 THEN CASE WHEN (rn + source_id*7) % 90 >= 50 THEN (pk % 50)::DOUBLE/30.7 ELSE (pk % 3)::DOUBLE/3070 END END AS court_x,
    CASE slot WHEN 1 THEN -3.0::DOUBLE ELSE 3.0::DOUBLE END + CASE WHEN pk % 41 = 0 THEN CASE slot WHEN 1 THEN 6.0::DOUBLE ELSE -6.0::DOUBLE END ELSE 0 END AS court_y,
    CASE WHEN rn % 130 > 124 AND slot = 2 THEN 'incumbent_retained' END AS reason FROM v_rows, (VALUES (1), (2)) s(slot)""", ("v_rows",))
cte("fp", """SELECT source_id, frame, p1 IS NOT NULL AND p2 IS NOT NULL AS unambiguous, coalesce(p1.y < 0 AND p2.y > 0, false) AS opposite_halves,
    coalesce(sqrt(pow(p1.x - l1.x, 2) + pow(p1.y - l1.y, 2)), 0) + coalesce(sqrt(pow(p2.x - l2.x, 2) + pow(p2.y - l2.y, 2)), 0) AS activity
    FROM (SELECT *, last_value(p1 IGNORE NULLS) OVER w AS l1, last_value(p2 IGNORE NULLS) OVER w AS l2 FROM (SELECT source_id, frame, any_value({'x': court_x, 'y': court_y}) FILTER (slot = 1 AND court_x IS NOT NULL AND reason IS NULL) AS p1,
        any_value({'x': court_x, 'y': court_y}) FILTER (slot = 2 AND court_x IS NOT NULL AND reason IS NULL) AS p2 FROM fslots GROUP BY source_id, frame)
      WINDOW w AS (PARTITION BY source_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", ("fslots",))
cte("fplayers", """SELECT *, activity <= base + 2.5*greatest(mad, 1e-4) AS settled, activity > base + 4.0*greatest(mad, 1e-4) AS burst FROM (SELECT * EXCLUDE (h), coalesce(list_median(h), 0.0) AS base, coalesce(list_median(list_transform(h, lambda v: abs(v - list_median(h)))), 0.0) AS mad
    FROM (SELECT *, list(activity) OVER (PARTITION BY source_id ORDER BY frame ROWS BETWEEN 150 PRECEDING AND 1 PRECEDING) AS h FROM fp))""", ("fp",))


def spine(spark, sf):
    return frame_spine(fixtures.sources(fixtures.tracks(spark, sf)))


def players(spark, sf):
    return ops.player_evidence(slots(spark, sf), spine(spark, sf))


@query("player_evidence")
def _(spark, sf):
    return rounded(players(spark, sf))


oracle("player_evidence", "SELECT source_id, frame, unambiguous, opposite_halves, round(activity, 6) + 0.0 AS activity, round(base, 6) + 0.0 AS activity_baseline, round(mad, 6) + 0.0 AS activity_mad, settled, burst FROM fplayers", ("fplayers",))


def hypothesis_points(spark, sf):
    """One or two scored paths over every visible track point; some leave the image."""
    f = F.col("frame")
    rows = fixtures.tracks(spark, sf).filter("visibility = 1 AND frame % 23 <> 0").withColumn("rank", F.explode(F.when(f % 19 < 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    score = F.when(F.col("rank") == 1, 0.62 + (f % 7).cast("double") / 30.0).otherwise(0.55 + (f % 11).cast("double") / 41.0)
    return rows.select("source_id", "frame", F.concat(F.lit("r"), F.floor(f / 50).cast("long")).alias("region_id"), "rank", score.alias("total_score"),
                       (F.col("raw_x") + F.when(f % 170 == 101, 900).otherwise(0)).alias("cx"), F.col("raw_y").alias("cy"))


cte("fpoints", """SELECT source_id, frame, 'r' || CAST(frame // 50 AS BIGINT) || ':' || rank AS hypothesis, CASE rank WHEN 1 THEN 0.62::DOUBLE + (frame % 7)::DOUBLE/30.0 ELSE 0.55::DOUBLE + (frame % 11)::DOUBLE/41.0 END AS total_score,
    (raw_x + CASE WHEN frame % 170 = 101 THEN 900 ELSE 0 END)::DOUBLE AS x, raw_y::DOUBLE AS y FROM (SELECT *, unnest(CASE WHEN frame % 19 < 3 THEN [1, 2] ELSE [1] END) AS rank FROM v_tracks WHERE visibility = 1 AND frame % 23 <> 0)""", ("v_tracks",))
cte("fsel", """SELECT source_id, frame, coalesce(best.total_score - second <= 0.10, false) AS ambiguous, CASE WHEN coalesce(best.total_score - second <= 0.10, false) THEN NULL ELSE best END AS s FROM (SELECT DISTINCT source_id, frame FROM v_tracks)
    LEFT JOIN (SELECT source_id, frame, any_value({'total_score': total_score, 'hypothesis': hypothesis, 'x': x, 'y': y}) FILTER (n = 1) AS best, max(total_score) FILTER (n = 2) AS second
      FROM (SELECT *, row_number() OVER (PARTITION BY source_id, frame ORDER BY total_score DESC, hypothesis) AS n FROM fpoints WHERE total_score >= 0.6) GROUP BY source_id, frame) USING (source_id, frame)""", ("fpoints", "v_tracks"))
cte("fshuttle", """SELECT source_id, frame, s.hypothesis AS selected_hypothesis, s.total_score AS score, ambiguous, coalesce(sqrt(pow(s.x - p.x, 2) + pow(s.y - p.y, 2))/sqrt((641*641 + 359*359)::DOUBLE), 0.0) AS travel, coalesce(NOT (s.x >= 0 AND s.x < 641 AND s.y >= 0 AND s.y < 359), false) AS outside
    FROM (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM fsel)""", ("fsel",))


def shuttle(spark, sf):
    return ops.shuttle_evidence(hypothesis_points(spark, sf), spine(spark, sf), W, H)


@query("shuttle_evidence")
def _(spark, sf):
    return rounded(shuttle(spark, sf))


oracle("shuttle_evidence", f"SELECT source_id, frame, selected_hypothesis, ambiguous, outside, {r6('score', 'travel')} FROM fshuttle", ("fshuttle",))


def evidence(spark, sf):
    return ops.decoder_evidence(players(spark, sf), shuttle(spark, sf), FPS)


cte("fev", """SELECT p.*, selected_hypothesis, coalesce(score, 0) AS score, ambiguous, travel, outside, selected_hypothesis IS NOT NULL AS sel,
    count(*) OVER w = 15 AND sum((unambiguous AND opposite_halves AND settled)::INT) OVER w / 15.0::DOUBLE >= 0.8 AS ready FROM fplayers p JOIN fshuttle USING (source_id, frame)
    WINDOW w AS (PARTITION BY p.source_id ORDER BY p.frame ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)""", ("fplayers", "fshuttle"))
# reasons: c = competing_hypotheses, o = serve_only; sf = pending serve frame
cte("fsm", """SELECT source_id, -1::BIGINT AS frame, 'RESET' AS st, 0::BIGINT AS since, 0 AS gap, NULL::BIGINT AS serve, NULL::BIGINT AS start, NULL::BIGINT AS live, false AS resp, false AS seen, false AS rc, false AS ro, 0.0::DOUBLE AS trav,
      NULL::VARCHAR AS tr, NULL::BIGINT AS es, NULL::BIGINT AS ee, false AS er, false AS ec, false AS eo FROM (SELECT DISTINCT source_id FROM fev)
  UNION ALL SELECT source_id, frame,
    CASE tr WHEN 'readiness_confirmed' THEN 'SERVE_ARMED' WHEN 'player_roles_lost' THEN 'RESET' WHEN 'serve_evidence' THEN 'START_PENDING' WHEN 'opponent_response_confirmed' THEN 'LIVE' WHEN 'start_unconfirmed' THEN 'COOLDOWN'
      WHEN 'live_support_lost' THEN 'END_PENDING' WHEN 'support_recovered' THEN 'LIVE' WHEN 'end_confirmed' THEN 'COOLDOWN' WHEN 'cooldown_complete' THEN 'RESET' ELSE st END,
    CASE WHEN tr IN ('serve_evidence', 'start_unconfirmed', 'live_support_lost', 'end_confirmed') THEN frame ELSE since END,
    CASE WHEN tr IN ('support_recovered', 'end_confirmed') THEN 0 ELSE gap1 END,
    CASE WHEN tr = 'serve_evidence' THEN frame WHEN tr IN ('start_unconfirmed', 'end_confirmed') THEN NULL ELSE serve END,
    CASE WHEN tr = 'opponent_response_confirmed' THEN serve WHEN tr = 'end_confirmed' THEN NULL ELSE start END,
    CASE WHEN tr = 'end_confirmed' THEN NULL ELSE live1 END, resp1 AND tr IS DISTINCT FROM 'end_confirmed', seen1 AND tr IS DISTINCT FROM 'end_confirmed', rc1 AND tr IS DISTINCT FROM 'end_confirmed', (ro OR tr IS NOT DISTINCT FROM 'start_unconfirmed') AND tr IS DISTINCT FROM 'end_confirmed',
    CASE WHEN tr IN ('start_unconfirmed', 'end_confirmed') THEN 0.0 ELSE trav1 END, tr,
    CASE tr WHEN 'start_unconfirmed' THEN serve WHEN 'end_confirmed' THEN start END, CASE tr WHEN 'start_unconfirmed' THEN coalesce(nullif(live1, 0), frame) WHEN 'end_confirmed' THEN coalesce(live, start) END,
    tr IS NOT DISTINCT FROM 'end_confirmed' AND resp1, rc1, ro OR tr IS NOT DISTINCT FROM 'start_unconfirmed'
  FROM (SELECT *, CASE st WHEN 'RESET' THEN CASE WHEN ready THEN 'readiness_confirmed' END
      WHEN 'SERVE_ARMED' THEN CASE WHEN NOT unambiguous THEN 'player_roles_lost' WHEN sel AND burst THEN 'serve_evidence' END
      WHEN 'START_PENDING' THEN CASE WHEN resp1 AND frame - since + 1 <= 30 THEN 'opponent_response_confirmed' WHEN frame - since + 1 > 30 THEN 'start_unconfirmed' END
      WHEN 'LIVE' THEN CASE WHEN outside OR gap1 > 15 THEN 'live_support_lost' END
      WHEN 'END_PENDING' THEN CASE WHEN sel AND NOT outside AND frame - since <= 15 THEN 'support_recovered' WHEN frame - since + 1 >= 30 THEN 'end_confirmed' END
      ELSE CASE WHEN frame - since + 1 >= 30 THEN 'cooldown_complete' END END AS tr
    FROM (SELECT *, resp OR (st = 'START_PENDING' AND trav1 >= 0.08 AND seen1) AS resp1 FROM (SELECT e.*, st, since, gap, serve, start, live, resp, ro, rc OR (ambiguous AND st IN ('START_PENDING', 'LIVE', 'END_PENDING')) AS rc1,
        CASE WHEN st = 'START_PENDING' AND sel THEN trav + travel ELSE trav END AS trav1, CASE WHEN (st = 'START_PENDING' AND sel) OR (st = 'LIVE' AND sel AND NOT outside) THEN e.frame ELSE live END AS live1,
        seen OR (st = 'START_PENDING' AND burst AND e.frame > since) AS seen1, CASE WHEN st = 'LIVE' THEN CASE WHEN sel AND NOT outside THEN 0 ELSE gap + 1 END ELSE gap END AS gap1
      FROM fsm m JOIN fev e ON e.source_id = m.source_id AND e.frame = m.frame + 1)))""", ("fev",))
oracle_codes = "concat_ws(';', CASE WHEN {c} THEN 'competing_hypotheses' END, {x} CASE WHEN {o} THEN 'serve_only' END)"


@query("state_events_v2")
def _(spark, sf):
    return rounded(ops.state_events_v2(evidence(spark, sf), FPS))


oracle("state_events_v2", f"""SELECT m.source_id, m.frame, st AS state, tr AS transition, round(least(1.0, trav/0.08::DOUBLE), 6) + 0.0 AS live_score, round(least(1.0, gap/15.0::DOUBLE), 6) + 0.0 AS end_score, {oracle_codes.format(c='rc', o='ro', x='')} AS reason_codes,
    selected_hypothesis, ready AS player_readiness, round(round(activity, 8), 6) + 0.0 AS player_activity, opposite_halves AS side_evidence, burst AS contact_evidence FROM fsm m JOIN fev e ON e.source_id = m.source_id AND e.frame = m.frame""", ("fsm", "fev"), recursive=True)


@query("decode_rallies_v2")
def _(spark, sf):
    return rounded(ops.decode_rallies_v2(evidence(spark, sf), FPS))


oracle("decode_rallies_v2", f""", sp AS (SELECT source_id, es AS s, ee AS e, er AS r, ec AS c, eo AS o, false AS x, frame AS at_f FROM fsm WHERE es IS NOT NULL UNION ALL
      SELECT source_id, coalesce(start, serve, since), coalesce(live, frame), resp, rc, ro, true, frame + 1 FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY frame DESC) AS n FROM fsm) WHERE n = 1 AND st IN ('START_PENDING', 'LIVE', 'END_PENDING')),
    a AS (SELECT *, r AND NOT c AND NOT o AND NOT x AS ok, row_number() OVER (PARTITION BY source_id ORDER BY at_f) AS number FROM sp)
    SELECT source_id, source_id || '-' || lpad(number::VARCHAR, 4, '0') AS rally_id, s AS start_frame, greatest(s, e) AS end_frame, round(s/30.0::DOUBLE, 6) AS start_time, round(greatest(s, e)/30.0::DOUBLE, 6) AS end_time, CASE WHEN ok THEN 'accepted' ELSE 'review' END AS status,
      CASE WHEN ok THEN 0.85::DOUBLE ELSE 0.55::DOUBLE END AS confidence, CASE WHEN ok THEN 'high' ELSE 'medium' END AS confidence_band, {oracle_codes.format(c='c', o='o', x="CASE WHEN x THEN 'eof_unresolved' END, CASE WHEN NOT ok THEN 'manual_review_needed' END,")} AS flags,
      '' AS failure_reason, '' AS manual_start_frame, '' AS manual_end_frame, '' AS manual_decision FROM a""", ("fsm",), recursive=True)


@query("validate_rally_inputs")
def _(spark, sf):
    """Six artifact headers per source, some of them wrong or absent."""
    src = fixtures.sources(fixtures.tracks(spark, sf))
    k = F.col("source_id")
    kinds = F.array(*[F.lit(n) for n in ("candidates", "tracklets", "hypotheses", "player_assignments", "pose_cache", "calibration")])
    rows = src.withColumn("kind", F.explode(kinds)).filter(~((k % 7 == 0) & (F.col("kind") == "pose_cache")))
    art = rows.select(
        "source_id", "kind", F.concat("kind", k).alias("sha256"), (F.col("fps") + F.when(k % 5 == 0, 0.5).otherwise(0.0)).alias("fps"),
        (F.col("frame_count") + F.when(k % 3 == 0, 1).otherwise(0)).alias("frame_count"), F.when(k % 4 == 1, 10).otherwise(F.col("width")).alias("width"), "height",
        F.concat(F.lit("candidates"), F.when(k % 11 == 0, 0).otherwise(k)).alias("candidate_sha256"), F.concat(F.lit("tracklets"), F.when(k % 9 == 0, 0).otherwise(k)).alias("tracklet_sha256"),
        F.when((k % 8 == 0) & (F.col("kind") == "pose_cache"), "other").otherwise("raw").alias("raw_fingerprint"))
    return ops.validate_rally_inputs(src, art)


oracle("validate_rally_inputs", """WITH s AS (SELECT DISTINCT l_suppkey AS k FROM lineitem) SELECT k AS source_id, p AS problem FROM (
      SELECT k, 'missing_pose_cache' AS p FROM s WHERE k % 7 = 0 UNION ALL SELECT k, unnest(['calibration_size', 'candidate_size', 'assignment_size']) FROM s WHERE k % 4 = 1 UNION ALL SELECT k, unnest(['candidate_fps', 'assignment_fps']) FROM s WHERE k % 5 = 0
      UNION ALL SELECT k, 'assignment_frame_count' FROM s WHERE k % 3 = 0 UNION ALL SELECT k, 'candidate_fingerprint' FROM s WHERE k % 11 = 0 AND k <> 0 UNION ALL SELECT k, 'tracklet_fingerprint' FROM s WHERE k % 9 = 0 AND k <> 0 UNION ALL SELECT k, 'raw_fingerprint' FROM s WHERE k % 8 = 0 AND k % 7 <> 0)""")
