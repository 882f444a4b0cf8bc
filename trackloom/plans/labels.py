"""Label replay, queue and provenance queries."""

from pyspark.sql import functions as F

from trackloom import fixtures
from trackloom.operators import labels as ops
from trackloom.plans.base import cte, oracle, query, rounded


def events(spark, sf):
    rows = fixtures.label_events(spark, sf)
    return rows.select("revision_id", F.when(F.col("source_id") % 2 == 0, "points").otherwise("rallies").alias("task"),
                       "source_id", "frame", "label_kind", "superseded_revision", "ts",
                       F.concat(F.lit("a"), F.col("revision_id") % 7).alias("annotator"), F.concat(F.lit("s"), F.col("revision_id") % 3).alias("session_id"))


cte("e", """SELECT *, CASE WHEN source_id % 2 = 0 THEN 'points' ELSE 'rallies' END AS task, 'a' || (revision_id % 7) AS annotator, 's' || (revision_id % 3) AS session_id FROM v_label_events""", ("v_label_events",))
cte("heads", "SELECT * FROM e WHERE revision_id NOT IN (SELECT superseded_revision FROM e WHERE superseded_revision IS NOT NULL)", ("e",))
# in chain order: last event per key, and what an undo restores
cte("active", """SELECT a.* FROM (SELECT h.source_id, h.frame, CASE WHEN h.label_kind <> 'undo' THEN h.revision_id ELSE u.superseded_revision END AS rid
    FROM (SELECT *, row_number() OVER (PARTITION BY source_id, frame ORDER BY ts DESC, revision_id DESC) AS n FROM e) h LEFT JOIN e u ON u.revision_id = h.superseded_revision WHERE n = 1) x
    JOIN e a ON a.revision_id = x.rid WHERE a.label_kind <> 'undo'""", ("e",))


@query("replay_heads")
def _(spark, sf):
    return ops.replay_heads(events(spark, sf)).select("task", "source_id", "frame", "revision_id", "label_kind")


oracle("replay_heads", "SELECT task, source_id, frame, revision_id, label_kind FROM heads", ("heads",))


@query("replay_active")
def _(spark, sf):
    return ops.replay_active(events(spark, sf)).select("task", "source_id", "frame", "revision_id", "label_kind")


oracle("replay_active", "SELECT task, source_id, frame, revision_id, label_kind FROM active", ("active",))


@query("replay_violations")
def _(spark, sf):
    """The event log with some revisions damaged."""
    k = F.col("revision_id")
    rows = events(spark, sf).withColumn("frame", F.when(k % 101 == 0, F.col("frame") + 8).otherwise(F.col("frame")))
    rows = rows.withColumn("superseded_revision", F.when(k % 89 == 0, None).when(k % 83 == 0, -k).otherwise(F.col("superseded_revision")))
    rows = rows.withColumn("label_kind", F.when(k % 79 == 0, "undo").otherwise(F.col("label_kind")))
    return ops.replay_violations(rows.withColumn("revision_id", F.when(k % 97 == 0, k + 1).otherwise(k)))


oracle("replay_violations", """, d AS (SELECT CASE WHEN k % 97 = 0 THEN k + 1 ELSE k END AS revision_id, task, source_id, CASE WHEN k % 101 = 0 THEN frame + 8 ELSE frame END AS frame,
      CASE WHEN k % 79 = 0 THEN 'undo' ELSE label_kind END AS label_kind, CASE WHEN k % 89 = 0 THEN NULL WHEN k % 83 = 0 THEN -k ELSE superseded_revision END AS sup FROM (SELECT *, revision_id AS k FROM e)),
    p AS (SELECT revision_id, min({'t': task, 's': source_id, 'f': frame}) AS key FROM d GROUP BY revision_id),
    c AS (SELECT sup, count(*) AS n FROM d WHERE sup IS NOT NULL GROUP BY sup), r AS (SELECT task, source_id, frame, count(*) AS n FROM d WHERE sup IS NULL GROUP BY ALL)
    SELECT revision_id, 'duplicate_revision_id' AS violation FROM d GROUP BY revision_id HAVING count(*) > 1
    UNION ALL SELECT d.revision_id, 'unknown_parent' FROM d LEFT JOIN p ON p.revision_id = d.sup WHERE d.sup IS NOT NULL AND p.revision_id IS NULL
    UNION ALL SELECT d.revision_id, 'parent_of_other_key' FROM d JOIN p ON p.revision_id = d.sup WHERE p.key <> {'t': d.task, 's': d.source_id, 'f': d.frame}
    UNION ALL SELECT d.revision_id, 'branched_revision' FROM d JOIN c ON c.sup = d.sup WHERE c.n > 1
    UNION ALL SELECT d.revision_id, 'second_first_revision' FROM d JOIN r USING (task, source_id, frame) WHERE d.sup IS NULL AND r.n > 1
    UNION ALL SELECT revision_id, 'undo_first' FROM d WHERE sup IS NULL AND label_kind = 'undo'""", ("e",))


@query("export_labels")
def _(spark, sf):
    return ops.export_labels(events(spark, sf), task="points").select("task", "source_id", "frame", "revision_id", "label_kind")


oracle("export_labels", "SELECT task, source_id, frame, revision_id, label_kind FROM active WHERE task = 'points' AND label_kind <> 'unsure'", ("active",))


@query("export_summary")
def _(spark, sf):
    rows = events(spark, sf)
    return ops.export_summary(rows, ops.export_labels(rows))


oracle("export_summary", "SELECT (SELECT count(*) FROM e) AS revision_count, (SELECT count(*) FROM active WHERE label_kind <> 'unsure') AS label_count", ("e", "active"))


@query("undo_target")
def _(spark, sf):
    return ops.undo_target(events(spark, sf))


oracle("undo_target", """SELECT annotator, session_id, revision_id, task, source_id, frame FROM (SELECT *, row_number() OVER (PARTITION BY annotator, session_id ORDER BY ts DESC, revision_id DESC) AS n
    FROM heads WHERE label_kind <> 'undo') WHERE n = 1""", ("heads",))


def label_bursts(spark, sf):
    """One burst of twelve frames per source of the event log."""
    return events(spark, sf).select("task", "source_id").distinct().select(
        F.concat(F.lit("b"), F.col("source_id")).alias("burst_id"), "task", "source_id",
        (F.col("source_id") % 3).alias("start_frame"), (F.col("source_id") % 3 + 11).alias("end_frame"))


cte("progress", """SELECT 'b' || b.source_id AS burst_id, b.task, b.source_id, b.frame, a.revision_id IS NOT NULL AS completed, a.label_kind, a.revision_id
    FROM (SELECT DISTINCT task, source_id, source_id % 3 + unnest(range(12)) AS frame FROM e) b LEFT JOIN active a USING (task, source_id, frame)""", ("e", "active"))


@query("audit_progress")
def _(spark, sf):
    return ops.audit_progress(label_bursts(spark, sf), events(spark, sf))


oracle("audit_progress", "SELECT * FROM progress", ("progress",))


@query("audit_completion")
def _(spark, sf):
    return ops.audit_completion(ops.audit_progress(label_bursts(spark, sf), events(spark, sf)))


oracle("audit_completion", "SELECT task, count(*) FILTER (completed) AS complete, count(*) AS total FROM progress GROUP BY task", ("progress",))


@query("frame_history")
def _(spark, sf):
    return ops.frame_history(events(spark, sf)).select("task", "source_id", "frame", "revision_id", "label_kind", "active_revision", "active_label")


oracle("frame_history", """SELECT e.task, e.source_id, e.frame, e.revision_id, e.label_kind, a.revision_id AS active_revision, a.label_kind AS active_label
    FROM e LEFT JOIN active a USING (task, source_id, frame)""", ("e", "active"))


def named_candidates(spark, sf):
    c = fixtures.candidates(spark, sf)
    return c.select("source_id", "frame", "peak", F.concat(F.lit("f"), F.col("frame"), F.lit("-c"), F.col("cand")).alias("candidate_id"), "cand")


cte("cands", "SELECT *, 'f' || frame || '-c' || cand AS candidate_id FROM v_candidates", ("v_candidates",))


def frame_labels(spark, sf):
    """A label per first candidate row of every frame, with some mistakes."""
    f = F.col("frame")
    rows = named_candidates(spark, sf).filter("cand = 0")
    kind = F.when(f % 11 == 0, "wrong").when(f % 3 == 0, "no_shuttle").when(f % 7 == 0, "unsure").otherwise("selected")
    cid = (F.when(f % 13 == 0, "zz").when(f % 17 == 0, F.concat(F.lit("f"), f + 1, F.lit("-c0"))).when(f % 19 == 0, None)
            .when((f % 3 == 0) & (f % 23 != 0), None).otherwise(F.col("candidate_id")))
    return rows.select((F.col("source_id") * 10000000000 + f).alias("label_id"), "source_id", (f + F.when(f % 29 == 0, 1 << 40).otherwise(0)).alias("frame"),
                       kind.alias("label_kind"), cid.alias("candidate_id"), F.when(f % 31 == 0, "old").otherwise("sha").alias("candidate_artifact_sha256"))


cte("flabels", """SELECT source_id*10000000000 + f AS label_id, source_id, f + CASE WHEN f % 29 = 0 THEN 1099511627776 ELSE 0 END AS frame,
    CASE WHEN f % 11 = 0 THEN 'wrong' WHEN f % 3 = 0 THEN 'no_shuttle' WHEN f % 7 = 0 THEN 'unsure' ELSE 'selected' END AS label_kind,
    CASE WHEN f % 13 = 0 THEN 'zz' WHEN f % 17 = 0 THEN 'f' || (f+1) || '-c0' WHEN f % 19 = 0 THEN NULL WHEN f % 3 = 0 AND f % 23 <> 0 THEN NULL ELSE candidate_id END AS candidate_id,
    CASE WHEN f % 31 = 0 THEN 'old' ELSE 'sha' END AS fp FROM (SELECT *, frame AS f FROM cands WHERE cand = 0)""", ("cands",))


def label_sources(spark, sf):
    return fixtures.sources(fixtures.candidates(spark, sf)).withColumn("artifact_sha256", F.lit("sha")).withColumn("video_sha256", F.lit("vid"))


@query("validate_labels")
def _(spark, sf):
    return ops.validate_labels(frame_labels(spark, sf), label_sources(spark, sf), named_candidates(spark, sf))


oracle("validate_labels", """, x AS (SELECT l.*, n.frame_count, c.frame AS cf FROM flabels l LEFT JOIN (SELECT source_id, max(frame) + 1 AS frame_count FROM cands GROUP BY source_id) n USING (source_id)
      LEFT JOIN cands c ON c.source_id = l.source_id AND c.candidate_id = l.candidate_id)
    SELECT label_id, 'frame_out_of_range' AS problem FROM x WHERE frame >= frame_count UNION ALL SELECT label_id, 'fingerprint_mismatch' FROM x WHERE fp <> 'sha' UNION ALL SELECT label_id, 'invalid_label_kind' FROM x WHERE label_kind = 'wrong'
    UNION ALL SELECT label_id, 'missing_candidate_id' FROM x WHERE label_kind = 'selected' AND candidate_id IS NULL UNION ALL SELECT label_id, 'unknown_candidate_id' FROM x WHERE label_kind = 'selected' AND candidate_id IS NOT NULL AND cf IS NULL
    UNION ALL SELECT label_id, 'candidate_of_other_frame' FROM x WHERE label_kind = 'selected' AND cf <> frame UNION ALL SELECT label_id, 'unexpected_candidate_id' FROM x WHERE label_kind <> 'selected' AND candidate_id IS NOT NULL""", ("flabels", "cands"))


def suggested(spark, sf):
    rows = named_candidates(spark, sf).withColumn("threshold", F.when(F.col("frame") % 5 == 0, 0.3).otherwise(0.5))
    rows = rows.withColumn("marked", (F.col("cand") == 0) | ((F.col("frame") % 7 == 0) & (F.col("cand") == 1)))
    frames = fixtures.person_obs(spark, sf).select("source_id", "frame").distinct()
    artifacts = label_sources(spark, sf).select("source_id", (F.col("source_id") % 4 != 0).alias("verified"))
    return ops.suggestions(rows, frames, artifacts)


cte("sugg", """SELECT f.source_id, f.frame, CASE WHEN marks = 1 THEN 'selected' ELSE 'no_shuttle' END AS semantic_label, cid AS candidate_id FROM (SELECT DISTINCT source_id, frame FROM v_person_obs) f
    LEFT JOIN (SELECT source_id, frame, count(*) FILTER (m) AS marks, count(*) FILTER (th = 0.5) AS halves, count(*) FILTER (m AND th <> 0.5) AS wrong, max(candidate_id) FILTER (m) AS cid
      FROM (SELECT *, cand = 0 OR (frame % 7 = 0 AND cand = 1) AS m, CASE WHEN frame % 5 = 0 THEN 0.3 ELSE 0.5 END AS th FROM cands) GROUP BY source_id, frame) g USING (source_id, frame)
    WHERE f.source_id % 4 <> 0 AND f.source_id IN (SELECT source_id FROM cands) AND coalesce(marks, 0) <= 1 AND coalesce(wrong, 0) = 0 AND NOT (coalesce(halves, 0) > 0 AND marks <> 1)""", ("v_person_obs", "cands"))


@query("suggestions")
def _(spark, sf):
    return suggested(spark, sf)


oracle("suggestions", "SELECT * FROM sugg", ("sugg",))


@query("review_actions")
def _(spark, sf):
    labels = frame_labels(spark, sf).filter("frame < 1099511627776")
    return ops.review_actions(labels, suggested(spark, sf)).select("label_id", "label_kind", "candidate_id", "review_action")


oracle("review_actions", """SELECT label_id, label_kind, l.candidate_id, CASE WHEN semantic_label IS NULL THEN 'human_created' WHEN label_kind = semantic_label AND l.candidate_id IS NOT DISTINCT FROM s.candidate_id THEN 'human_confirmed' ELSE 'human_corrected' END AS review_action
    FROM flabels l LEFT JOIN sugg s USING (source_id, frame) WHERE frame < 1099511627776""", ("flabels", "sugg"))


def scored(spark, sf):
    frames = fixtures.candidates(spark, sf).select("source_id", F.explode(F.array("frame", F.col("frame") + 1)).alias("frame")).distinct()
    return ops.queue_scores(frames, fixtures.candidates(spark, sf))


cte("qscores", """SELECT f.source_id, f.frame, coalesce(n, 0) + 1.0::DOUBLE - least(1, greatest(0, coalesce(top, 0))) AS score FROM (SELECT DISTINCT source_id, frame + unnest([0, 1]) AS frame FROM v_candidates) f
    LEFT JOIN (SELECT source_id, frame, count(*) AS n, max(peak) AS top FROM v_candidates GROUP BY source_id, frame) USING (source_id, frame)""", ("v_candidates",))


@query("queue_scores")
def _(spark, sf):
    return rounded(scored(spark, sf))


oracle("queue_scores", "SELECT source_id, frame, round(score, 6) + 0.0 AS score FROM qscores", ("qscores",))


def eligible(spark, sf):
    return fixtures.candidates(spark, sf)


@query("eligible_runs")
def _(spark, sf):
    return ops.eligible_runs(eligible(spark, sf))


cte("runs", """SELECT source_id, min(frame) AS run_start, max(frame) AS run_end FROM (SELECT source_id, frame, frame - row_number() OVER (PARTITION BY source_id ORDER BY frame) AS g FROM (SELECT DISTINCT source_id, frame FROM v_candidates)) GROUP BY source_id, g""", ("v_candidates",))
oracle("eligible_runs", "SELECT * FROM runs", ("runs",))
FPS = 11.5


def burst_sources(spark, sf):
    return fixtures.sources(fixtures.candidates(spark, sf), FPS).withColumn("artifact_sha256", F.lit("sha")).withColumn("video_sha256", F.lit("vid"))


@query("frame_bursts")
def _(spark, sf):
    return ops.frame_bursts(eligible(spark, sf), burst_sources(spark, sf))


cte("bursts", """SELECT source_id, anchor_frame, s AS start_frame, s + len - 1 AS end_frame FROM (SELECT *, least(greatest(0, frame - run_start - CAST(len // 2 AS BIGINT)), n - len) + run_start AS s, frame AS anchor_frame
    FROM (SELECT f.*, run_start, run_end - run_start + 1 AS n, least(12, run_end - run_start + 1) AS len FROM (SELECT DISTINCT source_id, frame FROM v_candidates) f JOIN runs r ON r.source_id = f.source_id AND frame BETWEEN run_start AND run_end))""", ("v_candidates", "runs"))
oracle("frame_bursts", "SELECT * FROM bursts", ("bursts",))
SEED, COUNT = 42, 15


def audit(spark, sf):
    return ops.audit_queue(eligible(spark, sf), burst_sources(spark, sf), SEED, COUNT)


cte("audit", """SELECT source_id, s + CAST(len // 2 AS BIGINT) AS anchor_frame, s AS start_frame, s + len - 1 AS end_frame FROM (SELECT source_id, len, run_start + shift + len*unnest(range(cap)) AS s FROM (
      SELECT *, ('0x' || substr(md5('42|' || source_id || '|' || run_start), 1, 8))::BIGINT % (n - cap*len + 1) AS shift FROM (SELECT *, CAST(n // len AS BIGINT) AS cap FROM (SELECT *, run_end - run_start + 1 AS n, least(12, run_end - run_start + 1) AS len FROM runs))))
    ORDER BY md5('42|' || source_id || '|' || (s + CAST(len // 2 AS BIGINT))) LIMIT 15""", ("runs",))


@query("audit_queue")
def _(spark, sf):
    return audit(spark, sf)


oracle("audit_queue", "SELECT * FROM audit", ("audit",))


@query("adaptive_queue")
def _(spark, sf):
    bursts = ops.frame_bursts(eligible(spark, sf), burst_sources(spark, sf))
    return rounded(ops.adaptive_queue(scored(spark, sf), bursts, COUNT, audit(spark, sf)))


cte("free", """SELECT b.*, score FROM bursts b JOIN qscores q ON q.source_id = b.source_id AND q.frame = b.anchor_frame
    WHERE NOT EXISTS (SELECT 1 FROM audit a WHERE a.source_id = b.source_id AND a.start_frame <= b.end_frame AND b.start_frame <= a.end_frame)""", ("bursts", "qscores", "audit"))
cte("greedy", """SELECT 0 AS step, * FROM free UNION ALL SELECT step + 1, source_id, anchor_frame, start_frame, end_frame, score FROM (
      SELECT *, first_value(source_id) OVER o AS bs, first_value(start_frame) OVER o AS b0, first_value(end_frame) OVER o AS b1 FROM greedy m WINDOW o AS (ORDER BY score DESC, source_id, anchor_frame))
    WHERE step < 14 AND NOT (source_id = bs AND start_frame <= b1 AND b0 <= end_frame)""", ("free",))
oracle("adaptive_queue", """SELECT source_id, anchor_frame, start_frame, end_frame, round(score, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY score DESC, source_id, anchor_frame) AS n FROM greedy) WHERE n = 1""",
       ("greedy",), recursive=True)


@query("validate_queue")
def _(spark, sf):
    """Bursts of every anchor as a queue, some of them altered."""
    a = F.col("anchor_frame")
    queue = ops.frame_bursts(eligible(spark, sf), burst_sources(spark, sf)).select(
        (F.col("source_id") * 10000000000 + a).alias("burst_id"), "source_id", "anchor_frame", (F.col("start_frame") + F.when(a % 9 == 0, 1).otherwise(0)).alias("start_frame"), "end_frame",
        F.when(a % 5 == 0, "x").otherwise("sha").alias("candidate_artifact_sha256"), F.when(a % 7 == 0, "x").otherwise("vid").alias("source_video_sha256"))
    return ops.validate_queue(queue, eligible(spark, sf), burst_sources(spark, sf), "audit", 3)


oracle("validate_queue", """, q AS (SELECT source_id*10000000000 + anchor_frame AS id, source_id, anchor_frame AS a, start_frame + CASE WHEN anchor_frame % 9 = 0 THEN 1 ELSE 0 END AS s, end_frame AS e FROM bursts)
    SELECT id AS burst_id, 'artifact_mismatch' AS problem FROM q WHERE a % 5 = 0 UNION ALL SELECT id, 'video_mismatch' FROM q WHERE a % 7 = 0 UNION ALL SELECT id, 'frames_mismatch' FROM q WHERE a % 9 = 0
    UNION ALL SELECT id, 'overlap' FROM q WHERE EXISTS (SELECT 1 FROM q p WHERE p.source_id = q.source_id AND p.id < q.id AND p.s <= q.e AND q.s <= p.e AND p.s <= p.e AND q.s <= q.e) UNION ALL SELECT NULL, 'count_mismatch'""", ("bursts",))


@query("context_window")
def _(spark, sf):
    centers = audit(spark, sf).select("source_id", F.col("anchor_frame").alias("center_frame"))
    return rounded(ops.context_window(centers, eligible(spark, sf), fixtures.candidates(spark, sf), burst_sources(spark, sf)).select("source_id", "center_frame", "frame", "cand", "cx", "cy", "peak"))


oracle("context_window", """SELECT source_id, center_frame, frame, cand, cx, cy, round(peak, 6) AS peak FROM (SELECT a.source_id, a.anchor_frame AS center_frame, floor(greatest(0.0::DOUBLE, run_start/11.5::DOUBLE, anchor_frame/11.5::DOUBLE - 1)*11.5::DOUBLE) AS lo,
      least(run_end, ceil(least((last + 1)/11.5::DOUBLE, (run_end + 1)/11.5::DOUBLE, anchor_frame/11.5::DOUBLE + 1)*11.5::DOUBLE)) AS hi FROM audit a JOIN runs r ON r.source_id = a.source_id AND a.anchor_frame BETWEEN run_start AND run_end
      JOIN (SELECT source_id, max(frame) AS last FROM v_candidates GROUP BY source_id) l ON l.source_id = a.source_id) JOIN v_candidates USING (source_id) WHERE frame BETWEEN lo AND hi""", ("audit", "runs", "v_candidates"))


@query("source_catalog")
def _(spark, sf):
    k = F.col("s_suppkey")
    rows = fixtures.table(spark, sf, "supplier").select(
        F.when(k % 9 == 0, "").when(k % 5 == 0, F.concat(F.lit("s"), k % 10)).otherwise(F.concat(F.lit("s"), k)).alias("source_id"),
        F.when(k % 7 == 0, 0.0).otherwise(30.0).alias("fps"), (k % 4 * 100).alias("frame_count"))
    return ops.source_catalog(rows)


oracle("source_catalog", """WITH s AS (SELECT CASE WHEN s_suppkey % 9 = 0 THEN '' WHEN s_suppkey % 5 = 0 THEN 's' || (s_suppkey % 10) ELSE 's' || s_suppkey END AS source_id, CASE WHEN s_suppkey % 7 = 0 THEN 0.0::DOUBLE ELSE 30.0::DOUBLE END AS fps, s_suppkey % 4 * 100 AS frame_count FROM supplier)
    SELECT *, CASE WHEN source_id = '' THEN 'empty_source_id' WHEN count(*) OVER (PARTITION BY source_id) > 1 THEN 'duplicate_source_id' WHEN fps <= 0 THEN 'invalid_fps' WHEN frame_count <= 0 THEN 'invalid_frame_count' END AS problem FROM s""")


@query("task_sources")
def _(spark, sf):
    """Tasks listing one nation's suppliers each, and one task open to all."""
    sup = fixtures.table(spark, sf, "supplier")
    tasks = sup.groupBy(F.concat(F.lit("n"), F.col("s_nationkey")).alias("task")).agg(F.collect_set(F.col("s_suppkey") + F.col("s_nationkey") % 3 * 1000000).alias("source_ids"))
    tasks = tasks.unionByName(sup.agg(F.lit("all").alias("task"), F.array().cast("array<bigint>").alias("source_ids")))
    return ops.task_sources(tasks, sup.select(F.col("s_suppkey").alias("source_id")))


oracle("task_sources", """SELECT 'n' || s_nationkey AS task, s_suppkey + s_nationkey % 3 * 1000000 AS source_id, s_nationkey % 3 = 0 AS known FROM supplier UNION ALL SELECT 'all', s_suppkey, true FROM supplier""")
