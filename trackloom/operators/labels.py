"""Label revisions, labelling queues and provenance checks.

Revisions: revision_id, task, source_id, frame, label_kind, superseded_revision (NULL for the first of a
key), plus whatever columns ride along. The key of a label is (task, source_id, frame).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.chunks import CHUNK, by_chunk, carry, own_rows, running, spread, with_chunk
from trackloom.functions.ranges import overlapping, points_in_intervals
from trackloom.session import lookup, materialize

KEY = ["task", "source_id", "frame"]


# -- replay -----------------------------------------------------------------------------------

def replay_heads(events: DataFrame) -> DataFrame:
    """The latest revision of each key: the one nobody supersedes. Needs no event order."""
    replaced = events.filter("superseded_revision IS NOT NULL").select(F.col("superseded_revision").alias("revision_id"))
    return events.join(replaced, "revision_id", "left_anti")


def replay_active(events: DataFrame) -> DataFrame:
    """The label in force per key. An undo brings back the revision before the undone one, unless that is
    absent or an undo itself."""
    heads = replay_heads(events)
    labels = heads.filter("label_kind <> 'undo'")
    undone = heads.filter("label_kind = 'undo'").select(F.col("superseded_revision").alias("undone_id"))
    restored = (events.join(undone, events["revision_id"] == undone["undone_id"])
                      .filter("superseded_revision IS NOT NULL").select(F.col("superseded_revision").alias("revision_id")))
    return labels.unionByName(events.join(restored, "revision_id").filter("label_kind <> 'undo'").select(*events.columns))


def replay_violations(events: DataFrame) -> DataFrame:
    """Revisions that break the chain rules, one row per broken rule."""
    by_id = events.groupBy("revision_id").agg(F.count(F.lit(1)).alias("copies"))
    parents = events.groupBy(F.col("revision_id").alias("superseded_revision")).agg(F.min(F.struct(*KEY)).alias("p"))
    parents = parents.select("superseded_revision", *[F.col("p")[k].alias(f"p_{k}") for k in KEY])
    children = events.filter("superseded_revision IS NOT NULL").groupBy("superseded_revision").agg(F.count(F.lit(1)).alias("children"))
    # first revisions never meet the parent join, so they cannot pile up on its null key
    linked = (events.filter("superseded_revision IS NOT NULL").join(parents, "superseded_revision", "left")
                    .join(children, "superseded_revision", "left"))
    first = events.filter("superseded_revision IS NULL")
    roots = first.groupBy(*KEY).agg(F.count(F.lit(1)).alias("roots"))
    same = F.lit(True)
    for k in KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"p_{k}"))
    name = lambda c, n: F.when(c, F.lit(n))
    found = lambda df, *rules: df.select("revision_id", F.explode(F.array_compact(F.array(*rules))).alias("violation"))
    empty = F.col("revision_id").isNull() | (F.col("revision_id").cast("string") == "")
    return (found(by_id.filter("copies > 1"), F.lit("duplicate_revision_id"))
            .unionByName(found(events.filter(empty), F.lit("empty_revision_id")))
            .unionByName(found(linked, name(F.col("p_task").isNull(), "unknown_parent"),
                               name(F.col("p_task").isNotNull() & ~same, "parent_of_other_key"),
                               name(F.col("children") > 1, "branched_revision")))
            .unionByName(found(first.join(roots, KEY), name(F.col("roots") > 1, "second_first_revision"),
                               name(F.col("label_kind") == "undo", "undo_first"))))


def export_labels(events: DataFrame, task: str | None = None, include_unsure: bool = False) -> DataFrame:
    """Active labels ready for export, ordered by key."""
    rows = replay_active(events)
    if task is not None:
        rows = rows.filter(F.col("task") == task)
    if not include_unsure:
        rows = rows.filter("label_kind <> 'unsure'")
    return rows.orderBy(*KEY)


def export_summary(events: DataFrame, exported: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("revision_count")).join(exported.agg(F.count(F.lit(1)).alias("label_count")))


def undo_target(events: DataFrame) -> DataFrame:
    """Per (annotator, session): its latest non-undo revision that is still head."""
    mine = replay_heads(events).filter("label_kind <> 'undo'")
    latest = mine.groupBy("annotator", "session_id").agg(F.max_by(F.struct("revision_id", *KEY), F.struct("ts", "revision_id")).alias("t"))
    return latest.select("annotator", "session_id", "t.*")


def burst_frames(bursts: DataFrame) -> DataFrame:
    """One row per queued frame."""
    return bursts.withColumn("frame", F.explode(F.sequence("start_frame", "end_frame")))


def audit_progress(bursts: DataFrame, events: DataFrame) -> DataFrame:
    """Every queued frame with its completion flag and active label."""
    active = replay_active(events).select(*KEY, "label_kind", "revision_id")
    rows = burst_frames(bursts.select("burst_id", "task", "source_id", "start_frame", "end_frame")).join(active, KEY, "left")
    return rows.select("burst_id", *KEY, F.col("revision_id").isNotNull().alias("completed"), "label_kind", "revision_id")


def audit_completion(progress: DataFrame) -> DataFrame:
    return progress.groupBy("task").agg(F.count(F.when(F.col("completed"), 1)).alias("complete"), F.count(F.lit(1)).alias("total"))


def frame_history(events: DataFrame) -> DataFrame:
    """All revisions of each frame beside its active label."""
    active = replay_active(events).select(*KEY, F.col("revision_id").alias("active_revision"), F.col("label_kind").alias("active_label"))
    return events.join(active, KEY, "left")


# -- label checks -----------------------------------------------------------------------------

LABEL_KINDS = ("selected", "missing_proposal", "no_shuttle", "unsure")


def validate_labels(labels: DataFrame, sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per (label, problem).

    ``labels``: label_id, source_id, frame, label_kind, candidate_id, candidate_artifact_sha256;
    ``sources``: source_id, frame_count, artifact_sha256; ``candidates``: source_id, frame, candidate_id.
    """
    rows = lookup(labels, sources.select("source_id", "frame_count", "artifact_sha256"), "source_id", "left")
    ids = candidates.select("source_id", "candidate_id", F.col("frame").alias("candidate_frame")).dropDuplicates(["source_id", "candidate_id"])
    named = rows.filter("candidate_id IS NOT NULL").join(ids, ["source_id", "candidate_id"], "left")
    rows = named.unionByName(rows.filter("candidate_id IS NULL").withColumn("candidate_frame", F.lit(None).cast("long")))
    chosen, has_id = F.col("label_kind") == "selected", F.coalesce(F.col("candidate_id") != "", F.lit(False))
    rules = {
        "unknown_source": F.col("frame_count").isNull(),
        "frame_out_of_range": (F.col("frame") < 0) | (F.col("frame") >= F.col("frame_count")),
        "fingerprint_mismatch": ~F.col("candidate_artifact_sha256").eqNullSafe(F.col("artifact_sha256")),
        "invalid_label_kind": ~F.col("label_kind").isin(*LABEL_KINDS),
        "missing_candidate_id": chosen & ~has_id,
        "unknown_candidate_id": chosen & has_id & F.col("candidate_frame").isNull(),
        "candidate_of_other_frame": chosen & has_id & (F.col("candidate_frame") != F.col("frame")),
        "unexpected_candidate_id": ~chosen & F.col("candidate_id").isNotNull(),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return rows.select("label_id", F.explode(found).alias("problem"))


def suggestions(candidates: DataFrame, frames: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Default label per frame from the marked component of verified artifacts.

    ``candidates``: source_id, frame, candidate_id, threshold, marked; ``frames``: every artifact frame;
    ``artifacts``: source_id, verified. Contradictory marks give no suggestion.
    """
    at_half = F.col("threshold") == 0.5
    marks = candidates.groupBy("source_id", "frame").agg(
        F.count(F.when(F.col("marked"), 1)).alias("marks"), F.count(F.when(at_half, 1)).alias("halves"),
        F.count(F.when(F.col("marked") & ~F.coalesce(at_half, F.lit(False)), 1)).alias("wrong"),
        F.max(F.when(F.col("marked"), F.col("candidate_id"))).alias("candidate_id"))
    rows = lookup(frames, artifacts.filter("verified").select("source_id"), "source_id", "left_semi")
    rows = rows.select("source_id", "frame").join(marks, ["source_id", "frame"], "left").na.fill(0, ["marks", "halves", "wrong"])
    clear = (F.col("marks") <= 1) & (F.col("wrong") == 0) & ~((F.col("halves") > 0) & (F.col("marks") != 1))
    return rows.filter(clear).select(
        "source_id", "frame", F.when(F.col("candidate_id").isNotNull(), "selected").otherwise("no_shuttle").alias("semantic_label"), "candidate_id")


def verified_artifacts(meta: DataFrame) -> DataFrame:
    """Provenance gate over artifact headers: source_id, verified."""
    digest = lambda c: F.coalesce(F.col(c).rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    ok = ((F.col("schema_version") == 2) & (F.col("extraction_version") == F.col("expected_extraction_version"))
          & (F.col("model_stage") == F.col("expected_model_stage")) & (F.col("threshold_comparator") == ">")
          & (F.col("legacy_compatibility_threshold") == 0.5) & F.array_contains("thresholds", 0.5)
          & F.col("provenance_verified") & ~F.coalesce(F.col("nonproduction_unverified_provenance"), F.lit(False))
          & digest("checkpoint_sha256") & digest("inference_model_sha256"))
    return meta.select("source_id", F.coalesce(ok, F.lit(False)).alias("verified"))


def review_actions(labels: DataFrame, suggested: DataFrame) -> DataFrame:
    """human_created without a suggestion, else human_confirmed or human_corrected."""
    s = suggested.select("source_id", "frame", F.col("semantic_label").alias("s_label"), F.col("candidate_id").alias("s_candidate"))
    rows = labels.join(s, ["source_id", "frame"], "left")
    agrees = (F.col("label_kind") == F.col("s_label")) & F.col("candidate_id").eqNullSafe(F.col("s_candidate"))
    action = F.when(F.col("s_label").isNull(), "human_created").when(agrees, "human_confirmed").otherwise("human_corrected")
    return rows.withColumn("review_action", action).drop("s_label", "s_candidate")


# -- queues -----------------------------------------------------------------------------------

def queue_scores(frames: DataFrame, candidates: DataFrame) -> DataFrame:
    """Crowded frames and weak evidence first: candidate count plus 1 - strongest peak (clamped)."""
    stats = candidates.groupBy("source_id", "frame").agg(F.count(F.lit(1)).alias("n"), F.max("peak").alias("top"))
    rows = frames.select("source_id", "frame").join(stats, ["source_id", "frame"], "left")
    top = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("top", F.lit(0.0))))
    return rows.select("source_id", "frame", (F.coalesce("n", F.lit(0)) + 1.0 - top).alias("score"))


def _in_runs(eligible: DataFrame) -> DataFrame:
    """Distinct frames with the first and last frame of their contiguous run."""
    frames = eligible.select("source_id", "frame").distinct()
    w = by_chunk()
    step = lambda fn: fn("frame").over(w)
    rows = spread(frames, 1, 1).withColumns({"prev": step(F.lag), "next": step(F.lead)})
    rows = with_chunk(own_rows(rows))
    head = F.when(F.coalesce(F.col("prev") != F.col("frame") - 1, F.lit(True)), F.col("frame"))
    tail = F.when(F.coalesce(F.col("next") != F.col("frame") + 1, F.lit(True)), F.col("frame"))
    rows = carry(rows, last={"head_before": head}, following={"tail_after": tail})
    down = Window.partitionBy("source_id", CHUNK).orderBy(F.desc("frame")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "source_id", "frame", F.coalesce(F.last(head, ignorenulls=True).over(running(w)), F.col("head_before")).alias("run_start"),
        F.coalesce(F.last(tail, ignorenulls=True).over(down), F.col("tail_after")).alias("run_end"))


def eligible_runs(eligible: DataFrame) -> DataFrame:
    """Contiguous runs of eligible frames."""
    return _in_runs(eligible).filter("frame = run_start").select("source_id", "run_start", "run_end")


def _burst(anchor: Column, first: Column, last: Column, fps: Column) -> tuple[Column, Column]:
    """One second around the anchor (half-up length), shifted into [first, last]."""
    size = last - first + 1
    length = F.least(F.greatest(F.lit(1), F.floor(fps + 0.5).cast("long")), size)
    start = F.least(F.greatest(F.lit(0), anchor - first - F.floor(length / 2).cast("long")), size - length) + first
    return start, start + length - 1


def frame_bursts(eligible: DataFrame, sources: DataFrame) -> DataFrame:
    """The burst of every eligible anchor, contained in its run."""
    rows = lookup(_in_runs(eligible), sources.select("source_id", "fps"), "source_id", "inner")
    start, end = _burst(F.col("frame"), F.col("run_start"), F.col("run_end"), F.col("fps"))
    return rows.select("source_id", F.col("frame").alias("anchor_frame"), start.alias("start_frame"), end.alias("end_frame"))


def seeded(seed: int, *columns: str) -> Column:
    """Reproducible pseudo-random text key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def audit_tiles(eligible: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Randomly shifted maximal tiling of every run into one-second bursts."""
    rows = lookup(eligible_runs(eligible), sources.select("source_id", "fps"), "source_id", "inner")
    size = F.col("run_end") - F.col("run_start") + 1
    length = F.least(F.greatest(F.lit(1), F.floor(F.col("fps") + 0.5).cast("long")), size)
    rows = rows.withColumn("length", length).withColumn("capacity", F.floor(size / F.col("length")).cast("long"))
    slack = size - F.col("capacity") * F.col("length")
    shift = F.conv(F.substring(seeded(seed, "source_id", "run_start"), 1, 8), 16, 10).cast("long") % (slack + 1)
    first = F.col("run_start") + F.col("shift") + F.col("i") * F.col("length")
    return (rows.withColumn("shift", shift).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("capacity") - 1)))
                .select("source_id", (first + F.floor(F.col("length") / 2).cast("long")).alias("anchor_frame"),
                        first.alias("start_frame"), (first + F.col("length") - 1).alias("end_frame")))


def audit_queue(eligible: DataFrame, sources: DataFrame, seed: int, anchor_count: int) -> DataFrame:
    """Uniform seeded sample of ``anchor_count`` tiles; asking for more than exist is an error."""
    if anchor_count < 1:
        raise ValueError("anchor_count must be positive")
    tiles = materialize(audit_tiles(eligible, sources, seed), "tiles")
    if tiles.limit(anchor_count).count() < anchor_count:  # told here, where no later selection can lose it
        raise ValueError("anchor_count exceeds the non-overlapping capacity")
    return tiles.withColumn("draw", seeded(seed, "source_id", "anchor_frame")).orderBy("draw").limit(anchor_count).drop("draw")


def adaptive_queue(scores: DataFrame, bursts: DataFrame, anchor_count: int, audit: DataFrame | None = None) -> DataFrame:
    """Highest scores first, skipping bursts that touch the audit queue or an earlier choice.

    Exact on a bounded head of the ranking: a chosen burst of L frames rules out fewer than 3L anchors
    (2L-1 starts, plus the anchors pushed to the same start at a run's ends), so ``anchor_count`` choices
    never look past the best ``3 * L * anchor_count`` anchors that are clear of the audit.
    """
    if anchor_count < 1:
        raise ValueError("anchor_count must be positive")
    rows = bursts.join(scores.withColumnRenamed("frame", "anchor_frame"), ["source_id", "anchor_frame"])
    if audit is not None:
        a = rows.select("source_id", "anchor_frame", F.col("start_frame").alias("a_start"), F.col("end_frame").alias("a_end"))
        b = audit.select("source_id", F.col("start_frame").alias("b_start"), F.col("end_frame").alias("b_end"))
        taken = overlapping(a, b).select("source_id", "anchor_frame").distinct()
        rows = rows.join(taken, ["source_id", "anchor_frame"], "left_anti")
    longest = rows.agg(F.max(F.col("end_frame") - F.col("start_frame") + 1)).first()[0] or 1
    order = [F.desc("score"), "source_id", "anchor_frame"]
    head = rows.orderBy(*order).limit(3 * longest * anchor_count)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "anchor_frame"], ascending=[False, True])
        used: set[int] = set()
        keep = []
        for s, e in zip(pdf["start_frame"], pdf["end_frame"]):
            frames = range(int(s), int(e) + 1)
            keep.append(used.isdisjoint(frames))
            if keep[-1]:
                used.update(frames)
        return pdf[keep]

    return head.groupBy("source_id").applyInPandas(choose, head.schema).orderBy(*order).limit(anchor_count)


def validate_queue(queue: DataFrame, eligible: DataFrame, sources: DataFrame, kind: str, declared_count: int | None = None) -> DataFrame:
    """Problems of a stored queue: fingerprints, burst frames, audit overlap, audit count.

    ``queue``: burst_id, source_id, anchor_frame, start_frame, end_frame, candidate_artifact_sha256,
    source_video_sha256; ``sources``: source_id, fps, artifact_sha256, video_sha256.
    """
    known = lookup(queue, sources.select("source_id", "artifact_sha256", "video_sha256"), "source_id", "left")
    wanted = frame_bursts(eligible, sources).select("source_id", "anchor_frame", F.col("start_frame").alias("w_start"), F.col("end_frame").alias("w_end"))
    rows = known.join(wanted, ["source_id", "anchor_frame"], "left")
    rules = {
        "unknown_source": F.col("artifact_sha256").isNull(),
        "artifact_mismatch": F.col("candidate_artifact_sha256") != F.col("artifact_sha256"),
        "video_mismatch": F.col("source_video_sha256") != F.col("video_sha256"),
        "frames_mismatch": ~(F.col("start_frame").eqNullSafe(F.col("w_start")) & F.col("end_frame").eqNullSafe(F.col("w_end"))),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    problems = rows.select("burst_id", F.explode(found).alias("problem"))
    if kind == "audit":
        side = lambda p: queue.select("source_id", F.col("burst_id").alias(f"{p}_id"), F.col("start_frame").alias(f"{p}_start"), F.col("end_frame").alias(f"{p}_end"))
        clash = overlapping(side("a"), side("b")).filter("a_id < b_id").select(F.col("b_id").alias("burst_id"), F.lit("overlap").alias("problem")).distinct()
        problems = problems.unionByName(clash)
        if declared_count is not None:
            size = queue.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != declared_count)
            problems = problems.unionByName(size.select(F.lit(None).cast(dict(queue.dtypes)["burst_id"]).alias("burst_id"), F.lit("count_mismatch").alias("problem")))
    return problems


def context_window(centers: DataFrame, eligible: DataFrame, candidates: DataFrame, sources: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Candidates within the given seconds of each centre frame, clipped to the centre's run."""
    if seconds <= 0:
        raise ValueError("seconds must be positive")
    rows = centers.select("source_id", "center_frame").join(
        _in_runs(eligible).withColumnRenamed("frame", "center_frame"), ["source_id", "center_frame"])
    rows = lookup(rows, sources.select("source_id", "fps", "frame_count"), "source_id", "inner")
    at, fps = F.col("center_frame") / F.col("fps"), F.col("fps")
    begin = F.greatest(F.lit(0.0), F.col("run_start") / fps, at - seconds)
    finish = F.least(F.col("frame_count") / fps, (F.col("run_end") + 1) / fps, at + seconds)
    spans = rows.select(
        "source_id", "center_frame", F.greatest(F.lit(0), F.floor(begin * fps).cast("long")).alias("start_frame"),
        F.least(F.col("run_end"), F.col("frame_count") - 1, F.ceil(finish * fps).cast("long")).alias("end_frame"))
    return points_in_intervals(candidates, spans)


# -- catalog ----------------------------------------------------------------------------------

def source_catalog(sources: DataFrame) -> DataFrame:
    """Registrations with their problem, NULL when usable."""
    copies = sources.groupBy(F.col("source_id").alias("k")).agg(F.count(F.lit(1)).alias("copies"))
    rows = sources.join(copies, sources["source_id"].eqNullSafe(copies["k"])).drop("k")
    problem = (F.when(F.col("source_id").isNull() | (F.col("source_id") == ""), "empty_source_id")
                .when(F.col("copies") > 1, "duplicate_source_id")
                .when(~F.coalesce(F.col("fps") > 0, F.lit(False)), "invalid_fps")
                .when(~F.coalesce(F.col("frame_count") > 0, F.lit(False)), "invalid_frame_count"))
    return rows.withColumn("problem", problem).drop("copies")


def task_sources(tasks: DataFrame, sources: DataFrame) -> DataFrame:
    """Task membership: the listed sources, or every source where a task lists none; unknown ids are flagged."""
    ids = sources.select("source_id").distinct()
    listed = tasks.filter(F.size("source_ids") > 0).select("task", F.explode("source_ids").alias("source_id")).distinct()
    known = listed.join(ids.withColumn("known", F.lit(True)), "source_id", "left").select(
        "task", "source_id", F.col("known").isNotNull().alias("known"))
    # a task list is configuration, so this stays as large as the sources times the open tasks
    open_tasks = tasks.filter("source_ids IS NULL OR size(source_ids) = 0").agg(F.collect_set("task").alias("tasks"))
    everything = ids.join(F.broadcast(open_tasks)).select(F.explode("tasks").alias("task"), "source_id", F.lit(True).alias("known"))
    return known.unionByName(everything)
