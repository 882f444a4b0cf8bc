"""Play intervals from track evidence: state machine, scoring, classification, corrections."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.chunks import CHUNK, by_chunk, chunk_of, numbered, own_rows, spread, with_chunk
from trackloom.folds import fold
from trackloom.functions.ranges import points_in_intervals
from trackloom.operators.tracks import visibility_streaks
from trackloom.session import lookup, materialize
from trackloom.settings import SCALED_FIELDS, RallySettings

DEFAULTS = RallySettings()

# Evidence bits of one frame.
(VISIBLE, LOST, STOPPED, QUIET_GAP, LONG_GAP, OUTSIDE, BACK, MOVING,
 SERVE_SEEN, SERVE_OK, SERVE_SEEN_START, SERVE_OK_START) = (1 << i for i in range(12))


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def player_activity_guard(frames: DataFrame, settings: RallySettings = DEFAULTS) -> DataFrame:
    """Trailing mean player activity over both windows, and whether it vetoes an end signal."""
    w = by_chunk()
    mean = lambda n: F.avg("player_activity").over(w.rowsBetween(-(n - 1), 0))
    rows = spread(frames, max(settings.recent_motion_window, settings.stopped_window), 0)
    rows = (rows.withColumn("activity_recent", mean(settings.recent_motion_window))
                .withColumn("activity_stopped", mean(settings.stopped_window)))
    return own_rows(rows.withColumn("veto_quiet_gap", F.coalesce(F.col("activity_recent") >= 0.25, F.lit(False)))
                        .withColumn("veto_stopped", F.coalesce(F.col("activity_stopped") >= 0.15, F.lit(False))))


def with_evidence(frames: DataFrame, settings: RallySettings = DEFAULTS) -> DataFrame:
    """Condense a frame's evidence into one integer ``bits``; the machine needs nothing else.

    ``frames``: source_id, frame, visible_streak, missing_count, reliable, speed and optionally
    inside_courtish, players_on_courtish, players_opposite_service_regions, player_activity.
    """
    w, s = by_chunk(), settings
    first = frames.groupBy("source_id").agg(F.min("frame").alias("first_frame"))
    rows = lookup(frames, first, "source_id", "inner")
    rows = rows.select(
        "source_id", "frame", "first_frame", "visible_streak", "missing_count", "reliable", "speed",
        _optional(frames, "inside_courtish", "boolean").alias("inside"),
        _optional(frames, "players_on_courtish", "boolean").alias("on_court"),
        _optional(frames, "players_opposite_service_regions", "boolean").alias("serve"),
        _optional(frames, "player_activity", "double").alias("activity"))
    rows = spread(rows, max(s.recent_motion_window, s.stopped_window, s.visible_streak), 0)
    trailing = lambda fn, col, n: fn(col).over(w.rowsBetween(-(max(n, 1) - 1), 0))
    rows = rows.withColumns({
        "motion": trailing(F.sum, "speed", s.recent_motion_window), "motion_stop": trailing(F.sum, "speed", s.stopped_window),
        "act": trailing(F.avg, "activity", s.recent_motion_window), "act_stop": trailing(F.avg, "activity", s.stopped_window),
        "serve_n": trailing(F.count, "serve", s.visible_streak), "serve_any": trailing(F.max, "serve", s.visible_streak)})
    moving = F.col("motion") >= s.recent_motion_minimum
    stopped = ((F.col("frame") - F.col("first_frame") >= s.stopped_window - 1)
               & (F.col("motion_stop") <= s.stopped_speed * s.stopped_window)
               & ~F.coalesce(F.col("act_stop") >= 0.15, F.lit(False)))
    quiet = ((F.col("missing_count") > s.short_gap) & ~moving
             & ~F.coalesce(F.col("act") >= 0.25, F.lit(False)))
    back = F.coalesce(F.col("inside"), F.lit(False)) | F.coalesce(F.col("on_court"), F.lit(False))
    outside = F.coalesce(~F.col("inside"), F.lit(False)) & ~F.coalesce(F.col("on_court"), F.lit(False))
    bits = {
        VISIBLE: F.col("visible_streak") >= s.visible_streak,
        LOST: F.col("missing_count") > s.interpolation_gap,
        STOPPED: stopped, QUIET_GAP: quiet,
        LONG_GAP: F.col("missing_count") >= s.long_missing_gap,
        OUTSIDE: outside, BACK: back,
        MOVING: F.col("reliable") & moving & (F.col("visible_streak") >= s.visible_streak),
        SERVE_SEEN: F.col("serve").isNotNull(), SERVE_OK: F.coalesce(F.col("serve"), F.lit(False)),
        SERVE_SEEN_START: F.col("serve_n") > 0, SERVE_OK_START: F.coalesce(F.col("serve_any"), F.lit(False)),
    }
    total = sum((F.when(c, bit).otherwise(0) for bit, c in bits.items()), F.lit(0))
    return own_rows(rows.withColumn("bits", total.cast("int"))).select("source_id", "frame", "bits")


IDLE, STARTING, LIVE, ENDING = "IDLE", "CANDIDATE_START", "IN_RALLY", "CANDIDATE_END"
START_STATE = json.dumps([IDLE, 0])


def rally_machine(settings: RallySettings, emit: str) -> Callable[[pd.DataFrame, str], tuple[dict, str]]:
    """The per-frame machine; ``emit`` is "spans" (finished intervals) or "frames" (state per frame).

    A state is [name, outside streak, then what that name needs]: start frame and serve evidence while
    starting, start frame while live, start and end frames and the end reason while ending.
    """
    s = settings
    ends = STOPPED | QUIET_GAP | LONG_GAP

    def machine(pdf: pd.DataFrame, entry: str) -> tuple[dict, str]:
        name, out, *more = json.loads(entry)
        begin, seen, good, stop, reason = 0, False, False, 0, ""
        if name == STARTING:
            begin, seen, good = more
        elif name == LIVE:
            begin, = more
        elif name == ENDING:
            begin, stop, reason = more
        starts, stops, at, names = [], [], [], []
        for i, b in zip(pdf["frame"].tolist(), pdf["bits"].tolist()):
            if b & OUTSIDE:
                out = min(out + 1, s.outside_court_frames)
            elif b & BACK:
                out = 0
            if name == IDLE:
                if b & VISIBLE:
                    name, begin = STARTING, i - s.visible_streak + 1
                    seen, good = bool(b & SERVE_SEEN_START), bool(b & SERVE_OK_START)
            elif name == STARTING:
                seen, good = seen or bool(b & SERVE_SEEN), good or bool(b & SERVE_OK)
                if b & LOST:
                    starts.append(begin), stops.append(i - 1), at.append(i)
                    name = IDLE
                elif i - begin + 1 >= s.start_confirmation:
                    name = LIVE if good or not seen else IDLE
                    begin -= s.start_buffer
            elif name == LIVE:
                if b & ends or out >= s.outside_court_frames:
                    name, stop = ENDING, i
                    reason = ("outside" if out >= s.outside_court_frames else "long_gap" if b & LONG_GAP
                              else "medium_gap" if b & QUIET_GAP else "stopped")
            elif b & BACK if reason == "outside" else b & MOVING:
                name, out = LIVE, 0
            elif i - stop + 1 >= s.end_confirmation:
                starts.append(begin), stops.append(max(begin, stop - 1 + s.end_buffer)), at.append(i)
                name = IDLE
            if emit == "frames":
                names.append(name)
        more = {STARTING: [begin, seen, good], LIVE: [begin], ENDING: [begin, stop, reason]}.get(name, [])
        state = json.dumps([name, out, *more])
        if emit == "frames":
            return {"frame": pdf["frame"].tolist(), "state": names}, state
        return {"start_frame": starts, "end_frame": stops, "at_frame": at}, state
    return machine


def _warmup(settings: RallySettings) -> int:
    return 8 * (settings.long_missing_gap + settings.end_confirmation)


def frame_states(evidence: DataFrame, settings: RallySettings = DEFAULTS) -> DataFrame:
    """The machine's state after each frame."""
    rows, _ = fold(evidence, rally_machine(settings, "frames"), START_STATE, "frame long, state string", _warmup(settings))
    return rows


def rally_spans(evidence: DataFrame, settings: RallySettings = DEFAULTS) -> DataFrame:
    """Inclusive candidate intervals in order of emission: start_frame, end_frame, number, open_ended."""
    evidence = materialize(evidence, "evidence")
    rows, exits = fold(evidence, rally_machine(settings, "spans"), START_STATE,
                       "start_frame long, end_frame long, at_frame long", _warmup(settings))
    bounds = evidence.groupBy("source_id").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
    state = F.from_json("exit_state", "array<string>")
    name, begin = state[0], state[2].cast("long")
    # "[name, outside, begin, seen, good]" while starting: the gate decides whether it counts
    gate = (state[3] != "true") | (state[4] == "true")
    unfinished = exits.filter(name.isin(LIVE, ENDING) | ((name == STARTING) & gate)).select(
        "source_id", begin.alias("start_frame"), F.lit(None).cast("long").alias("end_frame"),
        F.lit(None).cast("long").alias("at_frame"), F.lit(True).alias("open_ended"))
    spans = lookup(rows.withColumn("open_ended", F.lit(False)).unionByName(unfinished), bounds, "source_id", "inner")
    last = F.col("last_frame")
    spans = spans.select(
        "source_id", F.greatest("start_frame", "first_frame").alias("start_frame"),
        F.least(F.coalesce("end_frame", last), last).alias("end_frame"),
        F.coalesce(F.col("at_frame"), last + 1).alias("at_frame"), "open_ended")
    return numbered(spans, ["source_id"], chunk_of("at_frame", 1 << 16), ["at_frame"], "number").drop("at_frame")


def score_rallies(spans: DataFrame, frames: DataFrame, settings: RallySettings = DEFAULTS) -> DataFrame:
    """Confidence and its ingredients for each interval.

    ``frames``: source_id, frame, reliable, removed, missing_count, speed, ``present`` (has a smoothed
    point) and optionally player_activity.
    """
    s = settings
    rows = frames.select("source_id", "frame", "reliable", "removed", "missing_count", "speed", "present",
                         _optional(frames, "player_activity", "double").alias("player_activity"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    steps = F.col("present") & (F.col("speed") > s.stopped_speed) & (F.col("speed") <= s.max_single_frame_jump)
    stats = points_in_intervals(rows, spans.select("source_id", "number", "start_frame", "end_frame")).groupBy(
        "source_id", "number").agg(
        F.count(F.lit(1)).alias("frames"), one(F.col("reliable")).alias("reliable_frames"), one(F.col("removed")).alias("removed_frames"),
        one(F.col("present")).alias("steps"), one(steps).alias("moving_steps"),
        F.max("missing_count").alias("longest_gap"), F.sum("speed").alias("motion"), F.avg("player_activity").alias("activity"))
    n = F.col("frames")
    reliable, removed = F.col("reliable_frames") / n, F.col("removed_frames") / n
    share = F.when(F.col("steps") > 0, F.col("moving_steps") / F.col("steps")).otherwise(0.0)
    has = F.col("activity").isNotNull()
    weighted = (reliable * s.reliable_weight + share * s.motion_weight
                + F.when(has, F.col("activity") * s.player_weight).otherwise(0.0))
    weights = F.when(has, s.reliable_weight + s.motion_weight + s.player_weight).otherwise(s.reliable_weight + s.motion_weight)
    gap = F.least(F.lit(1.0), F.col("longest_gap") / F.lit(float(max(s.long_missing_gap, 1))))
    score = weighted / weights + s.long_gap_weight * gap + s.removed_weight * removed
    flags = F.array_compact(F.array(F.when(reliable < 0.5, F.lit("low_shuttle_confidence")),
                                    F.when(F.col("longest_gap") >= s.long_missing_gap, F.lit("large_missing_gap"))))
    return spans.join(stats, ["source_id", "number"]).select(
        *spans.columns, "frames", "reliable_frames", "motion",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"), flags.alias("score_flags"))


def classify_rallies(scored: DataFrame, fps: float, settings: RallySettings = DEFAULTS,
                     base_flags: Iterable[str] = (), source_flags: DataFrame | None = None) -> DataFrame:
    """Canonical rally rows: status, confidence band, flags and failure reasons (``;``-joined).

    ``base_flags`` hold for all rallies, ``source_flags`` (source_id, flags) for those of a source.
    """
    if fps <= 0:
        raise ValueError("fps must be positive")
    s = settings
    base = list(base_flags) + ([] if abs(fps - s.target_fps) <= 1e-9 * max(fps, s.target_fps) else ["non_30_fps"])
    short = F.col("frames") < s.minimum_rally
    named = lambda c, name: F.when(c, F.lit(name))
    reasons = F.array_compact(F.array(
        named(short, "short_rally"), named(F.col("reliable_frames") < s.minimum_visible_frames, "insufficient_reliable_detections"),
        named(F.col("motion") < s.minimum_motion, "insufficient_motion")))
    if source_flags is not None:
        scored = lookup(scored, source_flags.select("source_id", F.col("flags").alias("own_flags")), "source_id", "left")
    own = F.coalesce("own_flags", F.array().cast("array<string>")) if source_flags is not None else F.array().cast("array<string>")
    flags = F.concat(F.array(*[F.lit(f) for f in base]).cast("array<string>"), own,
                     F.array_compact(F.array(named(F.col("open_ended"), "manual_review_needed"))),
                     F.col("score_flags"), F.array_compact(F.array(named(short, "short_rally"))))
    rows = scored.withColumn("reasons", reasons).withColumn("flag_list", F.array_distinct(flags))
    status = F.when(F.size("reasons") > 0, "rejected").when(F.size("flag_list") > 0, "review").otherwise("accepted")
    rows = rows.withColumn("status", status)
    noted = F.when(F.col("status") == "review", F.array_distinct(F.concat("flag_list", F.array(F.lit("manual_review_needed"))))).otherwise(F.col("flag_list"))
    band = F.when(F.col("score") >= 0.75, "high").when(F.col("score") >= 0.5, "medium").otherwise("low")
    return rows.select(
        "source_id", rally_id("source_id", "number").alias("rally_id"), "start_frame", "end_frame",
        (F.col("start_frame") / F.lit(float(fps))).alias("start_time"), (F.col("end_frame") / F.lit(float(fps))).alias("end_time"),
        "status", F.round("score", 6).alias("confidence"), band.alias("confidence_band"),
        F.concat_ws(";", noted).alias("flags"), F.concat_ws(";", "reasons").alias("failure_reason"),
        *[F.lit("").alias(c) for c in ("manual_start_frame", "manual_end_frame", "manual_decision")])


def rally_id(source: str, number: str) -> Column:
    """``source-NNNN``; numbers above 9999 keep all their digits."""
    digits = F.col(number).cast("string")
    return F.concat(F.col(source).cast("string"), F.lit("-"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def with_presence(frames: DataFrame) -> DataFrame:
    return frames.withColumn("present", F.col("smooth_x").isNotNull() & (F.col("cleaned") | F.col("interpolated")))


def segment_rallies(frames: DataFrame, fps: float, settings: RallySettings = DEFAULTS,
                    base_flags: Iterable[str] = (), source_flags: DataFrame | None = None) -> DataFrame:
    """Preprocessed tracks (with any court and player signals joined on) -> canonical rallies.

    The frame evidence is written once; the machine, its bounds and the scoring read it back.
    """
    present = frames if "present" in frames.columns else with_presence(frames)
    wanted = ["source_id", "frame", "visible_streak", "missing_count", "reliable", "removed", "speed", "present",
              "inside_courtish", "players_on_courtish", "players_opposite_service_regions", "player_activity"]
    present = materialize(present.select(*[c for c in wanted if c in present.columns]), "frames")
    spans = rally_spans(with_evidence(present, settings), settings)
    return classify_rallies(score_rallies(spans, present, settings), fps, settings, base_flags, source_flags)


# -- frame rates ------------------------------------------------------------------------------

def scaled_thresholds(sources: DataFrame, settings: RallySettings = DEFAULTS) -> DataFrame:
    """Frame-count thresholds of every source at its own frame rate."""
    ratio = F.col("fps") / F.lit(settings.target_fps)
    scale = lambda n: F.greatest(F.lit(1), F.bround(F.lit(float(getattr(settings, n))) * ratio, 0).cast("int"))
    columns = {n: scale(n) for n in SCALED_FIELDS}
    window = columns["smoothing_window"]
    columns["smoothing_window"] = F.greatest(F.lit(3), window + F.when(window % 2 == 0, 1).otherwise(0))
    order = F.least(F.lit(settings.smoothing_polyorder), columns["smoothing_window"] - 1)
    return sources.select("source_id", "fps", *[c.alias(n) for n, c in columns.items()], order.alias("smoothing_polyorder"))


def per_frame_rate(frames: DataFrame, sources: DataFrame, run: Callable[[DataFrame, float, RallySettings], DataFrame],
                   settings: RallySettings = DEFAULTS, max_rates: int = 64) -> DataFrame:
    """Apply ``run(frames, fps, scaled settings)`` once per distinct frame rate and union the results."""
    rates = [r.fps for r in sources.select("fps").distinct().limit(max_rates + 1).collect()]
    if len(rates) > max_rates:
        raise ValueError(f"more than {max_rates} distinct frame rates; normalise them first")
    result = None
    for fps in sorted(rates):
        ids = sources.filter(F.col("fps") == fps).select("source_id")
        part = run(frames.join(ids, "source_id", "left_semi"), fps, settings.for_fps(fps))
        result = part if result is None else result.unionByName(part)
    return result


def probability_frames(probabilities: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Model probabilities as track evidence: reliable where probability >= threshold.

    ``probabilities``: source_id, frame, probability and optionally motion, inside_courtish, player_activity.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    motion = F.greatest(F.lit(0.0), F.coalesce(_optional(probabilities, "motion", "double"), F.lit(0.0)))
    rows = (probabilities.withColumn("reliable", F.col("probability") >= threshold)
                         .withColumn("speed", motion).withColumn("removed", F.lit(False)))
    return visibility_streaks(rows.withColumn("present", F.col("reliable")), "reliable")


def decode_probabilities(probabilities: DataFrame, fps: float, settings: RallySettings = DEFAULTS,
                         threshold: float = 0.5) -> DataFrame:
    """Rallies from per-frame model probabilities, with thresholds scaled to ``fps``."""
    frames = probability_frames(probabilities, threshold)
    return segment_rallies(frames, fps, settings.for_fps(fps), ["decoded_from_model_probabilities"])


# -- binary predictions -----------------------------------------------------------------------

def smooth_binary(df: DataFrame) -> DataFrame:
    """Five-wide mean filter with reflected ends, thresholded above one half."""
    w = by_chunk()
    own, near = F.col("pred"), lambda k: (F.lag if k < 0 else F.lead)("pred", abs(k)).over(w)
    total = (own + F.coalesce(near(-1), own) + F.coalesce(near(1), own)
             + F.coalesce(near(-2), near(-1), near(1), own) + F.coalesce(near(2), near(1), near(-1), own))
    rows = spread(df, 2, 2).withColumn("smoothed", F.when(total >= 3, 1).otherwise(0))
    return own_rows(rows)


HIT, SOFT_START, NO_RECOVERY = 1, 2, 4


def binary_machine(grace: int, min_length: int):
    """State: [rally start or null, misses since the last hit or check].

    Every ``grace`` misses in a row a rally is checked, and ends where nothing is ahead. The number of a miss in its row of misses
    is its distance to the last hit, so starts and checks are found by search.
    """
    def machine(pdf: pd.DataFrame, entry: str) -> tuple[dict, str]:
        start, carried = json.loads(entry)
        frame, bits = pdf["frame"].to_numpy(), pdf["bits"].to_numpy()
        n, row = len(frame), np.arange(len(frame))
        hit = (bits & HIT) > 0
        last_hit = np.maximum.accumulate(np.where(hit, row, -1)) if n else row
        misses = np.where(last_hit >= 0, row - last_hit, row + 1 + carried)
        opening = np.flatnonzero(hit & ((bits & SOFT_START) > 0))
        ending = np.flatnonzero(~hit & (misses % grace == 0) & ((bits & NO_RECOVERY) > 0))
        after = lambda rows, k: int(rows[p]) if (p := np.searchsorted(rows, k)) < len(rows) else n
        starts, stops, k = [], [], 0
        while True:
            if start is None:
                if (k := after(opening, k)) == n:
                    break
                start = int(frame[k])
            if (k := after(ending, k)) == n:
                break
            if frame[k] - start >= min_length:
                starts.append(start)
                stops.append(int(frame[k]))
            start, k = None, k + 1
        left = 0 if start is None else int(misses[-1] % grace) if n else carried
        return {"start_frame": starts, "end_frame": stops}, json.dumps([start, left])
    return machine


def segment_binary(df: DataFrame, min_length: int = 50, grace: int = 3, look_ahead: int = 30) -> DataFrame:
    """Older decoder over 0/1 predictions: all-positive look-ahead to start, empty look-ahead to end."""
    w = by_chunk()
    ahead = w.rowsBetween(0, look_ahead - 1)
    soft = (F.min("pred").over(ahead) == 1) & (F.count(F.lit(1)).over(w.rowsBetween(0, look_ahead)) == look_ahead + 1)
    bits = (F.when(F.col("pred") == 1, HIT).otherwise(0) + F.when(soft, SOFT_START).otherwise(0)
            + F.when(F.sum("pred").over(ahead) == 0, NO_RECOVERY).otherwise(0))
    evidence = own_rows(spread(df.select("source_id", "frame", "pred"), 0, look_ahead + 1).withColumn("bits", bits))
    evidence = materialize(evidence.select("source_id", "frame", "bits"), "evidence")
    rows, exits = fold(evidence, binary_machine(grace, min_length), "[null, 0]", "start_frame long, end_frame long", 8 * look_ahead)
    last = evidence.groupBy("source_id").agg(F.max("frame").alias("end_frame"))
    begin = F.from_json("exit_state", "array<long>")[0]
    tail = exits.select("source_id", begin.alias("start_frame")).filter("start_frame IS NOT NULL").join(last, "source_id")
    return rows.unionByName(tail.filter(F.col("end_frame") - F.col("start_frame") >= min_length))


# -- export bounds ----------------------------------------------------------------------------

def pad_bounds(rallies: DataFrame, sources: DataFrame, before_seconds: float = 0.0, after_seconds: float = 0.0) -> DataFrame:
    """Widen intervals for export: half-even frame counts, clamped to the source."""
    if before_seconds < 0 or after_seconds < 0:
        raise ValueError("padding cannot be negative")
    rows = lookup(rallies, sources.select("source_id", "fps", "frame_count"), "source_id", "inner")
    frames = lambda seconds: F.bround(F.lit(float(seconds)) * F.col("fps"), 0).cast("long")
    return (rows.withColumn("padded_start", F.greatest(F.lit(0), F.col("start_frame") - frames(before_seconds)))
                .withColumn("padded_end", F.least(F.col("frame_count") - 1, F.col("end_frame") + frames(after_seconds)))
                .drop("fps", "frame_count"))


def clip_windows(hits: DataFrame, sources: DataFrame, lead_seconds: float = 0.5, length: int = 36) -> DataFrame:
    """Inclusive clip window around each labelled hit frame, clamped to the source."""
    rows = lookup(hits, sources.select("source_id", "fps", "frame_count"), "source_id", "inner")
    start = F.greatest(F.lit(0), (F.col("frame") - F.col("fps") * lead_seconds).cast("long"))
    return (rows.withColumn("clip_start", start)
                .withColumn("clip_end", F.least(F.col("clip_start") + length - 1, F.col("frame_count") - 1))
                .drop("fps", "frame_count"))


# -- manual corrections -----------------------------------------------------------------------

def _number_or_null(c: str) -> Column:
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).cast("long"))


def validate_corrections(rows: DataFrame, source_start: int | None = None, source_end: int | None = None) -> DataFrame:
    """One row per problem in reviewed rallies (text columns, as read); empty when all is well.

    ``row_number`` identifies the file row.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    manual_start, manual_end = ~blank("manual_start_frame"), ~blank("manual_end_frame")
    decision = F.lower(F.trim(F.coalesce("manual_decision", F.lit(""))))
    effective = lambda manual, auto, used: F.when(used, _number_or_null(manual)).otherwise(_number_or_null(auto))
    base = rows.select(
        "source_id", "rally_id", "row_number", decision.alias("decision"), manual_start.alias("ms"), manual_end.alias("me"),
        (_number_or_null("start_frame").isNull() | _number_or_null("end_frame").isNull()).alias("bad_auto"),
        effective("manual_start_frame", "start_frame", manual_start).alias("s"),
        effective("manual_end_frame", "end_frame", manual_end).alias("e"))
    base = base.withColumn("unreadable", F.col("bad_auto") | F.col("s").isNull() | F.col("e").isNull())
    repeats = base.groupBy("rally_id").agg(F.min("row_number").alias("first_row"))
    base = base.join(repeats, "rally_id")
    ok = ~F.col("unreadable")
    rules = {
        "invalid_decision": ~F.col("decision").isin("", "accept", "reject"),
        "boundaries_without_accept": (F.col("decision") != "accept") & (F.col("ms") | F.col("me")),
        "duplicate_rally_id": F.col("row_number") > F.col("first_row"),
        "boundaries_not_integers": F.col("unreadable"),
        "invalid_boundaries": ok & ((F.col("s") < 0) | (F.col("e") < F.col("s"))),
    }
    if source_start is not None:
        rules["start_outside_source"] = ok & (F.col("s") < source_start)
    if source_end is not None:
        rules["end_outside_source"] = ok & (F.col("e") > source_end)
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    single = base.select("source_id", "row_number", F.explode(found).alias("problem"), F.lit(None).cast("long").alias("other_row"))
    # neighbours in (start, end, row) order, one slice of the source at a time
    kept = base.filter(ok & (F.col("decision") != "reject")).select("source_id", "row_number", "s", "e")
    kept = kept.withColumn("place", F.greatest(F.lit(0), F.col("s")))
    clash = _previous_interval(kept).filter(F.col("s") <= F.col("previous.e")).select(
        "source_id", F.col("previous.row_number").alias("row_number"), F.lit("overlap").alias("problem"),
        F.col("row_number").alias("other_row"))
    return single.unionByName(clash)


def _previous_interval(kept: DataFrame) -> DataFrame:
    """The interval before each one in (s, e, row_number) order, carried across slices."""
    rows = with_chunk(kept, "place").withColumn("me", F.struct("s", "e", "row_number"))
    w = by_chunk(order=["s", "e", "row_number"])
    ends = rows.groupBy("source_id", CHUNK).agg(F.max("me").alias("tail"))
    ends = ends.select("source_id", CHUNK, F.lag("tail").over(Window.partitionBy("source_id").orderBy(CHUNK)).alias("carried"))
    rows = rows.join(ends, ["source_id", CHUNK], "left")
    return rows.withColumn("previous", F.coalesce(F.lag("me").over(w), F.col("carried")))


def finalize_rallies(rows: DataFrame, fps: float) -> DataFrame:
    """Apply the reviewers' decisions and boundaries; what remains is accepted."""
    if fps <= 0:
        raise ValueError("fps must be positive")
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    decision, status = F.lower(text("manual_decision")), F.lower(text("status"))
    kept = rows.filter((decision != "reject") & ((decision != "") | (status == "accepted")))
    for end in ("start", "end"):
        manual = F.nullif(text(f"manual_{end}_frame"), F.lit(""))
        kept = kept.withColumn(f"{end}_frame", F.coalesce(manual, F.col(f"{end}_frame").cast("string")).cast("long"))
        kept = kept.withColumn(f"{end}_time", F.col(f"{end}_frame") / F.lit(float(fps)))
    return kept.withColumn("status", F.lit("accepted"))
