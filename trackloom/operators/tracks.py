"""Point-track cleaning and kinematics: one row per (source_id, frame), frames contiguous per source."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.chunks import CHUNK, by_chunk, carry, left_behind, own_rows, running, spread, with_chunk
from trackloom.session import lookup, materialize
from trackloom.settings import RallySettings

DEFAULTS = RallySettings()


def normalize_tracks(df: DataFrame, width: int, height: int, settings: RallySettings = DEFAULTS) -> DataFrame:
    """Flag unusable points and scale the rest to image fractions; unusable coordinates become NULL."""
    if width <= 0 or height <= 0:
        raise ValueError("image size must be positive")
    x, y, shown = F.col("raw_x"), F.col("raw_y"), F.col("visibility") == 1
    inside = shown & (x >= 0) & (x < width) & (y >= 0) & (y < height)
    confident = F.col("peak_value").isNull() | (F.col("peak_value") >= settings.peak_cutoff)
    good = F.coalesce(inside & confident, F.lit(False))
    return (df.withColumn("cleaned", good)
              .withColumn("removed", shown & ~F.col("cleaned"))
              .withColumn("removal_reason", F.when(good | ~shown, "")
                          .when(inside, "low_peak").otherwise("invalid_coordinate"))
              .withColumn("x", F.when(F.col("cleaned"), x / F.lit(float(width))))
              .withColumn("y", F.when(F.col("cleaned"), y / F.lit(float(height)))))


def tracks_quality(df: DataFrame) -> DataFrame:
    """One row per rule violation; an empty result means the track table can be used.

    ``df`` keeps file order in ``row_number`` (1-based data rows of the file), starting at 2.
    """
    rows = with_chunk(df, "row_number")
    before = by_chunk(order=["row_number"]).rowsBetween(Window.unboundedPreceding, -1)
    rows = carry(rows, last={"carried": F.col("frame")}, frame="row_number")
    previous = F.coalesce(F.last("frame", ignorenulls=True).over(before), F.col("carried"))  # last readable frame
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    frame = F.col("frame")
    rules = {
        "invalid_frame": bad(frame) | (frame != F.floor(frame)),
        "negative_frame": frame < 0,
        "duplicate_frame": frame == F.col("previous"),
        "unordered_frame": frame < F.col("previous"),
        "missing_frames": frame > F.col("previous") + 1,
        "invalid_coordinate": bad(F.col("raw_x")) | bad(F.col("raw_y")),
        "invalid_visibility": F.col("visibility").isNull() | ~F.col("visibility").isin(0, 1),
    }
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return (rows.withColumn("previous", previous)
                .select("source_id", "row_number", F.col("frame"), F.explode(found).alias("violation")))


def require_valid(df: DataFrame) -> DataFrame:
    """Strict mode: fail the job on the first violating row instead of reporting it."""
    if not tracks_quality(df).isEmpty():
        raise ValueError("track table violates the input rules; see tracks_quality")
    return df


# -- cleaning ---------------------------------------------------------------------------------

def _drop_point(df: DataFrame, when: Column, reason: str) -> DataFrame:
    gone = F.col("drop_now")
    return df.withColumn("drop_now", when).withColumns({
        "cleaned": F.col("cleaned") & ~gone, "removed": F.col("removed") | gone,
        "removal_reason": F.when(gone, reason).otherwise(F.col("removal_reason")),
        "x": F.when(F.col("cleaned") & ~gone, F.col("x")), "y": F.when(F.col("cleaned") & ~gone, F.col("y")),
    }).drop("drop_now")


def _isolated(df: DataFrame, radius: int) -> DataFrame:
    near = F.sum(F.col("cleaned").cast("int")).over(by_chunk().rowsBetween(-radius, radius))
    return _drop_point(df, F.col("cleaned") & (near == 1), "isolated")


def remove_isolated(df: DataFrame, settings: RallySettings = DEFAULTS) -> DataFrame:
    """Remove valid points without another valid point within the radius."""
    r = settings.isolated_radius
    return own_rows(_isolated(spread(df, r, r), r))


def _jump_marked(df: DataFrame, limit: float) -> DataFrame:
    w = by_chunk()
    px, py, nx, ny = (F.lag("x").over(w), F.lag("y").over(w), F.lead("x").over(w), F.lead("y").over(w))
    x, y = F.col("x"), F.col("y")
    jump = ((F.hypot(x - px, y - py) > limit) & (F.hypot(nx - x, ny - y) > limit)
            & (F.hypot(nx - px, ny - py) <= limit))
    return df.withColumn("jump", F.coalesce(jump, F.lit(False)))


def _drop_alternate_jumps(df: DataFrame) -> DataFrame:
    """Of each run of consecutive jump points the 1st, 3rd, 5th, ... go: dropping one rescues the next. ``df``: rows with their chunk."""
    calm = F.when(~F.col("jump"), F.col("frame"))
    rows = materialize(df.withColumn("calm_here", F.last(calm, ignorenulls=True).over(running(by_chunk()))), "jumps")
    rows = _with_left_behind(rows, last={"calm_before": calm}, least={"first_frame": F.col("frame")})
    last_calm = F.coalesce("calm_here", "calm_before", F.col("first_frame") - 1)
    rows = _drop_point(rows, F.col("jump") & ((F.col("frame") - last_calm) % 2 == 1), "single_frame_jump")
    return rows.drop("jump", "calm_here", "calm_before", "first_frame", CHUNK)


def _with_left_behind(rows: DataFrame, **what) -> DataFrame:
    """``carry`` for written rows whose windows are done: the summary is written too, so that its size tells whether rows must be dealt again."""
    return lookup(rows, materialize(left_behind(rows, **what), "left"), ["source_id", CHUNK], "left")


def remove_jumps(df: DataFrame, settings: RallySettings = DEFAULTS) -> DataFrame:
    """Remove single-frame jumps: far from both neighbours while the neighbours are close."""
    marked = own_rows(_jump_marked(spread(df, 1, 1), settings.max_single_frame_jump), chunk=True)
    return _drop_alternate_jumps(marked)


def clean_tracks(df: DataFrame, settings: RallySettings = DEFAULTS) -> DataFrame:
    """``remove_isolated`` then ``remove_jumps`` sharing one pass over the rows."""
    reach = settings.isolated_radius + 1
    rows = _isolated(spread(df, reach, reach), settings.isolated_radius)
    return _drop_alternate_jumps(own_rows(_jump_marked(rows, settings.max_single_frame_jump), chunk=True))


# -- interpolation and smoothing --------------------------------------------------------------

def _interpolated(df: DataFrame, max_gap: int) -> DataFrame:
    w = by_chunk()
    point = F.when(F.col("cleaned"), F.struct("frame", "x", "y"))
    rows = df.withColumns({"before": F.last(point, ignorenulls=True).over(running(w)),
                           "after": F.first(point, ignorenulls=True).over(w.rowsBetween(1, max(1, max_gap)))})
    a, b = F.col("before"), F.col("after")
    fill = ~F.col("cleaned") & a.isNotNull() & b.isNotNull() & (b.frame - a.frame - 1 <= max_gap)
    share = (F.col("frame") - a.frame) / (b.frame - a.frame)
    value = lambda axis: F.when(fill, a[axis] + share * (b[axis] - a[axis])).otherwise(F.col(axis))
    return rows.withColumns({"interpolated": F.coalesce(fill, F.lit(False)), "x": value("x"), "y": value("y")}).drop(
        "before", "after")


def interpolate_gaps(df: DataFrame, settings: RallySettings = DEFAULTS) -> DataFrame:
    """Linear fill of gaps of at most ``interpolation_gap`` frames between cleaned points."""
    gap = settings.interpolation_gap
    return own_rows(_interpolated(spread(df, gap + 1, gap + 1), gap))


def present() -> Column:
    return F.col("cleaned") | F.col("interpolated")


def trajectory_spans(df: DataFrame) -> DataFrame:
    """Maximal runs of present points: (source_id, span_start, span_end), inclusive."""
    rows = with_chunk(df.select("source_id", "frame", present().alias("here")))
    absent = F.when(~F.col("here"), F.col("frame"))
    rows = carry(rows, last={"absent_before": absent}, least={"first_frame": F.col("frame")})
    last_absent = F.coalesce(F.last(absent, ignorenulls=True).over(running(by_chunk())),
                             F.col("absent_before"), F.col("first_frame") - 1)
    return (rows.withColumn("span_start", last_absent + 1).filter("here")
                .groupBy("source_id", "span_start").agg(F.max("frame").alias("span_end")))


def smoothing_matrix(window: int, order: int) -> np.ndarray:
    """Rows of the least-squares polynomial fit: row j gives the fitted value at sample j."""
    powers = np.vander(np.arange(window) - window // 2, order + 1, increasing=True).astype(float)
    return powers @ np.linalg.pinv(powers)


def _smoothed(df: DataFrame, window: int, order: int) -> DataFrame:
    """Savitzky-Golay per span with polynomial edges, as a linear combination of lag/lead columns."""
    w, reach = by_chunk(), window - 1
    here, frame = present(), F.col("frame")
    absent = F.when(~here, frame)
    rows = df.withColumns({
        "gap_back": F.last(absent, ignorenulls=True).over(running(w)),
        "edge_back": F.first("frame").over(running(w)),
        "gap_ahead": F.first(absent, ignorenulls=True).over(w.rowsBetween(1, reach)),
        "rows_ahead": F.count(F.lit(1)).over(w.rowsBetween(1, reach)),
        **{f"m{k}_{axis}": F.lag(axis, k).over(w) for k in range(1, reach + 1) for axis in "xy"},
        **{f"p{k}_{axis}": F.lead(axis, k).over(w) for k in range(1, reach + 1) for axis in "xy"}})
    rows = rows.withColumns({
        "a": F.least(F.lit(reach), frame - F.coalesce(F.col("gap_back"), F.col("edge_back") - 1) - 1),
        "b": F.coalesce(F.col("gap_ahead") - frame - 1, F.col("rows_ahead"))})
    # one coefficient row of 2*reach+1 weights per (window size, place in the window)
    weights, cases, offset = [], [], 0
    for n in (n for n in range(window, 2, -2) if n > order + 1):
        half, fit = n // 2, smoothing_matrix(n, order)
        for j in range(n):
            row = [0.0] * (2 * reach + 1)
            row[reach - j:reach - j + n] = fit[j].tolist()
            weights += row
        cases.append(f"WHEN a + b + 1 >= {n} THEN {offset} + CASE WHEN a < {half} THEN a WHEN b < {half} THEN {n - 1} - b ELSE {half} END")
        offset += n
    helpers = [f"{s}{k}_{axis}" for s in "mp" for k in range(1, reach + 1) for axis in "xy"]
    if not cases:
        smoothed = {f"smooth_{axis}": F.when(here, F.col(axis)) for axis in "xy"}
    else:
        rows = rows.withColumn("fit_row", F.expr(f"CASE {' '.join(cases)} END * {2 * reach + 1}"))
        table = "array(" + ", ".join(f"{v!r}D" for v in weights) + ")"
        at = lambda axis, k: (axis if k == 0 else f"{'m' if k < 0 else 'p'}{abs(k)}_{axis}")
        total = lambda axis: " + ".join(
            f"coalesce({table}[cast(fit_row as int) + {k + reach}] * {at(axis, k)}, 0D)" for k in range(-reach, reach + 1))
        smoothed = {f"smooth_{axis}": F.when(here, F.expr(f"CASE WHEN fit_row IS NULL THEN {axis} ELSE {total(axis)} END"))
                    for axis in "xy"}
    return rows.withColumns(smoothed).drop("gap_back", "edge_back", "gap_ahead", "rows_ahead", "a", "b", "fit_row", *helpers)


def smooth_tracks(df: DataFrame, settings: RallySettings = DEFAULTS) -> DataFrame:
    """Add smooth_x, smooth_y; spans shorter than a usable window stay as they are."""
    reach = settings.smoothing_window
    return own_rows(_smoothed(spread(df, reach, reach), settings.smoothing_window, settings.smoothing_polyorder))


# -- streaks and kinematics -------------------------------------------------------------------

def _history(df: DataFrame, flag: str | None, distance: bool) -> DataFrame:
    """Everything that looks back without bound, with one carry: streaks of ``flag`` and total distance. ``df``: rows with their chunk.

    The chunks' own values are written with the rows, which are dealt and sorted by chunk only once.
    """
    w, here, out, drop = running(by_chunk()), {}, {}, [CHUNK]
    last, total, least = {}, {}, {}
    if flag:
        seen, unseen = F.when(F.col(flag), F.col("frame")), F.when(~F.col(flag), F.col("frame"))
        last, least = {"seen_before": seen, "unseen_before": unseen}, {"first_frame": F.col("frame")}
        here |= {f"{n}_here": F.last(c, ignorenulls=True).over(w) for n, c in (("seen", seen), ("unseen", unseen))}
        since = lambda name: F.col("frame") - F.coalesce(f"{name}_here", f"{name}_before", F.col("first_frame") - 1)
        out |= {"visible_streak": since("unseen"), "missing_count": since("seen")}
        drop += ["seen_before", "unseen_before", "first_frame"]
    if distance:
        total = {"so_far": F.col("speed")}
        here |= {"distance_here": F.sum("speed").over(w)}
        out |= {"cumulative_distance": F.col("so_far") + F.col("distance_here")}
        drop += ["so_far"]
    rows = materialize(df.withColumns(here), "history")
    return _with_left_behind(rows, last=last, total=total, least=least).withColumns(out).drop(*drop, *here)


def visibility_streaks(df: DataFrame, flag: str = "cleaned") -> DataFrame:
    """``visible_streak`` and ``missing_count``: consecutive reliable / unreliable rows up to here."""
    return _history(with_chunk(df), flag, False)


def _speeds(df: DataFrame) -> DataFrame:
    w = by_chunk()
    step = F.hypot(F.col("smooth_x") - F.lag("smooth_x").over(w), F.col("smooth_y") - F.lag("smooth_y").over(w))
    return df.withColumn("step", step).withColumn("speed", F.coalesce("step", F.lit(0.0)))


def _accelerations(df: DataFrame) -> DataFrame:
    change = F.col("speed") - F.lag("speed").over(by_chunk())
    return df.withColumn("acceleration", F.when(F.col("step").isNotNull(), change).otherwise(F.lit(0.0))).drop("step")


def kinematics(df: DataFrame) -> DataFrame:
    """speed, acceleration (both reset at span starts) and cumulative_distance over smoothed points."""
    return _history(own_rows(_accelerations(_speeds(spread(df, 2, 0))), chunk=True), None, True)


def recent_motion(df: DataFrame, settings: RallySettings = DEFAULTS) -> DataFrame:
    """Sum of speed over the trailing motion window."""
    n = settings.recent_motion_window - 1
    total = F.sum("speed").over(by_chunk().rowsBetween(-n, 0))
    return own_rows(spread(df, n, 0).withColumn("recent_motion", total))


def preprocess_tracks(df: DataFrame, settings: RallySettings = DEFAULTS) -> DataFrame:
    """Normalised tracks -> cleaned, interpolated, smoothed, with streaks and kinematics.

    Two passes over the rows: the cleaning pass, then one halo wide enough for interpolation, smoothing,
    speed and acceleration together. Each deals and sorts the rows once and writes them with what their chunks tell.
    """
    gap, win = settings.interpolation_gap, settings.smoothing_window
    rows = spread(clean_tracks(df, settings), gap + win + 4, gap + win + 2)
    rows = _smoothed(_interpolated(rows, gap), win, settings.smoothing_polyorder)
    rows = own_rows(_accelerations(_speeds(rows)), chunk=True).withColumn("reliable", F.col("cleaned"))
    return _history(rows, "cleaned", True)


def kinematics7(df: DataFrame, samples: DataFrame) -> DataFrame:
    """[x, y, visible, vx, vy, ax, ay] at the sampled frames of each source.

    ``samples``: (source_id, position, frame), position 0.. in the order to differentiate over.
    Differences are per sampled step and scaled by 100; a sample without a track row is all zero.
    ``df`` carries x, y already scaled and ``visible``.
    """
    points = df.groupBy("source_id", "frame").agg(
        F.min(F.struct("x", "y", "visible")).alias("pt"))
    rows = samples.join(points, ["source_id", "frame"], "left").select(
        "source_id", "position", "frame",
        *[F.coalesce(F.col("pt")[c], F.lit(0)).cast("double").alias(c) for c in ("x", "y", "visible")])
    w = by_chunk(order=["position"])
    rows = spread(rows, 2, 0, frame="position")
    seen = F.col("visible") > 0
    prev_seen = F.coalesce(F.lag("visible").over(w) > 0, F.lit(False))
    rows = rows.withColumn("moving", seen & prev_seen)
    for axis in ("x", "y"):
        delta = (F.col(axis) - F.lag(axis).over(w)) * 100
        rows = rows.withColumn(f"v{axis}", F.when(F.col("moving"), delta).otherwise(F.lit(0.0)))
    both = F.col("moving") & F.coalesce(F.lag("moving").over(w), F.lit(False))
    for axis in ("x", "y"):
        delta = (F.col(f"v{axis}") - F.lag(f"v{axis}").over(w)) * 100
        rows = rows.withColumn(f"a{axis}", F.when(both, delta).otherwise(F.lit(0.0)))
    return own_rows(rows).drop("moving")
