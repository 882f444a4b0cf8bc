"""Feature tables, training windows, labels and source-disjoint splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.chunks import by_chunk, carry, own_rows, running, spread, with_chunk
from trackloom.functions.geometry import HALF_LENGTH, HALF_WIDTH, H, project
from trackloom.functions.ranges import points_in_intervals
from trackloom.operators.labels import seeded
from trackloom.session import lookup, materialize

KEYPOINTS = 33
POSE = [f"pose_{i}_{axis}" for i in range(KEYPOINTS) for axis in ("x", "y")]
SHUTTLE = [f"shuttle_{n}" for n in (
    "x", "y", "visible", "peak_value", "confidence_available", "cleaned", "interpolated", "removed", "missing_count",
    "visible_streak", "smooth_x", "smooth_y", "speed", "acceleration", "cumulative_distance", "inside_courtish")]
PLAYERS = ["player_activity", "players_inactive", "activity_window"] + [
    f"player{s}_{n}" for s in (1, 2) for n in ("court_x", "court_y", "observed")]
FRAME_FEATURES = POSE + SHUTTLE + PLAYERS
KINEMATICS = ["x", "y", "visible", "vx", "vy", "ax", "ay"]


# -- poses ------------------------------------------------------------------------------------

def pose_vectors(frames: DataFrame, poses: DataFrame, keypoints: int = KEYPOINTS) -> DataFrame:
    """``pose`` array of 2*keypoints coordinates per requested frame, NULL where no pose was found.

    ``frames``: source_id, position, frame; ``poses``: keypoints map<string, struct<x, y, ...>>.
    """
    at = lambda i, axis: F.coalesce(F.col("keypoints")[str(i)][axis], F.lit(0.0))
    vector = F.array(*[at(i, axis) for i in range(keypoints) for axis in ("x", "y")])
    found = poses.filter(F.size("keypoints") > 0).select("source_id", "frame", vector.alias("pose"))
    return frames.join(found, ["source_id", "frame"], "left")


def _fill_known(rows: DataFrame, column: str) -> DataFrame:
    """``fill_pose_gaps``, but NULL in sources that have no valid row.

    Windows see positions only; of a gap the two rows around it are looked up. Rows that need no other row's array join nothing.
    """
    rows = materialize(rows, "poses")
    rest = [c for c in rows.columns if c != column]
    at = F.when(F.col("here"), F.col("position"))
    marked = with_chunk(rows.select(*rest, F.col(column).isNotNull().alias("here")), "position")
    marked = carry(marked, last={"carried": at}, following={"coming": at}, frame="position")
    down = by_chunk(order=[F.desc("position")]).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumns({"prev": F.coalesce(F.last(at, ignorenulls=True).over(running(by_chunk(order=["position"]))), F.col("carried")),
                                 "next": F.coalesce(F.last(at, ignorenulls=True).over(down), F.col("coming"))})
    # a gap at an end has one neighbour, which then stands for both
    marked = materialize(marked.filter("NOT here").select(*rest, F.coalesce("prev", "next").alias("prev"), F.coalesce("next", "prev").alias("next")), "gaps")
    own = rows.filter(F.col(column).isNotNull())
    known = own.groupBy("source_id", "position").agg(F.first(column).alias("a"))
    gaps = marked.filter("prev IS NOT NULL")
    for end in ("prev", "next"):
        ends = known.select(F.col("source_id").alias("known_id"), F.col("position").alias("known_at"), F.col("a").alias(f"{end}_a"))
        gaps = gaps.join(ends, F.col("source_id").eqNullSafe(F.col("known_id")) & (F.col(end) == F.col("known_at"))).drop("known_id", "known_at")
    mean = F.when(F.col("prev") == F.col("next"), F.col("prev_a")).otherwise(F.zip_with("prev_a", "next_a", lambda a, b: (a + b) / 2))
    nothing = F.lit(None).cast(rows.schema[column].dataType)
    return (own.select(*rest, column).unionByName(gaps.select(*rest, mean.alias(column)))
            .unionByName(marked.filter("prev IS NULL").select(*rest, nothing.alias(column))))


def fill_pose_gaps(rows: DataFrame, width: int, column: str = "pose") -> DataFrame:
    """Missing rows become the mean of the previous and next valid rows, or the only one there is; 0 if none.

    ``rows``: source_id, position, an array column of ``width`` numbers.
    """
    return _fill_known(rows, column).withColumn(column, F.coalesce(column, F.array_repeat(F.lit(0.0), width))).select(*rows.columns)


def pose_features(frames: DataFrame, poses: DataFrame, keypoints: int = KEYPOINTS) -> DataFrame:
    """Filled pose coordinates of the requested frames."""
    return fill_pose_gaps(pose_vectors(frames, poses, keypoints), 2 * keypoints)


def pose_features_legacy(rows: DataFrame, last_position: int, width: int = 2 * KEYPOINTS) -> DataFrame:
    """Clip variant that fills while reading, so the row ahead still counts as zero: the k-th missing row after
    a pose is that pose over 2^k, leading rows are 0, and a missing last row repeats the one before it."""
    mark = F.when(F.col("pose").isNotNull(), F.struct("position", "pose"))
    rows = carry(with_chunk(rows, "position"), last={"carried": mark}, frame="position")
    last = F.coalesce(F.last(mark, ignorenulls=True).over(running(by_chunk(order=["position"]))), F.col("carried"))
    rows = rows.withColumn("src", last)
    gap = F.least(F.col("position"), F.lit(last_position - 1)) - F.col("src.position")
    faded = F.transform(F.col("src.pose"), lambda v: v / F.pow(F.lit(2.0), F.greatest(gap, F.lit(0))))
    return rows.withColumn("pose", F.coalesce(faded, F.array_repeat(F.lit(0.0), width))).drop("carried", "src", "chunk_no")


# -- per-frame features -----------------------------------------------------------------------

def tristate(c: Column) -> Column:
    return F.when(c, 1.0).when(~c, -1.0).otherwise(0.0)


def shuttle_features16(tracks: DataFrame) -> DataFrame:
    """The 16 shuttle columns of a preprocessed track row."""
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    source = {"visible": "visibility"}
    available = F.col("confidence_available").cast("double") if "confidence_available" in tracks.columns else F.lit(1.0)
    columns = {}
    for name in SHUTTLE:
        short = name.removeprefix("shuttle_")
        columns[name] = (available if short == "confidence_available" else
                         tristate(F.col("inside_courtish")) if short == "inside_courtish" and "inside_courtish" in tracks.columns else
                         F.lit(0.0) if short == "inside_courtish" else number(source.get(short, short)))
    return tracks.select("source_id", "frame", *[c.alias(n) for n, c in columns.items()])


def player_features9(players: DataFrame, calibrations: DataFrame | None = None) -> DataFrame:
    """Activity, and each slot's court position over the half court; a failed projection clears observed."""
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in players.columns else F.lit(0.0)
    rows = lookup(players, calibrations.select("source_id", *H), "source_id", "left") if calibrations is not None else players
    out = [number(c).alias(c) for c in PLAYERS[:3]]
    for s in (1, 2):
        seen = number(f"player{s}_valid") > 0
        if calibrations is None:
            x = y = F.lit(0.0)
        else:
            has = F.col("h0").isNotNull()
            cx, cy = project(number(f"player{s}_foot_x"), number(f"player{s}_foot_y"), H)
            x, y = (F.when(seen, F.coalesce(c / half, F.lit(0.0))).otherwise(0.0) for c, half in ((cx, HALF_WIDTH), (cy, HALF_LENGTH)))
            seen = seen & (~has | cx.isNotNull())
        out += [x.alias(f"player{s}_court_x"), y.alias(f"player{s}_court_y"), seen.cast("double").alias(f"player{s}_observed")]
    return rows.select("source_id", "frame", *out)


def _named(column: str, names: Sequence[str]) -> list[Column]:
    return [F.col(column)[i].alias(n) for i, n in enumerate(names)]


def feature_frame91(frames: DataFrame, poses: DataFrame, tracks: DataFrame, players: DataFrame, calibrations: DataFrame | None = None) -> DataFrame:
    """All 91 per-frame features in their fixed order; missing tracks and players are zero."""
    rows = _fill_known(pose_vectors(frames, poses), "pose")
    rows = rows.join(shuttle_features16(tracks), ["source_id", "frame"], "left").join(player_features9(players, calibrations), ["source_id", "frame"], "left")
    return rows.select("source_id", "position", "frame", *[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in zip(_named("pose", POSE), POSE)],
                       *[F.coalesce(c, F.lit(0.0)).alias(c) for c in SHUTTLE + PLAYERS])


def clip_features76(pose_rows: DataFrame, kinematics: DataFrame, anchors: DataFrame) -> DataFrame:
    """Clip features: 66 pose, 7 kinematic and 3 foot-anchor columns; clips without usable anchors drop out."""
    usable = anchors.filter("NOT rejected").select("source_id", F.col("frame").alias("position"), "anchor_x", "anchor_y", "observed")
    kin = kinematics.select("source_id", "position", *KINEMATICS)
    rows = pose_rows.join(kin, ["source_id", "position"]).join(usable, ["source_id", "position"])
    return rows.select("source_id", "position", *_named("pose", POSE), *KINEMATICS, "anchor_x", "anchor_y", "observed")


def combined_features(pose_rows: DataFrame, kinematics: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """66 pose and 7 kinematic columns, with the first label of each labelled frame when given.

    ``labels``: source_id, frame, label, seq (file order).
    """
    rows = pose_rows.join(kinematics.select("source_id", "position", *KINEMATICS), ["source_id", "position"])
    out = rows.select("source_id", "position", "frame", *_named("pose", POSE), *KINEMATICS)
    if labels is None:
        return out
    first = labels.groupBy("source_id", "frame").agg(F.min_by("label", "seq").alias("label"))
    return out.join(first, ["source_id", "frame"])


# -- labels and windows -----------------------------------------------------------------------

def interval_labels(frames: DataFrame, intervals: DataFrame) -> DataFrame:
    """1 for frames inside any interval, else 0."""
    inside = points_in_intervals(frames.select("source_id", "frame"), intervals.select("source_id", "start_frame", "end_frame")).select("source_id", "frame").distinct()
    return frames.join(inside.withColumn("label", F.lit(1)), ["source_id", "frame"], "left").na.fill(0, ["label"])


def build_sequences(rows: DataFrame, length: int, columns: Sequence[str] = ("features", "label")) -> DataFrame:
    """Every stride-1 window of ``length`` rows, with its first and last frame; arrays are in frame order."""
    if length <= 0:
        raise ValueError("length must be positive")
    w = by_chunk(order=["position"])
    ahead = w.rowsBetween(0, length - 1)
    lists = {f"{c}_seq": F.collect_list(c).over(ahead) for c in columns}
    rows = spread(rows, 0, length, frame="position").withColumns(
        {**lists, "rows_in": F.count(F.lit(1)).over(ahead), "end_frame": F.last("frame").over(ahead)})
    return own_rows(rows).filter(F.col("rows_in") == length).select(
        "source_id", "position", F.col("frame").alias("start_frame"), "end_frame", *lists)


def edge_label_smoothing(labels: str, length: int, edge_width: int = 2, smoothing: float = 0.1) -> Column:
    """Pull labels near both window ends towards 0.5 where they differ from their inner neighbour.

    The rule walks inwards and alters a label before its outer neighbour is compared with nothing else, so
    each comparison sees the inner neighbour unaltered while the window is at least twice the edge width.
    """
    if length < 2 * edge_width + 1:
        raise ValueError("window too short for the edge width")
    soft = lambda v: v * (1 - smoothing) + 0.5 * smoothing
    inner = lambda i: F.when(i < edge_width, i + 1).when(i >= length - edge_width, i - 1)
    return F.transform(F.col(labels), lambda v, i: F.coalesce(F.when(F.get(F.col(labels), inner(i).cast("int")) != v, soft(v)), v))


def average_overlaps(windows: DataFrame, threshold: float = 0.31) -> DataFrame:
    """Mean of all window predictions covering a position, and whether it exceeds the threshold.

    ``windows``: source_id, position (of the first row), probabilities array.
    """
    rows = windows.select("source_id", F.col("position").alias("first"), F.posexplode("probabilities").alias("t", "p"))
    rows = rows.groupBy("source_id", (F.col("first") + F.col("t")).alias("position")).agg(F.avg("p").alias("probability"))
    return rows.withColumn("pred", F.when(F.col("probability") > threshold, 1).otherwise(0))


# -- splits -----------------------------------------------------------------------------------

def group_split(rows: DataFrame, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Assign whole sources to validation, in seeded order, until they hold the wanted share of rows.

    At least one source stays in training. Only one row per source takes part in the ordering.
    """
    if not 0 < fraction < 1:
        raise ValueError("fraction must be between 0 and 1")
    counts = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).withColumn("draw", seeded(seed, "source_id"))
    checked = F.when(F.col("source_id").isNull() | (F.col("source_id").cast("string") == ""), F.raise_error(F.lit("row without source_id")).cast("long")).otherwise(F.col("n"))
    counts = counts.withColumn("n", checked)
    counts = materialize(counts.withColumn("bucket", _draw_bucket()), "draws")
    # sums of one row per bucket of draws meet in a window of at most 4096 rows; inside, one bucket at a time is ordered
    sums = counts.groupBy("bucket").agg(F.sum("n").alias("b_n"), F.count(F.lit(1)).alias("b_rows"))
    earlier, whole = Window.partitionBy().orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = sums.select("bucket", F.coalesce(F.sum("b_n").over(earlier), F.lit(0)).alias("n_before"), F.coalesce(F.sum("b_rows").over(earlier), F.lit(0)).alias("rows_before"),
                       F.sum("b_n").over(whole).alias("n_all"), F.sum("b_rows").over(whole).alias("groups"))
    inside = Window.partitionBy("bucket").orderBy("draw")
    rows = lookup(counts, sums, "bucket", "inner")
    before = F.col("n_before") + F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    target = F.greatest(F.lit(1), F.bround(F.col("n_all") * fraction, 0).cast("long"))
    place = F.col("rows_before") + F.row_number().over(inside)
    split = F.when((before < target) & (place < F.col("groups")), "validation").otherwise("train")
    return rows.select("source_id", "n", split.alias("split"))


def _draw_bucket():
    """The first three of a draw's hex digits: buckets of even size in the order of the draws."""
    return F.conv(F.substring("draw", 1, 3), 16, 10).cast("int")


def group_split_by_count(groups: DataFrame, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Validation takes the given share of the groups (rounded up), in seeded order."""
    ids = groups.select("source_id").distinct().withColumn("draw", seeded(seed, "source_id"))
    ids = materialize(ids.withColumn("bucket", _draw_bucket()), "draws")
    sums = ids.groupBy("bucket").agg(F.count(F.lit(1)).alias("b_rows"))
    sums = sums.select("bucket", F.sum("b_rows").over(Window.partitionBy()).alias("total"), F.coalesce(F.sum("b_rows").over(
        Window.partitionBy().orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rows_before"))
    place = F.col("rows_before") + F.row_number().over(Window.partitionBy("bucket").orderBy("draw"))
    return lookup(ids, sums, "bucket", "inner").select(
        "source_id", F.when(place <= F.ceil(F.col("total") * fraction - 1e-9), "validation").otherwise("train").alias("split"))


def split_leakage(rows: DataFrame) -> DataFrame:
    """Sources found on both sides of a split; must be empty. ``rows``: source_id, split."""
    side = lambda s: rows.filter(F.col("split") == s).select("source_id")
    return side("train").intersect(side("validation"))


def clip_label(clips: DataFrame) -> DataFrame:
    """Class name (text before the first underscore) and its index in sorted class order."""
    rows = clips.withColumn("label", F.substring_index("clip", "_", 1))
    names = rows.select("label").distinct()
    names = names.withColumn("label_index", F.row_number().over(Window.partitionBy().orderBy("label")).cast("long") - 1)  # one row per class
    return lookup(rows, names, "label", "inner")
