"""Court-plane projection, region signals, calibration fitting and clip-to-source resolution."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.chunks import by_chunk, own_rows, running, spread
from trackloom.functions import geometry as geo
from trackloom.functions.geometry import HALF_LENGTH, HALF_WIDTH, SHORT_SERVICE, H, project
from trackloom.session import lookup
from trackloom.settings import RallySettings


def validate_calibrations(df: DataFrame) -> DataFrame:
    """Add ``error`` (NULL when usable) and scale each matrix so that its last element is 1.

    ``df``: source_id, version, h0..h8, width, height and optionally video_width, video_height.
    """
    broken = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    not_finite = F.lit(False)
    for c in H:
        not_finite = not_finite | broken(c)
    size = F.col("width").isNull() | F.col("height").isNull() | (F.col("width") <= 0) | (F.col("height") <= 0)
    error = (F.when(~F.col("version").eqNullSafe(1), "unsupported_version")
              .when(not_finite, "invalid_matrix")
              .when(F.abs(geo.determinant()) < geo.TINY, "singular_matrix")
              .when(size, "invalid_image_size"))
    if "video_width" in df.columns:
        error = error.when((F.col("width") != F.col("video_width")) | (F.col("height") != F.col("video_height")),
                           "image_size_mismatch")
    scaled = geo.scaled_matrix([F.col(c) for c in H])
    rest = [c for c in df.columns if c not in H]
    return df.withColumn("error", error).select(
        *rest, "error", *[F.when(F.col("error").isNull(), s).otherwise(F.col(c)).alias(c) for c, s in zip(H, scaled)])


def _with_matrix(df: DataFrame, calibrations: DataFrame) -> DataFrame:
    return lookup(df, calibrations.select("source_id", *H), "source_id", "inner")


def project_to_court(df: DataFrame, calibrations: DataFrame, x: str = "image_x", y: str = "image_y") -> DataFrame:
    """Pixels to metres: court_x, court_y, and ``at_infinity`` where no finite image exists."""
    cx, cy = project(F.col(x), F.col(y), H)
    return (_with_matrix(df, calibrations).withColumn("court_x", cx).withColumn("court_y", cy)
            .withColumn("at_infinity", F.col("court_x").isNull()).drop(*H))


def project_to_image(df: DataFrame, calibrations: DataFrame, x: str = "court_x", y: str = "court_y") -> DataFrame:
    """Metres to pixels through the inverse map."""
    px, py = project(F.col(x), F.col(y), geo.inverse_matrix())
    return _with_matrix(df, calibrations).withColumn("image_x", px).withColumn("image_y", py).drop(*H)


def project_normalized(df: DataFrame, calibrations: DataFrame, x: str = "nx", y: str = "ny") -> DataFrame:
    """0..1 image coordinates to metres."""
    cal = calibrations.select("source_id", "width", "height", *H)
    cx, cy = project(F.col(x) * F.col("width"), F.col(y) * F.col("height"), H)
    return (lookup(df, cal, "source_id", "inner").withColumn("court_x", cx).withColumn("court_y", cy)
            .drop("width", "height", *H))


def landmark_positions(calibrations: DataFrame) -> DataFrame:
    """Every court landmark in every source's image."""
    names = ("landmark", "court_x", "court_y")
    rows = calibrations.select("source_id", *H, F.inline(geo.literal_rows(geo.court_landmark_rows(), names)))
    px, py = project(F.col("court_x"), F.col("court_y"), geo.inverse_matrix())
    return rows.select("source_id", *names, px.alias("image_x"), py.alias("image_y"))


def line_positions(calibrations: DataFrame) -> DataFrame:
    """Both image end points of every calibration line."""
    names = ("line", "axis", "court_at")
    rows = calibrations.select("source_id", *H, F.inline(geo.literal_rows(geo.court_line_rows(), names)))
    along_x = F.col("axis") == "x"
    at = F.col("court_at")
    ends = [(F.when(along_x, at).otherwise(-HALF_WIDTH), F.when(along_x, -HALF_LENGTH).otherwise(at)),
            (F.when(along_x, at).otherwise(HALF_WIDTH), F.when(along_x, HALF_LENGTH).otherwise(at))]
    inverse = geo.inverse_matrix()
    points = [project(x, y, inverse) for x, y in ends]
    return rows.select("source_id", *names, points[0][0].alias("x1"), points[0][1].alias("y1"),
                       points[1][0].alias("x2"), points[1][1].alias("y2"))


def segment_positions(calibrations: DataFrame) -> DataFrame:
    """Every painted court marking as an image segment."""
    names = ("cx1", "cy1", "cx2", "cy2")
    rows = calibrations.select("source_id", *H, F.inline(geo.literal_rows(geo.court_segment_rows(), names)))
    inverse = geo.inverse_matrix()
    a, b = project(F.col("cx1"), F.col("cy1"), inverse), project(F.col("cx2"), F.col("cy2"), inverse)
    return rows.select("source_id", *names, a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))


def reprojection_errors(observed: DataFrame, calibrations: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Pixel error of each observed landmark (source_id, landmark, image_x, image_y)."""
    placed = landmark_positions(calibrations).select(
        "source_id", "landmark", F.col("image_x").alias("expected_x"), F.col("image_y").alias("expected_y"))
    error = F.hypot(F.col("expected_x") - F.col("image_x"), F.col("expected_y") - F.col("image_y"))
    return (observed.join(placed, ["source_id", "landmark"]).withColumn("error_px", error)
                    .withColumn("inlier", F.col("error_px") <= threshold))


def reprojection_report(errors: DataFrame) -> DataFrame:
    return errors.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("landmarks"), F.sum(F.col("inlier").cast("long")).alias("inliers"),
        F.avg(F.when(F.col("inlier"), F.col("error_px"))).alias("mean_inlier_error"))


def line_intersections(lines: DataFrame) -> DataFrame:
    """Image and court intersection of each sideline with each cross-court line of a source.

    ``lines``: source_id, line, axis ('x' or 'y'), court_at, x1, y1, x2, y2. At most ten named lines
    per source, so at most 24 pairs.
    """
    length = F.hypot(F.col("y1") - F.col("y2"), F.col("x2") - F.col("x1"))
    unit = lines.select(
        "source_id", "line", "axis", "court_at", ((F.col("y1") - F.col("y2")) / length).alias("a"),
        ((F.col("x2") - F.col("x1")) / length).alias("b"),
        ((F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / length).alias("c"), length.alias("len"))
    pick = lambda axis: F.filter("ls", lambda s: s["axis"] == axis)
    per_source = unit.groupBy("source_id").agg(F.collect_list(F.struct("line", "axis", "court_at", "a", "b", "c", "len")).alias("ls"))
    pairs = (per_source.select("source_id", pick("x").alias("xs"), pick("y").alias("ys"))
             .withColumn("enough", (F.size("xs") >= 2) & (F.size("ys") >= 2))
             .withColumn("u", F.explode("xs")).withColumn("v", F.explode("ys")))
    u, v = F.col("u"), F.col("v")
    w = u.a * v.b - u.b * v.a
    error = (F.when(~F.col("enough"), "too_few_lines")
              .when((u.len < 1e-6) | (v.len < 1e-6) | u.len.isNull() | v.len.isNull(), "degenerate_line")
              .when(F.abs(w) < 1e-9, "parallel_lines"))
    return pairs.select(
        "source_id", F.concat_ws("__", u.line, v.line).alias("intersection"), error.alias("error"),
        F.when(error.isNull(), (u.b * v.c - u.c * v.b) / w).alias("image_x"),
        F.when(error.isNull(), (u.c * v.a - u.a * v.c) / w).alias("image_y"),
        u.court_at.alias("court_x"), v.court_at.alias("court_y"))


# -- calibration fitting ----------------------------------------------------------------------

def _normalizer(points: np.ndarray) -> np.ndarray:
    """Batched similarity transforms: centroid to the origin, mean distance sqrt(2)."""
    centre = points.mean(axis=1, keepdims=True)
    spread_ = np.linalg.norm(points - centre, axis=2).mean(axis=1)
    s = np.sqrt(2.0) / np.where(spread_ < 1e-12, np.nan, spread_)
    t = np.zeros((len(points), 3, 3))
    t[:, 0, 0] = t[:, 1, 1] = s
    t[:, :2, 2] = -s[:, None] * centre[:, 0]
    t[:, 2, 2] = 1.0
    return t


def _apply(matrices: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    homogeneous = np.concatenate([points, np.ones((*points.shape[:-1], 1))], axis=-1)
    out = homogeneous @ np.swapaxes(matrices, -1, -2)
    return out[..., :2] / out[..., 2:], np.abs(out[..., 2]) >= 1e-12


def fit_projective(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Batched direct linear transform, (k, n, 2) -> (k, 3, 3); NaN where degenerate."""
    ts, td = _normalizer(src), _normalizer(dst)
    (p, _), (q, _) = _apply(ts, src), _apply(td, dst)
    k, n, _ = src.shape
    one, zero = np.ones((k, n)), np.zeros((k, n))
    x, y, u, v = p[..., 0], p[..., 1], q[..., 0], q[..., 1]
    rows = np.stack([np.stack([-x, -y, -one, zero, zero, zero, u * x, u * y, u], -1),
                     np.stack([zero, zero, zero, -x, -y, -one, v * x, v * y, v], -1)], 2).reshape(k, 2 * n, 9)
    usable = np.isfinite(rows).all(axis=(1, 2))
    out = np.full((k, 3, 3), np.nan)
    if usable.any():
        h = np.linalg.svd(rows[usable])[2][:, -1].reshape(-1, 3, 3)
        h = np.linalg.inv(td[usable]) @ h @ ts[usable]
        last = h[:, 2, 2]
        norm = np.linalg.norm(h, axis=(1, 2))
        out[usable] = h / np.where(np.abs(last) < 1e-12, norm, last)[:, None, None]
    return out


def consensus_fit(court: np.ndarray, image: np.ndarray, threshold: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Court-to-image map from every four-point sample: most inliers, then least mean error, refitted."""
    if len(image) == 4:
        return fit_projective(court[None], image[None])[0], np.ones(4, bool)
    best, score = None, (3, -np.inf)
    samples = np.array(list(combinations(range(len(image)), 4)))
    for block in np.array_split(samples, max(1, len(samples) // 4096)):
        flat = lambda pts: np.linalg.matrix_rank(pts - pts.mean(axis=1, keepdims=True)) < 2
        ok = ~flat(court[block]) & ~flat(image[block])
        if not ok.any():
            continue
        maps = fit_projective(court[block[ok]], image[block[ok]])
        placed, finite = _apply(maps, np.broadcast_to(court, (len(maps), *court.shape)))
        errors = np.linalg.norm(placed - image, axis=2)
        usable = finite.all(axis=1) & np.isfinite(maps).all(axis=(1, 2))
        inside = (errors <= threshold) & usable[:, None]
        counts = inside.sum(axis=1)
        means = np.where(inside, errors, 0.0).sum(axis=1) / np.maximum(counts, 1)
        i = np.lexsort((means, -counts))[0]
        if (counts[i], -means[i]) > score:
            best, score = inside[i], (counts[i], -means[i])
    if best is None:
        raise ValueError("fewer than four inliers")
    return fit_projective(court[best][None], image[best][None])[0], best


FIT_SCHEMA = ("source_id long, " + ", ".join(f"{c} double" for c in H)
              + ", points long, inliers long, mean_inlier_error double, error string")


def fit_calibrations(points: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Fit one image-to-court matrix per source from named correspondences.

    ``points``: source_id, name, image_x, image_y, court_x, court_y. Names are unique per source and
    there are at most 32 (landmarks) or 24 (line intersections), so every group is small.
    """
    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name")
        image, court = pdf[["image_x", "image_y"]].to_numpy(), pdf[["court_x", "court_y"]].to_numpy()
        row = dict.fromkeys(H) | {"source_id": key[0], "points": len(pdf), "inliers": 0,
                                  "mean_inlier_error": None, "error": None}
        rank = lambda a: np.linalg.matrix_rank(a - a.mean(axis=0))
        if not np.isfinite(image).all():
            row["error"] = "non_finite_point"
        elif len(np.unique(image, axis=0)) < 4 or len(np.unique(court, axis=0)) < 4:
            row["error"] = "fewer_than_four_points"
        elif rank(image) < 2 or rank(court) < 2:
            row["error"] = "collinear_points"
        else:
            try:
                to_image, inside = consensus_fit(court, image, threshold)
                to_court = np.linalg.inv(to_image)
                back = np.linalg.inv(to_court)
                errors = np.linalg.norm(_apply(back, court)[0] - image, axis=1)
                last = to_court[2, 2]
                to_court = to_court / (last if abs(last) >= 1e-12 else np.linalg.norm(to_court))
                row |= dict(zip(H, to_court.ravel())) | {
                    "inliers": int(inside.sum()), "mean_inlier_error": float(errors[inside].mean())}
            except (ValueError, np.linalg.LinAlgError) as problem:
                row["error"] = str(problem)
        return pd.DataFrame([row])

    return points.groupBy("source_id").applyInPandas(fit, FIT_SCHEMA)


# -- clip names -------------------------------------------------------------------------------

def clip_key(name: Column) -> Column:
    """Lower-case file stem without the artifact suffixes."""
    stem = F.regexp_replace(F.lower(F.regexp_extract(name, r"([^/]*)$", 1)), r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(stem, "_pose$", ""), "_features$", "")


def resolve_clip_source(clips: DataFrame, source_ids: DataFrame, overrides: DataFrame) -> DataFrame:
    """Map clip names to sources: explicit override, else the only source id standing alone in the name.

    A source id matches when no letter or digit touches it, so every match is a substring between two
    such boundaries: those substrings (few, names are short) are equi-joined with the ids.
    ``clips``: clip; ``source_ids``: source; ``overrides``: clip, source.
    """
    named = clips.select("clip", clip_key(F.col("clip")).alias("key"))
    word = lambda ch: ch.rlike("[a-z0-9]")
    spots = F.sequence(F.lit(1), F.length("key"))
    starts = F.filter(spots, lambda i: (i == 1) | ~word(F.substr("key", i - 1, F.lit(1))))
    ends = F.filter(spots, lambda i: (i == F.length("key")) | ~word(F.substr("key", i + 1, F.lit(1))))
    parts = (named.filter(F.length("key") > 0).select("key").distinct()
             .withColumn("i", F.explode(starts)).withColumn("j", F.explode(ends)).filter("j >= i")
             .select("key", F.substr("key", F.col("i"), F.col("j") - F.col("i") + 1).alias("source")).distinct())
    ids = source_ids.select(F.lower("source").alias("source")).distinct()
    matches = parts.join(ids, "source").groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("source").alias("found"))
    forced = overrides.select(F.lower("clip").alias("key"), F.lower("source").alias("forced")).dropDuplicates(["key"])
    known = ids.select(F.col("source").alias("forced"), F.lit(True).alias("known"))
    rows = named.join(matches, "key", "left").join(forced.join(known, "forced", "left"), "key", "left")
    is_forced = F.col("forced").isNotNull()
    error = (F.when(is_forced & F.col("known").isNull(), "unknown_override_source")
              .when(~is_forced & F.col("n").isNull(), "no_source")
              .when(~is_forced & (F.col("n") > 1), "ambiguous_source"))
    return rows.select("clip", F.when(error.isNull(), F.coalesce("forced", "found")).alias("source"), error.alias("error"))


# -- signals on tracks ------------------------------------------------------------------------

def court_regions(calibrations: DataFrame, tolerance: float = RallySettings.court_tolerance) -> DataFrame:
    """Image bounding region of each court, grown by ``tolerance``.

    Uses ``image_points`` (array of x,y structs) where given, else the four projected court corners.
    """
    calibrations, inverse = geo.with_inverse(calibrations)
    corners = F.array(*[F.struct(*[c.alias(n) for c, n in zip(project(F.lit(x), F.lit(y), inverse), ("x", "y"))])
                        for x, y in ((-HALF_WIDTH, -HALF_LENGTH), (HALF_WIDTH, -HALF_LENGTH),
                                     (HALF_WIDTH, HALF_LENGTH), (-HALF_WIDTH, HALF_LENGTH))])
    points = F.coalesce(F.col("image_points"), corners) if "image_points" in calibrations.columns else corners
    rows = calibrations.withColumn("pts", points)
    usable = (F.size("pts") >= 4) & ~F.exists("pts", lambda p: p.x.isNull() | p.y.isNull())
    for axis in ("x", "y"):
        values = F.transform("pts", lambda p: p[axis])
        lo, hi = F.array_min(values), F.array_max(values)
        rows = (rows.withColumn(f"{axis}_lo", F.when(usable, lo - (hi - lo) * tolerance))
                    .withColumn(f"{axis}_hi", F.when(usable, hi + (hi - lo) * tolerance)))
    return rows.select("source_id", "x_lo", "x_hi", "y_lo", "y_hi",
                       F.when(~usable, "court_projection_unstable").alias("region_flag"))


def projection_flags(calibrations: DataFrame, player_calibrations: DataFrame | None = None,
                     tolerance: float = RallySettings.court_tolerance) -> DataFrame:
    """(source_id, flags) of the sources whose court, for the shuttle or for the players, cannot be projected."""
    unstable = court_regions(calibrations, tolerance).filter("region_flag IS NOT NULL").select("source_id", F.col("region_flag").alias("flag"))
    if player_calibrations is not None:
        finite = lambda c: F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))  # NaN counts as largest
        broken = ~reduce(lambda a, b: a & b, map(finite, H))
        unstable = unstable.unionByName(player_calibrations.filter(broken).select("source_id", F.lit("player_court_projection_unstable").alias("flag")))
    return unstable.groupBy("source_id").agg(F.array_sort(F.collect_set("flag")).alias("flags"))


def shuttle_inside_region(tracks: DataFrame, calibrations: DataFrame,
                          tolerance: float = RallySettings.court_tolerance) -> DataFrame:
    """Tri-state ``inside_courtish``: set on cleaned frames only."""
    rows = lookup(tracks, court_regions(calibrations, tolerance), "source_id", "left")
    inside = F.col("raw_x").between(F.col("x_lo"), F.col("x_hi")) & F.col("raw_y").between(F.col("y_lo"), F.col("y_hi"))
    return (rows.withColumn("inside_courtish", F.when(F.col("cleaned"), inside))
                .drop("x_lo", "x_hi", "y_lo", "y_hi", "region_flag"))


def players_on_court(players: DataFrame, calibrations: DataFrame,
                     margin: float = RallySettings.court_tolerance) -> DataFrame:
    """Count projected valid feet on court and tell whether both service regions are taken.

    ``players``: source_id, frame, player{1,2}_valid, player{1,2}_foot_x/_foot_y (pixels); a
    player_activity column passes through.
    """
    margin = max(0.0, margin)
    rows = _with_matrix(players, calibrations)
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    on, near, far = [], [], []
    for slot in (1, 2):
        x, y = project(number(f"player{slot}_foot_x"), number(f"player{slot}_foot_y"), H)
        across = F.abs(x) <= HALF_WIDTH + margin
        here = (number(f"player{slot}_valid") > 0) & across & (F.abs(y) <= HALF_LENGTH + margin)
        here = F.coalesce(here, F.lit(False))
        on.append(here)
        is_near = here & (y <= -SHORT_SERVICE + margin)
        near.append(is_near)
        far.append(here & ~is_near & (y >= SHORT_SERVICE - margin))
    return rows.select(
        "source_id", "frame", *[c for c in ("player_activity",) if c in players.columns], (on[0].cast("int") + on[1].cast("int")).alias("player_court_count"),
        (on[0] | on[1]).alias("players_on_courtish"),
        ((near[0] | near[1]) & (far[0] | far[1])).alias("players_opposite_service_regions"))


# -- foot anchors -----------------------------------------------------------------------------

FEET = (((29, 31), 27), ((30, 32), 28))  # (heel, toe) and ankle keypoint ids, left then right


def _weighted_point(ids, threshold: float) -> tuple[Column, Column, Column]:
    """Visibility-weighted mean of the usable keypoints among ``ids``."""
    total, sx, sy = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for i in ids:
        k = F.col("keypoints")[str(i)]
        weight = F.when((k.visibility >= threshold) & k.x.isNotNull() & k.y.isNotNull()
                        & ~F.isnan(k.x) & ~F.isnan(k.y), k.visibility).otherwise(F.lit(0.0))
        weight = F.coalesce(weight, F.lit(0.0))
        total = total + weight
        sx, sy = sx + F.when(weight > 0, weight * k.x).otherwise(0.0), sy + F.when(weight > 0, weight * k.y).otherwise(0.0)
    return total, F.when(total > 0, sx / total), F.when(total > 0, sy / total)


def foot_anchor(poses: DataFrame, calibrations: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mean court position of the visible feet, as fractions of the half court; NULL when none.

    ``poses``: source_id, frame, keypoints map<string, struct<x, y, visibility>> in 0..1 image units.
    """
    cal = calibrations.select("source_id", "width", "height", *H)
    rows = lookup(poses, cal, "source_id", "inner")
    points = []
    for side, (ground, ankle) in enumerate(FEET):
        gw, gx, gy = _weighted_point(ground, threshold)
        _, ax, ay = _weighted_point((ankle,), threshold)
        rows = (rows.withColumn(f"fx{side}", F.when(gw > 0, gx).otherwise(ax))
                    .withColumn(f"fy{side}", F.when(gw > 0, gy).otherwise(ay)))
        points.append(project(F.col(f"fx{side}") * F.col("width"), F.col(f"fy{side}") * F.col("height"), H))
    count = sum((F.col(f"fx{s}").isNotNull().cast("int") for s in (0, 1)), F.lit(0))
    mean = lambda axis, half: F.when(count > 0, sum(
        (F.when(F.col(f"fx{s}").isNotNull(), points[s][axis]).otherwise(F.lit(0.0)) for s in (0, 1)), F.lit(0.0)) / count / half)
    return rows.select("source_id", "frame", mean(0, HALF_WIDTH).alias("anchor_x"), mean(1, HALF_LENGTH).alias("anchor_y"))


def foot_anchor_series(anchors: DataFrame, max_gap: int = 5) -> DataFrame:
    """Fill missing anchors linearly (nearest at the ends) and add ``observed``.

    ``anchors`` has every frame 0..n-1 of each clip. Clips with no anchor or with a gap above
    ``max_gap`` come back with ``rejected`` set and unfilled values.
    """
    w = by_chunk()
    seen = F.col("anchor_x").isNotNull()
    rows = spread(anchors, max_gap + 1, max_gap + 1)
    point = F.when(seen, F.struct("frame", "anchor_x", "anchor_y"))
    missing_run = F.sum((~seen).cast("int")).over(w.rowsBetween(-max_gap, 0))
    rows = (rows.withColumn("pt", point)
                .withColumn("a", F.last("pt", ignorenulls=True).over(running(w)))
                .withColumn("b", F.first("pt", ignorenulls=True).over(w.rowsBetween(0, max_gap + 1)))
                .withColumn("long_gap", missing_run > max_gap))
    rows = own_rows(rows)
    verdict = rows.groupBy("source_id").agg(
        (F.max(F.col("long_gap")) | (F.count("anchor_x") == 0)).alias("rejected"))
    a, b = F.col("a"), F.col("b")
    share = (F.col("frame") - a.frame) / (b.frame - a.frame)
    fill = lambda c: (F.when(seen | F.col("rejected"), F.col(c)).when(a.isNull(), b[c]).when(b.isNull(), a[c])
                       .otherwise(a[c] + share * (b[c] - a[c])))
    return lookup(rows, verdict, "source_id", "inner").select(
        "source_id", "frame", fill("anchor_x").alias("anchor_x"), fill("anchor_y").alias("anchor_y"),
        seen.cast("double").alias("observed"), "rejected")
