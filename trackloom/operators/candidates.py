"""Point detections: components of activation maps, ranking, linking and association.

Candidates: source_id, frame, cand (position within the frame), candidate_id, cx, cy, peak.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.chunks import chunk_of, numbered
from trackloom.components import grouped_components
from trackloom.folds import fold, whole_blocks
from trackloom.session import lookup, materialize
from trackloom.settings import AssociationSettings, LinkSettings

THRESHOLDS = (0.2, 0.3, 0.4, 0.5)
RETENTION = (1, 2, 3, 5, 8, 12)

# -- activation maps --------------------------------------------------------------------------


def _component_labels(cells: np.ndarray) -> np.ndarray:
    """Smallest cell index of each 8-connected component; ``cells`` holds sorted unique (frame, y, x)."""
    frame, y, x = cells.T
    width, height = int(x.max()) + 2, int(y.max()) + 2
    code = (frame * height + y) * width + x
    labels = np.arange(len(code))
    links = []
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        at = np.searchsorted(code, code + dy * width + dx)
        at_ok = np.minimum(at, len(code) - 1)
        hit = (code[at_ok] == code + dy * width + dx) & (y + dy == y[at_ok]) & (x + dx == x[at_ok]) & (frame == frame[at_ok])
        links.append(np.stack([np.flatnonzero(hit), at_ok[hit]]))
    a, b = np.concatenate(links, axis=1)
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def extract_components(activations: DataFrame, image_width: float, image_height: float, map_width: int, map_height: int,
                       thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Connected components of sparse activation maps (source_id, frame, x, y, value) at each threshold.

    Only the labelling runs in Python, for the maps of one Arrow batch at a time; statistics are aggregates.
    """
    table = F.array(*[F.struct(F.lit(t).alias("threshold")) for t in thresholds])
    kind, place = dict(activations.dtypes)["source_id"], ["source_id", "frame", "threshold"]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, bounds in whole_blocks(batches, place):
            number = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))  # of the map within the block
            labels = _component_labels(np.stack([number, block["y"].to_numpy(), block["x"].to_numpy()], axis=1))
            yield from block.append_column("component", pa.array(labels, pa.int64())).to_batches()

    # maps are dealt out whole and sorted; all maps of a batch are labelled at once
    casted = activations.select("source_id", F.col("frame").cast("long").alias("frame"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"),
                                F.col("value").cast("double").alias("value")).repartition("source_id", "frame")
    cells = casted.select("*", F.inline(table)).filter(F.col("value") > F.col("threshold")).sortWithinPartitions(*place, "y", "x")
    labelled = cells.mapInArrow(label, f"source_id {kind}, frame long, x long, y long, value double, threshold double, component long")
    weight = lambda c: F.sum((F.col(c) + 0.5) * F.col("value")) / F.sum("value")
    first_peak = F.max_by(F.struct("x", "y"), F.struct("value", -F.col("y"), -F.col("x")))
    stats = labelled.groupBy("source_id", "frame", "threshold", "component").agg(
        F.min("x").alias("bx"), F.min("y").alias("by"), (F.max("x") - F.min("x") + 1).alias("bw"), (F.max("y") - F.min("y") + 1).alias("bh"),
        F.count(F.lit(1)).alias("area"), F.max("value").alias("peak"), F.avg("value").alias("mean"), F.sum("value").alias("total"),
        weight("x").alias("wx"), weight("y").alias("wy"), first_peak.alias("top"))
    order = Window.partitionBy("source_id", "frame", "threshold").orderBy("by", "bx", "bh", "bw", F.desc("area"), F.desc("peak"), "component")
    sx, sy = F.lit(image_width / map_width), F.lit(image_height / map_height)
    rows = stats.withColumn("component_index", (F.row_number().over(order) - 1).cast("long"))
    candidate_id = F.format_string("f%06d-t%03d-c%03d", "frame", F.round(F.col("threshold") * 100).cast("int"), "component_index")
    rows = rows.select(
        "source_id", "frame", "threshold", "component_index", candidate_id.alias("candidate_id"), "area", "peak", "mean", "total",
        (F.col("area") / float(map_width * map_height)).alias("area_normalized"),
        ((F.col("bx") + F.col("bw") / 2) * sx).alias("cx"), ((F.col("by") + F.col("bh") / 2) * sy).alias("cy"),
        ((F.col("top.x") + 0.5) * sx).alias("peak_x"), ((F.col("top.y") + 0.5) * sy).alias("peak_y"),
        (F.col("wx") * sx).alias("weighted_x"), (F.col("wy") * sy).alias("weighted_y"),
        (F.col("bx") * sx).alias("x1"), (F.col("by") * sy).alias("y1"), ((F.col("bx") + F.col("bw")) * sx).alias("x2"), ((F.col("by") + F.col("bh")) * sy).alias("y2"))
    return mark_legacy_component(rows)


def mark_legacy_component(components: DataFrame) -> DataFrame:
    """Flag the component of largest box area at threshold 0.5; equal areas go to the lowest index."""
    at_half = F.col("threshold") == 0.5
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    w = Window.partitionBy("source_id", "frame", "threshold").orderBy(F.desc(F.round(area, 6)), "component_index")
    return components.withColumn("legacy_largest", at_half & (F.row_number().over(w) == 1))


# -- ranking ----------------------------------------------------------------------------------

def rank_candidates(candidates: DataFrame, k: int | None = None) -> DataFrame:
    """``rank`` per frame by peak, mean (falls back to peak), area, then id; optionally only the top k."""
    if k is not None and k < 0:
        raise ValueError("k must not be negative")
    has = lambda *names: F.coalesce(*[F.col(n) for n in names if n in candidates.columns], F.lit(0.0))
    order = [F.desc(has("peak_activation", "peak")), F.desc(has("mean_activation", "mean", "peak_activation", "peak")),
             F.desc(has("area_normalized", "area")), F.asc("candidate_id")]
    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("source_id", "frame").orderBy(*order)).cast("long"))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def recall_violations(labels: DataFrame, candidates: DataFrame, frames: DataFrame) -> DataFrame:
    """Labels that make recall undefined: repeated frames, unknown kinds, frames or candidates."""
    chosen = F.lower("label_kind").isin("selected", "candidate")
    repeated = labels.groupBy("source_id", "frame").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("source_id", "frame", F.lit("repeated_frame").alias("problem"))
    kinds = labels.filter(~F.lower("label_kind").isin("selected", "candidate", "missing_proposal", "missing", "no_shuttle", "unsure"))
    picked = labels.filter(chosen)
    known = picked.join(frames.select("source_id", "frame").distinct(), ["source_id", "frame"], "left_semi")
    tag = lambda df, p: df.select("source_id", "frame", F.lit(p).alias("problem"))
    return (repeated.unionByName(tag(kinds, "unsupported_kind"))
            .unionByName(tag(picked.join(frames.select("source_id", "frame").distinct(), ["source_id", "frame"], "left_anti"), "unknown_frame"))
            .unionByName(tag(known.join(candidates.select("source_id", "frame", "candidate_id"), ["source_id", "frame", "candidate_id"], "left_anti"), "unknown_candidate")))


def recall_at_k(labels: DataFrame, candidates: DataFrame, ks: tuple[int, ...] = RETENTION) -> DataFrame:
    """Share of frames with the object present whose labelled candidate ranks within each K and within all.

    ``missing_proposal`` counts as present and never hit; ``no_shuttle`` and ``unsure`` do not count.
    """
    ranks = rank_candidates(candidates).select("source_id", "frame", "candidate_id", "rank")
    kind = F.lower("label_kind")
    present = labels.filter(kind.isin("selected", "candidate", "missing_proposal", "missing"))
    ranked = present.filter(kind.isin("selected", "candidate")).join(ranks, ["source_id", "frame", "candidate_id"])
    top = max(ks)
    histogram = ranked.groupBy(F.least("rank", F.lit(top + 1)).alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    table = F.array(*[F.struct(F.lit(str(k)).alias("k"), F.lit(k).alias("limit")) for k in ks], F.struct(F.lit("all").alias("k"), F.lit(top + 1).alias("limit")))
    # at most top+1 histogram rows from here on
    hits = histogram.select("rank", "n", F.inline(table)).groupBy("k").agg(F.sum(F.when(F.col("rank") <= F.col("limit"), F.col("n")).otherwise(0)).alias("hits"))
    total = present.agg(F.count(F.lit(1)).alias("present"))
    grid = labels.sparkSession.range(1).select(F.inline(table)).select("k")
    return (grid.join(hits, "k", "left").join(total)
                .select("k", F.coalesce("hits", F.lit(0)).alias("hits"), "present",
                        F.when(F.col("present") > 0, F.coalesce("hits", F.lit(0)) / F.col("present")).alias("recall")))


def candidate_load(frames: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates per frame (empty frames included): mean and maximum."""
    counts = candidates.groupBy("source_id", "frame").agg(F.count(F.lit(1)).alias("n"))
    return frames.select("source_id", "frame").join(counts, ["source_id", "frame"], "left").agg(
        F.avg(F.coalesce("n", F.lit(0))).alias("candidates_per_frame"), F.max(F.coalesce("n", F.lit(0))).alias("maximum_candidates_per_frame"))


# -- linking ----------------------------------------------------------------------------------

DENSE = 1 << 10  # pairs of one frame that are compared without a grid


def near_pairs(at: np.ndarray, here: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prediction, candidate, distance) of the pairs no farther apart than the prediction's radius.

    Many points are looked up by the cells of a grid as wide as the largest radius: the candidates lie sorted by cell, and the
    three cells above each other in one column are one run of that order. Few points are compared at once; the pairs are the same.
    """
    if len(at) * len(here) <= DENSE:
        track, cand = np.repeat(np.arange(len(at)), len(here)), np.tile(np.arange(len(here)), len(at))
    else:
        usable, there = np.flatnonzero(np.isfinite(at).all(axis=1)), np.flatnonzero(np.isfinite(here).all(axis=1))
        if not len(usable) or not len(there):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        width = max(float(radius[usable].max()), 1e-9)
        low = here[there].min(axis=0)
        cell = np.floor((here[there] - low) / width).astype(np.int64) + 1
        rows = int(cell[:, 1].max()) + 2
        key = cell[:, 0] * rows + cell[:, 1]
        order = np.argsort(key, kind="stable")
        key, there = key[order], there[order]
        # predictions outside the candidates' box by more than a cell have no partner; clip them to the rim of empty cells
        spot = np.clip(np.floor((at[usable] - low) / width), -1, [int(cell[:, 0].max()) + 1, rows]).astype(np.int64) + 1
        first, last = [], []
        for column in (spot[:, 0] - 1, spot[:, 0], spot[:, 0] + 1):
            first.append(np.searchsorted(key, column * rows + np.maximum(spot[:, 1] - 1, 1), "left"))
            last.append(np.searchsorted(key, column * rows + np.minimum(spot[:, 1] + 1, rows - 2), "right"))
        first, last = np.concatenate(first), np.concatenate(last)
        count = np.maximum(last - first, 0)
        track = np.repeat(np.tile(usable, 3), count)
        cand = there[np.arange(len(track)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)]
    distance = np.hypot(here[cand, 0] - at[track, 0], here[cand, 1] - at[track, 1])
    near = distance <= radius[track]
    return track[near], cand[near], distance[near]


def clear_winners(owner: np.ndarray, distance: np.ndarray, ratio: float) -> np.ndarray:
    """Marks the pairs that are their owner's least by far: below the second least, and at most ``ratio`` times it."""
    order = np.lexsort((distance, owner))
    own, d = owner[order], distance[order]
    first = np.ones(len(own), bool)
    first[1:] = own[1:] != own[:-1]
    second = np.full(len(own), np.inf)
    second[:-1][own[1:] == own[:-1]] = d[1:][own[1:] == own[:-1]]
    out = np.zeros(len(own), bool)
    out[order] = first & (d < second) & (d <= ratio * second)
    return out


FEW = 1 << 7  # pairs of one frame that are compared one by one


def sure_links(at: list, xs: list, ys: list, radius: list, ratio: float) -> tuple[list[bool], list[tuple[int, int]]]:
    """(whether a prediction has a candidate within its radius, (prediction, candidate) pairs that are clearly the nearest of both).

    A frame of few pairs would pay more for arrays than for the pairs; its distances are the same (the C library's hypot).
    """
    if len(at) * len(xs) <= FEW:
        try:
            return _few_links(at, xs, ys, radius, ratio)
        except OverflowError:
            pass
    track, cand, distance = near_pairs(np.array(at, float).reshape(-1, 2), np.column_stack([xs, ys]), np.array(radius, float))
    gated = np.zeros(len(at), bool)
    gated[track] = True
    sure = clear_winners(track, distance, ratio) & clear_winners(cand, distance, ratio)
    return gated.tolist(), list(zip(track[sure].tolist(), cand[sure].tolist()))


def _few_links(at: list, xs: list, ys: list, radius: list, ratio: float) -> tuple[list[bool], list[tuple[int, int]]]:
    inf = math.inf
    nearest, best, second = [-1] * len(xs), [inf] * len(xs), [inf] * len(xs)  # of each candidate
    gated, claims = [], []
    for track, ((x, y), reach) in enumerate(zip(at, radius)):
        mine, least, next_least = -1, inf, inf
        for cand, u in enumerate(xs):
            d = abs(complex(u - x, ys[cand] - y))
            if d <= reach:
                if mine < 0 or d < least:
                    mine, least, next_least = cand, d, least
                elif d < next_least:
                    next_least = d
                if nearest[cand] < 0 or d < best[cand]:
                    nearest[cand], best[cand], second[cand] = track, d, best[cand]
                elif d < second[cand]:
                    second[cand] = d
        gated.append(mine >= 0)
        if mine >= 0 and least < next_least and least <= ratio * next_least:
            claims.append((track, mine))
    return gated, [(t, c) for t, c in claims if nearest[c] == t and best[c] < second[c] and best[c] <= ratio * second[c]]


def link_machine(gate: float, settings: LinkSettings):
    """State: active tracklets as [start frame, start position, [frame, x, y] points (last two)].

    Per frame the pairs of predictions and candidates within the gate. A pair is linked when it is the nearest of both its
    prediction and its candidate, and clearly nearer than the second nearest of either.
    """
    ratio, reach = settings.ambiguity_ratio, settings.max_missing_frames + 1

    def machine(pdf: pd.DataFrame, entry: str) -> tuple[dict, str]:
        # start frame, start candidate, frame, x, y, then frame, x, y of the point before (None without)
        tracks = [(a, b, *p[-1], *(p[-2] if len(p) > 1 else (None, None, None))) for a, b, p in json.loads(entry)]
        frames, cands = pdf["frame"].to_numpy(np.int64).tolist(), pdf["cand"].to_numpy(np.int64).tolist()
        xs, ys = pdf["cx"].to_numpy(float).tolist(), pdf["cy"].to_numpy(float).tolist()
        owners: list[tuple] = []  # start frame and candidate of the tracklet, then the point before
        a = 0
        while a < len(frames):
            frame, b = frames[a], a + 1
            while b < len(frames) and frames[b] == frame:
                b += 1
            tracks = [t for t in tracks if frame - t[2] <= reach]
            at = [(x, y) if before is None else (x + (x - u) * (frame - last) / (last - before), y + (y - v) * (frame - last) / (last - before))
                  for _, _, last, x, y, before, u, v in tracks]
            gated, sure = sure_links(at, xs[a:b], ys[a:b], [gate * (frame - t[2]) for t in tracks], ratio)
            fresh = [(frame, cands[i], frame, xs[i], ys[i], None, None, None) for i in range(a, b)]
            for track, cand in sure:
                t = tracks[track]
                fresh[cand] = (*t[:2], *fresh[cand][2:5], *t[2:5])
            owners += [(t[0], t[1], *t[5:]) for t in fresh]
            tracks = [t for t, taken in zip(tracks, gated) if not taken] + fresh
            a = b
        # a tracklet out of reach of the next frame can never continue: forget it
        if frames:
            tracks = [t for t in tracks if frames[-1] + 1 - t[2] <= reach]
        out = {"frame": frames, "cand": cands, **{c: [o[i] for o in owners] for i, c in enumerate(("track_frame", "track_cand", "prev_frame", "prev_x", "prev_y"))}}
        # the order of tracklets does not matter to later frames; a fixed one makes equal states equal texts
        tracks.sort(key=lambda t: t[:2])
        return out, json.dumps([[*t[:2], [*([t[5:]] if t[5] is not None else []), t[2:5]]] for t in tracks])
    return machine


def link_candidates(candidates: DataFrame, fps: float, width: float, height: float, settings: LinkSettings = LinkSettings()) -> DataFrame:
    """Conservative frame-to-frame linking; every candidate row gets its tracklet and its predecessor.

    Components of nested thresholds (a column ``threshold``) are near-copies of each other, so only those of
    ``settings.candidate_threshold`` are linked; None links all. The state carried between frames is only what two frames back can still reach, so chunks of one
    source are linked in parallel.
    """
    gate = settings.max_speed_diagonals_per_second * math.hypot(width, height) / fps
    if settings.candidate_threshold is not None and "threshold" in candidates.columns:
        candidates = candidates.filter(F.abs(F.col("threshold") - settings.candidate_threshold) <= 1e-9)
    rows, _ = fold(candidates.select("source_id", "frame", "cand", "cx", "cy"), link_machine(gate, settings), "[]",
                   "frame long, cand long, track_frame long, track_cand long, prev_frame long, prev_x double, prev_y double",
                   warmup=60, within=["cand"])
    rows = materialize(rows, "links")
    # ids count tracklets in order of start frame, then candidate position
    starts = rows.filter("frame = track_frame AND cand = track_cand").select("source_id", "track_frame", "track_cand")
    ids = numbered(starts, ["source_id"], chunk_of("track_frame", 1 << 16), ["track_frame", "track_cand"], "n")
    ids = ids.withColumn("tracklet_id", F.format_string("t%06d", F.col("n") - 1)).drop("n")
    linked = rows.join(ids, ["source_id", "track_frame", "track_cand"])
    return candidates.join(linked.drop("track_frame", "track_cand"), ["source_id", "frame", "cand"])


def tracklet_summaries(linked: DataFrame) -> DataFrame:
    """One row per tracklet: extent, head and tail points, tail velocity, mean peak."""
    tail = F.max_by(F.struct("cx", "cy", "prev_frame", "prev_x", "prev_y"), "frame")
    rows = linked.groupBy("source_id", "tracklet_id").agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("points"),
        F.avg("peak").alias("confidence"), F.min_by(F.struct("cx", "cy"), "frame").alias("head"), tail.alias("tail"))
    t = F.col("tail")
    speed = lambda c, p: F.when(t["prev_frame"].isNotNull(), (t[c] - t[p]) / (F.col("last_frame") - t["prev_frame"])).otherwise(0.0)
    return rows.select("source_id", "tracklet_id", "first_frame", "last_frame", "points", "confidence",
                       F.col("head.cx").cast("double").alias("head_x"), F.col("head.cy").cast("double").alias("head_y"),
                       t["cx"].cast("double").alias("tail_x"), t["cy"].cast("double").alias("tail_y"),
                       speed("cx", "prev_x").alias("vx"), speed("cy", "prev_y").alias("vy"))


def validate_tracklets(tracklets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Problems of stored tracklets (source_id, tracklet_id, candidate_ids array, frames array)."""
    ids, frames = F.col("candidate_ids"), F.col("frames")
    name = lambda c, n: F.when(c, F.lit(n))
    shape = tracklets.select("source_id", "tracklet_id", F.explode(F.array_compact(F.array(
        name(F.size(ids) == 0, "empty"), name(F.size(ids) != F.size(frames), "length_mismatch"),
        name(frames != F.array_sort(frames), "unsorted_frames"), name(F.size(F.array_distinct(frames)) != F.size(frames), "repeated_frames")))).alias("problem"))
    copies = tracklets.groupBy("source_id", "tracklet_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("source_id", "tracklet_id", F.lit("duplicate_id").alias("problem"))
    members = tracklets.filter(F.size(ids) == F.size(frames)).select("source_id", "tracklet_id", F.inline(F.arrays_zip("candidate_ids", "frames")))
    known = candidates.select("source_id", F.col("candidate_id").alias("candidate_ids"), F.col("frame").alias("c_frame"))
    lost = members.join(known, ["source_id", "candidate_ids"], "left").filter(~F.col("c_frame").eqNullSafe(F.col("frames")))
    return shape.unionByName(copies).unionByName(lost.select("source_id", "tracklet_id", F.lit("unresolved_candidate").alias("problem")).distinct())


def candidate_tracklets(candidates: DataFrame, tracklets: DataFrame) -> DataFrame:
    """Candidates with the id of the tracklet that lists them, NULL when none does."""
    members = tracklets.select("source_id", "tracklet_id", F.explode("candidate_ids").alias("candidate_id"))
    return candidates.join(members, ["source_id", "candidate_id"], "left")


# -- association ------------------------------------------------------------------------------

def tracklet_edges(tracklets: DataFrame, fps: float, width: float, height: float, settings: AssociationSettings = AssociationSettings()) -> DataFrame:
    """Legal links between tracklets: short gap and a head near the tail's extrapolation.

    Tails look into the one or two frame bins their reach covers, so the join is an equi-join on
    (source, bin).
    """
    if settings.max_gap_seconds < 0 or settings.max_speed_diagonals_per_second <= 0:
        raise ValueError("gap and speed limits must be positive")
    reach = math.floor(settings.max_gap_seconds * fps + 1e-9) + 1
    gate_per_frame = settings.max_speed_diagonals_per_second * math.hypot(width, height) / fps
    bins = max(32, reach)
    tails = tracklets.select("source_id", F.col("tracklet_id").alias("tail_id"), "last_frame", "tail_x", "tail_y", "vx", "vy",
                             F.explode(F.sequence(chunk_of(F.col("last_frame") + 1, bins), chunk_of(F.col("last_frame") + reach, bins))).alias("bin"))
    heads = tracklets.select("source_id", F.col("tracklet_id").alias("head_id"), "first_frame", "head_x", "head_y", chunk_of("first_frame", bins).alias("bin"))
    span = F.col("first_frame") - F.col("last_frame")
    gap = (span - 1) / F.lit(float(fps))
    rows = tails.join(heads, ["source_id", "bin"]).filter((span > 0) & (gap <= settings.max_gap_seconds))
    distance = F.hypot(F.col("tail_x") + F.col("vx") * span - F.col("head_x"), F.col("tail_y") + F.col("vy") * span - F.col("head_y"))
    gate = F.lit(gate_per_frame) * span
    rows = rows.withColumns({"distance": distance, "gate": gate}).filter("distance <= gate")
    penalty = gap / settings.max_gap_seconds if settings.max_gap_seconds else F.lit(0.0)
    motion = F.greatest(F.lit(0.0), 1.0 - F.col("distance") / F.col("gate"))
    return rows.select("source_id", "tail_id", "head_id", motion.alias("motion"), penalty.alias("gap_penalty"), (motion * (1.0 - penalty)).alias("edge_score"))


def association_regions(tracklets: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components of the edge graph, numbered per source by their earliest tracklet."""
    node = lambda c: F.concat_ws("|", F.col("source_id").cast("string"), F.col(c))
    groups = grouped_components(edges.select(F.col("source_id").alias("group_id"), node("tail_id").alias("a"), node("head_id").alias("b")))
    rows = tracklets.select("source_id", "tracklet_id", "first_frame", "last_frame", node("tracklet_id").alias("node"))
    rows = rows.join(groups.withColumnRenamed("group_id", "source_id"), ["source_id", "node"], "left").withColumn("component", F.coalesce("component", "node"))
    first = rows.groupBy("source_id", "component").agg(F.min(F.struct("first_frame", "last_frame", "tracklet_id")).alias("lead"))
    first = numbered(first.select("source_id", "component", "lead.*"), ["source_id"], chunk_of("first_frame", 1 << 16), ["first_frame", "last_frame", "tracklet_id"], "n")
    ids = first.select("source_id", "component", F.format_string("r%04d", F.col("n") - 1).alias("region_id"))
    return rows.join(ids, ["source_id", "component"]).select("source_id", "tracklet_id", "region_id")


SHORT = 8  # path lengths whose bounds are exact; longer paths share one bound


class RegionGraph:
    """The tracklets of one region in time order and the links between them, as arrays sorted by tail."""

    def __init__(self, confidence: np.ndarray, tails: np.ndarray, heads: np.ndarray, motion: np.ndarray, gap: np.ndarray, edge_score: np.ndarray):
        order = np.lexsort((heads, tails))
        self.confidence, self.n = confidence.astype(float), len(confidence)
        self.tails, self.heads, self.motion, self.gap, self.edge_score = (x[order] for x in (tails, heads, motion, gap, edge_score))
        self.begin = np.searchsorted(self.tails, np.arange(self.n + 1))
        self.linked = np.flatnonzero(np.diff(self.begin))  # tracklets with a successor

    def best_next(self, by_link: np.ndarray) -> np.ndarray:
        """Per tracklet the largest value among its links; minus infinity without any."""
        out = np.full(self.n, -np.inf)
        if len(self.linked):
            out[self.linked] = np.maximum.reduceat(by_link, self.begin[self.linked])
        return out

    def fixed_length_bounds(self) -> dict[tuple[int, int], np.ndarray]:
        """(nodes in all, links to come) -> the most these links can add to twice the score. Twice the score of n nodes is additive for fixed n."""
        out = {}
        for n in range(2, SHORT + 1):
            gain = np.zeros(self.n)
            for r in range(n):
                out[n, r] = gain
                gain = self.best_next(self.confidence[self.heads] / n + self.edge_score / (n - 1) + gain[self.heads])
        return out

    def open_bounds(self, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(most that a continuation of any length can add to the sum of confidences and link scores over ``2 * least`` a node, most nodes to come)."""
        gain, depth = np.zeros(self.n), np.zeros(self.n, np.int64)
        own, begin = self.confidence[self.heads] + self.edge_score - 2 * least, self.begin
        for v in self.linked[::-1]:
            at = slice(begin[v], begin[v + 1])
            heads = self.heads[at]
            gain[v] = max(0.0, (own[at] + gain[heads]).max())
            depth[v] = depth[heads].max() + 1
        return gain, depth

    def paths_above(self, least: float, short: dict) -> list[dict]:
        """All paths that score ``least`` or more, by length: arrays end, up (row of the path without its last tracklet), score and the sums.

        Paths grow by one tracklet a round. A path is dropped when neither a fixed length nor any longer one can bring it to ``least``:
        with n nodes, twice the score is  C / n + E / (n - 1), and  n times that is at most  C + E + the largest link score.
        """
        gain, depth = self.open_bounds(least)
        most, slack = self.edge_score.max(initial=0.0), 1e-9
        end = np.arange(self.n)
        level = {"end": end, "up": np.full(self.n, -1), "c": self.confidence, "m": np.zeros(self.n), "g": np.zeros(self.n), "e": np.zeros(self.n)}
        levels, size = [], 0
        while len(level["end"]):
            size += 1
            end, c, e = level["end"], level["c"], level["e"]
            level["score"] = c / size if size == 1 else (c / size + e / (size - 1)) / 2
            levels.append(level)
            alive = (c + e - 2 * least * size + gain[end] + most >= -slack) & (size + depth[end] > SHORT)
            for n in range(size + 1, SHORT + 1):
                alive |= c / n + e / (n - 1) + short[n, n - size][end] >= 2 * least - slack
            rows = np.flatnonzero(alive)
            counts = self.begin[end[rows] + 1] - self.begin[end[rows]]
            up = np.repeat(rows, counts)
            link = np.arange(len(up)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.begin[end[rows]], counts)
            level = {"end": self.heads[link], "up": up, "c": c[up] + self.confidence[self.heads[link]], "m": level["m"][up] + self.motion[link],
                     "g": level["g"][up] + self.gap[link], "e": e[up] + self.edge_score[link]}
        return levels

    def thresholds(self, k: int) -> Iterator[float]:
        """Falling scores; the first is that of the k-th best path of one or two tracklets, the last lets every path pass."""
        pairs = ((self.confidence[self.tails] + self.confidence[self.heads]) / 2 + self.edge_score) / 2
        known = np.sort(np.concatenate([self.confidence, pairs]))[::-1]
        at = k
        while at <= len(known):
            yield float(known[at - 1])
            at *= 4
        yield -np.inf if not len(known) else float(min(0.0, known.min()) - 1.0)


MANY_PATHS = 1 << 10  # a region of fewer paths has them all written out


def listed_paths(confidence: list[float], ids: list[str], links: list[tuple], k: int, least_difference: float) -> list[dict] | None:
    """``best_paths`` of a small region: all its paths in order, with no arrays. None if the region is not small, or its links do not lead ahead."""
    ahead: list[list[tuple]] = [[] for _ in ids]
    for link in links:
        if link[1] <= link[0]:
            return None
        ahead[link[0]].append(link)
    count, total = [1] * len(ids), 0  # paths that begin at a tracklet
    for v in range(len(ids) - 1, -1, -1):
        count[v] += sum(count[link[1]] for link in ahead[v])
        total += count[v]
        if total > MANY_PATHS:
            return None
    if not all(map(math.isfinite, confidence)) or not all(x is not None and math.isfinite(x) for link in links for x in link[2:]):
        return None
    level = [((v,), c, 0.0, 0.0, 0.0) for v, c in enumerate(confidence)]
    paths, size = [], 0
    while level:
        size += 1
        for path, c, m, g, e in level:
            paths.append((-(c if size == 1 else (c / size + e / (size - 1)) / 2), -size, path, c, m, g, e))
        level = [((*path, head), c + confidence[head], m + motion, g + gap, e + score) for path, c, m, g, e in level for _, head, motion, gap, score in ahead[path[-1]]]
    paths.sort(key=lambda p: (p[0], p[1], [ids[v] for v in p[2]]))
    kept: list[tuple] = []
    for p in paths:
        mine = frozenset(p[2])
        if all(len(mine ^ other) / max(len(mine), len(other)) >= least_difference for other, _ in kept):
            kept.append((mine, p))
            if len(kept) == k:
                break
    out = []
    for _, (score, size, path, c, m, g, e) in kept:
        joints = max(1, -size - 1)
        out.append({"path": path, "score": -score, "confidence": c / -size, "motion": m / joints, "gap_penalty": g / joints, "edge_score": e / joints})
    return out


def best_paths(graph: RegionGraph, ids: list[str], k: int, least_difference: float) -> list[dict]:
    """The k best paths of a region that differ enough from each other, taken greedily in the order of score, length and ids.

    Whether a path is taken depends on better ones alone. So all paths above a threshold decide alone if k of them are taken, else the
    threshold falls. No path is passed over otherwise.
    """
    short = graph.fixed_length_bounds()
    for least in graph.thresholds(k):
        levels = graph.paths_above(least, short)

        def nodes_of(size: int, row: int) -> tuple[int, ...]:
            out = []
            for level in levels[size - 1::-1]:
                out.append(int(level["end"][row]))
                row = level["up"][row]
            return tuple(out[::-1])

        passing = [(size, rows, level["score"][rows]) for size, level in enumerate(levels, 1) for rows in [np.flatnonzero(level["score"] >= least)]]
        sizes = np.concatenate([np.full(len(rows), size) for size, rows, _ in passing])
        places, scores = np.concatenate([rows for _, rows, _ in passing]), np.concatenate([s for _, _, s in passing])
        kept: list[tuple[frozenset, int, int]] = []
        order, at = np.lexsort((-sizes, -scores)), 0
        while at < len(order) and len(kept) < k:
            tie = at
            while tie < len(order) and scores[order[tie]] == scores[order[at]] and sizes[order[tie]] == sizes[order[at]]:
                tie += 1
            equal = [(nodes_of(int(sizes[j]), int(places[j])), int(sizes[j]), int(places[j])) for j in order[at:tie]]
            for path, size, row in sorted(equal, key=lambda x: [ids[i] for i in x[0]]):
                mine = frozenset(path)
                if len(kept) < k and all(len(mine ^ other) / max(len(mine), len(other)) >= least_difference for other, *_ in kept):
                    kept.append((mine, size, row))
            at = tie
        if len(kept) == k:
            break
    out = []
    for _, size, row in kept:
        level, links = levels[size - 1], max(1, size - 1)
        out.append({"path": nodes_of(size, row), "score": float(level["score"][row]), "confidence": float(level["c"][row] / size),
                    **{name: float(level[c][row] / links) for name, c in (("motion", "m"), ("gap_penalty", "g"), ("edge_score", "e"))}})
    return out


PATHS_OUT = 2048  # paths that a task hands over at once
HYPOTHESIS_FIELDS = ("rank long, tracklet_ids array<string>, frame_start long, frame_end long, total_score double, confidence double, motion double, "
                     "gap_penalty double, edge_score double")


def decode_hypotheses(tracklets: DataFrame, edges: DataFrame, regions: DataFrame, settings: AssociationSettings = AssociationSettings()) -> DataFrame:
    """The best ``hypotheses_per_region`` paths of every region that differ enough from each other; exact, see ``best_paths``.

    A region of one tracklet is its own answer. The others stream through the tasks in order of regions; a task unpacks those of an Arrow
    batch and searches one at a time: a small one by listing its paths, others by some numbers per tracklet and per link, and the paths
    that can still reach the threshold.
    """
    if settings.hypotheses_per_region < 1:
        raise ValueError("at least one hypothesis per region")
    key = ["source_id", "region_id"]
    rows = tracklets.select("source_id", "tracklet_id", "first_frame", "last_frame", "confidence").join(regions, ["source_id", "tracklet_id"])
    rows = materialize(rows.join(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size")), key), "members")
    zero, names_out = F.lit(0.0), HYPOTHESIS_FIELDS.split(", ")
    alone = rows.filter("size = 1").select(*key, F.lit(1).cast("long").alias("rank"), F.array("tracklet_id").alias("tracklet_ids"), F.col("first_frame").alias("frame_start"),
                                           F.col("last_frame").alias("frame_end"), F.col("confidence").alias("total_score"), "confidence", zero.alias("motion"),
                                           zero.alias("gap_penalty"), zero.alias("edge_score"))
    out = edges.groupBy("source_id", F.col("tail_id").alias("tracklet_id")).agg(
        F.collect_list(F.struct("head_id", "motion", "gap_penalty", "edge_score")).alias("links"))
    linked = rows.filter("size > 1").join(out, ["source_id", "tracklet_id"], "left")
    linked = linked.select(*key, "tracklet_id", "first_frame", "last_frame", "confidence", "links").repartition(*key).sortWithinPartitions(*key, "first_frame", "tracklet_id")

    k, difference = settings.hypotheses_per_region, settings.minimum_difference

    kinds = [pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64(), *[pa.float64()] * 5]

    def told(block: pa.Table, at: list[int], paths: list[tuple]) -> list[pa.RecordBatch]:
        """The paths found, each with the source and region of a row of the block."""
        columns = {n.split(" ")[0]: pa.array(c, t) for n, c, t in zip(names_out, zip(*paths), kinds)}
        return pa.table({**{c: block[c].take(pa.array(at, pa.int64())) for c in key}, **columns}).to_batches()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, bounds in whole_blocks(batches, key):
            ids, first, last, confidence = (block[c].to_pylist() for c in ("tracklet_id", "first_frame", "last_frame", "confidence"))
            table = block["links"].chunk(0)
            begin, there = table.offsets.to_numpy().tolist(), table.is_valid().to_pylist()
            ahead = list(zip(*(c.to_pylist() for c in table.values.flatten())))  # head, motion, gap penalty and score of every link
            at, paths = [], []
            for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                names = ids[a:b]
                place = {t: i for i, t in enumerate(names)}
                links = [(i, place[e[0]], *e[1:]) for i in range(b - a) if there[a + i] for e in ahead[begin[a + i]:begin[a + i + 1]] if e[0] in place]
                sure = [math.nan if c is None else float(c) for c in confidence[a:b]]
                found = listed_paths(sure, names, links, k, difference)
                if found is None:
                    numbers = np.array(links, float).reshape(-1, 5)
                    graph = RegionGraph(np.array(sure), numbers[:, 0].astype(np.int64), numbers[:, 1].astype(np.int64), *numbers.T[2:])
                    found = best_paths(graph, names, k, difference)
                at += [a] * len(found)
                paths += [(rank, [names[j] for j in p["path"]], first[a + p["path"][0]], last[a + p["path"][-1]],
                           p["score"], p["confidence"], p["motion"], p["gap_penalty"], p["edge_score"]) for rank, p in enumerate(found, 1)]
                if len(paths) >= PATHS_OUT:
                    yield from told(block, at, paths)
                    at, paths = [], []
            if paths:
                yield from told(block, at, paths)

    schema = f"source_id {dict(tracklets.dtypes)['source_id']}, region_id string, {HYPOTHESIS_FIELDS}"
    return linked.mapInArrow(search, schema).unionByName(alone)


def hypothesis_points(hypotheses: DataFrame, linked: DataFrame) -> DataFrame:
    """The candidate rows along every hypothesis, in long form."""
    members = hypotheses.select("source_id", "region_id", "rank", "total_score", F.explode("tracklet_ids").alias("tracklet_id"))
    return members.join(linked, ["source_id", "tracklet_id"])


def hypothesis_segments(hypotheses: DataFrame, linked: DataFrame) -> DataFrame:
    """(previous point -> point) at each frame along the rank-1 paths, pixel-rounded half-even.

    Inside a tracklet the predecessor is known from linking; only the tracklet joints need the path order.
    """
    path = hypotheses.filter("rank = 1").select("source_id", "region_id", F.posexplode("tracklet_ids").alias("at", "tracklet_id"))
    before = path.select("source_id", "region_id", (F.col("at") + 1).alias("at"), F.col("tracklet_id").alias("before_id"))
    tails = linked.groupBy("source_id", F.col("tracklet_id").alias("before_id")).agg(F.max_by(F.struct("frame", "cx", "cy"), "frame").alias("tail"))
    path = path.join(before, ["source_id", "region_id", "at"], "left").join(tails, ["source_id", "before_id"], "left")
    rows = path.join(linked, ["source_id", "tracklet_id"])
    whole = lambda c: F.bround(c.cast("double"), 0).cast("long")
    inner, t = F.col("prev_frame").isNotNull(), F.col("tail")
    pick = lambda a, b: F.when(inner, F.col(a)).otherwise(t[b])
    return (rows.filter(inner | t.isNotNull()).filter(F.col("frame") > pick("prev_frame", "frame"))
            .select("source_id", "region_id", "frame", whole(pick("prev_x", "cx")).alias("from_x"), whole(pick("prev_y", "cy")).alias("from_y"),
                    whole(F.col("cx")).alias("to_x"), whole(F.col("cy")).alias("to_y")))
