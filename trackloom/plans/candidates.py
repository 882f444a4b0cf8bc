"""Candidate ranking, linking and association queries."""

from pyspark.sql import functions as F

from trackloom import fixtures
from trackloom.operators import candidates as ops
from trackloom.plans.base import cte, oracle, query, rounded
from trackloom.plans.labels import frame_labels
from trackloom.session import materialize
from trackloom.settings import AssociationSettings

W, H, FPS = fixtures.WIDTH, fixtures.HEIGHT, fixtures.FPS
LOOSE = AssociationSettings(max_gap_seconds=0.25, max_speed_diagonals_per_second=2.0)


def named(spark, sf):
    """Candidates with an id that sorts like (frame, position) and a mean activation with gaps."""
    rows = fixtures.candidates(spark, sf)
    return rows.withColumns({
        "candidate_id": F.concat(F.lit("f"), F.lpad(F.col("frame").cast("string"), 6, "0"), F.lit("-c"), F.col("cand").cast("string")),
        "mean": F.when(F.col("area") % 4 != 0, F.col("peak") * 0.8), "area": F.col("area").cast("double")})


cte("nc", """SELECT * REPLACE (area::DOUBLE AS area), 'f' || lpad(frame::VARCHAR, 6, '0') || '-c' || cand AS candidate_id, CASE WHEN area % 4 <> 0 THEN peak*0.8::DOUBLE END AS mean FROM v_candidates""", ("v_candidates",))
cte("ranked", "SELECT *, row_number() OVER (PARTITION BY source_id, frame ORDER BY peak DESC, coalesce(mean, peak) DESC, area DESC, candidate_id) AS rank FROM nc", ("nc",))


@query("rank_candidates")
def _(spark, sf):
    return ops.rank_candidates(named(spark, sf), 2).select("source_id", "frame", "candidate_id", "rank")


oracle("rank_candidates", "SELECT source_id, frame, candidate_id, rank FROM ranked WHERE rank <= 2", ("ranked",))


def recall_labels(spark, sf):
    f = F.col("frame")
    rows = named(spark, sf).filter("cand = 0")
    kind = F.when(f % 5 == 0, "missing_proposal").when(f % 7 == 0, "no_shuttle").when(f % 11 == 0, "unsure").otherwise("selected")
    return rows.select("source_id", "frame", kind.alias("label_kind"), F.when(kind == "selected", F.col("candidate_id")).alias("candidate_id"))


@query("recall_at_k")
def _(spark, sf):
    return rounded(ops.recall_at_k(recall_labels(spark, sf), named(spark, sf)))


oracle("recall_at_k", """, l AS (SELECT *, CASE WHEN frame % 5 = 0 THEN 'missing_proposal' WHEN frame % 7 = 0 THEN 'no_shuttle' WHEN frame % 11 = 0 THEN 'unsure' ELSE 'selected' END AS kind FROM ranked WHERE cand = 0),
    p AS (SELECT * FROM l WHERE kind IN ('selected', 'missing_proposal'))
    SELECT k, count(*) FILTER (kind = 'selected' AND rank <= lim) AS hits, count(*) AS present, round(count(*) FILTER (kind = 'selected' AND rank <= lim)::DOUBLE/count(*), 6) AS recall
    FROM p, (VALUES ('1', 1), ('2', 2), ('3', 3), ('5', 5), ('8', 8), ('12', 12), ('all', 1000000)) v(k, lim) GROUP BY k""", ("ranked",))


@query("recall_violations")
def _(spark, sf):
    rows = frame_labels(spark, sf).select("source_id", "frame", "label_kind", "candidate_id")
    ids = named(spark, sf).select("source_id", "frame", F.concat(F.lit("f"), F.col("frame"), F.lit("-c"), F.col("cand")).alias("candidate_id"))
    return ops.recall_violations(rows.unionByName(rows.filter("frame % 37 = 0")), ids, ids)


oracle("recall_violations", """, l AS (SELECT source_id, frame, label_kind, candidate_id FROM flabels UNION ALL SELECT source_id, frame, label_kind, candidate_id FROM flabels WHERE frame % 37 = 0),
    x AS (SELECT l.*, f.frame IS NOT NULL AS fk, c.frame IS NOT NULL AS ck FROM l LEFT JOIN (SELECT DISTINCT source_id, frame FROM cands) f USING (source_id, frame) LEFT JOIN cands c ON c.source_id = l.source_id AND c.frame = l.frame AND c.candidate_id = l.candidate_id)
    SELECT source_id, frame, 'repeated_frame' AS problem FROM l GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT source_id, frame, 'unsupported_kind' FROM l WHERE label_kind = 'wrong'
    UNION ALL SELECT source_id, frame, 'unknown_frame' FROM x WHERE label_kind = 'selected' AND NOT fk UNION ALL SELECT source_id, frame, 'unknown_candidate' FROM x WHERE label_kind = 'selected' AND fk AND NOT ck""", ("flabels", "cands"))


@query("candidate_load")
def _(spark, sf):
    return rounded(ops.candidate_load(fixtures.person_obs(spark, sf).select("source_id", "frame").distinct(), named(spark, sf)))


oracle("candidate_load", """SELECT round(avg(coalesce(n, 0)), 6) AS candidates_per_frame, max(coalesce(n, 0)) AS maximum_candidates_per_frame FROM (SELECT DISTINCT source_id, frame FROM v_person_obs)
    LEFT JOIN (SELECT source_id, frame, count(*) AS n FROM nc GROUP BY ALL) USING (source_id, frame)""", ("v_person_obs", "nc"))

MAP_W, MAP_H = 9, 7


def activations(spark, sf):
    rn, q, pk = F.col("rn"), F.col("q"), F.col("pk")
    return fixtures._supplier_rows(spark, sf).select(
        "source_id", F.floor(rn / 20).cast("long").alias("frame"), (pk % MAP_W).alias("x"), (q % MAP_H).cast("long").alias("y"),
        (((pk * 7 + q * 13) % 97).cast("double") / 97.0).alias("value")).groupBy("source_id", "frame", "x", "y").agg(F.max("value").alias("value"))


cte("cells", """SELECT source_id, frame, x, y, value, threshold FROM (SELECT source_id, CAST(rn // 20 AS BIGINT) AS frame, pk % 9 AS x, q % 7 AS y, max(((pk*7 + q*13) % 97)::DOUBLE/97.0) AS value FROM v_rows GROUP BY ALL),
    (VALUES (0.2::DOUBLE), (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE)) t(threshold) WHERE value > threshold""", ("v_rows",))
cte("reach", """SELECT source_id, frame, threshold, x, y, y*9 + x AS lab FROM cells UNION SELECT c.source_id, c.frame, c.threshold, c.x, c.y, m.lab FROM reach m JOIN cells c
    ON c.source_id = m.source_id AND c.frame = m.frame AND c.threshold = m.threshold AND abs(c.x - m.x) <= 1 AND abs(c.y - m.y) <= 1""", ("cells",))
cte("comps", """SELECT *, row_number() OVER (PARTITION BY source_id, frame, threshold ORDER BY y0, x0, h, w, area DESC, peak DESC, lab) - 1 AS component_index FROM (
    SELECT source_id, frame, threshold, lab, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area, max(value) AS peak, avg(value) AS mean, sum(value) AS total,
      sum((x+0.5)*value)/sum(value) AS wx, sum((y+0.5)*value)/sum(value) AS wy, arg_max({'x': x, 'y': y}, {'v': value, 'y': -y, 'x': -x}) AS top
    FROM (SELECT source_id, frame, threshold, x, y, min(lab) AS lab FROM reach GROUP BY ALL) JOIN cells USING (source_id, frame, threshold, x, y) GROUP BY source_id, frame, threshold, lab)""", ("reach",))
SX, SY = f"({W}::DOUBLE/9)", f"({H}::DOUBLE/7)"


@query("extract_components")
def _(spark, sf):
    rows = ops.extract_components(activations(spark, sf), W, H, MAP_W, MAP_H)
    # centroids are ratios of small integers: a prime divisor keeps them off rounding ties
    rows = rows.withColumns({c: F.col(c) / 1009.0 for c in ("weighted_x", "weighted_y")})
    return rounded(rows.select(
        "source_id", "frame", "threshold", "candidate_id", "area", "peak", "mean", "total", "cx", "cy", "peak_x", "peak_y", "weighted_x", "weighted_y", "x1", "y1", "x2", "y2"), 5)


oracle("extract_components", f"""SELECT source_id, frame, threshold, format('f{{:06d}}-t{{:03d}}-c{{:03d}}', frame, CAST(round(threshold*100) AS INT), component_index) AS candidate_id, area, round(peak, 5) AS peak, round(mean, 5) AS mean, round(total, 5) AS total,
    round((x0 + w/2.0::DOUBLE)*{SX}, 5) AS cx, round((y0 + h/2.0::DOUBLE)*{SY}, 5) AS cy, round((top.x+0.5)*{SX}, 5) AS peak_x, round((top.y+0.5)*{SY}, 5) AS peak_y, round(wx*{SX}/1009, 5) AS weighted_x, round(wy*{SY}/1009, 5) AS weighted_y,
    round(x0*{SX}, 5) + 0.0 AS x1, round(y0*{SY}, 5) + 0.0 AS y1, round((x0+w)*{SX}, 5) AS x2, round((y0+h)*{SY}, 5) AS y2 FROM comps""", ("comps",), recursive=True)


@query("mark_legacy_component")
def _(spark, sf):
    return ops.extract_components(activations(spark, sf), W, H, MAP_W, MAP_H).filter("legacy_largest").select("source_id", "frame", "candidate_id")


oracle("mark_legacy_component", """SELECT source_id, frame, format('f{:06d}-t050-c{:03d}', frame, component_index) AS candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id, frame ORDER BY w*h DESC, component_index) AS n
    FROM comps WHERE threshold = 0.5) WHERE n = 1""", ("comps",), recursive=True)


def linked(spark, sf):
    return ops.link_candidates(named(spark, sf), FPS, W, H)


@query("link_candidates")
def _(spark, sf):
    return linked(spark, sf).select("source_id", "frame", "candidate_id", "tracklet_id", "prev_frame")


def grid_tracklets(spark, sf):
    """Tracklets by rule, so that SQL can state them: position 0 candidates in blocks of four frames, the others alone."""
    rows = named(spark, sf).withColumn("g", F.when(F.col("cand") == 0, F.floor(F.col("frame") / 4).cast("long")).otherwise(F.col("frame") * 10 + F.col("cand")))
    rows = rows.withColumn("tracklet_id", F.concat(F.when(F.col("cand") == 0, "a").otherwise("b"), F.lpad(F.col("g").cast("string"), 7, "0")))
    from pyspark.sql import Window
    w = Window.partitionBy("source_id", "tracklet_id").orderBy("frame")  # at most four rows
    return rows.withColumns({"prev_frame": F.lag("frame").over(w), "prev_x": F.lag(F.col("cx").cast("double")).over(w), "prev_y": F.lag(F.col("cy").cast("double")).over(w)})


cte("gt", """SELECT *, lag(frame) OVER w AS prev_frame, lag(cx) OVER w AS prev_x, lag(cy) OVER w AS prev_y FROM (SELECT *, CASE WHEN cand = 0 THEN 'a' || lpad(CAST(frame // 4 AS BIGINT)::VARCHAR, 7, '0') ELSE 'b' || lpad((frame*10 + cand)::VARCHAR, 7, '0') END AS tracklet_id FROM nc)
    WINDOW w AS (PARTITION BY source_id, tracklet_id ORDER BY frame)""", ("nc",))
cte("ts", """SELECT *, CASE WHEN pf IS NULL THEN 0.0 ELSE (tail_x - px)/(last_frame - pf) END AS vx, CASE WHEN pf IS NULL THEN 0.0 ELSE (tail_y - py)/(last_frame - pf) END AS vy FROM (
    SELECT source_id, tracklet_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS points, avg(peak) AS confidence, arg_min(cx, frame)::DOUBLE AS head_x, arg_min(cy, frame)::DOUBLE AS head_y,
      arg_max(cx, frame)::DOUBLE AS tail_x, arg_max(cy, frame)::DOUBLE AS tail_y, arg_max(prev_frame, frame) FILTER (prev_frame IS NOT NULL) AS pf, arg_max(prev_x, frame) FILTER (prev_frame IS NOT NULL) AS px, arg_max(prev_y, frame) FILTER (prev_frame IS NOT NULL) AS py FROM gt GROUP BY ALL)""", ("gt",))
cte("edges", f"""SELECT source_id, tail_id, head_id, greatest(0, 1 - distance/gate) AS motion, gap/0.25 AS gap_penalty, greatest(0, 1 - distance/gate)*(1 - gap/0.25) AS edge_score FROM (
    SELECT a.source_id, a.tracklet_id AS tail_id, b.tracklet_id AS head_id, (b.first_frame - a.last_frame - 1)/30.0::DOUBLE AS gap, 2.0*sqrt({W*W + H*H}::DOUBLE)/30*(b.first_frame - a.last_frame) AS gate,
      sqrt(pow(a.tail_x + a.vx*(b.first_frame - a.last_frame) - b.head_x, 2) + pow(a.tail_y + a.vy*(b.first_frame - a.last_frame) - b.head_y, 2)) AS distance
    FROM ts a JOIN ts b ON a.source_id = b.source_id AND b.first_frame > a.last_frame AND b.first_frame <= a.last_frame + 9) WHERE gap <= 0.25 AND distance <= gate""", ("ts",))


@query("tracklet_summaries")
def _(spark, sf):
    return rounded(ops.tracklet_summaries(grid_tracklets(spark, sf)))


oracle("tracklet_summaries", """SELECT source_id, tracklet_id, first_frame, last_frame, points, round(confidence, 6) AS confidence, head_x, head_y, tail_x, tail_y, round(vx, 6) + 0.0 AS vx, round(vy, 6) + 0.0 AS vy FROM ts""", ("ts",))


@query("tracklet_edges")
def _(spark, sf):
    return rounded(ops.tracklet_edges(ops.tracklet_summaries(grid_tracklets(spark, sf)), FPS, W, H, LOOSE))


oracle("tracklet_edges", "SELECT source_id, tail_id, head_id, round(motion, 6) + 0.0 AS motion, round(gap_penalty, 6) + 0.0 AS gap_penalty, round(edge_score, 6) + 0.0 AS edge_score FROM edges", ("edges",))

SPARSE = AssociationSettings(max_gap_seconds=0.1, max_speed_diagonals_per_second=0.6)


@query("association_regions")
def _(spark, sf):
    tracklets = materialize(ops.tracklet_summaries(grid_tracklets(spark, sf)), "tracklets")
    return ops.association_regions(tracklets, ops.tracklet_edges(tracklets, FPS, W, H, SPARSE))


cte("sparse", f"""SELECT DISTINCT source_id, u, v FROM (SELECT source_id, unnest([tail_id, head_id]) AS u, unnest([head_id, tail_id]) AS v FROM (
    SELECT a.source_id, a.tracklet_id AS tail_id, b.tracklet_id AS head_id FROM ts a JOIN ts b ON a.source_id = b.source_id AND b.first_frame > a.last_frame AND b.first_frame <= a.last_frame + 4
    WHERE sqrt(pow(a.tail_x + a.vx*(b.first_frame - a.last_frame) - b.head_x, 2) + pow(a.tail_y + a.vy*(b.first_frame - a.last_frame) - b.head_y, 2)) <= 0.6*sqrt({W*W + H*H}::DOUBLE)/30*(b.first_frame - a.last_frame)))""", ("ts",))
cte("hops", """SELECT source_id, tracklet_id AS n, tracklet_id AS root FROM ts UNION SELECT e.source_id, e.v, m.root FROM hops m JOIN sparse e ON e.source_id = m.source_id AND e.u = m.n""", ("ts", "sparse"))
oracle("association_regions", """SELECT source_id, tracklet_id, 'r' || lpad((dense_rank() OVER (PARTITION BY source_id ORDER BY lead) - 1)::VARCHAR, 4, '0') AS region_id
    FROM (SELECT h.source_id, n AS tracklet_id, min({'f': t.first_frame, 'l': t.last_frame, 'i': t.tracklet_id}) AS lead FROM hops h JOIN ts t ON t.source_id = h.source_id AND t.tracklet_id = h.root GROUP BY h.source_id, n)""", ("hops",), recursive=True)


def decoded(spark, sf):
    points = materialize(linked(spark, sf), "linked")
    tracklets = materialize(ops.tracklet_summaries(points), "tracklets")
    edges = materialize(ops.tracklet_edges(tracklets, FPS, W, H, SPARSE), "edges")
    return points, ops.decode_hypotheses(tracklets, edges, ops.association_regions(tracklets, edges), SPARSE)


@query("decode_hypotheses")
def _(spark, sf):
    _, found = decoded(spark, sf)
    return rounded(found.withColumn("tracklet_ids", F.concat_ws(",", "tracklet_ids")))


def tracklet_arrays(spark, sf):
    """Stored tracklets with parallel arrays, some of them damaged."""
    rows = grid_tracklets(spark, sf).groupBy("source_id", "tracklet_id").agg(
        F.array_sort(F.collect_list(F.struct("frame", "candidate_id"))).alias("m"))
    first = F.col("m")[0]["frame"]
    ids, frames = F.transform("m", lambda m: m["candidate_id"]), F.transform("m", lambda m: m["frame"])
    return rows.select("source_id", F.when(first % 43 == 0, "dup").otherwise(F.col("tracklet_id")).alias("tracklet_id"),
                       F.when(first % 13 == 0, F.transform(ids, lambda i: F.concat(i, F.lit("x")))).otherwise(ids).alias("candidate_ids"),
                       F.when(first % 11 == 0, F.reverse(frames)).when(first % 17 == 0, F.concat(frames, F.array(F.element_at(frames, -1)))).otherwise(frames).alias("frames"))


cte("ta", """SELECT source_id, CASE WHEN f0 % 43 = 0 THEN 'dup' ELSE tracklet_id END AS tracklet_id, CASE WHEN f0 % 13 = 0 THEN list_transform(ids, lambda i: i || 'x') ELSE ids END AS ids,
    CASE WHEN f0 % 11 = 0 THEN list_reverse(frames) WHEN f0 % 17 = 0 THEN list_append(frames, frames[-1]) ELSE frames END AS frames
    FROM (SELECT source_id, tracklet_id, min(frame) AS f0, list(candidate_id ORDER BY frame) AS ids, list(frame ORDER BY frame) AS frames FROM gt GROUP BY source_id, tracklet_id)""", ("gt",))


@query("validate_tracklets")
def _(spark, sf):
    return ops.validate_tracklets(tracklet_arrays(spark, sf), named(spark, sf))


oracle("validate_tracklets", """SELECT source_id, tracklet_id, 'length_mismatch' AS problem FROM ta WHERE len(ids) <> len(frames) UNION ALL SELECT source_id, tracklet_id, 'unsorted_frames' FROM ta WHERE frames <> list_sort(frames)
    UNION ALL SELECT source_id, tracklet_id, 'repeated_frames' FROM ta WHERE len(list_distinct(frames)) <> len(frames) UNION ALL SELECT source_id, tracklet_id, 'duplicate_id' FROM ta GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT DISTINCT source_id, tracklet_id, 'unresolved_candidate' FROM (SELECT source_id, tracklet_id, unnest(ids) AS id, unnest(frames) AS f FROM ta WHERE len(ids) = len(frames)) x
      WHERE NOT EXISTS (SELECT 1 FROM nc WHERE nc.source_id = x.source_id AND nc.candidate_id = x.id AND nc.frame = x.f)""", ("ta", "nc"))


@query("candidate_tracklets")
def _(spark, sf):
    return ops.candidate_tracklets(named(spark, sf).select("source_id", "candidate_id", "frame"), tracklet_arrays(spark, sf))


oracle("candidate_tracklets", """SELECT nc.source_id, nc.candidate_id, frame, tracklet_id FROM nc LEFT JOIN (SELECT source_id, tracklet_id, unnest(ids) AS candidate_id FROM ta) t USING (source_id, candidate_id)""", ("nc", "ta"))


@query("hypothesis_segments")
def _(spark, sf):
    """Paths by rule: every region joins the tracklets of one candidate position in a block of frames, in order."""
    points = grid_tracklets(spark, sf)
    region = F.concat_ws("_", F.lit("r"), F.floor(F.col("frame") / 20).cast("long"), F.col("cand"))
    paths = points.groupBy("source_id", region.alias("region_id")).agg(F.array_sort(F.collect_set("tracklet_id")).alias("tracklet_ids")).withColumn("rank", F.lit(1))
    return ops.hypothesis_segments(paths, points)


oracle("hypothesis_segments", """SELECT source_id, region_id, frame, from_x, from_y, cx AS to_x, cy AS to_y FROM (SELECT *, lag(cx) OVER w AS from_x, lag(cy) OVER w AS from_y
    FROM (SELECT *, 'r_' || CAST(frame // 20 AS BIGINT) || '_' || cand AS region_id FROM gt) WINDOW w AS (PARTITION BY source_id, region_id ORDER BY frame)) WHERE from_x IS NOT NULL""", ("gt",))
