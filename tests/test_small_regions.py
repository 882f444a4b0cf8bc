"""Small frames and small regions take plain loops, with the answers of the array versions; rows are built here."""

import random

import numpy as np
from pyspark.sql import functions as F
from trackloom.operators import candidates
from trackloom.settings import AssociationSettings


def region(pick, n):
    """Confidences and forward links of a region; few values, so that scores tie."""
    links = [(a, b, *(pick.choice((0.25, 0.5, 1.0)) for _ in range(3))) for a in range(n) for b in range(a + 1, n) if pick.random() < 0.4]
    return [pick.choice((0.25, 0.5, 0.75)) for _ in range(n)], [f"t{i:03d}" for i in range(n)], links


def arrays(confidence, links):
    table = np.array(links, float).reshape(-1, 5)
    return candidates.RegionGraph(np.array(confidence), table[:, 0].astype(int), table[:, 1].astype(int), *table.T[2:])


def test_listed_paths_are_those_of_the_search():
    pick = random.Random(7)
    for n in [1, 2, 2, 3, 3, 4, 5, 6, 7, 8] * 12:
        confidence, ids, links = region(pick, n)
        for k, least in ((1, 0.0), (5, 0.25), (3, 0.8)):
            assert candidates.listed_paths(confidence, ids, links, k, least) == candidates.best_paths(arrays(confidence, links), ids, k, least)
    assert candidates.listed_paths([0.5] * 40, ids * 5, [(a, b, 1.0, 0.0, 1.0) for a in range(40) for b in range(a + 1, 40)], 5, 0.25) is None
    assert candidates.listed_paths([0.5, 0.5], ["a", "b"], [(1, 0, 1.0, 0.0, 1.0)], 5, 0.25) is None


def test_few_pairs_link_as_many_do(monkeypatch):
    pick = random.Random(3)
    for _ in range(300):
        at, here = ([(float(pick.randint(0, 12)), pick.uniform(0, 12)) for _ in range(pick.randint(0, 9))] for _ in range(2))
        if not here:
            continue
        if pick.random() < 0.2:
            here[0] = (float("nan"), 3.0)
        args = at, [x for x, _ in here], [y for _, y in here], [pick.choice((2.0, 4.0)) for _ in at], pick.choice((0.5, 0.7, 1.0))
        few = candidates.sure_links(*args)
        with monkeypatch.context() as m:
            m.setattr(candidates, "FEW", -1)
            many = candidates.sure_links(*args)
        assert few[0] == many[0] and sorted(few[1]) == sorted(many[1])


def test_regions_are_searched_by_the_batch(spark):
    pick, tracklets, edges, regions, want = random.Random(2), [], [], [], {}
    for source in range(12):
        for name, n in (("r0000", pick.randint(1, 6)), ("r0001", 2 if source else 40)):
            confidence, ids, links = region(pick, n)
            ids = [f"{name}-{i}" for i in ids]
            tracklets += [(source, t, 10 * i, 10 * i + 5, c) for i, (t, c) in enumerate(zip(ids, confidence))]
            regions += [(source, t, name) for t in ids]
            edges += [(source, ids[a], ids[b], *rest) for a, b, *rest in links]
            want |= {(source, name, r): (",".join(ids[i] for i in p["path"]), 10 * p["path"][0], p["score"]) for r, p in enumerate(candidates.best_paths(arrays(confidence, links), ids, 5, 0.25), 1)}
    found = candidates.decode_hypotheses(spark.createDataFrame(tracklets, "source_id long, tracklet_id string, first_frame long, last_frame long, confidence double").orderBy(F.rand(1)),
                                         spark.createDataFrame(edges, "source_id long, tail_id string, head_id string, motion double, gap_penalty double, edge_score double"),
                                         spark.createDataFrame(regions, "source_id long, tracklet_id string, region_id string"), AssociationSettings())
    assert "MapInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.source_id, r.region_id, r["rank"]): (",".join(r.tracklet_ids), r.frame_start, r.total_score) for r in found.collect()} == want
