"""Components of groups of any size; rows are built here."""

import random

import pytest

from trackloom import components


def smallest(edges):
    label = {}
    for g, a, b in edges:
        label.setdefault((g, a), a)
        label.setdefault((g, b), b)
    moved = True
    while moved:
        moved = False
        for g, a, b in edges:
            low = min(label[g, a], label[g, b])
            for x in (a, b):
                moved |= label[g, x] != low
                label[g, x] = low
    return sorted((g, n, c) for (g, n), c in label.items())


@pytest.mark.parametrize("block", [3, 50, 1 << 18])
def test_groups_within_and_across_blocks(spark, block):
    """One group spans many blocks, most lie within one; edges repeat and meet themselves."""
    rng = random.Random(block)
    edges = [(1, f"1|{i:04d}", f"1|{i + 1:04d}") for i in range(300) if i % 70] + [(1, "1|0001", "1|0299")]
    for g in range(2, 40):
        edges += [(g, f"{g}|{rng.randrange(12):04d}", f"{g}|{rng.randrange(12):04d}") for _ in range(rng.randrange(1, 9))]
    edges += edges[::7]
    rng.shuffle(edges)
    # a partition's edges as blocks of ``block``; what a block leaves open is joined below as in grouped_components
    rows = spark.createDataFrame(edges, "group_id long, a string, b string")
    size = components.BLOCK_EDGES
    components.BLOCK_EDGES = block
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2" if block < 100 else "10000")
    try:
        got = components.grouped_components(rows).collect()
    finally:
        components.BLOCK_EDGES = size
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in got) == smallest(edges)


def test_most_groups_never_reach_the_contraction(spark, monkeypatch):
    seen, real = [], components.connected_components
    monkeypatch.setattr(components, "connected_components", lambda edges: (seen.append(edges.count()), real(edges))[1])
    rows = spark.range(20000).selectExpr("id div 10 AS group_id", "concat(id div 10, '|', lpad(id, 6, '0')) AS a", "concat(id div 10, '|', lpad(id + 1, 6, '0')) AS b")
    got = components.grouped_components(rows)
    assert got.count() == 22000 and got.select("component").distinct().count() == 2000
    assert seen and seen[0] < 2000


@pytest.mark.parametrize("block", [3, 1 << 18])
def test_few_edges_take_no_rounds(spark, monkeypatch, block):
    """Edges that fit a block are solved in it: nothing but the edges is stored. Repeats, loops and nulls give the same rows either way."""
    stored, real = [], components.materialize
    monkeypatch.setattr(components, "BLOCK_EDGES", block)
    monkeypatch.setattr(components, "materialize", lambda df, name="stage": (stored.append(name), real(df, name))[1])
    edges = [(i, i + 1) for i in range(40) if i % 9] + [(5, 3), (5, 3), (70, 70), (None, 80), (81, None), (None, None)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    expected = [(n, c) for _, n, c in smallest([(0, a, b) for a, b in edges if a is not None and b is not None])] + [(80, 80), (81, 81), (None, None)]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert (len(stored) == 1) == (block == 1 << 18)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
