"""Connected components by alternating star contraction, all joins and groupings; small groups of edges within their block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.session import materialize


def _pairs(df: DataFrame) -> DataFrame:
    return df.filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for undirected edges (a, b); the component is its smallest node.

    Edges that fit one block (``BLOCK_EDGES``, a few megabytes) are solved in it. For more, large-star and small-star steps move
    every node to the smallest neighbour it knows; they converge in about log-squared rounds however long the paths are, and no
    step lists the pairs of a neighbourhood.
    """
    edges = materialize(edges.select("a", "b"), "edges")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    if edges.count() <= BLOCK_EDGES:
        kind = dict(nodes.dtypes)["node"]
        return edges.select(F.col("a").cast(kind), F.col("b").cast(kind)).repartition(1).mapInArrow(_in_one_block, f"node {kind}, component {kind}")
    current = materialize(_pairs(edges), "edges")
    signature = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: larger neighbours go to the least known node
        large = _pairs(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small star: each node and its smaller neighbours go to the least of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a")
        small = _pairs(moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
                            .unionByName(moved.select("a", F.col("m").alias("b"))))
        current = materialize(small, "edges")
        now = current.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == signature:
            break
        signature = now
    return nodes.join(current.select(F.col("a").alias("node"), F.col("b").alias("c")), "node", "left").select(
        "node", F.coalesce("c", "node").alias("component"))


BLOCK_EDGES = 1 << 18  # edges that a task holds at a time


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each component of the nodes 0..n-1 under the edges (a, b)."""
    labels = np.arange(n)
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def _in_one_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of the edges (a, b) of a task; a null is a node that links nothing."""
    held = [batch for batch in batches if batch.num_rows]
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        coded = pa.concat_arrays([table["a"].combine_chunks(), table["b"].combine_chunks()]).dictionary_encode(null_encoding="encode")
        nodes, ends_of = _ranked(coded)
        a, b = ends_of[:table.num_rows], ends_of[table.num_rows:]
        known = len(nodes) - nodes.null_count  # nulls are ranked last
        links = (a < known) & (b < known)
        yield from pa.table({"node": nodes, "component": nodes.take(pa.array(least_labels(len(nodes), a[links], b[links])))}).to_batches()


def _ranked(coded: pa.DictionaryArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a dictionary in order, and the place of every coded value among them."""
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]


def _block_components(held: list[pa.RecordBatch]) -> pa.Table:
    """(group_id, node, component, open) of edges (group_id, a, b) sorted by group; the first and last group may go on outside, so they are open."""
    table = pa.Table.from_batches(held).combine_chunks()
    groups = table["group_id"].combine_chunks()
    is_open = pc.is_in(groups, value_set=pa.concat_arrays([groups.slice(0, 1), groups.slice(len(groups) - 1, 1)])).to_numpy(zero_copy_only=False)
    coded = pa.concat_arrays([table["a"].combine_chunks(), table["b"].combine_chunks()]).dictionary_encode()
    nodes, ends_of = _ranked(coded)
    a, b = ends_of[:len(groups)], ends_of[len(groups):]
    where = np.empty(len(nodes), np.int64)
    where[b], where[a] = np.arange(len(groups)), np.arange(len(groups))
    return pa.table({"group_id": groups.take(pa.array(where)), "node": nodes, "component": nodes.take(pa.array(least_labels(len(nodes), a, b))), "open": is_open[where]})


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= BLOCK_EDGES:
            yield from _block_components(held).to_batches()
            held = []
    if held:
        yield from _block_components(held).to_batches()


def grouped_components(edges: DataFrame) -> DataFrame:
    """(group_id, node, component) for undirected edges (group_id, a, b) that stay within their group; the component is its smallest node.

    Edges sorted by group pass in blocks. A group that lies whole in a block is solved there; what a block knows of the others
    (a node and the smallest it is linked to) goes through ``connected_components``, so a group may have any size.
    """
    stored = materialize(edges.select("group_id", "a", "b"), "edges")  # ranges are drawn from stored rows
    schema = f"group_id {dict(edges.dtypes)['group_id']}, node string, component string, open boolean"
    blocks = materialize(stored.repartitionByRange("group_id", "a").sortWithinPartitions("group_id", "a").mapInArrow(_by_block, schema), "blocks")
    rest = blocks.filter("open")
    joined = connected_components(rest.select(F.col("node").alias("a"), F.col("component").alias("b")))
    closed = blocks.filter("NOT open").select("group_id", "node", "component")
    return closed.unionByName(rest.select("group_id", "node").distinct().join(joined, "node"))
