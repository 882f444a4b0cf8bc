"""Repeated byte strings by the common-prefix interval tree of an enhanced suffix array.

The suffixes of all chunks of a bucket (see ``anchors``) are sorted with their longest common prefixes. A scan with a stack turns
these into intervals: each is a string and all suffixes that begin with it. An interval whose occurrences are preceded by
different bytes is a maximal repeat; the others are the tails of a longer one and are skipped. A chunk's first suffix counts as
differently preceded, since what stands before it belongs to another chunk. So a long repeat is reported as overlapping
groups, chunk by chunk, whose union is the repeat: the work of a group does not grow with the length of a copy.

Removal: in a group, every occurrence in a document later than the group's first document is covered.

Defined results: null texts are empty; rows of equal ``doc_id`` are not earlier than each other, so repeated rows get equal
results; a null ``doc_id`` comes after all others; texts below 50 bytes lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.anchors import LAST, Plan, Powers, U64, covered_texts, in_blocks, shared_chunks, union_of, unpacked, window_hashes, without_copies
from trackloom.llm.common import documents, query

LENGTH = 50
DIVERSE, EDGE = -1, 256  # left contexts: several, or the edge of a chunk


def byte_plan(length: int = LENGTH) -> Plan:
    return Plan(window=length, gram=length // 2 - 1, parts=lambda t: t.encode("utf-8", "surrogatepass"),
                values=lambda b: np.frombuffer(b, np.uint8).astype(U64), content=lambda b, i, j: b[i:j])


def candidate_suffixes(orders: np.ndarray, contents: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(chunk, offset, position in the joined text, left context) of the suffixes that can begin a maximal repeat of several documents.

    Suffixes are classed by a hash of their first ``length`` bytes. A class of one document, or one that the same byte always
    precedes inside its chunks, begins none. The hash only rules out: what remains is compared by its bytes.
    """
    text = np.frombuffer(b"".join(contents), np.uint8)
    sizes = np.array([len(c) for c in contents], np.int64)
    edges = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - length + 1, 0)
    chunk = np.repeat(np.arange(len(contents)), counts)
    offset = np.arange(len(chunk)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = edges[chunk] + offset
    left = np.where(offset > 0, text[at - 1].astype(np.int16), EDGE)
    if not len(at):
        return chunk, offset, at, left
    hashes = window_hashes(text.astype(U64), length, Powers())[at]
    order = np.argsort(hashes, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], hashes[order[1:]] != hashes[order[:-1]]]))
    o, b = orders[chunk[order]], left[order]
    keep = (np.minimum.reduceat(o, begin) < np.maximum.reduceat(o, begin)) & (
        (np.maximum.reduceat(b, begin) == EDGE) | (np.minimum.reduceat(b, begin) < np.maximum.reduceat(b, begin)))
    kept = order[np.repeat(keep, np.diff(np.concatenate([begin, [len(order)]])))]
    return chunk[kept], offset[kept], at[kept], left[kept]


def enhanced_suffix_array(text: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes text[at:ends], longest common prefix of each with the one before it)."""
    sizes = ends - at
    width = -(-int(sizes.max()) // 8) * 8
    rows = np.concatenate([text, np.zeros(width, np.uint8)])[at[:, None] + np.arange(width)]
    rows[np.arange(width) >= sizes[:, None]] = 0
    # fixed-width strings compare as if zeros at the end were absent; among those the shorter suffix comes first
    order = np.argsort(sizes, kind="stable")
    order = order[np.argsort(rows.view(f"S{width}").ravel()[order], kind="stable")]
    rows, sizes = rows[order], sizes[order]
    differ = rows[1:] != rows[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.concatenate([[0], np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))])


def maximal_intervals(prefixes: list[int], orders: list[int], left: list[int], length: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """(first, last, length, least order) of every left-diverse interval of common prefixes of at least ``length``, by a stack scan."""
    firsts, lasts, lengths, leasts = [], [], [], []
    stack: list[list[int]] = []  # [prefix, first suffix, least order, left context]
    n = len(orders)
    for i in range(n):
        prefix = prefixes[i + 1] if i + 1 < n else 0
        first, least, context = i, orders[i], left[i]
        if context == EDGE:
            context = DIVERSE
        while stack and stack[-1][0] > prefix:
            depth, first, m, c = stack.pop()
            least = m if m < least else least
            if c != context:
                context = DIVERSE
            if context == DIVERSE:
                firsts.append(first)
                lasts.append(i)
                lengths.append(depth)
                leasts.append(least)
        if prefix >= length:
            if stack and stack[-1][0] == prefix:
                top = stack[-1]
                top[2] = least if least < top[2] else top[2]
                top[3] = context if top[3] == context else DIVERSE
            else:
                stack.append([prefix, first, least, context])
    return firsts, lasts, lengths, leasts


def repeat_groups(orders: np.ndarray, contents: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(group, chunk, offset, length, least order of the group) of every occurrence of every maximal repeat of several documents."""
    chunk, offset, at, left = candidate_suffixes(orders, contents, length)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    text = np.frombuffer(b"".join(contents), np.uint8)
    ends = np.cumsum([len(c) for c in contents])[chunk]
    order, prefixes = enhanced_suffix_array(text, at, ends)
    own = orders[chunk[order]]
    firsts, lasts, lengths, leasts = (np.array(x, np.int64) for x in maximal_intervals(
        prefixes.tolist(), own.tolist(), left[order].tolist(), length))
    counts = lasts - firsts + 1
    group = np.repeat(np.arange(len(counts)), counts)
    place = np.repeat(firsts, counts) + np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
    return group, chunk[order[place]], offset[order[place]], lengths[group], leasts[group]


def later_occurrences(orders: np.ndarray, contents: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, chunk, offset, size, least = repeat_groups(orders, contents, length)
    later = orders[chunk] > least
    return chunk[later], offset[later], size[later]


def _cut(rows: pd.DataFrame, spans: list) -> pd.DataFrame:
    out = []
    for order, text, (starts, lengths) in zip(rows["ord"], rows["text"], spans):
        data = text.encode("utf-8", "surrogatepass")
        runs = union_of(starts, lengths)
        kept, at = [], 0
        for a, b in runs:
            kept.append(data[at:a])
            at = b
        kept.append(data[at:])
        out.append((order, len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(b"".join(kept)).hexdigest()))
    return pd.DataFrame(out, columns=["ord", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256 after removing what an earlier document holds."""
    rows, total = without_copies(docs)
    blocks, n = in_blocks(rows.filter("NOT copied"), total)
    plan = byte_plan(length)
    own = covered_texts(blocks, n, plan, lambda o, c: later_occurrences(o, c, length), _cut,
                        "ord long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    own = own.select(F.when(F.col("ord") < LAST, F.col("ord")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    gone = F.col("n_bytes") >= length
    copies = rows.filter("copied").select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"),
        gone.cast("long").alias("n_spans"), F.sha2(F.when(gone, F.lit("")).otherwise(F.col("text")), 256).alias("kept_sha256"))
    return own.unionByName(copies)


def maximal_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(group_id, length, doc_id, start): every occurrence of every maximal repeat of several documents, in bytes.

    Repeats are maximal within chunks; occurrences in exact copies of a document are those of the document.
    """
    rows, total = without_copies(docs)
    blocks, n = in_blocks(rows.filter("NOT copied"), total)

    def groups_of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, orders, _, starts, contents = unpacked(pdf)
        group, chunk, offset, size, _ = repeat_groups(orders, contents, length)
        return pd.DataFrame({"group_id": [f"{key[0]}:{g}" for g in group], "length": size, "ord": orders[chunk], "start": starts[chunk] + offset})

    found = shared_chunks(blocks, n, byte_plan(length), once=False).groupBy("bucket").applyInPandas(groups_of, "group_id string, length long, ord long, start long")
    return found.select("group_id", "length", F.when(F.col("ord") < LAST, F.col("ord")).alias("doc_id"), "start")


@query("op4_remove_repeats")
def op4_remove_repeats(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir))
