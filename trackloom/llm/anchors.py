"""Windows that occur in several documents, found by content-defined anchors. Shared by byte and word operators.

A window of ``window`` elements holds ``window - gram + 1`` grams; its anchor is the leftmost gram of least hash, so equal windows
have equal anchors wherever they stand. The windows with one anchor form a run, covered by one short chunk of text. All
windows of all documents belong to exactly one chunk, and equal windows always meet in the bucket of their anchor's hash.

Work runs over blocks of documents (about ``BLOCK_BYTES`` of text each, one shuffle of the texts, read by three stages):

1. each block lists its distinct anchor hashes, and those that several of its documents hold, packed by bucket;
2. each bucket finds the hashes that several blocks hold and tells each block its own;
3. each block cuts the chunks at shared anchors and sends every distinct chunk once, named by its earliest document; documents
   of the block that hold the same chunk later are covered on the spot;
4. each bucket compares the chunks of the corpus (the operator's part) and answers with covered spans;
5. each block applies the spans to its documents.

A hash crosses the network once per block at most and a chunk's text once per block, so no key gathers more rows than there
are blocks, however many copies of it the corpus holds. Everything is a recomputable shuffle stage: a lost executor costs
its tasks, nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import lookup, materialize

BLOCK_BYTES = 8 << 20
BATCH = 1 << 17
U64 = np.uint64
_MULTIPLIER = 0x5851F42D4C957F2D
_SPREAD = (U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB))
LAST = (1 << 63) - 1  # order of a null doc_id: after every other


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * _SPREAD[0]
    x = (x ^ (x >> U64(27))) * _SPREAD[1]
    return x ^ (x >> U64(31))


class Powers:
    """Powers of an odd multiplier modulo 2^64 and of its inverse, as long as needed."""

    def __init__(self, multiplier: int = _MULTIPLIER):
        self.multiplier, self.n = multiplier, 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 12)
            inverse = pow(self.multiplier, -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(self.n, m, U64)])) for m in (self.multiplier, inverse))
        return self.up[:n], self.down[:n]


def window_hashes(elements: np.ndarray, n: int, powers: Powers) -> np.ndarray:
    """Hash of every window of ``n`` elements, by differences of one running sum."""
    up, down = powers.upto(len(elements) + 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum((elements + U64(1)) * up[:len(elements)])])
    return mixed((total[n:] - total[:-n]) * down[:len(elements) - n + 1])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


@dataclass(frozen=True)
class Plan:
    """What an operator compares: windows of ``window`` elements, anchored by grams of ``gram``.

    ``parts(text)`` cuts a text into elements, ``values(parts)`` gives one 64-bit value per element, ``content(parts, a, b)`` is the
    payload of the elements from a to b.
    """

    window: int
    gram: int
    parts: Callable
    values: Callable
    content: Callable


def anchor_runs(plan: Plan, values: list[np.ndarray], powers: Powers) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, first window, last window) of every run of windows with one anchor."""
    lengths = np.array([len(v) for v in values], np.int64)
    total = int(lengths.sum())
    if total < plan.window:
        return tuple(np.zeros(0, t) for t in (np.int64, U64, np.int64, np.int64))
    hashes = window_hashes(np.concatenate(values), plan.gram, powers)
    mask = U64((1 << total.bit_length()) - 1)
    least = sliding_least((hashes & ~mask) | np.arange(len(hashes), dtype=U64), plan.window - plan.gram + 1)
    owner = np.repeat(np.arange(len(values), dtype=np.int32), lengths)
    inside = np.flatnonzero(owner[:total - plan.window + 1] == owner[plan.window - 1:])
    if not len(inside):
        return tuple(np.zeros(0, t) for t in (np.int64, U64, np.int64, np.int64))
    at = (least[inside] & mask).astype(np.int64)
    begin = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    end = np.concatenate([begin[1:], [len(at)]]) - 1
    doc = owner[inside[begin]].astype(np.int64)
    offset = np.cumsum(lengths) - lengths
    return doc, hashes[at[begin]], inside[begin] - offset[doc], inside[end] - offset[doc]


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return (mixed(hashes ^ U64(0x9E3779B97F4A7C15)) % U64(n)).astype(np.int64)


def local_documents(rows: pd.DataFrame) -> tuple[list[tuple[int, str]], np.ndarray]:
    """The distinct (order, text) of a block in order, the same in every stage; and each row's place in that list."""
    keys = list(zip(rows["ord"].tolist(), rows["text"].tolist()))
    docs = sorted(set(keys))
    place = {k: i for i, k in enumerate(docs)}
    return docs, np.array([place[k] for k in keys], np.int64)


def runs_of_block(plan: Plan, docs: list[tuple[int, str]]) -> Iterator[tuple]:
    """(first document of the batch, parts of its documents, runs) for batches of a bounded number of elements."""
    powers = Powers()
    parts: list = []
    first = held = 0
    for i, (_, text) in enumerate(docs):
        parts.append(plan.parts(text))
        held += len(parts[-1])
        if held >= BATCH or i == len(docs) - 1:
            yield first, parts, anchor_runs(plan, [plan.values(p) for p in parts], powers)
            parts, first, held = [], i + 1, 0


def by_bucket(hashes: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of the buckets that are met."""
    bucket = bucket_of(hashes, n)
    order = np.argsort(bucket, kind="stable")
    met, begin = np.unique(bucket[order], return_index=True)
    for b, a, e in zip(met.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)]):
        yield b, order[a:e]


def distinct_hashes(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of one document, hashes of several) of a block; ``docs`` ascends."""
    order = np.argsort(hashes, kind="stable")
    hashes, docs = hashes[order], docs[order]
    begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    end = np.concatenate([begin[1:], [len(hashes)]]).astype(np.int64) - 1 if len(hashes) else begin
    several = docs[begin] != docs[end]
    return hashes[begin[~several]], hashes[begin[several]]


SPANS = "block long, documents binary, starts binary, lengths binary, origins binary"


def in_blocks(docs: DataFrame, total_bytes: int, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """The (ord, text) rows dealt into blocks by document, and the number of blocks."""
    n = max(1, -(-total_bytes // block_bytes))
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n)
    block = F.pmod(F.xxhash64("ord"), F.lit(n)).cast("long").alias("block")
    return docs.select(block, "ord", "text").repartition(n_parts, "block"), n


def shared_chunks(rows: DataFrame, n: int, plan: Plan, once: bool = True) -> DataFrame:
    """Stages 1 to 3: one row per (bucket, block) with the chunks at anchors that several documents hold, laid end to end.

    ``once``: a chunk's content is sent once per block; what its later documents and places need is put into rows of their own
    (bucket below 0). Otherwise every occurrence is sent.
    """

    def anchors_of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = [(first + run[0], run[1]) for first, _, run in runs_of_block(plan, local_documents(pdf)[0])]
        one, several = distinct_hashes(*(np.concatenate([x[i] for x in found]) for i in (0, 1)))
        ones, severals = (dict(by_bucket(x, n)) for x in (one, several))
        none = np.zeros(0, np.int64)
        out = [(b, int(key[0]), one[ones.get(b, none)].tobytes(), several[severals.get(b, none)].tobytes()) for b in sorted(ones.keys() | severals.keys())]
        return pd.DataFrame(out, columns=["bucket", "block", "one", "several"])

    def repeated_of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ones = [np.frombuffer(x, U64) for x in pdf["one"]]
        several = np.concatenate([np.frombuffer(x, U64) for x in pdf["several"]])
        every = np.concatenate(ones)
        order = np.argsort(every, kind="stable")
        again = every[order[1:]] == every[order[:-1]]
        repeated = np.zeros(len(every), bool)
        repeated[order[1:][again]] = repeated[order[:-1][again]] = True
        repeated |= np.isin(every, several)
        edges = np.cumsum([0, *map(len, ones)])
        out = [(block, x[hit].tobytes()) for block, x, a, b in zip(pdf["block"], ones, edges, edges[1:]) if (hit := repeated[a:b]).any()]
        return pd.DataFrame(out, columns=["block", "hashes"])

    def chunks_of(key: tuple, pdf: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "block", "orders", "documents", "starts", "sizes", "contents"]
        if not len(pdf):
            return pd.DataFrame([], columns=columns)
        block = int(key[0])
        ordered = local_documents(pdf)[0]
        batches = list(runs_of_block(plan, ordered))
        doc = np.concatenate([first + r[0] for first, _, r in batches])
        hashes = np.concatenate([r[1] for _, _, r in batches])
        begin, end = (np.concatenate([r[i] for _, _, r in batches]) for i in (2, 3))
        shared = np.isin(hashes, np.concatenate([distinct_hashes(doc, hashes)[1], *[np.frombuffer(x, U64) for x in hits["hashes"]]]))
        parts = [p for _, x, _ in batches for p in x]
        seen: dict[bytes, int] = {}
        sent: list[int] = []
        contents: list[bytes] = []
        covered, again = [], []  # (document, start, elements[, first place])
        for i in np.flatnonzero(shared).tolist():
            d, a, e = int(doc[i]), int(begin[i]), int(end[i]) + plan.window
            content = plan.content(parts[d], a, e)
            at = seen.setdefault(content, i) if once else i
            if at == i or (d0 := int(doc[at])) != d and ordered[d0][0] == ordered[d][0]:
                sent.append(i)
                contents.append(content)
            elif d0 == d:
                again.append((d, a, e - a, int(begin[at])))
            else:
                covered.append((d, a, e - a, -1))
        out = []
        if covered or again:
            c = np.array(covered + again, np.int64)
            out.append((-1 - block, block, c[:, 3].tobytes(), c[:, 0].tobytes(), c[:, 1].tobytes(), c[:, 2].tobytes(), b""))
        if sent:
            orders = np.array([ordered[d][0] for d in doc[sent]], np.int64)
            documents, starts = doc[sent].astype(np.int32), begin[sent].astype(np.uint32)
            sizes = np.array([len(c) for c in contents], np.uint32)
            out += [(b, block, orders[o].tobytes(), documents[o].tobytes(), starts[o].tobytes(), sizes[o].tobytes(), b"".join([contents[i] for i in o]))
                    for b, o in by_bucket(hashes[sent], n)]
        return pd.DataFrame(out, columns=columns)

    n_parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    n_parts = max(int(n_parts), n)
    listed = rows.groupBy("block").applyInPandas(anchors_of, "bucket long, block long, one binary, several binary")
    hits = listed.groupBy("bucket").applyInPandas(repeated_of, "block long, hashes binary")
    return rows.groupBy("block").cogroup(hits.repartition(n_parts, "block").groupBy("block")).applyInPandas(
        chunks_of, "bucket long, block long, orders binary, documents binary, starts binary, sizes binary, contents binary")


def unpacked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(block, order, document, first element, content) of the chunks of a bucket."""
    orders, documents, starts, block, contents = [], [], [], [], []
    for row in pdf.itertuples(index=False):
        orders.append(np.frombuffer(row.orders, np.int64))
        documents.append(np.frombuffer(row.documents, np.int32))
        starts.append(np.frombuffer(row.starts, np.uint32).astype(np.int64))
        edges = np.concatenate([[0], np.cumsum(np.frombuffer(row.sizes, np.uint32), dtype=np.int64)]).tolist()
        contents += [row.contents[a:b] for a, b in zip(edges, edges[1:])]
        block.append(np.full(len(starts[-1]), row.block))
    return *map(np.concatenate, (block, orders, documents, starts)), contents


def covered_texts(rows: DataFrame, n: int, plan: Plan, compare: Callable, apply: Callable, result: str) -> DataFrame:
    """All stages. ``compare(orders, contents)`` returns arrays (chunk, offset, length) of the spans that an earlier document holds;
    ``apply(rows, spans)`` gets the rows of a block and, for each, its spans (starts, lengths)."""

    def spans_of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:  # judged in its block already
            return pd.DataFrame({"block": pdf["block"], "documents": pdf["documents"], "starts": pdf["starts"], "lengths": pdf["sizes"], "origins": pdf["orders"]})
        block, orders, documents, starts, contents = unpacked(pdf)
        chunk, offset, length = compare(orders, contents)
        out = []
        for b in np.unique(block[chunk]):
            mine = np.flatnonzero(block[chunk] == b)
            c = chunk[mine]
            out.append((b, documents[c].astype(np.int64).tobytes(), (starts[c] + offset[mine]).tobytes(), length[mine].astype(np.int64).tobytes(), b""))
        return pd.DataFrame(out, columns=["block", "documents", "starts", "lengths", "origins"])

    def finish(key: tuple, pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        ordered, place = local_documents(pdf)
        d, a, m = (np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, np.int64) for x in found[c]]]) for c in ("documents", "starts", "lengths"))
        origin = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, np.int64) if x else np.full(len(y) // 8, -1) for x, y in zip(found["origins"], found["starts"])]])
        plain = origin < 0
        extra = [spans_at_other_places(d, a, m, origin)] if not plain.all() else []
        d, a, m = (np.concatenate([x[plain], *[y[i] for y in extra]]) for i, x in enumerate((d, a, m)))
        order = np.lexsort((a, d))
        d, a, m = d[order], a[order], m[order]
        begin, end = np.searchsorted(d, np.arange(len(ordered))), np.searchsorted(d, np.arange(len(ordered)), side="right")
        return apply(pdf, [(a[begin[p]:end[p]], m[begin[p]:end[p]]) for p in place])

    n_parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n)
    spans = shared_chunks(rows, n, plan).groupBy("bucket").applyInPandas(spans_of, SPANS)
    return rows.groupBy("block").cogroup(spans.repartition(n_parts, "block").groupBy("block")).applyInPandas(finish, result)


def spans_at_other_places(d: np.ndarray, a: np.ndarray, m: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans inside a chunk, moved to the other places of that chunk in its document (rows with an origin)."""
    plain = np.flatnonzero(origin < 0)
    plain = plain[np.lexsort((a[plain], d[plain]))]
    place = np.flatnonzero(origin >= 0)
    order = np.lexsort((origin[place], d[place]))
    place = place[order]
    key = d * (int(max(a.max(), origin.max())) + 1)
    begin = np.searchsorted(key[plain] + a[plain], key[place] + origin[place])
    end = np.searchsorted(key[plain] + a[plain], key[place] + origin[place] + m[place])
    counts = end - begin
    which = np.repeat(np.arange(len(place)), counts)
    span = plain[np.repeat(begin, counts) + np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)]
    p = place[which]
    inside = (d[span] == d[p]) & (a[span] + m[span] <= origin[p] + m[p])
    return d[p][inside], (a[span] - origin[p] + a[p])[inside], m[span][inside]


def union_of(starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by spans sorted by start."""
    out: list[list[int]] = []
    for a, b in zip(starts.tolist(), (starts + lengths).tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_copies(docs: DataFrame, key: str = "text") -> tuple[DataFrame, int]:
    """(doc_id, ord, text, n_bytes, copied) per row and the bytes of the rows that are no copies.

    ``copied``: the whole text is that of a row of smaller order. Copies are told by MD5 and length, in small rows.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"), F.coalesce(F.col(key), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary"))).withColumn("n_bytes", F.octet_length("text").cast("long"))
    seen = materialize(rows.select("ord", "digest", "n_bytes").distinct(), "digests")
    many = seen.groupBy("digest", "n_bytes").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).filter("first <> last")
    many = materialize(many.select(F.col("digest").alias("m_digest"), F.col("n_bytes").alias("m_bytes"), F.col("first").alias("m_first")), "many")
    total = seen.join(many, (F.col("digest") == F.col("m_digest")) & (F.col("n_bytes") == F.col("m_bytes")), "left").filter(
        "m_first IS NULL OR m_first = ord").agg(F.sum("n_bytes")).first()[0] or 0
    joined = lookup(rows, many, (F.col("digest") == F.col("m_digest")) & (F.col("n_bytes") == F.col("m_bytes")), "left")
    return joined.select("doc_id", "ord", "text", "n_bytes", F.coalesce(F.col("m_first") < F.col("ord"), F.lit(False)).alias("copied")), int(total)
