"""Near-duplicates of weighted word shingles by ProbMinHash, banding and exact verification.

A document is the multiset of its 5-word shingles (a shorter one is a single shingle of all its words). Similarity is the
probability Jaccard index  J(a, b) = sum over x of 1 / sum over y of max(a_y / a_x, b_y / b_x),  the plain Jaccard index where no
shingle repeats. Each shingle is a Poisson process whose rate is its weight and whose arrivals fall on random registers; a
register keeps the shingle of its earliest arrival, and a process stops as soon as its next arrival is later than every
register's. Two documents agree in a register with probability J. Bands of four registers make candidates; every link is
verified on the texts.

* Copies (equal word sequences) are one node from the start and never meet in a bucket.
* Each bucket first links its members to its smallest member, its leader. Leaders whose members are then still of several
  components are searched for links between components, in blocks: signatures are compared where the rows meet, the
  likeliest pairs are verified there, and only links that connect leave the task. No candidate between components is skipped,
  and a bucket of thousands of near copies costs one pair per member.
* A pair whose signatures agree in less than ``FLOOR`` of the registers is not verified in that search; at similarity 0.8
  this has probability below 1e-6. At 0.8 no band agrees with probability 5e-8.

Defined results: a null or empty text has no shingle and is a class of its own; rows that repeat a ``doc_id`` are one document,
whose links are those of all its texts; a null ``doc_id`` cannot name a class: its row has a null class and no links; an
empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.components import connected_components
from trackloom.llm.common import documents, lookup, materialize, pack, query, unpack, words

SHINGLE = 5
REGISTERS, BAND = 128, 4
THRESHOLD = 0.8
FLOOR = 0.62
BLOCK = 1024
SHARD_ROWS = 8192
FEW = 4                 # partners that a probe compares one by one
BATCH_WORDS = 1 << 16   # words that are signed at once; a longer text goes alone
SLICE_ROWS = 256        # rows of an Arrow batch that are Python objects at a time

U64 = np.uint64
_STEP, _A, _B, _P = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x100000001B3)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * _A
    x = (x ^ (x >> U64(27))) * _B
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """64-bit hash of a word, remembered for a few words: frequent ones come back soon, and a worker's memory stays small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 14:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles_of(docs: list[list[bytes]], known: WordHashes) -> list[np.ndarray]:
    """Per document the hash of each of its shingles, in order, with repeats; all texts are hashed at once."""
    lengths = [len(d) for d in docs]
    ids = np.fromiter(map(known.__getitem__, chain.from_iterable(docs)), U64, sum(lengths))

    def hashed(ids: np.ndarray, n: int) -> np.ndarray:
        m = max(0, len(ids) - n + 1)
        h = np.full(m, n, U64)
        for i in range(n):
            h = mixed(h * _P + ids[i:i + m])
        return h

    every, out, at = hashed(ids, SHINGLE), [], 0
    for k in lengths:
        out.append(every[at:at + k - SHINGLE + 1] if k >= SHINGLE else hashed(ids[at:at + k], k)[:1] if k else np.zeros(0, U64))
        at += k
    return out


def weighted(text: str | None, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles, weights) of one text."""
    return np.unique(shingles_of([words(text)], known)[0], return_counts=True)


def signatures(docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(documents x registers) of the (distinct shingles, weights) of each document; all need at least one shingle."""
    n, m = len(docs), REGISTERS
    item = np.concatenate([x for x, _ in docs])
    weight = np.concatenate([w for _, w in docs]).astype(float)
    owner = np.repeat(np.arange(n), [len(x) for x, _ in docs])
    first = np.full(n * m, np.inf)
    found = np.zeros(n * m, U64)
    time, draw = np.zeros(len(item)), item.copy()
    live = np.arange(len(item))
    while len(live):
        # the next arrival of every live process, and the register it falls on
        draw[live] += _STEP
        bits = mixed(draw[live])
        time[live] -= np.log1p(-((bits >> U64(11)).astype(float) * 2.0 ** -53)) / weight[live]
        at = owner[live] * m + (bits & U64(m - 1)).astype(np.int64)
        np.minimum.at(first, at, time[live])
        wins = first[at] == time[live]
        found[at[wins]] = item[live[wins]]
        docs_live = np.unique(owner[live])
        latest = np.zeros(n)
        latest[docs_live] = first.reshape(n, m)[docs_live].max(axis=1)
        live = live[time[live] < latest[owner[live]]]
    return (mixed(found) & U64(0xFFFFFFFF)).astype(np.uint32).reshape(n, m)


def _sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        rows: list[tuple[int, list[bytes]]] = []
        held = 0
        for at in range(0, batch.num_rows, SLICE_ROWS):
            piece = batch.slice(at, SLICE_ROWS)
            for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).cast(pa.binary()).to_pylist()):
                parts = text.split()  # at exactly the six ASCII blanks
                if parts:
                    rows.append((doc_id, parts))
                    held += len(parts)
                if held > BATCH_WORDS:
                    yield _signed(rows, known)
                    rows, held = [], 0
        if rows:
            yield _signed(rows, known)


def _signed(rows: list[tuple[int, list[bytes]]], known: WordHashes) -> pa.RecordBatch:
    docs = [parts for _, parts in rows]
    keys = np.array([np.frombuffer(hashlib.blake2b(b" ".join(p), digest_size=16).digest(), np.int64) for p in docs])
    sig = signatures([np.unique(x, return_counts=True) for x in shingles_of(docs, known)])
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                                       pa.array([s.tobytes() for s in sig], pa.binary())], ["doc_id", "k1", "k2", "sig"])


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, sig): the key of the word sequence and the signature of every document with a word."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(_sign_batches, "doc_id long, k1 long, k2 long, sig binary")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two (sorted distinct shingles, weights)."""
    every = np.union1d(a[0], b[0])
    wa, wb = np.zeros(len(every)), np.zeros(len(every))
    wa[np.searchsorted(every, a[0])] = a[1]
    wb[np.searchsorted(every, b[0])] = b[1]
    both = (wa > 0) & (wb > 0)
    if not both.any():
        return 0.0
    # for x, the y whose a_y / b_y exceeds a_x / b_x count a_y / a_x, the others b_y / b_x
    with np.errstate(divide="ignore"):
        ratio = np.where(wb > 0, wa / np.where(wb > 0, wb, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    above_a = wa.sum() - np.concatenate([[0], np.cumsum(wa[order])])
    below_b = np.concatenate([[0], np.cumsum(wb[order])])
    at = np.searchsorted(ratio[order], ratio[both], side="right")
    return float((1.0 / (above_a[at] / wa[both] + below_b[at] / wb[both])).sum())


class Members:
    """The shingles of many texts as codes, to find the texts that one of them may be similar to in few passes."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        sizes = [len(x) for x, _ in sets]
        shingles, codes = np.unique(np.concatenate([x for x, _ in sets]), return_inverse=True)
        self.shingles = np.append(shingles, U64(0))  # the last is where a search for an unknown one may end
        self.values, ranks = np.unique(np.concatenate([w for _, w in sets]), return_inverse=True)
        cuts = np.cumsum(sizes)[:-1]
        self.codes, self.ranks = np.split(codes, cuts), np.split(ranks, cuts)
        self.weight = np.zeros(len(self.shingles), np.int64)  # of the text that is compared: the rank of its weight, 0 for none

    def similarities(self, a: tuple[np.ndarray, np.ndarray], of: np.ndarray) -> np.ndarray:
        """``similarity`` of a text and each of the members ``of``, up to rounding.

        Shingles with the same two weights count alike, so it takes only the number of each such pair of weights.
        """
        values = np.append(0, np.unique(a[1]))
        spot = np.searchsorted(self.shingles[:-1], a[0])
        there = self.shingles[spot] == a[0]
        self.weight[spot[there]] = np.searchsorted(values, a[1][there])
        codes = np.concatenate([self.codes[j] for j in of])
        kind = self.weight[codes] * len(self.values) + np.concatenate([self.ranks[j] for j in of])
        self.weight[spot] = 0
        kinds = np.flatnonzero(np.bincount(kind))
        wa, wb = values[kinds // len(self.values)], self.values[kinds % len(self.values)]
        order = np.argsort(wa / wb, kind="stable")
        kinds, wa, wb = kinds[order], wa[order], wb[order]
        place = np.zeros(kinds.max(initial=0) + 1, np.int64)
        place[kinds] = np.arange(len(kinds))
        last = np.searchsorted(wa / wb, wa / wb, side="right") - 1  # equal ratios count together
        both = wa > 0
        bounds = np.concatenate([[0], np.cumsum([len(self.codes[j]) for j in of])])
        out, step = [], max(1, (1 << 20) // max(1, len(kinds)))
        for at in range(0, len(of), step):
            ends = bounds[at:at + step + 1]
            owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            n = np.bincount(owner * len(kinds) + place[kind[ends[0]:ends[-1]]], minlength=(len(ends) - 1) * len(kinds)).reshape(len(ends) - 1, -1)
            above_a = (a[1].sum() - np.cumsum(n * wa, axis=1))[:, last]
            below_b = np.cumsum(n * wb, axis=1)[:, last]
            whole = above_a[:, both] / wa[both] + below_b[:, both] / wb[both]
            out.append((n[:, both] / np.maximum(whole, 1e-9)).sum(axis=1))
        return np.concatenate(out)


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, recent = WordHashes(), OrderedDict()

    def of(text: str):
        if text not in recent:
            recent[text] = weighted(text, known)
            if len(recent) > 64:
                recent.popitem(last=False)
        return recent[text]

    for batch in batches:
        # a pair's texts are Python objects only while they are compared
        j = [similarity(of(x.as_py()), of(y.as_py())) for x, y in zip(batch.column(2), batch.column(3))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(j, pa.float64())], ["a", "b", "similarity"])


def verified(pairs: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The (a, b) pairs whose texts are similar enough, with their similarity; stored. Only texts of the pairs are shuffled."""
    ids = materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    texts = materialize(lookup(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL"), ids, "doc_id", "left_semi"), "texts")
    side = lambda n: texts.select(F.col("doc_id").alias(n), F.col("text").alias(f"text_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return materialize(both.mapInArrow(_verify_batches, "a long, b long, similarity double").filter(F.col("similarity") >= threshold), "links")


def _group_links(rows: pd.DataFrame, threshold: float, known: WordHashes) -> list[tuple[int, int]]:
    """Links between different components among the probes and the members of one part of a leader's group.

    A pair is looked at under the first leader it shares. The likeliest partners come first, and a partner that a link
    found here has connected meanwhile is passed over, so at most one link per member comes out. A doc_id with several texts has
    a row for each, and all are looked at.
    """
    base, probes = rows[rows["in_base"]], rows[rows["probe"]]
    if base.empty or probes.empty:
        return []
    sig = np.frombuffer(b"".join(base["sig"]), np.uint32).reshape(-1, REGISTERS)
    ids, labels, minor = base["doc_id"].to_numpy(), base["label"].to_numpy(), (base["label"] != base["largest"]).to_numpy()
    leader = int(rows["leader"].iloc[0])
    earlier = {i: frozenset(x for x in r if x < leader) for i, r in zip(rows["doc_id"], rows["leaders"])}
    base_texts, probe_texts = base["text"].tolist(), probes["text"].tolist()
    sets: dict[str, tuple] = {}
    joined: dict[int, int] = {}

    def root(label: int) -> int:
        while (up := joined.get(label, label)) != label:
            label = up
        return label

    def of(text: str):
        if text not in sets:
            x, w = weighted(text, known)
            sets[text] = (x, w, frozenset(x.tolist()) if w.max(initial=1) == 1 else None)
        return sets[text]

    likely = []
    for i, label, own in zip(probes["doc_id"].tolist(), probes["label"].tolist(), probes["sig"]):
        agree = (sig == np.frombuffer(own, np.uint32)).sum(axis=1)
        # a pair of two probes is met from either side: once is enough
        at = np.flatnonzero((agree >= FLOOR * REGISTERS) & (labels != label) & (~minor | (ids > i)))
        likely.append(at[np.argsort(-agree[at], kind="stable")])
    many = [at for at in likely if len(at) > FEW]
    if many:
        met = np.unique(np.concatenate(many))
        members, place = Members([of(base_texts[j])[:2] for j in met.tolist()]), np.zeros(len(ids), np.int64)
        place[met] = np.arange(len(met))
    out = []
    for i, label, text, at in zip(probes["doc_id"].tolist(), probes["label"].tolist(), probe_texts, likely):
        if len(at) > FEW:
            # what is clearly below the threshold goes; what stays is compared exactly
            at = at[members.similarities(of(text)[:2], place[at]) >= threshold - 1e-6]
        for j in at.tolist():
            other, other_label = int(ids[j]), int(labels[j])
            if root(label) == root(other_label) or not earlier[i].isdisjoint(earlier[other]):
                continue
            a, b = of(text), of(base_texts[j])
            if a[2] is not None and b[2] is not None:
                both = len(a[2] & b[2])
                close = both >= threshold * (len(a[2]) + len(b[2]) - both)
            else:
                close = similarity(a[:2], b[:2]) >= threshold
            if close:
                joined[root(other_label)] = root(label)
                out.append((min(i, other), max(i, other)))
    return out


def _between_components(shared: DataFrame, labels: DataFrame, signed: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between components that members of one bucket have.

    Buckets with the same smallest member are searched together. The members outside a group's largest component are its probes;
    they meet all members in blocks. Pairs are compared where they meet; only links leave the task.
    """
    spark = docs.sparkSession
    rows = shared.join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select(
        "leader", "doc_id", F.coalesce("component", "doc_id").alias("label")).distinct()
    rows = materialize(rows, "labelled")
    counts = rows.groupBy("leader", "label").agg(F.count(F.lit(1)).alias("n"))
    several = counts.groupBy("leader").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("members"),
                                           F.max(F.struct("n", "label"))["label"].alias("largest")).filter("labels > 1").drop("labels")
    rows = materialize(rows.join(materialize(several, "several"), "leader"), "open")
    leaders = rows.groupBy("doc_id").agg(F.collect_set("leader").alias("leaders"))  # one per band at most
    ids = materialize(leaders, "open-ids")
    texts = lookup(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL"), ids.select("doc_id"), "doc_id", "left_semi")
    known = materialize(texts.join(signed.select("doc_id", "sig"), "doc_id").join(ids, "doc_id"), "open-texts")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    spot = F.pmod(F.hash("doc_id"), F.lit(1 << 20))
    rows = rows.withColumn("blocks", blocks).withColumn("probe", F.col("label") != F.col("largest"))
    small = rows.filter("blocks = 1").select("*", F.lit(True).alias("in_base"), F.lit(0).alias("block"), F.lit(0).alias("part"))
    large = rows.filter("blocks > 1")
    count = F.sequence(F.lit(0), F.col("blocks") - 1)
    base = large.withColumn("probe", F.lit(False)).select("*", F.lit(True).alias("in_base"), (spot % F.col("blocks")).alias("block"), F.explode(count).alias("part"))
    probes = large.filter("probe").select("*", F.lit(False).alias("in_base"), F.explode(count).alias("block"), (spot % F.col("blocks")).alias("part"))
    parts = materialize(small.unionByName(base).unionByName(probes), "parts")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-parts.count() // SHARD_ROWS))
    keyed = parts.join(known, "doc_id").withColumn("shard", F.pmod(F.xxhash64("leader", "block", "part"), F.lit(shards)))

    def links_of(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHashes()
        found = {x for _, rows in pdf.groupby(["leader", "block", "part"]) for x in _group_links(rows, threshold, hashes)}
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    found = keyed.select("shard", "leader", "block", "part", "doc_id", "label", "largest", "probe", "in_base", "sig", "leaders", "text").groupBy(
        "shard").applyInPandas(links_of, "a long, b long")
    return materialize(found.distinct(), "found")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with rows that repeat both taken once; texts are shuffled only where a doc_id has several rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    again = rows.groupBy(F.col("doc_id").alias("again_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = materialize(again, "again")
    if not again.take(1):
        return rows
    same = F.col("doc_id") == F.col("again_id")
    return materialize(rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").distinct()), "texts-once")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) of every row: documents linked by similarity of at least ``threshold`` share the smallest ``doc_id``."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    docs = distinct_texts(docs)
    signed = materialize(sign(docs), "signed")
    copies = signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    copies = materialize(copies, "copies")
    owners = materialize(signed.select("doc_id", "k1", "k2").join(copies, ["k1", "k2"]).select("doc_id", "first").distinct(), "owners")
    later = owners.filter("doc_id <> first").select("doc_id")
    nodes = signed
    if later.take(1):
        nodes = signed.join(later, "doc_id", "left_anti")
        # only the copied text leaves: other texts of its doc_id, if any, stay in the search
        others = signed.select("doc_id", "k1", "k2").join(later, "doc_id", "left_semi").join(copies, ["k1", "k2"], "left").filter(
            "first IS NULL OR first = doc_id").select("doc_id", "k1", "k2").distinct()
        others = materialize(others, "others")
        if others.take(1):
            nodes = nodes.unionByName(signed.join(others, ["doc_id", "k1", "k2"], "left_semi"))
    n_bands = REGISTERS // BAND
    bands = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)),
                        lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * (4 * BAND) + 1, F.lit(4 * BAND))))
    rows = materialize(nodes.select("doc_id", F.explode(bands).alias("bucket")), "bands")
    leaders = rows.groupBy("bucket").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).filter("leader <> last")
    shared = materialize(rows.join(materialize(leaders.select("bucket", "leader"), "leaders"), "bucket"), "shared")
    pairs = shared.filter("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = verified(materialize(pairs, "pairs"), docs, threshold).select("a", "b")
    # copies whose doc_id is met with several texts join their classes here
    tied = owners.filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    labels = materialize(connected_components(links), "labels")
    links = links.unionByName(_between_components(shared.select("leader", "doc_id"), labels, nodes, docs, threshold))
    labels = materialize(connected_components(links.unionByName(tied)), "classes")
    return lookup(ids, labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one with the smallest ``doc_id``, and one row of it; rows without ``doc_id`` stay."""
    gone = materialize(near_duplicates(docs, threshold).filter("doc_id <> class_id").select(F.col("doc_id").alias("g_id")).distinct(), "gone")
    rows = pack(docs, p_id=F.col("doc_id").cast("long"))
    kept = lookup(rows, gone, F.col("p_id") == F.col("g_id"), "left_anti")
    again = materialize(rows.groupBy(F.col("p_id").alias("r_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND r_id IS NOT NULL").drop("n"), "again")
    if not again.take(1):
        return unpack(kept)
    same = F.col("p_id") == F.col("r_id")
    return unpack(lookup(kept, again, same, "left_anti").unionByName(lookup(kept, again, same, "left_semi").dropDuplicates(["p_id"])))


@query("op3_near_duplicates")
def op3_near_duplicates(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))
