"""Ranked lexical search: the k best documents of each query, by best-first search over intervals of documents.

The score of a document is the sum of its impacts over the query's terms (see ``impact``). Tasks cut what they read into shards of
bounded size, ordered by doc_id. In a shard every term has a posting list with the impacts, and over each list a sparse table of
range maxima: two look-ups give the largest impact of a term in any interval of documents. The sum over the query's terms bounds
every document of the interval. The search takes the intervals with the largest bounds first, splits each at the document of its
largest single impact, scores that document exactly and bounds the two rests; it ends when no bound reaches the k-th best score.
Many intervals are taken at once, so that the look-ups are numpy gathers over (intervals x terms).

1. The query terms go to the tasks, ``BLOCK_ITEMS`` queries at a time, so what is broadcast is bounded however many queries there
   are. One scan of the texts leaves (doc_id, n, terms, counts) of the query terms in each document.
2. N, L and the document frequencies are sums over that table, combined per task.
3. Each shard gives the exact scores of the documents it meets in the first ``SEED_ROUNDS`` rounds; the k-th best of all is a bound
   from below for the result.
4. The full search starts from that bound. A task hands over at most k documents a query; the least k of (score, doc_id) are the result.

No document is left out by 3: it only tells the search how early it may stop. Documents are never shuffled, a frequent term is
split over the shards, and equal scores (copies) are cut off by doc_id. A shard may be as large as memory allows; results do not
depend on it.

Defined results: null texts and texts without a term count nowhere; rows that repeat a doc_id are documents of their own, each with its
rank; a row without doc_id ranks after all others of its score; rows that repeat an item_id (or lack one) are one query with the
terms of all its texts; a query whose terms no document holds has no rows; weights are at least 0, and documents with score 0 are not
returned; empty tables give an empty table. Of the documents only doc_id and text are read, of the queries item_id and text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import documents, materialize, oracle, query

TOP = 50
BLOCK_ITEMS = 1024            # queries per pass; at 50 terms of 10 bytes each, 0.5 MB of terms
SHARD_DOCS, SHARD_POSTINGS, SHARD_RANKS = 4096, 1 << 20, 1 << 25
BATCH_INTERVALS = 64
SEED_ROUNDS = 7
LAST_ID = np.iinfo(np.int64).max  # stands for a missing doc_id, which ranks last

#: bytes of UTF-8 to terms: A-Z become a-z, other ASCII than letters and digits becomes a blank, all else stays
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order, as UTF-8; only A-Z are lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(weight, tf, n, n_docs: int, n_terms: int):
    """What a term adds to the score of a document in which it occurs ``tf`` times among ``n`` terms; all integers."""
    m = 50 + (50 * n * n_docs) // n_terms
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


# ---- the index of one shard

@dataclass
class Shard:
    """Posting lists laid end to end: list t is [start[t], start[t + 1])."""
    doc_ids: np.ndarray       # ascending
    start: np.ndarray
    doc: np.ndarray           # position of the document of each posting
    value: np.ndarray         # impact of each posting
    rank: np.ndarray          # rank[t, d]: postings of t before document d
    best: list[np.ndarray]    # sparse table: best[j][p] is the posting of the largest value in [p, p + 2^j), the first of equal ones


def build_shard(doc_ids: np.ndarray, n: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int) -> Shard:
    """Index of documents (terms, counts); ``weights`` by term."""
    order = np.argsort(doc_ids, kind="stable")
    lengths = np.array([len(rows[i][0]) for i in order], np.int64)
    doc = np.repeat(np.arange(len(order)), lengths)
    term = np.concatenate([rows[i][0] for i in order]).astype(np.int64)
    tf = np.concatenate([rows[i][1] for i in order]).astype(np.int64)
    value = impact(weights[term], tf, n[order].astype(np.int64)[doc], n_docs, n_terms)
    place = np.argsort(term, kind="stable")
    term, doc, value = term[place], doc[place].astype(np.int32), value[place]
    held = np.bincount(term, minlength=len(weights))
    start = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
    rank = np.zeros((len(weights), len(order) + 1), np.int16 if len(order) < 1 << 15 else np.int32)
    rank[term, doc + 1] = 1
    np.cumsum(rank, axis=1, out=rank)
    best, width = [np.arange(len(value), dtype=np.int32)], 1
    while 2 * width <= held.max(initial=0):
        left, right = best[-1][:-width], best[-1][width:]
        best.append(np.where(value[left] >= value[right], left, right))
        width *= 2
    return Shard(doc_ids[order], start, doc, value, rank, best)


def interval_bounds(shard: Shard, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per interval [low, high) of documents the sum of the terms' largest impacts, and the document of the largest of all (-1: none)."""
    base, own = shard.start[terms][None, :], shard.rank[terms]
    first = own[:, low].T
    count = own[:, high].T - first
    first = first + base
    level = np.frexp(np.maximum(count, 1))[1] - 1
    table = _stacked(shard)
    left = table[level, first * (count > 0)]
    right = table[level, np.where(count > 0, first + count - (1 << level), 0)]
    top = np.where(shard.value[left] >= shard.value[right], left, right)
    value = np.where(count > 0, shard.value[top], 0)
    widest = value.argmax(axis=1)
    rows = np.arange(len(low))
    split = np.where(value[rows, widest] > 0, shard.doc[top[rows, widest]], -1)
    return value.sum(axis=1), split


def _stacked(shard: Shard) -> np.ndarray:
    """The sparse table as one matrix; a level's missing tail is never asked for."""
    if isinstance(shard.best, list):
        table = np.zeros((len(shard.best), len(shard.value)), np.int32)
        for j, row in enumerate(shard.best):
            table[j, :len(row)] = row
        shard.best = table
    return shard.best


def exact_scores(shard: Shard, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
    at = shard.rank[terms][:, docs]
    held = shard.rank[terms][:, docs + 1] > at
    return np.where(held, shard.value[np.where(held, at + shard.start[terms][:, None], 0)], 0).sum(axis=0)


def search_shard(shard: Shard, terms: np.ndarray, top: int, floor: tuple[int, int] = (0, -1), rounds: int | None = None) -> list[tuple[int, int]]:
    """The best (score, doc_id) of a shard, at most ``top`` of them, best first; equal scores by ascending doc_id.

    ``floor`` is a (score, doc_id) that the k-th result is known to reach; what ranks after it is not returned. With ``rounds`` the search stops
    early, and the scores are those of some documents.
    """
    low, high = np.zeros(1, np.int64), np.full(1, len(shard.doc_ids))
    bound, split = interval_bounds(shard, terms, low, high)
    found_score, found_id = np.zeros(0, np.int64), np.zeros(0, np.int64)
    done = 0
    while len(low) and (rounds is None or done < rounds):
        if len(found_score) >= top:
            floor = max(floor, (int(found_score[top - 1]), int(found_id[top - 1])), key=lambda x: (x[0], -x[1]))
        # an interval stays while its bound beats the floor; at the floor's score, while it begins before the floor's doc_id
        ids = shard.doc_ids[low]
        alive = (split >= 0) & ((bound > floor[0]) | ((bound == floor[0]) & (ids <= floor[1])))
        low, high, bound, split = low[alive], high[alive], bound[alive], split[alive]
        if not len(low):
            break
        if len(low) > BATCH_INTERVALS:
            order = np.lexsort((low, -bound))
            now, later = order[:BATCH_INTERVALS], order[BATCH_INTERVALS:]
        else:
            now, later = np.arange(len(low)), np.zeros(0, np.int64)
        at = split[now].astype(np.int64)
        score = exact_scores(shard, terms, at)
        score_all, id_all = np.concatenate([found_score, score]), np.concatenate([found_id, shard.doc_ids[at]])
        order = np.lexsort((id_all, -score_all))[:top]
        found_score, found_id = score_all[order], id_all[order]
        new_low, new_high = np.concatenate([low[now], at + 1]), np.concatenate([at, high[now]])
        some = new_low < new_high
        new_low, new_high = new_low[some], new_high[some]
        if len(new_low):
            new_bound, new_split = interval_bounds(shard, terms, new_low, new_high)
        else:
            new_bound, new_split = np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = np.concatenate([low[later], new_low]), np.concatenate([high[later], new_high])
        bound, split = np.concatenate([bound[later], new_bound]), np.concatenate([split[later], new_split])
        done += 1
    keep = (found_score > floor[0]) | ((found_score == floor[0]) & (found_id <= floor[1]))
    keep &= found_score > 0
    return list(zip(found_score[keep].tolist(), found_id[keep].tolist()))


# ---- the jobs

def count_terms(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term: the vocabulary's terms it holds, packed as 32-bit numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {t: i for i, t in enumerate(shared.value)}
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                found = terms_of(text)
                if found:
                    held = sorted((number[t], c) for t, c in Counter(found).items() if t in number)
                    both = np.array(held, np.int32).reshape(-1, 2)
                    out.append((doc_id, len(found), both[:, 0].tobytes(), both[:, 1].tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "n", "terms", "counts"])

    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST_ID))).alias("doc_id"), "text")
    return slim.mapInPandas(rows, "doc_id long, n long, terms binary, counts binary")


def document_frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term; every task sends one count per term at most."""
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(np.frombuffer(b"".join(batch["terms"]), np.int32), minlength=size)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "df": total[at]})

    found = counted.select("terms").mapInPandas(sums, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()  # the vocabulary at most
    df = np.zeros(size, np.int64)
    df[found["term"].to_numpy(np.int64)] = found["df"].to_numpy(np.int64)
    return df


def shards_of(batches: Iterator[pd.DataFrame], weights: np.ndarray, n_docs: int, n_terms: int) -> Iterator[Shard]:
    ids, ns, rows, held = [], [], [], 0
    most = max(64, min(SHARD_DOCS, SHARD_RANKS // len(weights)))
    for batch in batches:
        for doc_id, n, terms, counts in zip(batch["doc_id"].tolist(), batch["n"].tolist(), batch["terms"], batch["counts"]):
            if not terms:
                continue
            ids.append(doc_id)
            ns.append(n)
            rows.append((np.frombuffer(terms, np.int32), np.frombuffer(counts, np.int32)))
            held += len(terms) // 4
            if len(ids) >= most or held >= SHARD_POSTINGS:
                yield build_shard(np.array(ids, np.int64), np.array(ns, np.int64), rows, weights, n_docs, n_terms)
                ids, ns, rows, held = [], [], [], 0
    if ids:
        yield build_shard(np.array(ids, np.int64), np.array(ns, np.int64), rows, weights, n_docs, n_terms)


def scored(counted: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, top: int,
           floors: list[tuple[int, int]] | None = None) -> DataFrame:
    """(item, doc_id, score): the best documents of every task for each item, or, without ``floors``, those of the first rounds."""
    shared = counted.sparkSession.sparkContext.broadcast((items, weights, floors))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms_by_item, w, given = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in terms_by_item]
        limits = list(given) if given else [(0, -1)] * len(terms_by_item)
        for shard in shards_of(batches, w, n_docs, n_terms):
            for i, terms in enumerate(terms_by_item):
                if len(terms):
                    new = search_shard(shard, terms, top, limits[i], None if given else SEED_ROUNDS)
                    if new:
                        best[i] = sorted(best[i] + new, key=lambda x: (-x[0], x[1]))[:top]
                        if len(best[i]) == top:
                            limits[i] = max(limits[i], best[i][-1], key=lambda x: (x[0], -x[1]))
        out = [(i, doc_id, score) for i, found in enumerate(best) for score, doc_id in found]
        yield pd.DataFrame(out, columns=["item", "doc_id", "score"]).astype("int64")

    return counted.mapInPandas(rows, "item long, doc_id long, score long")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each item, with their rank; tasks keep their own first ``top`` before the shuffle."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every item."""
    spark = docs.sparkSession
    items = items.select("item_id", "text")
    kind = items.schema["item_id"].dataType
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    spot = F.pmod(F.coalesce(F.xxhash64("item_id"), F.lit(0)), F.lit(blocks))
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    for k in range(blocks):
        texts: dict = {}
        for row in items.filter(spot == k).toLocalIterator():
            texts.setdefault(row.item_id, set()).update(terms_of(row.text))
        vocabulary = sorted(set().union(*texts.values()))
        if not vocabulary:
            continue
        number = {t: i for i, t in enumerate(vocabulary)}
        names = list(texts)
        counted = materialize(count_terms(docs, vocabulary), "term-counts")
        n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        df = document_frequencies(counted, len(vocabulary))
        weights = np.array([term_weight(n_docs, int(x)) if x else 0 for x in df], np.int64)
        terms = [np.array(sorted(j for t in texts[i] if df[j := number[t]] and weights[j]), np.int64) for i in names]
        floors = [(0, -1)] * len(names)
        for row in ranked(scored(counted, terms, weights, n_docs, n_terms, top), top).filter(F.col("rank") == top).collect():  # one row per item
            floors[row.item] = (row.score, row.doc_id)
        found = ranked(scored(counted, terms, weights, n_docs, n_terms, top, floors), top)
        named = spark.createDataFrame([(i, x) for i, x in enumerate(names)], f"item long, item_id {kind.simpleString()}").coalesce(1)
        found = found.join(F.broadcast(named), "item")  # BLOCK_ITEMS rows at most
        out = out.unionByName(found.select("item_id", "rank", F.when(F.col("doc_id") != int(LAST_ID), F.col("doc_id")).alias("doc_id"), "score"))
    return out


@query("op12_search_documents")
def op12_search_documents(spark, sf_dir):
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

# every document is scored in full
oracle("op12_search_documents", f"""
WITH rows_of AS (SELECT row_number() OVER () AS d, doc_id, text FROM documents),
words AS (SELECT d, doc_id, {_TERMS} AS term FROM rows_of),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} AS term FROM benchmark)),
sizes AS (SELECT d, count(*) AS n FROM words GROUP BY d),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
held AS (SELECT d, doc_id, term, count(*) AS tf FROM words SEMI JOIN asked USING (term) GROUP BY ALL),
weighed AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, total GROUP BY term, n_docs),
impacts AS (SELECT d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS impact
    FROM held JOIN weighed USING (term) JOIN sizes USING (d), total),
scores AS (SELECT item_id, d, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM impacts JOIN asked USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER best AS INT) AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= {TOP}""")
