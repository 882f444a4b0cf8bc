"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words is trained from confirmed toxic texts (P) and unlabelled texts (U). With class prior p
and logistic loss l, the risk is  p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)]):  the second bracket is the risk on
negatives, estimated without any negative label; where it turns negative the model has begun to memorise, and the step
is reversed. The model is fitted on a bounded sample (``max_positive``, ``max_unlabelled``, chosen by hash of the
document id); every document is scored from its whole text.

Defined results: a null or empty text scores as a text without words; the score depends on the text alone, so repeated rows
score alike; labels of unknown or null documents are ignored, a document labelled more than once is toxic if any of its
labels says so; without any positive label all scores are the prior (0.5 at most). Extra columns are passed through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import documents, pack, query, unpack

TOKEN = re.compile(r"\w+")
BUCKETS = 1 << 16
MAX_POSITIVE, MAX_UNLABELLED = 4096, 12288
THRESHOLD = 0.7


def token_buckets(text: str | None, known: dict[str, int]) -> np.ndarray:
    """Distinct buckets of a text's words in lower case; ``known`` keeps buckets of words met before."""
    found = set(TOKEN.findall(text.lower())) if text else ()
    if len(known) >= 1 << 14:
        known.clear()
    ids = set()
    for w in found:
        b = known.get(w)
        if b is None:
            b = known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
        ids.add(b)
    return np.fromiter(ids, np.int32, len(ids))


@dataclass(frozen=True)
class PuModel:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None, known: dict[str, int]) -> float:
        f = float(self.weights[token_buckets(text, known)].sum()) + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(f, -40.0, 40.0))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


class SparseRows:
    """Rows of distinct buckets, laid end to end."""

    def __init__(self, rows: list[np.ndarray], width: int = BUCKETS):
        self.n, self.width = len(rows), width
        self.flat = np.concatenate(rows).astype(np.int64) if self.n else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, w[self.flat], minlength=self.n) + b

    def pull_back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, g[self.row], minlength=self.width)

    def restricted(self, columns: np.ndarray) -> SparseRows:
        """The rows with ``columns`` only, renamed by position."""
        place = np.full(self.width, -1)
        place[columns] = np.arange(len(columns))
        out = SparseRows([], len(columns))
        kept = place[self.flat] >= 0
        out.n, out.flat, out.row = self.n, place[self.flat][kept], self.row[kept]
        return out


def telling_buckets(p_rows: SparseRows, u_rows: SparseRows, least: int = 3, deviation: float = 4.0) -> np.ndarray:
    """Buckets met in clearly more positive texts than their share of the unlabelled ones makes expected.

    A model over all words learns single texts by heart; the others carry no evidence either way.
    """
    in_p = np.bincount(p_rows.flat, minlength=BUCKETS)
    expected = p_rows.n * (np.bincount(u_rows.flat, minlength=BUCKETS) + 1.0) / (u_rows.n + 2.0)
    return (in_p >= least) & (in_p - expected >= deviation * np.sqrt(expected + 0.25))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 600, rate: float = 0.05,
             decay: float = 3e-5) -> PuModel:
    """Full-batch Adam on the non-negative risk over the telling buckets; ``decay`` is the L2 penalty per weight."""
    if not positive or not unlabelled:
        p = min(max(prior, 1e-3), 0.5)
        return PuModel(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    prior = min(max(prior, 1e-3), 0.999)
    p_rows, u_rows = SparseRows(positive), SparseRows(unlabelled)
    usable = np.flatnonzero(telling_buckets(p_rows, u_rows))
    p_rows, u_rows = p_rows.restricted(usable), u_rows.restricted(usable)
    k = len(usable)
    w, b = np.zeros(k), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, rounds + 1):
        fp, fu = p_rows.scores(w, b), u_rows.scores(w, b)
        sp, su = _sigmoid(fp), _sigmoid(fu)
        negative_risk = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        if negative_risk >= 0:
            gp, gu = prior * (sp - 1) / p_rows.n - prior * sp / p_rows.n, su / u_rows.n
        else:  # back off: climb the negative part of the risk
            gp, gu = prior * sp / p_rows.n, -su / u_rows.n
        g = np.append(p_rows.pull_back(gp) + u_rows.pull_back(gu) + decay * w, gp.sum() + gu.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-6)
        w -= step[:-1]
        b -= step[-1]
    weights = np.zeros(BUCKETS)
    weights[usable] = w
    return PuModel(weights, b)


def held_out(doc_id) -> F.Column:
    """Rows that training must not learn labels from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, label) of the rows that may be learnt from, one row per document."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(name).isNotNull() & ~held_out(F.col("doc_id")))
    return usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(name).cast("int").alias("label"))


def _bucket_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, int] = {}
    for batch in batches:
        yield pd.DataFrame({"positive": batch["positive"], "buckets": [token_buckets(t, known).tobytes() for t in batch["text"]]})


def train(docs: DataFrame, labels: DataFrame, name: str = "toxic", max_positive: int = MAX_POSITIVE,
          max_unlabelled: int = MAX_UNLABELLED) -> PuModel:
    """Fit on at most ``max_positive`` confirmed texts and ``max_unlabelled`` others; both samples are the smallest hashes."""
    known = training_labels(labels, name)
    prior = known.agg(F.avg("label")).first()[0] or 0.0
    at = F.xxhash64("doc_id")
    confirmed = known.filter("label = 1").orderBy(at, "doc_id").limit(max_positive).select("doc_id", F.lit(True).alias("positive"))
    others = (docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL")
                  .orderBy(at, "doc_id").limit(max_unlabelled).distinct().select("doc_id", F.lit(False).alias("positive")))
    chosen = F.broadcast(confirmed.unionByName(others))  # at most max_positive + max_unlabelled ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select("positive", "text")
    rows = texts.mapInPandas(_bucket_rows, "positive boolean, buckets binary").toPandas()
    sides = [[np.frombuffer(x, np.int32) for x in rows.loc[rows["positive"] == side, "buckets"]] for side in (True, False)]
    return fit_nnpu(sides[0], sides[1], float(prior))


def score_texts(docs: DataFrame, model: PuModel, text: str = "text", into: str = "score") -> DataFrame:
    """The rows with the model's score of ``text``; the weights (512 KB whatever the corpus) travel as a broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # plain arrays: no import on the executors

    def score_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, int] = {}
        fitted = PuModel(*shared.value)
        for batch in batches:  # a text is a Python object only while it is scored
            yield pa.array([fitted.score(t.as_py(), known) for t in batch], pa.float64())

    score = F.arrow_udf(score_batches, "double")

    return docs.withColumn(into, score(F.col(text)))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold`` under a model trained on ``labels`` and these documents."""
    scored = score_texts(pack(docs, p_text=F.col("text")), train(docs, labels), "p_text", "p_score")
    return unpack(scored.filter(F.col("p_score") < threshold))


@query("op7_score_toxicity")
def op7_score_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_texts(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
