"""Quality classifier: regularised quadratic discriminant over statistics of a text.

Each text becomes a vector of ``len(STATISTICS)`` transformed statistics. Per class the mean and covariance come from sums
that Spark adds up over all labelled training rows (no sample). The covariance of a class is shrunk towards the pooled one
and then towards a diagonal, so that it stays invertible for few rows or constant statistics; its Cholesky factor is
computed once and kept. The score is the logistic of the difference of the two Mahalanobis log-densities plus the log prior.

Defined results: null and empty texts have the statistics of a text without words and are scored like any other; the score
depends on the text alone; labels of null or unknown documents are ignored, a document labelled more than once counts by
its best label; with a class missing from the labels every score is that of the other class. Extra columns are passed through.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from trackloom.llm.common import documents, materialize, query, words
from trackloom.llm.toxicity import held_out, training_labels

STATISTICS = ("log words", "mean word length", "distinct words", "commonest word", "word repeats the one before", "symbols per word",
              "words ending in a mark", "words ending a sentence", "capital letters", "digits", "exclamations", "bars per word",
              "words per line", "short words", "repeated lines", "long words")
SYMBOLS = b"#*$%&|<>~^{}\\"
TO_POOLED, TO_DIAGONAL = 0.5, 0.02


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one text; shares go through log(x + 0.01), counts through log1p."""
    parts = words(text)
    n = max(1, len(parts))
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    chars = max(1, len(raw))
    counts = Counter(parts)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = list(map(len, parts))
    repeats = sum(map(bytes.__eq__, parts, parts[1:])) if len(parts) > 1 else 0
    ends = Counter(p[-1] for p in parts)
    capitals = chars - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if raw else 0
    shares = (len(counts) / n, max(counts.values(), default=0) / n, repeats / n,
              (chars - len(raw.translate(None, SYMBOLS))) / n if raw else 0.0,
              sum(ends[c] for c in b".,;:!?") / n, (ends[46] + ends[33] + ends[63]) / n, capitals / chars,
              (chars - len(raw.translate(None, b"0123456789"))) / chars if raw else 0.0,
              raw.count(b"!") / n, raw.count(b"|") / n)
    tail = (sum(x <= 3 for x in lengths) / n, 1 - len(set(lines)) / max(1, len(lines)), sum(x > 14 for x in lengths) / n)
    return np.array([math.log1p(len(parts)), math.log1p(sum(lengths) / n), *(math.log(x + 0.01) for x in shares),
                     math.log1p(n / max(1, len(lines))), *(math.log(x + 0.01) for x in tail)])


@dataclass(frozen=True)
class Side:
    """One class: mean, Cholesky factor of the shrunk covariance and what does not depend on the text."""

    mean: np.ndarray
    factor: np.ndarray
    constant: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = np.linalg.solve(self.factor, (x - self.mean).T)
        return self.constant - 0.5 * (z * z).sum(axis=0)


@dataclass(frozen=True)
class Discriminant:
    good: Side | None
    bad: Side | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.good is None or self.bad is None:
            return np.full(len(x), 0.5 if self.good is self.bad else float(self.bad is None))
        gap = self.good.log_density(x) - self.bad.log_density(x)
        return 1.0 / (1.0 + np.exp(-np.clip(gap, -40.0, 40.0)))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Discriminant:
    """From (count, sum of x, sum of x x') per class."""
    sums = {k: v for k, v in sums.items() if v[0] > 0}
    if not sums:
        return Discriminant(None, None)
    total = sum(n for n, _, _ in sums.values())
    scatter = {k: xx - np.outer(x, x) / n for k, (n, x, xx) in sums.items()}
    pooled = sum(scatter.values()) / total
    k = len(pooled)

    def side(label: int) -> Side | None:
        if label not in sums:
            return None
        n, x, _ = sums[label]
        covariance = (1 - to_pooled) * scatter[label] / n + to_pooled * pooled
        diagonal = np.diag(np.maximum(np.diag(covariance), np.trace(covariance) / k * 1e-3 + 1e-9))
        factor = np.linalg.cholesky((1 - to_diagonal) * covariance + to_diagonal * diagonal + 1e-9 * np.eye(k))
        return Side(x / n, factor, math.log(n / total) - np.log(np.diag(factor)).sum())

    return Discriminant(side(1), side(0))


@F.pandas_udf(ArrayType(DoubleType()))
def text_statistics(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([statistics(t) for t in batch])


def _sum_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task and class one row: count, sums and cross sums laid end to end."""
    k = len(STATISTICS)
    sums = {label: np.zeros(1 + k + k * k) for label in (0, 1)}
    for batch in batches:
        for x, label in zip(batch["statistics"], batch["label"]):
            sums[int(label > 0)] += np.concatenate([[1.0], x, np.outer(x, x).ravel()])
    yield pd.DataFrame({"label": list(sums), "sums": list(sums.values())})


def with_statistics(docs: DataFrame, text: str = "text", into: str = "statistics") -> DataFrame:
    return docs.withColumn(into, text_statistics(F.col(text)))


def train(measured: DataFrame, labels: DataFrame, name: str = "quality") -> Discriminant:
    """Fit on the (doc_id, statistics) of every labelled document outside the held-out third; no text is shuffled."""
    rows = measured.select(F.col("doc_id").cast("long").alias("doc_id"), "statistics").join(training_labels(labels, name), "doc_id")
    totals = (rows.select("statistics", "label").mapInPandas(_sum_rows, "label int, sums array<double>")
                  .select("label", F.posexplode("sums").alias("at", "x"))
                  .groupBy("label", "at").agg(F.sum("x").alias("x")).collect())  # 2 x 273 numbers
    k = len(STATISTICS)
    flat = {label: np.zeros(1 + k + k * k) for label in (0, 1)}
    for row in totals:
        flat[row["label"]][row["at"]] = row["x"]
    return fit({label: (v[0], v[1:k + 1], v[k + 1:].reshape(k, k)) for label, v in flat.items()})


def score_quality(measured: DataFrame, model: Discriminant, into: str = "score") -> DataFrame:
    """The rows with the model's score of their ``statistics``; two factors of 16 x 16 travel with the function."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array(list(batch), dtype=float).reshape(-1, len(STATISTICS))
            yield pd.Series(model.score(x))

    return measured.withColumn(into, score(F.col("statistics")))


@query("op8_score_quality")
def op8_score_quality(spark, sf_dir):
    measured = materialize(with_statistics(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "statistics"), "statistics")
    model = train(measured, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(measured, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
