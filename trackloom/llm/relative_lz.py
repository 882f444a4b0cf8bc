"""Duplicate word passages by relative Lempel-Ziv parsing.

The chunks of a bucket (see ``anchors``) form a reference block that is indexed as it is read, in the order of the documents: every
window of 50 words by a 128-bit fingerprint, with its earliest place. A chunk is factored greedily against the block before it
is added to it: at a word, the indexed window is looked up and followed in the reference text to its longest match, which
becomes a factor; without one the word is a literal. Factors have at least 50 words. The next lookups start at the first window
that leaves the factor, so windows across a factor's boundary are checked too, and a window is found exactly when an
earlier document holds it. Every window of a document is in one chunk, and so is parsed against every block it could be in.

Defined results: null texts have no words; rows of equal ``doc_id`` are not earlier than each other, so repeated rows get equal
results; a null ``doc_id`` comes after all others; texts below 50 words lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.anchors import LAST, Plan, Powers, U64, covered_texts, in_blocks, shared_chunks, union_of, unpacked, window_hashes, without_copies
from trackloom.llm.common import documents, query

WINDOW, GRAM = 50, 10
_SECOND = 0x2545F4914F6CDD1D


class WordValues(dict):
    """64-bit value of a word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 20:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def word_plan(window: int = WINDOW, gram: int = GRAM) -> Plan:
    known = WordValues()
    return Plan(window=window, gram=gram, parts=lambda t: t.encode("utf-8", "surrogatepass").split(),
                values=lambda p: np.fromiter(map(known.__getitem__, p), U64, len(p)), content=lambda p, i, j: b" ".join(p[i:j]))


def factors(orders: np.ndarray, contents: list[bytes], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(chunk, offset, length, reference chunk, reference offset) of the factors of every chunk against the chunks of earlier documents."""
    plan, powers, second = word_plan(window), Powers(), Powers(_SECOND)
    texts = [plan.values(c.split()) for c in contents]
    lengths = np.array([len(t) for t in texts], np.int64)
    edges = np.cumsum(lengths) - lengths
    joined = np.concatenate(texts)
    prints = list(zip(window_hashes(joined, window, powers).tolist(), window_hashes(joined, window, second).tolist())) if len(joined) >= window else []
    words = joined.tolist()
    index: dict[tuple[int, int], tuple[int, int, int]] = {}
    out = []
    for c in np.argsort(orders, kind="stable").tolist():
        own, begin, n = int(orders[c]), int(edges[c]), int(lengths[c])
        i = 0
        while i <= n - window:
            met = index.get(prints[begin + i])
            if met is None or met[0] >= own:
                i += 1
                continue
            _, ref, at = met
            here, there = begin + i, int(edges[ref]) + at
            m = window
            longest = min(n - i, int(lengths[ref]) - at)
            while m < longest and words[here + m] == words[there + m]:
                m += 1
            out.append((c, i, m, ref, at))
            i += m - window + 1
        for i in range(n - window + 1):
            index.setdefault(prints[begin + i], (own, c, i))
    return out


def later_words(orders: np.ndarray, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = np.array(factors(orders, contents), np.int64).reshape(-1, 5)
    return found[:, 0], found[:, 1], found[:, 2]


def _cut(rows: pd.DataFrame, spans: list) -> pd.DataFrame:
    out = []
    for order, text, (starts, lengths) in zip(rows["ord"], rows["text"], spans):
        parts = text.encode("utf-8", "surrogatepass").split()
        kept, at, removed = [], 0, 0
        for a, b in union_of(starts, lengths):
            kept += parts[at:a]
            at, removed = b, removed + b - a
        kept += parts[at:]
        out.append((order, len(parts), removed, hashlib.sha256(b" ".join(kept)).hexdigest()))
    return pd.DataFrame(out, columns=["ord", "n_words", "n_removed", "kept_sha256"])


def remove_passages(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and kept_sha256 after removing words in windows that an earlier document holds."""
    rows, total = without_copies(docs)
    blocks, n = in_blocks(rows.filter("NOT copied"), total)
    own = covered_texts(blocks, n, word_plan(), later_words, _cut, "ord long, n_words long, n_removed long, kept_sha256 string")
    own = own.select(F.when(F.col("ord") < LAST, F.col("ord")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")
    parts = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    gone = F.col("n_words") >= WINDOW
    copies = rows.filter("copied").withColumn("parts", parts).withColumn("n_words", F.size("parts").cast("long")).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", F.when(gone, F.col("n_words")).otherwise(0).cast("long").alias("n_removed"),
        F.sha2(F.when(gone, F.lit("")).otherwise(F.array_join("parts", " ")), 256).alias("kept_sha256"))
    return own.unionByName(copies)


def passage_factors(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n_words, ref_doc_id, ref_start): the factors of at least 50 words, in words of their documents.

    Factors end at the ends of chunks; exact copies of a document have the factors of the document.
    """
    rows, total = without_copies(docs)
    blocks, n = in_blocks(rows.filter("NOT copied"), total)

    def factors_of(pdf: pd.DataFrame) -> pd.DataFrame:
        _, orders, _, starts, contents = unpacked(pdf)
        found = np.array(factors(orders, contents), np.int64).reshape(-1, 5).T
        return pd.DataFrame({"ord": orders[found[0]], "start": starts[found[0]] + found[1], "n_words": found[2],
                             "ref_doc_id": orders[found[3]], "ref_start": starts[found[3]] + found[4]})

    found = shared_chunks(blocks, n, word_plan(), once=False).groupBy("bucket").applyInPandas(
        factors_of, "ord long, start long, n_words long, ref_doc_id long, ref_start long")
    return found.select(F.when(F.col("ord") < LAST, F.col("ord")).alias("doc_id"), "start", "n_words", "ref_doc_id", "ref_start")


@query("op5_remove_passages")
def op5_remove_passages(spark, sf_dir):
    return remove_passages(documents(spark, sf_dir))
