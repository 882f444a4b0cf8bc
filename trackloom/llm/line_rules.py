"""Quality rules, lines first: lines that fail a rule are removed, then documents that lost too much are rejected.

Rules of a line (lines without a word have no verdict and are dropped):

* punctuation: it neither ends in a closing mark nor is short; or marks and symbols crowd it;
* navigation: menu bars between its words, or only menu words;
* boilerplate: it holds a stock phrase of sites, licences or scripts.

A document is kept if its base figures pass and the lines that remain hold at least half of its words.

Defined results: a null or empty text has zero figures and fails (fewer than 20 words); the result depends on the text
alone, so repeated rows repeat it; extra columns are passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from trackloom.llm.common import documents, oracle, query

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
MIN_KEPT_PERCENT = 50
SHORT_LINE = 12          # words a line may have without a closing mark
BATCH_WORDS = 1 << 17    # words whose windows are compared at a time

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
# fixed values: both engines use these patterns
CLOSED = r"[.!?:;…。！？][\"'”’»)\]]*[\x20\x09-\x0D]*$"
CROWD = r"[#*$%&<>~^]|!!"
BARS = r"[|»›•·→]"
MENU = (r"^[\x20\x09-\x0D]*(home|menu|about|about us|contact|contact us|login|log in|sign in|sign up|register|search|next|previous|back|"
        r"skip to content|read more|share|share this|print|top)[\x20\x09-\x0D]*$")
STOCK = (r"all rights reserved|licensed under|cookie policy|privacy policy|terms of (use|service)|this website uses cookies|"
         r"enable javascript|subscribe to our|sign up for our|click here|powered by|lorem ipsum|follow us on")
CLOSED_RE, CROWD_RE, BARS_RE = re.compile(CLOSED), re.compile(CROWD), re.compile(BARS)
MENU_RE, STOCK_RE = re.compile(MENU), re.compile(STOCK)
WORD_RE = re.compile(r"[^\x20\x09-\x0D]+")


def line_rule(line: str, n: int) -> str | None:
    """The rule that a line of ``n`` words fails, or None."""
    low = line.lower()
    if STOCK_RE.search(low):
        return "boilerplate"
    bars = len(BARS_RE.findall(line))
    if (bars >= 3 and 4 * bars >= n) or MENU_RE.search(low):
        return "navigation"
    if 4 * len(CROWD_RE.findall(line)) > n or (n > SHORT_LINE and not CLOSED_RE.search(line)):
        return "punctuation"
    return None


def repeat_words(docs: list[list[bytes]]) -> np.ndarray:
    """Per document, the words that lie in a window of 8 words met at least twice in it.

    Windows are named exactly: pairs of names of neighbours get a name by sorting, for lengths 2, 4 and 8.
    """
    out = np.zeros(len(docs), np.int64)
    lengths = np.array([len(d) for d in docs])
    total = int(lengths.sum())
    if total < WINDOW:
        return out
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for d in docs for w in d), np.int64, total)
    doc = np.repeat(np.arange(len(docs)), lengths)
    span = 1
    while span < WINDOW:
        m = len(ids) - span
        ids = np.unique(ids[:m] * (int(ids.max()) + 1) + ids[span:], return_inverse=True)[1]
        span *= 2
    inside = doc[:len(ids)] == doc[WINDOW - 1:]
    at = np.flatnonzero(inside)
    key = doc[at] * (int(ids.max()) + 1) + ids[at]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = at[counts[inverse] > 1]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    covered = np.cumsum(edge)[:total] > 0
    return np.bincount(doc, covered, minlength=len(docs)).astype(np.int64)


RESULT = StructType([StructField("n_words", LongType()), StructField("word_chars", LongType()), StructField("n_symbols", LongType()),
                     StructField("n_dup_lines", LongType()), StructField("n_repeat_words", LongType()), StructField("base_failed", BooleanType()),
                     StructField("kept", BooleanType()), StructField("n_kept_words", LongType()), StructField("n_failed_lines", LongType()),
                     StructField("clean_text", StringType())])


def _rows(texts: list[str]) -> list[tuple]:
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    out = []
    for text, ws, repeated in zip(texts, split, repeat_words(split)):
        n = len(ws)
        word_chars = len(text) - sum(map(text.count, BLANKS))
        seen: set[str] = set()
        dup = kept_words = failed = 0
        kept_lines = []
        for line in text.split("\n"):
            k = len(line.encode("utf-8", "surrogatepass").split())
            if not k:
                continue
            dup += line in seen
            seen.add(line)
            if line_rule(line, k) is None:
                kept_words += k
                kept_lines.append(line)
            else:
                failed += 1
        base_failed = n < MIN_WORDS or 100 * int(repeated) > MAX_REPEAT_PERCENT * n
        out.append((n, word_chars, sum(map(text.count, SYMBOLS)), dup, int(repeated), base_failed,
                    not base_failed and 100 * kept_words >= MIN_KEPT_PERCENT * n, kept_words, failed, "\n".join(kept_lines)))
    return out


def evaluate(texts: list[str | None]) -> list[tuple]:
    """The figures of ``RESULT`` for each text, a bounded number of words at a time."""
    out: list[tuple] = []
    part: list[str] = []
    held = 0
    for t in texts:
        part.append(t or "")
        held += len(part[-1]) // 5
        if held >= BATCH_WORDS:
            out += _rows(part)
            part, held = [], 0
    return out + _rows(part)


@F.pandas_udf(RESULT)
def line_figures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame(evaluate(list(batch)), columns=RESULT.names)


def clean_lines(docs: DataFrame, text: str = "text", into: str = "lines") -> DataFrame:
    """The rows with a struct ``into``: the figures, the verdict ``kept`` and the text of the lines that remain."""
    return docs.withColumn(into, line_figures(F.col(text)))


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words", "n_failed_lines")


@query("op2_line_rules")
def op2_line_rules(spark, sf_dir):
    rows = clean_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", *[F.col(f"lines.{c}").alias(c) for c in FIGURES])


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


oracle("op2_line_rules", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p
      FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT r, p, word, CASE WHEN lead(word, 7) OVER o IS NOT NULL THEN concat_ws(' ', word, {", ".join(f"lead(word, {i}) OVER o" for i in range(1, 8))}) END AS gram
      FROM w WINDOW o AS (PARTITION BY r ORDER BY p)),
c AS (SELECT r, p, count(*) OVER (PARTITION BY r, gram) > 1 AND gram IS NOT NULL AS twice FROM g),
v AS (SELECT r, p, max(CAST(twice AS INT)) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM c),
rep AS (SELECT r, sum(covered) AS n_repeat_words FROM v GROUP BY r),
wc AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r),
ln AS (SELECT r, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM (SELECT r, string_split(text, chr(10)) AS ls FROM d)),
lw AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, lower(line) AS low,
         len(regexp_extract_all(line, '{BARS}')) AS bars, len(regexp_extract_all(line, '{CROWD}')) AS crowd FROM ln),
lr AS (SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY p) > 1 AS dup,
         regexp_matches(low, '{STOCK}') OR (bars >= 3 AND 4 * bars >= n) OR regexp_matches(low, '{MENU}')
         OR 4 * crowd > n OR (n > {SHORT_LINE} AND NOT regexp_matches(line, '{_quoted(CLOSED)}')) AS failed FROM lw WHERE n > 0),
ls AS (SELECT r, count(*) FILTER (dup) AS n_dup_lines, count(*) FILTER (failed) AS n_failed_lines,
         sum(n) FILTER (NOT failed) AS n_kept_words FROM lr GROUP BY r),
f AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_kept_words, 0) AS BIGINT) AS n_kept_words,
        coalesce(n_failed_lines, 0) AS n_failed_lines
      FROM d LEFT JOIN wc USING (r) LEFT JOIN rep USING (r) LEFT JOIN ls USING (r))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * n_kept_words >= {MIN_KEPT_PERCENT} * n_words AS kept
FROM f""")
