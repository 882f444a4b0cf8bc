"""Secret scan: keyed assignments, access keys and hex runs, and windows of high Shannon entropy.

Entropy part: candidate strings are the runs of at least ``WINDOW`` key characters. Each is scanned by a window of
``WINDOW`` characters whose character counts are kept by adding one and removing one per step, so the entropy of a window
costs two updates. The bar depends on the narrowest character class the run fits (digits, hex, letters, all key
characters); the union of windows above the bar is a span. Runs that may be words (no digit, or a short number after letters) have
a high bar, and a lower one where the case changes often. Parts that an allow-list knows (sample words, alphabets, UUIDs) are
cut out and the rest is scanned; a value that a sample word alone introduces (``example_...``) is a sample. Spans inside a base
span are suppressed.

Defined results: null and empty texts have no spans; offsets are code points, ends exclusive; the result of a row depends on
its text alone, so repeated rows repeat their result, and other columns are passed through untouched.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from trackloom.llm.common import documents, query

ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")
MIN_VALUE, MIN_ACCESS = 6, 20

WINDOW = 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
# character class, least bits per character of a window of 20; a class with few symbols has a lower bar
CLASSES = ((re.compile(r"[0-9]+"), 2.9),
           (re.compile(r"[0-9a-fA-F]+"), 3.0),
           (re.compile(r"[A-Za-z0-9]+"), 3.6),
           (re.compile(r"[A-Za-z0-9+/_=-]+"), 3.7))
# known harmless strings, in lower case (fixed values)
ALLOWED = re.compile(r"example|sample|placeholder|your[_-]?|xxxx|dummy|0123456789|abcdefgh|"
                     r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
SAMPLE = re.compile(r"(?:example|sample|placeholder|dummy)[_=-][a-z0-9]+")
WORDS = re.compile(r"[A-Za-z+/_=-]+|[A-Za-z]+[0-9]{1,4}")
# bars of what may be words: in windows with so many changes of case, and in others
MIN_CHANGES, MIXED_BAR, WORDS_BAR = 6, 3.9, 4.1
CHANGE = re.compile(r"(?=[a-z][A-Z]|[A-Z][a-z])")
C_LOG_C = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def entropy_runs(run: str, bar: float, admitted: list[bool] | None = None) -> Iterator[tuple[int, int]]:
    """Maximal unions of windows of ``run`` (those at ``admitted`` starts, if given) whose entropy reaches ``bar``; counts change by
    one character in, one out."""
    counts: dict[str, int] = {}
    total = 0.0  # sum of c log c over the window; entropy = log W - total / W
    most = WINDOW * (math.log2(WINDOW) - bar) + 1e-9
    first = last = None
    for i, ch in enumerate(run):
        c = counts.get(ch, 0)
        total += C_LOG_C[c + 1] - C_LOG_C[c] if c < WINDOW else 0.0
        counts[ch] = c + 1
        if i >= WINDOW - 1:
            start = i - WINDOW + 1
            if total <= most and (admitted is None or admitted[start]):
                if first is not None and start > last:
                    yield first, last
                    first = None
                first = start if first is None else first
                last = i + 1
            old = run[start]
            c = counts[old]
            total += C_LOG_C[c - 1] - C_LOG_C[c]
            counts[old] = c - 1
    if first is not None:
        yield first, last


def unknown_parts(run: str) -> list[list[int]]:
    """The positions of ``run`` outside allow-listed parts, cut where such a part borders on a joining mark or an end."""
    low = run.lower()
    if SAMPLE.fullmatch(low):
        return []
    parts: list[list[int]] = [[]]
    at = 0
    for m in ALLOWED.finditer(low):
        parts[-1] += range(at, m.start())
        at = m.end()
        if not (low[m.start() - 1:m.start()].isalnum() and low[at:at + 1].isalnum()):
            parts.append([])
    parts[-1] += range(at, len(run))
    return [p for p in parts if len(p) >= WINDOW]


def word_runs(run: str) -> list[tuple[int, int]]:
    """Spans of a run that may be words."""
    changes = [0] * (len(run) + 1)
    for m in CHANGE.finditer(run):
        changes[m.start() + 1] = 1
    changes = list(accumulate(changes))
    mixed = [changes[i + WINDOW - 1] - changes[i] >= MIN_CHANGES for i in range(len(run) - WINDOW + 1)]
    out: list[tuple[int, int]] = []
    for a, b in sorted([*(entropy_runs(run, MIXED_BAR, mixed) if any(mixed) else ()), *entropy_runs(run, WORDS_BAR)]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def entropy_spans(text: str) -> list[tuple[int, int]]:
    found = []
    for m in CANDIDATE.finditer(text):
        for at in unknown_parts(m.group()):
            part = "".join([m.group()[i] for i in at])
            spans = word_runs(part) if WORDS.fullmatch(part) else entropy_runs(part, next(bar for shape, bar in CLASSES if shape.fullmatch(part)))
            found += [(m.start() + at[a], m.start() + at[b - 1] + 1) for a, b in spans]
    return found


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds, by start, then kind as listed."""
    low = text.lower()
    found = []
    if "pass" in low or "secret" in low or "token" in low or "key" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def scan(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(base spans, all spans) of one text."""
    if not text:
        return [], []
    if max(map(len, text.split()), default=0) >= WINDOW:
        base, entropy = base_spans(text), entropy_spans(text)
    else:  # no run is long enough for anything but an assignment
        low = text.lower()
        base = base_spans(text) if "pass" in low or "secret" in low or "token" in low or "key" in low else []
        entropy = []
    spans = base + [(s, "entropy", e) for s, e in entropy if not any(a <= s and e <= b for a, _, b in base)]
    return base, sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def redact(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with every maximal run of spans replaced by ``mark``."""
    spans = scan(text)[1]
    if not spans:
        return text
    out, at = [], 0
    covered: list[list[int]] = []
    for s, _, e in spans:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    for s, e in covered:
        out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]


RESULT = StructType([StructField("n_assign", LongType()), StructField("n_access", LongType()), StructField("n_hex", LongType()),
                     StructField("base_sha256", StringType()), StructField("spans", StringType()), StructField("n_entropy", LongType())])


@F.pandas_udf(RESULT)
def scan_text(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = []
        for text in batch:
            base, spans = scan(text)
            kinds = [k for _, k, _ in spans]
            rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"),
                         hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), kinds.count("entropy")))
        yield pd.DataFrame(rows, columns=RESULT.names)


@F.arrow_udf(StringType())
def redact_text(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([redact(t.as_py()) for t in batch], pa.string())


def scan_secrets(docs: DataFrame, text: str = "text", into: str = "scan") -> DataFrame:
    """The rows with a struct ``into``: the spans found in ``text`` and their counts."""
    return docs.withColumn(into, scan_text(F.col(text)))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """Documents with every span replaced by a mark; rows without spans are unchanged."""
    kept = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = docs.withColumn("text", redact_text(F.col("text")))
    n_chars = [F.length("text").cast("long").alias("n_chars")] if "n_chars" in docs.columns else []
    return out.select(*kept, "text", *n_chars).select(*docs.columns)


@query("op9_scan_secrets")
def op9_scan_secrets(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text")
    return scan_secrets(rows).select("doc_id", "scan.*")
