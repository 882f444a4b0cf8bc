"""Interaction audit of five filters: what each removes alone, together and in every order.

A document is one of 32 patterns of failed filters, so all that the orders can show lies in a table of the patterns' counts. From it
come the removals v(S) of all 32 coalitions S (documents that fail any filter of S), for all documents, the good and the toxic ones.

* Steps: after the coalition S of the earlier filters, filter f removes v(S + f) - v(S); what fails f beyond that is redundant.
* Shapley: the additive game nearest to v, by least squares with the weights (n - 1) / (C(n, s) s (n - s)) on coalitions of s of n
  filters, under the constraint that the shares add up to v of all (efficiency). Its normal equations are solved in rationals. The
  solution is linear in v, so it is solved once, for the 32 unit games; 120 times each coefficient is an integer, and the shares
  of every part are exact integer sums.

The texts are mapped to their failures and keys where they are read. Identical texts are found by their SHA-256: rows are counted per (text, part, labels, doc_id),
then per (text, part, labels) with the least doc_id and its count, then the least doc_id per text. Every count is combined before its
shuffle, so a text or a part with a third of all rows is no hot group, and the texts themselves are never shuffled.

Defined results: a null text is empty, and all empty texts are identical; a null part is the empty string; a row without doc_id
never fails E and makes none fail; rows that repeat a doc_id are documents of their own, which do not make each other fail; a document
labelled more than once has a label if any of its labels says so, one without labels has none; an empty table gives an empty
table. Only doc_id, text and source are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import documents, materialize, oracle, query

LETTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 2, b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


def failures_of(text: str | None) -> int:
    """Bits 0 to 3: the text fails A, B, C, D. ``bytes.split`` cuts at exactly the six ASCII blanks of ``WORD``."""
    whole = (text or "").encode("utf-8", "surrogatepass")
    found = whole.split()
    n = len(found)
    capitals, symbols = (len(whole) - len(whole.translate(None, chars)) for chars in (CAPITALS, SYMBOLS))
    return ((n < LEAST_WORDS) + 2 * (100 * len(set(found)) < DISTINCT_PERCENT * n) + 4 * (100 * capitals > CAPITAL_PERCENT * len(text or ""))
            + 8 * (symbols > 0))


def _failure_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([failures_of(t) for t in batch], dtype="int32")


def text_failures(text: str) -> Column:
    return F.pandas_udf(_failure_batches, "int")(F.col(text))


def shapley_coefficients(n: int = len(LETTERS)) -> list[list[int]]:
    """n! times the share of filter i per unit of v(S), as coefficients[i][S].

    From the normal equations of the kernel-weighted least squares under the efficiency constraint: with A the weighted sum of z z',
    the solution for the right side b is A^-1 (b - c 1), where c makes the shares add up to v of all filters.
    """
    full = (1 << n) - 1
    proper = [(s, Fraction(n - 1, comb(n, k) * k * (n - k)), [Fraction(s >> i & 1) for i in range(n)])
              for s in range(1, full) for k in [s.bit_count()]]
    a = [[sum(w * z[i] * z[j] for _, w, z in proper) for j in range(n)] for i in range(n)]
    ones = solve(a, [Fraction(1)] * n)
    weights = {s: (w, z) for s, w, z in proper}
    columns = []
    for s in range(full + 1):
        w, z = weights.get(s, (Fraction(0), [Fraction(0)] * n))
        free = solve(a, [w * x for x in z])
        excess = (sum(free) - (s == full)) / sum(ones)
        columns.append([factorial(n) * (x - excess * one) for x, one in zip(free, ones)])
    if any(x.denominator != 1 for c in columns for x in c):
        raise ArithmeticError("shares are not multiples of 1 / n!")
    return [[int(c[i]) for c in columns] for i in range(n)]


def solve(a: Sequence[Sequence[Fraction]], b: Sequence[Fraction]) -> list[Fraction]:
    """Gauss-Jordan elimination in rationals."""
    rows = [[*r, x] for r, x in zip(a, b)]
    for k in range(len(rows)):
        at = next(i for i in range(k, len(rows)) if rows[i][k])
        rows[k], rows[at] = rows[at], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        rows = [r if i == k else [x - r[k] * y for x, y in zip(r, rows[k])] for i, r in enumerate(rows)]
    return [r[-1] for r in rows]


def patterns(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, pattern, n, good, toxic): documents of each part by the filters they fail, as bits; stored."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("text_key"), text_failures("text").alias("own"))
    rows = rows.groupBy("doc_id", "part", "text_key", "own").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("is_good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("is_toxic"))
    named = rows.filter("doc_id IS NOT NULL").join(marks, F.col("doc_id") == F.col("l_id"), "left")
    rows = named.select(*rows.columns, F.coalesce("is_good", F.lit(0)).alias("is_good"), F.coalesce("is_toxic", F.lit(0)).alias("is_toxic")).unionByName(
        rows.filter("doc_id IS NULL").select("*", F.lit(0).alias("is_good"), F.lit(0).alias("is_toxic")))
    # a struct's least is by doc_id first; it holds the rows of that doc_id, as each has one row per group by now
    named_rows = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    groups = materialize(rows.groupBy("text_key", "own", "part", "is_good", "is_toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))), F.lit(0)).alias("named"), F.min(named_rows).alias("least")), "audit-texts")
    firsts = groups.filter("least IS NOT NULL").groupBy(F.col("text_key").alias("f_key")).agg(
        F.min("least.doc_id").alias("first_id"), F.sum("named").alias("f_named")).filter("f_named > 1").drop("f_named")
    both = groups.join(firsts, F.col("text_key") == F.col("f_key"), "left")
    later = F.when(F.col("first_id").isNotNull(), F.col("named") - F.when(F.col("least.doc_id") == F.col("first_id"), F.col("least.n")).otherwise(F.lit(0))).otherwise(F.lit(0))
    split = both.withColumn("later", F.coalesce(later, F.lit(0))).select(
        "part", "is_good", "is_toxic", F.explode(F.array(F.struct(F.col("own").alias("pattern"), (F.col("n") - F.col("later")).alias("n")),
                                                         F.struct((F.col("own") + 16).alias("pattern"), F.col("later").alias("n")))).alias("x"))
    return materialize(split.filter("x.n > 0").groupBy("part", F.col("x.pattern").alias("pattern")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("is_good")).alias("good"), F.sum(F.col("x.n") * F.col("is_toxic")).alias("toxic")), "audit-patterns")


def coalition_removals(table: DataFrame) -> DataFrame:
    """One row per part: its documents n, and the arrays v, good, toxic over all 32 coalitions (the position is the coalition)."""
    packed = table.groupBy("part").agg(F.sum("n").alias("n"), F.collect_list(F.struct("pattern", "n", "good", "toxic")).alias("cells"))  # 32 at most

    def removed(name: str) -> Column:
        failing = lambda s: F.filter("cells", lambda c: c["pattern"].bitwiseAND(s) != 0)
        return F.transform(F.sequence(F.lit(0), F.lit((1 << len(LETTERS)) - 1)),
                           lambda s: F.aggregate(failing(s), F.lit(0).cast("long"), lambda sofar, c: sofar + c[name]))

    return packed.select("part", "n", removed("n").alias("v"), removed("good").alias("good"), removed("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step; see the module."""
    values = materialize(coalition_removals(patterns(docs, labels, part)), "audit-coalitions")
    full = (1 << len(LETTERS)) - 1
    shares = F.array(*[sum((F.lit(c).cast("long") * F.col("v")[s] for s, c in enumerate(row) if c), F.lit(0).cast("long")) for row in shapley_coefficients()])
    orders = F.split(F.lit(",".join(map("".join, permutations(LETTERS)))), ",")
    rows = values.select("*", shares.alias("shares"), F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))

    def bits(chosen) -> Column:
        marks = [F.when(chosen(F.locate(x, F.col("filter_order"))), F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(LETTERS)]
        return sum(marks[1:], marks[0])

    rows = rows.withColumn("alone", bits(lambda at: at == F.col("step"))).withColumn("after", bits(lambda at: at <= F.col("step")))
    at = lambda name, coalition: F.get(F.col(name), coalition)
    gone = lambda name: at(name, F.col("after")) - at(name, F.col("after") - F.col("alone"))
    everything, bit = F.lit(full), F.instr(F.lit(LETTERS), F.substring(F.col("filter_order"), F.col("step"), F.lit(1))) - 1
    return rows.select("part", "filter_order", "step", (F.col("n") - at("v", F.col("after"))).alias("kept"), gone("v").alias("removed"),
                       (at("v", F.col("alone")) - gone("v")).alias("redundant"),
                       (at("v", everything) - at("v", everything - F.col("alone"))).alias("unique_fails"),
                       gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), at("shares", bit).alias("shapley"))


@query("op11_audit_filters")
def op11_audit_filters(spark, sf_dir):
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations(LETTERS))

# each document walks through each order by itself: no coalitions, no shares from equations
oracle("op11_audit_filters", rf"""
WITH marks AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels GROUP BY doc_id),
texts AS (SELECT d.doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM documents d LEFT JOIN marks m ON d.doc_id = m.doc_id),
worded AS (SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM texts),
failing AS (SELECT part, good, toxic, (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS fails FROM worded),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY ALL),
orders(filter_order) AS (VALUES {_ORDERS}),
steps AS (SELECT filter_order, CAST(step AS INT) AS step, substr(filter_order, step, 1) AS letter FROM orders, range(1, 6) r(step)),
walked AS (SELECT part, filter_order, step, letter, fails, n, good, toxic,
    strpos(fails, letter) > 0 AS hit, regexp_matches(substr(filter_order, 1, step - 1), '[' || fails || '_]') AS gone FROM cells, steps),
counted AS (SELECT part, filter_order, step, letter, sum(n) FILTER (NOT gone AND NOT hit) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed,
    sum(n) FILTER (hit AND gone) AS redundant, sum(n) FILTER (fails = letter) AS unique_fails,
    sum(good) FILTER (hit AND NOT gone) AS good_lost, sum(toxic) FILTER (hit AND NOT gone) AS toxic_lost FROM walked GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
    CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
    CAST(coalesce(sum(removed) OVER (PARTITION BY part, letter), 0) AS BIGINT) AS shapley FROM counted""")
