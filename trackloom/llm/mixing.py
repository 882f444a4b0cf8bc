"""Mixing sources to target weights: repetition rates per source, hash-seeded copies per document.

All native. The documents are read once for their sizes; what follows works on (id, source, size) rows and on
one row per source. Sums per source are combined before the shuffle, so a source with a third of all rows is no
hot task, and the per-source figures reach the documents by a size-checked lookup.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; rows of one ``doc_id`` (or none)
with different texts draw independently, and so do rows that repeat id, source and text where ``numbered_repeats`` has numbered
them (the query does; without it they draw alike); all rows are returned; a source without words has target 0 and takes nothing; an empty table
gives an empty table. Columns of the input that are not named here play no part, whatever they are called.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import documents, lookup, materialize, n_words, oracle, pack, query

WEIGHTS = (5, 2, 1)
SHARE = 1.5     # words the mix takes, as a multiple of all words
CEILING = 2.0   # times a source may be repeated at most
RUN = 4096      # repeats of a row that one task numbers at a time
DRAWS = 8       # draws a document has; 8 hex digits of one SHA-256 each


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """0-based position in a total order: rows are ranged over the tasks, only one count per task meets in one place."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("r_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("r_part").agg(F.count(F.lit(1)).alias("r_rows"))
    before = Window.orderBy("r_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("r_part", F.coalesce(F.sum("r_rows").over(before), F.lit(0)).alias("r_offset"))
    inside = Window.partitionBy("r_part").orderBy(*order)
    return (lookup(ranged, offsets, "r_part", "inner")
            .withColumn(name, F.row_number().over(inside) - 1 + F.col("r_offset")).drop("r_part", "r_offset"))


def fill_level(sources: DataFrame, goal: float, ceiling: float) -> float | None:
    """The level at which weight times level, stopped at each source's ceiling, adds up to ``goal``.

    Sharing the excess anew by weight keeps all sources below their ceiling at one common level, so each round
    needs two sums. None: every source stands at its ceiling.
    """
    level, stopped = 0.0, -1
    while True:
        above = F.col("source_size") * F.lit(ceiling) < F.col("weight") * F.lit(level)
        row = sources.agg(F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)).alias("full"),
                          F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("open"),
                          F.count(F.when(above, 1)).alias("n")).first()
        if row["n"] == stopped or row["open"] == 0:
            return level if row["open"] else None
        level, stopped = (goal - ceiling * row["full"]) / row["open"], row["n"]


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def draw_key(doc_id: Column, digest: Column, repeat_no: Column) -> Column:
    """What seeds a row's draws: id, text and its number among equal rows."""
    return F.concat_ws(":", F.lit("mix"), F.coalesce(doc_id.cast("string"), F.lit("")), digest, repeat_no.cast("string"))


def draw(key: Column, k: int) -> Column:
    """The k-th hash-seeded number of a row, in [0, 1)."""
    digest = F.sha2(key, 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") / F.lit(2.0 ** 32)


def copies(key: Column, rate: Column, k: int) -> Column:
    whole = F.floor(rate)
    return (whole + (draw(key, k) < rate - whole).cast("long")).cast("long")


def source_plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """One row per source: source, source_size, target, rate, draw_no; from (doc_id, source, size, digest, repeat_no) rows.

    A Bernoulli draw per document has an error that matters for sources of few documents. Every document has ``DRAWS``
    independent draws, and each source uses the one whose sum comes nearest to its target; all sums come from one
    aggregation.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    weighed = materialize(ranked(totals, order, "position").withColumn(
        "weight", F.element_at(cycle, (F.col("position") % len(weights) + 1).cast("int"))), "sources")
    whole = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = fill_level(weighed, share * whole, ceiling)
    ceilings = F.col("source_size") * F.lit(ceiling)
    target = ceilings if level is None else F.least(ceilings, F.col("weight") * F.lit(level))
    plan = (weighed.withColumn("target", target.cast("double"))
                   .withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(ceiling))))
                                        .otherwise(F.lit(0.0)))
                   .select(F.col("source").alias("p_source"), "source_size", "target", "rate"))
    joined = lookup(sized.select("source", "size", draw_key(F.col("doc_id"), F.col("digest"), F.col("repeat_no")).alias("draw_key")), plan, F.col("source").eqNullSafe(F.col("p_source")), "inner")
    sums = joined.groupBy("p_source").agg(*[F.sum(F.col("size") * copies(F.col("draw_key"), F.col("rate"), k)).alias(f"k{k}") for k in range(DRAWS)])
    miss = sums.join(plan.select(F.col("p_source").alias("source"), "source_size", "target", "rate"), F.col("source").eqNullSafe(F.col("p_source")))
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"k{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(DRAWS)]))
    return materialize(miss.select("source", "source_size", "target", "rate", best["k"].alias("draw_no")), "mix")


def mix_sources(docs: DataFrame, plan: DataFrame, size: Column | None = None, digest: Column | None = None, repeat_no: Column | None = None) -> DataFrame:
    """The documents with size, source_size, target, copies and taken, from the ``source_plan`` of their sources.

    ``size``, ``digest`` and ``repeat_no`` stand for the text's own and 1, as in ``sized_documents``. Columns of ``docs`` with one of these five names are replaced.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    own = [F.col(f"packed_row.`{c}`").alias(c) for c in docs.columns if c not in added]
    key = draw_key(F.col("doc_id").cast("long"), text_digest(F.col("text")) if digest is None else digest, F.lit(1) if repeat_no is None else repeat_no)
    rows = pack(docs, m_key=key, m_source=F.col("source"), m_size=n_words(F.col("text")) if size is None else size)
    side = plan.select(F.col("source").alias("p_source"), F.col("source_size").alias("p_size"), F.col("target").alias("p_target"),
                       F.col("rate").alias("p_rate"), F.col("draw_no").alias("p_draw"))
    rows = lookup(rows, side, F.col("m_source").eqNullSafe(F.col("p_source")), "inner")
    chosen = reduce(lambda rest, k: F.when(F.col("p_draw") == k, copies(F.col("m_key"), F.col("p_rate"), k)).otherwise(rest),
                    range(DRAWS), F.lit(None).cast("long"))
    return rows.select(*own, F.col("m_size").alias("size"), F.col("p_size").alias("source_size"), F.col("p_target").alias("target"),
                       chosen.alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it; ``copy_no`` counts from 1."""
    return (mixed.filter("copies > 0")
                 .withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))


def sized_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, digest, repeat_no), stored: the only thing of the texts that the plan needs; ``repeat_no`` is 1."""
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"),
                                   text_digest(F.col("text")).alias("digest"), F.lit(1).cast("long").alias("repeat_no")), "sizes")


def numbered_repeats(sized: DataFrame) -> DataFrame:
    """The same rows with ``repeat_no`` counting from 1 within equal ones.

    Equal rows are counted and written out anew, so their number costs no window; the numbers of a row repeated more than
    ``RUN`` times are dealt to the tasks by runs.
    """
    key = ["doc_id", "source", "size", "digest"]
    counted = materialize(sized.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "repeats")
    few = counted.filter(F.col("n") <= RUN).select(*key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("repeat_no"))
    runs = counted.filter(F.col("n") > RUN).select(*key, "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(RUN).cast("long"))).alias("begin"))
    many = runs.repartition("digest", "begin").select(*key, F.explode(F.sequence("begin", F.least("n", F.col("begin") + RUN - 1))).alias("repeat_no"))
    return few.unionByName(many)


@query("op10_mix_sources")
def op10_mix_sources(spark, sf_dir):
    sized = materialize(numbered_repeats(sized_documents(documents(spark, sf_dir))), "numbered")
    mixed = mix_sources(sized, source_plan(sized), F.col("size"), F.col("digest"), F.col("repeat_no"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixing_sql(docs: str) -> str:
    """Statements of the mix over a relation ``docs``, up to the CTE ``mixed`` (the columns of docs, size, source_size, target, copies)."""
    sums = ", ".join(f"sum(size * (floor(rate) + CASE WHEN u{k} < rate - floor(rate) THEN 1 ELSE 0 END)) AS k{k}" for k in range(DRAWS))
    draws = ", ".join(f"CAST('0x' || substr(digest, {8 * k + 1}, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u{k}" for k in range(DRAWS))
    off = ", ".join(f"abs(k{k} - target)" for k in range(DRAWS))
    chosen = " ".join(f"WHEN draw_no = {k} THEN u{k}" for k in range(DRAWS))
    return f"""
mix_sized AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':'
      || row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, '')))) AS digest FROM {docs}),
mix_drawn AS (SELECT *, {draws} FROM mix_sized),
mix_totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM mix_sized GROUP BY source),
mix_weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM mix_totals),
mix_sorted AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM mix_weighed),
mix_tried AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER below, 0))
       / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS level
    FROM mix_sorted WINDOW below AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mix_level AS (SELECT min_by(level, ratio) AS level FROM mix_tried WHERE level <= ratio),
mix_target AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * level) AS target,
    CASE WHEN source_size > 0 THEN least(least(2.0::DOUBLE * source_size, weight * level) / source_size, 2.0::DOUBLE) ELSE 0 END AS rate
    FROM mix_weighed, mix_level),
mix_joined AS (SELECT d.*, t.source_size, t.target, t.rate FROM mix_drawn d JOIN mix_target t ON d.source IS NOT DISTINCT FROM t.source),
mix_sums AS (SELECT source, any_value(target) AS target, {sums} FROM mix_joined GROUP BY source),
mix_best AS (SELECT source, list_position([{off}], list_min([{off}])) - 1 AS draw_no FROM mix_sums),
mixed AS (SELECT j.*, CAST(floor(rate) AS BIGINT) + CASE WHEN CASE {chosen} END < rate - floor(rate) THEN 1 ELSE 0 END AS copies
    FROM mix_joined j JOIN mix_best b ON j.source IS NOT DISTINCT FROM b.source)"""


oracle("op10_mix_sources", f"WITH {mixing_sql('documents')} "
       "SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM mixed")
