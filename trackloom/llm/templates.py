"""Benchmark decontamination by template canonicalisation, native throughout.

A text becomes a template: numbers (with their sign or currency), units after numbers, and names (capitals inside a sentence)
are replaced by typed placeholders, other words are lower-cased and freed of marks; all by patterns over the whole text. A second,
wide template also takes capitals that begin a sentence as names; it adds the pairs that the first template misses. Windows of
five template tokens of every document are hash-joined with those of the benchmark items; only item windows with at least three
literal tokens take part. For each
document, item and alignment the values in the slots are compared: an item value stands for the document value that more than
half of its places have, and only windows with a slot of another value are left out (all with a slot of that item value, if no
document value has more than half). Different item values may stand for the same document value. So a question with other names
and numbers is caught while a chance meeting of templates is not. A document is contaminated by an item if the other windows
cover at least half of the item's.

Items of fewer than five tokens form one window of their own length. Items without a window of three literal tokens
(their own length, if shorter) cannot be told from chance once their values change; they are looked for word for word, by
windows of their tokens in lower case. Where the names at an item's sentence starts have changed, windows that lose their three
literals by it cannot meet: the item is also held if values have changed and half of the windows that keep them, ``MIN_WIDE`` at least, meet.

Defined results: null and empty texts hold nothing; repeated rows are judged once and reported once; rows with equal or null
``doc_id`` but different texts are judged separately; empty tables give an empty result. Only ``doc_id``, ``item_id`` and
``text`` are read, whatever else the tables hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import documents, lookup, materialize, oracle, pack, query, unpack

WINDOW = 5
MIN_LITERALS = 3
MIN_COVERAGE = 0.5
MIN_WIDE = 3
# fixed values: marks that are no part of a token, ends of a sentence, units of measure
MARKS = ".,;:!?\"'()[]{}«»“”„¿¡"
SENTENCE_END = ".?!:"
UNITS = ("mm", "cm", "m", "km", "in", "ft", "mi", "mile", "miles", "meter", "meters", "metres", "inch", "inches", "feet", "g", "kg", "mg", "lb",
         "lbs", "pounds", "tons", "ml", "l", "liter", "liters", "litres", "gallons", "s", "sec", "seconds", "min", "minutes", "h", "hour", "hours",
         "day", "days", "week", "weeks", "month", "months", "year", "years", "usd", "eur", "dollars", "euros", "cents", "percent", "degrees",
         "mph", "km/h", "kmh", "hz", "khz", "mhz", "w", "kw", "v", "gb", "mb", "kb", "tb")
MARK = r"[.,;:!?\"'()\[\]{}«»“”„¿¡]"
NUMBER = MARK[:-1] + r"\p{Sc}+\-\u2212\u2013\u00B1~#]*[0-9][^ ]*"  # marks, signs and currencies, then a digit
# rewriting steps over a text whose words each follow one space; STARTS puts a line break, which no word holds, before names at sentence starts
STARTS = r" (?<![^.?!: ] )(?=" + MARK + r"*\p{Lu})"
NAMES = r" (?<=[^.?!: ] )" + MARK + r"*\p{Lu}[^ ]*"
MEASURES = r" <num> (\n?)(?:" + "|".join(UNITS) + ")(?=" + MARK + "*(?: |$))"
EDGES = r"(?<![^ ])" + MARK + r"++|(?<!" + MARK + ")" + MARK + r"++(?![^ ])"
PLACEHOLDERS = ("<num>", "<unit>", "<name>")
# how a window reads its text: templates, wide templates, the words themselves
PLAIN, WIDE, LITERAL = 0, 1, 2


def template_columns(df: DataFrame, text: str = "text", with_tokens: bool = True) -> DataFrame:
    """Adds ``template``, ``wide`` and, if asked, ``tokens`` (the words without marks at their ends, case kept) and ``literal``
    (these in lower case, told from templates by a mark); all have one entry per word.

    Whole texts are rewritten by a few patterns rather than word by word; every pattern maps one word to one word. The wide
    template is cut from the first one's text, which tells its sentence starts, and only where there are any.
    """
    kept = df.columns
    single = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x09-\x0D]", " "), " {2,}", " ")
    named = F.regexp_replace(F.regexp_replace(F.concat(F.lit(" "), "spaced"), STARTS, " \n"), NAMES, " <name>")
    measured = F.regexp_replace(F.lower(F.regexp_replace(named, " " + NUMBER, " <num>")), MEASURES, " <num> $1<unit>")
    entries = lambda c: F.split(F.substr(c, F.lit(2)), " ")
    read = (df.withColumn("spaced", F.trim(single)).withColumn("marked", F.regexp_replace(measured, MARK + "+", "")).withColumn("starts", F.contains("marked", F.lit("\n")))
            .withColumns({"template": entries(F.replace("marked", F.lit("\n"), F.lit(""))),
                          "wide": F.when(F.col("starts"), entries(F.regexp_replace("marked", r"\n[^ ]*", "<name>")))}))
    bare = F.regexp_replace("spaced", EDGES, "")
    words = {"tokens": F.split(bare, " "), "literal": F.split(F.lower(F.concat(F.lit("="), F.replace(bare, F.lit(" "), F.lit(" =")))), " ")} if with_tokens else {}
    return read.withColumns({"wide": F.coalesce("wide", "template"), "wider": F.col("starts"), **words}).select(*kept, "template", "wide", "wider", *words)


def windows_of(df: DataFrame, keys: list[str], n: int, literal: bool = False) -> DataFrame:
    """(keys, at, reading, n, hash): the windows of ``n`` tokens of every row's ``template``, those that differ in ``wide``, and
    if asked those of ``literal``.

    One row per window and reading, cut and hashed after the rows are told apart, so that all of it is generated code.
    """
    count = F.size("template") - (n - 1)
    readings = F.when(F.lit(literal), F.lit(3)).when(F.col("wider"), F.lit(2)).otherwise(F.lit(1))
    # the outer form keeps the optimizer from a filter on the size, which would rewrite every text once more
    entries = [c for c in ["template", "wide", "wider", *(["literal"] if literal else [])] if c not in keys]
    rows = df.withColumn("n_windows", count).select(*keys, *entries, "n_windows", F.explode_outer(
        F.when(F.col("n_windows") > 0, F.sequence(F.lit(0), F.col("n_windows") * readings - 1))).alias("i")).filter("i IS NOT NULL")
    rows = rows.withColumn("reading", F.when(F.col("i") < F.col("n_windows"), F.lit(PLAIN)).when(F.col("i") < F.col("n_windows") * 2, F.lit(WIDE)).otherwise(F.lit(LITERAL)))
    rows = rows.withColumn("at", F.col("i") - F.col("reading") * F.col("n_windows"))
    entry = lambda c, k: F.get(F.col(c), F.col("at") + k)
    differs = reduce(lambda x, y: x | y, [entry("template", k) != entry("wide", k) for k in range(n)])
    hashed = lambda c: F.xxhash64(*[entry(c, k) for k in range(n)])
    value = F.when(F.col("reading") == PLAIN, hashed("template"))
    value = value.when(F.col("reading") == WIDE, hashed("wide")).otherwise(hashed("literal")) if literal else value.otherwise(hashed("wide"))
    return rows.filter((F.col("reading") != WIDE) | (F.col("wider") & differs)).select(*keys, "at", "reading", F.lit(n).alias("n"), value.alias("hash"))


def _literals(window: Column) -> Column:
    return F.size(F.filter(window, lambda x: ~x.isin(*PLACEHOLDERS) & (x != "")))


def _read(at: str, n: Column, reading: str) -> Column:
    """The window at ``at`` as ``reading`` has it."""
    cut = lambda c: F.slice(c, F.col(at) + 1, n)
    return F.when(F.col(reading) == PLAIN, cut("template")).when(F.col(reading) == WIDE, cut("wide")).otherwise(cut("literal"))


def item_windows(benchmark: DataFrame, window: int = WINDOW, least: int = MIN_LITERALS) -> DataFrame:
    """(item_id, item_at, reading, n, hash, item_template, item_tokens, keeps, n_windows, n_wide), stored: the informative windows of
    every item as each reading has them. ``keeps`` tells if a window is informative as a wide template."""
    items = template_columns(benchmark.select("item_id", "text").filter("item_id IS NOT NULL").distinct()).withColumn(
        "size", F.least(F.lit(window), F.size("tokens"))).filter("size > 0")
    out = None
    for n in range(1, window + 1):
        cut = (windows_of(items.filter(F.col("size") == n), ["item_id", "tokens", "template", "wide", "literal"], n, literal=True)
               .withColumnRenamed("at", "item_at").withColumn("item_template", _read("item_at", F.lit(n), "reading"))
               .withColumn("keeps", _literals(F.slice("wide", F.col("item_at") + 1, n)) >= min(n, least))
               .withColumn("item_tokens", F.slice("tokens", F.col("item_at") + 1, n))
               .filter(F.when(F.col("reading") == LITERAL, F.exists("item_tokens", lambda x: x != "")).otherwise(_literals(F.col("item_template")) >= min(n, least)))
               .select("item_id", "item_at", "reading", "n", "hash", "item_template", "item_tokens", "keeps"))
        out = cut if out is None else out.unionByName(cut)
    stored = materialize(out, "items")
    informative = stored.filter(F.col("reading") != LITERAL)
    counts = informative.groupBy("item_id").agg(F.countDistinct("item_at").alias("n_windows"), F.countDistinct(F.when(F.col("keeps"), F.col("item_at"))).alias("n_wide"))
    # only items without an informative window are read word for word
    dense = stored.join(counts.select("item_id"), "item_id", "left_anti")
    few = dense.groupBy("item_id").agg(F.countDistinct("item_at").alias("n_windows"), F.lit(0).cast("long").alias("n_wide"))
    return materialize(lookup(informative, counts, "item_id", "inner").unionByName(lookup(dense, few, "item_id", "inner")), "item-windows")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, n_matched, n_slots, n_changed): documents and the items they hold, stored.

    ``n_slots`` counts the item's slot values met, ``n_changed`` those that stand for another value in the document.
    """
    items = item_windows(benchmark)
    sizes = {(r["n"], r["literal"]) for r in items.select("n", (F.col("reading") == LITERAL).alias("literal")).distinct().collect()}  # at most 2 x WINDOW values
    sizes = {n: any((n, True) == x for x in sizes) for n in sorted({n for n, _ in sizes})} or {WINDOW: False}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    plain = template_columns(rows, with_tokens=any(sizes.values()))
    windows = reduce(DataFrame.unionByName, [windows_of(plain, ["doc_id", "text_hash"], n, literal) for n, literal in sizes.items()]).select(
        "doc_id", "text_hash", F.col("at").alias("doc_at"), F.col("n").alias("doc_n"), F.col("reading").alias("doc_reading"), "hash")
    # the rows of an item window carry what the comparison needs; one hash may stand for windows of several items
    met = materialize(lookup(windows, items.select("hash", "item_id", "item_at", "n", "n_windows", "n_wide", "keeps", "reading"), "hash", "inner")
                      .filter("doc_n = n").drop("hash", "doc_n").distinct(), "met")
    # slots: cut the windows out of the few documents that met any
    keys = met.select("doc_id", "text_hash").distinct()
    on = rows["text_hash"].eqNullSafe(F.col("k_hash")) & rows["doc_id"].eqNullSafe(F.col("k_id"))
    held = lookup(rows, materialize(keys, "keys").select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")), on, "inner").select(
        "doc_id", "text_hash", "text").distinct()
    cut = template_columns(held).select(F.col("doc_id").alias("t_id"), F.col("text_hash").alias("t_hash"), "tokens", "template", "wide", "literal")
    pairs = (met.join(cut, met["doc_id"].eqNullSafe(cut["t_id"]) & (met["text_hash"] == cut["t_hash"]))
             .select("doc_id", "text_hash", "item_id", "item_at", "n", "n_windows", "n_wide", "keeps", "doc_at", "reading", "doc_reading",
                     _read("doc_at", F.col("n"), "doc_reading").alias("doc_template"),
                     F.slice("tokens", F.col("doc_at") + 1, F.col("n")).alias("doc_tokens")))
    full = items.select("item_id", "item_at", "reading", "item_template", "item_tokens")
    pairs = lookup(pairs, full, ["item_id", "item_at", "reading"], "inner").filter("doc_template = item_template")
    # a window that meets in several readings counts as the plainest has it
    at = ["doc_id", "text_hash", "item_id", "item_at", "n_windows", "n_wide", "keeps"]
    pairs = pairs.withColumn("shift", F.col("doc_at") - F.col("item_at")).groupBy(*at, "shift").agg(
        F.min(F.struct(F.when((F.col("reading") == WIDE) | (F.col("doc_reading") == WIDE), 1).otherwise(0).alias("wide"), "item_template", "item_tokens", "doc_tokens")).alias("m"))
    pairs = materialize(pairs.select(*at, "shift", "m.*"), "aligned")
    # pairs that the first template tells have its figures; the wide one adds those it misses
    first = _judged(pairs.filter("wide = 0"), coverage)
    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash")) & (F.col("item_id") == F.col("f_item"))
    known = first.select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"), F.col("item_id").alias("f_item"))
    more = pairs.join(pairs.filter("wide = 1").select(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"), F.col("item_id").alias("w_item")).distinct(),
                      F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash")) & (F.col("item_id") == F.col("w_item")), "left_semi")
    return materialize(first.unionByName(_judged(more.join(known, same, "left_anti"), coverage, wide=True)), "contaminated")


def _judged(pairs: DataFrame, coverage: float, wide: bool = False) -> DataFrame:
    """The documents and items whose aligned windows agree in their slots and cover enough, stored."""
    place = ["doc_id", "text_hash", "item_id", "shift"]
    slots = (pairs.select(*place, "item_at", F.posexplode(F.arrays_zip("item_template", "item_tokens", "doc_tokens")).alias("k", "s"))
             .filter(F.col("s.item_template").isin(*PLACEHOLDERS))
             .select(*place, "item_at", (F.col("item_at") + F.col("k")).alias("slot"), F.col("s.item_template").alias("kind"),
                     F.lower("s.item_tokens").alias("theirs"), F.lower("s.doc_tokens").alias("ours")))
    # one place of an item lies in several windows and counts once
    held = slots.groupBy(*place, "kind", "theirs", "ours").agg(F.countDistinct("slot").alias("n"))
    values = held.groupBy(*place, "kind", "theirs").agg(
        F.max(F.struct("n", "ours")).alias("most"), F.sum("n").alias("n"), F.max(F.col("theirs") != F.col("ours")).alias("off"))
    values = materialize(values.select(*[F.col(c).alias(f"j_{c}") for c in [*place, "kind", "theirs"]],
                                       F.when(F.col("most.n") * 2 > F.col("n"), F.col("most.ours")).alias("stands_for"), "off"), "values")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"j_{c}")) for c in place])
    off = slots.join(values, same & (F.col("kind") == F.col("j_kind")) & (F.col("theirs") == F.col("j_theirs"))).filter(
        "stands_for IS NULL OR stands_for <> ours").select(*[F.col(c).alias(f"j_{c}") for c in [*place, "item_at"]]).distinct()
    judged = values.groupBy(*[f"j_{c}" for c in place]).agg(F.count(F.lit(1)).alias("n_met"), F.count(F.when(F.col("off"), 1)).alias("n_off"))
    windows = pairs.select(*place, "item_at", "n_windows", "n_wide", "keeps").join(off, same & (F.col("item_at") == F.col("j_item_at")), "left_anti").join(judged, same, "left")
    found = windows.groupBy("doc_id", "text_hash", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.countDistinct("item_at").alias("n_matched"),
        F.max("n_wide").alias("n_wide"), F.countDistinct(F.when(F.col("keeps"), F.col("item_at"))).alias("n_kept"),
        F.coalesce(F.max("n_met"), F.lit(0)).cast("long").alias("n_slots"), F.coalesce(F.max("n_off"), F.lit(0)).cast("long").alias("n_changed"))
    enough = F.col("n_matched") >= F.lit(coverage) * F.col("n_windows")
    if wide:
        enough |= (F.col("n_changed") > 0) & (F.col("n_kept") >= F.lit(coverage) * F.col("n_wide")) & (F.col("n_kept") >= MIN_WIDE)
    return materialize(found.filter(enough).drop("n_wide", "n_kept"), "judged")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash")).distinct()
    rows = pack(docs, p_id=F.col("doc_id").cast("long"), p_hash=F.xxhash64("text"))
    on = F.col("p_id").eqNullSafe(F.col("c_id")) & (F.col("p_hash") == F.col("c_hash"))
    return unpack(lookup(rows, materialize(bad, "bad"), on, "left_anti"))


@query("op6_decontaminate")
def op6_decontaminate(spark, sf_dir):
    found = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "n_windows", "n_matched", "n_slots", "n_changed")


def _template_sql(source: str, key: str) -> str:
    """(key, text, tokens, template) of a relation of (key, text)."""
    mark = MARK.replace("'", "''")
    return f"""(SELECT {key}, text, list_transform(raws, lambda x: trim(x, '{MARKS.replace("'", "''")}')) AS tokens,
      list_transform(range(1, len(kinds) + 1), lambda i: CASE WHEN kinds[i] <> '' THEN kinds[i]
        WHEN i > 1 AND kinds[i-1] = '<num>' AND regexp_matches(lower(raws[i]), '^({"|".join(UNITS)}){mark}*$') THEN '<unit>'
        ELSE regexp_replace(lower(raws[i]), '{mark}', '', 'g') END) AS template
      FROM (SELECT *, list_transform(range(1, len(raws) + 1), lambda i: CASE
              WHEN i > 1 AND NOT contains('{SENTENCE_END}', right(raws[i-1], 1)) AND regexp_matches(raws[i], '^{mark}*\\p{{Lu}}') THEN '<name>'
              WHEN regexp_matches(raws[i], '^{mark}*[0-9]') THEN '<num>' ELSE '' END) AS kinds
            FROM (SELECT {key}, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS raws FROM {source})))"""


_HOLDERS = "('<num>', '<unit>', '<name>', '')"


def contamination_sql(docs: str) -> str:
    """Statements over a relation ``docs`` up to ``leaks`` (doc_id, text, item_id and the figures)."""
    return f"""
tb AS (SELECT * FROM {_template_sql("(SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)", "item_id")}),
iw AS (SELECT item_id, i AS item_at, least({WINDOW}, len(tokens)) AS n, template[i:i + least({WINDOW}, len(tokens)) - 1] AS tmpl,
         tokens[i:i + least({WINDOW}, len(tokens)) - 1] AS toks
       FROM (SELECT *, unnest(range(1, len(tokens) - least({WINDOW}, len(tokens)) + 2)) AS i FROM tb WHERE len(tokens) > 0)),
ii AS (SELECT *, count(DISTINCT item_at) OVER (PARTITION BY item_id) AS n_windows FROM iw
       WHERE len(list_filter(tmpl, lambda x: x NOT IN {_HOLDERS})) >= least(n, {MIN_LITERALS})),
td AS (SELECT * FROM {_template_sql(f"(SELECT DISTINCT doc_id, text FROM {docs})", "doc_id")}),
dw AS (SELECT doc_id, text, j AS doc_at, n, template[j:j + n - 1] AS tmpl, tokens[j:j + n - 1] AS toks
       FROM (SELECT td.*, s.n, unnest(range(1, len(tokens) - s.n + 2)) AS j FROM td, (SELECT DISTINCT n FROM ii) s WHERE len(tokens) >= s.n)),
mt AS (SELECT dw.doc_id, dw.text, ii.item_id, item_at, n_windows, doc_at - item_at AS shift, ii.tmpl, ii.toks AS theirs, dw.toks AS ours
       FROM dw JOIN ii ON dw.tmpl = ii.tmpl AND dw.n = ii.n),
sl AS (SELECT DISTINCT doc_id, text, item_id, shift, kind, theirs, ours FROM (
         SELECT doc_id, text, item_id, shift, unnest(tmpl) AS kind, lower(unnest(theirs)) AS theirs, lower(unnest(ours)) AS ours FROM mt)
       WHERE kind IN ('<num>', '<unit>', '<name>')),
jd AS (SELECT doc_id, text, item_id, shift, count(*) AS n_pairs, count(DISTINCT (kind, theirs)) AS n_theirs, count(DISTINCT (kind, ours)) AS n_ours,
         count(*) FILTER (theirs <> ours) AS n_off FROM sl GROUP BY ALL),
leaks AS (SELECT m.doc_id, m.text, m.item_id, max(n_windows) AS n_windows, count(DISTINCT item_at) AS n_matched,
            coalesce(max(n_pairs), 0) AS n_slots, coalesce(max(n_off), 0) AS n_changed
          FROM mt m LEFT JOIN jd ON m.doc_id IS NOT DISTINCT FROM jd.doc_id AND m.text = jd.text AND m.item_id = jd.item_id AND m.shift = jd.shift
          WHERE n_pairs IS NULL OR (n_pairs = n_theirs AND n_pairs = n_ours)
          GROUP BY m.doc_id, m.text, m.item_id HAVING count(DISTINCT item_at) >= {MIN_COVERAGE} * max(n_windows))"""


oracle("op6_decontaminate", f"WITH {contamination_sql('documents')} SELECT doc_id, item_id, n_windows, n_matched, n_slots, n_changed FROM leaks")
