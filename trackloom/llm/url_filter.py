"""URL filter: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton.

A rule (verdict, host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest fitting rule
decides (host and path together; of equally long ones, the longer host). Urls that no rule fits are judged by their terms: one
automaton over all terms runs once over the url, a hit counts where no letter or digit touches it on either side, and the url is
blocked if the weights of its distinct terms reach ``LIMIT``. A strict term weighs that much alone, a soft one half of it, so one
strict or two distinct soft terms block.

Terms are searched in the whole url (queries carry terms, too), A-Z read as a-z. A percent escape stands for one blank, so what it
separates is found; letters written as escapes are not decoded. Letters are a-z, 0-9 and every code point from U+0080 on.

Rules and terms are parameters, small tables written down in a program; the pages are only mapped, so neither a hot host nor
repeated urls meet in a task, and nothing is shuffled. Of the pages, only the columns asked for are read.

Defined results: a null url, and one without ``://``, has an empty host and path, so no rule fits; a null url has no terms and is
allowed; a url without a path fits no rule, as every rule's path starts with ``/``; rows that repeat a url are judged alike and are
all returned; an empty table gives an empty table. Columns of the input that are not named here play no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import oracle, query

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
LIMIT = 2
STRICT = ("adult-only", "adult-x", "bestiality", "camgirls", "casino", "casinos", "cialis", "escorts", "gangbang", "hardcore-sex", "hentai", "keygen", "milf",
          "porn", "porno", "pornography", "pornstar", "sexcam", "sexcams", "viagra", "warez", "x-rated", "xxx", "xxxx")
SOFT = ("ad", "ads", "adult", "adults", "bet", "bets", "betting", "bonus", "cams", "cheap", "click", "crack", "credit", "dating", "discount", "erotic", "farm",
        "free", "gambling", "jackpot", "loan", "loans", "lottery", "naked", "nude", "nudes", "payday", "pharmacy", "pill", "pills", "poker", "replica", "sex",
        "sexy", "singles", "slots", "spam", "track", "tracker", "tracking", "win", "winner")
VOCABULARY = {**dict.fromkeys(STRICT, LIMIT), **dict.fromkeys(SOFT, LIMIT // 2)}
HITS = "n_strict long, n_soft long, weight long, terms string"


def lowered(text: Column) -> Column:
    """A-Z as a-z, everything else unchanged."""
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return lowered(host), path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (size, host_size, rule, verdict) of the rule that decides, null where none fits."""
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
                   F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(len(h)).alias("host_size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for v, h, p in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>")


def automaton(terms: Sequence[str]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for term in terms:
        built.add_word(term, term)
    built.make_automaton()
    return built


def bounded_hits(url: str, built: ahocorasick.Automaton) -> set[str]:
    """The distinct terms of a lowered url that no letter or digit touches."""
    found = set()
    for last, term in built.iter(url):
        before, after = last - len(term), last + 1
        if (before < 0 or not is_letter(url[before])) and (after == len(url) or not is_letter(url[after])):
            found.add(term)
    return found


def is_letter(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9" or c >= "\x80"


def term_hits(url: Column, vocabulary: Mapping[str, int] = VOCABULARY, limit: int = LIMIT) -> Column:
    """Struct (n_strict, n_soft, weight, terms) of the distinct terms of a url; ``terms`` is sorted and comma-joined."""
    weights = dict(vocabulary)
    if not all(weights):
        raise ValueError("a term is empty")

    @F.pandas_udf(HITS)
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        built = automaton(list(weights)) if weights else None
        for batch in batches:
            rows = []
            for u in batch:
                found = sorted(bounded_hits(u, built)) if u and built else []
                strict = sum(weights[t] >= limit for t in found)
                rows.append((strict, len(found) - strict, sum(weights[t] for t in found), ",".join(found)))
            yield pd.DataFrame(rows, columns=["n_strict", "n_soft", "weight", "terms"])

    return count(F.regexp_replace(lowered(url), "%[0-9a-f][0-9a-f]", " "))


def judge_urls(pages: DataFrame, keep: Sequence[str] = ("page_id",), rules: Sequence[tuple[str, str, str]] = RULES,
               vocabulary: Mapping[str, int] = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """The columns ``keep`` of every page with host, path, rule, verdict, n_strict, n_soft and terms of its ``url``."""
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col("url").alias("u"))
    host, path = host_and_path(F.coalesce("u", F.lit("")))
    rows = rows.select("kept", "u", host.alias("host"), path.alias("path"))
    rows = rows.select("kept", "host", "path", longest_rule(F.col("host"), F.col("path"), rules).alias("fit"), term_hits(F.col("u"), vocabulary, limit).alias("hits"))
    judged = F.when(F.col("hits.weight") >= limit, "block").otherwise("allow")
    return rows.select("kept.*", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", judged).alias("verdict"),
                       F.col("hits.n_strict").alias("n_strict"), F.col("hits.n_soft").alias("n_soft"), F.col("hits.terms").alias("terms"))


@query("op13_filter_urls")
def op13_filter_urls(spark, sf_dir):
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    edge = r"[^0-9a-z\x{80}-\x{10FFFF}]"
    terms = ", ".join(f"('{t}', {w})" for t, w in VOCABULARY.items())
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""
WITH numbered AS (SELECT row_number() OVER () AS n, page_id, url FROM pages),
rest AS (SELECT n, page_id, translate(url, '{UPPER}', '{LOWER}') AS u,
    CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM numbered),
parts AS (SELECT n, page_id, regexp_replace(u, '%[0-9a-f][0-9a-f]', ' ', 'g') AS u, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(verdict, host, path) AS (VALUES {rules}),
fitting AS (SELECT n, first(r.host || r.path ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS rule,
    first(r.verdict ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS verdict
    FROM parts p JOIN rules r ON ('.' || p.host) LIKE ('%.' || r.host) AND starts_with(p.path, r.path) GROUP BY n),
vocabulary(term, weight) AS (VALUES {terms}),
hits AS (SELECT n, count(*) FILTER (weight >= {LIMIT}) AS n_strict, count(*) FILTER (weight < {LIMIT}) AS n_soft, sum(weight) AS weight,
    string_agg(term, ',' ORDER BY term) AS terms
    FROM parts JOIN vocabulary ON regexp_matches(u, '(^|{edge})' || term || '($|{edge})') GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN weight >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
    coalesce(n_strict, 0) AS n_strict, coalesce(n_soft, 0) AS n_soft, coalesce(terms, '') AS terms
FROM parts LEFT JOIN fitting USING (n) LEFT JOIN hits USING (n)"""


oracle("op13_filter_urls", _sql())
