"""Filter audit, ranked search and URL filter: plain models on small tables, edge cases, clashing columns."""

from __future__ import annotations

import math
import re
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import filter_audit, lexical_search, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, source string, n int, pattern int, part string, kept int, score int, term string, rank int, item int"


def documents(spark, rows):
    """Documents from (doc_id, text, source) beside columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 7, 7, "x", 7, 7, "x", 7, 7) for r in rows], DOCS)


# ---- 11 filter audit

def plain_audit(rows, labels):
    """Every document walks through every order by itself."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    out = {}
    docs = []
    for doc_id, text, source in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)}
        docs.append((source or "", doc_id, {k for k, v in fails.items() if v}))
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[2]]
                left = [d for d in left if f not in d[2]]
                share[f] += len(gone)
                failing = sum(f in d[2] for d in mine)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(d[2] == {f} for d in mine),
                                                   sum(d[1] in good for d in gone), sum(d[1] in toxic for d in gone), f]
        for key, value in out.items():
            if key[0] == part:
                value[6] = share[value[6]] if isinstance(value[6], str) else value[6]
    return {k: tuple(v) for k, v in out.items()}


def test_shares_of_the_equations_are_the_shapley_values():
    for n in (2, 3, 5):
        found = filter_audit.shapley_coefficients(n)
        for i in range(n):
            for s in range(1 << n):
                k = s.bit_count()
                want = math.factorial(k - 1) * math.factorial(n - k) if s >> i & 1 else -math.factorial(k) * math.factorial(n - k - 1)
                assert k == 0 or found[i][s] == want  # nothing is removed by no filter


def test_audit_equals_walking_every_order(spark):
    rng = np.random.default_rng(3)
    many = " ".join(f"w{i}" for i in range(210))
    pool = [many, many + " #", many.upper(), "few words", "AB CD", "a " * 300, ("A " * 300) + "|", "", None, many + "éÄ" * 9, "50 % $"]
    rows = [(int(i), pool[rng.integers(len(pool))], [None, "", "s1", "s2"][rng.integers(4)]) for i in range(150)]
    rows += [(None, many, "s1"), (None, many, "s1"), (3, "few words", "s2"), (3, "few words", "s2"), (149, None, "s3"), (-5, "only here", "s4")]
    rows += [(1000, many + " tail" * 20000, "s5")]
    labels = [(int(i), int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 150, 2)] + [(None, 1, 1), (2, 1, 1), (4, None, 1), (9999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    merged = [(i, max((q or 0) for j, q, _ in labels if j == i), max((t or 0) for j, _, t in labels if j == i)) for i in {x[0] for x in labels} if i is not None]
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in filter_audit.audit(documents(spark, rows), table).collect()}
    assert out == plain_audit(rows, merged)


def test_audit_of_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(documents(spark, []), labels).count() == 0
    assert filter_audit.audit(documents(spark, [(1, "x", "s")]), labels).count() == 600


# ---- 12 ranked search

def plain_search(rows, items, top):
    docs = [(i, TERM.findall(t.translate(LOWER))) for i, t in rows if t is not None]
    docs = [d for d in docs if d[1]]
    n_docs, n_terms = len(docs), sum(len(d[1]) for d in docs)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    df = {t: sum(t in set(w) for _, w in docs) for t in set().union(*asked.values())} if asked else {}
    out = {}
    for item, terms in asked.items():
        scored = []
        for doc_id, found in docs:
            score = 0
            for t in terms & set(found):
                tf = found.count(t)
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(found) * n_docs) // n_terms)))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1):
            out[item, rank] = (doc_id, -score)
    return out


@pytest.fixture
def small_index(monkeypatch):
    for name, value in {"SHARD_DOCS": 70, "BATCH_INTERVALS": 3, "BLOCK_ITEMS": 3, "SEED_ROUNDS": 2}.items():
        monkeypatch.setattr(lexical_search, name, value)


def test_search_equals_scoring_everything(spark, small_index):
    rng = np.random.default_rng(7)
    names = [f"t{i}" for i in range(60)] + ["Été", "日本", "Caps", "a1b2"]
    weights = 1 / np.arange(1, len(names) + 1)
    text = lambda n: " ".join(rng.choice(names, n, p=weights / weights.sum()))
    rows = [(int(i), text(int(rng.integers(1, 60)))) for i in range(300)]
    rows += [(int(i), rows[5][1]) for i in range(300, 420)]  # one group of copies, all of one score
    rows += [(None, rows[5][1]), (None, "t1 t2 t3"), (7, rows[7][1]), (7, None), (8, ""), (9, " .,;!? \n"), (10, "word," * 5000 + "t9"), (11, "T1-t1_t1")]
    rng.shuffle(rows)
    items = [(1, rows[5][1] or "t5"), (2, text(30)), (2, text(10)), (3, "nowhere at all"), (4, None), (5, "ÉTÉ CAPS t40, t41"), (None, "t50 t3"), (6, text(40)), (7, "t1")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, [(i, t, "s") for i, t in rows]).repartition(5)
    for top in (50, 3):
        out = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in lexical_search.search(docs, benchmark, top).collect()}
        assert out == plain_search(rows, items, top)


def test_search_of_empty_tables(spark):
    none, one = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(documents(spark, [(1, "a", "s")]), none).count() == 0
    assert lexical_search.search(documents(spark, []), one).count() == 0
    assert lexical_search.search(documents(spark, [(1, None, "s"), (2, "...", "s")]), one).count() == 0


def made_shard(rng, n, k, most):
    rows = []
    for _ in range(n):
        held = np.flatnonzero(rng.random(k) < 0.3).astype(np.int32)
        rows.append((held, rng.integers(1, most, len(held)).astype(np.int32)))
    ids = rng.permutation(n) * 3
    return lexical_search.build_shard(ids, rng.integers(10, 99, n), rows, rng.integers(0, 50, k), 1000, 50000)


@pytest.mark.parametrize("seed", range(6))
def test_shard_search_and_bounds_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 90)), 12
    shard = made_shard(rng, n, k, 2 if seed % 2 else 9)
    terms = np.array(sorted(rng.choice(k, 5, replace=False)))
    matrix = np.zeros((k, n), np.int64)
    for t in range(k):
        at = slice(shard.start[t], shard.start[t + 1])
        matrix[t, shard.doc[at]] = shard.value[at]
    pairs = np.array(list(combinations(range(n + 1), 2)))
    bound, split = lexical_search.interval_bounds(shard, terms, pairs[:, 0], pairs[:, 1])
    for (low, high), b, s in zip(pairs.tolist(), bound.tolist(), split.tolist()):
        part = matrix[terms, low:high]
        assert b == part.max(axis=1).sum()
        assert (s == -1) == (part.max() == 0) and (s == -1 or part.max() == matrix[terms, s].max() and low <= s < high)
    total = matrix[terms].sum(axis=0)
    every = sorted(((int(s), int(i)) for s, i in zip(total, shard.doc_ids) if s > 0), key=lambda x: (-x[0], x[1]))
    for top in (1, 4, 200):
        assert lexical_search.search_shard(shard, terms, top) == every[:top]
        if every:
            floor = every[min(top, len(every)) - 1]
            assert lexical_search.search_shard(shard, terms, top, floor) == every[:top]
            assert set(lexical_search.search_shard(shard, terms, top, rounds=2)) <= set(every)


# ---- 13 url filter

CASES = [
    ("http://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("http://example.com/en/", "example.com", "/en/", "example.com/en/", "block"),
    ("https://WWW.Example.com/en/x?casino", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("https://x.www.example.com/en/x", "x.www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("https://notexample.com/en/x", "notexample.com", "/en/x", "com/", "allow"),
    ("https://example.com/EN/x", "example.com", "/EN/x", "com/", "allow"),
    ("https://casino.com", "casino.com", "", None, "block"),
    ("https://casino.com/", "casino.com", "/", "com/", "allow"),
    ("http://host.net/fr/1", "host.net", "/fr/1", "net/fr/", "block"),
    ("http://net/es/1#f", "net", "/es/1", "net/es/", "block"),
    ("http://planet/es/1", "planet", "/es/1", None, "allow"),
    ("http://free-bets.org/", "free-bets.org", "/", None, "block"),
    ("http://free.org/free/FREE", "free.org", "/free/FREE", None, "allow"),
    ("http://freebets.org/carefree", "freebets.org", "/carefree", None, "allow"),
    ("http://x.org/?q=cheap%20pills", "x.org", "/", None, "block"),
    ("http://x.org/écasino", "x.org", "/écasino", None, "allow"),
    ("http://x.org/Casino_1", "x.org", "/Casino_1", None, "block"),
    ("http://x.org?a=http://y.com/", "x.org", "", None, "allow"),
    ("//x.com/casino", "", "", None, "block"),
    ("", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://", "", "", None, "allow"), ("://ÄB.org/\n?", "Äb.org", "/\n", None, "allow"),
    ("http://x.org/" + "a" * 200000 + "/xxx", "x.org", "/" + "a" * 200000 + "/xxx", None, "block"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i % 20 if i else None, c[0], "h", 1, 1) for i, c in enumerate(CASES + CASES[:3])], "page_id long, url string, html string, host int, kept int")
    out = url_filter.judge_urls(pages).collect()
    want = [(i % 20 if i else None, *c[1:]) for i, c in enumerate(CASES + CASES[:3])]
    assert sorted((str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in out)) == sorted(map(str, want))
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_terms_overlap_and_count_once(spark):
    found = {r.u: r.hits for r in spark.createDataFrame([("adult-x/x-rated",), ("ad-ads-ad",), ("sex.sexcams-sexcam",), ("b%2Fads",)], "u string").select(
        "u", url_filter.term_hits(F.col("u")).alias("hits")).collect()}
    assert (found["adult-x/x-rated"].n_strict, found["adult-x/x-rated"].n_soft, found["adult-x/x-rated"].terms) == (2, 1, "adult,adult-x,x-rated")
    assert (found["ad-ads-ad"].n_soft, found["ad-ads-ad"].terms) == (2, "ad,ads")
    assert found["sex.sexcams-sexcam"].terms == "sex,sexcam,sexcams"
    assert found["b%2Fads"].terms == "ads"


def test_other_rules_and_vocabulary(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x/y"), (2, "http://c.a.b/q"), (3, "http://z/bad-worse")], "page_id long, url string")
    out = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules=[("block", "b", "/x/y"), ("allow", "a.b", "/x")], vocabulary={"worse": 1}, limit=1).collect()}
    assert out == {1: ("a.b/x", "allow"), 2: (None, "allow"), 3: (None, "block")}  # equally long: the longer host
    assert {r.verdict for r in url_filter.judge_urls(pages, rules=[], vocabulary={}).collect()} == {"allow"}
