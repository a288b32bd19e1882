"""Ranked lexical search against a plain scorer."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

from paddock.llm import lexical

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    found = [(d, terms(t)) for d, t in docs]
    found = [(d, Counter(t), len(t)) for d, t in found if t]
    n_docs, total = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, ts in asked.items():
        scored = []
        for d, c, n in found:
            m = 100 - 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, rank + 1, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def check(spark, docs, items, k):
    got = lexical.search(lexical.build(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(items, ITEMS), k)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, k)


def test_terms():
    for t in ("İstanbul ǅ Ünï-code", "a\x7fb`c@d[e", " x", None, "", "ABC-def_9", "naïve x", "\x00a"):
        assert [x.decode() for x in lexical.terms(t)] == terms(t)


def test_search_ties_repeats_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_DOCS", 37)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 4)
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "The", "the", "日本"]
    text = lambda n: " ".join(words[min(int(rnd.paretovariate(0.7)) - 1, 64)] for _ in range(n))
    docs = [(i, text(rnd.randrange(40))) for i in range(300)] + [(i, "the tie w3") for i in range(400, 520)] + [(7, "w1 w2 again"), (7, "w1 w2 again"), (None, "the tie w3"), (None, "w5"), (600, None), (601, ""), (602, "--- !!"), (603, text(20_000))]
    items = [(i, text(6)) for i in range(12)] + [(20, None), (21, ""), (22, "unheard"), (23, "the tie"), (23, "w3 the"), (23, "the tie"), (None, "w5 w6")]
    check(spark, docs, items, 50)
    check(spark, docs, items, 3)


def test_empty_tables_and_clashing_columns(spark):
    some, none = spark.createDataFrame([(1, "a b", "x", 5)], DOCS + ", vocab string, task bigint"), spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "A", "t")], ITEMS + ", term string")
    assert [tuple(r)[:3] for r in lexical.search(lexical.build(some), items).collect()] == [(1, 1, 1)]
    two = some.unionByName(spark.createDataFrame([(2, "c", "x", 5)], some.schema))
    assert [tuple(r)[:3] for r in lexical.search(lexical.build(two), items).collect()] == [(1, 1, 1)]
    assert lexical.search(lexical.build(none), items).count() == 0
    assert lexical.search(lexical.build(two), items.where("false")).count() == 0
