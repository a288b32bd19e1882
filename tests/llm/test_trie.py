"""The trie of conversations against a plain dictionary of beginnings."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from paddock.llm import trie

TURNS = "conv_id bigint, turn bigint, role string, text string"


def brute(seqs):
    members, exact = defaultdict(list), defaultdict(list)
    for c, turns in seqs.items():
        exact[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)

    def totals(k):
        own = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
        below = [totals(x) for x in kids[k]]
        return sum(b[0] for b in below) if below else 1, own + sum(b[1] for b in below)

    def row(k):
        ends = ",".join(map(str, sorted(exact[k])))
        return min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), *totals(k), hashlib.sha256(ends.encode()).hexdigest()

    return sorted((row(k) for k in members), key=str)


def held(spark, seqs):
    rows = [(c, i, role, text) for c, turns in seqs.items() for i, (role, text) in enumerate(turns)]
    return trie.turn_arrays(spark.createDataFrame(rows, TURNS))


def test_trie_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_BYTES", 60)
    rnd = random.Random(5)
    texts = [("user", ""), ("user", "é"), ("assistant", "abc"), ("user", "a longer text")]
    seqs = {c: [rnd.choice(texts) for _ in range(rnd.choice([1, 2, 3, 4, 9]))] for c in range(300)}
    seqs |= {c: [("user", "hot"), ("assistant", "same")] for c in range(1000, 1200)}
    seqs |= {c: [("user", "hot"), ("assistant", "same"), ("user", str(c % 7))] for c in range(2000, 2060)}
    seqs[5000] = [("user", "hot")] + [("assistant", "deep")] * 120
    for ranges in (1, 2, 7, 40):
        got = trie.trie(held(spark, seqs), ranges)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(seqs), ranges


def test_turnless_conversations_and_empty_table(spark):
    got = held(spark, {1: [("user", "a")], 2: [("user", "b")]})
    none = trie.rebuilt(got, F.lit(None).cast("bigint"), F.lit(5), 5)
    assert sorted(tuple(r) for r in trie.trie(none, 3).collect()) == brute({1: [], 2: []})
    assert trie.trie(held(spark, {1: [("u", "x")]}).where("false"), 3).count() == 0


def test_rebuilt_from_rows(spark):
    rnd = random.Random(9)
    rows = []
    for c in [*range(90, 130), *range(200, 220), 305]:
        for t in range(rnd.randrange(1, 9)):
            rows.append((c, None if rnd.random() < 0.05 and t == 0 else t, rnd.choice(["user", None]), rnd.choice([None, "", "x", "yy", "ö"])))
    rows += [(None, 1, "user", "lost"), rows[0]]
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()[:32]
            own[c].append(((t is not None, t or 0), role or "", digest, text or ""))
    own = {c: [(role, text) for _, role, _, text in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    df = spark.createDataFrame([r + ("clash",) for r in rows], TURNS + ", hashes string")
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    got = trie.trie(trie.rebuilt(trie.turn_arrays(df), F.col("conv_id") - F.col("conv_id") % 100, head, 5), 5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(seqs)
