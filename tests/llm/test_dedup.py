"""SimHash and embedding near-dedup against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from paddock.llm import capfilters, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(n, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids, linked):
    """The smallest id reachable from each."""
    own = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(own[a], own[b])
            if own[a] != m or own[b] != m:
                own[a] = own[b] = m
                changed = True
    return own


def test_simhash_documents(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(3))
    docs = []
    for g in range(12):
        base = [word() for _ in range(rnd.randint(1, 80))]
        for _ in range(rnd.randint(1, 6)):
            one = list(base)
            for _ in range(rnd.randint(0, 2)):
                one[rnd.randrange(len(one))] = word().upper()
            docs.append(rnd.choice([" ", "\n", "\t "]).join(one))
    docs += [None, "", "  \n", docs[0], docs[0], "one", "ONE", "x " * 50_000]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(docs)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    fps = {i: fingerprint(t) for i, t in enumerate(docs)}
    assert {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in got} == fps
    linked = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    assert {r["doc_id"]: r["component_id"] for r in got} == components(fps, linked)


def test_similar_documents(spark):
    """The pipeline's rule against all pairs, on copies with more and more words changed."""
    rnd = random.Random(3)
    docs = []
    for _ in range(40):
        base = [str(rnd.getrandbits(30)) for _ in range(200)]
        for changed in (0, 0, 1, 2, 3, 4, 4, 12, 40):
            one = list(base)
            for k in rnd.sample(range(200), changed):
                one[k] = "x"
            docs.append(" ".join(one))
    docs += [None, "", "few words", "Few  words", "x " * 60_000]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(docs)]
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in docs]
    near = [(a, b) for a in range(len(docs)) for b in range(a) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    want = set(components(range(len(docs)), near).values())
    out = simhash.one_of_each(spark.createDataFrame(rows, DOCS))
    kept = {r["doc_id"] for r in out.collect()}
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept >= want and len(kept - want) <= 0.05 * (len(docs) - len(want))
    assert {360, 362, 364} <= kept and not {361, 363} & kept


def test_dense_groups(spark):
    """Groups most of whose close pairs are just below 0.8: links that fail may not hide those that pass."""
    rnd = random.Random(8)
    docs, group = [], []
    for g in range(4):
        base = [str(rnd.getrandbits(30)) for _ in range(200)]
        for _ in range(150):
            one = list(base)
            for k in rnd.sample(range(200), rnd.randint(3, 6)):
                one[k] = str(rnd.getrandbits(30))
            docs.append(" ".join(one))
            group.append(g)
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in docs]
    near = [(a, b) for a in range(len(docs)) for b in range(a) if group[a] == group[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    own = components(range(len(docs)), near)
    drop = {i for i in own if own[i] != i}
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(docs)], DOCS)).select("doc_id").collect()}
    assert len(drop) >= 20 and set(own.values()) <= kept
    gone = len(docs) - len(kept)
    assert 0.9 * len(drop) <= gone <= len(drop), (gone, len(drop))


def test_recall_at_the_threshold():
    """Of pairs at a similarity of 0.8 to 0.85 the index, the tally and the distance find nine in ten, at every number of documents."""
    rnd = random.Random(5)
    for documents in (1000, 10**8, 10**11):
        rule, found, met, total = simhash.similar(documents), 0, 0, 120
        sets = np.array(rule.sets)
        for _ in range(total):
            one = [str(rnd.getrandbits(30)) for _ in range(180)]
            two = list(one)
            for k in range(3, 180, 50):  # four words, 20 of 176 shingles: similarity 0.8
                two[k] = "x"
            a, b = (simhash.shingle_set(" ".join(t), 5) for t in (one, two))
            assert 0.795 <= len(np.intersect1d(a, b)) / len(np.union1d(a, b)) <= 0.85
            apart = np.stack([simhash.fingerprint(" ".join(t), 5, rule.words) for t in (one, two)])
            apart = apart[0] ^ apart[1]
            alike = apart.view(np.uint8) == 0
            met += alike[sets].all(axis=1).any()
            found += alike[sets].all(axis=1).any() and alike.sum() >= rule.shared and np.bitwise_count(apart).sum() <= rule.bits
        assert found >= 0.9 * total, (documents, met, found)


def test_tally_decides():
    """Pairs of a list that share fewer bytes than guaranteed are dropped before any bit is compared."""
    bits = np.array([[0x0000000000000000], [0x0101010101000000], [0x0101010100000000], [0xFF00000000000000]], np.uint64)
    shared = [(i, j, int(n)) for i in range(4) for j in range(i) for n in simhash.shared_bytes(bits[[i]] ^ bits[[j]])]
    assert shared == [(1, 0, 3), (2, 0, 4), (2, 1, 7), (3, 0, 7), (3, 1, 3), (3, 2, 4)]
    i, j = (np.array(x) for x in zip(*[(a, b) for a, b, _ in shared]))
    kept = simhash._filtered(bits, i, j, simhash.Rule(1, [], 4, 64))
    assert [(a, b) for a, b in zip(kept[0].tolist(), kept[1].tolist())] == [(2, 0), (2, 1), (3, 0), (3, 2)]
    #: Fingerprints within four bits of each other share four bytes at least, so none of them is lost.
    pick = np.random.default_rng(1)
    for _ in range(200):
        x = int(pick.integers(1 << 63))
        y = x ^ sum(1 << int(b) for b in pick.choice(64, 4, replace=False))
        assert simhash.shared_bytes(np.array([[x ^ y]], np.uint64))[0] >= 4


@pytest.mark.parametrize("block", [16, 1024])
def test_links_of_dense_groups(spark, monkeypatch, block):
    """Fingerprints around a few centres, in lists split into several blocks, and in whole ones."""
    rnd = random.Random(2)
    monkeypatch.setattr(simhash, "BLOCK", block)
    fps = set()
    for _ in range(3):
        centre = rnd.getrandbits(64)
        for _ in range(120):
            x = centre
            for b in rnd.sample(range(64), rnd.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps |= {rnd.getrandbits(64) for _ in range(50)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = [(r["a"]["w0"], r["b"]["w0"]) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "w0 bigint")).collect()]
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
    assert all(near(a, b) for a, b in got)
    want = [(a, b) for a in signed for b in signed if a < b and near(a, b)]
    assert components(signed, got) == components(signed, want)


def test_simhash_edges(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c d e", None, None, None), (7, "a b c d e", None, None, None), (7, "a b c d e", None, None, None), (None, None, None, None, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 4 and {r["component_id"] for r in got if r["fp"]} == {7}
    assert simhash.one_of_each(spark.createDataFrame(rows, DOCS)).count() == 2


@pytest.mark.parametrize("n", [500, 10**4, 10**6, 4 * 10**6, 10**8, 10**10])
def test_filter_recall(n):
    """Pairs at a cosine of just 0.9 share a filter, whatever the number of vectors that the code is made for."""
    pick = np.random.default_rng(1)
    x, z = pick.normal(size=(2, 400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    code = capfilters.Code(64, n, 11)
    a, b = code.filters(x), code.filters(0.9 * x + (1 - 0.81) ** 0.5 * z)
    assert sum(len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)) >= 0.95 * 400


def test_embeddings_of_one_id(spark):
    """Two vectors of one vec_id are one entry; vectors without vec_id link, connect and name nothing."""
    east, north, west, far = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [-1.0, 0.05, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0]
    rows = [(5, east), (5, north), (3, east), (9, [0.05, 1.0, 0.0, 0.0]), (7, west), (None, [-1.0, 0.0, 0.0, 0.0]), (None, [-1.0, 0.0, 0.0, 0.0]), (8, [-1.0, -0.05, 0.0, 0.0]), (2, far), (2, [0.0, 0.05, 0.0, 1.0]), (None, [0.0, 0.0, 1.0, 0.0]), (None, None), (6, None)]
    got = capfilters.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<double>, label int")).collect()
    told = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str)
    want = [(5, 2, 3, False), (5, 2, 3, False), (3, 1, 3, True), (9, 1, 3, False), (7, 3, 7, True), (8, 3, 7, False), (None, 3, 7, False), (None, 3, 7, False), (2, 0, 2, True), (2, 0, 2, True), (None, 0, None, False), (None, 0, None, False), (6, 0, 6, True)]
    assert told == sorted(want, key=str)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(capfilters, "BLOCK", 32)
    pick = np.random.default_rng(4)
    x = pick.normal(size=(300, 16)).astype(np.float32)
    for g in range(5):
        centre = pick.normal(size=16)
        for k in range(40):
            x[g * 50 + k] = centre * pick.uniform(0.5, 2) + pick.normal(size=16) * pick.choice([0.02, 0.25])
    x[290] = x[291] = x[292]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] + [1.0] * 15, 0), (1003, [None] + [1.0] * 15, 0), (1004, [float("inf")] * 16, 0), (1005, [], 0), (1006, [1.0, 0.0], 0), (1007, [2.0, 0.1], 0)]
    got = {r["vec_id"]: r for r in capfilters.near_duplicates(spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int")).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    found = sum(got[i]["n_links"] for i in range(300))
    assert found >= 0.97 * near.sum() and all(got[i]["n_links"] <= near[i].sum() for i in range(300))
    own = components(range(300), [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b])
    assert sum(got[i]["component_id"] == own[i] for i in own) >= 295
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)
    assert [got[i]["n_links"] for i in range(1000, 1008)] == [0] * 6 + [1, 1]
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert capfilters.near_duplicates(empty).count() == 0
