"""Line dedup against a brute force over all earlier positions."""

from __future__ import annotations

import random

from paddock.llm import linededup

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute(docs, run_words):
    """Lines in any run of at least run_words words that occurs at an earlier position too."""
    order = sorted({(d, t) for d, t in docs if t is not None}, key=lambda x: x[0])
    held = [(d, t, [(i, x, len(x.split())) for i, x in enumerate(t.split("\n")) if x.split()]) for d, t in order]
    gone = {}
    for n, (d, t, own) in enumerate(held):
        for i in range(len(own)):
            for m in range(n + 1):
                other = held[m][2]
                for j in range(len(other)):
                    if m == n and j >= i:
                        break
                    k = words = 0
                    while i + k < len(own) and j + k < len(other) and own[i + k][1] == other[j + k][1]:
                        words += own[i + k][2]
                        k += 1
                    if words >= run_words:
                        gone.setdefault((d, t), set()).update(range(own[i][0], own[i + k - 1][0] + 1))
    return gone


def test_against_brute_force(spark):
    rnd = random.Random(3)
    pool = [" ".join(rnd.choice("abcdefgh") + str(n) for _ in range(rnd.randint(1, 6))) for n in range(40)]
    passages = [[rnd.choice(pool) for _ in range(rnd.randint(3, 8))] for _ in range(6)]
    docs = []
    for d in range(60):
        body = [rnd.choice(pool) for _ in range(rnd.randint(0, 6))]
        if rnd.random() < 0.7:
            at = rnd.randint(0, len(body))
            body[at:at] = rnd.choice(passages)
        if rnd.random() < 0.3:
            body.insert(rnd.randint(0, len(body)), "  ")
        docs.append((d, "\n".join(body)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, None), (103, ""), (104, "x"), (105, "\n".join([pool[0]] * 9))]
    rows = [(d, t, "en", "s", 0) for d, t in docs]
    found = linededup.dedup(spark.createDataFrame(rows, DOCS), 12).collect()
    want = brute(docs, 12)
    assert len(found) == len(rows)
    for r in found:
        t = dict(docs)[r["doc_id"]]
        lost = want.get((r["doc_id"], t), set())
        assert set(r["removed"]) == lost, r
        if t is None:
            assert r["text"] is None
            continue
        rest = [x for i, x in enumerate(t.split("\n")) if i not in lost]
        assert r["text"] == ("\n".join(rest) if not lost or any(x.split() for x in rest) else "")
    assert any(want.values())


def test_edge_rows(spark):
    long = "\n".join(f"w{i} " * 60 for i in range(300))
    rows = [(None, long, None, None, 0), (1, long, "en", None, 0), (1, long, "en", "s", 0), (2, "", None, None, None)]
    found = {(r["doc_id"], r["source"]): r["text"] for r in linededup.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert found[None, None] == long and found[1, None] == found[1, "s"] == "" and found[2, None] == ""
    assert linededup.dedup(spark.createDataFrame([], DOCS)).count() == 0
