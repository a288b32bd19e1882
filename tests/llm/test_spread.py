"""Sharding, mixing and the pipeline: laws that hold on small tables."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from paddock.llm import mixing, sharding

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(seed=0, n=400):
    rnd = random.Random(seed)
    rows = [(i, " ".join("w%d" % rnd.randrange(99) for _ in range(int(rnd.paretovariate(1.1)) * 5 % 900)), "en", rnd.choice(["a", "b", "c", None, "é"]) if i % 3 else "hot", 0) for i in range(n)]
    return rows + [(n + k, "copy copy copy " * 9, "en", "hot", 0) for k in range(n // 2)] + [(5000, None, None, None, None), (5001, "", None, "z", None), (None, "nul id", "en", "a", 0), (6001, "again", "en", "a", 0), (6001, "again", "en", "a", 0)]


def test_sharding(spark):
    rows = corpus()
    got = sharding.shard(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    size, slots, place = Counter(), defaultdict(list), defaultdict(set)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        t = text[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode())
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        place[t].add(r["shard"])
    assert set(size) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size[s] for s in range(16)) <= max(r["size"] for r in got) + 50
    assert all(len(p) == 1 for t, p in place.items() if t and not t.startswith("copy copy"))
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0


def test_apportionment_is_sainte_lague(spark):
    rnd = random.Random(1)
    for seats in (0, 1, 7, 100, 999):
        w = [rnd.choice([0.0, 1.0, 3.0, rnd.random() * 50]) for _ in range(9)]
        most = [rnd.choice([0, 3, 10_000]) for _ in w]
        want = [0] * 9
        for _ in range(seats):
            free = [i for i in range(9) if w[i] > 0 and want[i] < most[i]]
            if not free or sum(w) == 0:
                break
            want[max(free, key=lambda i: (w[i] / (2 * want[i] + 1), -i))] += 1
        df = spark.createDataFrame([(i, w[i], seats, most[i], 0) for i in range(9)], "id bigint, w double, seats bigint, most bigint, g int")
        got = {r["id"]: r["out"] for r in mixing.apportion(df, ["g"], "w", "seats", "most", "out").collect()}
        assert [got[i] for i in range(9)] == want
    df = spark.createDataFrame([(0, 10.0, 100, 3, 0), (1, 1.0, 100, 500, 0), (2, 1.0, 100, 500, 0)], "id bigint, w double, seats bigint, most bigint, g int")
    assert [r["out"] for r in mixing.apportion(df, ["g"], "w", "seats", "most", "out").orderBy("id").collect()] == [3, 49, 48]
    w = [10.0, 7.5, 3.0, 0.4]
    df = spark.createDataFrame([(i, x, 41, 10_000, 0) for i, x in enumerate(w)], "id bigint, w double, seats bigint, most bigint, g int")
    want = [0] * 4
    for _ in range(41):
        want[max(range(4), key=lambda i: (w[i] / (2 * want[i] + 1), -i))] += 1
    assert [r["out"] for r in mixing.apportion(df, ["g"], "w", "seats", "most", "out").orderBy("id").collect()] == want


def water(sizes):
    """Targets by sharing again until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / w for s in free}
            break
        out |= {s: 3.0 * sizes[s] for s in over}
        free -= set(over)
        left -= sum(3 * sizes[s] for s in over)
    return out


def test_mixing(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    sizes, taken = Counter(), Counter()
    for d, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = water(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3, 0.03 * want[s]), (s, taken[s], want[s])
    again = sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in mixing.mix(docs).collect())
    assert again == sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in got)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r["doc_id"], r["source"]] += len(r["text"].split())
    total = Counter()
    for r in got:
        total[r["doc_id"], r["source"]] += r["taken"]
    assert +words == +total
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and 4 <= len(corpus_pipeline.STAGES) <= 5
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == counts[-1] and last.where("n_tokens = 0").count() == 0


def test_registered(spark):
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


#: Names that operators use for columns of their own.
CLASHES = "size shard range slot rounds arcs _key1 _key2 key1 key2 text_hash kept n_words base_failed removed n_lines lines gone row th _src _doc_id of_doc w0 node first id n_tokens ids decoded odd word fold c _text".split()


def test_clashing_columns(spark):
    """Every operator and stage on documents with columns named like the operators' own; stages return them as they were."""
    import corpus_pipeline

    from paddock.llm import contextmix, langid, linededup, quality, simhash

    rnd = random.Random(4)
    rows = [(i, " ".join("w%d" % rnd.randrange(40) for _ in range(70)), "en", "ab"[i % 2], 0) for i in range(30)]
    rows += [rows[0], rows[1], (None, None, None, None, None), (99, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        got = out.collect()
        assert got, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
            assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in got for c in CLASHES), name
    assert len(sharding.shard(docs).collect()) == len(mixing.mix(docs).collect()) == len(rows)
    assert len(simhash.near_duplicates(docs).collect()) == len(linededup.dedup(docs).collect()) == len(rows)
    assert len(quality.judge(docs, docs.columns).collect()) == len(quality.cleaned(docs).collect()) == len(rows)
    assert len(langid.identify(docs, langid.fit(docs), ["doc_id"]).collect()) == len(rows)
    learned = contextmix.score(docs.withColumn("learn", F.lit(True)), "learn", ["doc_id", "row", "id", "word"])
    assert {r["word"] for r in learned.collect() if r["doc_id"] == 3} == {"word3"}
