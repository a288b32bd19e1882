"""Quality rules, language identification, BPE, chat formatting and LM scoring on small tables."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from paddock.llm import bpe, chat, contextmix, langid, quality

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PATH = public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, texts, langs=None, sources=None):
    return spark.createDataFrame([(i, t, (langs or {}).get(i), (sources or {}).get(i, "s"), 0) for i, t in enumerate(texts)], DOCS)


def test_quality_counts():
    assert quality.counts(None) == quality.counts("") == (0, 0, 0, 0, 0)
    text = "a b c x\na b c y\n\n z# <é>\na b c x  \na b c x"
    n, chars, symbols, dup, repeated = quality.counts(text)
    words = text.encode().split()
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    held = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    assert (n, symbols, dup, repeated) == (len(words), 3, 1, len(held))
    assert chars == sum(len(w.decode()) for w in words)


def test_quality_lines(spark):
    rnd = random.Random(0)
    line = lambda k: " ".join(rnd.choice("abcdefghij") + rnd.choice("klmnop") + str(rnd.randrange(99)) for _ in range(k))
    banner = [line(12) for _ in range(5)]
    texts = [line(60) + "\n" + line(30) for _ in range(100)] + ["\n".join(rnd.sample(banner, 5)) + "\n" + line(8 + i % 3) for i in range(30)]
    texts += [texts[0]] * 40 + [None, "", "short"]
    got = {r["doc_id"]: r for r in quality.judge(docs_of(spark, texts), ["doc_id"]).collect()}
    assert len(got) == len(texts)
    assert all(got[i]["kept"] for i in range(100)) and all(got[i]["kept"] for i in range(130, 170))
    assert not any(got[i]["kept"] for i in range(100, 130)) and not got[100]["base_failed"]
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in range(170, 173))
    other = quality.judge(docs_of(spark, texts, sources={i: None for i in range(100, 130)}), ["doc_id"])
    assert not any(r["kept"] for r in other.where("doc_id between 100 and 129").collect())
    assert quality.judge(docs_of(spark, []), ["doc_id"]).count() == 0


def test_quality_removes_lines(spark):
    """Kept documents lose the host's frequent lines, with their numbers; other hosts and texts stay as they are."""
    import corpus_pipeline

    rnd = random.Random(1)
    line = lambda k: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(k))
    own = [(line(40), line(30)) for _ in range(40)]
    texts = [f"Read  MORE here\n{a}\n\n read more HERE\t\n{b}" for a, b in own] + [line(60) + "\n", "Read more here\n" + line(60), None]
    docs = docs_of(spark, texts, sources={41: "other"})
    got = {r["doc_id"]: r for r in quality.cleaned(docs).collect()}
    assert len(got) == len(texts)
    for i, (a, b) in enumerate(own):
        assert got[i]["kept"] and got[i]["removed"] == [0, 3] and got[i]["text"] == f"{a}\n\n{b}"
    assert all(got[i]["removed"] == [] and got[i]["text"] == texts[i] for i in (40, 41, 42))
    passed = {r["doc_id"]: r for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    assert sorted(passed) == list(range(42))
    assert all(passed[i]["text"] == got[i]["text"] and passed[i]["n_chars"] == len(got[i]["text"]) for i in passed)


def test_quality_limit_is_the_same_for_large_hosts(spark):
    """Boilerplate on a few per cent of a large host depletes documents that pass the base rules; clean ones stay."""
    rnd = random.Random(2)
    line = lambda k: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(k))
    banner = line(60)
    texts = [line(60) for _ in range(1170)] + [f"{banner}\n{line(5)}" for _ in range(30)] + [f"{banner}\n{line(60)}" for _ in range(3)]
    got = {r["doc_id"]: r for r in quality.judge(docs_of(spark, texts), ["doc_id"]).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert {i for i in got if not got[i]["kept"]} == set(range(1170, 1200))


def test_language(spark):
    rnd = random.Random(5)
    parts = {"xx": ["ka", "lo", "mi", "ta"], "yy": ["sch", "ung", "ein", "ö"], "zz": ["ção", "que", "ar", "os"]}
    texts, langs = [], {}
    for i in range(240):
        lang = rnd.choice(list(parts))
        texts.append(" ".join("".join(rnd.choice(parts[lang]) for _ in range(3)) for _ in range(rnd.randint(3, 60))))
        langs[i] = lang
    train, test = range(180), range(180, 240)
    docs = docs_of(spark, texts, langs)
    model = langid.fit(docs.where(F.col("doc_id") < 180))
    got = {r["doc_id"]: r for r in langid.identify(docs.drop("lang"), model, ["doc_id"]).collect()}
    assert sum(got[i]["lang_pred"] == langs[i] for i in test) >= 58 and len(train) == 180
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs_of(spark, [None, "", "123 !!", "ka" * 600_000]), model, ["doc_id"]).collect()}
    assert odd == {0: "und", 1: "und", 2: "und", 3: "xx"}
    copied = docs_of(spark, [*texts[:60], *["que ção ar os"] * 400], langs | {i: "ww" for i in range(60, 460)})
    assert "ww" in langid.fit(copied, sample=20).langs and max(langid.fit(copied, sample=20).of) == 3
    nothing = langid.fit(docs_of(spark, []))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing, ["doc_id"]).collect()} == {"und"}


def _texts():
    rnd = random.Random(8)
    bits = ["Hello", "world's", "it's", "'re", "...", "!!!", "é", "é", "Straße", "日本語", "😀😀", "123", "a1b2", "x" * 30, "<|startoftext|>", "<|", "|>", " ", " ", "ſ", "İ", "don't", "don''t", "naïve", "̧"]
    texts = [None, "", " \n\t ", "a"]
    for n in (3, 40, 200, 900):
        texts += ["".join(rnd.choice(bits) + rnd.choice(["", "", " ", "\n"]) for _ in range(n)) for _ in range(4)]
    return texts + ["ab" * 400, "z" * 999, "lorem" * 150 + "'s", "!?" * 333, "é" * 300, "".join(rnd.choice("aehinorst") for _ in range(1500))]


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    texts = _texts()
    rnd = random.Random(4)
    prose = " ".join(rnd.choice(["plain", "words,", "It's", "Straße", "naïve.", "x1", "longer-worded"]) for _ in range(9000))
    texts += [prose, prose, "z" * 70_000, prose[:40_000] + "unsplit" * 6_000 + prose[:9_000]]
    for leaf in (37, 128, 1000, 32_768):
        got = {r["doc_id"]: r for r in bpe.encode(docs_of(spark, texts), PATH, ["doc_id"], leaf).collect()}
        assert len(got) == len(texts)
        for i, x in enumerate(texts):
            ids = t.encode(x or "", add_special_tokens=False).ids
            assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids, (leaf, i)
            assert got[i]["decoded"] == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs_of(spark, []), PATH, ["doc_id"]).count() == 0
    named = docs_of(spark, ["a b", None]).withColumns({c: F.lit("mine") for c in ("ids", "decoded", "row", "id", "piece", "head")})
    assert [(r["row"], r["piece"], len(r["ids"])) for r in bpe.encode(named, PATH, named.columns, 1).orderBy("doc_id").collect()] == [("mine", "mine", 8), ("mine", "mine", 0)]


def test_bpe_of_another_tokenizer(tmp_path):
    """A file that the word-wise path doesn't fit is encoded whole."""
    import json

    told = json.load(open(PATH, encoding="utf-8"))
    told["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"] = True
    path = tmp_path / "t.json"
    path.write_text(json.dumps(told), encoding="utf-8")
    e = bpe.Encoder(str(path))
    texts = ["Hello world's é", ""]
    assert not e.by_word and bpe.Encoder(PATH).by_word
    assert [np.frombuffer(x, "<u4").tolist() for x in e.coded(texts)[0]] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_chat_round_trip(spark):
    rnd = random.Random(6)
    bits = ["</s>", "[INST]", "[/INST]", "<|start|>", "<|end|>", "<|next|>", "<|body|>", "\\", "\\.", "\\\\", "<", "[", "<<SYS>>", "<</SYS>>", "<s>", "é😀", "\n", "a|b", "<|", "$1"]
    rows = []
    for c in range(60):
        for turn in range(rnd.randint(1, 9)):
            text = None if rnd.random() < 0.1 else "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 7)))
            rows.append((c, turn, rnd.choice(["user", "assistant", "assistant", "system", "<|end|>"]), text))
    rnd.shuffle(rows)
    rows += [(None, 0, "assistant", "x"), (100, None, None, None), (101, 1, "assistant", "q" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_conversations(df).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in out.collect():
        own = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[1] is not None, x[1] or 0))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss"] == "".join(x[3] or "" for x in own if x[2] == "assistant")
        inside = r["formatted"]
        for s in reversed(r["loss_spans"]):
            piece = inside[s["start"] : s["start"] + s["length"]]
            assert not any(m in piece for m in ("</s>", "[INST]", "[/INST]", "<|", "<<SYS>>"))
        assert r["n_blocks"] == sum(i == 0 or (own[i - 1][2] or "") != (x[2] or "") for i, x in enumerate(own))


def test_lm(spark):
    rnd = random.Random(9)
    vocab = [f"w{chr(97 + i % 26)}{i}" for i in range(400)]
    line = lambda: " ".join(rnd.choice(vocab[: rnd.choice([20, 400])]) for _ in range(rnd.randint(0, 40)))
    texts = [line() for _ in range(300)] + [None, "", "unseenword other", "Wa0 WA0"]
    docs = docs_of(spark, texts).withColumn("learn", F.col("doc_id") % 5 != 1)
    got = {r["doc_id"]: r for r in contextmix.score(docs, "learn", ["doc_id"]).collect()}
    split = [[w.decode() for w in (t or "").encode().lower().split()] + [None] for t in texts]
    c = Counter(w for i, ws in enumerate(split) if i % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in enumerate(split):
        assert got[i]["n_tokens"] == len(ws) and got[i]["train_tokens"] == n and got[i]["n_known"] == sum(c[w] > 0 for w in ws)
        assert math.isclose(got[i]["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert got[i]["score"] < 0
    known = [i for i in range(300) if i % 5 == 1]
    assert sum(got[i]["score"] for i in known) > 1.15 * sum(got[i]["base_score"] for i in known)
    assert contextmix.score(docs.where("false"), "learn", ["doc_id"]).count() == 0
    named = docs.limit(20).withColumns({c: F.lit("mine") for c in ("row", "id", "word", "n_tokens", "known", "c", "fold")})
    assert {r["word"] for r in contextmix.score(named, "learn", ["doc_id", "word", "id", "row"]).collect()} == {"mine"}
    untaught = contextmix.score(docs.limit(5).withColumn("learn", F.lit(None).cast("boolean")), "learn", ["doc_id"])
    assert {r["n_known"] for r in untaught.collect()} == {0}


def plain_mix(code, passes, k, bits, starts):
    """A mix in plain Python: (table, weights) learned from passes[fold] = [(symbols, contexts), ...], each folds's on the other's counts."""
    path = lambda s: [(int(code.place[i]), int(code.bits[i]), float(code.own[i])) for i in range(code.start[s], code.start[s] + code.length[s])]
    slot = lambda c, place: (int(c) ^ place) >> (32 - bits)
    counts = [Counter(), Counter()]
    for fold in (0, 1):
        for symbols, contexts in passes[fold]:
            for n, s in enumerate(symbols):
                for place, bit, _ in path(s):
                    for c in range(k):
                        counts[fold][c, slot(contexts[c][n], place), bit] += 1

    def state(held, c, at):
        zeros, ones = held[c, at, 0], held[c, at, 1]
        level = min(31, max(-32, round(math.log((ones + 0.4) / (zeros + 0.4)) / 0.28)))
        return sum(zeros + ones > x for x in (0, 2, 20)), level * 0.28

    first, bias, w, seen = starts.first, starts.bias, starts.gates.tolist(), {}
    for step in contextmix.STEPS:
        seen = Counter()
        for fold in (0, 1):
            for symbols, contexts in passes[fold]:
                every = [(x, [state(counts[1 - fold], c, slot(contexts[c][n], x[0])) for c in range(k)]) for n, s in enumerate(symbols) for x in path(s)]
                for at in range(0, len(every), contextmix.STEP_BITS):
                    part, wrong = every[at : at + contextmix.STEP_BITS], []
                    for (_, bit, own), held in part:
                        z = min(12, max(-12, own * first + bias + sum(w[c][g] * x for c, (g, x) in enumerate(held))))
                        seen[min(47, int((z + 12) * 2)), bit] += 1
                        wrong.append(bit - 1 / (1 + math.exp(-z)))
                    first += step * sum(e * x[2] for e, (x, _) in zip(wrong, part)) / len(part)
                    bias += step * sum(wrong) / len(part)
                    for c in range(k):
                        for g in range(4):
                            met = [(e, h[c][1]) for e, (_, h) in zip(wrong, part) if h[c][0] == g]
                            w[c][g] += step * sum(e * x for e, x in met) / max(64, len(met))
    both = counts[0] + counts[1]
    centres = [(i + 0.5) / 2 - 12 for i in range(48)]
    turned = []
    for i, c in enumerate(centres):
        p = (seen[i, 1] + 30 / (1 + math.exp(-c))) / (seen[i, 0] + seen[i, 1] + 30)
        turned.append(math.log(p / (1 - p)))

    def log10(s, contexts):
        out = 0.0
        for place, bit, own in path(s):
            z = own * first + bias
            for c in range(k):
                g, x = state(both, c, slot(contexts[c], place))
                z += w[c][g] * x
            z = math.floor((min(12, max(-12, z)) + 12) * 64 + 0.5) / 64 - 12
            z = (z + float(np.interp(z, centres, turned))) / 2
            out -= math.log10(1 + math.exp(-z if bit else z))
        return out

    return log10


def test_lm_equals_plain_python(spark, monkeypatch):
    monkeypatch.setattr(contextmix, "FEWEST_SYMBOLS", 40)
    rnd = random.Random(12)
    vocab = [f"w{chr(97 + i % 26)}{i}" for i in range(150)]
    texts = [" ".join(rnd.choice(vocab[: rnd.choice([12, 150])]) for _ in range(rnd.randint(0, 30))) for _ in range(90)]
    texts += [texts[0], texts[0], None, "", "neverseen wa0 WB1"]
    docs = docs_of(spark, texts).withColumn("learn", F.col("doc_id") % 4 != 1).coalesce(1)
    got = {r["doc_id"]: r for r in contextmix.score(docs, "learn", ["doc_id"]).collect()}
    split = [[w.decode() for w in (t or "").encode().lower().split()] for t in texts]
    learns = [i for i in range(len(texts)) if i % 4 != 1]
    c = Counter(w for i in learns for w in split[i])
    total = sum(c.values()) + len(learns)
    levels, room, cut = Counter(math.floor(math.log2(n) * 64) for n in c.values() if n > 1), 40, None
    for x in sorted(levels, reverse=True):
        room -= levels[x]
        if room < 0:
            break
        cut = x
    words = sorted((w for w, n in c.items() if n > 1 and math.floor(math.log2(n) * 64) >= cut), key=lambda w: (-c[w], w))
    assert 5 < len(words) <= 40
    own = np.array([total - len(learns) - sum(c[w] for w in words), len(learns), *[c[w] for w in words]], np.int64)
    code, number = contextmix.Code(own), {w: n + 2 for n, w in enumerate(words)}
    fold = {r["t"]: r["f"] for r in spark.createDataFrame([(t,) for t in {*texts, *c}], "t string").selectExpr("t", "cast(pmod(xxhash64(t), 2) as int) f").collect()}

    def read(ids):
        s, begins = [], []
        for i in ids:
            begins.append(len(s))
            s += [number.get(w, 0) for w in split[i]] + [1]
        return np.array(s, np.int32), contextmix.symbol_contexts(np.array(s, np.int32), np.array(begins))

    passes = [[read([i for i in learns if fold[texts[i]] == f])] for f in (0, 1)]
    mix = plain_mix(code, passes, 2, contextmix.FEWEST_BITS, contextmix.Weights.start(2))
    letters = contextmix.Code(np.bincount(np.frombuffer(" ".join(words).encode() + bytes(range(256)), np.uint8), minlength=256))
    rare = [w for w in c if w not in number]
    order = [r["word"] for r in contextmix.vocabulary(docs.select("text", "learn")).where("c > 0").collect() if r["word"] in set(rare)]
    passes = [[contextmix.spelled([w.encode() for w in order if fold[w] == f])[::2]] for f in (0, 1)]
    spell = plain_mix(letters, passes, 4, contextmix.SPELLING_BITS, contextmix.Weights.start(4))
    again = (sum(c[w] for w in rare if c[w] > 1) + 0.5) / (sum(c[w] for w in rare) + 1)
    for i in range(len(texts)):
        s, ctx = read([i])
        want = sum(mix(x, [k[n] for k in ctx]) for n, x in enumerate(s))
        for w in split[i]:
            if w not in number:
                b, _, ctx2 = contextmix.spelled([w.encode()])
                new = sum(spell(x, [k[n] for k in ctx2]) for n, x in enumerate(b))
                want += math.log10(again * c[w] / max(1, sum(c[w] for w in rare)) + (1 - again) * 10**new)
        assert abs(got[i]["score"] - want) < 0.01 * abs(want) + 0.05, (i, got[i]["score"], want)
    assert got[0]["score"] == got[90]["score"] == got[91]["score"]


def test_lm_averages_tasks_by_bits():
    """Two tasks' weights count by the bits they saw; cells add up; tasks without bits don't count."""
    start = contextmix.Weights.start(1)
    one, two, none = (contextmix.Learner(start, 0.1) for _ in range(3))
    one.first, one.n, two.first, two.n = 1.0, 30, 3.0, 10
    one.seen[0, 3], two.seen[0, 3] = 4, 5
    got = contextmix.averaged([one.row(), two.row(), none.row()], start)
    assert got.first == 1.5 and got.seen[0, 3] == 9 and np.allclose(got.gates, start.gates)
    assert contextmix.averaged([none.row()], start) is start and contextmix.averaged([], start) is start


def test_mixer_is_a_distribution():
    """Probabilities of all symbols in a context add up to one."""
    pick = np.random.default_rng(0)
    counts = pick.integers(0, 1000, 300)
    code = contextmix.Code(counts)
    s = pick.choice(300, 4000, p=counts / counts.sum()).astype(np.int32)
    ctx = contextmix.symbol_contexts(s, np.array([0]))
    tables = np.zeros((2, 1 << 18, 2), np.uint32)
    contextmix.tally(code, s, ctx, tables)
    assert tables.sum() == 2 * code.length[s].sum()
    held = contextmix.states(tables[..., 0].astype(np.float32), tables[..., 1].astype(np.float32))
    own = contextmix.Learner(contextmix.Weights.start(2), 0.02)
    own.learn(code, s, ctx, held)
    m = contextmix.Mixer(code, held, contextmix.averaged([own.row()], contextmix.Weights.start(2)))
    every = np.arange(300, dtype=np.int32)
    one = [np.full(300, c[17], np.uint32) for c in ctx]
    assert abs((10.0 ** m.log10(code, every, one)).sum() - 1) < 0.02


def test_lm_takes_texts_apart_twice(spark):
    """Once for the words, once for the symbols, which counting, both rounds of learning and scoring read."""
    taken = spark.sparkContext.accumulator(0)

    def told(t):
        taken.add(1)
        return t

    docs = docs_of(spark, [f"a b c w{i % 7} w{i}" for i in range(40)]).withColumn("learn", F.col("doc_id") % 5 != 1)
    seen = docs.withColumn("text", F.udf(told, "string").asNondeterministic()("text"))
    assert contextmix.score(seen, "learn", ["doc_id"]).count() == 40
    assert 40 <= taken.value <= 80


def test_lm_steps_go_on_across_reads(monkeypatch):
    """Weights don't depend on how many bits are read at once, also where a read ends within a symbol."""
    pick = np.random.default_rng(4)
    counts = pick.integers(0, 1000, 300)
    code = contextmix.Code(counts)
    s = pick.choice(300, 9000, p=counts / counts.sum()).astype(np.int32)
    ctx = contextmix.symbol_contexts(s, np.array([0]))
    tables = np.zeros((2, 1 << 18, 2), np.uint32)
    contextmix.tally(code, s, ctx, tables)
    held = contextmix.states(tables[..., 0].astype(np.float32), tables[..., 1].astype(np.float32))
    found = []
    for steps in (1, 3, 16):
        monkeypatch.setattr(contextmix, "READ_STEPS", steps)
        own = contextmix.Learner(contextmix.Weights.start(2), 0.1)
        own.learn(code, s, ctx, held)
        assert own.n == own.seen.sum() == code.length[s].sum() > 16 * contextmix.STEP_BITS
        found.append(np.frombuffer(own.row()))
    assert np.allclose(found[0], found[1], rtol=1e-5) and np.allclose(found[0], found[2], rtol=1e-5)


def test_lm_symbols_travel_packed():
    """Packed symbols come back as they were, from slices too; words are counted by text."""
    for most in (10, 70_000):
        model = contextmix.Model(["x"], np.zeros(most), np.zeros(most))
        s, begins = np.array([1, 5, most - 1, 1, 1], np.int32), np.array([0, 1, 4])
        packed = model.packed(s, begins)
        got, at = model.unpacked(packed)
        assert got.tolist() == s.tolist() and at.tolist() == [0, 1, 4]
        got, at = model.unpacked(packed.slice(1, 2))
        assert got.tolist() == s[1:].tolist() and at.tolist() == [0, 3]
    held = contextmix._per_text(pa.array(["a", "b", "a", "b"]), np.array([3, 0, 1])).to_pylist()
    assert [sorted((x["word"], x["n"]) for x in t) for t in held] == [[("a", 2), ("b", 1)], [], [("b", 1)]]
    assert contextmix._per_text(pa.array([], pa.string()), np.array([0, 0])).to_pylist() == [[], []]


def test_lm_looks_rare_words_up_unsorted(spark, capsys):
    docs = docs_of(spark, [f"a b w{i}" for i in range(9)]).withColumn("learn", F.lit(True))
    contextmix.score(docs, "learn", ["doc_id"]).explain()
    assert "ShuffledHashJoin [word" in capsys.readouterr().out
