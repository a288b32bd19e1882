"""SimHash near-dedup over a byte-position inverted index with count filtering.

A fingerprint of 64 bits is eight positional bytes, a wider one more. Fingerprints that differ in at
most four of 64 bits differ in at most four bytes, so they share at least four positional bytes; by
counting, at least three of the first seven. The inverted index is therefore kept on triples of
positional bytes of the first seven (35 lists of 24 bits each). The entries of a list are candidates:
the positional bytes that each pair shares are tallied, pairs below the guaranteed four go, and the bits
of those that are left are compared.

Texts of a similarity of 0.8 differ in 15 % of their bits, however many there are, so no number of
differing bits covers them and guarantees shared bytes short of all pairs. For those the index is kept
on all pairs (or, with more documents, triples or fours) of the bytes within groups of eight positions,
with as many groups as bring 19 of 20 such pairs together; the tally over all positions drops what met
by chance, and links are verified on the texts' shingles themselves. See ``similar``.

Equal fingerprints are one entry. A list with more than BLOCK entries is dealt out as pairs of blocks to
many tasks; a task returns links that connect what is linked in it, closest first, at most one per
entry, never all pairs. All links together have the components of all pairs within the distance.

Where links are verified on the texts afterwards, a link that fails may stand for others that wouldn't. So
groups with a failed link are gone through again, with each entry's closest partners in components other
than its own, then the next closest, until all its partners have been looked at (``verified_links``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.llm.common import materialize
from paddock.llm.components import connected
from paddock.session import ship


class Rule(NamedTuple):
    """Words of a fingerprint, sets of positions whose bytes key the index, and when two fingerprints link:
    positional bytes that they share at least, bits that they differ in at most."""

    words: int
    sets: list[tuple[int, ...]]
    shared: int
    bits: int


#: Four of 64 bits: at least four shared bytes, of which three are among the first seven.
FOUR_BITS = Rule(1, list(combinations(range(7), 3)), 4, 4)
#: Most entries, on average, of a list; groups of eight positions by the bytes of a key; similarity that links.
LIST, GROUPS, SIMILAR = 64, {2: 3, 3: 6, 4: 19}, 0.8
#: Entries of a list that are compared at once, entries that are compared by shifts, and shingles hashed at once.
BLOCK, SHIFTS, CHUNK = 1024, 64, 1 << 16
#: How many of an entry's partners in a list have been looked at after each further pass.
RANKS = (32, 1 << 62)
_SEED = 42


def similar(documents: int) -> Rule:
    """The rule for texts of a similarity of 0.8 or more among so many documents.

    A byte is shared with probability p = (1 - acos(8/9) / pi) ** 8 = 0.27, so two of a group's eight bytes are
    with 0.68, three with 0.37, four with 0.14; the groups bring 0.95 or more of the pairs together. Keys
    have as many bytes as keep lists at LIST entries on average, so they don't grow with the corpus.
    Expected shared bytes are over twice those asked for, and 99 of 100 pairs differ in no more bits.
    """
    size = next((k for k in (2, 3) if documents <= LIST << 8 * k), 4)
    sets = [tuple(8 * g + i for i in c) for g in range(GROUPS[size]) for c in combinations(range(8), size)]
    words = max(4, GROUPS[size])
    return Rule(words, sets, words, int(64 * words * 0.1516 + 2.33 * (64 * words * 0.1516 * 0.8484) ** 0.5))


def _remixed(h: np.ndarray) -> np.ndarray:
    """Another hash of the shingles from their hashes: an odd step and a multiply-xorshift round."""
    h = (h + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def fingerprint(text: str | None, n: int = 4, width: int = 1) -> np.ndarray:
    """SimHash of the n-word shingles, repeats included, in ``width`` 64-bit words; zeros without words."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(width, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(n, len(words))
    total = len(words) - k + 1
    ones = np.zeros(64 * width, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, CHUNK):
        upto = min(total, at + CHUNK)
        spans = zip(starts[at:upto].tolist(), ends[at + k - 1 : upto + k - 1].tolist())
        h = [np.array([digest(joined[a:b], _SEED) for a, b in spans], np.uint64)]
        while len(h) < width:
            h.append(_remixed(h[-1]))
        h = np.stack(h, axis=1)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > total).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view("<u8")


def words_of(rule: Rule) -> list[str]:
    return [f"w{i}" for i in range(rule.words)]


def fingerprints(docs: DataFrame, n: int = 4, keep: list[str] = ["doc_id"], width: int = 1) -> DataFrame:  # noqa: B006
    """``keep`` columns and the fingerprint's words w0, w1, ... (signed 64-bit) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), n, width) for t in batch.column("_text")], np.uint64).reshape(-1, width)
            own = [pa.array(np.ascontiguousarray(c), pa.int64()) for c in found.view(np.int64).T]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], names=names)

    ship(docs.sparkSession)
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(f"w{i}", T.LongType()) for i in range(width)]])
    names = schema.names
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def shared_bytes(apart: np.ndarray) -> np.ndarray:
    """How many positional bytes are alike, from rows of words that are the exclusive or of two fingerprints."""
    x = apart | apart >> np.uint64(4)
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    x &= np.uint64(0x0101010101010101)
    return 8 * apart.shape[-1] - np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def _filtered(bits: np.ndarray, i: np.ndarray, j: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The candidates (i, j) that link, and the bits that they differ in: first the tally of shared bytes, then the bits."""
    apart = bits[i] ^ bits[j]
    enough = shared_bytes(apart) >= rule.shared
    i, j, apart = i[enough], j[enough], apart[enough]
    differ = np.bitwise_count(apart).sum(axis=1, dtype=np.int64)
    near = differ <= rule.bits
    return i[near], j[near], differ[near]


def forest(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of links (i, j, distance) between entries those that connect the same, closest first."""
    i, j, d = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((j, i, d))
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    kept = []
    for k, x, y in zip(order.tolist(), i[order].tolist(), j[order].tolist()):
        a, b = root(x), root(y)
        if a != b:
            up[max(a, b)] = min(a, b)
            kept.append(k)
    return i[kept], j[kept]


def _ranked(found: list[tuple[np.ndarray, ...]], label: np.ndarray, ranks: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of links (i, j, distance) those between different labels that are among the partners ``ranks`` (from, below) of an entry, closest first."""
    i, j, d = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    best = np.full(len(i), np.iinfo(np.int64).max)
    for one, other in ((i, j), (j, i)):
        order = np.lexsort((other, d, one))
        held = one[order]
        first = np.searchsorted(held, held)
        best[order] = np.minimum(best[order], np.arange(len(held)) - first)
    asked = (best >= ranks[0]) & (best < ranks[1]) & (label[i] != label[j])
    return i[asked], j[asked]


def _within(
    bits: np.ndarray, keys: np.ndarray, own: np.ndarray, rule: Rule, label: np.ndarray | None = None, ranks: tuple[int, int] = (0, 0)
) -> tuple[np.ndarray, np.ndarray]:
    """Links within lists: entries (rows of ``bits``) lie list by list; ``keys`` has (key, x, y) and ``own`` the entry's block.

    Without labels what connects them, else what ``_ranked`` says.
    """
    edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    begins, ends = np.r_[0, edges], np.r_[edges, len(keys)]
    sizes = ends - begins
    found = []
    #: Small lists all at once: each entry with the one d places on.
    last = np.repeat(np.where(sizes <= SHIFTS, ends, begins), sizes)
    at = np.flatnonzero(np.arange(len(keys)) + 1 < last)
    for d in range(1, SHIFTS):
        at = at[at + d < last[at]]
        if not len(at):
            break
        for k in range(0, len(at), 1 << 18):
            some = at[k : k + (1 << 18)]
            found.append(_filtered(bits, some, some + d, rule))
    told = [_ranked(found, label, ranks)] if label is not None else []
    for a, b in zip(begins[sizes > SHIFTS].tolist(), ends[sizes > SHIFTS].tolist()):
        rows = a + (np.arange(b - a) if keys[a, 1] == keys[a, 2] else np.flatnonzero(own[a:b] == keys[a, 1]))
        cols = rows if keys[a, 1] == keys[a, 2] else a + np.flatnonzero(own[a:b] == keys[a, 2])
        held = []
        for k in range(0, len(rows), 128):
            i, j = (x.ravel() for x in np.meshgrid(rows[k : k + 128], cols, indexing="ij"))
            held.append(_filtered(bits, *((i[i < j], j[i < j]) if rows is cols else (i, j)), rule))
        if label is not None:
            told.append(_ranked(held, label, ranks))
            continue
        i, j = forest(held)
        found.append((i, j, np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)))
    if label is not None:
        return tuple(np.concatenate(x) for x in zip(*told))
    return forest(found)


def links(fps: DataFrame, rule: Rule = FOUR_BITS, ranks: tuple[int, int] | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints (structs of words) that have the components of all pairs by ``rule``.

    ``fps`` has the words w0, w1, ... of distinct fingerprints. With ``ranks`` (from, below) it has ``label``
    too, and what returns are the pairs of different labels at those places among an entry's partners in a list.
    """
    extra = [] if ranks is None else ["label"]
    words = words_of(rule)
    byte = lambda i: F.shiftrightunsigned(words[i // 8], 8 * (i % 8)).bitwiseAND(255)
    keys = F.array(*[sum((byte(i) * (1 << 8 * m) for m, i in enumerate(held)), F.lit(n << 32)) for n, held in enumerate(rule.sets)])
    index = fps.select(*words, *extra, F.explode(keys).alias("key"))
    large = materialize(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select(F.col("key").alias("_key"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    held = (
        index.join(large, F.col("key") == F.col("_key"), "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64(*words), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", *words, *extra)
    )
    names = [f"{side}{i}" for side in "ab" for i in range(rule.words)]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups arrive sorted, so they come one after another; one is held at a time."""
        rest: pd.DataFrame | None = None
        for part in batches:
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            last = part[["key", "x", "y"]].iloc[-1] if len(part) else None
            if last is None:
                continue
            open_ = (part["key"] == last["key"]) & (part["x"] == last["x"]) & (part["y"] == last["y"])
            rest = part[open_]
            yield found(part[~open_])
        if rest is not None:
            yield found(rest)

    def found(part: pd.DataFrame) -> pd.DataFrame:
        bits = np.ascontiguousarray(part[words].to_numpy(np.int64)).view(np.uint64)
        told = {} if ranks is None else {"label": part["label"].to_numpy(np.int64), "ranks": ranks}
        i, j = _within(bits, part[["key", "x", "y"]].to_numpy(np.int64), part["own"].to_numpy(np.int64), rule, **told) if len(part) > 1 else ([], [])
        return pd.DataFrame(np.hstack([bits[i], bits[j]]).view(np.int64).reshape(-1, len(names)), columns=names)

    dealt = held.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    out = dealt.mapInPandas(compare, ", ".join(f"{c} bigint" for c in names))
    return out.select(*[F.struct(*[F.col(f"{side}{i}").alias(w) for i, w in enumerate(words)]).alias(side) for side in "ab"]).distinct()


def near_duplicates(docs: DataFrame, n: int = 4) -> DataFrame:
    """doc_id, fp, component_id of every document: components of links at four or fewer bits.

    component_id is the smallest doc_id reachable. Null and blank texts have fingerprint 0 and link like
    any other; null doc_ids belong to their component but never name it. Repeated rows stay rows. Columns
    beside doc_id and text are not looked at; an empty table gives no rows.
    """
    own = materialize(fingerprints(docs, n).withColumnRenamed("w0", "fp"))
    #: Copies are counted up to one row a fingerprint before anything is joined.
    nodes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected(materialize(links(nodes.select(F.col("fp").alias("w0"))).select(F.col("a.w0").alias("a"), F.col("b.w0").alias("b"))))
    roots = nodes.join(found, nodes["fp"] == found["node"], "left").select(F.col("fp").alias("_fp"), F.coalesce("root", "fp").alias("root"), "least")
    roots = materialize(roots)
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(roots.join(least, "root").select("_fp", "component_id"))
    return own.join(named, own["fp"] == F.col("_fp")).select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Distinct hashes of the n-word shingles, sorted; a text of fewer words is one shingle, without words none."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    k = min(n, len(words))
    found = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), _SEED) for i in range(len(words) - k + 1)), np.uint64, len(words) - k + 1)
    return np.unique(found).view(np.int64)


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """node, held: the shingles of each text (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingle_set(t.as_py(), n) for t in batch.column("text")]
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], names=["node", "held"])

    return materialize(texts.mapInArrow(run, "node bigint, held array<bigint>"))


def _verified(found: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The links (a, b) whose shingles (node, held; one row a node) are alike by ``least`` of all of them."""
    one, two = (sets.select(F.col("node").alias(f"_{c}"), F.col("held").alias(f"_held_{c}")) for c in "ab")
    met = found.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b"))
    both = F.size(F.array_intersect("_held_a", "_held_b"))
    return met.where(both >= least * (F.size("_held_a") + F.size("_held_b") - both)).select("a", "b")


def verified_links(nodes: DataFrame, texts: DataFrame, rule: Rule, n: int, least: float) -> DataFrame:
    """node, root of the components of pairs that ``rule`` finds and whose texts share ``least`` of their shingles.

    ``nodes`` has node and the words of distinct fingerprints, ``texts`` one row (node, text) of each. The first
    pass verifies what connects the candidates. Only groups with a link that failed are looked at further:
    their entries' partners by rank, as long as they lie in other components. Ranks count all partners and so
    don't move between passes; the last one has no end, so none is left out.
    """
    names = words_of(rule)
    node = lambda side: F.xxhash64(*[f"{side}.{w}" for w in names]).alias(side)
    found = materialize(links(nodes.select(*names), rule).select(node("a"), node("b")).where("a != b"))
    asked = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets(texts.join(asked, "node", "left_semi"), n)
    good = materialize(_verified(found, sets, least))
    failed = found.join(good, ["a", "b"], "left_anti").select("a")
    loose = connected(found)
    if failed.isEmpty():
        return loose
    open_ = materialize(failed.join(loose, F.col("a") == F.col("node")).select("root").distinct())
    again = materialize(nodes.join(loose.join(open_, "root", "left_semi").select("node"), "node", "left_semi").select("node", *names))
    #: A group without a failed link is a component as it is; the others are told by their good links alone.
    closed = loose.join(open_, "root", "left_anti").select("node", "root")
    good = materialize(good.join(again.select(F.col("node").alias("a")), "a", "left_semi").select("a", "b"))
    own = connected(good)
    for ranks in zip((0, *RANKS), RANKS):
        held = again.join(own.select(F.col("node").alias("of"), "root"), F.col("node") == F.col("of"), "left").select(*names, F.coalesce("root", "node").alias("label"))
        more = links(held, rule, ranks).select(node("a"), node("b")).where("a != b")
        more = materialize(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        new = materialize(_verified(more, sets, least))
        if not new.isEmpty():
            good = good.unionByName(new)
            own = connected(good)
    return closed.unionByName(own.select("node", "root"))


def one_of_each(docs: DataFrame, n: int = 5, least: float = SIMILAR) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id (null last), then text hash.

    Shingles have five words; texts link that share at least ``least`` of their shingles, as far as the
    index of ``similar`` brings them together (19 of 20 at 0.8, nearly all from 0.85), in dense groups of
    texts just below that too; texts of equal wide fingerprints are one. Columns stay as they are, whatever their names; of rows equal in doc_id and text
    one stays. Texts without words are one component; an empty table gives no rows.
    """
    #: The user's columns travel as one, so their names can't meet ours.
    held = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", F.xxhash64("doc_id", "text").alias("key1"), F.xxhash64(F.lit("second"), "doc_id", "text").alias("key2"))
    rule = similar(docs.count())
    own = fingerprints(held, n, ["doc_id", "key1", "key2"], rule.words)
    own = materialize(own.withColumn("node", F.xxhash64(*words_of(rule))))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key1", "key2")).alias("first")
    nodes = materialize(own.groupBy("node").agg(first, *[F.min(w).alias(w) for w in words_of(rule)]))
    reps = nodes.select("node", F.col("first.key1").alias("key1"), F.col("first.key2").alias("key2"))
    texts = held.select("key1", "key2", "text").join(reps, ["key1", "key2"]).select("node", "text").dropDuplicates(["node"])
    roots = verified_links(nodes, texts, rule, n, least)
    met = nodes.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    winners = materialize(met.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("w")).select("w.key1", "w.key2"))
    return held.join(winners, ["key1", "key2"]).dropDuplicates(["key1", "key2"]).select("row.*")
