"""Ranked lexical search: document-sharded postings in compressed rows, scored a term at a time.

Each task packs its documents into shards of bounded size: one row with a vocabulary and, per term, the
places of its documents and integer impacts. Query items meet every shard in blocks; a shard adds each
term's impacts into a dense array, picks its best documents with ties whole, and Spark merges the shards'
picks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paddock.llm.common import materialize
from paddock.session import ship

#: Texts of a shard: documents and bytes at most (one longer text is a shard of its own). Items of a query block.
SHARD_DOCS, SHARD_BYTES, BLOCK_ITEMS = 65_536, 16_000_000, 4_096
TOP = 50
#: What a term is made of (ASCII letters and digits, every byte of other characters), lower-cased.
_TERM_BYTES = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))
_SHARD = "task int, number int, n_docs bigint, n_terms bigint, vocab array<string>, df array<int>, ids binary, lengths binary, docs binary, values binary"
_HITS = "item_id bigint, doc_id bigint, score bigint"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_TERM_BYTES).split()


def _packed(task: int, number: int, ids: list, texts: list[str]) -> tuple | None:
    """One shard of documents; those without a term are left out. ``values`` are term frequencies."""
    names: dict[bytes, int] = {}
    kept, lengths, place, term, tf = [], [], [], [], []
    for doc_id, text in zip(ids, texts):
        found = terms(text)
        if not found:
            continue
        counts = Counter(found)
        place.append(np.full(len(counts), len(kept), np.int32))
        term.append(np.fromiter((names.setdefault(t, len(names)) for t in counts), np.int32, len(counts)))
        tf.append(np.fromiter(counts.values(), np.int32, len(counts)))
        kept.append(doc_id)
        lengths.append(len(found))
    if not kept:
        return None
    at = np.concatenate(term)
    order = np.argsort(at, kind="stable")
    df = np.bincount(at, minlength=len(names)).astype(np.int32)
    # null ids sort behind all others
    own = np.array([np.iinfo(np.int64).max if x is None else x for x in kept], np.int64)
    null = np.array([x is None for x in kept], np.uint8)
    return (
        task, number, len(kept), int(sum(lengths)), [t.decode("utf-8", "replace") for t in names], df, own.tobytes() + null.tobytes(), np.array(lengths, np.int64).tobytes(),
        np.concatenate(place)[order].tobytes(), np.concatenate(tf)[order].tobytes(),
    )


def _row(packed: tuple) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(packed, kinds)], names=[c.split()[0] for c in _SHARD.split(", ")])


def build(docs: DataFrame) -> DataFrame:
    """The index of ``docs`` (doc_id, text), as a table in the shared folder with a row per shard.

    ``values`` are impacts, (10^9 tf) div (1000 tf + 20 m) with m = 100 - 50 + ((50 n N) div L); N and L are
    counted over all documents first. Documents without a term take no part.
    """
    ship(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text is None:
                    continue
                if ids and (size + len(text) > SHARD_BYTES or len(ids) >= SHARD_DOCS):
                    if (row := _packed(task, number, ids, texts)) is not None:
                        yield _row(row)
                        number += 1
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if ids and (row := _packed(task, number, ids, texts)) is not None:
            yield _row(row)

    counted = materialize(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(pack, _SHARD))
    n, total = counted.agg(F.sum("n_docs"), F.sum("n_terms")).first()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                lengths, docs_at, tf = np.frombuffer(r["lengths"], np.int64), np.frombuffer(r["docs"], np.int32), np.frombuffer(r["values"], np.int32).astype(np.int64)
                m = 100 - 50 + (50 * lengths * n) // total
                r["values"] = ((1_000_000_000 * tf) // (1000 * tf + 20 * m[docs_at])).astype(np.int32).tobytes()
                yield _row(tuple(r.values()))

    return materialize(counted.mapInArrow(weigh, _SHARD))


def _best(score: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores above 0, equal ones by ascending id, nulls last."""
    some = np.flatnonzero(score > 0)
    if len(some) > k:
        held = score[some]
        least = held[np.argpartition(held, len(held) - k)[len(held) - k]]
        some = some[held >= least]  # ties with the last one stay until ids decide
    return some[np.lexsort((ids[some], null[some], -score[some]))][:k]


def search(index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of ``index`` for each of ``items`` (item_id, text).

    A term weighs floor(1000 ln((2N + 2) / (2 df + 1))); a score is the sum of weight times impact over an
    item's distinct terms. Equal scores go by ascending doc_id, null last; repeated doc_ids are documents of
    their own. Rows of one item_id are one item with all their terms; items without a term, and empty
    tables, give no rows.
    """
    n = index.agg(F.sum("n_docs")).first()[0] or 0
    lowered = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = items.select(F.col("item_id").cast("bigint"), F.explode(F.array_distinct(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))).alias("term")).where("term != ''").distinct()
    held = index.select(F.explode(F.arrays_zip("vocab", "df")).alias("t")).select(F.col("t.vocab").alias("term"), F.col("t.df").cast("long").alias("df"))
    df = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    ready = materialize(asked.join(df.withColumn("w", weight), "term").groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("terms")))
    blocks = max(1, -(-ready.count() // BLOCK_ITEMS))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")
    shards = index.select("task", "number", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vocab", "df", "ids", "docs", "values")
    # every item meets every shard: one copy of its terms for each, keyed by the task and number of the shard;
    # neither side has a size that is known to stay small, so neither is broadcast
    made = index.groupBy("task").agg((F.max("number") + 1).alias("n"))
    tasks = made.agg(F.max("task")).first()[0] or 0
    copies = ready.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(tasks))).alias("task"), "item_id", "terms")
    dealt = copies.join(made.hint("merge"), "task").withColumn("number", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    by = ["task", "number", "block"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            r = left.to_pylist()[0]
            ends = np.cumsum(np.array(r["df"], np.int64))
            place = dict(zip(r["vocab"], range(len(ends))))
            docs_at, values = np.frombuffer(r["docs"], np.int32), np.frombuffer(r["values"], np.int32)
            size = len(r["ids"]) // 9
            ids, null = np.frombuffer(r["ids"], np.int64, size), np.frombuffer(r["ids"], np.uint8, size, 8 * size)
            total = np.zeros(size, np.int64)
            for item, asked_terms in zip(right.column("item_id").to_pylist(), right.column("terms").to_pylist()):
                total[:] = 0
                for t in asked_terms:
                    if (i := place.get(t["term"])) is not None:
                        a, z = ends[i] - r["df"][i], ends[i]
                        total[docs_at[a:z]] += t["w"] * values[a:z].astype(np.int64)
                out += [(item, None if null[i] else int(ids[i]), int(total[i])) for i in _best(total, ids, null, k)]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("item_id", "doc_id", "score"), columns)})

    hits = shards.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(score, _HITS)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
