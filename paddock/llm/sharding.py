"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, overfull ranges subdivided.

Records are put in order by (hash of the text, doc_id), so equal texts lie side by side. A sample drawn
with probability in proportion to size gives the boundaries of many narrow ranges of about equal bytes;
ranges that still hold too much are sampled again and subdivided. Neighbouring ranges then make up the
shards. Only the sample, the boundaries and one row per range reach the driver; all three are bounded by
parameters, not by the data. DataFrame functions only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.llm.common import materialize, unit_hash

SHARDS = 16
#: Narrow ranges aimed at, samples drawn for each, and rounds of subdividing at most.
RANGES, SAMPLES_PER_RANGE, ROUNDS = 1024, 12, 4
_BOUND = "array<struct<h:bigint,id:bigint>>"


def _range_of(bounds: list[tuple[int, int | None]]) -> Column:
    """Number of boundaries not above the record's key, by binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    held = F.from_json(F.lit(json.dumps([{"h": h, "id": i} for h, i in bounds])), _BOUND)

    def step(acc: Column, _: Column) -> Column:
        mid = ((acc["lo"] + acc["hi"]) / 2).cast("int")
        at = F.get(held, mid)
        left = (F.col("h") < at["h"]) | ((F.col("h") == at["h"]) & at["id"].isNotNull() & (F.col("id").isNull() | (F.col("id") < at["id"])))
        going = acc["lo"] < acc["hi"]
        return F.struct(
            F.when(going & ~left, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(going & left, mid).otherwise(acc["hi"]).alias("hi")
        )

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    first = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(steps, first, step, lambda acc: acc["lo"])


def _boundaries(sample: list, every: int) -> list[tuple[int, int | None]]:
    """Quantiles of the sorted sample (h, id, n: how often). A text that spans several stays alone, split by doc_id; others stay whole."""
    picked, before = [], 0
    for h, i, n in sorted(((r["h"], r["id"], r["n"]) for r in sample), key=lambda k: (k[0], k[1] is not None, k[1] or 0)):
        #: Every multiple of ``every`` picks a key; more than two picks of one key say no more.
        picks = (before + n - 1) // every - max(0, (before - 1) // every)
        picked += [(h, i)] * min(2, picks)
        before += n
    often = {h for (h, _), (g, _) in zip(picked, picked[1:]) if h == g}
    bounds: set[tuple[int, int | None]] = set()
    for h, i in picked:
        bounds.add((h, i if h in often else None))
    for h in often:
        bounds.add((h, None))
        if h < (1 << 63) - 1:
            bounds.add((h + 1, None))
    return sorted(bounds, key=lambda k: (k[0], k[1] is not None, k[1] or 0))


def _owners(held: dict[int, int], shards: int) -> dict[int, int]:
    """The shard of each range: neighbours together, then ranges move from the fullest to the emptiest while that evens them."""
    total, before, owner, own = sum(held.values()), 0, {}, [set() for _ in range(shards)]
    for r in sorted(held):
        owner[r] = min(shards - 1, int((before + held[r] / 2) * shards / total))
        own[owner[r]].add(r)
        before += held[r]
    filled = [sum(held[r] for r in rs) for rs in own]
    for _ in range(64 * shards):
        most, least = filled.index(max(filled)), filled.index(min(filled))
        gap = filled[most] - filled[least]
        moved = min((r for r in own[most] if held[r] < gap), key=lambda r: (abs(held[r] - gap / 2), r), default=None)
        if moved is None:
            break
        own[most].remove(moved)
        own[least].add(moved)
        owner[moved] = least
        filled[most], filled[least] = filled[most] - held[moved], filled[least] + held[moved]
    return owner


def shard(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES, seed: int = 5) -> DataFrame:
    """Shards of near equal bytes: doc_id, size, text_crc32, shard, range, slot (gapless within its shard).

    A record's size is the UTF-8 length of its text (null: 0) plus 1. Equal texts share a range, and so
    a shard, unless they alone fill several ranges; then doc_id splits them. Null texts form one group;
    null doc_ids come first. Rows equal in text and doc_id stay in one range. An empty table gives no rows.
    """
    text = F.col("text")
    slim = materialize(
        docs.select(
            F.col("doc_id"),
            F.col("doc_id").cast("long").alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(text, text.isNull()).alias("h"),
        )
    )
    total = slim.agg(F.sum("size")).first()[0] or 1
    rate = ranges * SAMPLES_PER_RANGE / total
    draw = unit_hash("h", "id", F.lit(seed))
    bounds = _boundaries(slim.where(draw < F.col("size") * rate).groupBy("h", "id").agg(F.count(F.lit(1)).alias("n")).collect(), SAMPLES_PER_RANGE)
    most = 3 * total / ranges
    for k in range(1, ROUNDS + 1):
        placed = slim.withColumn("range", _range_of(bounds))
        stats = (
            placed.groupBy("range")
            .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), (F.min(F.struct("h", "id")) != F.max(F.struct("h", "id"))).alias("divisible"))
            .collect()
        )
        over = [r["range"] for r in stats if r["bytes"] > most and r["divisible"]]
        if not over or k == ROUNDS:
            break
        again = placed.where(F.col("range").isin(over) & (unit_hash("h", "id", F.lit(seed + k)) < F.col("size") * rate * 2))
        more = _boundaries(again.groupBy("h", "id").agg(F.count(F.lit(1)).alias("n")).collect(), SAMPLES_PER_RANGE)
        if not set(more) - set(bounds):
            break
        bounds = sorted({*bounds, *more}, key=lambda b: (b[0], b[1] is not None, b[1] or 0))
    owner = _owners({r["range"]: r["bytes"] for r in stats}, shards)
    base, filled = {}, [0] * shards
    for r in sorted(stats, key=lambda r: r["range"]):
        s = owner[r["range"]]
        base[r["range"]], filled[s] = filled[s], filled[s] + r["n"]
    n = len(bounds) + 1
    lookup = lambda held, kind: F.from_json(F.lit(json.dumps([held.get(i, 0) for i in range(n)])), f"array<{kind}>")
    order = Window.partitionBy("range").orderBy("h", "id", "text_crc32", "size")
    return (
        slim.withColumn("range", _range_of(bounds))
        .withColumn("_n", F.row_number().over(order).cast("long"))
        .withColumn("shard", F.get(lookup(owner, "int"), F.col("range")))
        .withColumn("slot", F.get(lookup(base, "bigint"), F.col("range")) + F.col("_n") - 1)
        .select("doc_id", "size", "text_crc32", "shard", "range", "slot")
    )
