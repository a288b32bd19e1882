"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source's documents are laid out in a seeded order and cut into blocks of equal token counts.
Highest quotients give every source its number of blocks, a second apportionment gives every shard of
a source its integer quota, and each shard takes its quota as whole rounds plus a seeded run of blocks.
Everything runs on a narrow table of (row, source, size); no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.llm.common import SPACE, materialize, packed, row_key, unpacked, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: No source's target, and so no document, exceeds this many times its own size.
MOST_REPEATS = 3
#: Tokens of a block; small sources lower it so that each has at least MIN_BLOCKS.
BLOCK_TOKENS, MIN_BLOCKS = 256, 256
#: Rows of a shard, the unit whose documents one task lays out.
SHARD_ROWS = 4_000


def apportion(parties: DataFrame, group: list[str], weight: str, seats: str, most: str, out: str) -> DataFrame:
    """Sainte-Laguë: add ``out``, the seats that the highest quotients weight / (2 j + 1) give each row.

    ``parties`` has one row per party, ``seats`` holds the seats to give within ``group`` and ``most`` the
    party's limit. Seats that every party surely gets are counted in closed form; only those near the
    cutoff are ranked. Ties go to the lower ``id``.
    """
    whole = Window.partitionBy(*group)
    #: What each party gets in proportion when limits bind: in order of limit / weight, the parties before the first whose limit doesn't cut are full.
    ratio = F.when(F.col(weight) > 0, F.col(most) / F.col(weight))
    by_limit = Window.partitionBy(*group).orderBy(F.col("_ratio").asc_nulls_last(), F.col("id").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    met = (
        parties.withColumn("_ratio", ratio)
        .withColumn("_rest", F.col(seats) - F.coalesce(F.sum(F.when(F.col("_ratio").isNotNull(), F.col(most))).over(before), F.lit(0)))
        .withColumn("_weights", F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(before), F.lit(0)))
        .withColumn("_level", F.try_divide("_rest", "_weights"))
        .withColumn("_nth", F.row_number().over(by_limit))
        .withColumn("_water", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_nth", "_level"))).over(whole)["_level"])
        .withColumn("_fair", F.when(F.col("_water").isNull(), F.when(F.col(weight) > 0, F.col(most)).otherwise(0)).otherwise(F.least(F.col(weight) * F.col("_water"), F.col(most).cast("double"))))
    )
    slack = F.ceil(F.coalesce(F.try_divide(F.col(weight), F.sum(weight).over(whole)), F.lit(0.0)) * F.count(F.lit(1)).over(whole) / 2) + 2
    sure = F.greatest(F.lit(0).cast("long"), (F.floor(F.col("_fair") + 0.5) - slack).cast("long"))
    near = (
        met.withColumn("_sure", F.least(sure, F.col(most)))
        .withColumn("_slack", slack)
        .withColumn("_open", F.col(seats) - F.sum("_sure").over(whole))
        .withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), (2 * F.col("_slack") + 2).cast("long"))))
        .withColumn("_takes", (F.col("_sure") + F.col("_j") < F.col(most)) & (F.col(weight) > 0))
        .withColumn("_q", F.col(weight) / (2 * (F.col("_sure") + F.col("_j")) + 1))
    )
    ranked = near.withColumn(
        "_rank",
        F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_takes"), F.desc("_q"), F.col("id").asc_nulls_last())),
    )
    keys = [*group, "id"]
    won = ranked.groupBy(*[F.col(c).alias(f"_k_{c}") for c in keys]).agg(
        (F.max("_sure") + F.count_if((F.col("_rank") <= F.col("_open")) & F.col("_takes"))).cast("long").alias(out)
    )
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return parties.join(won, same, "left").select(*parties.columns, out)


def targets(sizes: DataFrame) -> DataFrame:
    """Per source (``source``, ``source_size``): its ``target`` in words.

    Weights share the total; a target stops at MOST_REPEATS times the source, and the excess is shared
    again by weight until none is above. That fixed point is the water level below: with sources in
    order of limit / weight, the level is the first that no later source's limit cuts.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    n = F.row_number().over(order)
    by_limit = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    capped = (
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((n - 1) % len(WEIGHTS) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * float(MOST_REPEATS))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_rest", F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_rest") / F.col("_weights"))
        .withColumn("_nth", F.row_number().over(by_limit))
        .withColumn("_first", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.col("_nth"))).over(every))
        .withColumn("_water", F.max(F.when(F.col("_nth") == F.col("_first"), F.col("_level"))).over(every))
    )
    target = F.when(F.col("_nth") >= F.col("_first"), F.col("weight") * F.col("_water")).otherwise(F.col("_cap"))
    return capped.withColumn("target", target).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, seed: int = 17, text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Mix ``docs`` (doc_id, source, text): one row per document with what the mix takes of it.

    Columns: doc_id, source, size, source_size, target, taken, rounds (how often the whole document is
    taken), arcs (further word ranges [start, end) of it). Null texts have size 0, a null source is a
    source of its own, repeated rows are documents of their own; an empty table gives no rows.
    """
    return _takes(
        docs.select("doc_id", "source", word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("text_hash")),
        seed,
        block_tokens,
    )


def _takes(rows: DataFrame, seed: int, block_tokens: int) -> DataFrame:
    slim = materialize(rows)
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    goal = targets(sizes.select("source", "source_size"))
    #: One row per source: a dimension of the mix, as small as its list of weights.
    every = Window.partitionBy(F.lit(0))
    smallest = F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(every)
    block = F.greatest(F.lit(1), F.least(F.lit(block_tokens), F.floor(smallest / MIN_BLOCKS))).cast("long")
    sources = materialize(
        goal.join(sizes.select(F.col("source").alias("_s"), "source_rows"), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("block", F.coalesce(block, F.lit(1).cast("long")))
        .withColumn("seats", F.round(F.sum("source_size").over(every) / F.col("block")).cast("long"))
        .withColumn("most", F.round(MOST_REPEATS * F.col("source_size") / F.col("block")).cast("long"))
        .withColumn("id", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("_all", F.lit(0))
        .drop("_s")
    )
    sources = apportion(sources, ["_all"], "target", "seats", "most", "source_seats")
    n_shards = F.ceil(F.col("source_rows") / SHARD_ROWS).cast("long")
    dims = sources.select(
        F.col("source").alias("_s"), F.col("id").alias("sid"), "source_size", "target", "block", "source_seats", n_shards.alias("n_shards")
    )
    rank = F.xxhash64(F.col("doc_id"), F.col("text_hash"), F.lit(seed))
    placed = (
        slim.join(dims, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("_h", rank)
        .withColumn("shard", F.pmod(F.col("_h"), F.col("n_shards")))
    )
    shards = (
        placed.groupBy("sid", "shard")
        .agg(F.sum("size").alias("tokens"), F.first("block").alias("block"), F.first("source_seats").alias("source_seats"))
        .withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("tokens") / F.col("block"))).cast("long"))
        .withColumn("most", F.when(F.col("tokens") > 0, MOST_REPEATS * F.col("blocks")).otherwise(0).cast("long"))
        .withColumn("id", F.col("shard"))
    )
    quotas = apportion(shards, ["sid"], "tokens", "source_seats", "most", "quota").select(
        F.col("sid").alias("_sid"), F.col("shard").alias("_shard"), "tokens", "blocks", "quota"
    )
    order = Window.partitionBy("sid", "shard").orderBy("_h", "doc_id", "text_hash")
    laid = (
        placed.join(quotas, (F.col("sid") == F.col("_sid")) & (F.col("shard") == F.col("_shard")))
        .withColumn("_at", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("rounds", F.floor(F.col("quota") / F.col("blocks")))
        .withColumn("_run", F.col("quota") % F.col("blocks"))
        .withColumn("_first", F.pmod(F.xxhash64("sid", "shard", F.lit(seed + 1)), F.col("blocks")))
    )
    cut = lambda k: F.floor(k * F.col("tokens") / F.col("blocks"))  # noqa: E731  where block k begins
    end = F.col("_first") + F.col("_run")

    def arc(lo: Column, hi: Column) -> Column:
        """The document's own words within tokens [lo, hi) of its shard."""
        return F.struct(
            F.greatest(F.lit(0), lo - F.col("_at")).cast("long").alias("start"),
            F.least(F.col("size"), hi - F.col("_at")).cast("long").alias("end"),
        )

    arcs = F.array(
        arc(F.lit(0), cut(F.greatest(F.lit(0), end - F.col("blocks")))),
        arc(cut(F.col("_first")), cut(F.least(end, F.col("blocks")))),
    )
    arcs = F.filter(arcs, lambda a: a["end"] > a["start"])
    return (
        laid.withColumn("arcs", arcs)
        .withColumn(
            "taken",
            F.col("rounds") * F.col("size") + F.aggregate("arcs", F.lit(0).cast("long"), lambda s, a: s + a["end"] - a["start"]),
        )
        .select("doc_id", "source", "size", "source_size", "target", "taken", "rounds", "arcs", "text_hash")
    )


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix as documents: each is repeated as often as taken, cut to its taken words where only a run is.

    Keeps the columns of ``docs``. Word ranges that make up a whole document keep its text as it is;
    others are words joined by a space. Documents that the mix doesn't take, and null or empty texts, go.
    Rows that agree in doc_id, source and text count as many times in the mix and pool what they draw.
    Columns may have any names; an empty table gives no rows.
    """
    drawn = (
        mix(docs, seed)
        .where("taken > 0")
        .groupBy(*row_key("doc_id", "source", "text_hash"))
        .agg(F.sum("rounds").alias("rounds"), F.flatten(F.collect_list("arcs")).alias("arcs"), F.first("size").alias("size"))
    )
    others = [c for c in docs.columns if c != "text"]
    held = docs.select(packed(others), "doc_id", "source", "text", F.xxhash64("text").alias("text_hash"))
    keyed = held.select("row", "text", *row_key("doc_id", "source", "text_hash"))
    joined = keyed.join(drawn, ["_key1", "_key2"]).dropDuplicates(["_key1", "_key2"])
    whole = F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))
    pieces = joined.withColumn("range", F.explode(F.concat(F.array_repeat(whole, F.col("rounds").cast("int")), F.col("arcs"))))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    cut = F.when((F.col("range.start") == 0) & (F.col("range.end") == F.col("size")), F.col("text")).otherwise(
        F.array_join(F.slice(words, (F.col("range.start") + 1).cast("int"), (F.col("range.end") - F.col("range.start")).cast("int")), " ")
    )
    own = dict(zip(others, unpacked(others))) | {"text": cut.alias("text")}
    return pieces.select(*[own[c] for c in docs.columns])
