"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.session import materialize, prepare, shared_dir

__all__ = ["SPACE", "hot_lookup", "materialize", "packed", "row_key", "shared_dir", "table", "unit_hash", "unpacked", "word_count"]

#: White space between words, as a character class.
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of ``text``; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE, -1)
    edges = (F.element_at(parts, 1) == "").cast("int") + (
        (F.size(parts) > 1) & (F.element_at(parts, -1) == "")
    ).cast("int")
    return (F.size(parts) - edges).cast("long")


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on ``cols`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def row_key(*cols: str) -> list[Column]:
    """Two hashes that name a row by the given columns, nulls included: never null, so joins and groupings on them share a shuffle."""
    return [F.xxhash64(*cols).alias("_key1"), F.xxhash64(F.lit("second"), *cols).alias("_key2")]


def packed(keep: list[str]) -> Column:
    """The user's columns as one, ``row``, so that their names can't meet an operator's own."""
    return F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]).alias("row")


def unpacked(keep: list[str], but: tuple[str, ...] = ()) -> list[Column]:
    """The columns that ``packed`` holds, without those whose names the operator's results bear."""
    return [F.col(f"row.k{i}").alias(c) for i, c in enumerate(keep) if c.lower() not in but]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def hot_lookup(df: DataFrame, right: DataFrame, key: str, share: int = 512) -> DataFrame:
    """Left join of ``df`` with ``right``, which has one row per string ``key``, whatever share of ``df`` a key holds.

    Keys with over one in ``share`` of the rows are fewer than ``share``; their rows of ``right`` are
    broadcast, and the rows of ``df`` that meet them stay where they are dealt by row. ``df`` is read twice.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    least = (counts.agg(F.sum("_n")).first()[0] or 0) // share
    hot = counts.where((F.col("_n") > least) & (F.col("_n") > 1)).select(key)
    held = [c for c in right.columns if c != key]
    hot_rows = right.join(F.broadcast(hot), key, "left_semi").select(F.col(key).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in held])
    rest = right.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_rest_{c}") for c in held])
    met = df.join(F.broadcast(hot_rows), F.col(key) == F.col("_hot_key"), "left")
    # rows that are served already, and null keys, get keys of their own, which meet nothing and spread
    spread = F.concat(F.lit("\x00"), F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])))
    dealt = met.withColumn("_at", F.coalesce(F.when(F.col("_hot_key").isNull(), F.col(key)), spread))
    found = dealt.join(rest, F.col("_at") == F.col("_key"), "left")
    return found.select(*[F.col(f"`{c}`") for c in df.columns], *[F.when(F.col("_hot_key").isNotNull(), F.col(f"_hot_{c}")).otherwise(F.col(f"_rest_{c}")).alias(c) for c in held])
