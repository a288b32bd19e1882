"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A document is its sequence of lines that hold a word. A window is the shortest run of lines from a line
on (or up to a line) that holds at least RUN_WORDS words, so any passage that long holds a whole window
on either end. Of every window the line with the least hash is selected: such fingerprints are
guaranteed to be selected in each copy of a passage. Fingerprints that occur at one position only are
dropped; the others are joined with the windows that selected them. Windows with the same fingerprint
and the same lines are matches: each is joined with the first position in document order, never with
all others, so a passage in n documents makes n rows. A match is extended both ways by the windows that
start in it and those that end in it, as long as they match too; the union is the maximal repeated run.
All runs but the first occurrence are deleted.

Every deleted line has an earlier equal line that stays, so no line's content is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.llm.common import SPACE, materialize, packed, unpacked, word_count

#: Words that a repeated run must hold.
RUN_WORDS = 50


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, pos (0-based), line (hash), words: the lines with a word, once per (doc_id, text)."""
    line = F.col("_line")
    return docs.where(F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "_line")
    ).select("doc_id", "text_hash", "pos", F.xxhash64(line).alias("line"), word_count(line).cast("int").alias("words")).where("words > 0")


def repeated_lines(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, text_hash, pos of every line that lies in a later occurrence of a run of ``run_words`` words or more."""
    doc = ["doc_id", "text_hash"]
    once = Window.partitionBy(*doc, "pos").orderBy("line")
    by_line = Window.partitionBy(*doc).orderBy("pos")
    ends = F.sum("words").over(by_line.rowsBetween(Window.unboundedPreceding, 0))
    placed = (
        lines(docs)
        .repartition(*doc)
        .withColumn("_copy", F.row_number().over(once))
        .where("_copy = 1")
        .withColumn("ends", ends)
        .withColumn("starts", F.col("ends") - F.col("words"))
    )
    onward = Window.partitionBy(*doc).orderBy("starts").rangeBetween(0, run_words - 1)
    back = Window.partitionBy(*doc).orderBy("ends").rangeBetween(-(run_words - 1), 0)

    def window(over: Window) -> Column:
        held = F.collect_list("line").over(over)
        return F.struct(
            F.min("pos").over(over).alias("first"),
            F.max("pos").over(over).alias("last"),
            (F.max("ends").over(over) - F.min("starts").over(over)).alias("words"),
            F.min(F.struct("line", "pos")).over(over).alias("selected"),
            F.xxhash64(held).alias("run"),
        )

    windows = materialize(
        placed.select(*doc, window(onward).alias("onward"), window(back).alias("back"))
        .select(*doc, F.explode(F.array("onward", "back")).alias("w"))
        .where(F.col("w.words") >= run_words)
        .select(*doc, "w.first", "w.last", F.col("w.selected.line").alias("fingerprint"), F.col("w.selected.pos").alias("pos"), "w.run")
        .distinct()
    )
    at, selected = F.struct("doc_id", "text_hash", "first"), F.struct("doc_id", "text_hash", "pos")
    often = (
        windows.groupBy(F.col("fingerprint").alias("_fingerprint"))
        .agg(F.min(selected).alias("_a"), F.max(selected).alias("_b"))
        .where("_a != _b")
    )
    met = windows.join(often, F.col("fingerprint") == F.col("_fingerprint"), "left_semi")
    first = (
        met.groupBy(F.col("fingerprint").alias("_f"), F.col("run").alias("_r"))
        .agg(F.min(at).alias("origin"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    later = met.join(first, (F.col("fingerprint") == F.col("_f")) & (F.col("run") == F.col("_r"))).where(F.col("origin") < at)
    return later.select(*doc, F.explode(F.sequence("first", "last")).alias("pos")).distinct()


def dedup(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs deleted from ``text``, and n_lines, removed (0-based line numbers).

    Lines are what \\n parts; blank lines between two deleted lines, or at a deleted run's end, go with
    the run. Documents are in order of doc_id (null first), then text; rows equal in both are one
    document and share its text. Null texts stay null, empty ones empty; a document whose every line is
    repeated stays with an empty text. Other columns stay as they are, but for those named n_lines or
    removed, which give way.
    """
    gone = (
        repeated_lines(docs.select("doc_id", "text"), run_words)
        .groupBy(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_hash"))
        .agg(F.collect_list("pos").alias("gone"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_hash"))
    others = [c for c in docs.columns if c != "text"]
    split = docs.select(packed(others), "doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("lines"))
    n = F.coalesce(F.size("lines"), F.lit(0))
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone"))
    rest = F.transform(left, lambda i: F.get(F.col("lines"), i))
    met = split.join(gone, same, "left").withColumn("rest", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(rest))
    text = F.when(
        F.col("gone").isNull() | F.exists("rest", lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0), F.array_join("rest", "\n")
    ).otherwise(F.when(F.col("lines").isNotNull(), F.lit("")))
    own = dict(zip(others, unpacked(others))) | {"text": text.alias("text")}
    return met.select(
        *[own[c] for c in docs.columns if c.lower() not in ("n_lines", "removed")],
        F.when(F.col("lines").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.coalesce(F.array_sort("gone"), F.array().cast("array<int>")).alias("removed"),
    )


def deduped(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """``dedup`` with the columns of ``docs`` alone, whatever their names."""
    at = [f"c{i}" if c not in ("doc_id", "text") else c for i, c in enumerate(docs.columns)]
    return dedup(docs.toDF(*at), run_words).select(*at).toDF(*docs.columns)
