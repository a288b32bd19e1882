"""Quality rules: counts of each text, and cross-document line frequency per host.

Lines are normalised and hashed, and per host (``source``) the distinct documents that hold a line are
counted; exact copies count as one document. Lines above the limit are removed as boilerplate, and a
document that loses most of its words is rejected as depleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.llm.common import SPACE, materialize, packed, unpacked, word_count
from paddock.session import ship

SYMBOLS = "#*$%&|<>"
#: A line is boilerplate in a host when more than this many distinct documents, and more than this share
#: of the host's distinct documents, hold it. Without a share the number is the same for hosts of every size.
LINE_DOCS, LINE_SHARE = 20, 0.0
#: A document is depleted when less than this share of its words is left.
LEFT_SHARE = 0.3
#: Base rules: fewest words, and most repeated words in a hundred.
LEAST_WORDS, MOST_REPEATED = 50, 50
_BLANK = " \t\n\x0b\x0c\r"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _BLANK))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    repeated = 0
    if n > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
        _, which, often = np.unique(pairs[:-1].astype(np.int64) * n + ids[2:], return_inverse=True, return_counts=True)
        at = np.flatnonzero(often[which] > 1)
        held = np.zeros(n, bool)
        for k in range(3):
            held[at + k] = True
        repeated = int(held.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of every document with its counts and base_failed; null texts count nothing."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counts(t.as_py()) for t in batch.column("_text")], np.int64).reshape(-1, len(_COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c) for c in found.T]], names=[f.name for f in schema.fields])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in _COUNTS])
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.mapInArrow(run, schema).withColumn("base_failed", failed)


def _line_hash(line: Column) -> Column:
    """Hash of a line in lower case, with single spaces."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), SPACE, " ")))


def _lines(docs: DataFrame) -> DataFrame:
    """source, text_hash, line (hash of the normalised line), words: one row per line of each distinct document and host."""
    line = F.explode(F.split("text", "\n", -1))
    return (
        docs.where(F.col("text").isNotNull())
        .select("source", F.xxhash64("text").alias("text_hash"), line.alias("_line"))
        .select("source", "text_hash", _line_hash(F.col("_line")).alias("line"), word_count(F.col("_line")).alias("words"))
        .where("words > 0")
        .groupBy("source", "text_hash", "line")
        .agg(F.sum("words").alias("words"))
    )


def boilerplate(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, left_share: float = LEFT_SHARE) -> DataFrame:
    """source, text_hash, lines (hashes of its frequent lines) and depleted of the documents that have frequent lines.

    Words of m copies of a text count m times in both the whole and the rest, so the share is the same.
    """
    lines = materialize(_lines(docs))
    frequent = lines.groupBy(F.col("source").alias("_source"), F.col("line").alias("_line")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > line_docs)
    if line_share:
        hosts = docs.groupBy(F.col("source").alias("_host")).agg(F.count_distinct(F.xxhash64("text")).alias("host_docs"))
        frequent = frequent.join(hosts, F.col("_source").eqNullSafe(F.col("_host"))).where(F.col("n") > F.col("host_docs") * line_share)
    marked = lines.join(frequent.select("_source", "_line"), (F.col("line") == F.col("_line")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return (
        marked.groupBy("source", "text_hash")
        .agg(
            F.sum("words").alias("whole"),
            F.sum(F.when(F.col("_line").isNull(), F.col("words")).otherwise(0)).alias("left"),
            F.collect_list("_line").alias("lines"),
        )
        .where("left < whole")
        .select("source", "text_hash", "lines", (F.col("left") < F.col("whole") * left_share).alias("depleted"))
    )


def depleted(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, left_share: float = LEFT_SHARE) -> DataFrame:
    """source and text_hash of the documents that removal of frequent lines leaves with too few words."""
    return boilerplate(docs, line_docs, line_share, left_share).where("depleted").select("source", "text_hash")


def _judged(docs: DataFrame, keep: list[str], limits: dict[str, float]) -> DataFrame:
    """row (the packed ``keep`` columns), the counts, base_failed, kept, and gone: the hashes of the document's frequent lines, null without any."""
    held = docs.select(packed(keep), "source", "text", F.xxhash64("text").alias("th"))
    base = with_counts(held, ["row", "source", "th"])
    found = boilerplate(docs.select("source", "text"), **limits).select(
        F.col("source").alias("_source"), F.col("text_hash").alias("_th"), F.col("lines").alias("gone"), "depleted"
    )
    met = base.join(found, (F.col("th") == F.col("_th")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    kept = ~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False))
    return met.select("row", *_COUNTS, "base_failed", kept.alias("kept"), "gone")


#: Names of what is returned beside the user's columns; a user's column of such a name gives way.
_RESULTS = (*_COUNTS, "base_failed", "kept", "removed", "lines_frequent")


def judge(docs: DataFrame, keep: list[str], **limits: float) -> DataFrame:
    """``keep`` columns, the counts, base_failed, kept and lines_frequent of every document.

    lines_frequent says how many different lines of the document its host has too often. Kept are
    documents that pass the base rules and aren't depleted. Null and blank texts fail the base rules. A
    null source is a host of its own; repeated rows get equal verdicts; columns of other names are passed
    by, and a kept column named as a result gives way to it; an empty table gives no rows.
    """
    often = F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("lines_frequent")
    return _judged(docs, keep, limits).select(*unpacked(keep, _RESULTS), *_COUNTS, "base_failed", "kept", often)


def _cleaned(docs: DataFrame, limits: dict[str, float]) -> DataFrame:
    """``_judged`` with text, freed of frequent lines, and removed."""
    at = f"row.k{docs.columns.index('text')}"
    parts = F.split(at, "\n", -1)
    hit = F.transform(parts, lambda x: F.array_contains("gone", _line_hash(x)))
    found = _judged(docs, docs.columns, limits).withColumn("hit", F.when(F.col("gone").isNotNull(), hit))
    rest = F.filter(parts, lambda _, i: ~F.get("hit", i))
    numbers = F.filter(F.sequence(F.lit(0), F.size("hit") - 1), lambda i: F.get("hit", i))
    some = F.col("hit").isNotNull()
    return found.withColumns({
        "removed": F.when(some, numbers).otherwise(F.array().cast("array<int>")),
        "text": F.when(some, F.array_join(rest, "\n")).otherwise(F.col(at)),
    })


def cleaned(docs: DataFrame, **limits: float) -> DataFrame:
    """``docs`` with frequent lines removed from the text, removed (their numbers, from 0), and what ``judge`` adds.

    Counts and base_failed are of the whole text. Texts without frequent lines stay as they are, with an
    empty list; so do null texts. Columns named as a result give way to it.
    """
    names = [c for c in unpacked(docs.columns)]
    shown = [F.col("text") if c == "text" else x for c, x in zip(docs.columns, names) if c.lower() not in _RESULTS]
    return _cleaned(docs, limits).select(*shown, "removed", *_COUNTS, "base_failed", "kept")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that ``judge`` keeps, frequent lines removed from their texts.

    The other columns are as they are, whatever their names; an empty table gives no rows.
    """
    found = _cleaned(docs, {}).where("kept")
    return found.select(*[F.col("text") if c == "text" else x for c, x in zip(docs.columns, unpacked(docs.columns))])
