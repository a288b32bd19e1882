"""File masks and suffixes of recordings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of line-oriented recordings, longest first, and of binary loggers.
JSONL = ((".telemetry.ext.jsonl.zst", "ext_zstd"), (".telemetry.ext.jsonl.zstd", "ext_zstd"), (".telemetry.jsonl.zst", "zstd"), (".telemetry.jsonl.zstd", "zstd"), (".telemetry.ext.jsonl", "ext"), (".telemetry.jsonl", "plain"))
LOGGERS = {"mp4": "aimd", "pds": "pds", "ld": "motec", "vbo": "vbo", "telemetry": "telemetry"}


def expand(mask: str) -> list[str]:
    """The masks that braces stand for."""
    m = re.search(r"\{([^{}]*)\}", mask)
    return [x for part in m[1].split(",") for x in expand(mask[: m.start()] + part + mask[m.end() :])] if m else [mask]


def to_regex(mask: str) -> str:
    """A regular expression for the mask: ``*`` and ``?`` within a name, ``**`` across folders, braces, any case."""
    one = lambda m: re.sub(r"\*\*/|\*\*|\*|\?|[^*?]+", lambda t: {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t[0]) or re.escape(t[0]), m)
    return "(?i)^(?:" + "|".join(one(m) for m in expand(mask)) + ")$"


def matches(path: Column, masks: list[str]) -> Column:
    """Whether the relative path or its last part fits a mask; without masks everything does."""
    name = F.element_at(F.split(path, "/"), -1)
    hit = F.lit(not masks)
    for m in masks:
        hit = hit | path.rlike(to_regex(m)) | name.rlike(to_regex(m))
    return hit


def kind(path: Column) -> Column:
    """What a file is by its suffix; null if it isn't a recording."""
    low = F.lower(path)
    found = None
    for suffix, k in JSONL:
        found = F.when(low.endswith(suffix), k) if found is None else found.when(low.endswith(suffix), k)
    for ext, k in LOGGERS.items():
        found = found.when(low.endswith("." + ext), k)
    return found


def scan(spark: SparkSession, folder: str, masks: list[str] | None = None) -> DataFrame:
    """path, length, modificationTime, kind of the recordings under a folder, contents unread until asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.withColumn("kind", kind(F.col("path"))).where(F.col("kind").isNotNull() & matches(F.regexp_replace("path", r"^\w+:/*", "/"), masks or []) & ~F.col("path").contains("/.git/"))
