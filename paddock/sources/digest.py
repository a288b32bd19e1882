"""Digests of linked files of any size: leaves are hashed in parallel by ranges, the tree over them is folded once a file.

SHA-256 stands in for BLAKE3, which isn't at hand; like it, the digest is a tree over blocks of fixed size, so it doesn't depend
on how a file was cut into ranges for reading.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.session import ship
from paddock.sources.fileio import Ranged

LEAF_BYTES, RANGE_LEAVES = 1 << 20, 64


def leaf(data: bytes) -> bytes:
    return hashlib.sha256(b"\0" + data).digest()


def root(leaves: list[bytes]) -> bytes:
    """The top of the tree: pairs of neighbours, an odd last one goes up as it is."""
    while len(leaves) > 1:
        leaves = [hashlib.sha256(b"\1" + b"".join(leaves[i : i + 2])).digest() if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def digests(files: DataFrame, range_leaves: int = RANGE_LEAVES) -> DataFrame:
    """path, size, digest (hex), problem of ``files`` (path): a task reads ``range_leaves`` blocks at a time.

    A file that can't be opened, or is cut while it is read, has a problem and no digest. An empty file is one
    empty block. What one task gathers of a file is 32 bytes for each of its blocks.
    """
    ship(files.sparkSession)

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path in b["path"]:
                try:
                    with Ranged(path) as f:
                        rows.append((path, f.size, None))
                except (OSError, ValueError) as broken:
                    rows.append((path, None, f"digest.unreadable: {broken}"))
            yield pd.DataFrame(rows, columns=["path", "size", "problem"]).astype({"size": "Int64"})

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, size, at in zip(b["path"], b["size"], b["at"]):
                rows = []
                with Ranged(path) as f:
                    for k in range(at, max(1, min(size, at + range_leaves * LEAF_BYTES)), LEAF_BYTES):
                        rows.append((path, k // LEAF_BYTES, leaf(f.read(k, min(LEAF_BYTES, size - k)))))
                yield pd.DataFrame(rows, columns=["path", "i", "leaf"])

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "digest": [root([bytes(x) for x in leaves]).hex() for leaves in b["leaves"]]})

    told = files.select("path").distinct().mapInPandas(sized, "path string, size bigint, problem string")
    ranges = told.where("problem is null").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_leaves * LEAF_BYTES).cast("long"))))
    leaves = ranges.repartition("path", "at").mapInPandas(hashed, "path string, i bigint, leaf binary")
    gathered = leaves.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "leaf"))), lambda x: x["leaf"]).alias("leaves"))
    return told.join(gathered.mapInPandas(folded, "path string, digest string"), "path", "left").select("path", "size", "digest", "problem")
