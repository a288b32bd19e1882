"""Embedding near-dedup with spherical-cap filters from structured random product codes.

Filter directions are all combinations of one code word per block of coordinates (after a random
rotation), so there are many directions but few code words. Each vector is list-decoded to all
directions whose inner product with it exceeds the cap's height: block products are sorted and
combinations that cannot reach the height are never looked at. Vectors that share a filter are
compared in double precision. The cap's height and the number of code words follow from the number of
vectors, so that a filter holds about the same number of unrelated vectors at every size.

Equal vectors are one entry with a count. A pair that shares several filters counts in the least of
them only, so no pair table is needed: a task returns how many links each entry has and links enough to
connect what is linked. Filters with more than BLOCK entries are dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import materialize
from paddock.llm.components import connected
from paddock.llm.simhash import forest
from paddock.session import ship

COSINE = 0.9
#: Unrelated vectors in a filter, most code words of two blocks, entries of a filter that are compared at once.
HELD, WORDS = 16, 2048
BLOCK = 1024
#: Filters to look at for a vector that has few, lowering the height by this factor each time.
_LOWER, _TRIES = 0.94, 30


def per_vector(n: int) -> int:
    """Filters that a vector is in on average, of ``n``.

    A higher cap is shared by fewer of the pairs at the cosine, and three blocks by fewer than two, so the
    number grows with the logarithm: 24 up to 10^4 vectors, 40 at 10^6, 100 at 10^8. A vector has at least a third.
    """
    size = np.log10(max(n, 1))
    return int(round(24 + 8 * max(0.0, size - 4) + 22 * max(0.0, size - 6)))


class Code:
    """The product code for vectors of one dimension, the same wherever it is made."""

    def __init__(self, dim: int, n: int, seed: int):
        share = min(0.2, HELD / max(n, 1))
        self.mean = per_vector(n)
        total = self.mean / share
        self.blocks = min(dim, 2 if total**0.5 <= WORDS else 3)
        self.words = max(2, int(np.ceil(total ** (1 / self.blocks))))
        pick = np.random.default_rng([seed, dim])
        self.turn = np.linalg.qr(pick.normal(size=(dim, dim)))[0]
        self.cuts = [dim * i // self.blocks for i in range(self.blocks + 1)]
        self.code = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            c = pick.normal(size=(self.words, b - a))
            self.code.append(c / np.linalg.norm(c, axis=1, keepdims=True))
        self.height = NormalDist().inv_cdf(1 - share) * (self.blocks / dim) ** 0.5

    def filters(self, x: np.ndarray) -> list[np.ndarray]:
        """The sorted filters of each row of unit vectors."""
        y = x @ self.turn
        near = [y[:, a:b] @ c.T for (a, b), c in zip(zip(self.cuts, self.cuts[1:]), self.code)]
        order = [np.argsort(-s, axis=1) for s in near]
        near = [np.take_along_axis(s, o, axis=1) for s, o in zip(near, order)]
        out = []
        for r in range(len(x)):
            s, o, height = [m[r] for m in near], [m[r] for m in order], self.height
            for _ in range(_TRIES):
                found = self._decode(s, o, height)
                if 3 * len(found) >= self.mean:
                    break
                height = height * _LOWER if height > 0.05 else height - 0.1
            out.append(np.sort(found))
        return out

    def _decode(self, s: list[np.ndarray], o: list[np.ndarray], height: float) -> np.ndarray:
        """Combinations whose products sum to the height or more; ``s`` is sorted downwards, ``o`` has the words."""
        most = [sum(x[0] for x in s[k + 1 :]) for k in range(len(s))]
        sums, ids = np.zeros(1), np.zeros(1, np.int64)
        for k in range(len(s)):
            n = np.searchsorted(-s[k], sums + most[k] - height, side="right")
            from_ = np.repeat(np.arange(len(sums)), n)
            word = np.arange(len(from_)) - np.repeat(np.cumsum(n) - n, n)
            sums, ids = sums[from_] + s[k][word], ids[from_] * self.words + o[k][word]
        return ids


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row's bytes, in four bytes a component where that loses nothing."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return [(s if f else v).tobytes() for v, s, f in zip(x, short, (short == x).all(axis=1))]


def _unit(rows: list[bytes], dim: int) -> np.ndarray:
    x = np.stack([np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64).astype(np.float64) for b in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _verified(x: np.ndarray, lists: list[np.ndarray], key: int, rows: np.ndarray, cols: np.ndarray, cosine: float) -> tuple[np.ndarray, ...]:
    """Pairs (i in rows, j in cols) at the cosine or above, and which of them share no filter below ``key``."""
    i, j = np.nonzero(x[rows] @ x[cols].T >= cosine)
    i, j = rows[i], cols[j]
    apart = i < j if rows is cols or np.array_equal(rows, cols) else i != j
    i, j = i[apart], j[apart]
    if not len(i):
        return i, j, np.zeros(0, bool)
    met = np.unique(np.r_[i, j])
    below = [lists[m][lists[m] < key] for m in met]
    known = np.unique(np.concatenate(below)) if below else np.zeros(0, np.int64)
    has = np.zeros((len(met), len(known)), np.float32)
    for r, b in enumerate(below):
        has[r, np.searchsorted(known, b)] = 1
    at_i, at_j = np.searchsorted(met, i), np.searchsorted(met, j)
    if len(known) == 0:
        return i, j, np.ones(len(i), bool)
    if len(i) > 4 * len(met):
        first = (has @ has.T)[at_i, at_j] == 0
    else:
        first = np.einsum("pk,pk->p", has[at_i], has[at_j]) == 0
    return i, j, first


def _compare(cosine: float):
    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for part in batches:
            if not len(part):
                continue
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            k = part[["dim", "key", "x", "y"]].to_numpy()
            open_ = (k == k[-1]).all(axis=1)
            rest = part[open_]
            yield pairs(part[~open_])
        if rest is not None:
            yield pairs(rest)

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int | None, int | None]] = []
        part = part.reset_index(drop=True)
        k = part[["dim", "key", "x", "y"]].to_numpy()
        edges = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1 if len(part) else []
        for a, b in zip([0, *edges], [*edges, len(part)]) if len(part) else ():
            ids, own = part["rep"].to_numpy(np.int64)[a:b], part["own"].to_numpy()[a:b]
            m = part["m"].to_numpy(np.int64)[a:b]
            x = _unit(part["vector"].iloc[a:b].tolist(), int(k[a, 0]))
            lists = [np.frombuffer(f, np.int64) for f in part["filters"].iloc[a:b]]
            if k[a, 2] == k[a, 3]:
                rows = cols = np.arange(b - a)
            else:
                rows, cols = np.flatnonzero(own == k[a, 2]), np.flatnonzero(own == k[a, 3])
            i, j, first = _verified(x, lists, int(k[a, 1]), rows, cols, cosine)
            if len(i):
                first &= ids[i] != ids[j]
                count = np.bincount(i[first], m[j[first]], minlength=b - a) + np.bincount(j[first], m[i[first]], minlength=b - a)
                out += [(int(ids[v]), None, int(count[v])) for v in np.flatnonzero(count)]
                x, y = forest([(i, j, np.zeros(len(i), np.int64))])
                out += [(p, q, None) for p, q in zip(ids[x].tolist(), ids[y].tolist())]
        found = pd.DataFrame(out, columns=["a", "b", "n"])
        return found.astype("Int64")

    return groups


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
    different lengths never link. Copies of a vector link with each other. Rows of one vec_id are one entry
    that has all their vectors: n_links is the sum over them, without links to itself. Rows without a vec_id
    are entries of their own vectors: they link and connect, but name no component and are never kept; where
    nothing else is reachable their component_id is null. Other columns are not looked at; an empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    e = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall("_e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("_e", lambda v: v != 0)
    usable = vectors.select("vec_id", e.alias("_e")).where(F.coalesce(fine, F.lit(False)))
    #: A vector is called by its smallest vec_id, or by a hash where it has none; null vec_ids count row by row.
    called = F.coalesce(F.min("vec_id").cast("long"), F.xxhash64("_e"))
    counted = usable.groupBy("_e", "vec_id").agg(F.when(F.col("vec_id").isNull(), F.count(F.lit(1))).otherwise(F.lit(1)).alias("m"))
    reps = materialize(counted.groupBy("_e").agg(called.alias("rep"), F.sum("m").alias("m")))
    met = usable.join(reps.withColumnRenamed("_e", "_v"), F.col("_e") == F.col("_v")).select("vec_id", "rep", "m", "_e").distinct()
    own = materialize(met.groupBy("vec_id", "rep").agg(F.sum(F.col("m") - 1).alias("copies")))
    n = reps.count()

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: dict[int, Code] = {}
        for part in batches:
            for at in range(0, len(part), 512):
                some = part.iloc[at : at + 512]
                dims = some["_e"].map(len)
                for dim, own in some.groupby(dims):
                    code = codes.setdefault(dim, Code(int(dim), n, seed))
                    held = _packed(np.stack([np.asarray(v, np.float64) for v in own["_e"]]))
                    found = code.filters(_unit(held, int(dim)))
                    yield pd.DataFrame(
                        {"rep": own["rep"].to_numpy(), "m": own["m"].to_numpy(), "dim": dim, "vector": held, "filters": [f.tobytes() for f in found], "keys": [f.tolist() for f in found]}
                    )

    decoded = materialize(reps.mapInPandas(decode, "rep bigint, m bigint, dim int, vector binary, filters binary, keys array<bigint>"))
    index = decoded.select("rep", "dim", F.explode("keys").alias("key"))
    sizes = index.groupBy("dim", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("dim").alias("_dim"), F.col("key").alias("_key"), "n")
    listed = decoded.select("rep", "m", "dim", "vector", "filters", F.explode("keys").alias("key"))
    held = (
        listed.join(sizes, (F.col("dim") == F.col("_dim")) & (F.col("key") == F.col("_key")))
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("dim", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "m", "vector", "filters")
    )
    group = ["dim", "key", "x", "y"]
    found = materialize(held.repartition(*group).sortWithinPartitions(*group).mapInPandas(_compare(cosine), "a bigint, b bigint, n bigint"))
    degree = found.where("n is not null").groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("n"))
    #: The vectors of one vec_id belong together, whether they are alike or not.
    several = own.where("vec_id is not null").groupBy("vec_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("vec_id", "least")
    joined = own.join(several, "vec_id").select(F.col("rep").alias("a"), F.col("least").alias("b")).where("a != b")
    roots = connected(found.where("b is not null").select("a", "b").unionByName(joined))
    told = materialize(
        own.join(degree, F.col("rep") == F.col("_a"), "left")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select("vec_id", "rep", (F.col("copies") + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("root", "rep").alias("root"))
    )
    least = told.groupBy("root").agg(F.min("vec_id").cast("long").alias("component_id"))
    named = told.join(least, "root")
    ids = named.where("vec_id is not null").groupBy(F.col("vec_id").alias("_id")).agg(F.sum("n").alias("n_links"), F.min("component_id").alias("component_id"))
    rows = vectors.select("vec_id", F.lit(None).cast("array<double>").alias("_e")).where("vec_id is not null").join(ids, F.col("vec_id") == F.col("_id"), "left")
    #: Rows without a vec_id are found by their vectors.
    bare = named.where("vec_id is null").select(F.col("rep").alias("_rep"), F.col("n").alias("n_links"), "component_id")
    by_vector = reps.select(F.col("_e").alias("_v"), F.col("rep").alias("_of")).join(bare, F.col("_of") == F.col("_rep")).select("_v", "n_links", "component_id")
    nameless = vectors.where("vec_id is null").select("vec_id", e.alias("_e")).join(by_vector, F.col("_e") == F.col("_v"), "left")
    own_id = F.coalesce("component_id", F.col("vec_id").cast("long"))
    both = rows.select("vec_id", "n_links", "component_id").unionByName(nameless.select("vec_id", "n_links", "component_id"))
    return both.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        own_id.alias("component_id"),
        F.coalesce(own_id == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
