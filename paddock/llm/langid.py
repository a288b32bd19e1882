"""Language identification by the nearest of several clustered centroids per language.

A text is a vector of hashed character n-grams (one to three UTF-8 bytes of lower-cased letters, other
characters as one space), weighted by TF-IDF and normalised. Each language's vectors are clustered by
spherical k-means; the language of the centroid with the greatest cosine wins. Texts whose greatest
cosine stays under a limit, set from the training distances, are flagged as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.llm.common import unit_hash
from paddock.session import ship

#: Hashed n-gram dimensions; centroids per language; training texts per language that are clustered.
DIMS, CENTROIDS, SAMPLE = 4096, 4, 600
#: Share of the training texts that rejection may flag.
REJECTED = 0.001
UNKNOWN = "und"
#: Bytes that are counted at once.
_CHUNK = 1 << 20
_OTHER = regex.compile(r"[^\p{L}]+")


def grams(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text; None without a letter."""
    letters = _OTHER.sub(" ", text.lower()).strip(" ") if text else ""
    if not letters:
        return None
    raw = np.frombuffer(b" " + letters.encode("utf-8", "replace") + b" ", np.uint8)
    found = np.zeros(DIMS, np.int64)
    for at in range(0, len(raw), _CHUNK):
        b = raw[at : at + _CHUNK + 2].astype(np.uint32)
        n = min(_CHUNK, len(raw) - at)
        one, two, three = b[:n], b[:-1] << 8 | b[1:], b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        for k, g in enumerate((one, two[:n], three[:n])):
            h = (g + np.uint32(k << 24)) * np.uint32(2654435761)
            found += np.bincount(h >> np.uint32(20), minlength=DIMS)
    return found


def _weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of normalised TF-IDF, with logarithmic term frequencies."""
    x = (np.log1p(tf) * idf).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def _clusters(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Spherical k-means: centroids of unit length."""
    pick = np.random.default_rng(seed)
    k = min(k, len(x))
    held = x[[int(pick.integers(len(x)))]]
    while len(held) < k:  # farthest first
        held = np.vstack([held, x[int(np.argmin((x @ held.T).max(axis=1)))]])
    for _ in range(12):
        own = np.argmax(x @ held.T, axis=1)
        sums = np.stack([x[own == c].sum(axis=0) if (own == c).any() else held[c] for c in range(k)])
        held = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return held


class Model:
    """Languages, their centroids, the inverse document frequencies and the rejection limit."""

    def __init__(self, langs: list[str], centroids: np.ndarray, of: np.ndarray, idf: np.ndarray, limit: float):
        self.langs, self.centroids, self.of, self.idf, self.limit = langs, centroids, of, idf, limit

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out = []
        for t in texts:
            tf = grams(t)
            if tf is None:
                out.append((UNKNOWN, 0.0, True))
                continue
            near = self.centroids @ _weighted(tf, self.idf)
            best = int(np.argmax(near))
            score = float(min(1.0, max(0.0, near[best])))
            out.append((self.langs[self.of[best]], score, score < self.limit))
        return out


def fit(docs: DataFrame, sample: int = SAMPLE, seed: int = 7) -> Model:
    """Learn from ``docs`` (text, lang): document frequencies over all of them, centroids from a bounded sample.

    Per language about ``sample`` distinct texts, drawn by a hash of the text, are clustered, all of them
    where there are no more; that bounds what the driver holds, however many copies a text has. Rows
    without a language or a letter teach nothing.
    """
    ship(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text")):
                tf = grams(t.as_py())
                if tf is not None:
                    own = seen.setdefault(lang, np.zeros(DIMS + 1, np.int64))
                    own[0] += 1
                    own[1:] += tf > 0
        for lang, own in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (DIMS + 1)), pa.array(range(-1, DIMS), pa.int32()), pa.array(own)], names=["lang", "dim", "n"]
            )

    df = known.mapInArrow(frequencies, "lang string, dim int, n bigint").groupBy("lang", "dim").agg(F.sum("n").alias("n"))
    per = df.groupBy("dim").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("langs")).collect()
    counted = {r["dim"]: r for r in per}
    if -1 not in counted:
        return Model([], np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.ones(DIMS), 0.0)
    rows_of = counted[-1]["langs"]
    texts_of = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("n")).collect()}
    total = counted[-1]["n"]
    idf = np.array([np.log((1 + total) / (1 + counted[d]["n"])) + 1 for d in range(DIMS)])
    rate = F.element_at(F.create_map(*[x for k, v in rows_of.items() for x in (F.lit(k), F.lit(min(1.0, sample / texts_of[k])))]), F.col("lang"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(g, x) for g, t in zip(batch.column("lang").to_pylist(), batch.column("text")) if (x := grams(t.as_py())) is not None]
            if got:
                x = _weighted(np.stack([x for _, x in got]), idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in got]), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    drawn = known.where(unit_hash("text", F.lit(seed)) < rate).dropDuplicates(["lang", "text"]).mapInArrow(vectors, "lang string, x binary").toPandas()
    langs = sorted(rows_of)
    held, of, near = [], [], []
    for n, lang in enumerate(langs):
        own = sorted(drawn.loc[drawn["lang"] == lang, "x"])
        if own:
            x = np.stack([np.frombuffer(b, np.float16) for b in own]).astype(np.float32)
            c = _clusters(x, CENTROIDS, seed + n)
            held.append(c)
            of += [n] * len(c)
            near.append((x @ c.T).max(axis=1))
    limit = float(np.quantile(np.concatenate(near), REJECTED)) if near else 0.0
    return Model(langs, np.vstack(held) if held else np.zeros((0, DIMS), np.float32), np.array(of, int), idf, limit)


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of every document with lang_pred, score (0 to 1) and rejected.

    Null texts and texts without a letter are ``und``, with score 0 and rejected. Whole texts are read,
    ties go to the first centroid, and an empty table gives no rows.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = held.value.predict(batch.column("_text").to_pylist()) if len(held.value.of) else [(UNKNOWN, 0.0, True)] * batch.num_rows
            pred = pd.DataFrame(found, columns=["p", "s", "r"])
            more = [pa.array(pred["p"].astype(str), pa.string()), pa.array(pred["s"], pa.float64()), pa.array(pred["r"], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=names)

    schema = T.StructType(
        [docs.schema[c] for c in keep]
        + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    )
    names = [f.name for f in schema.fields]
    return docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col("text").alias("_text")).mapInArrow(run, schema)
