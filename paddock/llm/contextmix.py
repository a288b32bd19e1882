"""LM scoring by online logistic context mixing.

A text is its lower-cased words and an end. Each word is coded as a symbol (the most frequent words, the
end, and an escape). Symbols are coded as the bits of a Huffman code, and every bit is predicted by
several counters found by hashing a context with the place in the code: none, the symbol before, the two
before. The predictions, as logits, are summed with weights, each selected by a gate: how much the
predictor's context has seen; a last stage refines the sum by what such sums turned out to be.

An escaped word is predicted twice: as one that training has, by its own count, and as a new one,
spelled byte by byte by another mix (contexts: none, the one, two and three bytes before, the word so
far). The two are mixed by the share of escaped words that training had had elsewhere.

Counts cover every training text. The weights and the last stage are learned online over every training
text: each task goes through its texts in steps of STEP_BITS bits, Spark averages the tasks' weights by
bits, and a second round starts from the averages. No text learns from its own counts: texts are dealt
in two folds by their hash, copies together, and one fold's weights are learned on the other's counts.
Scoring reads all counts with the weights of the last round and learns nothing more.

Texts are taken apart once, into a table of symbols, which all that follows reads.

Counts of words are a table that grows with the corpus and is joined by word; the number of symbols and
the slots of the hashed tables follow from the counted words, up to a documented size. Tables of counts
are filled by tasks and added up by Spark, and reach the driver as one byte a slot.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.llm.common import materialize
from paddock.session import ship

#: Counted words for one symbol, fewest and most symbols; counted words for a slot, fewest and most bits of a slot's number.
PER_SYMBOL, FEWEST_SYMBOLS, MOST_SYMBOLS = 512, 1 << 14, 1 << 16
PER_SLOT, FEWEST_BITS, MOST_BITS = 32, 18, 22
#: Slots of the spelling contexts (bits), parts that a table is added up in, texts whose words are counted at once.
SPELLING_BITS, PARTS, COUNTED = 20, 512, 2_048
#: Bits that are gone through at once, so that what they need stays in a core's cache; steps that are read at once; bits of a learning step; the step of each round.
CHUNK, READ_STEPS, STEP_BITS, STEPS = 1 << 18, 16, 4_096, (0.1, 0.02)
ESCAPE, END, FIRST = 0, 1, 2
_GATES = 4
#: Sums are told apart by this fraction, up to this bound; the last stage learns in wider cells.
_FINE, _BOUND, _CELLS = 64, 12, 48
#: A slot's state: its gate, and its logit in levels of this width around the middle one.
_LEVEL, _MIDDLE = 0.28, 32
_LOGITS = np.tile((np.arange(64) - _MIDDLE) * _LEVEL, _GATES).astype(np.float32)
#: The logits of one gate's states, none of the others', by gate. States of the first gate have seen nothing, so their logit is zero.
_OF_GATE = np.where(np.arange(256) >> 6 == np.arange(_GATES)[:, None], _LOGITS, np.float32(0))


class Code:
    """A Huffman code, flattened: the nodes and bits that each symbol passes, and each node's own counts."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, n, n) for n, c in enumerate(counts)]
        heapq.heapify(heap)
        n = len(counts)
        up = np.zeros(2 * n - 1, np.int64)
        bit = np.zeros(2 * n - 1, np.int8)
        held = np.zeros(2 * n - 1, np.int64)
        for c, _, k in heap:
            held[k] = c
        at = n
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            up[a[2]], up[b[2]], bit[b[2]], held[at] = at, at, 1, a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], at, at))
            at += 1
        root = 2 * n - 2
        nodes: list[int] = []
        bits: list[int] = []
        self.start = np.zeros(n, np.int64)
        self.length = np.zeros(n, np.int64)
        for s in range(n):
            self.start[s], k = len(nodes), s
            while k != root:
                nodes.append(int(up[k]) - n)
                bits.append(int(bit[k]))
                k = int(up[k])
            self.length[s] = len(nodes) - self.start[s]
        flat = np.array(nodes, np.int32)
        self.bits = np.array(bits, np.uint8)
        ones = np.zeros(max(n - 1, 1), np.int64)
        for k in range(2 * n - 2):
            if bit[k]:
                ones[up[k] - n] += held[k]
        whole = held[n:] if n > 1 else np.ones(1)
        logit = np.log((ones + 0.4) / (whole - ones + 0.4)).astype(np.float32)
        self.own = logit[flat]
        #: The last bit tells the code's bit; slots are made of the first ones.
        self.place = _mixed(flat) & ~np.uint32(1) | self.bits
        #: Of each symbol the places and own logits of its bits, as bytes, which Arrow copies by whole symbols.
        both = np.stack([self.place, self.own.view(np.uint32)], axis=1)
        ends = np.append(self.start, len(flat)) * both.itemsize * 2
        self.paths = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(both)])
        self.start, self.length = self.start.astype(np.int32), self.length.astype(np.int32)

    def passed(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many bits each symbol has, and the places and own logits of the bits of all."""
        both = np.frombuffer(self.paths.take(pa.array(symbols)).buffers()[2], np.uint32).reshape(-1, 2)
        return self.length[symbols], both[:, 0], both[:, 1].view(np.float32)

    def by_depth(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols' order by falling length, where each begins in the flat arrays in that order, and how many have a first bit, a second, and so on."""
        n = self.length[symbols]
        order = np.argsort((n.max(initial=0) - n).astype(np.uint16), kind="stable")
        return order, self.start[symbols[order]].astype(np.intp), len(n) - np.cumsum(np.bincount(n))[:-1]

    def per(self, symbols: np.ndarray) -> int:
        """Symbols whose bits make up a chunk, about."""
        return max(1, int(CHUNK / max(1.0, float(self.length[symbols].mean())))) if len(symbols) else 1


def _slots(context: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
    h = context ^ place
    h >>= np.uint32(32 - bits)
    return h


def _mixed(*columns: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each row of columns."""
    h = np.full(len(columns[0]), 0x811C9DC5, np.uint32)
    for c in columns:
        h = (h ^ c.astype(np.uint32)) * np.uint32(0x01000193)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
    return h


def symbol_contexts(s: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """Contexts of each symbol: the one before, the two before; each text begins after an end."""
    one, two = np.r_[END, s[:-1]], np.r_[END, END, s[:-2]] if len(s) > 1 else np.full(len(s), END)
    one[begins] = END
    two = two[: len(s)]
    two[begins] = END
    two[begins[begins + 1 < len(s)] + 1] = END
    return [_mixed(one), _mixed(one, two)]


def spelled(words: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Bytes of the words, each closed by a space; where each begins; the contexts of each byte."""
    closed = pc.binary_join_element_wise(words if isinstance(words, pa.Array) else pa.array(words, pa.binary()), b"", b" ")
    n = pc.binary_length(closed).to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.cumsum(n) - n
    b = np.frombuffer(closed.buffers()[2], np.uint8, int(n.sum()))
    place = np.arange(len(b)) - np.repeat(begins, n)
    back = []
    for k in (1, 2, 3):
        c = np.r_[np.zeros(k, np.uint8), b[:-k]][: len(b)].copy()
        c[place < k] = 0
        back.append(c)
    whole = np.zeros(len(b), np.uint32)
    h = np.zeros(len(words), np.uint32)
    for k in range(int(n.max())):
        own = np.flatnonzero(n > k)
        whole[begins[own] + k] = h[own]
        h[own] = _mixed(h[own], b[begins[own] + k])
    o1 = _mixed(back[0])
    return b, begins, [o1, _mixed(back[0], back[1]) + np.uint32(1), _mixed(*back) + np.uint32(2), whole + np.uint32(3)]


def tally(code: Code, symbols: np.ndarray, contexts: list[np.ndarray], tables: np.ndarray) -> None:
    """Add the bits of the symbols to ``tables`` (context, slot, bit)."""
    per = code.per(symbols)
    bits = tables.shape[1].bit_length() - 1
    flat = tables.reshape(len(tables), -1)
    one = tables.dtype.type(1)  # of the tables' own type, else each addition casts
    for at in range(0, len(symbols), per):
        order, starts, longer = code.by_depth(symbols[at : at + per])
        near = [c[at : at + per].take(order) for c in contexts]
        for depth, n in enumerate(longer):
            place = code.place.take(starts[:n] + depth, mode="clip")
            bit = place & np.uint32(1)
            for k, c in enumerate(near):
                cell = _slots(c[:n], place, bits)
                cell <<= np.uint32(1)
                cell |= bit
                np.add.at(flat[k], cell.astype(np.intp), one)


def states(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """One byte for a slot's counts: how much it has seen (none, up to 2, up to 20, more), and its logit's level."""
    seen = zeros + ones
    logit = np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)))
    level = np.clip(np.rint(logit / np.float32(_LEVEL)), -_MIDDLE, 63 - _MIDDLE).astype(np.int64) + _MIDDLE
    gate = (seen > 0).astype(np.int64) + (seen > 2) + (seen > 20)
    return (gate * 64 + level).astype(np.uint8)


def _met(state: np.ndarray) -> np.ndarray:
    """How many of the states of each step have each gate but the first."""
    steps = np.arange(0, -(-len(state) // 8), STEP_BITS // 8)
    least = [np.add.reduceat(np.bitwise_count(np.packbits(state >= g * 64)), steps, dtype=np.int64) for g in range(1, _GATES)]
    return -np.diff(least, axis=0, append=0).T


class Weights(NamedTuple):
    """Of the code's own logits, a constant, each context's gates, and what sums of each cell turned out to be (zeros, ones)."""

    first: float
    bias: float
    gates: np.ndarray
    seen: np.ndarray

    @staticmethod
    def start(contexts: int) -> Weights:
        return Weights(0.5, 0.0, np.full((contexts, _GATES), 0.3), np.zeros((2, _CELLS)))

    def packed(self) -> np.ndarray:
        return np.concatenate([[self.first, self.bias], self.gates.ravel(), self.seen.ravel()])

    @staticmethod
    def unpacked(flat: np.ndarray, contexts: int) -> Weights:
        n = 2 + contexts * _GATES
        return Weights(float(flat[0]), float(flat[1]), flat[2:n].reshape(contexts, _GATES), flat[n:].reshape(2, _CELLS))


class Learner:
    """A task's online pass over texts: weights that take a step after every STEP_BITS bits."""

    def __init__(self, weights: Weights, step: float):
        self.first, self.bias, self.gates = weights.first, weights.bias, weights.gates.astype(np.float64).copy()
        self.seen, self.step, self.n = np.zeros((2, _CELLS)), step, 0

    def learn(self, code: Code, symbols: np.ndarray, contexts: list[np.ndarray], tables: np.ndarray) -> None:
        """Go through the bits of the symbols in order, with the states of ``tables`` (context, slot)."""
        bits = tables.shape[1].bit_length() - 1
        ends = np.cumsum(code.length[symbols], dtype=np.int64)
        total, read = int(ends[-1]) if len(ends) else 0, READ_STEPS * STEP_BITS
        #: A row for each weight: the code's own logits, a constant, and of each context the logits of each gate but the first.
        x = np.ones((2 + len(contexts) * (_GATES - 1), min(read, total)), np.float32)
        w = np.concatenate([[self.first, self.bias], self.gates[:, 1:].ravel()])
        for begin in range(0, total, read):
            size = min(read, total - begin)
            at, last = np.searchsorted(ends, [begin, begin + size - 1], "right")
            n, place, own = code.passed(symbols[at : last + 1])
            #: The first and the last symbol may lie partly in other reads.
            cut = begin - int(ends[at]) + int(n[0])
            n[0] -= cut
            n[-1] -= int(ends[last]) - begin - size
            place = place[cut : cut + size]
            bit = (place & np.uint32(1)).astype(np.float32)
            x[0, :size] = own[cut : cut + size]
            starts = np.arange(0, size, STEP_BITS)
            met = np.empty((len(starts), len(x)))
            met[:, :2] = np.minimum(STEP_BITS, size - starts)[:, None]
            for row, t, c in zip(range(2, len(x), _GATES - 1), tables, contexts):
                state = t.take(_slots(np.repeat(c[at : last + 1], n), place, bits), mode="clip")
                met[:, row : row + _GATES - 1] = np.maximum(_met(state), 64)
                state = state.astype(np.intp)
                for g in range(1, _GATES):
                    _OF_GATE[g].take(state, out=x[row + g - 1, :size], mode="clip")
            z = np.empty(size, np.float32)
            for begin_, rate in zip(starts, self.step / met):
                part = slice(begin_, min(begin_ + STEP_BITS, size))
                w += rate * self._wrong(w, x[:, part], bit[part], z[part])
            z += _BOUND
            z *= _CELLS / (2 * _BOUND)
            cell = np.minimum(z, np.float32(_CELLS - 0.5))
            bit *= _CELLS
            np.floor(cell, out=cell)
            cell += bit
            self.seen += np.bincount(cell.astype(np.intp), minlength=2 * _CELLS).reshape(2, _CELLS)
        self.first, self.bias, self.gates[:, 1:] = float(w[0]), float(w[1]), w[2:].reshape(len(contexts), _GATES - 1)
        self.n += total

    @staticmethod
    def _wrong(w: np.ndarray, x: np.ndarray, bit: np.ndarray, z: np.ndarray) -> np.ndarray:
        """The error of a step's bits by each row of ``x``; ``z`` gets the sums."""
        np.matmul(w.astype(np.float32), x, out=z)
        np.clip(z, -_BOUND, _BOUND, out=z)
        wrong = np.negative(z)
        np.exp(wrong, out=wrong)
        wrong += 1
        np.divide(-1, wrong, out=wrong)
        wrong += bit
        return x @ wrong

    def row(self) -> bytes:
        """What the task hands on: weights times bits, the cells, and the bits."""
        told = Weights(self.first, self.bias, self.gates, self.seen).packed()
        told[: -self.seen.size] *= self.n
        return np.append(told, self.n).tobytes()


def averaged(rows: list[bytes], before: Weights) -> Weights:
    """Weights of all tasks, each by its bits; the cells of all are added up."""
    if not rows or (total := (added := np.sum([np.frombuffer(r) for r in rows], axis=0))[-1]) == 0:
        return before
    flat = added[:-1]
    flat[: -before.seen.size] /= total
    return Weights.unpacked(flat, len(before.gates))


class Mixer:
    """Weights folded into one value a state and context, and the last stage, for scoring."""

    def __init__(self, code: Code, tables: np.ndarray, weights: Weights):
        self.tables, self.weights = tables, weights
        self.values = [(np.repeat(w, 64) * _LOGITS).astype(np.float32) for w in weights.gates]
        self.own = (code.own * weights.first + weights.bias).astype(np.float32)
        centre = (np.arange(_CELLS) + 0.5) * (2 * _BOUND / _CELLS) - _BOUND
        prior = 1 / (1 + np.exp(-centre))
        p = (weights.seen[1] + 30 * prior) / (weights.seen.sum(axis=0) + 30)
        level = np.arange(-_BOUND * _FINE, _BOUND * _FINE + 1) / _FINE
        #: Half the sum, half what its cell turned out to be.
        refined = (level + np.interp(level, centre, np.log(p / (1 - p)))) / 2
        cost = np.stack([np.log1p(np.exp(refined)), np.log1p(np.exp(-refined))], axis=1) / np.log(10)
        self.cost = cost.astype(np.float32).ravel()

    def log10(self, code: Code, symbols: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        """log10 of each symbol's probability by the code that the mixer was made with."""
        out = np.zeros(len(symbols))
        per = code.per(symbols)
        bits = self.tables.shape[1].bit_length() - 1
        for at in range(0, len(symbols), per):
            order, starts, longer = code.by_depth(symbols[at : at + per])
            near = [c[at : at + per].take(order) for c in contexts]
            cost = np.zeros(len(order))
            for depth, n in enumerate(longer):
                where = starts[:n] + depth
                place, z = code.place.take(where, mode="clip"), self.own.take(where, mode="clip")
                for v, t, c in zip(self.values, self.tables, near):
                    z += v.take(t.take(_slots(c[:n], place, bits), mode="clip"), mode="clip")
                z *= _FINE
                np.clip(z, -_BOUND * _FINE, _BOUND * _FINE, out=z)
                z += _BOUND * _FINE + 0.5
                cell = z.astype(np.uint32)
                cell <<= np.uint32(1)
                cell |= place & np.uint32(1)
                cost[:n] -= self.cost.take(cell, mode="clip")
            out[at : at + per][order] = cost
        return out


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of the texts one after another, and how many each text has; null texts have none."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    split = pc.ascii_split_whitespace(trimmed)
    n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    n[pc.equal(trimmed, "").to_numpy(zero_copy_only=False)] = 0
    flat = split.flatten()
    return flat.filter(pc.not_equal(flat, "")), n


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, c: every word of every text and how often the texts where ``learn`` is true have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, COUNTED):
                batch = whole.slice(at, COUNTED)
                flat, n = tokens(batch.column("text"))
                learns = np.repeat(batch.column("learn").to_numpy(zero_copy_only=False).astype(bool), n)
                counts, others = pc.value_counts(flat.filter(pa.array(learns))), pc.unique(flat.filter(pa.array(~learns)))
                yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["word", "c"])
                yield pa.RecordBatch.from_arrays([others, pa.array(np.zeros(len(others), np.int64))], names=["word", "c"])

    return docs.select("learn", "text").mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _fewer(df: DataFrame) -> DataFrame:
    """``df`` in twice as many partitions as run at once, if it has more: each task hands on whole tables."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


_PARTS_SCHEMA = "k bigint, part bigint, kind string, counts binary"


def _in_parts(tables: np.ndarray) -> Iterator[pd.DataFrame]:
    """A task's tables (fold, context, slot, bit) in parts, each in the narrowest integers that hold it, packed; k is fold and context."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for k, table in enumerate(tables.reshape(-1, *tables.shape[2:])):
        rows = []
        for p, t in enumerate(np.split(table.ravel(), PARTS)):
            if t.any():
                kind = next(x for x in ("<u1", "<u2", "<u4") if t.max() <= np.iinfo(x).max)
                rows.append((k, p, kind, pack(t.astype(kind).tobytes())))
        if rows:  # a frame without rows has columns of no type
            yield pd.DataFrame(rows, columns=["k", "part", "kind", "counts"])


def _added(parts: DataFrame, n: int, bits: int) -> np.ndarray:
    """States (fold 0, fold 1, or both; context; slot) of tables added up by Spark from rows (k, part, kind, counts)."""
    width = (1 << bits) // PARTS

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for k, p, kind, raw in zip(b["k"], b["part"], b["kind"], b["counts"]):
                own = held.setdefault((k % n, p), np.zeros((2, 2 * width), np.float32))
                own[k // n] += np.frombuffer(unpack(raw), kind)
        rows = []
        for (k, p), v in held.items():
            v = np.stack([v[0], v[1], v[0] + v[1]]).reshape(3, width, 2)
            rows.append((k, p, states(v[..., 0], v[..., 1]).tobytes()))
        yield pd.DataFrame(rows, columns=["k", "part", "states"])

    none = states(np.zeros(1, np.float32), np.zeros(1, np.float32))[0]
    tables = np.full((3, n, 1 << bits), none, np.uint8)
    own = parts.withColumn("of", F.col("k") % n)
    done = own.repartition("of", "part").drop("of").mapInPandas(add, "k int, part int, states binary")
    for r in done.toLocalIterator():
        tables[:, r["k"], r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["states"], np.uint8).reshape(3, width)
    return tables


#: Goes through a batch: (fold, symbols, contexts) of what is in it.
Reader = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, list[np.ndarray]]]]


def _counted(df: DataFrame, read: Reader, code: Broadcast, contexts: int, bits: int) -> np.ndarray:
    """States of all that ``read`` finds in ``df``, by folds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((2, contexts, 1 << bits, 2), np.uint32)
        for b in batches:
            for fold, s, c in read(b):
                tally(code.value, s, c, tables[fold])
        for part in _in_parts(tables):
            yield pa.RecordBatch.from_pandas(part, preserve_index=False)

    return _added(_fewer(df).mapInArrow(count, _PARTS_SCHEMA), contexts, bits)


def _learned(df: DataFrame, read: Reader, code: Broadcast, tables: np.ndarray) -> Weights:
    """Weights after two rounds over all that ``read`` finds in ``df``; each fold learns on the other's counts."""
    weights = Weights.start(tables.shape[1])
    held = df.sparkSession.sparkContext.broadcast(tables[:2])
    for step in STEPS:

        def learn(batches: Iterator[pa.RecordBatch], start: Weights = weights, step: float = step) -> Iterator[pa.RecordBatch]:
            own = Learner(start, step)
            for b in batches:
                for fold, s, c in read(b):
                    own.learn(code.value, s, c, held.value[1 - fold])
            yield pa.RecordBatch.from_arrays([pa.array([own.row()], pa.binary())], names=["row"])

        weights = averaged([r["row"] for r in df.mapInArrow(learn, "row binary").collect()], weights)
    held.unpersist()
    return weights


class Model:
    """What tasks need to read texts: the symbols, their counts and their base scores."""

    def __init__(self, words: list[str], counts: np.ndarray, base: np.ndarray):
        self.words = pa.array(words, pa.string())
        self.counts, self.base = counts, base

    def symbols(self, flat: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the texts one after another, an end after each, and where each text begins."""
        found = pc.fill_null(pc.index_in(flat, value_set=self.words), ESCAPE - FIRST).to_numpy(zero_copy_only=False) + FIRST
        ends = np.cumsum(n + 1) - 1
        s = np.full(len(flat) + len(n), END, np.int32)
        inner = np.ones(len(s), bool)
        inner[ends] = False
        s[inner] = found
        return s, ends - n

    @property
    def kind(self) -> str:
        """The narrowest integers that hold every symbol."""
        return "<u2" if len(self.counts) <= 1 << 16 else "<u4"

    def packed(self, s: np.ndarray, begins: np.ndarray) -> pa.Array:
        """The symbols as one value a text."""
        ends = np.append(begins, len(s)) * np.dtype(self.kind).itemsize
        return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(s.astype(self.kind))])

    def unpacked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """What ``symbols`` gave, from ``packed`` texts."""
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // np.dtype(self.kind).itemsize
        s = np.frombuffer(b"".join(texts.to_pylist()), self.kind).astype(np.int32)
        return s, np.append(0, ends[:-1])


def _per_text(words: pa.Array, n: np.ndarray) -> pa.Array:
    """The distinct words of each text, of which text k has the next n[k], with how often it has them."""
    held = words.dictionary_encode()
    width = max(1, len(held.dictionary))
    key, times = np.unique(np.repeat(np.arange(len(n)) * width, n) + held.indices.to_numpy(), return_counts=True)
    ends = np.cumsum(np.bincount(key // width, minlength=len(n)))
    pairs = pa.StructArray.from_arrays([held.dictionary.take(pa.array(key % width)), pa.array(times)], names=["word", "n"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pairs)


def score(docs: DataFrame, learn: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of every document with its scores by a model of the texts where ``learn`` is true.

    Adds n_tokens (words and an end), n_known (tokens that training has), train_tokens, n_bytes (of the
    words, a space or end after each), base_score (log10 by add-half word counts), score (log10
    probability by the mixed model) and bits_per_byte. Null and empty texts are an end alone. Without
    training texts all words are unknown. Repeated rows stay rows, and train as often; equal texts have
    equal scores; an empty table gives no rows. Columns other than text, ``learn`` and ``keep`` are not
    looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    #: The user's columns travel as one, so their names can't meet ours.
    row = F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    docs = docs.select(row.alias("row"), F.coalesce(F.col(learn), F.lit(False)).alias("learn"), F.col("text").alias("text"))
    vocab = materialize(vocabulary(docs))
    known = vocab.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = docs.where("learn").count()
    total, distinct = (known["n"] or 0) + ends, known["v"] + (ends > 0)
    level = F.floor(F.log2("c") * 64).cast("int")
    room, cut = min(MOST_SYMBOLS, max(FEWEST_SYMBOLS, total // PER_SYMBOL)), None
    for r in sorted(vocab.where("c > 1").groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        room -= r["count"]
        if room < 0:
            break
        cut = r["level"]
    frequent = (level >= cut) & (F.col("c") > 1) if cut is not None else F.lit(False)
    top = vocab.where(frequent).orderBy(F.desc("c"), "word").collect()
    words, counts = [r["word"] for r in top], np.array([r["c"] for r in top], np.int64)
    del top
    below = 0.5 * (distinct + 1) + total
    own = np.r_[max(0, total - ends - counts.sum()), ends, counts]
    code = Code(own)
    model = spark.sparkContext.broadcast(Model(words, own, np.log10((own + 0.5) / below)))
    symbol_code = spark.sparkContext.broadcast(code)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                flat, words_in = tokens(batch.column("text"))
                s, begins = m.symbols(flat, words_in)
                escaped = s == ESCAPE
                edges = np.cumsum(words_in)
                lengths = np.r_[0, np.cumsum(pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64))]
                more = [
                    pa.array(words_in + 1),
                    pa.array(np.add.reduceat((~escaped & (m.counts[s] > 0)).astype(np.int64), begins)),
                    pa.array(lengths[edges] - lengths[edges - words_in] + words_in + 1),
                    pa.array(np.add.reduceat(np.where(escaped, 0.0, m.base[s]), begins)),
                    m.packed(s, begins),
                    _per_text(flat.filter(pa.array(escaped[s != END])), np.add.reduceat(escaped.astype(np.int64), begins)),
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "learn", "fold")), *more], names=names)

    schema = T.StructType([T.StructField("row", docs.schema["row"].dataType), *T._parse_datatype_string("learn boolean, fold int, n_tokens bigint, known bigint, n_bytes bigint, base double, symbols binary, odd array<struct<word string, n bigint>>").fields])
    names = [f.name for f in schema.fields]
    dealt = docs.select("row", "learn", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"), "text")
    #: Texts are taken apart once: what follows reads their symbols.
    rows = materialize(dealt.mapInArrow(read, schema).withColumn("id", F.monotonically_increasing_id()))

    def texts(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        for fold in (0, 1):
            some = b.column("symbols").filter(pc.equal(b.column("fold"), fold))
            for at in range(0, len(some), 512):
                s, begins = model.value.unpacked(some.slice(at, 512))
                yield fold, s, symbol_contexts(s, begins)

    learned = rows.where("learn").select("symbols", "fold")
    slots = min(MOST_BITS, max(FEWEST_BITS, int(total // PER_SLOT).bit_length()))
    tables = _counted(learned, texts, symbol_code, 2, slots)
    mixer = Mixer(code, tables[2].copy(), _learned(learned, texts, symbol_code, tables))
    del tables

    rare = vocab.where(~frequent)
    letters = Code(np.bincount(np.frombuffer(" ".join(words).encode() + bytes(range(256)), np.uint8), minlength=256))
    letter_code = spark.sparkContext.broadcast(letters)

    def spellings(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        for fold in (0, 1):
            some = b.column("word").filter(pc.equal(b.column("fold"), fold))
            for at in range(0, len(some), 20_000):
                s, _, c = spelled(some.slice(at, 20_000).cast(pa.binary()))
                yield fold, s, c

    #: New words are spelled as words that training has rarely, each once.
    shown = rare.where("c > 0").select("word", F.pmod(F.xxhash64("word"), F.lit(2)).cast("int").alias("fold"))
    tables = _counted(shown, spellings, letter_code, 4, SPELLING_BITS)
    speller = Mixer(letters, tables[2].copy(), _learned(shown, spellings, letter_code, tables))
    del tables
    #: Of the escaped words in training, how many it has elsewhere too.
    seen = rare.agg(F.sum("c").alias("all"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("again")).first()
    escaped, again = seen["all"] or 0, ((seen["again"] or 0) + 0.5) / ((seen["all"] or 0) + 1)
    text_mixer, word_mixer = spark.sparkContext.broadcast(mixer), spark.sparkContext.broadcast(speller)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 5_000):
                some = whole.slice(at, 5_000)
                s, begins, ctx = spelled(some.column("word").cast(pa.binary()))
                new = np.add.reduceat(word_mixer.value.log10(letter_code.value, s, ctx), begins)
                yield pa.RecordBatch.from_arrays([some.column("word"), some.column("c"), pa.array(new)], names=["word", "c", "new"])

    by_count = F.lit(again) * F.col("c") / F.lit(float(max(1, escaped)))
    rare_scored = rare.select("word", "c").mapInArrow(spell, "word string, c bigint, new double").select(
        "word", "c", F.log10(by_count + F.lit(1 - again) * F.pow(F.lit(10.0), F.greatest("new", F.lit(-300.0)))).alias("lp")
    )

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                s, begins = model.value.unpacked(batch.column("symbols"))
                mixed = np.add.reduceat(text_mixer.value.log10(symbol_code.value, s, symbol_contexts(s, begins)), begins)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept.names[:-1]), pa.array(mixed)], names=kept.names)

    kept = T.StructType([rows.schema[c] for c in ("id", "row", "n_tokens", "known", "n_bytes", "base")] + [T.StructField("mixed", T.DoubleType())])
    scored = rows.select(*kept.names[:-1], "symbols").mapInArrow(mix, kept)
    odd = rows.select("id", F.explode("odd").alias("odd")).select("id", "odd.word", "odd.n")
    #: Each rare word is one row there, so a partition of it is small enough to be looked up unsorted.
    met = odd.join(rare_scored.hint("shuffle_hash"), "word")
    more = met.groupBy(F.col("id").alias("of")).agg(
        F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("known2"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / below)).alias("base2"),
        F.sum(F.col("n") * F.col("lp")).alias("mixed2"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    score_ = F.col("mixed") + F.coalesce("mixed2", F.lit(0.0))
    return scored.join(more, F.col("id") == F.col("of"), "left").select(
        *[F.col(f"row.k{i}").alias(c) for i, c in enumerate(keep)],
        "n_tokens",
        (F.col("known") + zero("known2")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        "n_bytes",
        (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"),
        score_.alias("score"),
        (-score_ / np.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )
