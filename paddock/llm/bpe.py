"""BPE encoding and decoding of whole texts, long ones by tree concatenation.

A text of up to LEAF characters is encoded where it lies. A longer one is halved until its pieces fit;
the pieces are spread over the cluster and encoded in parallel, wherever the cuts fall, inside words
too. Then pairs of neighbours are joined level by level: a window around the join is encoded again and
grows until it agrees with the left half's tokens on its left and with the right half's on its right,
token for token; between the two agreements the window's tokens replace both. Every neighbouring pair
of tokens then stems from one encoding that saw both, which is what makes a BPE sequence the one of the
whole text. A piece hands on its ids and the offsets of the tokens near its ends; where a window grows
past those, the offsets of the whole half are found anew.
"""

from __future__ import annotations

import json
import os
import sys
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.session import ship

#: Characters of a piece, of the first window on either side of a join, rows encoded at once, and
#: words and parts of words whose tokens a worker remembers.
LEAF, WINDOW, ROWS, REMEMBERED = 32_768, 64, 256, 200_000
#: Tokens in a row that must agree on either side; the share of a piece whose offsets it hands on at either end.
AGREE, EDGE = 2, 32
#: Words of these characters alone are in normal form C and have plain lower case (no combining marks, no dotted capital i).
_PLAIN = regex.compile("[!-~¡-įı-ſ]*")
#: The letter that byte-level tokenizers write for each byte: itself where it shows, else one from 256 on, in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_SPACES = regex.compile(r"[\x20\x09-\x0D]")


class Encoder:
    """The tokenizer of a worker, with a bounded memory of words.

    Where the tokenizer's file shows that its pre-tokenizer drops white space and never joins what it
    parts, a text's tokens are those of its words one after another, and those of a plain word are its
    parts' ones. With any other file, texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.by_word = self._parts_words(told)
        self.parts_of = regex.compile(told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]) if self.by_word else None
        self.special = regex.compile("|".join(map(regex.escape, [t["content"] for t in told.get("added_tokens") or []])) or "(?!)")
        self.words: dict[bytes, tuple[bytes, str]] = {}
        self.parts: dict[str, tuple[bytes, str]] = {}

    @staticmethod
    def _parts_words(told: dict) -> bool:
        """Whether words can be encoded one by one: white space parts tokens and is dropped, and nothing looks across it."""
        if sys.byteorder != "little" or array("I").itemsize != 4 or told["model"]["type"] != "BPE" or told["model"].get("unk_token"):
            return False
        if told.get("decoder") or told.get("post_processor") or (told.get("model") or {}).get("dropout"):
            return False
        normal = [(n["type"], n.get("pattern"), n.get("content")) for n in (told.get("normalizer") or {}).get("normalizers", [])]
        split = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            normal == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and [p["type"] for p in split] == ["Split", "ByteLevel"]
            and split[0]["behavior"] == "Removed"
            and split[0]["invert"]
            and r"\s" in split[0]["pattern"]["Regex"].rsplit("|", 1)[-1]
            and not split[1]["add_prefix_space"]
            and not split[1]["use_regex"]
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or _SPACES.search(t["content"]) for t in told.get("added_tokens") or [])
        )

    def _encoded(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids and decoded text of each, by the library."""
        out = []
        for at in range(0, len(texts), 4096):
            found = [e.ids for e in self.tokenizer.encode_batch(texts[at : at + 4096], add_special_tokens=False)]
            said = self.tokenizer.decode_batch(found, skip_special_tokens=False)
            out += [(np.asarray(ids, "<u4").tobytes(), d) for ids, d in zip(found, said)]
        return out

    def _learn(self, new: list[bytes]) -> None:
        """Remember the tokens of words: of plain ones by their parts, of others by themselves."""
        if len(self.parts) > REMEMBERED:
            self.parts = {}
        odd, held, words = [], self.parts, self.words
        tokenize, parts_of = self.tokenizer.model.tokenize, self.parts_of.findall
        for w in new:
            s = w.decode()
            if self.special.search(s) or not (w.isascii() or _PLAIN.fullmatch(s)):
                odd.append(w)
                continue
            found = []
            for p in (s.lower(),) if s.isascii() and s.isalpha() else parts_of(s.lower()):
                if (own := held.get(p)) is None:
                    tokens = tokenize(p.encode().decode("latin-1").translate(_BYTE_LETTERS))
                    own = held[p] = array("I", [t.id for t in tokens]).tobytes(), " ".join([t.value for t in tokens])
                found.append(own)
            words[w] = found[0] if len(found) == 1 else (b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[0]]))
        words.update(zip(odd, self._encoded([w.decode() for w in odd])))

    def coded(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Token ids of each text, as little-endian unsigned 32-bit integers, and the text that they decode to.

        Without a decoder the library joins the tokens by spaces, so a text decodes to its words' joined ones.
        """
        if not self.by_word:
            whole = self._encoded(texts)
            return [x[0] for x in whole], [x[1] for x in whole]
        split = [t.encode("utf-8", "replace").split() for t in texts]
        own = {w for ws in split for w in ws}
        new = list(own - self.words.keys())
        if len(self.words) + len(new) > REMEMBERED:  # frequent words are among the batch's own and stay
            self.words = {w: self.words[w] for w in own & self.words.keys()}
        self._learn(new)
        parts = [list(map(self.words.__getitem__, ws)) for ws in split]
        return [b"".join([p[0] for p in ps]) for ps in parts], [" ".join([p[1] for p in ps if p[0]]) for ps in parts]

    def decode(self, ids: bytes) -> str:
        """The text that ids decode to; where tokens are joined by spaces, from each token's own."""
        numbers = np.frombuffer(ids, "<u4")
        if self.by_word:
            return " ".join(self.said[numbers])
        return self.tokenizer.decode(numbers.tolist(), skip_special_tokens=False)

    @cached_property
    def said(self) -> np.ndarray:
        n = self.tokenizer.get_vocab_size()
        return np.array(self.tokenizer.decode_batch([[i] for i in range(n)], skip_special_tokens=False), object)

    def spans(self, text: str, at: int) -> np.ndarray:
        """(id, start, end) of each token, with ``at`` added to the offsets."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        found = np.empty((len(e.ids), 3), np.int64)
        found[:, 0] = e.ids
        if len(e.ids):
            found[:, 1:] = np.asarray(e.offsets, np.int64) + at
        return found

    def edges(self, text: str, reach: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """Spans of the tokens in about ``reach`` characters at both ends of a piece, and whether these are all of it.

        The ends are parted from the rest by white space; without any near, the whole piece is spanned.
        """
        if self.by_word and len(text) > 4 * reach:
            head = max((text.rfind(c, reach, 2 * reach) for c in " \n\t"), default=-1)
            tail = max((text.rfind(c, len(text) - 2 * reach, len(text) - reach) for c in " \n\t"), default=-1)
            if head > 0 and tail > 0:
                return self.spans(text[:head], 0), self.spans(text[tail:], tail), False
        whole = self.spans(text, 0)
        return whole, whole, True


def _agreements(one: np.ndarray, two: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
    """Places (i in one, j in two) where AGREE tokens in a row are alike, with offsets strictly within (lo, hi)."""
    first = lambda x: np.r_[True, x[1:, 1] != x[:-1, 1]] if len(x) else np.zeros(0, bool)
    where = {int(s): j for j, s in enumerate(two[:, 1]) if first_two[j]} if (first_two := first(two)).any() else {}
    starts = first(one)
    found = []
    for i in range(1, len(one) - AGREE):
        j = where.get(int(one[i, 1])) if starts[i] else None
        if j is None or j + AGREE > len(two) or one[i, 1] <= lo or one[i + AGREE - 1, 2] >= hi:
            continue
        if (one[i : i + AGREE] == two[j : j + AGREE]).all():
            found.append((i, j))
    return found


def concatenate(
    encoder: Encoder, text: str, at: int, cut: int, left: np.ndarray, right: np.ndarray, closed: tuple[bool, bool] = (True, True), reach: int = WINDOW
) -> tuple[int, np.ndarray, int] | None:
    """How many tokens of ``left`` stay, the tokens between, and from which on those of ``right`` stay.

    ``text`` begins at offset ``at``; ``left`` and ``right`` span its two parts before and after ``cut``.
    Where a side isn't ``closed``, more text lies beyond it; None if a window would need that.
    """
    end = at + len(text)
    while True:
        a, b = max(at, cut - reach), min(end, cut + reach)
        if (a == at and not closed[0]) or (b == end and not closed[1]):
            return None
        window = encoder.spans(text[a - at : b - at], a)
        if a == at and b == end:
            return 0, window, len(right)
        before = np.searchsorted(left[:, 1], a)
        begins = [(0, 0)] if a == at else _agreements(window, left[before:], a, cut) if before < len(left) else []
        if b == end:
            ends = [(len(window), len(right))]
        else:
            ends = _agreements(window, right[: np.searchsorted(right[:, 1], b)], cut, b) if len(right) else []
        if begins and ends:
            i, j = begins[len(begins) // 2]
            k, m = ends[len(ends) // 2]
            if i <= k:
                return (before + j if a != at else 0), window[i:k], m
        reach *= 2


def cuts(n: int, leaf: int = LEAF) -> list[int]:
    """Boundaries of the pieces of a text of n characters: halves of halves until none is over ``leaf``."""
    parts = 1
    while n / parts > leaf:
        parts *= 2
    return [n * i // parts for i in range(parts + 1)]


class Half:
    """Neighbouring pieces joined so far: text, ids, and the spans at both ends (of all tokens: whole), offsets from its begin."""

    def __init__(self, text: str, ids: np.ndarray, head: np.ndarray, tail: np.ndarray, whole: bool):
        self.text, self.ids, self.head, self.tail, self.whole = text, ids, head, tail, whole

    def spanned(self, encoder: Encoder) -> np.ndarray:
        """The spans of all its tokens."""
        if not self.whole:
            self.head = self.tail = encoder.spans(self.text, 0)
            self.whole = True
        return self.head

    def joined(self, encoder: Encoder, other: Half, reach: int) -> Half:
        n, done = len(self.text), None
        near, far = self.tail, other.head
        if len(near) and len(far):
            a, b = (0 if self.whole else int(near[0, 1])), (len(other.text) if other.whole else int(far[-1, 2]))
            done = concatenate(encoder, self.text[a:] + other.text[:b], a, n, near, _moved(far, n), (self.whole, other.whole), reach)
        if done is None:
            near, far = self.spanned(encoder), other.spanned(encoder)
            done = concatenate(encoder, self.text + other.text, 0, n, near, _moved(far, n), reach=reach)
        kept, between, onward = done
        gone = len(near) - kept
        ids = np.concatenate([self.ids[: len(self.ids) - gone], between[:, 0].astype("<u4"), other.ids[onward:]])
        if self.whole and other.whole:
            spans = np.concatenate([near[:kept], between, _moved(far, n)[onward:]])
            return Half(self.text + other.text, ids, spans, spans, True)
        #: The far ends stay as they were, as far as the join didn't reach into them.
        tail = other.tail[max(0, len(other.tail) - (len(other.ids) - onward)) :]
        return Half(self.text + other.text, ids, self.head[: len(self.ids) - gone], _moved(tail, n), False)


def _moved(spans: np.ndarray, by: int) -> np.ndarray:
    return spans + np.array([0, by, by], np.int64)


def join_pieces(encoder: Encoder, pieces: list[Half], reach: int = WINDOW) -> np.ndarray:
    """Ids of a text from its pieces, joined pair by pair, level by level."""
    while len(pieces) > 1:
        pieces = [pieces[i].joined(encoder, pieces[i + 1], reach) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0].ids


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer_path: str, keep: list[str], leaf: int = LEAF) -> DataFrame:
    """``keep`` columns of every document, then ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded``.

    Null texts count as empty and have no tokens. Texts of any length are encoded whole, special tokens
    that occur in them as the library does. Repeated rows stay rows of their own; an empty table gives no
    rows. Kept columns named ids or decoded give way to the operator's. ``tokenizer_path`` must be
    readable on every executor.
    """
    ship(docs.sparkSession)
    keep = [c for c in keep if c.lower() not in ("ids", "decoded")]
    reach, edge = max(4, min(WINDOW, leaf // 8)), max(4, leaf // EDGE)
    text = F.coalesce(F.col("text"), F.lit(""))
    #: The user's columns travel as one, so their names can't meet ours.
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("row"), text.alias("text"))
    of_row = T.StructField("row", rows.schema["row"].dataType)
    schema = T.StructType([of_row, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    long = F.length("text") > leaf

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids, said = e.coded(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(ids, pa.binary()), pa.array(said, pa.string())], names=["row", "ids", "decoded"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for n, t in enumerate(whole.column("text")):
                t = t.as_py()
                ends = cuts(len(t), leaf)
                at = pa.array([n] + [None] * (len(ends) - 2), pa.int32())  # the row travels with its first piece
                yield pa.RecordBatch.from_arrays(
                    [whole.column("row").take(at), pa.array([whole.column("id")[n].as_py()] * (len(ends) - 1)), pa.array(range(len(ends) - 1), pa.int32()), pa.array([t[a:b] for a, b in zip(ends, ends[1:])], pa.string())],
                    names=["row", "id", "piece", "text"],
                )

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 32):
                batch = whole.slice(at, 32)
                texts = batch.column("text").to_pylist()
                spans = [e.edges(t, edge) for t in texts]
                heads = [h.astype("<i4").tobytes() for h, _, _ in spans]
                tails = [b"" if whole_ else s.astype("<i4").tobytes() for _, s, whole_ in spans]
                more = [pa.array(e.coded(texts)[0], pa.binary()), pa.array(heads, pa.binary()), pa.array(tails, pa.binary()), pa.array([w for _, _, w in spans])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "ids", "head", "tail", "whole"])

    def joined(table: pa.Table) -> pa.Table:
        e = _encoder(tokenizer_path)
        table = table.sort_by("piece").combine_chunks()
        held = []
        for t, ids, head, tail, whole in zip(*[table.column(c).to_pylist() for c in ("text", "ids", "head", "tail", "whole")]):
            first, last = (np.frombuffer(x, "<i4").reshape(-1, 3).astype(np.int64) for x in (head, tail))
            held.append(Half(t, np.frombuffer(ids, "<u4"), first, first if whole else last, whole))
        ids = join_pieces(e, held, reach).astype("<u4").tobytes()
        return pa.table([table.column("row").slice(0, 1), pa.array([ids], pa.binary()), pa.array([e.decode(ids)], pa.string())], names=["row", "ids", "decoded"])

    cut = T.StructType([of_row, *T._parse_datatype_string("id long, piece int, text string").fields])
    coded = T.StructType([*cut.fields, *T._parse_datatype_string("ids binary, head binary, tail binary, whole boolean").fields])
    held = rows.where(long).withColumn("id", F.monotonically_increasing_id()).mapInArrow(pieces, cut)
    whole = held.repartition("id", "piece").mapInArrow(tokens, coded).groupBy("id").applyInArrow(joined, schema)
    done = rows.where(~long).mapInArrow(short, schema).unionByName(whole)
    return done.select(*[F.col(f"row.k{i}").alias(c) for i, c in enumerate(keep)], "ids", "decoded")
