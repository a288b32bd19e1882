"""Logs whose layout differs by firmware and is searched for: directory, definitions, chunk table, field offsets.

One task goes through a file's head, which ends before its samples: hypotheses about the layout are tried
against what the bytes must satisfy, and tables of definitions and chunks come out. Units, time bases and
clamped counts are plans over these tables. Samples are decoded chunk by chunk from byte ranges, so that one
large file is work for many tasks and a filter on channels leaves the other bytes unread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paddock.functions.units import UNITS, find
from paddock.session import ship, spread
from paddock.sources.fileio import Held, Ranged

# Directory places in order of trial, a record's mark, the clock's tick, bounds of strides.
DIRECTORIES = (0x80, 0x78, 0x70, 0x68, 0x60, 0x58, 0x50, 0x48, 0x40)
MARK = (0x7C72).to_bytes(8, "little")
LEAST_BYTES, ENTRIES, TICK_NS, MARKED_STRIDE, NAME_BYTES, UNIT_BYTES = 0x100, 20, 100, 304, 112, 24
CHUNK_STRIDES, PLAIN_STRIDES, LEAST_MARKED, LEAST_CHUNK, EXPORT_CHANNELS, UNIT_AT = (48, 512), (100, 1024), 0xDC, 0x3C, 200, 0x90
# Sample types by code; codes beyond these are float32.
TYPES = {0: ("i8", "<i1"), 1: ("u8", "<u1"), 2: ("i16", "<i2"), 3: ("u16", "<u2"), 4: ("i32", "<i4"), 5: ("u32", "<u4"), 6: ("f32", "<f4"), 7: ("f64", "<f8")}
# Dimension of a quantity code; none for plain numbers and shares.
QUANTITIES = {
    0: None, 1: "length", 2: "volume", 3: "speed", 4: "temperature", 6: "time", 7: "angle", 8: "angular_velocity", 9: "pressure", 10: "acceleration", 11: "voltage", 12: "current", 13: "mass", 14: "force", 15: "torque",
    16: None, 20: "time", 23: "angular_acceleration",
}
SHARE_CODE, SHARE_TEXTS = 16, ("pp1", "%", "ratio")
# Texts in the unit's place that name no unit.
MARKS = ("raw", "flag", "flags", "cnt", "count", "code", "pp1", "laps", "lambda", "bit", "bits", "state", "driver", "user defined", "defined", "none", "n/a")

_ENTRY = np.dtype({"names": ["at", "count", "kind", "next_count"], "formats": ["<u8", "<u4", "<u4", "<u4"], "offsets": [0, 8, 0x14, 0x18], "itemsize": 32})
HEADS = (
    "recording_id string, layout string, directory int, type_at int, channels array<struct<channel_idx:int,id:bigint,name:string,type_code:bigint,quantity:int,declared:string>>, "
    "chunks array<struct<row:int,id:bigint,ticks:bigint,count:bigint,at:bigint>>, size bigint, problems array<struct<severity:string,code:string,message:string>>"
)


class Unreadable(ValueError):
    pass


def _u4(data: bytes, at: np.ndarray) -> np.ndarray:
    """Unsigned words at byte offsets; -1 where the bytes end."""
    raw = np.frombuffer(data, np.uint8)
    fits = (at >= 0) & (at + 4 <= len(raw))
    safe = np.where(fits, at, 0)
    if not len(raw) or not len(at):
        return np.full(len(at), -1, np.int64)
    word = sum(raw[np.minimum(safe + k, len(raw) - 1)].astype(np.int64) << (8 * k) for k in range(4))
    return np.where(fits, word, -1)


def _marks(data: bytes, start: int, end: int) -> Iterator[int]:
    """Places of the mark from ``start`` on, in steps of two bytes."""
    at = data.find(MARK, start, end)
    while at >= 0:
        if (at - start) % 2 == 0:
            yield at
        at = data.find(MARK, at + 1, end)


def search_layout(data: bytes, size: int) -> dict | None:
    """The first hypothesis that holds: a directory at one of the places, its definitions marked or not.

    Three neighbouring entries must rise and stay in the file, the first be definitions, and the bytes
    between the other two divide into chunk records of a sane width, by either count.
    """
    for place in DIRECTORIES:
        n = min(ENTRIES, (len(data) - place) // 32)
        if n < 3:
            continue
        e = np.frombuffer(data, _ENTRY, n, place)
        at = e["at"]
        rising = (at[:-2] < at[1:-1]) & (at[1:-1] < at[2:]) & (at[2:] <= size) & (e["kind"][:-2] == 1) & (e["count"][:-2] > 0)
        for i in np.flatnonzero(rising):
            defs, chunks, end = (int(at[i + k]) for k in range(3))
            for count in (int(e["next_count"][i]), int(e["count"][i + 1])):
                if count and (end - chunks) % count == 0 and CHUNK_STRIDES[0] <= (end - chunks) // count <= CHUNK_STRIDES[1]:
                    return {"directory": place, "defs": defs, "defs_count": int(e["count"][i]), "chunks": chunks, "end": end, "chunk_count": count}
    return None


def _name(data: bytes, at: int) -> str:
    return data[at : at + NAME_BYTES].decode("utf-16-le", "replace").split("\0", 1)[0].strip()


def definitions(data: bytes, found: dict) -> tuple[list[tuple[int, str, bytes]], bool, int]:
    """(id, name, record) of each channel, whether records are marked, and where a record's name starts."""
    reach = min(found["chunks"], found["defs"] + 8192, len(data))
    first = next(_marks(data, found["defs"], reach), None)
    if first is not None:
        second = next(_marks(data, first + 16, min(found["chunks"], first + 1024, len(data))), None)
        stride = MARKED_STRIDE if second is None else second - first
        places = range(first, min(found["chunks"], len(data)) - LEAST_MARKED + 1, stride) if stride >= LEAST_MARKED else ()
        rows = [(int.from_bytes(data[p + 8 : p + 12], "little"), _name(data, p + 0x10), data[p : p + stride]) for p in places if data.startswith(MARK, p)]
        if rows := [r for r in rows if r[0] and r[1]]:
            return rows, True, 0x10
    stride = (found["chunks"] - found["defs"]) // found["defs_count"]
    if not PLAIN_STRIDES[0] <= stride <= PLAIN_STRIDES[1]:
        return [], False, 8
    places = [p for p in range(found["defs"], found["defs"] + stride * found["defs_count"], stride) if p + 16 <= len(data)]
    rows = [(int.from_bytes(data[p : p + 4], "little"), _name(data, p + 8), data[p : p + stride]) for p in places]
    return [r for r in rows if r[1]], False, 8


def chunk_table(data: bytes, found: dict, export: bool, size: int) -> np.ndarray:
    """Rows of (id, ticks, count, place) in table order.

    The table is taken up where a record first tells its channel twice. Without such a record channels
    are interleaved in order of definition.
    """
    start, count = found["chunks"], found["chunk_count"]
    width = (found["end"] - start) // count
    if width < LEAST_CHUNK:
        return np.empty((0, 4), np.int64)
    field = lambda at, k: _u4(data, at + k)
    probes = start + np.arange(0, min(4096, found["end"] - start), 4)
    agrees = (probes + LEAST_CHUNK <= len(data)) & (field(probes, 4) > 0) & (field(probes, 4) == field(probes, 8)) & (field(probes, 0x1C) > 0)
    if agrees.any():
        at = int(probes[agrees.argmax()])
        if export:
            back = np.arange(at - width, start - 1, -width)
            fits = (field(back, 4) == field(back, 8)) & (field(back, 0x1C) > 0)
            at -= width * int(np.logical_and.accumulate(fits).sum())
        rows = at + width * np.arange(min(count, (found["end"] - at) // width))
        table = np.stack([field(rows, k) for k in (4, 0x18, 0x1C, 0x38)], axis=1)
        good = (table[:, 0] == field(rows, 8)) & ((table[:, 0] > 0) | (export & (table[:, 0] == 0))) & (table[:, 1] > 0) & (table[:, 2] > 0) & (table[:, 3] >= 0) & (table[:, 3] < size)
        if good.any():
            return table[good]
    rows = start + width * np.arange(count)
    whole = rows + width <= len(data)
    table = np.stack([np.arange(count) % max(found["defs_count"], 1), *[field(rows, k) for k in (0x18, 0x1C, 0x38)]], axis=1)
    return table[whole & (table[:, 1:] > 0).all(axis=1) & (table[:, 3] < size)]


def search_types(records: list[bytes], of: np.ndarray, chunks: np.ndarray, size: int) -> tuple[int, int, int] | None:
    """(offset, chunks past the end, unknown codes) of the types' field, or None.

    At the right offset the widths that the codes stand for lay the chunks end to end. Every four-byte
    offset is scored: chunks past the end, then gaps and overlaps, then unknown codes; the lowest wins, of
    equal ones the first. ``of`` is each chunk's record, or -1.
    """
    length = min(map(len, records))
    if length < 4:
        return None
    codes = np.stack([np.frombuffer(r, "<u4", length // 4) for r in records]).astype(np.int64)
    known = chunks[of >= 0]
    if not len(known):
        return None
    order = np.argsort(known[:, 3], kind="stable")
    rows, at, count = of[of >= 0][order], known[order, 3], known[order, 2]
    widths = np.array([np.dtype(TYPES.get(c, TYPES[6])[1]).itemsize for c in range(256)])
    scores = []
    for k in np.flatnonzero((codes <= 255).all(axis=0)):
        ends = at + count * widths[codes[rows, k]]
        gaps = np.abs(at[1:] - np.maximum.accumulate(ends)[:-1]).sum()
        scores.append((int((ends > size).sum()), int(gaps), int((codes[:, k] > 7).sum()), 4 * int(k)))
    if not scores:
        return None
    past, _, unknown, best = min(scores)
    return best, past, unknown


def _text(record: bytes, at: int) -> str | None:
    """The printable text at a place of a record, or None if it isn't one."""
    place = record[at : at + UNIT_BYTES]
    text = place[: len(place) & ~1].decode("utf-16-le", "replace").split("\0", 1)[0]
    return text.strip() if text.isascii() and text.isprintable() else None


def _texts(records: list[bytes], places: list[int]) -> dict[int, list[str | None]]:
    """``_text`` of every record at each place; decoded only where a text may start, as most places hold none."""
    width = max(map(len, records))
    held = np.zeros((len(records), width + UNIT_BYTES + 1), np.uint8)
    for i, r in enumerate(records):
        held[i, : len(r)] = np.frombuffer(r, np.uint8)
    size = np.array([len(r) for r in records])
    at = np.array(places, np.int64)
    first, second = held[:, at], held[:, at + 1]
    empty = (first == 0) & (second == 0) | (at + 2 > size[:, None])
    told = (second == 0) & (first >= 0x20) & (first < 0x7F) & ~empty
    found = {}
    for k, place in enumerate(places):
        if not told[:, k].any():
            found[place] = ["" if e else None for e in empty[:, k]]
        else:
            found[place] = ["" if e else _text(r, place) if t else None for r, e, t in zip(records, empty[:, k], told[:, k])]
    return found


def _accepts(code: int, text: str) -> bool:
    """Whether a unit's text goes with a quantity's code."""
    if code not in QUANTITIES:
        return True
    if code == SHARE_CODE:
        return text.lower() in SHARE_TEXTS
    return text.lower() in MARKS if QUANTITIES[code] is None else (found := find(text)) is not None and found[1] == QUANTITIES[code]


def search_units(records: list[bytes], name_at: int) -> tuple[int | None, int | None]:
    """Offsets of the quantity's code and of the unit's text, as far as all records bear them out.

    Pairs of offsets are voted on: in nine of ten records with a text, four at least, its dimension must
    be the code's. Else a text at its usual place stands alone, and codes that are all known count from
    eight records on.
    """
    length = len(records[0])
    offsets = range(0, max(0, length - 4), 4)
    texts = _texts(records, [at for at in offsets if at != name_at])
    hits = {at: n for at, found in texts.items() if (n := sum(1 <= len(t or "") <= 12 for t in found))}
    starts = [at for at in hits if not hits.get(at - 4, 0) >= hits[at]]  # else the tail of a longer text
    whole = min(map(len, records))
    held = np.stack([np.frombuffer(r, "<u4", whole // 4) for r in records])
    low, high = held.min(axis=0), held.max(axis=0)
    small = [at for at in offsets if at + 4 <= whole and high[at // 4] <= 64 and low[at // 4] < high[at // 4]]
    words = {at: held[:, at // 4].tolist() for at in small}
    votes = []
    for q in small:
        for u in starts:
            told = [(c, t) for c, t in zip(words[q], texts[u]) if t]
            agree = sum(_accepts(c, t) for c, t in told)
            if u != q and len(told) >= 4 and agree * 100 >= len(told) * 90:
                votes.append((-agree, q, u))
    if votes:
        return min(votes)[1:]
    known = [q for q in small if all(c in QUANTITIES for c in words[q])]
    if UNIT_AT in starts:
        return next((q for q in known if q != UNIT_AT), None), UNIT_AT
    return (known[0] if known and len(records) >= 8 else None), None


def head(source: Held | Ranged) -> dict:
    """What a file's head tells, as a row of ``HEADS``; raises ``Unreadable``."""
    size, problems = source.size, []
    if size < LEAST_BYTES:
        raise Unreadable("shorter than 256 bytes")
    found = search_layout(source.read(0, DIRECTORIES[0] + 32 * ENTRIES), size)
    if found is None:
        raise Unreadable("no directory with definitions and chunks")
    # definitions and chunks lie together, wherever the samples are
    base, place = found["defs"], found["directory"]
    found |= {k: found[k] - base for k in ("defs", "chunks", "end")}
    data = source.read(base, found["end"])
    rows, marked, name_at = definitions(data, found)
    layout = f"{'marker' if next(_marks(data, found['defs'], min(found['chunks'], found['defs'] + 8192, len(data))), None) is not None else 'markerless'}@0x{place:x}"
    if place != DIRECTORIES[0]:
        problems += [("warning", "pds.directory_offset_nonstandard", f"0x{place:x}"), ("info", "pds.layout", layout)]
    if not rows:
        raise Unreadable("no channel definitions")
    export = not marked and found["defs_count"] <= EXPORT_CHANNELS
    chunks = chunk_table(data, found, export, size)
    if not len(chunks):
        raise Unreadable("no readable chunks")
    records, ids = [r for _, _, r in rows], {r[0]: i for i, r in enumerate(rows)}
    types = None if export else search_types(records, np.array([ids.get(int(c), -1) for c in chunks[:, 0]]), chunks, size)
    if types is None and not export:
        raise Unreadable("no sample type agrees with the chunks")
    if types:
        at, past, unknown = types
        told = (("pds.sample_data_truncated", past), ("pds.type_code_unrecognized", unknown), ("pds.sample_type_offset_nonstandard", at))
        problems += [("warning", code, str(n)) for code, n in told if n]
    quantity, unit = search_units(records, name_at)
    word = lambda r, k: int.from_bytes(r[k : k + 4], "little") if k is not None and k + 4 <= len(r) else None
    return {
        "layout": layout, "directory": place, "type_at": types[0] if types else None, "size": size, "problems": problems,
        "channels": [(i, cid, name, word(r, types[0]) if types else 7, word(r, quantity), (_text(r, unit) or "") if unit is not None else "") for i, (cid, name, r) in enumerate(rows)],
        "chunks": [(i, *map(int, c)) for i, c in enumerate(chunks)],
    }


def _heads(rows: Iterator[tuple[str, Callable]]) -> Iterator[pd.DataFrame]:
    """A row of ``HEADS`` per recording; what can't be read is a row with its problem."""
    names = ["recording_id", "layout", "directory", "type_at", "channels", "chunks", "size", "problems"]
    held = []
    for rid, source in rows:
        try:
            with source() as s:
                told = head(s)
        except (Unreadable, OSError, ValueError) as broken:
            told = {"channels": [], "chunks": [], "problems": [("error", "pds.unreadable", str(broken))]}
        held.append([rid, *[told.get(n) for n in names[1:]]])
        if sum(len(r[4]) + len(r[5]) for r in held) > 20_000:
            yield pd.DataFrame(held, columns=names, dtype=object)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names, dtype=object)


def _bytes_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from contextlib import nullcontext

    for b in batches:
        yield from _heads((rid, lambda data=data: nullcontext(Held(bytes(data)))) for rid, data in zip(b["recording_id"], b["content"]))


def _file_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield from _heads((rid, lambda rid=rid: Ranged(rid)) for rid in b["recording_id"])


def heads(raw: DataFrame) -> DataFrame:
    """``HEADS`` of ``raw``: recording_id with content, or recording_id alone, a path whose head is read by ranges."""
    ship(raw.sparkSession)
    if "content" in raw.columns:
        return raw.select("recording_id", "content").mapInPandas(_bytes_rows, HEADS)
    return raw.select("recording_id").mapInPandas(_file_rows, HEADS)


def unit_of(quantity: Column, declared: Column) -> tuple[Column, Column]:
    """(unit, unit_source): a declared text wins, marks of no unit included; else the quantity's base unit."""
    base = {code: UNITS[d][0][0] for code, d in QUANTITIES.items() if d}
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in base.items() for x in pair]), quantity)
    text = F.coalesce(declared, F.lit(""))
    source = F.when((text != "") & ~F.lower(text).isin(*MARKS), "declared").when((text != "") | known.isNotNull(), "spec_default").otherwise("unknown")
    return F.when(text != "", text).otherwise(F.coalesce(known, F.lit(""))), source


def _typed(told: DataFrame) -> DataFrame:
    """recording_id, channel_idx, id, name, unit, unit_source, sample_type, width of each definition."""
    c = told.select("recording_id", F.explode("channels").alias("c")).select("recording_id", "c.*")
    unit, source = unit_of(F.col("quantity"), F.col("declared"))
    code = F.when(F.col("type_code") <= 7, F.col("type_code").cast("int")).otherwise(6)
    kinds = F.array(*[F.lit(TYPES[k][0]) for k in range(8)])
    widths = F.array(*[F.lit(np.dtype(TYPES[k][1]).itemsize) for k in range(8)])
    return c.select("recording_id", "channel_idx", "id", "name", unit.alias("unit"), source.alias("unit_source"), F.get(kinds, code).alias("sample_type"), F.get(widths, code).alias("width"))


def tables(told: DataFrame) -> dict[str, DataFrame]:
    """channels, chunks and diagnostics of ``heads``.

    A chunk belongs to the last definition with its id. Its count is cut to what the file holds; its time
    and sample bases are sums over the chunks of its channel before it, in the table's order, which isn't
    that of the bytes in interrupted logs. Joins are merge joins: columns of a table of heads are told to be far
    smaller than they are, and would be broadcast through the driver.
    """
    typed = _typed(told)
    owner = typed.groupBy("recording_id", "id").agg(F.max_by(F.struct("channel_idx", "name", "sample_type", "width"), "channel_idx").alias("o"))
    row = told.select("recording_id", "size", F.explode("chunks").alias("k")).select("recording_id", "size", "k.*")
    met = row.join(owner.hint("merge"), ["recording_id", "id"], "left").select("recording_id", "size", "row", "ticks", "count", F.col("at").alias("data_ptr"), "o.*")
    held = F.least("count", F.expr("(size - data_ptr) div width"))
    met = met.withColumn("sample_count", held)
    before = Window.partitionBy("recording_id", "channel_idx").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0).cast("long"))
    kept = met.where("sample_count > 0").withColumn("sample_period_ns", F.col("ticks") * TICK_NS).withColumns({
        "chunk_idx": zero(F.lit(1)).cast("int"), "sample_base": zero(F.col("sample_count")), "time_base_ns": zero(F.col("sample_count") * F.col("sample_period_ns")),
    })
    chunks = kept.select("recording_id", "channel_idx", "name", "sample_type", "chunk_idx", "sample_period_ns", "sample_count", "sample_base", "time_base_ns", "data_ptr")
    seen = chunks.groupBy("recording_id", "channel_idx").agg(F.sum("sample_count").alias("sample_count"), F.sum(F.col("sample_count") * F.col("sample_period_ns")).alias("duration_ns"))
    some = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    channels = typed.drop("width").join(seen.hint("merge"), ["recording_id", "channel_idx"], "left").select(*[c for c in typed.columns if c != "width"], some("sample_count"), some("duration_ns"))
    counted = met.groupBy("recording_id").agg(
        F.count_if(F.col("channel_idx").isNull()).alias("pds.chunk_channel_unknown"), F.count_if(F.col("sample_count") < F.col("count")).alias("pds.sample_count_clamped"), F.count_if(F.col("sample_count") == 0).alias("pds.chunk_empty_after_clamp"),
    )
    codes = [c for c in counted.columns if c != "recording_id"]
    late = counted.select("recording_id", F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(f"`{c}`").alias("n")) for c in codes])).alias("d")).where("d.n > 0")
    early = told.select("recording_id", F.explode("problems").alias("d")).select("recording_id", "d.severity", "d.code", F.lit(None).cast("string").alias("channel"), "d.message")
    diagnostics = early.unionByName(late.select("recording_id", F.lit("warning").alias("severity"), "d.code", F.lit(None).cast("string").alias("channel"), F.col("d.n").cast("string").alias("message")))
    return {"channels": channels, "chunks": chunks, "diagnostics": diagnostics}


SAMPLES = "recording_id string, channel_idx int, chunk_idx int, local_idx bigint, t_ns bigint, value double"
#: Neighbouring chunks that one task reads.
RANGE_BYTES = 64 << 20
_KINDS = {kind: form for kind, form in TYPES.values()}


def _decoded(chunks: Iterator[tuple], read: Callable[[str, int, int], bytes], rows: int) -> Iterator[pd.DataFrame]:
    """Frames of about ``rows`` samples; ``chunks`` are recording_id and the fields of ``tables``' chunks."""
    held, size = [], 0
    for c in chunks:
        form = np.dtype(_KINDS[c["sample_type"]])
        for at in range(0, c["sample_count"], rows):
            n = np.arange(at, min(c["sample_count"], at + rows))
            v = np.frombuffer(read(c["recording_id"], c["data_ptr"] + at * form.itemsize, len(n) * form.itemsize), form).astype(np.float64)
            n = n[: len(v)]
            held.append((c["recording_id"], c["channel_idx"], c["chunk_idx"], c["sample_base"] + n, c["time_base_ns"] + n * c["sample_period_ns"], v))
            size += len(v)
            if size >= rows:
                yield _framed(held)
                held, size = [], 0
    if held:
        yield _framed(held)


def _framed(held: list[tuple]) -> pd.DataFrame:
    rid, channel, chunk, local, at, value = zip(*held)
    n = [len(v) for v in value]
    spread = lambda x, kind: np.repeat(np.array(x, kind), n)
    return pd.DataFrame({"recording_id": spread(rid, object), "channel_idx": spread(channel, np.int32), "chunk_idx": spread(chunk, np.int32), "local_idx": np.concatenate(local), "t_ns": np.concatenate(at), "value": np.concatenate(value)})


def samples(chunks: DataFrame, raw: DataFrame | None = None, rows: int = 100_000) -> DataFrame:
    """Samples of ``chunks`` (of ``tables``, as far as they were kept), in batches of bounded size.

    Without ``raw`` recordings are paths: chunks are dealt over tasks by place, and only their bytes are
    read. With ``raw`` (recording_id, content) each content meets its chunks in one task.
    """
    ship(chunks.sparkSession)
    if raw is None:

        def ranged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for rid, own in b.groupby("recording_id", sort=False):
                    with Ranged(rid) as f:
                        yield from _decoded(own.sort_values("data_ptr").to_dict("records"), lambda _, at, n, f=f: f.read(at, n), rows)

        return chunks.repartition("recording_id", F.floor(F.col("data_ptr") / RANGE_BYTES)).mapInPandas(ranged, SAMPLES)
    own = chunks.groupBy("recording_id").agg(F.collect_list(F.struct(*[c for c in chunks.columns if c != "recording_id"])).alias("chunks"))

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            content = {rid: bytes(data) for rid, data in zip(b["recording_id"], b["content"])}
            each = ({"recording_id": rid} | r for rid, of in zip(b["recording_id"], b["chunks"]) for r in of)
            yield from _decoded(each, lambda rid, at, n, content=content: content[rid][at : at + n], rows)

    return spread(raw.select("recording_id", "content"), "recording_id").join(spread(own, "recording_id").hint("merge"), "recording_id").mapInPandas(held, SAMPLES)


def files(spark: SparkSession, path: str) -> DataFrame:
    """recording_id of each log under ``path``; no bytes are read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][sS]").load(path)
    return listed.select(F.col("path").alias("recording_id"))
