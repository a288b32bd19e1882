"""Camera recordings in one pass over ranges of bytes: a data source with splits and pushed filters.

``register`` and then ``spark.read.format("paddock_camera").load(folder)``. A split is a file and a range of
its bytes. Its task reads the index boxes and the definitions, then only the telemetry packets that start
in its range; video between them stays unread, and no file is held whole. Rows of all kinds (tracks,
channels, scalar records, fixes, problems) come from that pass; filters on ``kind`` and ``recording_id`` are
pushed, so that a scan of channels reads no packets and a scan of one recording opens one file.
"""

from __future__ import annotations

import re
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from paddock.session import ship
from paddock.sources import aimd
from paddock.sources.fileio import Held, Ranged

SPLIT_BYTES, READ_BYTES, GAP_BYTES, BATCH = 256 << 20, 4 << 20, 16 << 10, 50_000
KINDS = ("track", "channel", "scalar", "fix", "problem")
_PAIRS = pa.list_(pa.struct([("n", pa.int64()), ("delta", pa.int64())]))
_SCHEMA = pa.schema([
    ("recording_id", pa.string()), ("kind", pa.string()), ("packet", pa.int32()), ("seq", pa.int64()), ("id", pa.int32()), ("value", pa.float64()), ("channel_idx", pa.int32()), ("name", pa.string()), ("sample_type", pa.string()), ("problem", pa.string()), ("n", pa.int64()),
    ("track", pa.int32()), ("track_kind", pa.string()), ("timescale", pa.int64()), ("movie_timescale", pa.int64()), ("edits", pa.list_(pa.struct([("duration", pa.int64()), ("media", pa.int64())]))), ("stts", _PAIRS), ("ctts", _PAIRS),
    *[(n, pa.int64()) for n in aimd.FIX.names],
])
ROWS = (
    "recording_id string, kind string, packet int, seq bigint, id int, value double, channel_idx int, name string, sample_type string, problem string, n bigint, track int, track_kind string, timescale bigint, movie_timescale bigint, "
    "edits array<struct<duration:bigint,media:bigint>>, stts array<struct<n:bigint,delta:bigint>>, ctts array<struct<n:bigint,delta:bigint>>, " + ", ".join(f"{n} bigint" for n in aimd.FIX.names)
)
_BROKEN = (KeyError, ValueError, struct.error, IndexError, OverflowError)


def movie(source: Held | Ranged) -> memoryview:
    """The movie box with its head, found by going from box to box; the media between aren't read."""
    at = 0
    while at + 8 <= source.size:
        head = source.read(at, 16)
        size, kind = struct.unpack_from(">I4s", head)
        if size == 1 and len(head) == 16:
            size = struct.unpack_from(">Q", head, 8)[0]
        elif size == 0:
            size = source.size - at
        if size < 8 or at + size > source.size:
            break
        if kind == b"moov":
            return memoryview(source.read(at, size))
        at += size
    raise ValueError("no movie box")


def _spans(offsets: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last + 1 of the packets, in order of place, that one read takes together."""
    first = 0
    for i in range(1, len(offsets) + 1):
        if i == len(offsets) or offsets[i] - offsets[i - 1] - sizes[i - 1] > GAP_BYTES or offsets[i] + sizes[i] - offsets[first] > READ_BYTES:
            yield first, i
            first = i


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _list(rows: list[dict]) -> pa.RecordBatch:
    return _batch({k: [r.get(k) for r in rows] for k in {k for r in rows for k in r}}, len(rows))


def rows_of(rid: str, source: Held | Ranged, start: int = 0, end: int | None = None, kinds: tuple[str, ...] = KINDS) -> Iterator[pa.RecordBatch]:
    """The rows of the packets that start in a range of a file; the first range has its tracks and channels too.

    A file without a readable index is one problem. A packet that doesn't hold together is a problem of its
    own and is left out; so are, counted, records of unknown ids, values without an end and fixes of another size.
    """
    whole = start == 0
    told: list[dict] = []
    try:
        index = movie(source)
        if whole and "track" in kinds:
            told += [{"kind": "track"} | t for t in aimd.track_rows(index, source.size)]
        own = next((t for t in aimd.tracks_of(index) if aimd.kind_of(t) == "telemetry"), None)
        if own is None:
            raise ValueError("no telemetry track")
        offsets, sizes = aimd.places(own)
        if not len(offsets):
            raise ValueError("empty telemetry track")
        head = source.read(int(offsets[0]), int(sizes[0]))
        if (problem := aimd.packet_problem(head, int(sizes[0]))) is not None:
            raise ValueError(problem)
        known, fix, skipped = aimd.definitions(head)
    except _BROKEN as broken:
        if whole:
            told.append({"kind": "problem", "problem": f"aim.unreadable: {broken}", "n": 1})
            yield _list([{"recording_id": rid} | r for r in told])
        return
    if whole:
        names = [(i, name, kind) for i, (name, kind) in known.items()]
        if fix is not None:
            names += [(fix + 1 + i, name, kind) for i, (name, _, kind, _) in enumerate(aimd.FIX_CHANNELS)]
        told += [{"kind": "channel", "channel_idx": i, "id": r, "name": name, "sample_type": kind} for i, (r, name, kind) in enumerate(names)]
        if skipped:
            told.append({"kind": "problem", "problem": "aim.chs_block_skipped", "n": skipped})
        if told := [r for r in told if r["kind"] in kinds]:
            yield _list([{"recording_id": rid} | r for r in told])
    if not {"scalar", "fix", "problem"} & set(kinds):
        return
    mine = np.flatnonzero((offsets >= start) & (offsets < (source.size if end is None else end)))
    mine = mine[(mine > 0)]
    mine = mine[np.argsort(offsets[mine], kind="stable")]
    lost: Counter[str] = Counter()
    scalars, fixes = [], []

    def flush() -> Iterator[pa.RecordBatch]:
        if scalars and "scalar" in kinds:
            packet, seq, ids, stamps, values = zip(*scalars)
            yield _batch({"recording_id": [rid] * len(ids), "kind": ["scalar"] * len(ids), "packet": packet, "seq": seq, "id": ids, "stamp_ms": stamps, "value": values}, len(ids))
        if fixes and "fix" in kinds:
            found = np.frombuffer(b"".join(f[2] for f in fixes), aimd.FIX)
            yield _batch({"recording_id": [rid] * len(found), "kind": ["fix"] * len(found), "packet": [f[0] for f in fixes], "seq": [f[1] for f in fixes]} | {n: found[n].astype(np.int64) for n in aimd.FIX.names}, len(found))
        scalars.clear()
        fixes.clear()

    for a, z in _spans(offsets[mine], sizes[mine]):
        base = int(offsets[mine[a]])
        data = source.read(base, int(offsets[mine[z - 1]] + sizes[mine[z - 1]]) - base)
        for i in map(int, mine[a:z]):
            p = data[int(offsets[i]) - base : int(offsets[i] + sizes[i]) - base]
            if aimd.packet_problem(p, int(sizes[i])) is not None:
                lost["aim.packet_skipped"] += 1
                continue
            for k, (r, stamp, v) in enumerate(aimd.scalars_of(p, known, lost)):
                scalars.append((i, i << 32 | k, r, stamp, aimd.value_of(v, known[r][1])))
            if fix is not None or "problem" in kinds:
                fixes += [(i, i << 32 | k, b) for k, b in enumerate(aimd.fixes_of(p, lost)) if fix is not None]
        if len(scalars) + len(fixes) >= BATCH:
            yield from flush()
    yield from flush()
    if lost and "problem" in kinds:
        yield _list([{"recording_id": rid, "kind": "problem", "problem": code, "n": n} for code, n in sorted(lost.items())])


# ---- the data source --------------------------------------------------------------------------------


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int
    kinds: tuple[str, ...]

    def __post_init__(self) -> None:
        self.value = (self.path, self.start, self.end)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options.get("path", ""), int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.kinds, self.wanted = set(KINDS), None

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("kind",):
                self.kinds &= values
            elif values is not None and f.attribute == ("recording_id",):
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[Split]:
        system, place = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", self.path) if re.match(r"\w+:", self.path) else f"file://{self.path}")
        head = re.match(r"(\w+:)", self.path)
        found = system.get_file_info([place])[0]
        listed = [found] if found.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(place, recursive=True))
        kinds = tuple(k for k in KINDS if k in self.kinds)
        files = [(f"{head[1] if head else 'file:'}{f.path}" if not head or head[1] == "file:" else f"{head[1]}//{f.path}", f.size) for f in listed if f.type == pafs.FileType.File and f.path.lower().endswith(".mp4")]
        step = self.size if self.kinds & {"scalar", "fix", "problem"} else max([1, *[n for _, n in files]])
        return [Split(path, at, at + step, kinds) for path, n in sorted(files) if kinds and (self.wanted is None or path in self.wanted) for at in range(0, max(n, 1), step)] or [Split("", 0, 0, ())]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if split.path:
            with Ranged(split.path) as source:
                yield from rows_of(split.path, source, split.start, split.end, split.kinds)


class CameraSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paddock_camera"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: object) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed to it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CameraSource)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the recordings under ``path``."""
    register(spark)
    return spark.read.format("paddock_camera").load(path)


def scan(raw: DataFrame) -> DataFrame:
    """The same rows of ``raw`` (recording_id, content)."""
    ship(raw.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, data in zip(b.column(0).to_pylist(), b.column(1)):
                yield from rows_of(rid, Held(data.as_py() or b""))

    return raw.select("recording_id", "content").mapInArrow(lambda batches: _gathered(run(batches)), ROWS)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches as one, up to ``BATCH`` rows: a small file's costs more to hand over than its rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= BATCH:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def channels(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'channel'").select("recording_id", "channel_idx", "id", "name", "sample_type", F.lit(None).cast("string").alias("problem"))


def tracks(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'track'").select("recording_id", "track", F.col("track_kind").alias("kind"), "timescale", "movie_timescale", "edits", "stts", "ctts", "problem")


def samples(rows: DataFrame, index: bool = False) -> DataFrame:
    """``aimd.samples`` of the rows, which should be materialised: they are used four times."""
    scalars = rows.where("kind = 'scalar'").select("recording_id", "packet", "seq", "id", "stamp_ms", "value")
    fixes = rows.where("kind = 'fix'").select("recording_id", "packet", "seq", *aimd.FIX.names)
    return aimd.assembled(channels(rows), scalars, fixes, tracks(rows), index)


def diagnostics(rows: DataFrame) -> DataFrame:
    """recording_id, severity, code, channel, message: counts summed over the splits of a file."""
    lost = rows.where("kind = 'problem'").groupBy("recording_id", "problem").agg(F.sum("n").alias("n"))
    bad = rows.where("kind = 'track' and problem is not null").select("recording_id", F.concat(F.lit("aim.track: "), "problem").alias("problem"), F.lit(1).cast("long").alias("n"))
    every = lost.unionByName(bad)
    broken = F.col("problem").contains(": ")
    return every.select("recording_id", F.when(broken, "error").otherwise("warning").alias("severity"), F.split_part("problem", F.lit(": "), F.lit(1)).alias("code"), F.lit(None).cast("string").alias("channel"), F.when(broken, F.col("problem")).otherwise(F.col("n").cast("string")).alias("message"))
