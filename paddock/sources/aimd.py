"""Camera recordings with a telemetry track beside the video.

Python reads boxes and records out of a file's bytes; clocks, edit lists, frame times, geodetic positions
and the choice of packets are DataFrame plans over those rows. Here a file is a binary row, so it is smaller
than 2 GB, which is Spark's bound of such a row; ``camera`` reads files of any size by ranges.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paddock.functions import names
from paddock.operators import report
from paddock.session import materialize, ship, spread

# The sample entry's code, a packet's signature, how records start.
ENTRY, SIGNATURE, SCALAR, BLOCK = b"aimd", b"amv0", b"(S", b"<h"
_CONTAINERS = (b"moov", b"mdia", b"minf", b"stbl", b"edts")
#: Little-endian layout of a satellite record of 56 bytes.
FIX = np.dtype({
    "names": ["stamp_ms", "itow_ms", "week", "fix", "flags", "x", "y", "z", "position_cm", "vx", "vy", "vz", "speed_cm", "dop", "satellites"],
    "formats": ["<u4", "<u4", "<u2", "u1", "u1", "<i4", "<i4", "<i4", "<u4", "<i4", "<i4", "<i4", "<u4", "<u2", "u1"],
    "offsets": [0, 4, 12, 14, 15, 16, 20, 24, 28, 32, 36, 40, 44, 48, 51], "itemsize": 56,
})
#: Channels of a satellite record: name, unit, type, column of ``geodetic``.
FIX_CHANNELS = (
    ("GPS Latitude", "deg", "f64", "latitude"), ("GPS Longitude", "deg", "f64", "longitude"), ("GPS Altitude", "m", "f64", "altitude"), ("GPS Speed", "m/s", "f64", "speed"), ("GPS Heading", "deg", "f64", "heading"),
    ("GPS Satellites", "count", "u8", "satellites"), ("GPS Position Accuracy", "m", "f64", "position_accuracy"), ("GPS Speed Accuracy", "m/s", "f64", "speed_accuracy"), ("GPS ECEF Velocity X", "m/s", "f64", "vx_mps"),
    ("GPS ECEF Velocity Y", "m/s", "f64", "vy_mps"), ("GPS ECEF Velocity Z", "m/s", "f64", "vz_mps"), ("GPS iTOW", "ms", "u32", "itow"), ("GPS Week", "count", "u16", "week"), ("GPS DOP", "ratio", "f64", "dop"),
    ("GPS Fix Type", "raw", "u8", "fix"), ("GPS Fix Flags", "raw", "u8", "flags"),
)
#: Channels that lap recovery reads, in normal form; the index mode reads them whole.
LAP_CHANNELS = (
    "lapnumber", "lapnum", "lapcount", "lapcounter", "currentlap", "lap", "beaconeventcount", "beaconcount", "lapbeaconcount", "currentlaptime", "lapcurrentlaptime", "laptime", "laptimerunning",
    "lapprogression", "lapprogress", "lapprogresspct", "reflaptime", "referencelaptime", "previouslt", "previouslaptime", "lastlaptime",
)
#: Frames that one row of a run-length table is laid out to at once.
FRAME_RUN = 65_536
#: Records handed to Spark at once.
BATCH = 50_000
#: Rows that a step over whole channels sorts in one task, about.
TASK_ROWS = 500_000
_TYPES = {"u8": "u1", "u32": "<u4", "i32": "<i4", "f32": "<f4"}
_EDITS = "array<struct<duration:bigint,media:bigint>>"
TRACKS = f"recording_id string, track int, kind string, timescale bigint, movie_timescale bigint, edits {_EDITS}, stts array<struct<n:bigint,delta:bigint>>, ctts array<struct<n:bigint,delta:bigint>>, problem string"
CHANNELS = "recording_id string, channel_idx int, id int, name string, sample_type string, problem string"
RECORDS = "recording_id string, packet int, seq bigint, id int, stamp_ms bigint, value double"
FIXES = "recording_id string, packet int, seq bigint, " + ", ".join(f"{n} bigint" for n in FIX.names)


def files(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][pP]4").load(path).select(F.col("path").alias("recording_id"), "content")


# ---- bytes ------------------------------------------------------------------------------------------


def boxes(data: memoryview) -> Iterator[tuple[bytes, memoryview]]:
    """Kind and payload of the boxes that lie one after another in ``data``; stops at one that doesn't fit."""
    while len(data) >= 8:
        size, kind = struct.unpack_from(">I4s", data)
        head = 8
        if size == 1 and len(data) >= 16:
            size, head = struct.unpack_from(">Q", data, 8)[0], 16
        elif size == 0:
            size = len(data)
        if not head <= size <= len(data):
            return
        yield kind, data[head:size]
        data = data[size:]


def leaves(data: memoryview) -> dict[bytes, memoryview]:
    """The first box of each kind, those within containers included, tracks left out."""
    found: dict[bytes, memoryview] = {}
    for kind, body in boxes(data):
        found.setdefault(kind, body)
        if kind in _CONTAINERS:
            found = leaves(body) | found
    return found


def _table(box: memoryview, dtype: str) -> np.ndarray:
    """The rows of a counted table after its version and flags."""
    return np.frombuffer(box, np.dtype(dtype), struct.unpack_from(">I", box, 4)[0], 8)


def _scale(box: memoryview | None) -> int | None:
    return struct.unpack_from(">I", box, 20 if box[0] == 1 else 12)[0] if box else None


def tracks_of(data: memoryview) -> Iterator[dict[bytes, memoryview]]:
    """The boxes of every track, the movie's header under ``mvhd``."""
    for kind, movie in boxes(data):
        if kind == b"moov":
            top = leaves(movie)
            for part, body in boxes(movie):
                if part == b"trak":
                    yield leaves(body) | ({b"mvhd": top[b"mvhd"]} if b"mvhd" in top else {})


def kind_of(track: dict[bytes, memoryview]) -> str:
    entry, handler = track.get(b"stsd", b""), track.get(b"hdlr", b"")
    return "telemetry" if entry[12:16] == ENTRY else "video" if handler[8:12] == b"vide" else "other"


def places(track: dict[bytes, memoryview]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and sizes of a track's samples: chunks' sizes are repeated and summed within a chunk."""
    fixed, n = struct.unpack_from(">2I", track[b"stsz"], 4)
    sizes = np.full(n, fixed, np.int64) if fixed else np.frombuffer(track[b"stsz"], ">u4", n, 12).astype(np.int64)
    chunks = (_table(track[b"stco"], ">u4") if b"stco" in track else _table(track[b"co64"], ">u8")).astype(np.int64)
    runs = _table(track[b"stsc"], ">u4, >u4, >u4")
    if not len(runs) or runs["f0"][0] != 1:
        raise ValueError("invalid stsc first chunk")
    held = runs["f1"][np.searchsorted(runs["f0"], np.arange(1, len(chunks) + 1), "right") - 1].astype(np.int64)
    if held.sum() < n:
        raise ValueError("stsc does not address every sample")
    of = np.repeat(np.arange(len(chunks)), np.minimum(held, n))[:n]
    before = np.concatenate([[0], np.cumsum(sizes)])[:n]
    first = np.concatenate([[True], of[1:] != of[:-1]])[:n]
    return chunks[of] + before - np.maximum.accumulate(np.where(first, before, 0)), sizes


def packet_problem(packet: bytes | memoryview, size: int) -> str | None:
    if len(packet) != size or size < 10 or struct.unpack_from(">H", packet)[0] != size - 2:
        return "packet length does not match the sample's size"
    return None if packet[6:10] == SIGNATURE else "packet has no signature"


def packets_of(data: memoryview) -> list[memoryview]:
    """The packets of the first telemetry track, its definitions first."""
    for track in tracks_of(data):
        if kind_of(track) == "telemetry":
            found = [data[at : at + n] for at, n in zip(*places(track))]
            for p, n in zip(found, places(track)[1]):
                if (problem := packet_problem(p, int(n))) is not None:
                    raise ValueError(problem)
            if not found:
                raise ValueError("empty telemetry track")
            return found
    raise ValueError("no telemetry track")


def _blocks(packet: bytes, tag: bytes) -> Iterator[tuple[int, int]]:
    """Start and end of the payloads of tagged blocks; a block that doesn't fit has an end beyond the packet."""
    at = packet.find(BLOCK + tag)
    while at >= 0 and at + 10 <= len(packet):
        end = at + 12 + struct.unpack_from("<I", packet, at + 6)[0]
        yield at + 12, end
        at = packet.find(BLOCK + tag, max(end, at + 5))


def definitions(packet: bytes) -> tuple[dict[int, tuple[str, str]], int | None, int]:
    """Name and type by record id, the satellite record's id, and the number of definitions skipped."""
    found: dict[int, tuple[str, str]] = {}
    fix, skipped = None, 0
    for at, end in _blocks(packet, b"CHS"):
        if end > len(packet):
            break
        d = packet[at:end]
        if len(d) < 100:
            skipped += 1
            continue
        rid, encoding, width, group = (struct.unpack_from("<I", d, x)[0] for x in (0, 20, 72, 80))
        code, name = (d[a:b].split(b"\0", 1)[0].decode("latin-1").strip() for a, b in ((24, 32), (32, 64)))
        if code == "GPS0" and width == 56:
            fix = rid
        elif rid > 0xFFFF or not name or width not in (1, 4):
            skipped += 1
        elif rid in found:
            raise ValueError(f"duplicate record id {rid}")
        else:
            found[rid] = (name, "u8" if width == 1 else "u32" if group == 0x1003 else "i32" if encoding == 12 else "f32")
    if not found and fix is None:
        raise ValueError("no supported definitions")
    return found, fix, skipped


def scalars_of(packet: bytes, known: dict[int, tuple[str, str]], lost: Counter | None = None) -> Iterator[tuple[int, int, bytes]]:
    """Record id, stamp and value bytes of the closed records of known ids; ``lost`` counts the others."""
    at = packet.find(SCALAR, 10)
    while at >= 0 and at + 8 <= len(packet):
        stamp, rid = struct.unpack_from("<IH", packet, at + 2)
        width = (1 if known[rid][1] == "u8" else 4) if rid in known else 0
        if width and packet[at + 8 + width : at + 9 + width] == b")":
            yield rid, stamp, packet[at + 8 : at + 8 + width]
            at = packet.find(SCALAR, at + 9 + width)
        else:
            if lost is not None:
                lost["aim.value_unterminated" if width else "aim.unknown_record_id"] += 1
            at = packet.find(SCALAR, at + 2)


def value_of(raw: bytes, kind: str) -> float:
    return float(np.frombuffer(raw, _TYPES[kind])[0])


def fixes_of(packet: bytes, lost: Counter | None = None) -> Iterator[bytes]:
    """The satellite records of full size; ``lost`` counts the others."""
    for a, b in _blocks(packet, b"GPS"):
        if b - a == FIX.itemsize and b <= len(packet):
            yield packet[a:b]
        elif lost is not None:
            lost["aim.gps_record_skipped"] += 1


def _times(box: memoryview, form: str) -> list[dict]:
    """A run-length table, all of whose entries must be there."""
    n = struct.unpack_from(">I", box, 4)[0]
    if len(box) < 8 + 8 * n:
        raise ValueError("run-length table is cut")
    return [{"n": int(a), "delta": int(b)} for a, b in _table(box, form)]


def track_rows(data: memoryview, size: int) -> Iterator[dict]:
    """The tracks of a movie with the tables that their clocks follow from, as far as they hold together.

    A clock of 0 ticks, more frames than the file of ``size`` bytes can hold, and composition offsets for
    another number of frames are problems; such a track keeps no tables.
    """
    for i, t in enumerate(tracks_of(data)):
        row = {"track": i, "track_kind": kind_of(t), "timescale": None, "movie_timescale": None, "edits": None, "stts": [], "ctts": None, "problem": None}
        try:
            row |= {"timescale": _scale(t.get(b"mdhd")) or None, "movie_timescale": _scale(t.get(b"mvhd")) or None}
            if b"edts" in t:
                wide = t[b"elst"][0] == 1
                edits = _table(t[b"elst"], ">u8, >i8, >u4" if wide else ">u4, >i4, >u4")
                if any(r != 0x10000 for *_, r in edits):
                    raise ValueError("unsupported media rate")
                row["edits"] = [{"duration": int(a), "media": int(m)} for a, m, _ in edits]
            row["stts"] = _times(t[b"stts"], ">u4, >u4") if b"stts" in t else []
            if b"ctts" in t:
                row["ctts"] = _times(t[b"ctts"], ">u4, >i4" if t[b"ctts"][0] == 1 else ">u4, >u4")
            frames = sum(r["n"] for r in row["stts"])
            if row["track_kind"] == "video" and row["timescale"] is None:
                raise ValueError("no clock")
            if frames > size:
                raise ValueError("more frames than the file can hold")
            if row["ctts"] is not None and sum(r["n"] for r in row["ctts"]) < frames:
                raise ValueError("composition offsets for another number of frames")
        except (KeyError, ValueError, struct.error, IndexError, OverflowError) as broken:
            row |= {"stts": [], "ctts": None, "edits": None, "problem": str(broken)}
        yield row


# ---- rows -------------------------------------------------------------------------------------------


def _rows(raw: DataFrame, schema: str, read: Callable[[memoryview], Iterator[list[tuple]]]) -> DataFrame:
    """Rows of ``schema`` from what ``read`` tells of each content; small files share a frame, as each costs more than its rows."""
    ship(raw.sparkSession)
    names = _names(schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for b in batches:
            for rid, data in zip(b["recording_id"], b["content"]):
                for part in read(memoryview(bytes(data or b""))):
                    held += [(rid, *row) for row in part]
                    if len(held) >= BATCH:
                        yield pd.DataFrame(held, columns=names, dtype=object)
                        held = []
        if held:
            yield pd.DataFrame(held, columns=names, dtype=object)

    return raw.select("recording_id", "content").mapInPandas(run, schema)


def _names(schema: str) -> list[str]:
    """The columns of a schema whose nested ones have no space within."""
    return [c.split()[0] for c in schema.split(", ")]


def tracks(raw: DataFrame) -> DataFrame:
    """The tracks of ``raw`` (recording_id, content) with the tables that their clocks follow from."""

    def read(data: memoryview) -> Iterator[list[tuple]]:
        yield [tuple(row.values()) for row in track_rows(data, len(data))]

    return _rows(raw, TRACKS, read)


def channels(raw: DataFrame) -> DataFrame:
    """recording_id, channel_idx, id, name, sample_type: scalars in order of definition, then the satellite channels.

    A file that can't be read has one nameless row whose problem says why; skipped definitions are a
    problem of the first channel.
    """

    def read(data: memoryview) -> Iterator[list[tuple]]:
        try:
            found, fix, skipped = definitions(bytes(packets_of(data)[0]))
        except (KeyError, ValueError, struct.error, IndexError) as broken:
            yield [(0, None, "", "", f"aim.unreadable: {broken}")]
            return
        told = [(rid, name, kind) for rid, (name, kind) in found.items()]
        if fix is not None:
            told += [(fix + 1 + i, name, kind) for i, (name, _, kind, _) in enumerate(FIX_CHANNELS)]
        yield [(i, *t, f"aim.chs_block_skipped: {skipped}" if skipped and i == 0 else None) for i, t in enumerate(told)]

    return _rows(raw, CHANNELS, read)


def records(raw: DataFrame) -> DataFrame:
    """recording_id, packet, seq, id, stamp_ms, value of every scalar record; unreadable files have none."""

    def read(data: memoryview) -> Iterator[list[tuple]]:
        try:
            packets = packets_of(data)
            known = definitions(bytes(packets[0]))[0]
        except (KeyError, ValueError, struct.error, IndexError):
            return
        seq, rows = 0, []
        for i, p in enumerate(packets[1:], 1):
            for rid, stamp, v in scalars_of(bytes(p), known):
                rows.append((i, seq, rid, stamp, value_of(v, known[rid][1])))
                seq += 1
            if len(rows) >= BATCH:
                yield rows
                rows = []
        yield rows

    return _rows(raw, RECORDS, read)


def fixes(raw: DataFrame) -> DataFrame:
    """recording_id, packet, seq and the whole numbers of every satellite record of full size."""

    def read(data: memoryview) -> Iterator[list[tuple]]:
        try:
            packets = packets_of(data)
            if definitions(bytes(packets[0]))[1] is None:
                return
        except (KeyError, ValueError, struct.error, IndexError):
            return
        seq, held = 0, []
        for i, p in enumerate(packets[1:], 1):
            for b in fixes_of(bytes(p)):
                held.append((i, seq, *np.frombuffer(b, FIX)[0].tolist()))
                seq += 1
            if len(held) >= BATCH:
                yield held
                held = []
        yield held

    return _rows(raw, FIXES, read)


# ---- plans ------------------------------------------------------------------------------------------


def _scaled(ticks: Column, timescale: Column) -> Column:
    """Nanoseconds of ticks, toward zero, in decimals so that no product overflows."""
    return F.call_function("div", ticks.cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)"), timescale.cast("decimal(10,0)"))


def presentation_offset_ns(tracks: DataFrame) -> Column:
    """Column of ``tracks``: where the first media edit puts the media, 0 without edits; null without a movie clock or media edit."""
    place = F.array_position(F.transform("edits", lambda e: e["media"] >= 0), True).cast("int")
    empty = F.aggregate(F.slice("edits", 1, F.greatest(place - 1, F.lit(0))), F.lit(0).cast("long"), lambda a, e: a + e["duration"])
    media = F.element_at("edits", F.when(place > 0, place))["media"]
    edited = F.when(place > 0, _scaled(empty, F.col("movie_timescale")) - _scaled(media, F.col("timescale")))
    return F.when(F.col("movie_timescale").isNotNull(), F.when(F.col("edits").isNull(), F.lit(0).cast("long")).otherwise(edited))


def _laid_out(tracks: DataFrame, table: str) -> DataFrame:
    """recording_id, i, delta, before: a run-length table, one row a sample, with the deltas before it."""
    w = Window.partitionBy("recording_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    runs = tracks.select("recording_id", F.posexplode(table).alias("k", "r")).select("recording_id", "k", "r.n", "r.delta")
    summed = runs.withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("ticks", F.coalesce(F.sum(F.col("n") * F.col("delta")).over(w), F.lit(0))).where("n > 0")
    part = F.lit(FRAME_RUN).cast("long")
    runs = summed.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, part)))
    each = runs.withColumn("j", F.explode(F.sequence("at", F.least(F.col("at") + part, F.col("n")) - 1)))
    return each.select("recording_id", (F.col("first") + F.col("j")).alias("i"), "delta", (F.col("ticks") + F.col("j") * F.col("delta")).alias("before"))


def frame_times(tracks: DataFrame) -> DataFrame:
    """recording_id, frame, pts_ns: the first video track's frames in order of presentation; those before zero are left out.

    A first track with a problem has no frames.
    """
    video = tracks.where("kind = 'video'").withColumn("offset_ns", F.coalesce(presentation_offset_ns(tracks), F.lit(0)))
    first = video.groupBy("recording_id").agg(F.min_by(F.struct("timescale", "offset_ns", "stts", "ctts", "problem"), "track").alias("v"))
    # used three times below, and each use would go through the bytes again
    own = materialize(first.select("recording_id", "v.*").where("problem is null"))
    shift = _laid_out(own, "ctts").select("recording_id", "i", F.col("delta").alias("shift"))
    at = _laid_out(own, "stts").join(shift.hint("merge"), ["recording_id", "i"], "left").join(own.select("recording_id", "timescale", "offset_ns").hint("merge"), "recording_id")
    pts = at.select("recording_id", "i", (_scaled(F.col("before") + F.coalesce("shift", F.lit(0)), F.col("timescale")) + F.col("offset_ns")).alias("pts_ns")).where("pts_ns >= 0")
    order = Window.partitionBy("recording_id").orderBy("pts_ns", "i")
    return pts.select("recording_id", (F.row_number().over(order) - 1).cast("long").alias("frame"), "pts_ns")


def geodetic(fixes: DataFrame) -> DataFrame:
    """``fixes`` with latitude, longitude, altitude, speed, heading and the other columns of ``FIX_CHANNELS``.

    Positions and velocities are NaN unless the fix is 2, 3 or 4. Latitude takes eight rounds from the
    spherical start; heading is 0 below 1 cm/s.
    """
    a, e2 = 6_378_137.0, 6.694_379_990_14e-3
    good = F.col("fix").isin(2, 3, 4)
    metres = lambda c: F.when(good, F.col(c) / 100.0).otherwise(F.lit(float("nan")))
    df = fixes.withColumns({c + "_m": metres(c) for c in ("x", "y", "z")} | {c + "_mps": metres(c) for c in ("vx", "vy", "vz")})
    df = df.withColumns({"_p": F.hypot("x_m", "y_m"), "_lon": F.atan2("y_m", "x_m")}).withColumn("_lat", F.atan2(F.col("z_m"), F.col("_p") * (1 - e2)))
    for _ in range(8):
        df = df.withColumn("_n", a / F.sqrt(1 - e2 * F.pow(F.sin("_lat"), 2)))
        df = df.withColumn("_alt", F.col("_p") / F.cos("_lat") - F.col("_n"))
        df = df.withColumn("_lat", F.atan2(F.col("z_m"), F.col("_p") * (1 - e2 * F.col("_n") / (F.col("_n") + F.col("_alt")))))
    east = -F.sin("_lon") * F.col("vx_mps") + F.cos("_lon") * F.col("vy_mps")
    north = -F.sin("_lat") * F.cos("_lon") * F.col("vx_mps") - F.sin("_lat") * F.sin("_lon") * F.col("vy_mps") + F.cos("_lat") * F.col("vz_mps")
    turn = F.degrees(F.atan2("_east", "_north"))
    df = df.withColumns({"_east": east, "_north": north})
    return df.withColumns({
        "latitude": F.degrees("_lat"), "longitude": F.degrees("_lon"), "altitude": F.col("_alt"), "speed": F.sqrt(F.pow("vx_mps", 2) + F.pow("vy_mps", 2) + F.pow("vz_mps", 2)),
        "heading": F.when(F.hypot("_east", "_north") < 0.01, 0.0).otherwise(F.when(turn < 0, turn + 360).otherwise(turn)),
        "position_accuracy": F.col("position_cm") / 100.0, "speed_accuracy": F.col("speed_cm") / 100.0, "itow": F.col("itow_ms"), "dop": F.col("dop") / 100.0,
    }).drop("_p", "_lon", "_lat", "_n", "_alt", "_east", "_north")


def samples(raw: DataFrame, index: bool = False) -> DataFrame:
    """recording_id, channel_idx, local_idx, t_ns, value on the logger's own stamps.

    Zero is the least of the channels' first stamps as they arrived; earlier ones become zero. In index
    mode channels of ``LAP_CHANNELS`` are whole and of the others evenly spaced packets are taken.
    """
    # the parts are used more than once, and each use would go through the bytes again
    return assembled(*[materialize(part(raw)) for part in (channels, records, fixes)], tracks(raw), index)


def assembled(named: DataFrame, scalars: DataFrame, satellite: DataFrame, held: DataFrame, index: bool) -> DataFrame:
    """``samples`` from its parts.

    Joins are merge joins: of many small files, parts of a table are told to be far smaller than they are, and
    would be broadcast through the driver.
    """
    told = named.where("name != ''").select("recording_id", "channel_idx", "id", "name")
    column = F.create_map(*[F.lit(x) for name, _, _, c in FIX_CHANNELS for x in (name, c)])
    scalar = told.where(F.element_at(column, F.col("name")).isNull())
    found = scalars.join(scalar.hint("merge"), ["recording_id", "id"]).select("recording_id", "channel_idx", "name", "packet", "seq", "stamp_ms", "value")
    wide = geodetic(satellite)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for n, _, _, c in FIX_CHANNELS]))
    long = wide.select("recording_id", "packet", "seq", "stamp_ms", pairs.alias("s")).select("recording_id", "packet", "seq", "stamp_ms", "s.name", "s.value")
    every = found.unionByName(long.join(told.select("recording_id", "channel_idx", "name").hint("merge"), ["recording_id", "name"]))
    if index:
        # every packet counts, records or not: the track's samples less the definitions
        held = held.where("kind = 'telemetry'").groupBy("recording_id").agg(F.min_by("stts", "track").alias("s"))
        counts = held.select("recording_id", F.aggregate("s", F.lit(0).cast("long"), lambda a, r: a + r["n"]).alias("n")).withColumn("n", F.col("n") - 1)
        taken = report.spaced(counts, F.col("n")).select("recording_id", F.col("index").cast("int").alias("packet")).distinct()
        lap = names.normalize(F.col("name")).isin(*LAP_CHANNELS)
        every = every.where(lap).unionByName(every.where(~lap).join(taken.hint("merge"), ["recording_id", "packet"], "left_semi"))
    firsts = every.groupBy("recording_id", "channel_idx").agg(F.min_by("stamp_ms", "seq").alias("s")).groupBy("recording_id").agg(F.min("s").alias("origin"))
    order = Window.partitionBy("recording_id", "channel_idx").orderBy("stamp_ms", "seq")
    return every.join(firsts.hint("merge"), "recording_id").select(
        "recording_id", "channel_idx", (F.row_number().over(order) - 1).cast("long").alias("local_idx"), (F.greatest(F.col("stamp_ms") - F.col("origin"), F.lit(0)) * 1_000_000).alias("t_ns"), "value"
    )


def _fitted(first: int, t: np.ndarray, modal: int) -> list[tuple[int, int, int, int]]:
    """Period, count, base and start of the straight pieces that keep every stamp within half a modal period."""
    todo, done = [(first, t)], []
    while todo:
        base, run = todo.pop()
        steps = len(run) - 1
        period = max(1, (int(run[-1] - run[0]) + steps // 2) // steps) if steps else modal
        off = np.abs(run - (run[0] + period * np.arange(len(run))))
        cut = int(off.argmax())
        if off[cut] > max(1, modal // 2) and cut:
            todo += [(base + cut, run[cut:]), (base, run[:cut])]
        else:
            done.append((period, len(run), base, int(run[0])))
    return done


def fit_chunks(samples: DataFrame) -> DataFrame:
    """recording_id, channel_idx, chunk_idx, sample_period_ns, sample_count, sample_base, time_base_ns of stamped samples.

    The modal distance (the lesser of ties, zeros apart) tells gaps, which are more than twice as long;
    a run between gaps has its own mean period and is cut where a stamp is furthest off, if that is more
    than half the modal one. A channel of one sample has a period of 1. Straight runs are told by windows;
    only bent ones go to Python, a channel at a time.
    """
    by = ["recording_id", "channel_idx"]
    w = Window.partitionBy(*by).orderBy("local_idx")
    # partitions follow the rows: each step below sorts all that its task holds
    spaced = spread(samples.select(*by, "local_idx", "t_ns"), *by, each=TASK_ROWS).withColumn("gap", F.col("t_ns") - F.lag("t_ns").over(w))
    counted = spaced.where("gap > 0").groupBy(*by, "gap").agg(F.count(F.lit(1)).alias("n"))
    modal = counted.groupBy(*by).agg(F.max_by("gap", F.struct("n", -F.col("gap"))).alias("modal"))
    runs = spaced.join(modal.hint("merge"), by, "left").withColumn("modal", F.coalesce("modal", F.lit(1).cast("long")))
    runs = runs.withColumn("run", F.sum(F.when(F.col("gap") > F.col("modal") * 2, 1).otherwise(0)).over(w))
    own = Window.partitionBy(*by, "run")
    runs = runs.withColumns({"first": F.min("t_ns").over(own), "base": F.min("local_idx").over(own), "n": F.count(F.lit(1)).over(own), "last": F.max("t_ns").over(own)})
    steps = F.col("n") - 1
    runs = runs.withColumn("period", F.when(steps > 0, F.greatest(F.call_function("div", F.col("last") - F.col("first") + F.call_function("div", steps, F.lit(2)), steps), F.lit(1))).otherwise(F.col("modal")))
    off = F.abs(F.col("t_ns") - F.col("first") - F.col("period") * (F.col("local_idx") - F.col("base")))
    runs = runs.withColumn("bent", F.max(off).over(own) > F.greatest(F.call_function("div", F.col("modal"), F.lit(2)), F.lit(1)))
    straight = runs.where("not bent").groupBy(*by, "run").agg(F.first("period").alias("sample_period_ns"), F.first("n").alias("sample_count"), F.first("base").alias("sample_base"), F.first("first").alias("time_base_ns"))
    schema = "recording_id string, channel_idx int, sample_period_ns bigint, sample_count bigint, sample_base bigint, time_base_ns bigint"

    def fit(held: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, run in held.sort_values("local_idx").groupby("run"):
            rows += [(run["recording_id"].iloc[0], run["channel_idx"].iloc[0], *r) for r in _fitted(int(run["local_idx"].iloc[0]), run["t_ns"].to_numpy(), int(run["modal"].iloc[0]))]
        return pd.DataFrame(rows, columns=["recording_id", "channel_idx", "sample_period_ns", "sample_count", "sample_base", "time_base_ns"])

    bent = runs.where("bent").select(*by, "run", "local_idx", "t_ns", "modal").groupBy(*by).applyInPandas(fit, schema)
    pieces = straight.drop("run").unionByName(bent)
    each = Window.partitionBy(*by).orderBy("sample_base")
    return pieces.select(*by, (F.row_number().over(each) - 1).alias("chunk_idx"), "sample_period_ns", "sample_count", "sample_base", "time_base_ns")
