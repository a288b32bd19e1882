"""Writing binary logs with linked channel blocks: what doesn't fit is refused first, then bytes go to places that a plan laid out.

``refusals`` tells every channel, value and text that the format can't hold without loss; a recording with
one isn't written. ``pieces`` gives each file's bytes as rows (recording_id, place, content): one row of
heads and one for every block of samples. ``write`` hands them to a data source writer that stages a file
per recording and moves it (or a folder of new ones) into place on commit, so that a lost task or a failed job leaves no half file.

Tables of a row a recording or channel are met by merge joins: in Parquet millions of them are small enough that Spark would
broadcast them, and the driver would hold them all. Those that are used more than once are written, as a plan that repeats them
has some fifty exchanges, after each of which the driver plans anew.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from paddock.session import materialize, ship, spread
from paddock.sources.ld import BLOCK_BYTES, MAGIC

# Sizes and places of the blocks before the channels, and capacities of texts, their end included.
HEADER, EVENT, VENUE, VEHICLE = 0x6E2, 1154, 1100, 260
CHANNELS_AT = HEADER + EVENT + VENUE + VEHICLE
NAME, SHORT_NAME, UNIT, IDENTITY, COMMENT, STAMP = 32, 8, 12, 64, 1024, 16
TEXTS = {"driver": IDENTITY, "vehicle": IDENTITY, "venue": IDENTITY, "event": IDENTITY, "session": IDENTITY, "short_comment": IDENTITY, "event_comment": COMMENT, "date": STAMP, "time": STAMP}
# Code, width and numpy form that hold each sample type without loss.
ENCODED = {
    "i8": (0x03, 2, "<i2"), "u8": (0x03, 2, "<i2"), "i16": (0x03, 2, "<i2"), "u16": (0x05, 4, "<i4"), "i32": (0x05, 4, "<i4"), "u32": (0x08, 8, "<f8"), "f64": (0x08, 8, "<f8"), "f32": (0x07, 4, "<f4"),
}
BLOCK = 262_144
PIECES = "recording_id string, place bigint, content binary"
_FOLDER = re.compile(r"logs-[0-9a-f]{6,}$")


def _fits(text: Column, capacity: int) -> Column:
    """Whether a text is Latin-1 and shorter than its field."""
    return F.coalesce(text, F.lit("")).rlike(rf"^[\x{{0}}-\x{{FF}}]{{0,{capacity - 1}}}$")


def _held(samples: DataFrame, channels: DataFrame) -> DataFrame:
    """Counts of each channel's samples, and of the values that its encoding would change."""
    v, kind = F.col("value"), F.col("sample_type")
    whole = lambda low, high: ~F.isnan(v) & (v == F.round(v)) & v.between(low, high)
    kept = (
        F.when(kind.isin("i8", "u8", "i16"), whole(-32_768, 32_767)).when(kind.isin("u16", "i32"), whole(-2_147_483_648, 2_147_483_647))
        .when(kind == "f32", (v.cast("float").cast("double") == v) & (F.abs(v) < float("inf")) & ~F.isnan(v)).otherwise(True)
    )
    met = samples.join(channels.select("recording_id", "channel_idx", "sample_type").hint("merge"), ["recording_id", "channel_idx"])
    return met.groupBy("recording_id", "channel_idx").agg(F.count(F.lit(1)).alias("n"), F.max("local_idx").alias("last"), F.min("local_idx").alias("least"), F.count_if(~F.coalesce(kept, F.lit(False))).alias("lossy"))


def refusals(channels: DataFrame, chunks: DataFrame, samples: DataFrame, identity: DataFrame) -> DataFrame:
    """recording_id, channel, code, message: why recordings can't be written without loss.

    ``channels`` has recording_id, channel_idx, name, unit, sample_type; ``chunks`` recording_id, channel_idx,
    chunk_idx, sample_period_ns, sample_count, time_base_ns; ``samples`` recording_id, channel_idx, local_idx
    (through all chunks, from 0), value; ``identity`` recording_id and any of ``TEXTS``. Channels without
    samples take no part; a recording without any is ``ldwrite.empty``.
    """
    by = ["recording_id", "channel_idx"]
    w = Window.partitionBy(*by).orderBy("chunk_idx")
    expected = F.lag(F.col("time_base_ns") + F.col("sample_count") * F.col("sample_period_ns")).over(w)
    timed = chunks.withColumn("_gap", (F.col("time_base_ns") != expected).cast("int")).groupBy(*by).agg(
        F.min("sample_period_ns").alias("period"), F.max("sample_period_ns").alias("longest"), F.coalesce(F.max("_gap"), F.lit(0)).alias("gap"), F.sum("sample_count").alias("told"),
    )
    seen = materialize(channels.select(*by, "name", "unit", "sample_type").join(_held(samples, channels).hint("merge"), by).join(timed.hint("merge"), by, "left"))
    second = 1_000_000_000
    rules = [
        ("ldwrite.no_clock", F.coalesce(F.col("period") <= 0, F.lit(True))), ("ldwrite.mixed_periods", F.col("period") != F.col("longest")), ("ldwrite.frequency", (F.col("period") > 0) & ((second % F.greatest("period", F.lit(1)) != 0) | (F.col("period") > second) | (second / F.greatest("period", F.lit(1)) > 65_535))),
        ("ldwrite.gap", F.col("gap") > 0), ("ldwrite.sample_count", (F.col("told") != F.col("n")) | (F.col("least") != 0) | (F.col("last") != F.col("n") - 1) | (F.col("n") > 4_294_967_295)),
        ("ldwrite.value", F.col("lossy") > 0), ("ldwrite.name", ~_fits(F.col("name"), NAME)), ("ldwrite.unit", ~_fits(F.col("unit"), UNIT)), ("ldwrite.type", ~F.col("sample_type").isin(*ENCODED)),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules]), lambda c: c.isNotNull())
    told = seen.select("recording_id", F.col("name").alias("channel"), F.explode(found).alias("code"), F.col("lossy").cast("string").alias("message"))
    told = told.withColumn("message", F.when(F.col("code") == "ldwrite.value", F.concat("message", F.lit(" values would change"))).otherwise(F.lit("")))
    none = F.lit(None).cast("string")
    empty = channels.select("recording_id").union(identity.select("recording_id")).distinct().join(seen.select("recording_id").distinct().hint("merge"), "recording_id", "left_anti").select("recording_id", none.alias("channel"), F.lit("ldwrite.empty").alias("code"), F.lit("").alias("message"))
    widths = F.create_map(*[F.lit(x) for k, (_, n, _) in ENCODED.items() for x in (k, n)])
    size = seen.groupBy("recording_id").agg(F.sum(F.col("n") * F.try_element_at(widths, F.col("sample_type")) + BLOCK_BYTES).alias("bytes")).where(F.col("bytes") + CHANNELS_AT > 4_294_967_295)
    large = size.select("recording_id", none.alias("channel"), F.lit("ldwrite.too_large").alias("code"), F.col("bytes").cast("string").alias("message"))
    texts = [c for c in TEXTS if c in identity.columns]
    wide = identity.select("recording_id", F.explode(F.filter(F.array(*[F.when(~_fits(F.col(c), TEXTS[c]), F.lit(c)) for c in texts]) if texts else F.array().cast("array<string>"), lambda c: c.isNotNull())).alias("message"))
    return told.unionByName(empty).unionByName(large).unionByName(wide.select("recording_id", none.alias("channel"), F.lit("ldwrite.text").alias("code"), "message"))


def _head(texts: dict, channels: list[dict]) -> bytes:
    """All bytes before the samples: header, the chain of event, venue and vehicle, and the linked channels."""
    told = {k: (texts.get(k) or "").encode("latin-1") for k in TEXTS}
    told["date"], told["time"] = told["date"] or b"01/01/1970", told["time"] or b"00:00:00"
    data = CHANNELS_AT + BLOCK_BYTES * len(channels)
    out = bytearray(data)
    event, venue = HEADER, HEADER + EVENT
    vehicle = venue + VENUE
    # Words that other readers of these logs ask for.
    for at, form, value in (
        (0x00, "<I", MAGIC), (0x08, "<I", CHANNELS_AT), (0x0C, "<I", data), (0x24, "<I", event), (0x40, "<H", 1), (0x42, "<H", 0x4240), (0x44, "<H", 0x000F), (0x46, "<I", 0x1F44), (0x4A, "<3s", b"ADL"), (0x52, "<H", 420),
        (0x54, "<H", 0xADB0), (0x56, "<I", len(channels)), (0x5DE, "<I", 0xC81A4), (event + 1152, "<H", venue), (venue + 1098, "<H", vehicle),
    ):
        struct.pack_into(form, out, at, value)
    places = ((0x5E, "date"), (0x7E, "time"), (0x9E, "driver"), (0xDE, "vehicle"), (0x15E, "venue"), (0x624, "short_comment"), (event, "event"), (event + 64, "session"), (event + 128, "event_comment"), (venue, "venue"), (vehicle, "vehicle"))
    for at, key in places:
        out[at : at + len(told[key])] = told[key]
    for i, c in enumerate(channels):
        at = CHANNELS_AT + BLOCK_BYTES * i
        code, width, _ = ENCODED[c["sample_type"]]
        name = (c["name"] or "").encode("latin-1")
        before, after = at - BLOCK_BYTES if i else 0, at + BLOCK_BYTES if i + 1 < len(channels) else 0
        # shift 0, factor 1, scale 1, no decimals: values are stored as they are
        struct.pack_into("<4I4H4h32s8s12s", out, at, before, after, c["place"], c["n"], (0x2EE1 + i) & 0xFFFF, code, width, 1_000_000_000 // c["period"], 0, 1, 1, 0, name, name[: SHORT_NAME - 1], (c["unit"] or "").encode("latin-1"))
    return bytes(out)


def pieces(channels: DataFrame, chunks: DataFrame, samples: DataFrame, identity: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """The bytes of every recording without a refusal, as rows of ``PIECES``.

    Channels follow one another in order of channel_idx; a channel's place is a sum over those before it.
    """
    ship(samples.sparkSession)
    refused = refusals(channels, chunks, samples, identity) if refused is None else refused
    by = ["recording_id", "channel_idx"]
    bad = refused.select("recording_id").distinct()
    counted = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    period = chunks.groupBy(*by).agg(F.min("sample_period_ns").alias("period"))
    widths = F.create_map(*[F.lit(x) for k, (_, n, _) in ENCODED.items() for x in (k, n)])
    own = channels.select(*by, "name", "unit", "sample_type").join(counted.hint("merge"), by).join(period.hint("merge"), by).join(bad.hint("merge"), "recording_id", "left_anti").withColumn("width", F.element_at(widths, F.col("sample_type")))
    whole, upto = Window.partitionBy("recording_id"), Window.partitionBy("recording_id").orderBy("channel_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.lit(CHANNELS_AT) + BLOCK_BYTES * F.count(F.lit(1)).over(whole)
    placed = materialize(own.withColumn("place", start + F.coalesce(F.sum(F.col("n") * F.col("width")).over(upto), F.lit(0))))
    texts = [c for c in TEXTS if c in identity.columns]
    heads = placed.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("channel_idx", "name", "unit", "sample_type", "n", "period", "place"))).alias("channels")).join(identity.select("recording_id", F.struct(F.lit(0).alias("_"), *texts).alias("texts")).hint("merge"), "recording_id", "left")

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"recording_id": b["recording_id"], "place": 0, "content": [_head(t or {}, list(c)) for t, c in zip(b["texts"], b["channels"])]})

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            content = [np.asarray(v, np.float64).astype(ENCODED[t][2]).tobytes() for v, t in zip(b["values"], b["sample_type"])]
            yield pd.DataFrame({"recording_id": b["recording_id"], "place": b["place"] + b["least"] * b["width"], "content": content})

    blocks = samples.select(*by, "local_idx", "value").groupBy(*by, F.floor(F.col("local_idx") / BLOCK).alias("_block")).agg(F.array_sort(F.collect_list(F.struct("local_idx", "value"))).alias("v"), F.min("local_idx").alias("least"))
    dealt = blocks.join(placed.select(*by, "sample_type", "width", "place").hint("merge"), by).select("recording_id", "sample_type", "width", "place", "least", F.col("v.value").alias("values"))
    return heads.mapInPandas(head, PIECES).unionByName(dealt.mapInPandas(block, PIECES))


# ---- the sink ---------------------------------------------------------------------------------------


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if re.match(r"\w+:", path) else f"file://{path}")


@dataclass
class Staged(WriterCommitMessage):
    """Where a task's files are staged: as long for many files as for one."""

    folder: str | None = None


def _folder(rid: str, folders: int) -> str:
    return f"logs-{zlib.crc32(rid.encode()) % folders:06x}/" if folders else ""


class LogWriter(DataSourceWriter):
    """Stages the files of a task under a folder of its attempt; the commit moves them, an abort removes them."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job, self.folders = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex, int(options.get("folders", 0))

    def write(self, rows: Iterator) -> Staged:
        system, root = _place(self.path)
        own, made = f"{root}/_staged-{self.job}/{uuid.uuid4().hex}", set()
        out, now, at = None, None, 0
        for r in rows:
            rid, place, content = r[0], r[1], bytes(r[2])
            if rid != now:
                if out:
                    out.close()
                name = f"{own}/{_folder(rid, self.folders)}{rid}.ld"
                above = name.rsplit("/", 1)[0]
                if above not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                out, now, at = system.open_output_stream(name), rid, 0
            if place != at:
                raise ValueError(f"{rid}: bytes at {place} follow {at}")
            out.write(content)
            at += len(content)
        if out:
            out.close()
        return Staged(own if made else None)

    def commit(self, messages: list) -> None:
        """Folders that are new are moved whole, so the driver's work and memory follow them, not the files."""
        system, root = _place(self.path)
        listed = lambda path: system.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        is_dir = lambda f: f.type == pafs.FileType.Directory
        if self.overwrite:
            for f in listed(root):
                if is_dir(f) and _FOLDER.match(f.base_name):
                    system.delete_dir(f.path)
                elif f.path.endswith(".ld"):
                    system.delete_file(f.path)

        def move(staged: str, final: str) -> None:
            for f in listed(staged):
                to = f"{final}/{f.base_name}"
                if is_dir(f) and is_dir(system.get_file_info([to])[0]):
                    move(f.path, to)
                else:
                    system.move(f.path, to)

        for m in messages:
            if m and m.folder:
                move(m.folder, root)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = _place(self.path)
        if system.get_file_info([f"{root}/_staged-{self.job}"])[0].type == pafs.FileType.Directory:
            system.delete_dir(f"{root}/_staged-{self.job}")


class LogSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paddock_ld"

    def schema(self) -> str:
        return PIECES

    def writer(self, schema: object, overwrite: bool) -> LogWriter:
        return LogWriter(self.options, overwrite)


def write(laid_out: DataFrame, path: str, mode: str = "append", folders: int = 0) -> None:
    """One ``.ld`` file per recording of ``pieces`` under ``path``; a file is one task's, as its bytes are written in order.

    With ``folders`` the files are dealt over so many folders by their recording, each of them one task's; ``ld.in_folders``
    reads them. The driver then holds a name a folder. Without, all lie in ``path`` and are listed and moved there.
    """
    ship(laid_out.sparkSession)
    laid_out.sparkSession.dataSource.register(LogSink)
    place = F.pmod(F.crc32(F.col("recording_id").cast("binary")), F.lit(folders)) if folders else F.col("recording_id")
    dealt = spread(laid_out.withColumn("_folder", place), "_folder").sortWithinPartitions("_folder", "recording_id", "place")
    dealt.select("recording_id", "place", "content").write.format("paddock_ld").option("folders", folders).mode(mode).save(path)
