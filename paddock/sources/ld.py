"""Binary logs with linked channel blocks: headers and samples by numpy inside tasks, one file a row."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.session import ship, spread

# Layout of the file and of a channel's block.
MAGIC, LEAST_BYTES, BLOCK_BYTES, MOST_CHANNELS = 0x40, 0x1A0, 124, 4096
_TEXTS = {"date": (0x5E, 16), "time": (0x7E, 16), "driver": (0x9E, 64), "vehicle": (0xDE, 64), "venue": (0x15E, 64)}
_KINDS = {(0x08, 8): ("f64", "<f8"), (0x07, 8): ("f64", "<f8"), (0x07, 4): ("f32", "<f4")}
_WIDTHS = {2: ("i16", "<i2"), 4: ("i32", "<i4")}
CHANNELS = "recording_id string, channel_idx int, id int, name string, unit string, unit_source string, sample_type string, sample_count bigint, duration_ns bigint, period_ns bigint, problem string"


def _text(data: bytes, at: int, n: int) -> str:
    return data[at : at + n].split(b"\0", 1)[0].decode("latin-1").strip()


def blocks(data: bytes) -> list[dict]:
    """The channels of a file, each with how to decode it and what is wrong with it."""
    if len(data) < LEAST_BYTES or struct.unpack_from("<I", data)[0] != MAGIC:
        raise ValueError("not a log of this kind")
    found, at = [], struct.unpack_from("<I", data, 8)[0]
    while 0 < at <= len(data) - BLOCK_BYTES and len(found) < MOST_CHANNELS:
        following, place, wanted = struct.unpack_from("<3I", data, at + 4)
        a, width, hz = struct.unpack_from("<3H", data, at + 0x12)
        shift, mul, scale, dec = struct.unpack_from("<4h", data, at + 0x18)
        name, kind = _KINDS.get((a, width)) or (_WIDTHS.get(width) if a != 0x07 else None) or ("f32", None)
        fits = (len(data) - place) // width if width and place < len(data) else 0
        n = min(wanted, fits) if kind else 0
        problem = (
            "ld.invalid_width" if width not in (2, 4, 8) else "ld.decode_unsupported_width" if not kind else "ld.zero_frequency" if not hz
            else "ld.sample_count_clamped" if wanted > fits else "ld.zero_scale_factor" if not (mul and scale) and a not in (7, 8) else None
        )
        found.append({
            "name": _text(data, at + 0x20, 32), "unit": _text(data, at + 0x48, 12), "type": name, "kind": kind, "at": place, "n": n if hz else 0, "period": 1_000_000_000 // hz if hz else 0,
            "factor": (mul or 1) / (scale or 1) * 10.0 ** -dec, "offset": float(shift * (mul or 1)), "problem": problem,
        })
        if following <= at:
            break
        at = following
    if not found:
        raise ValueError("no channels")
    return found


def values(data: bytes, block: dict) -> np.ndarray:
    raw = np.frombuffer(data, block["kind"], block["n"], block["at"]).astype(np.float64) if block["n"] else np.zeros(0)
    return raw if block["type"] in ("f32", "f64") else raw * block["factor"] + block["offset"]


def _read(data: bytes) -> list[dict]:
    """``blocks``, or one that says what is wrong with a file that isn't such a log."""
    try:
        return blocks(data)
    except (ValueError, struct.error) as broken:
        return [{"name": "", "unit": "", "type": "", "kind": None, "at": 0, "n": 0, "period": 0, "factor": 1.0, "offset": 0.0, "problem": f"ld.unreadable: {broken}"}]


def files(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[lL][dD]").load(path).select(F.col("path").alias("recording_id"), "content")


def in_folders(spark: SparkSession, path: str, held: int = 16_000_000) -> DataFrame:
    """recording_id, content of the logs in the folders right under ``path``: the driver lists folders, tasks list and read their files.

    A task holds about ``held`` bytes beside the file that it reads.
    """
    ship(spark)
    system, root = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if re.match(r"\w+:", path) else f"file://{path}")
    found = [(f.path,) for f in system.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.Directory and not f.base_name.startswith("_")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for folder in b["folder"]:
                rows, size = [], 0
                for f in system.get_file_info(pafs.FileSelector(folder)):
                    if f.path.lower().endswith(".ld"):
                        with system.open_input_stream(f.path) as opened:
                            rows.append((f.path, opened.read()))
                        size += f.size
                        if size > held:
                            yield pd.DataFrame(rows, columns=["recording_id", "content"])
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=["recording_id", "content"])

    return spread(spark.createDataFrame(found, "folder string"), "folder").mapInPandas(run, "recording_id string, content binary")


def channels(raw: DataFrame) -> DataFrame:
    """Channel rows of ``raw`` (recording_id, content); an unreadable file has one nameless row whose problem says why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rid, data in zip(b["recording_id"], b["content"]):
                rows += [(rid, i, i, c["name"], c["unit"], "declared" if c["unit"] else "unknown", c["type"], c["n"], c["n"] * c["period"], c["period"], c["problem"]) for i, c in enumerate(_read(bytes(data)))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CHANNELS.split(", ")])

    return raw.mapInPandas(run, CHANNELS)


def samples(raw: DataFrame, names: list[str] | None = None, rows: int = 100_000) -> DataFrame:
    """Sample rows, of the named channels alone if asked, in batches of bounded size that small channels share."""

    def told(held: list[tuple]) -> pd.DataFrame:
        n = [len(v) for *_, v in held]
        local = np.concatenate([np.arange(at, at + len(v)) for _, _, _, at, v in held])
        each = lambda k, kind=None: np.repeat(np.array([h[k] for h in held], kind), n)
        return pd.DataFrame({"recording_id": each(0, object), "channel_idx": each(1), "chunk_idx": 0, "local_idx": local, "t_ns": local * each(2, np.int64), "value": np.concatenate([v for *_, v in held])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            for rid, data in zip(b["recording_id"], b["content"]):
                data = bytes(data)
                for i, c in enumerate(_read(data)):
                    if names is None or c["name"] in names:
                        v = values(data, c)
                        for at in range(0, len(v), rows):
                            held.append((rid, i, c["period"], at, v[at : at + rows]))
                            size += len(held[-1][-1])
                            if size >= rows:
                                yield told(held)
                                held, size = [], 0
        if held:
            yield told(held)

    return raw.mapInPandas(run, "recording_id string, channel_idx int, chunk_idx int, local_idx bigint, t_ns bigint, value double")


def identity(raw: DataFrame) -> DataFrame:
    """recording_id, date, time, driver, vehicle, venue, absolute_start_ns: fixed fields, read without the samples."""
    text = lambda at, n: F.trim(F.regexp_extract(F.decode(F.substring("content", at + 1, n), "ISO-8859-1"), "^([^\\x00]*)", 1))
    held = raw.select("recording_id", *[text(a, n).alias(k) for k, (a, n) in _TEXTS.items()])
    return held.withColumn("absolute_start_ns", F.unix_seconds(F.try_to_timestamp(F.concat_ws(" ", "date", "time"), F.lit("dd/MM/yyyy HH:mm:ss"))) * 1_000_000_000)
