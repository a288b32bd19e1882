"""Bytes of small logger files, for queries and tests that scan files of known contents."""

from __future__ import annotations

import struct


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _counted(kind: bytes, rows: list[tuple], form: str, version: int = 0) -> bytes:
    return box(kind, struct.pack(">BxxxI", version, len(rows)), *[struct.pack(form, *r) for r in rows])


def definition(rid: int, name: str, width: int, encoding: int = 0, group: int = 0, code: str = "") -> bytes:
    """A channel's definition in a camera recording's first packet."""
    body = bytearray(112)
    for at, v in ((0, rid), (20, encoding), (72, width), (80, group)):
        struct.pack_into("<I", body, at, v)
    body[24 : 24 + len(code)], body[32 : 32 + len(name)] = code.encode(), name.encode()
    return b"<hCHS\0" + struct.pack("<IH", len(body), 0) + bytes(body)


def packet(*parts: bytes) -> bytes:
    body = b"\0" * 4 + b"amv0" + b"".join(parts)
    return struct.pack(">H", len(body)) + body


def scalar(stamp: int, rid: int, value: bytes) -> bytes:
    return b"(S" + struct.pack("<IH", stamp, rid) + value + b")"


def camera(packets: list[bytes], video: tuple[int, list, list | None, list | None] | None = None, movie: int = 1000) -> bytes:
    """A camera file: the packets as chunks of two, and a video track of timescale, stts, ctts and edits without frames."""
    head = box(b"ftyp", b"isom\0\0\0\0")
    chunks = [packets[i : i + 2] for i in range(0, len(packets), 2)]
    ends = [len(head) + 8]
    for c in chunks:
        ends.append(ends[-1] + sum(map(len, c)))
    clock = lambda kind, scale: box(kind, bytes(12), struct.pack(">II", scale, 0))
    table = box(
        b"stbl", box(b"stsd", bytes(8), box(b"aimd", bytes(8))), _counted(b"stts", [(len(packets), 100)], ">2I"), _counted(b"stsc", [(1, 2, 1)], ">3I"),
        box(b"stsz", struct.pack(">III", 0, 0, len(packets)), *[struct.pack(">I", len(p)) for p in packets]), _counted(b"stco", [(e,) for e in ends[:-1]], ">I"),
    )
    tracks = [box(b"trak", box(b"mdia", clock(b"mdhd", 1000), box(b"hdlr", bytes(8), b"meta", bytes(12)), box(b"minf", table)))]
    if video:
        scale, stts, ctts, edits = video
        own = [_counted(b"stts", stts, ">2I")] + ([_counted(b"ctts", ctts, ">Ii", 1)] if ctts else [])
        edts = [box(b"edts", _counted(b"elst", [(d, m, 0x10000) for d, m in edits], ">IiI"))] if edits else []
        tracks.insert(0, box(b"trak", *edts, box(b"mdia", clock(b"mdhd", scale), box(b"hdlr", bytes(8), b"vide", bytes(12)), box(b"minf", box(b"stbl", *own)))))
    return head + box(b"mdat", *packets) + box(b"moov", clock(b"mvhd", movie), *tracks)


def searched_log(channels: list[tuple], chunks: list[tuple], directory: int = 0x80, marked: bool = True, twice: bool = True, type_at: int = 0xD0, stride: int = 0x130, quantity_at: int = 0x88, unit_at: int = 0x90, count: int | None = None) -> bytes:
    """A log of the kind whose layout is searched for.

    ``channels``: id, name, type code, quantity, unit. ``chunks``: channel id, ticks, number of samples, bytes;
    their bytes lie one after another.
    """
    defs = 0x200
    table = defs + stride * len(channels)
    end = table + 0x40 * len(chunks)
    head = bytearray(end)
    for k, (at, n, kind, following) in enumerate([(defs, len(channels), 1, count or len(chunks)), (table, len(chunks), 3, 0), (end, 0, 1, 0)]):
        struct.pack_into("<QIIIII", head, directory + 32 * k, at, n, 0, 8, kind, following)
    shift = 8 if marked else 0
    for k, (cid, name, code, quantity, unit) in enumerate(channels):
        at = defs + stride * k
        if marked:
            struct.pack_into("<Q", head, at, 0x7C72)
        for place, form, value in ((shift, "<I", cid), (type_at, "<I", code), (quantity_at, "<I", quantity)):
            struct.pack_into(form, head, at + place, value)
        for place, text in ((shift + 8, name), (unit_at, unit)):
            raw = text.encode("utf-16-le")
            head[at + place : at + place + len(raw)] = raw
    place = end
    for k, (cid, ticks, n, data) in enumerate(chunks):
        at = table + 0x40 * k
        if twice:
            struct.pack_into("<2I", head, at + 4, cid, cid)
        struct.pack_into("<2I", head, at + 0x18, ticks, n)
        struct.pack_into("<I", head, at + 0x38, place)
        place += len(data)
    return bytes(head) + b"".join(c[3] for c in chunks)
