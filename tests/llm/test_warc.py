"""Archives: round trips against a plain form, and hand-made archives with damage."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random

from paddock.llm import warc

PAGES = "page_id bigint, url string, html string"


def told(html):
    data = (html or "").encode()
    return len(data), base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(rows):
    first = {}
    for i, (pid, url, html) in enumerate(rows):
        key = told(html)
        order = (pid is None, pid or 0, url is not None, url or "", i)
        if key not in first or order < first[key]:
            first[key] = order
    return sorted(((pid, *told(html), "response", None) if first[told(html)][-1] == i else (pid, *told(html), "revisit", None if first[told(html)][0] else first[told(html)][1]) for i, (pid, url, html) in enumerate(rows)), key=str)


def through(spark, rows, path, **options):
    warc.write_archives(spark.createDataFrame(rows, PAGES), str(path), **options)
    found = warc.resolve(warc.read_archives(spark, str(path)))
    return sorted(((warc_id(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], warc_id(r["refers_to"])) for r in found.where("problem is null").collect()), key=str)


def warc_id(name):
    part = name.split(":")[2] if name else None
    return None if part in (None, "null") else int(part)


def test_round_trip(spark, tmp_path):
    rnd = random.Random(3)
    texts = [None, "", "a", "héé" * 50, "WARC/1.1\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n", "0\r\n\r\n", "line\n" * 300, "ü" * 5001]
    rows = [(i, f"http://h/{i}" if i % 5 else None, rnd.choice(texts)) for i in range(200)]
    rows += [(i, "u", "hot copy") for i in range(500, 900)] + [(7, "again", "hot copy")] * 3 + [(None, "n", "only null"), (None, None, "only null"), (3, "http://h/3", "dup"), (3, "http://h/3", "dup"), (3, None, "dup")]
    assert through(spark, rows, tmp_path / "a", chunk_bytes=7, segment_bytes=100) == brute(rows)


def test_payloads_come_back(spark, tmp_path):
    rows = [(1, "u", "x" * 10_000), (2, "u", "é" * 333), (3, "u", "")]
    warc.write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "a"), chunk_bytes=64, segment_bytes=50)
    found = {warc_id(r["record_id"]): bytes(r["payload"]).decode() for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert found == {i: t for i, _, t in rows}


def test_short_payloads_are_all_responses(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (2, "u", "ab"), (3, "u", "long enough"), (4, "u", "long enough"), (5, "u", None)]
    got = through(spark, rows, tmp_path / "a", least_bytes=5)
    assert [r[3] for r in got] == ["response"] * 4 + ["revisit", "response"] and got[4][4] == 3


def test_empty_table_and_clashing_columns(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "a"))
    assert warc.read_archives(spark, str(tmp_path / "a")).count() == 0
    df = spark.createDataFrame([(1, "u", "t", "x", 5, "y")], PAGES + ", digest string, n bigint, payload string")
    warc.write_archives(df, str(tmp_path / "b"))
    assert [r["payload_bytes"] for r in warc.read_archives(spark, str(tmp_path / "b")).collect()] == [1]


def record(kind, rid, block, *more):
    return b"\r\n".join([b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: " + rid, *more, b"content-length: %d" % len(block), b"", block]) + b"\r\n\r\n"


def test_foreign_archives_and_damage(spark, tmp_path):
    http = b"Content-Type: application/http;msgtype=response"
    body = b"HTTP/1.1 200 OK\r\ntransfer-encoding: gzip, Chunked\r\n\r\n3;ext=1\r\nabc\r\n2\r\nde\r\n0\r\nTrailer: x\r\n\r\n"
    part = lambda n, block, *more, o=b"<s>": record(b"continuation", o + b"%d" % n, block, b"WARC-Segment-Origin-ID: " + o, b"WARC-Segment-Number: %d" % n, *more)
    one = lambda rid, block: record(b"response", rid, block, http, b"WARC-Segment-Number: 1")
    total = lambda n: b"WARC-Segment-Total-Length: %d" % n
    good = b"".join([record(b"warcinfo", b"<i>", b"software: x"), record(b"resource", b"<r>", b"plain", b"Content-Type: text/plain"), record(b"response", b"<folded>", body, b"Content-Type:", b" application/http")])
    (tmp_path / "1.warc").write_bytes(good + part(3, body[20:], total(len(body))) + part(2, body[10:20]))
    (tmp_path / "2.warc.gz").write_bytes(gzip.compress(one(b"<s>", body[:10])) + gzip.compress(part(2, body[10:20])))
    lost = one(b"<l>", b"x") + part(3, b"z", total(3), o=b"<l>")
    short = one(b"<t>", body[:9]) + part(2, body[9:], total(7), o=b"<t>")
    broken = record(b"response", b"<c>", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n9\r\nabc", http)
    wrong = record(b"response", b"<d>", b"HTTP/1.1 200 OK\r\n\r\nabc", http, b"WARC-Payload-Digest: sha1:" + b"A" * 32)
    away = record(b"revisit", b"<v>", b"HTTP/1.1 200 OK\r\n\r\n", http, b"WARC-Refers-To: <nowhere>")
    (tmp_path / "3.warc").write_bytes(lost + short + broken + wrong + away + part(2, b"no first", total(8), o=b"<o>") + one(b"<cut>", b"whole")[:-6])
    (tmp_path / "4.warc").write_bytes(b"not an archive")
    records = warc.read_archives(spark, str(tmp_path))
    got = {r["record_id"]: (None if r["payload"] is None else bytes(r["payload"]), r["problem"]) for r in records.where("record_id is not null").collect()}
    assert got == {
        "<i>": (b"software: x", None), "<r>": (b"plain", None), "<folded>": (b"abcde", None), "<s>": (b"abcde", None), "<l>": (None, "warc.segments"), "<t>": (None, "warc.total_length"), "<c>": (None, "warc.chunked_framing"),
        "<d>": (b"abc", "warc.digest"), "<v>": (None, None), "<o>": (None, "warc.segments"), "<cut>": (None, "warc.truncated"),
    }
    assert records.where("record_id is null and problem = 'warc.unreadable'").count() == 1
    assert [r["problem"] for r in warc.resolve(records).where("record_type = 'revisit'").collect()] == ["warc.refers_to"]
