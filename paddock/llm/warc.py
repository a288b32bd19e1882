"""Web archives: writing pages as WARC records and reading archives back, segment by segment.

Writing: of pages with equal payloads the one with the smallest id is a response, the others are revisits
that refer to it. A response is an HTTP message with chunked transfer framing; what exceeds a segment goes
on in continuation records. Only one row of each payload carries its text through a shuffle.

Reading: files are parsed by record length inside tasks, so marks inside a payload mean nothing.
Continuation records are grouped by their origin's identifier, ordered by segment number, checked against
the total length, joined, and their transfer framing is taken off. What is wrong is told in ``problem``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm.common import hot_lookup, materialize
from paddock.session import prepare, ship

CRLF = "\r\n"
#: The alphabet of base32, and the profile of a revisit by payload.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an HTTP chunk and of a segment; records of a file, so that a file stays under half a GB.
CHUNK_BYTES, SEGMENT_BYTES, FILE_RECORDS = 16_384, 65_536, 8_192
_COPIES = 4_096
_RECORD = "file string, offset bigint, record_id string, record_type string, target_uri string, date string, refers_to string, origin string, segment int, total_length bigint, payload_digest string, mime string, block binary, payload binary, problem string"


def base32(hexed: Column) -> Column:
    """A SHA-1 in hex digits as upper-case base32. ``hexed`` is named often, so it should be a column."""
    five = lambda i: F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
    letter = lambda i, by: F.substring(F.lit(_BASE32), F.shiftright(five(i), by).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[letter(i, by) for i in range(8) for by in (15, 10, 5, 0)])


def _pieces(block: Column, size: int) -> Column:
    """``block`` (binary) cut every ``size`` bytes; an empty one is one empty piece."""
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(block) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda at: F.substring(block, at + 1, F.lit(size)))


def _raw(piece: Column) -> Column:
    """The same bytes as a string; strings keep bytes as they are, whole characters or not."""
    return piece.cast("string")


def _chunked(payload: Column, size: int) -> Column:
    told = F.transform(_pieces(payload, size), lambda c: F.when(F.octet_length(c) > 0, F.concat(F.lower(F.hex(F.octet_length(c).cast("long"))), F.lit(CRLF), _raw(c), F.lit(CRLF))).otherwise(F.lit("")))
    return F.concat(F.array_join(told, ""), F.lit(f"0{CRLF}{CRLF}"))


def _record(kind: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record but for the two line ends that close it; headers that are null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in headers]
    return F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(CRLF), *[F.coalesce(x, F.lit("")) for x in lines], F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def _name(page_id: Column, uri: Column, dig: Column, nth: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), F.lower(F.hex(F.xxhash64(uri, dig, nth))), F.lit(">"))


def page_of(record_id: Column) -> Column:
    """The page_id that a record's identifier names; null for foreign identifiers and null pages."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+):[0-9a-f]+>$", 1).try_cast("bigint")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", chunk_bytes: int = CHUNK_BYTES, segment_bytes: int = SEGMENT_BYTES) -> None:
    """One WARC record per row of ``pages`` (page_id, url, html), as gzipped files under ``path``.

    Of rows with equal payloads of at least ``least_bytes`` the one with the smallest page_id (null last,
    then by url) is a response and the others are revisits of it; shorter payloads are all responses. A
    null html is an empty payload, a null url writes no target. Repeated rows are records of their own. An
    empty table writes no record; further columns are ignored.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = prepare(pages.sparkSession) and pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("_sha1", F.sha1("payload")).withColumn("digest", base32(F.col("_sha1"))).drop("_sha1")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    told = rows.where(F.octet_length("payload") >= least_bytes)
    firsts = told.groupBy("digest").agg(F.min(order).alias("first"), F.any_value("payload").alias("payload")).select(F.col("first.page_id").alias("page_id"), F.col("first.url").alias("url"), "payload", "digest", F.lit(0).cast("long").alias("nth"))
    short = rows.where(F.octet_length("payload") < least_bytes).select("page_id", "url", "payload", "digest", F.monotonically_increasing_id().alias("nth"))
    responses = firsts.unionByName(short) if least_bytes > 0 else firsts

    kept = materialize(told.groupBy("page_id", "url", "digest").agg(F.count(F.lit(1)).alias("n")))
    origins = kept.groupBy("digest").agg(F.min(order).alias("first"), F.sum("n").alias("all_n")).where("all_n > 1").select("digest", "all_n", F.col("first.page_id").alias("to_page"), F.col("first.url").alias("to_url"))
    later = hot_lookup(kept, origins, "digest").where("all_n is not null")
    own = F.col("page_id").eqNullSafe(F.col("to_page")) & F.col("url").eqNullSafe(F.col("to_url"))
    later = later.withColumn("from", F.when(own, 1).otherwise(0).cast("long")).where("n > from")
    blocks = later.withColumn("at", F.explode(F.sequence(F.col("from"), F.col("n") - 1, F.lit(_COPIES).cast("long")))).repartition("digest", "page_id", "url", "at")
    copies = blocks.withColumn("nth", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + _COPIES, F.col("n")) - 1)))

    http = F.lit("application/http; msgtype=response")
    head = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Transfer-Encoding: chunked{CRLF}{CRLF}")
    name = _name(F.col("page_id"), F.col("url"), F.col("digest"), F.col("nth"))
    common = lambda rid, own: [("WARC-Record-ID", rid), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")), *own]
    segments = responses.withColumn("name", name).withColumn("segments", _pieces(F.concat(head, _chunked(F.col("payload"), chunk_bytes)).cast("binary"), segment_bytes))
    segments = segments.select("name", "url", "digest", F.size("segments").alias("of"), F.expr("aggregate(segments, 0L, (s, x) -> s + octet_length(x))").alias("total"), F.posexplode("segments").alias("at", "segment"))
    first, last, alone = F.col("at") == 0, F.col("at") == F.col("of") - 1, F.col("of") == 1
    number = F.when(~alone, (F.col("at") + 1).cast("string"))
    started = _record(
        F.when(first, "response").otherwise("continuation"),
        common(F.when(first, F.col("name")).otherwise(F.concat(F.expr("substring(name, 1, length(name) - 1)"), F.lit(":"), F.col("at") + 1, F.lit(">"))), [
            ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest")))), ("WARC-Segment-Number", number), ("WARC-Segment-Origin-ID", F.when(~first, F.col("name"))),
            ("WARC-Segment-Total-Length", F.when(last & ~alone, F.col("total").cast("string"))), ("Content-Type", F.when(first, http)),
        ]), _raw(F.col("segment")),
    )
    referred = _name(F.col("to_page"), F.col("to_url"), F.col("digest"), F.lit(0).cast("long"))
    revisit = _record(
        F.lit("revisit"), common(name, [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Profile", F.lit(_PROFILE)), ("WARC-Refers-To", referred), ("Content-Type", http)]), head
    )
    records = segments.select(started.alias("value")).unionByName(copies.select(revisit.alias("value")))
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _inflated(data: bytes) -> bytes:
    """All members of a gzip file; other bytes as they are. A cut member gives what can be read of it."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        try:
            out.append(one.decompress(data))
        except zlib.error:
            break
        data = one.unused_data
    return b"".join(out)


def unchunked(body: bytes) -> bytes | None:
    """``body`` without its chunked framing (extensions and trailers included), or None if the framing is broken."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";", 1)[0].strip()
        try:
            n = int(size, 16) if size and not size.startswith((b"-", b"+")) else -1
        except ValueError:
            n = -1
        if n < 0:
            return None
        if n == 0:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return None


def _payload(kind: str, mime: str | None, block: bytes) -> tuple[bytes | None, str | None]:
    """The payload of a record's whole block, and what is wrong with it."""
    if kind == "revisit":
        return None, None
    if not (mime or "").lower().replace(" ", "").startswith("application/http"):
        return block, None
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        return None, "warc.http_head"
    fields = dict(_fields(head.split(b"\r\n")[1:]))
    if fields.get("transfer-encoding", "").lower().split(",")[-1].strip() != "chunked":
        return body, None
    found = unchunked(body)
    return found, "warc.chunked_framing" if found is None else None


def _fields(lines: list[bytes]) -> Iterator[tuple[str, str]]:
    """Names in lower case with their values; a line that starts with a space goes on with the one before."""
    name, value = None, ""
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            value += " " + text.strip()
            continue
        if name:
            yield name, value
        name, _, value = text.partition(":")
        name, value = name.strip().lower(), value.strip()
    if name:
        yield name, value


def records_of(file: str, data: bytes) -> Iterator[tuple]:
    """The records of one archive as rows; after what can't be read the file ends with a row that says so."""
    at, end = 0, len(data)
    while at < end:
        if data[at : at + 1] in (b"\r", b"\n"):
            at += 1
            continue
        stop = data.find(b"\r\n\r\n", at)
        lines = data[at:stop].split(b"\r\n") if stop >= 0 else []
        f = dict(_fields(lines[1:]))
        length = f.get("content-length", "")
        if stop < 0 or not lines[0].startswith(b"WARC/") or not length.isdecimal():
            yield (file, at, *[None] * 12, "warc.unreadable")
            return
        start, n = stop + 4, int(length)
        block, kind = data[start : start + n], f.get("warc-type", "").lower()
        number = f.get("warc-segment-number")
        problem = "warc.truncated" if len(block) < n else "warc.segment_number" if number is not None and not number.isdecimal() else None
        segment = int(number) if number is not None and problem is None else None
        payload = None
        if segment is None and problem is None:
            payload, problem = _payload(kind, f.get("content-type"), block)
        total = f.get("warc-segment-total-length", "")
        yield (
            file, at, f.get("warc-record-id"), kind, f.get("warc-target-uri"), f.get("warc-date"), f.get("warc-refers-to"), f.get("warc-segment-origin-id"), segment, int(total) if total.isdecimal() else None,
            f.get("warc-payload-digest"), f.get("content-type"), block if segment is not None else None, payload, problem,
        )
        at = start + n


_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batches(rows: Iterator[tuple], ddl: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about ``most`` bytes."""
    schema = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in ddl.split(", ")])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def parse(files: DataFrame) -> DataFrame:
    """All records of ``files`` (path, content), continuation records as they are; payloads of the others decoded."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from _batches(records_of(b.column(0)[i].as_py(), _inflated(b.column(1)[i].as_buffer().to_pybytes())), _RECORD)

    return files.select("path", "content").mapInArrow(run, _RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """One row per record of ``parse`` whose segments are joined: record_id, record_type, target_uri, refers_to, payload, payload_bytes, payload_digest, declared_digest, problem.

    Segments of one origin that are equal count once. A missing or repeated number is ``warc.segments``, a
    sum of lengths unlike the declared total (or no total) ``warc.total_length``; such payloads are null.
    A payload unlike its declared SHA-1 is ``warc.digest``. Rows that already have a problem keep it.
    """
    ship(records.sparkSession)
    whole = records.where("segment is null").select("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload", "problem")
    key = F.coalesce("origin", "record_id").alias("origin")
    parts = records.where("segment is not null").select(key, "segment", "total_length", "block", "record_type", "target_uri", "refers_to", "payload_digest", "mime", "problem")
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    joined = parts.groupBy("origin").agg(
        F.array_sort(F.collect_set(F.struct("segment", F.coalesce("total_length", F.lit(-1).cast("long")).alias("total"), "block"))).alias("s"), F.max("problem").alias("problem"), *[first(c) for c in ("record_type", "target_uri", "refers_to", "payload_digest", "mime")]
    )
    numbers = F.col("s.segment") == F.sequence(F.lit(1), F.greatest(F.size("s"), F.lit(1)))
    length = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    problem = F.coalesce("problem", F.when(~numbers, "warc.segments"), F.when(F.element_at("s", -1)["total"] != length, "warc.total_length"))
    block = F.array_join(F.transform("s", lambda x: _raw(x["block"])), "").cast("binary")
    joined = joined.withColumn("problem", problem).withColumn("block", F.when(F.col("problem").isNull(), block)).drop("s")
    ddl = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload binary, problem string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                payload, bad = _payload(r["record_type"] or "", r["mime"], r["block"]) if r["problem"] is None else (None, r["problem"])
                yield from _batches(iter([(r["origin"], r["record_type"], r["target_uri"], r["refers_to"], r["payload_digest"], payload, bad)]), ddl)

    found = whole.unionByName(joined.mapInArrow(run, ddl)).withColumnRenamed("payload_digest", "declared")
    found = found.withColumn("_sha1", F.sha1("payload")).withColumn("payload_digest", base32(F.col("_sha1"))).withColumn("declared_digest", F.regexp_extract("declared", "(?i)^sha1:([A-Z2-7]{32})$", 1))
    wrong = (F.col("declared_digest") != "") & (F.col("declared_digest") != F.col("payload_digest"))
    return found.select("record_id", "record_type", "target_uri", "refers_to", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "declared_digest", F.coalesce("problem", F.when(wrong, "warc.digest")).alias("problem"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``reassemble`` of all archives under ``path``, gzipped or not."""
    return reassemble(parse(prepare(spark).read.format("binaryFile").load(path)))


def resolve(records: DataFrame) -> DataFrame:
    """Responses and revisits of ``reassemble`` without their payloads; a revisit gets bytes and digest of the response that it refers to.

    A revisit whose response is missing, or whose declared digest is another, has null bytes and the
    problem ``warc.refers_to``.
    """
    told = materialize(records.drop("payload").where("record_type in ('response', 'revisit')"))
    responses = told.where("record_type = 'response'")
    targets = responses.where("problem is null").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("payload_bytes").alias("_bytes"), F.max("payload_digest").alias("_digest"))
    back = hot_lookup(told.where("record_type = 'revisit'"), targets, "refers_to")
    fits = F.col("_digest").isNotNull() & ((F.col("declared_digest") == "") | (F.col("declared_digest") == F.col("_digest")))
    back = back.withColumn("payload_bytes", F.when(fits, F.col("_bytes"))).withColumn("payload_digest", F.when(fits, F.col("_digest"))).withColumn("problem", F.coalesce("problem", F.when(~fits, "warc.refers_to")))
    return responses.unionByName(back.select(responses.columns))
