"""Web archives: pages to WARC records in segments, and back.

Blocks over a limit are written as a first segment and continuation records.
Reading parses the archives file by file, brings the segments of a record
together by the id of its first one, puts them in order, checks their total
length, and undoes the chunked transfer framing.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import balanced_lookup, map_arrow, utf8

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(content: Column) -> Column:
    """SHA-1 as 32 base32 characters: each 5 hex digits are 4 of them."""
    digest = F.sha1(content)
    out = []
    for i in range(8):
        number = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1
            out.append(F.substring(F.lit(ALPHABET), place, F.lit(1)))
    return F.concat(*out)


def write(pages: DataFrame, path: str, least_bytes: int = 0, segment_bytes: int = 1 << 16, chunk_bytes: int = 1 << 13,
          records_per_file: int = 4096, date: str = "2026-01-01T00:00:00Z") -> None:
    """Write a record for every row of ``pages`` (page_id, url, html) to ``path``.

    Of rows with equal payloads of ``least_bytes`` or more, those with the
    largest page_id are responses and the others revisit it, without a payload;
    rows with smaller payloads are all responses. A null page_id is smaller than
    any other. Payloads that many rows share are looked up in a list of bounded
    length, without gathering their rows. Blocks are framed in chunks of
    ``chunk_bytes`` and cut into segments of ``segment_bytes``; a file has at
    most ``records_per_file`` records. Null and empty html is an empty payload;
    rows that repeat each get a record; an empty table gives archives without
    records; other columns are ignored.
    """
    payload = utf8("html")
    rows = pages.select(
        "page_id",
        F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20]", "%20").alias("url"),
        payload.alias("payload"),
        base32_sha1(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("size"),
    )
    largest = rows.filter(F.col("size") >= least_bytes).groupBy("digest").agg(
        F.max("page_id").alias("first"), F.count("*").alias("n")
    )
    rows = balanced_lookup(rows, largest.filter("n > 1").select("digest", "first", F.lit(True).alias("shared")), "digest")
    revisit = F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    told = rows.select(
        "page_id",
        "url",
        "digest",
        "size",
        revisit.alias("revisit"),
        F.col("first").alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),  # a revisit needs the digest only
        F.md5(F.concat_ws(" ", "page_id", "url", F.monotonically_increasing_id()).cast("binary")).alias("id"),
    )

    def each(batch):
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_pydict(
                {"record": pa.array(list(records(row, segment_bytes, chunk_bytes, date)), pa.binary())}
            )

    found = map_arrow(told, each, "record binary").select(F.col("record").cast("string"))
    # A record is its head and block, ended by two line ends: just what the writer puts between rows.
    writer = found.write.option("lineSep", END).option("maxRecordsPerFile", records_per_file)
    writer.option("compression", "gzip").text(path)


def records(row: dict, segment_bytes: int, chunk_bytes: int, date: str):
    """The records of one page, without the line ends after each."""
    head = {
        "WARC-Type": "revisit" if row["revisit"] else "response",
        "WARC-Record-ID": urn(row["id"]),
        "WARC-Date": date,
        "WARC-Target-URI": row["url"],
        "WARC-Payload-Digest": "sha1:" + row["digest"],
        "X-Payload-Length": row["size"],
        "X-Page-Id": row["page_id"],
        "Content-Type": "application/http; msgtype=response",
    }
    if row["revisit"]:
        head |= {"WARC-Profile": PROFILE, "X-Refers-To-Page-Id": row["refers_to"]}
        block = HTTP
    else:
        block = HTTP + chunked(row["payload"], chunk_bytes)
    cut = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(cut) == 1:
        yield record(head, block)
        return
    yield record(head | {"WARC-Segment-Number": 1}, cut[0])
    for number, part in enumerate(cut[1:], start=2):
        own = hashlib.md5(f"{row['id']} {number}".encode()).hexdigest()
        more = {
            "WARC-Type": "continuation",
            "WARC-Record-ID": urn(own),
            "WARC-Date": date,
            "WARC-Segment-Origin-ID": head["WARC-Record-ID"],
            "WARC-Segment-Number": number,
        }
        if number == len(cut):
            more["WARC-Segment-Total-Length"] = len(block)
        yield record(more, part)


def urn(digits: str) -> str:
    return f"<urn:uuid:{digits[:8]}-{digits[8:12]}-{digits[12:16]}-{digits[16:20]}-{digits[20:]}>"


def record(head: dict, block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in head.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def chunked(payload: bytes, size: int) -> bytes:
    cut = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in cut) + b"0\r\n\r\n"


# --- reading ------------------------------------------------------------------------------


def unchunked(body: bytes) -> bytes:
    """The content of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no end of a chunk's size")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is longer or shorter than its size")
        out.append(body[at : at + size])
        at += size + 2


def inflated(content: bytes, step: int = 1 << 20):
    """The content of an archive in blocks; gzip, of one or many members, or plain."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view = memoryview(content)
    while len(view):
        member, at = zlib.decompressobj(31), 0
        while not member.eof and at < len(view):
            yield member.decompress(view[at : at + step])
            at += step
        rest = len(member.unused_data)
        view = view[min(at, len(view)) - rest :] if member.eof else view[:0]


def parse(content: bytes):
    """(head, block) of each record of an archive."""
    held, blocks = bytearray(), inflated(content)

    def filled(until) -> bool:
        while not until():
            more = next(blocks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        if not filled(lambda: held.find(b"\r\n\r\n") >= 0):
            if held.strip():
                raise ValueError("an archive ends inside a record's head")
            return
        end = held.find(b"\r\n\r\n")
        lines = bytes(held[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        if not filled(lambda: len(held) >= end + 4 + size):
            raise ValueError("an archive ends inside a record's block")
        yield head, bytes(held[end + 4 : end + 4 + size])
        filled(lambda: len(held) >= end + 8 + size)
        del held[: end + 8 + size]


RECORD = (
    "origin string, number long, total long, type string, page_id long, refers_to long, digest string,"
    " size long, block binary"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The pages of the archives in ``path``.

    page_id, payload_bytes, payload_digest, record_type (response or revisit),
    refers_to (the response's page_id, for revisits), payload (null for
    revisits, which carry none), complete: false, with a null payload, if
    segments are missing, their total length is wrong, the framing is broken or
    the payload doesn't have its digest. Empty payloads come back as empty, also
    where the html was null; archives without records give no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def parsed(segments: bool):
        def each(batch):
            for content in batch.column("content").to_pylist():
                rows, size = [], 0
                for head, block in parse(content):
                    number = int(head.get("WARC-Segment-Number", 0))
                    if bool(number) != segments:
                        continue
                    rows.append(fields(head, number, block))
                    size += len(block)
                    if size > 1 << 22:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

        return map_arrow(files, each, RECORD)

    def decoded(batch):
        yield pa.RecordBatch.from_pylist([page(row) for row in batch.to_pylist()], schema=PAGE)

    rest = ["type", "page_id", "refers_to", "digest", "size"]
    # the segments of one record only; a record is read and written as one value
    together = parsed(True).groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"),
        F.max("total").alias("total"),
        *[F.max(c).alias(c) for c in rest],
    )
    whole = parsed(False).select(F.array(F.struct("number", "block")).alias("parts"), F.octet_length("block").cast("long").alias("total"), *rest)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, complete boolean"
    return map_arrow(whole.unionByName(together.drop("origin")), decoded, schema)


PAGE = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
     ("refers_to", pa.int64()), ("payload", pa.binary()), ("complete", pa.bool_())]
)


def number_of(text: str | None) -> int | None:
    return None if text is None else int(text)


def fields(head: dict, number: int, block: bytes) -> dict:
    first = head["WARC-Type"] != "continuation"
    return {
        "origin": head["WARC-Record-ID"] if first else head["WARC-Segment-Origin-ID"],
        "number": number,
        "total": number_of(head.get("WARC-Segment-Total-Length")),
        "type": head["WARC-Type"] if first else None,
        "page_id": number_of(head.get("X-Page-Id")),
        "refers_to": number_of(head.get("X-Refers-To-Page-Id")),
        "digest": head.get("WARC-Payload-Digest", "sha1:")[5:] if first else None,
        "size": number_of(head.get("X-Payload-Length")),
        "block": block,
    }


def table(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORD.split(", ")])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def page(row: dict) -> dict:
    parts = row["parts"]
    block = b"".join(p["block"] for p in parts)
    complete = [p["number"] for p in parts] in ([0], list(range(1, len(parts) + 1))) and len(block) == row["total"]
    payload = None
    if complete and row["type"] == "response":
        head, _, body = block.partition(b"\r\n\r\n")
        try:
            payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
            complete = base64.b32encode(hashlib.sha1(payload).digest()).decode() == row["digest"]
        except ValueError:
            complete = False
    return {
        "page_id": row["page_id"],
        "payload_bytes": len(payload) if complete and payload is not None else row["size"],
        "payload_digest": row["digest"],
        "record_type": row["type"],
        "refers_to": row["refers_to"] if row["type"] == "revisit" else None,
        "payload": payload if complete else None,
        "complete": complete,
    }
