"""Round trips through archives, and broken ones."""

import base64
import gzip
import hashlib
import uuid

import pytest

from lodestone.llm import warc
from lodestone.llm.tables import shared_folder


def expected(rows, least=0):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "")]
        largest = max((p for p in same if p is not None), default=None)
        revisit = len(payload) >= least and page != largest
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, "revisit" if revisit else "response", largest if revisit else None, None if revisit else payload, True))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect()), key=repr)


ROWS = [
    (1, "http://a", "<p>x\r\n\r\nWARC/1.1\r\n</p>"), (2, "http://b", None), (3, None, ""), (4, "u v\r\nw", "é" * 9000),
    (5, "u", "é" * 9000), (None, "n", "only"), (None, "n", "é" * 9000), (7, "t", "same"), (7, "t", "same"), (6, "t", "same"),
    (8, "big", "0\r\n\r\n" * 300_000),
]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, size int").repartition(3)
    path = shared_folder(spark)
    warc.write(pages, path, least_bytes=least, segment_bytes=1000, chunk_bytes=700, records_per_file=50)
    assert got(warc.read(spark, path)) == expected(ROWS, least)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    path = shared_folder(spark)
    warc.write(pages, path)
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    assert got(warc.read(spark, path)) == expected(rows)


def test_no_pages(spark):
    path = shared_folder(spark)
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


def test_segments_in_any_order_and_file_and_missing_ones(spark, tmp_path):
    def one(page, payload):
        row = {"page_id": page, "url": "u", "size": len(payload), "digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(),
               "revisit": False, "refers_to": None, "payload": payload, "id": uuid.uuid4().hex}
        return list(warc.records(row, 100, 30, "2026-01-01T00:00:00Z"))

    whole, short, torn = one(1, b"x" * 500), one(2, b"y" * 500), one(3, b"z" * 500)
    end = warc.END.encode()
    torn[-1] = torn[-1].replace(b"zz", b"Zz", 1)
    files = [reversed(whole[2:]), [*whole[:2], *short[:-2], short[-1]], torn]
    for i, records in enumerate(files):
        members = [gzip.compress(r + end) for r in records]  # a member for each record
        (tmp_path / f"{i}.warc.gz").write_bytes(b"".join(members))
    rows = {r["page_id"]: r for r in warc.read(spark, f"file://{tmp_path}").collect()}
    assert rows[1]["complete"] and bytes(rows[1]["payload"]) == b"x" * 500
    assert not rows[2]["complete"] and rows[2]["payload"] is None
    assert not rows[3]["complete"]


def test_framing():
    for n in (0, 1, 30, 31, 100):
        assert warc.unchunked(warc.chunked(b"q" * n, 30)) == b"q" * n
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nab\r\n0\r\n\r\n")
