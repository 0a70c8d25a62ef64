import hashlib
import os
import re

import pytest

from concord.llm import warc
from concord.llm.storage import new_path

TRAP = "p" * 120 + "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nrest"
PAGES = [
    (5, "http://a", "x" * 200), (3, "http://b", "x" * 200), (9, "http://c", "x" * 200), (3, "http://b", "x" * 200),
    (1, "u", "short"), (2, "u", "short"), (4, "http://line\r\nbreak", TRAP), (6, None, None), (7, "u", ""),
    (None, "u", "y" * 150), (8, "u", "y" * 150), (10, "u", "é" * 60), (11, "u", "WARC/1.0\r\n"), (12, "u", "z" * 2_000_000),
    (13, "u", "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99999999\r\n\r\n"), (14, "u", "\r\n\r\nWARC/1.0\r\nContent-Length: x\r\n\r\n"),
]


def expected(pages):
    """Digest, size and kind per row; of equal ids one row is the response."""
    out, first = [], {}
    for page_id, _, html in pages:
        data = (html or "").encode()
        if len(data) >= 100:
            key = (page_id is None, page_id)
            first[data] = min(first.get(data, key), key)
    used = set()
    for page_id, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        data = (html or "").encode()
        again = len(data) >= 100 and data in used
        used.add(data)
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data][1] if again else None))
    return sorted(out, key=str)


def round_trip(spark, pages, compression="none"):
    path = new_path(spark, "warc-test")
    frame = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, digest string, size int")
    warc.write(frame.repartition(3), path, compression=compression)
    return path


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, compression):
    path = round_trip(spark, PAGES, compression)
    for size in ("128m", "40k"):  # also where blocks cut records and magic lines
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            read = warc.read(spark, path).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read), key=str)
        assert got == expected(PAGES)
        payloads = {r.page_id: bytes(r.payload).decode() for r in read if r.record_type == "response"}
        assert payloads[4] == TRAP and payloads[12] == "z" * 2_000_000
        assert {r.page_id: r.url for r in read}[4] == "http://line%0D%0Abreak"


def test_revisits_hold_no_payload(spark):
    path = round_trip(spark, PAGES)
    text = "".join(bytes(r.content).decode() for r in spark.read.format("binaryFile").load(path).collect())
    assert text.count("x" * 200) == 1 and text.startswith("WARC/1.0\r\n") and text.endswith("\r\n\r\n")


def test_rows_of_files_are_told_apart_by_place(spark, tmp_path):
    """Repeated rows in several files: nothing but headers is stored beside the archive, and a revisit names a record that is there."""
    spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages"))
    stored, path = set(os.listdir(spark.conf.get("spark.checkpoint.dir"))), new_path(spark, "warc-test")
    warc.write(spark.read.parquet(str(tmp_path / "pages")), path, compression="none")
    read = warc.read(spark, path, with_payload=False).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read), key=str) == expected(PAGES)
    assert not any(n.startswith("warc-rows") for n in set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) - stored)
    text = "".join(bytes(r.content).decode() for r in spark.read.format("binaryFile").load(path).collect())
    ids, named = (re.findall(rf"\r\n{field}: (\S+)\r\n", text) for field in ("WARC-Record-ID", "WARC-Refers-To"))
    assert len(ids) == len(set(ids)) == len(PAGES) and named and set(named) <= set(ids)


def test_payload_that_is_an_archive(spark, tmp_path):
    """Whole records inside a payload, some of them repeated, and bytes that are no UTF-8."""
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    payload = b"\xff\xfe" + record * 4 + b"\x80"
    outer = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Page-ID: <urn:page:1>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(payload), payload)
    (tmp_path / "a.warc").write_bytes(outer + record + outer)
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.payload) for r in rows) == sorted([payload, payload, b"abc"])
    assert sorted(r.payload_digest for r in rows) == sorted(hashlib.sha256(p).hexdigest() for p in (payload, payload, b"abc"))


def test_empty(spark):
    path = round_trip(spark, [(1, "u", "h")])
    assert warc.read(spark, path).count() == 1
    none = new_path(spark, "warc-none")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), none)
    assert warc.read(spark, none).count() == 0
