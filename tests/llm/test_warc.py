"""The archive: against plain Python, exact round trips, damage, and odd tables."""

import base64
import gzip
import hashlib
from urllib.parse import unquote

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from tabloom.llm.warc_store import archive_pages, export_files, read_records, reconstruct

SCHEMA = "page_id long, url string, html string"
ROWS = [
    (5, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (9, None, "<p>one</p>"), (2, "http://b/", "<p>one</p>"),
    (None, "http://c/", "<p>one</p>"), (None, "http://c/", "<p>alone</p>"), (None, "http://d/", "<p>alone</p>"),
    (7, "http://e/\r\nWARC-Type: fake", None), (8, "http://f/", ""), (1, "http://g/", "grüße 日本 " * 5000), (3, "", "x"),
]


def expected(rows, least=0):
    first = {}
    for i, _, html in rows:
        key = (i is None, i or 0)
        first[html or ""] = min(first.get(html or "", key), key)
    out, seen = [], set()
    for i, _, html in rows:
        data = (html or "").encode()
        key = (i is None, i or 0)
        lead = key == first[html or ""] and html not in seen and (html or "") not in seen
        if lead:
            seen.add(html or "")
        response = lead or len(data) < least
        to = None if response or first[html or ""][0] else first[html or ""][1]
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", to))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_records_against_plain_python(spark, least):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    got = read_records(archive_pages(pages, least_bytes=least)).collect()
    assert sorted(map(tuple, got), key=str) == expected(ROWS, least)


def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages = pages.unionAll(pages.withColumn("page_id", F.col("page_id") + 1000))
    got = read_records(archive_pages(pages)).collect()
    assert sorted(map(tuple, got), key=str) == expected([tuple(r) for r in pages.collect()])


def parse(record):
    """Fields, HTTP part and payload of one record, by the format's own rules."""
    head, rest = record.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    assert lines[0] == "WARC/1.1"
    fields = dict(line.split(": ", 1) for line in lines[1:])
    length = int(fields["Content-Length"])
    assert rest[length:] == b"\r\n\r\n"
    http, payload = rest[:length].split(b"\r\n\r\n", 1)
    return fields, http, payload


def test_records_are_rebuilt_exactly(spark):
    archive = archive_pages(spark.createDataFrame(ROWS, SCHEMA))
    assert archive.payloads.count() == len({h or "" for _, _, h in ROWS})
    rebuilt = reconstruct(archive).collect()
    assert sorted(bytes(r.payload) for r in rebuilt) == sorted((h or "").encode() for _, _, h in ROWS)
    ids = set()
    for r in rebuilt:
        fields, http, payload = parse(bytes(r.warc))
        ids.add(fields["WARC-Record-ID"])
        assert payload == (bytes(r.payload) if fields["WARC-Type"] == "response" else b"")
        assert f"Content-Length: {len(r.payload)}".encode() in http
    assert len(ids) == len(ROWS)
    assert {parse(bytes(r.warc))[0].get("WARC-Refers-To") for r in rebuilt} <= ids | {None}
    urls = [unquote(parse(bytes(r.warc))[0].get("WARC-Target-URI", "<none>")) for r in rebuilt]
    assert sorted(urls) == sorted(u if u is not None else "<none>" for _, u, _ in ROWS)


def test_files_hold_the_same_records(spark, tmp_path):
    archive = archive_pages(spark.createDataFrame(ROWS, SCHEMA).repartition(3))
    found = []
    for file in export_files(archive, str(tmp_path / "warc")).collect():
        store, at = pafs.FileSystem.from_uri(file.file)
        data = gzip.decompress(store.open_input_file(at).read())
        parts = data.split(b"WARC/1.1\r\n")[1:]
        assert len(parts) == file.records
        found += [b"WARC/1.1\r\n" + p for p in parts]
    assert sorted(found) == sorted(bytes(r.warc) for r in reconstruct(archive).collect())


def test_damage_is_noticed(spark):
    archive = archive_pages(spark.createDataFrame(ROWS, SCHEMA))
    wrong = archive._replace(payloads=archive.payloads.withColumn("payload", F.concat("payload", F.lit(b"!"))))
    with pytest.raises(Exception, match="does not have its address"):
        read_records(wrong).collect()
    lost = archive._replace(payloads=archive.payloads.where(F.octet_length("payload") > 0))
    with pytest.raises(Exception, match="differ"):
        read_records(lost).collect()


def test_odd_tables(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    clashing = pages.withColumns({n: F.lit(1) for n in ("id", "record", "address", "payload", "header", "bytes", "a", "first", "refers_to")})
    assert sorted(map(tuple, read_records(archive_pages(clashing)).collect()), key=str) == expected(ROWS)
    assert read_records(archive_pages(pages.limit(0))).collect() == []
    assert reconstruct(archive_pages(pages.limit(0))).collect() == []
    words = spark.createDataFrame([("a:b", None, "x"), ("none", None, "x"), ("ü/1", None, "x")], "page_id string, url string, html string")
    got = {r.page_id: r.refers_to for r in read_records(archive_pages(words)).collect()}
    assert got == {"a:b": None, "none": "a:b", "ü/1": "a:b"}
