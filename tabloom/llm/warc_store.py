"""Content-addressed WARC archives: every payload once, every record header exactly, records by a join.

An archive is two Parquet tables in the shared folder:

* ``payloads``: ``(address, payload)``, the bytes of each different payload
  once, under their SHA-256;
* ``headers``: ``(id, record, address, header)``, one row per record with the
  exact text that stands before the payload: the WARC fields and the HTTP
  header.

Of records with equal payloads of at least ``least_bytes`` bytes the one with
the smallest id is a ``response``, the others are ``revisit`` records that
refer to it and carry no payload. Smaller payloads are stored once too, but
each of their records is a response.

Copies are dropped within a map task before anything is shuffled, so a payload
that a third of the pages share crosses the network once per task. Addresses
are verified whenever the archive is read: the digest of the stored bytes must
be their address, and length and SHA-1 must be those of the header.

Defined results: a null page is an empty payload. Of repeated rows (one id, one
payload) one is the response. Rows without an id come after all others and
refer, or are referred to, by null. A missing URL leaves its field out; line
breaks in a URL are percent-encoded. An empty table is an empty archive. Other
columns play no part.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.llm.batches import named
from tabloom.session import durable

# Fixed values of the format.
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = "none"


class Archive(NamedTuple):
    headers: DataFrame
    payloads: DataFrame
    id_type: T.DataType


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base 32: five hexadecimal digits are four digits of base 32."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def _record_id(key: Column, record: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(key.cast("string")), F.lit(NO_ID)), F.lit(":"),
                    record.cast("string"), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where there is no value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def archive_pages(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html",
                  least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> Archive:
    """Write one record per row; ``date`` is the ``WARC-Date`` of all of them."""
    payload = F.encode(F.coalesce(named(html).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(named(id_column).alias("id"), named(url).cast("string").alias("url"), payload.alias("payload"))
    address = F.unhex(F.sha2("payload", 256)).alias("address")
    payloads = durable(rows.select(address, "payload").dropDuplicates(["address"]), "payloads")
    facts = durable(rows.select(
        "id", "url", F.monotonically_increasing_id().alias("record"), address, F.octet_length("payload").alias("bytes"),
        base32_sha1(F.col("payload")).alias("sha1")), "facts")
    # Only payloads that occur twice need their first record looked up.
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("record").alias("record"))
    first = facts.where(F.col("bytes") >= least_bytes).groupBy("address").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select(F.col("address").alias("a"), "first")
    records = facts.join(first, facts["address"] == first["a"], "left")
    revisit = (F.col("first.record") != F.col("record")) & (F.col("bytes") >= least_bytes)
    revisit = F.coalesce(revisit, F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    clean_url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _record_id(F.col("id"), F.col("record"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", clean_url),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _field("WARC-Refers-To", F.when(revisit, _record_id(F.col("first.id"), F.col("first.record")))),
        _field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _field("Content-Type", F.lit("application/http;msgtype=response")),
        _field("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit("\r\n"), http)
    headers = durable(records.select("id", "record", "address", header.alias("header")), "headers")
    return Archive(headers, payloads, pages.schema[id_column].dataType)


def _read(header: str, name: str) -> Column:
    """Value of a WARC field, null where the record has none."""
    found = F.regexp_extract(header, rf"\A(?:[^\r\n]+\r\n)*?{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.col(header).rlike(rf"\A(?:[^\r\n]+\r\n)*?{name}: "), found)


def _checked(ok: Column, what: str, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(what)))


def read_records(archive: Archive, id_column: str = "page_id") -> DataFrame:
    """``(id, payload_bytes, payload_digest, record_type, refers_to)`` of every record, from the stored tables.

    The stored bytes are read, held against their address and measured once
    per payload, before the join; a damaged payload or header is an error.
    """
    again = F.unhex(F.sha2("payload", 256))
    stored = archive.payloads.select(
        _checked(again == F.col("address"), "a stored payload does not have its address", F.col("address")).alias("a"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    fields = archive.headers.select(
        F.col("id"), "address", _read("header", "WARC-Type").alias("record_type"),
        _read("header", "WARC-Payload-Digest").alias("declared"),
        F.regexp_extract("header", r"\nContent-Length: (\d+)\r\n\r\n\z", 1).cast("long").alias("length"),
        F.regexp_extract(_read("header", "WARC-Refers-To"), "^<urn:page:([^:]*):", 1).alias("to"))
    joined = fields.join(stored, fields["address"] == stored["a"], "left")
    ok = (F.concat(F.lit("sha1:"), F.col("payload_digest")) == F.col("declared")) & (F.col("length") == F.col("payload_bytes"))
    refers = F.when(F.col("to") != NO_ID, F.url_decode("to").cast(archive.id_type))
    return joined.select(
        F.col("id").alias(id_column), "payload_bytes",
        _checked(F.coalesce(ok, F.lit(False)), "a header and its payload differ", F.col("payload_digest")).alias("payload_digest"),
        "record_type", refers.alias("refers_to"))


def reconstruct(archive: Archive, id_column: str = "page_id") -> DataFrame:
    """``(id, record, payload, warc)``: every page's payload and the exact bytes of its record, by a join on the address."""
    joined = archive.headers.join(archive.payloads, "address")
    body = F.when(_read("header", "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select(F.col("id").alias(id_column), "record", "payload",
                         F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n")).alias("warc"))


FILES = T.StructType([T.StructField("file", T.StringType()), T.StructField("records", T.LongType())])


def export_files(archive: Archive, folder: str) -> DataFrame:
    """Standard ``.warc.gz`` files, a gzip member per record; ``(file, records)`` of the files that count.

    Every attempt of a task writes a file of its own.
    """
    target = f"file://{folder}" if folder.startswith("/") else folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, n = None, f"{target}/{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            if out is None and batch.num_rows:
                store, at = pafs.FileSystem.from_uri(name)
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                out = store.open_output_stream(at, compression=None)
            for record in batch.column(0):
                out.write(gzip.compress(record.as_py(), mtime=0))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=FILES.names)

    return durable(reconstruct(archive).select("warc").mapInArrow(run, FILES), "warc-files")
