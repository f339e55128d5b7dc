"""A content-addressed web archive: payload bytes once, record headers apart, records rebuilt by joins.

An archive is two tables in one folder:
- payloads: sha256, sha1 (base32), size, the gzip member of each distinct payload and how many records have it;
- headers: one row for each record with its exact header block (bytes up to and with the blank line), its kind
  and the digest that its block refers to. Its identifier is made of the page_id and the payload's digest, and for a revisit a number
  of its own; the date is a parameter, since pages have none.

A payload's address is its SHA-256 digest together with its length. Reading verifies both digests of every stored payload against its bytes
and fails on a mismatch. A record is its header block, its payload for a response, and two line ends; revisits
have an empty block and refer to the response with the same payload.

Of records with equal payloads of at least ``least`` bytes that with the largest id is the response and the others
revisit it. Smaller payloads are stored once too, but all their records are responses.

Skew: payloads are combined per digest before the shuffle (one copy leaves each task), and what joins by digest afterwards is
rows of headers without payloads, which adaptive execution splits where one digest is hot. Records are rebuilt from as many copies of
a payload as it has SHARED records, so a hot one is spread over tasks.

Edge cases: a null html is an empty payload; a null url gives an empty target; repeated page ids: one of the rows with the
largest id is written as the response of its digest and the others as the same response again, of one identifier; a null id is smaller
than any other; columns other than page_id, url and html aren't read; very long payloads are one member each; an empty table gives empty results.
"""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.llm.common import new_path, table

_STORED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("sha256", pa.binary()), ("sha1", pa.string()), ("size", pa.int64()), ("member", pa.binary())])
_STORED_DDL = "page_id long, url string, sha256 binary, sha1 string, size long, member binary"
#: Fixed value: the profile of revisits with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
#: Records that are rebuilt from one copy of a payload.
SHARED = 256
#: Fixed value: base32 digits in the order of their value.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _address(batches):
    """Digests and the compressed member of each payload."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            html = [(x or "").encode("utf-8", "surrogatepass") for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([hashlib.sha256(x).digest() for x in html]), pa.array([base32_sha1(x) for x in html]), pa.array([len(x) for x in html], pa.int64()), pa.array([gzip.compress(x, 6, mtime=0) for x in html])],
                schema=_STORED,
            )


def header_block(page_id: Column, url: Column, kind: Column, sha1: Column, size: Column, refers_to: Column, number: Column, date: str = DATE) -> Column:
    """The exact header block of a record, as bytes. number: what tells revisits of one page and payload apart."""
    name = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), sha1)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(name(page_id), F.when(kind == "revisit", F.concat(F.lit(":"), number.cast("string"))).otherwise(""), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(kind == "revisit", F.concat(line("WARC-Refers-To", F.concat(name(refers_to), F.lit(">"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(size.cast("string"))),
        F.lit("\r\n"),
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, least: int = 0, date: str = DATE) -> None:
    """Writes the archive of pages (page_id, url, html) under path."""
    rows = pages.select("page_id", "url", "html").mapInArrow(_address, _STORED_DDL)
    stored = rows.groupBy("sha256", "size").agg(F.max("page_id").alias("page_id"), F.first("sha1").alias("sha1"), F.first("member").alias("member"), F.count("*").alias("records"))
    stored.write.parquet(f"{path}/payloads")
    holders = pages.sparkSession.read.schema("sha256 binary, size long, page_id long, records long").parquet(f"{path}/payloads").withColumnRenamed("page_id", "holder")
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    plain = pages.select("page_id", "url", F.unhex(F.sha2(html, 256)).alias("sha256"), F.octet_length(html).cast("long").alias("size"), _base32(F.sha1(html)).alias("sha1"))
    met = plain.join(holders, ["sha256", "size"])
    kind = F.when((F.col("size") < least) | F.col("page_id").eqNullSafe(F.col("holder")), "response").otherwise("revisit")
    headers = met.withColumn("kind", kind).select("sha256", "size", header_block(F.col("page_id"), F.col("url"), F.col("kind"), F.col("sha1"), F.col("size"), F.col("holder"), F.monotonically_increasing_id(), date).alias("header"), "records")
    headers.write.parquet(f"{path}/headers")


def _base32(hexed: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: five of them are four digits of base 32."""
    part = lambda i: F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*map(part, range(8))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def _verify(batches):
    for batch in batches:
        sha1 = []
        for digest, name, size, member in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            data = gzip.decompress(member)
            if hashlib.sha256(data).digest() != digest or len(data) != size or base32_sha1(data) != name:
                raise ValueError(f"the payload sha1:{name} isn't what was stored")
            sha1.append(name)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sha1, pa.string())], names=["sha256", "size", "verified"])


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The fields of every record, from its header block and its verified payload."""
    payloads = spark.read.schema("sha256 binary, sha1 string, size long, member binary").parquet(f"{path}/payloads")
    sound = payloads.mapInArrow(_verify, "sha256 binary, size long, verified string")
    headers = spark.read.schema("sha256 binary, size long, header binary").parquet(f"{path}/headers")
    text = F.decode("header", "UTF-8")
    field = lambda name, pattern: F.regexp_extract(text, f"\r\n{name}: {pattern}\r\n", 1)
    number = lambda name: F.nullif(field(name, "<urn:page:(-?[0-9]*):[^>]*>"), F.lit("")).cast("long")
    met = headers.join(sound, ["sha256", "size"], "left")
    return met.select(
        number("WARC-Record-ID").alias("page_id"),
        field("WARC-Target-URI", "([^\r\n]*)").alias("url"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        F.assert_true(F.col("verified") == field("WARC-Payload-Digest", "sha1:([A-Z2-7]{32})"), "a header's payload is missing").alias("_sound"),
        F.col("size").alias("payload_bytes"),
        F.col("verified").alias("payload_digest"),
    )


def _rebuild(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            header, member = (batch.column(c).slice(at, 64).to_pylist() for c in (0, 1))
            data = [gzip.decompress(m) for m in member]
            records = [h + (b"" if b"\r\nWARC-Type: revisit\r\n" in h else d) + b"\r\n\r\n" for h, d in zip(header, data, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary()), pa.array(map(base32_sha1, data), pa.string()), pa.array(map(len, data), pa.int64())], names=["record", "sha1", "size"])


def _with_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The header block of each record and the member of its payload."""
    payloads = spark.read.schema("sha256 binary, size long, member binary, records long").parquet(f"{path}/payloads")
    headers = spark.read.schema("sha256 binary, size long, header binary, records long").parquet(f"{path}/headers")
    copies = payloads.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("records") / SHARED)))).drop("records")
    dealt = headers.withColumn("copy", F.pmod(F.xxhash64("header"), F.floor(F.col("records") / SHARED) + 1))
    return dealt.join(copies, ["sha256", "size", "copy"]).select("header", "member")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The original records, byte for byte (a column record), with the digest and size of their payload as it was read."""
    return _with_payloads(spark, path).mapInArrow(_rebuild, "record binary, sha1 string, size long")


def _parse(batches):
    """The digest columns from rebuilt records; fails where a record isn't what its header says."""
    import re

    field = lambda name, head: m[1].decode() if (m := re.search(rb"\r\n" + name + rb": ([^\r\n]*)\r\n", head)) else None
    page = lambda name, head: int(m) if (m := (field(name, head) or "::").split(":")[2]) else None
    for batch in _rebuild(batches):
        rows = []
        for record, sha1, size in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            head, _, rest = record.partition(b"\r\n\r\n")
            head += b"\r\n"
            kind = field(b"WARC-Type", head)
            if field(b"WARC-Payload-Digest", head) != f"sha1:{sha1}" or int(field(b"Content-Length", head)) != len(rest) - 4 or kind == "response" and base32_sha1(rest[:-4]) != sha1:
                raise ValueError(f"a record isn't what its header says: {field(b'WARC-Record-ID', head)}")
            rows.append((page(b"WARC-Record-ID", head), size, sha1, kind, page(b"WARC-Refers-To", head), field(b"WARC-Target-URI", head)))
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])


def op2_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return _with_payloads(spark, path).mapInArrow(_parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS holder, sha1(html) AS h FROM p GROUP BY html),
n AS (SELECT html, holder, list_transform(range(0, 32), lambda i: (('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS v FROM g),
d AS (SELECT html, holder, list_aggregate(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x + 1 AS INT), 1)), 'string_agg', '') AS digest FROM n)
SELECT page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> holder THEN holder END AS refers_to, regexp_replace(url, '[\\r\\n]', ' ', 'g') AS url
FROM p JOIN d ON p.html = d.html
"""
