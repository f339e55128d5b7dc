import base64
import hashlib

import duckdb
import pytest

from farebox.llm import warc


def archive(spark, tmp_path, rows, least=0):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, size int")
    warc.write_archive(df.repartition(3), str(tmp_path / "a"), least)
    return str(tmp_path / "a")


ROWS = [(1, "http://a/1", "<p>é</p>", 0), (2, "http://a/2", "<p>é</p>", 0), (3, None, None, 0), (4, "u\r\nX: y", "", 0), (5, "http://a/5", "x" * 2_000_000, 0), (6, "http://b", "revisit", 0)]


@pytest.mark.parametrize("least", [0, 5, 100])
def test_kinds(spark, tmp_path, least):
    got = {r.page_id: r for r in warc.read_headers(spark, archive(spark, tmp_path, ROWS, least)).collect()}
    for page_id, _, html, _ in ROWS:
        data = (html or "").encode()
        same = [r[0] for r in ROWS if (r[2] or "").encode() == data]
        r, first = got[page_id], len(data) < least or page_id == max(same)
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", max(same)))
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 4


def test_records(spark, tmp_path):
    records = [r.record for r in warc.read_records(spark, archive(spark, tmp_path, ROWS)).collect()]
    assert len(records) == len(ROWS)
    for record in records:
        head, _, rest = bytes(record).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        page = next(r for r in ROWS if r[0] == int(fields[b"WARC-Record-ID"].split(b":")[2]))
        assert fields[b"WARC-Date"] == b"2000-01-01T00:00:00Z" and (b"WARC-Profile" in fields) == (fields[b"WARC-Type"] == b"revisit")
        assert int(fields[b"Content-Length"]) == len(rest) - 4 and rest.endswith(b"\r\n\r\n")
        assert rest[:-4] == (b"" if fields[b"WARC-Type"] == b"revisit" else (page[2] or "").encode())


def test_changed_payload_is_noticed(spark, tmp_path):
    path = archive(spark, tmp_path, ROWS)
    p = spark.read.parquet(f"{path}/payloads")
    rows = p.collect()
    swap = [(r.sha256, r.size, r.page_id, r.sha1, rows[(i + 1) % len(rows)].member, r.records) for i, r in enumerate(rows)]
    spark.createDataFrame(swap, p.schema).write.parquet(f"{path}2/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}2/headers")
    with pytest.raises(Exception, match="isn't what was stored"):
        warc.read_headers(spark, f"{path}2").collect()
    with pytest.raises(Exception, match="isn't what its header says"):
        warc._with_payloads(spark, f"{path}2").mapInArrow(warc._parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string").collect()


def test_empty_and_repeated(spark, tmp_path):
    got = warc.read_headers(spark, archive(spark, tmp_path, [(7, "u", "same", 0)] * 3 + [(None, "u", "same", 0)])).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [("7", "response", None)] * 3 + [("None", "revisit", 7)]
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "b"))
    assert warc.read_headers(spark, str(tmp_path / "b")).count() == 0


def test_sql(spark):
    con = duckdb.connect()
    con.sql("create view pages as select * from read_parquet('/root/testdata/sf0.01/pages.parquet')")
    want = sorted(con.sql(warc.ORACLE).fetchall())
    got = warc.op2_content_addressed_warc(spark, "/root/testdata/sf0.01")
    assert got.columns == [c[0] for c in con.sql(warc.ORACLE).description]
    assert sorted(map(tuple, got.collect())) == want


def test_hot_payload_and_identifiers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SHARED", 8)
    rows = [(i // 2, f"u{i}", "same" if i % 4 else f"own {i}", 0) for i in range(200)]
    records = [bytes(r.record) for r in warc.read_records(spark, archive(spark, tmp_path, rows)).collect()]
    assert len(records) == 200
    names = [r.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for r in records]
    assert len(set(names)) >= 199  # the response of page 99 stands there twice
    known = set(names)
    for r in records:
        if b"WARC-Refers-To" in r:
            assert r.split(b"WARC-Refers-To: ")[1].split(b"\r\n")[0] in known
