"""Archives: round trip, magic inside payloads, splits of plain files, damaged and empty files."""

import base64
import hashlib
import re

import pytest

from spanloom.llm import queries, warc

SF = "/root/testdata/sf0.001"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows):
    first = {}
    for i, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t in rows:
        f = first.get(t or "")
        revisit = f is not None and (i is None or i > f)
        out.append((i, len((t or "").encode()), digest(t), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=repr)


def back(spark, target):
    got = []
    for r in warc.read_warc(spark, target).collect():
        number = lambda x: int(m[1]) if x and (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
        if r.record_type == "response":
            assert len(r.payload) == r.payload_bytes and base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() == r.payload_digest
        got.append((number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)))
    return sorted(got, key=repr)


def test_query(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = [tuple(r) for r in queries.op6_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == expected(rows)


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
ODD = [
    (1, "plain"), (2, None), (3, ""), (4, "plain"), (5, f"x{FAKE}y"), (6, FAKE), (7, FAKE * 3), (8, "ends\r\n"), (9, "a\r\n\r\nb\r\n\r\n"), (10, "WARC/1.0\r\n"),
    (11, "WARC/1.0\r\nContent-Length: 5"), (12, "é" * 5000), (13, "z" * 300_000), (14, f"x{FAKE}y"), (None, "plain"), (None, "alone"), (15, "HTTP/1.1 200 OK\r\n\r\n"),
    (16, "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99999999999\r\n\r\n"), (17, "WARC/1.0\r\nWARC-Type: x\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 200),
]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_odd_payloads(spark, tmp_path, compression):
    df = spark.createDataFrame([(i, t, "u\r\nX: y", "q") for i, t in ODD], "page_id long, html string, url string, __digest2 string").repartition(3)
    target = f"file://{tmp_path}/odd"
    warc.write_warc(df, target, "page_id", "html", "url", compression=compression)
    assert back(spark, target) == expected(ODD)


def test_splits_of_a_plain_file(spark, tmp_path):
    rows = [(i, (FAKE if i % 7 == 0 else "") + "text " * (i % 50) + str(i)) for i in range(600)]
    target = f"file://{tmp_path}/split"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, html string").coalesce(1), target, "page_id", "html", compression="none")
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "7000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert warc._pieces(spark, target).select("block").distinct().count() > 5
        assert back(spark, target) == expected(rows)
    finally:
        spark.conf.set(key, old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_repeated_rows_empty_table_and_cut_file(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "page_id long, html string")
    warc.write_warc(df, f"file://{tmp_path}/r", "page_id", "html")
    assert [x[3] for x in back(spark, f"file://{tmp_path}/r")] == ["response", "response", "response", "revisit"]  # by id and size; ids 1, 1, 2 (b), 2
    warc.write_warc(df.limit(0), f"file://{tmp_path}/e", "page_id", "html")
    assert back(spark, f"file://{tmp_path}/e") == []
    (tmp_path / "cut").mkdir()
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "cut" / "a.warc").write_bytes(record % 1 + record % 2 + (record % 3)[:-6])
    got = warc.read_warc(spark, f"file://{tmp_path}/cut").collect()
    assert sorted(r.record_id for r in got) == ["<urn:page:1>", "<urn:page:2>"] and {bytes(r.payload) for r in got} == {b"abc"}


def test_minimum_size(spark, tmp_path):
    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "abcdef"), (4, "abcdef")], "page_id long, html string")
    warc.write_warc(df, f"file://{tmp_path}/m", "page_id", "html", min_bytes=3)
    assert [x[3] for x in back(spark, f"file://{tmp_path}/m")] == ["response", "response", "response", "revisit"]
