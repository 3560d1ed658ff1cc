from __future__ import annotations

import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from strandflow.llm.warc import SQL, gzip_member, op5_warc, read_records, record_bytes, register, with_revisits
from tests.conftest import SF, rows_of


def records(spark):
    big = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 80
    rows = [(1, "http://a.example/x y\r\nEvil: 1", big), (2, None, big), (5, "http://b.example/%20", big), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "z" * 300_000)]
    return with_revisits(spark.createDataFrame(rows, "id long, uri string, payload string").withColumn("payload", F.col("payload").cast("binary"))), {r[0]: (r[1], (r[2] or "").encode()) for r in rows}


def test_query_equals_sql(spark, duck):
    assert rows_of(op5_warc(spark, SF)) == rows_of(duck.sql(SQL["op5_warc"]).df())


def test_round_trip_plain_and_compressed(spark, tmp_path):
    register(spark)
    made, source = records(spark)
    for kind in ("gzip", "none"):
        folder = str(tmp_path / kind)
        made.repartition(3).write.format("warc").option("compression", kind).option("file_bytes", 20_000).mode("append").save(folder)
        back = spark.read.format("warc").load(folder).collect()
        assert len(back) == 9
        for r in back:
            key = None if "none" in r["record_id"] else int(r["record_id"][10:-1])
            uri, payload = source[key]
            assert r["target_uri"] == uri and r["payload_length"] == len(payload) and r["payload_digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
            assert bytes(r["payload"]) == payload if r["warc_type"] == "response" else r["payload"] is None
        assert {r["record_id"] for r in back if r["warc_type"] == "revisit"} == {"<urn:page:1>", "<urn:page:2>"}
        assert {r["refers_to"] for r in back if r["warc_type"] == "revisit"} == {"<urn:page:5>"}


def test_predicates_and_payload_are_pushed_down(spark, tmp_path):
    register(spark)
    made, _ = records(spark)
    folder = str(tmp_path / "w")
    made.write.format("warc").mode("append").save(folder)
    df = spark.read.format("warc").option("payload", "false").load(folder).where((F.col("warc_type") == "response") & F.col("target_uri").startswith("http://b"))
    assert [r["record_id"] for r in df.collect()] == ["<urn:page:5>"] and df.first()["payload"] is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("isnotnull", "") or "StartsWith(target_uri" not in plan.split("Filter (")[-1]
    assert spark.read.format("warc").option("types", "revisit").load(folder).count() == 2


def test_files_of_other_writers_and_orphans(spark, tmp_path):
    register(spark)
    row = {"warc_type": "response", "record_id": "<urn:page:1>", "target_uri": "u", "date": None, "refers_to": None, "payload_digest": None, "payload_length": 3, "payload": b"abc"}
    folder = tmp_path / "foreign"
    folder.mkdir()
    (folder / "x.warc.gz").write_bytes(gzip.compress(record_bytes(row)) + gzip_member(record_bytes(row | {"record_id": "<urn:page:2>"})) + gzip.compress(record_bytes(row | {"record_id": "<urn:page:3>"})))
    assert sorted(r["record_id"] for r in spark.read.format("warc").load(str(folder)).collect()) == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]
    made, _ = records(spark)
    made.limit(0).write.format("warc").mode("append").save(str(folder))  # its manifest lists no file
    (folder / f"part-{'0' * 32}.warc.gz").write_bytes(gzip_member(record_bytes(row)))  # of a job that did not end
    assert spark.read.format("warc").load(str(folder)).count() == 3
    assert gzip.decompress(gzip_member(b"abc" * 999)) == b"abc" * 999


def test_one_member_for_a_whole_file(spark, tmp_path):
    register(spark)
    row = {"warc_type": "response", "record_id": "<urn:page:1>", "target_uri": "http://x/a%20b", "date": None, "refers_to": None, "payload_digest": None, "payload_length": 3}
    records = [record_bytes(row | {"record_id": f"<urn:page:{k}>", "payload": b"x" * k * 1000}).replace(b"%2520", b"%20").replace(b"X-Header-Values: percent-encoded\r\n", b"") for k in range(60)]
    for name, data in (("one.warc.gz", gzip.compress(b"".join(records))), ("two.warc.gz", gzip.compress(b"".join(records[:7])) + gzip.compress(b"".join(records[7:]))), ("plain.warc", b"".join(records))):
        folder = tmp_path / name[:3]
        folder.mkdir()
        (folder / name).write_bytes(data)
        got = spark.read.format("warc").load(str(folder))
        assert sorted((int(r["record_id"][10:-1]), len(r["payload"])) for r in got.collect()) == [(k, k * 1000) for k in range(60)]
        assert got.where("target_uri = 'http://x/a%20b'").count() == 60
        assert got.where("record_id = '<urn:page:59>'").count() == 1
        (folder / name).write_bytes(data[:-3000])
        try:
            got.collect()
            raise AssertionError(name)
        except Exception as e:
            assert "truncated" in str(e)


def test_null_headers_meet_no_prefix(spark, tmp_path):
    register(spark)
    made = with_revisits(spark.createDataFrame([(1, None, b"a"), (2, "u", b"b")], "id long, uri string, payload binary").selectExpr("*", "1 as digest", "2 as length", "3 as n", "4 as first"))
    made.write.format("warc").mode("append").save(str(tmp_path / "n"))
    load = lambda: spark.read.format("warc").load(str(tmp_path / "n"))
    assert [r["record_id"] for r in load().where(F.col("target_uri").startswith("")).collect()] == ["<urn:page:2>"]
    assert load().count() == 2


class Counted:
    """A file that counts what is read of it."""

    def __init__(self, data: bytes):
        self.f, self.count = io.BytesIO(data), 0

    def read(self, n: int = -1) -> bytes:
        got = self.f.read(n)
        self.count += len(got)
        return got

    def seek(self, *at) -> int:
        return self.f.seek(*at)


def test_unwanted_records_and_payloads_are_not_read():
    rng = random.Random(1)
    rows = [{"warc_type": "response", "record_id": f"<urn:page:{k}>", "target_uri": "u", "date": None, "refers_to": None, "payload_digest": None, "payload_length": n, "payload": rng.randbytes(n)} for k, n in enumerate([0, 10, 200_000, 1000, 300_000, 65_536])]
    for gz, data in ((True, b"".join(gzip_member(record_bytes(r)) for r in rows)), (False, b"".join(map(record_bytes, rows)))):
        everything = list(read_records(f := Counted(data), gz, lambda head: True, True))
        assert [(r["record_id"], r["payload"]) for r in everything] == [(r["record_id"], r["payload"]) for r in rows] and f.count >= len(data) - 8
        assert list(read_records(f := Counted(data), gz, lambda head: False, True)) == [] and f.count < 5200 * len(rows)
        without = list(read_records(f := Counted(data), gz, lambda head: True, False))
        assert [(r["record_id"], r["payload_length"], r["offset"]) for r in without] == [(r["record_id"], r["payload_length"], r["offset"]) for r in everything] and f.count < 5200 * len(rows)
        one = list(read_records(f := Counted(data), gz, lambda head: head["warc-record-id"] == "<urn:page:4>", True))
        assert [r["payload"] for r in one] == [rows[4]["payload"]] and f.count < 300_000 + 5200 * len(rows) + 70_000
    with pytest.raises(ValueError, match="truncated"):
        list(read_records(Counted(gzip_member(record_bytes(rows[2]))[:5000]), True, lambda head: True, True))
