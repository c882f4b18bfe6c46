import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.oracle_harness import compare
from vitrine.llm import queries, warc


def test_query_matches_oracle(spark):
    name = "op5_warc_round_trip"
    assert compare(spark, SF_SMALL, name, queries.QUERIES[name], queries.ORACLE_SQL[name])["status"] == "ok"


PAGES = [(1, "http://a/", "x" * 200), (2, "http://b/", "x" * 200), (3, None, None), (4, "http://c/\r\nWARC-Type: forged", ""),
         (5, "u", "é" * 60_000 + "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n"), (6, "u", "y" * 99), (7, "u", "y" * 99), (None, "u", "x" * 200)]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip_pushdown_and_edges(spark, tmp_dir, compression):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "first": F.lit(2)})
    path = f"file://{tmp_dir}/w"
    warc.write_warc(warc.page_records(pages), path, compression)
    got = {r.record_id: r for r in warc.read_warc(spark, path).collect()}
    text = {f"<urn:page:{i}>": h or "" for i, _, h in PAGES if i is not None}
    for k, h in text.items():
        assert got[k].payload_digest == "sha256:" + hashlib.sha256(h.encode()).hexdigest()
        assert got[k].payload_length == len(h.encode())
        assert bytes(got[k].payload) == (b"" if got[k].record_type == "revisit" else h.encode())
    assert got["<urn:page:2>"].refers_to == "<urn:page:1>" and got["<urn:page:2>"].record_type == "revisit"
    assert {got[f"<urn:page:{i}>"].record_type for i in (1, 3, 4, 5, 6, 7)} == {"response"}
    assert got["<urn:page:4>"].target_uri == "http://c/ WARC-Type: forged" and got["<urn:page:3>"].target_uri is None
    heads = warc.read_warc(spark, path, ("record_id", "record_type")).where("record_type = 'revisit'")
    assert "Filter (" not in heads._jdf.queryExecution().executedPlan().toString()  # pushed down whole
    assert heads.count() == len([r for r in got.values() if r.record_type == "revisit"])
    some = warc.read_warc(spark, path, ("record_id", "target_uri")).where("target_uri LIKE 'http://a%'")
    assert [r.record_id for r in some.collect()] == ["<urn:page:1>"]
    empty = f"file://{tmp_dir}/e"
    warc.write_warc(warc.page_records(pages.limit(0)), empty, compression)
    assert warc.read_warc(spark, empty).collect() == []


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_split_archives_and_skipped_payloads(spark, tmp_dir, compression, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT_BYTES", 1000)
    path = f"{tmp_dir}/s"
    w = warc.WarcWriter(path, False, compression == "gzip")

    class Row(dict):
        def asDict(self):
            return self

    rows = [Row(record_id=f"<{k}>", record_type="response" if k % 3 else "warcinfo", payload=os.urandom(500 + 7 * k)) for k in range(40)]
    w.commit([w.write(iter(rows)), None])
    reader = warc.WarcReader(path, ["record_id", "payload"], 1000)
    parts = reader.partitions()
    assert len(parts) > 10
    assert [x for p in parts for x in reader.read(p)] == [(r["record_id"], r["payload"]) for r in rows]
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = warc.WarcReader(path, ["record_id"], 1 << 30)
    assert len(list(reader.pushFilters([EqualTo(("record_type",), "warcinfo"), GreaterThan(("payload_length",), 3)]))) == 1
    assert [x[0] for p in reader.partitions() for x in reader.read(p)] == [f"<{k}>" for k in range(0, 40, 3)]
    # a stray file of a lost task is not in the manifest
    with open(f"{path}/part-stray.warc", "wb") as f:
        f.write(b"".join(warc.record(rows[0])))
    assert len(reader.partitions()) == 1


def test_archives_from_elsewhere(spark, tmp_dir):
    rows = [{"record_id": f"<{k}>", "record_type": "resource", "payload": b"p%d" % k * 300_000} for k in range(3)]
    with gzip.open(f"{tmp_dir}/a.warc.gz", "wb") as f:
        f.write(b"".join(p for r in rows for p in warc.record(r)))
    with open(f"{tmp_dir}/b.warc", "wb") as f:
        f.write(b"".join(p for r in rows for p in warc.record(r)))
    got = warc.read_warc(spark, tmp_dir, ("record_id", "payload")).collect()
    assert sorted((r.record_id, len(r.payload)) for r in got) == sorted([(f"<{k}>", 600_000) for k in range(3)] * 2)
    assert warc.read_warc(spark, tmp_dir, ("record_id", "record_type")).where("record_type = 'response'").count() == 0
