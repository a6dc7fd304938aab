import hashlib

import pytest
from pyspark.sql import functions as F

from embera.llm import warc_audit as W


def records(spark, n, copies=1):
    rows = [(i, f"http://h/{i}", "é" * (i % 50)) for i in range(n)] * copies + [(None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return W.laid_out(df.select(W.warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"), "page_id"), ["page_id"])


@pytest.mark.parametrize("cell", [1000, 0.001])
def test_layout(spark, monkeypatch, cell):
    monkeypatch.setattr(W, "CELL", cell)
    rows = sorted(records(spark, 120, 2).collect(), key=lambda r: r["offset"])
    at = 0
    for r in rows:
        assert r["offset"] == at
        at += r["length"]
    assert [r["digest"] for r in rows] == sorted(r["digest"] for r in rows) and len(rows) == 241
    text = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nWARC-Target-URI: http://h/7\r\nContent-Type: text/html\r\nContent-Length: 14\r\n\r\n{'é' * 7}\r\n\r\n"
    seven = [r for r in rows if r["page_id"] == 7]
    assert len(seven) == 2 and {r["digest"] for r in seven} == {hashlib.sha256(text.encode()).hexdigest()}


@pytest.mark.parametrize("block,fanout", [(1 << 16, 16), (512, 2)])
def test_audit(spark, monkeypatch, block, fanout):
    monkeypatch.setattr(W, "BLOCK", block)
    monkeypatch.setattr(W, "FANOUT", fanout)
    first = W.checkpointed(records(spark, 200)).select("offset", "length", "digest")
    rows = first.orderBy("offset").collect()
    bad, gone, extra = rows[17]["offset"], rows[90]["offset"], rows[-1]["offset"] + rows[-1]["length"]
    second = first.where(F.col("offset") != gone).withColumn("digest", F.when(F.col("offset") == bad, "0" * 64).otherwise(F.col("digest"))).union(spark.createDataFrame([(extra, 5, "f" * 64)], first.schema))
    got = {r["offset"]: r["status"] for r in W.audit(first, second).collect()}
    assert got == {bad: "damaged", gone: "lost", extra: "added"}
    assert W.audit(first, first).collect() == []


def test_only_differing_ranges_are_compared(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 1000)
    first = W.checkpointed(records(spark, 100)).select("offset", "length", "digest")
    at = first.orderBy("offset").collect()[50]["offset"]
    second = W.checkpointed(first.withColumn("digest", F.when(F.col("offset") == at, "x").otherwise(F.col("digest"))))
    a, b = (W.MerkleTree(d, 3) for d in (first, second))
    found = None
    for level in (2, 1, 0):
        found = W._differing(a.levels[level], b.levels[level], found, W.FANOUT)
        assert [r["range"] for r in found.collect()] == [at // (1000 * W.FANOUT**level)]
    assert a.root() != b.root()


def test_empty(spark):
    none = spark.createDataFrame([], "offset long, length long, digest string")
    assert W.audit(none, none).collect() == []
    assert [r["status"] for r in W.audit(none, spark.createDataFrame([(0, 3, "a")], none.schema)).collect()] == ["added"]


def test_long_records_and_any_extra_column(spark):
    """A very long record, repeated rows and columns of the names that are used inside."""
    names = ["digest", "length", "offset", "prefix", "before", "copies", "copy", "bytes", "range", "hash", "at", "status"]
    rows = [(1, "http://h/1", "x" * 3_000_000), (2, None, None), (2, None, None), (None, "http://h/3", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", *(f"'x' as `{n}`" for n in names))
    laid = W.checkpointed(W.laid_out(pages.select(W.warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"), "page_id"), ["page_id"]))
    got = sorted((tuple(r) for r in laid.select("offset", "length", "page_id").collect()), key=lambda r: r[0])
    assert [a for a, _, _ in got] == [0, *(a + n for a, n, _ in got[:-1])] and max(n for _, n, _ in got) > 3_000_000
    replica = laid.select("offset", "length", F.when(F.col("page_id") == 1, F.sha2(F.lit("other"), 256)).otherwise(F.col("digest")).alias("digest"))
    long = next(a for a, n, _ in got if n > 3_000_000)
    assert [(r["offset"], r["status"]) for r in W.audit(laid.select("offset", "length", "digest"), replica).collect()] == [(long, "damaged")]
