from datetime import datetime, timedelta

from embera.plans.encoding import HashingEncoder
from embera.plans.store import CacheStore
from embera.streaming.ingest import cache_stream, conflict_stream

NOON = datetime(2024, 1, 1, 12)


def test_cache_stream(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i}", "t", i, bytes([i])) for i in range(1, 4)], "file_path string, last_modified string, file_size long, content binary")
    rows.write.parquet(str(tmp_path / "in"))
    store = CacheStore(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    cache_stream(stream, store, HashingEncoder(4), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["file_path"] for r in store.view("file_cache").collect()) == ["f1", "f2", "f3"]


def test_conflict_stream(spark, tmp_path):
    kind = "id long, path string, class string, created timestamp, k string"
    batches = [[(1, "a", "cat", NOON, "k"), (2, "b", "dog", NOON + timedelta(seconds=30), "k")], [(3, "c", "cat", NOON + timedelta(hours=2), "k")], [(4, "d", "cat", NOON + timedelta(hours=4), "k")]]
    for b in batches:
        spark.createDataFrame(b, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        q = conflict_stream(stream, 1.0, "k").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["first_id"], r["n"], sorted(r["classes"])) for r in got] == [(1, 2, ["cat", "dog"])]
