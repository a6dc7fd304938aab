"""The cache probe: which files have a fresh vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FRESH = ("last_modified", "file_size")


def first_probes(probe: DataFrame, order: str | None = None) -> DataFrame:
    """One row per path: the first in ``order`` (else by the freshness key)."""
    w = Window.partitionBy("file_path").orderBy(*([order] if order else FRESH))
    return probe.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Bytes of a cache's rows up to which a broadcast hint is followed; the driver takes several times as much to build their table.
BROADCAST = 32 << 20
#: Bytes of a row besides its texts and vectors: pointers, lengths, the key of a hash table.
ROW = 64


def _row_bytes(df: DataFrame) -> int:
    """Bytes of all rows, measured in one pass; the estimate that Spark makes of compressed files is many times less."""
    own = lambda c, kind: F.octet_length(c) if kind in ("string", "binary") else F.size(c) * 8 if kind.startswith("array") else F.lit(8)
    each = sum((F.coalesce(own(F.col(c), kind), F.lit(0)) for c, kind in df.dtypes), F.lit(ROW))
    return df.agg(F.sum(each).alias("bytes")).first()["bytes"] or 0


def _hinted(cache: DataFrame, hint: str | None) -> DataFrame:
    """``cache`` with a join hint; one that asks for a broadcast counts only if the cache is small enough, by Spark's estimate and then as measured."""
    if hint is None or (hint == "broadcast" and (int(str(cache._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > BROADCAST or _row_bytes(cache) > BROADCAST)):
        return cache
    return cache.hint(hint)


def probe_status(probe: DataFrame, cache: DataFrame, hint: str | None = None, unique: bool = False, order: str | None = None) -> DataFrame:
    """Every probed path once, with ``status`` (hit, stale, miss) and its vector if fresh.

    Of a path that is probed several times the first entry counts (in ``order``); a probe
    whose paths are ``unique``, like a listing, is spared the shuffle for that. Paths compare
    exactly, and so do modification text and size. The join strategy is left to Spark's
    measured sizes unless a hint names one.
    """
    probe = probe if unique else first_probes(probe, order)
    cached = cache.select("file_path", F.col("last_modified").alias("_m"), F.col("file_size").alias("_s"), F.lit(True).alias("_there"), *(["embedding"] if "embedding" in cache.columns else []))
    joined = probe.join(_hinted(cached, hint), "file_path", "left")
    fresh = F.col("_m").eqNullSafe(F.col("last_modified")) & F.col("_s").eqNullSafe(F.col("file_size"))
    out = joined.withColumn("status", F.when(F.col("_there").isNull(), "miss").when(fresh, "hit").otherwise("stale"))
    if "embedding" in cache.columns:
        out = out.withColumn("embedding", F.when(F.col("status") == "hit", F.col("embedding")))
    return out.drop("_m", "_s", "_there")


def probe_fresh(probe: DataFrame, cache: DataFrame, hint: str | None = None) -> DataFrame:
    """Only the fresh ones, as a semi-join on path, modification text and size."""
    keys = cache.select("file_path", *FRESH)
    return probe.join(_hinted(keys, hint), ["file_path", *FRESH], "left_semi")


def archive_status(probe: DataFrame, cache: DataFrame) -> DataFrame:
    """Archives by hit, stale, miss, or inconsistent: a page count that isn't that of its vectors."""
    c = cache.select(F.col("archive_path").alias("file_path"), F.col("last_modified").alias("_m"), F.col("file_size").alias("_s"), F.col("page_count").alias("_n"), "pages")
    j = probe.join(c, "file_path", "left")
    fresh = F.col("_m").eqNullSafe(F.col("last_modified")) & F.col("_s").eqNullSafe(F.col("file_size"))
    status = F.when(F.col("_n").isNull(), "miss").when(~fresh, "stale").when(F.coalesce(F.size("pages"), F.lit(-1)) != F.col("_n"), "inconsistent").otherwise("hit")
    return j.withColumn("status", status).withColumn("pages", F.when(F.col("status") == "hit", F.col("pages"))).drop("_m", "_s", "_n")


def split_hits(probed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of a probe with vectors."""
    return probed.where("status = 'hit'"), probed.where("status <> 'hit'").drop("embedding")


def hit_rate(probed: DataFrame) -> DataFrame:
    hits = F.count_if(F.col("status") == "hit")
    return probed.agg(F.count("*").alias("total"), hits.alias("hits"), (F.count("*") - hits).alias("misses"), F.when(F.count("*") > 0, hits * 100.0 / F.count("*")).otherwise(0.0).alias("hit_percent"))


def cache_info(files: DataFrame, archives: DataFrame, covers: DataFrame) -> DataFrame:
    """One row over the three caches: totals, models and ages; an archive counts as one entry.

    Ages are compared as times; texts that are none are left out of them.
    """
    part = lambda d, kind: d.select("model_name", "created_at", F.lit(kind).alias("kind"))
    every = part(files, "file").unionByName(part(archives, "archive")).unionByName(part(covers, "cover"))
    time = F.try_to_timestamp("created_at")
    aged = F.when(time.isNotNull(), F.struct(time.alias("time"), "created_at"))
    by = every.groupBy("model_name", "kind").agg(F.count("*").alias("n"), F.min(aged).alias("oldest"), F.max(aged).alias("newest"))
    models = F.array_join(F.sort_array(F.collect_set(F.lower("model_name"))), ", ")
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    whole = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), count("file").alias("files"), count("archive").alias("archives"), count("cover").alias("covers"), models.alias("models"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest"))
    return whole.select("total", "files", "archives", "covers", "models", F.col("oldest.created_at").alias("oldest"), F.col("newest.created_at").alias("newest"))


def cache_diagnostics(cache: DataFrame) -> DataFrame:
    """Per model: rows, first and last key, and rows whose modification text isn't in UTC."""
    return cache.groupBy("model_name").agg(F.count("*").alias("n"), F.min("file_path").alias("first_path"), F.max("file_path").alias("last_path"), F.count_if(~F.endswith("last_modified", F.lit("Z"))).alias("not_utc"))


def diagnostics_sample(probe: DataFrame, cache: DataFrame, most: int = 12) -> DataFrame:
    """(file_path, status, last_modified, cached_modified, file_size, cached_size) of the first ``most`` probed paths."""
    some = first_probes(probe.orderBy("file_path").limit(most))
    cached = cache.select("file_path", F.col("last_modified").alias("cached_modified"), F.col("file_size").alias("cached_size"))
    there = some.join(cached, "file_path", "left")
    fresh = F.col("cached_modified").eqNullSafe(F.col("last_modified")) & F.col("cached_size").eqNullSafe(F.col("file_size"))
    status = F.when(F.col("cached_modified").isNull() & F.col("cached_size").isNull(), "miss").when(fresh, "fresh").otherwise("stale")
    return there.select("file_path", status.alias("status"), "last_modified", "cached_modified", "file_size", "cached_size").orderBy("file_path")
