"""Maintenance of the cache: compaction, vacuum, pruning, migration."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import COMIC_ARCHIVES, base_file_path, directory, file_name, has_extension, page_of_key, root
from ..operators.search import keep_first
from ..schemas import TABLES
from ..session import checkpointed
from ..sources.directories import GONE, connected_roots, file_states
from .store import CacheStore


def vacuum(store: CacheStore) -> int:
    """Rewrites the latest rows as one base commit; nothing changes before its log entry.

    Commits before the last base go, and those that have been merged. What led from that base to the new one stays until the
    next vacuum, for readers that planned with it.
    """
    counted = [n for n, _ in store.commits()]
    base = min(counted, default=0)
    merged = [n for n in store.numbers() if n > base and n not in counted]
    n = store.commit({t: store.view(t).withColumn("op", F.lit("U")) for t in TABLES}, base=True)
    for o in store.numbers():
        if o < base or o in merged:
            for t in TABLES:
                store._fs.delete(store._path(f"{store.root}/{t}/commit={o}"), True)
            store._fs.delete(store._path(f"{store.root}/_log/{o}"), True)
    return n


def optimize(store: CacheStore, most: int = 20) -> int | None:
    """Compacts once there are more than ``most`` commits; the rows stay the same.

    Only the commits after the base are put together, as long as they are a quarter of it at
    most; beyond that everything is rewritten. So a row is rewritten a few times, not with
    every round of small commits.
    """
    numbers = [n for n, _ in store.commits()]
    if len(numbers) <= most:
        return None
    return store.merge() if 4 * store.size(numbers[1:]) <= store.size(numbers[:1]) else vacuum(store)


def all_keys(store: CacheStore, model: str | None = None) -> DataFrame:
    """(base_path) of all three tables."""
    parts = [store.view(t, model).select(base_file_path(F.col(key)).alias("base_path")) for t, (_, key) in TABLES.items()]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


def missing_files(keys: DataFrame, listing: DataFrame, offline_roots: Iterable[str] = ()) -> DataFrame:
    """Base paths that a listing of their directories doesn't hold, names in either case.

    ``listing(file_path)`` covers the directories that exist. Paths without a root, or on a
    root that is offline, are never missing.
    """
    offline = [r.lower() for r in offline_roots]
    there = listing.select(F.lower(directory(F.col("file_path"))).alias("d"), F.lower(file_name(F.col("file_path"))).alias("n")).distinct()
    rooted = keys.withColumn("_r", root(F.col("base_path"))).where("_r <> ''")
    if offline:
        rooted = rooted.where(~F.lower("_r").isin(offline))
    named = rooted.withColumn("d", F.lower(directory(F.col("base_path")))).withColumn("n", F.lower(file_name(F.col("base_path"))))
    return named.join(there, ["d", "n"], "left_anti").select("base_path")


def prune_missing(store: CacheStore, model: str | None = None, offline_roots: Iterable[str] = (), listing: DataFrame | None = None) -> DataFrame:
    """Deletes the rows of files that are gone, in one commit; returns the missing base paths.

    What can't be looked at stays: files on a drive or mount that isn't connected, on a file
    system that isn't known here, or behind missing rights. Roots are looked at with each
    directory, and those of the missing files once more before anything is deleted. A
    ``listing`` of existing directories may stand for the file system, as in ``missing_files``.
    """
    keys = all_keys(store, model)
    if listing is None:
        offline = [r.lower() for r in offline_roots]
        gone = file_states(keys).where(F.col("state") == GONE).where(~F.lower(root(F.col("base_path"))).isin(offline)).select("base_path")
        missing = checkpointed(connected_roots(gone))
    else:
        missing = checkpointed(missing_files(keys, listing, offline_roots))
    if not missing.isEmpty():
        store.delete({t: store.view(t, model).withColumn("base_path", base_file_path(F.col(key))).join(missing, "base_path", "left_semi").select("model_name", key) for t, (_, key) in TABLES.items()})
    return missing


def migrated(legacy: DataFrame, markers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(archives, covers, rest) from legacy rows keyed ``path|page=n`` and (model_name, archive_path, page_count) markers.

    An archive is packed if a marker attests it and all its pages are there; pages beyond
    are ignored, and file data come from its first key. Comic paths without a page become
    covers. Other comic rows go; everything else stays.
    """
    rows = legacy.withColumn("archive_path", base_file_path(F.col("file_path"))).withColumn("page", page_of_key(F.col("file_path")))
    paged = F.lower("file_path").contains("|page=")
    marks = markers.select("model_name", "archive_path", "page_count").distinct()
    wanted = rows.where(paged & F.col("page").isNotNull()).join(marks, ["model_name", "archive_path"]).where("page >= 0 and page < page_count")
    first = F.min_by(F.struct("last_modified", "file_size", "created_at"), "file_path").alias("meta")
    packed = wanted.groupBy("model_name", "archive_path", "page_count").agg(F.count_distinct("page").alias("n"), first, F.array_sort(F.collect_list(F.struct("page", "embedding"))).alias("p"))
    archives = packed.where("n = page_count").select("model_name", "archive_path", F.col("page_count").cast("int").alias("page_count"), "meta.last_modified", "meta.file_size", F.transform("p", lambda x: x["embedding"]).alias("pages"), "meta.created_at")
    comic = has_extension(F.col("file_path"), COMIC_ARCHIVES)
    covers = rows.where(~paged & comic).select("model_name", "archive_path", "last_modified", "file_size", "embedding", "created_at")
    return archives, covers, rows.where(~paged & ~comic).select(*legacy.columns)


def migrate(store: CacheStore, markers: DataFrame | None) -> bool:
    """Moves legacy rows of the file table into the archive and cover tables in one commit; idempotent."""
    if markers is None or not (store.view("archive_cache").isEmpty() and store.view("cover_cache").isEmpty()):
        return False
    legacy = store.view("file_cache")
    archives, covers, rest = migrated(legacy, markers)
    gone = legacy.join(rest, ["model_name", "file_path"], "left_anti")
    if gone.isEmpty():
        return False
    up = lambda d: d.withColumn("op", F.lit("U"))
    store.commit({"archive_cache": up(archives), "cover_cache": up(keep_first(covers, ["model_name", "archive_path"], ["created_at"])), "file_cache": gone.withColumn("op", F.lit("D"))})
    return True


def open_store(spark: SparkSession, root: str, markers: DataFrame | None = None) -> CacheStore:
    """The store at ``root``, migrated before anyone reads it."""
    store = CacheStore(spark, root)
    migrate(store, markers)
    return store
