"""Cache queries. ``orders`` stands for the cache and ``lineitem`` for the probed files: a path is an
order's key, its size is derived from the key, and every 20th cached entry is stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import base_file_path, page_of_key, root
from ..operators import probe, routing
from ..operators.search import in_input_order, keep_first
from ..plans.encoding import complete_archives
from ..plans.maintenance import migrated, missing_files
from ..plans.store import CacheStore, store_folder
from ..sources.containers import ordered_entries
from ..sources.directories import file_states


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _path(c: str):
    return F.concat(F.lit("t/p"), F.col(c).cast("string"), F.lit(".jpg"))


def _size(c: str):
    return F.lit(100000).cast("long") + F.pmod(F.col(c), F.lit(40000))


def _cache(spark, d):
    """One cached file per order whose key isn't 50 modulo 100; each 20th key with an old time."""
    o = _t(spark, d, "orders").where(F.pmod("o_orderkey", F.lit(100)) != 50)
    old = F.when(F.pmod("o_orderkey", F.lit(20)) == 15, "2020-01-01T00:00:00Z").otherwise("2024-01-01T00:00:00Z")
    return o.select(_path("o_orderkey").alias("file_path"), old.alias("last_modified"), _size("o_orderkey").alias("file_size"))


def _probe(spark, d):
    """Every file that a line item names, once."""
    l = _t(spark, d, "lineitem").select("l_orderkey").distinct()  # noqa: E741
    return l.select(_path("l_orderkey").alias("file_path"), F.lit("2024-01-01T00:00:00Z").alias("last_modified"), _size("l_orderkey").alias("file_size"))


def cache_probe_status(spark, d):
    return probe.probe_status(_probe(spark, d), _cache(spark, d)).select("file_path", "status")


def _variant(hint):
    return lambda spark, d: probe.probe_status(_probe(spark, d), _cache(spark, d), hint, unique=True).groupBy("status").agg(F.count("*").alias("n"))


def cache_probe_semi(spark, d):
    return probe.probe_fresh(_probe(spark, d), _cache(spark, d)).agg(F.count("*").alias("n"))


def cache_hit_rate(spark, d):
    return probe.hit_rate(probe.probe_status(_probe(spark, d), _cache(spark, d))).withColumn("hit_percent", F.round("hit_percent", 6))


def cache_info(spark, d):
    """Every event is an entry of one of the three caches, by the place of its type."""
    e = _t(spark, d, "events").select(F.concat(F.lit("M"), F.pmod("user_id", F.lit(3)).cast("string")).alias("model_name"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "event_type")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # a handful
    files, archives, covers = (e.where(F.col("event_type").isin(kinds[i::3])) for i in range(3))
    return probe.cache_info(files, archives, covers)


def cache_diagnostics(spark, d):
    e = _t(spark, d, "events")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.pmod("event_id", F.lit(7)) == 0, "+02:00").otherwise("Z"))
    return probe.cache_diagnostics(e.select(F.col("event_type").alias("model_name"), F.concat(F.lit("f"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("file_path"), stamp.alias("last_modified")))


def upsert_latest(spark, d):
    """The newest version of each key; events are versions of their user's row."""
    e = _t(spark, d, "events")
    return keep_first(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


def store_versions(spark, d):
    """Events go through a stored cache: those of each type replace the users' rows in turn, a commit each; the
    users that 7 divides are deleted at the end, and the view is what is left."""
    e = _t(spark, d, "events")
    store = CacheStore(spark, store_folder(spark))
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # a handful
    path = F.concat(F.lit("u/"), F.col("user_id").cast("string"), F.lit(".jpg"))
    for kind in kinds:
        mine = keep_first(e.where(F.col("event_type") == kind), ["user_id"], [F.desc("ts"), F.desc("event_id")])
        store.upsert("file_cache", mine.select(F.lit("m").alias("model_name"), path.alias("file_path"), F.col("event_type").alias("last_modified"), F.col("event_id").alias("file_size"), F.array(F.col("value").cast("float") + 1).alias("embedding")))
    gone = e.where(F.pmod("user_id", F.lit(7)) == 0).select(F.lit("m").alias("model_name"), path.alias("file_path")).distinct()
    store.delete({"file_cache": gone})
    return store.view("file_cache", "m").select("file_path", F.col("last_modified").alias("event_type"), F.col("file_size").alias("event_id"))


def input_order(spark, d):
    """The number of events of a user, for each event in the order of its time."""
    e = _t(spark, d, "events")
    counts = e.where(F.pmod("user_id", F.lit(3)) != 0).groupBy("user_id").agg(F.count("*").alias("n"))
    return in_input_order(counts, e, "user_id", "event_id")


def archive_complete_pack(spark, d):
    """Conversations as archives, turns as pages; the last turn of each third one is missing."""
    c = _t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("archive_path"), F.col("turn").cast("int").alias("page_index"), F.length("text").alias("size"), "conv_id")
    n = c.groupBy("archive_path").agg((F.max("page_index") + 1).alias("page_count"))
    pages = c.join(n, "archive_path").where(~((F.pmod("conv_id", F.lit(3)) == 0) & (F.col("page_index") == F.col("page_count") - 1)))
    rows = pages.select("archive_path", "page_index", "page_count", F.lit("t").alias("last_modified"), F.lit(1).cast("long").alias("file_size"), F.array((F.col("size") + 1).cast("float")).alias("embedding"))
    return complete_archives(rows).select("archive_path", "page_count", F.array_join(F.transform("pages", lambda p: F.get(p, F.lit(0)).cast("int").cast("string")), ",").alias("pages"))


def migration_pack(spark, d):
    """Legacy rows keyed ``path|page=n``; every fourth archive has no marker, every fifth lacks page 0."""
    c = _t(spark, d, "conversations").where(~((F.pmod("conv_id", F.lit(5)) == 0) & (F.col("turn") == 0)))
    name = F.concat(F.lit("comics/c"), F.col("conv_id").cast("string"), F.lit(".cbz"))
    legacy = c.select(F.lit("clip").alias("model_name"), F.concat(name, F.lit("|page="), F.col("turn").cast("string")).alias("file_path"), F.lit("t").alias("last_modified"), F.lit(1).cast("long").alias("file_size"), F.array(F.length("text").cast("float")).alias("embedding"), F.lit("now").alias("created_at"))
    marks = _t(spark, d, "conversations").where(F.pmod("conv_id", F.lit(4)) != 0).groupBy("conv_id").agg((F.max("turn") + 1).cast("int").alias("page_count")).select(F.lit("clip").alias("model_name"), name.alias("archive_path"), "page_count")
    archives, _, _ = migrated(legacy, marks)
    return archives.select("archive_path", "page_count", F.size("pages").alias("n_pages"), F.aggregate("pages", F.lit(0.0), lambda s, p: s + F.get(p, F.lit(0))).cast("long").alias("sum"))


def prune_anti_join(spark, d):
    """Page addresses as cached keys; those of page_id 3 modulo 7 are gone, and one host is offline."""
    p = _t(spark, d, "pages")
    keys = p.select(base_file_path(F.concat("url", F.lit("|page=1"))).alias("base_path")).distinct()
    offline = [r[0] for r in p.select(F.lower(root(F.col("url")))).orderBy("page_id").limit(1).collect()]
    return missing_files(keys, p.where(F.pmod("page_id", F.lit(7)) != 3).select(F.col("url").alias("file_path")), offline)


def prune_states(spark, d):
    """Every order names a file: a table of the folder, one that isn't beside it, one in a folder that isn't
    there, and three that can't be looked at; the directories are listed for real."""
    k = F.col("o_orderkey").cast("string")
    kind = F.pmod("o_orderkey", F.lit(6)).cast("int")
    names = F.array(F.lit(f"{d}/orders.parquet"), F.concat(F.lit(f"{d}/gone"), k, F.lit(".jpg")), F.concat(F.lit(f"{d}/nodir"), F.pmod("o_orderkey", F.lit(97)).cast("string"), F.lit("/"), k), F.concat(F.lit("J:\\pics\\"), k), F.concat(F.lit("none://bucket/"), k), F.concat(F.lit("loose"), k))
    keys = _t(spark, d, "orders").select(kind.alias("kind"), F.get(names, kind).alias("base_path")).distinct()
    return keys.join(file_states(keys), "base_path").groupBy("kind", "state").agg(F.count("*").alias("n"))


def root_histogram(spark, d):
    return routing.root_histogram(_t(spark, d, "pages").withColumn("root", root(F.col("url"))), "root")


def page_order(spark, d):
    """Order of entries by upper-cased file name, then place."""
    p = _t(spark, d, "pages").select(root(F.col("url")).alias("archive"), "url", "page_id")
    return ordered_entries(p, "archive", "url", "page_id").select("page_id", "page_index")


def page_suffix(spark, d):
    c = _t(spark, d, "conversations")
    tail = F.when(F.pmod("conv_id", F.lit(9)) == 0, F.lit("x")).otherwise(F.lit(""))
    key = F.concat(F.lit("a/"), F.col("conv_id").cast("string"), F.lit(".cbr|page="), F.col("turn").cast("string"), tail)
    return c.select("conv_id", "turn", base_file_path(key).alias("base_path"), page_of_key(key).alias("page"))


_NAMES = (cache_probe_status, cache_probe_semi, cache_hit_rate, cache_info, cache_diagnostics, upsert_latest, store_versions, input_order, archive_complete_pack, migration_pack, prune_anti_join, prune_states, root_histogram, page_order, page_suffix)
QUERIES = {f.__name__: f for f in _NAMES} | {f"cache_probe_{h}": _variant(h) for h in ("broadcast", "merge", "shuffle_hash")}

_P = """WITH c AS (SELECT 't/p' || o_orderkey || '.jpg' AS path, CASE WHEN o_orderkey % 20 = 15 THEN '2020-01-01T00:00:00Z' ELSE '2024-01-01T00:00:00Z' END AS m, 100000 + o_orderkey % 40000 AS s FROM orders WHERE o_orderkey % 100 <> 50),
p AS (SELECT DISTINCT 't/p' || l_orderkey || '.jpg' AS path, '2024-01-01T00:00:00Z' AS m, 100000 + l_orderkey % 40000 AS s FROM lineitem),
j AS (SELECT p.path AS file_path, CASE WHEN c.path IS NULL THEN 'miss' WHEN c.m = p.m AND c.s = p.s THEN 'hit' ELSE 'stale' END AS status FROM p LEFT JOIN c USING (path))"""
_ROOT = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]+://[^/]*)', 1)"
ORACLES = {
    "cache_probe_status": f"{_P} SELECT file_path, status FROM j",
    **{f"cache_probe_{h}": f"{_P} SELECT status, count(*) AS n FROM j GROUP BY status" for h in ("broadcast", "merge", "shuffle_hash")},
    "cache_probe_semi": f"{_P} SELECT count(*) AS n FROM j WHERE status = 'hit'",
    "cache_hit_rate": f"{_P} SELECT count(*) AS total, count(*) FILTER (status = 'hit') AS hits, count(*) FILTER (status <> 'hit') AS misses, round(count(*) FILTER (status = 'hit') * 100.0::DOUBLE / count(*), 6) AS hit_percent FROM j",
    "cache_info": """WITH k AS (SELECT event_type, (row_number() OVER (ORDER BY event_type) - 1) % 3 AS i FROM (SELECT DISTINCT event_type FROM events)),
e AS (SELECT i, 'm' || user_id % 3 AS m, strftime(ts, '%Y-%m-%d %H:%M:%S') AS c FROM events JOIN k USING (event_type))
SELECT count(*) AS total, count(*) FILTER (i = 0) AS files, count(*) FILTER (i = 1) AS archives, count(*) FILTER (i = 2) AS covers, (SELECT string_agg(m, ', ' ORDER BY m) FROM (SELECT DISTINCT m FROM e)) AS models, min(c) AS oldest, max(c) AS newest FROM e""",
    "cache_diagnostics": "SELECT event_type AS model_name, count(*) AS n, 'f' || lpad(CAST(min(event_id) AS VARCHAR), 12, '0') AS first_path, 'f' || lpad(CAST(max(event_id) AS VARCHAR), 12, '0') AS last_path, count(*) FILTER (event_id % 7 = 0) AS not_utc FROM events GROUP BY event_type",
    "upsert_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "store_versions": "SELECT 'u/' || user_id || '.jpg' AS file_path, event_type, event_id FROM events WHERE user_id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type DESC, ts DESC, event_id DESC) = 1",
    "input_order": "SELECT e.event_id, e.user_id, c.n FROM events e LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE user_id % 3 <> 0 GROUP BY user_id) c ON e.user_id = c.user_id",
    "archive_complete_pack": "SELECT CAST(conv_id AS VARCHAR) AS archive_path, CAST(max(turn) + 1 AS INTEGER) AS page_count, string_agg(CAST(length(text) + 1 AS VARCHAR), ',' ORDER BY turn) AS pages FROM conversations GROUP BY conv_id HAVING conv_id % 3 <> 0 AND count(DISTINCT turn) = max(turn) + 1",
    "migration_pack": "SELECT 'comics/c' || conv_id || '.cbz' AS archive_path, CAST(max(turn) + 1 AS INTEGER) AS page_count, CAST(count(*) AS INTEGER) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS sum FROM conversations GROUP BY conv_id HAVING conv_id % 5 <> 0 AND conv_id % 4 <> 0 AND count(DISTINCT turn) = max(turn) + 1",
    "prune_anti_join": f"""WITH o AS (SELECT {_ROOT} AS r FROM pages ORDER BY page_id LIMIT 1), k AS (SELECT DISTINCT url, {_ROOT} AS r FROM pages),
here AS (SELECT DISTINCT lower(url) AS u FROM pages WHERE page_id % 7 <> 3)
SELECT url AS base_path FROM k WHERE lower(r) NOT IN (SELECT lower(r) FROM o) AND lower(url) NOT IN (SELECT u FROM here)""",
    "prune_states": "SELECT CAST(o_orderkey % 6 AS INTEGER) AS kind, CASE WHEN o_orderkey % 6 = 0 THEN 'there' WHEN o_orderkey % 6 < 3 THEN 'gone' ELSE 'unknown' END AS state, CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE count(DISTINCT o_orderkey) END AS n FROM orders GROUP BY o_orderkey % 6",
    "root_histogram": f"SELECT {_ROOT} AS root, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, root LIMIT 5",
    "page_order": f"SELECT page_id, CAST(row_number() OVER (PARTITION BY {_ROOT} ORDER BY upper(regexp_extract(url, '([^/\\\\]*)$', 1)), page_id) - 1 AS INTEGER) AS page_index FROM pages",
    "page_suffix": "SELECT conv_id, turn, 'a/' || conv_id || '.cbr' AS base_path, CASE WHEN conv_id % 9 <> 0 THEN CAST(turn AS INTEGER) END AS page FROM conversations",
}
