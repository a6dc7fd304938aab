"""Cache tables as a log of Parquet commits.

``<root>/<table>/commit=<n>/model_name=<m>/*.parquet`` holds rows with an operation (U for
upsert, D for delete); ``<root>/_log/<n>`` is written last, and only then the commit
counts. One log serves all tables, so a commit over several tables is all or nothing.
The view of a table is the newest row per key. Only keys of the commits after the first
(the base) are aggregated; the base loses their keys by an anti-join, so neither its
vectors nor theirs are ever sorted or grouped. One writer at a time; the log entry is
created exclusively, so a second writer fails instead of overwriting.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import keep_first
from ..schemas import TABLES
from ..session import checkpoint_folder


def store_folder(spark: SparkSession) -> str:
    """A new folder for a store, beside the checkpoints that all executors share."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}"


class CacheStore:
    """The three cache tables under one folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/_log"))

    # -- the log

    def commits(self) -> list[tuple[int, dict]]:
        """(number, entry) of the commits that count: the last base and what follows it."""
        entries = []
        for n in self.numbers():
            stream = self._fs.open(self._path(f"{self.root}/_log/{n}"))
            try:
                entries.append((n, json.loads(bytes(stream.readAllBytes()).decode())))
            finally:
                stream.close()
        base = max((n for n, e in entries if e.get("base")), default=0)
        merged = {n for _, e in entries for n in e.get("replaces", ())}
        return [(n, e) for n, e in entries if n >= base and n not in merged]

    def numbers(self) -> list[int]:
        """All commits of the log, those before the last base too."""
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(self._path(f"{self.root}/_log")) if f.getPath().getName().isdigit())

    def _next(self) -> int:
        return max(self.numbers(), default=0) + 1

    def commit(self, changes: dict[str, DataFrame], base: bool = False, created_at: str | None = None, replaces: Sequence[int] = ()) -> int:
        """Writes rows (with ``op``) of several tables, then the log entry; it may stand for the commits that it ``replaces``."""
        n = self._next()
        for table, rows in changes.items():
            schema, key = TABLES[table]
            columns = [f.split()[0] for f in schema.split(", ")]
            stamp = F.lit(created_at) if created_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
            full = rows if "created_at" in rows.columns else rows.withColumn("created_at", stamp)
            for c in columns:
                if c not in full.columns:
                    full = full.withColumn(c, F.lit(None))
            kinds = dict(x.split(" ", 1) for x in schema.split(", "))
            full.select(*(F.col(c).cast(kinds[c]).alias(c) for c in columns), "op").write.mode("overwrite").partitionBy("model_name").parquet(f"{self.root}/{table}/commit={n}")
        out = self._fs.create(self._path(f"{self.root}/_log/{n}"), False)  # fails if another writer was there first
        out.write(bytearray(json.dumps({"tables": sorted(changes), "base": base, "replaces": list(replaces)}).encode()))
        out.close()
        return n

    # -- views

    def view(self, table: str, model: str | None = None) -> DataFrame:
        """The latest rows; with a model only its partition is read."""
        schema, key = TABLES[table]
        parts = []
        for n, entry in self.commits():
            if table in entry["tables"]:
                path = f"{self.root}/{table}/commit={n}"
                if any(f.getPath().getName().startswith("model_name=") for f in self._fs.listStatus(self._path(path))):
                    rows = self.spark.read.schema(f"{schema}, op string").parquet(path)
                    parts.append((rows.where(F.col("model_name") == model) if model is not None else rows).withColumn("_commit", F.lit(n)))
        columns = [f.split()[0] for f in schema.split(", ")]
        if not parts:
            return self.spark.createDataFrame([], schema)
        if len(parts) == 1:
            return parts[0].where("op = 'U'").select(*columns)
        # only keys of later commits are compared: what they replace in the first one, and which of them is the latest
        later = parts[1]
        for p in parts[2:]:
            later = later.unionByName(p)
        keys = ["model_name", key]
        newest = later.select(*keys, "_commit").groupBy(*keys).agg(F.max("_commit").alias("_commit"))
        every = parts[0].join(newest, keys, "left_anti").unionByName(later.join(newest, [*keys, "_commit"], "left_semi"))
        return every.where("op = 'U'").select(*columns)

    def _scans(self, table: str, model: str | None) -> list[DataFrame]:
        """Rows of each commit that counts, with ``op``, ``_commit`` and their place: ``_file`` and ``_row``."""
        schema, _ = TABLES[table]
        out = []
        for n, entry in self.commits():
            path = f"{self.root}/{table}/commit={n}"
            if table in entry["tables"] and any(f.getPath().getName().startswith("model_name=") for f in self._fs.listStatus(self._path(path))):
                rows = self.spark.read.schema(f"{schema}, op string").parquet(path).select("*", F.lit(n).alias("_commit"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
                out.append(rows.where(F.col("model_name") == model) if model is not None else rows)
        return out

    def positions(self, table: str, model: str | None = None, columns: Sequence[str] = ("last_modified", "file_size")) -> DataFrame | None:
        """(model_name, key, columns, _file, _row): the places of the latest rows, without reading a vector; None without rows."""
        scans = self._scans(table, model)
        if not scans:
            return None
        keys = ["model_name", TABLES[table][1]]
        every = [s.select(*keys, *columns, "op", "_commit", "_file", "_row") for s in scans]
        if len(every) == 1:
            return every[0].where("op = 'U'").drop("op", "_commit")
        rows = reduce(DataFrame.unionByName, every)
        last = F.max_by(F.struct(*columns, "op", "_file", "_row"), "_commit").alias("last")
        return rows.groupBy(*keys).agg(last).where("last.op = 'U'").select(*keys, "last.*").drop("op")

    def fetch(self, table: str, places: DataFrame, column: str, few: int = 1_000_000) -> DataFrame:
        """``places`` (with _file and _row) with ``column`` of the stored rows there.

        The stored rows stay where they are read if there are up to ``few`` places (counted);
        more are joined by a shuffle of the rows that Spark's runtime filter leaves.
        """
        scans = self._scans(table, None)
        stored = reduce(DataFrame.unionByName, [s.select("_file", "_row", column) for s in scans])
        return stored.join(F.broadcast(places) if places.count() <= few else places, ["_file", "_row"]).drop("_file", "_row")

    def size(self, numbers: Sequence[int]) -> int:
        """Bytes of these commits' files."""
        paths = [self._path(f"{self.root}/{t}/commit={n}") for n in numbers for t in TABLES]
        return sum(self._fs.getContentSummary(p).getLength() for p in paths if self._fs.exists(p))

    def merge(self) -> int:
        """Puts the commits after the first one together: of each key the latest row, deletions too. The first isn't read."""
        later = [n for n, _ in self.commits()[1:]]
        changes = {}
        for table, (_, key) in TABLES.items():
            scans = [s.where(F.col("_commit").isin(later)) for s in self._scans(table, None)]
            if not scans:
                continue
            rows = reduce(DataFrame.unionByName, scans).drop("_file", "_row")
            keys = ["model_name", key]
            newest = rows.groupBy(*keys).agg(F.max("_commit").alias("_commit"))
            changes[table] = rows.join(newest, [*keys, "_commit"], "left_semi").drop("_commit")
        return self.commit(changes, replaces=later)

    # -- mutations

    def upsert(self, table: str, rows: DataFrame, created_at: str | None = None) -> int:
        """Inserts or replaces by (model, key). Of one key's rows in a commit the last created stays, or one chosen by hash."""
        _, key = TABLES[table]
        if table == "archive_cache":
            fine = (F.col("page_count") > 0) & (F.size("pages") == F.col("page_count")) & F.forall("pages", lambda p: p.isNotNull())
            rows = rows.withColumn("page_count", F.when(F.coalesce(fine, F.lit(False)), F.col("page_count")).otherwise(F.raise_error(F.lit("page_count has to be positive and match the pages"))))
        else:
            rows = rows.withColumn("embedding", F.when(F.coalesce(F.size("embedding"), F.lit(0)) > 0, F.col("embedding")).otherwise(F.raise_error(F.lit("a cached vector has components"))))
        ties = [c for c in rows.columns if c not in ("model_name", key, "created_at")]
        last = [F.desc_nulls_last("created_at")] if "created_at" in rows.columns else []
        once = keep_first(rows, ["model_name", key], [*last, F.xxhash64(*ties)])
        return self.commit({table: once.withColumn("op", F.lit("U"))}, created_at=created_at)

    def delete(self, keys: dict[str, DataFrame]) -> int:
        """Deletes (model_name, key) rows of several tables in one commit."""
        return self.commit({t: k.select("model_name", TABLES[t][1]).withColumn("op", F.lit("D")) for t, k in keys.items()})

    def clear(self, model: str | None = None) -> int:
        """Deletes a model's rows, or all, from the three tables."""
        return self.delete({t: self.view(t, model).select("model_name", key) for t, (_, key) in TABLES.items()})
