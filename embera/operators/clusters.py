"""k-means on feature vectors, silhouette, and the choice of k."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import euclidean, vector_literal
from ..session import checkpointed

#: Measured points that one block of pairwise distances holds, rows that meet it in one task, and how many of both are multiplied at once.
BLOCK, PART, STEP = 30_000, 30_000, 1000


def assign_nearest(df: DataFrame, centroids: Sequence[Sequence[float]], vector_col: str = "features") -> DataFrame:
    """``df`` with ``cluster``: the nearest centroid, the lowest number on ties.

    Centroids are k rows and stand in the plan as literals.
    """
    distances = F.array(*(euclidean(F.col(vector_col), vector_literal(c)) for c in centroids))
    return df.withColumn("_d", distances).withColumn("cluster", (F.array_position("_d", F.array_min("_d")) - 1).cast("int")).drop("_d")


def centroid_means(df: DataFrame, cluster_col: str = "cluster", vector_col: str = "features") -> DataFrame:
    """(cluster, centroid): means by component; sums are pre-aggregated per task."""
    long = df.select(F.col(cluster_col).alias("cluster"), F.posexplode(F.col(vector_col).cast("array<double>")).alias("pos", "x"))
    by = long.groupBy("cluster", "pos").agg(F.avg("x").alias("mean"))
    return by.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("centroid"))


def _cluster_sums(many: list[np.ndarray]):
    """For each set of centroids: sums by component and numbers of the rows nearest to each, per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = [np.zeros_like(c) for c in many], [np.zeros(len(c), dtype=np.int64) for c in many]
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(float)
            for c, total, n in zip(many, sums, counts, strict=True):
                near = np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1).argmin(axis=1)  # the lowest number on ties
                np.add.at(total, near, x)
                n += np.bincount(near, minlength=len(c))
        for i, (total, n) in enumerate(zip(sums, counts, strict=True)):
            k, width = total.shape
            yield pd.DataFrame({"set": i, "cluster": np.repeat(np.arange(k), width), "pos": np.tile(np.arange(width), k), "total": total.ravel(), "n": np.repeat(n, width)})

    return run


def lloyd_many(df: DataFrame, inits: Sequence[Sequence[Sequence[float]]], max_iterations: int = 100, vector_col: str = "features") -> list[list[list[float]]]:
    """Lloyd's rounds from several sets of centroids at once, until all stay; an empty cluster keeps its centroid.

    A round is one pass: sums by set, cluster and component are added up per task and then by
    Spark, and only centroids come to the driver.
    """
    now = [np.array(c, dtype=float) for c in inits]
    rows = df.where(F.col(vector_col).isNotNull()).select(F.col(vector_col).cast("array<double>").alias("v"))
    todo = list(range(len(now)))
    for _ in range(max_iterations):
        if not todo:
            break
        got = rows.mapInPandas(_cluster_sums([now[i] for i in todo]), "set int, cluster int, pos int, total double, n long")
        got = got.groupBy("set", "cluster", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0").collect()
        new = {i: now[i].copy() for i in todo}
        for r in got:
            new[todo[r["set"]]][r["cluster"], r["pos"]] = r["total"] / r["n"]
        still = [i for i in todo if not np.allclose(new[i], now[i], rtol=1e-12, atol=0)]
        for i in todo:
            now[i] = new[i]
        todo = still
    return [c.tolist() for c in now]


def lloyd(df: DataFrame, init: Sequence[Sequence[float]], max_iterations: int = 100, vector_col: str = "features") -> tuple[DataFrame, list[list[float]]]:
    """(rows with ``cluster``, centroids) by Lloyd's rounds from given centroids."""
    centroids = lloyd_many(df, [init], max_iterations, vector_col)[0]
    return assign_nearest(df, centroids, vector_col), centroids


def plus_plus(df: DataFrame, k: int, seed: int = 42, vector_col: str = "features") -> list[list[float]]:
    """k-means++ starting centroids, drawn over all different vectors; fewer if there are fewer.

    A vector's chance is the square of its distance to the nearest centroid so far, times its
    count. Each draw is a distributed one (the smallest of -log(u) / chance, u a hash of the
    vector), so groups of copies and small clusters count as what they are.
    """
    v = F.col(vector_col).cast("array<double>")
    points = df.where(v.isNotNull()).select(v.alias("v")).groupBy("v").agg(F.count("*").alias("n")).persist()
    chosen: list[list[float]] = []
    while len(chosen) < k:
        near = F.least(*d) if len(d := [euclidean(F.col("v"), vector_literal(c)) for c in chosen]) > 1 else d[0] if d else F.lit(1.0)
        u = (F.pmod(F.xxhash64("v", F.lit(seed), F.lit(len(chosen))), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        best = points.withColumn("chance", near * near * F.col("n")).where("chance > 0").orderBy(-F.log(u) / F.col("chance"), "v").select("v").limit(1).collect()
        if not best:
            break
        chosen.append(list(best[0]["v"]))
    points.unpersist()
    return chosen


def kmeans(df: DataFrame, k: int, max_iterations: int = 100, seed: int = 42, vector_col: str = "features") -> tuple[DataFrame, list[list[float]]]:
    """(rows with ``cluster``, centroids); k is cut to the number of points."""
    init = plus_plus(df, k, seed, vector_col)
    if not init:
        return df.withColumn("cluster", F.lit(None).cast("int")), []
    return lloyd(df, init, max_iterations, vector_col)


#: Members in one row of the inverted index.
CHUNK = 10_000


def members(assigned: DataFrame, id_col: str, cluster_col: str = "cluster") -> DataFrame:
    """(cluster, part, n, members): the inverted index, members in order inside a part.

    A cluster of up to about CHUNK members is one part (0); a larger one is dealt into more
    by hash, so that no row and no task holds a whole large cluster.
    """
    rows = assigned.select(F.col(cluster_col).alias("cluster"), F.col(id_col).alias("id"))
    parts = rows.groupBy(F.col("cluster").alias("c")).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    dealt = rows.join(parts, rows.cluster.eqNullSafe(parts.c)).select("cluster", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "id")
    return dealt.groupBy("cluster", "part").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("members"))


class _Sums:
    """Distances of a block's measured points to rows of each cluster of each labelling, added up as rows stream by.

    A column stands for each cluster of each labelling that was seen; sums over clusters are
    products with their 0/1 columns.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[order], points[order]
        self.squares = (self.points**2).sum(axis=1)
        self.at: dict[tuple[int, int], int] = {}
        self.totals, self.counts = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), dtype=np.int64)

    def _columns(self, clusters: np.ndarray) -> np.ndarray:
        """0/1 by row and column; a row without a cluster (NaN) in a labelling counts in none of it."""
        marks = []
        for labelling, of in enumerate(clusters.T):
            for c in np.unique(of[~np.isnan(of)]).tolist():
                marks.append((self.at.setdefault((labelling, int(c)), len(self.at)), of == c))
        if more := len(self.at) - self.totals.shape[1]:
            self.totals, self.counts = (np.hstack([x, np.zeros((len(self.ids), more), dtype=x.dtype)]) for x in (self.totals, self.counts))
        out = np.zeros((len(clusters), len(self.at)))
        for column, rows in marks:
            out[rows, column] = 1
        return out

    def add(self, own: np.ndarray, clusters: np.ndarray, x: np.ndarray) -> None:
        columns, far = self._columns(clusters), (x**2).sum(axis=1)
        lo, hi = np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, side="right")
        same = np.repeat(np.arange(len(own)), hi - lo)  # measured points (by place) that are a row themselves
        place = np.arange(len(same)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[same]
        self.counts += columns.sum(axis=0).astype(np.int64)
        np.subtract.at(self.counts, place, columns[same].astype(np.int64))
        for i in range(0, len(self.ids), STEP):
            part = slice(i, i + STEP)
            d = self.points[part] @ x.T
            d *= -2
            d += self.squares[part, None]
            d += far
            mine = (place >= i) & (place < i + STEP)
            d[place[mine] - i, same[mine]] = np.inf
            if d.min() <= 1e-6 * (self.squares[part].max() + far.max()):  # else the product has digits enough everywhere
                for a, b in zip(*np.nonzero(d <= 1e-6 * (self.squares[part, None] + far)), strict=True):
                    d[a, b] = ((self.points[i + a] - x[b]) ** 2).sum()
            d[place[mine] - i, same[mine]] = 0
            self.totals[part] += np.sqrt(d, out=d) @ columns

    def rows(self) -> Iterator[pa.RecordBatch]:
        for (labelling, c), at in self.at.items():
            n = len(self.ids)
            yield pa.RecordBatch.from_arrays([pa.array(self.ids), pa.array(np.full(n, labelling, dtype=np.int32)), pa.array(np.full(n, c)), pa.array(self.totals[:, at]), pa.array(self.counts[:, at])], names=["id", "labelling", "other", "total", "n"])


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows; null items are NaN."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    width = len(flat) // len(lists) if len(lists) else 0
    if pc.any(pc.not_equal(pc.list_value_length(lists), width)).as_py():
        raise ValueError("vectors of different lengths have no distance")
    return flat.reshape(len(lists), width)


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells (block, part) one after another, measured points first; the other rows stream by."""
    key, left, sums = None, [], None
    for batch in batches:
        cell = np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)], axis=1)  # block, part, side
        cuts = [0, *(np.nonzero((cell[1:] != cell[:-1]).any(axis=1))[0] + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            block, part, side = cell[lo].tolist()
            if (block, part) != key:
                if sums:
                    yield from sums.rows()
                key, left, sums = (block, part), [], None
            ids, clusters, points = batch.column(3).slice(lo, hi - lo).to_numpy(), _matrix(batch.column(4).slice(lo, hi - lo)), _matrix(batch.column(5).slice(lo, hi - lo))
            if not side:
                left.append((ids, points))
            elif left or sums:
                if sums is None:
                    sums, left = _Sums(np.concatenate([x[0] for x in left]), np.concatenate([x[1] for x in left])), []
                for i in range(0, hi - lo, STEP):
                    sums.add(ids[i : i + STEP], clusters[i : i + STEP], points[i : i + STEP])
    if sums:
        yield from sums.rows()


def silhouettes_of(df: DataFrame, id_col: str, clusters_col: str = "clusters", vector_col: str = "features", at: DataFrame | None = None) -> DataFrame:
    """(id, labelling, cluster, silhouette) by Euclidean distance, for several labellings in one pass; points alone
    in their cluster are left out.

    ``clusters_col`` is an array of a row's cluster in each labelling; a null one is in none.
    Null vectors have no distance and count for nothing. All other rows count for the
    distances, which are computed once. The points that are measured (``at``, a table of
    their ids; all, if none) are cut into blocks of about BLOCK, all rows into parts of PART
    at most, and a task has one block and one part, whose rows stream by: its work and memory
    are bounded, whatever the table. Sums per point and cluster come out, never pairs. The
    number of tasks grows with the square of the rows, as the distances do.
    """
    spark = df.sparkSession
    vectors = F.col(vector_col) if df.schema[vector_col].dataType.simpleString() == "array<float>" else F.col(vector_col).cast("array<double>")  # floats move as they are
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(clusters_col).cast("array<long>").alias("clusters"), vectors.alias("v")).where("v is not null")
    chosen = rows if at is None else rows.join(at.select(F.col(id_col).cast("long").alias("id")), "id", "left_semi")
    n = rows.count()
    blocks = max(1, -(-(n if at is None else chosen.count()) // BLOCK))
    parts = max(1, -(-n // PART), -(-2 * spark.sparkContext.defaultParallelism // blocks))  # few blocks: several tasks share one
    own = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = chosen.select(own(blocks, 1).alias("block"), each(parts).alias("part"), F.lit(0).alias("side"), "id", "clusters", "v")
    right = rows.select(each(blocks).alias("block"), own(parts, 2).alias("part"), F.lit(1).alias("side"), "id", "clusters", "v")
    both = left.union(right).repartitionById(blocks * parts, F.col("block") * parts + F.col("part")).sortWithinPartitions("block", "part", "side")
    sums = both.mapInArrow(_block_sums, "id long, labelling int, other long, total double, n long").groupBy("id", "labelling", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mean = F.col("total") / F.col("n")
    mine = chosen.select("id", F.posexplode("clusters").alias("labelling", "own"))
    by = sums.where("n > 0").join(mine, ["id", "labelling"]).groupBy("id", "labelling", F.col("own").alias("cluster")).agg(F.max(F.when(F.col("own") == F.col("other"), mean)).alias("a"), F.min(F.when(F.col("own") != F.col("other"), mean)).alias("b"))
    top = F.greatest("a", "b")
    return by.where("a is not null and b is not null").select("id", "labelling", "cluster", F.when(top > 0, (F.col("b") - F.col("a")) / top).otherwise(0.0).alias("silhouette"))


def silhouettes(df: DataFrame, id_col: str, cluster_col: str = "cluster", vector_col: str = "features", at: DataFrame | None = None) -> DataFrame:
    """(id, cluster, silhouette) of one labelling; see ``silhouettes_of``."""
    rows = df.select(F.col(id_col).alias("id"), F.array(F.col(cluster_col).cast("long")).alias("clusters"), F.col(vector_col).alias("v"))
    return silhouettes_of(rows, "id", "clusters", "v", None if at is None else at.select(F.col(id_col).alias("id"))).drop("labelling")


#: Points whose silhouettes choose k.
MEASURED = 10_000


def optimal_k(df: DataFrame, id_col: str, max_k: int = 10, seed: int = 42, vector_col: str = "features", measured: int | None = MEASURED) -> int:
    """The k of 2..max_k with the highest mean silhouette, the smallest on ties; 2 for two points or fewer.

    Silhouettes are taken of ``measured`` points chosen by hash, among all points, or of all
    points if it is None.
    """
    n = df.count()
    if n <= 2:
        return 2
    df = df.persist()
    at = df.select(id_col).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(measured) if measured is not None and n > measured else None
    start = plus_plus(df, min(max_k, n - 1), seed, vector_col)  # its first k are those that k draws give
    tried = range(2, len(start) + 1)
    assigned, names = df.select(id_col, vector_col), []
    for k, centroids in zip(tried, lloyd_many(df, [start[:k] for k in tried], 50, vector_col), strict=True):
        assigned = assign_nearest(assigned, centroids, vector_col).withColumnRenamed("cluster", f"in {k}")
        names.append(F.col(f"in {k}").cast("long"))
    best, chosen = None, 2
    if names:
        measured_points = silhouettes_of(checkpointed(assigned.select(id_col, vector_col, F.array(*names).alias("clusters"))), id_col, "clusters", vector_col, at)
        values = {r["labelling"]: r["value"] for r in measured_points.groupBy("labelling").agg(F.avg("silhouette").alias("value")).collect()}  # a row for each k
        for place, k in enumerate(tried):
            value = values.get(place)
            if value is not None and (best is None or value > best + 1e-12):
                best, chosen = value, k
    df.unpersist()
    return chosen
