"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample of the vectors and broadcast (MOST_LEAVES leaves at
most, whatever the table). Every row is put into the leaf that it descends to, and kept
there. A query visits leaves best-bin-first: a priority queue over tree nodes, ordered by
inner product with the node's centre, is popped until enough leaves are found. How many
are enough is calibrated: for a bounded sample of queries the exact neighbours are found by
brute force over all rows, and the number of visits is widened until half of these queries
reach RECALL; the other half measures the recall that is reported.

Neighbouring leaves form shelves of bounded size, and a query is sent once to each shelf
that it visits, with the numbers of its leaves there. Leaves of many rows are split into
parts, and shelves of many queries into query parts, so no task gets an unbounded group;
partial top lists are merged per query. Of one vector that very many rows share, only the
rows of the smallest ids can be among a query's nearest, so no others are compared.

Scores are inner products of the original vectors in double precision, summed in order of
the components, so equal vectors get equal scores; ties go to the smaller vec_id. A matrix
product finds the rows that may be among the best, within its rounding error.

Defined results: vectors that are null, zero, of another length than most, or that hold
null or non-finite components take no part, nor do rows without vec_id. Repeated rows of
one vec_id are separate candidates. A query is one vec_id with one vector: its exact
repetitions are the same query, and a vec_id with two vectors has two lists. A product
that overflows is infinite and counts as such; one of no value (infinities of both signs)
is below all others. Fewer candidates than asked for: all of them. Extra columns are
ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import checkpointed

#: Rows that fit the tree, queries that calibrate it, leaves at most, rows of a leaf about, children of a node.
SAMPLE, CALIBRATION, MOST_LEAVES, LEAF, BRANCH = 20_000, 400, 4096, 150, 8
#: Recall aimed at on the calibration queries (0.9 has to be reached).
RECALL = 0.95
#: Rows of a shelf (or of a part of a larger leaf) and queries that one task compares; queries compared at once.
ROW_PART, QUERY_PART, AT_ONCE = 4000, 2000, 400
#: Rows from which on one vector's copies are told apart by their ids first.
COPIES = 1000
PLACED = "leaf int, vec_id long, vector binary"
HITS = "query_id long, mark long, vec_id long, score double, leaf int"
OUT = "query_id long, rank int, vec_id long, score double"


def _finite(c: str) -> Column:
    v = F.col(c)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def usable_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, v) of the rows that take part, and their number."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(_finite("v"))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return (rows.where(F.size("v") == common["n"]), common["count"]) if common else (rows, 0)


def _flat(column: pa.Array) -> np.ndarray:
    """The rows of a column of lists, none of them null, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(column), -1)


def _matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<f8").reshape(len(column), -1) if column else np.empty((0, 0))


def _assign(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None] - 2 * x @ centres.T).argmin(axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(12):
        near = _assign(x, centres)
        for j in range(k):
            mine = x[near == j]
            centres[j] = mine.mean(axis=0) if len(mine) else x[rng.integers(len(x))]
    return centres


class Tree:
    """Nodes by number: children of inner nodes, leaf numbers of the others."""

    def __init__(self, x: np.ndarray, leaf: float, seed: int = 11):
        """``leaf``: sampled rows that a leaf should hold."""
        rng = np.random.default_rng(seed)
        self.centres, self.children, self.leaf = [x.mean(axis=0)], {}, {}
        todo = [(0, np.unique(x, axis=0))]
        while todo:
            node, mine = todo.pop(0)
            if len(mine) <= max(leaf, BRANCH) or len(self.centres) > MOST_LEAVES:
                continue
            centres = _kmeans(mine, BRANCH, rng)
            near = _assign(mine, centres)
            self.children[node] = []
            for j in range(BRANCH):
                if (part := mine[near == j]).size:
                    self.children[node].append(len(self.centres))
                    todo.append((len(self.centres), part))
                    self.centres.append(centres[j])
        self.centres = np.array(self.centres)
        self.kids = {n: self.centres[c] for n, c in self.children.items()}
        below = [0]  # leaves are numbered depth first, so that neighbours have near numbers
        while below:
            node = below.pop()
            if node in self.children:
                below += self.children[node][::-1]
            else:
                self.leaf[node] = len(self.leaf)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        out, todo = np.zeros(len(x), dtype=np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node in self.leaf:
                out[rows] = self.leaf[node]
            elif len(rows):
                near = _assign(x[rows], self.kids[node])
                todo += [(c, rows[near == j]) for j, c in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray, least: int, sizes: np.ndarray, rows: int) -> list[int]:
        """Leaves best-bin-first: ``least`` of them, and on until they hold ``rows`` rows."""
        products = (self.centres @ q).tolist()
        queue, out, held = [(-products[0], 0)], [], 0
        while queue and (len(out) < least or held < rows):
            _, node = heapq.heappop(queue)
            if (leaf := self.leaf.get(node)) is None:
                for c in self.children[node]:
                    heapq.heappush(queue, (-products[c], c))
            elif sizes[leaf]:
                out.append(leaf)
                held += sizes[leaf]
        return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows in double precision, added up component by component."""
    out = np.zeros(len(q))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(q.shape[1] if len(q) else 0):
            out += q[:, d] * x[:, d]
    return np.where(np.isnan(out), -np.inf, out)


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score), by number: the k best rows ``seen`` by each query but its own, best first."""
    with np.errstate(over="ignore", invalid="ignore"):
        score = q @ x.T
    open_ = q_ids[:, None] != ids[None]
    if seen is not None:
        open_ &= seen
    if np.isfinite(score).all():
        slack = 1e-12 * np.sqrt((q**2).sum(axis=1) * (x**2).sum(axis=1).max(initial=0.0))
        score[~open_] = -np.inf
        if score.shape[1] > k:
            open_ &= score >= (np.partition(score, -k, axis=1)[:, -k] - slack)[:, None]
    at, row = np.nonzero(open_)
    step = 50_000
    exact = np.concatenate([products(q[at[i : i + step]], x[row[i : i + step]]) for i in range(0, len(at), step)] or [np.empty(0)])
    order = np.lexsort((ids[row], -exact, at))
    at, row, exact = at[order], row[order], exact[order]
    first = np.searchsorted(at, at)  # where each query's list begins
    top = np.arange(len(at)) - first < k
    return at[top], row[top], exact[top]


def _hits(q_ids: np.ndarray, marks: np.ndarray, q: np.ndarray, ids: np.ndarray, leaves: np.ndarray, x: np.ndarray, k: int, seen=None) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(q_ids), AT_ONCE):
        part = slice(i, i + AT_ONCE)
        at, row, score = best(q_ids[part], q[part], ids, x, k, None if seen is None else seen(part))
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[part][at]), pa.array(marks[part][at]), pa.array(ids[row]), pa.array(score), pa.array(leaves[row], pa.int32())], names=["query_id", "mark", "vec_id", "score", "leaf"])


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def brute_force(queries: list[tuple[int, int, bytes]], placed: DataFrame, k: int) -> DataFrame:
    """Exact neighbours of a bounded list of queries (id, mark, vector); each batch keeps k of each query."""
    q_ids, marks, q = np.array([i for i, _, _ in queries], dtype=np.int64), np.array([m for _, m, _ in queries], dtype=np.int64), _matrix([v for _, _, v in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROW_PART):
                part = batch.slice(i, ROW_PART)
                leaves, ids = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                yield from _hits(q_ids, marks, q, ids, leaves, _matrix(part.column(2).to_pylist()), k)

    return _ranked(placed.mapInArrow(run, HITS), k)


def _placed(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _flat(batch.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.place(x)), batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["leaf", "vec_id", "vector"])

    return run


def _visiting(shared: Broadcast, least: int, sizes: np.ndarray, shelf: np.ndarray, rows: int):
    """One row for each shelf that a query visits, with its leaves there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                out = []
                for query, mark, vector in zip(*(c.to_pylist() for c in batch.slice(i, 500).columns), strict=True):
                    leaves = np.array(sorted(shared.value.visits(np.frombuffer(vector, dtype="<f8"), least, sizes, rows)), dtype="<i4")
                    cuts = np.flatnonzero(np.diff(shelf[leaves])) + 1
                    out += [(int(shelf[own[0]]), query, mark, vector, own.tobytes()) for own in np.split(leaves, cuts) if len(own)]
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], kind) for j, kind in enumerate(kinds)], names=["shelf", "id", "mark", "vector", "leaves"])

    return run


def _searched(k: int):
    """Rows and queries sorted by (shelf, row part, query part)."""

    def answer(rows: list, asked: list) -> Iterator[pa.RecordBatch]:
        if not rows or not asked:
            return
        leaves = np.array([r[0] for r in rows], dtype=np.int32)
        numbers, column = np.unique(leaves, return_inverse=True)
        sees = np.zeros((len(asked), len(numbers)), dtype=bool)
        for i, a in enumerate(asked):
            sees[i] = np.isin(numbers, np.frombuffer(a[3], dtype="<i4"))
        seen = lambda part: sees[part][:, column]
        yield from _hits(np.array([a[0] for a in asked]), np.array([a[1] for a in asked]), _matrix([a[2] for a in asked]), np.array([r[1] for r in rows]), leaves, _matrix([r[2] for r in rows]), k, seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, asked = None, [], []
        for batch in batches:
            for shelf, row_part, query_part, query, leaf, id_, mark, vector, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (shelf, row_part, query_part) != key:
                    yield from answer(rows, asked)
                    key, rows, asked = (shelf, row_part, query_part), [], []
                if query:
                    asked.append((id_, mark, vector, own))
                else:
                    rows.append((leaf, id_, vector))
        yield from answer(rows, asked)

    return run


def calibrated_visits(tree: Tree, sizes: np.ndarray, queries: list[tuple[int, int, bytes]], truth: list[tuple[int, int, int]], recall: float) -> tuple[int, float]:
    """(leaf visits, recall there) from the leaves of exact neighbours (query, mark, leaf).

    Every other query sets the visits; the rest, which nothing was fitted to, measures them.
    """
    orders = {(i, m): {leaf: n for n, leaf in enumerate(tree.visits(np.frombuffer(v, dtype="<f8"), len(sizes), sizes, 0))} for i, m, v in queries}
    sets = {(i, m): n % 2 == 0 for n, (i, m, _) in enumerate(queries)}
    at = lambda own: np.sort([orders[i, m][leaf] for i, m, leaf in truth if sets[i, m] == own])
    mine, held = at(True), at(False)
    if not len(mine):
        return 1, 1.0
    need = int(mine[min(len(mine) - 1, int(np.ceil(recall * len(mine))) - 1)]) + 1
    return need, float(np.mean((held if len(held) else mine) < need))


@dataclass
class Index:
    """A fitted tree, every row in its leaf, and the visits that reach the recall."""

    tree: Broadcast
    placed: DataFrame
    sizes: np.ndarray
    visits: int
    #: Measured on queries that calibration didn't use, against brute force over all rows.
    recall: float


def _sampled(rows: DataFrame, n: int, most: int, salt: int) -> DataFrame:
    """At most ``most`` different rows, chosen by hash."""
    mark = F.xxhash64(*rows.columns, F.lit(salt))
    if n > 5 * most:  # nothing but what may be chosen is moved
        rows = rows.where(F.pmod(mark, F.lit(1 << 30)) < int(1.5 * most / n * (1 << 30)))
    return rows.distinct().orderBy(mark, *rows.columns).limit(most)


def build_index(df: DataFrame, k: int = 20, every: int = 20, recall: float = RECALL) -> Index | None:
    """The index of ``df``, calibrated for ``k`` neighbours of rows whose vec_id divides by ``every``; None without rows."""
    rows, n = usable_vectors(df)
    if not n:
        return None
    sample = np.array([r["v"] for r in _sampled(rows.select("v"), n, SAMPLE, 1).collect()])
    leaf = max(LEAF, n / (MOST_LEAVES // 2))
    tree = df.sparkSession.sparkContext.broadcast(Tree(sample, leaf * len(sample) / n))
    placed = checkpointed(rows.mapInArrow(_placed(tree), PLACED))
    sizes = np.zeros(len(tree.value.leaf), dtype=np.int64)
    for r in placed.groupBy("leaf").count().collect():  # MOST_LEAVES rows at most
        sizes[r["leaf"]] = r["count"]
    asked = _queries(placed, every)
    probes = [(r["id"], r["mark"], bytes(r["vector"])) for r in _sampled(asked, asked.count(), CALIBRATION, 2).collect()]
    truth = [(r["query_id"], r["mark"], r["leaf"]) for r in brute_force(probes, placed, k).collect()] if probes else []
    return Index(tree, placed, sizes, *calibrated_visits(tree.value, sizes, probes, truth, recall))


def _queries(placed: DataFrame, every: int) -> DataFrame:
    return placed.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("id"), F.xxhash64("vector").alias("mark"), "vector")


def _shelves(sizes: np.ndarray) -> np.ndarray:
    """The shelf of every leaf: neighbours fill one up to ROW_PART rows; a larger leaf is one of its own."""
    out, shelf, held = np.zeros(len(sizes), dtype=np.int32), 0, 0
    for leaf, n in enumerate(sizes.tolist()):
        if held and held + n > ROW_PART:
            shelf, held = shelf + 1, 0
        out[leaf], held = shelf, held + n
    return out


def _without_copies(placed: DataFrame, k: int) -> DataFrame:
    """``placed`` without the rows of an often repeated vector that can't be among anyone's ``k`` nearest.

    Of equal vectors the k + 1 smallest ids can (one may be the query's own), and k rows of each.
    """
    mark = F.xxhash64("vector")
    often = checkpointed(placed.groupBy(mark.alias("often")).count().where(F.col("count") > COPIES).select("often"))
    if often.isEmpty():
        return placed
    own = F.row_number().over(Window.partitionBy("vector", "vec_id").orderBy("leaf"))
    ids = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    among = placed.join(often, mark == F.col("often"), "left_semi").withColumn("n", own).where(F.col("n") <= k).withColumn("n", ids).where(F.col("n") <= k + 1)
    return placed.join(often, mark == F.col("often"), "left_anti").unionByName(among.drop("n"))


def search(df: DataFrame, k: int = 20, every: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose vec_id divides by ``every``."""
    index = build_index(df, k, every, recall)
    return df.sparkSession.createDataFrame([], OUT) if index is None else search_index(index, k, every)


def search_index(index: Index, k: int = 20, every: int = 20) -> DataFrame:
    spark = index.placed.sparkSession
    shelf = _shelves(index.sizes)
    held = np.bincount(shelf, weights=index.sizes)
    queries = _queries(index.placed, every).distinct()
    asked = checkpointed(queries.mapInArrow(_visiting(index.tree, index.visits, index.sizes, shelf, k + 1), "shelf int, id long, mark long, vector binary, leaves binary"))
    row_parts = spark.createDataFrame([(s, int(-(-n // ROW_PART))) for s, n in enumerate(held.tolist()) if n], "shelf int, row_parts int")
    # a row per shelf, at most MOST_LEAVES
    parts = F.broadcast(asked.groupBy("shelf").agg(F.ceil(F.count("*") / QUERY_PART).cast("int").alias("query_parts")).join(row_parts, "shelf"))
    own = lambda name, salt, key: F.array(F.pmod(F.xxhash64(*key, F.lit(salt)), F.col(name)).cast("int"))
    each = lambda name: F.expr(f"sequence(0, {name} - 1)")
    of_leaf = F.broadcast(spark.createDataFrame([(leaf, int(s)) for leaf, s in enumerate(shelf.tolist())], "leaf int, shelf int"))
    rows = _without_copies(index.placed, k).join(of_leaf, "leaf").select("shelf", F.lit(0).alias("query"), "leaf", F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("mark"), "vector", F.lit(None).cast("binary").alias("leaves"))
    ask = asked.select("shelf", F.lit(1).alias("query"), F.lit(-1).alias("leaf"), "id", "mark", "vector", "leaves")
    dealt = lambda d, r, q: d.join(parts, "shelf").withColumn("row_part", F.explode(r)).withColumn("query_part", F.explode(q)).select("shelf", "row_part", "query_part", "query", "leaf", "id", "mark", "vector", "leaves")
    both = dealt(rows, own("row_parts", 3, ("id", "vector")), each("query_parts")).union(dealt(ask, each("row_parts"), own("query_parts", 4, ("id", "mark"))))
    cells = both.repartition("shelf", "row_part", "query_part").sortWithinPartitions("shelf", "row_part", "query_part", "query")
    return _ranked(cells.mapInArrow(_searched(k), HITS), k).select("query_id", "rank", "vec_id", "score")
