"""Compression of vectors to codes, with codebooks by member-resident Lloyd rounds.

A vector is cut into parts; the parts of one position share a codebook. Parts live with
their owner: a partition is named by (position, entry, salt) and holds, as numpy blocks,
the parts that are assigned to this entry. A round has two steps. Owners sum their resident
members (one row per position and entry leaves a task) and the entries move. Then each
owner assigns its members anew where they are: members that keep their entry stay in their
partition, and only the others go through the next shuffle, to their new owner. Residents
and arrivals have the same partitioner, so putting them together moves nothing.

The salt splits an entry among several owners, so a hot entry is no hot partition. Blocks
hold BLOCK parts and are taken one at a time; nothing else is held. The codebooks (parts x
entries x components of a part) are the only thing that passes the driver, and their size
does not depend on the rows. Arithmetic is exact: 64-bit where it can't overflow, else
Python's whole numbers.

Rounds keep the members on disk, and every third state is checkpointed in the shared
folder, so a lost executor costs its own partitions of at most three rounds.

Defined results: rows whose vector is null or holds null or non-finite components are
dropped. Rows are told apart, so equal rows and rows of one vec_id each get their code; the
first entries are the first rows by (vec_id, vector), null vec_ids last. With fewer rows
than entries the codebook is shorter. Vectors of other lengths than the longest, and
lengths that the parts don't divide, are filled with zeros. An error beyond the range of a
long is null, and so is the sum of its label. Extra columns are ignored. An empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from fractions import Fraction
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.rdd import RDD
from pyspark.sql import DataFrame, Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import checkpointed, checkpoint_folder, small_batches

#: Parts in a block, and parts that an owner has on average.
BLOCK, OWNED = 20_000, 200_000
#: Different labels that are broadcast at most.
FEW = 100_000
#: Components are floor(SCALE * x).
SCALE = 4096
_LONG = 2**63

Books = list[list[list[int]]]  # by position, entry, component


def usable(vector: str | Column) -> Column:
    """Whether a vector is there and has only finite components."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def whole(parts: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of every component: int64, or Python's numbers where these don't fit."""
    wide = np.asarray(parts, dtype=np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(wide * SCALE)
    if not scaled.size or np.abs(scaled).max() < 2.0**52:
        return scaled.astype(np.int64)
    return np.array([[math.floor(Fraction(x) * SCALE) for x in row] for row in wide.tolist()], dtype=object).reshape(wide.shape)


def nearest(values: np.ndarray, book: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry for every row, ties to the lower entry."""
    width = values.shape[1]
    reach = 2 * max([int(np.abs(values).max()) if values.size else 0, *(abs(x) for entry in book for x in entry)])
    kind: Any = np.int64 if reach * reach * max(width, 1) < _LONG else object
    values = values.astype(kind)
    best = np.zeros(len(values), dtype=np.int64)
    least: np.ndarray | None = None
    for e, entry in enumerate(book):
        off = values - np.array(entry, dtype=kind).reshape(1, width)
        far = (off * off).sum(axis=1) if width else np.zeros(len(values), dtype=kind)
        if least is None:
            least = far
        else:
            closer = (far < least).astype(bool)
            best[closer], least = e, np.where(closer, far, least)
    return best, least if least is not None else np.zeros(len(values), dtype=kind)


class Owners:
    """Names owners by one number each, and makes blocks for them."""

    def __init__(self, parts: int, entries: int, salts: int):
        self.parts, self.entries, self.salts = parts, entries, salts

    def key(self, position: int, entry: int, salt: int) -> int:
        return (position * self.entries + entry) * self.salts + salt

    def of(self, key: int) -> tuple[int, int, int]:
        rest, salt = divmod(key, self.salts)
        return *divmod(rest, self.entries), salt

    def split(self, position: int, salt: int, entry: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
        """A block for each entry that occurs."""
        order = np.argsort(entry, kind="stable")
        cuts = np.flatnonzero(np.diff(entry[order])) + 1
        for at in np.split(order, cuts):
            if len(at):
                yield self.key(position, int(entry[at[0]]), salt), [c[at] for c in columns]


def _gathered(blocks: Iterator[tuple[int, list[np.ndarray]]]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Small blocks of one owner put together up to BLOCK parts."""
    waiting: dict[int, list[list[np.ndarray]]] = {}
    size: dict[int, int] = {}
    for key, columns in blocks:
        waiting.setdefault(key, []).append(columns)
        size[key] = size.get(key, 0) + len(columns[0])
        if size[key] >= BLOCK:
            yield key, [np.concatenate(c) for c in zip(*waiting.pop(key), strict=True)]
            del size[key]
    for key, many in waiting.items():
        yield key, [np.concatenate(c) for c in zip(*many, strict=True)]


def _first_blocks(kept: DataFrame, owners: Owners, width: int, books: Books, kind: Any) -> RDD:
    """Blocks of all parts, assigned to the first codebooks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            row, ids, labels, vectors = batch.columns
            lengths = np.diff(vectors.offsets.to_numpy())
            matrix = np.zeros((n, owners.parts * width), dtype=kind)
            matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
            nulls = np.array([x.is_null().to_numpy(zero_copy_only=False) for x in (ids, labels)]).T
            label = np.array(labels.to_pylist(), dtype=object) if pa.types.is_string(labels.type) else labels.fill_null(0).to_numpy()
            columns = [row.to_numpy(), ids.fill_null(0).to_numpy(), label, nulls]
            salt = int.from_bytes(hashlib.sha256(columns[0][:1].tobytes()).digest()[:6], "little") % owners.salts
            keys, blocks = [], []
            for p in range(owners.parts):
                part = matrix[:, p * width : (p + 1) * width]
                for key, block in owners.split(p, salt, nearest(whole(part), books[p])[0], [*columns, part]):
                    keys.append(key)
                    blocks.append(pickle.dumps(block, protocol=5))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blocks, pa.binary())], names=["key", "block"])

    return kept.mapInArrow(run, "key long, block binary").rdd.map(lambda r: (r["key"], pickle.loads(r["block"])))


def _sums(owners: Owners):
    """(position, entry) -> (sums of components, members), of a task's residents."""

    def run(blocks: Iterator[tuple[int, list[np.ndarray]]]) -> Iterator[tuple[tuple[int, int], tuple[list[int], int]]]:
        out: dict[tuple[int, int], tuple[list[int], int]] = {}
        for key, columns in blocks:
            values, (position, entry, _) = whole(columns[-1]), owners.of(key)
            if values.dtype != object and values.size and int(np.abs(values).max()) * len(values) >= _LONG:
                values = values.astype(object)
            mine = [int(x) for x in values.sum(axis=0)], len(values)
            out[position, entry] = _plus(out[position, entry], mine) if (position, entry) in out else mine
        yield from out.items()

    return run


def _plus(a: tuple[list[int], int], b: tuple[list[int], int]) -> tuple[list[int], int]:
    return [x + y for x, y in zip(a[0], b[0], strict=True)], a[1] + b[1]


def _moved(owners: Owners, books: Books, leave: bool):
    """The members that leave their owner, under their new one's key, or those that stay."""

    def run(blocks: Iterator[tuple[int, list[np.ndarray]]]) -> Iterator[tuple[int, list[np.ndarray]]]:
        for key, columns in blocks:
            position, entry, salt = owners.of(key)
            now, _ = nearest(whole(columns[-1]), books[position])
            if leave:
                away = now != entry
                yield from owners.split(position, salt, now[away], [c[away] for c in columns])
            elif (here := now == entry).any():
                yield key, [c[here] for c in columns]

    def gathered(blocks: Iterator[tuple[int, list[np.ndarray]]]) -> Iterator[tuple[int, list[np.ndarray]]]:
        yield from _gathered(run(blocks))

    return gathered


def _assigned(owners: Owners, books: Books, label: pa.DataType):
    """(row, vec_id, label, position, entry, distance) of every part, as Arrow batches in bytes."""
    names = ["row", "vec_id", "label", "position", "entry", "distance"]

    def run(blocks: Iterator[tuple[int, list[np.ndarray]]]) -> Iterator[tuple[bytes]]:
        for key, (row, ids, labels, nulls, part) in blocks:
            position, _, _ = owners.of(key)
            entry, far = nearest(whole(part), books[position])
            far = pa.array([int(x) if x < _LONG else None for x in far.tolist()], pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(row), pa.array(ids, pa.int64(), mask=nulls[:, 0]), pa.array(labels, label, mask=nulls[:, 1]), pa.array(np.full(len(row), position, dtype=np.int32)), pa.array(entry.astype(np.int32)), far], names=names)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield (sink.getvalue().to_pybytes(),)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.column(0):
            yield from pa.ipc.open_stream(block.as_buffer())


def first_books(kept: DataFrame, parts: int, width: int, entries: int) -> Books:
    """The parts of the first rows by (vec_id, vector): at most ``entries`` rows come to the driver."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    filled = np.array([list(r["vector"]) + [0.0] * (parts * width - len(r["vector"])) for r in rows], dtype=np.float64).reshape(len(rows), parts * width)
    return [whole(filled[:, p * width : (p + 1) * width]).tolist() for p in range(parts)]


def compress(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Books]:
    """Codes of all usable rows, and the codebooks.

    The rows are (row, vec_id, label, entries, error): ``row`` tells rows apart, ``entries`` has the
    entry of each part, ``error`` the squared distances to them, summed.
    """
    if parts < 1 or entries < 1 or rounds < 0:
        raise ValueError("parts and entries have to be 1 at least, rounds 0")
    spark = small_batches(embeddings).sparkSession
    element = embeddings.schema[vector_col].dataType
    narrow = isinstance(element, T.ArrayType) and isinstance(element.elementType, T.FloatType)
    number = isinstance(embeddings.schema[label_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    vector = F.col(vector_col).cast("array<float>" if narrow else "array<double>")
    kept = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long" if number else "string").alias("label"), vector.alias("vector")).where(usable("vector"))
    rows, longest = kept.agg(F.count("*"), F.max(F.size("vector"))).first()
    width = -(-(longest or 0) // parts)
    books = first_books(kept, parts, width, entries)
    owners = Owners(parts, entries, max(1, -(-rows // (OWNED * entries))))
    count = min(parts * entries * owners.salts, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows * parts // OWNED)))

    numbered = kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "vector")
    state = _first_blocks(numbered, owners, width, books, np.float32 if narrow else np.float64).partitionBy(count)
    checkpoint_folder(spark)
    states: list[RDD] = []
    for done in range(rounds):
        state.persist(StorageLevel.DISK_ONLY)
        if done % 3 == 0:
            state.checkpoint()
        states.append(state)
        sums = state.mapPartitions(_sums(owners)).reduceByKey(_plus, min(count, 16)).collect()  # parts * entries rows at most
        for old in states[:-1]:
            old.unpersist()
        states = states[-1:]
        before, books = books, [[list(e) for e in book] for book in books]
        for (position, entry), (total, members) in sums:
            books[position][entry] = [x // members for x in total]
        if books == before:
            break  # nothing would change any more
        if done < rounds - 1:
            stay = state.mapPartitions(_moved(owners, books, False), preservesPartitioning=True)
            state = stay.union(state.mapPartitions(_moved(owners, books, True)).partitionBy(count))
    kind = pa.int64() if number else pa.string()
    schema = f"row long, vec_id long, label {'long' if number else 'string'}, position int, entry int, distance long"
    found = spark.createDataFrame(state.mapPartitions(_assigned(owners, books, kind)), "block binary").mapInArrow(_unpacked, schema)
    entry = F.array(*(F.max(F.when(F.col("position") == p, F.col("entry"))) for p in range(parts)))
    error = F.when(F.count("distance") == parts, F.try_sum("distance"))
    codes = found.groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), entry.alias("entries"), error.alias("error"))
    return codes, books


def code_text(entries: str = "entries") -> Column:
    """Two hex digits for each entry."""
    return F.array_join(F.transform(entries, lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")


def books_text(books: Books) -> str:
    """All components by part, entry and place, joined by commas."""
    return ",".join(str(x) for book in books for entry in book for x in entry)


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error: the errors summed over equal labels, nulls together."""
    codes = checkpointed(codes)
    total = F.when(F.count("error") == F.count("*"), F.try_sum("error"))
    sums = checkpointed(codes.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of_label"))
    if sums.count() <= FEW:
        sums = F.broadcast(sums)
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of_label")), "left").drop("of_label")
