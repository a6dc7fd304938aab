"""Canonical exact fingerprints of documents.

The canonical form of a text is its NFKC form, case-folded, with every run of white space
as one space and none at the ends. Its 128-bit xxHash is the fingerprint. Documents are
grouped by it, and inside a group of equal fingerprints the canonical bytes are compared
with those of the group's first document; should two texts ever collide, the different
one gets the fingerprint with ``-`` and its SHA-256 behind it, so that equal fingerprints
always mean equal canonical texts.

The edited text of a document ends with the beginning of the next document (ascending
doc_id). Rows are cut into ranges of doc_id, and the first row of each range also goes to
the range before it; so texts are shuffled once, compressed, and each range is streamed.

Defined results: a null text is empty; its fingerprint is that of the empty text. A null
doc_id comes before all others; rows of one doc_id are ordered by text. A single document
is its own next document. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, small_batches

#: Documents in a range, and members of a fingerprint's group that one task compares.
RANGE, GROUP = 4000, 2000
#: Ranges at most: their starts come to the driver. A range is streamed, so its length costs time, not memory.
MOST_RANGES = 8192
#: Hex digits of a fingerprint that number the bits of the bitmap of groups.
BITS = 6
_LEAST = -(2**63)


def canonical(text: str | None) -> bytes:
    return " ".join(unicodedata.normalize("NFKC", text or "").casefold().split()).encode("utf-8", "surrogatepass")


def fingerprint(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text))


def likeness(a: str, b: str) -> float:
    """Exact digests are alike or not at all."""
    return float(a == b)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.string())], names=["doc_id", "fingerprint"])


def _members(bits):
    """Compressed canonical forms of the documents whose fingerprint may be in a group: its bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, words = zstandard.ZstdCompressor(level=1), bits.value
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                form = canonical(text.as_py())
                mark = xxhash.xxh3_128_hexdigest(form)
                at = int(mark[:BITS], 16)
                if int(words[at >> 6]) >> (at & 63) & 1:
                    out.append((doc, mark, pack.compress(form)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.binary()))], names=["doc_id", "fingerprint", "form"])

    return run


def _bitmap(groups: DataFrame) -> np.ndarray:
    """One bit for each beginning (BITS hex digits) of a fingerprint, set if a group begins so.

    The bitmap is 2 MB whatever the corpus. Where many groups fill it, more texts than needed
    are moved, and the join still decides.
    """
    at = F.conv(F.substring("fingerprint", 1, BITS), 16, 10).cast("long")
    words = groups.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    out = np.zeros(1 << (4 * BITS - 6), dtype=np.int64)
    for r in words.collect():  # at most 2**18 rows
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def _different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members, sorted by fingerprint and part, first document first, whose bytes aren't those of the first."""
    key, first, unpack = None, b"", zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for mark, part, doc, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            form = unpack.decompress(packed)
            if (mark, part) != key:
                key, first = (mark, part), form
            elif form != first:
                out.append((mark, hashlib.sha256(form).hexdigest(), doc))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["fingerprint", "sha256", "doc_id"])


def collisions(docs: DataFrame) -> DataFrame:
    """(fingerprint, sha256, doc_id) of documents whose bytes differ from the first one of their fingerprint.

    Only groups of two or more move their texts, which a bitmap of their fingerprints tells in the scan. A large group is split into parts, and
    its first document goes to each part.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = rows.mapInArrow(_fingerprints, "doc_id long, fingerprint string")
    groups = checkpointed(marks.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1"))
    dealt = groups.select("fingerprint", "first", F.ceil(F.col("n") / GROUP).cast("int").alias("parts"))
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(groups))
    members = rows.mapInArrow(_members(bits), "doc_id long, fingerprint string, form binary").join(dealt, "fingerprint")
    leads = F.coalesce(F.col("doc_id") == F.col("first"), F.lit(False))
    members = members.withColumn("lead", leads).withColumn("part", F.explode(F.when(leads, F.expr("sequence(0, parts - 1)")).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")))))
    sorted_members = members.repartition("fingerprint", "part").sortWithinPartitions("fingerprint", "part", F.desc("lead"), "doc_id")
    return sorted_members.select("fingerprint", "part", "doc_id", "form").mapInArrow(_different, "fingerprint string, sha256 string, doc_id long")


def _lows(cuts: list[int]):
    """The smallest id between cuts, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.sort(batch.column(0).to_numpy(zero_copy_only=False))
            at, first = np.unique(np.searchsorted(np.array(cuts, dtype=np.int64), ids, side="right"), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(ids[first], pa.int64())], names=["range", "low"])

    return run


def _dealer(starts: list[int]):
    """Rows with their range; the first doc_id of a range also as what comes after the range before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        heads = set(starts)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                key = _LEAST if doc is None else doc
                at = bisect_right(starts, key) - 1
                tie, data = xxhash.xxh3_64_intdigest(raw) >> 1, pack.compress(raw)
                out.append((at, 0, doc, tie, data))
                if key in heads:
                    out.append(((at or len(starts)) - 1, 1, doc, tie, data))
            for i in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out[i : i + 1000]], kind) for j, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["range", "ahead", "doc_id", "tie", "data"])

    return run


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams ranges in order; each row waits for the next one."""
    unpack = zstandard.ZstdDecompressor()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
    waiting = None  # (range, doc_id, text, fingerprint)
    for batch in batches:
        out = []
        for at, ahead, doc, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = unpack.decompress(data).decode("utf-8", "surrogatepass")
            mark = fingerprint(text)
            if waiting is not None and waiting[0] == at:
                _, was, old, old_mark = waiting
                n = len(old) // 4
                edited = old[: len(old) - n] + text[:n]
                out.append((was, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), old_mark, fingerprint(edited), mark))
            waiting = None if ahead else (at, doc, text, mark)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=names)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row per row of ``docs``."""
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = rows.select(F.coalesce("doc_id", F.lit(_LEAST)).alias("key"))
    n = ids.count()
    # quantiles of the ids alone cut the ranges (one per RANGE documents); each starts at its smallest id
    ranges = max(1, min(MOST_RANGES, n // RANGE))
    cuts = ids.select(F.percentile_approx("key", [i / ranges for i in range(ranges)] if ranges > 1 else [0.0], 100 * ranges).alias("q")).first()["q"] if n else []
    starts = sorted(r["low"] for r in ids.mapInArrow(_lows(sorted(set(cuts or []))), "range int, low long").groupBy("range").agg(F.min("low").alias("low")).collect())
    dealt = rows.mapInArrow(_dealer(starts), "range int, ahead int, doc_id long, tie long, data binary")
    streamed = dealt.repartition("range").sortWithinPartitions("range", "ahead", "doc_id", "tie").select("range", "ahead", "doc_id", "data")
    edited = streamed.mapInArrow(_edit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string")
    apart = checkpointed(collisions(docs))
    if not apart.isEmpty():  # never seen for 128 bits, but settled exactly
        named = apart.select(F.col("fingerprint").alias("was"), F.col("doc_id").alias("at"), F.concat_ws("-", "fingerprint", "sha256").alias("now")).distinct()
        edited = edited.join(named, (F.col("fingerprint") == F.col("was")) & F.col("doc_id").eqNullSafe(F.col("at")), "left").withColumn("fingerprint", F.coalesce("now", "fingerprint")).drop("was", "at", "now")
    alike = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return edited.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", alike("edited_fingerprint").alias("near_edited"), alike("next_fingerprint").alias("near_next"))
