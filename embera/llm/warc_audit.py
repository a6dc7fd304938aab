"""WARC records and a Merkle audit of their replicas.

Records are laid out in one address space in the order of their digests (a
content-addressed archive), so offsets come from prefix sums over digest prefixes of at
most 4096 siblings each, never from one global sort; equal records are laid out side by
side from one row with a count.

A tree hashes the records of each range of BLOCK bytes in order of offset, and then
ranges of FANOUT ranges, up to one root. An audit compares two replicas' roots, goes down
only into ranges whose hashes differ, and compares single records only in the lowest
differing ranges. A record lost in one replica changes its own range only, because ranges
are cut by offset.

Defined results: a null url or html is empty, a null page_id writes an empty id. Repeated
rows are separate records. Records that only the other replica has are "added". Extra
columns are ignored. Empty tables give empty results, and equal roots an empty list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import checkpointed

BLOCK, FANOUT = 1 << 16, 16
#: Hex digits of a digest per level of prefix sums, and records that one cell of the last level holds, about.
DIGITS, CELL = 3, 1000


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A response record as text: header lines, payload, two line ends."""
    body = F.coalesce(html, F.lit(""))
    head = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:", F.coalesce(page_id.cast("string"), F.lit("")), ">\r\nWARC-Target-URI: ", F.coalesce(url, F.lit("")), "\r\nContent-Type: text/html\r\nContent-Length: ", F.octet_length(body).cast("string"), "\r\n\r\n")
    return F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in head), body, F.lit("\r\n\r\n"))


def laid_out(pages: DataFrame, kept: list[str]) -> DataFrame:
    """(offset, length, digest, *kept) of the records of (record, *kept): where each record lies.

    One pass hashes the records; only digests and the ``kept`` columns are moved.
    """
    seen = pages.select(F.sha2("record", 256).alias("digest"), F.octet_length("record").cast("long").alias("length"), *kept)
    r = checkpointed(seen.groupBy("digest", "length", *kept).agg(F.count("*").alias("copies")))
    n = r.count()
    levels = 1
    while n > CELL * 16 ** (DIGITS * levels) and levels < 5:
        levels += 1
    out = r.withColumn("offset", F.lit(0).cast("long"))
    for level in range(1, levels + 1):
        prefix, parent = F.substring("digest", 1, DIGITS * level), F.substring("prefix", 1, DIGITS * (level - 1))
        cells = r.groupBy(prefix.alias("prefix")).agg(F.sum(F.col("length") * F.col("copies")).alias("bytes"))
        before = F.coalesce(F.sum("bytes").over(Window.partitionBy(parent).orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cells = cells.select(F.col("prefix"), before.alias("before"))
        out = out.join(cells, prefix == F.col("prefix")).withColumn("offset", F.col("offset") + F.col("before")).drop("prefix", "before")
    cell = Window.partitionBy(F.substring("digest", 1, DIGITS * levels)).orderBy("digest", *kept).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("offset", F.col("offset") + F.coalesce(F.sum(F.col("length") * F.col("copies")).over(cell), F.lit(0)))
    copies = out.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    return copies.select((F.col("offset") + F.col("copy") * F.col("length")).alias("offset"), "length", "digest", *kept)


class MerkleTree:
    """Hashes of ordered offset ranges of one replica, a table per level."""

    def __init__(self, records: DataFrame, levels: int):
        """``records``: (offset, length, digest), as found in the replica."""
        self.records = records
        mark = F.concat_ws(":", "offset", "length", "digest")
        lowest = records.groupBy(F.floor(F.col("offset") / BLOCK).cast("long").alias("range")).agg(F.array_sort(F.collect_list(F.struct("offset", mark.alias("mark")))).alias("parts"))
        self.levels = [checkpointed(lowest.select("range", F.sha2(F.array_join(F.transform("parts", lambda p: p["mark"]), "\n"), 256).alias("hash")))]
        for _ in range(1, levels):
            up = self.levels[-1].groupBy(F.floor(F.col("range") / FANOUT).cast("long").alias("up")).agg(F.array_sort(F.collect_list(F.struct("range", "hash"))).alias("parts"))
            self.levels.append(up.select(F.col("up").alias("range"), F.sha2(F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["range"].cast("string"), p["hash"])), "\n"), 256).alias("hash")))

    def root(self) -> str | None:
        top = self.levels[-1].first()
        return top["hash"] if top else None


def levels_for(size: int) -> int:
    """Levels until one range covers ``size`` bytes."""
    ranges, levels = max(1, -(-size // BLOCK)), 1
    while ranges > 1:
        ranges, levels = -(-ranges // FANOUT), levels + 1
    return levels


def _differing(a: DataFrame, b: DataFrame, within: DataFrame | None, width: int) -> DataFrame:
    """Ranges whose hashes differ, looked for only below the ranges ``within``."""
    if within is not None:
        below = lambda d: d.join(within.withColumnRenamed("range", "up"), F.floor(F.col("range") / width) == F.col("up"), "left_semi")
        a, b = below(a), below(b)
    both = a.join(b.withColumnRenamed("hash", "other"), "range", "full")
    return both.where(~F.col("hash").eqNullSafe(F.col("other"))).select("range")


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """(offset, length, digest, other_digest, status) of the records that differ: damaged, lost or added.

    Both are (offset, length, digest); ``digest`` is of the first replica.
    """
    end = [d.agg(F.max(F.col("offset") + F.col("length"))).first()[0] or 0 for d in (first, second)]
    levels = levels_for(max(end))
    a, b = MerkleTree(first, levels), MerkleTree(second, levels)
    found = None
    if a.root() != b.root():
        for level in reversed(range(levels)):
            found = checkpointed(_differing(a.levels[level], b.levels[level], found, FANOUT))
    ranged = lambda d: d.withColumn("range", F.floor(F.col("offset") / BLOCK).cast("long"))
    if found is None:
        x, y = first.limit(0), second.limit(0)
    else:
        x, y = (ranged(d).join(found, "range", "left_semi").drop("range") for d in (first, second))
    both = x.join(y.select(F.col("offset").alias("at"), F.col("length").alias("other_length"), F.col("digest").alias("other_digest")), F.col("offset") == F.col("at"), "full")
    status = F.when(F.col("other_digest").isNull(), "lost").when(F.col("digest").isNull(), "added").otherwise("damaged")
    return both.where(~F.col("digest").eqNullSafe(F.col("other_digest"))).select(F.coalesce("offset", "at").alias("offset"), F.coalesce("length", "other_length").alias("length"), "digest", "other_digest", status.alias("status"))
