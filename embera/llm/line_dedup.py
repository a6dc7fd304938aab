"""Line dedup by distinct-site spread.

The sites (sources) of every line hash are counted with HyperLogLog sketches, which merge
by aggregation. Lines whose estimate lies near the threshold get an exact distinct count.
A line on ``min_sites`` sites or more is boilerplate: it stays in the first document that
has it (smallest doc_id) at its first place, and is removed elsewhere, so no text is lost
for good. Documents themselves all stay, if need be with an empty text. The threshold is a
few sites, not a share of them, so it means the same in a corpus of any size.

Lines are compared by a 64-bit hash of the line without blanks at its ends. Documents are
split once, and their lines (hash, site, place) are kept. For an exact count the sites of
a line are made distinct before lines are brought together, so a line that a third of all
rows have brings one row per site. Joins by line hash are plain equi-joins, which Spark
broadcasts or splits by measured size; a document's removals are gathered by document.

Defined results: a null text stays null; blank lines are never removed; a null source (all
of them, in a table without sources) is
the site of the empty name; documents without doc_id come first. Repeated rows share their
removals: a line that stays in one stays in its exact repetition of the same doc_id.
Extra columns pass through, whatever their names (an own ``n_removed`` is replaced). An
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, small_batches

MIN_SITES = 5
#: Estimates within this factor of the threshold are counted exactly; lg of the sketch's size.
NEAR, LG_K = 1.5, 12
BLANKS = " \t\r"
#: Boilerplate lines that are broadcast at most (their hashes, 8 bytes each).
FEW = 1_000_000


def _key(docs: DataFrame) -> list[Column]:
    text = F.col("text").cast("string")
    return [F.col("doc_id").cast("long").alias("k_id"), F.xxhash64(text).alias("k_hash"), F.coalesce(F.length(text), F.lit(-1)).alias("k_len")]


def site_lines(docs: DataFrame) -> DataFrame:
    """(k_id, k_hash, k_len, site, pos, line long): the lines that aren't blank, hashed."""
    lines = F.split(F.col("text").cast("string"), "\n")
    rows = docs.select(*_key(docs), (F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")).alias("site"), F.posexplode(lines).alias("pos", "raw"))
    bare = F.trim("raw", F.lit(BLANKS))
    return rows.where(bare != "").select("k_id", "k_hash", "k_len", "site", "pos", F.xxhash64(bare).alias("line"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, sites): lines on ``min_sites`` sites or more, with their count."""
    # a sketch passes over empty strings, and one site may have that name
    sketches = lines.groupBy("line").agg(F.hll_sketch_agg(F.concat(F.lit("/"), "site"), F.lit(LG_K)).alias("sketch"))
    estimated = checkpointed(sketches.select("line", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites / NEAR))
    near = estimated.where(F.col("sites") <= min_sites * NEAR).select("line")
    pairs = lines.select("line", "site").distinct()
    exact = pairs.join(near, "line", "left_semi").groupBy("line").agg(F.count("*").alias("sites"))
    far = estimated.where(F.col("sites") > min_sites * NEAR)
    return far.unionByName(exact.where(F.col("sites") >= min_sites))


def _drop_lines(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, places in parts:
        out = []
        for text, gone in zip(texts, places, strict=True):
            if text is not None and gone is not None and len(gone):
                away = set(gone.tolist())
                text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in away)
            out.append(text)
        yield pd.Series(out, dtype=object)


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text`` (``n_chars``, if there, follows), and ``n_removed``."""
    lines = checkpointed(site_lines(small_batches(docs)))
    spread = checkpointed(spread_lines(lines, min_sites).select("line"))
    if spread.count() <= FEW:  # else Spark splits the lines that very many rows have
        spread = F.broadcast(spread)
    places = checkpointed(lines.join(spread, "line").select("line", "k_id", "k_hash", "k_len", "pos"))
    found = checkpointed(places.distinct())
    place = F.struct("k_id", "k_hash", "k_len", "pos")
    first = checkpointed(found.groupBy("line").agg(F.min(place).alias("first")))  # apart, so that Spark may split the join's hot lines
    gone = found.join(first, "line").where(~place.eqNullSafe(F.col("first"))).groupBy("k_id", "k_hash", "k_len").agg(F.collect_list("pos").alias("places"))
    # a caller's columns travel as one, so that no name of theirs meets one of ours
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(n) for c, n in zip(_key(docs), ("own_id", "own_hash", "own_len"), strict=True)))
    joined = named.join(gone, named.own_id.eqNullSafe(gone.k_id) & (named.own_hash == gone.k_hash) & (named.own_len == gone.k_len), "left").select("row", "places")
    drop = F.pandas_udf(_drop_lines, "string")
    out = joined.select("row", drop(F.col("row.text").cast("string"), "places").alias("left"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed"))
    changed = {"text": F.col("left"), "n_chars": F.when(F.col("n_removed") > 0, F.length("left").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*(changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "n_removed"), "n_removed")
