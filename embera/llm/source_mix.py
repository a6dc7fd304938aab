"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document gets the key -ln(u) / weight, u a hash of the document and the seed; its
source takes documents in ascending order of key. Whole epochs come first: a source whose
target is 1.3 times its size takes every document once, and then the documents of the
smallest keys until the remaining 0.3 are full; the last of these is taken in part, so a
source meets its target to the word.

Prefix sums never put a source into one task: keys are cut into equally likely buckets
(through the distribution function of the keys), bucket sums are taken first, and only
the one bucket of a source in which its budget ends is ordered row by row; all others are
taken or left whole. Sources themselves are ranked and summed the same way, range by
range, so that a source may as well be a host.

Defined results: a null text has size 0 and is never taken. A null source comes last and
mixes like any other. A weight that is null or not finite counts as 1, one of 0 or less as
1e-9. Documents of equal key are ordered by doc_id and size. Repeated rows each count.
Extra columns are ignored by ``mix_sources`` and pass through ``mixed_documents``, whatever
their names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one bucket of a source holds, about.
BUCKET = 20_000
#: Quantiles of the weights from which the distribution function of the keys is made.
QUANTILES = 16


def words(text: Column) -> Column:
    """Number of words; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A uniform number in (0, 1) from the document and the seed: 52 bits of an MD5."""
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(mark, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def _before(rows: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, by name, sums over the rows before each one in the order (a total one).

    Rows are cut into ranges, and sums of ranges come first: a row per range, and there are
    no more ranges than shuffle partitions. Inside a range rows are ordered for themselves.
    """
    ranged = checkpointed(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    upto = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    of_range = ranged.groupBy(F.col("range").alias("r")).agg(*(F.sum(c).alias(f"sum_{n}") for n, c in sums.items()))
    of_range = of_range.select("r", *(F.coalesce(F.sum(f"sum_{n}").over(upto), F.lit(0)).alias(f"sum_{n}") for n in sums))
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()))
    out = out.join(F.broadcast(of_range), out.range == of_range.r)
    return out.select(*rows.columns, *((F.col(n) + F.col(f"sum_{n}")).alias(n) for n in sums))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row per source.

    Sources in order of code point take the weights in turn. A target is weight * level,
    but at most ``most`` times the source's size; the level is raised until the targets
    make ``share`` of all sizes. Weights have to be positive and finite.
    """
    if not weights or not all(0 < float(w) < float("inf") for w in weights):
        raise ValueError("weights of sources have to be positive and finite")
    s = _before(sizes, [F.asc_nulls_last("source")], {"place": F.lit(1)})
    s = s.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("w")).select("source", "source_size", "w", "cap", "ratio")
    s = checkpointed(_before(s, [F.asc("ratio"), F.asc_nulls_last("source")], {"caps": F.col("cap"), "ws": F.col("w")}))
    whole = s.agg(F.sum("source_size").alias("total"), F.sum("w").alias("all_w")).first()
    total, all_w = float(whole["total"] or 0) * float(share), float(whole["all_w"] or 0)
    s = s.withColumn("full", (F.lit(total) - F.col("caps")) / (F.lit(all_w) - F.col("ws")) > F.col("ratio"))
    full = s.where("full").agg(F.sum("cap").alias("caps"), F.sum("w").alias("ws")).first()
    level = F.col("w") * F.lit(total - float(full["caps"] or 0)) / F.lit(all_w - float(full["ws"] or 0))
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(level).alias("target"))


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """(doc_id, text_md5, source, size, source_size, target, epochs, part, taken), a row per row of ``docs``.

    ``quality(doc_id, weight)`` has one row per document at most. A document is taken
    ``epochs`` times as a whole, and ``part`` words of it once more.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    d = d.select("doc_id", "source", words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), document_key(F.col("doc_id"), F.col("text"), seed).alias("u"))
    if quality is None:
        d = d.withColumn("weight", F.lit(1.0))
    else:  # never broadcast: Spark's estimate of the weights, from compressed files, is many times less than their rows take of the driver
        d = d.join(quality.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("weight").cast("double").alias("weight")).hint("merge"), "doc_id", "left")
    known = F.col("weight").isNotNull() & ~F.isnan("weight") & (F.abs("weight") < float("inf"))
    d = d.withColumn("weight", F.greatest(F.when(known, F.col("weight")).otherwise(F.lit(1.0)), F.lit(1e-9)))
    d = checkpointed(d.withColumn("key", -F.log("u") / F.col("weight")).drop("u"))
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = checkpointed(source_targets(sizes, weights, share, most))
    seen = d.agg(F.count("*").alias("n"), F.percentile_approx("weight", [(2 * i + 1) / (2 * QUANTILES) for i in range(QUANTILES)], 1000).alias("w")).first()
    buckets = max(16, -(-seen["n"] // BUCKET))
    below = sum(((F.lit(1.0) - F.exp(-F.col("key") * w)) for w in seen["w"] or [1.0]), F.lit(0.0)) / len(seen["w"] or [1.0])
    d = d.withColumn("bucket", F.least((below * buckets).cast("int"), F.lit(buckets - 1)))
    cells = d.groupBy("source", "bucket").agg(F.sum("size").alias("cell"))
    # a row per bucket: a source of a billion documents has 50,000
    cells = cells.withColumn("before", F.coalesce(F.sum("cell").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = cells.join(targets, cells.source.eqNullSafe(targets.source)).select(cells.source.alias("s"), F.col("bucket").alias("b"), "cell", "before", "source_size", "target")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs)
    plan = checkpointed(plan.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long") - F.col("before")).drop("before"))
    d = d.join(plan, d.source.eqNullSafe(plan.s) & (d.bucket == plan.b)).drop("s", "b")
    # buckets before and behind the one in which the budget ends are settled as they are; rows are ordered inside that one only
    ends = (F.col("rest") > 0) & (F.col("rest") < F.col("cell"))
    columns = ["doc_id", "text_md5", "source", "size", "source_size", "target", "epochs"]
    settled = d.where(~ends).select(*columns, F.when(F.col("rest") > 0, F.col("size")).otherwise(F.lit(0)).cast("long").alias("part"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.asc_nulls_first("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    parted = d.where(ends).select(*columns, F.least(F.greatest(left, F.lit(0)), F.col("size")).cast("long").alias("part"))
    return settled.unionByName(parted).withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None, **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once per epoch, the last of a source cut to its words.

    Columns stay as they are; ``n_chars``, if there, follows a cut text. Rows are known by
    doc_id, source and text; of rows that differ in other columns only, one stands for all.
    """
    taken = mix_sources(docs, quality, **how).where("taken > 0")
    picks = taken.groupBy("doc_id", "source", "text_md5").agg(F.max("size").alias("size"), F.sum("epochs").alias("epochs"), F.collect_list(F.expr("case when part > 0 then part end")).alias("parts"))
    copies = picks.select("doc_id", "source", "text_md5", "size", F.explode(F.concat(F.array_repeat(F.col("size"), F.col("epochs").cast("int")), F.col("parts"))).alias("words"))
    # a caller's columns travel as one, so that no name of theirs meets one of ours
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.col("source").cast("string").alias("own_source"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("own_md5"))
    keys = ["own_id", "own_source", "own_md5"]
    repeated = checkpointed(rows.groupBy(*keys).count().where("count > 1"))
    if not repeated.isEmpty():  # the copies count repeated rows already
        same = [rows[k].eqNullSafe(repeated[k]) for k in keys]
        once = rows.join(repeated, same, "left_semi").groupBy(*keys).agg(F.min_by("row", F.to_json("row")).alias("row")).select("row", *keys)
        rows = rows.join(repeated, same, "left_anti").union(once)
    joined = rows.join(copies, rows.own_id.eqNullSafe(copies.doc_id) & rows.own_source.eqNullSafe(copies.source) & (rows.own_md5 == copies.text_md5)).select("row", "size", "words")
    text = F.col("row.text")
    pieces = F.split(text.cast("string"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", (F.col("words") + 1).cast("int"))
    cut = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(pieces, 1, F.col("words").cast("int")), "")).otherwise(text)
    out = joined.select("row", cut.alias("cut"))
    changed = {"text": F.col("cut"), "n_chars": F.length("cut").cast("long")}
    return out.select(*(changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
