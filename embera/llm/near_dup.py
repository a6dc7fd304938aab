"""Near-duplicate detection with HyperMinHash bands and exact verification.

1. Each text becomes a set of word shingles; texts of equal sets collapse to the smallest
   doc_id (a pre-aggregated group-by, so thousands of copies cost one row per map task).
2. The registers of each distinct set are banded. Sets that share a band with a hub (the
   smallest id of that band) become members of the hub's group: linear in the input, and
   every pair that shares any band meets in some group.
3. Groups are cut into blocks of bounded total set size and number. Inside a block all
   memberships are settled: candidates are pairs that share one of the rarest shingles of
   both (prefix filter, which loses no pair at the threshold), or all pairs where these
   would be more; a corrected Jaccard estimate from the registers drops those far below
   the threshold; the full sets decide (whole-number comparison).
   Large groups that share most of their members are one before that.
4. Of a group of several blocks, those members that didn't reach the hub first meet a few
   sub-hubs, the most central ones of what the blocks left over, and what is left over
   then meets the other blocks. No pair of different texts that shares a band goes
   untested unless both already are in one component.
5. Components come from the verified links (``components.py``).

With ``BANDS`` bands of ``ROWS`` registers a pair of Jaccard 0.8 shares no band with
probability (1 - 0.8**6)**48 = 5e-7.

Defined results: a null or empty text, or one without words, has an empty set, is linked
with nothing and is its own component, unless its doc_id has another row with words. A
null doc_id takes part in no link (component null, kept). Rows of one doc_id, repeated or
of different texts, are one node and share its component. Extra columns are ignored. An
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .components import connected_components
from .shared import checkpointed, small_batches

ROWS, BANDS = 6, 48
#: Shingles (8 bytes each, besides their text) and members of a block.
BLOCK, MEMBERS = 1_000_000, 8000
#: Pairs of entries of the prefix filter up to which it is used, and how many of them are held at once.
ENTRIES, HELD = 40_000_000, 2_000_000
#: Sub-hubs of a group, left-over members of a block from which on it names one, and members that it is compared with for that.
SUB_HUBS, MANY, COMPARED = 4, 64, 256
#: The estimate's standard error at 0.8 is 0.024; pairs below the threshold less SLACK (over eight of them) are not verified.
SLACK = 0.2


def _sketched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, bands = [], [], []
            for text in batch.column(2):
                s = sketch.shingles(text.as_py(), k)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(sketch.band_keys(sketch.registers(s, ROWS * BANDS), ROWS).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.binary())], names=["doc_id", "mark", "n_shingles", "set_key", "bands"])

    return run


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.int64)
        for i in range(0, batch.num_rows, 4096):
            ids, marks = batch.column(0).slice(i, 4096).to_numpy(zero_copy_only=False), batch.column(1).slice(i, 4096).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, BANDS)), pa.array(np.repeat(marks, BANDS)), pa.array(keys[i * BANDS : (i + len(ids)) * BANDS])], names=["id", "mark", "band"])


def _overlaps(sets: list[np.ndarray], rows: list[int]) -> np.ndarray:
    """Intersection sizes of sets[r], r in rows, with every set, by products of 0/1 blocks."""
    sizes = [len(s) for s in sets]
    at = np.repeat(np.arange(len(sets)), sizes)
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    at, column = at[shared], column[shared]
    out = np.zeros((len(rows), len(sets)), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    at, column = at[order], column[order]
    width = max(64, (1 << 22) // max(1, len(sets)))
    lo = 0
    while lo < len(column):
        first = column[lo]
        hi = int(np.searchsorted(column, first + width))
        x = np.zeros((len(sets), width), dtype=np.float32)
        x[at[lo:hi], column[lo:hi] - first] = 1
        out += x[rows] @ x.T
        lo = hi
    return out.astype(np.int64)


def _pairs(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in left, in right) of equal values, HELD pairs or so at a time; ``right`` is sorted."""
    lo, hi = np.searchsorted(right, left), np.searchsorted(right, left, side="right")
    upto = np.cumsum(hi - lo)
    start = 0
    while start < len(left):
        before = int(upto[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + HELD, side="right")))
        n = (hi - lo)[start:end]
        at = np.repeat(np.arange(start, end), n)
        if len(at):
            yield at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + lo[at]
        start = end


class _Group:
    """The texts of one block: ids, full sets, registers, and who is joined with whom."""

    def __init__(self, ids: list[int], texts: list[str | None], k: int):
        self.ids, self.sets = ids, [sketch.shingles(t, k) for t in texts]
        self.sizes = np.array([len(s) for s in self.sets])
        self._registers, self._known = np.zeros((len(ids), ROWS * BANDS), dtype=np.uint16), np.zeros(len(ids), dtype=bool)
        self.root = list(range(len(ids)))
        first: dict[int, int] = {}
        for i, x in enumerate(ids):
            self.root[i] = first.setdefault(x, i)

    def registers(self, rows: np.ndarray | list[int] | slice) -> np.ndarray:
        """Registers of these members, made when they are first asked for."""
        at = np.arange(len(self.ids))[rows]
        for i in np.unique(at[~self._known[at]]).tolist():
            self._registers[i] = sketch.registers(self.sets[i], ROWS * BANDS)
        self._known[at] = True
        return self._registers[rows]

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def _entries(self, percent: int) -> tuple[np.ndarray, ...]:
        """(shingle, member, place, in the shorter prefix) of the members' prefixes, by shingle.

        Shingles go from rare to common. A pair that reaches the threshold shares one that is
        in the prefix of the larger set and in the shorter prefix of the smaller one.
        """
        owner = np.repeat(np.arange(len(self.sets)), self.sizes)
        _, token, count = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
        order = np.lexsort((token, count[token], owner))
        token = token[order]  # owners are in order already
        place = np.arange(len(owner)) - (np.cumsum(self.sizes) - self.sizes)[owner]
        n = self.sizes[owner]
        keep = (place <= n - -(-percent * n // 100)) & (count[token] > 1)
        token, owner, place, n = token[keep], owner[keep], place[keep], n[keep]
        by = np.argsort(token, kind="stable")
        return token[by], owner[by], place[by], (place <= n - -(-2 * percent * n // (100 + percent)))[by]

    def _candidates(self, rows: list[int], percent: int, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]] | None:
        """Pairs (of numbers) that the prefix filter leaves, at least one of them in ``rows``; None if they are too many."""
        token, owner, place, short = self._entries(percent)
        mine = np.zeros(len(self.sets), dtype=bool)
        mine[rows] = True
        own = mine[owner]
        sides = [(short & own, ~own), (short & ~own, own)] + ([(short & own, own)] if within else [])
        many = sum(int((np.searchsorted(token[b], token[a], side="right") - np.searchsorted(token[b], token[a])).sum()) for a, b in sides)
        if many > ENTRIES:
            return None

        def run() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a, b in sides:
                x, px, y, py = owner[a], place[a], owner[b], place[b]
                for i, j in _pairs(token[a], token[b]):
                    small, large = x[i], y[j]
                    n, m = self.sizes[small], self.sizes[large]
                    fine = ((n < m) | ((n == m) & (small < large))) & (100 * n >= percent * m)
                    # what can still be shared from these places on
                    fine &= (100 + percent) * np.minimum(n - px[i], m - py[j]) >= percent * (n + m)
                    code = np.unique(small[fine] * len(self.sets) + large[fine])
                    yield code // len(self.sets), code % len(self.sets)

        return run()

    def _join(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.find(a), self.find(b)
        self.root[max(x, y)] = min(x, y)
        return self.ids[a], self.ids[b]

    def link(self, rows: list[int], percent: int, within: bool = True) -> Iterator[tuple[int, int]]:
        """Edges that join ``rows`` with any other text of the block, as far as not joined yet.

        Without ``within`` rows are not compared among themselves.
        """
        least = percent / 100 - SLACK
        found = self._candidates(rows, percent, within) if len(rows) > MANY else None
        if found is not None:
            for x, y in found:
                of = np.array([self.find(i) for i in range(len(self.sets))])
                apart = of[x] != of[y]
                x, y = x[apart], y[apart]
                for i in range(0, len(x), 20_000):
                    a, b = x[i : i + 20_000], y[i : i + 20_000]
                    near = sketch.estimate(self.registers(a), self.registers(b)) >= least
                    for r, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
                        if self.find(r) != self.find(j) and sketch.jaccard_at_least(self.sets[r], self.sets[j], percent):
                            yield self._join(r, j)
            return
        step = max(1, min(64, 40_000_000 // (len(self.sets) * ROWS * BANDS)))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            near = sketch.estimate(self.registers(part)[:, None], self.registers(slice(None))[None]) >= least
            near[np.arange(len(part)), part] = False
            if not within:
                near[:, rows] = False
            if verified := near.sum() > 500:  # many to verify: products of 0/1 blocks; else one by one
                both = _overlaps(self.sets, part)
                near &= 100 * both >= percent * (self.sizes[part][:, None] + self.sizes[None] - both)
            for r, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                if self.find(part[r]) != self.find(j) and (verified or sketch.jaccard_at_least(self.sets[part[r]], self.sets[j], percent)):
                    yield self._join(part[r], j)

    def central(self, rows: list[int]) -> tuple[int, float]:
        """The one of ``rows`` that is most alike to (up to COMPARED of) the others, and how much."""
        some = self.registers(rows[:: -(-len(rows) // COMPARED)])
        alike = [float(sketch.estimate(self.registers([r]), some).mean()) for r in rows]
        at = int(np.argmax(alike))
        return rows[at], alike[at]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of one key (the first columns) at a time, from batches that are sorted by it."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


LINKS = "a long, b long, hub long, score double"


def _edges(found: list[tuple[int, int]], named: list[tuple[int, int, float]] = ()) -> pa.RecordBatch:
    """Links (a, b), and nominations of sub-hubs (a for hub, with a score)."""
    rows = [(a, b, None, None) for a, b in found] + [(a, None, hub, score) for hub, a, score in named]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], names=["a", "b", "hub", "score"])


def _within(k: int, percent: int):
    """Links inside one block of a hub's group: hub first, then what it left over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        named: list[tuple[int, int, float]] = []
        for (hub, _), rows in _groups(batches, 2):
            if len(rows) < 2:
                continue
            group = _Group([r[1] for r in rows], [r[2] for r in rows], k)
            at = group.ids.index(hub)
            left = lambda: [i for i in range(len(rows)) if group.find(i) != group.find(at)]  # noqa: B023, E731
            out += group.link([at], percent)
            loose = left()
            if rows[0][0] > 1 and len(loose) > MANY:  # a group of several blocks
                pivot, score = group.central(loose)
                named.append((hub, group.ids[pivot], score))
                out += group.link([pivot], percent)
                loose = left()
            out += group.link(loose, percent)
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out, named)

    return run


def _across(k: int, percent: int):
    """Links between flagged members and the others of one cell; among the flagged ones too if the cell is theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, part, cell), rows in _groups(batches, 3):
            flagged, own = [i for i, r in enumerate(rows) if r[0]], cell == -1 - part
            if flagged and (own or len(flagged) < len(rows)) and len(rows) > 1:
                group = _Group([r[1] for r in rows], [r[2] for r in rows], k)
                yield _edges(list(group.link(flagged, percent, within=own)))

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of ``docs``.

    Two texts are linked if 100 * |A and B| >= percent * |A or B| for their sets of ``k``-word
    shingles. ``component_id`` is the smallest doc_id that links reach.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    sketched = checkpointed(rows.mapInArrow(_sketched(k), "doc_id long, mark long, n_shingles long, set_key binary, bands binary"))
    named = sketched.where("set_key is not null and doc_id is not null")
    # texts of one set: the smallest id stands for all
    # (kept apart from the joins below, so that Spark may split a key that a third of all rows share)
    same = checkpointed(named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").select("set_key", "rep"))
    copies = checkpointed(named.select("doc_id", "mark", "set_key").join(same, "set_key"))
    leads = copies.where("doc_id = rep").groupBy("set_key", "rep").agg(F.min("mark").alias("lead")).withColumnRenamed("set_key", "of")
    single = named.join(same, "set_key", "left_anti").select(F.col("doc_id").alias("id"), "mark", F.col("n_shingles").alias("n"), "bands")
    first = named.join(leads, (named.set_key == leads.of) & (named.doc_id == leads.rep) & (named.mark == leads.lead), "left_semi").groupBy(F.col("doc_id").alias("id"), "mark").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    reps = checkpointed(single.union(first))
    banded = reps.select("id", "mark", "bands").mapInArrow(_band_rows, "id long, mark long, band long")
    hubs = banded.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("band", "hub")
    members = banded.join(hubs, "band").select("hub", "id", "mark").distinct()
    members = checkpointed(members.join(reps.select("id", "mark", "n"), ["id", "mark"]).select("hub", "id", "mark", "n"))
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.count("*") / MEMBERS)).cast("int")
    wide = checkpointed(members.groupBy("hub").agg(blocks.alias("blocks")).where("blocks > 1"))
    if not wide.isEmpty():
        members = _merged(members, wide)
        wide = checkpointed(members.groupBy("hub").agg(blocks.alias("blocks")).where("blocks > 1"))
    placed = members.join(wide, "hub", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # a hub stands in every block of its group
    dealt = placed.where("id <> hub").select("hub", _block("blocks").alias("block"), "blocks", "id", "mark").union(placed.where("id = hub").select("hub", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "blocks", "id", "mark"))
    texts = _texts(rows, copies)
    dealt = dealt.join(texts, ["id", "mark"]).select("hub", "block", "blocks", "id", "text").repartition("hub", "block").sortWithinPartitions("hub", "block", "id")
    found = checkpointed(dealt.mapInArrow(_within(k, percent), LINKS))
    links = found.where("b is not null").select("a", "b")
    # rows of one id with different texts are one node, also where one of them is a copy of another id's
    several = named.groupBy("doc_id").count().where("count > 1").select("doc_id")
    links = checkpointed(links.union(copies.where("doc_id <> rep").join(several, "doc_id", "left_semi").select("doc_id", "rep").distinct()))
    if not wide.isEmpty():
        links = _between_blocks(links, found.where("b is null"), members.join(wide, "hub"), texts, k, percent)
    components = connected_components(links)
    out = sketched.select("doc_id", "n_shingles", "set_key").join(same, "set_key", "left").withColumn("rep", F.coalesce("rep", "doc_id")).join(components.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _merged(members: DataFrame, wide: DataFrame) -> DataFrame:
    """``members`` with large groups that share at least half of the smaller one's members as one, under the smallest hub.

    Texts that are much alike share many bands, each with a hub of its own; as one group
    they are compared once. A pair that shares a band still meets.
    """
    large = members.join(wide.select("hub"), "hub", "left_semi").select("hub", "id", "mark")
    sizes = large.groupBy("hub").agg(F.count("*").alias("size"))
    other = large.select(F.col("hub").alias("a"), "id", "mark")  # a text is in BANDS groups at most
    both = large.join(other, ["id", "mark"]).where("a < hub").groupBy("a", F.col("hub").alias("b")).agg(F.count("*").alias("both"))
    edges = both.join(sizes.withColumnRenamed("hub", "a"), "a").join(sizes.select(F.col("hub").alias("b"), F.col("size").alias("size_b")), "b").where(2 * F.col("both") >= F.least("size", "size_b"))
    into = connected_components(edges.select("a", "b"))
    moved = members.join(into.withColumnRenamed("node", "hub"), "hub", "left").select(F.coalesce("component", "hub").alias("hub"), "id", "mark", "n")
    return checkpointed(moved.distinct())


def _block(blocks: str, salt: int = 42):
    return F.pmod(F.xxhash64("id", "mark", F.lit(salt)), F.col(blocks)).cast("int")


def _texts(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """(id, mark, text), each id and text once."""
    texts = rows.withColumnRenamed("doc_id", "id")
    repeated = checkpointed(copies.groupBy(F.col("doc_id").alias("id"), "mark").count().where("count > 1").select("id", "mark"))
    if repeated.isEmpty():
        return texts
    once = texts.join(repeated, ["id", "mark"], "left_semi").groupBy("id", "mark").agg(F.first("text").alias("text"))
    return texts.join(repeated, ["id", "mark"], "left_anti").unionByName(once)


def _labelled(links: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` with ``loose``: not in their hub's component."""
    components = connected_components(links)
    labelled = members.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    of_hub = labelled.where("id = hub").select("hub", F.col("component").alias("home")).distinct()
    return checkpointed(labelled.join(of_hub, "hub").withColumn("loose", F.col("component") != F.col("home")).select("hub", "id", "mark", "n", "blocks", "loose"))


def _met(cells: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links of cells of (hub, part, cell, flag, id, mark)."""
    met = cells.join(texts, ["id", "mark"]).select("hub", "part", "cell", "flag", "id", "text")
    return met.repartition("hub", "part", "cell").sortWithinPartitions("hub", "part", "cell").mapInArrow(_across(k, percent), LINKS).where("b is not null").select("a", "b")


def _between_blocks(links: DataFrame, named: DataFrame, members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``links`` and those that groups of several blocks still lack: left-over members against all others."""
    labelled = _labelled(links, members)
    each = lambda n: F.expr(f"sequence(0, {n} - 1)")
    chosen = named.groupBy("hub").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "a")), False), 1, SUB_HUBS).alias("best")).select("hub", F.explode("best.a").alias("id"))
    subs = labelled.join(chosen, ["hub", "id"], "left_semi")
    if not subs.isEmpty():
        own = subs.select("hub", F.lit(0).alias("part"), F.explode(each("blocks")).alias("cell"), F.lit(True).alias("flag"), "id", "mark")
        others = labelled.where("loose").select("hub", F.lit(0).alias("part"), _block("blocks").alias("cell"), F.lit(False).alias("flag"), "id", "mark")
        links = checkpointed(links.union(_met(own.union(others), texts, k, percent)))
        labelled = _labelled(links, members)
    parts = labelled.where("loose").groupBy("hub").agg(F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.count("*") / MEMBERS)).cast("int").alias("parts"))
    labelled = labelled.join(parts, "hub").withColumn("own", _block("parts", 1))
    # every part of the left-over members meets every block of those that reached the hub, and each other part once
    home = labelled.where("not loose").select("hub", F.explode(each("parts")).alias("part"), _block("blocks").alias("cell"), F.lit(False).alias("flag"), "id", "mark")
    loose = labelled.where("loose")
    visits = loose.select("hub", F.col("own").alias("part"), F.explode(each("blocks")).alias("cell"), F.lit(True).alias("flag"), "id", "mark")
    stay = loose.select("hub", F.col("own").alias("part"), F.explode(F.expr("sequence(own, parts - 1)")).alias("other"), F.lit(True).alias("flag"), "id", "mark")
    go = loose.where("own > 0").select("hub", F.explode(F.expr("sequence(0, own - 1)")).alias("part"), F.col("own").alias("other"), F.lit(False).alias("flag"), "id", "mark")
    pairs = stay.union(go).select("hub", "part", (-1 - F.col("other")).alias("cell"), "flag", "id", "mark")
    return checkpointed(links.union(_met(home.union(visits).union(pairs), texts, k, percent)))
