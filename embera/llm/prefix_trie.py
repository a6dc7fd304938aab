"""A trie of conversations' turns, built by bursting.

A turn is named by an id of 20 bytes (16 of the digest of role and text, 4 for the code
points of the text), so a conversation is a path of ids and texts never move. Equal paths
collapse to one suffix that counts its conversations. Suffixes lie in containers, one under
each head of the trie. A container of more than LIMIT suffixes bursts: its suffixes go to
new containers by their next turn id, after the turns that all of them share, which make a
chain of nodes. Bursting goes on until no container is oversized. Then each container is
sorted and swept once, with a stack of the nodes of the current path, and the heads' totals
are summed from the deepest burst upward.

A container is bounded, so a first turn that a third of all conversations have is no hot
task. What a task holds is one path and the finished children of its nodes. Conversations
that end at one node are listed in blocks of neighbouring ids, made by all tasks, and one
task passes over a node's blocks for its digest.

Defined results: rows without conv_id belong to no conversation; a null role or text is
empty. Turns are ordered by turn, null first, then role, then text; repeated rows are turns
each. One task holds the turn ids of a conversation (not its texts). A conversation may be
turnless and is then a member of the root. Extra columns are ignored. An empty table gives
no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import checkpointed

#: Suffixes that a container holds, and heads that are broadcast at most.
LIMIT, FEW = 1000, 50_000
#: Bytes of a turn id; its last 4 are the code points of the text.
ID = 20
#: Conversations whose ids differ in these lower bits only are listed together.
_NEAR = 12
_NONE = hashlib.sha256(b"").hexdigest()
NODES = "node string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_id(role: str, text: str) -> Column:
    """The id of a turn in hex."""
    named = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.substring(named, 1, 32), F.lpad(F.hex(F.length(text)), 8, "0"))


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the hex ids of each conversation's turns in order."""
    empty = F.lit("")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("given"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"),
    )
    named = rows.withColumn("id", turn_id("role", "text"))

    def listed(df: DataFrame, *order: str) -> DataFrame:
        return df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*order, "id"))).alias("turns"))

    plain = checkpointed(listed(named, "given", "turn"))
    places = F.transform("turns", lambda t: F.struct(t["given"], t["turn"]))
    tied = F.size(F.array_distinct(places)) < F.size(F.array_distinct("turns"))
    ids = F.transform("turns", lambda t: t["id"]).alias("turns")
    ties = plain.where(tied).select("conv_id")
    if ties.isEmpty():
        return plain.select("conv_id", ids)
    # different turns in one place: only for these conversations, go by role and text
    place = Window.partitionBy("conv_id", "given", "turn").orderBy("role", "text")
    exact = listed(named.join(ties, "conv_id", "left_semi").withColumn("nth", F.row_number().over(place)), "given", "turn", "nth")
    return plain.where(~tied).select("conv_id", ids).unionByName(exact.select("conv_id", ids))


def rebuild(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Each conversation begins with the first h turns of the last id before it that ``every`` divides,
    h = crc32(id) modulo ``most``, and goes on with its own turns after its first h."""
    own = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    heads = own.where("base = conv_id").select("base", F.slice("turns", 1, max(most - 1, 1)).alias("head"))
    first = F.coalesce(F.expr("slice(head, 1, h)"), F.array().cast("array<string>"))
    return own.join(heads, "base", "left").select("conv_id", F.concat(first, F.expr("slice(turns, h + 1, greatest(size(turns), 1))")).alias("turns"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each path, of its blocks, which come sorted."""
    path, n, low, digest = None, 0, 0, hashlib.sha256()
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())

    def rows(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=["path", "n", "low", "ends"])

    for batch in batches:
        done = []
        for p, m, least, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p == path:
                n += m
                low = min(low, least)
                digest.update(b"," + ids.encode())
                continue
            if path is not None:
                done.append((path, n, low, digest.hexdigest()))
            path, n, low, digest = p, m, least, hashlib.sha256(ids.encode())
        if done:
            yield rows(done)
    if path is not None:
        yield rows([(path, n, low, digest.hexdigest())])


def suffixes(turns: DataFrame) -> DataFrame:
    """(path, n, low, ends): the different paths, their conversations' number, smallest id and digest."""
    paths = turns.select("conv_id", F.unhex(F.array_join("turns", "")).alias("path"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = paths.groupBy("path", F.shiftright("conv_id", _NEAR).alias("block")).agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), listed.alias("ids"))
    dealt = blocks.repartition("path").sortWithinPartitions("path", "block").select("path", "n", "low", "ids")
    return dealt.mapInArrow(_hashed, "path binary, n long, low long, ends string")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it has FEW rows at most (counted); else it is shuffled like any other table."""
    return F.broadcast(df) if df.count() <= FEW else df


def _prefix(path: str, depth: str) -> Column:
    return F.expr(f"substring({path}, 1, {ID} * ({depth}))")


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at their beginning."""
    most = min(len(a), len(b))
    at = 0
    while at < most and a[at : at + ID] == b[at : at + ID]:
        at += ID
    return at // ID


def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_common(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def _burst(live: DataFrame, limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """Suffixes in containers of at most ``limit``, and the heads of each round of bursting."""
    rounds: list[DataFrame] = []
    shared = F.pandas_udf(_shared, "int")
    while True:
        key = _prefix("path", "d").alias("key")
        over = checkpointed(live.groupBy(key).count().where(F.col("count") > limit).select("key"))
        if over.isEmpty():
            return live, rounds
        inside = live.withColumn("key", key).join(_small(over), "key")
        ends = inside.groupBy("key").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.min("path").alias("a"), F.max("path").alias("z"), F.first("d").alias("d"), F.first("parent").alias("parent"))
        found = ends.withColumn("l", shared("a", "z"))
        heads = checkpointed(found.select("key", "n", F.col("low").alias("head_low"), "d", "l", F.col("parent").alias("head_parent"), _prefix("a", "l").alias("prefix")))
        to = heads.select("key", "l", "head_low")
        placed = live.withColumn("key", key).join(_small(to), "key", "left")
        size = F.length("path") / ID
        stopped = placed.where(size == F.col("l")).select("key", "ends")
        live = checkpointed(placed.where(F.col("l").isNull() | (size > F.col("l"))).select("path", "n", "low", "ends", F.coalesce(F.col("l") + 1, "d").alias("d"), F.coalesce("head_low", "parent").alias("parent")))
        rounds.append(checkpointed(heads.join(stopped, "key", "left")))


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers whose paths come sorted; ``above`` is the path above a container's first node."""
    # on the stack: [conv_id, n_convs, n_children, n_leaves, saved, ends, code points, finished children]
    stack: list[list] = []
    top, parent, path = 0, 0, b""
    names = ["node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "above"]
    kinds = [pa.string(), *[pa.int64()] * 7, pa.string(), pa.binary()]
    out: list[tuple] = []

    def finish() -> None:
        low, n, children, leaves, saved, ends, chars, waiting = stack.pop()
        depth = top + len(stack)
        mine = (hashlib.sha256(path[: ID * depth]).hexdigest(), low, depth, n, children, max(leaves, 1), saved + (n - 1) * chars, ends)
        out.extend((*w[:3], low, *w[3:], None) for w in waiting)
        if not stack:
            out.append((*mine[:3], parent, *mine[3:], path[: ID * (top - 1)]))
            return
        up = stack[-1]
        up[0], up[1], up[2], up[3], up[4] = min(up[0], low), up[1] + n, up[2] + 1, up[3] + mine[5], up[4] + mine[6]
        up[7].append(mine)

    def rows() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        out.clear()
        return batch

    for batch in batches:
        for p, n, low, ends, d, above in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            same = _common(p, path) if stack and d == top else 0
            while stack and top + len(stack) - 1 > (same if same >= top else 0):
                finish()
                if len(out) >= 5000:
                    yield rows()
            if not stack:
                top, parent = d, above
            path = p
            size = len(p) // ID
            for depth in range(top + len(stack), size + 1):
                stack.append([low, 0, 0, 0, 0, _NONE, int.from_bytes(p[ID * depth - 4 : ID * depth], "big"), []])
            stack[-1][1], stack[-1][5] = n, ends
    while stack:
        finish()
    if out:
        yield rows()


def _chars(path: str, depth: Column) -> Column:
    """Code points of the text at a depth of a path."""
    return F.conv(F.hex(F.substring(path, depth * ID - 3, F.lit(4))), 16, 10).cast("long")


def _totals(children: DataFrame) -> DataFrame:
    return children.groupBy("above").agg(F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))


def trie(turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Nodes of the trie of ``turns`` (conv_id, turns: ids in hex; one row for each conversation).

    ``node`` is the SHA-256 of the path of turn ids, by which other conversations find it (see ``longest_prefix``).
    """
    paths = checkpointed(suffixes(turns))
    whole = paths.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max(F.when(F.length("path") == 0, F.col("ends"))).alias("ends"))
    n, low, ends = whole.first()  # one row
    live = paths.where(F.length("path") > 0).select("path", "n", "low", "ends", F.lit(1).alias("d"), F.lit(low).cast("long").alias("parent"))
    live, rounds = _burst(live, limit)
    sorted_ = live.withColumn("key", _prefix("path", "d")).repartition("key").sortWithinPartitions("path").select("path", "n", "low", "ends", "d", "parent")
    nodes = checkpointed(sorted_.mapInArrow(_swept, NODES + ", above binary"))
    swept = checkpointed(_totals(nodes.where("above is not null").select("above", F.lit(1).alias("n_children"), "n_leaves", F.col("saved_tokens").alias("saved"))))
    out = [nodes.drop("above")]
    tops = swept
    for heads in reversed(rounds):
        below = F.transform(F.sequence("d", "l"), lambda k: _chars("prefix", k) * (F.col("n") - 1))
        full = checkpointed(heads.join(tops.withColumnRenamed("above", "prefix"), "prefix").withColumn("costs", below))
        saved = F.col("saved") + F.aggregate(F.expr("slice(costs, depth - d + 1, l - depth + 1)"), F.lit(0).cast("long"), lambda a, b: a + b)
        chain = full.withColumn("depth", F.explode(F.sequence("d", "l")))
        last = F.col("depth") == F.col("l")
        out.append(chain.select(
            F.sha2(_prefix("prefix", "depth"), 256).alias("node"), F.col("head_low").alias("conv_id"), F.col("depth").cast("long").alias("depth"),
            F.when(F.col("depth") == F.col("d"), F.col("head_parent")).otherwise(F.col("head_low")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", saved.alias("saved_tokens"),
            F.when(last, F.coalesce("ends", F.lit(_NONE))).otherwise(_NONE).alias("ends_sha256"),
        ))
        all_costs = F.aggregate("costs", F.lit(0).cast("long"), lambda a, b: a + b)
        mine = full.select(_prefix("key", "d - 1").alias("above"), F.lit(1).alias("n_children"), "n_leaves", (F.col("saved") + all_costs).alias("saved"))
        tops = checkpointed(_totals(swept.unionByName(mine)))
    root = tops.where(F.length("above") == 0).agg(F.coalesce(F.sum("n_children"), F.lit(0)).alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    if n is not None:
        out.append(root.select(
            F.lit(_NONE).alias("node"), F.lit(low).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
            F.lit(n).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.lit(ends or _NONE).alias("ends_sha256"),
        ))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def longest_prefix(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, shared_with, n_convs): the deepest node that each conversation of ``turns`` runs
    through, and its smallest member; depth 0 is the root."""
    prefixes = turns.select("conv_id", F.unhex(F.array_join("turns", "")).alias("path"), F.explode(F.sequence(F.lit(0), F.size("turns"))).alias("at"))
    asked = prefixes.select(F.col("conv_id").alias("asking"), F.sha2(_prefix("path", "at"), 256).alias("node"))
    met = asked.join(nodes.select("node", "depth", F.col("conv_id").alias("shared_with"), "n_convs"), "node")
    best = met.groupBy("asking").agg(F.max(F.struct("depth", "shared_with", "n_convs")).alias("best"))
    return best.select(F.col("asking").alias("conv_id"), "best.*")
