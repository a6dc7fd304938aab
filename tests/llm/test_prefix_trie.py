import hashlib
import random
import zlib

import pytest

from embera.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = (convs.get(base, [])[:h]) + own[h:]
    return out


def brute(convs):
    """Node rows of {conv_id: turns}, from the definition."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def totals(node):
        leaves, saved = (0 if node in children else 1), (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        for child in children.get(node, []):
            a, b = totals(child)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    rows = []
    for node, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(node))
        rows.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children.get(node, [])), *totals(node), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def nodes_of(turns, limit=P.LIMIT):
    return sorted((tuple(r) for r in P.trie(turns, limit).drop("node").collect()), key=repr)


def conversations(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def random_rows(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 900), n):
        for turn in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([turn, turn, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "ccc", "", None, "\U0001f600é"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_like_brute_force(spark, limit):
    rows = random_rows(3)
    turns = P.rebuild(P.conversation_turns(conversations(spark, rows))).cache()
    convs = rebuilt(rows)
    assert nodes_of(turns, limit) == brute(convs)
    turns.unpersist()


def plain_turns(spark, convs):
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    return P.conversation_turns(conversations(spark, rows))


def test_hot_first_turn_long_shared_prefix_and_copies(spark):
    shared = [("system", "s" * 7)] + [("user", f"u{i}") for i in range(30)]
    convs = {c: [*shared, ("user", f"own {c % 40}"), ("assistant", "x" * (c % 3))] for c in range(120)}
    convs |= {c: list(shared) for c in range(5000, 5100)}  # end where the others branch
    convs |= {c: shared[:1] for c in range(200, 205)}
    turns = plain_turns(spark, convs)
    want = brute(convs)
    assert nodes_of(turns, 5) == want == nodes_of(turns, 1000)
    live = P.checkpointed(P.suffixes(turns)).where("length(path) > 0").selectExpr("path", "n", "low", "ends", "1 as d", "0L as parent")
    left, rounds = P._burst(live, 5)
    most = left.groupBy(P._prefix("path", "d")).count().agg({"count": "max"}).first()[0]
    # 30 shared turns are one chain of a burst, not 30 rounds
    assert most <= 5 and 1 < len(rounds) <= 4


def test_blocks_of_members(spark, monkeypatch):
    monkeypatch.setattr(P, "_NEAR", 2)
    convs = {c: [("user", "same")] for c in [*range(-9, 30), 10**12, -(10**12)]}
    assert nodes_of(plain_turns(spark, convs)) == brute(convs)


def test_edges(spark):
    assert nodes_of(P.rebuild(P.conversation_turns(conversations(spark, [])))) == []
    assert nodes_of(P.conversation_turns(conversations(spark, [(None, 1, "user", "a")]))) == []
    # conversation 101 has one turn and h = 3, and its base is absent: turnless
    rows = [(101, 0, "user", "gone")]
    assert zlib.crc32(b"101") % 6 > 0
    assert nodes_of(P.rebuild(P.conversation_turns(conversations(spark, rows)))) == [(101, 0, None, 1, 0, 1, 0, hashlib.sha256(b"101").hexdigest())]


def test_ties_go_by_role_and_text_and_extra_columns_clash(spark):
    rows = [(0, 1, "b", "x", 1, "k"), (0, 1, "a", "z", 2, "k"), (0, 1, "a", "y", 3, "k"), (0, None, "z", "q", 4, "k"), (0, 1, "a", "y", 5, "k")]
    df = spark.createDataFrame(rows, SCHEMA + ", id int, path string")
    got = P.conversation_turns(df).first()["turns"]
    ids = {(r, t): spark.range(1).select(P.turn_id(*map(P.F.lit, (r, t)))).first()[0] for _, _, r, t, _, _ in rows}
    assert got == [ids[x] for x in [("z", "q"), ("a", "y"), ("a", "y"), ("a", "z"), ("b", "x")]]


def test_turns_are_told_apart_by_role_and_text(spark):
    convs = {1: [("user", "1:a")], 2: [("user1:", "a")], 3: [("", "user")], 4: [("user", "")]}
    assert nodes_of(plain_turns(spark, convs)) == brute(convs)


def test_longest_prefix(spark):
    nodes = P.trie(plain_turns(spark, {1: [("u", "a"), ("v", "b")], 2: [("u", "a"), ("v", "c")]}))
    asked = plain_turns(spark, {7: [("u", "a"), ("v", "c"), ("u", "d")], 8: [("u", "z")]})
    assert sorted(map(tuple, P.longest_prefix(nodes, asked).collect())) == [(7, 2, 2, 1), (8, 0, 1, 2)]
