import random

import pytest

from embera.llm import near_dup, sketch
from embera.llm.components import connected_components


def words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")


def shingle_set(text, k):
    w = [x for x in words(text) if x]
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i) if i is not None else None) for i, s in sets]


def corpus(n, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.6:
            w = (rnd.choice(rows)[1] or "").split()
            for _ in range(rnd.randint(0, 4)):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((i, rnd.choice([" ", "\n", "  "]).join(w)))
        else:
            rows.append((i, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 2, 3, 5, 8, 30, 90])))))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "Wort É"), (n + 4, "wort É"), (n + 5, "wort é"), (n + 6, "x y z v " * 20000)]


@pytest.mark.parametrize("k,block", [(4, 1_000_000), (5, 300)])
def test_like_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = corpus(260, k)
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, hub string, n int")
    got = near_dup.near_duplicates(df, k, 80).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(rows, k, 80))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f"), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(None, None, True), (3, 3, True), (3, 3, True), (5, 3, False), (6, 6, True)], key=str)
    assert near_dup.near_duplicates(df.limit(0)).collect() == []


def links_of(group, rows, percent, within=True):
    return list(group.link(rows, percent, within))


@pytest.mark.parametrize("many", [0, 10_000])
def test_links_of_a_block(monkeypatch, many):
    """The prefix filter and the comparison of all pairs join what brute force joins."""
    monkeypatch.setattr(near_dup, "MANY", many)
    monkeypatch.setattr(near_dup, "HELD", 50)
    rows = [r for r in corpus(150, 9) if near_dup.sketch.shingles(r[1], 4).size]
    group = near_dup._Group([i for i, _ in rows], [t for _, t in rows], 4)
    links_of(group, list(range(len(rows))), 80)
    want = {i: c for i, _, c in brute(rows, 4, 80)}
    got = {}
    for n, (i, _) in enumerate(rows):
        got.setdefault(group.find(n), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(i for i in want if want[i] == c) for c in set(want.values()))
    # rows of one side only: nothing among themselves
    half = list(range(0, len(rows), 2))
    group = near_dup._Group([i for i, _ in rows], [t for _, t in rows], 4)
    ids = {rows[i][0] for i in half}
    assert all((a in ids) != (b in ids) for a, b in links_of(group, half, 80, within=False))


def test_one_template_needs_few_comparisons(monkeypatch):
    """Texts of one template, about 0.7 alike: the prefix filter leaves next to no pairs."""
    common = " ".join(f"t{i}" for i in range(28))
    texts = [f"{common} " + " ".join(f"u{n}x{i}" for i in range(6)) for n in range(600)]
    group = near_dup._Group(list(range(600)), texts, 4)
    pairs = group._candidates(list(range(600)), 80, True)
    assert pairs is not None and sum(len(x) for x, _ in pairs) == 0


def test_repeated_ids_with_empty_or_other_texts(spark):
    long, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, long), (1, ""), (1, None), (2, long + " x"), (3, other), (2, other + " y"), (2, other + " y"), (4, long + " z q"), (4, long + " z q"), (9, other), (9, long)]
    names = ["mark", "id", "band", "bands", "hub", "set_key", "rep", "n", "of", "lead", "copies", "block", "blocks", "component_id", "kept", "n_shingles", "a", "b"]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *(f"'x' as `{n}`" for n in names))
    got = near_dup.near_duplicates(df, 4, 80).collect()
    assert len(got) == len(rows) and {(r["doc_id"], r["component_id"]) for r in got} == {(i, 1) for i in (1, 2, 3, 4, 9)}


@pytest.mark.parametrize("members", [25, 8000])
def test_groups_over_blocks(spark, monkeypatch, members):
    """Copies that are alike to one text but not to each other, and texts of a template, over several blocks."""
    monkeypatch.setattr(near_dup, "MEMBERS", members)
    rnd, base = random.Random(8), [f"b{i}" for i in range(60)]
    rows = []
    for i in range(160):
        w = list(base)
        w[rnd.randrange(60)] = f"n{i}"
        w[rnd.randrange(60)] = f"m{i}"
        rows.append((i, " ".join(w)))
    rows.append((500, " ".join(base)))  # what they come from has the largest id
    rows += [(1000 + i, " ".join(f"t{j}" for j in range(28)) + " " + " ".join(f"u{i // 2}x{j}" for j in range(6))) for i in range(80)]
    rows += [(2000 + i, " ".join(f"t{j}" for j in range(28)) + " " + " ".join(f"u{i}x{j}" for j in range(5)) + " end") for i in range(40)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(rows, 4, 80))


def test_group_of_copies_stays_linear(spark, monkeypatch):
    """Near copies of one text, some of them apart from the hub, over several blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 2000)
    rnd = random.Random(3)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 4])):
            w[rnd.randrange(80)] = f"n{i}"
        rows.append((i, " ".join(w)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(rows, 4, 80))


def test_word_hashes_over_chunks(monkeypatch):
    text = ("alpha beta\tgamma\n" * 500).encode()
    whole = sketch.word_hashes(text)
    monkeypatch.setattr(sketch, "_CHUNK", 64)
    assert (sketch.word_hashes(text) == whole).all() and len(whole) == 1500 and len(set(whole.tolist())) == 3


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(41), 100]}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
