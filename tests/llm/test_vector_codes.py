import math
import random
from fractions import Fraction

from embera.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts, entries, rounds):
    """Codes and codebooks by plain Lloyd rounds over Python's numbers; rows are (vec_id, vector, label)."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // parts)
    cut = [[math.floor(Fraction(x) * 4096) for x in list(r[1]) + [0.0] * (parts * width - len(r[1]))] for r in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in cut]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p], e, strict=True)), i) for i, e in enumerate(books[p])) for p in range(parts)] for v in cut]

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, a in zip(cut, at, strict=True) if a[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    codes = []
    for r, a in zip(kept, assign(), strict=True):
        error = sum(d for d, _ in a)
        codes.append((r[0], "".join(f"{e:02x}" for _, e in a), error if error < 2**63 and all(d < 2**63 for d, _ in a) else None, r[2]))
    return codes, books


def got(spark, rows, schema=SCHEMA, **how):
    codes, books = V.compress(spark.createDataFrame(rows, schema), **how)
    out = V.with_label_errors(codes).select("vec_id", V.code_text().alias("code"), "error", "label", "label_error").collect()
    return out, books


def check(spark, rows, schema=SCHEMA, parts=4, entries=3, rounds=4):
    out, books = got(spark, rows, schema, parts=parts, entries=entries, rounds=rounds)
    want, want_books = brute(rows, parts, entries, rounds)
    assert books == want_books
    assert sorted(map(repr, ((r["vec_id"], r["code"], r["error"], r["label"]) for r in out))) == sorted(map(repr, want))
    for r in out:
        same = [e for _, _, e, label in want if label == r["label"]]
        assert r["label_error"] == (sum(same) if None not in same else None)


def test_like_brute_force_and_hot_entries(spark, monkeypatch):
    rng = random.Random(5)
    hot = [rng.uniform(-1, 1) for _ in range(8)]
    rows = [(i, hot if i % 3 == 0 else [rng.choice([-1, 1]) * rng.random() for _ in range(8)], rng.choice([1, 2, None])) for i in range(300)]
    rows = [(i, [float(f"{x:.3f}") for x in map(lambda x: round(x * 256) / 256, v)], c) for i, v, c in rows]
    check(spark, rows)
    monkeypatch.setattr(V, "OWNED", 40)  # many owners for each entry
    monkeypatch.setattr(V, "BLOCK", 7)
    check(spark, rows, rounds=6)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25, 1.0], 1), (1, [0.5, -0.25, 1.0], 1), (2, None, 1), (3, [nan, 1.0, 1.0], 2), (4, [inf, 0.0, 0.0], 2), (5, [None, 1.0, 2.0], 2), (None, [0.0, -0.125, 3.0], None), (-7, [1.0], None), (8, [], 3), (9, [0.0, 0.0, 0.0, 0.0, 2.0], 3)]
    check(spark, rows, parts=2)
    check(spark, rows, parts=8, entries=16)


def test_huge_components_are_exact(spark):
    rows = [(i, [(-1.0) ** i * 2.0**90 * i, 1.0, 2.0**20], i % 2) for i in range(7)] + [(i, [0.5, float(i), 0.0], 7) for i in range(7, 12)]
    check(spark, rows, parts=3, entries=2)
    wide = [(i, [1.7e308 * (-1) ** i, float(i)], 1) for i in range(4)]
    check(spark, wide, "vec_id long, embedding array<double>, label int", parts=2, entries=2)


def test_empty_table_text_labels_and_clashing_columns(spark):
    out, books = got(spark, [], SCHEMA)
    assert out == [] and books == [[]] * 8
    rows = [(i, [i / 8.0, -i / 4.0], "a" if i % 2 else None, "x", i) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, row string, entry int")
    codes, books = V.compress(df, parts=2, entries=4, rounds=3)
    want, want_books = brute([r[:3] for r in rows], 2, 4, 3)
    assert books == want_books
    assert sorted((r["vec_id"], r["text"], r["error"], str(r["label"])) for r in codes.select("*", V.code_text().alias("text")).collect()) == sorted((a, b, c, str(d)) for a, b, c, d in want)


def test_only_parts_that_change_entry_move(spark):
    """Residents and arrivals share a partitioner: a round adds no partitions."""
    owners = V.Owners(1, 2, 1)
    books = [[[0], [8192]]]
    import numpy as np

    part = np.array([[0.0], [0.1], [1.9]], dtype=np.float32)
    state = spark.sparkContext.parallelize([(0, [np.arange(3), part])]).partitionBy(4)
    stay = state.mapPartitions(V._moved(owners, books, False), preservesPartitioning=True)
    away = state.mapPartitions(V._moved(owners, books, True))
    assert [(k, c[0].tolist()) for k, c in away.collect()] == [(1, [2])]
    both = stay.union(away.partitionBy(4))
    assert both.getNumPartitions() == 4 and sorted((k, c[0].tolist()) for k, c in both.collect()) == [(0, [0, 1]), (1, [2])]
