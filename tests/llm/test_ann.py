import numpy as np

from embera.llm import ann


def exact(rows, k, every):
    fine = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == len(rows[0][1])]
    out = {}
    for q, v in fine:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def run(spark, rows, k, every):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, k, every).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 20)
    monkeypatch.setattr(ann, "ROW_PART", 50)
    monkeypatch.setattr(ann, "QUERY_PART", 7)
    monkeypatch.setattr(ann, "COPIES", 100)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 8)).astype(np.float32)
    x[7] *= 3  # long, so that its own copies are what lies nearest by inner product
    x[100:400] = x[7]  # a third of all rows is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want, got = exact(rows, 10, 20), run(spark, rows, 10, 20)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    score = {q: dict(v) for q, v in want.items()}
    assert np.mean([i in score[q] for q, v in got.items() for i, _ in v]) >= 0.9
    for q, v in got.items():
        assert v == sorted(v, key=lambda h: (-h[1], h[0]))
        assert all(abs(s - float(x[q].astype(float) @ x[i].astype(float))) < 1e-9 for i, s in v)
    # the hot vector's own neighbours are its copies, smallest ids first
    assert [i for i, _ in got[120]] == [7, *range(100, 109)]


def test_bad_vectors_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 0.0]), (40, None), (60, [1.0, float("nan")]), (80, [1.0, None]), (3, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (2, [0.5, 0.5]), (100, [float("inf"), 1.0]), (4, [-1.0, 0.0])]
    assert run(spark, rows, 20, 20) == {0: [(1, 0.5), (2, 0.5), (4, -1.0)]}
    assert run(spark, [(0, [1.0, 2.0])], 5, 20) == {}
    assert run(spark, [(1, None)], 5, 20) == {}


def test_repeated_queries_and_candidates(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 4)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = run(spark, rows, 5, 20)
    # a query's row that is repeated is one query, and not its own neighbour
    assert run(spark, rows + [rows[20], rows[20]], 5, 20)[20] == want[20]
    # a repeated candidate counts as often as it is there
    near = want[20][0][0]
    assert run(spark, rows + [rows[near]], 5, 20)[20] == [want[20][0], want[20][0], *want[20][1:4]]
    # one vec_id with two vectors has two lists
    two = ann.search(spark.createDataFrame(rows + [(20, x[7].tolist())], "vec_id long, embedding array<float>"), 5, 20).where("query_id = 20").collect()
    assert sorted(r["rank"] for r in two) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_overflow_is_nearest_and_clashes_are_ignored(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, 0.0]), (2, [5.0, 5.0]), (3, [-1e200, 1.0]), (4, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in ann.search(df, 4, 20).orderBy("rank").collect()]
    assert [i for i, _ in got] == [1, 2, 4, 3] and got[0][1] == float("inf") and got[3][1] == float("-inf")
    names = ["v", "vector", "leaf", "shelf", "query", "mark", "id", "n", "often", "rank", "row_part", "query_part", "leaves", "score", "query_id"]
    clash = df.selectExpr("*", *(f"'x' as `{n}`" for n in names))
    assert ann.search(clash, 4, 20).count() == 4


def test_recall_is_measured_on_other_queries(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 10)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 16)) * 3
    x = centres[rng.integers(30, size=3000)] + rng.standard_normal((3000, 16)) * 0.3
    index = ann.build_index(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 10, 5)
    assert index.recall >= 0.9 and int(index.sizes.sum()) == 3000 and index.visits < len(index.sizes)
