import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from embera.operators import clusters, conflicts, evaluation, probe, routing, search, tags


def test_search(spark):
    df = spark.createDataFrame([("d/a.jpg", [1.0, 0.0, 0.0, 0.0]), ("d/b.png", [0.6, 0.8, 0.0, 0.0]), ("d/sub/c.tiff", [0.0, 1.0, 0.0, 0.0]), ("d/z.jpg", [0.0] * 4), ("d/n.jpg", None)], "file_path string, embedding array<float>")
    got = search.rank(search.score(df, [1, 0, 0, 0]), "file_path").collect()
    assert [(r["file_path"], round(r["similarity"], 6)) for r in got] == [("d/a.jpg", 1.0), ("d/b.png", 0.6), ("d/sub/c.tiff", 0.0)]
    assert search.exclude(df, "file_path", "D/A.JPG").count() == 4
    assert search.dimension_matches(df, [1, 0, 0, 0]) and not search.dimension_matches(df, [1, 0])
    assert search.rank(search.score(df, [1, 0, 0, 0]), "file_path", 1).count() == 1


def test_after_search(spark):
    at = spark.createDataFrame([(0.10,), (0.25,), (0.30,)], "similarity double")
    assert search.at_least(at, 0.25).count() == 2
    a = spark.createDataFrame([("a1", 0, 0.5), ("x", 0, 0.4)], "archive_path string, page_index int, similarity double")
    b = spark.createDataFrame([("b1", 0, 0.6), ("x", 0, 0.45)], a.schema)
    got = search.rank(search.merge_roots([a, b], ["archive_path", "page_index"]), "archive_path").collect()
    assert [(r["archive_path"], r["similarity"]) for r in got] == [("b1", 0.6), ("a1", 0.5), ("x", 0.4)]


@pytest.mark.parametrize("values", [[0.1, 0.2, 0.3, 0.4], [0.5], [0.2] * 7, [0.1, 0.1, 0.9], [random.Random(1).random() for _ in range(501)]])
def test_distribution(spark, values):
    r = search.distribution(spark.createDataFrame([(v,) for v in values] + [(None,)], "similarity double"), bins=16).first()
    assert (r["n"], r["lowest"], r["highest"], r["median"]) == (len(values), min(values), max(values), sorted(values)[len(values) // 2])


def test_probe(spark, monkeypatch):
    files = spark.range(33000).selectExpr("concat('t/p', id, '.jpg') as file_path", "case when id % 100 = 75 then 'late' else 'm' end as last_modified", "id as file_size", "id")
    cache = spark.range(33000).where("id % 100 <> 50").selectExpr("concat('t/p', id, '.jpg') as file_path", "'m' as last_modified", "id as file_size", "array(cast(1 as float)) as embedding")
    out = probe.probe_status(files, cache)
    assert {r["status"]: r["count"] for r in out.groupBy("status").count().collect()} == {"miss": 330, "stale": 330, "hit": 32340}
    assert out.where("embedding is not null").count() == 32340
    r = probe.hit_rate(out).first()
    assert (r["total"], r["hits"], r["misses"]) == (33000, 32340, 660) and abs(r["hit_percent"] - 98) < 1e-9
    twice = spark.createDataFrame([("a", "1", 1), ("a", "2", 2)], "file_path string, last_modified string, file_size long")
    assert probe.first_probes(twice).count() == 1
    stored = spark.createDataFrame([("a", "2", 2)], "file_path string, last_modified string, file_size long")
    assert [r["status"] for r in probe.probe_status(twice, stored).collect()] == ["stale"]  # the first entry counts
    later = twice.selectExpr("*", "-file_size as place")
    assert [r["status"] for r in probe.probe_status(later, stored, order="place").collect()] == ["hit"]
    ages = spark.createDataFrame([("M", "2024-13-99 bad"), ("m", "2024-02-01T00:00:00Z"), ("n", "2023-05-05 10:00:00"), ("n", None)], "model_name string, created_at string")
    info = probe.cache_info(ages, ages.limit(0), ages.where("model_name = 'M'")).first()
    assert info.asDict() == {"total": 5, "files": 4, "archives": 0, "covers": 1, "models": "m, n", "oldest": "2023-05-05 10:00:00", "newest": "2024-02-01T00:00:00Z"}
    sample = probe.diagnostics_sample(files.where("id < 76"), cache, 76).collect()
    assert len(sample) == 76 and {r["status"] for r in sample} == {"fresh", "stale", "miss"}
    for hint in ("broadcast", "merge", "shuffle_hash"):
        assert probe.probe_status(files, cache, hint).where("status = 'hit'").count() == 32340
    assert probe.probe_fresh(files, cache).count() == 32340
    joined = lambda: probe.probe_status(files, cache, "broadcast", unique=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in joined()
    monkeypatch.setattr(probe, "BROADCAST", 1000)  # a larger cache isn't broadcast, whatever the hint says
    assert "strategy=broadcast" not in joined()
    boxes = spark.createDataFrame([("a", 2, "1", 1, [[1.0], [2.0]]), ("b", 99, "1", 1, [[1.0]]), ("c", 1, "0", 1, [[1.0]])], "archive_path string, page_count int, last_modified string, file_size long, pages array<array<float>>")
    asked = spark.createDataFrame([(x, "1", 1) for x in "abcd"], "file_path string, last_modified string, file_size long")
    assert {r["file_path"]: r["status"] for r in probe.archive_status(asked, boxes).collect()} == {"a": "hit", "b": "inconsistent", "c": "stale", "d": "miss"}


def test_broadcast_hint_goes_by_measured_rows(spark, tmp_path):
    """Files of few bytes (runs of equal values) that hold many rows."""
    spark.range(50_000).select(F.lit("a" * 1000).alias("file_path"), F.lit("1").alias("last_modified"), F.lit(1).cast("long").alias("file_size")).write.parquet(str(tmp_path / "cache"))
    cache, files = spark.read.parquet(str(tmp_path / "cache")), spark.createDataFrame([("b", "1", 1)], "file_path string, last_modified string, file_size long")
    assert int(str(cache._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20
    joined = lambda: probe.probe_status(files, cache, "broadcast", unique=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in joined()
    assert "strategy=broadcast" in probe.probe_status(files, cache.limit(100), "broadcast", unique=True)._jdf.queryExecution().optimizedPlan().toString()


def points(spark, groups):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(groups)], "id long, features array<double>")


TWO = [(1, 1), (1.1, 1), (1, 1.1), (10, 10), (10.1, 10), (10, 10.1)]
THREE = [(0, 0), (0.1, 0), (5, 5), (5.1, 5), (10, 10), (10.1, 10)]


def partition(df):
    by = {}
    for r in df.collect():
        by.setdefault(r["cluster"], set()).add(r["id"])
    return sorted(map(sorted, by.values()))


def test_kmeans(spark):
    assigned, centroids = clusters.kmeans(points(spark, TWO), 2)
    assert partition(assigned) == [[0, 1, 2], [3, 4, 5]] and len(centroids) == 2
    assert clusters.optimal_k(points(spark, TWO), "id") == 2
    assert clusters.optimal_k(points(spark, THREE), "id", 5) == 3
    assert clusters.optimal_k(points(spark, TWO[:2]), "id") == 2
    one, _ = clusters.kmeans(points(spark, [(1, 1)]), 1)
    assert [r["cluster"] for r in one.collect()] == [0]
    assert len(clusters.kmeans(points(spark, TWO[:2]), 10)[1]) <= 2
    assert clusters.kmeans(points(spark, []), 3)[0].collect() == []
    nine = points(spark, [(x + d, x) for x in (0, 20, 40) for d in (0, 0.1, 0.2)])
    assert len(partition(clusters.kmeans(nine, 3)[0])) == 3
    far, _ = clusters.lloyd(points(spark, [(0, 0), (1, 0)]), [[0, 0], [100, 100]])
    assert {r["cluster"] for r in far.collect()} == {0}
    ties = clusters.assign_nearest(points(spark, [(0, 0)]), [[1, 0], [-1, 0]])
    assert ties.first()["cluster"] == 0
    assert [r["members"] for r in clusters.members(assigned, "id").orderBy(F.expr("members[0]")).collect()] == [[0, 1, 2], [3, 4, 5]]


@pytest.mark.parametrize("block", [3, 2000])
def test_silhouette(spark, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    rng = np.random.default_rng(2)
    x, label = rng.standard_normal((25, 3)), rng.integers(0, 3, 25)
    label[0] = 9  # alone in its cluster
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x, strict=True))], "id long, cluster int, features array<double>")
    want = {}
    for i in range(25):
        d = np.linalg.norm(x - x[i], axis=1)
        mine = [j for j in range(25) if label[j] == label[i] and j != i]
        if mine:
            a, b = d[mine].mean(), min(d[label == c].mean() for c in set(label.tolist()) - {label[i]})
            want[i] = (b - a) / max(a, b)
    got = {r["id"]: r["silhouette"] for r in clusters.silhouettes(df, "id").collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_silhouette_tasks_are_bounded(spark, monkeypatch):
    """A task has a block of points and a part of the rows; null clusters, null vectors and one point twice count as in SQL."""
    monkeypatch.setattr(clusters, "BLOCK", 5)
    monkeypatch.setattr(clusters, "PART", 6)
    monkeypatch.setattr(clusters, "STEP", 2)
    rng = np.random.default_rng(3)
    x, label = rng.standard_normal((60, 3)).astype(np.float32), rng.integers(0, 3, 60).tolist()
    x[7], label[8], label[9] = x[6], None, None
    rows = [(i, label[i], None if i == 10 else x[i].tolist()) for i in range(60)]
    out = clusters.silhouettes(spark.createDataFrame(rows, "id long, cluster int, features array<float>"), "id")
    want = {}
    for i in set(range(60)) - {8, 9, 10}:
        d = {c: [np.linalg.norm(x[j].astype(float) - x[i]) for j in range(60) if label[j] == c and j not in (i, 10)] for c in range(3)}
        a, b = np.mean(d[label[i]]), min(np.mean(d[c]) for c in d if c != label[i])
        want[i] = (b - a) / max(a, b)
    got = {r["id"]: r["silhouette"] for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert out._jdf.queryExecution().optimizedPlan().toString().count(", 120\n") >= 1  # 59 rows: 12 blocks, 10 parts


def test_tags(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("z", [0.0, 0.0])], "file_path string, embedding array<float>")
    got = tags.preselect(tags.generate_tags(df, [("x", [1, 0]), ("y", [1, 0]), ("w", [0.3, 0]), ("x", [1, 0])], top_k=2))
    rows = [(r["file_path"], r["rank"], r["tag"], r["is_selected"]) for r in got.orderBy("file_path", "rank").collect()]
    assert rows == [("a", 1, "x", True), ("a", 2, "y", True), ("b", 1, "x", False), ("b", 2, "y", False)]
    assert {r["tag"]: r["n"] for r in tags.tag_counts(got).collect()} == {"x": 1, "y": 1}


def test_evaluation(spark):
    df = spark.createDataFrame([("cat", "cat"), ("cat", "dog"), ("dog", "dog"), ("dog", "bird"), ("cat", None)], "true_label string, predicted string")
    m = evaluation.confusion_matrix(df, ["cat", "dog"])
    assert {(r[0], r[1]): r[2] for r in m.collect()} == {("cat", "cat"): 1, ("cat", "dog"): 1, ("dog", "dog"): 1}
    got = {r["label"]: tuple(round(r[c], 4) for c in ("tp", "fp", "fn", "precision", "recall", "f1")) for r in evaluation.class_metrics(m, ["cat", "dog", "eel"]).collect()}
    assert got == {"cat": (1, 0, 1, 1, 0.5, 0.6667), "dog": (1, 1, 0, 0.5, 1, 0.6667), "eel": (0, 0, 0, 0, 0, 0)}
    r = evaluation.accuracy_summary(df).first()
    assert (r["total"], r["correct"], r["accuracy"]) == (5, 2, 0.4)


NOON = datetime(2024, 1, 1, 12)


def found(spark, rows, minutes=1.0):
    df = spark.createDataFrame([(i, f"p{i}", c, NOON + timedelta(seconds=s)) for i, (c, s) in enumerate(rows)], "id long, path string, class string, created timestamp_ntz")
    return sorted(sorted(r["ids"]) for r in conflicts.timestamp_conflicts(df, minutes).collect())


@pytest.mark.parametrize(
    "rows,want",
    [
        ([("cat", 0), ("dog", 30)], [[0, 1]]),
        ([("cat", 0), ("cat", 30)], []),
        ([("cat", 0), ("dog", 600)], []),
        ([("cat", 0), ("dog", 20), ("cat", 40)], [[0, 1, 2]]),
        ([("cat", 0), ("dog", 30), ("bird", 300), ("fish", 320)], [[0, 1], [2, 3]]),
        ([], []),
        ([("cat", 0)], []),
        ([("cat", 0), ("dog", 60)], []),
        ([("cat", 0), ("cat", 50), ("dog", 70)], [[1, 2]]),
    ],
)
def test_conflicts(spark, rows, want):
    assert found(spark, rows) == want


def greedy(rows, window):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1], i))
    out, i = [], 0
    while i < len(order):
        group = [j for j in order[i:] if rows[j][1] - rows[order[i]][1] < window]
        if len({rows[j][0] for j in group}) > 1:
            out.append(sorted(group))
            i += len(group)
        else:
            i += 1
    return sorted(out)


@pytest.mark.parametrize("together,span", [(2, 3000), (3, 100_000), (64, 600)])
def test_conflicts_like_the_rule(spark, monkeypatch, together, span):
    monkeypatch.setattr(conflicts, "TOGETHER", together)  # maps are composed in several levels
    monkeypatch.setattr(conflicts, "_BLOCK", 5)
    rnd = random.Random(together)
    rows = [(rnd.choice("abc"), rnd.randrange(span)) for _ in range(200)]
    monkeypatch.setattr(conflicts, "SLICE_ROWS", 7)
    assert found(spark, rows) == greedy(rows, 60)
    assert found(spark, rows, 0) == []


def test_a_dense_feed_is_no_single_task(spark, monkeypatch):
    """Without any gap, slices still go by themselves, and what enters them is chained."""
    monkeypatch.setattr(conflicts, "SLICE_ROWS", 40)
    monkeypatch.setattr(conflicts, "TOGETHER", 5)
    rnd = random.Random(1)
    rows = [(rnd.choice("aaaaab"), i * 3 + rnd.randrange(3)) for i in range(2500)]
    assert found(spark, rows) == greedy(rows, 60)


def test_a_burst_is_cut_by_its_rows(spark):
    """100 minutes of 50 rows a second and one stray old file: slices of about equally many rows."""
    import numpy as np

    window = 60_000_000
    burst = spark.range(300_000).select((F.lit(1_700_000_000_000_000) + F.col("id") * 20_000).alias("us"))
    starts = conflicts._starts(burst.union(spark.createDataFrame([(1_262_304_000_000_000,)], "us long")), window)
    us = np.r_[1_262_304_000_000_000, 1_700_000_000_000_000 + np.arange(300_000) * 20_000]
    held = np.bincount(np.searchsorted(starts, us, side="right") - 1)
    assert len(held) >= 6 and held.sum() == 300_001 and held.max() <= conflicts.SLICE_ROWS + 3000


def test_maps_compose_like_single_steps(spark):
    rnd = random.Random(2)
    maps = [[rnd.randrange(4) for _ in range(4)] if rnd.random() < 0.7 else [rnd.randrange(4)] for _ in range(40)]
    place, want = 0, []
    for m in maps:
        want.append(place)
        place = m[place] if len(m) > 1 else m[0]
    df = spark.createDataFrame(list(enumerate(maps)), "slice long, exits array<long>")
    for together in (2, 7, 64):
        conflicts.TOGETHER, kept = together, conflicts.TOGETHER
        got = conflicts._entries(df, len(maps)).orderBy("slice").collect()
        conflicts.TOGETHER = kept
        assert [r["entry"] for r in got] == want


def test_input_order(spark):
    asked = spark.createDataFrame([("b", 2), ("a", 1), ("z", 3), ("b", 0)], "path string, place int")
    got = search.in_input_order(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "path string, score double"), asked, "path", "place")
    assert [tuple(r) for r in got.collect()] == [(0, "b", 2.0), (1, "a", 1.0), (2, "b", 2.0), (3, "z", None)]


def test_sorting(spark):
    df = spark.createDataFrame([(1, "i/a.jpg", "cat", 0.9), (2, "i/b.jpg", "dog", 0.2), (3, "i/c.jpg", None, None), (4, "i/d.jpg", "cat", 0.99)], "id long, path string, class string, confidence double")
    plan = routing.routing_plan(df, "/out/", 0.5, spark.createDataFrame([(4,), (4,)], "id long"))
    assert {r["id"]: (r["action"], r["destination"]) for r in plan.collect()} == {1: ("sort", "/out/cat/a.jpg"), 2: ("low_confidence", None), 3: ("failed", None), 4: ("conflict", None)}
    assert routing.sort_summary(plan).first().asDict() == {"total": 4, "sorted": 1, "skipped": 3, "conflicts_skipped": 1}
    assert [tuple(r) for r in routing.files_per_class(plan).collect()] == [("cat", 1)]


def test_names_and_history(spark, tmp_path):
    df = spark.createDataFrame([(1, "a_p1.png"), (2, "A_P1.png"), (3, "b.png")], "n int, name string")
    taken = spark.createDataFrame([("a_p1.png",), ("a_p1 (1).png",)], "name string")
    assert [r["target_name"] for r in routing.clash_free_names(df, "name", ["n"], taken).orderBy("n").collect()] == ["a_p1 (2).png", "A_P1 (3).png", "b.png"]
    assert [r["target_name"] for r in routing.clash_free_names(df, "name", ["n"]).orderBy("n").collect()] == ["a_p1.png", "A_P1 (1).png", "b.png"]
    numbered = spark.createDataFrame([(1, "a.jpg", 0), (2, "a.jpg", 0), (3, "a (1).jpg", 0), (4, "A (1).jpg", 0), (5, "a.jpg", 0), (6, "b", 0), (7, "b", 0), (8, "b (01)", 0), (9, "a (4).jpg", 0)], "n int, name string, copy int")
    used = spark.createDataFrame([("A (3).JPG",), ("a (4).jpg",), ("c",)], "name string")
    got = routing.clash_free_names(numbered, "name", ["n"], used).orderBy("n").collect()
    assert [r["target_name"] for r in got] == ["a.jpg", "a (2).jpg", "a (1).jpg", "A (1) (1).jpg", "a (5).jpg", "b", "b (1)", "b (01)", "a (4) (1).jpg"] and got[0]["copy"] == 0
    asked = spark.createDataFrame([("a", 1), ("b", 2), ("A", 3)] + [(f"query{i}", 10 + i) for i in range(9)], "q string, at int")
    got = [r["query"] for r in routing.history(asked, [], "q", "at").orderBy("position").collect()]
    assert got == [*(f"query{i}" for i in range(8, -1, -1)), "A"]
    (tmp_path / "a.jpg").write_bytes(b"x")
    plan = spark.createDataFrame([(str(tmp_path / "a.jpg"), str(tmp_path / "o" / "a.jpg")), (str(tmp_path / "no.jpg"), str(tmp_path / "o" / "n.jpg"))], "path string, destination string")
    assert [r["done"] for r in routing.carry_out(plan).orderBy("path").collect()] == [True, False] and (tmp_path / "o" / "a.jpg").read_bytes() == b"x"


def test_a_move_that_is_tried_again_reports_every_file_once(spark, tmp_path):
    """A task that stopped after half of its rows runs again as a whole, in each of the three steps."""
    rows = [(str(tmp_path / "in" / f"{i}.jpg"), str(tmp_path / "out" / ("ab"[i % 2]) / f"{i}.jpg")) for i in range(10)]
    (tmp_path / "in").mkdir()
    for i, (source, _) in enumerate(rows):
        open(source, "wb").write(b"%d" % i)
    for step in (lambda s, t: routing.stage_file(s, t, "r", True), lambda s, t: routing.publish_file(s, t, "r"), routing.remove_source):
        for source, target in rows[:5]:
            step(source, target)
        for source, target in rows:
            step(source, target)
    assert sorted(p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()) == sorted(b"%d" % i for i in range(10)) and not os.listdir(tmp_path / "in")
    assert not [p for p in (tmp_path / "out").rglob(".r-*")]


def test_moves_and_copies_through_the_plan(spark, tmp_path):
    for name in ("a", "b", "c", "same"):
        (tmp_path / name).write_bytes(name.encode())
    p = lambda *x: str(tmp_path.joinpath(*x))
    plan = spark.createDataFrame([(p("a"), p("o", "1")), (p("a"), p("o", "2")), (p("b"), p("o", "3")), (p("c"), p("o", "3")), (p("none"), p("o", "4")), (p("same"), p("same")), (p("b"), None)], "path string, destination string")
    done = routing.carry_out(plan, move=True)
    for _ in range(2):  # to look again moves nothing
        got = {(os.path.basename(r["path"]), os.path.basename(r["destination"])): r["done"] for r in done.collect()}
        assert got == {("a", "1"): True, ("a", "2"): True, ("b", "3"): False, ("c", "3"): True, ("none", "4"): False, ("same", "same"): True}
    assert sorted(os.listdir(tmp_path)) == ["b", "o", "same"] and sorted(os.listdir(tmp_path / "o")) == ["1", "2", "3"]
    assert (tmp_path / "o" / "3").read_bytes() == b"c"
    again = routing.carry_out(spark.createDataFrame([(p("o", "1"), p("o", "2")), (p("b"), p("o", "2"))], plan.schema))
    assert sorted(r["done"] for r in again.collect()) == [False, True] and (tmp_path / "o" / "2").read_bytes() == b"a" and (tmp_path / "b").exists()
