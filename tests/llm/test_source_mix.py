import pytest

from embera.llm import source_mix as M


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = [s for s in open_ if level * w[s] > most * sizes[s]]
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


@pytest.mark.parametrize("bucket", [5, 20_000])
def test_mix(spark, monkeypatch, bucket):
    monkeypatch.setattr(M, "BUCKET", bucket)
    rows = [(i, "wort " * (i % 7) + "é\t" * (i % 3), ["a", "b", "ä", None, "hot", "hot", "hot"][i % 7]) for i in range(400)]
    rows += [(1000, "big " * 3000, "b"), (1001, None, "a"), (1002, "", "e"), (None, "x y z", "a"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, size int, bucket string")
    weight = spark.createDataFrame([(i, [0.25, 1.0, None][i % 3]) for i in range(300)], "doc_id long, weight double")
    got = M.mix_sources(df, weight).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        # whole epochs come before anything else
        assert r["taken"] >= int(want[r["source"]] / max(1, sizes[r["source"]]) + 1e-9) * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, M.mix_sources(df.repartition(7), weight).collect()), key=str)


def test_rows_of_the_mix(spark):
    rows = [(i, f"a{i}\tb  c\nd" if i % 2 else "w " * 9 + "end", f"s{i % 3}", 7) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    picks = {r["doc_id"]: r for r in M.mix_sources(df).collect()}
    got = M.mixed_documents(df).collect()
    seen = {}
    for r in got:
        whole = rows[r["doc_id"]][1]
        assert whole.startswith(r["text"]) and (r["n_chars"] == len(r["text"]))
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + len(r["text"].split())
    assert seen == {i: p["taken"] for i, p in picks.items() if p["taken"]}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix_sources(df).collect() == [] and M.mixed_documents(df).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert sorted((r["doc_id"], r["target"], r["taken"]) for r in M.mix_sources(blank).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    assert "Python" not in M.mix_sources(df)._jdf.queryExecution().toString()


def test_weights_matter(spark):
    """Documents of a higher weight are sampled more often by the fractional part."""
    df = spark.range(3000).selectExpr("id as doc_id", "'a b c d' as text", "case when id % 3 = 0 then 'a' else 'b' end as source")
    weight = spark.range(3000).selectExpr("id as doc_id", "case when id % 2 = 0 then 1.0 else 0.1 end as weight")
    got = M.mix_sources(df, weight, weights=(1, 1), share=0.5).where("source = 'b'").collect()
    good = sum(r["taken"] for r in got if r["doc_id"] % 2 == 0)
    assert good > 2 * sum(r["taken"] for r in got if r["doc_id"] % 2)


def test_any_extra_column_and_repeated_rows(spark):
    """Names that the operator uses inside, rows that are repeated, and texts of one doc_id in two sources."""
    names = ["_id", "_md5", "_size", "_words", "_mark", "row", "own_id", "own_source", "own_md5", "size", "words", "parts", "epochs", "part", "taken", "target", "text_md5", "cut", "count", "key", "u", "weight", "bucket", "a.b"]
    rows = [(i, f"w{i} x y z", f"s{i % 2}") for i in range(20)] + [(3, "w3 x y z", "s1")] * 2 + [(3, "w3 x y z", "s0"), (None, "a b", None), (None, "a b", None), (50, None, "s0"), (51, "", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", *(f"'x' as `{n}`" for n in names))
    picks = {}
    for r in M.mix_sources(df).collect():
        key = r["doc_id"], r["source"]
        picks[key] = picks.get(key, 0) + r["taken"]
    got = M.mixed_documents(df)
    assert got.columns == df.columns
    seen = {}
    for r in got.collect():
        seen[r["doc_id"], r["source"]] = seen.get((r["doc_id"], r["source"]), 0) + len(r["text"].split())
    assert seen == {k: v for k, v in picks.items() if v}


def test_odd_weights(spark):
    df = spark.range(40).selectExpr("id as doc_id", "'a b c' as text", "'s' as source")
    weight = spark.range(40).selectExpr("id as doc_id", "case id % 5 when 0 then double('NaN') when 1 then double('Infinity') when 2 then null when 3 then -1.0 else 0.5 end as weight")
    got = M.mix_sources(df, weight, share=0.5).collect()
    assert len(got) == 40 and abs(sum(r["taken"] for r in got) - 60) <= 1
    assert sum(r["taken"] for r in got if r["doc_id"] % 5 == 3) == 0  # the least of all weights come last


def test_many_sources_in_ranges(spark):
    """Ranks and sums of sources by range are those of one order."""
    sizes = {f"host{i:04d}": 1 + (i * 37) % 91 for i in range(300)} | {None: 5}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long").repartition(6)
    want = targets(sizes)
    for r in M.source_targets(df, (3, 1, 2), 1.5, 2.0).collect():
        assert abs(r["target"] - want[r["source"]]) < 1e-6


@pytest.mark.parametrize("weights", [(0, 1, 2), (), (1, -1), (float("nan"),), (float("inf"), 1)])
def test_weights_of_sources_are_checked(spark, weights):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="positive"):
        M.mix_sources(docs, weights=weights)


@pytest.mark.parametrize("summed", [False, True])
def test_weights_are_not_broadcast(spark, monkeypatch, tmp_path, summed):
    """Compressed files of weights are small, whatever their rows take of the driver."""
    plans, kept = [], M.checkpointed
    monkeypatch.setattr(M, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    spark.range(3000).selectExpr("id as doc_id", "if(id % 2 = 0, 1.0, 0.25) as weight").write.parquet(f"{tmp_path}/weights")
    weight = spark.read.parquet(f"{tmp_path}/weights")
    weight = weight.groupBy("doc_id").agg({"weight": "avg"}).toDF("doc_id", "weight") if summed else weight
    docs = spark.range(2000, 5000).selectExpr("id as doc_id", "'a b c' as text", "concat('s', id % 3) as source")
    got = M.mix_sources(docs, weight).collect()
    assert len(got) == 3000 and sum(r["taken"] for r in got) == pytest.approx(1.5 * 9000, abs=3)
    assert "doc_id" in plans[0] and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
