from embera.llm.line_dedup import dedup_lines

COMMON, NEAR = "All rights reserved.", "Nearly common"


def rows():
    out = [(i, f"own {i}\n {COMMON}\t\n\n{NEAR if i % 12 < 9 else 'other'}\n{COMMON}", f"s{i % 12}", 0) for i in range(36)]
    return out + [(100, None, "s1", 0), (101, "", "s2", 0), (102, COMMON, None, 0), (103, "x\n" * 3000, "s1", 0), (None, COMMON, "s3", 0)]


def test_lines(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: r for r in dedup_lines(df, 10).collect()}
    assert len(got) == len(rows())
    assert got[None]["text"] == COMMON and got[None]["n_removed"] == 0  # comes first
    for i in range(36):
        assert got[i]["text"] == f"own {i}\n\n{NEAR if i % 12 < 9 else 'other'}" and got[i]["n_removed"] == 2 and got[i]["n_chars"] == len(got[i]["text"])
    assert got[100]["text"] is None and got[101]["text"] == "" and got[102]["text"] == "" and got[103]["text"] == "x\n" * 3000
    # nine sites are spread enough for a threshold of nine
    assert dedup_lines(df, 9).where(f"text like '%{NEAR}%'").count() == 1


def test_repeats_clashes_and_empty(spark):
    base = [(1, COMMON, "a"), (1, COMMON, "a")] + [(i, COMMON, f"b{i}") for i in range(2, 15)]
    df = spark.createDataFrame(base, "doc_id long, text string, source string").selectExpr("*", "1 as line", "2 as pos", "'k' as _gone2")
    got = dedup_lines(df, 5).collect()
    assert sorted(r["text"] for r in got if r["doc_id"] == 1) == [COMMON, COMMON] and all(r["text"] == "" for r in got if r["doc_id"] > 1)
    assert dedup_lines(df.limit(0), 5).collect() == []
    assert dedup_lines(df, 5).columns == [*df.columns, "n_removed"]


def test_any_extra_column(spark):
    """Every name that the operator uses inside may be a column of the caller's."""
    names = ["k_id", "k_hash", "k_len", "site", "pos", "raw", "line", "sites", "sketch", "first", "places", "row", "left", "own_id", "own_hash", "own_len", "_gone", "_id", "_hash", "_len", "n_removed", "a.b"]
    df = spark.createDataFrame([(i, COMMON, f"b{i}") for i in range(6)] + [(None, None, None), (1, COMMON, "b1")], "doc_id long, text string, source string").selectExpr("*", *(f"'x' as `{n}`" for n in names))
    got = dedup_lines(df, 3)
    assert got.columns == [c for c in df.columns if c != "n_removed"] + ["n_removed"]
    assert sorted((str(r["doc_id"]), str(r["text"]), r["pos"]) for r in got.collect()) == sorted([("0", COMMON, "x"), ("1", "", "x"), ("1", "", "x"), *((str(i), "", "x") for i in range(2, 6)), ("None", "None", "x")])


def test_few_sites_are_enough_at_any_size(spark):
    """By default a line on five sites goes and one on four stays, in a corpus of six sites or of sixty."""
    for sites in (6, 60):
        rows = [(i, f"own {i}\n{'wide' if i < 5 else 'narrow' if i < 9 else 'rest ' + str(i)}", f"s{i % sites if i < 5 else i % 4 if i < 9 else i % sites}") for i in range(80)]
        got = {r["doc_id"]: r["n_removed"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
        assert {i for i, n in got.items() if n} == {1, 2, 3, 4}


def test_a_table_without_sources_has_one_site(spark):
    from embera.llm.line_dedup import dedup_lines

    docs = spark.createDataFrame([(i, f"same line\nown {i}") for i in range(8)], "doc_id long, text string")
    assert {r["n_removed"] for r in dedup_lines(docs).collect()} == {0}
    assert {r["n_removed"] for r in dedup_lines(docs, min_sites=1).collect()} == {0, 1}
