import hashlib
import json

from embera.llm import chat_format as C

TRICKY = ["", None, "plain", "</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "back\\slash \\[INST] \\\\", "[[INST]", "<<SYS>> a <</SYS>>", "<<s>", "é😀\n<|", "<" * 5 + "|"]


def test_round_trip_and_loss(spark):
    rows = [(1, i, ["user", "assistant", None, "we<|end|>ird"][i % 4], t) for i, t in enumerate(TRICKY)]
    rows += [(2, None, "assistant", "a"), (2, None, "assistant", "a"), (2, 0, "assistant", "b"), (None, 0, "user", "lost")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in C.read_back(C.format_chat(turns)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r[2] or "", r[3] or "") for r in rows if r[0] == 1]
    assert got[1]["loss_text"] == "".join(t or "" for i, t in enumerate(TRICKY) if i % 4 == 1)
    assert [t["text"] for t in got[2]["turns"]] == ["a", "a", "b"]
    assert got[None]["turns"][0]["text"] == "lost"
    for r in got.values():
        assert all("[INST]" not in t and "</s>" not in t for t in r["formatted"].split("<|"))
        assert r["formatted"].count("<|turn|>") == len(r["turns"])


def test_layouts(spark):
    docs = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "extra": 1},
        {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        {"prompt": "hi", "response": "yo"},
        {"instruction": "hi", "output": "yo", "input": None},
        {"question": "hi", "answer": "yo", "id": 7},
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(90, "{}"), (91, None), (92, "no json"), (93, '{"a": 1}')], "conv_id long, j string")
    turns, unknown = C.turns_from_json(df, "j")
    got = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {i: [("user", "hi"), ("assistant", "yo")] for i in range(5)}
    assert sorted(r["conv_id"] for r in unknown.collect()) == [90, 91, 92, 93]
    table = spark.createDataFrame([(5, [("human", "hi")])], "conv_id long, conversations array<struct<from string, value string>>")
    assert C.canonical_turns(table).collect()[0].asDict() == {"conv_id": 5, "turn": 0, "role": "user", "text": "hi"}
    both = json.dumps({"prompt": "hi", "response": "yo", "conv_id": 4, "turn": 0, "role": "x", "text": "other"})
    turns, unknown = C.turns_from_json(spark.createDataFrame([(1, both)], "conv_id long, j string"), "j")
    assert [r["text"] for r in turns.orderBy("turn").collect()] == ["hi", "yo"] and not unknown.collect()


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, head string, size int, formatted string")
    assert C.read_back(C.format_chat(C.canonical_turns(empty))).collect() == []
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def test_json_that_does_not_fit(spark):
    say = lambda role, content: json.dumps({"messages": [{"role": role, "content": content}, {"role": "assistant", "content": "yo"}]})
    rows = [
        say("user", 7),
        say("user", [{"type": "text", "text": "h"}, {"type": "image"}, "i"]),
        say("user", True),
        say("user", {"a": 1}),
        say(["user"], "hi"),
        say(None, None),
        json.dumps({"messages[]": {"role": "user", "content": "hi"}}),
        json.dumps({"messages": None}),
        json.dumps({"messages": []}),
        json.dumps({"messages": [{"role": "user", "content": "a"}, 5]}),
        '{"prompt": "\\ud800 a", "response": "\\ud83d\\ude00"}',
        "[" * 3000 + "]" * 3000,
        '{"a": ' + "[" * 100_000,
        json.dumps({"prompt": 1.5, "response": ["x"]}),
        json.dumps({"conversations": [{"from": "human", "value": "x" * 200_000}, None]}),
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "conv_id long, j string").selectExpr("*", "'x' as turn", "'y' as role", "'z' as r", "'w' as fingerprint", "'v' as turns", "'u' as t")
    turns, unknown = C.turns_from_json(df, "j")
    got = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    yo = ("assistant", "yo")
    assert got == {
        0: [("user", "7"), yo],
        1: [("user", "hi"), yo],
        2: [("user", "true"), yo],
        5: [(None, None), yo],
        10: [("user", "� a"), ("assistant", "\U0001f600")],
        14: [("user", "x" * 200_000)],
    }
    assert sorted(r["conv_id"] for r in unknown.collect()) == [3, 4, 6, 7, 8, 9, 11, 12, 13]
    back = C.read_back(C.format_chat(turns)).where("conv_id = 14").collect()[0]
    assert back["turns"][0]["text"] == "x" * 200_000


def test_tables_of_other_kinds(spark):
    """Another id column, contents that aren't text, parts, null and empty arrays, names with dots."""
    rows = spark.createDataFrame([(3, 0, "user", 5)], "chat long, turn int, role string, text int")
    assert C.canonical_turns(rows, "chat").collect()[0].asDict() == {"conv_id": 3, "turn": 0, "role": "user", "text": "5"}
    nested = spark.createDataFrame([(1, [("user", 4)]), (2, None), (3, [])], "conv_id long, messages array<struct<role string, content int>>").selectExpr("*", "'x' as turn", "'y' as t")
    assert [tuple(r) for r in C.canonical_turns(nested).collect()] == [(1, 0, "user", "4")]
    parts = spark.createDataFrame([(1, [("user", [("text", "a"), ("text", None), ("text", "b")])])], "conv_id long, messages array<struct<role string, content array<struct<type string, text string>>>>")
    assert [tuple(r) for r in C.canonical_turns(parts).collect()] == [(1, 0, "user", "ab")]
    odd = spark.createDataFrame([(1, "a", "b")], ["conv_id", "messages[].role", "messages[].content"])
    try:
        C.canonical_turns(odd)
        raise AssertionError("a column of that name is no array")
    except ValueError:
        pass
