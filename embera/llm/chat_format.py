"""Chat formatting by schema fingerprints.

The nested field paths of a layout (``messages[].role``) are hashed, and the hash selects
a declarative mapping that turns the layout into canonical turns (conv_id, turn, role,
text). Only paths that some mapping knows enter the hash, so extra columns change
nothing. Tables are fingerprinted by their schema; columns of JSON strings row by row.

The template writes each turn as ``<|turn|>role<|text|>text<|end|>``. Inside roles and
texts a backslash is doubled and one backslash is put after the first character of every
control string (this template's and other common ones), so a text can't end its own turn
and every text comes back exactly. The loss mask is a list of [start, end) code points
that cover the assistant texts.

Defined results: a null text or role is empty. Turns are ordered by turn (null first),
then role, then text, so repeated rows stay, side by side. Rows without conv_id form the
conversation of null conv_id, as in GROUP BY. A conversation is one training example, so
it has to fit one record. A null or empty array of messages gives no turns. Content may
be a text, a list of parts (texts, or objects with a ``text``), which are joined, or a
number or truth value, which is written as JSON. Rows of JSON that are no object, are
nested too deep to parse, or whose roles, messages or contents are of other kinds are
unknown, like those of unknown layouts; they give no turns and keep their fingerprint
(null if they can't be parsed). Lone surrogates of JSON texts become U+FFFD. A dot,
bracket or backslash in a field name is escaped in its path. Extra columns and fields
change nothing. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import small_batches

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What begins a control string, as the rest after its first character.
SQUARE, ANGLE = r"/?INST\]", r"/?s>|</?SYS>>|\|"

#: Layouts: name -> (the paths that identify it, a list of (role, path) or the array with its role and text fields).
LAYOUTS: dict[str, tuple[frozenset[str], object]] = {
    "turn_rows": (frozenset({"conv_id", "turn", "role", "text"}), None),
    "messages": (frozenset({"messages[].role", "messages[].content"}), ("messages", "role", "content")),
    "message_parts": (frozenset({"messages[].role", "messages[].content[].text"}), ("messages", "role", "content")),
    "dialogue": (frozenset({"conversations[].from", "conversations[].value"}), ("conversations", "from", "value")),
    "instruction": (frozenset({"instruction", "output"}), [("user", "instruction"), ("assistant", "output")]),
    "instruction_input": (frozenset({"instruction", "input", "output"}), [("user", "instruction"), ("user", "input"), ("assistant", "output")]),
    "prompt_response": (frozenset({"prompt", "response"}), [("user", "prompt"), ("assistant", "response")]),
    "prompt_completion": (frozenset({"prompt", "completion"}), [("user", "prompt"), ("assistant", "completion")]),
    "system_prompt_response": (frozenset({"system", "prompt", "response"}), [("system", "system"), ("user", "prompt"), ("assistant", "response")]),
    "question_answer": (frozenset({"question", "answer"}), [("user", "question"), ("assistant", "answer")]),
}
KNOWN = frozenset().union(*(paths for paths, _ in LAYOUTS.values()))
#: Names of speakers in dialogue layouts.
SPEAKERS = {"human": "user", "gpt": "assistant"}


def fingerprint(paths: set[str] | frozenset[str]) -> str:
    """Hash of the known field paths of a layout."""
    return hashlib.sha256("\n".join(sorted(paths & KNOWN)).encode()).hexdigest()[:16]


MAPPINGS = {fingerprint(paths): name for name, (paths, _) in LAYOUTS.items()}


def layout_of(paths: set[str], nested: bool = False) -> str | None:
    """The layout of these field paths, by their hash; None if no mapping knows it.

    Where paths of other layouts stand beside (``conv_id``, ``text``, ...), it is the
    layout of the most paths that are all there, the first of these in LAYOUTS. With
    ``nested``, layouts that spread a conversation over several rows are left out.
    """
    usable = {name: own for name, (own, how) in LAYOUTS.items() if how is not None or not nested}
    name = MAPPINGS.get(fingerprint(paths))
    if name not in usable:
        name = max((n for n, own in usable.items() if own <= paths), key=lambda n: len(usable[n]), default=None)
    return name


def _step(name: str) -> str:
    """A field's name as a step of a path: what would read as another step is escaped."""
    return re.sub(r"([\\.\[])", r"\\\1", name)


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Field paths of a schema; a step into an array is written []."""
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{_step(f.name)}" if at else _step(f.name)) for f in kind.fields)) if kind.fields else {at}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def json_paths(value: object, at: str = "") -> set[str]:
    """Field paths of a parsed JSON value; null fields don't count as present."""
    if isinstance(value, dict):
        return set().union(*(json_paths(v, f"{at}.{_step(k)}" if at else _step(k)) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(json_paths(v, f"{at}[]") for v in value)) if value else set()
    return set() if value is None else {at}


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) from a table whose schema is one of LAYOUTS; ``id_col`` stands for conv_id."""
    paths = {"conv_id" if p == _step(id_col) else p for p in schema_paths(df.schema)}
    name = layout_of(paths)
    if name is None:
        raise ValueError(f"no mapping for the layout {fingerprint(paths)}")
    how = LAYOUTS[name][1]
    conv_id = F.col(f"`{id_col}`").alias("conv_id")
    if how is None:
        return df.select(conv_id, F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    if isinstance(how, tuple):
        array, role, text = how
        turns = df.select(conv_id, F.posexplode(array).alias("turn", "t"))
        content = F.col("t")[text]
        if name == "message_parts":
            content = F.array_join(F.transform(content, lambda p: F.coalesce(p["text"].cast("string"), F.lit(""))), "")
        turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("t")[role].cast("string").alias("role"), content.cast("string").alias("text"))
        return turns.withColumn("role", F.coalesce(F.create_map(*(F.lit(x) for kv in SPEAKERS.items() for x in kv))[F.col("role")], F.col("role")))
    parts = [F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.col(path).cast("string").alias("text")) for i, (role, path) in enumerate(how)]
    return df.select(conv_id, F.explode(F.filter(F.array(*parts), lambda p: p["text"].isNotNull())).alias("p")).select("conv_id", "p.*")


class _Odd(Exception):
    """A value that no mapping can turn into text."""


def _sound(text: str) -> str:
    """``text`` with pairs of surrogates joined and lone ones as U+FFFD."""
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _content(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value if value is None else _sound(value)
    if isinstance(value, (bool, int, float)):
        return json.dumps(value)
    if isinstance(value, list):
        parts = [p.get("text") if isinstance(p, dict) else p for p in value]
        if all(p is None or isinstance(p, str) for p in parts):
            return _sound("".join(p or "" for p in parts))
    raise _Odd


def _role(value: object) -> str | None:
    if value is not None and not isinstance(value, str):
        raise _Odd
    return value if value is None else _sound(SPEAKERS.get(value, value))


def _turns(row: dict, how: object) -> list[dict]:
    """Turns of a parsed row by a mapping; _Odd if a value doesn't fit it."""
    if isinstance(how, tuple):
        messages = row.get(how[0])
        if not isinstance(messages, list) or not all(m is None or isinstance(m, dict) for m in messages):
            raise _Odd
        return [{"role": _role(m.get(how[1])), "text": _content(m.get(how[2]))} for m in messages if m is not None]
    return [{"role": role, "text": _content(row[path])} for role, path in how if row.get(path) is not None]


def _from_json(raw: pd.Series) -> pd.DataFrame:
    out = []
    for value in raw:
        mark = turns = None
        try:
            row = json.loads(value) if value is not None else None
            if isinstance(row, dict):
                paths = json_paths(row)
                mark, name = fingerprint(paths), layout_of(paths, nested=True)
                turns = _turns(row, LAYOUTS[name][1]) if name else None
        except (ValueError, RecursionError, _Odd):
            turns = None
        out.append((mark, turns))
    return pd.DataFrame(out, columns=["fingerprint", "turns"])


def turns_from_json(df: DataFrame, json_col: str, id_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """(turns, unknown): rows of JSON strings of any mix of layouts; unknown has (conv_id, fingerprint)."""
    _read = F.pandas_udf(_from_json, "fingerprint string, turns array<struct<role string, text string>>")
    read = df.select(F.col(f"`{id_col}`").alias("conv_id"), _read(F.col(f"`{json_col}`").cast("string")).alias("r"))
    turns = read.select("conv_id", F.posexplode("r.turns").alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")
    return turns, read.where("r.turns is null").select("conv_id", "r.fingerprint")


def escape(c: Column) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(c, rf"(\[)(?={SQUARE})|(<)(?={ANGLE})", r"$1$2\\")


_ESCAPED = re.compile(r"\\(\\?)")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_chat(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): one row per conversation.

    One shuffle by conv_id serves the running offsets and the grouping.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = turns.select("conv_id", "turn", "role", "text", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"), escape(F.col("text")).alias("body"))
    t = t.withColumn("size", F.length("head") + F.length("body") + F.lit(len(END))).withColumn("n", F.row_number().over(order))
    t = t.withColumn("start", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head"))
    span = F.when(F.coalesce(F.col("role"), F.lit("")) == learn, F.struct("start", (F.col("start") + F.length("body")).alias("end")))
    grouped = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span")))).alias("p"))
    return grouped.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), F.filter(F.transform("p", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation, unescaped."""
    return [tuple(unescape(x) for x in part.removeprefix(TURN).split(TEXT)) for part in formatted.split(END)[:-1]]


def _read_back(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for formatted, spans in parts:
        yield pd.DataFrame(
            {
                "turns": [[{"role": r, "text": x} for r, x in parse(f)] for f in formatted],
                "loss_text": ["".join(unescape(f[s["start"] : s["end"]]) for s in m) for f, m in zip(formatted, spans, strict=True)],
            }
        )


def read_back(chats: DataFrame) -> DataFrame:
    """Adds ``turns`` and ``loss_text``, parsed from ``formatted`` and ``loss_spans`` alone."""
    back = F.pandas_udf(_read_back, "turns array<struct<role string, text string>>, loss_text string")
    return small_batches(chats).withColumn("back", back("formatted", "loss_spans")).select("*", "back.turns", "back.loss_text").drop("back")
