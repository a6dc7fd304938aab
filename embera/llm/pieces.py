"""SentencePiece encoding that keeps offsets, and decoding, for BPE models.

A text is normalised by the model's compiled character map: a double array in which the
longest key that begins at a place is replaced by its value, and a character that begins no
key stays. Every normalised character remembers the byte of the source at which its key
began; so each piece of the encoding is projected to the source bytes from its own first
character to the next piece's, and the spans of a text's pieces follow each other without
gaps. Pieces come from merges in the order of their scores, leftmost first among equals.
A character without a piece falls back to its bytes, the last of which has the span.

No merge leads over a place where no piece has these two characters side by side, so texts
fall into units (a word with its space, for most), each of which a task encodes once.
Nothing is shuffled; the model is one file of about 1 MB, independent of the corpus, and
is broadcast. A lost executor costs only its own tasks again.

Defined results: a null text counts as empty; an empty text has the end id alone; texts are
never cut, and control symbols are never made of text. Extra columns are ignored. An empty
table gives an empty table. Unigram models, user-defined or unused pieces and white space
as suffix are refused with an error. In ``decode`` null ids give an empty text, and an id
outside of the vocabulary is an error.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import accumulate
from math import inf
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Units that a task remembers in each of two generations, and characters up to which merges are found by looking at all pairs.
REMEMBERED, SHORT = 300_000, 30
#: The symbol that stands for a space in pieces.
SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _replaced(e: UnicodeError) -> tuple[str, int]:
    """One replacement character for each byte that is no text."""
    assert isinstance(e, UnicodeDecodeError)
    return "�" * (e.end - e.start), e.end


codecs.register_error("embera-each-byte", _replaced)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class Memory:
    """What was found for texts. The older half goes when it is full, but for what was asked for since."""

    def __init__(self) -> None:
        self.newer: dict = {}
        self.older: dict = {}

    def room(self) -> dict:
        if len(self.newer) > REMEMBERED:
            self.newer, self.older = {}, self.newer
        return self.newer


class CharacterMap:
    """A compiled map of characters: the double array, then the values, each ended by a zero byte."""

    def __init__(self, blob: bytes = b""):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.values = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[str, int] | None:
        """(value, length) of the longest key that begins at ``at``."""
        if not self.units:
            return None
        units, node, found = self.units, 0, None
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units) or (unit := units[node]) & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        start, size = found
        return self.values[start : self.values.index(b"\0", start)].decode("utf-8"), size


class Model:
    """Vocabulary and rules of a model file."""

    def __init__(self, data: bytes):
        self.texts: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer: dict[int, int | bytes] = {}
        rules: dict[int, int | bytes] = {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.texts.append(piece.get(1, b"").decode("utf-8"))
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, _NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                rules = dict(fields(value))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or set(self.kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("only BPE models without user-defined or unused pieces and without white space as suffix")
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == _NORMAL}
        self.costs = {t: -scores[i] for t, i in self.ids.items()}
        self.unknown = self.kinds.index(_UNKNOWN)
        controls = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == _CONTROL}
        self.end = controls.get(trainer.get(47, b"</s>").decode("utf-8"))
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == _BYTE} if trainer.get(35) else {}
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode("utf-8")
        self.map = CharacterMap(rules.get(2, b""))
        self.dummy, self.squeeze, self.escape = bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1))
        #: Characters that stand side by side in a piece; merges stay inside of these.
        self.beside = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        self.known = Memory()
        # an unmapped word with its space is a unit of its own
        self.plain = not self.map.units and not self.squeeze and self.escape and not any(b[0] != SPACE and b[1] == SPACE for b in self.beside)

    def normalise(self, text: str, first: bool = True) -> tuple[str, list[int]]:
        """Normalised characters, and the source byte of each and of the end; ``first`` is false for later units of a text."""
        if self.plain and text:  # no key begins anywhere, so all characters stay
            at = [*range(len(text) + 1)] if text.isascii() else [0, *accumulate(1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4 for c in text)]
            text = text.replace(" ", SPACE)
            return (SPACE + text, [0, *at]) if first and self.dummy else (text, at)
        source = text.encode("utf-8", "surrogatepass")
        out: list[str] = []
        at = []
        done = 0
        space = SPACE if self.escape else " "

        def step() -> tuple[str, int]:
            if (found := self.map.longest(source, done)) is not None:
                return found
            lead = source[done]
            size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return source[done : done + size].decode("utf-8", "surrogatepass"), size

        if self.squeeze:
            while done < len(source):
                value, size = step()
                if value != " ":
                    break
                done += size
        if done == len(source):
            return "", [done]
        if first and self.dummy:
            out.append(space)
            at.append(done)
        spaced = self.squeeze
        while done < len(source):
            value, size = step()
            if spaced:
                value = value.lstrip(" ")
            if value:
                out.extend(value.replace(" ", space))
                at.extend([done] * len(value))
                spaced = self.squeeze and value.endswith(" ")
            done += size
        if self.squeeze:
            while out and out[-1] == space:
                out.pop()
                done = at.pop()
        return "".join(out), [*at, done]

    def merged(self, text: str) -> list[int]:
        """Id and characters of each piece of normalised text, one after the other, by merges in the order of scores."""
        if not text:
            return []
        beside, known, cuts = self.beside, self.known.room(), [0]
        cuts += [end for end, both in enumerate(map(add, text, text[1:]), 1) if both not in beside]
        out: list[int] = []
        for start, end in zip(cuts, [*cuts[1:], len(text)], strict=True):
            part = text[start:end]
            if (found := known.get(part)) is None:
                found = known[part] = self.known.older.get(part) or tuple(x for pair in self._merged(part) for x in pair)
            out += found
        return out

    def _merged(self, text: str) -> list[tuple[int, int]]:
        whole = self.ids.get(text)
        if len(text) == 1:
            return [(whole, 1)] if whole is not None else self._unknown(text)
        parts = self._by_looking(list(text)) if len(text) <= SHORT else self._by_heap(text)
        out: list[tuple[int, int]] = []
        for p in parts:
            found = self.ids.get(p)
            out += [(found, len(p))] if found is not None else self._unknown(p)
        return out

    def _by_looking(self, parts: list[str]) -> list[str]:
        cost = self.costs
        costs = [cost.get(x, inf) for x in map(add, parts, parts[1:])]
        while costs and (best := min(costs)) != inf:
            i = costs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = cost.get(parts[i] + parts[i + 1], inf)
            if i:
                costs[i - 1] = cost.get(parts[i - 1] + parts[i], inf)
        return parts

    def _by_heap(self, text: str) -> list[str]:
        n, cost = len(text), self.costs.get
        parts: list[str] = list(text)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        due: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                both = parts[i] + parts[after[i]]
                if (c := cost(both)) is not None:
                    due.append((c, i, both)) if not ready else heapq.heappush(due, (c, i, both))

        ready = False
        for i in range(n):
            offer(i)
        heapq.heapify(due)
        ready = True
        while due:
            _, i, both = heapq.heappop(due)
            j = after[i]
            if not parts[i] or j < 0 or len(parts[i]) + len(parts[j]) != len(both) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def _unknown(self, text: str) -> list[tuple[int, int]]:
        if not self.bytes:
            return [(self.unknown, len(text))]
        data = text.encode("utf-8", "surrogatepass")
        return [(self.bytes[b], len(text) if i == len(data) - 1 else 0) for i, b in enumerate(data)]


class Codec:
    """Encodes and decodes texts with one model; lives in a task."""

    def __init__(self, data: bytes):
        self.model = m = Model(data)
        self.heads, self.runs = Memory(), Memory()
        self.tails = Memory()  # by the word, without the space before it
        self.split = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")
        self.table = [b"" if k == _CONTROL else bytes([int(t[3:5], 16)]) if k == _BYTE else m.unknown_text.encode() if k == _UNKNOWN else t.replace(SPACE, " ").encode() for t, k in zip(m.texts, m.kinds, strict=True)]

    def _unit(self, source: str, first: bool) -> bytes:
        """Ids and source lengths of a unit's pieces, as pairs of unsigned 32-bit integers."""
        text, at = self.model.normalise(source, first)
        out, place = array("I"), 0
        pieces = iter(self.model.merged(text))
        for piece, size in zip(pieces, pieces, strict=True):
            out.append(piece)
            out.append(at[place + size] - at[place])
            place += size
        return out.tobytes()

    def _known(self, memory: Memory, units: list[str], first: bool = False, before: str = "") -> bytes:
        """What ``units`` give, one after the other."""
        newer = memory.room()
        for u in set(units).difference(newer):
            newer[u] = memory.older.get(u) or self._unit(before + u, first)
        return b"".join(map(newer.__getitem__, units))

    def pairs(self, text: str) -> tuple[int, bytes]:
        """(source byte at which the first piece begins, pairs of id and source length)."""
        if not text:
            return 0, b""
        if not self.model.plain:
            start = self.model.normalise(text)[1][0]
            return start, self._joined(self._unit(text, True))
        parts = text.split(" ")
        if "" in parts or SPACE in text:
            parts = self.split.findall(text)
            return 0, self._joined(self._known(self.heads, parts[:1], True) + self._known(self.runs, parts[1:]))
        return 0, self._joined(self._known(self.heads, parts[:1], True) + self._known(self.tails, parts[1:], False, " "))

    def _joined(self, pairs: bytes) -> bytes:
        """Without byte pieces, unknown pieces side by side are one."""
        if self.model.bytes:
            return pairs
        out: list[list[int]] = []
        for piece, size in np.frombuffer(pairs, dtype="<u4").reshape(-1, 2).tolist():
            if out and piece == self.model.unknown == out[-1][0]:
                out[-1][1] += size
            else:
                out.append([piece, size])
        return np.array(out, dtype="<u4").tobytes()

    def decode(self, ids: list[int]) -> str:
        m, start, head = self.model, 0, b""
        # a space at the beginning was put there by the encoder
        while start < len(ids) and not head:
            i = ids[start]
            head, start = self.table[i], start + 1
            if m.kinds[i] == _NORMAL and (m.dummy or m.squeeze) and head.startswith(b" "):
                head = head[1:]
                if not m.squeeze:
                    break
            elif m.kinds[i] != _CONTROL:
                break
        return (head + b"".join(map(self.table.__getitem__, ids[start:]))).decode("utf-8", "embera-each-byte")


_CODECS: dict[bytes, Codec] = {}


def _codec(data: bytes) -> Codec:
    if data not in _CODECS:  # Python workers are used again by later tasks
        _CODECS.clear()
        _CODECS[data] = Codec(data)
    return _CODECS[data]


def encode(docs: DataFrame, model: bytes, end: bool = True, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, starts, ends): piece i covers the UTF-8 bytes starts[i] to ends[i] of the text.

    With ``end`` the end id follows, whose span is empty. With ``check`` the ids are decoded
    again in the same pass and come back as ``decoded``.
    """
    if end and Model(model).end is None:
        raise ValueError("the model has no end symbol")
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        last = np.array([codec.model.end, 0], dtype="<u4").tobytes() if end else b""
        for batch in batches:
            found = [codec.pairs(t.as_py() or "") for t in batch.column(1)]
            flat = np.frombuffer(b"".join(x for _, pairs in found for x in (pairs, last)), dtype="<u4").reshape(-1, 2)
            counts = np.array([(len(pairs) + len(last)) // 8 for _, pairs in found], dtype=np.int64)
            edges = np.r_[0, np.cumsum(counts)]
            sums = np.r_[0, np.cumsum(flat[:, 1], dtype=np.int64)]
            shift = np.repeat(np.array([s for s, _ in found], dtype=np.int64) - sums[edges[:-1]], counts)
            ids = flat[:, 0].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x.astype(np.int32))) for x in (ids, sums[:-1] + shift, sums[1:] + shift)]
            columns = [batch.column(0), pa.array(counts), *lists]
            if check:
                columns.append(pa.array([codec.decode(ids[a:b].tolist()) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "starts", "ends", "decoded"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, starts array<int>, ends array<int>" + ", decoded string" * check)


def decode(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): the text that the ids stand for."""
    shared = small_batches(encoded).sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            texts = pa.array((codec.decode(x.as_py() or []) for x in batch.column(1)), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "decoded"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, decoded string")
