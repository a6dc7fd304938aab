"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task takes its documents in blocks. The distinct pre-tokens of a block that are new to
the task are laid end to end as one array of symbols; an inverted index leads from a pair
of symbols (named by the rank of what it merges into) to the places where it stands. The
merges are then applied in rank order, each to all its places at once, and a merge only
touches the two neighbours of a place. So a word is merged once however often it occurs,
and documents are looked up chunk by chunk. Nothing is shuffled, and a lost executor costs
only its own tasks again.

The vocabulary is one file of about 1 MB, independent of the corpus; it is broadcast.

Defined results: a null text counts as empty; an empty text has no tokens; text is never
cut, and special tokens are never made: their strings are ordinary text. Extra columns
are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Characters of text that a block of documents holds, and chunks that a task remembers.
BLOCK_CHARS, REMEMBERED = 4_000_000, 600_000
#: A space with white space on both sides: it may belong to the pre-token before it.
_AMONG = regex.compile(r"\s \s")


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Merges:
    """The vocabulary as whole numbers: a token is its rank, a pair is left << 20 | right."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: piece for piece, rank in ranks.items()}
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        self.pairs = {(x << 20) | y: rank for piece, rank in ranks.items() for i in range(1, len(piece)) if (x := ranks.get(piece[:i])) is not None and (y := ranks.get(piece[i:])) is not None}
        self.first = np.array([[self.pairs.get((x << 20) | y, -1) for y in self.byte.tolist()] for x in self.byte.tolist()], dtype=np.int64)


def replay(words: list[bytes], merges: Merges) -> list[bytes]:
    """Ids of every word (non-empty), as little-endian unsigned 32-bit integers, by applying
    merges in rank order to all words at once."""
    if not words:
        return []
    text = np.frombuffer(b"".join(words), dtype=np.uint8)
    n, ends = len(text), np.cumsum([len(w) for w in words])
    starts = np.r_[0, ends[:-1]]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1], before[starts] = -1, -1
    # the index at first: from the rank of a pair to its places, ascending
    rank = merges.first[text, np.r_[text[1:], text[:1]]]
    rank[ends - 1] = -1
    at = np.flatnonzero(rank >= 0)
    at = at[np.argsort(rank[at], kind="stable")]
    cuts = np.flatnonzero(np.diff(rank[at])) + 1
    places: dict[int, list[int]] = {int(rank[x[0]]): x.tolist() for x in np.split(at, cuts) if len(x)}
    due = list(places)
    heapq.heapify(due)
    symbol, after, before = merges.byte[text].tolist(), after.tolist(), before.tolist()
    pair = merges.pairs.get
    while due:
        rank = heapq.heappop(due)
        where = places.pop(rank, [])
        where.sort()
        for done, i in enumerate(where):
            j = after[i]
            if j < 0 or pair(symbol[i] << 20 | symbol[j]) != rank:
                continue  # another merge took one of the two
            symbol[i], symbol[j] = rank, -1
            after[i] = k = after[j]
            after[j] = -1
            sooner = False
            if k >= 0:
                before[k] = i
                if (r := pair(rank << 20 | symbol[k])) is not None:
                    if r in places:
                        places[r].append(i)
                    else:
                        places[r] = [i]
                        heapq.heappush(due, r)
                    sooner = r < rank
            if (h := before[i]) >= 0 and (r := pair(symbol[h] << 20 | rank)) is not None:
                if r in places:
                    places[r].append(h)
                else:
                    places[r] = [h]
                    heapq.heappush(due, r)
                sooner = sooner or r < rank
            if sooner and done + 1 < len(where):  # a merge of lower rank has come up: it goes first
                if rank in places:
                    places[rank] += where[done + 1 :]
                else:
                    places[rank] = where[done + 1 :]
                    heapq.heappush(due, rank)
                break
    left = np.array(symbol)
    alive = left >= 0
    counts = np.r_[0, np.cumsum(np.add.reduceat(alive, starts, dtype=np.int64))] * 4
    data, counts = left[alive].astype("<u4").tobytes(), counts.tolist()
    return [data[x:y] for x, y in zip(counts, counts[1:])]


class Codec:
    """Encodes blocks of texts and decodes ids, with one vocabulary; lives in a task."""

    def __init__(self, data: bytes, pattern: str, remembered: int | None = None):
        self.remembered = REMEMBERED if remembered is None else remembered
        self.merges = Merges(parse_ranks(data))
        self.pattern = regex.compile(pattern)
        self.plain = r"| ?\p{L}+|" in pattern and r"| ?[^\s\p{L}\p{N}]+|" in pattern
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}  # without the space that stands before them
        tokens = self.merges.tokens
        self.token_bytes = [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]

    def _split(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk; a space and letters, perhaps with one stop, need no pattern."""
        if self.plain and chunk[:1] == " ":
            if chunk[1:].isalpha():
                return [chunk]
            if chunk[-1] in ".,;:!?" and chunk[1:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)

    def _encode_pieces(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, as little-endian unsigned 32-bit integers."""
        split = list(map(self._split, chunks))
        if len(self.pieces) > self.remembered:
            self.pieces.clear()
        new = list(set().union(*split) - self.pieces.keys())
        whole = self.merges.ranks.get
        words = [p.encode("utf-8", "surrogatepass") for p in new]
        known = [(p, r.to_bytes(4, "little")) for p, w in zip(new, words, strict=True) if (r := whole(w)) is not None]
        rest = [(p, w) for p, w in zip(new, words, strict=True) if whole(w) is None]
        self.pieces.update(known)
        self.pieces.update(zip((p for p, _ in rest), replay([w for _, w in rest], self.merges), strict=True))
        return [b"".join(map(self.pieces.__getitem__, ps)) for ps in split]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of every text. A space that isn't among other white space always starts a pre-token,
        so texts split there; texts with other spaces are taken by white-space runs instead."""
        parts = [t.split(" ") for t in texts]
        odd = {i for i, p in enumerate(parts) if "" in p or _AMONG.search(texts[i])}
        if len(self.chunks) > self.remembered:  # keep what this block needs
            self.chunks = {c: self.chunks[c] for c in set().union(*(p[1:] for p in parts)) & self.chunks.keys()}
        new = set().union(*(p[1:] for i, p in enumerate(parts) if i not in odd)) - self.chunks.keys()
        heads = list({p[0] for i, p in enumerate(parts) if i not in odd})
        runs = {i: regex.findall(r"\s*\S+|\s+", texts[i]) for i in odd}
        plain = list(set(heads).union(*runs.values()))
        chunks = list(new)
        self.chunks.update(zip(chunks, self._encode_pieces([" " + c for c in chunks]), strict=True))
        first = dict(zip(plain, self._encode_pieces(plain), strict=True))
        for i, p in enumerate(parts):
            yield b"".join(map(first.__getitem__, runs[i])) if i in odd else first[p[0]] + b"".join(map(self.chunks.__getitem__, p[1:]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _blocks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about BLOCK_CHARS characters."""
    start, texts, size = 0, [], 0
    for i, value in enumerate(column):
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size >= BLOCK_CHARS:
            yield start, texts
            start, texts, size = i + 1, [], 0
    if texts:
        yield start, texts


_CODECS: dict[tuple[bytes, str, int | None], Codec] = {}


def _codec(data: bytes, pattern: str, remembered: int | None = None) -> Codec:
    key = data, pattern, remembered
    if key not in _CODECS:  # Python workers are used again by later tasks
        _CODECS.clear()
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def encode(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", check: bool = False, remembered: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): ids is binary, little-endian unsigned 32-bit integers.

    With ``check`` the ids are decoded again in the same pass and come back as ``decoded``.
    Workers remember what ``remembered`` chunks and pieces give: fewer take less memory and more time.
    """
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern, remembered)
        for batch in batches:
            for start, texts in _blocks(batch.column(1)):
                ids = list(codec.encode(texts))
                columns = [batch.column(0).slice(start, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if check:
                    columns.append(pa.array(map(codec.decode, ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded binary" * check)


def decode(encoded: DataFrame, vocabulary: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): the bytes that the ids stand for; null ids give empty bytes."""
    shared = small_batches(encoded).sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, "")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((codec.decode(x.as_py() or b"") for x in batch.column(1)), pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, decoded binary")
