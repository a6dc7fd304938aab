"""The prompt tokenizer: lower-case BPE with word ends, 77 ids per text."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH, START, END = 77, "<|startoftext|>", "<|endoftext|>"


def unescape_html(text: str | None) -> str | None:
    """HTML entities resolved twice, white space collapsed, lower case."""
    return None if text is None else re.sub(r"\s+", " ", html.unescape(html.unescape(text))).strip().lower()


class PromptTokenizer:
    """Merges by rank on the characters of a word, whose last one carries the end mark."""

    def __init__(self, definition: str):
        """``definition``: the JSON of a word-end BPE vocabulary (``model.vocab``, ``model.merges``)."""
        whole = json.loads(definition)
        model = whole["model"]
        self.vocab: dict[str, int] = model["vocab"] | {t["content"]: t["id"] for t in whole.get("added_tokens", ())}
        self.suffix: str = model.get("end_of_word_suffix") or "</w>"
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.word = lru_cache(100_000)(self._word)
        import regex

        self.pattern = regex.compile(r"<\|startoftext\|>|<\|endoftext\|>|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", regex.IGNORECASE)
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in kept]
        self.byte = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(other)}

    def _word(self, word: str) -> tuple[int, ...]:
        parts = [self.byte[b] for b in word.encode()]
        parts[-1] += self.suffix
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            merged, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    merged.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        return tuple(self.vocab[p] for p in parts if p in self.vocab)

    def encode(self, text: str | None) -> list[int]:
        return [i for w in self.pattern.findall(unescape_html(text) or "") for i in ((self.vocab[w],) if w in (START, END) else self.word(w))]

    def tokenize(self, text: str | None) -> list[int]:
        """Start, ids cut to fit, end, then zeros: LENGTH ids."""
        ids = [self.vocab[START], *self.encode(text)[: LENGTH - 2], self.vocab[END]]
        return ids + [0] * (LENGTH - len(ids))


def tokenized(c: Column, definition: str) -> Column:
    """array<long> of LENGTH ids; the vocabulary (about 2 MB) travels with the function."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = PromptTokenizer(definition)
        for texts in parts:
            yield pd.Series([tokenizer.tokenize(t) for t in texts], dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<long>")(c)
