"""Vectors as base64 text and as length-prefixed blobs (Arrow-batched)."""

from __future__ import annotations

import base64
import binascii
import re
import struct
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ALPHABET = re.compile(r"[A-Za-z0-9+/]*={0,2}")


def to_base64(vector: Sequence[float]) -> str:
    """Little-endian 32-bit floats in base64; a null vector is an error."""
    if vector is None:
        raise ValueError("vector is null")
    return base64.b64encode(np.asarray(vector, dtype="<f4").tobytes()).decode()


def try_parse_base64(text: str | None) -> list[float] | None:
    """The vector of a base64 text, whatever white space it holds; None if it isn't one."""
    plain = re.sub(r"\s", "", text or "")
    if not plain or len(plain) % 4 or not _ALPHABET.fullmatch(plain):
        return None
    try:
        data = base64.b64decode(plain, validate=True)
    except (ValueError, binascii.Error):
        return None
    return np.frombuffer(data, dtype="<f4").tolist() if data and len(data) % 4 == 0 else None


def to_blob(vector: Sequence[float]) -> bytes:
    """Dimension as a 32-bit integer, then 32-bit floats, little-endian."""
    return struct.pack("<i", len(vector)) + np.asarray(vector, dtype="<f4").tobytes()


def from_blob(data: bytes) -> list[float]:
    """The one vector of a blob; raises on a blob that is too short or of the wrong length."""
    if len(data) < 8:
        raise ValueError("a vector blob has 8 bytes at least")
    n = struct.unpack_from("<i", data)[0]
    if n < 1 or len(data) != 4 + 4 * n:
        raise ValueError("the blob's length doesn't match its dimension")
    return np.frombuffer(data, dtype="<f4", offset=4).tolist()


def pages_from_blob(data: bytes) -> list[list[float]]:
    """The vectors of a blob of several units; raises on a truncated one."""
    out, at = [], 0
    while at < len(data):
        n = struct.unpack_from("<i", data, at)[0] if at + 4 <= len(data) else -1
        if n < 1 or at + 4 + 4 * n > len(data):
            raise ValueError("truncated page blob")
        out.append(np.frombuffer(data, dtype="<f4", count=n, offset=at + 4).tolist())
        at += 4 + 4 * n
    return out


def _column(function, kind: str, null_stays: bool = True):
    def make(c: Column) -> Column:
        def run(values: pd.Series) -> pd.Series:
            return pd.Series([None if v is None and null_stays else function(v) for v in values], dtype=object)

        return F.pandas_udf(run, kind)(c)

    return make


vector_to_base64 = _column(to_base64, "string")
base64_to_vector = _column(try_parse_base64, "array<float>")
vector_to_blob = _column(to_blob, "binary")
blob_to_vector = _column(lambda b: from_blob(bytes(b)), "array<float>")
pages_to_blob = _column(lambda pages: b"".join(to_blob(p) for p in pages), "binary")
blob_to_pages = _column(lambda b: pages_from_blob(bytes(b)), "array<array<float>>")
