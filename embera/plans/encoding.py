"""Encoders and cache-first encoding of files and pages."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.probe import first_probes, probe_status, split_hits
from ..functions.vector import is_zero
from ..session import checkpointed
from .store import CacheStore


class Encoder(Protocol):
    """Turns texts and image bytes into vectors; a zero vector means it couldn't."""

    model_name: str
    dimension: int

    def encode_text(self, text: str) -> list[float]: ...

    def encode_images(self, contents: list[bytes]) -> list[list[float]]: ...


class HashingEncoder:
    """Deterministic unit vectors from bytes: for tests, and for runs without a model file."""

    def __init__(self, dimension: int = 64, model_name: str = "hashing"):
        self.dimension, self.model_name = dimension, model_name

    def _vector(self, data: bytes) -> list[float]:
        seed = int.from_bytes(hashlib.sha256(data).digest()[:8], "big")
        v = np.random.default_rng(seed).standard_normal(self.dimension)
        return (v / np.linalg.norm(v)).astype(np.float32).tolist()

    def encode_text(self, text: str) -> list[float]:
        return self._vector(text.encode())

    def encode_images(self, contents: list[bytes]) -> list[list[float]]:
        return [self._vector(c) if c else [0.0] * self.dimension for c in contents]


class OnnxEncoder:
    """A model file run with onnxruntime; the session is made once per Python worker.

    ``prepare`` turns image bytes into an input tensor, or None if it can't.
    """

    def __init__(self, path: str, dimension: int, model_name: str, prepare: Callable[[bytes], np.ndarray | None], normalize: bool = True, threads: int = 1):
        self.path, self.dimension, self.model_name, self.prepare, self.normalize, self.threads = path, dimension, model_name, prepare, normalize, threads
        self._session = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_session": None}

    def session(self):
        if self._session is None:
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = self.threads
            wanted = [p for p in ("CUDAExecutionProvider", "CPUExecutionProvider") if p in onnxruntime.get_available_providers()]
            self._session = onnxruntime.InferenceSession(self.path, options, providers=wanted)
        return self._session

    def encode_text(self, text: str) -> list[float]:
        raise NotImplementedError("this model encodes images")

    def encode_images(self, contents: list[bytes]) -> list[list[float]]:
        tensors = [self.prepare(c) for c in contents]
        out = np.zeros((len(contents), self.dimension), dtype=np.float32)
        fine = [i for i, t in enumerate(tensors) if t is not None]
        if fine:
            s = self.session()
            got = s.run(None, {s.get_inputs()[0].name: np.stack([tensors[i] for i in fine])})[0].reshape(len(fine), -1)
            norms = np.linalg.norm(got, axis=1, keepdims=True)
            out[fine] = np.where(norms > 0, got / np.maximum(norms, 1e-30), got) if self.normalize else got
        return out.tolist()


def with_vectors(df: DataFrame, encoder: Encoder, content_col: str = "content", batch: int = 32) -> DataFrame:
    """``df`` with ``embedding`` in place of the content, encoded in batches; failures are zero vectors."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for contents in parts:
            got: list[list[float]] = []
            for i in range(0, len(contents), batch):
                got += encoder.encode_images([bytes(c) if c is not None else b"" for c in contents.iloc[i : i + batch]])
            yield pd.Series(got, dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn("embedding", F.pandas_udf(run, "array<float>").asNondeterministic()(content_col)).drop(content_col)


def failures(df: DataFrame, path_col: str = "file_path") -> DataFrame:
    """Notes on what couldn't be encoded."""
    return df.where(is_zero(F.col("embedding"))).select(F.lit("encode").alias("scope"), F.col(path_col).alias("path"), F.lit("could not be decoded").alias("message"))


def probe_stored(store: CacheStore, probe: DataFrame, model: str, unique: bool = False, order: str | None = None) -> DataFrame:
    """Like ``probe_status`` on the store's file cache, in two phases: keys decide, and vectors are read for hits only.

    The probe's join and the choice of each key's latest row see keys, freshness and places;
    the vectors of hits are then fetched by file and row.
    """
    places = store.positions("file_cache", model)
    if places is None:
        return probe_status(probe, store.view("file_cache", model), unique=unique, order=order)
    first = probe if unique else first_probes(probe, order)
    cached = places.select("file_path", F.col("last_modified").alias("_m"), F.col("file_size").alias("_s"), "_file", "_row")
    fresh = F.col("_m").eqNullSafe(F.col("last_modified")) & F.col("_s").eqNullSafe(F.col("file_size"))
    status = F.when(F.col("_file").isNull(), "miss").when(fresh, "hit").otherwise("stale")
    probed = checkpointed(first.join(cached, "file_path", "left").withColumn("status", status).drop("_m", "_s"))
    columns = [*probe.columns, "embedding", "status"]
    hits = store.fetch("file_cache", probed.where("status = 'hit'"), "embedding").select(*columns)
    return hits.unionByName(probed.where("status <> 'hit'").withColumn("embedding", F.lit(None).cast("array<float>")).select(*columns))


def encode_with_cache(store: CacheStore, files: DataFrame, encoder: Encoder, contents: Callable[[DataFrame], DataFrame], wave: int | None = None) -> DataFrame:
    """(file_path, last_modified, file_size, embedding, status) of all files; misses are encoded and saved.

    ``files`` has each path once, as a listing has. ``contents(misses)`` adds the ``content`` column: only missed files are ever opened.
    With ``wave`` the misses are saved in that many commits, so what is done survives a
    stop; a failure (zero vector) is never saved.
    """
    hits, misses = split_hits(probe_status(files, store.view("file_cache", encoder.model_name), unique=True))
    waves = max(1, wave or 1)
    for i in range(waves):
        part = misses.where(F.pmod(F.xxhash64("file_path"), F.lit(waves)) == i)
        if part.isEmpty():
            continue
        fresh = with_vectors(contents(part.drop("status")), encoder).where(~is_zero(F.col("embedding")))
        store.upsert("file_cache", fresh.withColumn("model_name", F.lit(encoder.model_name)))
    again = probe_status(files, store.view("file_cache", encoder.model_name), unique=True).withColumnRenamed("status", "now")
    was = misses.select("file_path", "status").unionByName(hits.select("file_path", "status"))
    return again.join(was, "file_path").drop("now")


def complete_archives(pages: DataFrame) -> DataFrame:
    """(archive_path, page_count, last_modified, file_size, pages) of the archives all of whose pages have vectors.

    Repeated pages count once, pages out of range don't count, and an archive that lacks a
    page gives no row.
    """
    rows = pages.where((F.col("page_index") >= 0) & (F.col("page_index") < F.col("page_count")) & ~is_zero(F.col("embedding")))
    once = rows.groupBy("archive_path", "page_count", "last_modified", "file_size", "page_index").agg(F.first("embedding").alias("embedding"))
    by = once.groupBy("archive_path", "page_count", "last_modified", "file_size").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("page_index", "embedding"))).alias("p"))
    return by.where("n = page_count").select("archive_path", "page_count", "last_modified", "file_size", F.transform("p", lambda x: x["embedding"]).alias("pages"))
