"""Image search over directories: by text, by image, by vector; hashes of images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import to_base64, try_parse_base64
from ..functions.paths import SEARCH_IMAGES, file_name
from ..operators import search as S
from ..schemas import NOTE
from ..session import checkpointed
from ..sources.files import listing, listing_with_notes, with_contents
from .encoding import Encoder, encode_with_cache
from .store import CacheStore

HIT = "file_path string, file_name string, similarity double"


class ImageSearch:
    """Searches images under directories, vectors from the cache first.

    After a search ``notes`` tells of directories that couldn't be read and images that
    couldn't be decoded, and once its result has been looked at, ``counters`` has the numbers
    of that pass: files by status, and failures.
    """

    def __init__(self, spark: SparkSession, store: CacheStore, encoder: Encoder):
        self.spark, self.store, self.encoder = spark, store, encoder
        self.notes, self.counters = spark.createDataFrame([], NOTE), None

    def vectors(self, directory: str, recursive: bool = True) -> DataFrame:
        """All images' vectors; only files that the cache misses are opened."""
        found, notes = listing_with_notes(self.spark, directory, SEARCH_IMAGES, recursive)
        rows = encode_with_cache(self.store, found, self.encoder, with_contents)
        failed = rows.where(F.col("embedding").isNull()).select(F.lit("encode").alias("scope"), F.col("file_path").alias("path"), F.lit("could not be decoded").alias("message"))
        self.notes = notes.unionByName(failed)
        return rows

    def by_vector(self, directory: str, vector: Sequence[float], recursive: bool = True, exclude: str | None = None) -> DataFrame:
        """(file_path, file_name, similarity), best first; empty if the query's dimension doesn't fit."""
        if not len(vector):
            return self.spark.createDataFrame([], HIT)
        rows = self.vectors(directory, recursive)
        if not S.dimension_matches(rows.where(F.col("embedding").isNotNull()), vector):
            return self.spark.createDataFrame([], HIT)
        self.counters = Observation()  # the result is kept before it is sorted, since a sort runs what is below it twice
        by = {s: F.count_if(F.col("status") == s) for s in ("hit", "stale", "miss")}
        rows = rows.observe(self.counters, F.count("*").alias("files"), *(c.alias(s) for s, c in by.items()), F.count_if(F.col("embedding").isNull()).alias("failures"))
        scored = S.score(rows, vector)
        if exclude is not None:
            scored = S.exclude(scored, "file_path", exclude)
        return S.rank(checkpointed(scored.select("file_path", file_name(F.col("file_path")).alias("file_name"), "similarity")), "file_path")

    def by_text(self, directory: str, text: str, recursive: bool = True) -> DataFrame:
        return self.by_vector(directory, self.encoder.encode_text(f"a photo of {text}"), recursive)

    def image_vector(self, path: str) -> list[float] | None:
        """The vector of one image, from the cache if fresh; None if it can't be decoded."""
        rows = encode_with_cache(self.store, listing(self.spark, path, SEARCH_IMAGES, False, hidden=True), self.encoder, with_contents)
        got = rows.where(F.col("embedding").isNotNull()).select("embedding").limit(1).collect()
        return list(got[0]["embedding"]) if got else None

    def by_image(self, directory: str, path: str, recursive: bool = True) -> DataFrame:
        """By example; the example itself isn't among the results."""
        vector = self.image_vector(path)
        if vector is None:
            raise ValueError(f"{path} is missing or can't be decoded")
        return self.by_vector(directory, vector, recursive, exclude=path)

    def by_hash(self, directory: str, text: str, recursive: bool = True) -> DataFrame:
        return self.by_vector(directory, try_parse_base64(text) or [], recursive)

    def image_hash(self, path: str) -> str | None:
        vector = self.image_vector(path)
        return None if vector is None else to_base64(vector)


def search_roots(results: Sequence[DataFrame], keys: Sequence[str], threshold: float, limit: int | None = None) -> DataFrame:
    """Results of several roots: merged, one row per key, thresholded, best first."""
    return S.rank(S.at_least(S.merge_roots(results, keys), threshold).drop("root_ordinal"), keys[0], limit)
