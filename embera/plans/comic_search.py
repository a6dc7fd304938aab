"""Search over comic archives: covers only, or all pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import to_base64
from ..functions.paths import ARCHIVES, file_name
from ..functions.vector import is_zero
from ..operators import search as S
from ..operators.probe import archive_status, probe_status
from ..schemas import NOTE
from ..session import checkpointed
from ..sources.archives import read_archives
from ..sources.files import listing, listing_with_notes
from .encoding import Encoder, complete_archives, with_vectors
from .store import CacheStore

HIT = "archive_path string, archive_file_name string, page_index int, page_count int, similarity double"


class ComicSearch:
    """An archive with a fresh row in the cache is never opened; of others only their directory and the pages in question are read.

    After a search ``notes`` tells of what couldn't be read, and once its result has been
    looked at, ``counters`` has the numbers of that pass: pages, and archives by status.
    """

    def __init__(self, spark: SparkSession, store: CacheStore, encoder: Encoder, at_once: int = 1000):
        """``at_once``: archives whose pages are encoded before the complete ones of them are saved."""
        self.spark, self.store, self.encoder, self.at_once = spark, store, encoder, at_once
        self.notes, self.counters = spark.createDataFrame([], NOTE), None

    def _encoded(self, misses: DataFrame, pages: str | None) -> DataFrame:
        found, notes = read_archives(misses.select("file_path"), pages)
        self.notes = self.notes.unionByName(notes)
        made = with_vectors(found, self.encoder).where(~is_zero(F.col("embedding")))
        meta = misses.select(F.col("file_path").alias("archive_path"), "last_modified", "file_size")
        return made.join(meta, "archive_path")

    def _scanned(self, directory: str) -> DataFrame:
        found, self.notes = listing_with_notes(self.spark, directory, ARCHIVES, True, hidden=True)
        return found

    def pages(self, directory: str) -> DataFrame:
        """(archive_path, page_index, page_count, embedding, status) of all pages.

        Archives that the cache misses are encoded in waves, and the complete ones of a wave
        are saved before the next one begins: what is done survives a stop.
        """
        model = self.encoder.model_name
        found = self._scanned(directory)
        probed = checkpointed(archive_status(found, self.store.view("archive_cache", model)).drop("pages"))
        misses = probed.where("status <> 'hit'")
        waves = -(-misses.count() // self.at_once)
        rest = self.spark.createDataFrame([], "archive_path string, page_index int, page_count int, embedding array<float>")
        for i in range(waves):
            made = checkpointed(self._encoded(misses.where(F.pmod(F.xxhash64("file_path"), F.lit(waves)) == i), None))
            done = checkpointed(complete_archives(made))
            if not done.isEmpty():
                self.store.upsert("archive_cache", done.withColumn("model_name", F.lit(model)))
            rest = rest.unionByName(made.join(done.select("archive_path"), "archive_path", "left_anti").select(*rest.columns))
        again = archive_status(found, self.store.view("archive_cache", model)).where("status = 'hit'")
        saved = again.select(F.col("file_path").alias("archive_path"), F.posexplode("pages").alias("page_index", "embedding"), F.size("pages").alias("page_count"))
        was = probed.select(F.col("file_path").alias("archive_path"), "status")
        return saved.select(*rest.columns).unionByName(rest).join(was, "archive_path")

    def covers(self, directory: str) -> DataFrame:
        """(archive_path, page_index, page_count, embedding, status) of first pages.

        They come from the archive table, else the cover table (their page_count is 0), else
        the archive is opened and the cover saved.
        """
        model = self.encoder.model_name
        found = self._scanned(directory)
        whole = archive_status(found, self.store.view("archive_cache", model))
        from_archives = whole.where("status = 'hit'").select(F.col("file_path").alias("archive_path"), F.lit(0).alias("page_index"), F.size("pages").alias("page_count"), F.get("pages", F.lit(0)).alias("embedding"))
        cached = self.store.view("cover_cache", model).withColumnRenamed("archive_path", "file_path")
        probed = probe_status(whole.where("status <> 'hit'").select("file_path", "last_modified", "file_size"), cached, unique=True)
        from_covers = probed.where("status = 'hit'").select(F.col("file_path").alias("archive_path"), F.lit(0).alias("page_index"), F.lit(0).alias("page_count"), "embedding")
        out = from_archives.unionByName(from_covers).withColumn("status", F.lit("hit"))
        misses = checkpointed(probed.where("status <> 'hit'").drop("embedding"))
        if not misses.isEmpty():
            made = checkpointed(self._encoded(misses, "page_index = 0").join(misses.select(F.col("file_path").alias("archive_path"), "status"), "archive_path"))
            out = checkpointed(out)  # as it is before the new covers are saved
            self.store.upsert("cover_cache", made.select("archive_path", "last_modified", "file_size", "embedding").withColumn("model_name", F.lit(model)))
            out = out.unionByName(made.select("archive_path", "page_index", "page_count", "embedding", "status"))
        return out

    def by_vector(self, directory: str, vector: Sequence[float], all_pages: bool = False, exclude: str | None = None) -> DataFrame:
        rows = self.pages(directory) if all_pages else self.covers(directory)
        if not len(vector) or not S.dimension_matches(rows, vector):
            return self.spark.createDataFrame([], HIT)
        self.counters = Observation()  # the result is kept before it is sorted, since a sort runs what is below it twice
        by = {s: F.count_if(F.col("status") == s) for s in ("hit", "stale", "miss", "inconsistent")}
        scored = S.score(rows.observe(self.counters, F.count("*").alias("pages"), *(c.alias(s) for s, c in by.items())), vector)
        if exclude is not None:
            scored = S.exclude(scored, "archive_path", exclude)
        shown = scored.select("archive_path", file_name(F.col("archive_path")).alias("archive_file_name"), "page_index", "page_count", "similarity")
        return checkpointed(shown).orderBy(F.desc("similarity"), "archive_path", "page_index")

    def by_text(self, directory: str, text: str, all_pages: bool = False) -> DataFrame:
        return self.by_vector(directory, self.encoder.encode_text(f"a photo of {text}"), all_pages)

    def by_image(self, directory: str, content: bytes, all_pages: bool = False) -> DataFrame:
        return self.by_vector(directory, self.encoder.encode_images([content])[0], all_pages)

    def page_vector(self, archive: str, page: int) -> list[float] | None:
        """From the archive's row, else for page 0 the cover's, else by opening the archive (page 0 is saved as cover)."""
        model = self.encoder.model_name
        found = listing(self.spark, archive, ARCHIVES, False, hidden=True)
        whole = archive_status(found, self.store.view("archive_cache", model)).where("status = 'hit'").select(F.get("pages", F.lit(page)).alias("v")).collect()
        if whole:
            return list(whole[0]["v"]) if whole[0]["v"] is not None else None
        if page == 0:
            got = self.covers(archive).select("embedding").limit(1).collect()
            return list(got[0]["embedding"]) if got else None
        pages, _ = read_archives(found.select("file_path"), f"page_index = {int(page)}")
        got = with_vectors(pages, self.encoder).where(~is_zero(F.col("embedding"))).select("embedding").collect()
        return list(got[0]["embedding"]) if got else None

    def by_archive_page(self, directory: str, archive: str, page: int = 0, all_pages: bool = False) -> DataFrame:
        """By a page of an archive; the archive itself isn't among the results."""
        vector = self.page_vector(archive, page)
        if vector is None:
            raise ValueError(f"page {page} of {archive} can't be decoded")
        return self.by_vector(directory, vector, all_pages, exclude=archive)

    def page_hash(self, archive: str, page: int) -> str | None:
        vector = self.page_vector(archive, page)
        return None if vector is None else to_base64(vector)
