"""Pages of archives: dispatch by extension and signature, a ZIP reader, notes."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import PAGE_IMAGES, container_family, container_signature
from ..schemas import NOTE

PAGE = "archive_path string, page_index int, page_count int, entry_name string, content binary"
#: Readers by container family: content -> [(entry name, bytes)] in archive order. RAR, 7Z and PDF have none here.
READERS: dict[str, Callable[[bytes], list[tuple[str, bytes]]]] = {}


def reader(family: str):
    """Registers a reader for a container family."""

    def keep(f):
        READERS[family] = f
        return f

    return keep


@reader("ZIP")
def read_zip(content: bytes) -> list[tuple[str, bytes]]:
    """Entries that aren't empty and have an image's extension."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(i.filename, z.read(i)) for i in z.infolist() if i.file_size > 0 and i.filename.lower().endswith(tuple(f".{e}" for e in PAGE_IMAGES))]


def page_order(name: str, index: int) -> tuple[str, int]:
    """Pages go by file name, upper-cased, then by place in the archive; not by numbers in names."""
    return name.replace("\\", "/").rsplit("/", 1)[-1].upper(), index


def classify_containers(archives: DataFrame) -> DataFrame:
    """``archives(file_path, content)`` with ``family`` to read by: the signature's, else the extension's."""
    signature, promised = container_signature(F.col("content")), container_family(F.col("file_path"))
    return archives.withColumn("promised", promised).withColumn("signature", signature).withColumn("family", F.coalesce(F.regexp_replace("signature", "RAR5", "RAR"), "promised"))


def container_notes(classified: DataFrame) -> DataFrame:
    """(scope, path, message): what doesn't match or can't be read."""
    found = F.regexp_replace("signature", "RAR5", "RAR")
    message = (
        F.when(found.isNotNull() & F.col("promised").isNotNull() & (found != F.col("promised")), F.format_string("the extension says %s but the content is %s", "promised", "signature"))
        .when(F.col("signature") == "RAR5", "RAR5 archives need a reader for that format")
        .when(~F.coalesce(F.col("family"), F.lit("")).isin(*READERS), F.format_string("no reader for %s", F.coalesce("family", F.lit("this format"))))
    )
    return classified.select(F.lit("container").alias("scope"), F.col("file_path").alias("path"), message.alias("message")).where("message is not null")


#: What readers raise for content that they can't read.
BROKEN = (zipfile.BadZipFile, OSError, ValueError, NotImplementedError, RuntimeError, EOFError, zlib.error)


def _pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, family, content in zip(pdf["file_path"], pdf["family"], pdf["content"], strict=True):
            try:
                entries = READERS[family](bytes(content)) if family in READERS and content is not None else []
            except BROKEN:
                entries = []  # container_failures() tells of it
            entries = [e for _, e in sorted(((page_order(n, i), (n, b)) for i, (n, b) in enumerate(entries)), key=lambda x: x[0])]
            if entries:
                yield pd.DataFrame({"archive_path": path, "page_index": range(len(entries)), "page_count": len(entries), "entry_name": [n for n, _ in entries], "content": [b for _, b in entries]})


def read_pages(archives: DataFrame) -> DataFrame:
    """(archive_path, page_index, page_count, entry_name, content): an archive is opened once for all its pages."""
    return classify_containers(archives).select("file_path", "family", "content").mapInPandas(_pages, PAGE)


def _failures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, family, content in zip(pdf["file_path"], pdf["family"], pdf["content"], strict=True):
            try:
                if content is None:
                    raise OSError("the file can't be opened")
                if family in READERS:
                    READERS[family](bytes(content))
            except BROKEN as e:
                out.append(("container", path, f"can't be read: {e}"))
        yield pd.DataFrame({c: pd.Series([x[i] for x in out], dtype=object) for i, c in enumerate(("scope", "path", "message"))})


def container_failures(archives: DataFrame) -> DataFrame:
    """(scope, path, message) of archives whose reader fails or that couldn't be opened (null content)."""
    return classify_containers(archives).select("file_path", "family", "content").mapInPandas(_failures, NOTE)


def first_pages(pages: DataFrame) -> DataFrame:
    return pages.where("page_index = 0")


def page_at(pages: DataFrame, archive: str, index: int) -> DataFrame:
    """One page, or no row if it is out of range."""
    return pages.where((F.col("archive_path") == archive) & (F.col("page_index") == index))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("archive_path").agg(F.count("*").cast("int").alias("page_count"))


def ordered_entries(entries: DataFrame, archive_col: str, name_col: str, place_col: str) -> DataFrame:
    """``entries`` with ``page_index`` by the page order, as a window function."""
    base = F.upper(F.element_at(F.split(F.col(name_col), r"[/\\]"), -1))
    return entries.withColumn("page_index", (F.row_number().over(Window.partitionBy(archive_col).orderBy(base, place_col)) - 1).cast("int"))
