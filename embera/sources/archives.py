"""Pages of archives by byte ranges: the directory of an archive first, then just the entries that are asked for.

``zip_entries`` reads the ends of ZIP files and gives a row for each page, without content.
Filters on these rows (one page, first pages, some archives) decide what ``page_contents``
reads: the bytes of one entry at a time, wherever its row was dealt. So a page costs its
archive's directory and its own bytes, and a large archive is spread over tasks.
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import PAGE_IMAGES
from ..session import checkpointed
from .containers import BROKEN, PAGE, READERS, classify_containers, container_notes, page_order, read_pages
from .directories import opened
from .files import with_contents

ENTRY = "archive_path string, page_index int, page_count int, entry_name string, place long, packed long, size long, method int, crc long, message string"
#: Pages of one archive that go to a task together.
TOGETHER = 64
_LOCAL = struct.Struct("<4sHHHHHIIIHH")


def with_heads(files: DataFrame) -> DataFrame:
    """``files`` with ``content``: their first 8 bytes, null if they can't be opened."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            heads = []
            for place in pdf["file_path"]:
                try:
                    with opened(place) as f:
                        heads.append(f.read(8))
                except (OSError, ValueError):
                    heads.append(None)
            yield pd.DataFrame({"file_path": pdf["file_path"], "content": pd.Series(heads, dtype=object, index=pdf.index)})

    spread = files.select("file_path").repartition(8 * files.sparkSession.sparkContext.defaultParallelism, "file_path")
    return spread.mapInPandas(run, "file_path string, content binary")


def directory_of(place: str) -> list[zipfile.ZipInfo]:
    """A ZIP file's page entries in their order; only its end and its directory are read."""
    with opened(place) as f, zipfile.ZipFile(f) as z:
        pages = [(page_order(i.filename, n), i) for n, i in enumerate(z.infolist()) if i.file_size > 0 and i.filename.lower().endswith(tuple(f".{e}" for e in PAGE_IMAGES))]
    return [i for _, i in sorted(pages, key=lambda x: x[0])]


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in ENTRY.split(", ")]
    for pdf in batches:
        for path in pdf["file_path"]:
            try:
                found = directory_of(path)
                rows = [(path, n, len(found), i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC, "the entry is encrypted" if i.flag_bits & 1 else None) for n, i in enumerate(found)]
            except BROKEN as e:
                rows = [(path, None, None, None, None, None, None, None, None, f"can't be read: {e}")]
            yield pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object if c in ("archive_path", "entry_name", "message") else "Int64") for i, c in enumerate(names)})


def entry_bytes(f, place: int, packed: int, size: int, method: int, crc: int) -> bytes:
    """The content of one entry of an opened ZIP file, checked."""
    f.seek(place)
    head = f.read(_LOCAL.size)
    if len(head) < _LOCAL.size or head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no entry where the directory says")
    *_, name, extra = _LOCAL.unpack(head)
    f.seek(place + _LOCAL.size + name + extra)
    data = f.read(packed)
    if method == zipfile.ZIP_DEFLATED:
        data = zlib.decompressobj(-15).decompress(data, size + 1)
    elif method == zipfile.ZIP_BZIP2:
        import bz2

        data = bz2.decompress(data)
    elif method != zipfile.ZIP_STORED:
        raise NotImplementedError(f"compression {method}")
    if len(data) != size or zlib.crc32(data) != crc:
        raise zipfile.BadZipFile("the content isn't what the directory says")
    return data


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    f, name = None, None
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            content = None
            try:
                if name != row.archive_path:
                    if f is not None:
                        f.close()
                    f, name = opened(row.archive_path), row.archive_path
                if row.message is None or pd.isna(row.message):
                    content = entry_bytes(f, int(row.place), int(row.packed), int(row.size), int(row.method), int(row.crc))
            except BROKEN:
                pass  # a page without content
            yield pd.DataFrame({"archive_path": [row.archive_path], "page_index": [row.page_index], "page_count": [row.page_count], "entry_name": [row.entry_name], "content": pd.Series([content], dtype=object)})
    if f is not None:
        f.close()


def zip_entries(files: DataFrame) -> DataFrame:
    """A row for each page of ZIP files, and for a file that can't be read one without a page but with a message."""
    return files.select("file_path").mapInPandas(_entries, ENTRY)


def page_contents(entries: DataFrame) -> DataFrame:
    """(archive_path, page_index, page_count, entry_name, content) of entries; content is null if it can't be read."""
    tasks = 8 * entries.sparkSession.sparkContext.defaultParallelism
    dealt = entries.where("page_index is not null").repartition(tasks, "archive_path", F.floor(F.col("page_index") / TOGETHER)).sortWithinPartitions("archive_path", "page_index")
    return dealt.mapInPandas(_contents, PAGE)


def read_archives(files: DataFrame, pages: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages with content, notes) of archives by path; ``pages`` is a condition on page_index, for instance ``page_index = 0``.

    ZIP files are read by ranges. Of other families those with a registered reader are read
    as a whole, and notes tell of the rest.
    """
    classified = checkpointed(classify_containers(with_heads(files)))
    entries = checkpointed(zip_entries(classified.where("family = 'ZIP' and content is not null")))
    wanted = entries if pages is None else entries.where(pages)
    others = [f for f in READERS if f != "ZIP"]
    out = page_contents(wanted)
    if others:
        rest = read_pages(with_contents(classified.where(F.col("family").isin(others)).select("file_path")))
        out = out.unionByName(rest if pages is None else rest.where(pages))
    closed = classified.where("content is null").select(F.lit("container").alias("scope"), F.col("file_path").alias("path"), F.lit("the file can't be opened").alias("message"))
    broken = entries.where("message is not null").select(F.lit("container").alias("scope"), F.col("archive_path").alias("path"), "message")
    return out, container_notes(classified.where("content is not null")).unionByName(closed).unionByName(broken)
