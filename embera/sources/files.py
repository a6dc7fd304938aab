"""Directory scans, contents of chosen files, image sizes and decoding."""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import ARCHIVES, CLASS_IMAGES, SEARCH_IMAGES, has_extension
from ..session import checkpoint_folder, checkpointed
from .directories import absolute, is_local, opened, walk

#: Normalisation by channel (red, green, blue): fixed values.
IMAGENET = ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
CLIP = ((0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711))


def listing_with_notes(spark: SparkSession, place: str, extensions: Sequence[str], recursive: bool = True, hidden: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files, notes): (file_path, last_modified, file_size) of matching files, extensions in either case, and
    (scope, path, message) of directories that can't be read; no file is opened.

    Directories are listed on the executors (see ``directories.walk``). Names that begin with
    a dot count only if ``hidden``, all others always. A missing directory gives a note and no
    file; a file that can't be looked at has the earliest time and size 0, so no cached row fits.
    """
    found, notes = walk(spark, place, recursive, hidden)
    modified = F.coalesce(F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("0001-01-01T00:00:00.000Z"))
    return found.where(has_extension(F.col("file_path"), tuple(extensions))).select("file_path", modified.alias("last_modified"), F.coalesce("file_size", F.lit(0)).alias("file_size")), notes


def listing(spark: SparkSession, place: str, extensions: Sequence[str], recursive: bool = True, hidden: bool = False) -> DataFrame:
    """(file_path, last_modified, file_size) of matching files."""
    return listing_with_notes(spark, place, extensions, recursive, hidden)[0]


def with_contents(files: DataFrame, path_col: str = "file_path", at_once: int = 64 << 20) -> DataFrame:
    """``files`` with ``content``: just these files are opened, where their row is; null if one can't be read.

    Rows are handed on whenever ``at_once`` bytes have been read.
    """
    columns = files.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            start, read, held = 0, [], 0
            for i, place in enumerate(pdf[path_col]):
                try:
                    with opened(place) as f:
                        read.append(f.read())
                    held += len(read[-1])
                except (OSError, ValueError, TypeError):
                    read.append(None)
                if held >= at_once or i + 1 == len(pdf):
                    yield pdf.iloc[start : i + 1].assign(content=pd.Series(read, dtype=object, index=pdf.index[start : i + 1]))
                    start, read, held = i + 1, [], 0

    spread = files.repartition(8 * files.sparkSession.sparkContext.defaultParallelism, path_col)
    return spread.mapInPandas(run, T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])).select(*(f"`{c}`" for c in columns), "content")


def scan_images(spark: SparkSession, directory: str, recursive: bool = True) -> DataFrame:
    """Images a search looks at; .tif and .gif aren't among them, nor are hidden files."""
    return listing(spark, directory, SEARCH_IMAGES, recursive)


def scan_archives(spark: SparkSession, directory: str) -> DataFrame:
    """Comic archives, always with subdirectories, hidden ones too."""
    return listing(spark, directory, ARCHIVES, True, hidden=True)


def scan_top_level(spark: SparkSession, directory: str, extensions: Sequence[str] = CLASS_IMAGES) -> DataFrame:
    """Images right in the directory."""
    return listing(spark, directory, extensions, False, hidden=True)


def scan_labelled(spark: SparkSession, directory: str, extensions: Sequence[str] = CLASS_IMAGES) -> DataFrame:
    """(file_path, ..., label): the label is the name of the file's folder, one below the directory."""
    files = listing(spark, directory, extensions, True, hidden=True)
    base = absolute(directory).rstrip("/") + "/"
    below = F.substr("file_path", F.lit(len(base) + 1))
    return files.withColumn("label", F.regexp_extract(below, r"^([^/]+)/[^/]+$", 1)).where("label <> ''")


def header_size(head: bytes) -> tuple[int, int]:
    """(width, height) from the first bytes of a PNG, GIF, BMP, JPEG or WebP file; (0, 0) if unknown. No pixel is decoded."""
    try:
        if head[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", head[16:24])
        if head[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", head[6:10])
        if head[:2] == b"BM":
            width, height = struct.unpack("<ii", head[18:26])
            return abs(width), abs(height)
        if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            if head[12:16] == b"VP8X":
                return 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little")
            if head[12:16] == b"VP8L":
                bits = int.from_bytes(head[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            width, height = struct.unpack("<HH", head[26:30])
            return width & 0x3FFF, height & 0x3FFF
        if head[:2] == b"\xff\xd8":
            at = 2
            while at + 9 <= len(head):
                mark = head[at + 1]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):  # a frame header
                    height, width = struct.unpack(">HH", head[at + 5 : at + 9])
                    return width, height
                at += 2 + int.from_bytes(head[at + 2 : at + 4], "big") if mark not in (0xFF, 0x01) else 1
    except struct.error:
        pass
    return 0, 0


def image_sizes(spark: SparkSession, directory: str, recursive: bool = True, first: int = 256 << 10) -> DataFrame:
    """(file_path, width, height) from the ``first`` bytes of each image; 0 by 0 for what isn't known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = []
            for place in pdf["file_path"]:
                try:
                    with opened(place) as f:
                        sizes.append(header_size(f.read(first)))
                except (OSError, ValueError):
                    sizes.append((0, 0))
            yield pdf.assign(width=pd.Series([w for w, _ in sizes], dtype="int32", index=pdf.index), height=pd.Series([h for _, h in sizes], dtype="int32", index=pdf.index))

    files = scan_images(spark, directory, recursive).select("file_path")
    return files.repartition(8 * spark.sparkContext.defaultParallelism, "file_path").mapInPandas(run, "file_path string, width int, height int")


def image_tensor(data: bytes, height: int, width: int, channels: int, size: int, mean: Sequence[float], std: Sequence[float]):
    """float32[3, size, size]: cropped to a square around the centre, resized, normalised.

    ``data`` is Spark's image layout (blue, green, red by row); null if it wasn't decoded.
    """
    import numpy as np

    if height <= 0 or width <= 0 or channels not in (1, 3, 4):
        return None
    x = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    rgb = np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, 2::-1]
    side = min(height, width)
    top, left = (height - side) // 2, (width - side) // 2
    rgb = rgb[top : top + side, left : left + side].astype(np.float32) / 255
    at = (np.arange(size) + 0.5) * side / size - 0.5
    lo = np.clip(np.floor(at).astype(int), 0, side - 1)
    hi, f = np.minimum(lo + 1, side - 1), np.clip(at - lo, 0, 1).astype(np.float32)
    rows = rgb[lo] * (1 - f)[:, None, None] + rgb[hi] * f[:, None, None]
    out = rows[:, lo] * (1 - f)[None, :, None] + rows[:, hi] * f[None, :, None]
    return ((out - np.float32(mean)) / np.float32(std)).transpose(2, 0, 1)


def _kept(folder: str):
    """Contents as files of ``folder``, named by their digest: ``image`` is the name, null without content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names = []
            for content in pdf["content"]:
                name = hashlib.sha256(content).hexdigest() if content is not None and len(content) else None
                if name is not None and not os.path.exists(f"{folder}/{name}"):
                    with open(f"{folder}/.{name}-{uuid.uuid4().hex}", "wb") as f:
                        f.write(content)
                    os.replace(f.name, f"{folder}/{name}")
                names.append(name)
            yield pdf.drop(columns="content").assign(image=pd.Series(names, dtype=object, index=pdf.index))

    return run


def with_tensors(images: DataFrame, size: int, mean: Sequence[float], std: Sequence[float]) -> DataFrame:
    """``images`` with ``tensor`` in place of ``content``: 3 * size * size floats by channel, row and column.

    Contents of any origin (files, pages of archives) are decoded by Spark's image reader;
    for that they are kept once, by digest, in a folder beside the checkpoints, which all
    executors have to reach by its path. The tensor of what can't be decoded is null.
    """
    spark = images.sparkSession
    checkpoint_folder(spark)
    folder = absolute(f"{spark.sparkContext.getCheckpointDir()}/images-{uuid.uuid4().hex}")
    if not is_local(folder):
        raise ValueError("images are decoded through a shared folder that has a path")
    os.makedirs(folder)
    rest = [f for f in images.schema.fields if f.name != "content"]
    named = checkpointed(images.select(*(f"`{f.name}`" for f in rest), F.col("content").cast("binary").alias("content")).mapInPandas(_kept(folder), T.StructType([*rest, T.StructField("image", T.StringType())])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 16):
                part = pdf.iloc[i : i + 16]
                made = [image_tensor(*x, size, mean, std) for x in zip(part["data"], part["height"].tolist(), part["width"].tolist(), part["nChannels"].tolist(), strict=True)]
                yield pd.DataFrame({"of": part["name"], "tensor": pd.Series([None if t is None else t.ravel().tolist() for t in made], dtype=object, index=part.index)})

    decoded = spark.read.format("image").option("dropInvalid", "false").load(folder)
    rows = decoded.select(F.regexp_extract("image.origin", "([^/]+)$", 1).alias("name"), "image.data", "image.height", "image.width", "image.nChannels")
    tensors = rows.mapInPandas(run, "of string, tensor array<float>")
    return named.join(tensors, F.col("image") == F.col("of"), "left").drop("image", "of")


def image_tensors(spark: SparkSession, directory: str, size: int, mean: Sequence[float], std: Sequence[float]) -> DataFrame:
    """(file_path, tensor) of a directory's images; see ``with_tensors``."""
    return with_tensors(with_contents(scan_images(spark, directory).select("file_path")), size, mean, std)
