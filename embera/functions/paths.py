"""Paths, page keys and file signatures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = "|page="
#: File extensions of the scans; fixed values.
SEARCH_IMAGES = ("jpg", "jpeg", "png", "bmp", "tiff", "webp")
CLASS_IMAGES = ("jpg", "jpeg", "png", "bmp", "tiff")
PAGE_IMAGES = ("jpg", "jpeg", "png", "bmp", "tiff", "tif", "webp", "gif")
ARCHIVES = ("cbz", "cbr", "cb7", "cbt", "pdf")
COMIC_ARCHIVES = ("cbz", "cbr", "cb7", "cbt")


def has_extension(path: Column, extensions: tuple[str, ...]) -> Column:
    """Whether the path ends in one of the extensions, in either case."""
    return F.lower(path).rlike(rf"\.({'|'.join(extensions)})$")


def base_file_path(key: Column) -> Column:
    """The path before the first |page=."""
    return F.substring_index(key, PAGE, 1)


def page_of_key(key: Column) -> Column:
    """The number after the first |page= if the whole rest is one; else null."""
    at = F.locate(PAGE, key)
    rest = F.substr(key, at + F.lit(len(PAGE)))
    return F.when(at > 0, F.when(rest.rlike(r"^-?\d{1,10}$"), rest.try_cast("int")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def directory(path: Column) -> Column:
    """Everything before the last separator; empty without one."""
    return F.regexp_replace(F.regexp_extract(path, r"^(?s)(.*)[/\\][^/\\]*$", 1), r"^$", "")


def extension(path: Column) -> Column:
    """The extension with its dot; empty without one."""
    return F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def root(path: Column) -> Column:
    r"""Drive (``J:\``), share (``\\server\share``), scheme and host, or ``/``; empty if relative."""
    return F.coalesce(
        F.nullif(F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]+://[^/]*)", 1), F.lit("")),
        F.nullif(F.regexp_extract(path, r"^([A-Za-z]:[/\\]?)", 1), F.lit("")),
        F.nullif(F.regexp_extract(path, r"^(\\\\[^\\/]+[\\/][^\\/]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(path, r"^(/)", 1), F.lit("")),
        F.lit(""),
    )


def is_drive_root(path: Column) -> Column:
    return path.rlike(r"^[A-Za-z]:[/\\]?$")


def normalize_directory(path: Column) -> Column:
    r"""Trimmed, without separators at the end, but ``J:\`` keeps its own."""
    t = F.trim(path)
    short = F.regexp_replace(t, r"\\+$", "")
    return F.when(F.length(t) <= 3, t).otherwise(F.when(F.length(short) >= 3, short).otherwise(F.substring(t, 1, 3)))


def same_directory(a: Column, b: Column) -> Column:
    return F.lower(normalize_directory(a)) == F.lower(normalize_directory(b))


def container_signature(content: Column) -> Column:
    """RAR5, RAR, ZIP or 7Z from the first bytes; null if there are under 6 or none fits."""
    h = F.hex(F.substring(content, 1, 8))
    return F.when(
        F.length(h) >= 12,
        F.when(h.startswith("526172211A0701"), "RAR5").when(h.startswith("526172211A07"), "RAR").when(h.rlike("^504B0[357]"), "ZIP").when(h.startswith("377AFC0707") | h.startswith("377ABCAF271C"), "7Z"),
    )


def container_family(path: Column) -> Column:
    """What the extension promises."""
    e = F.lower(extension(path))
    return F.when(e.isin(".cbz", ".zip"), "ZIP").when(e.isin(".cbr", ".rar"), "RAR").when(e.isin(".cb7", ".7z"), "7Z").when(e == ".cbt", "TAR").when(e == ".pdf", "PDF")


def pdf_image_extension(content: Column) -> Column:
    """Extension of an image in a PDF file, one of the four kinds that stand in there as files; null if none fits."""
    h = F.hex(F.substring(content, 1, 8))
    return F.when(h.startswith("FFD8FF"), ".jpg").when(h.startswith("89504E47"), ".png").when(h.startswith("424D"), ".bmp").when(h.startswith("49492A00") | h.startswith("4D4D002A"), ".tif")


def sniff_extension(content: Column) -> Column:
    """Image extension from magic bytes; .jpg if none fits."""
    h = F.hex(F.substring(content, 1, 12))
    return (
        F.when(h.startswith("FFD8FF"), ".jpg")
        .when(h.startswith("89504E47"), ".png")
        .when(h.startswith("47494638"), ".gif")
        .when(h.startswith("424D"), ".bmp")
        .when(h.startswith("49492A00") | h.startswith("4D4D002A"), ".tif")
        .when(h.rlike("^52494646.{8}57454250"), ".webp")
        .otherwise(".jpg")
    )
