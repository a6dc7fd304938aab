"""Texts for display and for prompts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import file_name


def _trimmed(value: Column, digits: int) -> Column:
    """Rounded half up to ``digits`` decimals, without zeros at the end."""
    text = F.format_string(f"%.{digits}f", F.round(value, digits).cast("double"))
    return F.regexp_replace(text, r"\.?0+$", "")


def _sized(size: Column, show, units: tuple[str, ...]) -> Column:
    out = F.concat(show(size / float(1024 ** (len(units) - 1))), F.lit(f" {units[-1]}"))
    for i in reversed(range(len(units) - 1)):
        n = show(size / float(1024**i)) if i else size.cast("string")
        out = F.when(size < 1024 ** (i + 1), F.concat(n, F.lit(f" {units[i]}"))).otherwise(out)
    return out


def format_size(size: Column) -> Column:
    """512 B, 852 KB, 1.4 MB, 1.2 GB: one decimal at most."""
    return _sized(size, lambda x: _trimmed(x, 1), ("B", "KB", "MB", "GB"))


def format_bytes(size: Column) -> Column:
    """As format_size, two decimals at most."""
    return _sized(size, lambda x: _trimmed(x, 2), ("B", "KB", "MB", "GB"))


def size_text(size: Column) -> Column:
    """B, or KB and MB with one decimal always."""
    return _sized(size, lambda x: F.format_string("%.1f", F.round(x, 1).cast("double")), ("B", "KB", "MB"))


def tile_text(width: Column, height: Column, size: Column) -> Column:
    """``1920 × 1080 | 1.4 MB``; unknown parts left out, (click to open) if all are."""
    pixels = F.when((width > 0) & (height > 0), F.concat(width.cast("string"), F.lit(" × "), height.cast("string")))
    parts = F.concat_ws(" | ", pixels, F.when(size > 0, format_size(size)))
    return F.when(parts == "", "(click to open)").otherwise(parts)


def percent_text(score: Column) -> Column:
    """12.3%: half away from zero, decided on thousandths (``score * 100`` of 0.0045 is a bit under 0.45), and no -0.0%."""
    score = score.cast("double")
    return F.format_string("%.1f%%", F.signum(score) * F.floor(F.abs(score) * 1000 + 0.5) / 10 + 0.0)


def page_label(index: Column, count: Column) -> Column:
    return F.when(count > 0, F.format_string("Page %d of %d", (index + 1).cast("int"), count.cast("int"))).otherwise("")


def score_band(score: Column) -> Column:
    return F.when(score >= 0.28, "green").when(score >= 0.20, "orange").otherwise("gray")


def parse_tags(text: Column) -> Column:
    """Parts between commas, semicolons and line ends, trimmed, without blanks and repetitions."""
    parts = F.transform(F.split(text, r"[,\n;]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def prompt(query: Column) -> Column:
    return F.concat(F.lit("a photo of "), query)


def path_preview(paths: Column, most: int = 3, total: Column | None = None) -> Column:
    """The first file names, and how many more there are (of ``total``, if ``paths`` are just the first)."""
    n = F.size(paths) if total is None else total
    shown = F.array_join(F.transform(F.slice(paths, 1, most), file_name), ", ")
    return F.when(n > most, F.concat(shown, F.format_string(" ... (+%d more)", n - most))).otherwise(shown)


def clean_prompt(text: Column) -> Column:
    """White space collapsed, trimmed, lower case (HTML entities: see tokenizer.unescape_html)."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
