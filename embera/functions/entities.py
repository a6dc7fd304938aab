"""HTML character references as column expressions, for generated code without Python workers.

What a reference stands for comes from the standard's table of names, read from Python's
library: names that end in a semicolon are looked up as a whole; of others, and of unknown
ones, the longest old name that is allowed without a semicolon counts.
"""

from __future__ import annotations

from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names with and without a semicolon.
NAMED = {n: v for n, v in html5.items() if n.endswith(";")}
OLD = {n: v for n, v in html5.items() if not n.endswith(";")}
#: What numbers 128 to 159 mean: the characters of the old code page, themselves where it has none.
PAGE = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160))
#: White space that is collapsed: fixed values.
WHITE = r"[\t-\r\x1c- \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for item in sorted(entries.items()) for x in item))


def character(code: Column) -> Column:
    """The text of a numeric reference, by the standard's rules for numbers that are no characters."""
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    low = code.between(1, 8) | code.between(14, 31) | (code == 11) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return (
        F.when(code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd")
        .when(code == 13, "\r")
        .when(code.between(128, 159), F.substring(F.lit(PAGE), (code - 127).cast("int"), F.lit(1)))
        .when(low, "")
        .otherwise(plain)
    )


def _reference(part: Column, named: Column, old: Column) -> Column:
    """What stands behind an ampersand, with the reference at its beginning resolved."""
    number, hexed = F.regexp_extract(part, "^#([0-9]+)", 1), F.regexp_extract(part, "^#[xX]([0-9a-fA-F]+)", 1)
    value = lambda digits, base, most: F.when(F.length(F.ltrim(digits, F.lit("0"))) <= most, F.conv(digits, base, 10).cast("long"))
    name = F.regexp_extract(part, "^([A-Za-z0-9]{1,31};)", 1)
    short = F.regexp_extract(part, f"^({'|'.join(sorted(OLD, key=lambda n: (-len(n), n)))})", 1)
    whole = F.element_at(named, name)
    return (
        F.when(number != "", F.concat(character(value(number, 10, 7)), F.regexp_replace(part, "^#[0-9]+;?", "")))
        .when(hexed != "", F.concat(character(value(hexed, 16, 6)), F.regexp_replace(part, "^#[xX][0-9a-fA-F]+;?", "")))
        .when((name != "") & whole.isNotNull(), F.concat(whole, F.substr(part, F.length(name) + 1)))
        .when(short != "", F.concat(F.element_at(old, short), F.substr(part, F.length(short) + 1)))
        .otherwise(F.concat(F.lit("&"), part))
    )


def unescape(text: Column) -> Column:
    """A text with its character references resolved once."""
    parts = F.split(text, "&", -1)
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: _reference(p, _map(NAMED), _map(OLD)))
    return F.when(F.contains(text, F.lit("&")), F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))).otherwise(text)


def unescaped(text: Column) -> Column:
    """References resolved twice, white space collapsed, trimmed, lower case; null stays null."""
    twice = reduce(lambda t, _: unescape(t), range(2), text)
    return F.lower(F.trim(F.regexp_replace(twice, WHITE, " ")))


def unescape_sql(text: str) -> str:
    """The same once, for DuckDB, whose code points and maps are its own."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = lambda entries: "MAP {" + ", ".join(f"{quote(n)}: {quote(v)}" for n, v in sorted(entries.items())) + "}"
    code = "CASE WHEN d <> '' THEN CASE WHEN length(ltrim(d, '0')) <= 7 THEN TRY_CAST(d AS BIGINT) END WHEN length(ltrim(h, '0')) <= 6 THEN TRY_CAST('0x' || h AS BIGINT) END"
    chars = f"CASE WHEN k IS NULL OR k = 0 OR k BETWEEN 55296 AND 57343 OR k > 1114111 THEN chr(65533) WHEN k = 13 THEN chr(13) WHEN k BETWEEN 128 AND 159 THEN substr({quote(PAGE)}, k::INT - 127, 1) WHEN k BETWEEN 1 AND 8 OR k BETWEEN 14 AND 31 OR k IN (11, 127) OR k BETWEEN 64976 AND 65007 OR k % 65536 >= 65534 THEN '' ELSE chr(k::INT) END"
    short = "|".join(sorted(OLD, key=lambda n: (-len(n), n)))
    return f"""(SELECT page_id, string_agg(CASE WHEN i = 1 THEN p WHEN d <> '' OR h <> '' THEN ({chars}) || regexp_replace(p, '^#([0-9]+|[xX][0-9a-fA-F]+);?', '') WHEN w IS NOT NULL THEN w || substr(p, length(n) + 1) WHEN s <> '' THEN {table(OLD)}[s] || substr(p, length(s) + 1) ELSE '&' || p END, '' ORDER BY i) AS t
FROM (SELECT *, {code} AS k, {table(NAMED)}[n] AS w FROM (SELECT *, regexp_extract(p, '^#([0-9]+)', 1) AS d, regexp_extract(p, '^#[xX]([0-9a-fA-F]+)', 1) AS h, regexp_extract(p, '^([A-Za-z0-9]{{1,31}};)', 1) AS n, regexp_extract(p, '^({short})', 1) AS s
FROM (SELECT page_id, unnest(string_split(t, '&')) AS p, generate_subscripts(string_split(t, '&'), 1) AS i FROM {text}))) GROUP BY page_id)"""
