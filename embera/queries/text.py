"""Scalar functions over whole tables, and small fixed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths, schedule, text
from ..functions.entities import unescape_sql, unescaped
from ..functions.tokenizer import tokenized
from ..operators import routing


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def path_parts(spark, d):
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", paths.directory(u).alias("directory"), paths.file_name(u).alias("file_name"), paths.extension(u).alias("extension"), paths.stem(u).alias("stem"), paths.root(u).alias("root"))


def dir_normalize(spark, d):
    p = _t(spark, d, "pages")
    raw = F.concat(F.lit("  J:\\"), F.regexp_replace("url", "^[a-z]+://", ""), F.when(F.pmod("page_id", F.lit(2)) == 0, F.lit("\\\\")).otherwise(F.lit("")))
    return p.select("page_id", paths.normalize_directory(raw).alias("directory"))


def size_text(spark, d):
    n = F.col("n_chars")
    return _t(spark, d, "documents").select("doc_id", text.format_size(n).alias("short"), text.format_bytes(n * 1024).alias("long"), text.size_text(n * 3).alias("fixed"))


def tile_text(spark, d):
    c = _t(spark, d, "documents")
    return c.select("doc_id", text.tile_text(F.pmod("doc_id", F.lit(3)) * 640, F.lit(480), F.when(F.pmod("doc_id", F.lit(2)) == 0, F.lit(0)).otherwise(F.lit(512))).alias("tile"), text.page_label(F.pmod("doc_id", F.lit(7)), F.pmod("doc_id", F.lit(4)) * 7).alias("page"))


def magic_sniff(spark, d):
    """Signatures put before each page's first bytes by page_id."""
    p = _t(spark, d, "pages")
    heads = ["FFD8FFE0", "89504E47", "47494638", "424D0000", "49492A00", "4D4D002A", "524946460000000057454250", "00000000"]
    boxes = ["526172211A070100", "526172211A0700CF", "504B030414000000", "377AFC0707000000", "377ABCAF271C0004", "DEADBEEF01020304", "504B03", "504B050600000000"]
    pick = lambda x: F.unhex(F.get(F.array(*(F.lit(h) for h in x)), F.pmod("page_id", F.lit(8)).cast("int")))
    return p.select("page_id", paths.sniff_extension(pick(heads)).alias("image"), paths.container_signature(pick(boxes)).alias("container"))


def tag_parse(spark, d):
    t = text.parse_tags(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(t).alias("n_tags"), F.get(t, F.lit(0)).alias("first_tag"))


def path_preview(spark, d):
    """The first three addresses of a host, and how many more; no host's addresses are gathered."""
    p = _t(spark, d, "pages").select(paths.root(F.col("url")).alias("root"), "url")
    place = F.row_number().over(Window.partitionBy("root").orderBy("url"))
    first = p.withColumn("place", place).where("place <= 3").groupBy("root").agg(F.array_sort(F.collect_list("url")).alias("urls"))
    counts = p.groupBy(F.col("root").alias("r")).agg(F.count("*").alias("n"))
    return first.join(counts, first.root.eqNullSafe(counts.r)).select("root", text.path_preview(F.col("urls"), 3, F.col("n")).alias("preview"))


def html_unescape(spark, d):
    out = _t(spark, d, "pages").select("page_id", unescaped(F.col("html")).alias("t"))
    return out.select("page_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("sha256"))


def copy_name_collisions(spark, d):
    """Hosts as file names; every fifth carries a number already, and some numbers are taken."""
    number = F.when(F.pmod("page_id", F.lit(5)) == 0, F.format_string(" (%d)", F.pmod("page_id", F.lit(7)) + 1)).otherwise(F.lit(""))
    p = _t(spark, d, "pages").select("page_id", F.element_at(F.split("url", "/"), 3).alias("host"), "url")
    taken = p.where(F.pmod("page_id", F.lit(11)) == 3).select(F.concat(F.upper("host"), F.lit(" (2).JPG")).alias("name"))
    named = p.select("page_id", F.concat("host", number, F.lit(".jpg")).alias("name"))
    return routing.clash_free_names(named, "name", ["page_id"], taken).select("page_id", "target_name")


def _days(spark, d):
    """The days of the events as epochs: (epoch, epochs, validation_accuracy), the share of purchases' values above 50 as accuracy."""
    e = _t(spark, d, "events").select(F.to_date("ts").alias("day"), F.round(F.col("value"), 3).alias("value"))
    first = e.agg(F.min("day").alias("first"))
    by = e.groupBy("day").agg(F.round(F.count_if(F.col("value") > 50) / F.count("*"), 6).alias("validation_accuracy"))
    return by.crossJoin(F.broadcast(first)).select(F.datediff("day", "first").alias("epoch"), "validation_accuracy")  # one row on the right


def lr_schedule(spark, d):
    """Rates of 50 epochs' schedules for each day of the events."""
    e = _days(spark, d).select("epoch")
    parts = [e.select(F.lit(s).alias("schedule"), "epoch", F.round(schedule.learning_rate(s, F.col("epoch"), 50, 0.01), 9).alias("rate")) for s in ("cosine", "step", "one_cycle")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def best_epoch(spark, d):
    return schedule.best_epoch(_days(spark, d))


def architectures(spark, d):
    """Each architecture with the number of parts whose tenfold size its input takes in."""
    a, p = F.broadcast(schedule.architectures(spark)), _t(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    return a.join(p, F.col("p_size") * 10 >= F.col("image_size"), "left").groupBy(*a.columns).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_parts"))


def prompt_text(spark, d):
    return _t(spark, d, "benchmark").select("item_id", text.prompt(text.clean_prompt(F.col("text"))).alias("prompt"))


def bpe_tokenize(spark, d):
    """Ids of every benchmark text by the prompt tokenizer."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    out = _t(spark, d, "benchmark").select("item_id", tokenized(F.col("text"), definition).alias("ids"))
    return out.select("item_id", F.size(F.filter("ids", lambda i: i != 0)).alias("n"), F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


_NAMES = (path_parts, dir_normalize, size_text, tile_text, magic_sniff, tag_parse, path_preview, html_unescape, copy_name_collisions, lr_schedule, best_epoch, architectures, prompt_text, bpe_tokenize)
QUERIES = {f.__name__: f for f in _NAMES}

_F = "regexp_extract(url, '([^/\\\\]*)$', 1)"


def _size(n: str, units: str, digits: int) -> str:
    names, out = units.split(), ""
    for i, u in enumerate(names):
        value = f"{n} / {float(1024**i)}" if i else n
        shown = f"CAST({n} AS VARCHAR)" if i == 0 else (f"printf('%.1f', floor({value} * 10 + 0.5) / 10)" if digits < 0 else f"regexp_replace(printf('%.{digits}f', floor({value} * {10**digits} + 0.5) / {10**digits}), '\\.?0+$', '')")
        out += (f"WHEN {n} < {1024 ** (i + 1)} THEN " if i < len(names) - 1 else "ELSE ") + f"{shown} || ' {u}' "
    return f"CASE {out}END"


_DAYS = "SELECT CAST(datediff('day', min(day) OVER (), day) AS INTEGER) AS epoch, validation_accuracy FROM (SELECT CAST(ts AS DATE) AS day, round(count(*) FILTER (round(value, 3) > 50) / count(*), 6) AS validation_accuracy FROM events GROUP BY 1)"
ORACLES = {
    "html_unescape": f"SELECT page_id, length(t) AS n_chars, sha256(t) AS sha256 FROM (SELECT page_id, lower(trim(regexp_replace(t, '[\\t-\\r\\x1c- \\x85\\xa0\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'), ' ')) AS t FROM {unescape_sql(unescape_sql('(SELECT page_id, html AS t FROM pages)'))})",
    "path_parts": f"SELECT page_id, regexp_extract(url, '^(.*)[/\\\\][^/\\\\]*$', 1) AS directory, {_F} AS file_name, regexp_extract({_F}, '(\\.[^.]*)$', 1) AS extension, regexp_replace({_F}, '\\.[^.]*$', '') AS stem, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]+://[^/]*)', 1) AS root FROM pages",
    "dir_normalize": "SELECT page_id, 'J:\\' || regexp_replace(regexp_replace(rtrim(url), '^[a-z]+://', ''), '\\\\+$', '') AS directory FROM pages",
    "size_text": f"SELECT doc_id, {_size('n_chars', 'B KB MB GB', 1)} AS short, {_size('(n_chars * 1024)', 'B KB MB GB', 2)} AS long, {_size('(n_chars * 3)', 'B KB MB', -1)} AS fixed FROM documents",
    "tile_text": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN '(click to open)' WHEN doc_id % 3 = 0 THEN '512 B' WHEN doc_id % 2 = 0 THEN (doc_id % 3 * 640) || ' × 480' ELSE (doc_id % 3 * 640) || ' × 480 | 512 B' END AS tile, CASE WHEN doc_id % 4 > 0 THEN 'Page ' || (doc_id % 7 + 1) || ' of ' || (doc_id % 4 * 7) ELSE '' END AS page FROM documents",
    "magic_sniff": "SELECT page_id, ['.jpg', '.png', '.gif', '.bmp', '.tif', '.tif', '.webp', '.jpg'][page_id % 8 + 1] AS image, ['RAR5', 'RAR', 'ZIP', '7Z', '7Z', NULL, NULL, 'ZIP'][page_id % 8 + 1] AS container FROM pages",
    "tag_parse": "WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[,\\n;]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS t FROM documents) SELECT doc_id, CAST(len(list_distinct(t)) AS INTEGER) AS n_tags, t[1] AS first_tag FROM t",
    "path_preview": f"WITH r AS (SELECT regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]+://[^/]*)', 1) AS root, {_F} AS f, url FROM pages), n AS (SELECT root, list(f ORDER BY url) AS fs FROM r GROUP BY root) SELECT root, array_to_string(fs[1:3], ', ') || CASE WHEN len(fs) > 3 THEN ' ... (+' || (len(fs) - 3) || ' more)' ELSE '' END AS preview FROM n",
    "copy_name_collisions": r"""WITH p AS (SELECT page_id, string_split(url, '/')[3] AS h FROM pages),
f AS (SELECT page_id, h || CASE WHEN page_id % 5 = 0 THEN ' (' || (page_id % 7 + 1) || ')' ELSE '' END AS stem, lower(stem) AS key FROM p),
t AS (SELECT DISTINCT lower(h) || ' (2)' AS key FROM p WHERE page_id % 11 = 3),
d AS (SELECT f.*, row_number() OVER (PARTITION BY f.key ORDER BY page_id) - CASE WHEN t.key IS NULL THEN 1 ELSE 0 END AS d FROM f LEFT JOIN t USING (key)),
u AS (SELECT key FROM f UNION SELECT key FROM t),
n AS (SELECT key, unnest(range(1, (SELECT max(d) + count(*) FROM d))) AS n FROM (SELECT DISTINCT key FROM d WHERE d > 0)),
free AS (SELECT key, n, row_number() OVER (PARTITION BY key ORDER BY n) AS d FROM n WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.key = n.key || ' (' || n.n || ')'))
SELECT page_id, stem || CASE WHEN d > 0 THEN ' (' || n || ')' ELSE '' END || '.jpg' AS target_name FROM d LEFT JOIN free USING (key, d)""",
    "lr_schedule": f"WITH e AS ({_DAYS}) SELECT s AS schedule, epoch, round(CASE WHEN s = 'step' THEN 0.01::DOUBLE * pow(0.1::DOUBLE, epoch // 20) ELSE 0.01::DOUBLE * 0.5 * (1 + cos(pi() * epoch / 50.0::DOUBLE)) END, 9) AS rate FROM e, (VALUES ('cosine'), ('step'), ('one_cycle')) v(s)",
    "best_epoch": f"SELECT epoch, validation_accuracy FROM ({_DAYS}) ORDER BY validation_accuracy DESC, epoch LIMIT 1",
    "architectures": "SELECT v.*, (SELECT count(*) FROM part WHERE p_size * 10 >= image_size) AS n_parts FROM (VALUES ('EfficientNetB0', 'EfficientNet-B0', 224, 5), ('EfficientNetB1', 'EfficientNet-B1', 224, 8), ('EfficientNetV2S', 'EfficientNetV2-S', 384, 21), ('ConvNeXtTiny', 'ConvNeXt-Tiny', 224, 29), ('MobileNetV3Large', 'MobileNetV3-Large', 224, 6)) v(architecture, display_name, image_size, params_m)",
    "prompt_text": "SELECT item_id, 'a photo of ' || lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS prompt FROM benchmark",
}
