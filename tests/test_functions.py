import math
import struct

import pytest
from pyspark.sql import functions as F

from embera.functions import codec, paths, schedule, text
from embera.functions import vector as V
from embera.functions.tokenizer import PromptTokenizer, unescape_html


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", bytes: "binary", list: "array<double>"}
    schema = ", ".join(f"{k} {kinds[type(v)] if v is not None else 'array<double>'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (0,)], schema).select(column.alias("r")).first()["r"]


def test_vectors(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, V.dot(a, b), a=[1.0, 2.0], b=[3.0, 4.0]) == 11.0
    assert one(spark, V.dot(a, b), a=[1.0], b=[3.0, 4.0]) is None
    assert one(spark, V.euclidean(a, b), a=[0.0, 0.0], b=[3.0, 4.0]) == 5.0
    assert one(spark, V.l2_normalize(a), a=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, V.l2_normalize(a), a=[0.0, 0.0]) == [0.0, 0.0]
    assert [one(spark, V.is_zero(a), a=x) for x in ([0.0, 0.0], [0.0, 1.0], None)] == [True, False, True]
    assert one(spark, V.best_label(a, ["x", "y"]), a=[1.0, 5.0]) == "y"
    assert one(spark, V.best_label(a, ["x"]), a=[1.0, 5.0]) == "Unknown"
    assert one(spark, V.arg_max(a), a=[5.0, 5.0]) == 0
    assert abs(sum(one(spark, V.softmax(a), a=[1.0, 2.0, 3.0])) - 1) < 1e-12


def test_codec(spark):
    for v in ([1.0, -2.5, 0.0, 0.125, 3.5], [i % 7 / 7 - 0.5 for i in range(512)]):
        as32 = list(struct.unpack(f"<{len(v)}f", struct.pack(f"<{len(v)}f", *v)))
        t = codec.to_base64(v)
        assert codec.try_parse_base64(t) == as32
        assert codec.try_parse_base64("\n".join(t[i : i + 48] for i in range(0, len(t), 48))) == as32
        assert codec.from_blob(codec.to_blob(v)) == as32
        assert codec.pages_from_blob(codec.to_blob(v) * 3) == [as32] * 3
    for bad in (None, "", "   ", "not a hash", "AB=", "AAAA(AAA", "AAAA%AAA"):
        assert codec.try_parse_base64(bad) is None
    for bad in (b"", b"1234567", codec.to_blob([1.0])[:-1], codec.to_blob([1.0]) + b"x"):
        with pytest.raises(ValueError):
            codec.from_blob(bad)
    with pytest.raises(ValueError):
        codec.pages_from_blob(codec.to_blob([1.0]) * 2 + b"\1\0\0\0")
    with pytest.raises(ValueError):
        codec.to_base64(None)
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<float>")
    back = df.select("v", codec.blob_to_vector(codec.vector_to_blob(F.col("v"))).alias("w"), codec.base64_to_vector(codec.vector_to_base64(F.col("v"))).alias("x")).collect()
    assert all(r["v"] == r["w"] == r["x"] for r in back)


@pytest.mark.parametrize("raw,want", [("J:\\x\\", "J:\\x"), ("J:\\", "J:\\"), ("\\\\server\\share\\", "\\\\server\\share"), ("  J:\\a\\\\ ", "J:\\a")])
def test_directories(spark, raw, want):
    assert one(spark, paths.normalize_directory(F.col("p")), p=raw) == want


def test_paths(spark):
    p = F.col("p")
    assert one(spark, paths.base_file_path(p), p="/d/Big.cbr|page=42") == "/d/Big.cbr"
    assert [one(spark, paths.page_of_key(p), p=x) for x in ("a|page=42", "a|page=4x", "a", "a|page=")] == [42, None, None, None]
    assert one(spark, paths.file_name(p), p="J:\\a\\b c.JPG") == "b c.JPG"
    assert one(spark, paths.stem(p), p="/a/b.tar.gz") == "b.tar"
    assert one(spark, paths.extension(p), p="/a.b/c") == ""
    assert one(spark, paths.directory(p), p="/a/b/c.jpg") == "/a/b"
    assert [one(spark, paths.root(p), p=x) for x in ("J:\\a\\b", "\\\\s\\t\\u", "/a/b", "a/b", "http://h/x")] == ["J:\\", "\\\\s\\t", "/", "", "http://h"]
    assert [one(spark, paths.has_extension(p, paths.SEARCH_IMAGES), p=x) for x in ("A.JPG", "b.tif", "c.gif", "d.webp")] == [True, False, False, True]


@pytest.mark.parametrize("head,want", [("526172211A0700CF", "RAR"), ("526172211A070100", "RAR5"), ("504B030414000000", "ZIP"), ("377AFC0707000000", "7Z"), ("377ABCAF271C0004", "7Z"), ("DEADBEEF01020304", None), ("504B03", None)])
def test_signatures(spark, head, want):
    assert one(spark, paths.container_signature(F.col("c")), c=bytes.fromhex(head)) == want


def test_display(spark):
    n = F.col("n")
    assert [one(spark, text.format_size(n), n=x) for x in (512, 872448, 1468006, 1288490188)] == ["512 B", "852 KB", "1.4 MB", "1.2 GB"]
    assert one(spark, text.format_bytes(n), n=1320000) == "1.26 MB"
    assert [one(spark, text.size_text(n), n=x) for x in (10, 2048, 5 * 1024**2)] == ["10 B", "2.0 KB", "5.0 MB"]
    tile = text.tile_text(F.col("w"), F.col("h"), n)
    assert one(spark, tile, w=1920, h=1080, n=1468006) == "1920 × 1080 | 1.4 MB"
    assert one(spark, tile, w=0, h=0, n=0) == "(click to open)"
    assert one(spark, text.page_label(n, F.col("m")), n=2, m=5) == "Page 3 of 5" and one(spark, text.page_label(n, F.col("m")), n=2, m=0) == ""
    assert [one(spark, text.score_band(F.col("s")), s=x) for x in (0.28, 0.2, 0.19)] == ["green", "orange", "gray"]
    assert one(spark, text.parse_tags(F.col("t")), t=" beach , city;;beach\nforest") == ["beach", "city", "forest"]
    assert one(spark, text.prompt(F.col("t")), t="autumn") == "a photo of autumn"
    paths_of = F.array(*(F.lit(f"/a/{i}.jpg") for i in range(5)))
    assert one(spark, text.path_preview(paths_of)) == "0.jpg, 1.jpg, 2.jpg ... (+2 more)"
    assert unescape_html(" A &amp;amp;  b ") == "a & b"


def test_percent_text_halves_go_away_from_zero(spark):
    halves = spark.range(-1000, 1000).select(((F.col("id") * 1000 + 500) / 1e6).alias("s"))
    got = halves.select("s", text.percent_text(F.col("s")).alias("t")).collect()
    assert [r["t"] for r in got] == [f"{math.copysign(math.floor(abs(r['s']) * 1000 + 0.5) / 10, r['s']):.1f}%" for r in got]
    assert [one(spark, text.percent_text(F.col("s")), s=x) for x in (0.0045, -0.9165, -0.0001, 0.0)] == ["0.5%", "-91.7%", "0.0%", "0.0%"]


def test_schedule(spark):
    e = spark.range(50).select(F.col("id").alias("e"), *(schedule.learning_rate(s, F.col("id"), 50, 0.1).alias(s) for s in ("cosine", "step", "one_cycle"))).collect()
    for r in e:
        assert math.isclose(r["cosine"], 0.05 * (1 + math.cos(math.pi * r["e"] / 50))) and r["one_cycle"] == r["cosine"]
        assert math.isclose(r["step"], 0.1 * 0.1 ** (r["e"] // 20))
    best = spark.createDataFrame([(0, 0.5), (1, 0.9), (2, 0.9)], "epoch int, validation_accuracy double")
    assert schedule.best_epoch(best).first()["epoch"] == 1
    files = spark.range(103).selectExpr("concat('f', id) as path")
    parts = {r["part"]: r["count"] for r in schedule.train_validation_split(files, "path", 0.2).groupBy("part").count().collect()}
    assert parts == {"validation": 20, "train": 83}


def test_tokenizer():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        t = PromptTokenizer(f.read())
    assert t.tokenize("") == [49406, 49407] + [0] * 75
    assert t.tokenize("beach")[1] == 2117 and t.tokenize("Summer")[1] == 1673
    assert t.encode("a photo of a beach") == [320, 1125, 539, 320, 2117]
    long = t.tokenize("word " * 200)
    assert len(long) == 77 and long[-1] == 49407


def test_images_in_pdf_files(spark):
    kinds = {b"\xff\xd8\xff\xe0": ".jpg", b"\x89PNG\r\n": ".png", b"BM1234": ".bmp", b"II*\0": ".tif", b"MM\0*": ".tif", b"GIF89a": None, b"": None}
    for head, want in kinds.items():
        assert one(spark, paths.pdf_image_extension(F.col("c")), c=head) == want
