import io
import math
import os
import struct
import zipfile
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from embera.plans import analysis, maintenance
from embera.plans.comic_search import ComicSearch
from embera.operators.probe import probe_status
from embera.plans.encoding import HashingEncoder, complete_archives, probe_stored
from embera.plans.image_search import ImageSearch, search_roots
from embera.plans.store import CacheStore
from embera.sources import archives, containers, files


@pytest.fixture
def store(spark, tmp_path):
    return CacheStore(spark, str(tmp_path / "store"))


class FakeEncoder(HashingEncoder):
    """Vectors by the first byte of a file, and a count of what was encoded through a file."""

    def __init__(self, log):
        super().__init__(4, "fake")
        self.log = str(log)

    def encode_text(self, text):
        assert text.startswith("a photo of ") or " " not in text
        return [1.0, 0.0, 0.0, 0.0]

    def encode_images(self, contents):
        with open(self.log, "a") as f:
            f.write("x" * len(contents))
        return [{b"a": [1.0, 0, 0, 0], b"b": [0.6, 0.8, 0, 0], b"c": [0, 1.0, 0, 0]}.get(c[:1], [0.0] * 4) for c in contents]

    def encoded(self):
        try:
            with open(self.log, "r+") as f:
                n = len(f.read())
                f.seek(0)
                f.truncate()
            return n
        except FileNotFoundError:
            return 0


FILE = "model_name string, file_path string, last_modified string, file_size long, embedding array<float>"


def test_round_trip(spark, store):
    v = [math.sin(0.5 * i) * 0.25 for i in range(512)]
    as32 = list(struct.unpack("<512f", struct.pack("<512f", *v)))
    keys = ["D:/漫画/é.cbr", "D:/漫画/é.cbr|page=0"]
    store.upsert("file_cache", spark.createDataFrame([("m", k, "2025-12-23T08:49:55Z", 61839456, v) for k in keys], FILE))
    again = CacheStore(spark, store.root)
    assert {r["file_path"]: list(r["embedding"]) for r in again.view("file_cache", "m").collect()} == {k: as32 for k in keys}
    store.upsert("file_cache", spark.createDataFrame([("m", keys[0], "x", 1, [9.0])], FILE))
    assert {r["file_path"]: r["file_size"] for r in store.view("file_cache").collect()} == {keys[0]: 1, keys[1]: 61839456}
    assert store.view("file_cache", "other").count() == 0
    with pytest.raises(Exception, match="components"):
        store.upsert("file_cache", spark.createDataFrame([("m", "z", "x", 1, [])], FILE))
    assert store.view("file_cache").count() == 2


def test_last_of_a_key_and_the_plan_of_a_view(spark, store):
    rows = [("m", "p", str(i), i, [float(i)], f"2024-01-0{i}") for i in (2, 1, 3)]
    store.upsert("file_cache", spark.createDataFrame(rows, FILE + ", created_at string"))
    assert [(r["file_size"], r["created_at"]) for r in store.view("file_cache").collect()] == [(3, "2024-01-03")]
    store.upsert("file_cache", spark.createDataFrame([("m", "q", "x", 1, [9.0])], FILE))
    store.upsert("file_cache", spark.createDataFrame([("m", "q", "x", 2, [8.0]), ("m", "p", "x", 4, [7.0])], FILE))
    assert sorted((r["file_path"], r["file_size"]) for r in store.view("file_cache").collect()) == [("p", 4), ("q", 2)]
    plan = store.view("file_cache", "m")._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "Aggregate" in line and "embedding" in line] and "SortAggregate" not in plan


def test_store_is_migrated_before_it_is_read(spark, store):
    store.upsert("file_cache", spark.createDataFrame([("m", "a.cbz|page=0", "t", 1, [1.0])], FILE))
    marks = spark.createDataFrame([("m", "a.cbz", 1)], "model_name string, archive_path string, page_count int")
    again = maintenance.open_store(spark, store.root, marks)
    assert again.view("file_cache").count() == 0 and again.view("archive_cache").count() == 1
    assert maintenance.open_store(spark, store.root, marks).view("archive_cache").count() == 1


def test_archives_clear_and_vacuum(spark, store):
    box = "model_name string, archive_path string, page_count int, last_modified string, file_size long, pages array<array<float>>"
    page = lambda seed: [float(seed + i) for i in range(8)]
    store.upsert("archive_cache", spark.createDataFrame([("m", "a.cbz", 2, "t", 1, [page(1), page(2)])], box))
    store.upsert("archive_cache", spark.createDataFrame([("m", "a.cbz", 3, "t", 1, [page(1), page(2), page(3)]), ("n", "a.cbz", 1, "t", 1, [page(5)])], box))
    assert [r["page_count"] for r in store.view("archive_cache", "m").collect()] == [3]
    for bad in (("m", "b.cbz", 2, "t", 1, [page(1)]), ("m", "b.cbz", 0, "t", 1, [])):
        with pytest.raises(Exception, match="page_count"):
            store.upsert("archive_cache", spark.createDataFrame([bad], box))
    before = sorted(map(str, store.view("archive_cache").collect()))
    maintenance.vacuum(store)
    assert len(store.commits()) == 1 and sorted(map(str, store.view("archive_cache").collect())) == before
    assert maintenance.optimize(store) is None
    planned = store.view("archive_cache")  # a reader that planned before the next vacuum
    maintenance.vacuum(store)
    assert sorted(map(str, planned.collect())) == before and len(store.commits()) == 1
    maintenance.vacuum(store)
    assert len(store.numbers()) == 2 and sorted(map(str, store.view("archive_cache").collect())) == before
    store.clear("m")
    assert [r["model_name"] for r in store.view("archive_cache").collect()] == ["n"]
    store.clear()
    assert store.view("archive_cache").count() == 0


def test_unfinished_commit_does_not_count(spark, store, monkeypatch):
    row = spark.createDataFrame([("m", "p", "t", 1, [1.0])], FILE)
    store.upsert("file_cache", row)
    monkeypatch.setattr(store, "_next", lambda: 1)  # as a second writer would
    with pytest.raises(Exception):
        store.upsert("file_cache", row.withColumn("file_size", F.lit(2).cast("long")))
    assert len(store.commits()) == 1


def test_prune(spark, store, tmp_path):
    (tmp_path / "pics").mkdir()
    (tmp_path / "pics" / "Photo.PNG").write_bytes(b"a")
    d = tmp_path / "pics"
    keys = [f"{d}/photo.png", f"{d}/gone.png", f"{tmp_path}/nodir/x.png", "Z:/off/y.png", "loose.png"]
    store.upsert("file_cache", spark.createDataFrame([("m", k, "t", 1, [1.0]) for k in keys], FILE))
    store.upsert("cover_cache", spark.createDataFrame([("m", f"{d}/gone.png", "t", 1, [1.0])], FILE.replace("file_path", "archive_path")))
    assert {r[0] for r in maintenance.prune_missing(store, "other").collect()} == set()
    missing = {r[0] for r in maintenance.prune_missing(store, offline_roots=["z:/"]).collect()}
    assert missing == {keys[1], keys[2]}
    assert {r["file_path"] for r in store.view("file_cache").collect()} == {keys[0], keys[3], keys[4]} and store.view("cover_cache").count() == 0


def test_migration(spark, store):
    v = lambda x: [float(x)] * 2
    rows = [("m", f"full.cbz|page={i}", "t", 1, v(i)) for i in (2, 0, 1)] + [("m", "full.cbz|page=7", "t", 1, v(7)), ("m", "look.cbz|page=5", "t", 1, v(5)), ("m", "cover.cbr", "t", 1, v(9)), ("m", "part.cbz|page=0", "t", 1, v(0)), ("m", "loose.jpg", "t", 1, v(3)), ("n", "loose.jpg", "t", 1, v(4))]
    store.upsert("file_cache", spark.createDataFrame(rows, FILE))
    marks = spark.createDataFrame([("m", "full.cbz", 3), ("m", "part.cbz", 2)], "model_name string, archive_path string, page_count int")
    assert not maintenance.migrate(store, None)
    assert maintenance.migrate(store, marks)
    a = store.view("archive_cache").collect()
    assert [(r["archive_path"], r["page_count"], [p[0] for p in r["pages"]]) for r in a] == [("full.cbz", 3, [0.0, 1.0, 2.0])]
    assert [r["archive_path"] for r in store.view("cover_cache").collect()] == ["cover.cbr"]
    assert sorted((r["model_name"], r["file_path"]) for r in store.view("file_cache").collect()) == [("m", "loose.jpg"), ("n", "loose.jpg")]
    assert not maintenance.migrate(store, marks)


def png(width, height):
    raw = b"".join(b"\0" + b"\x40\x80\xc0" * width for _ in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_sources(spark, tmp_path):
    (tmp_path / "cat").mkdir()
    for name in ("a.JPG", "b.png", "n.txt", "d.gif", "e.tif", "cat/c.tiff"):
        (tmp_path / name).write_bytes(b"a")
    (tmp_path / "cat" / "real.png").write_bytes(png(6, 4))
    names = lambda d: sorted(r["file_path"].rsplit("/", 1)[1] for r in d.collect())
    assert names(files.scan_images(spark, str(tmp_path))) == ["a.JPG", "b.png", "c.tiff", "real.png"]
    assert names(files.scan_images(spark, str(tmp_path), False)) == ["a.JPG", "b.png"]
    assert files.scan_images(spark, str(tmp_path / "none")).collect() == []
    assert {r["label"] for r in files.scan_labelled(spark, str(tmp_path)).collect()} == {"cat"}
    sizes = {r["file_path"].rsplit("/", 1)[1]: (r["width"], r["height"]) for r in files.image_sizes(spark, str(tmp_path)).collect()}
    assert sizes["real.png"] == (6, 4) and sizes["b.png"] == (0, 0)
    image = spark.read.format("image").load(str(tmp_path / "cat" / "real.png")).select("image.*").first()
    x = files.image_tensor(bytes(image["data"]), image["height"], image["width"], image["nChannels"], 2, (0, 0, 0), (1, 1, 1))
    assert x.shape == (3, 2, 2) and [round(float(c[0, 0]) * 255) for c in x] == [0x40, 0x80, 0xC0]
    assert "content" not in files.scan_images(spark, str(tmp_path)).columns
    tensors = {r["file_path"].rsplit("/", 1)[1]: r["tensor"] for r in files.image_tensors(spark, str(tmp_path), 2, (0, 0, 0), (1, 1, 1)).collect()}
    assert tensors["b.png"] is None and tensors["real.png"] == x.ravel().tolist()


def test_hidden_and_odd_names(spark, tmp_path):
    """Names with an underscore are files like others; names with a dot count for archives and classes only."""
    for name in ("_dir", ".secret", "deep/er/est", "_other"):
        (tmp_path / name).mkdir(parents=True)
    for name in ("a.jpg", "_b.jpg", ".c.jpg", "_dir/d.jpg", ".secret/e.jpg", "deep/er/est/f.jpg", "with space#1.jpg", "_x.cbz", ".y.cbz", "_dir/.z.cbr", "_other/g.png"):
        (tmp_path / name).write_bytes(b"a")
    below = lambda df: sorted(r["file_path"][len(str(tmp_path)) + 1 :] for r in df.collect())
    assert below(files.scan_images(spark, str(tmp_path))) == sorted(["a.jpg", "_b.jpg", "_dir/d.jpg", "deep/er/est/f.jpg", "with space#1.jpg", "_other/g.png"])
    assert below(files.scan_archives(spark, str(tmp_path) + "/")) == sorted(["_x.cbz", ".y.cbz", "_dir/.z.cbr"])
    assert below(files.scan_images(spark, f"file://{tmp_path}", False)) == sorted(["a.jpg", "_b.jpg", "with space#1.jpg"])
    assert {(r["file_path"].rsplit("/", 1)[1], r["label"]) for r in files.scan_labelled(spark, str(tmp_path)).collect()} == {("d.jpg", "_dir"), ("e.jpg", ".secret"), ("g.png", "_other")}
    read = files.with_contents(files.scan_images(spark, str(tmp_path)).union(spark.createDataFrame([(f"{tmp_path}/gone.jpg", "t", 1)], "file_path string, last_modified string, file_size long")), at_once=1)
    got = {r["file_path"].rsplit("/", 1)[1]: r["content"] for r in read.collect()}
    assert got["gone.jpg"] is None and bytes(got["d.jpg"]) == b"a" and len(got) == 7


def test_sizes_from_headers(tmp_path):
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"J" * 14 + b"\xff\xc2" + struct.pack(">HBHH", 17, 8, 300, 500) + b"x" * 20
    for head, want in (
        (png(6, 4), (6, 4)), (jpeg, (500, 300)), (b"GIF89a" + struct.pack("<HH", 7, 9), (7, 9)), (b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -8), (5, 8)),
        (b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (639).to_bytes(3, "little") + (479).to_bytes(3, "little"), (640, 480)),
        (b"", (0, 0)), (b"\x89PNG\r\n\x1a\n", (0, 0)), (b"\xff\xd8\xff", (0, 0)), (b"no image at all", (0, 0)),
    ):
        assert tuple(files.header_size(head)) == want


def comic(names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in names:
            z.writestr(n, b)
    return out.getvalue()


def test_containers(spark, tmp_path):
    rows = [("x/a.cbz", comic([("z/B.jpg", b"b"), ("a10.jpg", b"1"), ("A2.png", b"2"), ("n.txt", b"t"), ("e.jpg", b"")])), ("x/b.cbr", comic([("p.jpg", b"p")])), ("x/c.cbz", b"Rar!\x1a\x07\x01\x00...."), ("x/d.pdf", b"%PDF-1.4"), ("x/e.cbz", b"PK\x03\x04broken..")]
    df = spark.createDataFrame(rows, "file_path string, content binary")
    pages = containers.read_pages(df)
    assert [(r["archive_path"], r["page_index"], r["entry_name"]) for r in pages.orderBy("archive_path", "page_index").collect()] == [("x/a.cbz", 0, "a10.jpg"), ("x/a.cbz", 1, "A2.png"), ("x/a.cbz", 2, "z/B.jpg"), ("x/b.cbr", 0, "p.jpg")]
    notes = {r["path"] for r in containers.container_notes(containers.classify_containers(df)).collect()}
    assert notes == {"x/b.cbr", "x/c.cbz", "x/d.pdf"}
    failed = containers.container_failures(df.union(spark.createDataFrame([("x/f.cbz", None)], df.schema)))
    assert {r["path"] for r in failed.collect()} == {"x/e.cbz", "x/f.cbz"}
    assert containers.page_at(pages, "x/a.cbz", 9).count() == 0 and containers.page_counts(pages).count() == 2
    order = [["p02-000.jpg", "p02-005.jpg"], ["CCI08272016.jpg", "CCI08272016_0001.jpg"], ["img230.jpg", "zfurby2.jpg"], ["x-000-a.jpg", "x-000-b.jpg"]]
    for want in order:
        assert sorted(want[::-1], key=lambda n: containers.page_order(n, 0)) == want


def test_complete_archives(spark):
    rows = [("a", i, 3, [1.0]) for i in (0, 1, 1, 2, 7)] + [("b", 0, 2, [1.0]), ("c", 0, 1, [0.0])]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "archive_path string, page_index int, page_count int, embedding array<float>, last_modified string, file_size long")
    assert [(r["archive_path"], len(r["pages"])) for r in complete_archives(df).collect()] == [("a", 3)]


def test_image_search(spark, store, tmp_path):
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    for name, data in (("a.jpg", b"a"), ("b.png", b"b"), ("sub/c.tiff", b"c"), ("bad.jpg", b"?"), ("notes.txt", b"a")):
        (d / name).write_bytes(data)
    encoder = FakeEncoder(tmp_path / "log")
    s = ImageSearch(spark, store, encoder)
    names = lambda df: [(r["file_name"], round(r["similarity"], 6)) for r in df.collect()]
    assert names(s.by_text(str(d), "autumn")) == [("a.jpg", 1.0), ("b.png", 0.6), ("c.tiff", 0.0)]
    assert encoder.encoded() == 4
    assert names(s.by_vector(str(d), [1, 0, 0, 0], recursive=False)) == [("a.jpg", 1.0), ("b.png", 0.6)]
    assert encoder.encoded() == 1  # only what could not be decoded is tried again
    assert names(s.by_image(str(d), str(d / "a.jpg"))) == [("b.png", 0.6), ("c.tiff", 0.0)]
    assert s.by_vector(str(d), [1, 0]).collect() == [] and s.by_vector(str(d), []).collect() == []
    assert names(s.by_hash(str(d), s.image_hash(str(d / "a.jpg")))) == [("a.jpg", 1.0), ("b.png", 0.6), ("c.tiff", 0.0)]
    encoder.encoded()
    (d / "bad.jpg").unlink()
    (d / "b.png").write_bytes(b"bb")
    assert names(s.by_text(str(d), "x"))[1] == ("b.png", 0.6) and encoder.encoded() == 1
    with pytest.raises(ValueError):
        s.by_image(str(d), str(d / "missing.jpg"))
    # a fresh file is never opened, nor does any plan read contents by scanning
    kept = os.stat(d / "a.jpg")
    (d / "a.jpg").write_bytes(b"c")
    os.utime(d / "a.jpg", ns=(kept.st_atime_ns, kept.st_mtime_ns))
    assert names(s.by_text(str(d), "x"))[0] == ("a.jpg", 1.0) and encoder.encoded() == 0
    assert "binaryFile" not in s.vectors(str(d))._jdf.queryExecution().toString()
    merged = search_roots([s.by_text(str(d), "x"), s.by_text(str(d / "sub"), "x")], ["file_path"], 0.5)
    assert merged.count() == 2


def test_comic_search(spark, store, tmp_path):
    d = tmp_path / "comics"
    d.mkdir()
    (d / "one.cbz").write_bytes(comic([("1.jpg", b"b"), ("2.jpg", b"a"), ("3.jpg", b"c")]))
    (d / "two.cbz").write_bytes(comic([("1.jpg", b"a"), ("2.jpg", b"?")]))
    encoder = FakeEncoder(tmp_path / "log")
    s = ComicSearch(spark, store, encoder)
    hits = lambda df: [(r["archive_file_name"], r["page_index"], round(r["similarity"], 6), r["page_count"]) for r in df.collect()]
    assert hits(s.by_text(str(d), "x")) == [("two.cbz", 0, 1.0, 2), ("one.cbz", 0, 0.6, 3)]
    assert encoder.encoded() >= 2
    assert hits(s.by_text(str(d), "x")) == [("two.cbz", 0, 1.0, 0), ("one.cbz", 0, 0.6, 0)] and encoder.encoded() == 0
    assert hits(s.by_text(str(d), "x", all_pages=True)) == [("one.cbz", 1, 1.0, 3), ("two.cbz", 0, 1.0, 2), ("one.cbz", 0, 0.6, 3), ("one.cbz", 2, 0.0, 3)]
    assert [r["archive_path"].rsplit("/", 1)[1] for r in store.view("archive_cache").collect()] == ["one.cbz"]  # two.cbz lacks a page
    assert hits(s.by_archive_page(str(d), str(d / "one.cbz"), 1)) == [("two.cbz", 0, 1.0, 0)]
    assert s.page_hash(str(d / "one.cbz"), 9) is None and s.page_vector(str(d / "two.cbz"), 0) == [1.0, 0, 0, 0]
    assert hits(s.by_image(str(d), b"a"))[0][0] == "two.cbz" and s.by_vector(str(d), [1.0]).collect() == []


def test_analyses(spark):
    images = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0, 0.0])], "file_path string, embedding array<float>")

    class Words(HashingEncoder):
        def encode_text(self, text):
            return [1.0, 0, 0, 0] if text == "x" else [0, 1.0, 0, 0]

    got = analysis.tag_analysis(images, "x, y", Words(4), top_k=1)
    assert sorted((r["file_path"], r["tag"], r["is_selected"]) for r in got.collect()) == [("a", "x", True), ("b", "y", True)]
    pts = spark.createDataFrame([(i, [float(i // 3 * 10 + i % 3), 0.0]) for i in range(6)], "id long, features array<double>")
    _, members = analysis.cluster_analysis(pts, "id")
    assert sorted(r["members"] for r in members.collect()) == [[0, 1, 2], [3, 4, 5]]
    out = spark.createDataFrame([("p", [0.1, 0.9]), ("q", [])], "path string, output array<float>")
    r = analysis.classified(out, ["cat", "dog"]).collect()
    assert len(r) == 1 and r[0]["predicted_class"] == "dog" and round(r[0]["confidence"], 6) == 0.9 and set(r[0]["probabilities"]) == {"cat", "dog"}
    acc, metrics, _ = analysis.evaluate(spark.createDataFrame([("a", "a")], "true_label string, predicted string"), ["a"])
    assert acc.first()["accuracy"] == 1.0 and metrics.first()["f1"] == 1.0


class Counting:
    """A file that counts the bytes that are read from it."""

    def __init__(self, f, total):
        self.f, self.total = f, total

    def read(self, n=-1):
        data = self.f.read(n)
        self.total[0] += len(data)
        return data

    def __getattr__(self, name):
        return getattr(self.f, name)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()


def test_one_page_costs_the_directory_and_its_own_bytes(spark, tmp_path, monkeypatch):
    big = tmp_path / "big.cbz"
    body = {f"p{i:03d}.jpg": os.urandom(20_000) for i in range(200)}
    big.write_bytes(comic(list(body.items())))
    total = [0]
    monkeypatch.setattr(archives, "opened", lambda place: Counting(open(place, "rb"), total))
    (entries,) = archives._entries(iter([pd.DataFrame({"file_path": [str(big)]})]))
    assert len(entries) == 200 and total[0] < 30_000
    (page,) = archives._contents(iter([entries[entries["page_index"] == 5]]))
    assert page["content"].tolist() == [body["p005.jpg"]] and total[0] < 60_000 < 4_000_000 < big.stat().st_size


def test_archives_by_ranges(spark, tmp_path):
    good = comic([("z/B.jpg", b"b" * 100), ("a10.jpg", b"1"), ("A2.png", b"2"), ("n.txt", b"t"), ("e.jpg", b"")])
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("d.jpg", b"d" * 1000, zipfile.ZIP_DEFLATED)
        z.writestr("e.jpg", b"e" * 1000, zipfile.ZIP_BZIP2)
    bad = bytearray(good)
    bad[bad.index(b"b" * 100)] = 0
    rows = {"a.cbz": good, "b.cbr": good, "c.cbz": b"Rar!\x1a\x07\x01\x00....", "d.pdf": b"%PDF-1.4", "e.cbz": b"PK\x03\x04broken..", "f.cbz": packed.getvalue(), "g.cbz": bytes(bad)}
    for name, data in rows.items():
        (tmp_path / name).write_bytes(data)
    files_ = spark.createDataFrame([(str(tmp_path / n),) for n in [*rows, "gone.cbz"]], "file_path string")
    pages, notes = archives.read_archives(files_)
    got = {(os.path.basename(r["archive_path"]), r["page_index"]): (r["entry_name"], r["page_count"], None if r["content"] is None else bytes(r["content"])) for r in pages.collect()}
    assert got[("a.cbz", 0)] == ("a10.jpg", 3, b"1") and got[("a.cbz", 2)] == ("z/B.jpg", 3, b"b" * 100) and len(got) == 11
    assert got[("f.cbz", 0)][2] == b"d" * 1000 and got[("f.cbz", 1)][2] == b"e" * 1000
    assert got[("g.cbz", 2)][2] is None and got[("g.cbz", 1)][2] == b"2"  # one page is damaged, the others aren't
    assert {os.path.basename(r["path"]) for r in notes.collect()} == {"b.cbr", "c.cbz", "d.pdf", "e.cbz", "gone.cbz"}
    whole = containers.read_pages(files.with_contents(files_.where("file_path like '%a.cbz'")))
    some, _ = archives.read_archives(files_.where("file_path like '%a.cbz'"), "page_index >= 1")
    assert sorted(map(str, some.collect())) == sorted(map(str, whole.where("page_index >= 1").collect()))


def test_a_search_that_stops_midway_has_saved_its_waves(spark, store, tmp_path):
    d = tmp_path / "comics"
    d.mkdir()
    for i in range(12):
        (d / f"{i:02d}.cbz").write_bytes(comic([("1.jpg", b"a"), ("2.jpg", b"!" if i == 7 else b"b")]))

    class Stops(FakeEncoder):
        def encode_images(self, contents):
            if any(c[:1] == b"!" for c in contents) and not os.path.exists(self.log + ".go"):
                raise RuntimeError("stopped")
            return super().encode_images(contents)

    encoder = Stops(tmp_path / "log")
    s = ComicSearch(spark, store, encoder, at_once=2)
    with pytest.raises(Exception, match="stopped"):
        s.pages(str(d))
    saved = {os.path.basename(r["archive_path"]) for r in store.view("archive_cache").collect()}
    open(encoder.log + ".go", "w").close()
    encoder.encoded()
    rows = s.pages(str(d)).collect()
    assert len(rows) == 23 and {r["status"] for r in rows if os.path.basename(r["archive_path"]) in saved} <= {"hit"}
    assert encoder.encoded() == 2 * (12 - len(saved)) and len(saved) < 12
    assert store.view("archive_cache").count() == 11


def test_notes_and_counters_of_searches(spark, store, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for name, data in (("a.jpg", b"a"), ("b.png", b"b"), ("bad.jpg", b"?")):
        (d / name).write_bytes(data)
    (d / "one.cbz").write_bytes(comic([("1.jpg", b"b"), ("2.jpg", b"a")]))
    (d / "two.cbr").write_bytes(b"Rar!\x1a\x07\x01\x00....")
    s = ImageSearch(spark, store, FakeEncoder(tmp_path / "log"))
    s.by_text(str(d), "x").collect()
    assert s.counters.get == {"files": 3, "hit": 0, "stale": 0, "miss": 3, "failures": 1}
    s.by_text(str(d), "x").collect()
    assert s.counters.get == {"files": 3, "hit": 2, "stale": 0, "miss": 1, "failures": 1}
    assert [(r["scope"], os.path.basename(r["path"])) for r in s.notes.collect()] == [("encode", "bad.jpg")]
    c = ComicSearch(spark, store, FakeEncoder(tmp_path / "log"))
    c.by_text(str(d), "x", all_pages=True).collect()
    assert c.counters.get == {"pages": 2, "hit": 0, "stale": 0, "miss": 2, "inconsistent": 0}
    assert [os.path.basename(r["path"]) for r in c.notes.collect()] == ["two.cbr"]
    c.by_text(str(d), "x", all_pages=True).collect()
    assert c.counters.get["hit"] == 2
    gone = ComicSearch(spark, store, FakeEncoder(tmp_path / "log"))
    assert gone.by_text(str(tmp_path / "nowhere"), "x").collect() == [] and [r["scope"] for r in gone.notes.collect()] == ["scan"]


def test_two_phases_read_vectors_of_hits_only(spark, store):
    row = lambda i, m="t", s=1: ("m", f"p{i}", m, s, [float(i), 1.0])
    probe = spark.createDataFrame([(f"p{i}", "t", 1) for i in (*range(0, 30, 2), 0, 77)] + [("p4", "t", 9)], "file_path string, last_modified string, file_size long")
    late = lambda: sorted(map(str, probe_stored(store, probe, "m").select("file_path", "last_modified", "file_size", "status", "embedding").collect()))
    plain = lambda: sorted(map(str, probe_status(probe, store.view("file_cache", "m")).select("file_path", "last_modified", "file_size", "status", "embedding").collect()))
    assert late() == plain()
    store.upsert("file_cache", spark.createDataFrame([row(i) for i in range(20)], FILE))
    assert late() == plain()
    store.upsert("file_cache", spark.createDataFrame([row(2, "old"), row(4, s=9), ("n", "p6", "t", 5, [1.0])], FILE))
    store.delete({"file_cache": spark.createDataFrame([("m", "p8")], "model_name string, file_path string")})
    assert late() == plain() and "status='stale'" in str(late())
    maintenance.vacuum(store)
    assert late() == plain()
    plan = store.positions("file_cache", "m")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "embedding" not in plan
    plan = store.fetch("file_cache", spark.createDataFrame([("f", 1)], "_file string, _row long"), "embedding")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan  # vectors stay where they are read


def test_entities_like_the_library(spark):
    import html

    from embera.functions.entities import unescape, unescaped
    from embera.functions.tokenizer import unescape_html

    texts = ["", "no &", "&amp;amp; &lt;b&gt;", "&notit; &notin; &not &ampx &unknown; &amp", "&#65;&#x41;&#X1F600;&#0;&#128;&#159;&#55296;&#1114112;&#99999999999999;&#xFFFFFFFFFF;", "&#13;a&#11;b&#xFDD0;c&#x1FFFF;", "&CounterClockwiseContourIntegral; &NotEqualTilde;", "&&amp;;&;&#;&#x;&#xg;", "A &nbsp; B\x1c\u2003c \u3000", "&copy2024 &COPY;&Copy;", "&#00065; &#x00000041 &ThickSpace;x", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", unescape(F.col("t")).alias("once"), unescaped(F.col("t")).alias("twice")).collect()
    for r in rows:
        t = texts[r["i"]]
        assert r["once"] == (None if t is None else html.unescape(t)), t
        assert r["twice"] == unescape_html(t), t
    assert "Python" not in df.select(unescaped(F.col("t")))._jdf.queryExecution().toString()


def test_small_commits_are_merged_without_the_base(spark, store):
    row = lambda i, s=1: ("m", f"p{i}", "t", s, [float(i)] * 64)
    store.upsert("file_cache", spark.createDataFrame([row(i) for i in range(3000)], FILE))
    for n in range(4):
        store.upsert("file_cache", spark.createDataFrame([row(n, 2), row(100 + n, 2), row(9000 + n)], FILE))
    store.delete({"file_cache": spark.createDataFrame([("m", "p1"), ("m", "p9000")], "model_name string, file_path string")})
    store.upsert("cover_cache", spark.createDataFrame([("m", "a.cbz", "t", 1, [1.0])], FILE.replace("file_path", "archive_path")))
    before = {t: sorted(map(str, store.view(t).collect())) for t in ("file_cache", "cover_cache")}
    maintenance.vacuum(store)
    for n in range(3):
        store.upsert("file_cache", spark.createDataFrame([row(n + 50, 3)], FILE))
    store.delete({"file_cache": spark.createDataFrame([("m", "p51")], "model_name string, file_path string")})
    want = sorted(map(str, store.view("file_cache").collect()))
    base = store.commits()[0][0]
    planned = store.view("file_cache")
    assert maintenance.optimize(store, most=3) is not None and maintenance.optimize(store, most=3) is None
    assert [n for n, _ in store.commits()][0] == base and len(store.commits()) == 2
    assert sorted(map(str, store.view("file_cache").collect())) == want == sorted(map(str, planned.collect()))
    assert sorted(map(str, store.view("cover_cache").collect())) == before["cover_cache"]
    store.upsert("file_cache", spark.createDataFrame([row(51, 4)], FILE))
    assert store.view("file_cache").where("file_path = 'p51'").count() == 1
    maintenance.vacuum(store)
    assert len(store.view("file_cache").collect()) == len(want) + 1


def test_tensors_of_pages_and_odd_names(spark, tmp_path):
    image = png(6, 4)
    (tmp_path / "_x.png").write_bytes(image)
    (tmp_path / "bad.jpg").write_bytes(b"no image")
    (tmp_path / "a.cbz").write_bytes(comic([("1.png", image), ("2.png", png(3, 3)), ("3.jpg", b"?")]))
    how = (2, (0, 0, 0), (1, 1, 1))
    by_file = {os.path.basename(r["file_path"]): r["tensor"] for r in files.image_tensors(spark, str(tmp_path), *how).collect()}
    assert set(by_file) == {"_x.png", "bad.jpg"} and by_file["bad.jpg"] is None and len(by_file["_x.png"]) == 12
    pages, _ = archives.read_archives(spark.createDataFrame([(str(tmp_path / "a.cbz"),)], "file_path string"))
    made = {r["page_index"]: r["tensor"] for r in files.with_tensors(pages, *how).collect()}
    assert made[0] == by_file["_x.png"] and made[1] is not None and made[2] is None
    assert files.image_tensors(spark, str(tmp_path / "none"), *how).collect() == []
