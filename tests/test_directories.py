import os

import pandas as pd
import pytest

from embera.plans import maintenance
from embera.plans.store import CacheStore
from embera.sources import directories as D
from embera.sources import files

FILE = "model_name string, file_path string, last_modified string, file_size long, embedding array<float>"


def paths(df):
    return sorted(r["file_path"] for r in df.collect())


def test_a_wide_and_deep_tree_takes_rounds(spark, tmp_path, monkeypatch):
    want = []
    for i in range(150):
        (tmp_path / "one" / f"d{i}" / "x").mkdir(parents=True)
        (tmp_path / "one" / f"d{i}" / "x" / "p.jpg").write_bytes(b"a")
        want.append(f"{tmp_path}/one/d{i}/x/p.jpg")
    deep = tmp_path / "/".join(["deep"] * 80)
    deep.mkdir(parents=True)
    (deep / "q.png").write_bytes(b"a")
    # a task hands over what is left after AT_ONCE directories
    (handed,) = D._walked(False, True)(iter([pd.DataFrame({"file_path": [str(tmp_path)]})]))
    assert (handed["kind"] == "folder").sum() > 100
    assert paths(files.scan_images(spark, str(tmp_path))) == sorted([*want, str(deep / "q.png")])


def test_what_cannot_be_read_is_lost_alone(tmp_path, monkeypatch):
    for name in ("a", "b", "c"):
        (tmp_path / name / "in").mkdir(parents=True)
        (tmp_path / name / "in" / "p.jpg").write_bytes(b"x")
    real = os.scandir

    def scandir(place):
        if os.fsdecode(place).endswith("/b/in"):
            raise PermissionError("not allowed")
        return real(place)

    monkeypatch.setattr(os, "scandir", scandir)
    found = pd.concat(D._walked(False, True)(iter([pd.DataFrame({"file_path": [str(tmp_path)]})])))
    assert sorted(found[found["kind"] == "file"]["file_path"]) == [f"{tmp_path}/{n}/in/p.jpg" for n in "ac"]
    assert found[found["kind"] == "note"][["file_path", "message"]].values.tolist() == [[f"{tmp_path}/b/in", "not allowed"]]
    # its files are looked at one by one, so nothing is gone that only can't be listed
    states = pd.concat(D._states(iter([pd.DataFrame({"d": [f"{tmp_path}/b/in", f"{tmp_path}/a/in", f"{tmp_path}/no"]})])))
    assert {d: s for d, s, n in states[["d", "state", "n"]].values.tolist() if n is None} == {f"{tmp_path}/b/in": D.UNKNOWN, f"{tmp_path}/a/in": D.THERE, f"{tmp_path}/no": D.GONE}
    assert D.state_of(f"{tmp_path}/b/in/p.jpg") == D.THERE and D.state_of(f"{tmp_path}/b/in/q.jpg") == D.GONE


def test_relative_directories_odd_names_and_notes(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "pics").mkdir()
    (tmp_path / "pics" / "a.jpg").write_bytes(b"a")
    odd = os.fsencode(tmp_path / "pics") + b"/o\xffdd.jpg"
    with open(odd, "wb") as f:
        f.write(b"odd")
    found = files.scan_images(spark, "pics")
    assert paths(found) == sorted([f"{tmp_path}/pics/a.jpg", f"{tmp_path}/pics/o\uefffdd.jpg"])
    assert {bytes(r["content"]) for r in files.with_contents(found).collect()} == {b"a", b"odd"}
    assert files.image_sizes(spark, "pics").count() == 2
    some, notes = files.listing_with_notes(spark, "none", ("jpg",))
    assert some.collect() == [] and [r["path"] for r in notes.collect()] == [f"{tmp_path}/none"]
    some, notes = files.listing_with_notes(spark, "Q:\\pics", ("jpg",))
    assert some.collect() == [] and notes.count() == 1
    broken = tmp_path / "pics" / "link.jpg"
    broken.symlink_to(tmp_path / "nothing")
    assert [(r["last_modified"], r["file_size"]) for r in files.scan_images(spark, "pics").where("file_path like '%link.jpg'").collect()] == [("0001-01-01T00:00:00.000Z", 0)]
    (tmp_path / "pics" / "loop").symlink_to(tmp_path / "pics")
    assert files.scan_images(spark, "pics").count() == 3


@pytest.mark.parametrize("place,root", [("/mnt/usb/a/b", "/mnt/usb"), ("/run/media/me/disk/x", "/run/media/me/disk"), ("/data/x.jpg", "/data"), ("J:\\pics\\b.jpg", "J:\\"), ("\\\\srv\\share\\x", "\\\\srv\\share"), ("s3://bucket/x/a.jpg", "s3://bucket"), ("loose.jpg", "")])
def test_roots(place, root):
    assert D.root_of(place) == root


def test_an_empty_mount_point_is_not_connected(tmp_path, monkeypatch):
    monkeypatch.setattr(D, "MOUNTS", (str(tmp_path),))
    (tmp_path / "usb").mkdir()
    assert not D.is_connected(D.root_of(f"{tmp_path}/usb/pics/a.jpg"))
    assert D.state_of(f"{tmp_path}/usb/pics/a.jpg") == D.UNKNOWN
    (tmp_path / "usb" / "other").mkdir()
    assert D.is_connected(f"{tmp_path}/usb") and D.state_of(f"{tmp_path}/usb/pics/a.jpg") == D.GONE


def test_prune_keeps_what_it_cannot_look_at(spark, tmp_path):
    store = CacheStore(spark, str(tmp_path / "store"))
    (tmp_path / "pics").mkdir()
    (tmp_path / "pics" / "Here.JPG").write_bytes(b"a")
    kept = [f"{tmp_path}/pics/here.jpg", "s3a://bucket/x/a.jpg", "J:\\pics\\b.jpg", "/no/such/c.jpg", f"{tmp_path}/{'x' * 300}/d.jpg", "loose.png", "\\\\srv\\share\\e.png"]
    gone = [f"{tmp_path}/pics/gone.jpg", f"{tmp_path}/nodir/deep/f.jpg", f"{tmp_path}/pics/Here.JPG/g.jpg"]
    store.upsert("file_cache", spark.createDataFrame([("m", k, "t", 1, [1.0]) for k in kept + gone], FILE))
    states = {r["base_path"]: r["state"] for r in D.file_states(maintenance.all_keys(store)).collect()}
    assert states == {kept[0]: D.THERE} | dict.fromkeys(kept[1:], D.UNKNOWN) | dict.fromkeys(gone, D.GONE)
    assert {r["base_path"] for r in maintenance.prune_missing(store).collect()} == set(gone)
    assert sorted(r["file_path"] for r in store.view("file_cache").collect()) == sorted(kept)
    # a root that goes between the listing and the deletion
    away = spark.createDataFrame([("/nowhere-now/x.jpg",), (gone[0],)], "base_path string")
    assert [r["base_path"] for r in D.connected_roots(away).collect()] == [gone[0]]
