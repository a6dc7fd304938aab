"""Directories listed on the executors: by rounds over a frontier, and with a state of three values.

A path is there, gone or unknown. Only a directory that could be listed tells that a name
in it is gone, and a missing directory is gone only if its root is connected; whatever can't
be looked at (a drive that isn't plugged in, a file system that isn't known here, missing
rights) is unknown, and nothing may be concluded from it.

Names needn't be text: a byte that isn't UTF-8 stands in paths as a character of the private
range from U+EF80 on, and is turned back when the file is opened.
"""

from __future__ import annotations

import os
import re
import stat
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import directory, file_name
from ..session import checkpointed

THERE, GONE, UNKNOWN = "there", "gone", "unknown"
#: Directories that a task lists below one row of the frontier, before it hands the rest over.
AT_ONCE = 64
#: Folders whose entries are places where volumes are mounted; fixed values.
MOUNTS = ("/mnt", "/media", "/Volumes", "/run/media")
_OCTETS = {0xDC80 + i: 0xEF80 + i for i in range(128)}
_BACK = {v: k for k, v in _OCTETS.items()}
_RAW = re.compile("[\uef80-\uefff]")


def absolute(place: str) -> str:
    """A directory as it is known on the driver: without file:, absolute, without separators at its end."""
    place = re.sub(r"^file:(//)?(?=/)", "", place)
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|\\\\|/", place):
        place = os.path.abspath(place)
    return place.rstrip("/") or "/"


def is_local(place: str) -> bool:
    """Whether a path belongs to this machine's file system."""
    return place.startswith("/") or (os.name == "nt" and bool(re.match(r"[A-Za-z]:[\\/]|\\\\", place)))


def to_system(place: str) -> bytes:
    """The bytes by which the system knows a local path."""
    plain = os.fsencode(place)
    if _RAW.search(place) and not os.path.lexists(plain):
        return os.fsencode(place.translate(_BACK))
    return plain


def from_system(name: bytes) -> str:
    return os.fsdecode(name).translate(_OCTETS)


def opened(place: str):
    """A file of any known file system, opened for reading."""
    if is_local(place):
        return open(to_system(place), "rb")
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]+://", place):
        raise OSError(f"{place} isn't on a file system that is known here")
    system, path = fs.FileSystem.from_uri(place)
    return system.open_input_file(path)


def root_of(place: str) -> str:
    """What has to be connected for a path to be looked at; empty if there is no telling.

    Of a local path it is the volume where one is mounted, else the first folder; of others
    the drive, share, or scheme and host.
    """
    for mount in MOUNTS:
        if place.startswith(mount + "/"):
            return "/".join(place.split("/")[: mount.count("/") + (3 if mount == "/run/media" else 2)])
    if place.startswith("/"):
        return "/".join(place.split("/")[:2])
    found = re.match(r"[A-Za-z][A-Za-z0-9+.-]+://[^/]*|[A-Za-z]:[\\/]?|\\\\[^\\/]+[\\/][^\\/]+", place)
    return found[0] if found else ""


def is_connected(root: str) -> bool:
    """Whether a root is there. A mount point without entries counts as not connected."""
    try:
        if is_local(root):
            with os.scandir(to_system(root)) as entries:
                return not root.startswith(MOUNTS) or any(True for _ in entries)
        if not re.match(r"[A-Za-z][A-Za-z0-9+.-]+://", root):
            return False
        system, path = fs.FileSystem.from_uri(root)
        return system.get_file_info(path).type == fs.FileType.Directory
    except PermissionError:
        return True
    except (OSError, ValueError, NotImplementedError):
        return False


def entries_of(place: str) -> list[tuple[str, bool, int | None, int]]:
    """(path, folder, modified in ms, size) of a directory's entries, or of the one file; raises what keeps it from being read.

    Links to folders aren't followed; an entry that can't be looked at has no time and size 0.
    """
    if is_local(place):
        raw = to_system(place)
        info = os.stat(raw)
        if not stat.S_ISDIR(info.st_mode):
            return [(place, False, info.st_mtime_ns // 1_000_000, info.st_size)]
        out: list[tuple[str, bool, int | None, int]] = []
        with os.scandir(raw) as entries:
            for e in entries:
                path = f"{place.rstrip('/')}/{from_system(e.name)}"
                try:
                    if e.is_dir(follow_symlinks=False):
                        out.append((path, True, None, 0))
                        continue
                    info = e.stat()
                    if stat.S_ISREG(info.st_mode):
                        out.append((path, False, info.st_mtime_ns // 1_000_000, info.st_size))
                except OSError:
                    out.append((path, False, None, 0))
        return out
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]+://", place):
        raise OSError("the file system isn't known here")
    system, path = fs.FileSystem.from_uri(place)
    before = place.removesuffix(path)
    known = system.get_file_info(path)
    if known.type == fs.FileType.NotFound:
        raise FileNotFoundError(place)
    found = [known] if known.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path))
    return [(before + f.path, f.type == fs.FileType.Directory, (f.mtime_ns or 0) // 1_000_000, f.size or 0) for f in found]


_FOUND = "file_path string, kind string, ms long, file_size long, message string"


def _frame(rows: list[tuple], names: tuple[str, ...]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype="Int64" if c in ("ms", "file_size") else object) for i, c in enumerate(names)})


def _walked(hidden: bool, deep: bool):
    """Files below directories, notes on what can't be read, and folders that are left for the next round."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in pdf["file_path"]:
                due, rows, done = deque([start]), [], 0
                while due and done < AT_ONCE:
                    place, done = due.popleft(), done + 1
                    try:
                        for path, folder, ms, size in entries_of(place):
                            if path != place and not hidden and path.rsplit("/", 1)[-1].startswith("."):
                                continue
                            if not folder:
                                rows.append((path, "file", ms, size, None))
                            elif deep:
                                due.append(path)
                    except (OSError, ValueError, NotImplementedError) as e:  # this directory alone is lost
                        rows.append((place, "note", None, None, str(e)))
                    if len(rows) > 10_000:
                        yield _frame(rows, ("file_path", "kind", "ms", "file_size", "message"))
                        rows = []
                rows += [(path, "folder", None, None, None) for path in due]
                yield _frame(rows, ("file_path", "kind", "ms", "file_size", "message"))

    return run


def walk(spark: SparkSession, place: str, recursive: bool = True, hidden: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files, notes): (file_path, ms, file_size), and (scope, path, message) of directories that can't be read.

    Folders that are found and not yet listed are dealt out anew in each round, so a wide or
    deep tree below one folder takes all tasks. A tree of few folders takes one round.
    """
    tasks = 8 * spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([(absolute(place),)], "file_path string")
    rounds = []
    while True:
        found = checkpointed(frontier.mapInPandas(_walked(hidden, recursive), _FOUND))
        rounds.append(found)
        rest = found.where("kind = 'folder'").select("file_path")
        if rest.isEmpty():
            break
        frontier = rest.repartition(tasks, "file_path")
    every = rounds[0]
    for more in rounds[1:]:
        every = every.unionByName(more)
    files = every.where("kind = 'file'").select("file_path", "ms", "file_size")
    return files, every.where("kind = 'note'").select(F.lit("scan").alias("scope"), F.col("file_path").alias("path"), "message")


def state_of(place: str, folder: bool = False) -> str:
    """Whether one file (or folder) is there, gone or unknown."""
    root = root_of(place)
    try:
        if is_local(place):
            os.stat(to_system(place))
            return THERE
        if not re.match(r"[A-Za-z][A-Za-z0-9+.-]+://", place):
            return UNKNOWN
        system, path = fs.FileSystem.from_uri(place)
        if system.get_file_info(path).type != fs.FileType.NotFound:
            return THERE
    except (FileNotFoundError, NotADirectoryError):
        pass
    except (OSError, ValueError, NotImplementedError):
        return UNKNOWN
    return GONE if root and is_connected(root) else UNKNOWN


def _states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(d, state, n): a row for each directory, and one for each file in it with its name in lower case.

    The root of a directory that seems to be gone, or has names, is looked at after it.
    """
    for pdf in batches:
        for d in pdf["d"]:
            rows: list[tuple] = []
            state = UNKNOWN
            root = root_of(f"{d}/")
            try:
                names = [path.replace("\\", "/").rsplit("/", 1)[-1].lower() for path, folder, _, _ in entries_of(d or "/") if not folder]
                state = THERE
                rows = [(d, THERE, n) for n in names]
            except (FileNotFoundError, NotADirectoryError):
                state = GONE
            except (OSError, ValueError, NotImplementedError):
                pass
            if state != UNKNOWN and not (root and is_connected(root)):
                state = UNKNOWN
            yield _frame([*rows, (d, state, None)], ("d", "state", "n"))


def _looked_at(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(state=[state_of(p) for p in pdf["base_path"]])


def file_states(keys: DataFrame) -> DataFrame:
    """(base_path, state) of distinct paths: there, gone or unknown; names count in either case.

    Each directory is listed once. Files of a directory that can't be listed are looked at
    one by one. Paths without a root are unknown.
    """
    named = keys.select("base_path").distinct().withColumn("d", directory(F.col("base_path"))).withColumn("n", F.lower(file_name(F.col("base_path"))))
    rooted = F.col("base_path").rlike(r"^(/|\\\\|[A-Za-z]:[\\/]|[A-Za-z][A-Za-z0-9+.-]+://)")
    tasks = 8 * keys.sparkSession.sparkContext.defaultParallelism
    found = checkpointed(named.where(rooted).select("d").distinct().repartition(tasks, "d").mapInPandas(_states, "d string, state string, n string"))
    folders = found.where("n is null").select("d", F.col("state").alias("folder"))
    names = found.where("n is not null").select("d", "n", F.lit(True).alias("named")).distinct()
    placed = named.join(folders, "d", "left").join(names, ["d", "n"], "left")
    state = F.when(~rooted, UNKNOWN).when(F.col("named"), THERE).when(F.col("folder") == UNKNOWN, None).otherwise(GONE)
    judged = checkpointed(placed.select("base_path", state.alias("state")))
    single = judged.where("state is null").select("base_path", F.lit("").alias("state"))
    return judged.where("state is not null").unionByName(single.mapInPandas(_looked_at, "base_path string, state string"))


def connected_roots(paths: DataFrame) -> DataFrame:
    """``paths`` (base_path) whose root is connected now; each root is looked at once."""
    of = F.pandas_udf(lambda s: s.map(root_of), "string")
    up = F.pandas_udf(lambda s: s.map(is_connected), "boolean")
    rooted = paths.withColumn("root", of("base_path"))
    roots = rooted.select("root").distinct().withColumn("up", up("root")).where("up").select("root")
    return rooted.join(roots, "root", "left_semi").select("base_path")
