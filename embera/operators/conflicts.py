"""Timestamp conflicts: files of different classes created close together."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed

#: Rows after which a slice of time ends with the window in which it is, slices whose maps one task composes, and slices whose entries are broadcast at most.
SLICE_ROWS, TOGETHER, FEW = 50_000, 64, 200_000
#: Windows of time that are counted together before single ones.
_BLOCK = 4096


class _Walk:
    """The greedy walk over rows (id, path, class, us) in order of time.

    It holds the rows less than a window after the anchor, the first row held. When the
    next row is further away, the group is complete: two classes or more are a conflict
    and leave together, else the anchor alone leaves.
    """

    def __init__(self, window_us: int):
        self.window, self.held, self.classes, self.out = window_us, deque(), Counter(), []

    def _settle(self) -> None:
        if len(self.classes) > 1:
            rows = list(self.held)
            self.out.append((rows[0][0], [r[0] for r in rows], [r[1] for r in rows], list(dict.fromkeys(r[2] for r in rows)), rows[0][3], rows[-1][3]))
            self.held.clear()
            self.classes.clear()
        else:
            first = self.held.popleft()[2]
            self.classes[first] -= 1
            if not self.classes[first]:
                del self.classes[first]

    def add(self, row: tuple) -> None:
        while self.held and row[3] - self.held[0][3] >= self.window:
            self._settle()
        self.held.append(row)
        self.classes[row[2]] += 1

    def end(self) -> None:
        while self.held:
            self._settle()

    def found(self) -> pd.DataFrame:
        rows, self.out = self.out, []
        return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=kind) for i, (c, kind) in enumerate(_COLUMNS)})


_COLUMNS = (("first_id", "int64"), ("ids", object), ("file_paths", object), ("classes", object), ("window_start", "int64"), ("window_end", "int64"))


def greedy(rows: list[tuple], window_us: int) -> pd.DataFrame:
    """Conflicts of one island's rows (id, path, class, us)."""
    walk = _Walk(window_us)
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        walk.add(r)
    walk.end()
    return walk.found()


class _Slice:
    """Rows of one slice of time in order, and those of the next slice less than a window after its end.

    For every row as an anchor it is known, without walking, whether its window holds two
    classes and where the next anchor stands: behind the window then, else at the next row.
    """

    def __init__(self, rows: pd.DataFrame, end: int, window_us: int):
        self.rows = rows = rows.sort_values(["us", "id"], kind="stable", ignore_index=True)
        us = rows["us"].to_numpy()
        self.own = int(np.searchsorted(us, end))
        self.behind = np.searchsorted(us, us + window_us)
        kind = pd.factorize(rows["class"])[0]
        changes = np.append(np.flatnonzero(kind[1:] != kind[:-1]) + 1, len(us) + 1)
        other = changes[np.searchsorted(changes, np.arange(len(us)), side="right")]
        self.anchors = np.flatnonzero((other < self.behind)[: self.own])  # rows whose window is a conflict

    def walk(self, entry: int) -> Iterator[int]:
        """Conflict anchors from the own row ``entry`` on, then minus the place in the next slice where the walk goes on, less one."""
        at = entry
        while at < self.own:
            k = int(np.searchsorted(self.anchors, at))
            if k == len(self.anchors):
                at = self.own
                break
            yield int(self.anchors[k])
            at = int(self.behind[self.anchors[k]])
        yield -1 - (at - self.own)

    def exits(self, most: int) -> list[int]:
        """Where the walk goes on in the next slice, for each place 0..``most`` at which it may enter this one."""
        known: dict[int, int] = {}
        out = []
        for entry in range(most + 1):
            seen, end = [], 0
            for at in self.walk(entry):
                if at in known:
                    end = known[at]
                    break
                if at < 0:
                    end = -1 - at
                else:
                    seen.append(at)
            known.update(dict.fromkeys(seen, end))
            out.append(end)
        return out


def _sliced(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """Whole slices from batches that are sorted by slice."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        for n, part in pdf.groupby("slice", sort=False):
            if held and held[-1]["slice"].iloc[0] != n:
                yield int(held[0]["slice"].iloc[0]), pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield int(held[0]["slice"].iloc[0]), pd.concat(held)


def _maps(window_us: int, starts: np.ndarray):
    """(slice, exits): one exit if the place of entry doesn't matter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for n, rows in _sliced(batches):
            s = _Slice(rows, int(starts[n + 1]), window_us)
            near = int(np.searchsorted(s.rows["us"].to_numpy()[: s.own], starts[n] + window_us))
            exits = s.exits(near)
            yield pd.DataFrame({"slice": [n], "exits": [exits[:1] if len(set(exits)) == 1 else exits]})

    return run


def _through(exits: np.ndarray, entry):
    """Where a map leads from an entry, or from many."""
    return exits[entry] if len(exits) > 1 else (np.full(len(entry), exits[0]) if isinstance(entry, np.ndarray) else exits[0])


def _composed(key: tuple, maps: pd.DataFrame) -> pd.DataFrame:
    """The map of several slices in a row, from the first one's entries to the last one's exits."""
    both = None
    for exits in maps.sort_values("slice")["exits"]:
        both = np.asarray(exits) if both is None else _through(np.asarray(exits), both)
        if len(both) > 1 and (both == both[0]).all():
            both = both[:1]
    return pd.DataFrame({"slice": [key[0]], "exits": [both.tolist()]})


def _entered(key: tuple, maps: pd.DataFrame) -> pd.DataFrame:
    """(slice, entry) of slices in a row, of which the first one's entry is known."""
    maps = maps.sort_values("slice")
    place, entries = int(maps["entry"].iloc[0]), []
    for exits in maps["exits"]:
        entries.append(place)
        place = int(_through(np.asarray(exits), place))
    return pd.DataFrame({"slice": maps["slice"], "entry": entries})


def _entries(maps: DataFrame, count: int) -> DataFrame:
    """(slice, entry): maps are composed in groups, these again, and entries are handed down the same way."""
    together = F.floor(F.col("slice") / TOGETHER).alias("group")
    if count <= TOGETHER:
        return maps.withColumn("entry", F.lit(0)).groupBy(together).applyInPandas(_entered, "slice long, entry long")
    groups = checkpointed(maps.groupBy(together).applyInPandas(_composed, "slice long, exits array<long>"))
    above = _entries(groups, -(-count // TOGETHER)).withColumnRenamed("slice", "group")
    return maps.withColumn("group", together).join(above, "group").groupBy("group").applyInPandas(_entered, "slice long, entry long")


def _found(window_us: int, starts: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for n, rows in _sliced(batches):
            s = _Slice(rows, int(starts[n + 1]), window_us)
            out = []
            for at in s.walk(int(rows["entry"].max())):
                if at >= 0:
                    group = s.rows.iloc[at : s.behind[at]]
                    us = group["us"].tolist()
                    out.append((int(group["id"].iloc[0]), group["id"].tolist(), group["path"].tolist(), list(dict.fromkeys(group["class"].tolist())), us[0], us[-1]))
            yield pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=kind) for i, (c, kind) in enumerate(_COLUMNS)})

    return run


def _starts(rows: DataFrame, window_us: int) -> np.ndarray:
    """Where slices begin, and after the last one the end of time.

    Windows are counted, blocks of them first; a slice ends with the window in which its
    SLICE_ROWS are full. A number for each slice comes to the driver.
    """
    cells = rows.groupBy(F.floor(F.col("us") / F.lit(window_us)).alias("cell")).agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("cell") / _BLOCK))
    sums = cells.groupBy("block").agg(F.sum("n").alias("b"))
    before = lambda of, w: F.coalesce(F.sum(of).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sums.withColumn("past", before("b", Window.orderBy("block"))).drop("b")
    placed = cells.join(blocks, "block").withColumn("past", F.col("past") + before("n", Window.partitionBy("block").orderBy("cell")))
    first = placed.groupBy(F.floor(F.col("past") / SLICE_ROWS)).agg(F.min("cell").alias("cell")).orderBy("cell")
    starts = [r["cell"] * window_us for r in first.collect()]
    return np.array([*starts, np.iinfo(np.int64).max], dtype=np.int64)


CONFLICT = "first_id long, ids array<long>, file_paths array<string>, classes array<string>, window_start long, window_end long"


def timestamp_conflicts(df: DataFrame, window_minutes: float, id_col: str = "id", path_col: str = "path", class_col: str = "class", time_col: str = "created") -> DataFrame:
    """One row per conflict, times in microseconds; none if the window isn't positive.

    Anchors follow each other, but a slice of time depends on what came before only by the
    place at which the walk enters it, which lies in its first window. So slices, of about
    equally many rows, tell first where they are left for each such place; these maps are
    composed, and then all slices give their conflicts on their own.
    """
    window_us = round(window_minutes * 60_000_000)
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(class_col).cast("string"), F.lit("")).alias("class"), F.unix_micros(F.col(time_col).cast("timestamp")).alias("us")).where("us is not null")
    if window_us <= 0:
        return spark.createDataFrame([], CONFLICT)
    starts = _starts(rows, window_us)
    count = len(starts) - 1
    if count < 2:
        one = rows.select(F.lit(0).alias("slice"), "id", "path", "class", "us", F.lit(0).alias("entry"))
        return one.repartition("slice").mapInPandas(_found(window_us, starts), CONFLICT) if count else spark.createDataFrame([], CONFLICT)

    def slices(us: pd.Series) -> pd.Series:
        at = np.searchsorted(starts, us.to_numpy(), side="right") - 1
        # rows in the first window of a slice stand behind the slice before, too
        return pd.Series([[n, n - 1] if twice else [n] for n, twice in zip(at.tolist(), (us.to_numpy() - starts[at] < window_us) & (at > 0), strict=True)], dtype=object)

    cut = rows.withColumn("slice", F.explode(F.pandas_udf(slices, "array<long>")("us"))).repartition("slice").sortWithinPartitions("slice")
    cut = checkpointed(cut.select("slice", "id", "path", "class", "us"))
    maps = checkpointed(cut.select("slice", "id", "class", "us").mapInPandas(_maps(window_us, starts), "slice long, exits array<long>"))
    entries = _entries(maps, count)
    if count <= FEW:
        entries = F.broadcast(entries)
    placed = cut.join(entries, "slice") if count <= FEW else cut.join(entries, "slice").repartition("slice").sortWithinPartitions("slice")
    return placed.mapInPandas(_found(window_us, starts), CONFLICT)


def conflict_members(conflicts: DataFrame) -> DataFrame:
    return conflicts.select("first_id", F.explode("ids").alias("id"))


def describe(conflicts: DataFrame, window_minutes: float) -> DataFrame:
    """Adds ``message`` and ``summary``: counts, the span in seconds, times of day and classes."""
    clock = lambda c: F.date_format(F.timestamp_micros(c), "HH:mm:ss")
    seconds = F.round((F.col("window_end") - F.col("window_start")) / 1_000_000).cast("long")
    summary = F.format_string("Files created within %ds (%s - %s) predicted as different classes: [%s]", seconds, clock(F.col("window_start")), clock(F.col("window_end")), F.array_join("classes", ", "))
    message = F.format_string(f"Timestamp conflict: %d images within {window_minutes:g}min window predicted as %d different classes", F.size("file_paths"), F.size("classes"))
    return conflicts.withColumn("message", message).withColumn("summary", summary)
