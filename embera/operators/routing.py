"""Routing of classified files: plans, counters, clash-free names, copying."""

from __future__ import annotations

import contextlib
import hashlib
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import extension, file_name, stem
from ..session import checkpointed


def routing_plan(classified: DataFrame, target: str, threshold: float, conflict_ids: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """``classified(id, path, class, confidence)`` with ``action`` (sort, low_confidence, failed, conflict) and ``destination``."""
    c = classified
    if conflict_ids is not None:
        marked = conflict_ids.select(F.col("id").alias("_c")).distinct()
        c = c.join(marked, c[id_col] == marked["_c"], "left")
    else:
        c = c.withColumn("_c", F.lit(None).cast("long"))
    action = F.when(F.col("_c").isNotNull(), "conflict").when(F.col("class").isNull() | F.col("confidence").isNull(), "failed").when(F.col("confidence") >= threshold, "sort").otherwise("low_confidence")
    return c.withColumn("action", action).withColumn("destination", F.when(F.col("action") == "sort", F.concat_ws("/", F.lit(target.rstrip("/")), "class", file_name(F.col("path"))))).drop("_c")


def sort_summary(plan: DataFrame) -> DataFrame:
    """(total, sorted, skipped, conflicts_skipped): conflict members count as skipped, too."""
    return plan.agg(F.count("*").alias("total"), F.count_if(F.col("action") == "sort").alias("sorted"), F.count_if(F.col("action") != "sort").alias("skipped"), F.count_if(F.col("action") == "conflict").alias("conflicts_skipped"))


def files_per_class(plan: DataFrame) -> DataFrame:
    return plan.where("action = 'sort'").groupBy("class").agg(F.count("*").alias("n"))


#: The number at the end of a name, before its extension, as ``clash_free_names`` writes it.
NUMBERED = r" \(([1-9][0-9]{0,17})\)(\.[^.]*)?$"


def clash_free_names(df: DataFrame, name_col: str, order: list, taken: DataFrame | None = None) -> DataFrame:
    """``df`` with ``target_name``, unlike all others and all of ``taken(name)`` in either case.

    The first file of a name keeps it, if it isn't taken. Every other gets `` (n)`` before its
    extension, with the smallest n that no file of the table, none of ``taken`` and no
    earlier one has. (Names written for different names differ: their numbers are behind
    them.) The n of a name's d-th copy is d plus the numbers in use before it, which a
    window over both counts.
    """
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.lower(F.col(name_col)).alias("key"), F.row_number().over(Window.partitionBy(F.lower(F.col(name_col))).orderBy(*order)).alias("n"))
    names = df.select(F.lower(F.col(name_col)).alias("name"), F.lit(False).alias("there"))
    if taken is not None:
        names = names.union(taken.select(F.lower("name"), F.lit(True)))
        there = taken.select(F.lower("name").alias("key"), F.lit(1).alias("there")).distinct()
        rows = rows.join(there, "key", "left").withColumn("copy", F.col("n") - 1 + F.coalesce("there", F.lit(0))).select("row", "key", "copy")
    else:
        rows = rows.select("row", "key", (F.col("n") - 1).alias("copy"))
    used = names.select(F.regexp_replace("name", NUMBERED, "$2").alias("key"), F.regexp_extract("name", NUMBERED, 1).alias("number")).where("number <> ''").select("key", F.col("number").cast("long").alias("number")).distinct()
    # so many numbers are free before one in use
    used = used.withColumn("copy", F.col("number") - F.row_number().over(Window.partitionBy("key").orderBy("number")))
    both = rows.select("row", "key", F.col("copy").cast("long").alias("copy"), F.lit(0).alias("kind")).unionByName(used.select("key", "copy", F.lit(1).alias("kind")), allowMissingColumns=True)
    before = Window.partitionBy("key").orderBy("copy", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("number", F.col("copy") + F.sum("kind").over(before)).where("kind = 0")
    c = F.col(f"row.`{name_col}`")
    named = F.when(F.col("copy") > 0, F.concat(stem(c), F.format_string(" (%d)", "number"), extension(c))).otherwise(c)
    return both.select("row.*", named.alias("target_name"))


def page_file_name(archive: str, index: str, content_extension: str):
    """``{archive}_p{n}{ext}`` of a page."""
    return F.concat(stem(F.col(archive)), F.lit("_p"), (F.col(index) + 1).cast("string"), F.col(content_extension))


def _temporary(run_id: str, source: str, target: str) -> str:
    """The name beside ``target`` under which a file waits until it is published; the same for every attempt."""
    mark = hashlib.sha256(f"{source}\0{target}".encode("utf-8", "surrogatepass")).hexdigest()[:16]
    return os.path.join(os.path.dirname(target), f".{run_id}-{mark}")


def stage_file(source: str, target: str, run_id: str, link: bool) -> None:
    """Puts the content of ``source`` beside ``target``; the source stays as it is. Attempts may repeat."""
    if os.path.abspath(source) == os.path.abspath(target):
        os.stat(source)
        return
    waiting = _temporary(run_id, source, target)
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    if link:
        try:
            os.link(source, waiting)
            return
        except FileExistsError:
            return  # an attempt before
        except OSError:
            pass  # another file system
    shutil.copyfile(source, waiting + "~")
    os.replace(waiting + "~", waiting)


def publish_file(source: str, target: str, run_id: str) -> None:
    """Gives a staged file its name. If it isn't waiting any more, an attempt before did so."""
    waiting = _temporary(run_id, source, target)
    try:
        os.replace(waiting, target)
        with contextlib.suppress(FileNotFoundError):
            os.unlink(waiting)  # both names were links to one file, which a rename leaves as it is
    except FileNotFoundError:
        if not os.path.exists(target):
            raise


def remove_source(source: str, target: str) -> None:
    """Takes away the source of a published file; gone already is as good."""
    if os.path.abspath(source) != os.path.abspath(target) and os.path.exists(target):
        with contextlib.suppress(FileNotFoundError):
            os.unlink(source)


def _step(action: Callable[[str, str], None]):
    """Rows without an error get ``action``; what it raises becomes their error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors = []
            for source, target, error in zip(pdf["path"], pdf["destination"], pdf["error"], strict=True):
                if error is None or pd.isna(error):
                    try:
                        action(source, target)
                        error = None
                    except (OSError, ValueError) as e:
                        error = str(e)
                errors.append(error)
            yield pdf.assign(error=pd.Series(errors, dtype=object, index=pdf.index))

    return run


def carry_out(plan: DataFrame, move: bool = False, run_id: str | None = None) -> DataFrame:
    """Copies or moves ``path`` to ``destination`` on the executors: (path, destination, done, error).

    Three jobs, each kept when it is done: contents are staged beside their destinations
    (linked for a move within a file system), then published by a rename, then sources of
    moved files go. A task that fails after half of its rows and runs again repeats steps
    that change nothing any more, so every file is reported once and none is lost; looking
    at the result again does nothing. Of rows with one destination the last path by name
    stays. Of a move with several destinations the source goes after all of them.
    """
    run_id = run_id or f"embera-{uuid.uuid4().hex[:12]}"
    rows = plan.where("path is not null and destination is not null").select("path", "destination").distinct()
    rows = rows.join(rows.groupBy("destination").agg(F.max("path").alias("last")), "destination")
    kind = "path string, destination string, error string"
    staged = checkpointed(rows.where("path = last").select("path", "destination", F.lit(None).cast("string").alias("error")).mapInPandas(_step(lambda s, t: stage_file(s, t, run_id, move)), kind))
    published = checkpointed(staged.mapInPandas(_step(lambda s, t: publish_file(s, t, run_id)), kind))
    if move:
        left = published.where("error is not null").select("path").distinct()
        gone = published.join(left, "path", "left_anti").mapInPandas(_step(remove_source), kind)
        published = checkpointed(gone.unionByName(published.join(left, "path", "left_semi")))
    replaced = rows.where("path <> last").select("path", "destination", F.lit(False).alias("done"), F.lit("another file has this destination").alias("error"))
    return published.select("path", "destination", F.col("error").isNull().alias("done"), "error").unionByName(replaced)


def cluster_plan(assigned: DataFrame, target: str) -> DataFrame:
    """Copies by cluster number."""
    return assigned.withColumn("destination", F.concat_ws("/", F.lit(target.rstrip("/")), F.format_string("Cluster %d", F.col("cluster") + 1), file_name(F.col("path"))))


def tag_plan(tagged: DataFrame, target: str) -> DataFrame:
    """One copy per selected tag of a file."""
    return tagged.where("is_selected").withColumn("destination", F.concat_ws("/", F.lit(target.rstrip("/")), "tag", file_name(F.col("path"))))


def history(df: DataFrame, key_cols: list[str], query_col: str, time_col: str, most: int = 10) -> DataFrame:
    """The last ``most`` different queries per key, in either case, newest first."""
    last = df.groupBy(*key_cols, F.lower(query_col).alias("_q")).agg(F.max_by(query_col, time_col).alias("query"), F.max(time_col).alias("used"))
    if not key_cols:  # a sort that keeps ``most`` rows per task; only those are numbered
        last = last.orderBy(F.desc("used"), "query").limit(most)
    w = Window.partitionBy(*key_cols or [F.lit(1)]).orderBy(F.desc("used"), "query")
    return last.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most).drop("_q")


def root_histogram(df: DataFrame, root_col: str, most: int = 5) -> DataFrame:
    return df.groupBy(F.col(root_col).alias("root")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(most)
