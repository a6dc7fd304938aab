"""Streams (an extension): new images into the cache, conflicts among arriving files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.conflicts import greedy
from ..plans.encoding import Encoder, with_vectors
from ..plans.store import CacheStore
from ..functions.vector import is_zero


def cache_stream(files: DataFrame, store: CacheStore, encoder: Encoder, checkpoint: str):
    """Starts a query that encodes arriving files (file_path, last_modified, file_size, content) into the cache.

    A batch is one commit of keyed upserts, so a batch that runs again changes nothing.
    """

    def save(batch: DataFrame, _: int) -> None:
        fresh = with_vectors(batch, encoder).where(~is_zero(F.col("embedding"))).withColumn("model_name", F.lit(encoder.model_name))
        if not fresh.isEmpty():
            store.upsert("file_cache", fresh)

    return files.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def conflict_stream(files: DataFrame, window_minutes: float, key_col: str, watermark: str = "10 minutes") -> DataFrame:
    """Conflicts per key of a stream ``(id, path, class, created, key)``.

    Rows wait in state until the watermark has passed their island's end: an island is
    closed by a gap of the window's length, and what it holds is bounded by that.
    """
    window_us = round(window_minutes * 60_000_000)
    schema = f"{key_col} string, first_id long, n int, classes array<string>, window_start long, window_end long"

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in parts:
            held += list(zip(pdf["id"].tolist(), pdf["path"].tolist(), pdf["class"].tolist(), pdf["us"].tolist(), strict=True))
        held.sort(key=lambda r: (r[3], r[0]))
        now = state.getCurrentWatermarkMs() * 1000
        done, island = [], []
        for row in held:
            if island and row[3] - island[-1][3] >= window_us:
                done.append(island)
                island = []
            island.append(row)
        if island and island[-1][3] + window_us <= now:
            done.append(island)
            island = []
        if island:
            state.update(tuple(list(c) for c in zip(*island, strict=True)))
            state.setTimeoutTimestamp(max(island[-1][3] + window_us, now + 1000) // 1000 + 1)
        elif state.exists:
            state.remove()
        for rows in done:
            found = greedy(rows, window_us)
            if len(found):
                yield pd.DataFrame({key_col: key[0], "first_id": found["first_id"], "n": found["ids"].map(len), "classes": found["classes"], "window_start": found["window_start"], "window_end": found["window_end"]})

    rows = files.withWatermark("created", watermark).select(F.col(key_col).cast("string").alias(key_col), F.col("id").cast("long").alias("id"), "path", "class", "created", F.unix_micros(F.col("created").cast("timestamp")).alias("us"))
    return rows.groupBy(key_col).applyInPandasWithState(run, schema, "ids array<long>, paths array<string>, classes array<string>, us array<long>", "append", GroupStateTimeout.EventTimeTimeout)
