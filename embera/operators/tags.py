"""Zero-shot tagging: every image against a short list of tag vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import dot, is_zero, vector_literal

PRESELECTED = 0.3


def generate_tags(images: DataFrame, tags: Sequence[tuple[str, Sequence[float]]], id_col: str = "file_path", vector_col: str = "embedding", top_k: int = 5) -> DataFrame:
    """(id, rank, tag, score): the ``top_k`` tags of each image, candidate order on ties.

    The tags are a short list typed by a person; they stand in the plan as literals, so an
    image is scored in one pass without a join. Of equal tags the last vector counts.
    Undecodable images (zero vectors) are skipped.
    """
    unique = list(dict(tags).items())
    if not unique:
        return images.select(F.col(id_col), F.lit(0).alias("rank"), F.lit("").alias("tag"), F.lit(0.0).alias("score")).limit(0)
    scored = F.array(*(F.struct((-dot(F.col(vector_col), vector_literal(v))).alias("minus"), F.lit(i).alias("ord"), F.lit(t).alias("tag")) for i, (t, v) in enumerate(unique)))
    best = F.slice(F.array_sort(F.filter(scored, lambda s: s["minus"].isNotNull())), 1, top_k)
    rows = images.where(~is_zero(F.col(vector_col))).select(F.col(id_col), F.posexplode(best).alias("pos", "s"))
    return rows.select(id_col, (F.col("pos") + 1).alias("rank"), F.col("s.tag").alias("tag"), (-F.col("s.minus")).alias("score"))


def preselect(tagged: DataFrame, least: float = PRESELECTED) -> DataFrame:
    return tagged.withColumn("is_selected", F.col("score") >= least)


def tag_counts(tagged: DataFrame, selected_only: bool = True) -> DataFrame:
    """(tag, n): images per tag."""
    rows = tagged.where("is_selected") if selected_only else tagged
    return rows.groupBy("tag").agg(F.count("*").alias("n"))
