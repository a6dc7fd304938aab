"""Named analyses: clusters, tags, sorting, evaluation, classification."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_tags
from ..functions.vector import arg_max, best_label, softmax
from ..operators import clusters, conflicts, evaluation, routing, tags
from .encoding import Encoder


def cluster_analysis(features: DataFrame, id_col: str, k: int | None = None, max_k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(assigned rows, members per cluster); without k the best silhouette chooses it."""
    k = k or clusters.optimal_k(features, id_col, max_k)
    assigned, _ = clusters.kmeans(features, k)
    return assigned, clusters.members(assigned, id_col)


def tag_analysis(images: DataFrame, tag_text: str, encoder: Encoder, id_col: str = "file_path", top_k: int = 5) -> DataFrame:
    """Tags of every image from a typed list; likely ones are preselected."""
    spark = images.sparkSession
    names = spark.createDataFrame([(tag_text,)], "t string").select(parse_tags(F.col("t")).alias("t")).first()["t"]
    return tags.preselect(tags.generate_tags(images, [(n, encoder.encode_text(n)) for n in names], id_col, top_k=top_k))


def classified(outputs: DataFrame, labels: Sequence[str], output_col: str = "output", as_probabilities: bool = False) -> DataFrame:
    """``outputs`` with predicted class, confidence and probabilities; the raw output is the confidence unless asked otherwise."""
    v = softmax(F.col(output_col)) if as_probabilities else F.col(output_col)
    out = outputs.withColumn("_v", v).where(F.size("_v") > 0)
    named = F.map_from_entries(F.zip_with(F.transform(F.sequence(F.lit(0), F.size("_v") - 1), lambda i: F.coalesce(F.get(F.array(*(F.lit(x) for x in labels)), i), F.concat(F.lit("#"), i.cast("string")))), F.col("_v"), lambda n, x: F.struct(n, x)))
    return out.withColumn("predicted_class", best_label(F.col("_v"), labels)).withColumn("confidence", F.get("_v", arg_max(F.col("_v")))).withColumn("probabilities", named).drop("_v")


def model_outputs(df: DataFrame, encoder: Encoder, content_col: str = "content") -> DataFrame:
    """``df`` with ``output``, the model's first output row per image; undecodable images drop out."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for contents in parts:
            yield pd.Series(encoder.encode_images([bytes(c) if c is not None else b"" for c in contents]), dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    out = df.withColumn("output", F.pandas_udf(run, "array<float>").asNondeterministic()(content_col)).drop(content_col)
    return out.where(F.exists("output", lambda x: x != 0))


def sort_with_conflicts(files: DataFrame, target: str, threshold: float = 0.999, window_minutes: float = 1.0, skip_conflicts: bool = True) -> tuple[DataFrame, DataFrame]:
    """(plan, conflicts) of ``files(id, path, class, confidence, created)``."""
    found = conflicts.timestamp_conflicts(files, window_minutes)
    return routing.routing_plan(files, target, threshold, conflicts.conflict_members(found) if skip_conflicts else None), found


def evaluate(predictions: DataFrame, labels: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accuracy, metrics per class, confusion matrix)."""
    confusion = evaluation.confusion_matrix(predictions, labels)
    return evaluation.accuracy_summary(predictions), evaluation.class_metrics(confusion, labels), confusion
