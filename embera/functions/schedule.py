"""Learning-rate schedules, model lookups and the train/validation split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Architecture, display name, image size, parameters in millions.
ARCHITECTURES = [
    ("EfficientNetB0", "EfficientNet-B0", 224, 5),
    ("EfficientNetB1", "EfficientNet-B1", 224, 8),
    ("EfficientNetV2S", "EfficientNetV2-S", 384, 21),
    ("ConvNeXtTiny", "ConvNeXt-Tiny", 224, 29),
    ("MobileNetV3Large", "MobileNetV3-Large", 224, 6),
]


def learning_rate(schedule: str, epoch: Column, epochs: int, base: float) -> Column:
    """cosine and one_cycle: base * 0.5 * (1 + cos(pi * epoch / epochs)); step: a tenth every 20 epochs."""
    if schedule in ("cosine", "one_cycle"):
        return F.lit(base) * 0.5 * (1 + F.cos(F.lit(math.pi) * epoch / float(epochs)))
    if schedule == "step":
        return F.lit(base) * F.pow(F.lit(0.1), F.floor(epoch / 20).cast("double"))
    return F.lit(base)


def architectures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ARCHITECTURES, "architecture string, display_name string, image_size int, params_m int")


def best_epoch(metrics: DataFrame) -> DataFrame:
    """The first epoch of the highest validation accuracy: one row."""
    return metrics.agg(F.max_by("epoch", F.struct("validation_accuracy", -F.col("epoch"))).alias("epoch"), F.max("validation_accuracy").alias("validation_accuracy"))


def train_validation_split(df: DataFrame, path_col: str, share: float, seed: int = 42) -> DataFrame:
    """``df`` with ``part``: the floor(n * share) rows of the smallest hash are validation.

    The cut is found in counts by hash range first, so nothing is sorted as a whole.
    """
    mark = F.xxhash64(F.col(path_col), F.lit(seed))
    bins = df.groupBy(F.shiftright(mark, 44).alias("bin")).agg(F.count("*").alias("n"))
    along = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # 2**20 rows at most
    bins = bins.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
    wanted = F.floor(F.sum("n").over(Window.partitionBy(F.lit(1))) * share)
    edge = bins.withColumn("wanted", wanted).where("before < wanted and before + n >= wanted").select("bin", (F.col("wanted") - F.col("before")).alias("skip")).first()
    if edge is None:
        return df.withColumn("part", F.lit("train"))
    # only the rows of one bin are put in order
    inside = df.where(F.shiftright(mark, 44) == edge["bin"]).select(F.struct(mark.alias("h"), F.col(path_col).alias("p")).alias("x")).orderBy("x").limit(edge["skip"])
    cut = inside.agg(F.max("x").alias("x")).first()["x"]
    first = (mark < cut["h"]) | ((mark == cut["h"]) & (F.col(path_col) <= cut["p"]))
    return df.withColumn("part", F.when(first, "validation").otherwise("train"))
