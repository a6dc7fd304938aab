"""Classifier evaluation: confusion matrix, per-class metrics, accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_matrix(df: DataFrame, labels: Sequence[str], true_col: str = "true_label", predicted_col: str = "predicted") -> DataFrame:
    """(true_label, predicted, n) over rows whose labels both are known."""
    known = [str(x) for x in labels]
    rows = df.where(F.col(true_col).isin(known) & F.col(predicted_col).isin(known))
    return rows.groupBy(F.col(true_col).alias("true_label"), F.col(predicted_col).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(confusion: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1), zeros where a denominator is zero; every label has a row.

    The input has at most one row per pair of labels, so it is the matrix that is joined,
    never the predictions.
    """
    names = confusion.sparkSession.createDataFrame([(str(x),) for x in labels], "label string")
    both = confusion.select(F.explode(F.array(F.struct(F.col("true_label").alias("label"), F.lit(True).alias("as_true")), F.struct(F.col("predicted").alias("label"), F.lit(False).alias("as_true")))).alias("x"), "n", (F.col("true_label") == F.col("predicted")).alias("right")).select("x.*", "n", "right")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    m = names.join(both, "label", "left").groupBy("label").agg(total(F.col("as_true") & F.col("right")).alias("tp"), total(~F.col("as_true") & ~F.col("right")).alias("fp"), total(F.col("as_true") & ~F.col("right")).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    m = m.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return m.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def accuracy_summary(df: DataFrame, true_col: str = "true_label", predicted_col: str = "predicted") -> DataFrame:
    """(total, correct, accuracy, loss): all rows count, also those without a prediction."""
    correct = F.count_if(F.col(true_col) == F.col(predicted_col))
    return df.agg(F.count("*").alias("total"), correct.alias("correct"), F.when(F.count("*") > 0, correct / F.count("*")).otherwise(0.0).alias("accuracy"), F.lit(0.0).alias("loss"))
