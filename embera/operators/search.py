"""Exact vector search and the relational steps after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vector import dot, is_zero, vector_literal


def dimension_matches(cached: DataFrame, query: Sequence[float], vector_col: str = "embedding") -> bool:
    """Whether a query fits the cached vectors, from the first one that isn't zero; True without any."""
    first = cached.where(~is_zero(F.col(vector_col))).select(F.size(vector_col).alias("n")).limit(1).collect()
    return not first or first[0]["n"] == len(query)


def score(df: DataFrame, query: Sequence[float], vector_col: str = "embedding") -> DataFrame:
    """``df`` with ``similarity`` to the query; zero vectors and other dimensions drop out."""
    literal = vector_literal(query)
    return df.where(~is_zero(F.col(vector_col))).withColumn("similarity", dot(F.col(vector_col), literal)).where(F.col("similarity").isNotNull())


def exclude(df: DataFrame, path_col: str, path: str) -> DataFrame:
    """Without the query's own path, in either case."""
    return df.where(F.lower(path_col) != F.lower(F.lit(path)))


def at_least(df: DataFrame, threshold: float, score_col: str = "similarity") -> DataFrame:
    return df.where(F.col(score_col) >= threshold)


def rank(df: DataFrame, tie: str | Column, limit: int | None = None, score_col: str = "similarity") -> DataFrame:
    """Best first, ties by ``tie``; with a limit Spark keeps just that many per task."""
    ordered = df.orderBy(F.desc(score_col), tie)
    return ordered.limit(limit) if limit is not None else ordered


def merge_roots(results: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Results of several roots as one; of equal keys the earliest root's row stays."""
    parts = [r.withColumn("root_ordinal", F.lit(i)) for i, r in enumerate(results)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return keep_first(every, keys, ["root_ordinal", F.desc("similarity")])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def in_input_order(results: DataFrame, inputs: DataFrame, key: str, order_col: str) -> DataFrame:
    """``results`` (a row per key) for every row of ``inputs``, in the order that ``order_col`` of ``inputs`` carries; null where there is none."""
    places = inputs.select(F.col(key).alias("_key"), F.col(order_col).alias("_order"))
    joined = places.join(results, places["_key"] == results[key], "left")
    return joined.orderBy("_order").select("_order", F.col("_key").alias(key), *(results[c] for c in results.columns if c != key)).withColumnRenamed("_order", order_col)


def distribution(df: DataFrame, score_col: str = "similarity", bins: int = 4096) -> DataFrame:
    """(n, lowest, highest, median): the median is the upper one, sorted[n div 2].

    Scores are counted by bin; the bin that holds the middle is cut into bins again until
    it holds few rows or one value, whatever outliers there are. Nothing is sorted or
    gathered as a whole; ``bins`` counts come to the driver per round.
    """
    s = F.col(score_col).cast("double")
    rows = df.where(s.isNotNull()).select(s.alias("s"))
    total = rows.agg(F.count("s").alias("n"), F.min("s").alias("lowest"), F.max("s").alias("highest")).first()
    median = None
    if total["n"]:
        lo, hi, skip, inside = total["lowest"], total["highest"], total["n"] // 2, total["n"]
        while lo < hi and inside > bins:
            at = F.least(F.floor((F.col("s") - lo) / F.lit(hi - lo) * bins), F.lit(bins - 1)).cast("int")
            counts = rows.where(F.col("s").between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("s").alias("c"), F.min("s").alias("lo"), F.max("s").alias("hi")).collect()
            for r in sorted(counts, key=lambda r: r["bin"]):
                if skip < r["c"]:
                    break
                skip -= r["c"]
            if (r["lo"], r["hi"]) == (lo, hi):  # values too near for bins: they are counted one by one below
                break
            lo, hi, inside = r["lo"], r["hi"], r["c"]
        values = rows.where(F.col("s").between(lo, hi)).groupBy("s").count().orderBy("s")
        for v in values.collect() if lo < hi else [(lo, inside)]:  # ``bins`` rows at most, or as many as doubles lie so near
            if skip < v[1]:
                median = v[0]
                break
            skip -= v[1]
    return df.sparkSession.createDataFrame([(total["n"], total["lowest"], total["highest"], median)], "n long, lowest double, highest double, median double")
