"""Vector queries over ``embeddings``: the table is the file cache, labels are its folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.text import percent_text, score_band
from ..functions.vector import euclidean, is_zero, l2_normalize, norm, vector_literal
from ..operators import clusters, search, tags
from ..session import checkpointed


def _table(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _query(e: DataFrame) -> list[float]:
    """The vector of the smallest id: one row."""
    return list(e.where(F.col("embedding").isNotNull()).orderBy("vec_id").select("embedding").first()["embedding"])


def _scored(e: DataFrame) -> DataFrame:
    return search.score(e, _query(e)).withColumn("similarity", F.round("similarity", 6))


def vec_search_topk(spark, d):
    return search.rank(_scored(_table(spark, d)).select("vec_id", "similarity"), "vec_id", 20)


def vec_search_threshold(spark, d):
    return search.at_least(_scored(_table(spark, d)), 0.25).select("vec_id", "similarity")


def vec_search_exclude_self(spark, d):
    e = _table(spark, d)
    named = _scored(e).withColumn("path", F.concat(F.lit("Img_"), F.col("vec_id").cast("string"), F.lit(".JPG")))
    return search.rank(search.exclude(named, "path", "img_0.jpg").select("vec_id", "similarity"), "vec_id", 50)


def vec_search_multi_root_dedup(spark, d):
    s = _scored(_table(spark, d)).select("vec_id", "label", "similarity")
    return search.merge_roots([s.where("label <= 5"), s.where("label >= 4")], ["vec_id"]).select("vec_id", "similarity", "root_ordinal")


def vec_score_distribution(spark, d):
    return search.distribution(_scored(_table(spark, d)))


def vec_score_bands(spark, d):
    return _scored(_table(spark, d)).groupBy(score_band(F.col("similarity")).alias("band")).agg(F.count("*").alias("n"))


def vec_l2_normalize(spark, d):
    tripled = _table(spark, d).withColumn("v", F.transform("embedding", lambda x: x.cast("double") * 3))
    unit = l2_normalize(F.col("v"))
    return tripled.select("vec_id", F.round(norm(F.col("v")), 5).alias("norm_before"), F.round(norm(unit), 6).alias("norm_after"), F.round(F.get(unit, F.lit(0)), 6).alias("first"))


def vec_euclid_to_query(spark, d):
    e = _table(spark, d)
    return e.select("vec_id", F.round(euclidean(F.col("embedding"), vector_literal(_query(e))), 6).alias("distance"))


def vec_dim_guard(spark, d):
    e = _table(spark, d)
    short = _query(e)[:-1]
    fits = search.dimension_matches(e, short)
    return search.score(e, short).agg(F.count("*").alias("n_results")).withColumn("fits", F.lit(fits))


def zero_vector_filter(spark, d):
    e = _table(spark, d).withColumn("embedding", F.when(F.pmod("vec_id", F.lit(10)) == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")))
    return e.where(~is_zero(F.col("embedding"))).groupBy("label").agg(F.count("*").alias("n"))


def _label_vectors(e: DataFrame) -> list[tuple[str, list[float]]]:
    """The label centroids, rounded: ten short rows."""
    rows = clusters.centroid_means(e.select("label", "embedding"), "label", "embedding").collect()
    return [(f"label{r['cluster']}", [round(x, 6) for x in r["centroid"]]) for r in sorted(rows, key=lambda r: r["cluster"])]


def _tagged(e: DataFrame) -> DataFrame:
    return tags.generate_tags(e, _label_vectors(e), "vec_id").withColumn("score", F.round("score", 5))


def zero_shot_tags(spark, d):
    return _tagged(_table(spark, d)).select("vec_id", "rank", "score")


#: Scores of these vectors with label centroids are low; about a third of the first five tags reaches this.
TAGGED = 0.02


def tag_counts(spark, d):
    return tags.tag_counts(tags.preselect(_tagged(_table(spark, d)), TAGGED))


def nearest_centroid_assign(spark, d):
    e = _table(spark, d)
    out = clusters.assign_nearest(e, [v for _, v in _label_vectors(e)], "embedding")
    return out.groupBy("label", "cluster").agg(F.count("*").alias("n"))


def centroid_means(spark, d):
    m = clusters.centroid_means(_table(spark, d), "label", "embedding")
    return m.select(F.col("cluster").alias("label"), F.posexplode("centroid").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("mean"))


def cluster_members(spark, d):
    """The inverted index, a row for each member; a large label has several parts in it."""
    m = clusters.members(_table(spark, d), "vec_id", "label")
    whole = m.groupBy(F.col("cluster").alias("label")).agg(F.sum("n").alias("n"))
    rows = m.select(F.col("cluster").alias("of"), F.explode("members").alias("vec_id"))
    return rows.join(whole, F.col("of").eqNullSafe(F.col("label"))).select("label", "vec_id", "n")


def silhouette_by_label(spark, d):
    s = clusters.silhouettes(_table(spark, d), "vec_id", "label", "embedding")
    return s.groupBy(F.col("cluster").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


def kmeans_fixed_init(spark, d):
    e = _table(spark, d)
    init = [v for _, v in _label_vectors(e)][:4]
    assigned, _ = clusters.lloyd(e, init, 5, "embedding")
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"))


def optimal_k(spark, d):
    e = _table(spark, d).select("vec_id", F.col("embedding").alias("features"))
    return spark.createDataFrame([(clusters.optimal_k(e, "vec_id"),)], "k int")


def vector_hash_roundtrip(spark, d):
    """Vectors as text and back: length of the text, and number, first, last and sum of the components that come back."""
    back = _table(spark, d).select("vec_id", codec.vector_to_base64(F.col("embedding")).alias("text")).withColumn("v", codec.base64_to_vector(F.col("text")))
    total = F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6)
    at = lambda i: F.get("v", i).cast("double")
    return back.select("vec_id", F.length("text").alias("n_text"), F.size("v").alias("n"), at(F.lit(0)).alias("first"), at(F.size("v") - 1).alias("last"), total.alias("total"))


def silhouette_by_k(spark, d):
    """The mean silhouette of all points for 2, 3 and 4 clusters around the first vectors."""
    e = _table(spark, d)
    first = [list(r[0]) for r in e.orderBy("vec_id").select("embedding").limit(4).collect()]
    for k in (2, 3, 4):
        e = clusters.assign_nearest(e, first[:k], "embedding").withColumnRenamed("cluster", f"c{k}")
    s = clusters.silhouettes_of(checkpointed(e.select("vec_id", "embedding", F.array(*(F.col(f"c{k}").cast("long") for k in (2, 3, 4))).alias("clusters"))), "vec_id", "clusters", "embedding")
    return s.groupBy((F.col("labelling") + 2).alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


def percent_labels(spark, d):
    return _scored(_table(spark, d)).select("vec_id", percent_text(F.col("similarity")).alias("percent"))


_NAMES = (vec_search_topk, vec_search_threshold, vec_search_exclude_self, vec_search_multi_root_dedup, vec_score_distribution, vec_score_bands, vec_l2_normalize, vec_euclid_to_query, vec_dim_guard, zero_vector_filter, zero_shot_tags, tag_counts, nearest_centroid_assign, centroid_means, cluster_members, silhouette_by_label, kmeans_fixed_init, optimal_k, silhouette_by_k, vector_hash_roundtrip, percent_labels)
QUERIES = {f.__name__: f for f in _NAMES}

_S = "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, round(list_dot_product(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, q)"
_C = "WITH u AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, round(avg(x::DOUBLE), 6) AS mean FROM u GROUP BY label, pos), c AS (SELECT label, list(mean ORDER BY pos) AS c FROM m GROUP BY label)"
_T = _C + ", t AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rank, score FROM (SELECT vec_id, c.label, list_dot_product(embedding::DOUBLE[], c.c) AS score FROM embeddings, c))"


def _lloyd_sql(k: int, rounds: int) -> str:
    """Rounds of nearest centroids and their means, from the first ``k`` label centroids."""
    out = _C + f", c0 AS (SELECT row_number() OVER (ORDER BY label) - 1 AS k, c FROM c QUALIFY k < {k})"
    for i in range(rounds + 1):
        out += f", a{i} AS (SELECT vec_id, any_value(embedding::DOUBLE[]) AS e, arg_min(k, (list_distance(embedding::DOUBLE[], c), k)) AS k FROM embeddings, c{i} GROUP BY vec_id)"
        if i < rounds:
            out += f", m{i} AS (SELECT k, pos, avg(x) AS x FROM (SELECT k, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM a{i}) GROUP BY k, pos), n{i} AS (SELECT k, list(x ORDER BY pos) AS c FROM m{i} GROUP BY k), c{i + 1} AS (SELECT k, coalesce(n{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN n{i} USING (k))"
    return f"{out} SELECT CAST(k AS INTEGER) AS cluster, count(*) AS n FROM a{rounds} GROUP BY k"


ORACLES = {
    "kmeans_fixed_init": _lloyd_sql(4, 5),
    "vec_search_topk": f"{_S} SELECT vec_id, similarity FROM s ORDER BY similarity DESC, vec_id LIMIT 20",
    "vec_search_threshold": f"{_S} SELECT vec_id, similarity FROM s WHERE similarity >= 0.25",
    "vec_search_exclude_self": f"{_S} SELECT vec_id, similarity FROM s WHERE vec_id <> 0 ORDER BY similarity DESC, vec_id LIMIT 50",
    "vec_search_multi_root_dedup": f"{_S} SELECT vec_id, similarity, CASE WHEN label <= 5 THEN 0 ELSE 1 END AS root_ordinal FROM s",
    "vec_score_distribution": f"{_S} SELECT count(*) AS n, min(similarity) AS lowest, max(similarity) AS highest, list_sort(list(similarity))[count(*) // 2 + 1] AS median FROM s",
    "vec_score_bands": f"{_S} SELECT CASE WHEN similarity >= 0.28 THEN 'green' WHEN similarity >= 0.20 THEN 'orange' ELSE 'gray' END AS band, count(*) AS n FROM s GROUP BY 1",
    "vec_l2_normalize": "WITH t AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM t) SELECT vec_id, round(n, 5) AS norm_before, round(sqrt(list_dot_product(list_transform(v, lambda x: x / n), list_transform(v, lambda x: x / n))), 6) AS norm_after, round(v[1] / n, 6) AS first FROM n",
    "vec_euclid_to_query": f"{_S} SELECT vec_id, round(list_distance(e, q), 6) AS distance FROM s, q",
    "vec_dim_guard": "WITH q AS (SELECT len(embedding) - 1 AS n FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1) SELECT count(*) FILTER (len(embedding) = q.n) AS n_results, bool_and(len(embedding) = q.n) AS fits FROM embeddings, q",
    "zero_vector_filter": "SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 10 <> 0 GROUP BY label",
    "zero_shot_tags": f"{_T} SELECT vec_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM t WHERE rank <= 5",
    "tag_counts": f"{_T} SELECT 'label' || label AS tag, count(*) AS n FROM t WHERE rank <= 5 AND round(score, 5) >= 0.02 GROUP BY label",
    "nearest_centroid_assign": _C + ", d AS (SELECT vec_id, e.label, c.label AS cl, list_distance(embedding::DOUBLE[], c.c) AS d FROM embeddings e, c), b AS (SELECT vec_id, label, arg_min(cl, (d, cl)) AS cluster FROM d GROUP BY ALL) SELECT label, cluster, count(*) AS n FROM b GROUP BY ALL",
    "centroid_means": _C + " SELECT label, CAST(pos - 1 AS INTEGER) AS pos, mean FROM m",
    "cluster_members": "SELECT label, vec_id, count(*) OVER (PARTITION BY label) AS n FROM embeddings",
    "silhouette_by_label": """WITH p AS (SELECT a.vec_id, a.label AS own, b.label AS other, avg(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY ALL),
s AS (SELECT vec_id, own, max(d) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM p GROUP BY ALL)
SELECT CAST(own AS BIGINT) AS label, count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY own""",
    "silhouette_by_k": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id) - 1 AS c FROM embeddings), k AS (SELECT unnest([2, 3, 4]) AS k),
a AS MATERIALIZED (SELECT k.k, e.vec_id, any_value(e.v) AS v, arg_min(f.c, (list_distance(e.v, f.v), f.c)) AS own FROM e, k JOIN e f ON f.c < k.k GROUP BY k.k, e.vec_id),
d AS MATERIALIZED (SELECT x.vec_id AS i, y.vec_id AS j, list_distance(x.v, y.v) AS d FROM e x JOIN e y ON x.vec_id <> y.vec_id),
p AS (SELECT x.k, x.vec_id, x.own, y.own AS other, avg(d.d) AS d FROM a x JOIN d ON d.i = x.vec_id JOIN a y ON y.vec_id = d.j AND y.k = x.k GROUP BY ALL),
s AS (SELECT k, vec_id, max(d) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM p GROUP BY k, vec_id)
SELECT k, count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY k""",
    "vector_hash_roundtrip": "SELECT vec_id, CAST(4 * ceil(len(embedding) * 4 / 3.0) AS INTEGER) AS n_text, CAST(len(embedding) AS INTEGER) AS n, embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings",
    "percent_labels": f"{_S} SELECT vec_id, printf('%.1f%%', sign(similarity) * floor(abs(similarity) * 1000 + 0.5) / 10 + 0.0) AS percent FROM s",
}
