"""Evaluation, conflicts and sorting: ``labels`` are predictions, ``events`` are classified files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schedule import train_validation_split
from ..operators import conflicts, evaluation, routing


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """quality is the truth, toxic the prediction; each 11th prediction is missing, each 13th unknown."""
    bad = F.when(F.pmod("doc_id", F.lit(11)) == 0, F.lit(None).cast("string")).when(F.pmod("doc_id", F.lit(13)) == 0, "2").otherwise(F.col("toxic").cast("string"))
    return spark.read.parquet(f"{d}/labels.parquet").select(F.col("quality").cast("string").alias("true_label"), bad.alias("predicted"))


def confusion_matrix(spark, d):
    return evaluation.confusion_matrix(_predictions(spark, d), ["0", "1"])


def class_metrics(spark, d):
    m = evaluation.class_metrics(evaluation.confusion_matrix(_predictions(spark, d), ["0", "1"]), ["0", "1"])
    return m.select("label", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def accuracy_summary(spark, d):
    return evaluation.accuracy_summary(_predictions(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


def _files(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("in/f"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("path"), F.col("event_type").alias("class"), F.col("ts").alias("created"), (F.col("value") / 100).alias("confidence"))


def timestamp_conflicts(spark, d):
    c = conflicts.timestamp_conflicts(_files(spark, d), 1.0)
    return c.select("first_id", F.size("ids").alias("n_files"), F.size("classes").alias("n_classes"), "window_start", "window_end")


def conflict_summary(spark, d):
    c = conflicts.describe(conflicts.timestamp_conflicts(_files(spark, d), 1.0), 1.0)
    return c.select("first_id", "message", "summary")


def conflict_members(spark, d):
    return conflicts.conflict_members(conflicts.timestamp_conflicts(_files(spark, d), 1.0))


def _plan(spark, d) -> DataFrame:
    f = _files(spark, d)
    members = conflicts.conflict_members(conflicts.timestamp_conflicts(f, 1.0))
    return routing.routing_plan(f, "out", 0.5, members)


def sort_routing_plan(spark, d):
    return _plan(spark, d).select("id", "action", "destination")


def sort_summary(spark, d):
    return routing.sort_summary(_plan(spark, d))


def files_per_class(spark, d):
    return routing.files_per_class(_plan(spark, d))


def mru_history(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("at", F.struct("ts", "event_id"))
    h = routing.history(e, ["user_id"], "event_type", "at")
    return h.select("user_id", "query", "position", F.col("used.event_id").alias("event_id"))


def train_val_split_counts(spark, d):
    s = train_validation_split(_files(spark, d), "path", 0.2)
    return s.groupBy("part").agg(F.count("*").alias("n"))


_NAMES = (confusion_matrix, class_metrics, accuracy_summary, timestamp_conflicts, conflict_summary, conflict_members, sort_routing_plan, sort_summary, files_per_class, mru_history, train_val_split_counts)
QUERIES = {f.__name__: f for f in _NAMES}

_L = "WITH p AS (SELECT CAST(quality AS VARCHAR) AS t, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN '2' ELSE CAST(toxic AS VARCHAR) END AS p FROM labels)"
_E = """WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY epoch_us(ts), event_id) AS rn, event_id, epoch_us(ts) AS us, event_type AS c, value FROM events),
w AS (SELECT a.rn, max(b.rn) AS last_rn, count(DISTINCT b.c) AS nc FROM e a JOIN e b ON b.rn >= a.rn AND b.rn <= a.rn + 1000 AND b.us - a.us < 60000000 GROUP BY a.rn),
chain(rn) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT CASE WHEN w.nc > 1 THEN w.last_rn + 1 ELSE chain.rn + 1 END FROM chain JOIN w USING (rn) WHERE (CASE WHEN w.nc > 1 THEN w.last_rn + 1 ELSE chain.rn + 1 END) <= (SELECT max(rn) FROM e)),
g AS (SELECT w.rn, w.last_rn, w.nc FROM chain JOIN w USING (rn) WHERE w.nc > 1),
k AS (SELECT g.rn, e.event_id FROM g JOIN e ON e.rn BETWEEN g.rn AND g.last_rn),
r AS (SELECT e.event_id AS id, e.c, CASE WHEN k.event_id IS NOT NULL THEN 'conflict' WHEN value IS NULL OR e.c IS NULL THEN 'failed' WHEN value / 100 >= 0.5 THEN 'sort' ELSE 'low_confidence' END AS action FROM e LEFT JOIN k USING (event_id))"""
ORACLES = {
    "confusion_matrix": f"{_L} SELECT t AS true_label, p AS predicted, count(*) AS n FROM p WHERE t IN ('0', '1') AND p IN ('0', '1') GROUP BY ALL",
    "class_metrics": f"""{_L}, k AS (SELECT * FROM p WHERE t IN ('0', '1') AND p IN ('0', '1')), m AS (SELECT l AS label, count(*) FILTER (t = l AND p = l) AS tp, count(*) FILTER (t <> l AND p = l) AS fp, count(*) FILTER (t = l AND p <> l) AS fn FROM k, (VALUES ('0'), ('1')) v(l) GROUP BY l),
q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM m)
SELECT label, tp, fp, fn, round(pr, 6)::DOUBLE AS precision, round(re, 6)::DOUBLE AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6)::DOUBLE AS f1 FROM q""",
    "accuracy_summary": f"{_L} SELECT count(*) AS total, count(*) FILTER (t = p) AS correct, round(count(*) FILTER (t = p) / count(*)::DOUBLE, 6) AS accuracy, 0.0::DOUBLE AS loss FROM p",
    "timestamp_conflicts": f"{_E} SELECT a.event_id AS first_id, CAST(g.last_rn - g.rn + 1 AS INTEGER) AS n_files, CAST(g.nc AS INTEGER) AS n_classes, a.us AS window_start, b.us AS window_end FROM g JOIN e a ON a.rn = g.rn JOIN e b ON b.rn = g.last_rn",
    "conflict_summary": f"""{_E}, m AS (SELECT k.rn, e.c, min(e.rn) AS place FROM k JOIN e USING (event_id) GROUP BY k.rn, e.c), n AS (SELECT rn, string_agg(c, ', ' ORDER BY place) AS cs FROM m GROUP BY rn)
SELECT a.event_id AS first_id, 'Timestamp conflict: ' || (g.last_rn - g.rn + 1) || ' images within 1min window predicted as ' || g.nc || ' different classes' AS message,
  'Files created within ' || CAST(floor((b.us - a.us) / 1e6 + 0.5) AS BIGINT) || 's (' || strftime(make_timestamp(a.us), '%H:%M:%S') || ' - ' || strftime(make_timestamp(b.us), '%H:%M:%S') || ') predicted as different classes: [' || n.cs || ']' AS summary
FROM g JOIN e a ON a.rn = g.rn JOIN e b ON b.rn = g.last_rn JOIN n ON n.rn = g.rn""",
    "conflict_members": f"{_E} SELECT a.event_id AS first_id, k.event_id AS id FROM k JOIN e a ON a.rn = k.rn",
    "sort_routing_plan": f"{_E} SELECT id, action, CASE WHEN action = 'sort' THEN 'out/' || c || '/f' || id || '.jpg' END AS destination FROM r",
    "sort_summary": f"{_E} SELECT count(*) AS total, count(*) FILTER (action = 'sort') AS sorted, count(*) FILTER (action <> 'sort') AS skipped, count(*) FILTER (action = 'conflict') AS conflicts_skipped FROM r",
    "files_per_class": f"{_E} SELECT c AS class, count(*) AS n FROM r WHERE action = 'sort' GROUP BY c",
    "mru_history": "WITH l AS (SELECT user_id, event_type, max((ts, event_id)) AS m, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL) SELECT user_id, event_type AS query, CAST(row_number() OVER (PARTITION BY user_id ORDER BY m DESC) AS INTEGER) AS position, event_id FROM l QUALIFY position <= 10",
    "train_val_split_counts": "WITH n AS (SELECT count(*) AS n FROM events) SELECT 'validation' AS part, CAST(floor(n * 0.2) AS BIGINT) AS n FROM n UNION ALL SELECT 'train', CAST(n - floor(n * 0.2) AS BIGINT) FROM n",
}
