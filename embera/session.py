"""Session settings the engine relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and base64 without line breaks."""
    b = SparkSession.builder.appName("embera")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.chunkBase64String.enabled": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> None:
    """Name the folder of checkpoints to Spark: the one in spark.checkpoint.dir, which all executors share.

    Only a local session that names none gets a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="embera-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the checkpoint folder, so that the rows outlive a lost executor."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
