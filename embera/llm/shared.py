"""What the corpus operators share: cutting lineage, and reading tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_folder, checkpointed

__all__ = ["checkpoint_folder", "checkpointed", "small_batches", "table", "tokenizer_file"]

#: Bytes of rows in one Arrow batch, about.
BATCH_BYTES = 4 << 20
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding what its session sends to Python at once.

    Spark's default is 10,000 rows or 64 MB a batch, which a batch of texts fills, several
    times over in buffers and copies. BATCH_BYTES keeps that small whatever the texts' length
    (one longer text is a batch of its own). A session that names a size keeps its own.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH, _DEFAULT) == _DEFAULT:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> bytes:
    """The bytes of a public vocabulary file, read on the driver (about 1 MB, whatever the corpus)."""
    if folder is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    else:
        path = os.path.join(folder, name)
    with open(path, "rb") as f:
        return f.read()
