"""Registered queries: key -> (spark, folder) -> DataFrame, and their SQL for an independent check."""

from . import cache, evaluation, text, vectors

QUERIES = vectors.QUERIES | cache.QUERIES | evaluation.QUERIES | text.QUERIES
ORACLES = vectors.ORACLES | cache.ORACLES | evaluation.ORACLES | text.ORACLES
