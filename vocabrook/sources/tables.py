"""Intermediate tables that several parts of a plan read."""

from __future__ import annotations

from pyspark.sql import DataFrame


def reused(df: DataFrame) -> DataFrame:
    """df, computed once: a checkpoint in spark.checkpoint.dir, which all executors share; where none is set, a cached table.

    Either survives lost executors: a checkpoint is read again, a cached part is computed again.
    """
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.cache()
