"""Intermediate tables written once and read back.

Used where several branches of a job read the same costly intermediate: the
plan is cut there, later reads prune columns, and a lost executor costs a
re-read instead of a recomputation of everything upstream.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from mediaspark.session import ensure_checkpoint_dir


def written(df: DataFrame, label: str = "part") -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
