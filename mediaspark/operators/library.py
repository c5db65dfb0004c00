"""Library records: lookups and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark.plans.skew import salted_join


def known_assets(winners: DataFrame, records: DataFrame, spread: list[str]) -> DataFrame:
    """The library record of a chosen asset: by (source, source_id), else by
    fingerprint; blank keys never match.  Adds ``record_id`` and ``matched_by``.

    ``records``: id, source, source_id, fingerprint.
    """
    by_id = (
        records.where(F.coalesce("source_id", F.lit("")) != "")
        .groupBy("source", "source_id").agg(F.min("id").alias("_by_id"))
    )
    by_print = (
        records.where(F.coalesce("fingerprint", F.lit("")) != "")
        .groupBy("fingerprint").agg(F.min("id").alias("_by_print"))
    )
    found = salted_join(winners, by_id, ["source", "source_id"], "left", spread=spread)
    found = salted_join(found, by_print, ["fingerprint"], "left", spread=spread)
    matched = F.when(F.col("_by_id").isNotNull(), F.lit("source")).when(
        F.col("_by_print").isNotNull(), F.lit("fingerprint")
    )
    return (
        found.withColumn("record_id", F.coalesce("_by_id", "_by_print"))
        .withColumn("matched_by", matched)
        .drop("_by_id", "_by_print")
    )


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Records after a merge: the newest version of every id wins."""
    every = existing.unionByName(incoming, allowMissingColumns=True)
    rest = [c for c in every.columns if c != key]
    newest = every.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r"))
    return newest.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
