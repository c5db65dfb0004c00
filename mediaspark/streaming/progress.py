"""Progress events: last state per project and call rates, batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediaspark.config import CALLS_PER_MINUTE


def latest_state(events: DataFrame, done_stage: str = "purchase", error_stage: str = "error") -> DataFrame:
    """Last stage per project; works on a batch and, in update or complete
    mode, on a stream.  Only partial maxima are shuffled."""
    return events.groupBy("project").agg(
        F.max_by("stage", F.struct("updated_at", "event_id")).alias("stage"),
        F.max("updated_at").alias("updated_at"),
        F.count("*").alias("updates"),
        F.max(F.col("stage") == done_stage).alias("done"),
        F.max(F.when(F.col("stage") == error_stage, F.col("event_id"))).alias("last_error"),
    )


def trailing_calls(events: DataFrame, seconds: int = 60, limit: int = CALLS_PER_MINUTE) -> DataFrame:
    """Calls of a project in the ``seconds`` up to each call.

    Time is cut into buckets of the window's length; a call only looks at its
    own and the previous bucket.  Every call is copied into the next bucket,
    where it counts but is not reported, so the window runs inside
    (project, bucket) and a busy project is spread over its buckets.
    """
    micros = F.unix_micros(F.col("updated_at").cast("timestamp"))
    span = seconds * 1_000_000
    rows = events.select("project", "event_id", "updated_at", micros.alias("_t"))
    own = F.floor(F.col("_t") / span).cast("long")
    copies = rows.withColumn("_shift", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_bucket", own + F.col("_shift"))
    window = W.partitionBy("project", "_bucket").orderBy("_t").rangeBetween(-span, 0)
    counted = copies.withColumn("calls", F.count("*").over(window)).where(F.col("_shift") == 0)
    return counted.select(
        "project", "event_id", "updated_at", "calls", (F.col("calls") > limit).alias("over_limit")
    )


def windowed_calls(events: DataFrame, length: str = "60 seconds", slide: str = "10 seconds",
                   delay: str = "5 minutes", limit: int = CALLS_PER_MINUTE) -> DataFrame:
    """Stream form: calls per project and sliding window, late calls dropped
    after ``delay``."""
    counts = (
        events.withWatermark("updated_at", delay)
        .groupBy("project", F.window("updated_at", length, slide))
        .agg(F.count("*").alias("calls"))
    )
    return counts.select(
        "project", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "calls",
        (F.col("calls") > limit).alias("over_limit"),
    )
