"""Small helpers of the operators in this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspark.session import ensure_checkpoint_dir

#: Java pattern of a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder in the place that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def file_system(path: str):
    """(file system, path in it) as Arrow reads and writes it in tasks."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once below the checkpoint folder and read back."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of the bitmap of known hashes: 8 MB, whatever the input.
SLOTS = 1 << 26


def told_apart(rows: DataFrame, value: Column, known: DataFrame, known_value: Column) -> tuple[DataFrame, DataFrame]:
    """(the rows whose value surely is none of the known ones, all others).

    Values are hashes (bigint).  The known ones are set in a bitmap of fixed
    size, which is broadcast; so rows can be left in place where a join would
    shuffle them all, and only the others need the join.
    """
    slot = lambda v: F.pmod(v, F.lit(SLOTS)) + 1
    place = lambda v: (F.bitmap_bucket_number(slot(v)).alias("told_bucket"), F.bitmap_bit_position(slot(v)).alias("told_bit"))
    bits = known.select(*place(known_value)).groupBy("told_bucket").agg(F.bitmap_construct_agg("told_bit").alias("told_bits"))
    bucket, bit = place(value)
    # at most SLOTS / 32768 rows of 4 KB
    marked = rows.withColumns({"told_bucket": bucket, "told_bit": bit}).join(F.broadcast(stored(bits, "bits")), "told_bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(told_bits, int(told_bit div 8) + 1, 1)")), 16, 10).cast("int")
    marked = marked.withColumn("told", F.coalesce(F.getbit(byte, (F.col("told_bit") % 8).cast("int")) == 1, F.lit(False)))
    extra = ("told_bucket", "told_bit", "told_bits", "told")
    return marked.where("not told").drop(*extra), marked.where("told").drop(*extra)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(df: DataFrame, order: list[str], sums: dict[str, Column], label: str) -> DataFrame:
    """Adds running sums (inclusive) over all rows in the given order.

    Rows are dealt by ranges of the order and stored with their part number, so
    the sums before a part are a window over one row per part; only the sums
    within a part need the rows, and a part is as small as a shuffle partition.
    """
    from pyspark.sql import Window as W

    keys = [F.col(c).asc_nulls_first() for c in order]
    parted = df.withColumns({f"_in_{k}": v for k, v in sums.items()})
    parted = stored(parted.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), label)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = parted.groupBy("_part").agg(*[F.sum(f"_in_{k}").alias(f"_of_{k}") for k in sums])
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_of_{k}").over(before), F.lit(0)).alias(f"_to_{k}") for k in sums])
    within = W.partitionBy("_part").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    inside = parted.withColumns({k: F.sum(f"_in_{k}").over(within) for k in sums})
    # one row per part: as many as shuffle partitions
    out = inside.join(F.broadcast(totals), "_part").withColumns({k: F.col(k) + F.col(f"_to_{k}") for k in sums})
    return out.drop("_part", *[f"_in_{k}" for k in sums], *[f"_to_{k}" for k in sums])
