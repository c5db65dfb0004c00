"""Library index that grows with the files that arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mediaspark.operators.dedup import content_hash, index_plan
from mediaspark.sources.library import relative_name, video_only

INDEX = "name string, hash string, size bigint, duplicate_of string, status string, batch bigint"


def arriving_files(spark: SparkSession, root: str) -> DataFrame:
    """Stream of video files below ``root`` with their content hash."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true").load(root)
    )
    named = video_only(files).select(relative_name("path", root).alias("name"), F.col("length").alias("size"), "content")
    return content_hash(named).drop("content")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def _store(path: str):
    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
        # a batch that is run again must not see what it wrote the first time
        known = read_index(spark, path).where(F.col("batch") < number) if there else spark.createDataFrame([], INDEX)
        indexed = known.where(F.col("status") == "indexed")
        new = rows.join(known.select("name"), "name", "left_anti").dropDuplicates(["name"])
        planned = index_plan(new, indexed.select("name", "hash"))
        planned.select("name", "hash", "size", "duplicate_of", "status").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return batch


def index_arrivals(files: DataFrame, index_path: str, checkpoint: str) -> StreamingQuery:
    """Indexes everything that has arrived and stops.  A file seen before is
    skipped, a copy of an indexed file is recorded as a duplicate, and each
    batch overwrites only its own folder, so a repeated batch is harmless."""
    return (
        files.writeStream.foreachBatch(_store(index_path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
