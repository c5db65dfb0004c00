"""Library indexes, media files, scripts, transcripts and saved projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspark.config import QUARANTINE_DIR, VIDEO_EXTENSIONS
from mediaspark.functions.text import is_blank, strip
from mediaspark.functions.timecode import to_seconds

INDEX_ENTRY = "map<string,struct<caption:string,width:int,height:int,duration:double,hash:string>>"
TRANSCRIPT = "segments array<struct<words:array<struct<word:string,start:double,end:double>>>>"
TIMELINE = (
    "project_id string, clip_number int, start string, end string, duration double, script string, "
    "asset struct<path:string,source:string,source_id:string,media_type:string,width:int,height:int,duration:double,"
    "score:double,selected_text:string>, placeholder boolean, note string, status string, recommended_effect string, "
    "transition string, generation_attempted boolean, generation_failure_reason string, "
    "alternates array<struct<source:string,source_id:string,download_url:string,media_type:string,width:int,height:int,"
    "duration:double,text:string,score:double>>"
)


def index_entries(indexes: DataFrame, body: str = "body", folder: str = "folder") -> DataFrame:
    """Index maps (one JSON object per folder row) as one row per entry."""
    rows = indexes.select(folder, F.explode(F.from_json(body, INDEX_ENTRY)).alias("name", "e"))
    return rows.select(folder, "name", "e.caption", "e.width", "e.height", "e.duration", "e.hash")


def media_files(spark: SparkSession, root: str) -> DataFrame:
    """Video files under a folder with size and content, quarantine left out.

    The hash and name of a file are expressions on this; the content column is
    read only where it is used.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return video_only(files)


def video_only(files: DataFrame) -> DataFrame:
    kinds = "|".join(VIDEO_EXTENSIONS)
    return files.where(
        F.lower("path").rlike(rf"\.({kinds})$") & ~F.col("path").contains(f"/{QUARANTINE_DIR}/")
    )


def relative_name(path: Column | str, root: str) -> Column:
    """Path below ``root``, whatever scheme the reader put in front."""
    path = F.col(path) if isinstance(path, str) else path
    return F.substring_index(path, root.rstrip("/") + "/", -1)


def scripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) script files: blank ones are rejected."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("script"))
    return rows.where(~is_blank("script")), rows.where(is_blank("script"))


def transcript_words(landed: DataFrame, key: str = "project_id", body: str = "body") -> DataFrame:
    """Words of transcripts in spoken order: key, word_idx, text, start, end."""
    parsed = landed.select(key, F.from_json(body, TRANSCRIPT).alias("t"))
    flat = F.flatten(F.transform("t.segments", lambda s: F.coalesce(s["words"], F.array().cast(
        "array<struct<word:string,start:double,end:double>>"))))
    rows = parsed.select(key, F.posexplode(flat).alias("word_idx", "w"))
    return rows.select(key, "word_idx", strip("w.word").alias("text"), "w.start", "w.end")


def empty_transcripts(landed: DataFrame, key: str = "project_id", body: str = "body") -> DataFrame:
    """Transcripts without a single word."""
    return landed.select(key).join(transcript_words(landed, key, body).select(key).distinct(), key, "left_anti")


def timelines(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    rows = spark.read.schema(TIMELINE).format(fmt).load(path)
    return rows.withColumn("start_s", to_seconds("start")).withColumn("end_s", to_seconds("end"))
