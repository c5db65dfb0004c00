"""Writers of timelines, reports and captions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark.functions import media
from mediaspark.functions.timecode import to_frames
from mediaspark.operators import captions, reports


def write_timeline(rows: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One folder per project.  Rows are clustered by range, so a long project
    is written by several tasks and a short one by one."""
    placed = rows.repartitionByRange(F.col("project_id"), F.col("clip_number"))
    placed.sortWithinPartitions("project_id", "clip_number").write.mode(mode).partitionBy("project_id").format(fmt).save(path)


def write_report(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def write_lines(lines: DataFrame, path: str, order: list[str], text: str = "line", mode: str = "overwrite") -> None:
    """Text files per project, the lines in order over the part files."""
    placed = lines.repartitionByRange(F.col("project_id"), *[F.col(c) for c in order])
    placed = placed.sortWithinPartitions("project_id", *order).select("project_id", F.col(text).alias("value"))
    placed.write.mode(mode).partitionBy("project_id").text(path)


def write_srt(cues: DataFrame, path: str, longest: int | None = None) -> None:
    """Subtitle files; ``cues`` comes from ``captions.cues``."""
    numbered = captions.number_cues(cues, longest=longest)
    blocks = numbered.withColumn("block", captions.srt_block(F.col("cue_no"), "start_s", "end_s", "cue_text"))
    write_lines(blocks, path, ["cue_no"], "block")


def write_timeline_table(rows: DataFrame, path: str) -> None:
    write_lines(reports.timeline_lines(rows), path, ["clip_number"])


def render_segments_json(rows: DataFrame) -> DataFrame:
    """Render plan of every segment as a JSON object; ``rows`` has the frame
    bounds, effect, transition and media type of each beat."""
    body = F.to_json(F.struct(
        F.col("clip_number").alias("clipNumber"), F.col("path"), F.col("start_frame").alias("startFrame"),
        F.col("duration_frames").alias("durationInFrames"), F.col("effect"),
        F.coalesce("media_type", F.lit("image")).alias("mediaType"), media.boundary("transition").alias("transition"),
    ))
    return rows.select("project_id", "clip_number", body.alias("segment"))


def render_words_json(words: DataFrame) -> DataFrame:
    """Caption words in frames as JSON objects; ``words`` from ``word_timings``."""
    first = to_frames("word_start")
    body = F.to_json(F.struct(
        F.col("word").alias("text"), first.alias("startFrame"),
        F.greatest(F.lit(1).cast("long"), to_frames("word_end") - first).alias("durationInFrames"),
    ))
    return words.select("project_id", "clip_number", "pos", body.alias("word"))
