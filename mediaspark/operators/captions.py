"""Caption lines, cues and subtitle text."""

from __future__ import annotations

import textwrap
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspark import config as C
from mediaspark.functions.text import caption_word, is_blank, strip
from mediaspark.functions.timecode import srt_code, to_frames, to_seconds
from mediaspark.plans.skew import BLOCK, block_scan

FRAME_BUCKET = 900
# Texts that are wrapped at once.
WRAPPED_TEXTS = 256


def caption_lines(
    words: DataFrame, size: int = C.WORDS_PER_CAPTION_LINE, longest: int | None = None, block: int = BLOCK
) -> DataFrame:
    """Lines of ``size`` words that run across row borders.

    ``words`` comes from ``word_timings``.  The place of a word in its project
    is the running word count of the rows before plus its place in the row, so
    the words themselves are never sorted per project.
    """
    counts = words.where(F.col("pos") == 0).select("project_id", "clip_number", "n_words")
    offsets = block_scan(counts, ("project_id",), "clip_number", {"offset": ("sum", F.col("n_words"))}, longest=longest, block=block)
    placed = words.join(offsets.select("project_id", "clip_number", "offset"), ["project_id", "clip_number"])
    placed = placed.withColumn("_place", F.col("offset") + F.col("pos"))
    placed = placed.withColumn("line_no", F.floor(F.col("_place") / size).cast("long"))
    placed = placed.withColumn("_sf", to_frames("word_start")).withColumn("_ef", to_frames("word_end"))
    placed = placed.withColumn("_end", F.col("_sf") + F.greatest(F.lit(1).cast("long"), F.col("_ef") - F.col("_sf")))
    # a group here is one line: at most ``size`` words
    return placed.groupBy("project_id", "line_no").agg(
        F.min_by("_sf", "_place").alias("start_frame"),
        F.max_by("_end", "_place").alias("end_frame"),
        F.min_by("word_start", "_place").alias("start_s"),
        F.max_by("word_end", "_place").alias("end_s"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_place", "word"))), lambda s: s["word"]), " ")
        .alias("line"),
    )


def active_line(frames: DataFrame, lines: DataFrame, bucket: int = FRAME_BUCKET) -> DataFrame:
    """The line on screen at a frame: start <= frame < end, first line wins.

    A range join: lines are copied into every time bucket they touch, frames
    fall into one bucket, and the two meet on (project, bucket).
    """
    spread = lines.withColumn(
        "_bucket",
        F.explode(
            F.sequence(
                F.floor(F.col("start_frame") / bucket).cast("long"),
                F.floor(F.greatest(F.col("start_frame"), F.col("end_frame") - 1) / bucket).cast("long"),
            )
        ),
    )
    asked = frames.withColumn("_bucket", F.floor(F.col("frame") / bucket).cast("long"))
    hit = asked.join(spread, ["project_id", "_bucket"]).where(
        (F.col("start_frame") <= F.col("frame")) & (F.col("frame") < F.col("end_frame"))
    )
    return hit.groupBy("project_id", "frame").agg(
        F.min("line_no").alias("line_no"), F.min_by("line", "line_no").alias("line")
    )


def emphasised(words: DataFrame, emphasis: DataFrame) -> DataFrame:
    """Flags the words of a project's emphasis list (project_id, word)."""
    wanted = emphasis.select("project_id", F.lower("word").alias("_clean"), F.lit(True).alias("emphasised")).distinct()
    flagged = words.withColumn("_clean", caption_word("word")).join(wanted, ["project_id", "_clean"], "left")
    return flagged.withColumn(
        "emphasised", F.coalesce("emphasised", F.lit(False)) & (F.col("_clean") != "")
    ).drop("_clean")


def _wrap(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Lines of at most the caption width, by the rules of the standard
    library's text wrapping (long words broken, breaks after hyphens).  A batch
    is taken a few texts at a time, so that its lines are never all held."""
    wrapper = textwrap.TextWrapper(width=C.CAPTION_WIDTH)
    for texts in batches:
        for first in range(0, len(texts), WRAPPED_TEXTS):
            part = texts.slice(first, WRAPPED_TEXTS).to_pylist()
            yield pa.array([None if t is None else wrapper.wrap(t) or [t] for t in part], pa.list_(pa.string()))


def wrap_lines(text: Column) -> Column:
    """The lines a text is wrapped into."""
    return F.arrow_udf(_wrap, "array<string>")(text)


def cues(rows: DataFrame, text: str = "script_beat", lines_per_cue: int = C.CAPTION_LINES) -> DataFrame:
    """Two-line caption cues; a row's time is shared out by words."""
    begin, finish = to_seconds("start").cast("double"), to_seconds("end").cast("double")
    kept = rows.where(~is_blank(text) & (finish > begin))
    kept = kept.select(
        "project_id", "clip_number", begin.alias("_s"), finish.alias("_e"), wrap_lines(strip(text)).alias("_lines")
    )
    starts = F.sequence(F.lit(1), F.size("_lines"), F.lit(lines_per_cue))
    chunks = F.transform(starts, lambda i: F.array_join(F.slice("_lines", i, lines_per_cue), "\n"))
    counts = F.transform("_chunks", lambda c: F.greatest(F.lit(1), F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))))
    kept = kept.withColumn("_chunks", chunks).withColumn("_counts", counts)
    total = F.aggregate("_counts", F.lit(0), lambda a, n: a + n)
    kept = kept.withColumn("_total", total)

    def upto(count: Column) -> Column:
        done = F.aggregate(F.slice("_counts", 1, count), F.lit(0), lambda a, n: a + n)
        share = (F.col("_e") - F.col("_s")) * (done.cast("double") / F.col("_total"))
        return F.least(F.col("_e"), F.col("_s") + share)

    # every text has a line; a plain explode is preceded by a filter on its array, for which Spark would wrap all texts once more
    out = kept.select("*", F.posexplode_outer("_chunks").alias("part", "cue_text"))
    return out.select(
        "project_id", "clip_number", "part",
        F.when(F.col("part") == 0, F.col("_s")).otherwise(upto(F.col("part"))).alias("start_s"),
        upto(F.col("part") + 1).alias("end_s"),
        "cue_text",
    )


def number_cues(cue_rows: DataFrame, longest: int | None = None, block: int = BLOCK) -> DataFrame:
    """1-based number of every cue within its project."""
    counted = block_scan(
        cue_rows, ("project_id",), "clip_number", {"_before": ("count", F.lit(1))}, order=("part",), longest=longest, block=block
    )
    return counted.withColumn("cue_no", (F.col("_before") + 1).cast("long")).drop("_before")


def srt_block(number: Column, start: Column | str, end: Column | str, text: Column | str) -> Column:
    """One numbered subtitle block, closed by a blank line."""
    text = F.col(text) if isinstance(text, str) else text
    return F.concat(number.cast("string"), F.lit("\n"), srt_code(start), F.lit(" --> "), srt_code(end), F.lit("\n"),
                    text, F.lit("\n"))
