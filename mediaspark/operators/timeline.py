"""Timing of beats.  All running computations use block scans, so a project of
any length is spread over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark import config as C
from mediaspark.functions.text import words
from mediaspark.functions.timecode import code_pair, span_seconds, to_frames, to_seconds
from mediaspark.plans.skew import BLOCK, block_scan

PROJECT = ("project_id",)


def pace_timing(beats: DataFrame, longest: int | None = None, block: int = BLOCK) -> DataFrame:
    """Start and end of every beat from its word count, one after the other."""
    length = F.greatest(
        F.lit(C.MIN_CLIP_SECONDS),
        F.least(F.lit(C.MAX_CLIP_SECONDS), F.coalesce("word_count", F.lit(0)).cast("double") / C.WORDS_PER_SECOND),
    )
    timed = block_scan(beats.withColumn("_d", length), PROJECT, "clip_number", {"start_s": ("sum", F.col("_d"))}, longest=longest, block=block)
    timed = timed.withColumn("start_s", F.col("start_s").cast("double"))
    timed = timed.withColumn("end_s", F.col("start_s") + F.col("_d")).drop("_d")
    start, end = code_pair("start_s", "end_s")
    return timed.withColumn("start", start).withColumn("end", end)


def floor_cascade(spans: DataFrame, longest: int | None = None, block: int = BLOCK) -> DataFrame:
    """Spoken spans with minimum lengths: no row starts before the previous
    one ends, none is shorter than the floor, and rows behind the end of the
    transcript get a fixed length.

    The recurrence end[i] = max(m[i], end[i-1] + inc[i]) is solved with two
    scans: W = running sum of inc, end = W + max(0, running max of m - W).
    """
    rows = spans.withColumn("_inc", F.when(F.col("exhausted"), C.EXHAUSTED_SECONDS).otherwise(C.MIN_SPOKEN_SECONDS))
    rows = rows.withColumn(
        "_m", F.when(~F.col("exhausted"), F.greatest("span_end", F.col("span_start") + C.MIN_SPOKEN_SECONDS))
    )
    rows = block_scan(rows, PROJECT, "clip_number", {"_w0": ("sum", F.col("_inc"))}, longest=longest, block=block)
    rows = rows.withColumn("_lift", F.col("_m") - (F.col("_w0") + F.col("_inc")))
    rows = block_scan(rows, PROJECT, "clip_number", {"_top": ("max", F.col("_lift"))}, longest=longest, block=block)
    previous = F.col("_w0") + F.greatest(F.lit(0.0), F.coalesce("_top", F.lit(0.0)))
    end = F.col("_w0") + F.col("_inc") + F.greatest(F.lit(0.0), F.coalesce("_top", F.lit(0.0)), F.coalesce("_lift", F.lit(0.0)))
    start = F.when(F.col("exhausted"), previous).otherwise(F.greatest("span_start", previous))
    return rows.withColumn("start_s", start.cast("double")).withColumn("end_s", end.cast("double")).drop(
        "_inc", "_m", "_w0", "_lift", "_top"
    )


def with_codes(rows: DataFrame) -> DataFrame:
    start, end = code_pair("start_s", "end_s")
    return rows.withColumn("start", start).withColumn("end", end)


def force_contiguity(rows: DataFrame, order: tuple[str, ...] = (), longest: int | None = None, block: int = BLOCK) -> DataFrame:
    """Every row starts where the previous one ends (ends never move)."""
    rows = block_scan(rows, PROJECT, "clip_number", previous={"_prev_end": F.col("end")}, order=order, longest=longest, block=block)
    return rows.withColumn("start", F.coalesce("_prev_end", "start")).drop("_prev_end")


def contiguity_violations(rows: DataFrame, longest: int | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs of neighbours where one does not start at the end of the other."""
    before = F.struct(F.col("clip_number"), F.col("end"))
    rows = block_scan(rows, PROJECT, "clip_number", previous={"_before": before}, longest=longest, block=block)
    return rows.where(F.col("_before.end") != F.col("start")).select(
        "project_id", F.col("_before.clip_number").alias("clip_number"), F.col("_before.end").alias("end"),
        F.col("clip_number").alias("next_clip_number"), F.col("start").alias("next_start"),
    )


def split_long_rows(
    rows: DataFrame, limit: float = C.MAX_ON_SCREEN_SECONDS, longest: int | None = None, block: int = BLOCK
) -> DataFrame:
    """Cuts rows longer than ``limit`` into equal parts, each with its share
    of the words, and numbers the rows anew."""
    rows = rows.withColumn("_d", span_seconds("start", "end"))
    rows = rows.withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("_d") / limit)).cast("int"))
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    begin = to_seconds("start").cast("double")
    chunk = F.col("_d") / F.col("_n")
    last = F.col("_i") == F.col("_n") - 1
    start, end = code_pair(
        begin + F.col("_i") * chunk,
        F.when(last, to_seconds("end").cast("double")).otherwise(begin + (F.col("_i") + 1) * chunk),
    )
    word_list = words("script_beat")
    per = F.ceil(F.size("_words") / F.col("_n")).cast("int")
    piece = F.array_join(F.slice("_words", F.col("_i") * F.greatest(per, F.lit(1)) + 1, F.greatest(per, F.lit(1))), " ")
    text = F.when((F.size("_words") < F.col("_n")) | (piece == ""), F.col("script_beat")).otherwise(piece)
    single = F.col("_n") == 1
    rows = rows.withColumn("_words", word_list)
    rows = rows.withColumn("_s", F.when(single, F.col("start")).otherwise(start))
    rows = rows.withColumn("_e", F.when(single, F.col("end")).otherwise(end))
    rows = rows.withColumn("script_beat", F.when(single, F.col("script_beat")).otherwise(text))
    rows = rows.withColumn("start", F.col("_s")).withColumn("end", F.col("_e"))
    rows = rows.withColumn("part", F.col("_i") + 1).drop("_words", "_s", "_e", "_d", "_n", "_i")
    rows = block_scan(rows, PROJECT, "clip_number", {"_before": ("count", F.lit(1))}, order=("part",), longest=longest, block=block)
    return (
        rows.withColumnRenamed("clip_number", "parent_clip")
        .withColumn("clip_number", (F.col("_before") + 1).cast("int"))
        .drop("_before")
    )


def word_timings(rows: DataFrame, text: str = "script_beat") -> DataFrame:
    """Words of every row, spread evenly over it.  Blank rows and rows without
    length have none."""
    start, end = to_seconds("start").cast("double"), to_seconds("end").cast("double")
    kept = rows.withColumn("_words", words(text)).where((F.size("_words") > 0) & (end > start))
    per = (end - start) / F.size("_words")
    out = kept.select(
        "project_id", "clip_number", F.size("_words").alias("n_words"), start.alias("_s"), end.alias("_e"),
        per.alias("_per"), F.posexplode("_words").alias("pos", "word"),
    )
    return out.select(
        "project_id", "clip_number", "n_words", "pos", "word",
        F.least(F.col("_e"), F.col("_s") + F.col("pos") * F.col("_per")).alias("word_start"),
        F.least(F.col("_e"), F.col("_s") + (F.col("pos") + 1) * F.col("_per")).alias("word_end"),
    )


def frame_bounds(rows: DataFrame) -> DataFrame:
    """Frames of every row from its absolute start and end."""
    first, last = to_frames(to_seconds("start")), to_frames(to_seconds("end"))
    return rows.withColumn("start_frame", first).withColumn(
        "duration_frames", F.greatest(F.lit(1).cast("long"), last - first)
    )


def total_frames(framed: DataFrame) -> DataFrame:
    """Length of a project: the end of its last row."""
    end = F.col("start_frame") + F.col("duration_frames")
    return framed.groupBy("project_id").agg(F.max_by(end, F.col("clip_number")).alias("total_frames"))


def duration_totals(rows: DataFrame) -> DataFrame:
    """Frames and seconds of a project as sums over its rows."""
    return rows.groupBy("project_id").agg(
        F.sum(to_frames("duration")).alias("total_frames"), F.sum("duration").alias("total_seconds")
    )


def tail_gap(words_spoken: DataFrame, rows: DataFrame, epsilon: float = C.TAIL_EPSILON) -> DataFrame:
    """Projects whose narration runs on after the last row.

    ``words_spoken``: project_id, n_words, audio_end; ``rows``: project_id,
    end_s, n_words (words given to the row)."""
    covered = rows.groupBy("project_id").agg(F.max("end_s").alias("last_end"), F.sum("n_words").alias("used"))
    out = words_spoken.join(covered, "project_id", "left")
    gap = F.col("audio_end") - F.coalesce("last_end", F.lit(0.0))
    left = F.col("n_words") - F.coalesce("used", F.lit(0))
    return out.select(
        "project_id", gap.alias("uncovered_seconds"), F.greatest(left, F.lit(0)).alias("unused_words"),
        ((gap > epsilon) & (left > 0)).alias("needs_rows"),
    )

