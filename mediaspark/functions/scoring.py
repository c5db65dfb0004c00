"""Relevance score of a candidate for a beat, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaspark import config as C
from mediaspark.functions.text import col, is_blank
from mediaspark.functions.vectors import clamped_cosine

# Rarity weights are kept as integers (units of 1e-9) so that sums of weights,
# and with them ties, do not depend on the order of addition.
WEIGHT_UNIT = 1_000_000_000
SPELLED_TOKENS = 4


def rarity(frequency: Column | str) -> Column:
    """Weight of a word by its corpus frequency; unknown words weigh 1."""
    frequency = col(frequency)
    value = F.least(F.lit(1.0), -F.log10(frequency) / C.RARITY_CEILING)
    return (
        F.when(frequency > 0, F.rint(value * WEIGHT_UNIT).cast("long"))
        .otherwise(F.lit(WEIGHT_UNIT).cast("long"))
    )


def matched_weight(weighted: Column | str, tokens: Column | str) -> Column:
    """Weight of the query tokens (array of struct(token, w)) found in a text.

    Phrases have a few words; those are spelled out, as a plain array_contains
    is compiled and a lambda is not.  Longer ones go through the lambda.
    """
    nothing = F.lit(0).cast("long")
    spelled = nothing
    for i in range(SPELLED_TOKENS):
        item = F.get(col(weighted), F.lit(i))
        found = (F.size(col(weighted)) > i) & F.array_contains(col(tokens), item["token"])
        spelled = spelled + F.when(found, item["w"]).otherwise(nothing)
    general = F.aggregate(
        F.filter(col(weighted), lambda s: F.array_contains(col(tokens), s["token"])),
        nothing,
        lambda total, s: total + s["w"],
    )
    return F.when(F.size(col(weighted)) <= SPELLED_TOKENS, spelled).otherwise(general)


def total_weight(weighted: Column | str) -> Column:
    return F.aggregate(col(weighted), F.lit(0).cast("long"), lambda total, s: total + s["w"])


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def semantic(text: Column | str, a: Column | str, b: Column | str) -> Column:
    """Clamped cosine; a candidate without text is neutral."""
    return F.when(F.coalesce(col(text), F.lit("")) == "", F.lit(0.5)).otherwise(clamped_cosine(a, b))


def era_fit(source: Column | str, visual_type: Column | str) -> Column:
    archive = col(source).isin(*C.ARCHIVE_SOURCES)
    historical = col(visual_type).isin(*C.HISTORICAL_TYPES)
    return F.when(archive & historical, F.lit(1.0)).when(archive | historical, F.lit(0.6)).otherwise(F.lit(0.5))


def quality(width: Column | str, height: Column | str) -> Column:
    pixels = col(width).cast("double") * col(height).cast("double")
    return F.least(F.lit(1.0), pixels / float(C.FRAME_WIDTH * C.FRAME_HEIGHT))


def cinematic(media: Column | str, width: Column | str, height: Column | str) -> Column:
    base = F.when(col(media) == "video", F.lit(0.8)).otherwise(F.lit(0.4))
    return F.least(F.lit(1.0), base + F.lit(0.2) * quality(width, height))


def motion(media: Column | str) -> Column:
    return F.when(col(media) == "video", F.lit(1.0)).otherwise(F.lit(0.0))


def duration_fit(media: Column | str, duration: Column | str) -> Column:
    return F.when((col(media) != "video") | (col(duration) <= 0), F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), col(duration) / C.COMFORTABLE_VIDEO_SECONDS)
    )


def total_score(
    semantic_value: Column,
    keyword_value: Column,
    source: str = "source",
    visual_type: str = "visual_type",
    media: str = "media_type",
    width: str = "width",
    height: str = "height",
    duration: str = "duration",
) -> Column:
    w = C.WEIGHTS
    total = (
        w["semantic"] * semantic_value
        + w["keyword"] * keyword_value
        + w["era"] * era_fit(source, visual_type)
        + w["quality"] * quality(width, height)
        + w["cinematic"] * cinematic(media, width, height)
        + w["motion"] * motion(media)
        + w["duration"] * duration_fit(media, duration)
    )
    score = F.rint(total * 10000.0) / 100.0
    return F.when(
        col(source) == C.LIBRARY_SOURCE, F.least(F.lit(100.0), score + C.LIBRARY_BONUS)
    ).otherwise(score)


def media_bias(images: Column | str, videos: Column | str) -> Column:
    """Bonus an image gets for ordering (a video gets its negative)."""
    total = col(images) + col(videos)
    current = F.when(total == 0, F.lit(C.TARGET_IMAGE_RATIO)).otherwise(
        col(images).cast("double") / total.cast("double")
    )
    return F.greatest(
        F.lit(-C.MEDIA_BIAS_CAP),
        F.least(F.lit(C.MEDIA_BIAS_CAP), (C.TARGET_IMAGE_RATIO - current) * C.MEDIA_BIAS_SLOPE),
    )


def blank_text(text: Column | str) -> Column:
    return is_blank(text)
