"""Second, frame and time-code arithmetic.  Rounding is half-to-even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaspark.config import FPS
from mediaspark.functions.text import col


def half_even(value: Column | str) -> Column:
    return F.rint(col(value)).cast("long")


def to_seconds(code: Column | str) -> Column:
    parts = F.split(col(code), ":")
    return (
        parts[0].cast("long") * 3600 + parts[1].cast("long") * 60 + parts[2].cast("long")
    )


def span_seconds(start: Column | str, end: Column | str) -> Column:
    return (to_seconds(end) - to_seconds(start)).cast("double")


def _code(total: Column) -> Column:
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(total / 3600).cast("long"),
        F.floor(total % 3600 / 60).cast("long"),
        total % 60,
    )


def to_code(seconds: Column | str) -> Column:
    return _code(half_even(seconds))


def code_pair(start: Column | str, end: Column | str) -> tuple[Column, Column]:
    """Start and end codes of one row; a real gap never rounds to nothing."""
    start, end = col(start), col(end)
    first, last = half_even(start), half_even(end)
    return _code(first), _code(F.when((end > start) & (first == last), first + 1).otherwise(last))


def srt_code(seconds: Column | str) -> Column:
    ms = half_even(col(seconds) * 1000)
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        F.floor(ms / 3600000).cast("long"),
        F.floor(ms % 3600000 / 60000).cast("long"),
        F.floor(ms % 60000 / 1000).cast("long"),
        ms % 1000,
    )


def to_frames(seconds: Column | str, fps: int = FPS) -> Column:
    return half_even(col(seconds) * fps)
