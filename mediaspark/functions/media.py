"""Expressions on media attributes: size, aspect, labels of a beat."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaspark import config as C
from mediaspark.functions.text import col, strip


def parse_resolution(text: Column | str) -> tuple[Column, Column]:
    """Width and height of "WxH"; anything else is (0, 0)."""
    text = col(text)
    width = F.regexp_extract(text, r"^\s*([+-]?\d+)\s*x\s*([+-]?\d+)\s*$", 1).try_cast("int")
    height = F.regexp_extract(text, r"^\s*([+-]?\d+)\s*x\s*([+-]?\d+)\s*$", 2).try_cast("int")
    good = width.isNotNull() & height.isNotNull()
    return F.when(good, width).otherwise(0), F.when(good, height).otherwise(0)


def size_known(width: Column | str, height: Column | str) -> Column:
    return (col(width) > 0) & (col(height) > 0)


def too_low_res(width: Column | str, height: Column | str) -> Column:
    """Check after the file was fetched: unknown sizes fail."""
    return ~size_known(width, height) | (F.least(col(width), col(height)) < C.MIN_DIMENSION)


def known_low_res(width: Column | str, height: Column | str) -> Column:
    """Check before fetching: unknown sizes pass."""
    return size_known(width, height) & (F.least(col(width), col(height)) < C.MIN_DIMENSION)


def _ratio_error(width: Column | str, height: Column | str) -> Column:
    ratio = col(width).cast("double") / F.nullif(col(height).cast("double"), F.lit(0.0))
    return F.abs(ratio - F.lit(16.0) / F.lit(9.0))


def is_landscape(width: Column | str, height: Column | str) -> Column:
    w, h = col(width), col(height)
    return F.when(
        size_known(w, h) & (w > h), _ratio_error(w, h) <= C.RATIO_TOLERANCE
    ).otherwise(F.lit(False))


def known_not_landscape(width: Column | str, height: Column | str) -> Column:
    return size_known(width, height) & ~is_landscape(width, height)


def is_exact_landscape(width: Column | str, height: Column | str) -> Column:
    return F.when(
        size_known(width, height), _ratio_error(width, height) < C.EXACT_RATIO_TOLERANCE
    ).otherwise(F.lit(False))


def fit_plan(width: Column | str, height: Column | str) -> Column:
    """What it takes to bring a file to the frame size."""
    w, h = col(width), col(height)
    return (
        F.when(is_exact_landscape(w, h), F.lit("none"))
        .when(too_low_res(w, h), F.lit("reject"))
        .when(w >= h, F.lit("crop"))
        .otherwise(F.lit("blur_pad"))
    )


def open_licence(url: Column | str) -> Column:
    url = F.coalesce(col(url), F.lit(""))
    return reduce(lambda a, b: a | b, [url.startswith(p) for p in C.OPEN_LICENCES])


def valid_visual_type(visual_type: Column | str) -> Column:
    value = col(visual_type)
    return F.when(value.isin(*C.VISUAL_TYPES), value).otherwise(F.lit(C.DEFAULT_VISUAL_TYPE))


def valid_choice(value: Column | str, allowed: tuple[str, ...], default: str) -> Column:
    value = col(value)
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def pacing(value: Column | str) -> Column:
    return valid_choice(value, ("fast", "medium", "slow"), "medium")


def transition_style(value: Column | str) -> Column:
    return valid_choice(value, TRANSITION_STYLES, DEFAULT_TRANSITION_STYLE)


def media_type(value: Column | str) -> Column:
    return valid_choice(value, ("video", "image"), "video")


def era(visual_type: Column | str) -> Column:
    value = col(visual_type)
    return (
        F.when(value.isin(*C.HISTORICAL_TYPES), F.lit("historical"))
        .when(value.isin(*C.MODERN_TYPES), F.lit("modern"))
        .otherwise(F.lit("general"))
    )


def edit_effect(visual_type: Column | str) -> tuple[Column, Column]:
    value = col(visual_type)

    def pick(position: int) -> Column:
        table = F.create_map(*[F.lit(x) for k, v in C.EDIT_EFFECTS.items() for x in (k, v[position])])
        return F.coalesce(F.try_element_at(table, value), F.lit(C.DEFAULT_EFFECT[position]))

    return pick(0), pick(1)


def boundary(transition: Column | str) -> Column:
    return F.when(F.lower(strip(transition)) == "hard cut", F.lit("hard_cut")).otherwise(F.lit("dissolve"))


def boundary_frames(pace: Column | str, frames: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in C.TRANSITION_FRAMES.items() for x in kv])
    length = F.coalesce(F.try_element_at(table, col(pace)), F.lit(C.TRANSITION_FRAMES["medium"]))
    return F.least(length.cast("long"), F.floor(col(frames) / 2).cast("long"))


def outcome(source: Column | str, placeholder: Column | str, attempted: Column | str, reason: Column | str) -> Column:
    """Label of a resolved beat in the match report."""
    return (
        F.when(col(placeholder) | col(source).isNull(), F.lit("placeholder"))
        .when(col(source) == "ai_generated", F.lit("ai_generated"))
        .when(col(attempted), F.concat(F.lit("real (generation failed: "), F.coalesce(col(reason), F.lit("None")), F.lit(")")))
        .otherwise(F.lit("real"))
    )


def required_speed(source_seconds: Column | str, slot_seconds: Column | str) -> Column:
    return F.when(col(slot_seconds) > 0, col(source_seconds) / col(slot_seconds))


def natural_speed(speed: Column) -> Column:
    return F.coalesce((speed >= C.SPEED_MIN) & (speed <= C.SPEED_MAX), F.lit(False))


def render_status(
    placeholder: Column | str,
    media: Column | str,
    source_seconds: Column | str,
    slot_seconds: Column | str,
    has_fill: Column | str,
) -> Column:
    """How a row fills its slot."""
    src, slot, eps = col(source_seconds), col(slot_seconds), C.DURATION_EPSILON
    stretchable = (src > eps) & (slot > eps) & (F.abs(src - slot) > eps)
    return (
        F.when(col(placeholder), F.lit("missing"))
        .when(col(media) == "image", F.lit("ok"))
        .when(stretchable & natural_speed(required_speed(src, slot)), F.lit("speed-matched"))
        .when((src < slot - eps) & col(has_fill), F.lit("split-fill"))
        .when(src < slot - eps, F.lit("speed-matched"))
        .when(src > slot + eps, F.lit("trimmed"))
        .otherwise(F.lit("ok"))
    )


# Transition styles of a whole video and the default one.
TRANSITION_STYLES = ("fade", "slide", "zoom", "hard_cut")
DEFAULT_TRANSITION_STYLE = "fade"
