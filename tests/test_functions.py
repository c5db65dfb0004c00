"""Scalar expressions against plain values."""

import random
import re
import textwrap
import time

import pytest
from pyspark.sql import functions as F

from mediaspark.functions import media, scoring, text, timecode
from mediaspark.operators import terms


def one(spark, *columns, **values):
    cells = [(F.lit(v) if v is not None else F.lit(None).cast("string")).alias(k) for k, v in values.items()]
    return tuple(spark.range(1).select(*cells).select(*columns).first())


@pytest.mark.parametrize("phrase, tokens", [
    ("The Tennis player, serving!", ["tennis", "player", "serving"]),
    ("a  an\tx  — pool–side pool", ["poolside", "pool"]),
    ("  ", []),
])
def test_overlap_tokens(spark, phrase, tokens):
    assert one(spark, text.overlap_tokens("t"), t=phrase)[0] == tokens


def test_words_split_on_wide_spaces(spark):
    assert one(spark, text.words("t"), t="a b c\n d\x1ce ")[0] == "a b c\n d\x1ce ".split()


@pytest.mark.parametrize("url, slug", [
    ("https://x.example/video/semi-truck-climbing-a-mountain-18749833/", "semi truck climbing a mountain"),
    ("https://x.example/video/plain", "plain"),
    ("", ""),
])
def test_url_slug(spark, url, slug):
    assert one(spark, text.url_slug("u"), u=url)[0] == slug


@pytest.mark.parametrize("caption, slug", [
    ("Muscular Bodybuilder: flexing, in the gym today!", "muscular_bodybuilder_flexing_in_the_gym"),
    ("already_a_slug", "already_a_slug"),
    ("???", "clip"),
])
def test_caption_slug(spark, caption, slug):
    assert one(spark, text.caption_slug("c"), c=caption)[0] == slug


@pytest.mark.parametrize("project, name", [
    ("project_1700000000", "final_video_with_narration.mp4"),
    ("Some Name: A Recap!", "Some_Name_A_Recap!.mp4"),
    ("???", "final_video_with_narration.mp4"),
])
def test_final_video_name(spark, project, name):
    assert one(spark, text.final_video_name("p"), p=project)[0] == name


@pytest.mark.parametrize("url, kind, ext", [
    ("https://x/a/clip.mov?token=1.2", "video", ".mov"), ("https://x/a/clip", "video", ".mp4"), ("https://x/a/p", "image", ".jpg"),
])
def test_url_extension(spark, url, kind, ext):
    assert one(spark, text.url_extension("u", F.lit(kind)), u=url)[0] == ext


@pytest.mark.parametrize("seconds", [0.0, 0.5, 1.5, 2.5, 59.5, 3599.5, 3661.2])
def test_time_code_rounds_half_to_even(spark, seconds):
    total = round(seconds)
    expected = f"{total // 3600:02d}:{total % 3600 // 60:02d}:{total % 60:02d}"
    assert one(spark, timecode.to_code("s"), s=seconds)[0] == expected


def test_code_pair_never_collapses(spark):
    start, end = timecode.code_pair("a", "b")
    assert one(spark, start, end, a=1.5, b=2.5) == ("00:00:02", "00:00:03")
    assert one(spark, start, end, a=2.0, b=2.0) == ("00:00:02", "00:00:02")


def test_srt_code(spark):
    assert one(spark, timecode.srt_code("s"), s=3661.2345)[0] == "01:01:01,234"


@pytest.mark.parametrize("size, parsed", [("1920x1080", (1920, 1080)), ("bad", (0, 0)), ("1x2x3", (0, 0)), ("x", (0, 0))])
def test_resolution(spark, size, parsed):
    assert one(spark, *media.parse_resolution("r"), r=size) == parsed


@pytest.mark.parametrize("w, h, plan, landscape", [
    (1920, 1080, "none", True), (1920, 1088, "crop", True), (1000, 1000, "crop", False), (1080, 1920, "blur_pad", False),
    (640, 360, "none", True), (640, 400, "reject", False), (0, 0, "reject", False),
])
def test_fit_plan(spark, w, h, plan, landscape):
    assert one(spark, media.fit_plan("w", "h"), media.is_landscape("w", "h"), w=w, h=h) == (plan, landscape)


@pytest.mark.parametrize("placeholder, kind, src, slot, fill, status", [
    (True, "video", 5.0, 5.0, False, "missing"), (False, "image", 0.0, 5.0, False, "ok"),
    (False, "video", 5.01, 5.0, False, "ok"), (False, "video", 4.0, 5.0, False, "speed-matched"),
    (False, "video", 1.0, 5.0, True, "split-fill"), (False, "video", 1.0, 5.0, False, "speed-matched"),
    (False, "video", 50.0, 5.0, False, "trimmed"),
])
def test_render_status(spark, placeholder, kind, src, slot, fill, status):
    got = one(spark, media.render_status("p", "m", "a", "b", "f"), p=placeholder, m=kind, a=src, b=slot, f=fill)
    assert got[0] == status


@pytest.mark.parametrize("url, ok", [
    ("https://creativecommons.org/publicdomain/zero/1.0/", True), ("http://creativecommons.org/licenses/by/4.0/", True),
    ("https://creativecommons.org/licenses/by-nc/4.0/", False), ("", False), (None, False),
])
def test_open_licence(spark, url, ok):
    assert one(spark, media.open_licence("u"), u=url)[0] is ok


TRUCKS = terms.Category("trucks", "Trucks", ("car", "t-shirt", "train"), ("truck",), "semi truck")


@pytest.mark.parametrize("keyword, hit", [
    ("red Cars on road", True), ("cargo carrier", False), ("École train", True), ("T-Shirts shop", True), ("éclair", False),
])
def test_denylist_whole_words(spark, keyword, hit):
    assert one(spark, terms.violates("k", F.lit("trucks"), [TRUCKS]), k=keyword)[0] is hit
    expected = "semi truck" if hit else keyword
    assert one(spark, terms.make_safe("k", F.lit("trucks"), [TRUCKS]), k=keyword)[0] == expected


@pytest.mark.parametrize("caption, term", [
    ("train, cars", "car"), ("cars and trucks", None), ("   ", None), ("cargo", None), ("Train station", "train"),
])
def test_candidate_denylist(spark, caption, term):
    banned = F.array(*[F.lit(t) for t in TRUCKS.banned])
    positive = F.array(*[F.lit(t) for t in TRUCKS.positive])
    got = one(spark, terms.first_banned("c", TRUCKS), terms.first_banned_from_arrays("c", banned, positive), c=caption)
    assert got == (term, term)


def test_score_parts(spark):
    row = dict(source="nasa", visual_type="Archive", media_type="image", width=1920, height=1080, duration=0.0)
    score = scoring.total_score(F.lit(1.0), F.lit(1.0))
    expected = round((0.27 + 0.18 + 0.135 + 0.135 + 0.108 * 0.6 + 0.0 + 0.10) * 100, 2)
    assert one(spark, score, **row)[0] == pytest.approx(expected)
    library = dict(row, source="local_library", media_type="video", visual_type="Sports", duration=1.0)
    expected = round((0.27 + 0.18 + 0.135 * 0.5 + 0.135 + 0.108 + 0.072 + 0.05) * 100, 2) + 10
    assert one(spark, score, **library)[0] == pytest.approx(expected)


def test_rarity_limits(spark):
    assert one(spark, scoring.rarity("f"), f=0.0)[0] == scoring.WEIGHT_UNIT
    assert one(spark, scoring.rarity("f"), f=1e-9)[0] == scoring.WEIGHT_UNIT
    assert one(spark, scoring.rarity("f"), f=0.1)[0] == round(scoring.WEIGHT_UNIT / 7)


@pytest.mark.parametrize("images, videos, bias", [(0, 0, 0.0), (0, 5, 8.0), (5, 0, -7.0), (13, 7, 0.0)])
def test_media_bias(spark, images, videos, bias):
    assert one(spark, scoring.media_bias("i", "v"), i=images, v=videos)[0] == pytest.approx(bias)


def test_sentences_and_packing(spark):
    body = "One two. Three four five!  Six? " + "w " * 30 + ". Last one"
    chunks = one(spark, text.pack_sentences(text.sentences("t"), 6), t=body)[0]
    assert chunks[0] == "One two. Three four five! Six?" and chunks[-1].endswith("Last one")
    assert " ".join(" ".join(chunks).split()) == " ".join(body.split())
    assert one(spark, text.pack_sentences(text.sentences("t"), 6), t="  ")[0] == []


def test_generation_prompt(spark):
    tail = ". Trucks context, photorealistic, natural lighting."
    assert one(spark, text.generation_prompt("k", "n", F.lit("Trucks")), k="red truck", n="at night")[0] == "red truck. at night" + tail
    assert one(spark, text.generation_prompt("k", "n", F.lit("Trucks")), k="red truck", n="")[0] == "red truck" + tail


def test_wrap_follows_textwrap(spark):
    from mediaspark.operators.captions import wrap_lines

    bodies = ["a short line", "x" * 100, "well-known " * 12, "mixed words of many lengths " * 9]
    rows = spark.createDataFrame([(b,) for b in bodies], "t string").select("t", wrap_lines(F.col("t")).alias("l")).collect()
    assert all(r["l"] == textwrap.wrap(r["t"], 42) for r in rows)


def test_long_runs_of_blanks_and_underscores_take_no_square(spark):
    """A pattern that ends at the end of the text starts anew at every blank of a run."""
    run = 150_000
    rows = spark.createDataFrame([("a" + " " * run + "b",), ("_" * run + "c" + "_" * run + "d__",), (" \u3000\x1f_x_\x85\n",), ("",), (None,)], "t string")
    started = time.time()
    got = rows.select(text.strip("t"), text.safe_file_name("t"), text.key_slug("t"), text.final_video_name("t"), text.caption_slug("t")).collect()
    assert time.time() - started < 20
    default = "final_video_with_narration.mp4"
    assert [tuple(r) for r in got] == [
        ("a" + " " * run + "b", "a_b", "a_b", "a_b.mp4", "a_b"),
        ("_" * run + "c" + "_" * run + "d__", "c" + "_" * run + "d", "c_d", "c" + "_" * run + "d.mp4", "c_d"),
        ("_x_", "x", "x", "x.mp4", "x"), ("", "", "", default, "clip"), (None, None, None, None, None),
    ]


def test_slugs_are_those_of_the_whole_caption(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab9Z _-\u00e9\u3000\t\n!") for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.caption_slug("t").alias("slug")).collect()
    for r in rows:
        parts = [w for w in re.split(r"[ \t\n_]+", re.sub(r"[^a-zA-Z0-9 \t\n_]", "", r["t"]).lower()) if w]
        assert r["slug"] == ("_".join(parts[:6]) or "clip")
