"""Candidates of a beat: retrieved rows with filters and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark import config as C
from mediaspark.functions import scoring
from mediaspark.functions.media import known_low_res
from mediaspark.operators.retrieval import clip_phrases, provider_active, provider_rank, search
from mediaspark.operators.similarity import pair_dots
from mediaspark.operators.terms import Category, first_banned_by_category
from mediaspark.plans.materialise import written
from mediaspark.plans.skew import hot_join

CLIP_KEY = ("project_id", "clip_number")


def score_candidates(
    clips: DataFrame,
    hits: DataFrame,
    vectors: DataFrame,
    weights: DataFrame,
    categories: tuple[Category, ...],
    per_page: int = C.PER_PAGE,
    only_usable: bool = False,
) -> DataFrame:
    """One row per beat, source, search phrase and retrieved entry, scored.

    With ``only_usable`` rows that ``usable`` would drop are dropped before they
    are written, shuffled and scored; what dropped them is then not a column.

    The beat side of the join on the entry is skewed by nature (the first
    entries of a source fill every thin result), so only those hot entries are
    copied; the tokens of the retrieved entries travel once per entry, as the ids
    that the search has worked out, and the denylists are matched once per
    entry, where its text lies.  Rows meet vectors by the ids of their pair.
    """
    phrases = written(clip_phrases(clips).select(*CLIP_KEY, "visual_type", "category", "canva_keyword", "tier", "phrase_no", "query", "vec_id"), "asked")
    pages, words, tokens = search(phrases, hits, weights, per_page)
    found = written(pages.select("query", F.transform("page", lambda e: F.struct(e["source"].alias("source"), e["pos"].alias("pos"), e["entry"].alias("entry"))).alias("page")), "found")
    # a main keyword is a phrase of its own
    keyword = words.select(F.col("query").alias("canva_keyword"), F.arrays_zip(F.col("words").alias("token"), F.col("ws").alias("w")).alias("keyword_tokens"))
    beats = (
        phrases.select(*CLIP_KEY, "visual_type", "category", "canva_keyword", "tier", "phrase_no", "query", F.col("vec_id").alias("a"))
        .join(keyword, "canva_keyword", "left").drop("canva_keyword")
    )
    # one row per phrase meets the beats
    rows = (
        beats.join(found, "query").drop("query")
        .withColumn("e", F.explode("page")).drop("page").select("*", "e.source", "e.pos", "e.entry").drop("e")
        .withColumn("provider_rank", provider_rank())
        .where(provider_active(categories=categories))
    )
    wanted = written(found.select(F.explode("page.entry").alias("entry")).groupBy("entry").agg(F.count("*").alias("n")), "wanted")
    entries = hits.withColumn("_lower", F.lower("text")).select(
        F.col("doc_id").alias("entry"), "source_id", "width", "height", "media_type", "duration",
        (F.coalesce("text", F.lit("")) == "").alias("no_text"), F.col("vec_id").alias("b"),
        first_banned_by_category("_lower", categories, lowered=True).alias("banned_by"),
    )
    # no semi join, which the planner would put before the texts are read off
    entries = entries.join(wanted.select("entry"), "entry").join(tokens.select("entry", F.col("words").alias("tokens")), "entry")
    joined = hot_join(rows, entries, "entry", wanted, spread=["project_id", "clip_number", "tier", "phrase_no"])
    empty = F.array().cast("array<struct<token:bigint,w:bigint>>")
    joined = joined.withColumn("keyword_tokens", F.coalesce("keyword_tokens", empty))
    joined = joined.withColumns({
        "banned_term": F.try_element_at("banned_by", F.col("category")), "low_res": known_low_res("width", "height"),
    })
    if only_usable:
        joined, judged = usable(joined), ()
    else:
        judged = ("category", "banned_term", "low_res")
    matched = written(joined.select(
        *CLIP_KEY, "visual_type", "tier", "phrase_no", "provider_rank", "source",
        "pos", F.col("entry").alias("doc_id"), "source_id", "media_type", "width", "height", "duration", *judged,
        scoring.share(
            scoring.matched_weight("keyword_tokens", "tokens"), scoring.total_weight("keyword_tokens")
        ).alias("keyword_match"),
        "no_text", "a", "b",
    ), "matched")
    # rows stream past the vectors of their cell and take the product along; no row carries a vector
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("dot")))
    scored = pair_dots(matched, vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    scored = scored.withColumn("semantic", F.when(F.col("no_text"), F.lit(0.5)).otherwise(near))
    scored = scored.drop("no_text", "a", "b", "dot")
    return scored.withColumn("score", scoring.total_score(F.col("semantic"), F.col("keyword_match")))


def usable(rows: DataFrame) -> DataFrame:
    """Drops rows below the resolution floor or on the denylist."""
    return rows.where(~F.col("low_res") & F.col("banned_term").isNull())
