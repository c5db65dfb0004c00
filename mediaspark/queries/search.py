"""Retrieval, scoring, tiers and ranking over the derived media tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark.functions import scoring
from mediaspark.operators import candidates as cand
from mediaspark.operators import ranking, reports, retrieval, tiers
from mediaspark.plans.materialise import written
from mediaspark.plans.skew import salted_join
from mediaspark.queries import oracle as O
from mediaspark.queries.registry import register
from mediaspark.views import CATEGORIES, Views


def weights(v: Views) -> DataFrame:
    return retrieval.word_frequencies(v.table("documents"))


def candidates(v: Views, only_usable: bool = False) -> DataFrame:
    return cand.score_candidates(v.clips, v.hits, v.vectors, written(weights(v), "weights"), CATEGORIES, only_usable=only_usable)


def searched(v: Views, high_score: float = 90.0, library_score: float = 75.0) -> DataFrame:
    return tiers.early_stop(tiers.escalate(candidates(v, only_usable=True)), high_score, library_score)


@register("word_freq", O.query("SELECT token, n, round(frequency, 12) AS frequency, weight FROM word_freq"))
def word_freq(v: Views) -> DataFrame:
    return weights(v).withColumn("frequency", F.round("frequency", 12))


@register(
    "retrieval_topk",
    O.query(
        "SELECT f.query, f.source, CAST(pos AS INT) AS pos, doc_id, matched, coalesce(total, 0) AS total "
        "FROM found f LEFT JOIN query_total t ON f.query = t.query"
    ),
)
def retrieval_topk(v: Views) -> DataFrame:
    phrases = retrieval.clip_phrases(v.clips)
    return retrieval.retrieve(phrases, v.hits, weights(v)).withColumnRenamed("entry", "doc_id")


_SCORED = (
    "project_id, clip_number, tier, CAST(phrase_no AS INT) AS phrase_no, source, CAST(pos AS INT) AS pos, doc_id, "
    "round(semantic, 9) AS semantic, round(keyword_match, 9) AS keyword_match, score"
)


@register("score_hits", O.query(f"SELECT {_SCORED} FROM candidates"))
def score_hits(v: Views) -> DataFrame:
    return candidates(v).select(
        "project_id", "clip_number", "tier", "phrase_no", "source", "pos", "doc_id",
        F.round("semantic", 9).alias("semantic"), F.round("keyword_match", 9).alias("keyword_match"), "score",
    )


_SHORT = "project_id, clip_number, source, source_id, media_type, score"


@register("top_candidate", O.query(f"SELECT {_SHORT} FROM ranked WHERE rank = 1"))
def top_candidate(v: Views) -> DataFrame:
    ranked = ranking.rank_candidates(searched(v))
    return ranked.where(F.col("rank") == 1).select(*_SHORT.split(", "))


@register("alternates_top5", O.query(f"SELECT {_SHORT}, rank FROM ranked WHERE rank <= 5"))
def alternates_top5(v: Views) -> DataFrame:
    ranked = ranking.rank_candidates(searched(v))
    return ranked.where(F.col("rank") <= 5).select(*_SHORT.split(", "), "rank")


@register("diagnostics_top3", O.query(f"""
SELECT {_SHORT}, CAST(rn AS INT) AS rank, round(semantic, 9) AS semantic, round(keyword_match, 9) AS keyword_match FROM (
 SELECT *, row_number() OVER (PARTITION BY project_id, clip_number ORDER BY score DESC, {O.ARRIVAL}) AS rn FROM searched)
WHERE rn <= 3"""))
def diagnostics_top3(v: Views) -> DataFrame:
    ranked = ranking.rank_candidates(searched(v), min_score=None).where(F.col("rank") <= 3)
    return ranked.select(
        *_SHORT.split(", "), "rank", F.round("semantic", 9).alias("semantic"),
        F.round("keyword_match", 9).alias("keyword_match"),
    )


_ROW = "project_id, clip_number, source, tier, phrase_no, pos, doc_id, score"
_ROW_SQL = "project_id, clip_number, source, tier, CAST(phrase_no AS INT) AS phrase_no, CAST(pos AS INT) AS pos, doc_id, score"


@register("tier_escalation", O.query(f"SELECT {_ROW_SQL} FROM escalated"))
def tier_escalation(v: Views) -> DataFrame:
    return tiers.escalate(candidates(v, only_usable=True)).select(*_ROW.split(", "))


_CALLS = """
SELECT *, (CAST(project_id AS BIGINT) + provider_rank) % 7 = 0 AS primary_failed,
 (clip_number + provider_rank) % 5 = 0 AS fallback_failed,
 CASE WHEN (CAST(project_id AS BIGINT) + clip_number) % 4 < 3 THEN (CAST(project_id AS BIGINT) + clip_number) % 4 + 1 END
  AS failed_phrase FROM usable"""


@register("call_failures", O.query(f"""
SELECT {_ROW_SQL} FROM (
 SELECT *, max(CASE WHEN tier = 1 THEN score END) OVER w AS best1, max(CASE WHEN tier = 2 THEN score END) OVER w AS best2,
  min(CASE WHEN tier = 3 THEN phrase_no END) OVER w AS first_phrase FROM called
 WHERE NOT primary_failed AND NOT (tier = 2 AND fallback_failed)
  AND (tier <> 3 OR failed_phrase IS NULL OR phrase_no < failed_phrase)
 WINDOW w AS (PARTITION BY project_id, clip_number, source))
WHERE tier = 1 OR (tier = 2 AND coalesce(best1, -1) < 50)
 OR (tier = 3 AND coalesce(best1, -1) < 50 AND coalesce(best2, -1) < 50 AND phrase_no = first_phrase)""", called=_CALLS))
def call_failures(v: Views) -> DataFrame:
    project = F.col("project_id").cast("long")
    rows = candidates(v, only_usable=True).withColumns({
        "primary_failed": (project + F.col("provider_rank")) % 7 == 0,
        "fallback_failed": (F.col("clip_number") + F.col("provider_rank")) % 5 == 0,
        "failed_phrase": F.when((project + F.col("clip_number")) % 4 < 3, (project + F.col("clip_number")) % 4 + 1),
    })
    return tiers.escalate(rows).select(*_ROW.split(", "))


# Scores of the generated texts stay below 90, so the stop is set at 70.
@register("provider_early_stop", O.query(f"""
SELECT {_ROW_SQL} FROM (SELECT *, max(score) OVER (PARTITION BY project_id, clip_number ORDER BY provider_rank
   RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  max(CASE WHEN source = 'local_library' THEN score END) OVER (PARTITION BY project_id, clip_number) AS library_best
 FROM escalated) WHERE coalesce(before, -1) < 70 AND (coalesce(library_best, -1) < 75 OR source = 'local_library')"""))
def provider_early_stop(v: Views) -> DataFrame:
    return searched(v, high_score=70.0).select(*_ROW.split(", "))


O.CTES.update({
    "scan_rows": """
SELECT *, row_number() OVER (PARTITION BY project_id, clip_number ORDER BY score DESC) AS scan_rank FROM (
 SELECT *, max(score) OVER (PARTITION BY project_id, clip_number ORDER BY provider_rank
   RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  max(CASE WHEN source = 'local_library' THEN score END) OVER (PARTITION BY project_id, clip_number) AS library_best
 FROM escalated WHERE tier < 3)
WHERE coalesce(before, -1) < 90 AND (coalesce(library_best, -1) < 75 OR source = 'local_library') AND score >= 50""",
    "availability": """
SELECT c.project_id, c.clip_number, count(s.score) AS candidate_count, max(s.score) AS top_score, count(s.score) < 1 AS thin
FROM clips c LEFT JOIN scan_rows s ON c.project_id = s.project_id AND c.clip_number = s.clip_number GROUP BY 1, 2""",
    "winners": "SELECT * FROM ranked WHERE rank = 1",
})


def _scan(v: Views, base: DataFrame | None = None) -> DataFrame:
    rows = candidates(v, only_usable=True) if base is None else base
    rows = tiers.early_stop(tiers.escalate(rows, semantic_tier=False))
    return rows.where(F.col("score") >= 50)


@register("availability_clips", O.query("SELECT * FROM availability"))
def availability_clips(v: Views) -> DataFrame:
    return reports.clip_availability(v.clips, _scan(v))


@register("availability_report", O.query("""
SELECT project_id, count(*) AS total_clips, count(*) FILTER (thin) AS thin_count,
 count(*) FILTER (thin)::DOUBLE / count(*) >= 0.15E0 AS warn FROM availability GROUP BY project_id"""))
def availability_report(v: Views) -> DataFrame:
    return reports.project_availability(reports.clip_availability(v.clips, _scan(v)))


@register("score_gap", O.query("""
SELECT a.project_id, a.clip_number, a.top_score AS scan_top, w.score AS final_score, round(a.top_score - w.score, 6) AS gap,
 a.candidate_count FROM availability a LEFT JOIN winners w ON a.project_id = w.project_id AND a.clip_number = w.clip_number"""))
def score_gap(v: Views) -> DataFrame:
    base = written(candidates(v, only_usable=True), "candidates")
    final = ranking.rank_candidates(tiers.early_stop(tiers.escalate(base))).where(F.col("rank") == 1)
    return reports.score_gap(v.clips, _scan(v, base), final)


@register("use_counts", O.query("""
SELECT r.project_id, r.clip_number, r.source, r.source_id, r.rank, coalesce(u.uses, 0) AS uses, coalesce(u.uses, 0) < 1 AS free
FROM ranked r LEFT JOIN (SELECT project_id, source, source_id, count(*) AS uses FROM winners GROUP BY 1, 2, 3) u
 ON r.project_id = u.project_id AND r.source = u.source AND r.source_id = u.source_id"""))
def use_counts(v: Views) -> DataFrame:
    """Every ranked candidate with the times its project already shows it."""
    ranked = written(ranking.rank_candidates(searched(v)), "ranked")
    uses = reports.use_counts(ranked.where(F.col("rank") == 1))
    joined = salted_join(ranked, uses, ["project_id", "source", "source_id"], "left", spread=["clip_number", "rank"])
    count = F.coalesce("uses", F.lit(0)).cast("long")
    return joined.select(
        "project_id", "clip_number", "source", "source_id", "rank", count.alias("uses"), (count < 1).alias("free")
    )


_BIAS = "greatest(-8.0E0, least(8.0E0, (0.65E0 - images::DOUBLE / (images + videos)) * 20.0E0))"


@register("media_mix_bias", O.query(f"""
SELECT r.project_id, r.clip_number, r.source, r.source_id, r.media_type, r.score, round({_BIAS}, 9) AS image_bias,
 CAST(row_number() OVER (PARTITION BY r.project_id, r.clip_number ORDER BY
  r.score + CASE WHEN media_type = 'image' THEN {_BIAS} ELSE -({_BIAS}) END DESC, {O.ARRIVAL}) AS INT) AS rank
FROM ranked r JOIN (SELECT project_id, count(*) FILTER (media_type = 'image') AS images,
 count(*) FILTER (media_type = 'video') AS videos FROM winners GROUP BY project_id) m ON r.project_id = m.project_id"""))
def media_mix_bias(v: Views) -> DataFrame:
    ranked = written(ranking.rank_candidates(searched(v)), "ranked")
    mix = reports.media_mix(ranked.where(F.col("rank") == 1))
    joined = salted_join(ranked.drop("rank"), mix, ["project_id"], spread=["clip_number", "doc_id"])
    bias = scoring.media_bias("images", "videos")
    biased = ranking.rank_candidates(joined.withColumn("_bias", bias), bias=F.col("_bias"))
    return biased.select(
        "project_id", "clip_number", "source", "source_id", "media_type", "score",
        F.round("_bias", 9).alias("image_bias"), "rank",
    )
