"""Assignment of assets, next to SQL that takes the beats of a project in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark import config as C
from mediaspark.functions.timecode import span_seconds
from mediaspark.operators import assign, timeline
from mediaspark.queries import oracle as O
from mediaspark.queries import search
from mediaspark.queries.registry import register
from mediaspark.queries.timing import CTES as TIMING
from mediaspark.views import Views

BUDGET = 4


def assignment_input(v: Views) -> DataFrame:
    """Beats with their candidates and the outcome of fetching each."""
    rows = search.candidates(v, only_usable=True).withColumns({
        "fetch_ok": F.col("doc_id") % 13 != 0,
        "verify_score": F.when(F.col("doc_id") % 11 != 0, F.col("doc_id") % 40 / 100.0),
        "file_width": F.when(F.col("width") > 0, F.col("width")).otherwise(F.lit(1280)).cast("int"),
        "file_height": F.when(F.col("height") > 0, F.col("height")).otherwise(F.lit(720)).cast("int"),
        "file_seconds": F.col("duration"),
        "fit_ok": F.col("doc_id") % 17 != 0,
    })
    timed = timeline.pace_timing(v.clip_rows, longest=v.longest)
    beats = timed.select(
        "project_id", "clip_number", span_seconds("start", "end").alias("target_seconds"),
        ((F.col("conv_id") + F.col("turn")) % 3 == 0).alias("generation_ok"),
    )
    return assign.beat_rows(beats, rows)


def _seconds(code: str) -> str:
    return (f"(CAST(substr({code},1,2) AS BIGINT) * 3600 + CAST(substr({code},4,2) AS BIGINT) * 60 "
            f"+ CAST(substr({code},7,2) AS BIGINT))")


INPUT = {
    "paced_raw": TIMING["paced_raw"],
    "paced": TIMING["paced"],
    "beat_list": f"""
SELECT p.project_id, p.clip_number, ({_seconds('end_code')} - {_seconds('start_code')})::DOUBLE AS need,
 (conv_id + turn) % 3 = 0 AS can_generate, row_number() OVER (PARTITION BY p.project_id ORDER BY p.clip_number) AS step
FROM paced p JOIN clips_base b ON p.project_id = b.project_id AND p.clip_number = b.clip_number""",
    "file_rows": """
SELECT *, CASE WHEN width > 0 THEN width ELSE 1280 END AS fw, CASE WHEN height > 0 THEN height ELSE 720 END AS fh,
 CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 40)::DOUBLE / 100.0E0 END AS seen FROM usable""",
    "offers": f"""
SELECT project_id, clip_number, provider_rank, tier, phrase_no, pos, source, source_id, source || ':' || source_id AS asset,
 media_type, score, duration AS seconds, CASE WHEN doc_id % 13 = 0 THEN 'fetch_failed'
  WHEN abs(fw::DOUBLE / fh - 16.0E0 / 9.0E0) >= {C.EXACT_RATIO_TOLERANCE} AND least(fw, fh) < {C.MIN_DIMENSION} THEN 'too_small'
  WHEN abs(fw::DOUBLE / fh - 16.0E0 / 9.0E0) >= {C.EXACT_RATIO_TOLERANCE} AND doc_id % 17 = 0 THEN 'not_16_9'
  WHEN seen < {C.VERIFICATION_FLOOR}E0 THEN 'not_verified' ELSE 'accepted' END AS verdict FROM file_rows""",
}


def walk_sql(rules: assign.Rules) -> str:
    """Beats of every project in turn, over ``beat_list`` and ``offers``."""
    flag = lambda b: "TRUE" if b else "FALSE"
    limit = "NULL::BIGINT" if rules.limit is None else f"{rules.limit}::BIGINT"
    part = "PARTITION BY project_id"
    state = "project_id, step, clip_number, used, images, videos, spent, need, can_generate"
    lean = ("CASE WHEN images + videos = 0 THEN 0.0E0 ELSE greatest(-8.0E0, least(8.0E0, "
            "(0.65E0 - images::DOUBLE / (images + videos)) * 20.0E0)) END") if not rules.simulate else "0.0E0"
    flags = f"""
 SELECT *, shut IS NOT TRUE AND early AND can_generate AS ahead FROM (
  SELECT *, coalesce(spent >= {limit}, FALSE) AS shut, n = 0 OR best < {rules.generation_score} AS weak,
   {flag(rules.generation)} AND (n = 0 OR best < {rules.generation_score}) AS early,
   coalesce(cut_at <= coalesce(pick, n), FALSE) AS over FROM (
   SELECT *, min(CASE WHEN good AND spent + paid_before >= {limit} THEN place END) OVER ({part}) AS cut_at,
    max(CASE WHEN place = pick THEN score END) OVER ({part}) AS pick_score,
    max(CASE WHEN place = pick THEN asset END) OVER ({part}) AS pick_asset,
    max(CASE WHEN place = pick THEN media_type END) OVER ({part}) AS pick_type,
    max(CASE WHEN place = pick THEN seconds END) OVER ({part}) AS have FROM (
    SELECT *, count(CASE WHEN good THEN 1 END) OVER ({part}) AS n, max(CASE WHEN place = 1 THEN score END) OVER ({part}) AS best,
     min(CASE WHEN good AND verdict = 'accepted' THEN place END) OVER ({part}) AS pick,
     coalesce(sum(CASE WHEN good AND verdict <> 'fetch_failed' THEN 1 ELSE 0 END) OVER ({part}
      ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS paid_before FROM (
     SELECT *, CASE WHEN good THEN line END AS place FROM (
      SELECT *, row_number() OVER ({part} ORDER BY good DESC, score + CASE WHEN media_type = 'image' THEN lean ELSE -lean END DESC,
       CASE WHEN media_type = 'image' THEN 1 ELSE 0 END, provider_rank, tier, phrase_no, pos) AS line FROM (
       SELECT *, {lean} AS lean, coalesce(pool AND score >= {rules.min_score} AND (stop IS NULL OR provider_rank <= stop), FALSE)
        AS good FROM (
        SELECT *, min(CASE WHEN pool AND (score >= {rules.high_score} OR (source = 'local_library'
          AND score >= {rules.generation_score})) THEN provider_rank END) OVER ({part}) AS stop FROM (
         SELECT *, is_open AND (tier = 1 OR (tier = 2 AND NOT found1) OR ({flag(rules.semantic_tier)} AND tier = 3
           AND NOT found1 AND NOT found2 AND phrase_no = phrase)) AS pool FROM (
          SELECT *, bool_or(is_open AND tier = 1 AND score >= {rules.min_score}) OVER src AS found1,
           bool_or(is_open AND tier = 2 AND score >= {rules.min_score}) OVER src AS found2,
           min(CASE WHEN is_open AND tier = 3 THEN phrase_no END) OVER src AS phrase FROM (
           SELECT *, asset IS NOT NULL AND ({flag(rules.allow_duplicates)} OR uses < {rules.cap}) AS is_open FROM (
            SELECT w.project_id, b.step, b.clip_number, w.used, w.images, w.videos, w.spent, b.need, b.can_generate,
             o.* EXCLUDE (project_id, clip_number), len(list_filter(w.used, lambda u: u = o.asset)) AS uses
            FROM walk w JOIN beat_list b ON b.project_id = w.project_id AND b.step = w.step + 1
            LEFT JOIN offers o ON o.project_id = b.project_id AND o.clip_number = b.clip_number))
          WINDOW src AS ({part}, provider_rank))))))))))"""
    rows = f"""
 SELECT *, count(CASE WHEN fill THEN 1 END) OVER ({part}) AS n_fill,
  min(CASE WHEN fill AND verdict IN ('accepted', 'not_verified') THEN fill_line END) OVER ({part}) AS fill_at FROM (
  SELECT *, sum(CASE WHEN fill THEN 1 ELSE 0 END) OVER ({part} ORDER BY line) AS fill_line FROM (
   SELECT *, coalesce(taken_up AND pick_type = 'video' AND have > 0.05E0 AND need > 0.05E0 AND have < need - 0.05E0
     AND NOT (have / need BETWEEN 0.7E0 AND 1.4E0) AND place > pick AND asset <> pick_asset AND verdict <> 'fetch_failed'
     AND uses + own_uses < {rules.cap}, FALSE) AS fill FROM (
    SELECT *, count(CASE WHEN own THEN 1 END) OVER ({part}, asset) AS own_uses, count(CASE WHEN own THEN 1 END) OVER ({part}) AS n_own
    FROM (
     SELECT *, good AND verdict <> 'fetch_failed' AND place <= tried AS own, NOT idle AND NOT cut AND NOT made AND pick IS NOT NULL
       AS taken_up FROM (
      SELECT *, ahead OR (late AND can_generate) AS made,
       CASE WHEN idle THEN 0 WHEN cut THEN cut_at - 1 ELSE coalesce(pick, n) END AS tried FROM (
       SELECT *, NOT idle AND NOT early AND NOT cut AND {flag(rules.generation)}
         AND (pick IS NULL OR pick_score < {rules.generation_score}) AS late FROM (
        SELECT *, shut OR ahead AS idle, NOT shut AND NOT ahead AND over AS cut FROM ({flags}))))))))"""
    if rules.simulate:
        fetched, downloads = "list(asset ORDER BY line) FILTER (place = 1)", "0"
    else:
        fetched = ("list_concat(coalesce(list(asset ORDER BY line) FILTER (own), []), "
                   "coalesce(list(asset) FILTER (fill_line = fill_at AND fill AND paid = fill_at), []))")
        downloads = "any_value(n_own + paid)"
    return f"""
SELECT * FROM (WITH RECURSIVE walk AS (
 SELECT DISTINCT project_id, 0::BIGINT AS step, 0 AS clip_number, CAST([] AS VARCHAR[]) AS used, 0::BIGINT AS images,
  0::BIGINT AS videos, 0::BIGINT AS spent, CAST([] AS VARCHAR[]) AS fetched, 0::BIGINT AS downloads, FALSE AS shut, FALSE AS cut,
  FALSE AS made, FALSE AS taken_up, FALSE AS early, FALSE AS late, FALSE AS idle, FALSE AS can_generate, 0::BIGINT AS n,
  0::BIGINT AS tried, NULL::DOUBLE AS best, NULL::DOUBLE AS pick_score, NULL::VARCHAR AS pick_asset, NULL::VARCHAR AS pick_type,
  NULL::VARCHAR AS last_refusal, CAST([] AS VARCHAR[]) AS best_assets, NULL::VARCHAR AS fill_asset FROM beat_list
 UNION ALL
 SELECT project_id, step, clip_number, list_concat(used, got), images + CASE WHEN taken_up AND pick_type = 'image' THEN 1 ELSE 0 END,
  videos + CASE WHEN taken_up AND pick_type = 'video' THEN 1 ELSE 0 END, spent + paid_all, got, paid_all, shut, cut, made, taken_up,
  early, late, idle, can_generate, n, tried, best, pick_score, pick_asset, pick_type, last_refusal, best_assets, fill_asset
 FROM (SELECT project_id, any_value(step) AS step, any_value(clip_number) AS clip_number, any_value(used) AS used,
   any_value(images) AS images, any_value(videos) AS videos, any_value(spent) AS spent, coalesce({fetched}, []) AS got,
   {downloads} AS paid_all, any_value(shut) AS shut, any_value(cut) AS cut, any_value(made) AS made,
   any_value(taken_up) AS taken_up, any_value(early) AS early, any_value(late) AS late, any_value(idle) AS idle,
   any_value(can_generate) AS can_generate, any_value(n) AS n, any_value(tried) AS tried, any_value(best) AS best,
   any_value(pick_score) AS pick_score, any_value(pick_asset) AS pick_asset, any_value(pick_type) AS pick_type,
   max(CASE WHEN place = n THEN verdict END) AS last_refusal,
   coalesce(list(asset ORDER BY line) FILTER (place <= 5), []) AS best_assets,
   max(CASE WHEN fill AND fill_line = fill_at AND paid = fill_at THEN asset END) AS fill_asset
  FROM (SELECT *, CASE WHEN {limit} IS NULL THEN coalesce(fill_at, n_fill)
    ELSE least(coalesce(fill_at, n_fill), {limit} - spent - n_own) END AS paid FROM ({rows}))
  GROUP BY project_id))
 SELECT * FROM walk WHERE step > 0)"""


_RESULT = """
SELECT project_id, clip_number, CASE WHEN made THEN 'ai_generated' WHEN taken_up THEN 'real' ELSE 'placeholder' END AS outcome,
 CASE WHEN made THEN 'ai_generated' WHEN taken_up THEN split_part(pick_asset, ':', 1) END AS source,
 CASE WHEN made THEN printf('clip%03d_generated.jpg', clip_number) WHEN taken_up THEN substr(pick_asset, strpos(pick_asset, ':') + 1) END
  AS source_id,
 CASE WHEN made THEN 'image' WHEN taken_up THEN pick_type END AS media_type, CASE WHEN taken_up THEN pick_score END AS score,
 split_part(fill_asset, ':', 1) AS fill_source, substr(fill_asset, strpos(fill_asset, ':') + 1) AS fill_source_id,
 CASE WHEN shut OR cut THEN 'budget_spent' WHEN NOT idle AND n > 0 AND pick_asset IS NULL THEN 'all_refused'
  WHEN NOT idle AND n = 0 THEN 'no_candidate' END AS reason,
 CASE WHEN NOT idle AND NOT cut AND n > 0 AND pick_asset IS NULL THEN last_refusal END AS last_refusal,
 (early OR late) AND NOT shut AND NOT cut AS generation_attempted,
 (early OR late) AND NOT shut AND NOT cut AND NOT can_generate AS generation_failed,
 CAST(CASE WHEN shut THEN 0 ELSE n END AS INT) AS n_candidates, CAST(tried AS INT) AS tried, CAST(downloads AS INT) AS downloads,
 array_to_string(fetched, ', ') AS fetched, CASE WHEN shut THEN '' ELSE array_to_string(best_assets, ', ') END AS alternates
FROM walked"""


def _flat(out: DataFrame) -> DataFrame:
    return out.select(
        *[c for c in out.columns if c not in ("fetched", "alternates")],
        F.array_join("fetched", ", ").alias("fetched"), F.array_join("alternates", ", ").alias("alternates"),
    )


@register("assign_greedy", O.query(_RESULT, **INPUT, walked=walk_sql(assign.Rules())))
def assign_greedy(v: Views) -> DataFrame:
    return _flat(assign.assign(assignment_input(v)))


@register("assign_budget", O.query(_RESULT, **INPUT, walked=walk_sql(assign.Rules(limit=BUDGET, generation=False))))
def assign_budget(v: Views) -> DataFrame:
    """At most four downloads a project, no generated images."""
    return _flat(assign.assign(assignment_input(v), assign.Rules(limit=BUDGET, generation=False)))


_DRY = assign.Rules(simulate=True, semantic_tier=False, generation=False)


@register("availability_sim", O.query(
    "SELECT project_id, clip_number, CAST(n AS INT) AS candidate_count, best AS top_score, n < 1 AS thin FROM walked",
    **INPUT, walked=walk_sql(_DRY)))
def availability_sim(v: Views) -> DataFrame:
    return assign.availability(assignment_input(v))
