"""Resolved projects: assignment, alignment, reports and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark.functions import scoring
from mediaspark.functions.text import overlap_tokens, words
from mediaspark.functions.timecode import code_pair
from mediaspark.operators import align, captions, checks, reports, retrieval, timeline
from mediaspark.plans.materialise import written
from mediaspark.plans.skew import block_scan
from mediaspark.queries import oracle as O
from mediaspark.queries import search, timing
from mediaspark.queries.registry import register
from mediaspark.views import Views


def transcript(v: Views) -> DataFrame:
    """Spoken words of every project: the script with words left out and
    fillers put in."""
    said = F.flatten(F.transform(
        words("script_beat"),
        lambda w, i: F.when(i % 7 == 3, F.array().cast("array<string>"))
        .when(i % 11 == 5, F.array(w, F.lit("um"))).otherwise(F.array(w)),
    ))
    rows = v.clip_rows.select("project_id", "clip_number", said.alias("said"))
    rows = block_scan(rows, ["project_id"], "clip_number", {"offset": ("sum", F.size("said"))}, longest=v.longest)
    out = rows.select("project_id", "offset", F.posexplode("said").alias("pos", "text"))
    at = F.col("offset") + F.col("pos")
    return out.select("project_id", at.alias("word_idx"), "text", (at * 0.4).alias("start"), (at * 0.4 + 0.35).alias("end"))


def aligned(v: Views) -> DataFrame:
    spans = align.transcript_spans(v.clip_rows, transcript(v))
    return timeline.floor_cascade(spans, longest=v.longest)


@register("transcript_align")
def transcript_align(v: Views) -> DataFrame:
    rows = timeline.force_contiguity(timeline.with_codes(aligned(v)), longest=v.longest)
    return rows.select("project_id", "clip_number", "first_word", "end_word", "matched", "start", "end")


@register("full_timing")
def full_timing(v: Views) -> DataFrame:
    """The whole timing pass: alignment, floors, contiguity, split, contiguity."""
    rows = timeline.force_contiguity(timeline.with_codes(aligned(v)), longest=v.longest)
    rows = rows.select("project_id", "clip_number", "start", "end").join(
        v.clip_rows.select("project_id", "clip_number", "script_beat"), ["project_id", "clip_number"]
    )
    # written, as the scan that follows looks for the highest position first
    rows = written(timeline.split_long_rows(rows, longest=v.longest), "split")
    return timeline.force_contiguity(rows).select(
        "project_id", "parent_clip", "part", "clip_number", "start", "end", "script_beat"
    )


@register("script_audit")
def script_audit(v: Views) -> DataFrame:
    """Every beat against the next beat of its project, as script and transcript."""
    rows = block_scan(
        v.clip_rows.select("project_id", "clip_number", "script_beat"), ["project_id"], "clip_number",
        previous={"before": F.col("script_beat")}, longest=v.longest,
    )
    half = F.when(F.col("clip_number") % 2 == 0, F.coalesce("before", F.lit(""))).otherwise(
        F.regexp_replace("script_beat", "er", "re")
    )
    pairs = rows.select(
        F.concat("project_id", F.lit("/"), F.col("clip_number").cast("string")).alias("project_id"),
        F.col("script_beat").alias("script"), half.alias("transcript"),
    )
    judged = align.script_audit(pairs)
    return judged.withColumn("mismatches", F.size("mismatches"))


@register("caption_cues")
def caption_cues(v: Views) -> DataFrame:
    cues = captions.cues(timing.contiguous(v))
    return captions.number_cues(cues, longest=v.longest).select(
        "project_id", "cue_no", "clip_number", "part", "start_s", "end_s", "cue_text",
        captions.srt_block(F.col("cue_no"), "start_s", "end_s", "cue_text").alias("block"),
    )


_LABEL = """CASE WHEN e.project_id IS NULL OR placeholder OR source IS NULL THEN 'placeholder'
 WHEN source = 'ai_generated' THEN 'ai_generated'
 WHEN generation_attempted THEN 'real (generation failed: ' || coalesce(generation_failure_reason, 'None') || ')' ELSE 'real' END"""
O.CTES["labelled"] = f"""
SELECT c.project_id, c.clip_number, c.canva_keyword, e.source, e.source_id, e.selected_text, e.score, e.note,
 e.project_id IS NULL OR placeholder OR e.source IS NULL AS held, {_LABEL} AS outcome, e.project_id IS NULL AS missing
FROM clips c LEFT JOIN (SELECT * FROM entries WHERE clip_number % 8 <> 7) e
 ON c.project_id = e.project_id AND c.clip_number = e.clip_number"""


def _report(v: Views) -> DataFrame:
    """Match report; the seventh beat of a project has no entry."""
    return reports.match_report(v.clips, timing.entries(v).where(F.col("clip_number") % 8 != 7))


@register("match_report", O.query("""
SELECT project_id, clip_number, canva_keyword, CASE WHEN held THEN '—' ELSE source || ':' || source_id END AS selected,
 CASE WHEN held THEN '(placeholder — no candidate accepted: ' || CASE WHEN missing THEN 'no timeline entry' ELSE note END || ')'
  ELSE replace(selected_text, '|', '/') END AS selected_text, CASE WHEN NOT held THEN score END AS score, outcome FROM labelled"""))
def match_report(v: Views) -> DataFrame:
    return _report(v)


O.CTES["report_ratio"] = f"""
SELECT l.project_id, l.clip_number, coalesce(sum(CASE WHEN list_contains(toks, t.token) THEN t.w ELSE 0 END)::DOUBLE / sum(t.w), 0.0E0)
 AS ratio FROM (SELECT *, {O.overlap_tokens('selected_text')} AS toks FROM labelled WHERE NOT held) l
LEFT JOIN query_tokens t ON t.query = l.canva_keyword GROUP BY l.project_id, l.clip_number"""


@register("match_ratio", O.query("SELECT project_id, clip_number, round(ratio, 9) AS keyword_match FROM report_ratio"))
def match_ratio(v: Views) -> DataFrame:
    rows = _report(v).where(F.col("outcome") != "placeholder")
    weighted = retrieval.weighted_tokens(rows.select(F.col("canva_keyword")), "canva_keyword", search.weights(v))
    joined = rows.join(weighted, "canva_keyword", "left")
    empty = F.array().cast("array<struct<token:string,w:bigint>>")
    joined = joined.withColumn("weighted", F.coalesce("weighted", empty)).withColumn("tokens", overlap_tokens("selected_text"))
    ratio = scoring.share(scoring.matched_weight("weighted", "tokens"), scoring.total_weight("weighted"))
    return joined.select("project_id", "clip_number", F.round(ratio, 9).alias("keyword_match"))


@register("outcome_share", O.query("""
SELECT outcome, count(*) AS n, round(count(*) * 100.0E0 / sum(count(*)) OVER (), 6) AS percent FROM labelled GROUP BY outcome"""))
def outcome_share(v: Views) -> DataFrame:
    return reports.outcome_share(_report(v))


@register("timeline_markdown", O.query("""
SELECT c.project_id, c.clip_number, '|' || CAST(c.clip_number AS VARCHAR) || '|' || s.start_code || '|' || s.end_code || '|'
 || section || '|' || c.script_beat || '|' || canva_keyword || '|' || fallback_keyword || '|' || visual_type || '|' || category || '|'
 AS line FROM clips c JOIN seconds s ON c.project_id = s.project_id AND c.clip_number = s.clip_number"""))
def timeline_markdown(v: Views) -> DataFrame:
    codes = timing.contiguous(v).select("project_id", "clip_number", "start", "end")
    rows = v.clips.join(codes, ["project_id", "clip_number"]).withColumn("edit_note", F.col("category"))
    return reports.timeline_lines(rows)


O.CTES.update({
    "alternates": """
SELECT e.project_id, e.clip_number, i AS alternate_index, h.source, h.source_id, h.media_type, h.text AS selected_text, h.duration AS asset_seconds,
 h.width, h.height, h.doc_id, 40.0E0 + h.doc_id % 60 AS score
FROM (SELECT *, unnest(range(0, 3)) AS i FROM entries) e
JOIN hits h ON h.doc_id = (e.conv_id * 17 + (e.turn + e.i) * 3) % (SELECT count(*) FROM documents)""",
    "edits": """
SELECT project_id, clip_number + CASE WHEN conv_id % 10 = 9 THEN 100 ELSE 0 END AS clip_number, turn % 4 AS alternate_index
FROM entries WHERE turn % 2 = 0""",
    "judged": """
SELECT * REPLACE (CASE WHEN problem IS NULL AND row_number() OVER (PARTITION BY project_id, source, source_id, problem IS NULL ORDER BY clip_number) > 1
 THEN 'already used' ELSE problem END AS problem) FROM (
SELECT d.project_id, d.clip_number, d.alternate_index, a.source, a.source_id, a.media_type, a.score, a.selected_text, a.asset_seconds, a.width, a.height, a.doc_id,
 CASE WHEN e.project_id IS NULL THEN 'clip not found' WHEN a.source IS NULL THEN 'alternate out of range'
  WHEN EXISTS (SELECT 1 FROM entries o WHERE o.project_id = d.project_id AND o.clip_number <> d.clip_number
   AND o.source = a.source AND o.source_id = a.source_id) THEN 'already used' END AS problem
FROM edits d LEFT JOIN entries e ON d.project_id = e.project_id AND d.clip_number = e.clip_number
LEFT JOIN alternates a ON d.project_id = a.project_id AND d.clip_number = a.clip_number AND d.alternate_index = a.alternate_index)""",
})


@register("swap_edit", O.query("""
SELECT e.project_id, e.clip_number, CASE WHEN j.source IS NULL THEN e.source ELSE j.source END AS source,
 CASE WHEN j.source IS NULL THEN e.source_id ELSE j.source_id END AS source_id,
 CASE WHEN j.source IS NULL THEN e.media_type ELSE j.media_type END AS media_type, CASE WHEN j.source IS NULL THEN e.selected_text ELSE j.selected_text END AS selected_text,
 CASE WHEN j.source IS NULL THEN e.asset_seconds ELSE j.asset_seconds END AS asset_seconds, CASE WHEN j.source IS NULL THEN e.width ELSE j.width END AS width,
 CASE WHEN j.source IS NULL THEN e.height ELSE j.height END AS height, CASE WHEN j.source IS NULL THEN e.score ELSE j.score END AS score,
 CASE WHEN j.source IS NULL THEN e.placeholder ELSE FALSE END AS placeholder,
 CASE WHEN j.source IS NULL THEN e.note ELSE 'swapped to alternate ' || CAST(j.alternate_index AS VARCHAR) || ' (' || j.source
  || ':' || j.source_id || ') via editor' END AS note, 'row' AS kind
FROM entries e LEFT JOIN (SELECT * FROM judged WHERE problem IS NULL) j
 ON e.project_id = j.project_id AND e.clip_number = j.clip_number
UNION ALL SELECT project_id, clip_number, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, problem, 'rejected' FROM judged WHERE problem IS NOT NULL"""))
def swap_edit(v: Views) -> DataFrame:
    rows = timing.entries(v)
    asked = rows.select("project_id", "clip_number", "conv_id", "turn", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("alternate_index"))
    asked = asked.withColumn(
        "doc_id", (F.col("conv_id") * 17 + (F.col("turn") + F.col("alternate_index")) * 3) % v.n_documents
    )
    assets = v.hits.select("doc_id", "source", "source_id", "media_type", F.col("text").alias("selected_text"), F.col("duration").alias("asset_seconds"), "width", "height")
    alternates = asked.join(assets, "doc_id").withColumn(
        "score", F.lit(40.0) + F.col("doc_id") % 60
    ).drop("conv_id", "turn")
    off = F.when(F.col("conv_id") % 10 == 9, 100).otherwise(0)
    edits = rows.where(F.col("turn") % 2 == 0).select(
        "project_id", (F.col("clip_number") + off).alias("clip_number"), (F.col("turn") % 4).cast("int").alias("alternate_index")
    )
    merged, rejected = checks.swap_alternates(rows, alternates, edits)
    asset = ("source", "source_id", "media_type", "selected_text", "asset_seconds", "width", "height", "score", "placeholder")
    kept = merged.select("project_id", "clip_number", *asset, "note", F.lit("row").alias("kind"))
    nothing = [F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in asset]
    return kept.unionByName(rejected.select("project_id", "clip_number", *nothing, F.col("problem").alias("note"), F.lit("rejected").alias("kind")))


@register("coded_pairs", O.query(f"""
SELECT event_id, {O.code(O.half_even('value'))} AS start, {O.code('(CASE WHEN ' + O.half_even('value + 0.75E0') + ' = '
 + O.half_even('value') + ' THEN ' + O.half_even('value') + ' + 1 ELSE ' + O.half_even('value + 0.75E0') + ' END)')} AS "end"
FROM progress"""))
def coded_pairs(v: Views) -> DataFrame:
    start, end = code_pair("value", F.col("value") + 0.75)
    return v.progress.select("event_id", start.alias("start"), end.alias("end"))
