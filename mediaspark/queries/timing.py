"""Timing of beats, captions and subtitles over the derived beats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark.functions import media
from mediaspark.functions.text import word_count
from mediaspark.functions.timecode import srt_code, to_code, to_seconds
from mediaspark.operators import captions, checks, timeline
from mediaspark.plans.materialise import written
from mediaspark.queries import oracle as O
from mediaspark.queries.registry import register
from mediaspark.views import Views

CTES = {
    "paced_raw": """
SELECT project_id, clip_number, script_beat, word_count,
 coalesce(sum(d) OVER (PARTITION BY project_id ORDER BY clip_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0E0)
  AS start_s, d FROM (SELECT *, greatest(3.0E0, least(5.0E0, word_count::DOUBLE / 2.0E0)) AS d FROM clips_base)""",
    "paced": f"""
SELECT * EXCLUDE (d), start_s + d AS end_s, {O.code(O.half_even('start_s'))} AS start_code,
 {O.code('(CASE WHEN ' + O.half_even('start_s + d') + ' = ' + O.half_even('start_s') + ' THEN ' + O.half_even('start_s')
         + ' + 1 ELSE ' + O.half_even('start_s + d') + ' END)')} AS end_code FROM paced_raw""",
    "cascade": """
SELECT project_id, clip_number, start_s, end_s FROM (
 WITH RECURSIVE walk AS (
  SELECT project_id, clip_number, CASE WHEN exhausted THEN 0.0E0 ELSE greatest(span_start, 0.0E0) END AS start_s,
   CASE WHEN exhausted THEN 3.0E0 ELSE greatest(span_end, greatest(span_start, 0.0E0) + 2.0E0) END AS end_s
  FROM spans WHERE clip_number = 1
  UNION ALL
  SELECT s.project_id, s.clip_number, CASE WHEN s.exhausted THEN w.end_s ELSE greatest(s.span_start, w.end_s) END,
   CASE WHEN s.exhausted THEN w.end_s + 3.0E0 ELSE greatest(s.span_end, greatest(s.span_start, w.end_s) + 2.0E0) END
  FROM walk w JOIN spans s ON s.project_id = w.project_id AND s.clip_number = w.clip_number + 1)
 SELECT * FROM walk)""",
    "coded": f"""
SELECT c.project_id, c.clip_number, b.script_beat, {O.code(O.half_even('start_s'))} AS start_code,
 {O.code('(CASE WHEN ' + O.half_even('end_s') + ' = ' + O.half_even('start_s') + ' AND end_s > start_s THEN '
         + O.half_even('start_s') + ' + 1 ELSE ' + O.half_even('end_s') + ' END)')} AS end_code
FROM cascade c JOIN clips_base b ON c.project_id = b.project_id AND c.clip_number = b.clip_number""",
    "contiguous": """
SELECT project_id, clip_number, script_beat, end_code,
 coalesce(lag(end_code) OVER (PARTITION BY project_id ORDER BY clip_number), start_code) AS start_code FROM coded""",
    "seconds": """
SELECT *, CAST(substr(start_code,1,2) AS BIGINT) * 3600 + CAST(substr(start_code,4,2) AS BIGINT) * 60
  + CAST(substr(start_code,7,2) AS BIGINT) AS b,
 CAST(substr(end_code,1,2) AS BIGINT) * 3600 + CAST(substr(end_code,4,2) AS BIGINT) * 60
  + CAST(substr(end_code,7,2) AS BIGINT) AS e FROM contiguous""",
    "spoken": f"""
SELECT project_id, clip_number, n_words, i - 1 AS pos, w[i] AS word,
 least(e::DOUBLE, b::DOUBLE + (i - 1) * per) AS word_start, least(e::DOUBLE, b::DOUBLE + i * per) AS word_end
FROM (SELECT *, len(w) AS n_words, (e - b)::DOUBLE / len(w) AS per, unnest(range(1, len(w) + 1)) AS i
 FROM (SELECT *, {O.words('script_beat')} AS w FROM seconds) WHERE e > b AND len(w) > 0)""",
    "line_words": f"""
SELECT *, (row_number() OVER (PARTITION BY project_id ORDER BY clip_number, pos) - 1) AS place,
 {O.half_even('word_start * 30')} AS sf, {O.half_even('word_end * 30')} AS ef FROM spoken""",
    "lines": """
SELECT project_id, place // 7 AS line_no, min(sf) AS start_frame, arg_max(sf + greatest(1, ef - sf), place) AS end_frame,
 min(word_start) AS start_s, max(word_end) AS end_s, string_agg(word, ' ' ORDER BY place) AS line
FROM line_words GROUP BY project_id, place // 7""",
    "parts": f"""
SELECT *, unnest(range(0, n)) AS i FROM (
 SELECT *, CAST(greatest(1, ceil((e - b)::DOUBLE / 5.0E0)) AS BIGINT) AS n, {O.words('script_beat')} AS w FROM seconds)""",
    "part_times": """
SELECT *, b::DOUBLE + i * ((e - b)::DOUBLE / n) AS ps,
 CASE WHEN i = n - 1 THEN e::DOUBLE ELSE b::DOUBLE + (i + 1) * ((e - b)::DOUBLE / n) END AS pe,
 CAST(greatest(1, ceil(len(w)::DOUBLE / n)) AS BIGINT) AS per FROM parts""",
    "split_rows": f"""
SELECT project_id, clip_number AS parent_clip, CAST(i + 1 AS INT) AS part,
 CAST(row_number() OVER (PARTITION BY project_id ORDER BY clip_number, i) AS INT) AS clip_number,
 CASE WHEN n = 1 THEN start_code ELSE {O.code(O.half_even('ps'))} END AS start_code,
 CASE WHEN n = 1 THEN end_code ELSE {O.code('(CASE WHEN ' + O.half_even('pe') + ' = ' + O.half_even('ps') + ' THEN '
   + O.half_even('ps') + ' + 1 ELSE ' + O.half_even('pe') + ' END)')} END AS end_code,
 CASE WHEN n = 1 OR len(w) < n OR len(w[i * per + 1 : (i + 1) * per]) = 0 THEN script_beat
  ELSE array_to_string(w[i * per + 1 : (i + 1) * per], ' ') END AS script_beat FROM part_times""",
    "framed": """
SELECT project_id, clip_number, b * 30 AS start_frame, greatest(1, e * 30 - b * 30) AS duration_frames FROM seconds""",
    "entries": f"""
SELECT project_id, clip_number, b AS start_sec, e AS end_sec, start_code, end_code, script_beat, visual_type, category,
 canva_keyword, turn, conv_id, (e - b)::DOUBLE AS duration,
 CASE WHEN held THEN NULL WHEN attempted AND (conv_id + turn) % 3 = 0 THEN 'ai_generated' ELSE source END AS source,
 CASE WHEN held THEN NULL ELSE source_id END AS source_id, CASE WHEN held THEN NULL ELSE media_type END AS media_type,
 CASE WHEN held THEN NULL ELSE text END AS selected_text, CASE WHEN held THEN NULL ELSE asset_seconds END AS asset_seconds,
 CASE WHEN held THEN NULL ELSE width END AS width, CASE WHEN held THEN NULL ELSE height END AS height,
 CASE WHEN held THEN NULL ELSE doc_id END AS doc_id,
 CASE WHEN held THEN NULL ELSE score END AS score, held AS placeholder, attempted AS generation_attempted,
 CASE WHEN attempted AND (conv_id + turn) % 3 <> 0 THEN 'quota' END AS generation_failure_reason,
 turn % 4 = 1 AS has_fill, CASE WHEN held THEN 'no candidate' ELSE '' END AS note
FROM (SELECT s.project_id, s.clip_number, s.b, s.e, s.start_code, s.end_code, s.script_beat, c.visual_type, c.category,
  c.canva_keyword, c.turn, c.conv_id, (c.conv_id + c.turn) % 9 = 0 AS held,
  40.0E0 + h.doc_id % 60 < 75 AS attempted, h.source, h.source_id, h.media_type, h.text, h.duration AS asset_seconds,
  h.width, h.height, h.doc_id, 40.0E0 + h.doc_id % 60 AS score
 FROM seconds s JOIN clips c ON s.project_id = c.project_id AND s.clip_number = c.clip_number
 JOIN hits h ON h.doc_id = (c.conv_id * 17 + c.turn * 3) % (SELECT count(*) FROM documents))""",
}
O.CTES.update(CTES)


def cascaded(v: Views) -> DataFrame:
    """Cascaded spans with codes and the text of their beats."""
    rows = timeline.with_codes(timeline.floor_cascade(v.spans, longest=v.longest))
    return rows.join(v.clip_rows.select("project_id", "clip_number", "script_beat"), ["project_id", "clip_number"])


def contiguous(v: Views) -> DataFrame:
    return timeline.force_contiguity(cascaded(v), longest=v.longest)


def entries(v: Views) -> DataFrame:
    """A resolved timeline: contiguous beats with an asset each, some held
    back as placeholders and some handed to generation."""
    rows = contiguous(v).select("project_id", "clip_number", "start", "end")
    beats = v.clips.drop("phrases", "vec_id", "word_count").join(rows, ["project_id", "clip_number"])
    beats = beats.withColumn("doc_id", (F.col("conv_id") * 17 + F.col("turn") * 3) % v.n_documents)
    assets = v.hits.select(
        "doc_id", "source", "source_id", "media_type", F.col("text").alias("selected_text"),
        F.col("duration").alias("asset_seconds"), "width", "height",
    )
    joined = beats.join(assets, "doc_id")
    held = (F.col("conv_id") + F.col("turn")) % 9 == 0
    score = F.lit(40.0) + F.col("doc_id") % 60
    attempted = score < 75
    generated = attempted & ((F.col("conv_id") + F.col("turn")) % 3 == 0)
    kept = lambda c: F.when(~held, c)
    return joined.select(
        "project_id", "clip_number", "start", "end", "script_beat", "visual_type", "category", "canva_keyword", "turn",
        "conv_id", (to_seconds("end") - to_seconds("start")).cast("double").alias("duration"),
        kept(F.when(generated, F.lit("ai_generated")).otherwise(F.col("source"))).alias("source"),
        *[kept(F.col(c)).alias(c) for c in
          ("source_id", "media_type", "selected_text", "asset_seconds", "width", "height", "doc_id")],
        kept(score).alias("score"), held.alias("placeholder"), attempted.alias("generation_attempted"),
        F.when(attempted & ~generated, F.lit("quota")).alias("generation_failure_reason"),
        (F.col("turn") % 4 == 1).alias("has_fill"), F.when(held, F.lit("no candidate")).otherwise(F.lit("")).alias("note"),
    )


@register("pace_timing", O.query(
    "SELECT project_id, clip_number, start_s, end_s, start_code AS start, end_code AS \"end\" FROM paced"))
def pace_timing(v: Views) -> DataFrame:
    return timeline.pace_timing(v.clip_rows, longest=v.longest).select("project_id", "clip_number", "start_s", "end_s", "start", "end")


@register("floor_cascade", O.query("SELECT project_id, clip_number, start_s, end_s FROM cascade"))
def floor_cascade(v: Views) -> DataFrame:
    return timeline.floor_cascade(v.spans, longest=v.longest).select("project_id", "clip_number", "start_s", "end_s")


@register("force_contiguity", O.query(
    "SELECT project_id, clip_number, start_code AS start, end_code AS \"end\" FROM contiguous"))
def force_contiguity(v: Views) -> DataFrame:
    return contiguous(v).select("project_id", "clip_number", "start", "end")


@register("contiguity_violations", O.query("""
SELECT project_id, clip_number, end_code AS "end", next_clip_number, next_start FROM (
 SELECT *, lead(clip_number) OVER w AS next_clip_number, lead(start_code) OVER w AS next_start FROM coded
 WINDOW w AS (PARTITION BY project_id ORDER BY clip_number)) WHERE next_start <> end_code"""))
def contiguity_violations(v: Views) -> DataFrame:
    return timeline.contiguity_violations(cascaded(v), longest=v.longest)


@register("split_long_rows", O.query("""
SELECT project_id, parent_clip, part, clip_number, end_code AS "end",
 coalesce(lag(end_code) OVER (PARTITION BY project_id ORDER BY clip_number), start_code) AS start, script_beat
FROM split_rows"""))
def split_long_rows(v: Views) -> DataFrame:
    # written, as the scan that follows looks for the highest position first
    rows = written(timeline.split_long_rows(contiguous(v), longest=v.longest), "split")
    return timeline.force_contiguity(rows).select(
        "project_id", "parent_clip", "part", "clip_number", "start", "end", "script_beat"
    )


@register("word_timings", O.query(
    "SELECT project_id, clip_number, CAST(pos AS INT) AS pos, word, round(word_start, 6) AS word_start, "
    "round(word_end, 6) AS word_end FROM spoken"))
def word_timings(v: Views) -> DataFrame:
    return timeline.word_timings(contiguous(v)).select(
        "project_id", "clip_number", "pos", "word", F.round("word_start", 6).alias("word_start"),
        F.round("word_end", 6).alias("word_end"),
    )


def _lines(v: Views) -> DataFrame:
    rows = contiguous(v)
    return captions.caption_lines(timeline.word_timings(rows), longest=v.longest)


@register("caption_lines", O.query("SELECT project_id, line_no, start_frame, end_frame, line FROM lines"))
def caption_lines(v: Views) -> DataFrame:
    return _lines(v).select("project_id", "line_no", "start_frame", "end_frame", "line")


@register("active_line", O.query("""
SELECT project_id, frame, line_no, line FROM (
 SELECT f.project_id, f.frame, l.line_no, l.line,
  row_number() OVER (PARTITION BY f.project_id, f.frame ORDER BY l.line_no) AS rn
 FROM (SELECT DISTINCT project_id, start_frame + duration_frames // 2 AS frame FROM framed) f
 JOIN lines l ON f.project_id = l.project_id AND l.start_frame <= f.frame AND f.frame < l.end_frame) WHERE rn = 1"""))
def active_line(v: Views) -> DataFrame:
    framed = timeline.frame_bounds(contiguous(v))
    middle = F.col("start_frame") + F.floor(F.col("duration_frames") / 2).cast("long")
    return captions.active_line(framed.select("project_id", middle.alias("frame")).distinct(), _lines(v))


@register("emphasised_words", O.query("""
SELECT s.project_id, s.clip_number, CAST(s.pos AS INT) AS pos, s.word,
 k.project_id IS NOT NULL AND clean <> '' AS emphasised
FROM (SELECT *, lower(regexp_replace(word, '[^A-Za-z0-9_'']', '', 'g')) AS clean FROM spoken) s
LEFT JOIN (SELECT DISTINCT project_id, lower(unnest(string_split(canva_keyword, ' '))) AS kw FROM clips) k
 ON s.project_id = k.project_id AND s.clean = k.kw"""))
def emphasised_words(v: Views) -> DataFrame:
    words = timeline.word_timings(contiguous(v)).select("project_id", "clip_number", "pos", "word")
    marks = v.clips.select("project_id", F.explode(F.split("canva_keyword", " ")).alias("word"))
    return captions.emphasised(words, marks)


@register("frame_bounds", O.query("""
SELECT f.project_id, clip_number, start_frame, duration_frames, total_frames FROM framed f JOIN (
 SELECT project_id, arg_max(start_frame + duration_frames, clip_number) AS total_frames FROM framed GROUP BY project_id) t
 ON f.project_id = t.project_id"""))
def frame_bounds(v: Views) -> DataFrame:
    framed = timeline.frame_bounds(contiguous(v)).select("project_id", "clip_number", "start_frame", "duration_frames")
    return framed.join(timeline.total_frames(framed), "project_id")


def _srt_sql(seconds: str) -> str:
    ms = O.half_even(f"{seconds} * 1000")
    return (
        f"lpad(CAST({ms} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} % 3600000 // 60000 AS VARCHAR), 2, '0') || "
        f"':' || lpad(CAST({ms} % 60000 // 1000 AS VARCHAR), 2, '0') || ',' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0')"
    )


@register("srt_blocks", O.query(f"""
SELECT project_id, line_no + 1 AS cue_no, CAST(line_no + 1 AS VARCHAR) || chr(10) || {_srt_sql('round(start_s, 6)')} || ' --> '
 || {_srt_sql('round(end_s, 6)')} || chr(10) || line || chr(10) AS block FROM lines"""))
def srt_blocks(v: Views) -> DataFrame:
    number = F.col("line_no") + 1
    block = captions.srt_block(number, F.round("start_s", 6), F.round("end_s", 6), "line")
    return _lines(v).select("project_id", number.alias("cue_no"), block.alias("block"))


@register("tail_gap", O.query(f"""
SELECT a.project_id, audio_end - last_end AS uncovered_seconds, greatest(said - used, 0) AS unused_words,
 audio_end - last_end > 0.5E0 AND said - used > 0 AS needs_rows
FROM (SELECT project_id, max(span_end) AS audio_end FROM spans GROUP BY project_id) a
JOIN (SELECT project_id, CAST(sum(len({O.words('script_beat')})) AS BIGINT) AS said FROM clips_base GROUP BY project_id) w
 ON a.project_id = w.project_id
JOIN (SELECT project_id, max(end_s) AS last_end, CAST(sum(word_count) AS BIGINT) AS used FROM paced GROUP BY project_id) p
 ON a.project_id = p.project_id"""))
def tail_gap(v: Views) -> DataFrame:
    audio = v.spans.groupBy("project_id").agg(F.max("span_end").alias("audio_end"))
    said = v.clip_rows.groupBy("project_id").agg(F.sum(word_count("script_beat")).alias("n_words"))
    rows = timeline.pace_timing(v.clip_rows, longest=v.longest).select("project_id", "end_s", F.col("word_count").alias("n_words"))
    return timeline.tail_gap(audio.join(said, "project_id"), rows)


@register("timecodes", O.query(f"""
SELECT event_id, {O.code('t')} AS code, t AS seconds, {_srt_sql('value')} AS srt, {O.half_even('value * 30')} AS frames
FROM (SELECT event_id, value, {O.half_even('value * 37.5E0')} AS t FROM progress)"""))
def timecodes(v: Views) -> DataFrame:
    code = to_code(F.col("value") * 37.5)
    return v.progress.select(
        "event_id", code.alias("code"), to_seconds(code).alias("seconds"), srt_code("value").alias("srt"),
        F.rint(F.col("value") * 30).cast("long").alias("frames"),
    )


@register("render_status", O.query("""
SELECT project_id, clip_number, round(CASE WHEN duration > 0 THEN asset_seconds / duration END, 9) AS speed,
 CASE WHEN placeholder THEN 'missing' WHEN media_type = 'image' THEN 'ok'
  WHEN asset_seconds > 0.05E0 AND duration > 0.05E0 AND abs(asset_seconds - duration) > 0.05E0
   AND asset_seconds / duration >= 0.7E0 AND asset_seconds / duration <= 1.4E0 THEN 'speed-matched'
  WHEN asset_seconds < duration - 0.05E0 THEN CASE WHEN has_fill THEN 'split-fill' ELSE 'speed-matched' END
  WHEN asset_seconds > duration + 0.05E0 THEN 'trimmed' ELSE 'ok' END AS status FROM entries"""))
def render_status(v: Views) -> DataFrame:
    rows = entries(v)
    return rows.select(
        "project_id", "clip_number",
        F.round(media.required_speed("asset_seconds", "duration"), 9).alias("speed"),
        media.render_status("placeholder", "media_type", "asset_seconds", "duration", "has_fill").alias("status"),
    )


def _pick_sql(position: int) -> str:
    from mediaspark.config import DEFAULT_EFFECT, EDIT_EFFECTS

    cases = " ".join(f"WHEN {O.lit(k)} THEN {O.lit(p[position])}" for k, p in EDIT_EFFECTS.items())
    return f"CASE visual_type {cases} ELSE {O.lit(DEFAULT_EFFECT[position])} END"


@register("render_segments", O.query(f"""
SELECT e.project_id, e.clip_number, start_frame, duration_frames, {_pick_sql(0)} AS effect,
 coalesce(media_type, 'image') AS media_type,
 CASE WHEN {_pick_sql(1)} = 'hard cut' THEN 'hard_cut' ELSE 'dissolve' END AS boundary,
 least(CASE turn % 3 WHEN 0 THEN 6 WHEN 1 THEN 12 ELSE 20 END, duration_frames // 2) AS boundary_frames
FROM entries e JOIN framed f ON e.project_id = f.project_id AND e.clip_number = f.clip_number"""))
def render_segments(v: Views) -> DataFrame:
    rows = timeline.frame_bounds(entries(v))
    effect, transition = media.edit_effect("visual_type")
    pace = F.element_at(F.array(F.lit("fast"), F.lit("medium"), F.lit("slow")), (F.col("turn") % 3 + 1).cast("int"))
    return rows.select(
        "project_id", "clip_number", "start_frame", "duration_frames", effect.alias("effect"),
        F.coalesce("media_type", F.lit("image")).alias("media_type"), media.boundary(transition).alias("boundary"),
        media.boundary_frames(pace, "duration_frames").alias("boundary_frames"),
    )


@register("orientation_violations", O.query("""
SELECT project_id, clip_number, width, height, round(CASE WHEN height > 0 THEN width::DOUBLE / height ELSE 0.0E0 END, 6) AS ratio
FROM entries WHERE NOT placeholder AND source IS NOT NULL AND NOT (width > 0 AND height > 0 AND width > height
 AND coalesce(abs(width::DOUBLE / nullif(height, 0)::DOUBLE - 16.0E0 / 9.0E0), 9) <= 0.05E0)"""))
def orientation_violations(v: Views) -> DataFrame:
    return checks.orientation_violations(entries(v)).select(
        "project_id", "clip_number", "width", "height", F.round("ratio", 6).alias("ratio")
    )


@register("duration_totals", O.query("""
SELECT project_id, CAST(sum(round_even(duration * 30, 0)) AS BIGINT) AS total_frames, sum(duration) AS total_seconds
FROM entries GROUP BY project_id"""))
def duration_totals(v: Views) -> DataFrame:
    return timeline.duration_totals(entries(v))


@register("total_check", O.query("""
SELECT m.project_id, measured_seconds, expected_seconds,
 CASE WHEN width <> 1920 OR height <> 1080 THEN 'resolution' ELSE 'duration' END AS problem
FROM (SELECT project_id, sum(duration) + (max(conv_id) % 5) / 8.0E0 AS measured_seconds,
  CASE WHEN max(conv_id) % 6 = 0 THEN 1280 ELSE 1920 END AS width, 1080 AS height FROM entries GROUP BY project_id) m
JOIN (SELECT project_id, sum(duration) AS expected_seconds FROM entries GROUP BY project_id) x ON m.project_id = x.project_id
WHERE width <> 1920 OR height <> 1080 OR abs(measured_seconds - expected_seconds) > 0.25E0"""))
def total_check(v: Views) -> DataFrame:
    rows = entries(v)
    measured = rows.groupBy("project_id").agg(
        (F.sum("duration") + F.max("conv_id") % 5 / 8.0).alias("measured_seconds"),
        F.when(F.max("conv_id") % 6 == 0, 1280).otherwise(1920).alias("width"), F.lit(1080).alias("height"),
    )
    return checks.total_violations(rows, measured).select("project_id", "measured_seconds", "expected_seconds", "problem")
