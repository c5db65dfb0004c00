"""Denylists, quality gates, labels and search order over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark import config as C
from mediaspark.functions import media, text
from mediaspark.operators import checks, denylist, packing, retrieval, terms
from mediaspark.queries import oracle as O
from mediaspark.queries import timing
from mediaspark.queries.registry import register
from mediaspark.views import CATEGORIES, Views

_VIOLATES = lambda c: O.by_category(lambda k: O.mentions(c, k.banned), otherwise="FALSE")
_SAFE = lambda c: f"CASE WHEN {_VIOLATES(c)} THEN {O.by_category(lambda k: O.lit(k.safe))} ELSE {c} END"


@register("denylist_keywords", O.query(f"""
SELECT project_id, clip_number, category, {_VIOLATES('canva_keyword')} AS canva_hit, {_SAFE('canva_keyword')} AS canva_keyword,
 {_SAFE('fallback_keyword')} AS fallback_keyword,
 array_to_string(list_transform(phrases, lambda p: {_SAFE('p')}), '; ') AS phrases FROM clips"""))
def denylist_keywords(v: Views) -> DataFrame:
    return v.clips.select(
        "project_id", "clip_number", "category",
        terms.violates("canva_keyword", "category", CATEGORIES).alias("canva_hit"),
        terms.make_safe("canva_keyword", "category", CATEGORIES).alias("canva_keyword"),
        terms.make_safe("fallback_keyword", "category", CATEGORIES).alias("fallback_keyword"),
        F.array_join(terms.make_all_safe("phrases", "category", CATEGORIES), "; ").alias("phrases"),
    )


@register("denylist_candidates", O.query("SELECT doc_id, key AS category, term AS banned_term FROM banned_rows WHERE term IS NOT NULL"))
def denylist_candidates(v: Views) -> DataFrame:
    lowered = v.hits.select("doc_id", F.lower("text").alias("_lower"))
    named = terms.first_banned_by_category("_lower", CATEGORIES, lowered=True)
    rows = lowered.select("doc_id", F.explode(named).alias("category", "banned_term"))
    return rows.where(F.col("banned_term").isNotNull())


@register("denylist_by_table", O.query("SELECT doc_id, key AS category, term AS banned_term FROM banned_rows WHERE term IS NOT NULL"))
def denylist_by_table(v: Views) -> DataFrame:
    """The same with the term lists in a table instead of in the plan."""
    rows = [(c.key, list(c.banned), list(c.positive)) for c in CATEGORIES]
    lists = v.spark.createDataFrame(rows, "category string, banned array<string>, positive array<string>")
    found = denylist.first_banned(v.hits.select(F.col("doc_id").alias("entry_id"), "text"), lists)
    return found.withColumnRenamed("entry_id", "doc_id")


@register("low_res_filter", O.query("""
SELECT doc_id, width, height, width > 0 AND height > 0 AND least(width, height) < 480 AS known_low_res,
 NOT (width > 0 AND height > 0) OR least(width, height) < 480 AS too_low_res FROM hits"""))
def low_res_filter(v: Views) -> DataFrame:
    return v.hits.select(
        "doc_id", "width", "height", media.known_low_res("width", "height").alias("known_low_res"),
        media.too_low_res("width", "height").alias("too_low_res"),
    )


# Sizes that fall on every branch come from the document length.
_W, _H = "(n_chars * 7 % 2400)", "(n_chars * 3 % 1400)"


@register("aspect_fit_plan", O.query(f"""
SELECT doc_id, w AS width, h AS height, landscape, w > 0 AND h > 0 AND NOT landscape AS known_other,
 CASE WHEN w > 0 AND h > 0 AND err < 0.001E0 THEN 'none' WHEN w <= 0 OR h <= 0 OR least(w, h) < 480 THEN 'reject'
  WHEN w >= h THEN 'crop' ELSE 'blur_pad' END AS plan
FROM (SELECT *, w > 0 AND h > 0 AND w > h AND err <= 0.05E0 AS landscape FROM (
 SELECT doc_id, w, h, CASE WHEN h > 0 THEN abs(w::DOUBLE / h::DOUBLE - 16.0E0 / 9.0E0) ELSE 9.0E0 END AS err FROM (
  SELECT doc_id, {_W} AS w, {_H} AS h FROM documents
  UNION ALL SELECT doc_id, 16 * (n_chars % 130) AS w, 9 * (n_chars % 130) AS h FROM documents)))"""))
def aspect_fit_plan(v: Views) -> DataFrame:
    d = v.table("documents")
    n = F.col("n_chars")
    odd = d.select("doc_id", (n * 7 % 2400).alias("width"), (n * 3 % 1400).alias("height"))
    exact = d.select("doc_id", (n % 130 * 16).alias("width"), (n % 130 * 9).alias("height"))
    return odd.unionByName(exact).select(
        "doc_id", "width", "height", media.is_landscape("width", "height").alias("landscape"),
        media.known_not_landscape("width", "height").alias("known_other"), media.fit_plan("width", "height").alias("plan"),
    )


@register("resolution_parse", O.query("""
SELECT page_id, CASE WHEN bad THEN 0 ELSE a END AS width, CASE WHEN bad THEN 0 ELSE b END AS height FROM (
 SELECT page_id, CAST(length(url) * 10 AS INT) AS a, CAST(length(html) % 2000 AS INT) AS b, page_id % 5 = 4 AS bad FROM pages)"""))
def resolution_parse(v: Views) -> DataFrame:
    size = F.format_string("%dx%d", F.length("url") * 10, F.length("html") % 2000)
    rows = v.table("pages").select(
        "page_id", F.when(F.col("page_id") % 5 == 4, F.col("url")).otherwise(size).alias("resolution")
    )
    width, height = media.parse_resolution("resolution")
    return rows.select("page_id", width.alias("width"), height.alias("height"))


_GATE = "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (doc_id % 40) / 100.0E0 END"


@register("verification_gate", O.query(f"""
SELECT doc_id, score, coalesce(score >= 0.2E0, TRUE) AS passed FROM (SELECT doc_id, {_GATE} AS score FROM hits)"""))
def verification_gate(v: Views) -> DataFrame:
    rows = v.hits.select("doc_id", F.when(F.col("doc_id") % 11 != 0, F.col("doc_id") % 40 / 100.0).alias("score"))
    return rows.select("doc_id", "score", checks.verification_passes("score").alias("passed"))


@register("enum_normalise", O.query(f"""
SELECT project_id, clip_number, CASE WHEN visual_type IN {O.inside(C.VISUAL_TYPES)} THEN visual_type ELSE 'B-roll' END AS visual_type,
 CASE WHEN section IN ('fast', 'medium', 'slow') THEN section ELSE 'medium' END AS pacing,
 CASE WHEN section IN ('fade', 'slide', 'zoom', 'hard_cut') THEN section ELSE 'fade' END AS transition_style,
 CASE WHEN section IN ('video', 'image') THEN section ELSE 'video' END AS media_type,
 array_to_string({O.words('script_beat')}[1:15], ' ') AS emphasis FROM clips_base"""))
def enum_normalise(v: Views) -> DataFrame:
    return v.clip_rows.select(
        "project_id", "clip_number", media.valid_visual_type("visual_type").alias("visual_type"),
        media.pacing("section").alias("pacing"), media.transition_style("section").alias("transition_style"),
        media.media_type("section").alias("media_type"),
        F.array_join(F.slice(text.words("script_beat"), 1, 15), " ").alias("emphasis"),
    )


@register("edit_labels", O.query(f"""
SELECT project_id, clip_number, CASE WHEN visual_type IN {O.inside(C.HISTORICAL_TYPES)} THEN 'historical'
  WHEN visual_type IN {O.inside(C.MODERN_TYPES)} THEN 'modern' ELSE 'general' END AS era,
 {timing._pick_sql(0)} AS effect, {timing._pick_sql(1)} AS transition FROM clips"""))
def edit_labels(v: Views) -> DataFrame:
    effect, transition = media.edit_effect("visual_type")
    return v.clips.select(
        "project_id", "clip_number", media.era("visual_type").alias("era"), effect.alias("effect"),
        transition.alias("transition"),
    )


O.CTES["search_order"] = f"""
SELECT project_id, clip_number, source, row_number() OVER (PARTITION BY project_id, clip_number ORDER BY r) AS place FROM (
 SELECT project_id, clip_number, visual_type, category, conv_id, source, {O.provider_rank()} AS r
 FROM clips, (SELECT unnest({O.strings(C.PROVIDERS_DEFAULT)}) AS source) WHERE {O.provider_active()}
 AND (conv_id % 4 <> 1 OR source = 'local_library') AND (conv_id % 4 <> 2 OR source <> 'local_library'))"""


def _search_order(v: Views) -> DataFrame:
    """Sources of every beat; one project in four has the stock sources off,
    one in four the library."""
    rows = v.clips.select(
        "project_id", "clip_number", "visual_type", "category", "conv_id",
        F.explode(F.array(*[F.lit(s) for s in C.PROVIDERS_DEFAULT])).alias("source"),
    )
    active = retrieval.provider_active(
        categories=CATEGORIES, library=F.col("conv_id") % 4 != 2, stock=F.col("conv_id") % 4 != 1
    )
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("project_id", "clip_number").orderBy("_r"))
    return rows.where(active).withColumn("_r", retrieval.provider_rank()).withColumn("place", place)


@register("provider_order", O.query("SELECT project_id, clip_number, source, CAST(place AS INT) AS place FROM search_order"))
def provider_order(v: Views) -> DataFrame:
    return _search_order(v).select("project_id", "clip_number", "source", "place")


@register("active_providers", O.query("""
SELECT c.project_id, c.clip_number, count(o.source) AS providers FROM clips c
LEFT JOIN search_order o ON c.project_id = o.project_id AND c.clip_number = o.clip_number GROUP BY 1, 2"""))
def active_providers(v: Views) -> DataFrame:
    counts = _search_order(v).groupBy("project_id", "clip_number").agg(F.count("*").alias("n"))
    return v.clip_rows.select("project_id", "clip_number").join(counts, ["project_id", "clip_number"], "left").select(
        "project_id", "clip_number", F.coalesce("n", F.lit(0)).cast("long").alias("providers")
    )


@register("url_slug", O.query(r"""
SELECT page_id, replace(regexp_replace(list_extract(string_split(rtrim(url, '/'), '/'), -1), '-\d+$', ''), '-', ' ') AS slug,
 CASE WHEN page_id % 3 = 1 THEN '.html' ELSE '.jpg' END AS ext FROM (
 SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '/semi-truck-on-road-' || CAST(page_id AS VARCHAR) || '/'
  WHEN 1 THEN 'https://a.example/p/clip-' || CAST(page_id AS VARCHAR) || '.html?x=' || CAST(page_id AS VARCHAR)
  ELSE 'https://a.example/p/plain-name' END AS url FROM pages)"""))
def url_slug(v: Views) -> DataFrame:
    number = F.col("page_id").cast("string")
    url = (
        F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/semi-truck-on-road-"), number, F.lit("/")))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://a.example/p/clip-"), number, F.lit(".html?x="), number))
        .otherwise(F.lit("https://a.example/p/plain-name"))
    )
    rows = v.table("pages").select("page_id", url.alias("url"))
    return rows.select("page_id", text.url_slug("url").alias("slug"), text.url_extension("url", F.lit("image")).alias("ext"))


@register("name_slugs", O.query(f"""
SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key_slug,
 CASE WHEN safe = '' THEN 'final_video_with_narration.mp4' ELSE safe || '.mp4' END AS file_name FROM (
 SELECT doc_id, text, regexp_replace(regexp_replace({O.strip("regexp_replace(text, '[<>:\"/\\\\|?*\\x00-\\x1f]', '', 'g')")},
  {O.WS}, '_', 'g'), '^_+|_+$', '', 'g') AS safe FROM documents)"""))
def name_slugs(v: Views) -> DataFrame:
    return v.table("documents").select(
        "doc_id", text.key_slug("text").alias("key_slug"), text.final_video_name("text").alias("file_name")
    )


@register("sentence_split", O.query(f"""
SELECT doc_id, CAST(i AS INT) AS sentence_no, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
 SELECT doc_id, list_filter(string_split(regexp_replace({O.strip('text')}, '([.!?]){O.SPACE}+', '\\1' || chr(1), 'g'), chr(1)),
  lambda x: x <> '') AS s FROM documents))"""))
def sentence_split(v: Views) -> DataFrame:
    rows = v.table("documents").select("doc_id", F.posexplode(text.sentences("text")).alias("pos", "sentence"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("sentence_no"), "sentence")


O.CTES["sentence_rows"] = f"""
SELECT doc_id, s[i] AS sentence, i, len({O.words('s[i]')}) AS n FROM (
 SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
  SELECT doc_id, list_filter(string_split(regexp_replace({O.strip('text')}, '([.!?]){O.SPACE}+', '\\1' || chr(1), 'g'), chr(1)),
   lambda x: x <> '') AS s FROM documents))"""


# SQL takes the sentences in turn.
@register("chunk_pack", O.query(f"""
SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, CAST(sum(n) AS INT) AS n_words, string_agg(sentence, ' ' ORDER BY i) AS chunk FROM (
 WITH RECURSIVE walk AS (
  SELECT doc_id, i, n, n AS held, 0 AS chunk_no, sentence FROM sentence_rows WHERE i = 1
  UNION ALL
  SELECT r.doc_id, r.i, r.n, CASE WHEN w.held + r.n > {C.CHUNK_WORDS} THEN r.n ELSE w.held + r.n END,
   w.chunk_no + CASE WHEN w.held + r.n > {C.CHUNK_WORDS} THEN 1 ELSE 0 END, r.sentence
  FROM walk w JOIN sentence_rows r ON w.doc_id = r.doc_id AND r.i = w.i + 1)
 SELECT * FROM walk) GROUP BY doc_id, chunk_no"""))
def chunk_pack(v: Views) -> DataFrame:
    return packing.pack_texts(v.table("documents"), C.CHUNK_WORDS)


@register("scripts_accepted", O.query(f"""
SELECT doc_id, {O.strip('text')} <> '' AS accepted FROM (
 SELECT doc_id, CASE WHEN n_chars % 9 = 0 THEN chr(32) || chr(9) ELSE text END AS text FROM documents)"""))
def scripts_accepted(v: Views) -> DataFrame:
    body = F.when(F.col("n_chars") % 9 == 0, F.lit(" \t")).otherwise(F.col("text"))
    return v.table("documents").select("doc_id", (~text.is_blank(body)).alias("accepted"))


@register("generation_prompts", O.query(f"""
SELECT project_id, clip_number, canva_keyword || CASE WHEN section = 'system' THEN '' ELSE '. ' || section END || '. '
 || {O.by_category(lambda c: O.lit(c.display_name))} || ' context, photorealistic, natural lighting.' AS prompt FROM clips"""))
def generation_prompts(v: Views) -> DataFrame:
    names = F.create_map(*[F.lit(x) for c in CATEGORIES for x in (c.key, c.display_name)])
    note = F.when(F.col("section") == "system", F.lit("")).otherwise(F.col("section"))
    return v.clips.select(
        "project_id", "clip_number", text.generation_prompt("canva_keyword", note, names[F.col("category")]).alias("prompt")
    )
