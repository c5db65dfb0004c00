"""Library upkeep and vector search over the derived files and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark.functions.text import keywords_from_csv, keywords_to_csv, longest_first, overlap_tokens, query_text
from mediaspark.operators import dedup, library, ranking, reports, retrieval, similarity
from mediaspark.plans.materialise import written
from mediaspark.plans.skew import hot_join
from mediaspark.queries import oracle as O
from mediaspark.queries import search, timing
from mediaspark.queries.registry import register
from mediaspark.views import Views

# The generated vectors hold no pair at the default 0.75; see the tests for it.
PAIR_THRESHOLD = 0.4

O.CTES.update({
    "hashed": "SELECT name, folder, doc_id, size, content, sha256(content) AS hash FROM files",
    "index_hashed": "SELECT name, folder, doc_id, caption, sha256(caption) AS hash FROM library_index",
    "alike": f"""
SELECT id_a, id_b, score FROM (SELECT x.vec_id AS id_a, y.vec_id AS id_b,
  round(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: p[1] * p[2])), 9) AS score
 FROM vectors x JOIN vectors y ON x.vec_id < y.vec_id) WHERE score >= {PAIR_THRESHOLD}E0""",
    "clusters": """
SELECT id, min(other) AS cluster FROM (
 WITH RECURSIVE edges AS (SELECT id_a AS u, id_b AS v FROM alike UNION SELECT id_b, id_a FROM alike),
 reach AS (SELECT u AS id, u AS other FROM edges UNION SELECT r.id, e.v FROM reach r JOIN edges e ON r.other = e.u)
 SELECT * FROM reach) GROUP BY id""",
    "present": """
SELECT c.cluster, f.name, f.size FROM (SELECT 'clip_' || CAST(id AS VARCHAR) || '.mp4' AS name, cluster FROM clusters) c
JOIN files f ON c.name = f.name""",
    "removals": """
SELECT * FROM (SELECT cluster, first_value(name) OVER w AS keep, first_value(size) OVER w AS keep_size, name AS remove,
 size AS remove_size, row_number() OVER w AS rn FROM present
 WINDOW w AS (PARTITION BY cluster ORDER BY size DESC, name)) WHERE rn > 1""",
    "run": """
SELECT h.name, h.folder, h.hash, coalesce(k.known, CASE WHEN f.first < h.name THEN f.first END) AS duplicate_of, length(x.content) % 13 <> 0 AS usable
FROM hashed h ANTI JOIN library_index i ON h.name = i.name JOIN files x ON h.name = x.name
LEFT JOIN (SELECT hash, min(name) AS known FROM index_hashed GROUP BY hash) k ON h.hash = k.hash
LEFT JOIN (SELECT h2.hash, min(h2.name) AS first FROM hashed h2 ANTI JOIN library_index i2 ON h2.name = i2.name JOIN files x2 ON h2.name = x2.name
 WHERE length(x2.content) % 13 <> 0 GROUP BY h2.hash) f ON h.hash = f.hash""",
    "slugs": """
SELECT name, folder, CASE WHEN stem = '' THEN 'clip' ELSE stem END AS slug FROM (
 SELECT name, folder, array_to_string(list_filter(string_split_regex(lower(regexp_replace(content, '[^a-zA-Z0-9\\s_]', '', 'g')),
  '[\\s_]+'), lambda w: w <> '')[1:6], '_') AS stem FROM files)""",
})


@register("exact_dedup", O.query("""
SELECT name, hash, min(name) OVER (PARTITION BY hash) AS keep_name, min(name) OVER (PARTITION BY hash) <> name AS duplicate
FROM hashed"""))
def exact_dedup(v: Views) -> DataFrame:
    return dedup.exact_duplicates(dedup.content_hash(v.files)).select("name", "hash", "keep_name", "duplicate")


@register("near_dup_pairs", O.query("SELECT id_a, id_b, score FROM alike"))
def near_dup_pairs(v: Views) -> DataFrame:
    items = v.vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return similarity.near_pairs(items, PAIR_THRESHOLD)


def _clusters(v: Views) -> DataFrame:
    return dedup.components(written(near_dup_pairs(v), "pairs"))


@register("near_dup_clusters", O.query("SELECT id, cluster FROM clusters"))
def near_dup_clusters(v: Views) -> DataFrame:
    return _clusters(v)


def _plan(v: Views) -> DataFrame:
    named = _clusters(v).select(
        F.concat(F.lit("clip_"), F.col("id").cast("string"), F.lit(".mp4")).alias("name"), "cluster"
    )
    return dedup.removal_plan(named, v.files)


@register("removal_plan", O.query("SELECT cluster, keep, keep_size, remove, remove_size FROM removals"))
def removal_plan(v: Views) -> DataFrame:
    return _plan(v)


@register("removal_lines", O.query("""
SELECT remove, '- keep `' || keep || '` (' || CAST(keep_size AS VARCHAR) || ' bytes) — remove `' || remove || '` (' || CAST(remove_size AS VARCHAR)
 || ' bytes, smaller)' AS line FROM removals"""))
def removal_lines(v: Views) -> DataFrame:
    return reports.removal_lines(_plan(v))


@register("apply_removals", O.query("""
SELECT i.name, 'kept' AS state FROM library_index i WHERE i.name NOT IN (SELECT remove FROM removals)
UNION ALL SELECT f.name, 'quarantined' FROM files f WHERE f.name IN (SELECT remove FROM removals)"""))
def apply_removals(v: Views) -> DataFrame:
    index, gone = dedup.apply_removals(v.library_index, v.files, written(_plan(v), "plan"))
    kept = index.select("name", F.lit("kept").alias("state"))
    return kept.unionByName(gone.select("name", F.lit("quarantined").alias("state")))


@register("index_new_stale", O.query("""
SELECT CASE WHEN grouping(folder) = 1 THEN 'all' ELSE folder END AS folder, CAST(sum(new) AS BIGINT) AS new_files,
 CAST(sum(stale) AS BIGINT) AS stale_entries, CAST(sum(indexed) AS BIGINT) AS indexed FROM (
 SELECT folder, 1 AS new, 0 AS stale, 0 AS indexed FROM files WHERE name NOT IN (SELECT name FROM library_index)
 UNION ALL SELECT folder, 0, 1, 1 FROM library_index WHERE name NOT IN (SELECT name FROM files)
 UNION ALL SELECT folder, 0, 0, 1 FROM library_index WHERE name IN (SELECT name FROM files)) GROUP BY ROLLUP (folder)"""))
def index_new_stale(v: Views) -> DataFrame:
    new = dedup.new_files(v.files, v.library_index).select("folder", F.lit(1).alias("n"), F.lit(0).alias("s"), F.lit(0).alias("i"))
    stale = dedup.stale_entries(v.library_index, v.files).select("folder", F.lit(0).alias("n"), F.lit(1).alias("s"), F.lit(0).alias("i"))
    every = v.library_index.select("folder", F.lit(0).alias("n"), F.lit(0).alias("s"), F.lit(1).alias("i"))
    rolled = new.unionByName(stale).unionByName(every).rollup("folder").agg(
        F.grouping("folder").alias("_all"), F.sum("n").alias("new_files"), F.sum("s").alias("stale_entries"),
        F.sum("i").alias("indexed"),
    )
    return rolled.select(
        F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("folder")).alias("folder"),
        "new_files", "stale_entries", "indexed",
    )


@register("index_plan", O.query("""
SELECT name, CASE WHEN duplicate_of IS NOT NULL THEN 'duplicate' WHEN usable THEN 'indexed' ELSE 'failed' END AS status, duplicate_of FROM run"""))
def index_plan(v: Views) -> DataFrame:
    return _run(v).select("name", "status", "duplicate_of")


def _run(v: Views) -> DataFrame:
    index = dedup.content_hash(v.library_index, "caption")
    # a file whose length is a multiple of 13 stands for one that could not be described
    described = v.files.withColumn("caption", F.when(F.length("content") % 13 != 0, F.col("content")))
    return dedup.index_plan(dedup.content_hash(described).drop("content"), index.select("name", "hash"))


@register("index_summary", O.query("""
SELECT f.folder, count(*) FILTER (r.duplicate_of IS NULL AND r.usable) AS indexed, count(*) FILTER (r.duplicate_of IS NULL AND NOT r.usable) AS failed,
 count(*) FILTER (r.duplicate_of IS NOT NULL) AS duplicates, count(*) FILTER (r.name IS NULL) AS already_indexed
FROM files f LEFT JOIN run r ON f.name = r.name GROUP BY f.folder"""))
def index_summary(v: Views) -> DataFrame:
    run = _run(v).select("name", "status")
    every = v.files.select("name", "folder").join(run, "name", "left")
    return every.groupBy("folder").agg(
        F.count_if(F.col("status") == "indexed").alias("indexed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "duplicate").alias("duplicates"),
        F.count_if(F.col("status").isNull()).alias("already_indexed"),
    )


@register("unique_names", O.query("""
SELECT name, CASE WHEN k = 1 THEN slug ELSE slug || '_' || CAST(k AS VARCHAR) END || '.mp4' AS new_name FROM (
 SELECT name, slug, row_number() OVER (PARTITION BY folder, slug ORDER BY name) AS k FROM slugs)"""))
def unique_names(v: Views) -> DataFrame:
    files = v.files.select("name", "folder", F.lit(".mp4").alias("ext"), F.col("content").alias("caption"))
    return dedup.unique_names(files).select("name", "new_name")


# Short and numbered captions, so that slugs are each other's numbered names, and names that are in use already.
O.CTES.update({
    "captioned": """
SELECT name, folder, substr(content, 1, 1) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' ' || CAST(doc_id % 7 AS VARCHAR) END AS caption FROM files""",
    "in_use": """
SELECT DISTINCT folder, lower(substr(content, 1, 1)) || '_' || CAST(doc_id % 13 AS VARCHAR) || '.mp4' AS new_name FROM files
WHERE doc_id % 5 = 0 AND regexp_full_match(substr(content, 1, 1), '[a-zA-Z]')""",
    "captions_in_order": """
SELECT folder, name, CASE WHEN stem = '' THEN 'clip' ELSE stem END AS slug, row_number() OVER (PARTITION BY folder ORDER BY name) AS i FROM (
 SELECT name, folder, array_to_string(list_filter(string_split_regex(lower(regexp_replace(caption, '[^a-zA-Z0-9\\s_]', '', 'g')),
  '[\\s_]+'), lambda w: w <> '')[1:6], '_') AS stem FROM captioned)""",
})


@register("unique_names_in_order", O.query("""
SELECT folder, name, chosen AS new_name FROM (
 WITH RECURSIVE walk AS (
  SELECT folder, CAST(0 AS BIGINT) AS i, '' AS name, '' AS chosen, coalesce((SELECT list(u.new_name) FROM in_use u WHERE u.folder = f.folder), []) AS names
  FROM (SELECT DISTINCT folder FROM files) f
  UNION ALL
  SELECT folder, i, name, chosen, list_append(names, chosen) FROM (
   SELECT c.folder, c.i, c.name, w.names, CASE WHEN NOT list_contains(w.names, c.slug || '.mp4') THEN c.slug || '.mp4' ELSE
     c.slug || '_' || CAST(list_filter(range(2, len(w.names) + 3), lambda k: NOT list_contains(w.names, c.slug || '_' || CAST(k AS VARCHAR) || '.mp4'))[1] AS VARCHAR) || '.mp4' END AS chosen
   FROM walk w JOIN captions_in_order c ON c.folder = w.folder AND c.i = w.i + 1))
 SELECT * FROM walk) WHERE name <> ''"""))
def unique_names_in_order(v: Views) -> DataFrame:
    """Names of files with short and numbered captions, next to names in use."""
    first = F.substring("content", 1, 1)
    number = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), (F.col("doc_id") % 7).cast("string")))
    files = v.files.select("name", "folder", F.lit(".mp4").alias("ext"), F.concat(first, number).alias("caption"))
    in_use = v.files.where((F.col("doc_id") % 5 == 0) & first.rlike("^[a-zA-Z]$")).select(
        "folder", F.concat(F.lower(first), F.lit("_"), (F.col("doc_id") % 13).cast("string"), F.lit(".mp4")).alias("new_name")
    ).distinct()
    return dedup.unique_names(files, in_use).select("folder", "name", "new_name")


@register("caption_split", O.query("""
SELECT d.name, d.caption IS NOT NULL AS usable FROM (
 SELECT f.name, i.caption FROM files f LEFT JOIN library_index i ON f.name = i.name) d"""))
def caption_split(v: Views) -> DataFrame:
    described = v.files.select("name").join(v.library_index.select("name", "caption"), "name", "left")
    good, failed = dedup.split_captions(described)
    return good.select("name", F.lit(True).alias("usable")).unionByName(failed.select("name", F.lit(False).alias("usable")))


@register("vector_topk", O.query("""
SELECT query_id, CAST(rn AS INT) AS rank, item_id, similarity FROM (
 SELECT q.vec_id AS query_id, v.vec_id AS item_id,
  round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: p[1] * p[2])), 9) AS similarity,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY
   round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: p[1] * p[2])), 9) DESC, v.vec_id) AS rn
 FROM vectors q JOIN (SELECT DISTINCT vec_id FROM clips_base) c ON q.vec_id = c.vec_id CROSS JOIN vectors v) WHERE rn <= 5"""))
def vector_topk(v: Views) -> DataFrame:
    asked = v.vectors.join(v.clip_rows.select("vec_id").distinct(), "vec_id", "left_semi")
    return similarity.nearest(
        asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
        v.vectors.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")),
    ).select("query_id", "rank", "item_id", "similarity")


O.CTES.update({
    "pool": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, clip_number ORDER BY source_no, pos) AS place FROM (
 SELECT p.*, CASE source WHEN 'pexels' THEN 0 WHEN 'pixabay' THEN 1 WHEN 'pexels_images' THEN 2 ELSE 3 END AS source_no
 FROM pairs p WHERE tier = 1 AND source IN ('pexels','pixabay','pexels_images','pixabay_images') AND pos <= 2))
WHERE place <= 8""",
    "pool_scored": """
SELECT project_id, clip_number, source, source_id, media_type, width, height, duration, CAST(place AS INT) AS place,
 greatest(0.0E0, least(1.0E0, round(list_sum(list_transform(list_zip(a, b), lambda p: p[1] * p[2])), 9))) AS score,
 CASE WHEN clip_number % 2 = 0 THEN 'video' ELSE 'image' END AS preferred,
 2.0E0 + clip_number AS target FROM pool""",
    "picked": """
SELECT *, row_number() OVER (PARTITION BY project_id, clip_number ORDER BY pixels DESC, score DESC, place) AS pick,
 count(*) OVER (PARTITION BY project_id, clip_number) AS tied FROM (
 SELECT *, max(score) OVER (PARTITION BY project_id, clip_number) AS best FROM (
  SELECT *, max(CASE WHEN near THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, clip_number) AS any_near FROM (
   SELECT *, media_type = preferred AND score >= top - 0.05E0 AS near FROM (
    SELECT *, max(score) OVER (PARTITION BY project_id, clip_number) AS top, width * height AS pixels,
     row_number() OVER (PARTITION BY project_id, clip_number ORDER BY score DESC, place) AS rn FROM pool_scored)))
  WHERE CASE WHEN any_near = 1 THEN near ELSE rn = 1 END)
WHERE abs(score - best) <= 0.01E0""",
})


def _pool(v: Views) -> DataFrame:
    phrases = retrieval.clip_phrases(v.clips).where(F.col("tier") == 1)
    found = retrieval.retrieve(phrases, v.hits, search.weights(v))
    hits = v.hits.select("doc_id", "source_id", "media_type", "width", "height", "duration", F.col("vec_id").alias("hit_vec"))
    rows = phrases.select("project_id", "clip_number", "vec_id", "query").join(
        found.select("query", "source", "pos", F.col("entry").alias("doc_id")), "query"
    )
    pool = written(ranking.pool_quota(rows, ["project_id", "clip_number"]), "pool")
    # thin results are filled with the same first entries
    pool = hot_join(pool, hits, "doc_id", pool.groupBy("doc_id").agg(F.count("*").alias("n")), spread=["project_id", "clip_number"])
    pairs = written(pool.withColumnRenamed("vec_id", "a").withColumnRenamed("hit_vec", "b").drop("query"), "pool")
    pool = similarity.pair_dots(pairs, v.vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round("dot", 9)))
    return pool.select(
        "project_id", "clip_number", "source", "source_id", "media_type", "width", "height", "duration", "place",
        score.alias("score"),
        F.when(F.col("clip_number") % 2 == 0, F.lit("video")).otherwise(F.lit("image")).alias("preferred"),
        (F.lit(2.0) + F.col("clip_number")).alias("target"),
    )


@register("pool_quota", O.query(
    "SELECT project_id, clip_number, place, source, source_id, media_type, score FROM pool_scored"))
def pool_quota(v: Views) -> DataFrame:
    return _pool(v).select("project_id", "clip_number", "place", "source", "source_id", "media_type", "score")


@register("duration_relax", O.query("""
SELECT project_id, clip_number, place, source, source_id, duration, target FROM (
 SELECT *, max(CASE WHEN media_type <> 'video' OR duration >= target THEN 1 ELSE 0 END)
  OVER (PARTITION BY project_id, clip_number) AS any_ok FROM pool_scored)
WHERE media_type <> 'video' OR duration >= target OR any_ok = 0"""))
def duration_relax(v: Views) -> DataFrame:
    return ranking.relax_duration(_pool(v), ["project_id", "clip_number"], "target").select(
        "project_id", "clip_number", "place", "source", "source_id", "duration", "target"
    )


@register("media_pref_pick", O.query("""
SELECT project_id, clip_number, source, source_id, media_type, score,
 CASE WHEN any_near = 1 THEN 'preferred media type ''' || preferred || ''''
  ELSE 'no ''' || preferred || ''' candidate within 0.05 of the top score (' || printf('%.2f', top) || ')' END
 || '; semantic score ' || printf('%.2f', score) || CASE WHEN tied > 1 THEN '; resolution used as tiebreaker' ELSE '' END
 AS reason FROM picked WHERE pick = 1"""))
def media_pref_pick(v: Views) -> DataFrame:
    return ranking.prefer_media(_pool(v), ["project_id", "clip_number"], order=("place",)).select(
        "project_id", "clip_number", "source", "source_id", "media_type", "score", "reason"
    )


O.CTES["records"] = """
SELECT 'rec_' || CAST(h.doc_id AS VARCHAR) AS id, source, CASE WHEN h.doc_id % 3 = 0 THEN '' ELSE source_id END AS source_id,
 CASE WHEN h.doc_id % 5 = 0 THEN '' ELSE md5(text) END AS fingerprint FROM hits h JOIN labels l ON h.doc_id = l.doc_id"""


@register("known_asset_lookup", O.query("""
SELECT e.project_id, e.clip_number, coalesce(i.id, p.id) AS record_id,
 CASE WHEN i.id IS NOT NULL THEN 'source' WHEN p.id IS NOT NULL THEN 'fingerprint' END AS matched_by
FROM (SELECT *, md5(selected_text) AS fingerprint FROM entries WHERE source IS NOT NULL) e
LEFT JOIN (SELECT source, source_id, min(id) AS id FROM records WHERE source_id <> '' GROUP BY 1, 2) i
 ON e.source = i.source AND e.source_id = i.source_id
LEFT JOIN (SELECT fingerprint, min(id) AS id FROM records WHERE fingerprint <> '' GROUP BY 1) p
 ON e.fingerprint = p.fingerprint"""))
def known_asset_lookup(v: Views) -> DataFrame:
    labelled = v.hits.join(v.table("labels").select("doc_id"), "doc_id")
    records = labelled.select(
        F.concat(F.lit("rec_"), F.col("doc_id").cast("string")).alias("id"), "source",
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("source_id")).alias("source_id"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.md5("text")).alias("fingerprint"),
    )
    winners = timing.entries(v).where(F.col("source").isNotNull()).select(
        "project_id", "clip_number", "source", "source_id", F.md5("selected_text").alias("fingerprint")
    )
    return library.known_assets(winners, records, ["project_id", "clip_number"]).select(
        "project_id", "clip_number", "record_id", "matched_by"
    )


@register("library_upsert", O.query(f"""
SELECT id, version, description, keywords_csv, CAST(len(list_filter(string_split(keywords_csv, ','), lambda k: k <> '')) AS INT)
 AS n_keywords, description || ' ' || replace(keywords_csv, ',', ' ') AS query_text FROM (
 SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rn FROM (
  SELECT name AS id, 1 AS version, caption AS description, '' AS keywords_csv FROM library_index
  UNION ALL
  SELECT name, 2, content, array_to_string(list_transform(list_sort(list_transform({O.overlap_tokens('content')},
   lambda t: lpad(CAST(100000 - length(t) AS VARCHAR), 6, '0') || t)), lambda k: substr(k, 7))[1:3], ',') FROM files))
WHERE rn = 1"""))
def library_upsert(v: Views) -> DataFrame:
    existing = v.library_index.select(
        F.col("name").alias("id"), F.lit(1).alias("version"), F.col("caption").alias("description"),
        F.lit("").alias("keywords_csv"),
    )
    keywords = F.slice(longest_first(overlap_tokens("content")), 1, 3)
    incoming = v.files.select(
        F.col("name").alias("id"), F.lit(2).alias("version"), F.col("content").alias("description"),
        keywords_to_csv(keywords).alias("keywords_csv"),
    )
    merged = library.upsert(existing, incoming)
    decoded = keywords_from_csv("keywords_csv")
    return merged.select(
        "id", "version", "description", "keywords_csv", F.size(decoded).alias("n_keywords"),
        query_text("description", decoded).alias("query_text"),
    )


O.CTES["folder_entries"] = f"""
SELECT i.folder, i.doc_id, {O.overlap_tokens('i.caption')} AS tokens FROM library_index i SEMI JOIN files f ON i.name = f.name"""


@register("library_retrieval", O.query("""
SELECT query, folder, CAST(pos AS INT) AS pos, doc_id, matched FROM (
 SELECT *, row_number() OVER (PARTITION BY query, folder ORDER BY matched DESC, doc_id) AS pos FROM (
  SELECT q.query, e.folder, e.doc_id, CAST(coalesce(m.matched, 0) AS BIGINT) AS matched
  FROM (SELECT DISTINCT query FROM phrase_rows) q CROSS JOIN folder_entries e
  LEFT JOIN (SELECT query, doc_id, sum(w) AS matched FROM query_tokens JOIN (
   SELECT doc_id, unnest(tokens) AS token FROM folder_entries) USING (token) GROUP BY query, doc_id) m
  ON q.query = m.query AND e.doc_id = m.doc_id)) WHERE pos <= 5"""))
def library_retrieval(v: Views) -> DataFrame:
    """Search of all library folders with the phrases of all tiers: a page per
    folder, entries without a file skipped before the page is cut."""
    catalogue = v.library_index.join(v.files.select("name"), "name", "left_semi")
    catalogue = catalogue.select(F.col("folder").alias("source"), "doc_id", F.col("caption").alias("text"))
    found = retrieval.retrieve(retrieval.clip_phrases(v.clips), catalogue, search.weights(v), sources=None)
    return found.select("query", F.col("source").alias("folder"), "pos", F.col("entry").alias("doc_id"), "matched")


@register("duplicate_report", O.query("""
SELECT id_a, id_b, '## ' || printf('%.3f', score) || ' — `clip_' || CAST(id_a AS VARCHAR) || '` vs `clip_' || CAST(id_b AS VARCHAR) || '`'
 || chr(10) || chr(10) || '- **clip_' || CAST(id_a AS VARCHAR) || '**: ' || a.text || chr(10) || '- **clip_' || CAST(id_b AS VARCHAR)
 || '**: ' || b.text || chr(10) AS block FROM alike JOIN documents a ON a.doc_id = id_a JOIN documents b ON b.doc_id = id_b"""))
def duplicate_report(v: Views) -> DataFrame:
    """Report blocks of the near-duplicate pairs, with their heading line."""
    rows = dedup.with_texts(near_dup_pairs(v), v.table("documents").select(F.col("doc_id").alias("id"), "text"))
    named = rows.withColumns({
        "name_a": F.concat(F.lit("clip_"), F.col("id_a").cast("string")),
        "name_b": F.concat(F.lit("clip_"), F.col("id_b").cast("string")),
    })
    lines = reports.duplicate_lines(named, "id_a", "id_b")
    return lines.select("id_a", "id_b", "block")
