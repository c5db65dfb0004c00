"""Catalogue readers, category tables and event state over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspark.functions.text import longest_first, overlap_tokens
from mediaspark.operators import categories as cats
from mediaspark.operators import denylist
from mediaspark.queries import oracle as O
from mediaspark.queries.registry import register
from mediaspark.sources import catalogs, library
from mediaspark.streaming import progress
from mediaspark.views import Views

_HIT = "source, source_id, download_url, media_type, width, height, duration, text"


def _hit_sql(source, source_id, url, media, width, height, duration, text, tail) -> str:
    return O.query(
        f"SELECT {O.lit(source)} AS source, CAST({source_id} AS VARCHAR) AS source_id, {url} AS download_url, {media} AS media_type, "
        f"CAST({width} AS INT) AS width, CAST({height} AS INT) AS height, CAST({duration} AS DOUBLE) AS duration, {text} AS text {tail}"
    )


def _land(v: Views, *columns) -> DataFrame:
    return v.table("documents").select(F.to_json(F.struct(*columns)).alias("body"))


def _id() -> Column:
    return F.col("doc_id")


def _full() -> Column:
    return F.col("text")


@register("catalog_pexels_videos", _hit_sql(
    "pexels", "doc_id", "'u' || CAST(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS VARCHAR)", "'video'",
    "CASE WHEN doc_id % 3 = 0 THEN 1920 ELSE 1280 END", "CASE WHEN doc_id % 3 = 0 THEN 1080 ELSE 720 END",
    "doc_id % 40", "'road number ' || lang", "FROM documents WHERE doc_id % 10 <> 9"))
def catalog_pexels_videos(v: Views) -> DataFrame:
    """Items whose file list is empty come out as nothing."""
    rendition = lambda link, w, h: F.struct(F.lit(link).alias("link"), F.lit(w).alias("width"), F.lit(h).alias("height"))
    files = F.when(_id() % 3 == 0, F.array(rendition("u1", 640, 360), rendition("u2", 1920, 1080), rendition("u3", 1920, 1080)))
    files = files.otherwise(F.array(rendition("u1", 1280, 720), rendition("u2", 1280, 720)))
    files = F.when(_id() % 10 == 9, F.slice(files, 1, 0)).otherwise(files)
    url = F.concat(F.lit("https://a.example/video/road-number-"), "lang", F.lit("-"), _id().cast("string"), F.lit("/"))
    return catalogs.pexels_videos(_land(
        v, _id().alias("id"), url.alias("url"), (_id() % 40).alias("duration"), files.alias("video_files")))


@register("catalog_pixabay_videos", _hit_sql(
    "pixabay", "doc_id", "CASE doc_id % 4 WHEN 0 THEN 'L' WHEN 1 THEN 'M' ELSE 'T' END", "'video'",
    "CASE doc_id % 4 WHEN 0 THEN 1920 WHEN 1 THEN 1280 ELSE 0 END", "CASE doc_id % 4 WHEN 0 THEN 1080 WHEN 1 THEN 720 ELSE 0 END",
    "doc_id % 30", "text", "FROM documents WHERE doc_id % 4 <> 3"))
def catalog_pixabay_videos(v: Views) -> DataFrame:
    clip = lambda url, w, h: F.struct(F.lit(url).alias("url"), F.lit(w).alias("width"), F.lit(h).alias("height"))
    videos = F.struct(
        F.when(_id() % 4 == 0, clip("L", 1920, 1080)).alias("large"), F.when(_id() % 4 < 2, clip("M", 1280, 720)).alias("medium"),
        F.when(_id() % 4 < 3, F.struct(F.lit("T").alias("url"))).alias("tiny"),
    )
    return catalogs.pixabay_videos(_land(
        v, _id().alias("id"), _full().alias("tags"), (_id() % 30).alias("duration"), videos.alias("videos")))


@register("catalog_pexels_images", _hit_sql(
    "pexels_images", "doc_id", "CASE WHEN doc_id % 3 = 0 THEN 'big' ELSE 'orig' END", "'image'", "1200", "800", "0",
    "CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END", "FROM documents WHERE doc_id % 3 <> 2"))
def catalog_pexels_images(v: Views) -> DataFrame:
    src = F.struct(
        F.when(_id() % 3 == 0, F.lit("big")).otherwise(F.lit("")).alias("large2x"),
        F.when(_id() % 3 == 2, F.lit("")).otherwise(F.lit("orig")).alias("original"),
    )
    return catalogs.pexels_images(_land(
        v, _id().alias("id"), F.when(_id() % 2 == 0, _full()).alias("alt"), F.lit(1200).alias("width"), F.lit(800).alias("height"),
        src.alias("src")))


@register("catalog_pixabay_images", _hit_sql(
    "pixabay_images", "doc_id", "'big' || lang", "'image'", "doc_id % 4000", "900", "0", "text",
    "FROM documents WHERE doc_id % 5 <> 0"))
def catalog_pixabay_images(v: Views) -> DataFrame:
    return catalogs.pixabay_images(_land(
        v, _id().alias("id"), _full().alias("tags"), F.when(_id() % 5 != 0, F.concat(F.lit("big"), "lang")).alias("largeImageURL"),
        (_id() % 4000).alias("imageWidth"), F.lit(900).alias("imageHeight")))


@register("catalog_coverr", _hit_sql(
    "coverr", "doc_id", "CASE WHEN doc_id % 2 = 0 THEN 'dl' ELSE 'mp4' END", "'video'", "1920", "1080", "doc_id % 20",
    "lang || ' ' || text || CASE doc_id % 3 WHEN 0 THEN ' one two' WHEN 1 THEN ' single' ELSE '' END", "FROM documents"))
def catalog_coverr(v: Views) -> DataFrame:
    urls = F.struct(F.lit("mp4").alias("mp4"), F.when(_id() % 2 == 0, F.lit("dl")).otherwise(F.lit("")).alias("mp4_download"))
    base = [_id().cast("string").alias("id"), F.col("lang").alias("title"), _full().alias("description"),
            F.lit(1920).alias("max_width"), F.lit(1080).alias("max_height"), (_id() % 20).alias("duration"), urls.alias("urls")]
    d = v.table("documents")
    tagged = F.to_json(F.struct(*base, F.array(F.lit("one"), F.lit("two")).alias("tags")))
    single = F.to_json(F.struct(*base, F.lit("single").alias("tags")))
    bare = F.to_json(F.struct(*base))
    return catalogs.coverr(d.select(F.when(_id() % 3 == 0, tagged).when(_id() % 3 == 1, single).otherwise(bare).alias("body")))


_LICENCE = """CASE doc_id % 4 WHEN 0 THEN 'https://creativecommons.org/publicdomain/zero/1.0/'
 WHEN 1 THEN 'http://creativecommons.org/licenses/by/4.0/' WHEN 2 THEN 'https://creativecommons.org/licenses/by-nc/4.0/' END"""


@register("licence_allowlist", O.query(f"""
SELECT doc_id, licence, coalesce(starts_with(licence, 'https://creativecommons.org/publicdomain')
 OR starts_with(licence, 'http://creativecommons.org/licenses/by/'), FALSE) AS open FROM (SELECT doc_id, {_LICENCE} AS licence FROM documents)"""))
def licence_allowlist(v: Views) -> DataFrame:
    from mediaspark.functions.media import open_licence

    rows = v.table("documents").select("doc_id", _licence().alias("licence"))
    return rows.select("doc_id", "licence", open_licence("licence").alias("open"))


def _licence():
    return (
        F.when(_id() % 4 == 0, F.lit("https://creativecommons.org/publicdomain/zero/1.0/"))
        .when(_id() % 4 == 1, F.lit("http://creativecommons.org/licenses/by/4.0/"))
        .when(_id() % 4 == 2, F.lit("https://creativecommons.org/licenses/by-nc/4.0/"))
    )


@register("catalog_archive", _hit_sql(
    "internet_archive", "'item' || CAST(doc_id AS VARCHAR)",
    "'https://archive.org/download/item' || CAST(doc_id AS VARCHAR) || '/' || CASE WHEN doc_id % 3 = 0 THEN 'B.OGV' ELSE 'a.jpg' END",
    "CASE WHEN doc_id % 3 = 0 THEN 'video' ELSE 'image' END", "CASE WHEN doc_id % 3 = 0 THEN 640 ELSE 0 END",
    "CASE WHEN doc_id % 3 = 0 THEN 480 ELSE 0 END", "CASE WHEN doc_id % 3 = 0 THEN 12.5E0 ELSE 0.0E0 END",
    "lang || ' ' || text || ' one two'", "FROM documents WHERE doc_id % 4 IN (0, 1) AND doc_id % 7 <> 6"))
def catalog_archive(v: Views) -> DataFrame:
    d = v.table("documents")
    name = F.concat(F.lit("item"), _id().cast("string"))
    items = d.select(F.to_json(F.struct(
        name.alias("identifier"), F.col("lang").alias("title"), _full().alias("description"),
        F.array(F.lit("one"), F.lit("two")).alias("subject"), _licence().alias("licenseurl"))).alias("body"))
    file = lambda n, w, h, s: F.struct(F.lit(n).alias("name"), F.lit(w).alias("width"), F.lit(h).alias("height"), F.lit(s).alias("length"))
    listing = F.when(_id() % 7 == 6, F.array(file("notes.txt", "", "", ""))).when(
        _id() % 3 == 0, F.array(file("a.jpg", "n/a", "", ""), file("B.OGV", "640", "480", "12.5"), file("c.mp4", "1", "1", "1"))
    ).otherwise(F.array(file("x.xml", "", "", ""), file("a.jpg", "n/a", "", "")))
    files = d.select(name.alias("identifier"), F.posexplode(listing).alias("pos", "f")).select("identifier", "pos", "f.*")
    return catalogs.internet_archive(items, files)


@register("catalog_nasa", _hit_sql(
    "nasa", "'n' || CAST(doc_id AS VARCHAR)", "'p' || lang", "'image'", "0", "0", "0", "text", "FROM documents WHERE doc_id % 4 <> 0"))
def catalog_nasa(v: Views) -> DataFrame:
    link = lambda rel, href: F.struct(F.lit(rel).alias("rel"), href.alias("href"))
    links = F.when(_id() % 4 == 0, F.array(link("captions", F.lit("c")))).otherwise(
        F.array(link("captions", F.lit("c")), link("preview", F.concat(F.lit("p"), "lang")), link("preview", F.lit("late"))))
    data = F.array(F.struct(F.concat(F.lit("n"), _id().cast("string")).alias("nasa_id"), _full().alias("title")))
    return catalogs.nasa(_land(v, data.alias("data"), links.alias("links")))


@register("catalog_wikimedia", _hit_sql(
    "wikimedia", "CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE text END",
    "CASE WHEN doc_id % 3 = 0 THEN 'a.JPG' ELSE 'b.png' END", "'image'", "800", "600", "0", "text",
    "FROM documents WHERE doc_id % 3 <> 2"))
def catalog_wikimedia(v: Views) -> DataFrame:
    url = F.when(_id() % 3 == 0, F.lit("a.JPG")).when(_id() % 3 == 1, F.lit("b.png")).otherwise(F.lit("c.svg"))
    page = F.struct(
        F.when(_id() % 2 == 0, _id()).alias("pageid"), _full().alias("title"),
        F.array(F.struct(url.alias("url"), F.lit(800).alias("width"), F.lit(600).alias("height"))).alias("imageinfo"))
    body = F.to_json(F.create_map(_id().cast("string"), page))
    return catalogs.wikimedia(v.table("documents").select(body.alias("body")))


@register("index_entries", O.query("""
SELECT lang AS folder, 'clip_' || CAST(doc_id AS VARCHAR) || '.mp4' AS name, text AS caption, 1280 AS width, 720 AS height,
 CAST(doc_id % 9 AS DOUBLE) AS duration FROM documents"""))
def index_entries(v: Views) -> DataFrame:
    entry = F.struct(_full().alias("caption"), F.lit(1280).alias("width"), F.lit(720).alias("height"), (_id() % 9).alias("duration"))
    name = F.concat(F.lit("clip_"), _id().cast("string"), F.lit(".mp4"))
    landed = v.table("documents").select(F.col("lang").alias("folder"), F.to_json(F.create_map(name, entry)).alias("body"))
    return library.index_entries(landed).drop("hash")


@register("transcript_words", O.query(f"""
SELECT project_id, i - 1 AS word_idx, w[i] AS text, (i - 1) * 0.5E0 AS start FROM (
 SELECT project_id, w, unnest(range(1, len(w) + 1)) AS i FROM (
  SELECT CAST(doc_id AS VARCHAR) AS project_id, {O.words('text')} AS w FROM documents))""").replace(
    "i - 1 AS word_idx", "CAST(i - 1 AS INT) AS word_idx"))
def transcript_words(v: Views) -> DataFrame:
    from mediaspark.functions.text import words

    item = F.transform(words("text"), lambda w, i: F.struct(
        F.concat(F.lit(" "), w).alias("word"), (i * 0.5).alias("start"), (i * 0.5 + 0.4).alias("end")))
    half = F.floor(F.size("_i") / 2).cast("int")
    rows = v.table("documents").select(_id().cast("string").alias("project_id"), item.alias("_i"))
    segments = F.array(
        F.struct(F.slice("_i", 1, half).alias("words")), F.struct(F.array().cast(
            "array<struct<word:string,start:double,end:double>>").alias("words")),
        F.struct(F.slice("_i", half + 1, F.size("_i")).alias("words")))
    landed = rows.select("project_id", F.to_json(F.struct(segments.alias("segments"))).alias("body"))
    return library.transcript_words(landed).select("project_id", "word_idx", "text", "start")


# Categories of every document: parents are every fourth one, some are orphans.
O.CTES["cats"] = f"""
SELECT 'cat_' || CAST(doc_id AS VARCHAR) AS key, lang || ' ' || source || ' ' || CAST(doc_id AS VARCHAR) AS display_name,
 list_transform(list_sort(list_transform({O.overlap_tokens('text')}, lambda t: lpad(CAST(100000 - length(t) AS VARCHAR), 6, '0') || t)),
  lambda k: substr(k, 7))[1:3] AS banned, 'safe ' || lang AS safe, lang = 'en' AS use_archive,
 CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS library_path,
 CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 31 = 5 THEN 'gone' ELSE 'cat_' || CAST(doc_id - doc_id % 4 AS VARCHAR) END
  AS parent_key, doc_id % 5 = 0 AS is_custom, 'Scripts in ' || lang AS context FROM documents"""


def _categories(v: Views) -> DataFrame:
    key = lambda n: F.concat(F.lit("cat_"), n.cast("string"))
    ranked = longest_first(overlap_tokens("text"))
    return v.table("documents").select(
        key(_id()).alias("key"), F.concat_ws(" ", "lang", "source", _id().cast("string")).alias("display_name"),
        F.slice(ranked, 1, 3).alias("banned"), F.array().cast("array<string>").alias("positive"),
        F.concat(F.lit("safe "), "lang").alias("safe"), (F.col("lang") == "en").alias("use_archive"),
        F.when(_id() % 3 == 0, F.lit("")).otherwise(F.col("lang")).alias("library_path"),
        F.when(_id() % 4 != 0, F.when(_id() % 31 == 5, F.lit("gone")).otherwise(key(_id() - _id() % 4))).alias("parent_key"),
        (_id() % 5 == 0).alias("is_custom"), F.concat(F.lit("Scripts in "), "lang").alias("context"),
    )


@register("category_tree", O.query("""
SELECT c.key, c.display_name, p.key AS parent_key, CASE WHEN p.key IS NULL THEN 0 ELSE 1 END AS depth,
 coalesce(lower(p.display_name), lower(c.display_name)) AS group_name, coalesce(p.key, c.key) AS group_key
FROM cats c LEFT JOIN cats p ON c.parent_key = p.key"""))
def category_tree(v: Views) -> DataFrame:
    return cats.tree(_categories(v))


@register("category_overlay", O.query("""
SELECT key, display_name, FALSE AS is_custom FROM cats WHERE key NOT IN (SELECT 'cat_' || CAST(doc_id AS VARCHAR) FROM labels)
UNION ALL SELECT c.key, 'custom ' || c.display_name, TRUE FROM cats c JOIN labels l ON c.key = 'cat_' || CAST(l.doc_id AS VARCHAR)"""))
def category_overlay(v: Views) -> DataFrame:
    rows = _categories(v).drop("is_custom")
    labelled = v.table("labels").select(F.concat(F.lit("cat_"), _id().cast("string")).alias("key"))
    custom = rows.join(labelled, "key").withColumn("display_name", F.concat(F.lit("custom "), "display_name"))
    return cats.overlay(rows, custom).select("key", "display_name", "is_custom")


O.CTES.update({
    "requests": """
SELECT conv_id AS request_id, turn AS pos, 'cat_' || CAST(CASE WHEN conv_id % 3 = 0 THEN conv_id * 4 + 1 + turn % 3
  WHEN conv_id % 3 = 1 THEN (conv_id * 13 + turn) % (SELECT count(*) FROM documents) ELSE conv_id END AS VARCHAR)
  || CASE WHEN conv_id % 11 = 10 THEN 'x' ELSE '' END AS key FROM conversations""",
    "asked": """
SELECT request_id, r.key, min(pos) AS pos, any_value(c.display_name) AS display_name, any_value(c.banned) AS banned,
 any_value(c.library_path) AS library_path, any_value(c.safe) AS safe, any_value(c.parent_key) AS parent_key,
 any_value(c.context) AS context, any_value(c.key) IS NULL AS missing FROM requests r LEFT JOIN cats c ON r.key = c.key GROUP BY request_id, r.key""",
    "grouped": """
SELECT request_id, count(*) AS n_keys, count(*) FILTER (missing) AS missing, min(parent_key) AS low, max(parent_key) AS high,
 count(parent_key) AS parents, string_agg(display_name, ', ' ORDER BY pos) AS names,
 arg_min(key, pos) AS first_key, arg_min(display_name, pos) AS first_name, arg_min(safe, pos) AS first_safe,
 arg_min(context, pos) AS first_context, arg_min_null(parent_key, pos) AS first_parent
FROM asked GROUP BY request_id""",
    "terms": """
SELECT request_id, string_agg(term, ',' ORDER BY pos, i) AS banned FROM (
 SELECT request_id, term, min(pos) AS pos, arg_min(i, pos * 1000 + i) AS i FROM (
  SELECT request_id, pos, i, banned[i] AS term FROM (SELECT *, unnest(range(1, len(banned) + 1)) AS i FROM asked))
 GROUP BY request_id, term) GROUP BY request_id""",
})


def _requests(v: Views) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    rows = v.table("conversations")
    number = F.when(conv % 3 == 0, conv * 4 + 1 + turn % 3).when(conv % 3 == 1, (conv * 13 + turn) % v.n_documents).otherwise(conv)
    key = F.concat(F.lit("cat_"), number.cast("string"), F.when(conv % 11 == 10, F.lit("x")).otherwise(F.lit("")))
    return rows.select(conv.alias("request_id"), turn.alias("pos"), key.alias("key"))


@register("category_merge", O.query("""
SELECT request_id, n_keys, problem, CASE WHEN problem IS NULL THEN CASE WHEN n_keys > 1 THEN low ELSE first_key END END AS key,
 CASE WHEN problem IS NULL THEN CASE WHEN n_keys > 1 THEN parent_name || ' (' || names || ')' ELSE first_name END END AS display_name,
 CASE WHEN problem IS NULL THEN coalesce(banned, '') END AS banned,
 CASE WHEN problem IS NULL THEN CASE WHEN n_keys > 1 THEN parent_safe ELSE first_safe END END AS safe,
 CASE WHEN problem IS NULL THEN CASE WHEN n_keys > 1 THEN parent_context ELSE first_context END END AS context,
 CASE WHEN problem IS NULL THEN CASE WHEN n_keys > 1 THEN parent_parent ELSE first_parent END END AS parent_key FROM (
 SELECT g.*, p.display_name AS parent_name, p.safe AS parent_safe, p.context AS parent_context, p.parent_key AS parent_parent, t.banned, CASE WHEN missing > 0 THEN 'unknown key'
  WHEN n_keys > 1 AND (parents < n_keys OR low <> high) THEN 'no shared parent'
  WHEN n_keys > 1 AND p.key IS NULL THEN 'parent missing' END AS problem
 FROM grouped g LEFT JOIN cats p ON g.low = p.key LEFT JOIN terms t ON g.request_id = t.request_id)"""))
def category_merge(v: Views) -> DataFrame:
    merged = cats.merge_requests(_requests(v), _categories(v))
    return merged.select("request_id", "n_keys", "problem", "key", "display_name",
                         F.array_join("banned", ",").alias("banned"), "safe", "context", "parent_key")


_WORD = r"[\p{L}\p{N}_]+"
# every character that is no part of a word, and both ends, between marks
_MARKED = lambda c: f"regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_]', chr(1) || '\\0' || chr(1), 'g')"
O.CTES.update({
    "listed": """
SELECT key AS category, unnest(list_append(banned, array_to_string(string_split(text, ' ')[1:2], ' '))) AS term,
 unnest(range(len(banned) + 1)) AS place FROM cats JOIN documents d ON key = 'cat_' || CAST(d.doc_id AS VARCHAR)""",
    "mentioned": f"""
SELECT DISTINCT doc_id, term FROM (SELECT DISTINCT term, chr(1) || {_MARKED('lower(term)')} AS marked,
  unnest([regexp_extract(lower(term), '{_WORD}'), regexp_extract(lower(term), '{_WORD}') || 's']) AS word
 FROM (SELECT DISTINCT term FROM listed WHERE term <> '')) t
JOIN (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{_WORD}'))) AS word FROM documents) w
 ON w.word = t.word
JOIN (SELECT doc_id, chr(1) || {_MARKED('lower(text)')} || chr(1) AS body FROM documents) d USING (doc_id)
WHERE contains(body, marked || chr(1)) OR contains(body, marked || 's' || chr(1))""",
    "wanted": """
SELECT request_id, term, min(pos * 1000 + place) AS place FROM asked a JOIN listed l ON a.key = l.category
WHERE request_id IN (SELECT g.request_id FROM grouped g LEFT JOIN cats p ON g.low = p.key
 WHERE missing = 0 AND (n_keys = 1 OR parents = n_keys AND low = high AND p.key IS NOT NULL)) GROUP BY request_id, term""",
})


def _listed(v: Views) -> DataFrame:
    """The categories, with a term of two words more."""
    opening = F.array_join(F.slice(F.split("text", " ", -1), 1, 2), " ")
    extra = v.table("documents").select(F.concat(F.lit("cat_"), _id().cast("string")).alias("key"), opening.alias("_opening"))
    return _categories(v).join(extra, "key").withColumn("banned", F.array_append("banned", F.col("_opening"))).drop("_opening")


def _entries(v: Views) -> DataFrame:
    return v.table("documents").select(F.col("doc_id").alias("entry_id"), "text")


@register("category_denylist", O.query("""
SELECT doc_id, category, arg_min(term, place) AS banned_term FROM mentioned JOIN listed USING (term) GROUP BY doc_id, category"""))
def category_denylist(v: Views) -> DataFrame:
    """First banned term of each document for each of as many categories as there are documents."""
    lists = _listed(v).select(F.col("key").alias("category"), "banned", "positive")
    return denylist.first_banned(_entries(v), lists).withColumnRenamed("entry_id", "doc_id")


@register("merged_category_hits", O.query("""
SELECT doc_id, request_id, arg_min(term, place) AS banned_term FROM mentioned JOIN wanted USING (term) GROUP BY doc_id, request_id"""))
def merged_category_hits(v: Views) -> DataFrame:
    """The same for the merged categories of requests."""
    merged = cats.merge_requests(_requests(v), _listed(v)).where("problem is null")
    lists = merged.select(F.col("request_id").alias("category"), "banned", "positive")
    found = denylist.first_banned(_entries(v), lists)
    return found.select(F.col("entry_id").alias("doc_id"), F.col("category").alias("request_id"), "banned_term")


@register("category_edits", O.query("""
SELECT e.edit_id, action, e.key, CASE WHEN action = 'add' AND (c.key IS NOT NULL OR lower(e.display_name) IN (SELECT lower(display_name) FROM cats))
  THEN 'already exists' WHEN action <> 'add' AND c.key IS NULL THEN 'unknown key' WHEN action <> 'add' AND NOT c.is_custom THEN 'built-in'
  WHEN action = 'delete' AND EXISTS (SELECT 1 FROM cats k WHERE k.parent_key = e.key) THEN 'has sub-categories'
  WHEN action = 'rename' AND coalesce(e.display_name, '') = '' THEN 'display_name required' END AS problem
FROM (SELECT event_id AS edit_id, CASE event_id % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'delete' ELSE 'rename' END AS action,
 'cat_' || CAST(event_id * 7 % (SELECT count(*) FROM documents) AS VARCHAR) AS key,
 CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN 'EN src1 1' ELSE 'New ' || event_type END AS display_name FROM events) e
LEFT JOIN cats c ON e.key = c.key"""))
def category_edits(v: Views) -> DataFrame:
    n = F.col("event_id")
    edits = v.table("events").select(
        n.alias("edit_id"), F.when(n % 3 == 0, F.lit("add")).when(n % 3 == 1, F.lit("delete")).otherwise(F.lit("rename")).alias("action"),
        F.concat(F.lit("cat_"), (n * 7 % v.n_documents).cast("string")).alias("key"),
        F.when(n % 4 == 0, F.lit("")).when(n % 4 == 1, F.lit("EN src1 1")).otherwise(F.concat(F.lit("New "), "event_type"))
        .alias("display_name"),
    )
    return cats.edit_problems(edits, _categories(v))


@register("progress_latest", O.query("""
SELECT project, arg_max(stage, (updated_at, event_id)) AS stage, max(updated_at) AS updated_at, count(*) AS updates,
 bool_or(stage = 'purchase') AS done, max(CASE WHEN stage = 'error' THEN event_id END) AS last_error FROM progress GROUP BY project"""))
def progress_latest(v: Views) -> DataFrame:
    return progress.latest_state(v.progress)


# No user calls often enough for the default of 30 a minute.
@register("rate_window", O.query("""
SELECT project, event_id, updated_at, count(*) OVER w AS calls, count(*) OVER w > 5 AS over_limit FROM progress
WINDOW w AS (PARTITION BY project ORDER BY updated_at RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)"""))
def rate_window(v: Views) -> DataFrame:
    return progress.trailing_calls(v.progress, seconds=86400, limit=5)
