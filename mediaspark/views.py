"""Tables of the media domain derived from the given test tables.

``spark_views`` gives DataFrames, ``ORACLE`` the same views as SQL common table
expressions.  Every view reads its tables whole.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspark.functions.media import valid_visual_type
from mediaspark.functions.text import longest_first, overlap_tokens
from mediaspark.operators.terms import Category
from mediaspark.session import tune
from mediaspark.sources.tables import read_table

# Categories of the test projects, with terms that occur in the
# generated prose.
CATEGORIES = (
    Category("news", "Daily News", ("idiot", "pathetic", "license", "ther"), ("thing", "est"),
             "city street", True, "news"),
    Category("tales", "Old Tales", ("moron", "worthless", "ou"), ("pour", "with this"), "open book"),
    Category("nature", "Nature Walks", ("stupid", "thon", "eau"), ("thor",),
             "forest river", False, "nature", "tales"),
    Category("travel", "Far Travel", ("disgusting", "thon", "que"), ("para", "con"),
             "mountain road", False, "travel", "tales"),
    Category("lost", "Lost Rooms", ("ing",), (), "empty room", True, "", "gone"),
)
CATEGORY_KEYS = tuple(c.key for c in CATEGORIES)

HITS_SQL = """
SELECT CASE doc_id % 8 WHEN 0 THEN 'local_library' WHEN 1 THEN 'pexels' WHEN 2 THEN 'pixabay' WHEN 3 THEN 'coverr'
   WHEN 4 THEN 'pexels_images' WHEN 5 THEN 'pixabay_images' WHEN 6 THEN 'internet_archive' ELSE 'nasa' END AS source,
 CAST(doc_id AS VARCHAR(20)) AS source_id, doc_id,
 CASE doc_id % 5 WHEN 0 THEN 1920 WHEN 1 THEN 1280 WHEN 2 THEN 640 WHEN 3 THEN 1080 ELSE 0 END AS width,
 CASE doc_id % 5 WHEN 0 THEN 1080 WHEN 1 THEN 720 WHEN 2 THEN 360 WHEN 3 THEN 1920 ELSE 0 END AS height,
 CASE WHEN doc_id % 8 IN (4,5,7) THEN 'image' ELSE 'video' END AS media_type,
 CASE WHEN doc_id % 8 IN (4,5,7) THEN 0.0E0 ELSE (doc_id % 40) / 4.0E0 END AS duration,
 text, lang, doc_id % (SELECT count(*) FROM {embeddings}) AS vec_id FROM {documents}
"""

CLIPS_SQL = """
SELECT CAST(conv_id AS VARCHAR(20)) AS project_id, CAST(turn + 1 AS INT) AS clip_number, role AS section,
 text AS script_beat,
 CASE (conv_id + turn) % 6 WHEN 0 THEN 'Archive' WHEN 1 THEN 'Sports' WHEN 2 THEN 'Technology'
   WHEN 3 THEN 'Documents' WHEN 4 THEN 'Metaphor' ELSE 'B-roll' END AS visual_type,
 1 + (conv_id * 7 + turn * 5) % 24 AS word_count,
 CASE conv_id % 5 WHEN 0 THEN 'news' WHEN 1 THEN 'tales' WHEN 2 THEN 'nature' WHEN 3 THEN 'travel' ELSE 'lost' END
   AS category,
 (conv_id * 31 + turn) % (SELECT count(*) FROM {embeddings}) AS vec_id, conv_id, turn FROM {conversations}
"""

PROGRESS_SQL = """
SELECT CAST(user_id AS VARCHAR(20)) AS project, event_type AS stage, ts AS updated_at, value, event_id FROM {events}
"""

SPANS_SQL = """
SELECT CAST(conv_id AS VARCHAR(20)) AS project_id, CAST(turn + 1 AS INT) AS clip_number,
 (turn + 1) * 2.5E0 + (conv_id % 7) / 4.0E0 AS span_start,
 (turn + 1) * 2.5E0 + (conv_id % 7) / 4.0E0 + ((conv_id + turn) % 9) / 2.0E0 AS span_end,
 (conv_id + turn) % 5 = 0 AS exhausted FROM {conversations}
"""

# Files on disk: every document but those a reviewer removed (toxic labels).
FILES_SQL = """
SELECT 'clip_' || CAST(d.doc_id AS VARCHAR(20)) || '.mp4' AS name, d.lang AS folder, d.doc_id, d.n_chars AS size,
 d.text AS content FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id WHERE coalesce(l.toxic, 0) = 0
"""

# Indexed entries: every document somebody labelled.
INDEX_SQL = """
SELECT 'clip_' || CAST(d.doc_id AS VARCHAR(20)) || '.mp4' AS name, d.lang AS folder, d.doc_id, d.text AS caption
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
"""

TABLES = ("documents", "conversations", "embeddings", "events", "pages", "labels", "benchmark")
SPREAD_KEYS = {
    "documents": ("doc_id",), "conversations": ("conv_id", "turn"), "embeddings": ("vec_id",), "events": ("event_id",),
    "pages": ("page_id",), "labels": ("doc_id",), "benchmark": ("item_id",),
}
VIEWS = {
    "hits": HITS_SQL, "clips": CLIPS_SQL, "progress": PROGRESS_SQL,
    "spans": SPANS_SQL, "files": FILES_SQL, "library_index": INDEX_SQL,
}

ORACLE = {name: sql.format(**{t: t for t in TABLES}).strip() for name, sql in VIEWS.items()}


class Views:
    """Lazy DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = tune(spark)
        self.folder = folder.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._read(name)
        return self._tables[name]

    def _read(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}.parquet", *SPREAD_KEYS.get(name, ()))

    def _view(self, name: str) -> DataFrame:
        sql = VIEWS[name]
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in sql}
        return self.spark.sql(sql, **used)

    @cached_property
    def hits(self) -> DataFrame:
        return self._view("hits")

    @cached_property
    def clip_rows(self) -> DataFrame:
        """Beats as they arrive: free-form visual types, no search phrases."""
        return self._view("clips")

    @cached_property
    def n_documents(self) -> int:
        return self.table("documents").count()

    @cached_property
    def longest(self) -> int:
        """Number of beats of the longest project."""
        return int(self.table("conversations").agg(F.max("turn")).first()[0] or 0) + 1

    @cached_property
    def clips(self) -> DataFrame:
        """Beats with valid visual types and the three kinds of search phrase."""
        tokens = overlap_tokens("script_beat")
        ranked = self.clip_rows.withColumn("visual_type", valid_visual_type("visual_type"))
        ranked = ranked.withColumn("_long", longest_first(tokens))
        phrase = lambda a, n: F.array_join(F.slice("_long", a, n), " ")
        return ranked.select(
            "*",
            phrase(1, 3).alias("canva_keyword"),
            F.array_join(F.slice(F.reverse("_long"), 1, 2), " ").alias("fallback_keyword"),
            F.filter(F.array(phrase(4, 2), phrase(6, 2), phrase(8, 2)), lambda p: p != "").alias("phrases"),
        ).drop("_long")

    @cached_property
    def progress(self) -> DataFrame:
        return self._view("progress")

    @cached_property
    def spans(self) -> DataFrame:
        return self._view("spans")

    @cached_property
    def files(self) -> DataFrame:
        return self._view("files")

    @cached_property
    def library_index(self) -> DataFrame:
        return self._view("library_index")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))

