"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspark.llm.common import table
from mediaspark.session import tune

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(tune(spark), folder)

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return run

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@_query()
def op4_minimax_shards(spark: SparkSession, folder: str) -> DataFrame:
    from mediaspark.llm.minimax import minimax_shards

    out = minimax_shards(table(spark, folder, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query()
def op1_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    from mediaspark.llm.fingerprints import edited_likeness

    return edited_likeness(table(spark, folder, "documents"))


@_query()
def op6_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    from mediaspark.llm.pii import personal_data

    return personal_data(table(spark, folder, "documents"))


@_query()
def op7_template_windows(spark: SparkSession, folder: str) -> DataFrame:
    from mediaspark.llm.templates import contaminated

    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
classes AS (SELECT min(doc_id) AS id, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY 2, 3),
marks AS (SELECT id, n, hash(unnest(s)) AS h FROM classes),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY h) AS r FROM marks),
heads AS (SELECT id, n, h FROM ranked WHERE r <= n - (9 * n + 9) // 10 + 1),
near AS (SELECT DISTINCT a.id AS a, b.id AS b FROM heads a JOIN heads b ON a.h = b.h AND a.id < b.id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
links AS (
  SELECT a, b FROM near JOIN classes x ON x.id = a JOIN classes y ON y.id = b
  WHERE 190 * len(list_intersect(x.s, y.s)) >= 90 * (x.n + y.n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT id, id AS r FROM classes UNION SELECT reach.id, edges.b FROM reach JOIN edges ON edges.a = reach.r),
named AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(named.component_id, sets.doc_id) AS component_id
FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s LEFT JOIN named ON named.id = classes.id
"""


@_query(_OP2_SQL)
def op2_parity_sketch(spark: SparkSession, folder: str) -> DataFrame:
    from mediaspark.llm.parity_join import similarity_components

    return similarity_components(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@_query()
def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from mediaspark.llm.tokens import token_files

    return token_files(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query()
def op9_weak_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that the classifier keeps, with their scores."""
    from mediaspark.llm.weak_quality import classify

    scored = classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.where("accepted").select("doc_id", "p_quality", "p_toxic")


def labelled_languages(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    """(doc_id, domain): the language of the rows that the labels call good."""
    good = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    return docs.select("doc_id", F.col("lang").alias("domain")).join(good, "doc_id", "left_semi")


@_query()
def op10_soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from mediaspark.llm.mixing import mixture

    docs = table(spark, folder, "documents")
    return mixture(docs, labelled_languages(spark, folder, docs))


@_query()
def op5_run_length_index(spark: SparkSession, folder: str) -> DataFrame:
    from mediaspark.llm.repeats import without_repeats

    return without_repeats(table(spark, folder, "documents"))


@_query()
def op3_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    from mediaspark.llm.ctw import scores

    return scores(table(spark, folder, "documents"))


_OP11_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(40 // 5 * 4), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(d, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""


@_query(_OP11_SQL)
def op11_boundary_chains(spark: SparkSession, folder: str) -> DataFrame:
    from mediaspark.llm.warc import archived

    return archived(table(spark, folder, "pages"))


_OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT range AS i, CAST(range AS UINTEGER) AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, xor(c >> 1, CASE WHEN c & 1 = 1 THEN CAST(3988292384 AS UINTEGER) ELSE CAST(0 AS UINTEGER) END), k + 1 FROM bits WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
texts AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS (
  SELECT kind, id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
  SELECT kind, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
    || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM words),
counted AS (SELECT kind, id, f, count(*) AS n FROM runs GROUP BY ALL),
features AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)),
hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS UINTEGER)),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1]), CAST(4294967295 AS UINTEGER)), CAST(4294967295 AS UINTEGER)) % 10000 AS b
  FROM features, crcs),
placed AS (SELECT kind, id, b, n FROM counted JOIN hashed USING (f)),
held AS (
  SELECT range AS b, coalesce(sum(n) FILTER (kind = 0), 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t FROM range(10000) LEFT JOIN placed ON b = range GROUP BY 1),
gains AS (
  SELECT b, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (sum(s) OVER () + 10000) / ((CAST(s AS DOUBLE) + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM held),
sums AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM placed JOIN gains USING (b) WHERE kind = 0 GROUP BY id),
scored AS (
  SELECT words.id AS doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || words.id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN sums ON sums.id = words.id WHERE kind = 0),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""


@_query(_OP12_SQL)
def op12_word_automaton(spark: SparkSession, folder: str) -> DataFrame:
    from mediaspark.llm.resample import importance_ranks

    return importance_ranks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("n_words")


_OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || doc_id) AS h FROM documents),
r AS (SELECT *, list_transform(range(4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS x FROM d),
c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 90 THEN 'plain'
    WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM o
"""


@_query(_OP13_SQL)
def op13_learned_rank(spark: SparkSession, folder: str) -> DataFrame:
    from mediaspark.llm.middle import fill_in_middle, restored

    out = fill_in_middle(table(spark, folder, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
