"""SQL text for the side-by-side check: common table expressions and the
fragments they share.  Written for clarity, as brute force over whole tables."""

from __future__ import annotations

import re

from mediaspark import config as C
from mediaspark.functions.text import PUNCTUATION_AND_DASHES, SPACE
from mediaspark.operators.terms import AFTER, BEFORE, _quote
from mediaspark.views import CATEGORIES, ORACLE


def lit(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]" if values else "CAST([] AS VARCHAR[])"


def inside(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


WS = lit(SPACE + "+")


def words(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, {WS}), lambda w: w <> '')"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, {lit(f'^{SPACE}+|{SPACE}+$')}, '', 'g')"


def normal_tokens(expr: str, chars: str = PUNCTUATION_AND_DASHES) -> str:
    return words(f"lower(translate({expr}, {lit(chars)}, ''))")


def overlap_tokens(expr: str) -> str:
    return (
        f"list_distinct(list_filter(string_split_regex(lower(translate({expr}, {lit(PUNCTUATION_AND_DASHES)}, '')), {WS}), "
        f"lambda t: length(t) > 1 AND NOT list_contains({strings(C.LOW_SIGNAL_WORDS)}, t)))"
    )


def mentions(expr: str, terms) -> str:
    if not terms:
        return "FALSE"
    body = "|".join(_quote(t) for t in terms)
    return f"regexp_matches(lower({expr}), {lit(f'{BEFORE}(?:{body}){AFTER}')})"


def first_banned(expr: str, cfg) -> str:
    cases = " ".join(f"WHEN {mentions(expr, [t])} THEN {lit(t)}" for t in cfg.banned)
    positive = f"WHEN {mentions(expr, cfg.positive)} THEN NULL " if cfg.positive else ""
    return f"CASE {positive}{cases} ELSE NULL END"


def by_category(make, column: str = "category", otherwise: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {lit(c.key)} THEN {make(c)}" for c in CATEGORIES) + f" ELSE {otherwise} END"


def provider_rank(source: str = "source", visual_type: str = "visual_type") -> str:
    def order(names):
        return f"CASE {source} " + " ".join(f"WHEN {lit(n)} THEN {i}" for i, n in enumerate(names)) + " END"

    return (
        f"CASE WHEN {visual_type} IN {inside(C.HISTORICAL_TYPES)} THEN {order(C.PROVIDERS_HISTORICAL)} "
        f"ELSE {order(C.PROVIDERS_DEFAULT)} END"
    )


def provider_active(source: str = "source", category: str = "category") -> str:
    archive = inside([c.key for c in CATEGORIES if c.use_archive])
    library = inside([c.key for c in CATEGORIES if c.library_path])
    return (
        f"(({source} <> 'internet_archive' OR {category} IN {archive}) "
        f"AND ({source} <> 'local_library' OR {category} IN {library}))"
    )


def code(total: str) -> str:
    """HH:MM:SS of an integer number of seconds."""
    return (
        f"lpad(CAST({total} // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST({total} % 3600 // 60 AS VARCHAR), 2, '0') "
        f"|| ':' || lpad(CAST({total} % 60 AS VARCHAR), 2, '0')"
    )


def half_even(expr: str) -> str:
    return f"CAST(round_even({expr}, 0) AS BIGINT)"


SCORE = """round_even((0.27E0 * semantic + 0.18E0 * keyword_match
   + 0.135E0 * CASE WHEN source IN {arch} AND visual_type IN {hist} THEN 1.0E0
       WHEN source IN {arch} OR visual_type IN {hist} THEN 0.6E0 ELSE 0.5E0 END
   + 0.135E0 * quality
   + 0.108E0 * least(1.0E0, CASE WHEN media_type = 'video' THEN 0.8E0 ELSE 0.4E0 END + 0.2E0 * quality)
   + 0.072E0 * CASE WHEN media_type = 'video' THEN 1.0E0 ELSE 0.0E0 END
   + 0.1E0 * CASE WHEN media_type <> 'video' OR duration <= 0 THEN 1.0E0 ELSE least(1.0E0, duration / 2.0E0) END
   ) * 10000.0E0, 0) / 100.0E0""".format(arch=inside(C.ARCHIVE_SOURCES), hist=inside(C.HISTORICAL_TYPES))

_SEQ = "list_sum(list_transform(list_zip(a, b), lambda p: p[1] * p[2]))"

CTES: dict[str, str] = dict(ORACLE)
CTES["clips_base"] = CTES.pop("clips")
CTES["beats"] = f"""
SELECT * EXCLUDE (visual_type), CASE WHEN visual_type IN {inside(C.VISUAL_TYPES)} THEN visual_type ELSE 'B-roll' END
  AS visual_type,
 list_transform(list_sort(list_transform({overlap_tokens('script_beat')},
   lambda t: lpad(CAST(100000 - length(t) AS VARCHAR), 6, '0') || t)), lambda k: substr(k, 7)) AS by_length
FROM clips_base"""
CTES["clips"] = """
SELECT * EXCLUDE (by_length), array_to_string(by_length[1:3], ' ') AS canva_keyword,
 array_to_string(list_reverse(by_length)[1:2], ' ') AS fallback_keyword,
 list_filter([array_to_string(by_length[4:5], ' '), array_to_string(by_length[6:7], ' '),
   array_to_string(by_length[8:9], ' ')], lambda p: p <> '') AS phrases
FROM beats"""
CTES["word_freq"] = f"""
SELECT token, n, n::DOUBLE / (sum(n) OVER ())::DOUBLE AS frequency,
 CAST(round_even(least(1.0E0, -log10(n::DOUBLE / (sum(n) OVER ())::DOUBLE) / 7.0E0) * 1000000000, 0) AS BIGINT) AS weight
FROM (SELECT token, count(*) AS n FROM (SELECT unnest({normal_tokens('text')}) AS token FROM documents) GROUP BY token)"""
CTES["phrase_rows"] = """
SELECT project_id, clip_number, visual_type, category, canva_keyword, vec_id, 1 AS tier, 1 AS phrase_no, canva_keyword AS query FROM clips
UNION ALL
SELECT project_id, clip_number, visual_type, category, canva_keyword, vec_id, 2, 1, fallback_keyword FROM clips
UNION ALL
SELECT project_id, clip_number, visual_type, category, canva_keyword, vec_id, 3, i, phrases[i]
FROM (SELECT *, unnest(range(1, len(phrases) + 1)) AS i FROM clips)"""
CTES["query_tokens"] = f"""
SELECT query, t.token, coalesce(weight, 1000000000) AS w
FROM (SELECT query, unnest({overlap_tokens('query')}) AS token FROM (SELECT DISTINCT query FROM phrase_rows)) t
LEFT JOIN word_freq f ON t.token = f.token"""
CTES["hit_tokens"] = f"""
SELECT doc_id, source, unnest({overlap_tokens('text')}) AS token FROM hits"""
CTES["matched"] = """
SELECT query, doc_id, sum(w) AS matched FROM query_tokens JOIN hit_tokens USING (token) GROUP BY query, doc_id"""
CTES["found"] = """
SELECT query, source, doc_id, CAST(matched AS BIGINT) AS matched, pos FROM (
 SELECT q.query, h.source, h.doc_id, coalesce(m.matched, 0) AS matched,
  row_number() OVER (PARTITION BY q.query, h.source ORDER BY coalesce(m.matched, 0) DESC, h.doc_id) AS pos
 FROM (SELECT DISTINCT query FROM phrase_rows) q CROSS JOIN hits h
 LEFT JOIN matched m ON q.query = m.query AND h.doc_id = m.doc_id) WHERE pos <= 5"""
CTES["query_total"] = "SELECT query, CAST(sum(w) AS BIGINT) AS total FROM query_tokens GROUP BY query"
CTES["vectors"] = "SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings"
CTES["banned_rows"] = "SELECT doc_id, key, term FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, {lit(c.key)} AS key, {first_banned('text', c)} AS term FROM hits" for c in CATEGORIES
) + ")"
CTES["pairs"] = f"""
SELECT p.project_id, p.clip_number, p.visual_type, p.category, p.canva_keyword, p.tier, p.phrase_no,
 {provider_rank('f.source', 'p.visual_type')} AS provider_rank, f.source, f.pos, f.doc_id, h.source_id, h.media_type,
 h.width, h.height, h.duration, (h.width > 0 AND h.height > 0 AND least(h.width, h.height) < 480) AS low_res,
 b.term AS banned_term, h.text, vq.embedding AS a, vh.embedding AS b
FROM phrase_rows p JOIN found f ON p.query = f.query JOIN hits h ON f.doc_id = h.doc_id
JOIN vectors vq ON p.vec_id = vq.vec_id JOIN vectors vh ON h.vec_id = vh.vec_id
LEFT JOIN banned_rows b ON b.doc_id = f.doc_id AND b.key = p.category
WHERE {provider_active('f.source', 'p.category')}"""
CTES["keyword_matches"] = """
SELECT k.canva_keyword, k.doc_id, sum(CASE WHEN h.token IS NULL THEN 0 ELSE q.w END)::DOUBLE / sum(q.w)::DOUBLE AS ratio
FROM (SELECT DISTINCT canva_keyword, doc_id FROM pairs) k JOIN query_tokens q ON q.query = k.canva_keyword
LEFT JOIN hit_tokens h ON h.doc_id = k.doc_id AND h.token = q.token GROUP BY k.canva_keyword, k.doc_id"""
CTES["scored_parts"] = f"""
SELECT p.* EXCLUDE (a, b, text), CASE WHEN text = '' THEN 0.5E0 ELSE greatest(0.0E0, least(1.0E0, {_SEQ})) END AS semantic,
 coalesce(k.ratio, 0.0E0) AS keyword_match, least(1.0E0, width::DOUBLE * height::DOUBLE / 2073600.0E0) AS quality
FROM pairs p LEFT JOIN keyword_matches k ON p.canva_keyword = k.canva_keyword AND p.doc_id = k.doc_id"""
CTES["candidates"] = f"""
SELECT * EXCLUDE (quality), CASE WHEN source = 'local_library' THEN least(100.0E0, {SCORE} + 10.0E0) ELSE {SCORE} END AS score
FROM scored_parts"""
CTES["usable"] = "SELECT * FROM candidates WHERE NOT low_res AND banned_term IS NULL"
CTES["tier_best"] = """
SELECT *, max(CASE WHEN tier = 1 THEN score END) OVER w AS best1, max(CASE WHEN tier = 2 THEN score END) OVER w AS best2,
 min(CASE WHEN tier = 3 THEN phrase_no END) OVER w AS first_phrase
FROM usable WINDOW w AS (PARTITION BY project_id, clip_number, source)"""
CTES["escalated"] = """
SELECT * EXCLUDE (best1, best2, first_phrase) FROM tier_best WHERE tier = 1
 OR (tier = 2 AND coalesce(best1, -1) < 50)
 OR (tier = 3 AND coalesce(best1, -1) < 50 AND coalesce(best2, -1) < 50 AND phrase_no = first_phrase)"""
CTES["searched"] = """
SELECT * EXCLUDE (before, library_best) FROM (
 SELECT *, max(score) OVER (PARTITION BY project_id, clip_number ORDER BY provider_rank
   RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  max(CASE WHEN source = 'local_library' THEN score END) OVER (PARTITION BY project_id, clip_number) AS library_best
 FROM escalated)
WHERE coalesce(before, -1) < 90 AND (coalesce(library_best, -1) < 75 OR source = 'local_library')"""
ARRIVAL = "CASE WHEN media_type = 'image' THEN 1 ELSE 0 END, provider_rank, tier, phrase_no, pos"
CTES["ranked"] = f"""
SELECT *, CAST(row_number() OVER (PARTITION BY project_id, clip_number ORDER BY score DESC, {ARRIVAL}) AS INT) AS rank
FROM searched WHERE score >= 50"""


def query(sql: str, **extra: str) -> str:
    """The statement with the expressions it needs, in dependency order."""
    known = {**CTES, **extra}
    ordered: list[str] = []

    def visit(name: str, trail: tuple[str, ...]) -> None:
        if name in ordered or name in trail:
            return
        found = set(re.findall(r"[A-Za-z_]+", known[name]))
        for other in known:
            if other != name and other in found:
                visit(other, (*trail, name))
        ordered.append(name)

    found = set(re.findall(r"[A-Za-z_]+", sql))
    for name in known:
        if name in found:
            visit(name, ())
    if not ordered:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS ({known[name].strip()})" for name in ordered)
    return f"WITH {ctes}\n{sql.strip()}"
