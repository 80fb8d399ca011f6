"""One registered query per operator, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from capturelake.llm import (
    audit_queries,
    byte_bpe,
    exact_dedup,
    language,
    ngram_join,
    packing,
    page_text,
    quality,
    secret_scan,
    substring_dedup,
    topk,
)
from capturelake.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"),
                               public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digest(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_digest(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_classes(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH t AS (
    SELECT DISTINCT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                             'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, text_sha256
FROM t JOIN g USING (text_sha256)
"""

OP5_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
u AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
x AS (SELECT doc_id, i, words[i] AS word,
             CASE WHEN i + 19 <= len(words) THEN array_to_string(words[i:i + 19], ' ') END AS win FROM u),
d AS (SELECT doc_id, i, word,
             win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM x),
c AS (SELECT doc_id, i, word,
             bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
      FROM d),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
             string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

OP7_SQL = """
WITH v AS (
    SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 5
"""

def _op8_sql() -> str:
    """Spans from matches and the gaps between them; entropies window by window."""
    quote = lambda pattern: "'" + pattern.replace("'", "''") + "'"

    def matched(kind: str, pattern: str, group: int) -> str:
        return (f"regexp_extract_all(text, {quote(pattern)}) AS m_{kind}, string_split_regex(text, {quote(pattern)}) AS g_{kind}, "
                f"regexp_extract_all(text, {quote(pattern)}, {group}) AS c_{kind}")

    def spans(kind: str, rank: int, test: str) -> str:
        before = f"list_sum([length(y) FOR y IN g_{kind}[1:i]]) + coalesce(list_sum([length(y) FOR y IN m_{kind}[1:i - 1]]), 0)"
        places = f"[{{'i': i, 'a': CAST({before} AS BIGINT)}} FOR i IN range(1, len(m_{kind}) + 1)]"
        span = f"{{'a': x.a, 'rank': {rank}, 'kind': '{kind}', 'b': x.a + length(m_{kind}[x.i])}}"
        return f"[{span} FOR x IN {places} IF {test}] AS s_{kind}"

    kinds = {kind: (pattern, group, least) for kind, pattern, group, least in secret_scan.BASE}
    allowed = " OR ".join(f"regexp_matches(c, {quote(p)})" for p in secret_scan.ALLOWED)
    size = secret_scan.WINDOW
    window = (f"list_max([-list_sum([n / {size}.0 * log2(n / {size}.0) FOR n IN [length(w) - length(replace(w, ch, '')) "
              f"FOR ch IN list_distinct(string_split(w, ''))]]) FOR w IN [c[i:i + {size - 1}] FOR i IN range(1, length(c) - {size - 2})]])")
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT *, {", ".join(matched(k, *v[:2]) for k, v in kinds.items())}, {matched("entropy", secret_scan.CANDIDATE, 0)} FROM t),
e AS (SELECT *, [CASE WHEN {allowed} THEN false ELSE {window} >= CASE WHEN regexp_matches(c, '^[0-9a-fA-F]+$')
        THEN {secret_scan.HEX_BITS} ELSE {secret_scan.BASE64_BITS} END END FOR c IN c_entropy] AS high FROM m),
s AS (SELECT *, {", ".join(spans(k, r, f"length(c_{k}[x.i]) >= {v[2]}") for r, (k, v) in enumerate(kinds.items()))},
        {spans("entropy", 3, "high[x.i]")} FROM e),
f AS (SELECT doc_id, s_assign, s_access, s_hex, list_sort(s_assign || s_access || s_hex) AS base,
        [x FOR x IN s_entropy IF len([y FOR y IN s_assign || s_access || s_hex IF y.a <= x.a AND x.b <= y.b]) = 0] AS more FROM s)
SELECT doc_id, len(s_assign) AS n_assign, len(s_access) AS n_access, len(s_hex) AS n_hex,
       sha256(array_to_string([concat(x.kind, ':', x.a, ':', x.b) FOR x IN base], ',')) AS base_sha256,
       array_to_string([concat(x.kind, ':', x.a, ':', x.b) FOR x IN list_sort(base || more)], ',') AS spans
FROM f
"""


OP8_SQL = _op8_sql()

OP10_SQL = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, array_to_string(words, ' ') AS s FROM w WHERE len(words) BETWEEN 1 AND 4
      UNION ALL
      SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ')
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
n AS (SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
      FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT doc_id, n AS n_shingles, component_id
FROM n JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) USING (doc_id)
"""

#: name -> (query, SQL or None)
QUERIES = {
    "op1_exact_dedup": (op1_exact_dedup, OP1_SQL),
    "op2_packing": (op2_packing, None),
    "op3_byte_bpe": (op3_byte_bpe, None),
    "op4_page_text": (op4_page_text, None),
    "op5_substring_dedup": (op5_substring_dedup, OP5_SQL),
    "op6_quality": (op6_quality, None),
    "op7_topk": (op7_topk, OP7_SQL),
    "op8_secret_scan": (op8_secret_scan, OP8_SQL),
    "op9_language": (op9_language, None),
    "op10_ngram_join": (op10_ngram_join, OP10_SQL),
} | audit_queries.QUERIES
