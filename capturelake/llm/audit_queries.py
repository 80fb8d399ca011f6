"""Registered queries of the audits and the URL filter, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from capturelake.llm import conversation_repair, source_audit, url_filter
from capturelake.llm.common import table

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from its language and from every other source; cases as in ``source_audit``."""
    return source_audit.divergence(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit and cheapest repair of every damaged conversation; cases as in ``conversation_repair``."""
    return conversation_repair.audit_damaged(table(spark, sf_dir, "conversations"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; cases as in ``url_filter``."""
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


OP11_SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '{source_audit.TERM}') AS terms
    FROM documents),
t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY lang, term
      HAVING count(DISTINCT id) >= {source_audit.LEAST_DOCUMENTS}),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, CAST(count(*) AS HUGEINT) AS n FROM t JOIN k USING (lang, term)
      GROUP BY t.lang, t.source, t.term),
s AS (SELECT g.lang, g.source, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS total
      FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
             1 + {source_audit.SCALE} * (coalesce(c.n, 0) + 2) // (s.total + 2 * l.v) AS p,
             1 + {source_audit.SCALE} * (k.n + 2) // (l.total + 2 * l.v) AS q
      FROM s JOIN k ON k.lang = s.lang JOIN l ON l.lang = s.lang
      LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
          GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= {source_audit.TOP}
"""


def _op12_sql() -> str:
    """The same least cells row by row: four states, each with its cheapest (cost, audit) so far."""
    repair = conversation_repair
    white = r"\x20\x09-\x0D"
    steps = "list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0])"
    crc = ("xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(name, '')]), "
           f"lambda crc, b: list_reduce({steps}, lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)")

    def plus(cell: str, cost, letter: str) -> str:
        return f"CASE WHEN {cell} IS NOT NULL THEN {{'c': ({cell}).c + {cost}, 'a': ({cell}).a || '{letter}'}} END"

    def first(options: list[str]) -> str:
        return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"

    closed = ", ".join(
        first([f"c{p}" if not word else plus(f"c{p}", cost, word) for (p, q), (cost, word) in repair._INSERTED.items() if q == state])
        + f" AS i{state}" for state in range(4))
    fine = f"CASE WHEN fault = 'truncated' THEN {repair.CUT_OFF} ELSE 0 END"
    moves = {q: [plus(f"i{q}", repair.DELETE, "D")] for q in range(4)}
    for p in range(4):
        q = repair.GIVEN[p][0]
        moves[q].append(f"CASE WHEN free THEN {plus(f'i{p}', f'{repair.REROLE} + {fine}', 'R')} END")
        for (source, initial), target in repair.STEP.items():
            if source == p:
                moves[target].append(f"CASE WHEN free AND initial = '{initial}' THEN {plus(f'i{p}', fine, 'K')} END")
    stepped = ", ".join(f"{first(options)} AS c{q}" for q, options in moves.items())
    cell = "STRUCT(c BIGINT, a VARCHAR)"
    return f"""
WITH RECURSIVE named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
kinds AS (SELECT *, {crc} % 20 AS kind FROM named),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
            FROM kinds WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
                    left(role, 1) AS initial FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again,
                lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{white}]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
                          WHEN NOT regexp_matches(text, '[.!?][{white}]*\\z') THEN 'truncated' ELSE 'sound' END AS fault FROM seen),
turns AS (SELECT *, fault IN ('truncated', 'sound') AS free FROM judged),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
           FROM turns GROUP BY conv_id),
walk(conv_id, i, c0, c1, c2, c3) AS (
    SELECT conv_id, CAST(0 AS BIGINT), CAST({{'c': 0, 'a': ''}} AS {cell}), CAST(NULL AS {cell}), CAST(NULL AS {cell}), CAST(NULL AS {cell}) FROM counts
    UNION ALL
    SELECT conv_id, i, {stepped} FROM (
        SELECT w.conv_id, t.i, t.initial, t.fault, t.free, {closed}
        FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1)),
least AS (SELECT conv_id, {first(["c0", "i3"])} AS best FROM (
    SELECT w.conv_id, w.c0, {closed} FROM walk w JOIN counts n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.i)),
letters AS (SELECT conv_id, best.a AS audit, unnest(range(1, length(best.a) + 1)) AS k FROM least),
edits AS (SELECT conv_id, k, audit[k] AS edit, k - (length(audit[1:k]) - length(replace(audit[1:k], 'I', ''))) AS i,
                 k - (length(audit[1:k]) - length(replace(audit[1:k], 'D', ''))) AS place FROM letters),
kept AS (SELECT e.*, t.role, t.text, max(CASE WHEN e.edit = 'K' AND t.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS system
         FROM edits e LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.i = e.i AND e.edit <> 'I' WHERE e.edit <> 'D'),
lines AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                     || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS repaired FROM kept GROUP BY conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate,
       coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal, coalesce(l.best.c, 0) AS cost,
       coalesce(l.best.a, '') AS audit, sha256(coalesce(r.repaired, '')) AS repaired_sha256
FROM every e LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN least l ON l.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN lines r ON r.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def _op13_sql() -> str:
    """Rules from the longest on; terms by one pattern each."""
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0]) - len(r[1]))

    def chosen(value) -> str:
        return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, v)}'"
                                  for h, p, v in rules) + " END"

    def held(terms) -> str:
        return " + ".join(f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS INTEGER)" for t in terms)

    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
a AS (SELECT page_id, translate(url, {_UPPER}, {_LOWER}) AS low,
             CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_UPPER}, {_LOWER}) AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT page_id, host, path, {chosen(lambda h, p, v: h + p)} AS rule,
       coalesce({chosen(lambda h, p, v: v)}, CASE WHEN {held(url_filter.STRICT)} >= 1 OR {held(url_filter.SOFT)} >= {url_filter.NEEDED}
                THEN 'block' ELSE 'allow' END) AS verdict
FROM h
"""


QUERIES = {
    "op11_source_audit": (op11_source_audit, OP11_SQL),
    "op12_conversation_repair": (op12_conversation_repair, _op12_sql()),
    "op13_url_filter": (op13_url_filter, _op13_sql()),
}
