"""URL filter: host and path rules first, then a weighted vocabulary sought with an Aho-Corasick automaton.

The longest rule that fits decides (a rule fits its host, every subdomain of it, and paths that start with the
rule's path). Where none fits, the terms of the vocabulary are sought in the whole URL, A-Z lower-cased, all at once.
A term counts only between characters that are not letters or digits (or the ends of the URL). One strict term
rejects, and so do ``needed`` different soft terms; repeats of one soft term count once.

Rows are judged one by one in map tasks: no shuffle, so no key can be hot. Both lists are parameters of bounded size.

Defined cases: a null URL, one without ``://`` and an empty one have an empty host and path and fit no rule; their text
is still sought for terms (null: none). A repeated row is judged each time. Hosts keep port and user information as
they stand. Only the columns named in the result leave, so further columns of the table may have any name.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import ascii_lower

#: (host, start of the path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))

STRICT = ("adult", "casino", "cialis", "escort", "gambling", "malware", "phishing", "porn", "spam", "viagra", "xxx")
SOFT = ("ad", "ads", "bet", "bets", "betting", "bonus", "cheap", "click", "clicks", "deal", "deals", "dating", "free", "hot",
        "jackpot", "loan", "loans", "lottery", "payday", "pharmacy", "pill", "pills", "poker", "popup", "promo", "replica",
        "sex", "slot", "slots", "track", "tracker", "tracking", "win", "winner", "xx")

#: Different soft terms that reject.
NEEDED = 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host between the first ``://`` and ``/``, ``?``, ``#`` or the end; path from there to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)),
            F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, by characters of host and path; null where none fits."""
    chosen = None
    for name, start, verdict in sorted(rules, key=lambda r: -len(r[0]) - len(r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, found) if chosen is None else chosen.when(fits, found)
    return chosen if chosen is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


@functools.lru_cache(maxsize=4)
def _automaton(strict: tuple, soft: tuple):
    import ahocorasick

    found = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):  # a term of both lists is strict
        for term in terms:
            found.add_word(term, (weight, term))
    found.make_automaton()
    return found


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def terms_in(url: str, strict: tuple, soft: tuple) -> tuple[list[str], list[str]]:
    """(strict, soft) terms that stand alone somewhere in the URL, each once and sorted."""
    text = url.translate(_LOWER)
    hits = {1: set(), 2: set()}
    for last, (weight, term) in _automaton(strict, soft).iter(text):
        before, after = last - len(term), last + 1
        if (before < 0 or text[before] not in _INSIDE) and (after == len(text) or text[after] not in _INSIDE):
            hits[weight].add(term)
    return sorted(hits[2]), sorted(hits[1])


def judge(pages: DataFrame, rules=RULES, strict: tuple = STRICT, soft: tuple = SOFT, needed: int = NEEDED,
          key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, strict_terms, soft_terms of every row."""
    if not all((*strict, *soft)) or not (strict or soft):
        raise ValueError("terms are not empty, and there is one at least")

    def seek(batches):
        import pyarrow as pa

        for batch in batches:
            found = [terms_in(u, strict, soft) for u in batch.column(1).to_pylist()]
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:1], *batch.columns[2:], pa.array([a for a, _ in found], texts), pa.array([b for _, b in found], texts)],
                names=[key, "host", "path", "fit", "strict_terms", "soft_terms"])

    host, path = host_and_path(F.col("u"))
    rows = pages.select(F.col(key).alias("k"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("u"))
    rows = rows.select("k", "u", host.alias("h"), path.alias("p"))
    rows = rows.withColumn("fit", longest_rule(F.col("h"), F.col("p"), rules))
    kind = pages.schema[key].dataType.simpleString()
    judged = rows.mapInArrow(seek, f"`{key}` {kind}, host string, path string, fit struct<rule: string, verdict: string>, "
                                   "strict_terms array<string>, soft_terms array<string>")
    rejected = (F.size("strict_terms") > 0) | (F.size("soft_terms") >= needed)
    return judged.select(F.col(key), "host", "path", F.col("fit.rule").alias("rule"),
                         F.coalesce(F.col("fit.verdict"), F.when(rejected, "block").otherwise("allow")).alias("verdict"),
                         "strict_terms", "soft_terms")
