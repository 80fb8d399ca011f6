from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from capturelake.llm import source_audit
from capturelake.llm.source_audit import divergence, kept_terms

SCHEMA = "doc_id long, text string, lang string, source string"


def terms_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(rows, least, top):
    out, by_lang, held, count = [], defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        by_lang[lang].add(source)
        words = terms_of(text)
        held[lang].update(set(words))
        count[lang, source].update(words)
    for lang, sources in by_lang.items():
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        total = sum(count[lang, s][t] for s in sources for t in kept)
        p = {}
        for s in sources:
            n = sum(count[lang, s][t] for t in kept)
            p[s] = {t: 1 + 10**9 * (count[lang, s][t] + 2) // (n + 2 * len(kept)) for t in kept}
        q = {t: 1 + 10**9 * (sum(count[lang, s][t] for s in sources) + 2) // (total + 2 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in sources if o != s]
            own = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(own, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, r + 1) for r, (v, item) in enumerate(found)]
    return sorted(out)


def rows_of(seed, n=150):
    draw = random.Random(seed)
    words = ["the", "The", "cat,", "(cat)", "dog-cat", "élan", "Élan", "x1y", "λόγος", "a\x00b", "...", "12", "日本", "end."] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(n):
        text = draw.choice([" ", "\n", "\t \x0b"]).join(draw.choice(words) for _ in range(draw.randrange(0, 40)))
        rows.append((draw.choice([i, i, 5]), draw.choice([text] * 8 + [None, ""]), draw.choice(["en", "en", "de", None, "zz" if i % 40 == 0 else "en"]),
                     draw.choice(["s0", "s0", "s1", "s2", None, f"t{i % 3}", "é"])))
    return [*rows, rows[0], rows[0], (None, "the", "only", "one"), (1, None, "bare", "a"), (2, "", "bare", "b")]


@pytest.mark.parametrize(("seed", "slice_bytes", "tile"), [(0, 1 << 23, (32, 1 << 14)), (1, 300, (2, 3))])
def test_matches_plain_counts(spark, monkeypatch, seed, slice_bytes, tile):
    rows = rows_of(seed)
    monkeypatch.setattr(source_audit, "TILE_SOURCES", tile[0])
    monkeypatch.setattr(source_audit, "TILE_TERMS", tile[1])
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 AS chunk", "2 AS slice", "3 AS term", "4 AS p", "5 AS groups", "6 AS rank")
    got = sorted(tuple(r) for r in divergence(df, least=5, top=4, slice_bytes=slice_bytes).collect())
    assert got == plain(rows, 5, 4)


def counted(spark, rows, least, **kwargs):
    out = kept_terms(spark.createDataFrame(rows, SCHEMA).coalesce(1), least, **kwargs)
    return {(r.g, r.term): (r.n, r.whole, r.one) for r in out.collect()}


def test_a_term_in_several_chunks_counts_a_document_once(spark):
    rows = [(1, "cat cat, (CAT) cat-cat", "en", "s"), (1, "cat", "en", "s"), (2, "dog " * 70_000, "en", "s")]
    assert sorted(v for v in counted(spark, rows, 1).values()) == [(6, 6, 1), (70_000, 70_000, 1)]
    assert list(counted(spark, rows, 2).values()) == [(6, 6, 1)]
    assert counted(spark, rows, 3) == {}


def test_documents_of_many_chunk_forms_and_groups_add_up(spark):
    """No form, group or slice has enough documents alone."""
    forms = ["cat", "Cat,", "(cat)", "cat.", "CAT!"]
    rows = [(i, forms[i % 5], "en", f"s{i % 3}") for i in range(10)] + [(20 + i, f"{forms[i % 5]} {forms[i % 4]}", "de", "s") for i in range(9)]
    for size in (1 << 20, 8):
        assert sorted(v[1:] for v in counted(spark, rows, 10, slice_bytes=size).values()) == [(10, 0), (10, 0), (10, 1)]


def test_tasks_merge_what_they_hold(spark, monkeypatch):
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choice(["a", "b", "B,", "c-d"]) for _ in range(20)), "en", f"s{i % 3}") for i in range(60)]
    merge = source_audit._gathered
    want = counted(spark, rows, 3)
    batches = list(source_audit.Counts.added(
        source_audit.pa.array([b"x", b"y"], source_audit.pa.large_binary()), *(source_audit.np.array(x) for x in (
            [0, 1, 0], [0, 1, 0], [5, 6, 7], [0, 1, 0], [0, 1, 0], [1, 2, 3])), source_audit.np.array([[1, 1], [2, 2]]), 2).rows(4)) * 5
    counts = merge(iter(batches), 2, most=10)
    assert sorted(zip(counts.names.take(source_audit.pa.array(counts.name)).to_pylist(), counts.count.tolist(), strict=True)) == [(b"x", 60), (b"y", 30)]
    assert counted(spark, rows, 3, slice_bytes=50) == want


def test_empty_table_and_exact_quotients(spark):
    assert divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    row = spark.range(1).selectExpr("cast(123456789012345678 as long) AS n", "cast(987654321098765432 as long) AS total", "cast(7 as long) AS v")
    got = row.select(source_audit._share("n", "total", "v").alias("p")).first().p
    assert got == 1 + 10**9 * (123456789012345678 + 2) // (987654321098765432 + 14)
