from __future__ import annotations

import random

import numpy as np
import pytest

from capturelake.llm import ngram_join
from capturelake.llm.components import components
from capturelake.llm.ngram_join import Index, block_links, keep_one, link_classes


def sets_of(rows):
    out = []
    for _, t in rows:
        w = (t or "").lower().split()
        out.append(frozenset(tuple(w[a:a + 5]) for a in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute(rows):
    sets, up = sets_of(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return {(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)}


def corpus(seed, n=250, hot=0.4):
    draw = random.Random(seed)
    bases = [[f"w{draw.randint(0, 3000)}" for _ in range(draw.randint(3, 120))] for _ in range(10)]
    rows = []
    for i in range(n):
        words = list(bases[0] if draw.random() < hot else draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 2, 3, 5])):
            k = draw.randrange(len(words))
            words[k] = f"z{draw.randint(0, 40)}" if draw.random() < 0.6 else words[k].upper()
        rows.append((3 * i + 1, " ".join(words + [f"c{i}" for i in range(30)] * (draw.random() < 0.2))))
    return rows + [(9000, None), (9001, ""), (9002, " \n "), (9003, "One two"), (9004, "one\tTWO"), (None, "one two"),
                   (None, "only here"), rows[5], rows[5]]


@pytest.mark.parametrize(("seed", "block"), [(0, 512), (1, 16)])
def test_classes_match_brute_force(documents, monkeypatch, seed, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "PIVOTS", 3)
    rows = corpus(seed)
    assert {tuple(r) for r in link_classes(documents(rows)).collect()} == brute(rows)


def template_corpus(n, share, seed=5):
    """Documents that share much text but do not link, and a few links among them."""
    draw = random.Random(seed)
    base = [f"t{i}" for i in range(share)]
    rows = [(i, " ".join(base + [f"u{i}_{k}" for k in range(100 - share)])) for i in range(n)]
    for i in draw.sample(range(n), 12):
        rows.append((1000 + i, rows[i][1].replace(f"u{i}_0", "z") if share < 90 else rows[i][1]))
    return rows


@pytest.mark.parametrize("share", [60, 85])
def test_groups_of_a_family_without_links_are_bounded(documents, monkeypatch, share):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "QUERIES", 2, raising=False)
    groups = []

    def watch(name):
        real = getattr(ngram_join, name)

        def run(rows, *args):
            groups.append(rows.groupBy(*[c for c in ("family", "block", "chunk") if c in rows.columns]).count()
                          .agg({"count": "max"}).first()[0])
            return real(rows, *args)
        monkeypatch.setattr(ngram_join, name, run)

    watch("by_block")
    if hasattr(ngram_join, "by_query"):
        watch("by_query")
    rows = template_corpus(300, share)
    assert {tuple(r) for r in link_classes(documents(rows)).collect()} == brute(rows)
    assert len(groups) == 2 and all((g or 0) <= 110 for g in groups)


def test_least_document_of_each_group_stays(documents):
    rows = corpus(2, 60)
    df = documents(rows)
    kept = keep_one(df)
    assert kept.columns == df.columns
    got = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert got == sorted({d for d, _, c in brute(rows) if d == c and d is not None})


def test_empty_table(documents):
    assert link_classes(documents([])).count() == 0


def test_search_finds_every_partner():
    draw = random.Random(3)
    base = list(range(0, 300))
    sets = [sorted(set(draw.sample(base, draw.randint(200, 300)))) for _ in range(60)] + [list(range(250))] * 3
    index = Index()
    for s in sets:
        index.add(s)
    for s in sets:
        x = set(s)
        assert sorted(index.search(s)) == [i for i, y in enumerate(sets) if 100 * len(x & set(y)) >= 80 * len(x | set(y))]
    arrays = [np.array(s, dtype=np.int64) for s in sets]
    up = list(range(len(sets)))
    for a, b in block_links(arrays):
        up = [up[a] if x == up[b] else x for x in up]
    full = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in index.search(x):
            full = [full[i] if y == full[j] else y for y in full]
    groups = lambda v: {frozenset(i for i, x in enumerate(v) if x == r) for r in v}
    assert groups(up) == groups(full)


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    draw = random.Random(1)
    edges += [(300 + draw.randrange(60), 300 + draw.randrange(60)) for _ in range(50)]
    up = {v: v for e in edges for v in e if e[0] != e[1]}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {(r.id, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(v, root(v)) for v in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
