from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash

from capturelake.llm.substring_dedup import dedup_digest, dedup_substrings


def version(text):
    """The signed 64-bit hash that orders different texts of one doc_id."""
    return int.from_bytes(xxhash.xxh64_digest((text or "").encode(), seed=42), "big", signed=True)


def brute(rows, window=20):
    seen, out = {}, set()
    for i, t in sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], version(r[1]))):
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for a in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[a:a + window]), (i, t, a)) != (i, t, a):
                gone[a:a + window] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.add((i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    for i, t in rows:
        if i is None:
            w = (t or "").encode().split()
            out.add((None, len(w), 0, hashlib.sha256(b" ".join(w)).hexdigest()))
    return out


def corpus(seed, words):
    draw = random.Random(seed)
    shared = [words(seed + 50 + i, draw.randint(15, 60)) for i in range(5)]
    rows = []
    for i in range(150):
        parts = [words(1000 * seed + i, draw.randint(0, 120), draw.choice([2, 40, 4000]), draw.choice([" ", "\n", " \t "]))]
        for _ in range(draw.choice([0, 0, 1, 2])):
            parts.insert(draw.randrange(len(parts) + 1), draw.choice(shared))
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, rows[3][1]) for i in range(30)]
    rows += [(300, None), (301, ""), (302, "  "), (303, "Heat " * 90), (304, "Heat " * 50 + "x"), (305, "a b " * 40),
             (306, "\x0b" + rows[4][1]), (307, "É x y " * 25), (None, rows[3][1]), rows[9], rows[9]]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_matches_brute_force(documents, words, seed):
    rows = corpus(seed, words)
    assert {tuple(r) for r in dedup_digest(documents(rows).repartition(5)).collect()} == brute(rows)


def test_other_lengths_and_texts(documents, words):
    rows = corpus(7, words)[:80]
    got = {(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(bytes(r.kept_text)).hexdigest())
           for r in dedup_substrings(documents(rows), window=12, phrase=5).collect()}
    assert got == brute(rows, 12)


def test_empty_table(documents):
    assert dedup_digest(documents([])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_texts_that_share_a_doc_id(documents, words, seed):
    """Overlapping, equal, disjoint and empty texts of one id, in one batch and over several."""
    rows = [r for r in corpus(20 + seed, words) if r[0] is not None]
    passage = words(900 + seed, 70)
    rows += [(5, f"{passage} tail"), (5, f"head {passage}"), (5, passage), (5, passage), (5, "short"), (5, ""),
             (6, f"{passage} {passage}"), (9, rows[8][1]), (9, rows[9][1] + " " + rows[8][1])]
    for parts in (1, 6):
        got = [tuple(r) for r in dedup_digest(documents(rows).repartition(parts)).collect()]
        assert len(got) == len(rows) and set(got) == brute(rows)
