from __future__ import annotations

import hashlib

from capturelake.llm import exact_dedup
from capturelake.llm.exact_dedup import exact_dedup as dedup, keep_one

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    norm = {(i, (t or "").translate(LOWER)) for i, t in rows}
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out = set()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        out |= {(i, keep, len(ids), i == keep, sha) for i in ids}
    return out


ROWS = [(1, "Same Text"), (2, "same text"), (7, "SAME TEXT"), (3, None), (4, ""), (5, "É same"), (6, "é same"),
        (None, "same text"), (None, "alone"), (8, "x" * 30), (9, "x" * 29 + "y"), (10, "x" * 30), (10, "x" * 30),
        (11, "ab" * 50), (12, "ab" * 50 + "a"), (13, "AB" * 50), (14, "😀b" * 40), (15, "😀b" * 40), (16, "İI"), (17, "İi")]


def test_names_match_brute_force_at_any_block_size(documents):
    df = documents(ROWS)
    for block in (1, 4, 7, 4096):
        assert {tuple(r) for r in dedup(df, block).collect()} == brute(ROWS)


def test_blocks_that_share_hash_and_length_are_told_apart(documents, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.length(c[0]).cast("long"))
    assert {tuple(r) for r in dedup(documents(ROWS), 4).collect()} == brute(ROWS)


def test_a_repeated_row_stays_once_with_its_columns(documents):
    df = documents(ROWS)
    kept = keep_one(df, 8)
    assert kept.columns == df.columns
    want = sorted((i, s) for i, _, _, stays, s in brute(ROWS) if stays and i is not None)
    got = [(r.doc_id, hashlib.sha256((r.text or "").translate(LOWER).encode()).hexdigest()) for r in kept.collect()]
    assert sorted((x for x in got if x[0] is not None)) == want
    assert len(got) == len(set(got))


def test_empty_table(documents):
    assert dedup(documents([])).count() == 0
    assert keep_one(documents([])).count() == 0
