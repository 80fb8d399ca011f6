from __future__ import annotations

import math
import random

import pytest

from capturelake.llm.topk import top_k


def brute(rows, k, every):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(b) == len(a))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def rows_of(seed, n=300, dims=8):
    draw = random.Random(seed)
    rows = [(i, [draw.choice([draw.gauss(0, 1), 0.0, 0.5]) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, rows[10][1]) for i in range(20)]
    return rows + [(n + 50, None), (n + 51, [None] * dims), (n + 52, [math.nan] * dims), (n + 53, [math.inf] * dims),
                   (n + 54, []), (n + 56, [1.0] * (dims + 1)), (n + 100, [0.0] * dims), (None, rows[0][1])]


@pytest.mark.parametrize(("seed", "block", "asked"), [(0, 4096, 1024), (1, 32, 4)])
def test_matches_brute_force(spark, seed, block, asked):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS rank", "3 AS part")
    import numpy as np

    exact = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(tuple(r) for r in top_k(df, 5, 10, block=block, query_block=asked).collect())
    assert got == brute(exact, 5, 10)


def test_few_candidates_and_empty_table(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.25, -1.0])], schema)
    assert [tuple(r) for r in top_k(df).collect()] == [(0, 1, 1, 256 * 64 - 128 * 256)]
    assert top_k(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert top_k(spark.createDataFrame([], schema)).count() == 0
