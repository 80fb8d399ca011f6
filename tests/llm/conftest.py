from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text) as a documents table, with columns whose names operators use themselves."""
    def make(rows, schema="doc_id long, text string", **extra):
        df = spark.createDataFrame(rows, schema)
        from pyspark.sql import functions as F

        clash = {"key": 1, "n": 2, "h": 3, "name": "x", "pos": 4, "level": 5, "kept": False, "score": 0.5, "start": 7,
                 "family": 8, "uses": 9, "m": 10, "word": "w", "label": 1, "host": "h", "block": 2, "size": 3} | extra
        return df.withColumns({k: F.lit(v) for k, v in clash.items()})
    return make


@pytest.fixture
def words():
    """Random texts over a small vocabulary."""
    def make(seed, n, vocabulary=40, sep=" "):
        draw = random.Random(seed)
        return sep.join(f"w{draw.randrange(vocabulary)}" for _ in range(n))
    return make
