from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa

from capturelake.llm.common import utf8
from capturelake.llm.quality import FEATURES, Model, accepted, classify, passages


def text(seed, good, n=150):
    draw = random.Random(seed)
    words = ["".join(draw.choice(["the", "ing", "tion", "er", "é"]) for _ in range(draw.randint(1, 3))) for _ in range(n)]
    if good:
        return " ".join(words)
    return " ".join(words[:40]) + " " + draw.choice([" | ".join(words), "!! ".join(words).upper(), "### ".join(words), words[0] + (" " + words[0]) * 90])


def tables(spark, n=400):
    rows = [(i, text(i, i % 4 > 0)) for i in range(n)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(n) if i % 5] + [(3, None, 0), (None, 1, 0), (99999, 1, 0)]
    extra = [(5000, None), (5001, ""), (5002, " \n "), (None, text(1, True)), rows[7], (5003, text(3, True, 20_000))]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string").selectExpr(
        "*", "'x' AS label", "1 AS score", "0 AS quality", "2 AS quality_score_")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, extra


def test_held_out_accuracy_and_columns(spark):
    docs, labels, rows, extra = tables(spark)
    out = classify(docs, labels).collect()
    assert len(out) == len(rows) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < len(rows)]
    right = np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in held])
    assert len(held) > 80 and right >= 0.95
    kept = accepted(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in out)


def test_scores_do_not_depend_on_partitions(spark):
    docs, labels, _, _ = tables(spark, 120)
    first = {(r.doc_id, round(r.score, 9)) for r in classify(docs, labels).collect()}
    assert first == {(r.doc_id, round(r.score, 9)) for r in classify(docs.repartition(7), labels.repartition(3)).collect()}


def test_no_labels_and_empty_tables(spark):
    docs, labels, _, _ = tables(spark, 20)
    assert {r.score for r in classify(docs, labels.limit(0)).collect()} == {0.5}
    assert classify(docs.limit(0), labels).count() == 0


def test_passages_of_a_text_do_not_depend_on_its_neighbours():
    texts = [text(i, i % 2 == 0, 10 + 37 * i) for i in range(8)] + ["", "  ", "one"]
    x, first = passages(*utf8(pa.array(texts)))
    assert x.shape[1] == FEATURES and len(first) == len(texts) + 1
    for i, t in enumerate(texts):
        alone, only = passages(*utf8(pa.array([t])))
        assert np.allclose(alone, x[first[i]:first[i + 1]])
        assert len(alone) == max(1, -(-len(t.split()) // 64)) == only[-1]


def test_gradients_reduce_the_loss():
    draw = np.random.default_rng(0)
    first = np.arange(0, 201, 4)
    x = draw.normal(size=(200, 5))
    labels = (np.maximum.reduceat(x[:, 0], first[:-1]) > 1).astype(float)
    model = Model(5)
    y = model.fit(x, first, labels).score(x, first)
    assert ((y >= 0.5) == (labels == 1)).mean() > 0.9


def small_bags():
    draw = np.random.default_rng(5)
    first = np.array([0, 1, 4, 9, 11])
    return Model(6, seed=2), draw.normal(size=(11, 6)), first, np.array([1.0, 0.0, 0.25, 1.0])


def plain_scores(model, x, first):
    """One passage after another: code, gate, attention over the bag, score."""
    p, out = model.p, []
    for a, b in zip(first[:-1], first[1:], strict=True):
        codes = [np.tanh(row @ p["W"] + p["b"]) for row in x[a:b]]
        weights = [np.exp(np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"]))) @ p["w"]) for h in codes]
        bag = sum(w * h for w, h in zip(weights, codes, strict=True)) / sum(weights)
        out.append(1 / (1 + np.exp(-(bag @ p["c"] + p["d"][0]))))
    return np.array(out)


def test_scores_equal_a_plain_loop():
    model, x, first, _ = small_bags()
    model.p["c"] = np.linspace(-1, 1, len(model.p["c"]))
    np.testing.assert_allclose(model._forward(x, first)["y"], plain_scores(model, x, first), rtol=1e-12)


def test_gradients_equal_finite_differences():
    model, x, first, labels = small_bags()
    model.p["c"] = np.linspace(-1, 1, len(model.p["c"]))

    def loss():
        y = plain_scores(model, x, first)
        return -(labels * np.log(y) + (1 - labels) * np.log(1 - y)).mean()

    draw = random.Random(4)
    for name, grad in model._gradients(x, first, labels).items():
        assert grad.shape == model.p[name].shape
        for _ in range(12):
            at = tuple(draw.randrange(n) for n in grad.shape)
            held, around = model.p[name][at], []
            for step in (1e-5, -1e-5):
                model.p[name][at] = held + step
                around.append(loss())
            model.p[name][at] = held
            assert abs((around[0] - around[1]) / 2e-5 - grad[at]) < 1e-8, (name, at)
