"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is described by shares of kinds of
characters and words and encoded by a learned layer; gated attention, tanh(Vh) * sigmoid(Uh), weighs
the passages of a document; the weighted passage representation gives the score. Only documents have
labels: what a passage contributes is learned through the attention.

The model is fitted on a bounded sample, the SAMPLE labelled rows that are not held out and come first
by a hash of the id; every whole text is scored. Labels, language, source and id are no inputs.

Defined results: null text is empty; an empty text has one passage without words and is scored like
any other; rows with a null label teach nothing; without any labelled row every score is 0.5;
repeated rows give a row each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capturelake.llm.common import renamed, slices, text_of, tidy, utf8

PASSAGE = 64
SAMPLE = 6000
HIDDEN, GATE = 16, 8
ROUNDS, RATE, DECAY = 400, 0.03, 1e-4
SLICE = 1 << 22
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

#: Kinds of bytes whose shares of a passage are features.
KINDS = ("|", "!", "#$%&*@^~`", "0123456789", ".", ",;:", "?", "<>{}[]()\\/_=+", "\"'", "\n")
FEATURES = 2 * (len(KINDS) + 1) + 7


def _tables() -> np.ndarray:
    out = np.zeros((len(KINDS), 256), dtype=np.uint8)
    for i, kind in enumerate(KINDS):
        out[i, [ord(c) for c in kind]] = 1
    return out


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, first passage of every document); a document without words has one of zeros."""
    feats, counts = [], []
    tables = _tables()
    for begin, end in slices(offsets, SLICE):
        f, c = _passages(data[offsets[begin]:offsets[end]], offsets[begin:end + 1] - offsets[begin], tables)
        feats.append(f)
        counts.append(c)
    counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    feats = np.concatenate(feats) if feats else np.zeros((0, FEATURES))
    return feats, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _passages(data: np.ndarray, offsets: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    word = data > 32
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[:-1][(offsets[:-1] < len(data)) & (np.diff(offsets) > 0)]
    begins[inner] = word[inner]
    starts = np.flatnonzero(begins)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    per_doc = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
    parts = np.maximum(1, -(-per_doc // PASSAGE))
    first = np.concatenate([[0], np.cumsum(parts)])
    out = np.zeros((int(first[-1]), FEATURES))
    if not len(starts):
        return out, parts
    index = np.arange(len(starts)) - np.repeat(np.concatenate([[0], np.cumsum(per_doc)])[:-1], per_doc)
    passage = first[doc] + index // PASSAGE
    heads = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    at, to = passage[heads], starts[heads]
    add = lambda x: np.add.reduceat(x, heads)  # noqa: E731  words to passages
    words = np.diff(np.append(heads, len(starts))).astype(float)
    size = np.add.reduceat(word, starts, dtype=np.int64)
    letters = np.maximum(1.0, add(size))
    upper = (data >= 65) & (data <= 90)
    if len(data) > 1:  # À-Þ in UTF-8
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    code = np.add.reduceat(data * word, starts, dtype=np.int64) * 64 + size
    same = np.zeros(len(starts))
    same[1:] = (code[1:] == code[:-1]) & (index[1:] > 0)
    apart = np.zeros(len(starts))
    apart[2:] = (code[2:] == code[:-2]) & (index[2:] > 1)
    masks = [upper, *(tables[i][data] for i in range(len(tables)))]
    for i, mask in enumerate(masks):
        # A passage's bytes reach from its first word to the next passage's.
        total = np.add.reduceat(mask, to, dtype=np.int64)
        out[at, 2 * i] = total / letters
        out[at, 2 * i + 1] = np.minimum(3.0, total / words)
    base = 2 * len(masks)
    out[at, base] = letters / words / 10
    out[at, base + 1] = add(same) / words
    out[at, base + 2] = add(apart) / words
    out[at, base + 3] = add(upper[starts].astype(float)) / words
    out[at, base + 4] = words / PASSAGE
    out[at, base + 5] = add((size > 12).astype(float)) / words
    out[at, base + 6] = 1.0
    return out, parts


class Model:
    """Gated-attention pooling over encoded passages, fitted by Adam on whole bags."""

    def __init__(self, features: int = FEATURES, seed: int = 7):
        draw = np.random.default_rng(seed)
        scale = lambda a, b: draw.normal(0, 1 / np.sqrt(a), (a, b))
        self.mean, self.std = np.zeros(features), np.ones(features)
        self.p = {"W": scale(features, HIDDEN), "b": np.zeros(HIDDEN), "V": scale(HIDDEN, GATE), "U": scale(HIDDEN, GATE),
                  "w": scale(GATE, 1)[:, 0], "c": np.zeros(HIDDEN), "d": np.zeros(1)}
        self.fitted = False

    def _forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, counts = self.p, np.diff(first)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), counts))
        a = e / np.repeat(np.add.reduceat(e, first[:-1]), counts)
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def _gradients(self, x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of the bags, by parameter; x is standardised."""
        p, counts, n = self.p, np.diff(first), len(labels)
        f = self._forward(x, first)
        dy = (f["y"] - labels) / n
        dz = np.repeat(dy[:, None] * p["c"], counts, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first[:-1]), counts))
        dt = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
                "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True)}

    def fit(self, x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> Model:
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-3
        x, p = (x - self.mean) / self.std, self.p
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
        for step in range(1, ROUNDS + 1):
            grad = self._gradients(x, first, labels)
            for k, g in grad.items():
                m, v = moments[k]
                g = g + DECAY * p[k]
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p[k] -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        self.fitted = True
        return self

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(first) - 1
        if not n or not self.fitted:
            return np.full(n, 0.5)
        return self._forward((x - self.mean) / self.std, first)["y"]


def held_out(column: str = "doc_id", parts: int = 3, part: int = 1):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == part, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model fitted on the passages of at most ``sample`` labelled documents that are not held out."""
    chosen = (labels.where(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id")
              .agg(F.avg("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = (docs.select(F.col("doc_id").alias("_id"), text_of().alias("text"))
             .join(F.broadcast(chosen), F.col("_id") == F.col("doc_id")).select("doc_id", "label", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, first = passages(*utf8(batch.column(2)))
            bags = [x[a:b].astype(np.float32).tobytes() for a, b in zip(first, first[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.binary())],
                                             names=["doc_id", "label", "bag"])

    rows = (texts.select(F.col("doc_id").cast("long"), F.col("label").cast("double"), "text")
            .mapInArrow(run, "doc_id long, label double, bag binary").collect())
    model = Model()
    if rows:
        rows.sort(key=lambda r: (r["doc_id"], bytes(r["bag"])))
        bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows]
        first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
        model.fit(np.concatenate(bags).astype(float), first, np.array([r["label"] for r in rows]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of the documents, and ``quality_score`` from 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            at = batch.schema.get_field_index("text")
            text = batch.column(at).cast(pa.large_string())
            y = held.value.score(*passages(*utf8(pc.fill_null(text, pa.scalar("", pa.large_string())))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y, pa.float64())],
                                             names=[*batch.schema.names, "quality_score"])

    return docs.mapInArrow(tidy(run), schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document."""
    rows = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learn(docs, labels, sample))
    return rows.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"),
                       (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that are not rejected, with all their columns unchanged, whatever their names."""
    rows, at = renamed(docs)
    scored = score(rows.withColumnRenamed(at["text"], "text"), learn(docs.select("doc_id", "text"), labels, sample))
    return scored.where("quality_score >= 0.5").drop("quality_score").toDF(*docs.columns)
