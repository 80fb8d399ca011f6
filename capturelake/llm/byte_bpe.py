"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Within one match of the splitting pattern the tokens form a linked list. Every adjacent pair that has
a rank puts its left position into the bucket of that rank, and the rank's bit is set in a bitmap of
three levels of 64-bit words. Find-first-set gives the lowest rank at hand; the leftmost position of
its bucket is merged, unless the list changed there in the meantime (a stale entry, skipped). Each
merge costs the same however long the match is, so matches of any length are encoded whole.

Text repeats: the distinct stretches between spaces of some texts are found first and put in place by
number, and a worker remembers the ids of up to MEMO matches.
"""

from __future__ import annotations

import base64
import heapq
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import pieces, slices, spread, text_of, utf8

MEMO = 1_200_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
# White space as Unicode defines it; the pattern's matches never reach over these boundaries.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: First bytes of characters that are certainly no white space.
CLEAR = np.array([b > 32 and b not in (0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])
#: Bytes of text encoded at a time, or one longer text.
SLICE = 1 << 24


BIT = [1 << i for i in range(64)]
#: Position of the single bit of a word.
FIRST = {1 << i: i for i in range(64)}


class RankQueue:
    """Positions by rank; find-first-set over three levels of 64-bit words gives the lowest rank."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self, ranks: int):
        if ranks > 1 << 18:
            raise ValueError("three levels of 64-bit words hold 2^18 ranks")
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        self.low[word] |= BIT[rank & 63]
        self.mid[rank >> 12] |= BIT[word & 63]
        self.top |= BIT[rank >> 12]

    def pop(self) -> tuple[int, int]:
        """(lowest rank, its leftmost position); the queue must not be empty."""
        group = FIRST[(top := self.top) & -top]
        word = (group << 6) + FIRST[(bits := self.mid[group]) & -bits]
        rank = (word << 6) + FIRST[(bits := self.low[word]) & -bits]
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heapq.heappop(bucket)
        del self.buckets[rank]
        self.low[word] = bits = bits & (bits - 1)
        if not bits:
            self.mid[group] ^= BIT[word & 63]
            if not self.mid[group]:
                self.top ^= BIT[group]
        return rank, bucket[0]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """Encoder and decoder over byte ranks; remembers the ids of matches (little-endian unsigned 32-bit)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO):
        import regex

        self.ranks, self.memo = ranks, memo
        # The tokenizer's regular expressions know only Unicode white space by \s.
        self.split = regex.compile(pattern.replace("[^\\s", f"[^{SPACE}").replace("\\s", f"[{SPACE}]")
                                   .replace("\\S", f"[^{SPACE}]")).findall
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.words: dict[str, bytes] = {}
        self.tokens = {rank: token for token, rank in ranks.items()}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        ranks, n = self.ranks, len(data)
        get = ranks.get
        if (whole := get(data)) is not None:
            return [whole]
        queue = self.queue
        push, pop = queue.push, queue.pop
        # end[i]: end of the token that starts at i, or 0 when none starts there any more.
        end, before = list(range(1, n + 1)), list(range(-1, n))
        for i in range(n - 1):
            if (rank := get(data[i:i + 2])) is not None:
                push(rank, i)
        while queue.top:
            rank, i = pop()
            j = end[i]
            if not j or j >= n:
                continue
            k = end[j]
            if get(data[i:k]) != rank:
                continue
            end[i], end[j] = k, 0
            before[k] = i
            if k < n and (right := get(data[i:end[k]])) is not None:
                push(right, i)
            h = before[i]
            if h >= 0 and (left := get(data[h:k])) is not None:
                push(left, h)
        out, i = [], 0
        while i < n:
            j = end[i]
            out.append(ranks[data[i:j]])
            i = j
        return out

    def _word(self, word: str) -> bytes:
        out = self.words.get(word)
        if out is None:
            ids = self.merge(word.encode("utf-8", "replace"))
            if len(self.words) >= self.memo:
                self.words.clear()
            self.words[word] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def stretch(self, stretch: str) -> bytes:
        """Ids of the pattern's matches in a stretch of text, one after the other."""
        return b"".join(map(self._word, self.split(stretch)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids end).

        Texts are cut before a space that an ASCII character other than white space follows, or a letter
        beyond ASCII whose first byte no white space shares. The pattern starts a match there in any case.
        """
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        cut = np.zeros(len(data), dtype=bool)
        cut[:-1] = (data[:-1] == 32) & CLEAR[data[1:]]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        which, stretches = pieces(data, starts)
        ids, ends = spread(which, [self.stretch(s) for s in stretches])
        ends = np.concatenate([[0], ends])
        return ids, ends[np.searchsorted(starts, offsets[1:])]

    def texts(self, column) -> Iterator[np.ndarray]:
        """Ids of every text of an Arrow column."""
        data, offsets = utf8(column)
        for low, high in slices(offsets, SLICE):
            ids, ends = self.encode(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
            yield from np.split(ids, ends[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def _encoder(path: str, pattern: str) -> ByteBpe:
    """One encoder for each worker process, so that what it remembers serves several tasks."""
    key = (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = ByteBpe(load_ranks(path), pattern)
    return _ENCODERS[key]


_ENCODERS: dict[tuple, ByteBpe] = {}


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) per document. Null text is empty; every input row gives one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(ranks, pattern)
        for batch in batches:
            ids = pa.array([ids.astype(np.int32) for ids in bpe.texts(batch.column(1))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, data binary) per row of (doc_id, ids); null ids give empty data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(ranks, pattern)
        for batch in batches:
            data = [bpe.decode(np.array(ids or (), np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Per document the number of its ids, their digest, and the digest of what they decode to.

    Null text is empty; repeated rows give a row each; other columns are ignored; an empty table gives
    an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(ranks, pattern)
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for ids in bpe.texts(batch.column(1)):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, SCHEMA)
