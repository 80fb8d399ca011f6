"""Packing of tokenised documents into fixed windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows and parts of the remainder. A bounded number of parts is
partitioned into near-equal windows: every partial partition is a vector of window
loads; the two with the largest spread are merged so that the fullest window of one meets the emptiest
of the other, until one is left. If its fullest window exceeds the capacity, the number of windows
rises and the parts are partitioned again. All of it happens inside map tasks.

Defined results: null or empty text has the end id alone; repeated rows are packed as often as they
occur; other columns are ignored; an empty table gives an empty result. Sequence ids name the map task
and the window, so a task that runs again gives the same ids.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import pieces, slices, spread, text_of, tidy, utf8

WINDOW = 2048
END = 1
#: A remainder is cut into parts of at most PART ids, so that windows can be filled evenly.
PART = 512
#: Parts partitioned at a time; bounds memory and the length of the load vectors.
GROUP = 1536
#: Bytes of pieces and their ids that a worker remembers from task to task; an idle worker ends and frees them.
MEMO = 1 << 27
#: Bytes of text encoded at a time, or one longer text.
SLICE = 1 << 23

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_tokens long")


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window of each size, by multiway differencing. Ties go to the earlier partial partition.

    A partial partition holds its loads in descending order; loads of zero at the end are left out
    until as many windows are in use. A load stands for a tree of sizes.
    """
    n = len(sizes)
    tree = [(-1, -1)] * n
    heap = [(-int(size), i, np.array([size], dtype=np.int64), np.array([i], dtype=np.int64))
            for i, size in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    count = n
    while len(heap) > 1:
        _, _, loads, nodes = heapq.heappop(heap)
        _, _, others, names = heapq.heappop(heap)
        meet = max(0, len(loads) + len(others) - windows)
        # The fullest windows of one meet the emptiest of the other.
        alone, small = len(loads) - meet, others[::-1]
        both = loads[alone:] + small[:meet]
        joined = np.arange(len(tree), len(tree) + meet)
        tree.extend(zip(nodes[alone:].tolist(), names[::-1][:meet].tolist(), strict=True))
        loads = np.concatenate([loads[:alone], both, small[meet:]])
        nodes = np.concatenate([nodes[:alone], joined, names[::-1][meet:]])
        order = np.argsort(-loads, kind="stable")
        loads, nodes = loads[order], nodes[order]
        if len(loads) == windows:
            loads = loads - loads[-1]
        heapq.heappush(heap, (-int(loads[0]), count, loads, nodes))
        count += 1
    out = np.zeros(n, dtype=np.int64)
    for window, node in enumerate(heap[0][3].tolist() if heap else ()):
        stack = [node]
        while stack:
            left, right = tree[node := stack.pop()]
            if left < 0:
                out[node] = window
            else:
                stack += (left, right)
    return out


def fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each size so that none exceeds the capacity; the number of windows rises until that holds."""
    windows = max(1, -(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))
    while True:
        out = differencing(sizes, windows)
        if np.bincount(out, weights=sizes).max(initial=0) <= capacity:
            return out
        windows += 1 + windows // 500


#: Kinds of bytes. Words without ODD bytes consist of pre-tokens that are cut by kind: runs of letters, single digits, runs of
#: marks. Apostrophes, control characters and what is beyond Latin-1 letters are odd.
GAP, LETTER, DIGIT, MARK, ODD = range(5)
KIND = np.full(256, ODD, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = GAP
KIND[[c for c in range(33, 127) if c != 39]] = MARK
KIND[48:58] = DIGIT
KIND[[*range(65, 91), *range(97, 123)]] = LETTER


#: Byte-level vocabularies write bytes that are no visible Latin-1 character as code points from 256 on.
HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
BYTES = {b: 256 + i for i, b in enumerate(HIDDEN)}


#: Pieces of letters only, some of them beyond ASCII.
LATIN = re.compile("[a-zß-öø-ÿ]+").fullmatch


def cut_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(number of the distinct piece of every piece, distinct pieces, byte where each begins) of texts.

    Words without odd bytes are lower-cased and cut into pre-tokens; others stay whole, as they are.
    """
    kind = KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    lead = lead[(second != 0x97) & (second != 0xB7)]  # the signs of times and division
    kind[lead] = kind[lead + 1] = LETTER
    solid = kind != GAP
    cut = solid.copy()
    cut[1:] &= ~solid[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    cut[begins] = solid[begins]
    words = np.flatnonzero(cut)
    odd = np.logical_or.reduceat(kind == ODD, words) if len(words) else np.zeros(0, bool)
    plain = solid
    if odd.any():
        plain = np.repeat(np.append(True, ~odd), np.diff(np.concatenate([[0], words, [len(data)]]))) & solid
    inner = kind == DIGIT
    inner[1:] |= kind[1:] != kind[:-1]
    cut |= inner & plain
    low = data.copy()
    low[((data >= 65) & (data <= 90)) & plain] += 32
    upper = lead[(data[lead + 1] <= 0x9E) & plain[lead]] + 1
    low[upper] += 32
    starts = np.flatnonzero(cut)
    which, distinct = pieces(low[solid], np.cumsum(solid)[starts] - 1)
    return which, distinct, starts


class Recent:
    """Ids by word, the latest ones within ``most`` bytes: of two generations the older one goes as a whole.

    A word asked for again moves to the newer one.
    """

    #: Bytes of a dictionary place and two objects, besides their contents.
    EACH = 200

    def __init__(self, most: int):
        self.half = self.room = most // 2
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, word: str) -> bytes | None:
        ids = self.new.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is not None:
                self.put(word, ids)
        return ids

    def put(self, word: str, ids: bytes) -> None:
        size = self.EACH + 2 * len(word) + len(ids)
        if size > self.room:
            self.old, self.new, self.room = self.new, {}, self.half
        if size <= self.room:
            self.new[word] = ids
            self.room -= size


class WordIds:
    """Ids of words as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.memo = Recent(memo)

    def of(self, piece: str) -> bytes:
        """Ids of a pre-token in lower case, which goes to the merges directly, or of a word with odd characters."""
        out = self.memo.get(piece)
        if out is None:
            if piece.isascii() and "'" not in piece and piece.isprintable():
                ids = [token.id for token in self.model.tokenize(piece)]
            elif LATIN(piece):
                ids = [token.id for token in self.model.tokenize(piece.encode().decode("latin-1").translate(BYTES))]
            else:
                ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
            out = struct.pack(f"<{len(ids)}I", *ids)
            self.memo.put(piece, out)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids end).

        The tokenizer never joins text across ASCII white space or pre-tokens, so the distinct pieces of the texts
        are encoded one by one and put in place by number.
        """
        which, distinct, starts = cut_pieces(data, offsets)
        ids, ends = spread(which, [self.of(w) for w in distinct])
        ends = np.concatenate([[0], ends])
        return ids, ends[np.searchsorted(starts, offsets[1:])]


_WORDS: dict[str, WordIds] = {}


def _words(path: str) -> WordIds:
    """One for each worker process: the vocabulary is read once."""
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split(" ")[0] for part in SCHEMA.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, part: int = PART,
         group: int = GROUP) -> DataFrame:
    """One row per piece: where it starts in its document, its length and checksum, its sequence and place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 36
        words, tail, sequence = _words(tokenizer), struct.pack("<I", end), 0
        held: list[tuple] = []

        def windows(rows: list[tuple]) -> list[tuple]:
            nonlocal sequence
            of = fit(np.array([r[2] for r in rows], dtype=np.int64), window)
            order = np.argsort(of, kind="stable")
            totals = np.bincount(of, weights=[r[2] for r in rows]).astype(np.int64)
            out, offset, last, number = [], 0, -1, -1
            for i in order.tolist():
                if of[i] != last:
                    offset, last, number = 0, of[i], number + 1
                out.append((*rows[i], base + sequence + number, offset, int(totals[last])))
                offset += rows[i][2]
            sequence += number + 1
            return out

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for low, high in slices(offsets, SLICE):
                out, last = [], 0
                ids, ends = words.encode(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                for doc_id, stop in zip(doc_ids[low:high], ends.tolist(), strict=True):
                    own = ids[last:stop].tobytes() + tail
                    last, total = stop, len(own) // 4
                    cut = total // window * window
                    for start in range(0, cut, window):
                        crc = zlib.crc32(own[4 * start:4 * (start + window)])
                        out.append((doc_id, start, window, crc, total, base + sequence, 0, window))
                        sequence += 1
                    for start in range(cut, total, part):
                        crc = zlib.crc32(own[4 * start:4 * (start + part)])
                        held.append((doc_id, start, min(part, total - start), crc, total))
                    if len(held) >= group:
                        out += windows(held)
                        held = []
                yield _batch(out)
        if held:
            yield _batch(windows(held))

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(tidy(run), SCHEMA)
