"""Removal of repeated passages by suffix automata of reference shards.

A window is WINDOW consecutive words. Windows are dealt to shards by their minimizer, the least hash
of the PHRASE-word phrases in them: equal windows have equal minimizers, and neighbouring windows mostly
share one, so they travel as one segment of text. Each shard streams its segments in order of document
and position through a suffix automaton of the segments before: the matching statistics (length of
the longest suffix that the automaton contains) tell which windows have an earlier copy, and the segment is
then added to the automaton. Maximal spans of such windows are removed.

Segments whose minimizer occurs once in the corpus hold no repeated window; only hashes of them are
moved. Of equal segments in one batch of a map task only the first is sent to the shard; the others have an
earlier copy for certain. A segment equal to one before it is settled without the automaton, so thousands of
copies of a passage cost no more than reading them, and the automaton grows with different text only.

The automata are not broadcast: their number grows with the corpus, and every document would pass through
every one. The shards bring each segment to the only automaton it can match.

Defined results: null text has no words; documents with fewer words than a window keep all; rows that
repeat a doc_id with the same text are one document and get the same result each; rows that repeat a doc_id with
another text are documents of their own, and of their equal windows the one in the text of least hash (signed 64 bits)
stays; a null doc_id keeps all words and is no reference; texts of any length are read whole; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import slices, text_of, utf8, working_table
from capturelake.llm.words import mixed, shingle_hashes, window_minima, word_hashes

WINDOW = 20
PHRASE = 8
SLICE = 1 << 23
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def segments(data: np.ndarray, offsets: np.ndarray, window: int, phrase: int):
    """(text number, first window, windows, minimizer, first byte, byte after, alone) of every segment.

    alone: the minimizer is in one place of the segment, so no two of its windows are equal.
    """
    words, starts, before = word_hashes(data, offsets)
    phrases, width = shingle_hashes(words, phrase), window - phrase + 1
    minima = window_minima(phrases, width)
    n = len(minima)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    # A window lies in one text: its first and last word do.
    valid = doc[:n] == doc[window - 1:window - 1 + n] if n else np.zeros(0, bool)
    new = valid.copy()
    new[1:] &= (minima[1:] != minima[:-1]) | (doc[1:n] != doc[:n - 1])
    first = np.flatnonzero(new)
    if not len(first):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty, empty, empty.astype(bool)
    ends = np.append(np.cumsum(valid), 0)
    upto = np.append(first[1:], n)
    count = ends[upto - 1] - ends[first] + 1
    last = first + count + window - 2
    steps, m = np.arange(width), minima[first][:, None]
    left = first + np.argmax(phrases[first[:, None] + steps] == m, axis=1)
    final = first + count + width - 2
    right = final - np.argmax(phrases[final[:, None] - steps] == m, axis=1)
    texts = doc[first]
    stops = np.append(starts, len(data))[np.minimum(last + 1, len(starts))]
    return (texts, first - before[texts], count, minima[first].view(np.int64), starts[first],
            np.minimum(stops, offsets[texts + 1]), left == right)


class Automaton:
    """Suffix automaton of several sequences, extended word by word."""

    def __init__(self):
        self.moves, self.link, self.length = [{}], [-1], [0]

    def _clone(self, p: int, c, q: int) -> int:
        copy = len(self.moves)
        self.moves.append(dict(self.moves[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p >= 0 and self.moves[p].get(c) == q:
            self.moves[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def extend(self, last: int, c) -> int:
        """State of the sequence that ended in ``last`` with ``c`` added."""
        moves, link, length = self.moves, self.link, self.length
        q = moves[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def stream(self, words: list, window: int) -> list[bool]:
        """For every window of the sequence whether it has an earlier copy; the sequence is then part of the automaton."""
        moves, link, length = self.moves, self.link, self.length
        out, state, matched, last = [], 0, 0, 0
        for i, c in enumerate(words):
            # A clone may have taken over the matched suffix.
            while link[state] >= 0 and matched <= length[link[state]]:
                state = link[state]
            while state and c not in moves[state]:
                state = link[state]
                matched = length[state]
            if c in moves[state]:
                state, matched = moves[state][c], matched + 1
            if i >= window - 1:
                out.append(matched >= window)
            last = self.extend(last, c)
        return out


class Shard:
    """Segments of one minimizer, in order of document and position."""

    def __init__(self, window: int):
        self.window, self.automaton, self.waiting, self.seen = window, None, [], set()

    def repeated(self, content: bytes) -> list[bool]:
        words = content.split()
        n = len(words) - self.window + 1
        key = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
        if key in self.seen:
            return [True] * n
        self.seen.add(key)
        if self.automaton is None:
            if not self.waiting and len({tuple(words[i:i + self.window]) for i in range(n)}) == n:
                self.waiting.append(words)  # nothing before it and no copy within: an automaton may never be needed
                return [False] * n
            self.automaton = Automaton()
            for held in self.waiting:
                self.automaton.stream(held, self.window)
            self.waiting = []
        return self.automaton.stream(words, self.window)


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def candidates(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(doc_id, starts): segments whose minimizer occurs more than once; docs: (doc_id, text).

    Texts that share a doc_id share a row: a start too many costs the shard a look at it and changes no result.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            for low, high in slices(offsets, SLICE):
                texts, first, _, minimizer, _, _, alone = segments(
                    data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], window, phrase)
                # A segment that may repeat within itself counts twice.
                rows = np.repeat(np.arange(len(first)), np.where(alone, 1, 2))
                texts, first, minimizer = texts[rows], first[rows], minimizer[rows]
                yield pa.RecordBatch.from_arrays([pa.array(minimizer), pa.array(ids[low:high][texts]), pa.array(first)],
                                                 names=["m", "doc_id", "start"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows, sorted by m, that have a neighbour with the same m; the last row waits for the next batch."""
        m, rest = np.zeros(0, np.int64), []
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _columns(batch, "m", "doc_id", "start")
            if len(m):
                new = [np.concatenate([held, x]) for held, x in zip([m, *rest], new, strict=True)]
            m, rest = new[0], new[1:]
            keep = np.zeros(len(m), dtype=bool)
            same = m[1:] == m[:-1]
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= before is not None and m[0] == before
            keep[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in rest], names=["doc_id", "start"])
            before = m[-2] if len(m) > 1 else before
            m, rest = m[-1:], [x[-1:] for x in rest]
        if len(m) and before is not None and m[0] == before:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rest], names=["doc_id", "start"])

    rows = docs.where("doc_id is not null").mapInArrow(hashes, "m long, doc_id long, start long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(parts, "m").sortWithinPartitions("m").mapInArrow(shared, "doc_id long, start long")
            .groupBy("doc_id").agg(F.collect_list("start").alias("starts")))


def repeated_spans(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, version, first, after): words covered by windows that start earlier elsewhere.

    docs: (doc_id, text, version); version tells apart the texts of one doc_id and orders them.
    """

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            wanted, versions = batch.column(2), batch.column(3).to_numpy(zero_copy_only=False)
            for low, high in slices(offsets, SLICE):
                part, places = data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
                texts, first, count, minimizer, begin, end, _ = segments(part, places, window, phrase)
                chosen = wanted.slice(low, high - low)
                sizes = np.diff(chosen.offsets.to_numpy())
                pairs = np.repeat(np.arange(high - low), sizes) << 40 | chosen.flatten().to_numpy(zero_copy_only=False)
                keep = np.flatnonzero(np.isin(texts << 40 | first, pairs))
                raw = part.tobytes()
                doc_ids, starts, m = ids[low:high][texts[keep]], first[keep], minimizer[keep]
                version = versions[low:high][texts[keep]]
                content = [raw[a:b] for a, b in zip(begin[keep].tolist(), end[keep].tolist(), strict=True)]
                held, settled = {}, np.zeros(len(keep), np.int64)
                for i in np.lexsort((starts, version, doc_ids)).tolist():
                    at = held.setdefault((int(m[i]), content[i]), i)
                    if (doc_ids[at], version[at], starts[at]) != (doc_ids[i], version[i], starts[i]):
                        settled[i], content[i] = count[keep[i]], b""
                # Settled segments need no shard; they are dealt out anyhow.
                m = np.where(settled > 0, mixed((doc_ids * 1_000_003 + starts).view(np.uint64)).view(np.int64), m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m), pa.array(doc_ids), pa.array(version), pa.array(starts), pa.array(content, pa.binary()),
                     pa.array(settled)], names=["m", "doc_id", "version", "start", "content", "settled"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, key, place = Shard(window), None, None
        for batch in batches:
            ids, found, begins, ends = [], [], [], []
            m, doc_ids, versions, starts = (x.tolist() for x in _columns(batch, "m", "doc_id", "version", "start"))
            rows = zip(m, doc_ids, versions, starts, batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
            for mine, doc_id, version, start, content, settled in rows:
                if settled:
                    ids.append(doc_id)
                    found.append(version)
                    begins.append(start)
                    ends.append(start + settled - 1 + window)
                    continue
                if mine != key:
                    shard, key, place = Shard(window), mine, None
                if (doc_id, version, start) == place:
                    continue  # a repeated row
                place = (doc_id, version, start)
                flags = shard.repeated(content)
                at, n = 0, len(flags)
                while at < n:
                    if flags[at]:
                        to = at
                        while to + 1 < n and flags[to + 1]:
                            to += 1
                        ids.append(doc_id)
                        found.append(version)
                        begins.append(start + at)
                        ends.append(start + to + window)
                        at = to
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, found, begins, ends)],
                                             names=["doc_id", "version", "first", "after"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chosen = candidates(docs, window, phrase)
    rows = docs.join(chosen, "doc_id").select("doc_id", "text", "starts", "version")
    moved = rows.mapInArrow(contents, "m long, doc_id long, version long, start long, content binary, settled long")
    return (moved.repartition(parts, "m").sortWithinPartitions("m", "doc_id", "version", "start")
            .mapInArrow(match, "doc_id long, version long, first long, after long"))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text binary) per document: the kept words joined by one space."""
    return _removed(docs, window, phrase, False)


def dedup_digest(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per document."""
    return _removed(docs, window, phrase, True)


def _removed(docs: DataFrame, window: int, phrase: int, digest: bool) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn(
        "version", F.xxhash64("text"))
    spans = working_table(repeated_spans(docs, window, phrase).groupBy("doc_id", "version").agg(
        F.collect_list("first").alias("first"), F.collect_list(F.col("after")).alias("after")))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            data, offsets = utf8(batch.column(1))
            raw, offsets = data.tobytes(), offsets.tolist()
            firsts, afters = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for a, b, first, after in zip(offsets, offsets[1:], firsts, afters, strict=False):
                words = raw[a:b].split()
                total.append(len(words))
                if first:
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, first, 1)
                    np.add.at(depth, after, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
                gone.append(total[-1] - len(words))
                text = b" ".join(words)
                kept.append(hashlib.sha256(text).hexdigest() if digest else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(kept, pa.string() if digest else pa.binary())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept_text"])

    schema = SCHEMA if digest else "doc_id long, n_words long, n_removed long, kept_text binary"
    return docs.join(spans, ["doc_id", "version"], "left").select("doc_id", "text", "first", "after").mapInArrow(remove, schema)
