"""Language identification by cross-parsing entropy over suffix automata.

For each language a suffix automaton of labelled text recognises every substring of that text. A
document is parsed greedily: each phrase is the longest match of what follows in the automaton. The
language that needs the fewest phrases per character wins; a letter that a language lacks costs it two, as it has to be
announced and then spelled.

The automata are learned from a bounded sample: of each language PIECES pieces of PIECE characters,
chosen by a hash of the document id, at a place in the document also chosen by hash. Every learned letter has
its own symbol. Every text is then parsed whole, in blocks of STEP characters that are advanced together, one
character a step. A block is first parsed as if a phrase began with it; then it is parsed again from the state
in which the block before it ends, until both parses are in the same state, as they soon are. Where they do
not meet within the block, the next block follows in one more round, so the phrases are those of one greedy parse.

Defined results: ``und`` with score 0 if a text is null or has no letter, or if there is no labelled
text at all; ties go to the language first in alphabetical order; repeated rows give a row each; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturelake.llm.common import slices, text_of, utf8

#: Bounds of the learned sample, per language.
PIECES, PIECE = 160, 250
STEP = 256
SLICE = 1 << 21
#: The most frequent letters have a column in the table of transitions; those of the others are looked up by key.
COLUMNS = 90
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
SPACE, OTHER, PAD = 0, 1, 2

_CLASS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For every code point: the lower-case letter's code point, or 0 if it is no letter."""
    if not _CLASS:
        table = np.zeros(sys.maxunicode + 1, dtype=np.int32)
        for code in range(sys.maxunicode + 1):
            char = chr(code)
            if char.isalpha() or unicodedata.category(char)[0] == "L":
                low = char.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _CLASS.append(table)
    return _CLASS[0]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts exactly the substrings of ``symbols``; state 0 is the start."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
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
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


class Parser:
    """Automata of all languages in one table of transitions, advanced for many blocks at once."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        table, counts = letter_table(), {}
        coded = {}
        for name in self.languages:
            parts = [table[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)] for t in texts[name]]
            coded[name] = parts
            for part in parts:
                for code, n in zip(*np.unique(part[part > 0], return_counts=True), strict=True):
                    counts[int(code)] = counts.get(int(code), 0) + int(n)
        letters = sorted(counts, key=lambda code: (-counts[code], code))
        of_letter = np.full(sys.maxunicode + 1, OTHER, dtype=np.int32)
        of_letter[letters] = np.arange(len(letters)) + PAD + 1
        self.symbol = np.where(table > 0, of_letter[table], SPACE).astype(np.int32)
        self.symbols = len(letters) + PAD + 1
        self.width = min(self.symbols, COLUMNS + PAD + 1)
        rows, rare, self.roots, base = [], [], [], 0
        self.first = np.full((len(self.languages), self.symbols), -1, dtype=np.int32)
        for i, name in enumerate(self.languages):
            # Symbol -1 stands between pieces: no document contains it, so no match reaches over it. No automaton has OTHER.
            chain: list[int] = []
            for part in coded[name]:
                chain += self._dense(np.where(part > 0, of_letter[part], SPACE)).tolist() + [-1]
            moves = suffix_automaton(chain)
            grid = np.full((len(moves), self.width), -1, dtype=np.int32)
            for state, out in enumerate(moves):
                for c, to in out.items():
                    if c >= self.width:
                        rare.append(((base + state) * self.symbols + c, base + to))
                    elif c >= 0:
                        grid[state, c] = base + to
            for c, to in moves[0].items():
                if c >= 0:
                    self.first[i, c] = base + to
            grid[:, PAD] = np.arange(base, base + len(moves))
            self.roots.append(base)
            rows.append(grid)
            base += len(moves)
        # Between phrases: every symbol begins a new one, and one that the language lacks is a phrase of its own.
        self.between = base
        self.first[self.first < 0] = base
        none = np.full((1, self.width), -1, dtype=np.int32)
        none[:, PAD] = base
        self.moves = np.concatenate([*rows, none])
        self.roots = np.array(self.roots, dtype=np.int32)
        found = np.array(sorted(rare), dtype=np.int64).reshape(-1, 2)
        self.rare, self.rare_to = found[:, 0].copy(), found[:, 1].astype(np.int32)

    @staticmethod
    def _dense(symbols: np.ndarray) -> np.ndarray:
        """Runs of what is no letter become one space."""
        keep = symbols != SPACE
        keep[1:] |= symbols[:-1] != SPACE
        return symbols[keep]

    def _next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The state after ``symbol``, below 0 where the phrase ends before it."""
        if self.symbols == self.width:
            return self.moves.ravel()[state * self.width + symbol]
        symbol = np.broadcast_to(symbol, state.shape)
        seldom = symbol >= self.width
        to = self.moves.ravel()[state * self.width + np.where(seldom, OTHER, symbol)]
        if len(self.rare) and seldom.any():
            key = state[seldom].astype(np.int64) * self.symbols + symbol[seldom]
            at = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
            to[seldom] = np.where(self.rare[at] == key, self.rare_to[at], -1)
        return to

    def phrases(self, blocks: np.ndarray, follows: np.ndarray | None = None) -> np.ndarray:
        """Phrases that begin in each block (STEP symbols, padded), for each language: languages x blocks.

        ``follows`` tells the blocks that continue the block before them; without it none does.
        """
        languages, steps = len(self.roots), blocks.shape[1]
        count = np.zeros((languages, len(blocks)), dtype=np.int32)
        state = np.full(count.shape, self.between, dtype=np.int32)
        again = follows is not None and bool(follows.any())
        states = np.empty((steps if again else 0, *count.shape), np.int32)
        begun = np.empty(states.shape, bool)
        for j in range(steps):
            symbol = blocks[:, j]
            to = self._next(state, symbol)
            ended = to < 0
            count += ended
            state = np.where(ended, self.first[:, symbol], to)
            if again:
                states[j], begun[j] = state, ended
        if not again:
            return count
        out, last, change = state, np.full(count.shape, self.between, np.int32), np.zeros_like(count)
        active = np.flatnonzero(follows)
        language, block = (x.ravel() for x in np.meshgrid(np.arange(languages), active, indexing="ij"))
        while True:
            # Only parses that enter a block otherwise than they did before.
            enters = out[language, block - 1]
            new = enters != last[language, block]
            language, block, enters = language[new], block[new], enters[new]
            if not len(block):
                return count + change
            last[language, block] = enters
            run, at, difference = enters, np.arange(len(block)), np.zeros(len(block), np.int32)
            leaves = states[steps - 1][language, block]
            for j in range(steps):
                symbol = blocks[block[at], j]
                to = self._next(run, symbol)
                ended = to < 0
                difference[at] += ended.astype(np.int32) - begun[j][language[at], block[at]]
                run = np.where(ended, self.first[language[at], symbol], to)
                apart = run != states[j][language[at], block[at]]
                at, run = at[apart], run[apart]
                if not len(at):
                    break
            leaves[at] = run
            change[language, block] = difference
            out[language, block] = leaves
            block = block + 1
            on = block < len(blocks)
            on[on] = follows[block[on]]
            language, block = language[on], block[on]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for begin, end in slices(offsets, SLICE):
            for name, score in self._predict(data[offsets[begin]:offsets[end]], offsets[begin:end + 1] - offsets[begin]):
                names.append(name)
                scores.append(score)
        return names, scores

    def _predict(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[str, float]]:
        n = len(offsets) - 1
        if not self.languages:
            return [("und", 0.0)] * n
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        # Code points before each document: bytes that are no continuation bytes.
        leads = np.flatnonzero((data & 0xC0) != 0x80)
        starts = np.searchsorted(leads, offsets) if len(leads) == len(codes) else None
        if starts is None:
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:], strict=False)]
            codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        symbols = self.symbol[codes]
        keep = symbols != SPACE
        keep[1:] |= symbols[:-1] != SPACE
        total = np.concatenate([[0], np.cumsum(keep)])
        has_letter = np.concatenate([[0], np.cumsum(symbols != SPACE)])
        letters = has_letter[starts[1:]] - has_letter[starts[:-1]]
        begin = total[starts]
        size = np.diff(begin)
        symbols = symbols[keep]
        per = -(-size // STEP)
        first = np.concatenate([[0], np.cumsum(per)])
        blocks = np.full((int(first[-1]), STEP), PAD, dtype=np.int32)
        within = np.arange(len(symbols)) - np.repeat(begin[:-1], size)
        blocks[np.repeat(first[:-1], size) + within // STEP, within % STEP] = symbols
        follows = np.ones(len(blocks), bool)
        follows[first[:-1][per > 0]] = False
        phrases = self.phrases(blocks, follows) if len(blocks) else np.zeros((len(self.roots), 0), np.int32)
        running = np.concatenate([np.zeros((len(self.roots), 1), np.int64), np.cumsum(phrases, axis=1, dtype=np.int64)], 1)
        needed = running[:, first[1:]] - running[:, first[:-1]]
        for i, lacks in enumerate(self.first == self.between):
            missing = np.flatnonzero(lacks[symbols])
            needed[i] += np.bincount(np.searchsorted(begin, missing, side="right") - 1, minlength=n)
        best = np.argmin(needed, axis=0)
        out = []
        for i in range(n):
            if not letters[i]:
                out.append(("und", 0.0))
                continue
            counts = np.sort(needed[:, i])
            other = float(counts[1]) if len(counts) > 1 else float(counts[0])
            out.append((self.languages[best[i]], other / (other + float(counts[0]))))
        return out


def held_out(column: str = "doc_id", parts: int = 4, part: int = 2):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == part, F.lit(False))


def learn(docs: DataFrame, pieces: int = PIECES, piece: int = PIECE) -> Parser:
    """Parser over a bounded sample of the labelled documents that are not held out."""
    text = text_of()
    turn = F.xxhash64(F.col("doc_id").cast("string"), "text")
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & (F.char_length(text) > 0))
    at = F.pmod(F.xxhash64(turn), F.greatest(F.lit(1), F.char_length(text) - piece)) + 1
    chosen = labelled.select("lang", turn.alias("turn"), text.substr(at.cast("int"), F.lit(piece)).alias("piece"))
    order = Window.partitionBy("lang").orderBy("turn", "piece")
    rows = (chosen.withColumn("i", F.row_number().over(order)).where(F.col("i") <= pieces)
            .select("lang", "piece").orderBy("lang", "piece").collect())
    texts: dict[str, list[str]] = {}
    for row in rows:
        texts.setdefault(row["lang"], []).append(row["piece"])
    return Parser(texts)


def identify(docs: DataFrame, pieces: int = PIECES, piece: int = PIECE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per document. The score is the runner-up's share of the phrases of both."""
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, pieces, piece))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = held.value
        for batch in batches:
            names, scores = parser.predict(*utf8(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()),
                                              pa.array(scores, pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                       text_of().alias("text")).mapInArrow(run, SCHEMA)
