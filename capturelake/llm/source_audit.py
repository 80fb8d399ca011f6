"""Source divergence audit: how far the words of each source stand from those of its language and of other sources.

Chunk factorization: texts are cut at ASCII white space into chunks. Every map task counts the chunks of its documents,
slice by slice (some megabytes of text, whole documents): occurrences by group, which is a (language, source), and
some of the documents. Counts of one chunk meet in one task, which cuts each of its distinct chunks into terms once
and adds the chunk's counts to them; counts of one term meet in another task. Between the stages the counts of
a slice travel as one row per bucket of names, so the rows of a shuffle are few and wide.

Whether a term is in enough documents needs ``least`` distinct ones, so ``least`` documents of each name and group
are all that has to travel: whoever drops more has seen enough. The test is exact however many chunks hold a term.

Skew: a frequent chunk has one entry per slice and group, whatever the number of its occurrences, and tasks merge what
they hold whenever it passes a fixed number of bytes. Sources of a language are compared in tiles of source groups and
term groups. The result has every pair of sources of a language, so it grows with their square; a tile emits a pair
once for some thousands of terms.

Counts, sums and quotients are integers; quotients are formed from decimals of 38 digits and are below 2^63 as long as
the counts of one group are below 10^18. Languages and groups travel as 64-bit hashes, and a collision stops the job.

Defined cases: null text, language or source is an empty one; an empty text or one without terms counts for its group
alone; every row is a document, repeated ids and repeated rows too; a table without rows gives no rows. Other columns are
not read. A very long text is a slice of its own.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from capturelake.llm.common import join_groups, slices, text_of, tidy, utf8, working_table

#: A term, as a pattern over characters: bytes of letters A-Z, a-z and of all characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS = 10
SCALE = 1_000_000_000
TOP = 10
#: Bytes of text of one slice.
SLICE = 1 << 23
#: Bytes that a task holds before it merges them.
HELD = 1 << 25
#: Sources and terms of one tile.
TILE_SOURCES, TILE_TERMS = 32, 1 << 14

#: Names of a bucket with their counts. entries: how many entries a name has; an entry is a place in the groups of the
#: row, a count and a number of documents, which follow one another in ``documents``.
_COUNTS = ("bucket int, names binary, name_sizes binary, entries binary, places binary, counts binary, document_counts binary, "
           "documents binary, langs binary, groups binary")
_FIELDS = {"name_sizes": "<u4", "entries": "<u4", "places": "<u2", "counts": "<i8", "document_counts": "<u2", "documents": "<i8",
           "langs": "<i8", "groups": "<i8"}


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i] + 1, ... (sizes[i] of them) one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _before(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, sizes) of a binary array."""
    data, offsets = utf8(array)
    return data, np.diff(offsets)


class Counts:
    """Names with entries (group, count, documents), the groups being (language, group) hashes."""

    def __init__(self, names: pa.Array, name, group, count, document_counts, documents, groups: np.ndarray):
        self.names, self.name, self.group, self.count = names, name, group, count
        self.document_counts, self.documents, self.groups = document_counts, documents, groups

    @staticmethod
    def added(names: pa.Array, name, group, count, document_name, document_group, document, groups: np.ndarray, least: int) -> Counts:
        """Sums of the entries of one name and group; at most ``least`` different documents of each."""
        width = max(len(groups), 1)
        key, order = name * width + group, slice(None)
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        key, count = key[first], np.add.reduceat(count, first) if len(first) else count
        own = document_name * width + document_group
        order = np.lexsort((document, own))
        own, document = own[order], document[order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (document[1:] != document[:-1])
        own, document = own[new], document[new]
        start = np.searchsorted(own, key)
        sizes = np.minimum(np.searchsorted(own, key, side="right") - start, least)
        return Counts(names, key // width, key % width, count, sizes, document[_ranges(start, sizes)], groups)

    @staticmethod
    def merged(rows: list[dict], least: int) -> Counts:
        """The counts of several rows, names met once."""
        part = {k: np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in _FIELDS.items()}
        per_row = np.array([len(r["places"]) // 2 for r in rows], np.int64)
        groups = np.stack([part["langs"], part["groups"]], 1)
        base = _before(np.array([len(r["langs"]) // 8 for r in rows], np.int64))
        groups, renamed = np.unique(groups, axis=0, return_inverse=True)
        names = _binary(np.frombuffer(b"".join(r["names"] for r in rows), np.uint8), part["name_sizes"]).dictionary_encode()
        which = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        name = np.repeat(which, part["entries"])
        group = renamed.reshape(-1)[part["places"] + np.repeat(base, per_row)].astype(np.int64)
        sizes = part["document_counts"].astype(np.int64)
        return Counts.added(names.dictionary, name, group, part["counts"], np.repeat(name, sizes), np.repeat(group, sizes),
                            part["documents"], groups, least)

    def terms(self, least: int) -> Counts:
        """The counts of the terms in the names; every name is cut once."""
        data, sizes = _bytes_of(self.names)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        low = data | 32
        letter = (data >= 128) | ((low >= 97) & (low <= 122))
        begin = letter.copy()
        begin[1:] &= ~letter[:-1]
        heads = offsets[:-1][sizes > 0]
        begin[heads] = letter[heads]
        starts = np.flatnonzero(begin)
        solid = np.where(data >= 128, data, low)[letter]
        cuts = np.cumsum(letter)[starts] - 1
        found = _binary(solid, np.diff(np.append(cuts, len(solid)))).dictionary_encode()
        term = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        runs = np.bincount(np.searchsorted(offsets, starts, side="right") - 1, minlength=len(sizes))
        first = _before(runs)
        times = runs[self.name]
        name = term[_ranges(first[self.name], times)]
        of = np.repeat(np.arange(len(self.name)), self.document_counts)
        again = runs[self.name[of]]
        document_name = term[_ranges(first[self.name[of]], again)]
        return Counts.added(found.dictionary, name, np.repeat(self.group, times), np.repeat(self.count, times), document_name,
                            np.repeat(self.group[of], again), np.repeat(self.documents, again), self.groups, least)

    def rows(self, buckets: int):
        """One row for every bucket of names."""
        data, sizes = _bytes_of(self.names)
        bucket = np.fromiter(map(zlib.crc32, self.names.to_pylist()), np.int64, len(self.names)) % buckets
        used = np.bincount(self.name, minlength=len(sizes))
        order = np.argsort(bucket, kind="stable")
        order = order[used[order] > 0]
        bucket, used_first = bucket[order], _before(used)[order]
        data, sizes, used = data[_ranges(_before(sizes)[order], sizes[order])], sizes[order], used[order]
        entry = _ranges(used_first, used)
        group, count, held = self.group[entry], self.count[entry], self.document_counts[entry]
        documents = self.documents[_ranges(_before(self.document_counts)[entry], held)]
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        ends = [np.concatenate([[0], np.cumsum(x)]) for x in (sizes, used, held)]
        out = []
        for a, b in zip(cut, np.append(cut, len(bucket))[1:], strict=False):
            c, d = ends[1][a], ends[1][b]
            places, local = np.unique(group[c:d], return_inverse=True)
            values = {"name_sizes": sizes[a:b], "entries": used[a:b], "places": local, "counts": count[c:d], "document_counts": held[c:d],
                      "documents": documents[ends[2][c]:ends[2][d]], "langs": self.groups[places, 0], "groups": self.groups[places, 1]}
            out.append({"bucket": int(bucket[a]), "names": data[ends[0][a]:ends[0][b]].tobytes()}
                       | {k: v.astype(_FIELDS[k]).tobytes() for k, v in values.items()})
            if len(out) >= 64:
                yield _packed(out)
                out = []
        if out:
            yield _packed(out)


def _packed(rows: list[dict]) -> pa.RecordBatch:
    names = [part.split(" ")[0] for part in _COUNTS.split(", ")]
    kinds = [pa.int32()] + [pa.binary()] * (len(names) - 1)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds, strict=True)], names=names)


def _chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of every chunk, distinct chunks, number of the document of every chunk) of texts cut at ASCII white space."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    start = ~gap
    start[1:] &= gap[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    start[begins] = ~gap[begins]
    starts = np.flatnonzero(start)
    solid = data[~gap]
    cuts = np.append(np.cumsum(~gap)[starts] - 1, len(solid)).astype(np.int64)
    chunks = _binary(solid, np.diff(cuts)).dictionary_encode()
    return (chunks.indices.to_numpy(zero_copy_only=False).astype(np.int64), chunks.dictionary,
            np.searchsorted(offsets, starts, side="right") - 1)


def _chunk_counts(batches, buckets: int, least: int, most: int):
    """Counts of the chunks of every slice."""
    number = TaskContext.get().partitionId() << 38
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        langs, groups = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        for begin, end in slices(offsets, most):
            chunk, distinct, document = _chunks(data[offsets[begin]:offsets[end]], offsets[begin:end + 1] - offsets[begin])
            pairs, member = np.unique(np.stack([langs[begin:end], groups[begin:end]], 1), axis=0, return_inverse=True)
            member, width = member.reshape(-1), end - begin
            code, count = np.unique(chunk * width + document, return_counts=True)
            name, document = code // width, code % width
            yield from Counts.added(distinct, name, member[document], count.astype(np.int64), name, member[document],
                                    document + number, pairs, least).rows(buckets)
            number += width


def _gathered(batches, least: int, most: int = HELD):
    """All counts of a task, merged whenever they pass ``most`` bytes."""
    held, size, limit = [], 0, most
    for batch in batches:
        for row in batch.to_pylist():
            held.append(row)
            size += sum(len(v) for k, v in row.items() if k != "bucket")
            if size > limit:
                held = [r for part in Counts.merged(held, least).rows(1) for r in part.to_pylist()]
                size = sum(len(v) for r in held for k, v in r.items() if k != "bucket")
                limit = max(most, 2 * size)
    return Counts.merged(held, least) if held else None


def _term_rows(batches, buckets: int, least: int):
    counts = _gathered(batches, least)
    if counts is not None:
        yield from counts.terms(least).rows(buckets)


def _kept_rows(batches, least: int):
    """(language, group, term, count, count in the language, 1 on one row of the language and term) of terms in enough documents."""
    counts = _gathered(batches, least)
    if counts is None or not len(counts.name):
        return
    langs, lang = np.unique(counts.groups[:, 0], return_inverse=True)
    lang = lang.reshape(-1)
    own = np.repeat(counts.name * len(langs) + lang[counts.group], counts.document_counts)
    order = np.lexsort((counts.documents, own))
    own, document = own[order], counts.documents[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (document[1:] != document[:-1])
    found, documents = np.unique(own[new], return_counts=True)
    key = counts.name * len(langs) + lang[counts.group]
    at = np.searchsorted(found, key)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, counts.count)
    chosen = np.flatnonzero(documents[at] >= least)
    _, first = np.unique(key[chosen], return_index=True)
    flag = np.zeros(len(chosen), np.int64)
    flag[first] = 1
    terms = counts.names.cast(pa.large_string())
    for a in range(0, len(chosen), 50_000):
        part = chosen[a:a + 50_000]
        pairs = counts.groups[counts.group[part]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), terms.take(pa.array(counts.name[part])).cast(pa.string()), pa.array(counts.count[part]),
             pa.array(total[at[part]]), pa.array(flag[a:a + 50_000])], names=["l", "g", "term", "n", "whole", "one"])


def kept_terms(documents: DataFrame, least: int = LEAST_DOCUMENTS, slice_bytes: int = SLICE) -> DataFrame:
    """Terms in ``least`` documents of their language at least, per group that has them.

    l and g are xxhash64 of the language and of (language, source); n counts in the group, ``whole`` in the
    language; ``one`` is 1 on one row of a language and term and 0 on its others.
    """
    lang, source = text_of("lang"), text_of("source")
    rows = documents.select(text_of().alias("text"), F.xxhash64(lang).alias("l"), F.xxhash64(lang, source).alias("g"))
    # Buckets grow with the input, so what a task holds does not.
    buckets = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * rows.rdd.getNumPartitions())
    chunks = rows.mapInArrow(tidy(functools.partial(_chunk_counts, buckets=buckets, least=least, most=slice_bytes)), _COUNTS)
    terms = chunks.repartition(buckets, "bucket").mapInArrow(tidy(functools.partial(_term_rows, buckets=buckets, least=least)), _COUNTS)
    return terms.repartition(buckets, "bucket").mapInArrow(tidy(functools.partial(_kept_rows, least=least)),
                                                           "l long, g long, term string, n long, whole long, one long")


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)) of columns or numbers, exact; null without terms."""
    wide = "cast({} as decimal(20,0))"
    below = f"cast({wide.format(total)} + 2 * {wide.format(terms)} as decimal(24,0))"
    above = f"cast(cast({SCALE} as decimal(10,0)) * ({wide.format(count)} + 2) as decimal(34,0))"
    return F.expr(f"1 + {above} div nullif({below}, cast(0 as decimal(24,0)))")


def _pair_tile(key, table):
    """(group, other group, shared sum, terms of the tile, value of a term that neither has) for the pairs of a tile."""
    left, right = key[2].as_py(), key[3].as_py()
    heads, rows = table.filter(pc.is_null(table["term"])), table.filter(pc.is_valid(table["term"]))
    names = heads["g"].to_numpy()
    order = np.argsort(names)
    names, blocks = names[order], heads["block"].to_numpy()[order]
    bare = heads["p"].fill_null(0).to_numpy()[order]
    term = rows["term"].combine_chunks().dictionary_encode() if len(rows) else pa.array([], pa.string()).dictionary_encode()
    m = len(term.dictionary)
    shares = np.repeat(bare[:, None], m, axis=1)
    if len(rows):
        shares[np.searchsorted(names, rows["g"].to_numpy()), term.indices.to_numpy(zero_copy_only=False)] = rows["p"].to_numpy()
    others, out = np.flatnonzero(blocks == right), []
    for i in np.flatnonzero(blocks == left):
        facing = others[others > i] if left == right else others
        sums = np.zeros(len(facing), np.int64)
        for begin in range(0, m, 4096):
            p, q = shares[i, begin:begin + 4096], shares[facing, begin:begin + 4096]
            sums += ((p - q) ** 2 // (p + q)).sum(axis=1)
        rest = (bare[i] - bare[facing]) ** 2 // np.maximum(bare[i] + bare[facing], 1)
        out.append((np.full(len(facing), names[i]), names[facing], sums, np.full(len(facing), m), rest))
    columns = [np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 5
    return pa.table(dict(zip(("g", "other", "shared", "terms", "bare"), columns, strict=True)))


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """g, other, value of every ordered pair of groups of a language.

    Every source of a language meets every other in the tile of their two blocks, once for each block of terms; terms
    that no source of a tile has count by their number.
    """
    blocks, parts = (F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int") for n, size in (("lang_sources", TILE_SOURCES), ("lang_terms", TILE_TERMS)))
    block = F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int")
    several = groups.where("lang_sources > 1").withColumns({"blocks": blocks, "parts": parts})
    heads = several.select("l", "g", F.lit(None).cast("string").alias("term"), F.col("bare").alias("p"), block.alias("block"), "blocks",
                           F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    rows = shares.where("lang_sources > 1").withColumns({"blocks": blocks, "parts": parts}).select(
        "l", "g", "term", "p", block.alias("block"), "blocks", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part"))
    dealt = heads.unionByName(rows).withColumn("face", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("l", "part", F.least("block", "face").alias("i"), F.greatest("block", "face").alias("j"), "block", "g", "term", "p")
    tiles = dealt.groupBy("l", "part", "i", "j").applyInArrow(_pair_tile, "g long, other long, shared long, terms long, bare long")
    sums = tiles.groupBy("g", "other").agg(F.sum("shared").alias("shared"), F.sum("terms").alias("terms"), F.max("bare").alias("bare"))
    sums = sums.join(groups.select("g", "lang_terms"), "g")
    sums = sums.select("g", "other", (F.col("shared") + (F.col("lang_terms") - F.col("terms")) * F.col("bare")).alias("value"))
    return sums.unionByName(sums.select(F.col("other").alias("g"), F.col("g").alias("other"), "value"))


def divergence(documents: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, slice_bytes: int = SLICE) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: every other source of the language with the divergence summed over the kept terms. Part ``term``: the
    ``top`` kept terms that the source has and uses more than its language, with their share of the divergence from it.
    """
    kept = working_table(kept_terms(documents, least, slice_bytes))
    lang, source = text_of("lang"), text_of("source")
    groups = working_table(documents.select(lang.alias("lang"), source.alias("source")).distinct()
                           .select("lang", "source", F.xxhash64("lang").alias("l"), F.xxhash64("lang", "source").alias("g")))
    seen = groups.agg(F.count("*"), F.countDistinct("g"), F.countDistinct("lang"), F.countDistinct("l")).first()
    if seen[0] != seen[1] or seen[2] != seen[3]:
        raise ValueError("two languages or two sources have one 64-bit hash")
    langs = groups.groupBy("l").agg(F.count("*").alias("lang_sources")).join(
        kept.groupBy("l").agg(F.sum("one").alias("lang_terms"), F.sum("n").alias("lang_total")), "l", "left")
    langs = working_table(langs.na.fill(0))
    groups = groups.join(kept.groupBy("g").agg(F.sum("n").alias("total"), F.count("*").alias("rows")), "g", "left")
    groups = join_groups(groups.na.fill(0, ["total", "rows"]), langs, ["l"], "lang_sources")
    groups = working_table(groups.withColumn("bare", _share("0", "total", "lang_terms")))
    shares = join_groups(kept, groups.select("g", "total", "rows", "lang_terms", "lang_total", "lang_sources"), ["g"], "rows")
    shares = shares.select("l", "g", "term", "lang_terms", "lang_sources", _share("n", "total", "lang_terms").alias("p"),
                           _share("whole", "lang_total", "lang_terms").alias("q"))
    own = shares.where("p > q").select("g", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    ranked = Window.partitionBy("g").orderBy(F.desc("value"), "item")
    own = own.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    items = groups.select(F.col("g").alias("other"), F.col("source").alias("item"))
    pairs = _pairs(shares, groups).join(items, "other").select("g", "item", "value").withColumn("rank", F.row_number().over(ranked))
    both = pairs.withColumn("part", F.lit("pair")).unionByName(own.withColumn("part", F.lit("term")))
    return both.join(groups.select("g", "lang", "source"), "g").select("lang", "source", "part", "item", "value", "rank")
