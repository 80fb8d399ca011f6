"""Jaccard join of documents on word shingles by T-occurrence search with DivideSkip.

A document is its set of distinct SHINGLE-word shingles (as 64-bit hashes). Equal sets are one class. Two
documents link when 100 * intersection >= 80 * union.

1. Of every set only the shingles that come first by hash are dealt out, as many as a linked pair must
   share by the prefix principle (40 % of them); those that another set has too are counted. A set of
   which too few are shared has no partner.
2. Of the shared ones, ordered from rare to frequent, a pair shares one of the first few; sets that do
   are a family (connected components over the shingles).
3. A family is cut into blocks of BLOCK sets. In each block an inverted index is searched with every
   set as query: DivideSkip merges the short inverted lists with a heap, keeps the ids that occur often
   enough to reach the threshold, and probes the long lists for these by binary search. Some sets of the
   family are in every block: sets known to be connected through them need not be compared, and
   only sets outside the largest connected part are sought in other blocks. Of these, a set that holds
   too few shingles that any other set of the family has is linked with none; the others go to the
   blocks that hold one of the rarest of these shingles, of which a linked pair must share one. They
   pass by the index of a block in chunks of QUERIES blocks' size. No link that joins two parts is
   missed, and no pairs are listed within a group of copies.

Defined results: null text or no words: the empty set, linked with nothing; fewer words than a
shingle: the whole sequence is one; rows that repeat a doc_id are one class with it if their text is
equal; a null doc_id takes part and is never the least id unless its component has no other; other columns
are ignored; an empty table gives an empty result. Sets are told apart by a 64-bit hash.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import join_groups, renamed, slices, text_of, tidy, utf8, working_table
from capturelake.llm.components import components
from capturelake.llm.words import mixed, shingle_hashes, word_hashes

SHINGLE = 5
SLICE = 1 << 22
#: A block has about BLOCK sets and SHINGLES shingles at most (or one larger set).
BLOCK, SHINGLES, PIVOTS = 512, 1 << 18, 8
#: A chunk of queries has about this many times the sets and shingles of a block at most.
QUERIES = 16
#: Document frequencies count up to here; more frequent shingles tie.
FREQUENT = 1 << 16
#: Weight of a binary probe against a step of the heap, in DivideSkip's rule for the number of long lists.
PROBE = 0.0085


def least_overlap(n):
    """Shingles that a set of n shares with every partner: 100 * i >= 80 * u >= 80 * n."""
    return (4 * n + 4) // 5


def extra(n):
    return np.maximum(1, n // 5)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    words, _, before = word_hashes(data, offsets, lower=True)
    hashes = shingle_hashes(words, k)
    out = []
    for a, b in zip(before.tolist(), before[1:].tolist(), strict=False):
        if b - a >= k:
            found = np.sort(hashes[a:b - k + 1])
            keep = np.ones(len(found), dtype=bool)
            keep[1:] = found[1:] != found[:-1]
            out.append(found[keep])
        else:
            # The number of words keeps a short sequence apart from shingles.
            out.append(mixed(shingle_hashes(words[a:b], b - a) + np.uint64(b - a)) if b > a else words[:0])
    return out


def set_key(found: np.ndarray) -> int:
    return int(np.int64(mixed(mixed(found ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True) + np.uint64(len(found))).view(np.int64)[0]))


def _sets(batches: Iterator[pa.RecordBatch], k: int):
    """(row of the batch, batch, set) of every document."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
        for low, high in slices(offsets, SLICE):
            yield batch.slice(low, high - low), shingle_sets(
                data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], k)


def described(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, key) per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, k):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_key(s) for s in sets], pa.int64())], names=["doc_id", "n", "key"])

    return docs.mapInArrow(tidy(run), "doc_id long, n long, key long")


def shared_prefixes(docs: DataFrame, k: int) -> DataFrame:
    """(key, n, h, df): shingles of a set's prefix that other sets' prefixes hold too."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, k):
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            length = np.where(sizes > 0, sizes - least_overlap(sizes) + extra(sizes), 0)
            keys = np.array([set_key(s) for s in sets], dtype=np.int64)
            heads = [s[:n] for s, n in zip(sets, length.tolist(), strict=True)]
            h = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(np.repeat(keys, length)), pa.array(np.repeat(sizes, length))],
                names=["h", "key", "n"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (h, key); a shingle's rows are held until all are seen or FREQUENT are."""
        held = [np.zeros(0, np.int64)] * 3
        many = None  # a shingle known to be frequent: (h, last key given out)

        def out(rows: list[np.ndarray], df: np.ndarray) -> pa.RecordBatch:
            h, key, n = rows
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, n, h, df)], names=["key", "n", "h", "df"])

        def settle(rows: list[np.ndarray], final: bool) -> tuple[list[pa.RecordBatch], list[np.ndarray]]:
            nonlocal many
            given = []
            h, key, _ = rows
            if not len(h):
                return given, rows
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1])
            if many is not None:
                new &= (h != many[0]) | (key != many[1])
            rows = [x[new] for x in rows]
            h = rows[0]
            if many is not None and len(h):
                more = int(np.searchsorted(h != many[0], True))  # rows of the frequent shingle come first
                if more:
                    head = [x[:more] for x in rows]
                    given.append(out(head, np.full(more, FREQUENT)))
                    many = (many[0], int(head[1][-1]))
                    rows = [x[more:] for x in rows]
                if len(rows[0]):
                    many = None
                h = rows[0]
            if not len(h):
                return given, rows
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            count = np.diff(np.append(first, len(h)))
            end = len(h) if final else int(first[-1])
            df = np.repeat(count, count)
            if not final and count[-1] >= FREQUENT:
                end = len(h)
                many = (int(h[-1]), int(rows[1][-1]))
            df = np.minimum(df, FREQUENT)
            keep = df[:end] > 1
            given.append(out([x[:end][keep] for x in rows], df[:end][keep]))
            return given, [x[end:] for x in rows]

        for batch in batches:
            fresh = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            given, held = settle([np.concatenate(x) for x in zip(held, fresh, strict=True)], False)
            yield from given
        given, _ = settle(held, True)
        yield from given

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.mapInArrow(tidy(prefixes), "h long, key long, n long")
    return (rows.repartition(parts, "h").sortWithinPartitions("h", "key")
            .mapInArrow(tidy(shared), "key long, n long, h long, df long"))


def families(docs: DataFrame, k: int) -> DataFrame:
    """(id, root): sets that may link, by key, with the family they are in."""
    rows = shared_prefixes(docs, k)
    n = F.col("n")
    partner = F.floor((4 * n + 4) / 5)
    must = F.greatest(F.lit(1), F.floor(partner / 5)).cast("int")
    ordered = (rows.groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("shared"))
               .where(F.size("shared") >= must)
               .select("key", F.explode(F.slice("shared", F.lit(1), F.size("shared") - must + 1)).alias("s")))
    firsts = working_table(ordered.select("key", F.col("s.h").alias("h")))
    least = firsts.groupBy("h").agg(F.min("key").alias("root"), F.count("*").alias("uses")).where("uses > 1")
    edges = join_groups(firsts, least, ["h"], "uses").select(F.col("key").alias("a"), F.col("root").alias("b"))
    return components(edges)


class Index:
    """Inverted lists of sets; ids are given out in order, so every list is sorted."""

    def __init__(self):
        self.lists: dict[int, list[int]] = {}
        self.sizes: list[int] = []

    def add(self, shingles: list[int]) -> int:
        number = len(self.sizes)
        self.sizes.append(len(shingles))
        lists = self.lists
        for s in shingles:
            held = lists.get(s)
            if held is None:
                lists[s] = [number]
            else:
                held.append(number)
        return number

    def search(self, shingles: list[int]) -> list[int]:
        """Ids of the sets that link with the query: T-occurrence search with DivideSkip."""
        get, n = self.lists.get, len(shingles)
        lists = [x for x in map(get, shingles) if x is not None]
        least = least_overlap(n)
        if len(lists) < least:
            return []
        lists.sort(key=len)
        longest = len(lists[-1])
        skip = min(least - 1, int(least / (PROBE * math.log2(longest + 1) + 1)))
        short, long = lists[:len(lists) - skip], lists[len(lists) - skip:]
        found, at, count = [], -1, 0
        need = least - skip

        def check(candidate: int, count: int) -> None:
            size = self.sizes[candidate]
            if 5 * min(size, n) < 4 * max(size, n):
                return
            # 100 * i >= 80 * (n + size - i)
            target = -(-4 * (n + size) // 9)
            left = len(long)
            for entries in long:
                if count + left < target or count >= target:
                    break
                left -= 1
                i = bisect_left(entries, candidate)
                count += i < len(entries) and entries[i] == candidate
            if count >= target:
                found.append(candidate)

        for candidate in heapq.merge(*short):
            if candidate == at:
                count += 1
                continue
            if count >= need:
                check(at, count)
            at, count = candidate, 1
        if count >= need:
            check(at, count)
        return found


class Parts:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def links(a: np.ndarray, b: np.ndarray) -> bool:
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= 80 * (len(a) + len(b) - shared)


def block_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what is connected among the sets of a block; the first sets serve as pivots.

    Sets outside the part of the pivots are in an index of their own. A set that links with a pivot is
    sought among those only; any other set also among the ones in the pivots' part.
    """
    parts, out = Parts(len(sets)), []
    inside, outside = (Index(), []), (Index(), [])
    asked = [None] * len(sets)
    pivots: list[int] = []

    def link(i: int, j: int) -> None:
        if parts.join(i, j):
            out.append((i, j))

    def place(i: int, where: tuple) -> None:
        where[0].add(asked[i])
        where[1].append(i)

    for i, mine in enumerate(sets):
        asked[i] = mine.tolist()
        if not pivots:
            pivots.append(i)
            place(i, inside)
            continue
        home = parts.root(pivots[0])
        hit = next((p for p in pivots if links(mine, sets[p])), None)
        if hit is not None:
            link(i, hit)
        found = [outside[1][j] for j in outside[0].search(asked[i])]
        if hit is None:
            found += [inside[1][j] for j in inside[0].search(asked[i])]
        for j in found:
            link(i, j)
        home = parts.root(pivots[0])
        if parts.root(i) == home:
            place(i, inside)
            if hit is None and len(pivots) < PIVOTS:
                pivots.append(i)
            moved = [j for j in outside[1] if parts.root(j) == home]
            if moved:
                rest = [j for j in outside[1] if parts.root(j) != home]
                for j in moved:
                    place(j, inside)
                outside = (Index(), [])
                for j in rest:
                    place(j, outside)
        else:
            place(i, outside)
    return out


LINK = "a long, b long"


def by_block(rows: DataFrame, flag: str, work) -> DataFrame:
    """(a, b) that ``work`` finds in each block, given as rows (key, flag, shingles); a block is bounded by BLOCK."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def given(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            family, block, keys, flags = (batch.column(i).to_pylist() for i in range(4))
            lists = batch.column(4)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            pairs = []
            for i, mine in enumerate(zip(family, block, strict=True)):
                if mine != key:
                    pairs += work(held) if len(held) > 1 else []
                    key, held = mine, []
                held.append((keys[i], flags[i], values[ends[i]:ends[i + 1]].copy()))
            yield given(pairs)
        if len(held) > 1:
            yield given(work(held))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.select("family", "block", "key", flag, "shingles").repartition(parts, "family", "block")
            .sortWithinPartitions("family", "block", "key").mapInArrow(tidy(run), LINK))


def by_query(rows: DataFrame) -> DataFrame:
    """(a, b): links of queries with the sets of a block, given as rows (family, block, chunk, query, key, shingles).

    The sets of the block come first and are held as an index; the queries pass by it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, index, held = None, Index(), []
        for batch in batches:
            family, block, chunk, query, keys = (batch.column(i).to_pylist() for i in range(5))
            lists = batch.column(5)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            pairs = []
            for i, mine in enumerate(zip(family, block, chunk, strict=True)):
                if mine != group:
                    group, index, held = mine, Index(), []
                shingles = values[ends[i]:ends[i + 1]].tolist()
                if query[i]:
                    pairs += [(held[j], keys[i]) for j in index.search(shingles) if held[j] != keys[i]]
                else:
                    index.add(shingles)
                    held.append(keys[i])
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.select("family", "block", "chunk", "query", "key", "shingles").repartition(parts, "family", "block", "chunk")
            .sortWithinPartitions("family", "block", "chunk", "query", "key").mapInArrow(tidy(run), LINK))


def query_blocks(large: DataFrame, rest: DataFrame) -> DataFrame:
    """(family, key, n, block): blocks that may hold partners of the sets ``rest`` (family, key, blocks)."""
    wide = large.select("family", "key", "block", F.explode("shingles").alias("h"))
    common = wide.groupBy("family", "h").agg(F.count("*").alias("uses")).where("uses > 1")
    least = large.groupBy("family").agg(F.min(F.size("shingles")).alias("least"))
    asked = wide.join(rest.select("family", "key"), ["family", "key"], "left_semi").select("family", "key", "h")
    # 100 * i >= 80 * (n + m - i) with a partner of m shingles, at least 80 % of n and the least of the family.
    sizes = (large.select("family", "key", F.size("shingles").cast("long").alias("n"))
             .join(rest, ["family", "key"]).join(F.broadcast(least), "family")
             .withColumn("m", F.greatest(F.expr("(4 * n + 4) div 5"), F.col("least").cast("long")))
             .select("family", "key", "n", "blocks", F.expr("(4 * (n + m) + 8) div 9").alias("need")))
    found = (join_groups(asked, common, ["family", "h"], "uses").groupBy("family", "key")
             .agg(F.sort_array(F.collect_list(F.struct("uses", "h"))).alias("shared")).join(sizes, ["family", "key"])
             .where(F.size("shared") >= F.col("need")))
    # A partner holds ``need`` of the shared shingles, so one of the rarest of them.
    probes = working_table(found.select("family", "key", "n", "blocks", F.explode(F.slice(
        "shared", F.lit(1), (F.size("shared") - F.col("need") + 1).cast("int"))).alias("s"))
        .select("family", "key", "n", "blocks", F.col("s.h").alias("h")))
    places = (wide.join(probes.select("family", "h").distinct(), ["family", "h"], "left_semi")
              .groupBy("family", "h").agg(F.collect_set("block").alias("at")))
    uses = probes.groupBy("family", "h").agg(F.count("*").alias("uses"))
    places = working_table(places.join(uses, ["family", "h"]))
    query = ["family", "key", "n", "blocks"]
    many = F.size("at").alias("many")
    # Where the lists name as many blocks as there are, every block is asked.
    total = working_table(join_groups(probes, places.select("family", "h", many, "uses"), ["family", "h"], "uses")
                          .groupBy(*query).agg(F.sum("many").alias("total")))
    every = total.where("total >= blocks").select("family", "key", "n", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    few = probes.join(total.where("total < blocks").select("family", "key"), ["family", "key"], "left_semi")
    some = (join_groups(few, places, ["family", "h"], "uses").select("family", "key", "n", F.explode("at").alias("block")).distinct())
    return every.unionByName(some)


def family_links(members: DataFrame) -> DataFrame:
    """(a, b): links by key that connect what is connected; members: (family, size, weight, key, shingles), a working table.

    size and weight: the sets of the family and the shingles of all of them.
    """
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / SHINGLES)).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    large = members.where("blocks > 1")
    # The same few sets go to every block of a large family.
    lead = (large.groupBy("family", "blocks").agg(F.slice(F.sort_array(F.collect_set(
        F.when(F.pmod(F.xxhash64("key", F.lit(1)), F.col("size")) < 4 * PIVOTS, F.col("key")))), 1, PIVOTS).alias("lead"))
        .select("family", "blocks", F.explode("lead").alias("key")))
    leads = (large.join(lead.select("family", "key"), ["family", "key"])
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    columns = ["family", "block", "key", "shingles", "lead"]
    rows = members.withColumn("lead", F.lit(False)).select(columns).unionByName(
        leads.withColumn("lead", F.lit(True)).select(columns))

    def inner(rows: list[tuple]) -> list[tuple[int, int]]:
        chosen = {key: shingles for key, _, shingles in sorted(rows, key=lambda r: (not r[1], r[0]))}
        keys = list(chosen)
        return [(keys[i], keys[j]) for i, j in block_links(list(chosen.values()))]

    near = working_table(by_block(rows, "lead", inner))
    if not large.limit(1).count():
        return near
    # Of each large family, the sets outside its largest connected part are sought in every block.
    known = components(near)
    placed = large.select("family", "key", "blocks").join(known.withColumnRenamed("id", "key"), "key", "left").select(
        "family", "key", "blocks", F.coalesce("root", "key").alias("root"))
    counted = placed.groupBy("family", "root").agg(F.count("*").alias("uses"))
    main = counted.groupBy("family").agg(F.max_by("root", F.struct("uses", "root")).alias("main"))
    rest = working_table(placed.join(main, "family").where("root <> main").select("family", "key", "blocks"))
    sought = large.join(rest.select("family").distinct(), "family", "left_semi")
    asked = working_table(query_blocks(sought, rest))
    chunks = asked.groupBy("family", "block").agg(F.greatest(
        F.ceil(F.count("*") / (QUERIES * BLOCK)), F.ceil(F.sum("n") / (QUERIES * SHINGLES))).cast("int").alias("chunks"))
    columns = ["family", "block", "chunk", "query", "key", "shingles"]
    queries = (asked.join(chunks, ["family", "block"])
               .withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(2)), F.col("chunks")).cast("int"))
               .join(sought.select("family", "key", "shingles"), ["family", "key"]).withColumn("query", F.lit(True)))
    held = (sought.join(chunks, ["family", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .withColumn("query", F.lit(False)))
    return near.unionByName(by_query(held.select(columns).unionByName(queries.select(columns))))


def link_classes(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document: the least doc_id reachable by links."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    base = working_table(described(docs, k))
    classes = base.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"),
                                                     F.count("*").alias("uses"))
    family = working_table(families(docs, k))
    sets = working_table(family.withColumnRenamed("id", "key").join(classes, "key").select("key", "root", "n", "least"))
    sizes = sets.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    wanted = join_groups(sets, sizes, ["root"], "size").select(
        "key", F.col("root").alias("family"), "size", "weight", F.col("least").alias("_rep"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, k):
            keys = part.column(1).to_pylist()
            keep = [i for i, (s, key) in enumerate(zip(sets, keys, strict=True)) if len(s) and set_key(s) == key]
            rows = part.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column(2), rows.column(3), rows.column(4), rows.column(1),
                 pa.array([sets[i].view(np.int64) for i in keep], pa.list_(pa.int64()))],
                names=["family", "size", "weight", "key", "shingles"])

    members = working_table(
        docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_rep"))).select("text", "key", "family", "size", "weight")
        .mapInArrow(tidy(fetch), "family long, size long, weight long, key long, shingles array<long>"))
    roots = working_table(components(family_links(members)))
    of_root = roots.join(classes.withColumnRenamed("key", "id"), "id").groupBy("root").agg(F.min("least").alias("component"))
    of_class = (classes.join(roots.withColumnRenamed("id", "key"), "key", "left").join(of_root, "root", "left")
                .select("key", F.coalesce("component", "least").alias("component"), "uses"))
    linked = join_groups(base.where("n > 0"), of_class, ["key"], "uses").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return linked.unionByName(base.where("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """The documents of least id of each group, with all their columns, whatever their names; a repeated row stays once."""
    kept = link_classes(docs, k).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("id")).distinct()
    rows, at = renamed(docs)
    found = rows.withColumn("hash", F.xxhash64(at["text"])).join(kept, F.col(at["doc_id"]).eqNullSafe(F.col("id")), "left_semi")
    return found.dropDuplicates([at["doc_id"], "hash"]).select(*at.values()).toDF(*docs.columns)
