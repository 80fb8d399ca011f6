"""Exact top-k inner-product search by Fagin's threshold algorithm.

Vectors are dealt into blocks inside map tasks. Each block has one list per dimension, sorted by value;
a query reads every list from the end its component's sign favours. Each round reads some entries of
all lists, scores in full the vectors met for the first time, and stops when no unseen vector can beat
the kth score: the bound is the sum over dimensions of query component times the value last read.
The kth score is kept over all blocks of a task. The best of each task meet per query.

The query set is stated (ids divisible by a number) and goes to the tasks in blocks of bounded size,
so each task holds one block of queries and one block of vectors.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor
do rows without an id; vectors are compared only with vectors of the same length; a row never finds its own id; ties go to the smaller
id; a query with fewer than k candidates returns all; repeated ids count as one vector each, the rows
that repeat an id and a score are returned as often as they occur within k; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

SCALE = 256
BLOCK = 4096
#: Queries that a task holds at a time.
QUERY_BLOCK = 1024
#: Entries read from every list in the first round; doubles from round to round.
DEPTH = 32


def threshold_search(vectors: np.ndarray, ids: np.ndarray, lists: np.ndarray, query: np.ndarray, own: int,
                     best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """best, (score, -id) in descending order, improved by the vectors of a block; lists: row numbers by value."""
    n, dims = vectors.shape
    used = np.flatnonzero(query)
    seen = np.zeros(n, dtype=bool)
    at, depth = 0, DEPTH
    signs = query[used] > 0
    weights = query[used]
    top = np.array([s for s, _ in best], dtype=np.int64)
    top_ids = np.array([-i for _, i in best], dtype=np.int64)
    while at < n:
        upto = min(n, at + depth)
        # Entries of the used lists, read from the largest value where the component is positive, else from the smallest.
        if len(used):
            rows = np.concatenate([lists[n - upto:n - at, used[signs]].ravel(), lists[at:upto, used[~signs]].ravel()])
        else:
            rows = np.arange(at, upto)
        fresh = np.zeros(n, dtype=bool)
        fresh[rows] = True
        fresh &= ~seen
        seen |= fresh
        new = np.flatnonzero(fresh)
        scores = vectors[new] @ query
        mine = ids[new] != own
        top = np.concatenate([top, scores[mine].astype(np.int64)])
        top_ids = np.concatenate([top_ids, ids[new][mine]])
        if len(top) > k:
            order = np.lexsort((top_ids, -top))[:k]
            top, top_ids = top[order], top_ids[order]
        at, depth = upto, 2 * depth
        if len(top) == k and at < n and len(used):
            last = np.where(signs, lists[n - at, used], lists[at - 1, used])
            bound = int(vectors[last, used] @ weights)
            # An unseen vector can reach the bound at most; on a tie it may still have a smaller id.
            if bound < top.min():
                break
    order = np.lexsort((top_ids, -top))
    return [(int(top[i]), -int(top_ids[i])) for i in order]


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of valid vectors."""
    double = F.transform("embedding", lambda x: x.cast("double"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return (rows.select(F.col("vec_id").cast("long").alias("vec_id"), double.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", fine))
            .select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v")))


def _by_length(ids: list[int], vectors: list[list[int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids, vectors, strict=True):
        pair = out.setdefault(len(v), ([], []))
        pair[0].append(i)
        pair[1].append(v)
    return {n: (np.array(i, dtype=np.int64), np.array(v, dtype=np.int64)) for n, (i, v) in out.items()}


RESULT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()),
                       T.StructField("score", T.LongType())])


def top_k(rows: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE, block: int = BLOCK,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose id is divisible by ``every``."""
    vectors = quantised(rows, scale)
    queries = vectors.where(F.col("vec_id") % every == 0)
    count = queries.count()
    blocks = -(-count // query_block)
    # Queries in blocks of bounded size: each block is one row of packed arrays, cut by a hash of the id.
    packed = (queries.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))).cast("int").alias("part"))
              .agg(F.collect_list(F.struct("vec_id", "v")).alias("queries")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asked = _by_length([q["vec_id"] for q in row["queries"]], [q["v"] for q in row["queries"]])
                given = _by_length([c["vec_id"] for c in row["vectors"]], [c["v"] for c in row["vectors"]])
                found = []
                for n, (query_ids, query_vectors) in asked.items():
                    if n not in given:
                        continue
                    ids, vectors = given[n]
                    exact = float(np.abs(vectors).max()) * float(np.abs(query_vectors).max()) * n < 2.0 ** 53
                    kind = np.float64 if exact else np.int64  # sums below 2^53 are exact in doubles
                    lists = np.argsort(vectors, axis=0, kind="stable")
                    vectors = vectors.astype(kind)
                    for own, query in zip(query_ids.tolist(), query_vectors.astype(kind), strict=True):
                        best = threshold_search(vectors, ids, lists, query, own, [], k)
                        found += [(own, -i, s) for s, i in best]
                columns = list(zip(*found, strict=True)) if found else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=RESULT.names)

    total = rows.count()
    cut = max(1, -(-total // block))
    candidates = (vectors.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(cut)).cast("int").alias("block"))
                  .agg(F.collect_list(F.struct("vec_id", "v")).alias("vectors")))
    # One task for each block of vectors and block of queries.
    tiles = (candidates.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks) - 1))))
             .join(packed, "part").select("vectors", "queries"))
    best = tiles.repartition(max(1, cut * max(1, blocks))).mapInArrow(search, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))
