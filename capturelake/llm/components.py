"""Connected components of a graph of long ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import join_groups, working_table


def _star(edges: DataFrame, column: str) -> DataFrame:
    """Every neighbour v of u is linked to the least of u and its neighbours; edges: (u, v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("_least"), F.count("*").alias("uses"))
    return (join_groups(edges, least, ["u"], "uses")
            .select("u", "v", F.least("u", "_least").alias("m")))


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[:]


def components(edges: DataFrame) -> DataFrame:
    """(id, root): every id that occurs in edges (a, b), and the least id reachable from it.

    Neighbourhoods are never gathered: each step is a minimum per id, joined back without dealing the
    rows of a hot id to one task. The number of steps is about the logarithm of the longest path.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = working_table(edges)
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = working_table(_star(both, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                              .distinct())
        # After the large-star step every edge points to a smaller id.
        stars = _star(large, "u")
        small = stars.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            stars.select("u", F.col("m").alias("v"))).distinct()
        edges = working_table(small)
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
