"""Exact deduplication by deterministic block naming, with DataFrame functions only.

Each text is cut into blocks of a fixed size. Equal blocks get one integer name: the distinct blocks
are sorted and numbered. Adjacent names are then paired and the distinct pairs named in the same way,
level by level, until every document has one name. A name stands for exactly one sequence of blocks,
so the pair (level, name) is an identity without collisions.

Only the first level moves text, and only the distinct blocks of each map task. Names come back to the
rows by hash and length of the block; where two different blocks share both, these blocks are named
among themselves and joined by content.

Defined results: null text is empty text; rows that repeat a doc_id with the same text are one
document; rows with one doc_id and different texts are different documents; a null doc_id is smaller
than any other and stays only if its group has no other; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import ascii_lower, join_groups, renamed, text_of, working_table

BLOCK = 4096
KEY = ["doc_id", "text_sha256"]


def _numbered(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Distinct rows with an integer each: sorted within their partition, numbered across partitions."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _first_names(blocks: DataFrame) -> DataFrame:
    """(key, pos, n, name): the name of every block."""
    blocks = blocks.withColumns({"h": F.xxhash64("content"), "size": F.length("content")})
    # Two passes over the text: one moves the distinct contents, one keeps only what stands for them.
    names = working_table(_numbered(blocks.select("h", "size", "content").distinct(), ["content"])
                          .select("h", "size", "name"))
    cells = working_table(blocks.select(*KEY, "pos", "n", "h", "size"))
    by_hash = names.groupBy("h", "size").agg(F.min("name").alias("name"), F.count("*").alias("shared"))
    clashes = by_hash.where("shared > 1").select("h", "size")
    used = cells.groupBy("h", "size").agg(F.count("*").alias("uses"))
    plain = by_hash.where("shared = 1").drop("shared").join(used, ["h", "size"])
    named = join_groups(cells, plain, ["h", "size"], "uses").select(*KEY, "pos", "n", "name")
    if clashes.limit(1).count():
        among = blocks.join(clashes, ["h", "size"], "left_semi")
        again = working_table(_numbered(among.select("content").distinct(), ["content"]))
        named = named.unionByName(among.join(again, "content").select(
            *KEY, "pos", "n", (-1 - F.col("name")).alias("name")))
    return named


def block_names(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_sha256, level, name) per document; equal (level, name) means equal normalised text."""
    text = docs.select("doc_id", ascii_lower(text_of()).alias("text"))
    parts = F.when(F.length("text") <= block, F.array("text")).otherwise(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    blocks = (text.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
                          parts.alias("parts"))
              .select(*KEY, F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "content")))
    cells = working_table(_first_names(blocks))
    done, level = cells.where("n = 1").select(*KEY, F.lit(0).alias("level"), "name").distinct(), 0
    longest = cells.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        left = F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left")
        right = F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right")
        pairs = (cells.where("n > 1").groupBy(*KEY, F.col("n"), F.shiftright("pos", 1).alias("q")).agg(left, right)
                 .select(*KEY, F.ceil(F.col("n") / 2).cast("int").alias("n"), F.col("q").alias("pos"), "left",
                         F.struct(F.col("right").isNull().alias("last"), F.coalesce("right", F.lit(0)).alias("id"))
                         .alias("right")))
        uses = pairs.groupBy("left", "right").agg(F.count("*").alias("uses"))
        names = working_table(_numbered(uses, ["left", "right"]))
        cells = working_table(join_groups(pairs, names, ["left", "right"], "uses").select(*KEY, "pos", "n", "name"))
        done = done.unionByName(cells.where("n = 1").select(*KEY, F.lit(level).alias("level"), "name"))
    return done


def exact_dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per document; the largest doc_id of equal texts stays."""
    names = working_table(block_names(docs, block))
    groups = names.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return join_groups(names, groups, ["level", "name"], "group_size").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names; a repeated row stays once."""
    kept = exact_dedup(docs, block).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("kept_sha"))
    rows, at = renamed(docs)
    rows = rows.withColumn("sha", F.sha2(ascii_lower(text_of(at["text"])).cast("binary"), 256))
    found = rows.join(kept, F.col(at["doc_id"]).eqNullSafe(F.col("id")) & (F.col("sha") == F.col("kept_sha")), "left_semi")
    return found.dropDuplicates([at["doc_id"], "sha"]).select(*at.values()).toDF(*docs.columns)
