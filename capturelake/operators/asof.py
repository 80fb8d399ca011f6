"""Exact-time and nearest-in-time joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from capturelake.plans.chunks import CELL_NS, SEQ_CHUNK, SESSION, Running, attach, chunk_of, running
from capturelake.session import cut

REACH_NS = 1 << 33
STAMP = [SESSION, "timestamp_ns"]


def latest_by_timestamp(df: DataFrame) -> DataFrame:
    """One row per (session, timestamp): the last arrival replaces earlier ones.

    Copies collapse in the map-side part of the aggregation.
    """
    rest = [c for c in df.columns if c not in STAMP]
    best = df.groupBy(*STAMP).agg(F.max(F.struct("seq", *[c for c in rest if c != "seq"])).alias("_row"))
    return best.select(*STAMP, *[F.col(f"_row.{c}").alias(c) for c in rest])


def match_metadata(images: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left equi-join on the sensor timestamp, adding a ``meta`` struct (null without a match)."""
    meta = latest_by_timestamp(metadata)
    packed = meta.select(*STAMP, F.struct(*[c for c in meta.columns if c not in STAMP]).alias("meta"))
    return latest_by_timestamp(images).join(packed, STAMP, "left")


def newest_pose(poses: DataFrame) -> DataFrame:
    return poses.groupBy(SESSION).agg(F.max("timestamp_ns").alias("newest_pose_ns"))


def pose_ready(images: DataFrame, poses: DataFrame) -> DataFrame:
    """Adds ``pose_ready``, true once the session's newest pose is not older than the image."""
    joined = attach(images, newest_pose(poses), by=["timestamp_ns"])
    ready = F.coalesce(F.col("newest_pose_ns") >= F.col("timestamp_ns"), F.lit(False))
    return joined.withColumn("pose_ready", ready).drop("newest_pose_ns")


def _closest(refs: list[Column], ts: Column) -> Column:
    """The reference nearest to ts; equal distances go to the earlier arrival."""
    ranked = [F.when(r.isNotNull(), F.struct(F.abs(r["timestamp_ns"] - ts).alias("d"), r["seq"].alias("seq"),
                                             r["timestamp_ns"].alias("timestamp_ns"))) for r in refs]
    return F.array_min(F.array(*ranked))


def _spread(cell: Column, tolerance: int, cell_ns: int, reach: int) -> Column:
    """The groups of ``reach`` cells that a cell's samples can be within the tolerance of."""
    cells = -(-tolerance // cell_ns)
    return F.explode(F.sequence(chunk_of(cell - cells, reach), chunk_of(cell + cells, reach)))


def nearest(images: DataFrame, samples: dict[str, tuple[DataFrame, int]], cell_ns: int = CELL_NS,
            reach_ns: int = REACH_NS) -> DataFrame:
    """Nearest sample of each kind within its tolerance; images are unique per timestamp.

    ``samples`` maps a name to (table, tolerance). Adds ``<name>_timestamp_ns`` and
    ``<name>_seq``. No pairs are formed; every image keeps the last sample before it and the
    first after it, found at two scales so that no group grows with the data:

    * within a cell of about a millisecond all its samples count (after reduction to one per
      timestamp, the earliest arrival, a cell cannot hold more rows than nanoseconds);
    * from other cells only their first and last samples can be nearest, so those are
      ordered in groups of some seconds, i.e. a few thousand cells. Cells near a group's
      edge are seen by the neighbouring group as well.
    """
    # A group is wider than twice each tolerance, so that a sample is seen by two groups at most.
    reach = max(reach_ns, *[2 * (tolerance + cell_ns) + 1 for _, tolerance in samples.values()]) // cell_ns + 1
    cell = chunk_of("timestamp_ns", cell_ns).alias("_cell")
    inside = images.select(SESSION, cell, "timestamp_ns", F.lit(1).alias("_kind"),
                           F.struct(*images.columns).alias("_image"))
    asking = images.select(SESSION, cell).distinct()
    around = asking.select(SESSION, "_cell", F.lit(0).alias("_kind"), chunk_of("_cell", reach).alias("_group"))
    for name, (table, tolerance) in samples.items():
        one = table.groupBy(*STAMP).agg(F.min("seq").alias("seq")).select(SESSION, cell, "timestamp_ns", "seq")
        ref = F.struct("timestamp_ns", "seq")
        inside = inside.unionByName(
            one.select(SESSION, "_cell", "timestamp_ns", F.lit(0).alias("_kind"), ref.alias(f"_{name}")),
            allowMissingColumns=True)
        ends = one.groupBy(SESSION, "_cell").agg(
            F.min("timestamp_ns").alias("_t0"), F.min_by("seq", "timestamp_ns").alias("_s0"),
            F.max("timestamp_ns").alias("_t1"), F.max_by("seq", "timestamp_ns").alias("_s1"))
        around = around.unionByName(ends.select(
            SESSION, "_cell", F.lit(1).alias("_kind"), _spread(F.col("_cell"), tolerance, cell_ns, reach).alias("_group"),
            F.struct(F.col("_t0").alias("timestamp_ns"), F.col("_s0").alias("seq")).alias(f"_first_{name}"),
            F.struct(F.col("_t1").alias("timestamp_ns"), F.col("_s1").alias("seq")).alias(f"_last_{name}")),
            allowMissingColumns=True)

    def seen(column: str, group: Window, *order: Column) -> Column:
        window = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return F.last(column, ignorenulls=True).over(window)

    # A cell asks before its own samples come, from either side; within a cell they come first.
    group, one_cell = Window.partitionBy(SESSION, "_group"), Window.partitionBy(SESSION, "_cell")
    outer = around.select("*", *[seen(f"_last_{n}", group, F.asc("_cell"), F.asc("_kind")).alias(f"_b_{n}") for n in samples])
    outer = outer.select("*", *[seen(f"_first_{n}", group, F.desc("_cell"), F.asc("_kind")).alias(f"_a_{n}") for n in samples])
    outer = outer.where(F.col("_kind") == 0).select(SESSION, "_cell", *[f"_{p}_{n}" for n in samples for p in "ab"])
    inner = inside.select("*", *[
        seen(f"_{n}", one_cell, F.asc("timestamp_ns"), F.asc("_kind")).alias(f"_i_{n}") for n in samples])
    inner = inner.select("*", *[
        seen(f"_{n}", one_cell, F.desc("timestamp_ns"), F.asc("_kind")).alias(f"_j_{n}") for n in samples])
    inner = inner.where(F.col("_kind") == 1).select(SESSION, "_cell", "_image", *[f"_{p}_{n}" for n in samples for p in "ij"])
    found = inner.join(outer, [SESSION, "_cell"], "left").select("_image.*", *[
        _closest([F.col(f"_{p}_{n}") for p in "ijab"], F.col("_image.timestamp_ns")).alias(f"_{n}") for n in samples])
    out = {}
    for name, (_, tolerance) in samples.items():
        hit = F.col(f"_{name}.d") <= tolerance
        out[f"{name}_timestamp_ns"] = F.when(hit, F.col(f"_{name}.timestamp_ns"))
        out[f"{name}_seq"] = F.when(hit, F.col(f"_{name}.seq"))
    return found.withColumns(out).drop(*[f"_{n}" for n in samples])


def nearest_pose(images: DataFrame, poses: DataFrame, tolerance_ns: int, cell_ns: int = CELL_NS,
                 reach_ns: int = REACH_NS) -> DataFrame:
    """D3 (poses C1-filtered by the caller); a later copy of an image replaces the earlier one."""
    return nearest(latest_by_timestamp(images), {"pose": (poses, tolerance_ns)}, cell_ns, reach_ns)


def finalize_seq(images: DataFrame, poses: DataFrame, cell_ns: int = CELL_NS, first_pose: str | None = None) -> DataFrame:
    """Adds ``finalize_seq``: the arrival at which image, metadata and a late enough pose are all there.

    With ``first_pose`` the arrival of the first late enough pose stays as a column of that name.

    Images carry ``meta`` (see ``match_metadata``); null while any of the three is missing.
    The first arrival among poses not older than the image is a running minimum from the
    session's end.
    """
    marks = poses.groupBy(*STAMP).agg(F.min("seq").alias("_pose_seq")).withColumn("_kind", F.lit(1))
    rows = images.select(*STAMP, F.lit(0).alias("_kind"), F.struct(*images.columns).alias("_image"))
    scan = running(rows.unionByName(marks, allowMissingColumns=True),
                   [Running("_first_pose", "min", F.col("_pose_seq"))],
                   order=("timestamp_ns", "_kind"), width=cell_ns, reverse=True)
    done = F.when(F.col("meta").isNotNull() & F.col("_first_pose").isNotNull(),
                  F.greatest("seq", "meta.seq", "_first_pose"))
    found = scan.where(F.col("_kind") == 0).select("_image.*", "_first_pose").withColumn("finalize_seq", done)
    return found.withColumnRenamed("_first_pose", first_pose) if first_pose else found.drop("_first_pose")


def arrivals_before(rows: DataFrame, samples: dict[str, DataFrame], width: int = SEQ_CHUNK) -> DataFrame:
    """Adds ``<name>_rank`` per kind: how many samples had arrived at the row's ``at_seq`` (0 where null).

    Each arrival that is asked for is ranked once, so a chunk holds two rows per arrival at most;
    the ranks then go to the rows, many of which may share an arrival or wait for one.
    """
    asks = rows.where("at_seq IS NOT NULL").select(SESSION, F.col("at_seq").alias("seq"), F.lit(1).alias("_kind")).distinct()
    for name, table in samples.items():
        asks = asks.unionByName(table.select(SESSION, "seq", F.lit(0).alias("_kind"), F.lit(name).alias("_name")),
                                allowMissingColumns=True)
    counts = [Running(f"{n}_rank", "sum", F.when(F.col("_name") == n, 1).otherwise(0)) for n in samples]
    ranked = running(asks, counts, order=("seq", "_kind"), width=width).where(F.col("_kind") == 1).select(
        SESSION, F.col("seq").alias("at_seq"), *[f"{n}_rank" for n in samples])
    found = attach(rows, ranked, by=["seq"], keys=(SESSION, "at_seq"))
    return found.withColumns({f"{n}_rank": F.coalesce(f"{n}_rank", F.lit(0)) for n in samples})


def blocks_of(samples: DataFrame, n: int, width: int = SEQ_CHUNK) -> DataFrame:
    """Samples numbered in arrival order, as arrays of the n samples of each block."""
    numbered = running(samples.select(SESSION, "seq", "timestamp_ns"), [Running("rank", "sum", F.lit(1))], width=width)
    return (numbered.withColumn("_block", chunk_of(F.col("rank") - 1, n)).groupBy(SESSION, "_block")
            .agg(F.collect_list(F.struct("rank", "seq", "timestamp_ns")).alias("_held")))


def _closest_held(blocks: list[str], rank: Column, n: int) -> Column:
    """The nearest sample of the blocks among the n that end at ``rank``."""
    ts = F.col("timestamp_ns")
    held = F.flatten(F.array_compact(F.array(*[F.col(b) for b in blocks])))
    inside = F.filter(held, lambda s: (s["rank"] <= rank) & (s["rank"] > rank - n))
    return F.array_min(F.transform(inside, lambda s: F.struct(
        F.abs(s["timestamp_ns"] - ts).alias("d"), s["seq"].alias("seq"), s["timestamp_ns"].alias("timestamp_ns"))))


def nearest_retained(images: DataFrame, samples: dict[str, tuple[DataFrame, int, int]],
                     width: int = SEQ_CHUNK) -> DataFrame:
    """D4 causal / D5: nearest among the newest n arrivals at the image's ``finalize_seq``, per kind.

    ``samples`` maps a name to (table, tolerance, n). Samples are stored in blocks of n in
    arrival order, so every image reads exactly the two blocks that cover its history; no
    block exceeds n samples.
    """
    # One row per image, written once: the look-ups of each block below read it twice.
    rows = cut(arrivals_before(images.withColumn("at_seq", F.col("finalize_seq")),
                               {k: v[0] for k, v in samples.items()}, width).drop("at_seq"))
    for name, (table, tolerance, n) in samples.items():
        held, rank = blocks_of(table, n, width), F.col(f"{name}_rank")
        top = chunk_of(rank - 1, n)
        sides = {"_newer": top, "_older": top - 1}
        for side, block in sides.items():
            # Many images may ask for one block: they are spread over salts. Without arrivals there is none to ask for.
            rows = attach(rows.withColumn("_block", F.when(rank > 0, block)), held.withColumnRenamed("_held", side),
                          by=["seq"], keys=(SESSION, "_block")).drop("_block")
        hit = F.col("_best.d") <= tolerance
        rows = rows.withColumn("_best", _closest_held(list(sides), rank, n)).withColumns({
            f"{name}_timestamp_ns": F.when(hit, F.col("_best.timestamp_ns")),
            f"{name}_seq": F.when(hit, F.col("_best.seq"))}).drop("_best", f"{name}_rank", *sides)
    return rows


def retained(samples: DataFrame, at: DataFrame, n: int, width: int = SEQ_CHUNK) -> DataFrame:
    """For each row of ``at`` (session, seq) the arrival range held then: first and last rank and count."""
    ranked = arrivals_before(at.select(SESSION, "seq", F.col("seq").alias("at_seq")), {"last": samples}, width)
    first = F.greatest(F.lit(1), F.col("last_rank") - n + 1)
    return ranked.select(SESSION, "seq", first.alias("first_rank"), "last_rank",
                         (F.col("last_rank") - first + 1).alias("held"))
