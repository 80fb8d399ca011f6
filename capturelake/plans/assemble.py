"""Photo + metadata + pose + depth alignment."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from capturelake.operators.asof import (REACH_NS, STAMP, finalize_seq, latest_by_timestamp, match_metadata, nearest,
                                        nearest_retained, pose_ready)
from capturelake.operators.gates import is_still_sharp
from capturelake.operators.motion import last_n
from capturelake.plans.chunks import CELL_NS, SEQ_CHUNK, SESSION, Running, attach, chunk_of, running
from capturelake.policies import DATASET, Policy, threshold
from capturelake.session import cut


def assign_capture_index(rows: DataFrame, cell_ns: int = CELL_NS) -> DataFrame:
    """E5: adds ``capture_index``, 1-based over a session's saved rows by image time, null elsewhere."""
    saved = F.col("outcome") == "saved"
    counted = running(rows, [Running("_index", "sum", F.when(saved, 1).otherwise(0))],
                      order=("timestamp_ns", "seq"), width=cell_ns)
    return counted.withColumn("capture_index", F.when(saved, F.col("_index")).cast("int")).drop("_index")


def assemble_keyframes(images: DataFrame, metadata: DataFrame, poses: DataFrame, depth: DataFrame | None = None,
                       policy: Policy = DATASET, mode: str = "nearest",
                       cell_ns: int = CELL_NS, reach_ns: int = REACH_NS, width: int = SEQ_CHUNK) -> DataFrame:
    """One row per image with ``outcome`` and, where found, pose and depth references and deltas.

    ``poses`` are tracking frames only. Outcomes in order: pending_metadata, pending_pose,
    rejected_quality, rejected_pose, rejected_depth, saved; a profile without a depth
    tolerance has no depth stage. ``mode='causal'`` looks only at the newest arrivals held
    when the image could first be finalised, and a photo whose metadata was evicted before stays
    pending; ``'nearest'`` looks at the whole session.
    """
    with_depth = depth is not None and policy.depth_tolerance_ns is not None
    base = pose_ready(match_metadata(images, metadata), poses)
    if mode == "nearest":
        samples = {"pose": (poses, policy.pose_tolerance_ns)}
        if with_depth:
            samples["depth"] = (depth, policy.depth_tolerance_ns)
        matched = nearest(base, samples, cell_ns, reach_ns)
    elif mode == "causal":
        samples = {"pose": (poses, policy.pose_tolerance_ns, policy.pose_buffer)}
        if with_depth:
            samples["depth"] = (depth, policy.depth_tolerance_ns, policy.depth_buffer)
        # Written once: the look-ups of every kind read it several times.
        final = cut(finalize_seq(base, poses, cell_ns, "_first_pose"))
        kept, late = final.drop("_first_pose"), late_sessions(final, poses, policy)
        if not late.isEmpty():
            gone = evicted_images(final, metadata, poses, policy, width, late).withColumn("_gone", F.lit(True))
            kept = cut(attach(kept, gone, by=["seq"], keys=STAMP).withColumns({
                "meta": F.when(F.col("_gone").isNull(), F.col("meta")),
                "finalize_seq": F.when(F.col("_gone").isNull(), F.col("finalize_seq"))}).drop("_gone"))
        matched = nearest_retained(kept, samples, width)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    outcome = (F.when(F.col("meta").isNull(), "pending_metadata")
               .when(~F.col("pose_ready"), "pending_pose")
               .when(~is_still_sharp(policy, "meta"), "rejected_quality")
               .when(F.col("pose_seq").isNull(), "rejected_pose"))
    if with_depth:
        outcome = outcome.when(F.col("depth_seq").isNull(), "rejected_depth")
    rows = matched.withColumn("outcome", outcome.otherwise("saved"))
    for name in ("pose", "depth") if with_depth else ("pose",):
        rows = rows.withColumn(f"{name}_delta_ns", F.col(f"{name}_timestamp_ns") - F.col("timestamp_ns"))
    # One row per image: written once, since numbering the saved rows reads it twice.
    return assign_capture_index(cut(rows), cell_ns)


#: Stands for "no pose held yet".
NO_POSE = -(1 << 63)
CHUNK_ROW = (SESSION, "chunk", "entered", "held", "gone")


def late_sessions(images: DataFrame, poses: DataFrame, policy: Policy = DATASET) -> DataFrame:
    """Sessions in which metadata can have been evicted before its photo was finalised; images as from ``finalize_seq``.

    An entry goes if the oldest held pose is newer by more than the tolerance. Then either that pose is the
    session's first arrival of all, or the buffer was full: the photo waited for as many arrivals after
    the first pose that was late enough for it.
    """
    waits = images.where("finalize_seq IS NOT NULL").groupBy(SESSION).agg(
        F.max(F.col("finalize_seq") - F.col("_first_pose")).alias("_wait"), F.min("timestamp_ns").alias("_earliest"))
    first = poses.groupBy(SESSION).agg(F.min_by("timestamp_ns", "seq").alias("_first_ns"))
    return waits.join(first, SESSION).where(
        (F.col("_wait") >= policy.pose_buffer - 1) | (F.col("_first_ns") - policy.pose_tolerance_ns > F.col("_earliest"))).select(SESSION)


def _in_sessions(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    return attach(rows, sessions.withColumn("_late", F.lit(True)), by=["seq"]).where("_late").drop("_late")


def evicted_images(images: DataFrame, metadata: DataFrame, poses: DataFrame, policy: Policy = DATASET,
                   width: int = SEQ_CHUNK, sessions: DataFrame | None = None, stretch: int = SEQ_CHUNK) -> DataFrame:
    """G5 as it happens: (session_id, timestamp_ns) of photos whose metadata was gone when they could be finalised.

    ``images`` carry ``finalize_seq``. At each metadata arrival beyond the buffer, entries older than the oldest
    held pose (less the tolerance) go; a photo that is finalised takes its entry out. The oldest held pose
    of an arrival is found by its rank. ``sessions`` names those to look at (default: all).

    What is held is a fold over metadata and photos in arrival order, which runs in chunks of ``stretch`` arrivals, all
    at once. A chunk is folded from nothing held at first. An eviction, and photos that take their entries out, make the
    rest of a chunk independent of what was held before, so the ends of most chunks are right already. Each chunk
    after one that ended otherwise than assumed is folded again, until none is left; a chunk that is not reached
    by a change is not read again.
    """
    if sessions is not None:
        images, metadata, poses = (_in_sessions(x, sessions) for x in (images, metadata, poses))
    # One pass numbers the poses and tells how many each metadata arrival has before it; written, as both sides read it.
    both = poses.select(*STAMP, "seq", F.lit(0).alias("_kind")).unionByName(metadata.select(*STAMP, "seq", F.lit(1).alias("_kind")))
    ranked = cut(running(both, [Running("_rank", "sum", F.when(F.col("_kind") == 0, 1).otherwise(0))],
                         order=("seq", "_kind"), width=width))
    numbered = ranked.where("_kind = 0").select(SESSION, "_rank", F.col("timestamp_ns").alias("_oldest"))
    first = ranked.where("_kind = 1").withColumn(
        "_rank", F.when(F.col("_rank") > 0, F.greatest(F.lit(1), F.col("_rank") - policy.pose_buffer + 1)))
    arrivals = attach(first, numbered, by=["seq"], keys=(SESSION, "_rank")).select(
        SESSION, "seq", F.lit(0).alias("kind"), "timestamp_ns", F.coalesce("_oldest", F.lit(NO_POSE)).alias("oldest"))
    ends = images.where("finalize_seq IS NOT NULL").select(
        SESSION, F.col("finalize_seq").alias("seq"), F.lit(1).alias("kind"), "timestamp_ns", F.lit(NO_POSE).alias("oldest"))
    events = cut(arrivals.unionByName(ends).withColumn("chunk", chunk_of("seq", stretch)))
    places = Window.partitionBy(SESSION).orderBy("chunk")
    # One row per chunk: the chunk that comes after it.
    after = cut(events.select(SESSION, "chunk").distinct().withColumn("next", F.lead("chunk").over(places)))
    done = cut(_folded(events, None, policy))
    asked = None
    while True:
        left = done.select(SESSION, "chunk", "held").join(after.where("next IS NOT NULL"), [SESSION, "chunk"]).select(
            SESSION, F.col("next").alias("chunk"), "held")
        known = done.select(SESSION, "chunk", F.col("entered").alias("was"))
        asked = cut(left.join(known, [SESSION, "chunk"]).where("held <> was").select(SESSION, "chunk", "held"))
        if asked.isEmpty():
            break
        again = _folded(events.join(asked.select(SESSION, "chunk"), [SESSION, "chunk"], "left_semi"), asked, policy)
        done = cut(done.join(asked, [SESSION, "chunk"], "left_anti").unionByName(again))
    return done.select(SESSION, F.explode("gone").alias("timestamp_ns"))


def _folded(events: DataFrame, entries: DataFrame | None, policy: Policy) -> DataFrame:
    """A row per chunk: what it was entered with, what it holds in the end, photos whose entry was gone."""
    buffer, tolerance = policy.metadata_buffer, policy.pose_tolerance_ns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, entered, held, order, gone = None, [], set(), [], []

        def row() -> tuple:
            return *at, entered, sorted(held), gone

        for pdf in batches:
            out = []
            for session, chunk, kind, ts, oldest, before in zip(*[pdf[c].tolist() for c in (
                    SESSION, "chunk", "kind", "timestamp_ns", "oldest", "before")]):
                if (session, chunk) != at:
                    if at is not None:
                        out.append(row())
                    at, entered, held, order, gone = (session, chunk), [], set(), [], []
                if kind < 0:
                    entered = list(before)
                    held, order = set(entered), list(entered)  # sorted, so a heap
                elif kind:
                    if ts in held:
                        held.remove(ts)
                    else:
                        gone.append(ts)
                else:
                    if ts not in held:
                        held.add(ts)
                        heappush(order, ts)
                    if oldest != NO_POSE and len(held) > buffer:
                        while order and order[0] < oldest - tolerance:
                            held.discard(heappop(order))
            yield pd.DataFrame(out, columns=CHUNK_ROW)
        if at is not None:
            yield pd.DataFrame([row()], columns=CHUNK_ROW)

    rows = events.withColumn("before", F.lit(None).cast("array<long>"))
    if entries is not None:
        rows = rows.unionByName(entries.select(
            SESSION, "chunk", F.lit(NO_POSE).alias("seq"), F.lit(-1).alias("kind"), F.lit(NO_POSE).alias("timestamp_ns"),
            F.lit(NO_POSE).alias("oldest"), F.col("held").alias("before")))
    dealt = rows.repartition(SESSION, "chunk").sortWithinPartitions(SESSION, "chunk", "seq", "kind", "timestamp_ns")
    return dealt.mapInPandas(fold, "session_id string, chunk long, entered array<long>, held array<long>, gone array<long>")


def with_poses(keyframes: DataFrame, poses: DataFrame) -> DataFrame:
    """Adds pose and intrinsics of the matched frame; the key (session, arrival) is unique."""
    extra = [c for c in poses.columns if c in ("pose", "image_k", "texture_k")]
    side = poses.select(SESSION, F.col("seq").alias("pose_seq"), *extra)
    return attach(keyframes, side, by=["timestamp_ns"], keys=(SESSION, "pose_seq"))


def rejected_images(images: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Images that produced no keyframe, with their outcome."""
    found = attach(images, keyframes.select(*STAMP, "outcome"), by=["seq"], keys=STAMP)
    return found.where(F.col("outcome").isNull() | (F.col("outcome") != "saved"))


def _known(images: DataFrame, metadata: DataFrame) -> DataFrame:
    """Images with ``_known`` where metadata has their time; any number of images may share one."""
    return attach(images, metadata.select(*STAMP).distinct().withColumn("_known", F.lit(True)), by=["seq"], keys=STAMP)


def unmatched_images(images: DataFrame, metadata: DataFrame) -> DataFrame:
    """Images without metadata."""
    return _known(images, metadata).where("_known IS NULL").drop("_known")


def matched_images(images: DataFrame, metadata: DataFrame) -> DataFrame:
    return _known(images, metadata).where("_known").drop("_known")


def evict_metadata(metadata: DataFrame, poses: DataFrame, policy: Policy = DATASET,
                   width: int = SEQ_CHUNK) -> DataFrame:
    """Metadata still held; beyond the buffer size, entries older than the oldest held pose go.

    Without any pose nothing is evicted.
    """
    held = latest_by_timestamp(metadata)
    counts = held.groupBy(SESSION).agg(F.count("*").alias("_held"))
    oldest = (last_n(poses.select(SESSION, "seq", "timestamp_ns"), policy.pose_buffer, width=width)
              .groupBy(SESSION).agg(F.min_by("timestamp_ns", "seq").alias("_oldest")))
    rows = attach(held, counts.join(oldest, SESSION, "left"), by=["timestamp_ns"])
    stale = ((F.col("_held") > threshold(policy, "metadata_buffer"))
             & F.coalesce(F.col("timestamp_ns") < F.col("_oldest") - threshold(policy, "pose_tolerance_ns"),
                          F.lit(False)))
    return rows.where(~stale).drop("_held", "_oldest")
