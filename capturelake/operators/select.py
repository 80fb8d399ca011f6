"""Greedy keyframe selection (G1) with a decision for every frame.

Whether a frame is requested depends on the last request before it, so selection is a
sequential fold. It is still exact and parallel within one session:

1. a session's frames are cut into chunks of C consecutive ones; only the last request before a chunk
   links it to the past;
2. each chunk that has a successor is folded once from every frame that could be its first
   request (its heads: the unblocked frames up to the first one that any earlier request
   is old enough to force); the folds merge within a few requests, and only
   (head, last request of the chunk) leaves the task;
3. per session, the heads are walked chunk by chunk, giving each chunk its entry request;
4. all chunks are folded in parallel from their entries.

A session within one chunk skips 2 and 3. Folds stream over sorted Arrow batches and hold
one request (or one per unmerged head), never a group.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from capturelake.operators.gates import FOCUSED_AF, is_slow
from capturelake.operators.motion import speeds
from capturelake.plans.chunks import SEQ_CHUNK, SESSION, Running, chunk_of, running
from capturelake.policies import Policy, threshold
from capturelake.session import cut

CLEARING = ("photo_arrived", "request_failed", "result_without_timestamp")
POSE = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")
REQUEST = ("seq", "timestamp_ns", *POSE)
THRESHOLDS = ("min_interval_ns", "force_after_ns", "min_translation_m", "min_rotation_deg")
#: Stands for "none yet" in long columns: below every arrival number and every clock.
NEVER = -(1 << 63)
#: A chunk's rows in a batch from which on array steps pay; fewer are taken row by row, many chunks in one go.
JUMP_ROWS = 2048
_TYPES = {"seq": "long", "timestamp_ns": "long", **dict.fromkeys(POSE, "double")}


def _schema(prefix: str) -> str:
    return ", ".join(f"{prefix}{c} {_TYPES[c]}" for c in REQUEST)


def refuse(last: tuple | None, row: tuple, clear: float | None, tracked: bool, limits: tuple) -> str | None:
    """Why ``row`` cannot follow the request ``last``, by timing and viewpoint; None if it can.

    ``last`` and ``row`` are (seq, ts, tx, ty, tz, qx, qy, qz, qw); ``clear`` is the latest
    arrival that ended a request, and ``tracked`` says whether those are known at all.
    """
    if last is None:
        return None
    if tracked and (clear is None or clear <= last[0]):
        return "in_flight"
    interval, force, translation, rotation = limits
    elapsed = row[1] - last[1]
    if elapsed < interval:
        return "interval"
    if elapsed >= force or math.dist(last[2:5], row[2:5]) >= translation:
        return None
    w = last[5] * row[5] + last[6] * row[6] + last[7] * row[7] + last[8] * row[8]
    return None if math.degrees(2.0 * math.acos(min(1.0, abs(w)))) >= rotation else "viewpoint"


def _rows(pdf: pd.DataFrame, limits: tuple | None) -> Iterator[tuple]:
    """(first-of-chunk, block, clear, limits, request tuple) per frame of a batch."""
    first = (pdf["_n"] == 1).tolist()
    block = pdf["_block"].tolist()
    clear = [None if v == NEVER else v for v in pdf["_clear"].tolist()]
    request = zip(*[pdf[c].tolist() for c in REQUEST])
    bounds = [limits] * len(pdf) if limits else zip(*[pdf[c].tolist() for c in THRESHOLDS])
    return zip(first, block, clear, bounds, request)


def _forward(pdf: pd.DataFrame) -> bool:
    """Whether clock and clearing arrivals never go back and every pose is known, which the binary search needs."""
    ts, clear = pdf["timestamp_ns"].to_numpy(), pdf["_clear"].to_numpy()
    return bool((ts[1:] >= ts[:-1]).all() and (clear[1:] >= clear[:-1]).all() and pdf[list(POSE)].notna().all(axis=None))


def _jump(pdf: pd.DataFrame, last: tuple | None, tracked: bool, limits: tuple) -> tuple[np.ndarray, tuple | None]:
    """Decisions for frames of one chunk whose clock never goes back, from request to request.

    Frames that are in flight or too early after a request are found by binary search; one step is
    taken per request and per frame that could follow it, not per frame.
    """
    n = len(pdf)
    seq, ts, clear = (pdf[c].to_numpy() for c in ("seq", "timestamp_ns", "_clear"))
    block = pdf["_block"].to_numpy(dtype=object)
    free = np.array([b is None for b in block], dtype=bool)
    places = np.flatnonzero(free)
    poses = pdf[list(POSE)].to_numpy()
    out = block.copy()
    interval, force, translation, rotation = limits
    at = 0
    while at < n:
        if last is not None:
            ready = at
            if tracked:
                ready = max(at, int(np.searchsorted(clear, last[0], side="right")))
                out[at:ready] = "in_flight"
            begin = max(ready, int(np.searchsorted(ts, last[1] + math.ceil(interval))))
            out[ready:begin] = "interval"
            due = max(begin, int(np.searchsorted(ts, last[1] + math.ceil(force))))
            at = _viewpoint(out, poses, last, begin, due, translation, rotation, free)
            if at is None:
                k = int(np.searchsorted(places, due))
                at = int(places[k]) if k < len(places) else n
        else:
            k = int(np.searchsorted(places, at))
            at = int(places[k]) if k < len(places) else n
        if at < n:
            out[at] = "requested"
            last = (int(seq[at]), int(ts[at]), *poses[at].tolist())
            at += 1
    out[block == "capture_stopped"] = "capture_stopped"
    return out, last


def _viewpoint(out: np.ndarray, poses: np.ndarray, last: tuple, begin: int, due: int, translation: float,
               rotation: float, free: np.ndarray) -> int | None:
    """First unblocked frame in begin..due that moved enough; those before it that did not are marked."""
    step = 16
    while begin < due:
        end = min(due, begin + step)
        part = poses[begin:end]
        path = np.sqrt(((part[:, :3] - last[2:5]) ** 2).sum(axis=1))
        w = np.minimum(1.0, np.abs(part[:, 3:] @ np.array(last[5:9])))
        angle = np.degrees(2.0 * np.arccos(w))
        moved = (path >= translation) | (angle >= rotation)
        # Next to a threshold the last digit counts: there the frame is tested as the fold tests it.
        close = (np.abs(path - translation) < 1e-9) | (np.abs(angle - rotation) < 1e-6)
        for k in np.flatnonzero(close).tolist():
            moved[k] = refuse(last, (0, last[1], *part[k].tolist()), None, False, (0, math.inf, translation, rotation)) is None
        hits = np.flatnonzero(moved & free[begin:end])
        stop = begin + int(hits[0]) if len(hits) else end
        still = np.flatnonzero(~moved[:stop - begin]) + begin
        out[still] = "viewpoint"
        if len(hits):
            return stop
        begin, step = end, 4 * step
    return None


def _step(pdf: pd.DataFrame, last: tuple | None, tracked: bool, limits: tuple | None) -> tuple[list, tuple | None]:
    """Decisions for the frames of any number of chunks, one frame after another."""
    heads = pdf[pdf["_n"] == 1]
    known = heads["_e_known"].tolist()
    entries = zip(known, zip(*[heads[f"_e_{c}"].tolist() for c in REQUEST]))
    decisions = []
    for first, block, clear, bounds, row in _rows(pdf, limits):
        if first:
            has, entry = next(entries)
            last = entry if has else None
        if block == "capture_stopped":
            decision = block
        else:
            decision = refuse(last, row, clear, tracked, bounds) or block or "requested"
            if decision == "requested":
                last = row
        decisions.append(decision)
    return decisions, last


def _decide(tracked: bool, limits: tuple | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            decisions, at = [], 0
            edges = np.unique(np.concatenate([[0], np.flatnonzero(pdf["_n"].to_numpy() == 1), [len(pdf)]]))
            long = np.flatnonzero(np.diff(edges) >= JUMP_ROWS) if limits else []
            for a, b in zip(edges[long].tolist(), edges[1:][long].tolist()):
                part = pdf.iloc[a:b]
                if not _forward(part):
                    continue
                if at < a:
                    some, last = _step(pdf.iloc[at:a], last, tracked, limits)
                    decisions.extend(some)
                if part["_n"].iat[0] == 1:
                    last = (tuple(part[f"_e_{c}"].iat[0].item() for c in REQUEST)
                            if part["_e_known"].iat[0] else None)
                some, last = _jump(part, last, tracked, limits)
                decisions.extend(some)
                at = b
            if at < len(pdf):
                some, last = _step(pdf.iloc[at:], last, tracked, limits)
                decisions.extend(some)
            yield pd.DataFrame({SESSION: pdf[SESSION], "seq": pdf["seq"], "timestamp_ns": pdf["timestamp_ns"],
                                "decision": decisions})
    return fold


class Orbits:
    """Selections running side by side through a chunk, each from its own first request.

    Selections whose last request is the same frame go on as one. A frame is only tried
    against those that can follow their last request by time: ``flying`` wait for their
    request to end (in arrival order), ``young`` for the interval (a heap by time), and only
    the ``ripe`` ones are tested for viewpoint.
    """

    def __init__(self, tracked: bool):
        self.tracked = tracked
        self.flying: deque = deque()
        self.young: list = []
        self.ripe: list = []

    def follow(self, row: tuple, clear: int | None, limits: tuple) -> list[int]:
        """Takes out the selections that request ``row``; returns the ids of their heads."""
        while self.flying and clear is not None and self.flying[0][0][0] < clear:
            end, ids = self.flying.popleft()
            heappush(self.young, (end[1], end[0], end, ids))
        while self.young and row[1] - self.young[0][0] >= limits[0]:
            _, _, end, ids = heappop(self.young)
            self.ripe.append((end, ids))
        merged: list[int] = []
        left = []
        for end, ids in self.ripe:
            if refuse(end, row, clear, self.tracked, limits) is None:
                merged, ids = (merged, ids) if len(merged) >= len(ids) else (ids, merged)
                merged.extend(ids)
            else:
                left.append((end, ids))
        self.ripe = left
        return merged

    def add(self, row: tuple, ids: list[int]) -> None:
        if self.tracked:
            self.flying.append((row, ids))
        else:
            heappush(self.young, (row[1], row[0], row, ids))

    def ends(self) -> dict[int, tuple]:
        """Last request per head."""
        held = [*self.flying, *self.ripe, *[(end, ids) for _, _, end, ids in self.young]]
        return {i: end for end, ids in held for i in ids}


def _head_folds(tracked: bool, limits: tuple | None, chunk: str) -> Callable:
    columns = [SESSION, chunk, *[f"_h_{c}" for c in REQUEST], "_h_clear",
               *([f"_h_{t}" for t in THRESHOLDS]), *[f"_x_{c}" for c in REQUEST]]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, heads, orbits = None, [], Orbits(tracked)
        open_plain = open_flight = cleared = False

        def finish() -> list[tuple]:
            ends = orbits.ends()
            return [(*where, *h, c, *b, *ends[i]) for i, (h, c, b) in enumerate(heads)]

        for pdf in batches:
            out = []
            ids = zip(pdf[SESSION].tolist(), pdf[chunk].tolist())
            horizon = pdf["_before_ns"].tolist()
            start = pdf["_clear_before"].tolist()
            for (first, block, clear, bounds, row), key, seen, clear0 in zip(
                    _rows(pdf, limits), ids, horizon, start):
                if first:
                    if where is not None:
                        out.extend(finish())
                    where, heads, orbits = key, [], Orbits(tracked)
                    open_plain, open_flight, cleared = True, tracked, False
                if block:
                    continue
                merged = orbits.follow(row, clear, bounds)
                cleared = cleared or (clear is not None and clear > clear0)
                if open_plain or (open_flight and cleared):
                    merged.append(len(heads))
                    heads.append((row, NEVER if clear is None else clear, bounds))
                    # Without a frame before this chunk anything can come first.
                    forced = seen == NEVER or row[1] - seen >= bounds[1]
                    open_plain = open_plain and not forced
                    open_flight = open_flight and not (forced and cleared)
                if merged:
                    orbits.add(row, merged)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if where is not None:
            yield pd.DataFrame(finish(), columns=columns)
    return fold


def _walk(tracked: bool, chunk: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    columns = [SESSION, chunk, *[f"_e_{c}" for c in REQUEST]]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = at = entry = found = None
        for pdf in batches:
            out = []
            keys = zip(pdf[SESSION].tolist(), pdf[chunk].tolist(), (pdf["_n"] == 1).tolist())
            heads = zip(*[pdf[f"_h_{c}"].tolist() for c in REQUEST])
            ends = zip(*[pdf[f"_x_{c}"].tolist() for c in REQUEST])
            clears = pdf["_h_clear"].tolist()
            bounds = zip(*[pdf[f"_h_{t}"].tolist() for t in THRESHOLDS])
            for (s, c, first), head, end, clear, limits in zip(keys, heads, ends, clears, bounds):
                if at is not None and (first or (session, at) != (s, c)):
                    if found is not None:
                        out.append((session, at, *found))
                        entry = found
                if first:
                    entry = None
                if first or (session, at) != (s, c):
                    session, at, found = s, c, None
                if found is None and refuse(entry, head, None if clear == NEVER else clear, tracked, limits) is None:
                    found = end
            if out:
                yield pd.DataFrame(out, columns=columns)
        if found is not None:
            yield pd.DataFrame([(session, at, *found)], columns=columns)
    return fold


def block_reason(policy: Policy | str, exposure: bool = False) -> Column:
    """The first failing gate that does not depend on earlier requests; null if none.

    Frames are gated on exposure only where the frame itself becomes the photo.
    """
    reason = (F.when(~F.col("enabled"), "capture_stopped")
              .when(~is_slow(policy), "motion")
              .when(F.col("lens_state") != 0, "lens")
              .when(~F.col("af_state").isin(*FOCUSED_AF), "focus"))
    if not exposure:
        return reason
    slow = F.col("exposure_time_ns") > threshold(policy, "max_exposure_ns")
    return reason.when(threshold(policy, "null_exposure_ok") & slow, "exposure")


def with_history(frames: DataFrame, controls: DataFrame | None, width: int) -> DataFrame:
    """Adds motion, ``enabled``, ``_clear`` (latest arrival that ended a request, NEVER if none) and the frame's
    position ``_at`` in its session, in one pass."""
    rows = frames.select(SESSION, "seq", F.lit(1).alias("_rank"), F.struct("pose", "timestamp_ns").alias("_now"),
                         F.struct(*[c for c in frames.columns if c not in (SESSION, "seq")]).alias("_row"))
    specs = [Running("_prev", "last", F.col("_now"), inclusive=False), Running("_at", "sum", F.col("_rank"))]
    if controls is not None:
        marks = controls.select(
            SESSION, "seq", F.lit(0).alias("_rank"),
            F.when(F.col("kind").isin("stop", "resume"), F.col("kind") == "resume").alias("_on"),
            F.when(F.col("kind").isin(*CLEARING), F.col("seq")).alias("_ended"))
        rows = rows.unionByName(marks, allowMissingColumns=True)
        specs += [Running("_enabled", "last", F.col("_on")), Running("_cleared", "last", F.col("_ended"))]
    seen = running(rows, specs, order=("seq", "_rank"), width=width).where(F.col("_rank") == 1)
    enabled, clear = ("_enabled", "_cleared") if controls is not None else (F.lit(True), F.lit(NEVER))
    return seen.select(SESSION, "seq", "_row.*", "_prev", "_at", F.coalesce(enabled, F.lit(True)).alias("enabled"),
                       F.coalesce(clear, F.lit(NEVER)).cast("long").alias("_clear")).withColumns(speeds("_prev"))


def select_keyframes(frames: DataFrame, policy: Policy | str, controls: DataFrame | None = None,
                     width: int = SEQ_CHUNK) -> DataFrame:
    """G1: (session_id, seq, timestamp_ns, decision) for every tracking frame, in arrival order.

    ``frames`` holds session_id, seq, timestamp_ns, pose, lens_state and af_state, tracking
    frames only; the photo profile also uses exposure_time_ns. Motion and viewpoint are the same in any fixed coordinate system, so poses
    need not be root-relative. Without ``controls`` a request ends at once; with them, frames
    between a request and the event that ends it are ``in_flight``, and frames between stop
    and resume are ``capture_stopped``.
    """
    tracked = controls is not None
    chunk = "_chunk"
    limits = tuple(getattr(policy, t) for t in THRESHOLDS) if isinstance(policy, Policy) else None
    seen = with_history(frames, controls, width)
    ready = cut(seen.select(
        SESSION, chunk_of(F.col("_at") - 1, width).alias(chunk), "seq", "timestamp_ns", *[F.col(f"pose.{c}").alias(c) for c in POSE], "_clear",
        block_reason(policy, "exposure_time_ns" in frames.columns).alias("_block"),
        *([] if limits else [threshold(policy, t).alias(t) for t in THRESHOLDS])))

    # One row per chunk: is there a later one, and the clock and clearing arrival before it.
    per_chunk = ready.groupBy(SESSION, chunk).agg(F.max("timestamp_ns").alias("_max"), F.max("_clear").alias("_cleared"))
    order = Window.partitionBy(SESSION).orderBy(chunk)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    chunks = per_chunk.select(
        SESSION, chunk, F.lead(chunk).over(order).isNotNull().alias("_more"),
        F.coalesce(F.max("_max").over(earlier), F.lit(NEVER)).alias("_before_ns"),
        F.coalesce(F.max("_cleared").over(earlier), F.lit(NEVER)).alias("_clear_before"))
    arrivals = F.row_number().over(Window.partitionBy(SESSION, chunk).orderBy("seq")).alias("_n")

    bounds = ", ".join(f"_h_{t} double" for t in THRESHOLDS)
    heads = (ready.join(chunks.where("_more").drop("_more"), [SESSION, chunk])
             .select("*", arrivals)
             .mapInPandas(_head_folds(tracked, limits, chunk),
                          f"{SESSION} string, {chunk} long, {_schema('_h_')}, _h_clear long, {bounds}, {_schema('_x_')}"))
    exits = (heads.select("*", F.row_number().over(Window.partitionBy(SESSION).orderBy(chunk, "_h_seq")).alias("_n"))
             .mapInPandas(_walk(tracked, chunk), f"{SESSION} string, {chunk} long, {_schema('_e_')}"))
    ends = exits.select(SESSION, chunk, F.struct(*[f"_e_{c}" for c in REQUEST]).alias("_exit"))
    entries = (chunks.select(SESSION, chunk).join(ends, [SESSION, chunk], "left")
               .select(SESSION, chunk, F.last("_exit", ignorenulls=True).over(earlier).alias("_entry")))
    return (ready.join(entries, [SESSION, chunk], "left")
            .select(*ready.columns, F.col("_entry").isNotNull().alias("_e_known"),
                    *[F.coalesce(f"_entry._e_{c}", F.lit(0)).cast(_TYPES[c]).alias(f"_e_{c}") for c in REQUEST],
                    arrivals)
            .mapInPandas(_decide(tracked, limits),
                         f"{SESSION} string, seq long, timestamp_ns long, decision string"))
