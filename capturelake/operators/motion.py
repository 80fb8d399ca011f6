"""Frame-to-frame features over arrival order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions.pose import (parts, relative_parts, rotation_degrees, translation_distance,
                                        with_pose)
from capturelake.plans.chunks import SEQ_CHUNK, SESSION, Running, attach, chunk_of, pick, running
from capturelake.session import cut

CAMERA_FIELDS = ("exposure_time_ns", "iso", "focus_distance", "af_state", "lens_state")


def motion(frames: DataFrame, width: int = SEQ_CHUNK) -> DataFrame:
    """adds linear_mps and angular_dps against the previous arrival; 0 without one or for dt ≤ 0."""
    withp = running(frames, [Running("_prev", "last", F.struct("pose", "timestamp_ns"), inclusive=False)], width=width)
    return withp.withColumns(speeds("_prev")).drop("_prev")


def speeds(prev: str) -> dict[str, Column]:
    """linear_mps and angular_dps against a struct column (pose, timestamp_ns) of the previous frame."""
    prev_pose, prev_ts = F.col(f"{prev}.pose"), F.col(f"{prev}.timestamp_ns")
    dt = (F.col("timestamp_ns") - prev_ts) / F.lit(1e9)

    def per_second(v: Column) -> Column:
        return F.coalesce(F.when(dt > 0, v / dt), F.lit(0.0))

    return {"linear_mps": per_second(translation_distance(prev_pose, F.col("pose"))),
            "angular_dps": per_second(rotation_degrees(prev_pose, F.col("pose")))}


def latest_camera_state(states: DataFrame, fields: Sequence[str] = CAMERA_FIELDS,
                        width: int = SEQ_CHUNK) -> DataFrame:
    """every field becomes its latest known value so far."""
    filled = running(states, [Running(f"_{f}", "last", F.col(f)) for f in fields], width=width)
    return filled.withColumns({f: F.col(f"_{f}") for f in fields}).drop(*[f"_{f}" for f in fields])


def session_roots(poses: DataFrame) -> DataFrame:
    """the pose of each session's first tracking frame (input already C1-filtered)."""
    first = pick(F.col("pose"), poses.schema["pose"].dataType, F.col("seq"), reverse=True)
    return poses.groupBy(SESSION).agg(first.alias("root"))


def attach_root(frames: DataFrame, roots: DataFrame, override: str | None = None) -> DataFrame:
    """Adds ``root``; a per-frame override wins, and without any root the frame's own pose is used."""
    known = [F.col(override)] if override else []
    joined = attach(frames, roots.withColumnRenamed("root", "_root"), by=[chunk_of("seq", 1024)])
    return joined.withColumn("root", F.coalesce(*known, F.col("_root"), F.col("pose"))).drop("_root")


def root_relative(frames: DataFrame) -> DataFrame:
    """Replaces ``pose`` by root⁻¹∘pose."""
    return with_pose(frames, "pose", relative_parts(parts(F.col("root")), parts(F.col("pose"))))


def new_depth_only(depth: DataFrame, width: int = SEQ_CHUNK) -> DataFrame:
    """drops a depth frame that repeats the timestamp of the arrival just before it."""
    prev = Running("_prev_ts", "last", F.col("timestamp_ns"), inclusive=False)
    rows = running(depth, [prev], width=width)
    return rows.where(~F.col("_prev_ts").eqNullSafe(F.col("timestamp_ns"))).drop("_prev_ts")


def last_n(df: DataFrame, n: int, order: str = "seq", width: int = SEQ_CHUNK,
           keys: Sequence[str] = (SESSION,)) -> DataFrame:
    """newest n rows per key, ranked by running counts from the end."""
    ranked = running(df, [Running("_rank", "sum", F.lit(1))], order=(order,), width=width, keys=keys, reverse=True)
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def time_since_last(frames: DataFrame, width: int = SEQ_CHUNK) -> DataFrame:
    """ns since the previous frame and, where a ``decision`` exists, since the last request."""
    specs = [Running("_frame", "last", F.col("timestamp_ns"), inclusive=False)]
    out = {"since_frame_ns": F.col("timestamp_ns") - F.col("_frame")}
    if "decision" in frames.columns:
        frames = cut(frames)  # decisions come from a selection, which would run for each use
        asked = F.when(F.col("decision") == "requested", F.col("timestamp_ns"))
        specs.append(Running("_request", "last", asked, inclusive=False))
        out["since_request_ns"] = F.col("timestamp_ns") - F.col("_request")
    return running(frames, specs, width=width).withColumns(out).drop("_frame", "_request")
