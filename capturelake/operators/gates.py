"""Quality gates and filters (C1–C10). Null rules are part of each gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions.imaging import subsample_step
from capturelake.functions.pose import rotation_degrees, translation_distance
from capturelake.plans.chunks import SEQ_CHUNK, SESSION, Running, running
from capturelake.policies import MIN_CONFIDENCE, POINT_LIMIT, Policy, threshold

FOCUSED_AF = (0, 2, 4)


def tracking_only(frames: DataFrame) -> DataFrame:
    """C1."""
    return frames.where(F.col("tracking_state") == "TRACKING")


def valid_depth(pixels: DataFrame) -> DataFrame:
    """Only exact zero means "no depth"."""
    return pixels.where(F.col("depth_mm") != 0)


def on_grid(x: Column, y: Column, w: Column, h: Column, limit: int = POINT_LIMIT) -> Column:
    step = subsample_step(w, h, limit)
    return (x % step == 0) & (y % step == 0)


def grid_subsample(pixels: DataFrame, width: Column, height: Column, limit: int = POINT_LIMIT) -> DataFrame:
    """Keeps the regular grid whose size is about ``limit`` pixels of the frame."""
    return pixels.where(on_grid(F.col("x"), F.col("y"), width, height, limit))


def min_confidence(points: DataFrame, t: float = MIN_CONFIDENCE) -> DataFrame:
    """C4: the threshold itself passes."""
    return points.where(F.col("confidence") >= F.lit(t))


def is_focused(af: Column, null_ok: bool | Column = True) -> Column:
    """C5."""
    fallback = null_ok if isinstance(null_ok, Column) else F.lit(null_ok)
    return F.coalesce(af.isin(*FOCUSED_AF), fallback)


def _zero_or_null(c: Column) -> Column:
    return F.coalesce(c == 0, F.lit(True))


def is_still_sharp(policy: Policy | str, meta: str | None = None) -> Column:
    """Gate on a still's metadata; unknown exposure or ISO rejects, other unknowns pass."""
    def m(name: str) -> Column:
        return F.col(f"{meta}.{name}" if meta else name)

    return (F.coalesce(m("exposure_time_ns") <= threshold(policy, "max_exposure_ns"), F.lit(False))
            & F.coalesce(m("iso") <= threshold(policy, "max_iso"), F.lit(False))
            & _zero_or_null(m("lens_state")) & _zero_or_null(m("ois_mode"))
            & _zero_or_null(m("video_stabilization_mode")) & is_focused(m("af_state")))


def is_slow(policy: Policy | str, linear: str = "linear_mps", angular: str = "angular_dps") -> Column:
    return ((F.col(linear) <= threshold(policy, "max_linear_mps"))
            & (F.col(angular) <= threshold(policy, "max_angular_dps")))


def is_frame_sharp(policy: Policy | str) -> Column:
    """Gate on a video frame; every unknown passes."""
    return (is_slow(policy)
            & F.coalesce(F.col("exposure_time_ns") <= threshold(policy, "max_exposure_ns"), F.lit(True))
            & _zero_or_null(F.col("lens_state")) & is_focused(F.col("af_state")))


def is_pose_stable(policy: Policy | str) -> Column:
    """Motion, lens and focus of the frame a still would be requested on."""
    return is_slow(policy) & _zero_or_null(F.col("lens_state")) & is_focused(F.col("af_state"))


def viewpoint_changed(pose: Column, ts: Column, last_pose: Column, last_ts: Column, policy: Policy | str) -> Column:
    """Far enough from the last request in space, angle or time; no last request passes."""
    moved = ((translation_distance(last_pose, pose) >= threshold(policy, "min_translation_m"))
             | (rotation_degrees(last_pose, pose) >= threshold(policy, "min_rotation_deg")))
    forced = ts - last_ts >= threshold(policy, "force_after_ns")
    return last_ts.isNull() | last_pose.isNull() | forced | moved


def capture_enabled(frames: DataFrame, controls: DataFrame, width: int = SEQ_CHUNK) -> DataFrame:
    """Adds ``enabled``, false between a stop and the next resume.

    Control events are merged into the frames' arrival order; an event with a frame's own
    seq precedes it.
    """
    marks = controls.where(F.col("kind").isin("stop", "resume")).select(
        SESSION, "seq", F.lit(0).alias("_rank"), (F.col("kind") == "resume").alias("_on"))
    rows = frames.select(SESSION, "seq", F.lit(1).alias("_rank"), F.struct(*frames.columns).alias("_row"))
    merged = running(rows.unionByName(marks, allowMissingColumns=True),
                     [Running("_enabled", "last", F.col("_on"))], order=("seq", "_rank"), width=width)
    return merged.where(F.col("_rank") == 1).select(
        "_row.*", F.coalesce("_enabled", F.lit(True)).alias("enabled"))
