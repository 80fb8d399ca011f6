"""Capture reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.operators.motion import last_n
from capturelake.plans.chunks import SEQ_CHUNK, SESSION
from capturelake.policies import DISPLAY_FRAMES, LOG_LINES

DECISIONS = ("capture_stopped", "in_flight", "interval", "viewpoint", "motion", "lens", "focus", "exposure", "requested")


def depth_frames_held(depth: DataFrame, n: int = DISPLAY_FRAMES) -> DataFrame:
    """Accepted depth frames kept for display, per session."""
    return depth.groupBy(SESSION).agg(F.least(F.count("*"), F.lit(n)).alias("depth_frames"))


def capture_report(decisions: DataFrame, keyframes: DataFrame, depth: DataFrame,
                   finalized: DataFrame | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """Per session the frames per decision, the last decision, saved keyframes and depth frames held.

    Each input is reduced to one row per session (map-side first) before the joins. A session
    counts that occurs in any input or in ``sessions``; without frames its decision is null.
    ``finalized`` lists the saved sessions.
    """
    frames = decisions.groupBy(SESSION).agg(
        F.count("*").alias("frames"), F.max_by("decision", "seq").alias("last_decision"),
        *[F.count_if(F.col("decision") == d).alias(f"n_{d}") for d in DECISIONS])
    saved = keyframes.groupBy(SESSION).agg(F.count_if(F.col("outcome") == "saved").alias("keyframes"))
    report = frames.join(saved, SESSION, "full").join(depth_frames_held(depth), SESSION, "full")
    for more in (finalized, sessions):
        if more is not None:
            report = report.join(more.select(SESSION).distinct(), SESSION, "full")
    report = report.na.fill(0, ["frames", "keyframes", "depth_frames", *[f"n_{d}" for d in DECISIONS]])
    if finalized is None:
        report = report.withColumn("finalized", F.lit(False))
    else:
        marks = finalized.select(SESSION).distinct().withColumn("_saved", F.lit(True))
        report = (report.join(marks, SESSION, "left")
                  .withColumn("finalized", F.coalesce("_saved", F.lit(False))).drop("_saved"))
    state = F.when(F.col("finalized"), "saved").otherwise("capturing")
    status = F.concat_ws(" / ", F.concat(F.lit("Raw depth: "), F.col("depth_frames").cast("string")),
                         F.concat(F.lit("keyframes: "), F.col("keyframes").cast("string")), state)
    return report.withColumn("status", status)


def recent_log_lines(lines: DataFrame, n: int = LOG_LINES, width: int = SEQ_CHUNK) -> DataFrame:
    """F5 on diagnostics: the newest n lines per session."""
    return last_n(lines, n, width=width)
