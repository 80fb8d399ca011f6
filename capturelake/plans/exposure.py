"""Exposure and focus plan for every requested frame (F2 → I22 → I17 → I18 → I19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.functions.imaging import jpeg_orientation
from capturelake.functions.planning import contains, lock_focus, manual_sensor_supported, plan_exposure
from capturelake.operators.motion import CAMERA_FIELDS
from capturelake.plans.chunks import SEQ_CHUNK, SESSION, Running, attach, running
from capturelake.policies import DATASET, Policy
from capturelake.session import cut


def state_at(requests: DataFrame, states: DataFrame, width: int = SEQ_CHUNK) -> DataFrame:
    """Adds to each request the latest known camera state up to its arrival, per field."""
    known = states.select(SESSION, "seq", F.lit(0).alias("_rank"), *CAMERA_FIELDS)
    asks = requests.select(SESSION, "seq", F.lit(1).alias("_rank"), F.struct(*requests.columns).alias("_row"))
    merged = running(asks.unionByName(known, allowMissingColumns=True),
                     [Running(f"_{c}", "last", F.col(c)) for c in CAMERA_FIELDS],
                     order=("seq", "_rank"), width=width)
    return merged.where(F.col("_rank") == 1).select(
        "_row.*", *[F.col(f"_{c}").alias(c) for c in CAMERA_FIELDS])


def exposure_plan(requests: DataFrame, states: DataFrame, caps: DataFrame, policy: Policy | str = DATASET,
                  key: str = "camera_id", width: int = SEQ_CHUNK) -> DataFrame:
    """Exposure, ISO, focus, orientation and reason per request.

    ``requests`` carry ``key``; ``caps`` has one row per key: exposure_min/max, iso_min/max,
    min_focus_distance, capabilities, ois_modes, sensor_orientation.
    """
    # Written once: a selection that requests come from would run again for every use below.
    requests = cut(requests)
    # One camera may take most of the requests.
    rows = attach(state_at(requests, states, width), caps, by=[SESSION, "seq"], keys=[key])
    plan = plan_exposure({c: F.col(c) for c in CAMERA_FIELDS}, {
        "manual": manual_sensor_supported(F.col("capabilities")),
        **{c: F.col(c) for c in ("exposure_min", "exposure_max", "iso_min", "iso_max")}}, policy)
    ok = F.col("_plan.reason") == "ok"
    return rows.withColumn("_plan", plan).select(
        *requests.columns, F.col("_plan.exposure_ns").alias("planned_exposure_ns"),
        F.col("_plan.iso").alias("planned_iso"),
        F.when(ok, lock_focus(F.col("focus_distance"), F.col("min_focus_distance"))).alias("planned_focus"),
        contains(F.col("ois_modes"), 0).alias("ois_can_be_off"),
        jpeg_orientation(F.col("sensor_orientation"), F.lit(0)).alias("sensor_orientation_degrees"),
        F.col("_plan.reason").alias("reason"))
