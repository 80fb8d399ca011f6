"""Capture policies: the thresholds and null rules of the three pipeline profiles.

A gate accepts either a ``Policy`` (thresholds become literals) or the name of a struct
column holding one (per-row thresholds after ``resolve_policy``).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Policy:
    profile: str
    device_class: str
    min_interval_ns: int
    force_after_ns: int
    min_translation_m: float
    min_rotation_deg: float
    max_linear_mps: float
    max_angular_dps: float
    pose_tolerance_ns: int | None
    depth_tolerance_ns: int | None
    max_exposure_ns: int
    max_iso: int | None
    null_exposure_ok: bool
    plan_null_af_ok: bool
    pose_buffer: int
    depth_buffer: int | None
    metadata_buffer: int | None
    root_relative: bool


# Fixed values of the capture profiles.
DATASET = Policy("dataset", "any", 700_000_000, 2_000_000_000, 0.03, 2.5, 0.25, 20.0,
                 75_000_000, 250_000_000, 4_000_000, 3200, False, True, 180, 24, 12, True)
HIGHRES_PIXEL10A = Policy("highres", "pixel10a", 650_000_000, 3_000_000_000, 0.035, 3.0, 0.08, 6.0,
                          50_000_000, None, 3_333_333, 1600, False, False, 120, None, 8, False)
HIGHRES_GENERIC = Policy("highres", "generic", 650_000_000, 3_000_000_000, 0.035, 3.0, 0.10, 8.0,
                         50_000_000, None, 3_333_333, 1600, False, False, 120, None, 8, False)
PHOTO_PIXEL10A = Policy("photo", "pixel10a", 650_000_000, 2_500_000_000, 0.035, 3.0, 0.08, 6.0,
                        None, None, 10_000_000, None, True, True, 120, None, None, False)
PHOTO_GENERIC = Policy("photo", "generic", 650_000_000, 2_500_000_000, 0.035, 3.0, 0.10, 8.0,
                       None, None, 12_500_000, None, True, True, 120, None, None, False)
POLICIES = (DATASET, HIGHRES_PIXEL10A, HIGHRES_GENERIC, PHOTO_PIXEL10A, PHOTO_GENERIC)

MAX_JPEG_PIXELS = 13_000_000
TARGET_EXPOSURE_NS = 2_000_000
POINT_LIMIT = 15_000
DISPLAY_FRAMES = 60
MIN_CONFIDENCE = 0.1
MIN_JOB_FRAMES = 8
LOG_LINES = 500
PENDING_WRITES = 2

_SPARK_TYPES = {"profile": T.StringType(), "device_class": T.StringType(),
                "min_translation_m": T.DoubleType(), "min_rotation_deg": T.DoubleType(),
                "max_linear_mps": T.DoubleType(), "max_angular_dps": T.DoubleType(),
                "null_exposure_ok": T.BooleanType(), "plan_null_af_ok": T.BooleanType(),
                "root_relative": T.BooleanType()}
POLICY_SCHEMA = T.StructType(
    [T.StructField(f.name, _SPARK_TYPES.get(f.name, T.LongType())) for f in fields(Policy)])


def threshold(policy: Policy | str, name: str) -> Column:
    """A policy field as a column: a literal, or a field of a policy struct column."""
    if isinstance(policy, Policy):
        return F.lit(getattr(policy, name)).cast(POLICY_SCHEMA[name].dataType)
    return F.col(f"{policy}.{name}")


def policy_table(spark: SparkSession) -> DataFrame:
    """The five fixed policies, one row each."""
    return spark.createDataFrame([tuple(asdict(p).values()) for p in POLICIES], POLICY_SCHEMA)


def device_class(model: Column) -> Column:
    return F.when(F.lower(F.coalesce(model, F.lit(""))).contains("pixel 10a"), "pixel10a").otherwise("generic")


def resolve_policy(sessions: DataFrame, profile: str | Column = "profile", model: str = "model") -> DataFrame:
    """Adds a ``policy`` struct to each session from its profile and device model.

    The policy table is five fixed rows, so broadcasting it is always safe.
    """
    spark = sessions.sparkSession
    wanted = F.col(profile) if isinstance(profile, str) else profile
    table = policy_table(spark).select(F.struct("*").alias("policy"))
    keyed = sessions.withColumn("_profile", wanted).withColumn(
        "_class", F.when(wanted == "dataset", "any").otherwise(device_class(F.col(model))))
    return keyed.join(
        F.broadcast(table),
        (F.col("_profile") == F.col("policy.profile")) & (F.col("_class") == F.col("policy.device_class")),
        "left",
    ).drop("_profile", "_class")
