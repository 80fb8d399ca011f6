"""Catalogue choices per camera or device (G3, G4) as plain aggregations.

The best row of a group is the minimum of a ranking struct, which combines map-side, so
a camera or device with any number of rows never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.functions.imaging import is_four_by_three, pixel_count
from capturelake.policies import MAX_JPEG_PIXELS


def choose_jpeg_size(sizes: DataFrame, limit: int = MAX_JPEG_PIXELS) -> DataFrame:
    """Largest 4:3 size up to the limit, else largest up to it, else the smallest of all.

    Equal sizes keep the first of the input order, but the smallest keeps the last.
    """
    px = pixel_count(F.col("width"), F.col("height"))
    small = px <= limit
    tier = F.when(small & is_four_by_three(F.col("width"), F.col("height")), 0).when(small, 1).otherwise(2)
    ranked = sizes.select("camera_id", F.struct(
        tier.alias("tier"), F.when(small, -px).otherwise(px).alias("px"),
        F.when(small, F.col("ord")).otherwise(-F.col("ord")).alias("tie"),
        "ord", "width", "height").alias("_r"))
    return (ranked.groupBy("camera_id").agg(F.min("_r").alias("_r"))
            .select("camera_id", "_r.ord", "_r.width", "_r.height", "_r.tier"))


CONFIG = ("ord", "camera_id", "cpu_w", "cpu_h", "gpu_w", "gpu_h")


def choose_camera_config(configs: DataFrame, current: DataFrame) -> DataFrame:
    """30 fps without depth sensor; same camera if any; fewest CPU then most GPU pixels, first of ties.

    ``current`` holds one config per device; it is kept when no config qualifies. Configs
    are reduced per (device, camera) before they meet ``current``.
    """
    fit = configs.where((F.col("fps") == 30) & ~F.col("depth_sensor_used"))
    rank = F.struct(pixel_count(F.col("cpu_w"), F.col("cpu_h")).alias("cpu"),
                    (-pixel_count(F.col("gpu_w"), F.col("gpu_h"))).alias("gpu"), *CONFIG)
    per_camera = fit.groupBy("device_id", "camera_id").agg(F.min(rank).alias("_best"))
    now = current.select("device_id", F.struct(*CONFIG).alias("_now"))
    picked = now.join(per_camera, "device_id", "left").groupBy("device_id").agg(
        F.first("_now").alias("_now"),
        F.min(F.when(F.col("camera_id") == F.col("_now.camera_id"), F.col("_best"))).alias("_same"),
        F.min("_best").alias("_any"))
    best = F.coalesce("_same", "_any")
    return picked.select(
        "device_id",
        *[F.coalesce(best[c], F.col(f"_now.{c}")).alias(c) for c in CONFIG],
        F.when(F.col("_same").isNotNull(), "same_camera").when(F.col("_any").isNotNull(), "any_camera")
        .otherwise("current").alias("choice"))
