"""Session datasets: transforms, validation, manifests, jobs and names.

Documents are built as one row per frame plus one row per session; a session's frames are
never gathered into a single row, so a session of any size can be exported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions.imaging import frame_name, megapixels
from capturelake.functions.pose import column_major_to_rows, forward_world, pose_inverse, pose_matrix, up_world
from capturelake.plans.chunks import SESSION, Running, attach, chunk_of, running
from capturelake.policies import DATASET, MIN_JOB_FRAMES, Policy

# Fixed values of the dataset documents.
COORDINATES = "ARCore root-anchor local; OpenGL camera convention (+X right,+Y up,-Z forward)"
POINT_COORDINATES = "ARCore root-anchor local coordinates"
IMAGE_PATTERN = "frame_*.jpg"
METADATA_PATTERN = "frame_*.json"
CLOUD_PATTERN = "frame_*.ply"
STRATEGY = "quality-gated keyframes selected by viewpoint change, focus, exposure and motion"
MANIFEST_NOTE = ("Per-frame PLY files are depth priors/initialization data; RGB images and camera poses are the "
                 "primary 3DGS training observations.")
JOB_NOTE = ("The capture/preprocessing handoff is ready. The native Vulkan 3DGS optimizer is not bundled in this "
            "build yet.")
JOB_STATUS = "READY_FOR_ANDROID_NATIVE_TRAINER"
JOB_CONVENTION = "OpenGL camera-to-world, root-anchor local"
JOB_BACKEND = "android_native_backend_pending"
TARGET_SHUTTER = "1/500 s"

REQUIRED = ("jpeg_width", "jpeg_height", "image", "capture_index", "jpeg_sensor_timestamp_ns")


def order_frames(keyframes: DataFrame) -> DataFrame:
    """By session and capture index, missing indices last."""
    return keyframes.orderBy(SESSION, F.col("capture_index").asc_nulls_last(), F.col("jpeg_sensor_timestamp_ns"))


def _unreadable(array: Column, size: int) -> Column:
    """The array lacks one of its first ``size`` values, or one of them is no finite number."""
    def bad(x: Column) -> Column:
        v = x.cast("double")
        return v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))

    return F.coalesce((F.size(array) < size) | F.exists(F.slice(array, 1, size), bad), F.lit(True))


def frame_invalid() -> Column:
    """A required field is missing, a number is null or not finite, a dimension is zero, or the transform does
    not have 16 values."""
    k = F.col("arcore_image_intrinsics")
    missing = [F.col(c).isNull() for c in REQUIRED]
    matrix = F.col("world_from_camera_column_major")
    bad = (_unreadable(k["focal_length_px"], 2) | _unreadable(k["principal_point_px"], 2)
           | _unreadable(k["image_dimensions"], 2) | F.exists(F.slice(k["image_dimensions"], 1, 2), lambda d: d == 0)
           | F.coalesce(F.size(matrix) != 16, F.lit(True)) | _unreadable(matrix, 16))
    for m in missing:
        bad = bad | m
    return F.coalesce(bad, F.lit(True))


def validate_sessions(keyframes: DataFrame, sessions: DataFrame) -> DataFrame:
    """frame_count, bad_frames and status (ok, no captured keyframes, finalize failed) per session."""
    per_session = keyframes.groupBy(SESSION).agg(
        F.count("*").alias("frame_count"), F.count_if(frame_invalid()).alias("bad_frames"))
    return sessions.select(SESSION).distinct().join(per_session, SESSION, "left").select(
        SESSION, F.coalesce("frame_count", F.lit(0)).alias("frame_count"),
        F.coalesce("bad_frames", F.lit(0)).alias("bad_frames"),
    ).withColumn("status", F.when(F.col("frame_count") == 0, "no captured keyframes")
                 .when(F.col("bad_frames") > 0, "finalize failed").otherwise("ok"))


def transform_frames(keyframes: DataFrame) -> DataFrame:
    """One row per frame: capture_index and the ``frame`` entry of its session's document."""
    k = F.col("arcore_image_intrinsics")
    sx = F.try_divide(F.col("jpeg_width"), F.get(k["image_dimensions"], F.lit(0)))
    sy = F.try_divide(F.col("jpeg_height"), F.get(k["image_dimensions"], F.lit(1)))
    frame = F.struct(
        F.col("image").alias("file_path"), F.coalesce("point_cloud", F.lit("")).alias("depth_point_cloud_path"),
        F.col("jpeg_width").alias("w"), F.col("jpeg_height").alias("h"),
        (k["focal_length_px"][0] * sx).alias("fl_x"), (k["focal_length_px"][1] * sy).alias("fl_y"),
        (k["principal_point_px"][0] * sx).alias("cx"), (k["principal_point_px"][1] * sy).alias("cy"),
        F.col("capture_index"), F.col("jpeg_sensor_timestamp_ns").alias("timestamp_ns"),
        column_major_to_rows(F.col("world_from_camera_column_major")).alias("transform_matrix"))
    return keyframes.select(SESSION, "capture_index", frame.alias("frame"))


def build_transforms(keyframes: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """E1 for valid sessions only: any bad frame fails its whole session."""
    status = validate_sessions(keyframes, keyframes if sessions is None else sessions)
    valid = status.where(F.col("status") == "ok").select(SESSION, F.lit(True).alias("_valid"))
    return transform_frames(attach(keyframes, valid, by=[
        chunk_of("capture_index", 128), F.when(F.col("capture_index").isNull(), F.col("image"))], how="inner"))


def transforms_head(source: str = "capturelake") -> dict:
    """Session-level constants of a transforms document."""
    return {"camera_model": "OPENCV", "k1": 0.0, "k2": 0.0, "p1": 0.0, "p2": 0.0,
            "coordinate_system": COORDINATES, "source": source}


def build_manifests(keyframes: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Manifest fields per valid session."""
    valid = validate_sessions(keyframes, keyframes if sessions is None else sessions).where(F.col("status") == "ok")
    return valid.select(
        SESSION, F.lit(1).alias("format_version"), F.lit("saved").alias("state"), "frame_count",
        F.lit("transforms.json").alias("transforms"), F.lit(IMAGE_PATTERN).alias("image_pattern"),
        F.lit(METADATA_PATTERN).alias("per_frame_metadata_pattern"),
        F.lit(CLOUD_PATTERN).alias("raw_depth_point_cloud_pattern"),
        F.lit(STRATEGY).alias("capture_strategy"), F.lit(MANIFEST_NOTE).alias("note"))


def frame_counts_min(keyframes: DataFrame, n: int = MIN_JOB_FRAMES) -> DataFrame:
    """Sessions with at least n frames."""
    return keyframes.groupBy(SESSION).agg(F.count("*").alias("frame_count")).where(F.col("frame_count") >= n)


def prepare_jobs(frames: DataFrame, sessions: DataFrame, requested_at_ms: int | None = None,
                 n: int = MIN_JOB_FRAMES) -> DataFrame:
    """Per session the reason (ready, missing, too_few) and, when ready, the job fields."""
    counts = frames.groupBy(SESSION).agg(F.count("*").alias("frame_count"))
    joined = sessions.select(SESSION).distinct().join(counts, SESSION, "left")
    reason = (F.when(F.col("frame_count").isNull(), "missing").when(F.col("frame_count") < n, "too_few")
              .otherwise("ready"))
    ready = F.col("reason") == "ready"
    at = F.lit(requested_at_ms).cast("long") if requested_at_ms is not None else F.unix_millis(F.current_timestamp())
    fields = {"format_version": F.lit(1), "status": F.lit(JOB_STATUS), "requested_at_unix_ms": at,
              "transforms": F.lit("transforms.json"), "rgb_pattern": F.lit(IMAGE_PATTERN),
              "depth_prior_pattern": F.lit(CLOUD_PATTERN), "camera_convention": F.lit(JOB_CONVENTION),
              "backend": F.lit(JOB_BACKEND), "note": F.lit(JOB_NOTE)}
    return joined.withColumn("reason", reason).select(
        SESSION, "reason", F.coalesce("frame_count", F.lit(0)).alias("frame_count"),
        *[F.when(ready, c).alias(name) for name, c in fields.items()])


def published_names(sessions: DataFrame, existing: DataFrame, name: str = "directory") -> DataFrame:
    """The name each working directory is published under.

    ``capture_tmp_X`` becomes ``dataset_X``, or ``dataset_X_saved`` where that exists; other
    names stay.
    """
    working = F.col(name).startswith("capture_tmp_")
    target = F.concat(F.lit("dataset_"), F.col(name).substr(F.lit(len("capture_tmp_") + 1), F.length(name)))
    taken = existing.select(F.col(name).alias("_target")).distinct().withColumn("_taken", F.lit(True))
    joined = sessions.withColumn("_target", F.when(working, target)).join(taken, "_target", "left")
    final = (F.when(F.col("_target").isNull(), F.col(name))
             .when(F.col("_taken"), F.concat("_target", F.lit("_saved"))).otherwise(F.col("_target")))
    return joined.withColumn("published", final).drop("_target", "_taken")


def session_ready(outcomes: DataFrame, in_flight: DataFrame | None = None) -> DataFrame:
    """A session may be saved when nothing is pending and no request is in flight."""
    ready = outcomes.groupBy(SESSION).agg(F.count_if(F.col("outcome").startswith("pending")).alias("pending"))
    if in_flight is not None:
        ready = ready.join(in_flight.select(SESSION, F.lit(True).alias("_flying")).distinct(), SESSION, "full")
        return ready.select(SESSION, F.coalesce("pending", F.lit(0)).alias("pending"),
                            ((F.coalesce("pending", F.lit(0)) == 0) & F.col("_flying").isNull()).alias("ready"))
    return ready.withColumn("ready", F.col("pending") == 0)


def _intrinsics(k: str) -> Column:
    c = F.col(k)
    return F.struct(F.array(c["fx"], c["fy"]).alias("focal_length_px"),
                    F.array(c["cx"], c["cy"]).alias("principal_point_px"),
                    F.array(c["width"], c["height"]).alias("image_dimensions"))


# Fixed texts of the session documents, per profile.
SESSION_TEXTS = {
    "dataset": {
        "dataset_contents": "Each frame has .jpg + synchronized root-anchor camera pose JSON + Raw Depth .ply",
        "capture_policy": "Prefer 1/500 s; save no slower than 1/250 s and no higher than ISO 3200",
        "stabilization_policy": "EIS OFF; OIS OFF for saved stills"},
    "highres": {
        "capture_policy": "Camera2 still: target 1/500 s, never save slower than 1/300 s, ISO <= 1600",
        "focus_policy": "ARCore/Camera2 autofocus for acquisition; lock measured focus distance for still",
        "stabilization_policy": "EIS OFF and OIS OFF for saved stills",
        "aperture_policy": "do not change physical aperture; record actual f-number"},
    "photo": {
        "eis_policy": "OFF for stable photogrammetry geometry",
        "focus_policy": "ARCore AUTO; save only stationary/focused lens frames"},
}
HIGHRES_NAMES = {"pixel10a": "pixel_10a_photogrammetry", "generic": "photogrammetry"}
PHOTO_NAMES = {"pixel10a": "pixel_10a", "generic": "generic"}
JPEG_QUALITY = 95

# metadata column -> document field, in document order
_CAPTURE = {"exposure_time_ns": "exposure_time_ns", "iso": "iso", "aperture": "aperture_f_number",
            "focal_length_mm": "focal_length_mm", "focus_distance_diopters": "focus_distance_diopters",
            "af_mode": "af_mode", "af_state": "af_state", "ae_state": "ae_state", "awb_state": "awb_state",
            "lens_state": "lens_state", "ois_mode": "ois_mode",
            "video_stabilization_mode": "video_stabilization_mode",
            "rolling_shutter_skew_ns": "rolling_shutter_skew_ns", "frame_duration_ns": "frame_duration_ns",
            "jpeg_orientation_degrees": "jpeg_orientation_degrees", "crop_region": "crop_region"}


def quality_gate(policy: Policy) -> Column:
    """Gate thresholds recorded with each keyframe."""
    fields = {"target_shutter": TARGET_SHUTTER, "max_saved_exposure_ns": policy.max_exposure_ns,
              "max_saved_iso": policy.max_iso, "max_linear_speed_mps": policy.max_linear_mps,
              "max_angular_speed_dps": policy.max_angular_dps,
              "max_pose_match_delta_ns": policy.pose_tolerance_ns}
    if policy.depth_tolerance_ns is not None:
        fields["max_depth_match_delta_ns"] = policy.depth_tolerance_ns
    else:
        fields["profile"] = HIGHRES_NAMES[policy.device_class]
    return F.struct(*[F.lit(v).alias(n) for n, v in fields.items()])


def keyframe_documents(keyframes: DataFrame, policy: Policy = DATASET) -> DataFrame:
    """B2 content: saved keyframes as the nested per-frame document columns.

    Input: ``assemble_keyframes`` output with pose, image_k and texture_k attached (and
    point_count where clouds are written).
    """
    saved = keyframes.where(F.col("outcome") == "saved")
    base = frame_name(F.col("capture_index"), F.col("timestamp_ns"))
    p = F.col("pose")
    meta_fields = set(saved.schema["meta"].dataType.names)
    capture = F.struct(*[(F.col(f"meta.{src}") if src in meta_fields else F.lit(None).cast("int")).alias(dst)
                         for src, dst in _CAPTURE.items()])
    if "camera_id" in saved.columns:
        capture = capture.withField("camera_id", F.col("camera_id"))
    columns = {"capture_index": F.col("capture_index"), "image": F.concat(base, F.lit(".jpg"))}
    has_depth = "depth_seq" in saved.columns
    if has_depth:
        columns["point_cloud"] = F.concat(base, F.lit(".ply"))
    columns |= {"jpeg_width": F.col("jpeg_width"), "jpeg_height": F.col("jpeg_height"),
                "jpeg_sensor_timestamp_ns": F.col("timestamp_ns"),
                "arcore_pose_timestamp_ns": F.col("pose_timestamp_ns"),
                "pose_timestamp_delta_ns": F.col("pose_delta_ns")}
    if has_depth:
        count = F.col("point_count") if "point_count" in saved.columns else F.lit(None)
        columns |= {"raw_depth_timestamp_ns": F.col("depth_timestamp_ns"),
                    "depth_timestamp_delta_ns": F.col("depth_delta_ns"), "point_count": count.cast("int"),
                    "point_cloud_coordinate_system": F.lit(POINT_COORDINATES)}
    columns |= {**_pose_fields(p),
                "arcore_image_intrinsics": _intrinsics("image_k"),
                "arcore_texture_intrinsics": _intrinsics("texture_k"),
                "camera2_capture": capture, "capture_quality_gate": quality_gate(policy)}
    return saved.select(SESSION, *[c.alias(n) for n, c in columns.items()])


def _pose_fields(p: Column) -> dict[str, Column]:
    return {"translation_m": F.array(p["tx"], p["ty"], p["tz"]),
            "rotation_quaternion_xyzw": F.array(p["qx"], p["qy"], p["qz"], p["qw"]),
            "world_from_camera_column_major": pose_matrix(p),
            "camera_from_world_column_major": pose_matrix(pose_inverse(p)),
            "forward_world": forward_world(p), "up_world": up_world(p)}


def photo_documents(frames: DataFrame, policy: Policy) -> DataFrame:
    """B2 content of the photo profile, where the requested frame is the photo.

    ``frames`` are requested frames with motion, pose, image_k, image_timestamp_ns and any of
    the metadata columns; capture indices count them in arrival order.
    """
    counted = running(frames, [Running("capture_index", "sum", F.lit(1))])
    k, p = F.col("image_k"), F.col("pose")
    known = {"sensor_timestamp_ns", "exposure_time_ns", "frame_duration_ns", "rolling_shutter_skew_ns", "iso",
             "aperture_f_number", "focal_length_mm", "focus_distance_diopters", "focus_range_diopters", "lens_state",
             "af_mode", "af_state", "ae_state", "awb_state", "ois_mode", "video_stabilization_mode",
             "lens_intrinsic_calibration", "lens_radial_distortion"}
    metadata = [c for c in frames.columns if c in known]
    gate = {"profile": F.lit(PHOTO_NAMES[policy.device_class]), "linear_speed_mps": F.col("linear_mps"),
            "angular_speed_dps": F.col("angular_dps"), "max_exposure_ns": F.lit(policy.max_exposure_ns),
            "max_linear_speed_mps": F.lit(policy.max_linear_mps), "max_angular_speed_dps": F.lit(policy.max_angular_dps),
            "jpeg_quality": F.lit(JPEG_QUALITY)}
    columns = {"capture_index": F.col("capture_index").cast("int"),
               "image": F.concat(frame_name(F.col("capture_index"), F.col("image_timestamp_ns")), F.lit(".jpg")),
               "width": k["width"], "height": k["height"], "frame_timestamp_ns": F.col("timestamp_ns"),
               "image_timestamp_ns": F.col("image_timestamp_ns"), **_pose_fields(p), "intrinsics": _intrinsics("image_k"),
               "camera_metadata": F.struct(*metadata),
               "capture_quality_gate": F.struct(*[c.alias(n) for n, c in gate.items()])}
    return counted.select(SESSION, *[c.alias(n) for n, c in columns.items()])


def session_documents(sessions: DataFrame, policy: Policy) -> DataFrame:
    """B8 content: a session's camera columns with the profile's fixed texts and thresholds."""
    extra: dict[str, Column] = {n: F.lit(t) for n, t in SESSION_TEXTS[policy.profile].items()}
    if policy.profile == "highres":
        extra["profile"] = F.lit(HIGHRES_NAMES[policy.device_class])
        if "jpeg_width" in sessions.columns:
            extra["jpeg_megapixels"] = megapixels(F.col("jpeg_width"), F.col("jpeg_height"))
    if policy.profile == "photo":
        extra |= {"capture_profile": F.lit(PHOTO_NAMES[policy.device_class]),
                  "max_exposure_ns": F.lit(policy.max_exposure_ns),
                  "max_linear_speed_mps": F.lit(policy.max_linear_mps),
                  "max_angular_speed_dps": F.lit(policy.max_angular_dps)}
    return sessions.withColumns(extra)


def trajectory_lines(documents: DataFrame) -> DataFrame:
    """B3 content: one CSV line per keyframe with 9 decimals."""
    t, q = F.col("translation_m"), F.col("rotation_quaternion_xyzw")
    line = F.format_string(
        "%d,%s,%s,%d,%d,%.9f,%.9f,%.9f,%.9f,%.9f,%.9f,%.9f", "capture_index", "image", "point_cloud",
        "jpeg_sensor_timestamp_ns", "arcore_pose_timestamp_ns", *[t[i] for i in range(3)], *[q[i] for i in range(4)])
    return documents.select(SESSION, "capture_index", line.alias("line"))
