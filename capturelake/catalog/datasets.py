"""Dataset queries: documents, validation, manifests, jobs and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.catalog.common import r, rq, sql, sql_matrix, tracking
from capturelake.fixtures import table
from capturelake.functions.imaging import frame_name
from capturelake.functions.pose import pose, pose_matrix
from capturelake.operators.export import (build_manifests, build_transforms, frame_counts_min, keyframe_documents,
                                          order_frames, prepare_jobs, published_names, trajectory_lines,
                                          validate_sessions)
from capturelake.operators.motion import attach_root, root_relative, session_roots
from capturelake.catalog.photos import NEAREST, PHOTO_TABLES, tables
from capturelake.catalog.common import sql_relative
from capturelake.plans.assemble import assemble_keyframes, with_poses
from capturelake.plans.chunks import SESSION, Running, running
from capturelake.session import cut


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Keyframe documents of the orders table, some with missing fields."""
    k = table(spark, sf, "keyframes")
    return k.select(
        SESSION, "capture_index", "image", "point_cloud", "jpeg_width", "jpeg_height",
        F.col("timestamp_ns").alias("jpeg_sensor_timestamp_ns"),
        F.struct(F.array("fx", "fy").alias("focal_length_px"), F.array("cx", "cy").alias("principal_point_px"),
                 F.array("img_w", "img_h").alias("image_dimensions")).alias("arcore_image_intrinsics"),
        pose_matrix(pose()).alias("world_from_camera_column_major"))


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer is a session, with or without keyframes."""
    return table(spark, sf, "customer").selectExpr(
        "concat('s', lpad(cast(c_custkey AS string), 6, '0')) AS session_id")


def transforms(spark: SparkSession, sf: str) -> DataFrame:
    rows = build_transforms(documents(spark, sf), sessions(spark, sf))
    f = F.col("frame")
    return rows.select(
        SESSION, f["capture_index"].alias("capture_index"), f["file_path"].alias("file_path"),
        f["depth_point_cloud_path"].alias("depth_point_cloud_path"), f["w"].alias("w"), f["h"].alias("h"),
        *[r(f[c], 5).alias(c) for c in ("fl_x", "fl_y", "cx", "cy")], f["timestamp_ns"].alias("timestamp_ns"),
        *[r(f["transform_matrix"][i][j]).alias(f"m{i}{j}") for i in range(3) for j in range(4)])


def validated(spark: SparkSession, sf: str) -> DataFrame:
    return validate_sessions(documents(spark, sf), sessions(spark, sf))


def validated_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of every order, some with nulls inside arrays, zero dimensions or numbers that are not finite."""
    key, k = F.regexp_extract("image", r"(\d+)", 1).cast("long"), "arcore_image_intrinsics"
    odd = documents(spark, sf).withColumn(k, F.struct(
        F.transform(f"{k}.focal_length_px", lambda v, i: F.when(~((key % 13 == 0) & (i == 1)), v)).alias("focal_length_px"),
        F.transform(f"{k}.principal_point_px", lambda v, i: F.when((key % 29 == 0) & (i == 0), F.lit(float("nan"))).otherwise(v))
        .alias("principal_point_px"),
        F.transform(f"{k}.image_dimensions", lambda v, i: F.when((key % 17 == 0) & (i == 0), 0).otherwise(v)).alias("image_dimensions")))
    odd = odd.withColumn("world_from_camera_column_major", F.transform(
        "world_from_camera_column_major", lambda v, i: F.when(~((key % 19 == 0) & (i == 7)), v)))
    return validate_sessions(odd, sessions(spark, sf))


def ordered(spark: SparkSession, sf: str) -> DataFrame:
    """Frames in document order with their position: the count of the session's rows so far in the sorted output."""
    rows = cut(order_frames(documents(spark, sf)).select(
        SESSION, "image", "capture_index", F.monotonically_increasing_id().alias("_at")))
    placed = running(rows, [Running("position", "sum", F.lit(1))], order=("_at",), width=1 << 17)
    return placed.select(SESSION, "image", "capture_index", "position")


def enough_frames(spark: SparkSession, sf: str) -> DataFrame:
    return frame_counts_min(documents(spark, sf))


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    frames = build_transforms(documents(spark, sf), sessions(spark, sf))
    return prepare_jobs(frames, sessions(spark, sf), requested_at_ms=1_700_000_000_000).select(
        SESSION, "reason", "frame_count", "format_version", "status", "requested_at_unix_ms", "backend")


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    return build_manifests(documents(spark, sf), sessions(spark, sf)).select(
        SESSION, "format_version", "state", "frame_count", "transforms", "image_pattern")


def names(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    working = c.selectExpr("CASE c_custkey % 4 WHEN 3 THEN concat('photogrammetry_', c_custkey) "
                           "ELSE concat('capture_tmp_', c_custkey) END AS directory")
    existing = table(spark, sf, "orders").selectExpr("concat('dataset_', o_custkey) AS directory")
    return published_names(working, existing)


def saved_keyframes(spark: SparkSession, sf: str) -> DataFrame:
    """Saved keyframes with root-relative poses and intrinsics, as documents."""
    images, meta, frames, depth = tables(spark, sf)
    based = root_relative(attach_root(frames, session_roots(frames)))
    return keyframe_documents(with_poses(assemble_keyframes(images, meta, frames, depth), based))


def keyframe_json(spark: SparkSession, sf: str) -> DataFrame:
    docs = saved_keyframes(spark, sf)
    text = docs.select(SESSION, F.to_json(F.struct(*docs.columns[1:]), {"ignoreNullFields": "false"}).alias("doc"))
    get = lambda path: F.get_json_object("doc", f"$.{path}")
    return text.select(
        SESSION, get("capture_index").cast("int").alias("capture_index"), get("image").alias("image"),
        get("jpeg_sensor_timestamp_ns").cast("long").alias("timestamp_ns"),
        get("pose_timestamp_delta_ns").cast("long").alias("pose_delta_ns"),
        get("depth_timestamp_delta_ns").cast("long").alias("depth_delta_ns"),
        *[r(get(f"translation_m[{i}]").cast("double"), 5).alias(f"t{i}") for i in range(3)],
        r(get("forward_world[2]").cast("double"), 5).alias("forward_z"),
        r(get("arcore_image_intrinsics.focal_length_px[0]").cast("double"), 3).alias("fx"),
        get("camera2_capture.iso").cast("int").alias("iso"),
        get("camera2_capture.exposure_time_ns").cast("long").alias("exposure_time_ns"),
        get("capture_quality_gate.max_saved_iso").cast("int").alias("max_saved_iso"))


def trajectory(spark: SparkSession, sf: str) -> DataFrame:
    # Compared as numbers, to the 9 decimals of the text.
    cells = F.split("line", ",")
    rows = trajectory_lines(saved_keyframes(spark, sf)).withColumn("c", cells)
    return rows.select(
        SESSION, F.col("c")[0].cast("int").alias("index"), F.col("c")[1].alias("image"), F.col("c")[2].alias("point_cloud"),
        F.col("c")[4].cast("long").alias("pose_timestamp_ns"),
        *[r(F.col("c")[5 + i].cast("double"), 9).alias(n) for i, n in enumerate(("tx", "ty", "tz"))],
        F.size("c").alias("cells"))


def frame_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "keyframes").select(
        SESSION, "seq", frame_name(F.col("capture_index"), F.col("timestamp_ns")).alias("name"))


BAD = "capture_index IS NULL OR jpeg_width IS NULL"
VALID = f"""sess AS (SELECT concat('s', lpad(cast(c_custkey AS varchar), 6, '0')) AS session_id FROM customer),
checked AS (SELECT session_id, count(k.seq) AS frame_count, count(k.seq) FILTER ({BAD}) AS bad_frames
  FROM sess LEFT JOIN keyframes k USING (session_id) GROUP BY session_id),
good AS (SELECT k.* FROM keyframes k JOIN checked c USING (session_id) WHERE c.bad_frames = 0)"""
M = sql_matrix()
ROOTED = """rooted AS (SELECT p.*, o.tx AS otx, o.ty AS oty, o.tz AS otz, o.qx AS oqx, o.qy AS oqy, o.qz AS oqz, o.qw AS oqw
  FROM tracked p JOIN (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM tracked) o
  ON o.session_id = p.session_id AND o.rn = 1),
rel AS (SELECT session_id, seq, timestamp_ns, fx, {} FROM rooted)""".format(
    ", ".join(f"{e} AS {k}" for k, e in sql_relative("o", "").items()))
SAVED = "kf k JOIN rel p ON p.session_id = k.session_id AND p.seq = k.pose_seq"

QUERIES = {
    "build_transforms": (transforms, sql(
        "SELECT session_id, capture_index, image AS file_path, coalesce(point_cloud, '') AS depth_point_cloud_path, "
        f"jpeg_width AS w, jpeg_height AS h, {rq('fx*jpeg_width/img_w', 'fl_x', 5)}, {rq('fy*jpeg_height/img_h', 'fl_y', 5)}, "
        f"{rq('cx*jpeg_width/img_w', 'cx', 5)}, {rq('cy*jpeg_height/img_h', 'cy', 5)}, timestamp_ns, "
        + ", ".join(rq(M[j * 4 + i], f"m{i}{j}") for i in range(3) for j in range(4)) + " FROM good",
        "keyframes", extra=VALID)),
    "validate_sessions": (validated, sql(
        "SELECT session_id, frame_count, bad_frames, CASE WHEN frame_count = 0 THEN 'no captured keyframes' "
        "WHEN bad_frames > 0 THEN 'finalize failed' ELSE 'ok' END AS status FROM checked", "keyframes", extra=VALID)),
    "validate_documents_nulls": (validated_nulls, sql(
        "SELECT session_id, frame_count, bad_frames, CASE WHEN frame_count = 0 THEN 'no captured keyframes' "
        "WHEN bad_frames > 0 THEN 'finalize failed' ELSE 'ok' END AS status FROM (SELECT session_id, count(k.seq) AS frame_count, "
        f"count(k.seq) FILTER (({BAD}) OR k.seq % 13 = 0 OR k.seq % 17 = 0 OR k.seq % 19 = 0 OR k.seq % 29 = 0) AS bad_frames "
        "FROM sess LEFT JOIN keyframes k USING (session_id) GROUP BY session_id)", "keyframes", extra=VALID)),
    "order_frames": (ordered, sql(
        "SELECT session_id, image, capture_index, row_number() OVER (PARTITION BY session_id ORDER BY capture_index NULLS LAST, "
        "timestamp_ns) AS position FROM keyframes", "keyframes")),
    "frame_counts_min": (enough_frames, sql(
        "SELECT session_id, count(*) AS frame_count FROM keyframes GROUP BY session_id HAVING count(*) >= 8", "keyframes")),
    "prepare_jobs": (jobs, sql("""
SELECT session_id, reason, n AS frame_count, CASE WHEN reason = 'ready' THEN 1 END AS format_version,
  CASE WHEN reason = 'ready' THEN 'READY_FOR_ANDROID_NATIVE_TRAINER' END AS status,
  CASE WHEN reason = 'ready' THEN 1700000000000 END AS requested_at_unix_ms,
  CASE WHEN reason = 'ready' THEN 'android_native_backend_pending' END AS backend
FROM (SELECT session_id, count(g.seq) AS n, CASE WHEN count(g.seq) = 0 THEN 'missing' WHEN count(g.seq) < 8 THEN 'too_few'
  ELSE 'ready' END AS reason FROM sess LEFT JOIN good g USING (session_id) GROUP BY session_id)""", "keyframes", extra=VALID)),
    "build_manifests": (manifests, sql(
        "SELECT session_id, 1 AS format_version, 'saved' AS state, frame_count, 'transforms.json' AS transforms, "
        "'frame_*.jpg' AS image_pattern FROM checked WHERE bad_frames = 0 AND frame_count > 0", "keyframes", extra=VALID)),
    "published_names": (names, """
SELECT directory, CASE WHEN k % 4 = 3 THEN directory WHEN EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = k) THEN concat('dataset_', k, '_saved') ELSE concat('dataset_', k) END AS published
FROM (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 3 THEN concat('photogrammetry_', c_custkey)
  ELSE concat('capture_tmp_', c_custkey) END AS directory FROM customer)"""),
    "keyframe_documents": (keyframe_json, sql(
        "SELECT k.session_id, capture_index, format('frame_{:06d}_{}.jpg', capture_index, k.timestamp_ns) AS image, "
        f"k.timestamp_ns, pose_delta_ns, depth_delta_ns, {rq('p.tx', 't0', 5)}, {rq('p.ty', 't1', 5)}, {rq('p.tz', 't2', 5)}, "
        f"{rq('-(1 - 2*(p.qx*p.qx + p.qy*p.qy))', 'forward_z', 5)}, {rq('p.fx', 'fx', 3)}, m.iso, m.exposure_time_ns, "
        f"3200 AS max_saved_iso FROM {SAVED} JOIN still_metadata m ON m.session_id = k.session_id AND "
        "m.timestamp_ns = k.timestamp_ns WHERE outcome = 'saved'", *PHOTO_TABLES, extra=f"{NEAREST}, {ROOTED}")),
    "trajectory_lines": (trajectory, sql(
        "SELECT k.session_id, capture_index AS index, format('frame_{:06d}_{}.jpg', capture_index, k.timestamp_ns) AS image, "
        "format('frame_{:06d}_{}.ply', capture_index, k.timestamp_ns) AS point_cloud, p.timestamp_ns AS pose_timestamp_ns, "
        f"{rq('p.tx', 'tx', 9)}, {rq('p.ty', 'ty', 9)}, {rq('p.tz', 'tz', 9)}, 12 AS cells FROM {SAVED} "
        "WHERE outcome = 'saved'", *PHOTO_TABLES, extra=f"{NEAREST}, {ROOTED}")),
    "frame_names": (frame_names, sql(
        "SELECT session_id, seq, CASE WHEN capture_index IS NULL THEN format('frame_  null_{}', timestamp_ns) "
        "ELSE format('frame_{:06d}_{}', capture_index, timestamp_ns) END AS name FROM keyframes", "keyframes")),
}
