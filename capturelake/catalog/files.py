"""File queries: every writer runs over the derived tables and its reader gives the rows back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.catalog.clouds import LOCAL, MODEL, PX, binary_frames, decoded_sql, rgb_sql, world
from capturelake.catalog.common import intrinsics, r, rq, sql, sql_matrix
from capturelake.catalog.datasets import ROOTED, SAVED, VALID, documents, saved_keyframes, sessions
from capturelake.catalog.frames import decisions_sql, photo_frames
from capturelake.catalog.photos import NEAREST, PHOTO_TABLES, tables
from capturelake.fixtures import table
from capturelake.functions.pose import pose
from capturelake.operators.export import (build_manifests, build_transforms, photo_documents, prepare_jobs,
                                          session_documents, validate_sessions)
from capturelake.operators.motion import attach_root, motion, root_relative, session_roots
from capturelake.operators.points import explode_depth_frames
from capturelake.operators.select import select_keyframes
from capturelake.plans.assemble import assemble_keyframes, with_poses
from capturelake.plans.chunks import SESSION
from capturelake.plans.commit import commit_keyframes, commit_snapshot
from capturelake.policies import DATASET, PHOTO_GENERIC
from capturelake.session import checkpoint_dir
from capturelake.sources import readers, snapshots, working, writers
from capturelake.sources.listing import tasks


def shared_folder(spark: SparkSession) -> str:
    """A new folder where every executor can write and read."""
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def point_cloud_files(spark: SparkSession, sf: str) -> DataFrame:
    root = shared_folder(spark)
    points = world(spark, sf).withColumn("frame", F.format_string("frame_%06d_%d", "frame_id", F.col("frame_id") * 33000000))
    writers.write_point_clouds(points.withColumn("frame_ts_ns", F.col("frame_id") * 33000000), root)
    return readers.read_point_clouds(spark, root).select(
        SESSION, "frame", "frame_ts_ns", "i", *[r(F.col(c).cast("double"), 4).alias(c) for c in ("x", "y", "z")],
        "red", "green", "blue", r(F.col("confidence").cast("double"), 4).alias("confidence"))


def keyframe_files(spark: SparkSession, sf: str) -> DataFrame:
    root = shared_folder(spark)
    writers.write_keyframes(saved_keyframes(spark, sf), root)
    docs = readers.read_keyframes(spark, root)
    return docs.select(SESSION, "file_name", "capture_index", "image", "jpeg_sensor_timestamp_ns",
                       *[r(F.col("translation_m")[i], 5).alias(f"t{i}") for i in range(3)],
                       r(F.col("arcore_image_intrinsics.focal_length_px")[0], 3).alias("fx"),
                       F.col("camera2_capture.iso").alias("iso"),
                       F.size("world_from_camera_column_major").alias("matrix_values"),
                       F.col("capture_quality_gate.max_saved_exposure_ns").alias("max_saved_exposure_ns"))


def validated_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with missing fields go through their files and fail their sessions."""
    root = shared_folder(spark)
    docs = documents(spark, sf).withColumn("image", F.coalesce("image", F.lit("x.jpg")))
    writers.write_keyframes(docs, root)
    return validate_sessions(readers.read_keyframes(spark, root), sessions(spark, sf))


def transforms_files(spark: SparkSession, sf: str) -> DataFrame:
    return _transforms_back(spark, sf, lambda root: readers.read_transforms(spark, root, lines=True))


def transforms_files_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The same documents as of an unknown tool, in ranges so short that most documents have several."""
    return _transforms_back(spark, sf, lambda root: readers.read_transforms_ranges(spark, root, size=1 << 12))


def _transforms_back(spark: SparkSession, sf: str, read: Callable[[str], DataFrame]) -> DataFrame:
    root = shared_folder(spark)
    writers.write_transforms(build_transforms(documents(spark, sf)), root)
    back = read(root)
    return back.select(SESSION, "camera_model", "capture_index", "file_path", r("fl_x", 5).alias("fl_x"),
                       *[r(F.col("transform_matrix")[i][3]).alias(f"m{i}3") for i in range(3)])


def job_files(spark: SparkSession, sf: str) -> DataFrame:
    root = shared_folder(spark)
    writers.write_transforms(build_transforms(documents(spark, sf)), root)
    frames = readers.read_transforms(spark, root, lines=True)
    writers.write_jobs(prepare_jobs(frames, sessions(spark, sf), 1_700_000_000_000), root)
    jobs = readers.read_documents(spark, root, "frame_count long, requested_at_unix_ms long, status string", "3dgs_job.json")
    return jobs.select(SESSION, "frame_count", "requested_at_unix_ms", "status")


def trajectory_files(spark: SparkSession, sf: str) -> DataFrame:
    root = shared_folder(spark)
    writers.write_trajectory(saved_keyframes(spark, sf), root)
    return readers.read_trajectory(spark, root).select(
        SESSION, "index", "image", "pose_timestamp_ns", *[r(c, 9).alias(c) for c in ("tx", "ty", "tz")])


def published_files(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests are written to working folders; half of the names are taken before publishing."""
    root = shared_folder(spark)
    valid = build_manifests(documents(spark, sf), sessions(spark, sf))
    working = valid.withColumn(SESSION, F.concat(F.lit("capture_tmp_"), SESSION))
    writers.write_manifests(working, root)
    taken = valid.where(F.substring(SESSION, -1, 1).isin("0", "2", "4", "6", "8"))
    writers.write_documents(taken.select(F.concat(F.lit("dataset_"), SESSION).alias(SESSION), F.lit("README").alias("file"),
                                         F.lit("taken").alias("content")).repartition(tasks(spark), SESSION), root, "taken")
    return writers.publish_datasets(working, root).select(SESSION, F.col("file").alias("published"))


def snapshot_files(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests of two commits, each in a generation of its own; the second finds every session published."""
    root = shared_folder(spark)
    valid = build_manifests(documents(spark, sf), sessions(spark, sf))
    taken = valid.where(F.substring(SESSION, -1, 1).isin("0", "2", "4", "6", "8"))
    writers.write_documents(taken.select(F.concat(F.lit("dataset_"), SESSION).alias(SESSION), F.lit("README").alias("file"),
                                         F.lit("taken").alias("content")).repartition(tasks(spark), SESSION), root, "taken")
    named = valid.withColumn(SESSION, F.concat(F.lit("capture_tmp_"), SESSION))
    for _ in range(2):
        generation = snapshots.new_generation()
        writers.write_manifests(named.withColumn(SESSION, snapshots.folder(F.col(SESSION), generation)),
                                snapshots.files_of(root, generation))
        outcome = snapshots.publish_snapshots(named.select(SESSION), root, generation)
    checked = snapshots.verify_snapshots(spark, root).withColumnRenamed(SESSION, "published")
    return outcome.select(SESSION, F.col("file").alias("published"), "status").join(checked, "published").select(
        SESSION, "published", "status", "files", "missing", "resized", "unlisted")


def _photos_and_points(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    images, meta, frames, depth = tables(spark, sf)
    based = root_relative(attach_root(frames, session_roots(frames)))
    keyframes = with_poses(assemble_keyframes(images, meta, frames, depth), based)
    points = depth.select(SESSION, F.col("seq").alias("depth_seq"), "frame_id", F.explode(F.expr("sequence(0L, frame_id % 3)")).alias("i")).select(
        SESSION, "depth_seq", "i", (F.col("i") * 0.5).alias("x"), F.expr("(frame_id % 100) / 128D").alias("y"), F.lit(-1.0).alias("z"),
        F.col("i").alias("red"), F.lit(2).alias("green"), F.lit(3).alias("blue"), F.lit(1.0).alias("confidence"))
    return keyframes, points, images.select(SESSION, "timestamp_ns", F.lit("photo").cast("binary").alias("content"))


def dataset_files(spark: SparkSession, sf: str) -> DataFrame:
    """Photos to published datasets, read back: documents, point files, transforms and trajectory meet by name."""
    root = shared_folder(spark)
    keyframes, points, photos = _photos_and_points(spark, sf)
    commit_keyframes(keyframes, points, root, photos, requested_at_ms=1_700_000_000_000)
    return _read_back(spark, root, lambda rows, *by: rows)


def snapshot_dataset_files(spark: SparkSession, sf: str) -> DataFrame:
    """The same datasets published by pointers, and every file read through them."""
    root = shared_folder(spark)
    keyframes, points, photos = _photos_and_points(spark, sf)
    commit_snapshot(keyframes, points, root, photos, requested_at_ms=1_700_000_000_000)
    return _read_back(spark, snapshots.snapshot_files(root), lambda rows, *by: snapshots.published(rows, root, by))


def _read_back(spark: SparkSession, root: str, seen: Callable[..., DataFrame]) -> DataFrame:
    """The files of datasets joined by name; ``seen`` takes a reader's rows and columns that tell them apart."""
    docs = seen(readers.read_keyframes(spark, root), "file_name").select(
        SESSION, "capture_index", "image", "point_count", F.regexp_replace("file_name", r"\.json$", "").alias("frame"))
    clouds = seen(readers.read_point_clouds(spark, root), "frame", "i").groupBy(SESSION, "frame").agg(
        F.count("*").alias("cloud_points"), r(F.sum(F.col("y").cast("double")), 4).alias("sum_y"))
    listed = seen(readers.read_transforms(spark, root, lines=True), "file_path").select(
        SESSION, "capture_index", F.col("file_path").alias("listed_as"))
    track = seen(readers.read_trajectory(spark, root), "index").select(
        SESSION, F.col("index").alias("capture_index"), F.col("image").alias("tracked_as"))
    shots = seen(readers.read_images(spark, root), "path").select(
        SESSION, "capture_index", F.col("length").alias("photo_bytes"))
    return (docs.join(clouds, [SESSION, "frame"], "left").drop("frame").join(listed, [SESSION, "capture_index"], "left")
            .join(track, [SESSION, "capture_index"], "left").join(shots, [SESSION, "capture_index"], "left"))


def session_camera_files(spark: SparkSession, sf: str) -> DataFrame:
    root = shared_folder(spark)
    cameras = table(spark, sf, "customer").selectExpr(
        "concat('s', lpad(cast(c_custkey AS string), 6, '0')) AS session_id", "'Google' AS manufacturer",
        "CASE WHEN c_custkey % 2 = 0 THEN 'Pixel 10a' ELSE 'Pixel 9' END AS model", "cast(c_custkey % 3 AS string) AS camera_id",
        "4000 AS jpeg_width", "3000 AS jpeg_height",
        "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 90 END AS sensor_orientation_degrees",
        "CASE WHEN c_custkey % 7 > 0 THEN struct(0 AS left, 0 AS top, 4080 AS right, 3072 AS bottom) END AS active_array",
        "array(1.68D) AS available_apertures", "cast(NULL AS array<double>) AS lens_distortion")
    writers.write_session_cameras(session_documents(cameras, DATASET), root)
    return readers.read_session_cameras(spark, root).select(
        SESSION, "model", "camera_id", "sensor_orientation_degrees", F.col("active_array.right").alias("active_right"),
        F.col("available_apertures")[0].alias("aperture"), F.size("lens_distortion").alias("distortion_values"),
        "stabilization_policy")


def image_files(spark: SparkSession, sf: str) -> DataFrame:
    root = shared_folder(spark)
    photos = saved_keyframes(spark, sf).select(
        SESSION, "image", F.encode(F.concat(F.lit("photo "), "image"), "UTF-8").alias("content"))
    writers.write_images(photos, root)
    return readers.read_images(spark, root).select(SESSION, "capture_index", "timestamp_ns", "length")


def depth_frame_table(spark: SparkSession, sf: str) -> DataFrame:
    """Depth frames as a parquet working table, read back and decoded."""
    where = f"{shared_folder(spark)}/depth_frames"
    full = binary_frames(spark, sf).withColumns({
        "timestamp_ns": F.col("seq"), "texture_k": F.lit(None), "pose": F.lit(None)})
    full.write.parquet(where)
    return explode_depth_frames(readers.read_depth_frames(spark, where), limit=20).select(*PX)


def state_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Camera states and still metadata as JSON working tables, read back with fixed schemas."""
    root = shared_folder(spark)
    table(spark, sf, "camera_states").write.json(f"{root}/states")
    table(spark, sf, "still_metadata").write.json(f"{root}/stills")
    states = readers.read_camera_states(spark, f"{root}/states", "json")
    stills = readers.read_still_metadata(spark, f"{root}/stills", "json")
    columns = (SESSION, "seq", "timestamp_ns", "exposure_time_ns", "iso", "af_state", "lens_state")
    return (states.select(F.lit("state").alias("kind"), *columns)
            .unionByName(stills.select(F.lit("still").alias("kind"), *columns)))


def pose_table(spark: SparkSession, sf: str) -> DataFrame:
    where = f"{shared_folder(spark)}/poses"
    table(spark, sf, "poses").select(
        SESSION, "seq", "timestamp_ns", "tracking_state", pose().alias("pose"), intrinsics("image_k"),
        intrinsics("texture_k"), "lens_state", "af_state").write.parquet(where)
    return readers.read_poses(spark, where).select(
        SESSION, "seq", "timestamp_ns", "tracking_state", r("pose.tx").alias("tx"), r("pose.qw").alias("qw"),
        F.col("image_k.width").alias("width"), "af_state")


def metadata_by_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Photos and metadata as working tables by day and bucket, matched where they lie."""
    root, mark = shared_folder(spark), uuid.uuid4().hex
    images, meta, _, _ = tables(spark, sf)
    day = F.expr("date_add(DATE'2024-01-01', cast(substring(session_id, 2) AS int) % 5)")
    laid = [working.write_working_table(df, f"{name}_{mark}", f"{root}/{name}", day, buckets=8)
            for name, df in (("images", images), ("still_metadata", meta))]
    return working.match_in_place(*laid).select(
        SESSION, F.col(working.DAY).cast("string").alias("session_date"), "seq", "timestamp_ns", F.col("meta.seq").alias("meta_seq"),
        F.col("meta.exposure_time_ns").alias("exposure_time_ns"), F.col("meta.iso").alias("iso"))


def photo_keyframe_files(spark: SparkSession, sf: str) -> DataFrame:
    """Photo-profile keyframes: requested frames with their motion, as documents read back."""
    root = shared_folder(spark)
    frames = photo_frames(spark, sf)
    asked = select_keyframes(frames, PHOTO_GENERIC).where("decision = 'requested'").select(SESSION, "seq")
    requested = motion(frames).join(asked, [SESSION, "seq"]).withColumn("image_timestamp_ns", F.col("timestamp_ns") + 5)
    writers.write_keyframes(photo_documents(requested, PHOTO_GENERIC), root)
    return readers.read_keyframes(spark, root).select(
        SESSION, "capture_index", "image", "width", "frame_timestamp_ns",
        r(F.col("intrinsics.focal_length_px")[0], 3).alias("fx"), F.col("camera_metadata.iso").alias("iso"),
        r("capture_quality_gate.linear_speed_mps", 5).alias("linear_mps"),
        F.col("capture_quality_gate.profile").alias("profile"))


ROOT_NAME = "format('frame_{:06d}_{}', frame_id, frame_id*33000000)"
IMAGE = "format('frame_{:06d}_{}.jpg', capture_index, k.timestamp_ns)"
M = sql_matrix()
OK = f"""ok AS (SELECT k.* FROM keyframes k JOIN (SELECT session_id FROM keyframes GROUP BY session_id
  HAVING count(*) FILTER (capture_index IS NULL OR jpeg_width IS NULL) = 0) g USING (session_id))"""

TRANSFORMS = sql(
    f"SELECT session_id, 'OPENCV' AS camera_model, capture_index, image AS file_path, {rq('fx*jpeg_width/img_w', 'fl_x', 5)}, "
    + ", ".join(rq(M[12 + i], f"m{i}3") for i in range(3)) + " FROM ok", "keyframes", extra=OK)

DATASETS = sql(
    f"SELECT concat('dataset_', k.session_id) AS session_id, capture_index, {IMAGE} AS image, cast(k.depth_seq % 3 + 1 AS int) AS point_count, "
    f"cast(k.depth_seq % 3 + 1 AS bigint) AS cloud_points, {rq('(k.depth_seq % 3 + 1) * ((k.depth_seq % 100) / 128e0)', 'sum_y', 4)}, "
    f"{IMAGE} AS listed_as, {IMAGE} AS tracked_as, cast(5 AS bigint) AS photo_bytes FROM kf k WHERE outcome = 'saved'",
    *PHOTO_TABLES, extra=NEAREST)

QUERIES = {
    "point_cloud_files": (point_cloud_files, sql(
        f"SELECT session_id, {ROOT_NAME} AS frame, frame_id*33000000 AS frame_ts_ns, "
        "row_number() OVER (PARTITION BY frame_id ORDER BY i) - 1 AS i, "
        + ", ".join(rq(f"cast(cast({c} AS float) AS double)", c, 4) for c in "xyz")
        + f", {rgb_sql()}, {rq('cast(cast(conf AS float) AS double)', 'confidence', 4)} FROM world",
        "depth_pixels", "depth_frames_meta", extra=f"{LOCAL}, {MODEL}")),
    "keyframe_files": (keyframe_files, sql(
        f"SELECT k.session_id, replace({IMAGE}, '.jpg', '.json') AS file_name, capture_index, {IMAGE} AS image, "
        f"k.timestamp_ns AS jpeg_sensor_timestamp_ns, {rq('p.tx', 't0', 5)}, {rq('p.ty', 't1', 5)}, {rq('p.tz', 't2', 5)}, "
        f"{rq('p.fx', 'fx', 3)}, m.iso, 16 AS matrix_values, cast(4000000 AS bigint) AS max_saved_exposure_ns FROM {SAVED} "
        "JOIN still_metadata m ON m.session_id = k.session_id AND m.timestamp_ns = k.timestamp_ns WHERE outcome = 'saved'",
        *PHOTO_TABLES, extra=f"{NEAREST}, {ROOTED}")),
    "photo_keyframe_files": (photo_keyframe_files, decisions_sql(PHOTO_GENERIC, body=(
        "SELECT session_id, capture_index, format('frame_{:06d}_{}.jpg', capture_index, timestamp_ns + 5) AS image, "
        f"img_w AS width, timestamp_ns AS frame_timestamp_ns, {rq('fx', 'fx', 3)}, iso, {rq('linear_mps', 'linear_mps', 5)}, "
        "'generic' AS profile FROM (SELECT b.*, cast(row_number() OVER (PARTITION BY session_id ORDER BY seq) AS int) AS "
        "capture_index FROM b JOIN decisions d USING (session_id, seq, timestamp_ns) WHERE d.decision = 'requested')"))),
    "validated_files": (validated_files, sql(
        "SELECT session_id, frame_count, bad_frames, CASE WHEN frame_count = 0 THEN 'no captured keyframes' "
        "WHEN bad_frames > 0 THEN 'finalize failed' ELSE 'ok' END AS status FROM checked", "keyframes", extra=VALID)),
    "transforms_files": (transforms_files, TRANSFORMS),
    "transforms_files_ranges": (transforms_files_ranges, TRANSFORMS),
    "job_files": (job_files, sql(
        "SELECT session_id, count(*) AS frame_count, 1700000000000 AS requested_at_unix_ms, "
        "'READY_FOR_ANDROID_NATIVE_TRAINER' AS status FROM ok WHERE session_id IN (SELECT session_id FROM sess) "
        "GROUP BY session_id HAVING count(*) >= 8", "keyframes", extra=f"{OK}, {VALID}")),
    "trajectory_files": (trajectory_files, sql(
        f"SELECT k.session_id, capture_index AS index, {IMAGE} AS image, p.timestamp_ns AS pose_timestamp_ns, "
        f"{rq('p.tx', 'tx', 9)}, {rq('p.ty', 'ty', 9)}, {rq('p.tz', 'tz', 9)} FROM {SAVED} WHERE outcome = 'saved'",
        *PHOTO_TABLES, extra=f"{NEAREST}, {ROOTED}")),
    "published_files": (published_files, sql(
        "SELECT concat('capture_tmp_', session_id) AS session_id, CASE WHEN right(session_id, 1) IN ('0','2','4','6','8') "
        "THEN concat('dataset_', session_id, '_saved') ELSE concat('dataset_', session_id) END AS published "
        "FROM checked WHERE bad_frames = 0 AND frame_count > 0", "keyframes", extra=VALID)),
    "dataset_files": (dataset_files, DATASETS),
    "snapshot_dataset_files": (snapshot_dataset_files, DATASETS),
    "snapshot_files": (snapshot_files, sql(
        "SELECT concat('capture_tmp_', session_id) AS session_id, CASE WHEN right(session_id, 1) IN ('0','2','4','6','8') "
        "THEN concat('dataset_', session_id, '_saved') ELSE concat('dataset_', session_id) END AS published, 'already' AS status, "
        "1::bigint AS files, 0::bigint AS missing, 0::bigint AS resized, 0::bigint AS unlisted "
        "FROM checked WHERE bad_frames = 0 AND frame_count > 0", "keyframes", extra=VALID)),
    "session_camera_files": (session_camera_files, """
SELECT concat('s', lpad(cast(c_custkey AS varchar), 6, '0')) AS session_id,
  CASE WHEN c_custkey % 2 = 0 THEN 'Pixel 10a' ELSE 'Pixel 9' END AS model, cast(c_custkey % 3 AS varchar) AS camera_id,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 90 END AS sensor_orientation_degrees,
  CASE WHEN c_custkey % 7 > 0 THEN 4080 END AS active_right, 1.68e0 AS aperture, CAST(NULL AS int) AS distortion_values,
  'EIS OFF; OIS OFF for saved stills' AS stabilization_policy FROM customer"""),
    "image_files": (image_files, sql(
        f"SELECT session_id, capture_index, timestamp_ns, cast(length({IMAGE}) + 6 AS bigint) AS length FROM kf k "
        "WHERE outcome = 'saved'", *PHOTO_TABLES, extra=NEAREST)),
    "depth_frame_table": (depth_frame_table, decoded_sql()),
    "state_tables": (state_tables, sql(
        "SELECT 'state' AS kind, session_id, seq, timestamp_ns, exposure_time_ns, iso, af_state, lens_state FROM camera_states "
        "UNION ALL SELECT 'still', session_id, seq, timestamp_ns, exposure_time_ns, iso, af_state, lens_state FROM still_metadata",
        "camera_states", "still_metadata")),
    "match_metadata_by_layout": (metadata_by_layout, sql(
        "SELECT i.session_id, cast(DATE '2024-01-01' + cast(cast(substr(i.session_id, 2) AS int) % 5 AS int) AS date)::varchar AS session_date, "
        "i.seq, i.timestamp_ns, m.seq AS meta_seq, exposure_time_ns, iso FROM images i "
        "LEFT JOIN still_metadata m USING (session_id, timestamp_ns)", "images", "still_metadata")),
    "pose_table": (pose_table, sql(
        f"SELECT session_id, seq, timestamp_ns, tracking_state, {rq('tx', 'tx')}, {rq('qw', 'qw')}, 640 AS width, af_state FROM poses",
        "poses")),
}
