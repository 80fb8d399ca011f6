"""Documents and files: validation, round trips, pieces of large sessions, publishing."""

from __future__ import annotations

import json
import struct

import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from capturelake.functions.pose import pose, pose_matrix
from capturelake.operators.export import (build_manifests, build_transforms, frame_counts_min, order_frames,
                                          prepare_jobs, published_names, session_ready, trajectory_lines,
                                          validate_sessions)
from capturelake.sources import readers, writers
from capturelake.sources.ply import RECORD


def documents(spark, rows):
    """(session, index, width, cloud) keyframes with plain intrinsics and poses."""
    table = spark.createDataFrame(rows, "session_id string, capture_index int, jpeg_width int, point_cloud string")
    return table.select(
        "session_id", "capture_index", F.format_string("frame_%06d_7.jpg", "capture_index").alias("image"), "point_cloud",
        "jpeg_width", F.lit(3000).alias("jpeg_height"), F.lit(7).cast("long").alias("jpeg_sensor_timestamp_ns"),
        F.lit(8).cast("long").alias("arcore_pose_timestamp_ns"),
        F.array(F.col("capture_index") / 3.0, F.lit(0.0), F.lit(-1.0)).alias("translation_m"),
        F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]).alias("rotation_quaternion_xyzw"),
        F.struct(F.array(F.lit(500.0), F.lit(501.0)).alias("focal_length_px"),
                 F.array(F.lit(320.0), F.lit(240.0)).alias("principal_point_px"),
                 F.array(F.lit(640), F.lit(480)).alias("image_dimensions")).alias("arcore_image_intrinsics"),
        pose_matrix(pose(*[F.lit(float(v)) for v in (1, 2, 3, 0, 0, 0, 1)])).alias("world_from_camera_column_major"))


def sessions(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "session_id string")


def test_validation_fails_whole_sessions(spark):
    docs = documents(spark, [("ok", 1, 4000, None), ("ok", 2, 4000, "c.ply"), ("width", 1, 4000, None), ("width", 2, None, None),
                             ("matrix", 1, 4000, None)])
    docs = docs.withColumn("world_from_camera_column_major", F.expr(
        "CASE WHEN session_id = 'matrix' THEN slice(world_from_camera_column_major, 1, 15) ELSE world_from_camera_column_major END"))
    got = rows_of(validate_sessions(docs, sessions(spark, "ok", "width", "matrix", "empty")), "session_id", "status")
    assert got == [("empty", "no captured keyframes"), ("matrix", "finalize failed"), ("ok", "ok"), ("width", "finalize failed")]
    frames = build_transforms(docs)
    assert rows_of(frames, "frame.depth_point_cloud_path", "frame.fl_x") == [("", 3125.0), ("c.ply", 3125.0)]
    assert frames.first().frame.transform_matrix == [[1, 0, 0, 1], [0, 1, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1]]
    assert rows_of(build_manifests(docs), "session_id", "frame_count") == [("ok", 2)]


def test_missing_index_sorts_last(spark):
    docs = documents(spark, [("s", None, 1, None), ("s", 2, 1, None), ("s", 1, 1, None)])
    assert [r.capture_index for r in order_frames(docs).collect()] == [1, 2, None]


def test_jobs_need_eight_frames(spark):
    docs = documents(spark, [("seven", i, 1, None) for i in range(7)] + [("eight", i, 1, None) for i in range(8)])
    assert rows_of(frame_counts_min(docs), "session_id") == [("eight",)]
    jobs = prepare_jobs(docs, sessions(spark, "seven", "eight", "none"), 5)
    assert sorted(map(tuple, jobs.select("session_id", "reason", "frame_count", "requested_at_unix_ms").collect())) == [
        ("eight", "ready", 8, 5), ("none", "missing", 0, None), ("seven", "too_few", 7, None)]


def test_ready_needs_nothing_in_flight(spark):
    rows = spark.createDataFrame([("a", "saved"), ("b", "pending_pose"), ("c", "saved")], "session_id string, outcome string")
    flying = sessions(spark, "c", "d")
    assert rows_of(session_ready(rows, flying), "session_id", "ready") == [("a", True), ("b", False), ("c", False), ("d", False)]


def test_published_names(spark):
    names = spark.createDataFrame([("capture_tmp_1",), ("capture_tmp_2",), ("photogrammetry_3",)], "directory string")
    taken = spark.createDataFrame([("dataset_2",), ("dataset_9",)], "directory string")
    assert rows_of(published_names(names, taken), "directory", "published") == [
        ("capture_tmp_1", "dataset_1"), ("capture_tmp_2", "dataset_2_saved"), ("photogrammetry_3", "photogrammetry_3")]


def points(spark, frames, size):
    return spark.range(frames * size).select(
        F.concat(F.lit("s"), (F.col("id") % frames % 2).cast("string")).alias("session_id"),
        F.format_string("frame_%06d_1", F.col("id") % frames).alias("frame"), (F.col("id") % frames).alias("frame_ts_ns"),
        F.floor(F.col("id") / frames).alias("i"), (F.col("id") / 7.0).alias("x"), F.lit(-0.5).alias("y"), F.lit(2.0).alias("z"),
        (F.col("id") % 256).cast("int").alias("red"), F.lit(0).alias("green"), F.lit(255).alias("blue"), F.lit(0.25).alias("confidence"))


@pytest.mark.parametrize("slab", [1 << 20, 300, 1])
def test_point_files_round_trip_across_arrow_batches(spark, tmp_path, slab):
    root = str(tmp_path)
    size = 700 if slab > 1 else 7
    table = points(spark, 5, size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        manifest = writers.write_point_clouds(table, root, slab)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted({(r.items, r.file) for r in manifest.collect()}) == [(size, f"frame_{i:06d}_1.ply") for i in range(5)]
    back = readers.read_point_clouds(spark, root)
    columns = ("session_id", "frame", "frame_ts_ns", "i", "x", "y", "z", "red", "green", "blue", "confidence")
    want = table.withColumns({c: F.col(c).cast("float") for c in ("x", "y", "z", "confidence")})
    assert rows_of(back, *columns) == rows_of(want, *columns)


def test_point_file_layout(spark, tmp_path):
    writers.write_point_clouds(points(spark, 1, 2), str(tmp_path))
    data = (tmp_path / "s0" / "frame_000000_1.ply").read_bytes()
    head, body = data.split(b"end_header\n")
    assert b"element vertex 2\n" in head and b"comment raw_depth_timestamp_ns 0\n" in head
    assert RECORD.itemsize == 19 and len(body) == 38
    assert struct.unpack("<fffBBBf", body[:19]) == (0.0, -0.5, 2.0, 0, 0, 255, 0.25)
    assert [p.name for p in (tmp_path / "s0").iterdir() if not p.name.endswith(".crc")] == ["frame_000000_1.ply"]


@pytest.mark.parametrize("slab", [1 << 17, 37])
def test_session_files_are_whole_and_ordered_when_written_in_pieces(spark, tmp_path, monkeypatch, slab):
    root = str(tmp_path)
    monkeypatch.setattr(writers.write_session_files, "__defaults__", (slab,))
    docs = documents(spark, [("hot", i, 4000, f"c{i}.ply") for i in range(400)] + [("small", i, 4000, None) for i in range(3)])
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
        manifest = writers.write_transforms(build_transforms(docs), root, source="test")
        writers.write_trajectory(docs, root)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows_of(manifest, "session_id", "items") == [("hot", 400), ("small", 3)]
    doc = json.loads((tmp_path / "hot" / "transforms.json").read_text())
    assert doc["camera_model"] == "OPENCV" and doc["source"] == "test" and doc["k1"] == 0.0
    assert [f["capture_index"] for f in doc["frames"]] == list(range(400))
    lines = (tmp_path / "hot" / "camera_trajectory.csv").read_text().splitlines()
    assert lines[0].startswith("index,image,point_cloud") and len(lines) == 401
    assert lines[2] == "1,frame_000001_7.jpg,c1.ply,7,8,0.333333333,0.000000000,-1.000000000,0.000000000,0.000000000,0.000000000,1.000000000"
    assert readers.read_trajectory(spark, root).count() == 403
    assert rows_of(readers.transforms_sessions(spark, root), "session_id", "frame_count") == [("hot", 400), ("small", 3)]
    assert readers.read_transforms(spark, root).where("session_id = 'small'").count() == 3
    assert not list((tmp_path / "_pieces").glob("*"))


def test_unreadable_document_fails_its_session(spark, tmp_path):
    writers.write_keyframes(documents(spark, [("a", 1, 4000, None), ("b", 1, 4000, None), ("b", 2, 4000, None)]), str(tmp_path))
    (tmp_path / "b" / "frame_000002_7.json").write_text("{broken")
    docs = readers.read_keyframes(spark, str(tmp_path))
    assert rows_of(validate_sessions(docs, docs), "session_id", "status") == [("a", "ok"), ("b", "finalize failed")]
    text = json.loads((tmp_path / "a" / "frame_000001_7.json").read_text())
    assert text["point_cloud"] is None and text["jpeg_width"] == 4000


def test_publish_renames_once(spark, tmp_path):
    for name in ("capture_tmp_1", "capture_tmp_2", "dataset_2", "photogrammetry_3"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.txt").write_text(name)
    todo = sessions(spark, "capture_tmp_1", "capture_tmp_2", "photogrammetry_3")
    want = [("capture_tmp_1", "dataset_1"), ("capture_tmp_2", "dataset_2_saved"), ("photogrammetry_3", "photogrammetry_3")]
    for _ in range(2):
        assert rows_of(writers.publish_datasets(todo, str(tmp_path)), "session_id", "file") == want
    assert (tmp_path / "dataset_2_saved" / "x.txt").read_text() == "capture_tmp_2"
    assert (tmp_path / "dataset_2" / "x.txt").read_text() == "dataset_2"
    assert (tmp_path / "dataset_1" / ".saved").exists() and not (tmp_path / "capture_tmp_1").exists()


def test_images_and_session_documents(spark, tmp_path):
    root = str(tmp_path)
    photos = spark.createDataFrame([("s", "frame_000003_99.jpg", bytearray(b"abc"))], "session_id string, image string, content binary")
    writers.write_images(photos, root)
    assert rows_of(readers.read_images(spark, root), "capture_index", "timestamp_ns", "length") == [(3, 99, 3)]
    assert bytes(readers.read_images(spark, root, content=True).first().content) == b"abc"
    device = spark.createDataFrame([("s", "Pixel 9", "generic")], "session_id string, model string, capture_profile string")
    writers.write_session_cameras(device, root, "session_device.json")
    writers.write_session_cameras(spark.createDataFrame([("s", "0", None)], "session_id string, camera_id string, jpeg_width int"), root)
    assert sorted(map(str, rows_of(readers.read_session_cameras(spark, root).fillna(""), "camera_id", "model"))) == [
        "('', 'Pixel 9')", "('0', '')"]
    assert '"jpeg_width":null' in (tmp_path / "s" / "session_camera.json").read_text()


def test_trajectory_lines_need_no_session_gathering(spark):
    plan = trajectory_lines(documents(spark, [("s", 1, 1, "c")]))._jdf.queryExecution().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("root", ["/a/b", "file:/a/b", "file:///a/b"])
def test_roots(root):
    assert writers.open_root(root)[1] == "/a/b"


def test_session_documents_per_profile(spark):
    from capturelake.policies import DATASET, HIGHRES_PIXEL10A, PHOTO_GENERIC
    from capturelake.operators.export import session_documents
    base = spark.createDataFrame([("s", 4000, 3000)], "session_id string, jpeg_width int, jpeg_height int")
    assert session_documents(base, DATASET).first().capture_policy.startswith("Prefer 1/500 s")
    high = session_documents(base, HIGHRES_PIXEL10A).first()
    assert (high.profile, high.jpeg_megapixels) == ("pixel_10a_photogrammetry", 12.0)
    photo = session_documents(base, PHOTO_GENERIC).first()
    assert (photo.capture_profile, photo.max_exposure_ns) == ("generic", 12_500_000)


def test_tables_can_be_read_as_streams(spark, tmp_path):
    for read in (readers.read_poses, readers.read_camera_states, readers.read_still_metadata):
        assert read(spark, str(tmp_path), "json", stream=True, max_files=1).isStreaming
