"""Inputs at the edge: clocks below zero, nulls inside arrays, stray files, lost pieces, hot arrivals."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest
from helpers import fold, frames_table, random_frames
from pyspark.sql import functions as F

from capturelake import session as sessions
from capturelake.operators import select
from capturelake.operators.asof import arrivals_before, nearest
from capturelake.operators.export import build_transforms, published_names, validate_sessions
from capturelake.operators.report import capture_report
from capturelake.operators.select import POSE, REQUEST, select_keyframes
from capturelake.policies import DATASET
from capturelake.sources import readers, writers

DOCUMENT = ("session_id string, capture_index int, image string, point_cloud string, jpeg_width int, jpeg_height int, "
            "jpeg_sensor_timestamp_ns long, arcore_image_intrinsics struct<focal_length_px: array<double>, "
            "principal_point_px: array<double>, image_dimensions: array<int>>, world_from_camera_column_major array<double>")


@pytest.mark.parametrize("width", [13, 19, 1 << 17])
def test_selection_does_not_depend_on_where_the_clock_starts(spark, width):
    rows = [(r[0], r[1], r[2] - 40_000_000_000, *r[3:]) for r in random_frames(3, {"s": 300})]
    got = {(r.session_id, r.seq): r.decision for r in select_keyframes(frames_table(spark, rows), DATASET, width=width).collect()}
    assert got == fold(rows, DATASET)


def test_jumps_decide_as_the_frame_by_frame_fold(monkeypatch):
    draw = np.random.default_rng(4)
    n = 20_000
    ts = np.cumsum(draw.integers(0, 60_000_000, n))
    angle = np.cumsum(draw.normal(0, 0.004, n))
    pdf = pd.DataFrame({"session_id": "s", "seq": np.arange(n) * 2, "timestamp_ns": ts, "_n": np.arange(n) + 1,
                        **{c: np.cumsum(draw.normal(0, 0.004, n)) for c in POSE[:3]},
                        "qx": 0.0, "qy": np.sin(angle / 2), "qz": 0.0, "qw": np.cos(angle / 2)})
    pdf["_block"] = draw.choice(np.array([None, None, None, "motion", "lens", "capture_stopped"], dtype=object), n)
    pdf["_clear"] = np.maximum.accumulate(np.where(draw.random(n) < 0.1, pdf["seq"], select.NEVER))
    for known in (False, True):
        for c in REQUEST:
            pdf[f"_e_{c}"] = pdf[c].iat[0] if c != "timestamp_ns" else -5
        pdf["_e_seq"], pdf["_e_known"] = -2, known
        limits = tuple(getattr(DATASET, t) for t in select.THRESHOLDS)
        for tracked in (False, True):
            batches = [pdf.iloc[:7000], pdf.iloc[7000:7001], pdf.iloc[7001:]]
            fast = pd.concat(list(select._decide(tracked, limits)(iter(batches))))["decision"].tolist()
            monkeypatch.setattr(select, "_forward", lambda part: False)
            slow = pd.concat(list(select._decide(tracked, limits)(iter(batches))))["decision"].tolist()
            monkeypatch.undo()
            assert fast == slow and "requested" in fast


def document(session, **changes):
    base = {"f": [500.0, 501.0], "c": [320.0, 240.0], "d": [640, 480], "m": [float(i) for i in range(16)]} | changes
    return (session, 1, "frame_1.jpg", None, 4000, 3000, 5, (base["f"], base["c"], base["d"]), base["m"])


def test_a_session_with_an_unreadable_number_fails_alone(spark):
    matrix = [float(i) for i in range(16)]
    bad = {"f0": {"f": [None, 1.0]}, "c1": {"c": [1.0, None]}, "d0": {"d": [0, 480]}, "dn": {"d": [640, None]},
           "m": {"m": [*matrix[:7], None, *matrix[8:]]}, "nan": {"m": [float("nan"), *matrix[1:]]},
           "inf": {"f": [float("inf"), 1.0]}, "short": {"c": [1.0]}, "null": {"d": None}}
    df = spark.createDataFrame([document("good"), *[document(s, **c) for s, c in bad.items()]], DOCUMENT)
    status = {r.session_id: r.status for r in validate_sessions(df, df).collect()}
    assert status == {"good": "ok"} | dict.fromkeys(bad, "finalize failed")
    frames = build_transforms(df).collect()
    assert [r.session_id for r in frames] == ["good"] and frames[0].frame.fl_x == 500.0 * 4000 / 640


def test_stray_photo_names_keep_their_row(spark, tmp_path):
    os.makedirs(tmp_path / "s1")
    for name in ("frame_0001_55.jpg", "frame_cover.jpg", "frame_1_99999999999999999999.jpg"):
        (tmp_path / "s1" / name).write_bytes(b"x")
    rows = {r.path.rsplit("/", 1)[1]: (r.capture_index, r.timestamp_ns) for r in readers.read_images(spark, str(tmp_path)).collect()}
    assert rows == {"frame_0001_55.jpg": (1, 55), "frame_cover.jpg": (None, None), "frame_1_99999999999999999999.jpg": (1, None)}


def test_a_lost_piece_is_no_success(tmp_path):
    parts = pd.DataFrame([("s", "a.txt", [{"slab": 0, "piece": "gone", "head": 0, "size": 9}], 5, 0)],
                         columns=["session_id", "file", "parts", "items", "stamp"])
    held = tmp_path / "pieces"
    held.mkdir()
    join = writers._piece_joiner(str(tmp_path), str(held), lambda stamp, n: b"", b"", b"")
    with pytest.raises(FileNotFoundError):
        list(join(iter([parts])))
    (tmp_path / "s").mkdir(exist_ok=True)
    (tmp_path / "s" / "a.txt").write_bytes(b"old")
    with pytest.raises(FileNotFoundError):
        list(join(iter([parts])))
    (tmp_path / "s" / "a.txt").write_bytes(b"123456789")
    assert list(join(iter([parts])))[0]["bytes"].tolist() == [9]


def test_publishing_reports_what_happened(spark, tmp_path):
    for name in ("capture_tmp_a", "capture_tmp_b", "dataset_b", "capture_tmp_c", "dataset_c", "dataset_c_saved", "other"):
        (tmp_path / name).mkdir()
    names = ["capture_tmp_a", "capture_tmp_b", "capture_tmp_c", "capture_tmp_gone", "other", "other_gone"]
    df = spark.createDataFrame([(n,) for n in names], "session_id string")
    first = {r.session_id: (r.file, r.status) for r in writers.publish_datasets(df, str(tmp_path)).collect()}
    assert first == {"capture_tmp_a": ("dataset_a", "published"), "capture_tmp_b": ("dataset_b_saved", "published"),
                     "capture_tmp_c": ("capture_tmp_c", "taken"), "capture_tmp_gone": (None, "missing"),
                     "other": ("other", "published"), "other_gone": (None, "missing")}
    again = {r.session_id: (r.file, r.status) for r in writers.publish_datasets(df, str(tmp_path)).collect()}
    assert again["capture_tmp_a"] == ("dataset_a", "already") and again["capture_tmp_b"] == ("dataset_b_saved", "already")
    assert os.path.isdir(tmp_path / "capture_tmp_c")


def test_long_directory_names_are_not_cut(spark):
    long = "capture_tmp_" + "x" * ((1 << 20) + 5)
    names = spark.createDataFrame([(long,)], "directory string")
    out = published_names(names, names.limit(0)).select(F.length("published").alias("n")).first()
    assert out.n == len("dataset_") + (1 << 20) + 5


def test_report_has_sessions_without_frames(spark):
    decisions = spark.createDataFrame([("a", 1, "requested")], "session_id string, seq long, decision string")
    keyframes = spark.createDataFrame([("b", "saved"), ("b", "pending_pose")], "session_id string, outcome string")
    depth = spark.createDataFrame([("c", 1)], "session_id string, seq long")
    done = spark.createDataFrame([("b",)], "session_id string")
    every = spark.createDataFrame([("d",), ("a",)], "session_id string")
    rows = {r.session_id: (r.frames, r.last_decision, r.keyframes, r.depth_frames, r.finalized)
            for r in capture_report(decisions, keyframes, depth, done, every).collect()}
    assert rows == {"a": (1, "requested", 0, 0, False), "b": (0, None, 1, 0, True), "c": (0, None, 0, 1, False),
                    "d": (0, None, 0, 0, False)}


def test_wide_tolerances(spark):
    images = spark.createDataFrame([("s", 1, 0), ("s", 2, 60_000_000_000)], "session_id string, seq long, timestamp_ns long")
    poses = spark.createDataFrame([("s", 3, 20_000_000_000)], "session_id string, seq long, timestamp_ns long")
    rows = {r.seq: r.p_seq for r in nearest(images, {"p": (poses, 30_000_000_000)}).collect()}
    assert rows == {1: 3, 2: None}
    assert {r.seq: r.p_seq for r in nearest(images, {"p": (poses, 50_000_000_000)}).collect()} == {1: 3, 2: 3}


def test_images_that_wait_or_share_an_arrival_are_ranked_once(spark):
    rows = spark.range(5000).selectExpr("'s' AS session_id", "id AS seq", "id AS timestamp_ns",
                                        "CASE WHEN id % 2 = 0 THEN 40L END AS at_seq")
    samples = spark.range(100).selectExpr("'s' AS session_id", "id AS seq")
    out = arrivals_before(rows, {"p": samples}, width=16)
    assert out.groupBy("at_seq", "p_rank").count().orderBy("at_seq").collect() == [(None, 0, 2500), (40, 41, 2500)]


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class Held:
                    @staticmethod
                    def getCheckpointDir():
                        class No:
                            isDefined = staticmethod(lambda: False)
                        return No
                return Held

    class Session:
        sparkContext = Context

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sessions.checkpoint_dir(Session)


def test_transforms_by_line_are_those_of_the_whole_document(spark, tmp_path):
    docs = spark.createDataFrame([(s, i, f"frame_{i}.jpg", None, 4000, 3000, i, ([500.0, 501.0], [320.0, 240.0], [640, 480]),
                                   [float(j) for j in range(16)]) for s in ("a", "b") for i in range(1, 40)], DOCUMENT)
    writers.write_transforms(build_transforms(docs), str(tmp_path), "x, y")
    whole = sorted(map(str, readers.read_transforms(spark, str(tmp_path)).collect()))
    assert len(whole) == 78
    assert sorted(map(str, readers.read_transforms(spark, str(tmp_path), lines=True).collect())) == whole


@pytest.mark.parametrize("records", [1, 7, 50, 1 << 20])
def test_point_files_are_read_in_ranges(spark, tmp_path, records):
    points = spark.range(50).selectExpr(
        "'s' AS session_id", "'frame_000001_5' AS frame", "5L AS frame_ts_ns", "id AS i", "id * 0.5D AS x", "1.0D AS y", "2.0D AS z",
        "id AS red", "2 AS green", "3 AS blue", "0.5D AS confidence")
    writers.write_point_clouds(points, str(tmp_path))
    back = readers.read_point_clouds(spark, str(tmp_path), records).orderBy("i").collect()
    assert [(r.session_id, r.frame, r.frame_ts_ns, r.i, r.x, r.red) for r in back] == [
        ("s", "frame_000001_5", 5, i, i * 0.5, i) for i in range(50)]
