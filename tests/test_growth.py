"""What a step does must not grow faster than its input: tables derived once, no group per file, no copies of views."""

from __future__ import annotations

from helpers import rows_of
from pyspark.sql import functions as F

from capturelake.catalog import streams
from capturelake.functions.pose import pose
from capturelake.operators import points as points_module
from capturelake.operators.points import project_points
from capturelake.sources import json_ranges
from capturelake.streaming.select_stream import stream_dedup_depth


def test_a_replay_derives_its_events_once(spark, monkeypatch):
    monkeypatch.setattr(streams, "ARRIVALS", 10)
    derived = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            derived.add(len(pdf))
            yield pdf

    rows = [(f"s{i % 2}", i, i // 4 * 4) for i in range(60)]
    events = spark.createDataFrame(rows, "session_id string, seq long, timestamp_ns long").mapInPandas(
        count, "session_id string, seq long, timestamp_ns long")
    got = streams.replay(spark, events, stream_dedup_depth)
    assert rows_of(got, "seq") == [(4 * k + s,) for k in range(15) for s in (0, 1)]
    assert derived.value <= 2 * 60  # the range of numbers and the table; six micro-batches


def test_ranges_of_many_files_are_no_groups_of_their_own(spark, tmp_path):
    (tmp_path / "a").write_text("{}")
    ranges = spark.createDataFrame([(str(tmp_path / "a"), 0)], "path string, part long")
    plan = json_ranges.entered(ranges, 100)._jdf.queryExecution().toString()
    assert "FlatMapGroupsIn" not in plan


def test_views_are_not_copied_and_stretches_of_points_keep_all(spark, monkeypatch):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    depth = spark.createDataFrame([("s", k, k) for k in range(3)], "session_id string, frame_id long, seq long")
    k = F.struct(*[F.lit(v).alias(c) for c, v in (("fx", 100.0), ("fy", 100.0), ("cx", 50.0), ("cy", 50.0), ("width", 100), ("height", 100))])
    views = depth.select("session_id", "seq", F.col("frame_id").alias("view_id"), pose(*lit(0, 0, 0, 0, 0, 0, 1)).alias("pose"), k.alias("image_k"))
    cloud = spark.range(60).select(F.lit("s").alias("session_id"), (F.col("id") % 3).alias("frame_id"), F.floor(F.col("id") / 3).alias("i"),
                                   (F.col("id") % 7 / 10).alias("x"), F.lit(0.1).alias("y"), F.lit(-1.0).alias("z"))
    whole = project_points(cloud, views, depth, 2)
    assert "[0,1,2,3,4,5,6,7]" not in whole._jdf.queryExecution().toString()
    want = rows_of(whole, "view_id", "frame_id", "i", "u", "v", "depth_m")
    seen = [(v, f, i) for v in range(3) for f in range(3) if v - 2 < f <= v for i in range(20) if (3 * i + f) % 7 / 10 < 0.5]
    assert sorted(r[:3] for r in want) == seen
    assert rows_of(project_points(cloud.drop("i"), views, depth, 2), "view_id", "frame_id") == sorted(r[:2] for r in seen)
    monkeypatch.setattr(points_module, "PACKED", 3)
    assert rows_of(project_points(cloud, views, depth, 2), "view_id", "frame_id", "i", "u", "v", "depth_m") == want


def test_views_travel_to_blocks_and_not_as_pairs_with_frames(spark, monkeypatch):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    depth = spark.createDataFrame([("s", k, k) for k in range(9)], "session_id string, frame_id long, seq long")
    k = F.struct(*[F.lit(v).alias(c) for c, v in (("fx", 100.0), ("fy", 100.0), ("cx", 50.0), ("cy", 50.0), ("width", 100), ("height", 100))])
    views = depth.select("session_id", "seq", F.col("frame_id").alias("view_id"), pose(*lit(0, 0, 0, 0, 0, 0, 1)).alias("pose"), k.alias("image_k"))
    cloud = spark.range(180).select(F.lit("s").alias("session_id"), (F.col("id") % 9).alias("frame_id"), F.floor(F.col("id") / 9).alias("i"),
                                    (F.col("id") % 7 / 10).alias("x"), F.lit(0.1).alias("y"), F.lit(-1.0).alias("z"))
    seen = project_points(cloud, views, depth, 4)
    mode = spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    steps = seen._jdf.queryExecution().explainString(mode).split("\n\n")
    inputs = [s.split("Input [", 1)[1].split("\n")[0] for s in steps if " Exchange\n" in s or s.split("\n")[0].endswith(" Exchange")]
    assert len(inputs) > 5 and not [i for i in inputs if "frame_id#" in i and ("_m#" in i or "_m0#" in i)]
    want = rows_of(seen, "view_id", "frame_id", "i", "u", "v", "depth_m")
    assert [r[:3] for r in want] == sorted((v, f, i) for v in range(9) for f in range(9) if v - 4 < f <= v
                                           for i in range(20) if (9 * i + f) % 7 / 10 < 0.5)
    for name, value in (("PACKED", 5), ("CELLED", 2), ("LARGE", 4)):  # stretches, cells and frames of their own
        monkeypatch.setattr(points_module, name, value)
        assert rows_of(project_points(cloud, views, depth, 4), "view_id", "frame_id", "i", "u", "v", "depth_m") == want


def test_a_commit_aligns_its_photos_once(spark, monkeypatch, tmp_path):
    from capturelake.plans import commit
    from capturelake.policies import DATASET

    derived = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            derived.add(len(pdf))
            yield pdf

    schema = "session_id string, capture_index int, timestamp_ns long, depth_seq long, depth_timestamp_ns long, outcome string"
    keyframes = spark.createDataFrame([("s", i, i, i, i, "saved") for i in range(8)], schema).mapInPandas(count, schema)
    points = spark.range(8).selectExpr("'s' AS session_id", "id AS depth_seq", "id AS i")
    photos = spark.range(8).selectExpr("'s' AS session_id", "id AS timestamp_ns", "cast('p' AS binary) AS content")
    seen = {}
    for name in ("write_images", "write_keyframes", "write_trajectory"):
        monkeypatch.setattr(commit.writers, name, lambda df, root, name=name: seen.update({name: df.count()}))
    monkeypatch.setattr(commit.writers, "write_point_clouds", lambda df, root: seen.update(
        clouds=df.count()) or spark.createDataFrame([], commit.writers.MANIFEST))
    monkeypatch.setattr(commit, "keyframe_documents", lambda df, policy: df)
    written = commit._write_keyframes(keyframes, points, str(tmp_path), photos, DATASET, F.col("session_id"))
    assert written.select("session_id").distinct().count() == 1
    assert seen == dict.fromkeys(("clouds", "write_images", "write_keyframes", "write_trajectory"), 8)
    assert derived.value <= 2 * 8  # by the job that keeps them, not by every writer
