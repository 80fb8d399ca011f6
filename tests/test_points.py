"""Depth frames to points: decoding, padding, world coordinates, display and projection."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from helpers import rows_of, stamps
from pyspark.sql import functions as F

from capturelake import schemas
from capturelake.functions.pose import pose
from capturelake.operators.points import (color_pixels, explode_depth_frames, frame_matrices, point_counts,
                                          points_per_view, project_points, session_cloud, unproject_pixels,
                                          view_frames, world_points, zip_points_colors)

W, H, CW, CH = 7, 5, 15, 10
K = (500.0, 400.0, 320.0, 240.0, 640, 480)
LAYOUTS = [(W + 3, 1, CW + 1, 1, CW + 2, 2, CW + 3, 2), (W * 2, 2, CW, 1, CW, 1, CW, 1)]


def frame(rng, frame_id, layout, missing=None):
    depth = rng.integers(0, 65536, W * H).astype("<u2")
    depth[rng.random(W * H) < 0.3] = 0
    cs, cp, ys, yp, us, up, vs, vp = layout
    planes = {"depth16": depth.tobytes(), "confidence": rng.bytes(cs * H), "y_plane": rng.bytes(ys * CH),
              "u_plane": rng.bytes(us * CH), "v_plane": rng.bytes(vs * CH)}
    if missing:
        planes[missing] = None
    return ("s", frame_id, frame_id, frame_id * 10, W, H, planes["depth16"], planes["confidence"], cs, cp,
            planes["y_plane"], planes["u_plane"], planes["v_plane"], ys, yp, us, up, vs, vp, CW, 0.6, 9.4,
            K, (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0))


def by_hand(row, limit, unsigned):
    (_, fid, _, _, w, h, depth, conf, cs, cp, yp_, up_, vp_, ys, yp, us, up, vs, vp, cw, lo, hi, *_) = row
    mm = np.frombuffer(depth, "<u2" if unsigned else "<i2")
    step = max(1, int(np.ceil(np.sqrt(w * h / limit))))
    lo, hi = int(np.floor(lo + 0.5)), int(np.floor(hi + 0.5))
    out = []
    for y in range(0, h, step):
        for x in range(0, w, step):
            d = int(mm[y * w + x])
            if d:
                cx, cy = x * cw // w, lo + y * (hi - lo) // h
                out.append((fid, len(out), x, y, d, conf[y * cs + x * cp], yp_[cy * ys + cx * yp],
                            up_[cy // 2 * us + cx // 2 * up], vp_[cy // 2 * vs + cx // 2 * vp]))
    return out


COLUMNS = ("frame_id", "i", "x", "y", "depth_mm", "confidence", "yy", "uu", "vv")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    return [frame(rng, i, LAYOUTS[i % 2]) for i in range(1, 9)] + [
        frame(rng, 20, LAYOUTS[0], "y_plane"), frame(rng, 21, LAYOUTS[0], "depth16")]


@pytest.mark.parametrize("limit,unsigned", [(15_000, False), (15_000, True), (9, False)])
def test_decoding_equals_a_pixel_loop(spark, rows, limit, unsigned):
    table = spark.createDataFrame(rows, schemas.DEPTH_FRAMES).repartition(2)
    want = sorted(p for r in rows[:8] for p in by_hand(r, limit, unsigned))
    assert rows_of(explode_depth_frames(table, limit, unsigned), *COLUMNS) == want


def test_padding_fills_the_grid_behind_the_points(spark, rows):
    table = spark.createDataFrame(rows, schemas.DEPTH_FRAMES)
    padded = explode_depth_frames(table, pad=True)
    assert {n for (n,) in rows_of(point_counts(padded), "point_count")} == {W * H}
    valid = sorted(p for r in rows[:8] for p in by_hand(r, 15_000, False))
    assert rows_of(padded.where("depth_mm <> 0"), *COLUMNS) == valid
    points = color_pixels(unproject_pixels(padded, sampled=True, pad=True))
    empty = points.where("depth_mm = 0")
    assert rows_of(empty.select("x_m", "y_m", "red", "green", "blue", "confidence").distinct(),
                   "x_m", "y_m", "red", "green", "blue", "confidence") == [(0.0, 0.0, 0, 0, 0, 0.0)]
    # In session coordinates they lie at the camera itself.
    placed = world_points(points.withColumn("root", F.col("pose")).transform(frame_matrices))
    assert rows_of(placed.where("depth_mm = 0").select("x", "y", "z").distinct(), "x", "y", "z") == [(0.0, 0.0, 0.0)]


def test_decoded_frames_follow_the_table_path(spark, rows):
    """Unprojecting decoded pixels equals unprojecting pixel rows joined to their frame."""
    table = spark.createDataFrame(rows, schemas.DEPTH_FRAMES)
    direct = unproject_pixels(explode_depth_frames(table, limit=9), sampled=True)
    pixels = explode_depth_frames(table).select("session_id", *COLUMNS)
    side = table.select("session_id", "frame_id", "texture_k", F.col("width").alias("depth_width"), F.col("height").alias("depth_height"))
    joined = unproject_pixels(pixels, side, limit=9)
    columns = ("frame_id", "x", "y", "x_m", "y_m", "z_m", "confidence")
    assert rows_of(direct, *columns) == rows_of(joined, *columns)


def cloud(spark, rows):
    return spark.createDataFrame(rows, "session_id string, frame_id long, i long, x double, y double, z double, confidence double")


def test_session_cloud_keeps_newest_frames_and_threshold(spark):
    points = cloud(spark, [("s", f, i, 0.0, 0.0, 0.0, c) for f in range(6) for i, c in enumerate((0.1, 0.09, 0.5))])
    depth = stamps(spark, [("s", f, f) for f in range(6)]).withColumn("frame_id", F.col("seq"))
    for width in (2, 100):
        assert rows_of(session_cloud(points, depth, 2, width=width), "frame_id", "i") == [(4, 0), (4, 2), (5, 0), (5, 2)]


def views(spark, seqs):
    k = F.struct(F.lit(100.0).alias("fx"), F.lit(100.0).alias("fy"), F.lit(50.0).alias("cx"), F.lit(50.0).alias("cy"),
                 F.lit(100).alias("width"), F.lit(100).alias("height"))
    flat = spark.createDataFrame([("s", q, q, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0) for q in seqs],
                                 "session_id string, seq long, view_id long, tx double, ty double, tz double, qx double, "
                                 "qy double, qz double, qw double")
    return flat.select("session_id", "seq", "view_id", pose().alias("pose"), k.alias("image_k"))


@pytest.mark.parametrize("n,width", [(3, 2), (3, 100), (4, 5), (1, 100)])
def test_view_sees_the_newest_frames_of_its_time(spark, n, width):
    depth = stamps(spark, [("s", f, f) for f in range(0, 20, 2)]).withColumn("frame_id", F.col("seq"))
    got = rows_of(view_frames(views(spark, [0, 5, 11, 30]), depth, n, width), "view_id", "frame_id")
    want = sorted((v, f) for v in (0, 5, 11, 30) for f in [x for x in range(0, 20, 2) if x <= v][-n:])
    assert got == want


def test_projection(spark):
    depth = stamps(spark, [("s", 1, 1)]).withColumn("frame_id", F.lit(1).cast("long"))
    # The view stands at z = 1 and looks along −Z: depth of a point is 1 − z.
    inside = [("s", 1, 0, 0.0, 0.0, 0.0, 1.0), ("s", 1, 1, 0.49, 0.5, 0.0, 1.0), ("s", 1, 2, 0.0, 0.0, -99.0, 1.0)]
    outside = [("s", 1, 3, 0.51, 0.0, 0.0, 1.0), ("s", 1, 4, 0.0, 0.0, 0.95, 1.0), ("s", 1, 5, 0.0, 0.0, 2.0, 1.0),
               ("s", 1, 6, 0.0, 0.0, -99.5, 1.0), ("s", 1, 7, 0.0, -0.51, 0.0, 1.0)]
    seen = project_points(cloud(spark, inside + outside), views(spark, [2]), depth)
    assert [(i, round(u, 6), round(v, 6)) for i, u, v in rows_of(seen, "i", "u", "v")] == [
        (0, 50.0, 50.0), (1, 99.0, 0.0), (2, 50.0, 50.0)]
    assert rows_of(points_per_view(seen), "view_id", "points_seen") == [(2, 3)]


@pytest.mark.parametrize("edge", [0.05, 0.5, 1000.0])
def test_cells_that_are_tested_first_lose_no_point(spark, edge):
    """Views turned any way and points anywhere, some near the planes: the rows are those of a loop over all of them."""
    rng = random.Random(4)
    spots = [("s", f, i, *(rng.choice((0.0, 0.5, rng.uniform(-3, 3))) + 2 * f * (c == 0) for c in range(3)), 1.0)
             for f in range(6) for i in range(40)]
    odd = [("s", 0, 99, None, 0.0, 0.0, 1.0), ("s", 1, 99, float("nan"), 0.0, 0.0, 1.0)]
    depth = stamps(spark, [("s", f, f) for f in range(6)]).withColumn("frame_id", F.col("seq"))
    turned = 0.7 * F.col("seq")
    placed = views(spark, range(6, 12)).select("session_id", "seq", "view_id", "image_k", F.struct(
        (F.col("seq") - 6.0).alias("tx"), F.lit(0.0).alias("ty"), F.lit(1.0).alias("tz"), F.lit(0.0).alias("qx"),
        F.sin(turned).alias("qy"), F.lit(0.0).alias("qz"), F.cos(turned).alias("qw")).alias("pose"))
    want = []
    for view in range(6, 12):
        s, c = math.sin(2 * 0.7 * view), math.cos(2 * 0.7 * view)
        for _, f, i, x, y, z, _ in spots:
            x, z = x - (view - 6.0), z - 1.0
            right, ahead = c * x - s * z, -(s * x + c * z)
            if 0.1 <= ahead <= 100 and 0 <= 50 + 100 * right / ahead < 100 and 0 <= 50 - 100 * y / ahead < 100:
                want.append((view, f, i))
    seen = project_points(cloud(spark, spots + odd), placed, depth, edge=edge)
    got = [r for r in rows_of(seen, "view_id", "frame_id", "i") if r[2] != 99]
    assert got == sorted(want) and len(got) > 50


def test_scattered_frames_are_pruned_before_the_projection(spark):
    """Frames in rooms side by side, views that look at one each: at most half of the points meet a view."""
    from capturelake.functions.pose import inverse_parts, parts, pose_matrix, with_pose
    from capturelake.operators.points import cell_code, shown_cells

    spots = [("s", f, i, 10.0 * f + 0.01 * i, 0.02 * i, 0.0, 1.0) for f in range(10) for i in range(50)]
    depth = stamps(spark, [("s", f, f) for f in range(10)]).withColumn("frame_id", F.col("seq"))
    placed = with_pose(views(spark, [20]), "_inverse", inverse_parts(parts(F.col("pose")))).select(
        "session_id", "seq", "view_id", "image_k", pose_matrix(F.col("_inverse")).alias("_m"))
    points = cloud(spark, spots)
    shown = view_frames(placed, depth)
    kept = shown_cells(points, shown)
    entering = points.withColumn("_cell", cell_code()).join(kept, ["session_id", "frame_id", "_cell"])
    assert shown.count() == 10 and {r.frame_id for r in kept.collect()} == {0} and 0 < entering.count() <= 250 // 5


def test_cell_codes_tell_cells_apart(spark):
    from capturelake.operators.points import cell_code

    spots = [("s", 0, 0, x * 0.5 + 0.1, y * 0.5, z * 0.5 + 0.49, 1.0) for x in range(-4, 5) for y in range(-4, 5) for z in range(-3, 3)]
    codes = [r[0] for r in cloud(spark, spots).select(cell_code(0.5)).collect()]
    assert len(set(codes)) == len(codes)
    assert cloud(spark, [("s", 0, 0, 0.6, 0.0, 0.0, 1.0)]).select(cell_code(0.5)).first()[0] == 1


def test_zip_cuts_the_longer_side(spark):
    points = cloud(spark, [("s", 1, i, 0.0, 0.0, 0.0, 1.0) for i in range(4)])
    colors = spark.createDataFrame([("s", 1, i, 9) for i in range(3)], "session_id string, frame_id long, i long, red int")
    assert zip_points_colors(points, colors).count() == 3
