"""Pose algebra, imaging formulas, gates, planning and catalogue choices."""

from __future__ import annotations

import math

import pytest
from helpers import rows_of, single
from pyspark.sql import functions as F

from capturelake.functions import imaging as im
from capturelake.functions import planning as pl
from capturelake.functions import pose as ps
from capturelake.operators.choose import choose_camera_config, choose_jpeg_size
from capturelake.operators.gates import (is_focused, is_frame_sharp, is_pose_stable, is_still_sharp, min_confidence,
                                         on_grid, valid_depth, viewpoint_changed)
from capturelake.plans.exposure import exposure_plan
from capturelake.policies import (DATASET, HIGHRES_GENERIC, HIGHRES_PIXEL10A, PHOTO_GENERIC, PHOTO_PIXEL10A,
                                  resolve_policy)

H = math.sqrt(0.5)


def p(*v):
    return ps.pose(*[F.lit(float(x)) for x in v])


A = (1, 2, 3, 0.0, H, 0.0, H)
B = (-2, 0.5, 1, 0.5, 0.5, 0.5, 0.5)


def test_inverse_composes_to_identity(spark):
    ident = single(spark, v=ps.pose_compose(ps.pose_inverse(p(*B)), p(*B))).v
    assert [round(x, 12) + 0.0 for x in ident] == [0, 0, 0, 0, 0, 0, 1]


def test_matrix_of_composition_is_the_product(spark):
    r = single(spark, a=ps.pose_matrix(p(*A)), b=ps.pose_matrix(p(*B)), ab=ps.pose_matrix(ps.pose_compose(p(*A), p(*B))))
    for col in range(4):
        for row in range(4):
            want = sum(r.a[k * 4 + row] * r.b[col * 4 + k] for k in range(4))
            assert r.ab[col * 4 + row] == pytest.approx(want)


def test_rotation_conventions(spark):
    # A quarter turn about +Y looks along −X; without rotation along −Z with +Y up.
    r = single(spark, f=ps.forward_world(p(*A)), u=ps.up_world(p(*A)), i=ps.forward_world(p(0, 0, 0, 0, 0, 0, 1)))
    assert [round(x, 9) + 0.0 for x in r.f] == [-1, 0, 0]
    assert [round(x, 9) + 0.0 for x in r.u] == [0, 1, 0]
    assert [round(x, 9) + 0.0 for x in r.i] == [0, 0, -1]


def test_distances(spark):
    half = math.radians(30) / 2
    r = single(spark, d=ps.translation_distance(p(0, 0, 0, 0, 0, 0, 1), p(3, 4, 0, 0, 0, 0, 1)),
               a=ps.rotation_degrees(p(0, 0, 0, 0, 0, 0, 1), p(0, 0, 0, 0, math.sin(half), 0, math.cos(half))),
               n=ps.rotation_degrees(p(0, 0, 0, 0, 0, 0, 1), p(0, 0, 0, 0, 0, 0, -1)))
    assert r.d == 5 and r.a == pytest.approx(30) and r.n == 0


def test_matrix_rows(spark):
    m = F.array(*[F.lit(float(i)) for i in range(16)])
    r = single(spark, ok=ps.column_major_to_rows(m), bad=ps.column_major_to_rows(F.slice(m, 1, 15)))
    assert r.ok == [[0, 4, 8, 12], [1, 5, 9, 13], [2, 6, 10, 14], [3, 7, 11, 15]] and r.bad is None


def test_steps_and_rounding(spark):
    def step(w, h):
        return im.subsample_step(F.lit(w), F.lit(h))
    r = single(spark, a=step(160, 90), b=step(640, 480), c=step(1, 1), d=im.sampled_dim(F.lit(7), F.lit(3)),
               n=im.java_round(F.lit(-0.5)), h=im.java_round(F.lit(2.5)))
    assert (r.a, r.b, r.c, r.d, r.n, r.h) == (1, 5, 1, 3, 0, 3)


def test_unproject_then_project_returns_the_pixel(spark):
    k = F.struct(F.lit(125.0).alias("fx"), F.lit(94.0).alias("fy"), F.lit(80.0).alias("cx"), F.lit(45.0).alias("cy"))
    x, y, z = im.unproject(F.lit(13), F.lit(77), F.lit(1500), k)
    r = single(spark, u=F.lit(80.0) + F.lit(125.0) * x / -z, v=F.lit(45.0) - F.lit(94.0) * y / -z, z=z)
    assert (r.u, r.v, r.z) == (pytest.approx(13), pytest.approx(77), -1.5)


def test_colour(spark):
    def rgb(y, u, v):
        return F.array(*[im.to_byte(c).cast("int") for c in im.yuv_to_rgb(F.lit(y), F.lit(u), F.lit(v))])
    r = single(spark, white=rgb(255, 128, 128), black=rgb(0, 128, 128), red=rgb(76, 84, 255), over=im.to_byte(F.lit(1.7)),
               conf=im.norm_confidence(F.lit(-1)))
    assert min(r.white) >= 253 and max(r.black) <= 2
    assert r.red[0] > 250 and r.red[1] < 60 and r.over == 255 and r.conf == 1.0


def test_color_coord(spark):
    c = im.color_coord(F.lit(159), F.lit(89), F.lit(640), F.lit(160), F.lit(90), F.lit(59.5), F.lit(420.4))
    assert tuple(single(spark, a=c[0], b=c[1], c=c[2], d=c[3])) == (636, 416, 318, 208)


def test_names_and_orientation(spark):
    r = single(spark, n=im.frame_name(F.lit(7), F.lit(123).cast("long")), a=im.jpeg_orientation(F.lit(90), F.lit(270)),
               b=im.jpeg_orientation(F.lit(None).cast("int"), F.lit(0)), m=im.megapixels(F.lit(4000), F.lit(3000)),
               s=im.session_name(F.lit("2024-05-06 07:08:09").cast("timestamp")),
               f=im.is_four_by_three(F.lit(3000), F.lit(4000)), g=im.is_four_by_three(F.lit(1920), F.lit(1080)))
    assert tuple(r) == ("frame_000007_123", 180, 90, 12.0, "20240506_070809", True, False)


@pytest.mark.parametrize("field,value,dataset", [
    (None, None, True), ("exposure_time_ns", None, False), ("exposure_time_ns", 4_000_000, True),
    ("exposure_time_ns", 4_000_001, False), ("iso", None, False), ("iso", 3200, True), ("iso", 3201, False),
    ("lens_state", None, True), ("lens_state", 1, False), ("ois_mode", None, True), ("ois_mode", 1, False),
    ("video_stabilization_mode", None, True), ("video_stabilization_mode", 1, False), ("af_state", None, True),
    ("af_state", 4, True), ("af_state", 1, False), ("af_state", 5, False)])
def test_still_gate_nulls(spark, field, value, dataset):
    row = {"exposure_time_ns": 10**6, "iso": 100, "lens_state": 0, "ois_mode": 0, "video_stabilization_mode": 0, "af_state": 2}
    if field:
        row[field] = value
    table = spark.range(1).select(*[F.lit(v).cast("long").alias(c) for c, v in row.items()])
    assert table.select(is_still_sharp(DATASET)).first()[0] is dataset


def test_frame_gates(spark):
    table = spark.createDataFrame(
        [(0, 0.25, 20.0, None, None, None), (1, 0.26, 0.0, 1, 0, 0), (2, 0.1, 8.0, 12_500_001, 0, 0), (3, 0.1, 8.0, 1, 1, 0),
         (4, 0.1, 8.0, 1, 0, 3), (5, 0.1, 8.0, None, None, None)],
        "i int, linear_mps double, angular_dps double, exposure_time_ns long, lens_state int, af_state int")
    got = rows_of(table.select("i", is_frame_sharp(PHOTO_GENERIC).alias("f"), is_pose_stable(DATASET).alias("s")), "f", "s", "i")
    assert {i: (f, s) for f, s, i in got} == {0: (False, True), 1: (False, False), 2: (False, True), 3: (False, False),
                                              4: (False, False), 5: (True, True)}
    r = single(spark, a=is_focused(F.lit(None).cast("int"), False), b=is_focused(F.lit(None).cast("int"), True))
    assert tuple(r) == (False, True)


def test_viewpoint(spark):
    def changed(ts, last_ts, x):
        last = p(0, 0, 0, 0, 0, 0, 1) if last_ts is not None else F.lit(None).cast(
            "struct<tx:double,ty:double,tz:double,qx:double,qy:double,qz:double,qw:double>")
        return viewpoint_changed(p(x, 0, 0, 0, 0, 0, 1), F.lit(ts), last, F.lit(last_ts).cast("long"), DATASET)
    r = single(spark, first=changed(0, None, 0), still=changed(10**9, 0, 0.02), moved=changed(10**9, 0, 0.03125),
               forced=changed(2 * 10**9, 0, 0))
    assert tuple(r) == (True, False, True, True)


def test_pixel_filters(spark):
    px = spark.createDataFrame([(0, 0.1), (-1, 0.05), (5, 0.2)], "depth_mm int, confidence double")
    assert rows_of(valid_depth(px), "depth_mm") == [(-1,), (5,)]
    assert rows_of(min_confidence(px), "confidence") == [(0.1,), (0.2,)]
    grid = spark.range(20).select(on_grid(F.col("id"), F.lit(0), F.lit(640), F.lit(480)).alias("k"), "id")
    assert rows_of(grid.where("k"), "id") == [(0,), (5,), (10,), (15,)]


def plan(spark, exposure, iso, lo_e=100_000, hi_e=10**9, lo_i=100, hi_i=6400, policy=DATASET, **over):
    state = {"exposure_time_ns": exposure, "iso": iso, "focus_distance": 1.0, "lens_state": 0, "af_state": 2}
    caps = {"exposure_min": lo_e, "exposure_max": hi_e, "iso_min": lo_i, "iso_max": hi_i}
    state.update({k: v for k, v in over.items() if k in state})
    types = dict.fromkeys(state, "int") | {"exposure_time_ns": "long", "focus_distance": "double"}
    out = single(spark, v=pl.plan_exposure(
        {k: F.lit(v).cast(types[k]) for k, v in state.items()},
        {k: F.lit(v).cast("long") for k, v in caps.items()} | {"manual": F.lit(over.get("manual", True))}, policy)).v
    return tuple(out)


@pytest.mark.parametrize("args,kw,want", [
    ((10_000_000, 100), {}, (2_000_000, 500, "ok")),                      # 1/100 s moves to the target
    ((1_000_000, 50), {}, (500_000, 100, "ok")),                          # bright: lowest ISO, shorter exposure
    ((33_000_000, 300), {}, (3_093_750, 3200, "ok")),                     # dark: highest ISO, longer exposure
    ((33_000_000, 400), {}, (None, None, "too_dark")),
    ((10_000_000, 100), {"manual": False}, (None, None, "manual_unsupported")),
    ((None, 100), {}, (None, None, "no_metadata")),
    ((10_000_000, 100), {"focus_distance": None}, (None, None, "no_metadata")),
    ((10_000_000, 100), {"lens_state": 1}, (None, None, "lens_moving")),
    ((10_000_000, 100), {"lens_state": None}, (2_000_000, 500, "ok")),
    ((10_000_000, 100), {"af_state": 1}, (None, None, "af_not_converged")),
    ((10_000_000, 100), {"af_state": None}, (2_000_000, 500, "ok")),
    ((10_000_000, 100), {"af_state": None, "policy": HIGHRES_GENERIC}, (None, None, "af_not_converged")),
    ((10_000_000, 100), {"lo_e": None}, (None, None, "range_unavailable")),
    ((10_000_000, 100), {"lo_e": 5_000_000}, (None, None, "range_invalid")),
    ((10_000_000, 100), {"lo_i": 3300}, (None, None, "range_invalid")),
])
def test_exposure_plan_cases(spark, args, kw, want):
    assert plan(spark, *args, **kw) == want


def test_exposure_plan_uses_the_state_at_the_request(spark):
    states = spark.createDataFrame([("s", 1, 10**7, 100, -2.0, 2, 0), ("s", 5, 2 * 10**7, None, 9.0, None, None)],
                                   "session_id string, seq long, exposure_time_ns long, iso int, focus_distance double, "
                                   "af_state int, lens_state int")
    asks = spark.createDataFrame([("s", 0, "c"), ("s", 3, "c"), ("s", 6, "c")], "session_id string, seq long, camera_id string")
    caps = spark.createDataFrame([("c", 100_000, 10**8, 100, 6400, 8.0, [1], [0], None)],
                                 "camera_id string, exposure_min long, exposure_max long, iso_min int, iso_max int, "
                                 "min_focus_distance double, capabilities array<int>, ois_modes array<int>, sensor_orientation int")
    for width in (1, 2, 1 << 17):
        got = rows_of(exposure_plan(asks, states, caps, width=width), "seq", "reason", "planned_iso", "planned_focus",
                      "ois_can_be_off", "sensor_orientation_degrees")
        assert got == [(0, "no_metadata", None, None, True, 90), (3, "ok", 500, 0.0, True, 90), (6, "ok", 1000, 8.0, True, 90)]


def sizes(spark, *rows):
    return spark.createDataFrame([("c", i, w, h) for i, (w, h) in enumerate(rows)],
                                 "camera_id string, ord long, width int, height int")


@pytest.mark.parametrize("rows,want", [
    ([(640, 480), (4000, 3000), (4080, 2296), (8000, 6000)], (1, 0)), ([(1920, 1080), (4080, 2296), (8000, 6000)], (1, 1)),
    ([(9000, 6000), (8000, 6000), (8000, 6000)], (2, 2)), ([(4000, 3000), (4000, 3000)], (0, 0))])
def test_jpeg_size_tiers(spark, rows, want):
    assert rows_of(choose_jpeg_size(sizes(spark, *rows)), "ord", "tier") == [want]


def test_camera_config(spark):
    schema = "device_id string, ord long, camera_id string, fps int, depth_sensor_used boolean, cpu_w int, cpu_h int, gpu_w int, gpu_h int"
    rows = [("same", 0, "1", 30, False, 320, 240, 640, 480), ("same", 1, "0", 30, False, 640, 480, 1280, 720),
            ("same", 2, "0", 30, False, 640, 480, 1920, 1080), ("same", 3, "0", 30, False, 640, 480, 1920, 1080),
            ("same", 4, "0", 60, False, 10, 10, 9999, 9999), ("other", 5, "1", 30, False, 640, 480, 1280, 720),
            ("none", 6, "0", 60, False, 640, 480, 1280, 720), ("none", 7, "0", 30, True, 640, 480, 1280, 720)]
    current = [(d, 99, "0", 1, 1, 1, 1) for d in ("same", "other", "none", "absent")]
    got = choose_camera_config(spark.createDataFrame(rows, schema), spark.createDataFrame(
        current, "device_id string, ord long, camera_id string, cpu_w int, cpu_h int, gpu_w int, gpu_h int"))
    assert rows_of(got, "device_id", "ord", "choice") == [
        ("absent", 99, "current"), ("none", 99, "current"), ("other", 5, "any_camera"), ("same", 2, "same_camera")]


def test_policy_by_device(spark):
    rows = [("a", "dataset", None), ("b", "highres", "Google Pixel 10A Pro"), ("c", "highres", "Pixel 9"),
            ("d", "photo", "PIXEL 10a"), ("e", "photo", None), ("f", "unknown", None)]
    table = resolve_policy(spark.createDataFrame(rows, "session_id string, profile string, model string"))
    got = {r.session_id: r.policy and (r.policy.max_angular_dps, r.policy.max_exposure_ns) for r in table.collect()}
    want = {k: (p.max_angular_dps, p.max_exposure_ns) for k, p in zip(
        "abcde", (DATASET, HIGHRES_PIXEL10A, HIGHRES_GENERIC, PHOTO_PIXEL10A, PHOTO_GENERIC))}
    assert got == want | {"f": None}
