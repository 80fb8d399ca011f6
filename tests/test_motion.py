"""Ordered features: any chunk width gives the single-chunk result."""

from __future__ import annotations

import pytest
from helpers import frames_table, random_frames, rows_of, stamps
from pyspark.sql import functions as F

from capturelake.functions.pose import pose
from capturelake.operators.gates import capture_enabled
from capturelake.operators.motion import (attach_root, last_n, latest_camera_state, motion, new_depth_only,
                                          root_relative, session_roots, time_since_last)
from capturelake.operators.report import recent_log_lines
from capturelake.plans.chunks import Running, attach, chunk_of, running

SESSIONS = {"hot": 120, "a": 25, "b": 1}
WIDTHS = [1, 3, 16, 1 << 17]


def frames(spark, seed=1, **kw):
    return frames_table(spark, random_frames(seed, SESSIONS, **kw))


@pytest.mark.parametrize("width,coarse", [(1, 4), (3, 2), (5, 1), (16, 1 << 20), (1 << 17, 1 << 20)])
@pytest.mark.parametrize("reverse", [False, True])
def test_running_equals_plain_loop(spark, width, coarse, reverse):
    rows = [(r[0], r[1], r[2], r[3]) for r in random_frames(2, SESSIONS)]
    table = spark.createDataFrame(rows, "session_id string, seq long, ts long, v int")
    specs = [Running("l", "last", F.col("v")), Running("lx", "last", F.col("v"), inclusive=False),
             Running("s", "sum", F.col("v")), Running("n", "min", F.col("ts")), Running("m", "max", F.col("ts")),
             Running("st", "last", F.struct("v", F.struct("ts").alias("in")), inclusive=False)]
    got = {(r.session_id, r.seq): r for r in running(table, specs, width=width, reverse=reverse, coarse=coarse).collect()}
    assert len(got) == len(rows)
    for s in SESSIONS:
        last, total, lo, hi, before = None, 0, None, None, None
        for _, seq, ts, v in sorted((r for r in rows if r[0] == s), key=lambda r: r[1], reverse=reverse):
            r = got[(s, seq)]
            assert r.lx == last
            assert (None if r.st is None else (r.st.v, r.st["in"].ts)) == before
            last = v if v is not None else last
            total += v or 0
            lo, hi = min(ts, lo if lo is not None else ts), max(ts, hi if hi is not None else ts)
            before = (v, ts)
            assert (r.l, r.s, r.n, r.m) == (last, total, lo, hi)


def test_chunk_of_floors_negative_values(spark):
    got = spark.createDataFrame([(-1,), (-8,), (0,), (7,), (8,)], "v long").select("v", chunk_of("v", 8).alias("c"))
    assert dict(got.collect()) == {-1: -1, -8: -1, 0: 0, 7: 0, 8: 1}


@pytest.mark.parametrize("salts", [1, 3, 64])
def test_attach(spark, salts):
    table = stamps(spark, [("hot", i, i) for i in range(50)] + [("a", 99, 1), ("none", 100, 1)])
    stats = spark.createDataFrame([("hot", 1), ("a", 2)], "session_id string, n int")
    got = rows_of(attach(table, stats, by=["seq"], salts=salts).groupBy("session_id", "n").count(), "session_id", "n", "count")
    assert rows_of(attach(table, stats, by=["seq"], how="inner").groupBy("n").count(), "n", "count") == [(1, 50), (2, 1)]
    assert got == [("a", 2, 1), ("hot", 1, 50), ("none", None, 1)]


@pytest.mark.parametrize("jitter", [False, True])
def test_motion_over_chunks(spark, jitter):
    table = frames(spark, 3, jitter=jitter)
    columns = ("session_id", "seq", "linear_mps", "angular_dps")
    whole = rows_of(motion(table), *columns)
    for width in (1, 7):
        assert rows_of(motion(table, width), *columns) == whole


def test_motion_is_zero_without_a_previous_frame_or_time_step(spark):
    rows = [("s", i, ts, 0, 0, float(x), 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)
            for i, (ts, x) in enumerate([(10**9, 0), (10**9, 5), (5 * 10**8, 9), (10**9, 10)])]
    got = rows_of(motion(frames_table(spark, rows)), "seq", "linear_mps")
    # The frame with an earlier clock still becomes the previous one.
    assert got == [(0, 0.0), (1, 0.0), (2, 0.0), (3, 2.0)]


def test_latest_state_keeps_each_field(spark):
    rows = [("s", 0, 0, 1, None, 1.0, None, None), ("s", 1, 0, None, 5, None, 3, None), ("s", 2, 0, 2, None, None, None, 1)]
    table = spark.createDataFrame(rows, "session_id string, seq long, timestamp_ns long, exposure_time_ns long, iso int, "
                                        "focus_distance float, af_state int, lens_state int")
    for width in (1, 1 << 17):
        got = rows_of(latest_camera_state(table, width=width), "seq", "exposure_time_ns", "iso", "af_state", "lens_state")
        assert got == [(0, 1, None, None, None), (1, 1, 5, 3, None), (2, 2, 5, 3, 1)]


def test_root_makes_first_frame_the_identity(spark):
    table = frames(spark, 5)
    based = root_relative(attach_root(table, session_roots(table)))
    first = based.where("session_id = 'hot'").orderBy("seq").first().pose
    assert first.qw == pytest.approx(1) and first.tx == pytest.approx(0) and first.qy == pytest.approx(0)


def test_frame_root_wins_and_missing_root_is_identity(spark):
    table = frames(spark, 6).withColumn("own", F.when(F.col("seq") % 2 == 0, pose(*[F.lit(v) for v in (1, 0, 0, 0, 0, 0, 1)])))
    none = session_roots(table).where("false")
    rows = root_relative(attach_root(table, none, override="own")).select("seq", "pose").collect()
    raw = {r.seq: r.pose for r in table.select("seq", "pose").collect()}
    for seq, p in rows:
        assert p.tx == pytest.approx(raw[seq].tx - 1 if seq % 2 == 0 else 0)


def test_only_consecutive_repeats_are_dropped(spark):
    table = stamps(spark, [("s", 0, 5), ("s", 1, 5), ("s", 2, 7), ("s", 3, 5), ("t", 4, 5)])
    for width in (1, 2, 100):
        assert rows_of(new_depth_only(table, width), "seq") == [(0,), (2,), (3,), (4,)]


@pytest.mark.parametrize("width", WIDTHS)
def test_last_n(spark, width):
    table = stamps(spark, [("hot", i, i) for i in range(40)] + [("a", 50, 0)])
    assert rows_of(last_n(table, 3, width=width), "seq") == [(37,), (38,), (39,), (50,)]
    assert recent_log_lines(table, width=width).count() == 41


def test_time_since_last(spark):
    rows = [("s", i, ts, d) for i, (ts, d) in enumerate([(0, "requested"), (5, "interval"), (9, "requested"), (12, "motion")])]
    table = spark.createDataFrame(rows, "session_id string, seq long, timestamp_ns long, decision string")
    for width in (1, 2, 100):
        got = rows_of(time_since_last(table, width), "seq", "since_frame_ns", "since_request_ns")
        assert got == [(0, None, None), (1, 5, 5), (2, 4, 9), (3, 3, 3)]


def test_capture_enabled_between_stop_and_resume(spark):
    table = stamps(spark, [("s", i, i) for i in range(6)])
    marks = spark.createDataFrame([("s", 2, "stop"), ("s", 4, "resume"), ("s", 5, "photo_arrived")],
                                  "session_id string, seq long, kind string")
    for width in (1, 3, 100):
        got = [r[1] for r in rows_of(capture_enabled(table, marks, width), "seq", "enabled")]
        assert got == [True, True, False, False, True, True]
