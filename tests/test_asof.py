"""Nearest-in-time joins and photo assembly against all-pairs searches on small tables."""

from __future__ import annotations

import random

import pytest
from helpers import closest, rows_of, stamps
from pyspark.sql import functions as F

from capturelake.operators.asof import (finalize_seq, latest_by_timestamp, match_metadata, nearest, nearest_pose,
                                        nearest_retained, pose_ready, retained)
from capturelake.operators.export import session_ready
from capturelake.plans.assemble import (assemble_keyframes, assign_capture_index, evict_metadata, rejected_images,
                                        unmatched_images)
from capturelake.policies import DATASET, HIGHRES_GENERIC

MS = 1_000_000
META = ("session_id string, seq long, timestamp_ns long, exposure_time_ns long, iso int, af_state int, lens_state int, "
        "ois_mode int, video_stabilization_mode int")


def meta(spark, rows):
    """(session, seq, ts[, exposure, iso, af, lens, ois, eis]); sharp by default."""
    full = [(*r, *(10**6, 100, 2, 0, 0, 0)[len(r) - 3:]) for r in rows]
    return spark.createDataFrame(full, META)


def random_stamps(seed, n, sessions=("hot", "hot", "hot", "a"), span=4000):
    rng = random.Random(seed)
    return [(rng.choice(sessions), i, rng.randint(0, span) * MS) for i in range(n)]


def unique(rows):
    """The last arrival per session and timestamp."""
    return list({(s, ts): (s, q, ts) for s, q, ts in rows}.values())


@pytest.mark.parametrize("seed,cell,reach", [(1, MS, 160 * MS), (2, 20 * MS, 400 * MS), (3, 1 << 20, 1 << 33),
                                             (4, 300 * MS, 1 << 33), (5, 1, 200 * MS)])
def test_nearest_equals_all_pairs(spark, seed, cell, reach):
    images, poses = unique(random_stamps(seed, 150)), random_stamps(seed + 50, 300)
    want = closest(images, poses, 75 * MS)
    got = nearest_pose(stamps(spark, images), stamps(spark, poses), 75 * MS, cell, reach).collect()
    assert {(r.session_id, r.seq): (r.pose_timestamp_ns, r.pose_seq) if r.pose_seq is not None else None
            for r in got} == want


def test_nearest_of_two_kinds_at_once(spark):
    images, poses, depth = unique(random_stamps(4, 80)), random_stamps(5, 100), random_stamps(6, 60)
    got = nearest(stamps(spark, images), {"pose": (stamps(spark, poses), 75 * MS),
                                          "depth": (stamps(spark, depth), 250 * MS)}, 7 * MS, 600 * MS).collect()
    a, b = closest(images, poses, 75 * MS), closest(images, depth, 250 * MS)
    for r in got:
        k = (r.session_id, r.seq)
        assert r.pose_seq == (a[k][1] if a[k] else None)
        assert r.depth_seq == (b[k][1] if b[k] else None)


def test_tie_goes_to_the_earlier_arrival(spark):
    images = stamps(spark, [("s", 9, 100)])
    for late, early in ((90, 110), (110, 90)):
        poses = stamps(spark, [("s", 1, early), ("s", 2, late), ("s", 3, early)])
        assert rows_of(nearest_pose(images, poses, 50, 10, 1000), "pose_seq") == [(1,)]


def test_tolerance_is_inclusive(spark):
    images = stamps(spark, [("s", 0, 0), ("t", 1, 0)])
    poses = stamps(spark, [("s", 2, 75 * MS), ("t", 3, 75 * MS + 1)])
    assert rows_of(nearest_pose(images, poses, 75 * MS), "seq", "pose_seq") == [(0, 2), (1, None)]


def test_a_tolerance_wider_than_the_reach_widens_it(spark):
    images, poses = unique(random_stamps(8, 80)), random_stamps(58, 40)
    want = closest(images, poses, 900 * MS)
    got = nearest_pose(stamps(spark, images), stamps(spark, poses), 900 * MS, 7 * MS, 200 * MS).collect()
    assert {(r.session_id, r.seq): (r.pose_timestamp_ns, r.pose_seq) if r.pose_seq is not None else None for r in got} == want


def test_copies_of_one_timestamp_collapse(spark):
    poses = stamps(spark, [("s", i, 1000) for i in range(500)])
    images = stamps(spark, [("s", 900 + i, 1000) for i in range(500)])
    assert rows_of(nearest_pose(images, poses, 10, 5, 100), "seq", "pose_seq") == [(1399, 0)]
    assert rows_of(latest_by_timestamp(images), "seq") == [(1399,)]


def test_later_metadata_replaces_earlier(spark):
    images = stamps(spark, [("s", 1, 10), ("s", 2, 20)])
    got = match_metadata(images, meta(spark, [("s", 3, 10, 111), ("s", 5, 10, 222), ("t", 6, 20)]))
    assert rows_of(got, "seq", "meta.exposure_time_ns") == [(1, 222), (2, None)]


def test_pose_ready(spark):
    images = stamps(spark, [("s", 1, 10), ("s", 2, 21), ("none", 3, 0)])
    got = pose_ready(images, stamps(spark, [("s", 0, 20), ("s", 4, 5)]))
    assert rows_of(got, "seq", "pose_ready") == [(1, True), (2, False), (3, False)]


@pytest.mark.parametrize("seed,width,chunk", [(7, 1 << 17, 1 << 20), (8, 10, 30 * MS), (9, 3, 70 * MS)])
def test_causal_equals_replay(spark, seed, width, chunk):
    rng = random.Random(seed)
    # One clock per session, samples in clock order, photos and metadata a little late.
    images, stills, poses, depth = [], [], [], []
    seq = 0
    for s in ("hot", "a"):
        clock = 0
        for _ in range(160 if s == "hot" else 20):
            clock += rng.randint(10, 60) * MS
            poses.append((s, seq, clock))
            if rng.random() < 0.5:
                depth.append((s, seq + 1, clock - rng.randint(0, 80) * MS))
            if rng.random() < 0.3:
                ts = clock + rng.randint(-150, 40) * MS
                images.append((s, seq + 2, ts))
                if rng.random() < 0.9:
                    stills.append((s, seq + 3 + rng.randint(0, 1) * 20, ts))
            seq += 25
    n_pose, n_depth = 6, 3
    final = finalize_seq(match_metadata(stamps(spark, images), meta(spark, stills)), stamps(spark, poses), chunk)
    got = nearest_retained(final, {"pose": (stamps(spark, poses), 75 * MS, n_pose),
                                   "depth": (stamps(spark, depth), 250 * MS, n_depth)}, width).collect()
    by_ts = {(s, ts): q for s, q, ts in stills}
    assert len(got) == len({(s, t) for s, _, t in images})
    for r in got:
        s, ts = r.session_id, r.timestamp_ns
        late = [q for z, q, t in poses if z == s and t >= ts]
        end = max(r.seq, by_ts[(s, ts)], min(late)) if (s, ts) in by_ts and late else None
        assert r.finalize_seq == end
        for name, table, n, tol in (("pose", poses, n_pose, 75 * MS), ("depth", depth, n_depth, 250 * MS)):
            held = [] if end is None else sorted((q, t) for z, q, t in table if z == s and q <= end)[-n:]
            best = min(((abs(t - ts), q) for q, t in held), default=None)
            assert r[f"{name}_seq"] == (best[1] if best and best[0] <= tol else None)


def test_retained_ranges(spark):
    poses = stamps(spark, [("s", q, q) for q in range(0, 20, 2)])
    for width in (4, 1 << 17):
        got = rows_of(retained(poses, stamps(spark, [("s", 7, 0), ("s", 18, 0), ("t", 3, 0)]), 3, width),
                      "session_id", "first_rank", "last_rank", "held")
        assert got == [("s", 2, 4, 3), ("s", 8, 10, 3), ("t", 1, 0, 0)]


def scene(spark):
    images = stamps(spark, [("s", 1, 100 * MS), ("s", 2, 200 * MS), ("s", 3, 300 * MS), ("s", 4, 400 * MS),
                            ("s", 5, 500 * MS), ("s", 6, 9000 * MS), ("s", 7, 1500 * MS)])
    stills = meta(spark, [("s", 11, 100 * MS), ("s", 12, 200 * MS, 5 * MS), ("s", 13, 300 * MS), ("s", 14, 400 * MS),
                          ("s", 16, 9000 * MS), ("s", 17, 1500 * MS)])
    poses = stamps(spark, [("s", 21, 110 * MS), ("s", 22, 290 * MS), ("s", 23, 470 * MS), ("s", 24, 1490 * MS),
                           ("s", 25, 3000 * MS), ("s", 26, 3100 * MS), ("s", 27, 3200 * MS)])
    depth = stamps(spark, [("s", 31, 350 * MS), ("s", 32, 2000 * MS)])
    return images, stills, poses, depth


def test_every_outcome(spark):
    images, stills, poses, depth = scene(spark)
    rows = assemble_keyframes(images, stills, poses, depth)
    got = rows_of(rows, "seq", "outcome", "capture_index", "pose_delta_ns", "depth_delta_ns")
    assert [(s, o, i) for s, o, i, _, _ in got] == [
        (1, "saved", 1), (2, "rejected_quality", None), (3, "saved", 2), (4, "saved", 3), (5, "pending_metadata", None),
        (6, "pending_pose", None), (7, "rejected_depth", None)]
    assert got[0][3:] == (10 * MS, 250 * MS) and got[2][3:] == (-10 * MS, 50 * MS)
    assert rows_of(session_ready(rows), "pending", "ready") == [(2, False)]
    assert rows_of(rejected_images(images, rows), "seq") == [(2,), (5,), (6,), (7,)]
    assert rows_of(unmatched_images(images, stills), "seq") == [(5,)]


def test_profile_without_depth_stage(spark):
    images, stills, poses, depth = scene(spark)
    got = dict(rows_of(assemble_keyframes(images, stills, poses, depth, HIGHRES_GENERIC), "seq", "outcome"))
    assert got[7] == "saved" and got[4] == "rejected_pose"


def test_later_depth_frame_is_only_seen_by_nearest(spark):
    images, stills = stamps(spark, [("s", 1, 100 * MS)]), meta(spark, [("s", 2, 100 * MS)])
    poses = stamps(spark, [("s", 3, 100 * MS)])
    depth = stamps(spark, [("s", 0, 0), ("s", 4, 110 * MS)])
    for mode, seq in (("nearest", 4), ("causal", 0)):
        got = assemble_keyframes(images, stills, poses, depth, mode=mode)
        assert rows_of(got, "outcome", "depth_seq") == [("saved", seq)]


def test_outcomes_add_up_for_small_chunks(spark):
    images, poses = random_stamps(20, 120), random_stamps(21, 300)
    stills = meta(spark, [(s, 1000 + q, t) for s, q, t in images if q % 5])
    tables = stamps(spark, unique(images)), stills, stamps(spark, poses), stamps(spark, random_stamps(22, 200))
    wide = assemble_keyframes(*tables)
    tight = assemble_keyframes(*tables, cell_ns=3 * MS, reach_ns=520 * MS, width=7)
    columns = ("session_id", "timestamp_ns", "outcome", "pose_seq", "depth_seq")
    assert sorted(map(str, wide.select(*columns).collect())) == sorted(map(str, tight.select(*columns).collect()))
    saved = tight.where("outcome = 'saved'").groupBy("session_id").agg(
        F.count("*").alias("n"), F.max("capture_index").alias("m"), F.countDistinct("capture_index").alias("d")).collect()
    assert saved and all(r.n == r.m == r.d for r in saved)
    assert tight.where("outcome = 'saved' AND abs(pose_delta_ns) > 75000000").count() == 0


def test_capture_index_follows_image_time(spark):
    rows = stamps(spark, [("s", 1, 30), ("s", 2, 10), ("s", 3, 20)]).withColumn(
        "outcome", F.when(F.col("seq") == 3, "rejected_pose").otherwise("saved"))
    for chunk in (4, 1 << 20):
        assert rows_of(assign_capture_index(rows, chunk), "seq", "capture_index") == [(1, 2), (2, 1), (3, None)]


def test_metadata_eviction_starts_beyond_the_buffer(spark):
    poses = stamps(spark, [("s", 100, 1000 * MS), ("s", 101, 2000 * MS)])
    few = [("s", q, q * MS) for q in range(12)]
    assert evict_metadata(meta(spark, few), poses).count() == 12
    many = few + [("s", 50, 925 * MS), ("s", 51, 924 * MS)]
    assert rows_of(evict_metadata(meta(spark, many), poses), "seq") == [(50,)]
    assert evict_metadata(meta(spark, many), poses.where("false")).count() == 14
    assert DATASET.metadata_buffer == 12
