"""Streaming operators give the batch results, whatever the micro-batches."""

from __future__ import annotations

import random

import pytest
from helpers import fold, frames_table, random_frames, rows_of, stamps
from pyspark.sql import functions as F

from capturelake.catalog.streams import replay
from capturelake.operators.motion import latest_camera_state, new_depth_only
from capturelake.plans.assemble import assemble_keyframes
from capturelake.policies import DATASET
from capturelake.streaming.assemble_stream import assembly_events, stream_assemble_keyframes, stream_write_keyframes
from capturelake.streaming.select_stream import (selection_events, stream_dedup_depth, stream_latest_camera_state,
                                                 stream_select_keyframes)
from test_asof import MS, META, meta


@pytest.mark.parametrize("batches", [1, 4])
def test_selection(spark, batches):
    rng = random.Random(batches)
    rows = random_frames(3, {"hot": 150, "a": 30}, jitter=True)
    kinds = ["photo_arrived"] * 5 + ["request_failed", "stop", "resume", "resume"]
    controls = [(r[0], r[1], rng.choice(kinds)) for r in rows if rng.random() < 0.25]
    table = spark.createDataFrame(controls, "session_id string, seq long, kind string")
    out = replay(spark, selection_events(frames_table(spark, rows), table), stream_select_keyframes, batches)
    assert {(r.session_id, r.seq): r.decision for r in out.collect()} == fold(rows, DATASET, controls)


@pytest.mark.parametrize("batches", [1, 5])
def test_assembly_equals_causal_batch(spark, batches):
    rng = random.Random(9)
    images, stills, poses, depth, clock = [], [], [], [], 0
    for q in range(0, 1600, 8):
        clock += rng.randint(10, 60) * MS
        poses.append(("s", q, clock))
        depth.append(("s", q + 1, clock - rng.randint(0, 90) * MS))
        if rng.random() < 0.3:
            ts = clock + rng.randint(-150, 50) * MS
            first, second = rng.sample((2, 3, 4, 5), 2)
            images.append(("s", q + first, ts))
            if rng.random() < 0.9:
                stills.append(("s", q + second, ts, rng.choice((10**6, 9 * 10**6))))
    tables = stamps(spark, images), meta(spark, stills), stamps(spark, poses), stamps(spark, depth)
    out = replay(spark, assembly_events(*tables), stream_assemble_keyframes, batches)
    columns = ("timestamp_ns", "outcome", "pose_seq", "pose_delta_ns", "depth_seq", "depth_delta_ns")
    batch = assemble_keyframes(*tables, mode="causal").where("outcome NOT LIKE 'pending%'")
    got = {r.timestamp_ns: tuple(r) for r in out.select(*columns).collect()}
    want = {r.timestamp_ns: tuple(r) for r in batch.select(*columns).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    saved = {k for k, v in want.items() if v[1] == "saved"}
    assert saved and all(got[k] == want[k] for k in saved)


@pytest.mark.parametrize("seed", range(3))
def test_batch_evicts_metadata_as_the_stream_does(spark, seed):
    from dataclasses import replace

    policy = replace(DATASET, metadata_buffer=4, pose_buffer=6, depth_buffer=5)
    rng = random.Random(seed)
    images, stills, poses, depth = [], [], [], []
    for q in range(0, 1200, 4):
        ts = 30 * MS * q
        poses.append(("s", q, ts))
        depth.append(("s", q + 1, ts - rng.randint(0, 90) * MS))
        if rng.random() < 0.4:
            shot = ts + rng.randint(-50, 50) * MS
            stills.append(("s", q + 2, shot, 10**6))
            images.append(("s", q + 3 + 4 * rng.choice((0, 0, 1, 5, 20, 60)), shot))  # some photos come late
    tables = stamps(spark, images), meta(spark, stills), stamps(spark, poses), stamps(spark, depth)
    out = replay(spark, assembly_events(*tables, policy), lambda e: stream_assemble_keyframes(e, policy), 3)
    batch = assemble_keyframes(*tables, policy=policy, mode="causal", width=16)
    got = {r.timestamp_ns: r.outcome for r in out.collect()}
    want = {r.timestamp_ns: r.outcome for r in batch.collect()}
    assert got == {k: v for k, v in want.items() if not v.startswith("pending")}
    assert sum(v == "pending_metadata" for v in want.values()) > 10 < len(got)


def test_eviction_in_chunks_equals_one_fold(spark):
    """One session with most rows, cut into chunks; what a chunk holds in the end reaches the next ones."""
    from dataclasses import replace

    from capturelake.operators.asof import finalize_seq, match_metadata, pose_ready
    from capturelake.plans.assemble import evicted_images, late_sessions

    policy = replace(DATASET, metadata_buffer=4, pose_buffer=6)
    rng = random.Random(8)
    images, stills, poses = [], [], []
    for name, n in (("hot", 1600), ("a", 200), ("quiet", 200)):
        for q in range(0, n, 4):
            ts = 30 * MS * q
            poses.append((name, q, ts))
            if rng.random() < 0.4:
                shot = ts + rng.randint(-50, 20) * MS
                stills.append((name, q + 2, shot, 10**6))
                late = 0 if name == "quiet" else rng.choice((0, 0, 1, 5, 20, 60))
                if rng.random() < 0.8:
                    images.append((name, q + 3 + 4 * late, shot))
    images, stills, poses = stamps(spark, images), meta(spark, stills), stamps(spark, poses)
    final = finalize_seq(pose_ready(match_metadata(images, stills), poses), poses, first_pose="_first_pose").cache()
    late = late_sessions(final, poses, policy)
    assert {r.session_id for r in late.collect()} == {"hot", "a"}
    whole = sorted(map(tuple, evicted_images(final, stills, poses, policy).collect()))
    cut_up = sorted(map(tuple, evicted_images(final, stills, poses, policy, sessions=late, stretch=500).collect()))
    assert cut_up == whole and len(whole) > 20


def test_idle_sessions_leave_as_pending(spark, tmp_path):
    clock = F.timestamp_seconds(F.col("seq"))
    tables = [t.withColumn("event_time", clock) for t in (
        stamps(spark, [("s", 10, 100), ("s", 11, 900)]), meta(spark, [("s", 12, 900)]), stamps(spark, [("s", 5, 50), ("z", 9000, 1)]),
        stamps(spark, [("s", 6, 60)]))]
    events = assembly_events(*tables)
    where, out, ckpt = (f"{tmp_path}/{n}" for n in ("events", "out", "ckpt"))
    for part in (events.where("session_id = 's'"), events.where("session_id = 'z'")):
        part.write.mode("append").parquet(where)
        stream = stream_assemble_keyframes(spark.readStream.schema(events.schema).parquet(where), idle="10 seconds")
        stream_write_keyframes(stream, out, ckpt).awaitTermination()
    got = rows_of(spark.read.schema(stream.schema).parquet(out), "seq", "outcome")
    assert got == [(10, "pending_metadata"), (11, "pending_pose")]


def test_depth_and_state_streams(spark):
    depth = stamps(spark, [("s", i, t) for i, t in enumerate((5, 5, 7, 5, 5, 9))] + [("t", 9, 5)])
    assert rows_of(replay(spark, depth, stream_dedup_depth, 3), "seq") == rows_of(new_depth_only(depth), "seq")
    states = spark.createDataFrame([("s", i, i, e, None, None, a, 0) for i, (e, a) in enumerate([(1, None), (None, 2), (None, None), (4, None)])],
                                   "session_id string, seq long, timestamp_ns long, exposure_time_ns long, iso int, "
                                   "focus_distance float, af_state int, lens_state int")
    columns = ("seq", "exposure_time_ns", "iso", "af_state", "lens_state")
    got = replay(spark, states, stream_latest_camera_state, 4)
    assert rows_of(got, *columns) == rows_of(latest_camera_state(states), *columns)


def arrivals(kind, pairs, sharp=True):
    from capturelake.streaming.assembly_state import Arrival
    return [Arrival(seq, kind, ts, sharp, 0) for seq, ts in pairs]


def test_metadata_buffer_is_bounded():
    from capturelake.streaming.assembly_state import Assembly
    held = Assembly("s", DATASET)
    held.handle(arrivals("pose", [(0, 1000 * MS)]) + arrivals("metadata", [(i, i * MS) for i in range(13)]))
    assert not held.stills
    held.handle(arrivals("metadata", [(99, 990 * MS)]))
    assert list(held.stills) == [990 * MS]
    held.handle(arrivals("pose", [(i, i) for i in range(200)]))
    assert len(held.poses.held) == len(held.entries["poses"].new) == DATASET.pose_buffer and META


def test_pending_photos_cost_linear_time():
    import time

    from capturelake.streaming.assembly_state import Assembly

    def run(n):
        held, start = Assembly("s", DATASET), time.process_time()
        held.handle(arrivals("pose", [(0, 0)]) + arrivals("image", [(i + 1, 10**9 + i) for i in range(n)]))  # all wait
        return time.process_time() - start, len(held.photos.new)

    (small, _), (large, pending) = run(2_000), run(20_000)
    assert pending == 20_000 and large < 60 * small + 1


class Store(dict):
    """A map state that counts what is asked of it."""

    writes = reads = 0

    def getValue(self, key):
        self.reads += 1
        return self.get(key)

    def containsKey(self, key):
        return key in self

    def updateValue(self, key, value):
        self.writes += 1
        self[key] = value

    def removeKey(self, key):
        self.writes += 1
        del self[key]

    def iterator(self):
        self.reads += len(self)
        return iter(list(self.items()))


class Value:
    held = None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


def stores():
    from capturelake.streaming.assembly_state import LAYOUT
    return {"progress": Value()} | {name: Store() for name in LAYOUT}


def test_a_batch_writes_what_arrived_and_not_what_is_held():
    from capturelake.streaming.assembly_state import Assembly

    kept = stores()
    first = Assembly("s", DATASET, handle=kept)
    first.handle(arrivals("pose", [(i, i) for i in range(500)]) + arrivals("image", [(1000 + i, 10**9 + i) for i in range(5000)]))
    first.store()
    assert len(kept["photos"]) == 5000 and len(kept["poses"]) == DATASET.pose_buffer
    read = kept["photos"].reads
    second = Assembly("s", DATASET, handle=kept)
    rows = second.handle(arrivals("metadata", [(9000, 10**9 + 7)]) + arrivals("pose", [(9001, 10**9 + 20)]))
    assert [r[1:4] for r in rows] == [(1007, 10**9 + 7, "saved" if DATASET.depth_tolerance_ns is None else "rejected_depth")]
    assert second.store() == 2  # the pose came, the photo left, its metadata was never written
    assert kept["photos"].reads - read == 1 and len(kept["photos"]) == 4999


@pytest.mark.parametrize("seed", range(4))
def test_state_does_not_depend_on_the_batches(seed):
    """Whatever the cuts: same rows, same entries; a repeated photo time and evicted metadata among them."""
    from dataclasses import replace

    from capturelake.streaming.assembly_state import Arrival, Assembly

    policy = replace(DATASET, metadata_buffer=4, pose_buffer=6, depth_buffer=5)
    rng = random.Random(seed)
    flow = [Arrival(q, rng.choice(("pose", "depth", "image", "metadata")), (30 * q + rng.randrange(-90, 90)) // 40 * 40 * MS,
                    rng.random() < 0.8, 0) for q in range(900)]

    def run(sizes):
        kept, rows, at = stores(), [], 0
        while at < len(flow):
            n = rng.choice(sizes)
            held = Assembly("s", policy, handle=kept)
            rows += held.handle(flow[at:at + n])
            held.store()
            at += n
        return rows, {k: dict(v) for k, v in kept.items() if k != "progress"}, kept["progress"].held

    whole = run([900])
    assert len(whole[0]) > 20 and run([1]) == whole and run([1, 7, 50]) == whole


def test_late_arrivals_wait_and_what_is_later_still_leaves():
    from capturelake.streaming.assembly_state import Arrival, Assembly

    kept = stores()

    def batch(*pairs):
        held = Assembly("s", DATASET, lateness=5, handle=kept)
        now, late = held.ordered([Arrival(q, k, q * MS, True, 0) for q, k in pairs])
        held.store()
        return [a.seq for a in now], [r[1:4] for r in late]

    assert batch((3, "pose"), (1, "pose")) == ([], [])
    assert batch((2, "image"), (7, "pose"), (7, "pose")) == ([1, 2], [])
    assert batch((2, "image"), (4, "depth")) == ([], [(2, 2 * MS, "late")])
    assert len(kept["waiting"]) == 3
    assert batch((9, "end")) == ([3, 4, 7], []) and not kept["waiting"]
    assert batch((8, "pose"), (12, "pose")) == ([], [(8, 8 * MS, "late")])
    assert batch() == ([], [])


@pytest.mark.parametrize("batches", [2, 5])
def test_swapped_batches_give_the_batch_result(spark, tmp_path, batches):
    from capturelake.catalog.streams import replay_swapped
    from capturelake.streaming.assemble_stream import session_ends

    rng = random.Random(batches)
    images, stills, poses, depth, clock = [], [], [], [], 0
    for q in range(0, 800, 8):
        clock += rng.randint(10, 60) * MS
        poses.append(("s", q, clock))
        depth.append(("s", q + 1, clock - rng.randint(0, 90) * MS))
        if rng.random() < 0.4:
            ts = clock + rng.randint(-150, 50) * MS
            images.append(("s", q + 2, ts))
            stills.append(("s", q + 3, ts, 10**6))
    tables = stamps(spark, images), meta(spark, stills), stamps(spark, poses), stamps(spark, depth)
    events = assembly_events(*tables)
    out = replay_swapped(spark, events, session_ends(events), batches).collect()
    batch = assemble_keyframes(*tables, mode="causal").where("outcome NOT LIKE 'pending%'").collect()
    columns = ("timestamp_ns", "outcome", "pose_seq", "depth_seq")
    got = {r.timestamp_ns: tuple(r[c] for c in columns) for r in out if r.outcome != "late"}
    assert got.keys() == {r.timestamp_ns for r in batch}
    assert all(got[r.timestamp_ns] == tuple(r[c] for c in columns) for r in batch if r.outcome == "saved")
    late = [r.seq for r in out if r.outcome == "late"]
    assert late and all(q % 11 == 0 for q in late)


def test_photos_without_metadata_leave_after_their_patience(spark, tmp_path):
    clock = F.timestamp_seconds(F.col("seq"))
    tables = [t.withColumn("event_time", clock) for t in (
        stamps(spark, [("s", 10, 100), ("s", 900, 700)]), meta(spark, [("s", 920, 700)]),
        stamps(spark, [("s", 5, 50), ("s", 60, 300), ("s", 930, 800)]), stamps(spark, [("s", 6, 60)]))]
    events = assembly_events(*tables)
    where, out, ckpt = (f"{tmp_path}/{n}" for n in ("events", "out", "ckpt"))
    for part in (events.where("seq < 900"), events.where("seq = 900"), events.where("seq > 900")):
        part.write.mode("append").parquet(where)
        stream = stream_assemble_keyframes(spark.readStream.schema(events.schema).parquet(where), idle="10 seconds", patience_ms=60_000)
        stream_write_keyframes(stream, out, ckpt).awaitTermination()
    assert rows_of(spark.read.schema(stream.schema).parquet(out), "seq", "outcome") == [(10, "pending_metadata"), (900, "saved")]
    with pytest.raises(ValueError, match="idle"):
        stream_assemble_keyframes(spark.readStream.schema(events.schema).parquet(where), patience_ms=1)


@pytest.mark.parametrize("build", [stream_dedup_depth, stream_latest_camera_state])
def test_idle_sessions_lose_their_state(spark, tmp_path, build):
    rows = [("s", 1, 5, 1), ("s", 2, 5, 2), ("z", 9000, 5, 9000), ("z", 9001, 5, 9001), ("s", 9500, 5, 9500)]
    events = spark.createDataFrame(rows, "session_id string, seq long, timestamp_ns long, t long").selectExpr(
        "session_id", "seq", "timestamp_ns", "timestamp_seconds(t) AS event_time", "CASE WHEN seq = 1 THEN 7L END AS exposure_time_ns",
        "cast(NULL AS int) AS iso", "cast(NULL AS float) AS focus_distance", "cast(NULL AS int) AS af_state", "cast(NULL AS int) AS lens_state")
    where, out, ckpt = (f"{tmp_path}/{n}" for n in ("events", "out", "ckpt"))
    for part in ("seq < 9000", "seq = 9000", "seq = 9001", "seq = 9500"):
        events.where(part).write.mode("append").parquet(where)
        stream = build(spark.readStream.schema(events.schema).parquet(where), idle="10 seconds")
        stream_write_keyframes(stream, out, ckpt).awaitTermination()
    got = spark.read.schema(stream.schema).parquet(out).orderBy("seq").collect()
    if build is stream_dedup_depth:
        assert [r.seq for r in got] == [1, 9000, 9500]  # a state that had stayed would drop 9500
    else:
        assert [(r.seq, r.exposure_time_ns) for r in got] == [(1, 7), (2, 7), (9000, None), (9001, None), (9500, None)]


def sink_fixture(spark, tmp_path):
    """Outcome rows of three sessions as a stream's batches, and what describes them."""
    from capturelake.streaming.assemble_stream import RESULT
    from capturelake.streaming.document_sink import described

    shots = [(name, 10 * i, 1000 * MS + 40 * MS * i) for name in ("a", "b") for i in range(6)]
    images = stamps(spark, shots).withColumns({"jpeg_width": F.lit(4000), "jpeg_height": F.lit(3000)})
    stills = meta(spark, [(s, q + 1, ts, 10**6) for s, q, ts in shots])
    k = F.struct(*[F.lit(1.0).alias(n) for n in ("fx", "fy", "cx", "cy")], F.lit(4).alias("width"), F.lit(3).alias("height"))
    pose = F.struct(*[F.lit(float(n == "qw")).alias(n) for n in ("tx", "ty", "tz", "qx", "qy", "qz", "qw")])
    poses = stamps(spark, [(s, q + 2, ts + MS) for s, q, ts in shots]).withColumns({"pose": pose, "image_k": k, "texture_k": k})
    rows = [(s, q, ts, "saved" if q != 30 else "rejected_pose", q + 2, MS, q + 3, -MS,
             None if q == 30 else q // 10 + 1 - (q > 30)) for s, q, ts in shots]
    return spark.createDataFrame(rows, RESULT), described(images, stills, poses), str(tmp_path)


def committed(spark, root):
    from capturelake.streaming.document_sink import committed_keyframes

    return sorted((r.session_id, r.capture_index, r.image) for r in committed_keyframes(spark, root).collect())


def test_a_batch_that_runs_again_writes_nothing(spark, tmp_path):
    from capturelake.streaming.document_sink import commit_batch, ledger, write_committed_trajectory

    rows, describe, root = sink_fixture(spark, tmp_path)
    first, second = rows.where("seq < 30"), rows.where("seq >= 20")  # the second one holds photos of the first again
    commit_batch(first, 0, describe, root)
    once = committed(spark, root)
    commit_batch(first, 0, describe, root)
    assert committed(spark, root) == once and ledger(spark, root).count() == 6
    commit_batch(second, 1, describe, root)
    commit_batch(rows.where("outcome <> 'saved'"), 2, describe, root)
    commit_batch(rows.limit(0), 3, describe, root)
    every = committed(spark, root)
    assert [r[1] for r in every] == [1, 2, 3, 4, 5] * 2 and set(once) < set(every)
    assert ledger(spark, root).count() == 10
    write_committed_trajectory(spark, root).count()
    lines = spark.read.text(f"{root}/a/camera_trajectory.csv").collect()
    assert [x.value.split(",")[0] for x in lines] == ["index", "1", "2", "3", "4", "5"]


def test_a_batch_that_stops_before_its_entry_is_repeated(spark, tmp_path, monkeypatch):
    from capturelake.streaming import document_sink

    rows, describe, root = sink_fixture(spark, tmp_path)

    def stop(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(document_sink, "trajectory_lines", stop)
        with pytest.raises(OSError, match="lost"):
            document_sink.commit_batch(rows, 0, describe, root)
    assert committed(spark, root) == []  # the files are there, but no entry names them
    document_sink.commit_batch(rows, 0, describe, root)
    assert len(committed(spark, root)) == 10


def test_a_lost_checkpoint_does_not_repeat_documents(spark, tmp_path):
    from capturelake.streaming.document_sink import ledger, stream_write_documents

    rows, describe, root = sink_fixture(spark, tmp_path / "out")
    where = f"{tmp_path}/rows"
    rows.where("seq < 30").write.mode("append").parquet(where)
    source = lambda: spark.readStream.schema(rows.schema).parquet(where)
    stream_write_documents(source(), describe, root, f"{tmp_path}/ckpt1").awaitTermination()
    assert ledger(spark, root).count() == 6
    rows.where("seq >= 30").write.mode("append").parquet(where)
    stream_write_documents(source(), describe, root, f"{tmp_path}/ckpt2").awaitTermination()
    keys = [(r.session_id, r.timestamp_ns, r.capture_index) for r in ledger(spark, root).collect()]
    assert len(keys) == len(set(keys)) == 10 == len(committed(spark, root))


class Handle:
    """The states of one session as the store keeps them, with a count of the calls that cross to it."""

    def __init__(self):
        self.calls = 0

    def _counted(self, state):
        handle = self

        class Counted:
            def __getattr__(self, name):
                def call(*values):
                    handle.calls += 1
                    return bool(state) if name == "exists" else state.clear() if name == "clear" and isinstance(state, Store) else getattr(state, name)(*values)
                return call
        return Counted()

    def getValueState(self, name, schema):
        self.value = Value()
        return self._counted(self.value)

    def getMapState(self, name, key, value):
        return self._counted(Store())


def test_a_micro_batch_asks_its_state_a_few_times():
    """Whatever the cuts, rows as without a state; calls do not grow with the rings or with what waits."""
    from dataclasses import replace

    from capturelake.streaming.assembly_state import Arrival, Assembly, open_state

    rng = random.Random(7)
    policy = replace(DATASET, metadata_buffer=4, pose_buffer=60, depth_buffer=5)
    flow = [Arrival(q, rng.choice(("pose", "pose", "depth", "image", "metadata")), (30 * q + rng.randrange(-90, 90)) // 40 * 40 * MS,
                    rng.random() < 0.8, 0) for q in range(900)]
    late = [flow[i ^ 1] for i in range(900)]

    def run(arrivals, size, lateness=None):
        handle = Handle()
        kept, rows, calls = open_state(handle, policy), [], []
        for at in range(0, len(arrivals), size):
            before, held = handle.calls, Assembly("s", policy, lateness, kept)
            now, gone = held.ordered(arrivals[at:at + size])
            rows += gone + held.handle(now)
            held.store()
            calls.append(handle.calls - before)
        held = Assembly("s", policy, lateness, kept)
        return rows + held.left(), max(calls)

    alone = Assembly("s", policy)
    want = alone.handle(flow)
    want += alone.left()
    assert len(want) > 40
    for size in (1, 7, 50, 900):
        rows, calls = run(flow, size)
        assert sorted(map(repr, rows)) == sorted(map(repr, want)) and calls < 60 + size / 2
    for size in (2, 7, 300):
        rows, calls = run(late, size, 40)
        assert sorted(map(repr, rows)) == sorted(map(repr, want)) and calls < 60 + size / 2
    handle = Handle()
    held = Assembly("s", DATASET, 1000, open_state(handle, DATASET))
    assert held.ordered(arrivals("pose", [(i, i) for i in range(900)])) == ([], [])
    held.handle(arrivals("pose", [(i, i) for i in range(500)]))
    held.store()
    assert handle.calls <= 4  # 900 arrivals that wait and 180 poses


def test_a_session_of_a_micro_batch_takes_few_pandas_steps(monkeypatch):
    """Rows in order are neither joined, sorted nor shifted; the values are those of pandas."""
    import numpy as np
    import pandas as pd

    from capturelake.streaming import select_stream

    rows = pd.DataFrame({"seq": [1, 2, 2, 5], "v": [None, 4.0, None, 7.0]})
    mixed = pd.DataFrame({"seq": [5, 2, 2], "kind": ["frame", "frame", "stop"]})
    assert select_stream._ordered(iter([mixed]))["kind"].tolist() == ["stop", "frame", "frame"]
    assert select_stream._ordered(iter([rows[2:], rows[:2]]))["seq"].tolist() == [1, 2, 2, 5]
    for held in (None, 3.0):
        filled = rows["v"].ffill()
        want = (filled if held is None else filled.fillna(held)).to_numpy()
        np.testing.assert_array_equal(select_stream._filled(rows["v"].to_numpy(), held), want)
    assert select_stream._filled(np.array([None, None], dtype=object), 2.0).tolist() == [2.0, 2.0]
    assert select_stream._filled(np.array([1 << 60, 3]), 2.0).tolist() == [1 << 60, 3]

    def refused(*_, **__):
        raise AssertionError("a step for rows that are in order already")

    monkeypatch.setattr(pd, "concat", refused)
    monkeypatch.setattr(pd.DataFrame, "sort_values", refused)
    assert select_stream._ordered(iter([rows])) is rows
