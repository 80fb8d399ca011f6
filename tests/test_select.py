"""Selection against a plain sequential fold, in particular across chunk borders."""

from __future__ import annotations

import random
from dataclasses import asdict

import pandas as pd
import pytest
from pyspark.sql import functions as F
from helpers import fold, frames_table, random_frames

from capturelake.operators import select
from capturelake.operators.select import JUMP_ROWS, Orbits, refuse, select_keyframes
from capturelake.policies import DATASET, HIGHRES_GENERIC, POLICIES, POLICY_SCHEMA

# A hot session with most rows, a few small ones.
SESSIONS = {"hot": 600, "a": 60, "b": 30, "c": 1}


def decisions(df) -> dict:
    return {(r.session_id, r.seq): r.decision for r in df.collect()}


@pytest.mark.parametrize("seed,width,jitter", [
    (1, 1 << 17, False), (1, 16, False), (2, 37, False), (3, 5, False), (4, 64, True), (5, 9, True), (6, 1, False)])
def test_equals_fold_for_any_chunk_width(spark, seed, width, jitter):
    rows = random_frames(seed, SESSIONS, jitter=jitter)
    got = decisions(select_keyframes(frames_table(spark, rows), DATASET, width=width))
    assert got == fold(rows, DATASET)


@pytest.mark.parametrize("seed,width", [(11, 1 << 17), (12, 16), (13, 50), (14, 7), (15, 3)])
def test_equals_fold_with_control_events(spark, seed, width):
    rng = random.Random(seed)
    rows = random_frames(seed, SESSIONS, jitter=seed % 2 == 0)
    kinds = ["photo_arrived"] * 6 + ["request_failed", "result_without_timestamp", "stop", "resume", "resume"]
    controls = sorted({(r[0], r[1] + rng.randint(0, 1)): rng.choice(kinds) for r in rows if rng.random() < 0.2}.items())
    controls = [(s, q, k) for (s, q), k in controls]
    table = spark.createDataFrame(controls, "session_id string, seq long, kind string")
    got = decisions(select_keyframes(frames_table(spark, rows), DATASET, table, width=width))
    assert got == fold(rows, DATASET, controls)


@pytest.mark.parametrize("width", [1 << 17, 20])
def test_request_that_never_ends_blocks_all_later_chunks(spark, width):
    rows = random_frames(21, {"s": 200})
    table = spark.createDataFrame([("s", 0, "photo_arrived")], "session_id string, seq long, kind string")
    got = decisions(select_keyframes(frames_table(spark, rows), DATASET, table, width=width))
    assert got == fold(rows, DATASET, [("s", 0, "photo_arrived")])
    assert list(got.values()).count("requested") == 1


def test_policy_per_row(spark):
    rows = random_frames(31, {"s": 200, "t": 100})
    literals = [F.lit(v).cast(POLICY_SCHEMA[n].dataType).alias(n) for n, v in asdict(HIGHRES_GENERIC).items()]
    frames = frames_table(spark, rows).withColumn("policy", F.struct(*literals))
    for width in (1 << 17, 16):
        assert decisions(select_keyframes(frames, "policy", width=width)) == fold(rows, HIGHRES_GENERIC)


def test_every_profile(spark):
    rows = random_frames(32, {"s": 150})
    for policy in POLICIES:
        assert decisions(select_keyframes(frames_table(spark, rows), policy, width=32)) == fold(rows, policy)


def frame(seq, ts, x=0.0):
    return ("s", seq, ts, 0, 2, x, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)


def test_timing_edges(spark):
    rows = [frame(0, 0), frame(1, 699_999_999, 0.1), frame(2, 700_000_000, 0.1), frame(3, 2_699_999_999, 0.1),
            frame(4, 2_700_000_000, 0.1)]
    assert [d for _, d in sorted(decisions(select_keyframes(frames_table(spark, rows), DATASET)).items())] == [
        "requested", "interval", "requested", "viewpoint", "requested"]


def test_failed_request_still_starts_the_interval(spark):
    rows = [frame(0, 0), frame(2, 500_000_000, 1.0), frame(4, 800_000_000, 1.0)]
    table = spark.createDataFrame([("s", 1, "request_failed")], "session_id string, seq long, kind string")
    got = decisions(select_keyframes(frames_table(spark, rows), DATASET, table))
    # The second frame is only 0.5 s after the failed request; the third one does not move further.
    assert got == {("s", 0): "requested", ("s", 2): "interval", ("s", 4): "requested"}


def test_requests_keep_their_distance(spark):
    rows = random_frames(41, {"s": 300})
    got = decisions(select_keyframes(frames_table(spark, rows), DATASET, width=50))
    stamps = [r[2] for r in rows if got[("s", r[1])] == "requested"]
    assert len(stamps) > 5
    assert min(b - a for a, b in zip(stamps, stamps[1:])) >= DATASET.min_interval_ns


def test_refuse_is_in_flight_until_cleared():
    row = (5, 10**10, 0, 0, 0, 0, 0, 0, 1)
    last = (3, 0, 0, 0, 0, 0, 0, 0, 1)
    limits = (7 * 10**8, 2 * 10**9, 0.03, 2.5)
    assert refuse(last, row, None, True, limits) == "in_flight"
    assert refuse(last, row, 3, True, limits) == "in_flight"
    assert refuse(last, row, 4, True, limits) is None
    assert refuse(last, row, None, False, limits) is None


def test_dense_chunks_stay_linear():
    """Many selections within one interval are kept waiting, not tried against every frame."""
    orbits, limits, tries = Orbits(False), (7 * 10**8, 2 * 10**9, 0.03, 2.5), 0
    for i in range(20_000):
        row = (i, i * 10**5, i / 10.0, 0, 0, 0, 0, 0, 1)
        merged = orbits.follow(row, None, limits)
        tries += len(orbits.ripe) + len(merged)
        orbits.add(row, [*merged, i])
    assert tries < 200_000
    assert len(orbits.ends()) == 20_000


@pytest.mark.parametrize("step_ns", [10_000_000, 1_000_000])
def test_equals_fold_on_a_dense_clock(spark, step_ns):
    rows = random_frames(51, {"hot": 2000, "a": 50}, step_ns=step_ns)
    assert decisions(select_keyframes(frames_table(spark, rows), DATASET, width=100)) == fold(rows, DATASET)


def chunks_of_rows(sizes: list[int]) -> pd.DataFrame:
    """A batch as the last fold gets it: chunks of one session, every other one with an entry request."""
    rng = random.Random(61)
    at = [(k, n) for k, size in enumerate(sizes) for n in range(1, size + 1)]
    rows = {"session_id": ["s"] * len(at), "seq": list(range(len(at))), "timestamp_ns": [2 * 10**8 * i for i in range(len(at))]}
    rows |= {c: [rng.uniform(0, 0.02) for _ in at] for c in select.POSE[:3]} | {c: [0.0] * len(at) for c in select.POSE[3:6]}
    rows |= {"qw": [1.0] * len(at), "_clear": [i - i % 7 for i in range(len(at))], "_n": [n for _, n in at],
             "_block": [rng.choice([None, None, "motion", "capture_stopped"]) for _ in at], "_e_known": [k % 2 == 1 for k, _ in at]}
    before = [i - n for i, (_, n) in enumerate(at)]
    rows |= {"_e_seq": before, "_e_timestamp_ns": [2 * 10**8 * i for i in before], **{f"_e_{c}": [0.0] * len(at) for c in select.POSE[:6]}}
    return pd.DataFrame(rows | {"_e_qw": [1.0] * len(at)})


def test_short_chunks_take_no_array_steps_each(monkeypatch):
    """A chunk of a few rows once cost some hundred times its rows; now many pass in one go."""
    steps = []
    for name in ("_forward", "_jump"):
        monkeypatch.setattr(select, name, lambda *a, f=getattr(select, name): steps.append(1) or f(*a))
    limits = (7 * 10**8, 2 * 10**9, 0.03, 2.5)
    pdf = chunks_of_rows([13] * 100 + [JUMP_ROWS] + [13] * 100 + [1, JUMP_ROWS + 5])

    def decide() -> list[str]:
        # Batches end anywhere, also within a chunk.
        return [d for out in select._decide(True, limits)(iter([pdf[:1000], pdf[1000:3000], pdf[3000:]])) for d in out["decision"]]

    got = decide()
    assert len(steps) <= 2 * 2
    monkeypatch.setattr(select, "JUMP_ROWS", 1)
    assert decide() == got
    assert len(steps) > 2 * 200
    assert {"requested", "in_flight", "interval", "viewpoint", "motion", "capture_stopped"} == set(got)


def test_equals_fold_for_long_and_short_chunks(spark):
    rows = random_frames(52, {"hot": 2 * JUMP_ROWS, "a": 50}, step_ns=10_000_000)
    assert decisions(select_keyframes(frames_table(spark, rows), DATASET)) == fold(rows, DATASET)
