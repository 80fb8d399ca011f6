"""Small tables and brute-force versions of the sequential and pairwise operators."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.functions.pose import FIELDS, pose
from capturelake.policies import Policy

FRAME = "session_id string, seq long, timestamp_ns long, lens_state int, af_state int, " + ", ".join(
    f"{c} double" for c in FIELDS)


def frames_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, FRAME).select(
        "session_id", "seq", "timestamp_ns", "lens_state", "af_state", pose().alias("pose"))


def random_frames(seed: int, sessions: dict[str, int], step_ns: int = 100_000_000, jitter: bool = False) -> list[tuple]:
    """Frames of a slow random walk; with ``jitter`` the clock runs backwards now and then."""
    rng = random.Random(seed)
    rows, seq = [], 0
    clock = dict.fromkeys(sessions, 0)
    place = {s: [0.0, 0.0, 0.0, 0.0] for s in sessions}
    left = dict(sessions)
    while any(left.values()):
        s = rng.choices(list(left), weights=list(left.values()))[0]
        left[s] -= 1
        clock[s] += rng.randint(1, 2 * step_ns)
        ts = clock[s] - (rng.randint(0, 30 * step_ns) if jitter and rng.random() < 0.1 else 0)
        p = place[s]
        for i in range(3):
            p[i] += rng.uniform(-0.02, 0.02)
        p[3] += rng.uniform(-1.5, 1.5)
        half = math.radians(p[3]) / 2
        lens = rng.choice([None, 0, 0, 0, 0, 0, 1])
        af = rng.choice([None, 0, 2, 4, 4, 2, 1])
        rows.append((s, seq, max(0, ts), lens, af, p[0], p[1], p[2], 0.0, math.sin(half), 0.0, math.cos(half)))
        seq += rng.randint(1, 3)
    return rows


def _turn(a: tuple, b: tuple) -> float:
    w = sum(x * y for x, y in zip(a[8:12], b[8:12]))
    return math.degrees(2 * math.acos(min(1.0, abs(w))))


def fold(rows: list[tuple], p: Policy, controls: list[tuple] | None = None) -> dict[tuple, str]:
    """Decision per (session, seq), one frame after another."""
    out = {}
    by_session: dict[str, list] = {}
    for r in rows:
        by_session.setdefault(r[0], []).append((r[1], 1, r))
    for c in controls or []:
        by_session.setdefault(c[0], []).append((c[1], 0, c))
    for session, events in by_session.items():
        prev = last = None
        flying, enabled = False, True
        for _, kind, r in sorted(events, key=lambda e: e[:2]):
            if kind == 0:
                if r[2] in ("stop", "resume"):
                    enabled = r[2] == "resume"
                else:
                    flying = False
                continue
            speed = turn = 0.0
            if prev is not None and r[2] > prev[2]:
                dt = (r[2] - prev[2]) / 1e9
                speed, turn = math.dist(prev[5:8], r[5:8]) / dt, _turn(prev, r) / dt
            prev = r
            if not enabled:
                d = "capture_stopped"
            elif flying:
                d = "in_flight"
            elif last is not None and r[2] - last[2] < p.min_interval_ns:
                d = "interval"
            elif last is not None and not (r[2] - last[2] >= p.force_after_ns
                                           or math.dist(last[5:8], r[5:8]) >= p.min_translation_m
                                           or _turn(last, r) >= p.min_rotation_deg):
                d = "viewpoint"
            elif speed > p.max_linear_mps or turn > p.max_angular_dps:
                d = "motion"
            elif r[3] is not None and r[3] != 0:
                d = "lens"
            elif r[4] is not None and r[4] not in (0, 2, 4):
                d = "focus"
            else:
                d, last, flying = "requested", r, controls is not None
            out[(session, r[1])] = d
    return out


def closest(images: list[tuple], samples: list[tuple], tolerance: int) -> dict[tuple, tuple | None]:
    """(session, seq) -> (timestamp, seq) of the nearest sample, earlier arrivals first."""
    out = {}
    for s, seq, ts in images:
        near = min(((abs(t - ts), q, t) for z, q, t in samples if z == s), default=None)
        out[(s, seq)] = (near[2], near[1]) if near and near[0] <= tolerance else None
    return out


def stamps(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "session_id string, seq long, timestamp_ns long")


def rows_of(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted(tuple(r) for r in df.select(*columns).collect())


def single(spark: SparkSession, **columns) -> object:
    """The one row of expressions evaluated on a one-row table."""
    return spark.range(1).select(*[F.expr(c).alias(n) if isinstance(c, str) else c.alias(n)
                                   for n, c in columns.items()]).first()
