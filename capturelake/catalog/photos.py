"""Photo alignment queries: exact and nearest-in-time joins, assembly and capture reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.catalog.common import r, rq, sql, tracking
from capturelake.catalog.frames import decided, fold_sql
from capturelake.fixtures import table
from capturelake.operators.asof import (finalize_seq, match_metadata, nearest, nearest_pose, nearest_retained,
                                        pose_ready, retained)
from capturelake.operators.export import session_ready
from capturelake.operators.report import DECISIONS, capture_report, depth_frames_held
from capturelake.plans.assemble import (assemble_keyframes, evict_metadata, matched_images, rejected_images,
                                        unmatched_images)
from capturelake.plans.chunks import SEQ_CHUNK
from capturelake.policies import DATASET, HIGHRES_GENERIC, Policy
from capturelake.session import cut

KEY = ("session_id", "seq", "timestamp_ns")


def tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return (table(spark, sf, "images"), table(spark, sf, "still_metadata"), tracking(spark, sf),
            table(spark, sf, "depth_frames_ref"))


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    images, meta, _, _ = tables(spark, sf)
    return match_metadata(images, meta).select(
        *KEY, F.col("meta.seq").alias("meta_seq"), F.col("meta.exposure_time_ns").alias("exposure_time_ns"),
        F.col("meta.iso").alias("iso"))


def ready(spark: SparkSession, sf: str) -> DataFrame:
    images, _, frames, _ = tables(spark, sf)
    return pose_ready(images, frames).select(*KEY, "pose_ready")


def closest_pose(spark: SparkSession, sf: str) -> DataFrame:
    images, _, frames, _ = tables(spark, sf)
    return nearest_pose(images, frames, DATASET.pose_tolerance_ns).select(*KEY, "pose_timestamp_ns", "pose_seq")


def closest_depth(spark: SparkSession, sf: str) -> DataFrame:
    images, _, _, depth = tables(spark, sf)
    return nearest(images, {"depth": (depth, DATASET.depth_tolerance_ns)}).select(
        *KEY, "depth_timestamp_ns", "depth_seq")


def closest_depth_causal(spark: SparkSession, sf: str) -> DataFrame:
    images, meta, frames, depth = tables(spark, sf)
    final = finalize_seq(match_metadata(images, meta), frames)
    return nearest_retained(cut(final), {"depth": (depth, DATASET.depth_tolerance_ns, DATASET.depth_buffer)}).select(
        *KEY, "finalize_seq", "depth_timestamp_ns", "depth_seq")


def held(spark: SparkSession, sf: str) -> DataFrame:
    images, _, frames, _ = tables(spark, sf)
    return retained(frames, images, DATASET.depth_buffer)


def assembled(spark: SparkSession, sf: str, policy: Policy = DATASET, mode: str = "nearest",
              width: int = SEQ_CHUNK) -> DataFrame:
    images, meta, frames, depth = tables(spark, sf)
    rows = assemble_keyframes(images, meta, frames, depth, policy, mode, width=width)
    depth_columns = ["depth_seq", "depth_delta_ns"] if policy.depth_tolerance_ns else []
    return rows.select(*KEY, "outcome", "capture_index", "pose_seq", "pose_delta_ns", *depth_columns)


def rejected(spark: SparkSession, sf: str) -> DataFrame:
    images, meta, frames, depth = tables(spark, sf)
    return rejected_images(images, assemble_keyframes(images, meta, frames, depth)).select(*KEY, "outcome")


def unmatched(spark: SparkSession, sf: str) -> DataFrame:
    images, meta, _, _ = tables(spark, sf)
    return (unmatched_images(images, meta).withColumn("has_metadata", F.lit(False))
            .unionByName(matched_images(images, meta).withColumn("has_metadata", F.lit(True)))
            .select(*KEY, "has_metadata"))


def saveable(spark: SparkSession, sf: str) -> DataFrame:
    return session_ready(assembled(spark, sf))


def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    return assembled(spark, sf).groupBy("session_id", "outcome").agg(
        F.count("*").alias("images"), r(F.avg(F.abs("pose_delta_ns")) / 1e6, 4).alias("mean_pose_delta_ms"))


def evicted(spark: SparkSession, sf: str) -> DataFrame:
    _, meta, frames, _ = tables(spark, sf)
    return evict_metadata(meta, frames, SMALL_BUFFER).select(*KEY)


# A short pose buffer, so that the compressed test sessions do evict.
SMALL_BUFFER = Policy(**{**HIGHRES_GENERIC.__dict__, "pose_buffer": 20})


def report(spark: SparkSession, sf: str) -> DataFrame:
    images, meta, frames, depth = tables(spark, sf)
    kf = assemble_keyframes(images, meta, frames, depth)
    return capture_report(decided(spark, sf, DATASET), kf, depth)


def report_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer is a session, with or without frames; every third one is finished."""
    images, meta, frames, depth = tables(spark, sf)
    every = table(spark, sf, "customer").selectExpr("c_custkey", "concat('s', lpad(cast(c_custkey AS string), 6, '0')) AS session_id")
    return capture_report(decided(spark, sf, DATASET), assemble_keyframes(images, meta, frames, depth), depth,
                          every.where("c_custkey % 3 = 0"), every)


def displayed(spark: SparkSession, sf: str) -> DataFrame:
    return depth_frames_held(table(spark, sf, "depth_frames_ref"), 30)


TRACKED = "tracked AS (SELECT * FROM poses WHERE tracking_state = 'TRACKING')"


def near_sql(name: str, source: str, tolerance: int) -> str:
    return f"""{name} AS (SELECT session_id, seq, s_ts, s_seq FROM (SELECT i.session_id, i.seq, s.timestamp_ns AS s_ts,
    s.seq AS s_seq, row_number() OVER (PARTITION BY i.session_id, i.seq ORDER BY abs(s.timestamp_ns - i.timestamp_ns), s.seq) AS rn
  FROM images i JOIN {source} s ON s.session_id = i.session_id AND abs(s.timestamp_ns - i.timestamp_ns) <= {tolerance})
  WHERE rn = 1)"""


FINAL = """final AS (SELECT i.session_id, i.seq, i.timestamp_ns, m.seq AS meta_seq, CASE WHEN m.seq IS NOT NULL THEN (
    SELECT CASE WHEN min(p.seq) IS NOT NULL THEN greatest(i.seq, m.seq, min(p.seq)) END FROM tracked p
    WHERE p.session_id = i.session_id AND p.timestamp_ns >= i.timestamp_ns) END AS finalize_seq
  FROM images i LEFT JOIN still_metadata m USING (session_id, timestamp_ns))"""


def held_sql(name: str, source: str, tolerance: int, n: int) -> str:
    return f"""{name}_r AS (SELECT session_id, seq, timestamp_ns, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rk FROM {source}),
{name}_n AS (SELECT f.*, (SELECT count(*) FROM {source} s WHERE s.session_id = f.session_id AND s.seq <= f.finalize_seq) AS r FROM final f),
{name} AS (SELECT session_id, seq, s_ts, s_seq FROM (SELECT f.session_id, f.seq, s.timestamp_ns AS s_ts, s.seq AS s_seq,
    row_number() OVER (PARTITION BY f.session_id, f.seq ORDER BY abs(s.timestamp_ns - f.timestamp_ns), s.seq) AS rn
  FROM {name}_n f JOIN {name}_r s ON s.session_id = f.session_id AND s.rk <= f.r AND s.rk > f.r - {n}) q
  WHERE rn = 1)"""


def rows_sql(e: int, iso: int, depth: bool) -> str:
    """One row per image with its outcome, from near_pose and near_depth."""
    rejected_depth = "WHEN d.s_seq IS NULL THEN 'rejected_depth'" if depth else ""
    join = "LEFT JOIN near_depth d USING (session_id, seq)" if depth else ""
    columns = ", d.s_seq AS depth_seq, d.s_ts - i.timestamp_ns AS depth_delta_ns" if depth else ""
    return f"""rows_ AS (SELECT i.session_id, i.seq, i.timestamp_ns, CASE WHEN m.seq IS NULL THEN 'pending_metadata'
    WHEN coalesce((SELECT max(p.timestamp_ns) FROM tracked p WHERE p.session_id = i.session_id) < i.timestamp_ns, true) THEN 'pending_pose'
    WHEN NOT (coalesce(exposure_time_ns <= {e}, false) AND coalesce(iso <= {iso}, false) AND coalesce(lens_state = 0, true)
      AND coalesce(ois_mode = 0, true) AND coalesce(video_stabilization_mode = 0, true)
      AND coalesce(af_state IN (0, 2, 4), true)) THEN 'rejected_quality'
    WHEN n.s_seq IS NULL THEN 'rejected_pose' {rejected_depth} ELSE 'saved' END AS outcome,
    n.s_seq AS pose_seq, n.s_ts - i.timestamp_ns AS pose_delta_ns {columns}
  FROM images i LEFT JOIN still_metadata m USING (session_id, timestamp_ns)
  LEFT JOIN near_pose n ON n.session_id = i.session_id AND n.seq = i.seq {join.replace('USING (session_id, seq)', 'ON d.session_id = i.session_id AND d.seq = i.seq')}),
kf AS (SELECT *, CASE WHEN outcome = 'saved' THEN cast(row_number() OVER (PARTITION BY session_id, outcome ORDER BY timestamp_ns, seq) AS int) END
  AS capture_index FROM rows_)"""


PHOTO_TABLES = ("images", "still_metadata", "poses", "depth_frames_ref")
NEAREST = ", ".join((TRACKED, near_sql("near_pose", "tracked", 75_000_000),
                     near_sql("near_depth", "depth_frames_ref", 250_000_000), rows_sql(4_000_000, 3200, True)))
OUT = "session_id, seq, timestamp_ns, outcome, capture_index, pose_seq, pose_delta_ns"

CAUSAL_SQL = sql(
        f"SELECT {OUT}, depth_seq, depth_delta_ns FROM kf", *PHOTO_TABLES, extra=", ".join((
            TRACKED, FINAL, held_sql("held_pose", "tracked", 75_000_000, 180),
            held_sql("held_depth", "depth_frames_ref", 250_000_000, 24),
            *(f"near_{k} AS (SELECT h.* FROM held_{k} h JOIN images i ON i.session_id = h.session_id AND i.seq = h.seq "
              f"WHERE abs(h.s_ts - i.timestamp_ns) <= {t})" for k, t in (("pose", 75_000_000), ("depth", 250_000_000))),
            rows_sql(4_000_000, 3200, True))))


def report_sql(finalized: str, more: str) -> str:
    counts = ", ".join(f"count(*) FILTER (decision = '{d}') AS n_{d}" for d in DECISIONS)
    return sql(f"""
SELECT session_id, coalesce(frames, 0) AS frames, last_decision, {', '.join(f'coalesce(n_{d}, 0) AS n_{d}' for d in DECISIONS)},
  coalesce(keyframes, 0) AS keyframes, coalesce(depth_frames, 0) AS depth_frames, {finalized} AS finalized,
  concat('Raw depth: ', coalesce(depth_frames, 0), ' / keyframes: ', coalesce(keyframes, 0), ' / ',
         CASE WHEN {finalized} THEN 'saved' ELSE 'capturing' END) AS status
FROM (SELECT session_id, count(*) AS frames, arg_max(decision, seq) AS last_decision, {counts} FROM decisions GROUP BY session_id)
FULL JOIN (SELECT session_id, count(*) FILTER (outcome = 'saved') AS keyframes FROM kf GROUP BY session_id) USING (session_id)
FULL JOIN (SELECT session_id, least(count(*), 60) AS depth_frames FROM depth_frames_ref GROUP BY session_id) USING (session_id)
{more}""", *PHOTO_TABLES, extra=fold_sql(DATASET, False) + ", " + NEAREST.replace(TRACKED + ", ", ""), recursive=True)


QUERIES = {
    "match_metadata": (metadata, sql(
        "SELECT i.session_id, i.seq, i.timestamp_ns, m.seq AS meta_seq, exposure_time_ns, iso FROM images i "
        "LEFT JOIN still_metadata m USING (session_id, timestamp_ns)", "images", "still_metadata")),
    "pose_ready": (ready, sql(
        "SELECT session_id, seq, timestamp_ns, coalesce((SELECT max(p.timestamp_ns) FROM tracked p WHERE p.session_id = "
        "i.session_id) >= timestamp_ns, false) AS pose_ready FROM images i", "images", "poses", extra=TRACKED)),
    "nearest_pose": (closest_pose, sql(
        "SELECT session_id, seq, timestamp_ns, s_ts AS pose_timestamp_ns, s_seq AS pose_seq FROM images "
        "LEFT JOIN near_pose USING (session_id, seq)", "images", "poses",
        extra=f"{TRACKED}, {near_sql('near_pose', 'tracked', 75_000_000)}")),
    "nearest_depth": (closest_depth, sql(
        "SELECT session_id, seq, timestamp_ns, s_ts AS depth_timestamp_ns, s_seq AS depth_seq FROM images "
        "LEFT JOIN near_depth USING (session_id, seq)", "images", "depth_frames_ref",
        extra=near_sql("near_depth", "depth_frames_ref", 250_000_000))),
    "nearest_depth_causal": (closest_depth_causal, sql(
        "SELECT session_id, seq, timestamp_ns, finalize_seq, CASE WHEN abs(s_ts - timestamp_ns) <= 250000000 THEN s_ts END "
        "AS depth_timestamp_ns, CASE WHEN abs(s_ts - timestamp_ns) <= 250000000 THEN s_seq END AS depth_seq FROM final "
        "LEFT JOIN near_depth USING (session_id, seq)", *PHOTO_TABLES,
        extra=", ".join((TRACKED, FINAL, held_sql("near_depth", "depth_frames_ref", 250_000_000, 24))))),
    "retained_poses": (held, sql(
        "SELECT session_id, seq, greatest(1, r - 23) AS first_rank, r AS last_rank, least(r, 24) AS held FROM (SELECT "
        "session_id, seq, (SELECT count(*) FROM tracked p WHERE p.session_id = i.session_id AND p.seq <= i.seq) AS r "
        "FROM images i)", "images", "poses", extra=TRACKED)),
    "assemble_keyframes": (assembled, sql(f"SELECT {OUT}, depth_seq, depth_delta_ns FROM kf", *PHOTO_TABLES, extra=NEAREST)),
    "assemble_keyframes_highres": (lambda s, d: assembled(s, d, HIGHRES_GENERIC), sql(
        f"SELECT {OUT} FROM kf", *PHOTO_TABLES,
        extra=", ".join((TRACKED, near_sql("near_pose", "tracked", 50_000_000), rows_sql(3_333_333, 1600, False))))),
    "assemble_keyframes_causal": (lambda s, d: assembled(s, d, DATASET, "causal"), CAUSAL_SQL),
    "outcome_counts": (outcome_counts, sql(
        f"SELECT session_id, outcome, count(*) AS images, {rq('avg(abs(pose_delta_ns))/1e6', 'mean_pose_delta_ms', 4)} "
        "FROM kf GROUP BY session_id, outcome", *PHOTO_TABLES, extra=NEAREST)),
    "rejected_images": (rejected, sql(
        "SELECT session_id, seq, timestamp_ns, outcome FROM kf WHERE outcome <> 'saved'", *PHOTO_TABLES, extra=NEAREST)),
    "images_by_metadata": (unmatched, sql(
        "SELECT session_id, seq, timestamp_ns, EXISTS (SELECT 1 FROM still_metadata m WHERE m.session_id = i.session_id "
        "AND m.timestamp_ns = i.timestamp_ns) AS has_metadata FROM images i", "images", "still_metadata")),
    "session_ready": (saveable, sql(
        "SELECT session_id, count(*) FILTER (outcome LIKE 'pending%') AS pending, "
        "count(*) FILTER (outcome LIKE 'pending%') = 0 AS ready FROM kf GROUP BY session_id", *PHOTO_TABLES, extra=NEAREST)),
    "evict_metadata": (evicted, sql("""
SELECT m.session_id, m.seq, m.timestamp_ns FROM still_metadata m
LEFT JOIN (SELECT session_id, count(*) AS held FROM still_metadata GROUP BY session_id) c USING (session_id)
LEFT JOIN (SELECT session_id, arg_min(timestamp_ns, seq) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY session_id
  ORDER BY seq DESC) AS rn FROM tracked) WHERE rn <= 20 GROUP BY session_id) o USING (session_id)
WHERE NOT (held > 8 AND coalesce(m.timestamp_ns < oldest - 50000000, false))""", "still_metadata", "poses", extra=TRACKED)),
    "capture_report": (report, report_sql("false", "")),
    "capture_report_all": (report_all, report_sql("coalesce(ck % 3 = 0, false)", """FULL JOIN (SELECT c_custkey AS ck,
  concat('s', lpad(cast(c_custkey AS varchar), 6, '0')) AS session_id FROM customer) USING (session_id)""")),
    "assemble_keyframes_causal_chunked": (lambda s, d: assembled(s, d, DATASET, "causal", 13), CAUSAL_SQL),
    "depth_frames_held": (displayed, sql(
        "SELECT session_id, least(count(*), 30) AS depth_frames FROM depth_frames_ref GROUP BY session_id",
        "depth_frames_ref")),
}
