"""Frame-level queries: gates, motion and keyframe selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.catalog.common import (MOTION_SQL, poses, r, rq, sql, sql_relative, sql_rotate, tracking)
from capturelake.fixtures import table
from capturelake.functions.pose import (FIELDS, forward_world, pose, pose_compose, pose_inverse, pose_matrix,
                                        rotation_degrees, translation_distance, up_world)
from capturelake.operators.choose import choose_camera_config, choose_jpeg_size
from capturelake.operators.gates import (capture_enabled, is_focused, is_frame_sharp, is_pose_stable,
                                         is_still_sharp, viewpoint_changed)
from capturelake.operators.motion import (attach_root, last_n, latest_camera_state, motion, new_depth_only,
                                          root_relative, session_roots, time_since_last)
from capturelake.operators.report import recent_log_lines
from capturelake.operators.select import select_keyframes
from capturelake.plans.chunks import SEQ_CHUNK, Running, running
from capturelake.plans.exposure import exposure_plan
from capturelake.functions.imaging import is_four_by_three, megapixels, pixel_count, session_name
from capturelake.policies import DATASET, HIGHRES_GENERIC, HIGHRES_PIXEL10A, LOG_LINES, PHOTO_GENERIC, Policy, resolve_policy

KEY = ("session_id", "seq")


def pose_columns(c: str = "pose") -> list:
    return [r(f"{c}.{f}").alias(f) for f in FIELDS]


def read_poses(spark: SparkSession, sf: str) -> DataFrame:
    return poses(spark, sf).select(*KEY, "timestamp_ns", "tracking_state", *pose_columns(),
                                   r("image_k.fx").alias("fx"), "lens_state", "af_state")


def tracking_frames(spark: SparkSession, sf: str) -> DataFrame:
    return tracking(spark, sf).select(*KEY, "timestamp_ns")


def focus_gate(spark: SparkSession, sf: str) -> DataFrame:
    af = F.col("af_state")
    return table(spark, sf, "camera_states").select(
        *KEY, is_focused(af, True).alias("focused"), is_focused(af, False).alias("focused_known"))


def still_sharp(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "still_metadata").select(
        *KEY, is_still_sharp(DATASET).alias("sharp_dataset"), is_still_sharp(HIGHRES_GENERIC).alias("sharp_highres"))


def frame_sharp(spark: SparkSession, sf: str) -> DataFrame:
    states = table(spark, sf, "camera_states").select(*KEY, "exposure_time_ns")
    return motion(tracking(spark, sf)).join(states, list(KEY)).select(
        *KEY, is_frame_sharp(PHOTO_GENERIC).alias("sharp"))


def pose_stable(spark: SparkSession, sf: str) -> DataFrame:
    return motion(tracking(spark, sf)).select(*KEY, is_pose_stable(DATASET).alias("stable"))


def moved_view(spark: SparkSession, sf: str) -> DataFrame:
    prev = Running("_p", "last", F.struct("pose", "timestamp_ns"), inclusive=False)
    return running(tracking(spark, sf), [prev]).select(*KEY, viewpoint_changed(
        F.col("pose"), F.col("timestamp_ns"), F.col("_p.pose"), F.col("_p.timestamp_ns"), DATASET).alias("changed"))


def enabled_frames(spark: SparkSession, sf: str) -> DataFrame:
    return capture_enabled(tracking(spark, sf), table(spark, sf, "control_events")).select(*KEY, "enabled")


def frame_motion(spark: SparkSession, sf: str, width: int = SEQ_CHUNK) -> DataFrame:
    return motion(tracking(spark, sf), width).select(*KEY, r("linear_mps", 5).alias("linear_mps"),
                                              r("angular_dps", 3).alias("angular_dps"))


def camera_state(spark: SparkSession, sf: str, width: int = SEQ_CHUNK) -> DataFrame:
    return latest_camera_state(table(spark, sf, "camera_states"), width=width).select(
        *KEY, "exposure_time_ns", "iso", "focus_distance", "af_state", "lens_state")


def roots(spark: SparkSession, sf: str) -> DataFrame:
    return session_roots(tracking(spark, sf)).select("session_id", *pose_columns("root"))


def rebased(spark: SparkSession, sf: str) -> DataFrame:
    frames = tracking(spark, sf)
    return root_relative(attach_root(frames, session_roots(frames))).select(*KEY, *pose_columns())


def fresh_depth(spark: SparkSession, sf: str) -> DataFrame:
    # Every third depth frame repeats the clock of the arrival before it.
    return new_depth_only(repeated_depth(spark, sf)).select(*KEY, "timestamp_ns")


def repeated_depth(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "depth_frames_ref").withColumn(
        "timestamp_ns", F.expr("timestamp_ns - timestamp_ns % 500000000"))


def newest_depth(spark: SparkSession, sf: str, width: int = SEQ_CHUNK) -> DataFrame:
    return last_n(table(spark, sf, "depth_frames_ref"), 24, width=width).select(*KEY, "frame_id")


LINE = "concat('lens ', lens_state, ' focus ', coalesce(cast(af_state AS varchar(9)), 'unknown'))"


def log_lines(spark: SparkSession, sf: str, n: int = LOG_LINES) -> DataFrame:
    lines = table(spark, sf, "camera_states").select(*KEY, F.expr(LINE).alias("line"))
    return recent_log_lines(lines, n)


def log_lines_sql(n: int) -> str:
    return sql(f"SELECT session_id, seq, line FROM (SELECT session_id, seq, {LINE} AS line, row_number() OVER (PARTITION BY session_id "
               f"ORDER BY seq DESC) AS rn FROM camera_states) WHERE rn <= {n}", "camera_states")


def decided(spark: SparkSession, sf: str, policy: Policy, controls: bool = False, width: int = SEQ_CHUNK) -> DataFrame:
    return select_keyframes(tracking(spark, sf), policy, table(spark, sf, "control_events") if controls else None, width)


def since_last(spark: SparkSession, sf: str) -> DataFrame:
    return time_since_last(decided(spark, sf, DATASET)).select(*KEY, "since_frame_ns", "since_request_ns")


def pose_algebra(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "depth_frames_meta").withColumn("pose", pose())
    ident = pose_compose(pose_inverse(F.col("pose")), F.col("pose"))
    step = pose(F.lit(0.1), F.lit(0.2), F.lit(0.3), F.lit(0.0), F.lit(0.6), F.lit(0.0), F.lit(0.8))
    m = pose_matrix(F.col("pose"))
    inv = pose_inverse(F.col("pose"))
    next_pose = pose_compose(F.col("pose"), step)
    return p.select(
        "frame_id", r(ident["tx"]).alias("id_tx"), r(ident["qw"]).alias("id_qw"),
        *[r(inv[f]).alias(f"inv_{f}") for f in ("tx", "ty", "tz", "qy")],
        *[r(m[i]).alias(f"m{i}") for i in (0, 2, 8, 12, 15)],
        r(translation_distance(F.col("pose"), next_pose)).alias("moved"),
        r(rotation_degrees(F.col("pose"), next_pose), 4).alias("turned"),
        *[r(forward_world(F.col("pose"))[i]).alias(f"fwd{i}") for i in range(3)],
        *[r(up_world(F.col("pose"))[i]).alias(f"up{i}") for i in range(3)])


def jpeg_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return choose_jpeg_size(table(spark, sf, "camera_sizes"))


def size_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    return table(spark, sf, "camera_sizes").select(
        "camera_id", "ord", pixel_count(w, h).alias("pixels"), r(megapixels(w, h)).alias("megapixels"),
        is_four_by_three(w, h).alias("four_by_three"))


CURRENT = """SELECT device_id, max(ord) + 1 AS ord, concat('cam', cast(max(ord) % 4 AS {string})) AS camera_id,
  640 AS cpu_w, 480 AS cpu_h, 1280 AS gpu_w, 720 AS gpu_h FROM camera_configs GROUP BY device_id"""


def camera_choice(spark: SparkSession, sf: str) -> DataFrame:
    configs = table(spark, sf, "camera_configs")
    current = spark.sql(CURRENT.format(string="string").replace("camera_configs", "{src}"), src=configs)
    return choose_camera_config(configs, current)


REQUESTS = """SELECT *, concat('cam', cast(seq % 5 AS {string})) AS camera_id FROM requested"""
CAPS = """SELECT concat('cam', cast(n AS {string})) AS camera_id,
  CASE WHEN n = 4 THEN NULL ELSE 100000 + n*1000000 END AS exposure_min, 20000000 + n AS exposure_max,
  50 + n*150 AS iso_min, 1600*(n + 1) AS iso_max,
  CASE WHEN n = 1 THEN NULL ELSE 2e0 + n END AS min_focus_distance,
  n <> 3 AS manual, CASE WHEN n = 2 THEN NULL ELSE 90*n END AS sensor_orientation
  FROM (SELECT n FROM (SELECT DISTINCT p_partkey % 5 AS n FROM {part}) d) c"""


def planned(spark: SparkSession, sf: str) -> DataFrame:
    asked = decided(spark, sf, DATASET).where("decision = 'requested'").drop("decision", "timestamp_ns")
    requests = asked.withColumn("camera_id", F.concat(F.lit("cam"), (F.col("seq") % 5).cast("string")))
    caps = spark.sql(CAPS.format(string="string", part="{src}"), src=table(spark, sf, "part"))
    caps = caps.withColumn("capabilities", F.when(F.col("manual"), F.array(F.lit(0), F.lit(1)))).withColumn(
        "ois_modes", F.when(F.col("camera_id") != "cam3", F.array(F.lit(0), F.lit(1))))
    plan = exposure_plan(requests, table(spark, sf, "camera_states"), caps, DATASET)
    return plan.withColumn("planned_focus", r("planned_focus"))


def session_policies(spark: SparkSession, sf: str) -> DataFrame:
    sessions = table(spark, sf, "customer").selectExpr(
        "c_custkey", "CASE c_custkey % 3 WHEN 0 THEN 'dataset' WHEN 1 THEN 'highres' ELSE 'photo' END AS profile",
        "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Google PIXEL 10a' ELSE 'Pixel 9' END AS model")
    return resolve_policy(sessions).select(
        "c_custkey", "profile", F.col("policy.device_class").alias("device_class"),
        F.col("policy.min_interval_ns").alias("min_interval_ns"), F.col("policy.max_linear_mps").alias("max_linear_mps"),
        F.col("policy.max_exposure_ns").alias("max_exposure_ns"), F.col("policy.max_iso").alias("max_iso"))


def session_names(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return ev.groupBy("user_id").agg(F.min("ts").alias("ts")).select(
        "user_id", F.concat(F.lit("capture_tmp_"), session_name(F.col("ts"))).alias("directory"))


def photo_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Tracking frames with the exposure of their own camera state."""
    exposures = table(spark, sf, "camera_states").select(*KEY, "exposure_time_ns", "iso")
    return tracking(spark, sf).join(exposures, list(KEY))


def fold_sql(p: Policy, controls: bool) -> str:
    """Selection as a recursive statement: one step per frame and session, carrying the last request."""
    if controls:
        marked = """
    SELECT f.*, (SELECT max(c.seq) FROM control_events c WHERE c.session_id = f.session_id AND c.seq <= f.seq
        AND c.kind IN ('photo_arrived', 'request_failed', 'result_without_timestamp')) AS clear_seq,
      coalesce((SELECT arg_max(c.kind = 'resume', c.seq) FROM control_events c WHERE c.session_id = f.session_id
        AND c.seq <= f.seq AND c.kind IN ('stop', 'resume')), true) AS enabled FROM f"""
        flight = "WHEN n.last_seq IS NOT NULL AND coalesce(b.clear_seq, -1) <= n.last_seq THEN 'in_flight'"
    else:
        marked = "SELECT f.*, true AS enabled FROM f"
        flight = ""
    exposure = ""
    if p.profile == "photo":
        marked = ("SELECT f.*, true AS enabled, c.exposure_time_ns, c.iso FROM f "
                  "JOIN camera_states c USING (session_id, seq)")
        exposure = f"WHEN exposure_time_ns > {p.max_exposure_ns} THEN 'exposure'"
    last = ("last_seq", "last_ts", *[f"l{c}" for c in FIELDS])
    now = ("seq", "timestamp_ns", *FIELDS)
    keep = ", ".join(f"CASE WHEN d = 'requested' THEN {b} ELSE {a} END" for a, b in zip(last, now))
    names = ", ".join(last)
    moved = ("sqrt((b.tx-n.ltx)*(b.tx-n.ltx) + (b.ty-n.lty)*(b.ty-n.lty) + (b.tz-n.ltz)*(b.tz-n.ltz)) >= "
             f"{p.min_translation_m!r} OR degrees(2*acos(least(1e0, abs(b.qx*n.lqx + b.qy*n.lqy + b.qz*n.lqz + "
             f"b.qw*n.lqw)))) >= {p.min_rotation_deg!r}")
    extra = f"""{MOTION_SQL},
marked AS ({marked}),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn,
  CASE WHEN linear_mps > {p.max_linear_mps!r} OR angular_dps > {p.max_angular_dps!r} THEN 'motion'
       WHEN lens_state <> 0 THEN 'lens' WHEN af_state NOT IN (0, 2, 4) THEN 'focus' {exposure} END AS block FROM marked),
starts AS (SELECT session_id AS sid, 0::BIGINT AS step, NULL::BIGINT AS s_seq, NULL::BIGINT AS s_ts,
  NULL::VARCHAR AS dec, NULL::BIGINT AS last_seq, NULL::BIGINT AS last_ts,
  {', '.join(f'NULL::DOUBLE AS l{c}' for c in FIELDS)} FROM (SELECT DISTINCT session_id FROM b)),
n AS (
  SELECT * FROM starts
  UNION ALL
  SELECT session_id, rn, seq, timestamp_ns, d, {keep} FROM (
    SELECT b.session_id, b.rn, b.seq, b.timestamp_ns, {', '.join(f'b.{c}' for c in FIELDS)},
      {', '.join(f'n.{c}' for c in last)},
      CASE WHEN NOT b.enabled THEN 'capture_stopped' {flight}
           WHEN n.last_ts IS NOT NULL AND b.timestamp_ns - n.last_ts < {p.min_interval_ns} THEN 'interval'
           WHEN n.last_ts IS NOT NULL AND NOT (b.timestamp_ns - n.last_ts >= {p.force_after_ns} OR {moved}) THEN 'viewpoint'
           WHEN b.block IS NOT NULL THEN b.block ELSE 'requested' END AS d
    FROM n JOIN b ON b.session_id = n.sid AND b.rn = n.step + 1) q),
decisions AS (SELECT sid AS session_id, s_seq AS seq, s_ts AS timestamp_ns, dec AS decision FROM n WHERE step > 0)"""
    return extra


def decisions_sql(p: Policy, controls: bool = False,
                  body: str = "SELECT * FROM decisions") -> str:
    more = ["control_events"] if controls else ["camera_states"] if p.profile == "photo" else []
    return sql(body, "poses", *more, extra=fold_sql(p, controls), recursive=True)


def bounded(lo: str, hi: str, v: str) -> str:
    return f"greatest({lo}, least({hi}, {v}))"


PLAN_SQL = f"""
requested AS (SELECT session_id, seq FROM decisions WHERE decision = 'requested'),
caps AS ({CAPS.format(string='varchar', part='part')}),
held AS (SELECT session_id, seq, {', '.join(
    f"last_value({c} IGNORE NULLS) OVER w AS {c}"
    for c in ('exposure_time_ns', 'iso', 'focus_distance', 'af_state', 'lens_state'))}
  FROM camera_states WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
ask AS (SELECT q.session_id, q.seq, q.camera_id, h.exposure_time_ns, h.iso, h.focus_distance, h.af_state, h.lens_state,
    c.exposure_min, c.exposure_max, c.iso_min, c.iso_max, c.min_focus_distance, c.manual, c.sensor_orientation,
    exposure_min AS lo_e, least(exposure_max, 4000000) AS hi_e, iso_min AS lo_i, least(iso_max, 3200) AS hi_i,
    cast(h.exposure_time_ns AS double) * h.iso AS product
  FROM ({REQUESTS.format(string='varchar')}) q LEFT JOIN held h USING (session_id, seq) LEFT JOIN caps c USING (camera_id)),
s1 AS (SELECT *, {bounded('lo_e', 'hi_e', '2000000')} AS first_e, ceil(product / hi_i) AS needed FROM ask),
s2 AS (SELECT *, ceil(product / first_e) AS want FROM s1),
s3 AS (SELECT *, CASE WHEN want < lo_i THEN {bounded('lo_e', 'hi_e', 'floor(product/lo_i + 0.5e0)')}
    WHEN want > hi_i THEN {bounded('lo_e', 'hi_e', 'needed')} ELSE first_e END AS e FROM s2),
s4 AS (SELECT *, CASE WHEN NOT manual THEN 'manual_unsupported'
    WHEN exposure_time_ns IS NULL OR iso IS NULL OR focus_distance IS NULL THEN 'no_metadata'
    WHEN lens_state <> 0 THEN 'lens_moving' WHEN af_state NOT IN (0, 2, 4) THEN 'af_not_converged'
    WHEN exposure_min IS NULL OR exposure_max IS NULL OR iso_min IS NULL OR iso_max IS NULL THEN 'range_unavailable'
    WHEN lo_e > hi_e OR lo_i > hi_i THEN 'range_invalid'
    WHEN want > hi_i AND needed > hi_e THEN 'too_dark' ELSE 'ok' END AS reason FROM s3)"""

PREV = "lag({c}) OVER (PARTITION BY session_id ORDER BY seq)"
STAND = "coalesce(lens_state = 0, true) AND coalesce(af_state IN (0, 2, 4), true)"
STILL = ("coalesce(exposure_time_ns <= {e}, false) AND coalesce(iso <= {i}, false) AND coalesce(lens_state = 0, true) "
         "AND coalesce(ois_mode = 0, true) AND coalesce(video_stabilization_mode = 0, true) "
         "AND coalesce(af_state IN (0, 2, 4), true)")
POSE_R = ", ".join(rq(f, f) for f in FIELDS)

QUERIES = {
    # sources and gates
    "read_poses": (read_poses, sql(
        f"SELECT session_id, seq, timestamp_ns, tracking_state, {POSE_R}, {rq('fx', 'fx')}, lens_state, af_state FROM poses",
        "poses")),
    "tracking_frames": (tracking_frames, sql(
        "SELECT session_id, seq, timestamp_ns FROM poses WHERE tracking_state = 'TRACKING'", "poses")),
    "focus_gate": (focus_gate, sql(
        "SELECT session_id, seq, coalesce(af_state IN (0,2,4), true) AS focused, "
        "coalesce(af_state IN (0,2,4), false) AS focused_known FROM camera_states", "camera_states")),
    "still_sharp": (still_sharp, sql(
        f"SELECT session_id, seq, {STILL.format(e=4000000, i=3200)} AS sharp_dataset, "
        f"{STILL.format(e=3333333, i=1600)} AS sharp_highres FROM still_metadata", "still_metadata")),
    "frame_sharp": (frame_sharp, sql(
        f"SELECT session_id, seq, linear_mps <= 0.10 AND angular_dps <= 8.0 AND coalesce(c.exposure_time_ns <= 12500000, true) "
        f"AND coalesce(f.lens_state = 0, true) AND coalesce(f.af_state IN (0,2,4), true) AS sharp "
        "FROM f JOIN camera_states c USING (session_id, seq)", "poses", "camera_states", extra=MOTION_SQL)),
    "pose_stable": (pose_stable, sql(
        f"SELECT session_id, seq, linear_mps <= 0.25 AND angular_dps <= 20.0 AND {STAND} AS stable FROM f",
        "poses", extra=MOTION_SQL)),
    "viewpoint_changed": (moved_view, sql(
        "SELECT session_id, seq, p_ts IS NULL OR timestamp_ns - p_ts >= 2000000000 "
        "OR sqrt((tx-ptx)*(tx-ptx) + (ty-pty)*(ty-pty) + (tz-ptz)*(tz-ptz)) >= 0.03 "
        "OR degrees(2*acos(least(1e0, abs(qx*pqx + qy*pqy + qz*pqz + qw*pqw)))) >= 2.5 AS changed FROM f",
        "poses", extra=MOTION_SQL)),
    "capture_enabled": (enabled_frames, sql(
        "SELECT f.session_id, f.seq, coalesce((SELECT arg_max(c.kind = 'resume', c.seq) FROM control_events c "
        "WHERE c.session_id = f.session_id AND c.seq <= f.seq AND c.kind IN ('stop', 'resume')), true) AS enabled "
        "FROM tracked f", "poses", "control_events", extra=MOTION_SQL)),
    # motion and state
    "frame_motion": (frame_motion, sql(
        f"SELECT session_id, seq, {rq('linear_mps', 'linear_mps', 5)}, {rq('angular_dps', 'angular_dps', 3)} FROM f",
        "poses", extra=MOTION_SQL)),
    "latest_camera_state": (camera_state, sql(
        "SELECT session_id, seq, " + ", ".join(
            f"last_value({c} IGNORE NULLS) OVER w AS {c}"
            for c in ("exposure_time_ns", "iso", "focus_distance", "af_state", "lens_state"))
        + " FROM camera_states WINDOW w AS (PARTITION BY session_id ORDER BY seq)", "camera_states")),
    "session_roots": (roots, sql(
        f"SELECT session_id, {POSE_R} FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn "
        "FROM tracked) WHERE rn = 1", "poses", extra=MOTION_SQL)),
    "root_relative_poses": (rebased, sql(
        "SELECT p.session_id, p.seq, " + ", ".join(rq(e, k) for k, e in sql_relative("o.", "p.").items())
        + " FROM tracked p JOIN (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM tracked) o "
        "ON o.session_id = p.session_id AND o.rn = 1", "poses", extra=MOTION_SQL)),
    "new_depth_only": (fresh_depth, sql(
        "SELECT session_id, seq, t AS timestamp_ns FROM (SELECT session_id, seq, t, lag(t) OVER "
        "(PARTITION BY session_id ORDER BY seq) AS p FROM (SELECT *, timestamp_ns - timestamp_ns % 500000000 AS t "
        "FROM depth_frames_ref)) WHERE p IS NULL OR p <> t", "depth_frames_ref")),
    "newest_depth_frames": (newest_depth, sql(
        "SELECT session_id, seq, frame_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) "
        "AS rn FROM depth_frames_ref) WHERE rn <= 24", "depth_frames_ref")),
    "recent_log_lines": (log_lines, log_lines_sql(LOG_LINES)),
    "recent_log_lines_narrow": (lambda s, d: log_lines(s, d, 20), log_lines_sql(20)),
    "time_since_last": (since_last, decisions_sql(DATASET, body=(
        "SELECT session_id, seq, timestamp_ns - lag(timestamp_ns) OVER w AS since_frame_ns, timestamp_ns - last_value("
        "CASE WHEN decision = 'requested' THEN timestamp_ns END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since_request_ns FROM decisions "
        "WINDOW w AS (PARTITION BY session_id ORDER BY seq)"))),
    # selection
    "select_keyframes": (lambda s, d: decided(s, d, DATASET), decisions_sql(DATASET)),
    "select_keyframes_highres": (lambda s, d: decided(s, d, HIGHRES_PIXEL10A), decisions_sql(HIGHRES_PIXEL10A)),
    "select_keyframes_photo": (lambda s, d: select_keyframes(photo_frames(s, d), PHOTO_GENERIC), decisions_sql(PHOTO_GENERIC)),
    "select_keyframes_with_controls": (lambda s, d: decided(s, d, DATASET, True), decisions_sql(DATASET, True)),
    "choose_jpeg_size": (jpeg_sizes, sql(
        "SELECT camera_id, ord, width, height, tier FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY tier, "
        "CASE WHEN tier < 2 THEN -px ELSE px END, CASE WHEN tier < 2 THEN ord ELSE -ord END) AS rn FROM ("
        "SELECT *, width*height AS px, CASE WHEN width*height > 13000000 THEN 2 WHEN "
        "abs(greatest(width, height)*1e0/least(width, height) - 4e0/3e0) < 0.04 THEN 0 ELSE 1 END AS tier "
        "FROM camera_sizes)) WHERE rn = 1", "camera_sizes")),
    "size_catalogue": (size_catalogue, sql(
        f"SELECT camera_id, ord, cast(width*height AS bigint) AS pixels, {rq('width*height/1e6', 'megapixels')}, "
        "abs(greatest(width, height)*1e0/least(width, height) - 4e0/3e0) < 0.04 AS four_by_three FROM camera_sizes",
        "camera_sizes")),
    "choose_camera_config": (camera_choice, sql("""
SELECT n.device_id, coalesce(p.ord, n.ord) AS ord, coalesce(p.camera_id, n.camera_id) AS camera_id,
  coalesce(p.cpu_w, n.cpu_w) AS cpu_w, coalesce(p.cpu_h, n.cpu_h) AS cpu_h, coalesce(p.gpu_w, n.gpu_w) AS gpu_w,
  coalesce(p.gpu_h, n.gpu_h) AS gpu_h,
  CASE WHEN p.ord IS NULL THEN 'current' WHEN p.same THEN 'same_camera' ELSE 'any_camera' END AS choice
FROM cur n LEFT JOIN (SELECT c.*, c.camera_id = n.camera_id AS same, row_number() OVER (PARTITION BY c.device_id ORDER BY
    CASE WHEN c.camera_id = n.camera_id THEN 0 ELSE 1 END, c.cpu_w*c.cpu_h, -c.gpu_w*c.gpu_h, c.ord) AS rn
  FROM camera_configs c JOIN cur n USING (device_id) WHERE c.fps = 30 AND NOT c.depth_sensor_used) p
ON p.device_id = n.device_id AND p.rn = 1""", "camera_configs", extra=f"cur AS ({CURRENT.format(string='varchar')})")),
    # planning and algebra
    "exposure_plan": (planned, sql(
        "SELECT session_id, seq, camera_id, CASE WHEN reason = 'ok' THEN cast(e AS bigint) END AS planned_exposure_ns, "
        f"CASE WHEN reason = 'ok' THEN cast({bounded('lo_i', 'hi_i', 'floor(product/e + 0.5e0)')} AS int) END AS planned_iso, "
        "CASE WHEN reason = 'ok' THEN round(CASE WHEN min_focus_distance IS NULL THEN greatest(0e0, focus_distance) "
        "ELSE least(greatest(0e0, focus_distance), min_focus_distance) END, 6) + 0e0 END AS planned_focus, "
        "camera_id <> 'cam3' AS ois_can_be_off, (coalesce(sensor_orientation, 90) + 360) % 360 AS sensor_orientation_degrees, "
        "reason FROM s4", "poses", "camera_states", extra=fold_sql(DATASET, False) + "," + PLAN_SQL, recursive=True)),
    "resolve_policy": (session_policies, """
SELECT c_custkey, profile, cls AS device_class,
  cast(CASE profile WHEN 'dataset' THEN 700000000 ELSE 650000000 END AS bigint) AS min_interval_ns,
  CASE WHEN profile = 'dataset' THEN 0.25e0 WHEN cls = 'pixel10a' THEN 0.08e0 ELSE 0.10e0 END AS max_linear_mps,
  cast(CASE profile WHEN 'dataset' THEN 4000000 WHEN 'highres' THEN 3333333 ELSE
    CASE WHEN cls = 'pixel10a' THEN 10000000 ELSE 12500000 END END AS bigint) AS max_exposure_ns,
  cast(CASE profile WHEN 'dataset' THEN 3200 WHEN 'highres' THEN 1600 END AS bigint) AS max_iso
FROM (SELECT *, CASE WHEN profile = 'dataset' THEN 'any' WHEN c_custkey % 5 <> 0 AND c_custkey % 2 = 0 THEN 'pixel10a'
    ELSE 'generic' END AS cls FROM (SELECT c_custkey,
  CASE c_custkey % 3 WHEN 0 THEN 'dataset' WHEN 1 THEN 'highres' ELSE 'photo' END AS profile FROM customer))"""),
    "session_names": (session_names,
        "SELECT user_id, 'capture_tmp_' || strftime(min(ts), '%Y%m%d_%H%M%S') AS directory FROM events GROUP BY user_id"),
    "pose_algebra": (pose_algebra, sql(
        "SELECT frame_id, 0e0 AS id_tx, 1e0 AS id_qw, "
        + ", ".join(rq(f"-{e}", f"inv_t{k}") for k, e in zip("xyz", sql_rotate("", ("tx", "ty", "tz"), "-")))
        + f", {rq('-qy', 'inv_qy')}, {rq('1-2*qy*qy', 'm0')}, {rq('-2*qy*qw', 'm2')}, {rq('2*qy*qw', 'm8')}, "
        f"{rq('tx', 'm12')}, 1e0 AS m15, {rq('sqrt(0.01e0 + 0.04e0 + 0.09e0)', 'moved')}, "
        f"{rq('degrees(2*acos(0.8e0))', 'turned', 4)}, "
        + ", ".join(rq(e, f"fwd{i}") for i, e in enumerate(sql_rotate("", ("0", "0", "-1")))) + ", "
        + ", ".join(rq(e, f"up{i}") for i, e in enumerate(sql_rotate("", ("0", "1", "0"))))
        + " FROM depth_frames_meta", "depth_frames_meta")),
}

# The same over chunks far narrower than a session, so that carries over chunks and the walk over heads take part.
QUERIES |= {f"{name}_chunked": (query, QUERIES[name][1]) for name, query in {
    "frame_motion": lambda s, d: frame_motion(s, d, 64),
    "latest_camera_state": lambda s, d: camera_state(s, d, 64),
    "newest_depth_frames": lambda s, d: newest_depth(s, d, 13),
    "select_keyframes": lambda s, d: decided(s, d, DATASET, width=13),
    "select_keyframes_with_controls": lambda s, d: decided(s, d, DATASET, True, width=13)}.items()}
