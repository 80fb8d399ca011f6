"""Working tables derived from the test tables (events, lineitem, part, orders).

The SQL text is shared with the DuckDB oracle; only three placeholders differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.plans.chunks import Running, running

DUCKDB = {"us": "epoch_us(ts)", "div": "//", "k": "json_extract_string(props, '$.k')", "string": "varchar"}
SPARK = {"us": "unix_micros(cast(ts AS timestamp))", "div": "div", "k": "get_json_object(props, '$.k')",
         "string": "string"}

# Tables that number rows within a key: (key, order columns, chunk width). DuckDB uses a window; Spark a
# running count over chunks of the first order column, so that no key lands in one task.
NUMBERED = {"depth_pixels": ("l_orderkey", ("l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice"), 1 << 14),
            "keyframes": ("o_custkey", ("o_orderkey",), 1 << 17)}

# name -> (relation it reads, SQL)
TABLES = {
    "ev": ("events", """
SELECT event_id AS seq, event_id, user_id, concat('s', lpad(cast(user_id AS {string}), 6, '0')) AS session_id,
  {us} {div} 100 AS timestamp_ns, value, event_type, cast({k} AS int) AS k FROM events"""),
    "poses": ("ev", """
SELECT session_id, seq, timestamp_ns,
  CASE WHEN event_id % 23 = 22 THEN 'PAUSED' ELSE 'TRACKING' END AS tracking_state,
  value/5000e0 AS tx, (k % 10)/1000e0 AS ty, (event_id % 50)/2000e0 AS tz,
  CASE WHEN event_id % 2 = 1 THEN sin(radians(k*1e-1)/2e0) ELSE 0e0 END AS qx,
  CASE WHEN event_id % 2 = 0 THEN sin(radians(k*1e-1)/2e0) ELSE 0e0 END AS qy,
  0e0 AS qz, cos(radians(k*1e-1)/2e0) AS qw,
  500e0 + (user_id % 5)*10 AS fx, 501e0 + (user_id % 5)*10 AS fy, 3195e-1 AS cx, 2395e-1 AS cy,
  640 AS img_w, 480 AS img_h,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS lens_state,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE cast(event_id % 7 AS int) END AS af_state FROM ev"""),
    "images": ("ev", """
SELECT session_id, seq, timestamp_ns + (event_id % 7)*20000000 AS timestamp_ns,
  4000 AS jpeg_width, 3000 AS jpeg_height
  FROM ev WHERE event_type = 'purchase'"""),
    "still_metadata": ("ev", """
SELECT session_id, seq, timestamp_ns + (event_id % 7)*20000000 AS timestamp_ns,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE 1000000 + (event_id * 7919 % 5)*1000000 END AS exposure_time_ns,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE cast(100*(1 + event_id % 40) AS int) END AS iso,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 1 ELSE cast(2*(event_id % 3) AS int) END AS af_state,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 37 = 0 THEN 1 ELSE 0 END AS lens_state,
  CASE WHEN event_id % 41 = 0 THEN 1 ELSE 0 END AS ois_mode,
  CASE WHEN event_id % 43 = 0 THEN 1 END AS video_stabilization_mode
  FROM ev WHERE event_type = 'purchase' AND event_id % 12 <> 0"""),
    "depth_frames_ref": ("ev", """
SELECT session_id, seq, timestamp_ns + (event_id % 5)*30000000 AS timestamp_ns, event_id AS frame_id
  FROM ev"""),
    "camera_states": ("ev", """
SELECT session_id, seq, timestamp_ns,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 500000 + (event_id % 40)*1000000 END AS exposure_time_ns,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE cast(50 + (event_id % 30)*50 AS int) END AS iso,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 12)/2e0 - 5e-1 END AS focus_distance,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE cast(event_id % 7 AS int) END AS af_state,
  CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS lens_state FROM ev"""),
    "control_events": ("ev", """
SELECT session_id, seq,
  CASE WHEN event_type = 'error' AND event_id % 9 = 0 THEN 'stop'
       WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'resume'
       WHEN event_type = 'purchase' THEN 'photo_arrived'
       WHEN event_type = 'error' THEN 'request_failed'
       ELSE 'result_without_timestamp' END AS kind
  FROM ev WHERE event_type IN ('error', 'signup', 'purchase') OR event_id % 10 = 3"""),
    "depth_pixels": ("lineitem", """
SELECT l_orderkey AS frame_id, {nth} AS i,
  cast(l_partkey % 160 AS int) AS x, cast((l_suppkey*7 + l_linenumber*13) % 90 AS int) AS y,
  CASE WHEN l_partkey % 10 = 0 THEN 0 ELSE cast(floor(l_extendedprice) AS bigint) % 5000 END AS depth_mm,
  cast((l_linenumber*37 + l_partkey) % 256 AS int) AS confidence, cast((l_partkey*3) % 256 AS int) AS yy,
  cast((l_suppkey*5) % 256 AS int) AS uu, cast((l_linenumber*29) % 256 AS int) AS vv FROM lineitem"""),
    "depth_frames_meta": ("orders", """
SELECT o_orderkey AS frame_id, concat('s', lpad(cast(o_custkey AS {string}), 6, '0')) AS session_id, o_orderkey AS seq,
  o_orderkey * 33000000 AS timestamp_ns, 160 AS depth_width, 90 AS depth_height,
  (o_orderkey % 40)/100e0 AS tx, (o_orderkey % 30)/100e0 AS ty, (o_orderkey % 20)/100e0 AS tz,
  0e0 AS qx, sin(radians((o_orderkey % 90)*1e0)/2e0) AS qy, 0e0 AS qz, cos(radians((o_orderkey % 90)*1e0)/2e0) AS qw,
  500e0 + (o_custkey % 5)*10 AS fx, 501e0 + (o_custkey % 5)*10 AS fy, 3195e-1 AS cx, 2395e-1 AS cy,
  640 AS img_w, 480 AS img_h FROM orders"""),
    "camera_sizes": ("part", """
SELECT p_brand AS camera_id, p_partkey AS ord,
  cast(CASE p_partkey % 2 WHEN 0 THEN (480 + p_size*96)*4 {div} 3 ELSE (480 + p_size*96)*16 {div} 9 END AS int) AS width,
  480 + p_size*96 AS height FROM part"""),
    "camera_configs": ("part", """
SELECT p_brand AS device_id, p_partkey AS ord, concat('cam', cast(p_partkey % 3 AS {string})) AS camera_id,
  CASE WHEN p_partkey % 4 = 0 THEN 60 ELSE 30 END AS fps, p_partkey % 5 = 0 AS depth_sensor_used,
  640 + (p_size % 4)*320 AS cpu_w, 480 + (p_size % 4)*240 AS cpu_h,
  1280 + (p_size % 3)*640 AS gpu_w, 720 + (p_size % 3)*360 AS gpu_h FROM part"""),
    "keyframes": ("orders", """
SELECT concat('s', lpad(cast(o_custkey AS {string}), 6, '0')) AS session_id, o_orderkey AS seq,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE cast({nth} AS int) END AS capture_index,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE 4000 END AS jpeg_width, 3000 AS jpeg_height,
  concat('frame_', cast(o_orderkey AS {string}), '.jpg') AS image,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('frame_', cast(o_orderkey AS {string}), '.ply') END AS point_cloud,
  o_orderkey * 33000000 AS timestamp_ns, (o_orderkey % 40)/100e0 AS tx, (o_orderkey % 30)/100e0 AS ty, (o_orderkey % 20)/100e0 AS tz,
  0e0 AS qx, sin(radians((o_orderkey % 90)*1e0)/2e0) AS qy, 0e0 AS qz, cos(radians((o_orderkey % 90)*1e0)/2e0) AS qw,
  500e0 + o_custkey % 7 AS fx, 501e0 AS fy, 3195e-1 AS cx, 2395e-1 AS cy, 640 AS img_w, 480 AS img_h FROM orders"""),
}
SOURCES = ("events", "lineitem", "orders", "part", "customer", "supplier")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived working table as a Spark DataFrame."""
    if name in SOURCES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parent, sql = TABLES[name]
    source = table(spark, sf_dir, parent)
    if name in NUMBERED:
        key, order, width = NUMBERED[name]
        source = running(source, [Running("nth", "sum", F.lit(1))], order=order, width=width, keys=(key,))
    body = re.sub(rf"\bFROM {parent}\b", "FROM {src}", sql.format(**SPARK, nth="nth"))
    return spark.sql(body, src=source)


def ctes(*names: str) -> str:
    """The same tables as a DuckDB WITH list, parents first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in SOURCES or name in order:
            return
        visit(TABLES[name][0])
        order.append(name)

    for name in names:
        visit(name)
    def nth(name: str) -> str:
        key, columns, _ = NUMBERED.get(name, ("", (), 0))
        return f"row_number() OVER (PARTITION BY {key} ORDER BY {', '.join(columns)})"

    return ",\n".join(f"{n} AS ({TABLES[n][1].format(**DUCKDB, nth=nth(n))})" for n in order)
