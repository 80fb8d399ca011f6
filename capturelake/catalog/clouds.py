"""Point-cloud queries over depth pixels and binary depth frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.catalog.common import intrinsics, r, rq, sql, sql_matrix, sql_relative
from capturelake.fixtures import table
from capturelake.functions.imaging import scale_intrinsics, subsample_step
from capturelake.functions.pose import compose_parts, parts, pose, with_pose
from capturelake.operators.gates import grid_subsample, min_confidence, valid_depth
from capturelake.operators.motion import attach_root, root_relative, session_roots
from capturelake.operators.points import (color_pixels, color_position, explode_depth_frames, frame_matrices,
                                          point_counts, points_per_view, project_points, session_cloud,
                                          unproject_pixels, view_frames, world_points, zip_arrays,
                                          zip_points_colors)
from capturelake.plans.chunks import SESSION, attach, chunk_of
from capturelake.policies import DISPLAY_FRAMES
from capturelake.session import cut
from capturelake.sources.readers import complete_depth_frames

GRID = 2000
SET_BACK = 0.01371


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """One depth frame per order: pose, texture intrinsics and depth size."""
    return table(spark, sf, "depth_frames_meta").select(
        SESSION, "frame_id", "seq", "timestamp_ns", pose().alias("pose"), intrinsics("texture_k"),
        intrinsics("image_k"), "depth_width", "depth_height")


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "depth_pixels")


def located(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels with their frame's session, intrinsics and matrix relative to the session's root."""
    side = frames(spark, sf)
    placed = frame_matrices(attach_root(side, session_roots(side)))
    return attach(pixels(spark, sf), placed.select(
        "frame_id", SESSION, "texture_k", "depth_width", "depth_height", "model"), by=[chunk_of("i", 1024)], keys=["frame_id"])


def world(spark: SparkSession, sf: str) -> DataFrame:
    return world_points(color_pixels(unproject_pixels(located(spark, sf), sampled=True)))


def depth_valid(spark: SparkSession, sf: str) -> DataFrame:
    return valid_depth(pixels(spark, sf)).select("frame_id", "i", "depth_mm")


def on_grid(spark: SparkSession, sf: str) -> DataFrame:
    return grid_subsample(pixels(spark, sf), F.lit(160), F.lit(90), GRID).select("frame_id", "i", "x", "y")


def steps(spark: SparkSession, sf: str) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    return table(spark, sf, "camera_sizes").select(
        "camera_id", "ord", subsample_step(w, h).alias("step"), subsample_step(w, h, 100).alias("coarse_step"))


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    k = scale_intrinsics(F.col("texture_k"), F.col("depth_width"), F.col("depth_height"))
    return frames(spark, sf).withColumn("k", k).select("frame_id", *[r(f"k.{c}").alias(c) for c in ("fx", "fy", "cx", "cy")])


def local_points(spark: SparkSession, sf: str) -> DataFrame:
    side = frames(spark, sf).select("frame_id", "texture_k", "depth_width", "depth_height")
    return unproject_pixels(pixels(spark, sf), side, GRID).select(
        "frame_id", "i", *[r(c, 9).alias(c) for c in ("x_m", "y_m", "z_m", "confidence")])


def confident(spark: SparkSession, sf: str) -> DataFrame:
    side = frames(spark, sf).select("frame_id", "texture_k", "depth_width", "depth_height")
    points = unproject_pixels(pixels(spark, sf), side, sampled=True)
    return min_confidence(points).select("frame_id", "i", r("confidence").alias("confidence"))


def colors(spark: SparkSession, sf: str) -> DataFrame:
    return color_pixels(valid_depth(pixels(spark, sf))).select("frame_id", "i", "red", "green", "blue")


def color_at(spark: SparkSession, sf: str) -> DataFrame:
    sized = pixels(spark, sf).withColumns({"depth_width": F.lit(160), "depth_height": F.lit(90)})
    return color_position(sized, F.lit(640), F.lit(59.5), F.lit(420.4)).select(
        "frame_id", "i", "color_x", "color_y", "chroma_x", "chroma_y")


def cloud(spark: SparkSession, sf: str) -> DataFrame:
    return world(spark, sf).select(
        SESSION, "frame_id", "i", *[r(c, 9).alias(c) for c in ("x", "y", "z")], "red", "green", "blue",
        r("confidence").alias("confidence"))


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return point_counts(valid_depth(pixels(spark, sf)), ["frame_id"])


def zipped(spark: SparkSession, sf: str) -> DataFrame:
    px = valid_depth(pixels(spark, sf))
    points = px.select("frame_id", "i", "depth_mm")
    tones = color_pixels(pixels(spark, sf).where("i % 7 <> 6")).select("frame_id", "i", "red")
    return zip_points_colors(points, tones, ["frame_id"])


def zipped_arrays(spark: SparkSession, sf: str) -> DataFrame:
    # An order has a handful of lines, so its arrays are short.
    px = pixels(spark, sf)
    arrays = px.groupBy("frame_id").agg(
        F.array_sort(F.collect_list(F.struct("i", "depth_mm"))).alias("p"),
        F.array_sort(F.collect_list(F.when(F.col("i") % 3 != 0, F.struct("i", "yy")))).alias("c"))
    pairs = arrays.select("frame_id", F.explode(zip_arrays(F.col("p"), F.col("c"))).alias("z"))
    return pairs.select("frame_id", F.col("z.point.i").alias("i"), F.col("z.point.depth_mm").alias("depth_mm"),
                        F.col("z.color.yy").alias("yy"))


def newest_cloud(spark: SparkSession, sf: str, n: int = DISPLAY_FRAMES) -> DataFrame:
    depth = frames(spark, sf).select(SESSION, "frame_id", "seq")
    return session_cloud(world(spark, sf), depth, n).groupBy(SESSION).agg(
        F.count("*").alias("points"), F.countDistinct("frame_id").alias("frames"), r(F.min("z"), 4).alias("min_z"))


def views(spark: SparkSession, sf: str) -> DataFrame:
    """Every depth frame of the table is also a view of its session."""
    side = frames(spark, sf)
    return (attach_root(side, session_roots(side))
            .selectExpr(SESSION, "seq", "frame_id AS view_id", "pose", "root", "image_k"))


def projected(spark: SparkSession, sf: str, n: int = DISPLAY_FRAMES) -> DataFrame:
    depth = frames(spark, sf).select(SESSION, "frame_id", "seq")
    # Set back a little, so that no point lies exactly on the near plane.
    back = [F.lit(v) for v in (0.0, 0.0, SET_BACK, 0.0, 0.0, 0.0, 1.0)]
    moved = with_pose(root_relative(views(spark, sf)), "pose", compose_parts(parts(F.col("pose")), back))
    seen = project_points(cut(world(spark, sf).select(SESSION, "frame_id", "i", "x", "y", "z")), moved, depth, n)
    return points_per_view(seen).withColumn("nearest_m", r("nearest_m", 4))


def shown(spark: SparkSession, sf: str, n: int = DISPLAY_FRAMES) -> DataFrame:
    depth = frames(spark, sf).select(SESSION, "frame_id", "seq")
    return view_frames(views(spark, sf), depth, n).select(SESSION, "view_id", "frame_id")


# Binary frames of 8x6 depth pixels: planes are digests of the order key, with extra zero digits in the depth.
W, H, CW, CH = 8, 6, 16, 12
STRIDES = {"conf": W + 2, "y": CW + 4, "u": CW, "v": CW}
DEPTH_DIGITS = "'abcde01234', '0000000000'"


def _plane(name: str, size: int) -> str:
    """Spark SQL for a plane of at least ``size`` bytes, 16 per digest."""
    parts = ", ".join(f"md5(concat(o_orderkey, '{name}', {k}))" for k in range(-(-size // 16)))
    text = f"concat({parts})"
    return f"unhex({f'translate({text}, {DEPTH_DIGITS})' if name == 'd' else text})"


def _byte(name: str, at: str) -> str:
    """DuckDB SQL for the byte at a position of a plane."""
    digits = f"md5(concat(o_orderkey, '{name}', ({at})//16))"
    digits = f"translate({digits}, {DEPTH_DIGITS})" if name == "d" else digits
    return f"cast(concat('0x', substr({digits}, (({at}) % 16)*2 + 1, 2)) AS int)"


def binary_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Depth frames with planes; some orders miss one of the three images.

    The keys are dealt out first: planes are made and decoded by every core, whatever the files of the table.
    """
    keys = table(spark, sf, "orders").select("o_custkey", "o_orderkey").repartition(
        spark.sparkContext.defaultParallelism, "o_orderkey")
    return keys.selectExpr(
        "concat('s', lpad(cast(o_custkey AS string), 6, '0')) AS session_id", "o_orderkey AS frame_id",
        "o_orderkey AS seq", f"{W} AS width", f"{H} AS height",
        f"CASE WHEN o_orderkey % 13 <> 0 THEN {_plane('d', W * H * 2)} END AS depth16",
        f"CASE WHEN o_orderkey % 17 <> 0 THEN {_plane('c', STRIDES['conf'] * H)} END AS confidence",
        f"CASE WHEN o_orderkey % 19 <> 0 THEN {_plane('y', STRIDES['y'] * CH)} END AS y_plane",
        f"{_plane('u', STRIDES['u'] * CH // 2)} AS u_plane", f"{_plane('v', STRIDES['v'] * CH // 2)} AS v_plane",
        f"{STRIDES['conf']} AS conf_row_stride", "1 AS conf_pixel_stride", f"{STRIDES['y']} AS y_row_stride",
        "1 AS y_pixel_stride", f"{STRIDES['u']} AS u_row_stride", "2 AS u_pixel_stride",
        f"{STRIDES['v']} AS v_row_stride", "2 AS v_pixel_stride", f"{CW} AS color_width",
        "float(1.5) AS color_min_y", "float(10.4) AS color_max_y")


def whole_frames(spark: SparkSession, sf: str) -> DataFrame:
    return complete_depth_frames(binary_frames(spark, sf)).selectExpr(
        "session_id", "frame_id", "octet_length(depth16) AS depth_bytes", "octet_length(confidence) AS confidence_bytes")


PX = ("session_id", "frame_id", "i", "x", "y", "depth_mm", "confidence", "yy", "uu", "vv")


def decoded(spark: SparkSession, sf: str) -> DataFrame:
    return explode_depth_frames(binary_frames(spark, sf), limit=20).select(*PX)


def decoded_padded(spark: SparkSession, sf: str) -> DataFrame:
    return point_counts(explode_depth_frames(binary_frames(spark, sf), limit=20, unsigned=True, pad=True))


def decoded_sql() -> str:
    """The sampled pixels straight from the digests; step 2 keeps 4x3 pixels, colour rows span 2 to 10."""
    cx, cy = f"(x*{CW}//{W})", f"(2 + y*8//{H})"
    half = f"({cy}//2)*{CW} + ({cx}//2)*2"
    low, high = _byte("d", f"(y*{W} + x)*2"), _byte("d", f"(y*{W} + x)*2 + 1")
    return f"""
WITH px AS (SELECT o_custkey, o_orderkey, cast(x AS int) AS x, cast(y AS int) AS y FROM orders,
    (SELECT unnest(range(0, {W}, 2)) AS x) a, (SELECT unnest(range(0, {H}, 2)) AS y) b
  WHERE o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0),
v AS (SELECT concat('s', lpad(cast(o_custkey AS varchar), 6, '0')) AS session_id, o_orderkey AS frame_id, x, y,
  {low} + 256*{high} AS raw, {_byte('c', f"y*{STRIDES['conf']} + x")} AS confidence,
  {_byte('y', f"{cy}*{STRIDES['y']} + {cx}")} AS yy, {_byte('u', half)} AS uu, {_byte('v', half)} AS vv FROM px)
SELECT session_id, frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY y, x) - 1 AS i, x, y,
  CASE WHEN raw > 32767 THEN raw - 65536 ELSE raw END AS depth_mm, confidence, yy, uu, vv FROM v WHERE raw <> 0"""


K_SQL = "fx*160/img_w AS kfx, fy*90/img_h AS kfy, cx*160/img_w AS kcx, cy*90/img_h AS kcy"
LOCAL = f"""local_ AS (SELECT p.*, d.session_id, d.seq, depth_mm/1000e0*(x-kcx)/kfx AS x_m, depth_mm/1000e0*(kcy-y)/kfy AS y_m,
  -depth_mm/1000e0 AS z_m, p.confidence/255e0 AS conf FROM depth_pixels p JOIN (SELECT *, {K_SQL} FROM depth_frames_meta) d
  USING (frame_id) WHERE depth_mm <> 0)"""
REL = ", ".join(f"{e} AS {k}" for k, e in sql_relative("o.", "d.").items())
MODEL = f"""rootf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM depth_frames_meta) WHERE rn = 1),
rel AS (SELECT d.session_id, d.frame_id, d.seq, d.fx, d.fy, d.cx, d.cy, d.img_w, d.img_h, {REL}
  FROM depth_frames_meta d JOIN rootf o USING (session_id)),
model AS (SELECT *, {', '.join(f'{e} AS m{i}' for i, e in enumerate(sql_matrix()))} FROM rel),
world AS (SELECT l.session_id, l.frame_id, l.i, l.conf, l.depth_mm, l.yy, l.uu, l.vv,
  m0*x_m + m4*y_m + m8*z_m + m12 AS x, m1*x_m + m5*y_m + m9*z_m + m13 AS y, m2*x_m + m6*y_m + m10*z_m + m14 AS z
  FROM local_ l JOIN model USING (frame_id))"""
VF, UF = "(vv*1.230e0/255e0 - 0.615e0)", "(uu*0.872e0/255e0 - 0.436e0)"


def rgb_sql() -> str:
    tones = {"red": f"+ 1.13983e0*{VF}", "green": f"- 0.39465e0*{UF} - 0.58060e0*{VF}", "blue": f"+ 2.03211e0*{UF}"}
    return ", ".join(f"cast(floor(greatest(0e0, least(1e0, yy/255e0 {t}))*255e0 + 0.5e0) AS smallint) AS {n}"
                     for n, t in tones.items())


def viewed_sql(n: int) -> str:
    return f"""framed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rk FROM model),
pairs AS (SELECT v.session_id, v.frame_id AS view_id, f.frame_id, v.m0, v.m1, v.m2, v.m4, v.m5, v.m6, v.m8, v.m9, v.m10,
  v.m12, v.m13, v.m14, v.fx, v.fy, v.cx, v.cy, v.img_w, v.img_h
  FROM framed v JOIN framed f ON f.session_id = v.session_id AND f.rk <= v.rk AND f.rk > v.rk - {n}),
cam AS (SELECT q.session_id, q.view_id, q.fx, q.fy, q.cx, q.cy, q.img_w, q.img_h,
  m0*(x-m12) + m1*(y-m13) + m2*(z-m14) AS vx, m4*(x-m12) + m5*(y-m13) + m6*(z-m14) AS vy,
  0.01371e0 - (m8*(x-m12) + m9*(y-m13) + m10*(z-m14)) AS vd FROM pairs q JOIN world w USING (frame_id))"""


def newest_cloud_sql(n: int) -> str:
    return sql(
        f"SELECT session_id, count(*) AS points, count(DISTINCT frame_id) AS frames, {rq('min(z)', 'min_z', 4)} FROM world JOIN "
        "(SELECT frame_id FROM (SELECT frame_id, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS rn "
        f"FROM depth_frames_meta) WHERE rn <= {n}) USING (frame_id) WHERE conf >= 0.1 GROUP BY session_id",
        "depth_pixels", "depth_frames_meta", extra=f"{LOCAL}, {MODEL}")


def shown_sql(n: int) -> str:
    return sql("SELECT session_id, view_id, frame_id FROM pairs", "depth_frames_meta",
               "depth_pixels", extra=f"{LOCAL}, {MODEL}, {viewed_sql(n)}")


def projected_sql(n: int) -> str:
    return sql(
        f"SELECT session_id, view_id, count(*) AS points_seen, {rq('min(vd)', 'nearest_m', 4)} FROM cam WHERE vd >= 0.1 AND vd <= 100 "
        "AND cx + fx*vx/vd >= 0 AND cx + fx*vx/vd < img_w AND cy - fy*vy/vd >= 0 AND cy - fy*vy/vd < img_h "
        "GROUP BY session_id, view_id", "depth_pixels", "depth_frames_meta", extra=f"{LOCAL}, {MODEL}, {viewed_sql(n)}")


QUERIES = {
    "complete_depth_frames": (whole_frames,
        f"SELECT concat('s', lpad(cast(o_custkey AS varchar), 6, '0')) AS session_id, o_orderkey AS frame_id, {W * H * 2} AS depth_bytes, "
        f"64 AS confidence_bytes FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0"),
    "valid_depth": (depth_valid, sql("SELECT frame_id, i, depth_mm FROM depth_pixels WHERE depth_mm <> 0", "depth_pixels")),
    "grid_subsample": (on_grid, sql("SELECT frame_id, i, x, y FROM depth_pixels WHERE x % 3 = 0 AND y % 3 = 0", "depth_pixels")),
    "subsample_step": (steps, sql(
        "SELECT camera_id, ord, greatest(1, cast(ceil(sqrt(width*height/15000e0)) AS int)) AS step, "
        "greatest(1, cast(ceil(sqrt(width*height/100e0)) AS int)) AS coarse_step FROM camera_sizes", "camera_sizes")),
    "scale_intrinsics": (scaled, sql(
        f"SELECT frame_id, {rq('kfx', 'fx')}, {rq('kfy', 'fy')}, {rq('kcx', 'cx')}, {rq('kcy', 'cy')} FROM "
        f"(SELECT frame_id, {K_SQL} FROM depth_frames_meta)", "depth_frames_meta")),
    "unproject_pixels": (local_points, sql(
        f"SELECT frame_id, i, {rq('x_m', 'x_m', 9)}, {rq('y_m', 'y_m', 9)}, {rq('z_m', 'z_m', 9)}, {rq('conf', 'confidence', 9)} "
        "FROM local_ WHERE x % 3 = 0 AND y % 3 = 0", "depth_pixels", "depth_frames_meta", extra=LOCAL)),
    "confident_points": (confident, sql(
        f"SELECT frame_id, i, {rq('conf', 'confidence')} FROM local_ WHERE conf >= 0.1", "depth_pixels", "depth_frames_meta",
        extra=LOCAL)),
    "color_pixels": (colors, sql(f"SELECT frame_id, i, {rgb_sql()} FROM depth_pixels WHERE depth_mm <> 0", "depth_pixels")),
    "color_position": (color_at, sql(
        "SELECT frame_id, i, cast(x*640//160 AS bigint) AS color_x, cast(60 + y*360//90 AS bigint) AS color_y, "
        "cast((x*640//160)//2 AS bigint) AS chroma_x, cast((60 + y*360//90)//2 AS bigint) AS chroma_y FROM depth_pixels", "depth_pixels")),
    "world_points": (cloud, sql(
        f"SELECT session_id, frame_id, i, {rq('x', 'x', 9)}, {rq('y', 'y', 9)}, {rq('z', 'z', 9)}, {rgb_sql()}, "
        f"{rq('conf', 'confidence')} FROM world", "depth_pixels", "depth_frames_meta", extra=f"{LOCAL}, {MODEL}")),
    "point_counts": (counts, sql(
        "SELECT frame_id, count(*) AS point_count FROM depth_pixels WHERE depth_mm <> 0 GROUP BY frame_id", "depth_pixels")),
    "zip_points_colors": (zipped, sql(
        f"SELECT frame_id, i, depth_mm, red FROM (SELECT frame_id, i, depth_mm, {rgb_sql()} FROM depth_pixels "
        "WHERE depth_mm <> 0 AND i % 7 <> 6)", "depth_pixels")),
    "zip_arrays": (zipped_arrays, sql(
        "SELECT p.frame_id, p.i, p.depth_mm, c.yy FROM depth_pixels p JOIN (SELECT *, row_number() OVER (PARTITION BY frame_id "
        "ORDER BY i) AS rk FROM depth_pixels WHERE i % 3 <> 0) c ON c.frame_id = p.frame_id AND c.rk = p.i", "depth_pixels")),
    "session_cloud": (newest_cloud, newest_cloud_sql(DISPLAY_FRAMES)),
    "session_cloud_narrow": (lambda s, d: newest_cloud(s, d, 5), newest_cloud_sql(5)),
    "view_frames": (shown, shown_sql(DISPLAY_FRAMES)),
    "view_frames_narrow": (lambda s, d: shown(s, d, 4), shown_sql(4)),
    "project_points": (projected, projected_sql(DISPLAY_FRAMES)),
    "project_points_narrow": (lambda s, d: projected(s, d, 4), projected_sql(4)),
    "explode_depth_frames": (decoded, decoded_sql()),
    "padded_point_counts": (decoded_padded,
        "SELECT concat('s', lpad(cast(o_custkey AS varchar), 6, '0')) AS session_id, o_orderkey AS frame_id, cast(12 AS bigint) AS point_count "
        "FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0"),
}
