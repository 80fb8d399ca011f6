"""Depth frames to coloured points."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions.imaging import (color_coord, norm_confidence, scale_intrinsics, to_byte, unproject,
                                           yuv_to_rgb)
from capturelake.functions.pose import apply_matrix, inverse_parts, parts, pose_matrix, with_pose
from capturelake.operators.gates import grid_subsample, min_confidence, valid_depth
from capturelake.operators.motion import last_n, root_relative
from capturelake.plans.chunks import SEQ_CHUNK, SESSION, Running, attach, chunk_of, running
from capturelake.policies import DISPLAY_FRAMES, MIN_CONFIDENCE, POINT_LIMIT

FRAME = (SESSION, "frame_id")
FAR, NEAR = 100.0, 0.1
PIXEL = "array<struct<i:long,x:int,y:int,depth_mm:int,confidence:int,yy:int,uu:int,vv:int>>"
# Plane bytes of the frames sampled together, which bounds the memory of a decoding task.
DECODE_BYTES = 32 << 20
CHANNELS = ("x", "y", "depth_mm", "confidence", "yy", "uu", "vv")
PLANES = ("depth16", "confidence", "y_plane", "u_plane", "v_plane")
LAYOUT = ("width", "height", "conf_row_stride", "conf_pixel_stride", "y_row_stride", "y_pixel_stride",
          "u_row_stride", "u_pixel_stride", "v_row_stride", "v_pixel_stride", "color_width",
          "color_min_y", "color_max_y")


@lru_cache(maxsize=64)
def _grid(layout: tuple, limit: int) -> tuple[np.ndarray, ...]:
    """Sampled x and y, and the offset of each sample in every plane, for one frame layout.

    Depth rows are taken as tight; confidence and colour planes honour their strides.
    """
    f = dict(zip(LAYOUT, layout))
    w, h = int(f["width"]), int(f["height"])
    step = max(1, math.ceil(math.sqrt(w * h / limit)))
    y, x = (g.ravel() for g in np.meshgrid(np.arange(0, h, step), np.arange(0, w, step), indexing="ij"))
    lo, hi = math.floor(f["color_min_y"] + 0.5), math.floor(f["color_max_y"] + 0.5)
    cx, cy = x * int(f["color_width"]) // w, lo + y * (hi - lo) // h
    at = {"conf": (y, x), "y": (cy, cx), "u": (cy // 2, cx // 2), "v": (cy // 2, cx // 2)}
    offsets = [r * int(f[f"{p}_row_stride"]) + c * int(f[f"{p}_pixel_stride"]) for p, (r, c) in at.items()]
    return x, y, y * w + x, *offsets


def sample_pixels(layout: tuple, planes: list[np.ndarray], limit: int, unsigned: bool, pad: bool) -> pa.Array:
    """Sampled pixels of frames with one layout as a list per frame; planes are (frames, bytes)."""
    x, y, at, *offsets = _grid(layout, limit)
    depth = planes[0].view("<u2" if unsigned else "<i2")[:, at].astype(np.int32)
    n, m = depth.shape
    channels = [np.broadcast_to(x, (n, m)), np.broadcast_to(y, (n, m)), depth,
                *[p[:, o] for p, o in zip(planes[1:], offsets)]]
    kept = depth != 0
    counts = kept.sum(axis=1)
    if pad:
        # Pixels with depth first, in order, then one empty pixel for each without.
        order = np.argsort(~kept, axis=1, kind="stable")
        filled = np.take_along_axis(kept, order, axis=1)
        values = [(np.take_along_axis(c, order, axis=1) * filled).ravel() for c in channels]
        counts = np.full(n, m)
    else:
        values = [c[kept] for c in channels]
    offsets = np.concatenate([[0], np.cumsum(counts)])
    index = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts)
    fields = [pa.array(index, pa.int64()), *[pa.array(v.astype(np.int32)) for v in values]]
    pixels = pa.StructArray.from_arrays(fields, names=["i", *CHANNELS])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pixels)


def _decode(limit: int, unsigned: bool, pad: bool) -> Callable:
    def decode(frames: pa.Array) -> pa.Array:
        columns = [frames.field(i) for i in range(len(PLANES) + len(LAYOUT))]
        layouts = list(zip(*[c.to_pylist() for c in columns[len(PLANES):]]))
        sizes = list(zip(*[pc.binary_length(c).to_pylist() for c in columns[:len(PLANES)]]))
        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(layouts, sizes)):
            groups.setdefault(key, []).append(i)
        lists, order = [], []
        for (layout, size), rows in groups.items():
            together = max(1, DECODE_BYTES // max(1, sum(size)))
            for start in range(0, len(rows), together):
                part = rows[start:start + together]
                planes = [np.frombuffer(b"".join(c.take(pa.array(part)).to_pylist()), dtype=np.uint8).reshape(len(part), -1)
                          for c in columns[:len(PLANES)]]
                lists.append(sample_pixels(layout, planes, limit, unsigned, pad))
                order.extend(part)
        if not lists:
            return pa.array([], pa.list_(pa.struct([("i", pa.int64()), *[(c, pa.int32()) for c in CHANNELS]])))
        joined = pa.concat_arrays(lists)
        return joined if order == sorted(order) else joined.take(pa.array(np.argsort(order)))

    # Annotations are strings in this module, so the evaluation type is set by the wrapper.
    return F.arrow_udf(decode, PIXEL)


def explode_depth_frames(frames: DataFrame, limit: int = POINT_LIMIT, unsigned: bool = False,
                         pad: bool = False) -> DataFrame:
    """H1: one row per sampled pixel with depth, keeping the frame's other columns.

    Frames missing a plane are skipped. ``pad`` appends one empty pixel per skipped one, as
    a buffer sized for the whole grid would hold. Only the planes go through Python; the
    frame's pose and intrinsics stay JVM-side and are pruned if unused.
    """
    whole = frames.dropna(subset=list(PLANES))
    rest = [c for c in frames.columns if c not in (*PLANES, *LAYOUT)]
    pixels = _decode(limit, unsigned, pad)(F.struct(*PLANES, *LAYOUT))
    size = [F.col("width").alias("depth_width"), F.col("height").alias("depth_height")]
    return whole.select(*rest, *size, pixels.alias("_px")).select(
        *rest, "depth_width", "depth_height", F.inline("_px"))


def unproject_pixels(pixels: DataFrame, intrinsics: DataFrame | None = None, limit: int = POINT_LIMIT,
                     sampled: bool = False, pad: bool = False) -> DataFrame:
    """H2: camera-local x_m, y_m, z_m and confidence of every sampled pixel with depth.

    Pixels whose frame is missing from ``intrinsics`` keep their row, with null positions.
    Pixels carry (or get, by frame, from ``intrinsics``) ``texture_k``, ``depth_width`` and
    ``depth_height``. ``sampled`` says the grid has been applied already; ``pad`` keeps
    pixels without depth, which land on the camera itself.
    """
    rows = pixels
    if intrinsics is not None:
        rows = attach(pixels, intrinsics, by=[chunk_of("i", 1024)], keys=[c for c in FRAME if c in pixels.columns])
    rows = rows if pad else valid_depth(rows)
    if not sampled:
        rows = grid_subsample(rows, F.col("depth_width"), F.col("depth_height"), limit)
    k = scale_intrinsics(F.col("texture_k"), F.col("depth_width"), F.col("depth_height"))
    x, y, z = unproject(F.col("x"), F.col("y"), F.col("depth_mm"), k)
    return rows.withColumns({"x_m": x, "y_m": y, "z_m": z, "confidence": norm_confidence(F.col("confidence"))})


def color_pixels(pixels: DataFrame) -> DataFrame:
    """H3: red, green, blue bytes from the sampled YUV values; black where there is no depth."""
    rgb = yuv_to_rgb(F.col("yy"), F.col("uu"), F.col("vv"))
    black = F.lit(0).cast("smallint")
    return pixels.withColumns({n: F.when(F.col("depth_mm") == 0, black).otherwise(to_byte(c))
                               for n, c in zip(("red", "green", "blue"), rgb)})


def color_position(pixels: DataFrame, color_width: Column, min_y: Column, max_y: Column) -> DataFrame:
    """I11 as columns: where each depth pixel reads colour and chroma."""
    names = ("color_x", "color_y", "chroma_x", "chroma_y")
    at = color_coord(F.col("x"), F.col("y"), color_width, F.col("depth_width"), F.col("depth_height"), min_y, max_y)
    return pixels.withColumns(dict(zip(names, at)))


def zip_points_colors(points: DataFrame, colors: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """D6 on rows: the i-th point gets the i-th colour; the longer side is cut."""
    return points.join(colors, [*keys, "i"])


def zip_arrays(points: Column, colors: Column) -> Column:
    """D6 on arrays: array<struct<point, color>> of the shorter length."""
    n = F.least(F.size(points), F.size(colors))
    return F.arrays_zip(F.slice(points, 1, n).alias("point"), F.slice(colors, 1, n).alias("color"))


def frame_matrices(frames: DataFrame, root: str = "root") -> DataFrame:
    """Adds ``model``: root⁻¹∘pose as a matrix, once per frame rather than once per point."""
    rows = frames
    if root in frames.columns:
        rows = root_relative(frames.withColumnRenamed(root, "root"))
    return rows.withColumn("model", pose_matrix(F.col("pose")))


def world_points(points: DataFrame, frames: DataFrame | None = None, keys: Sequence[str] = FRAME) -> DataFrame:
    """H4: x, y, z of every point in its session's root coordinates.

    ``frames`` (with ``model``, see ``frame_matrices``) joins by frame; points that carry
    ``model`` already need no join. Points of a frame that is missing keep their row, with nulls.
    """
    rows = points if frames is None else attach(points, frames, by=[chunk_of("i", 1024)], keys=keys)
    x, y, z = apply_matrix(F.col("model"), F.col("x_m"), F.col("y_m"), F.col("z_m"))
    return rows.withColumns({"x": x, "y": y, "z": z}).drop("model")


def point_counts(points: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Points per frame."""
    return points.groupBy(*keys).agg(F.count("*").alias("point_count"))


def session_cloud(points: DataFrame, depth: DataFrame, n: int = DISPLAY_FRAMES, t: float = MIN_CONFIDENCE,
                  width: int = SEQ_CHUNK) -> DataFrame:
    """H5: confident points of each session's newest n depth frames."""
    newest = last_n(depth, n, width=width).select(*FRAME)
    return min_confidence(points, t).join(newest, list(FRAME), "left_semi")


def _blocks(views: DataFrame, depth: DataFrame, n: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Views by the blocks they may show, as (session, _view, _rank, _block), and frames as (session, frame, _at, _block).

    Frames are numbered in arrival order (``_at``) and kept in blocks of n, so a view reads two blocks instead of meeting
    every frame of its session; ``_inside`` says which of their frames it shows.
    """
    frames = depth.select(SESSION, "seq", F.lit(0).alias("_kind"), "frame_id")
    asks = views.select(SESSION, "seq", F.lit(1).alias("_kind"), F.struct(*views.columns).alias("_view"))
    ranked = running(frames.unionByName(asks, allowMissingColumns=True),
                     [Running("_rank", "sum", 1 - F.col("_kind"))], order=("seq", "_kind"), width=width)
    stored = ranked.where(F.col("_kind") == 0).select(
        SESSION, F.col("frame_id"), F.col("_rank").alias("_at"), chunk_of(F.col("_rank") - 1, n).alias("_block"))
    top = chunk_of(F.col("_rank") - 1, n)
    wanted = (ranked.where(F.col("_kind") == 1)
              .select(SESSION, "_view", "_rank", F.explode(F.array(top, top - 1)).alias("_block")))
    return wanted, stored


def _inside(n: int) -> Column:
    return (F.col("_at") <= F.col("_rank")) & (F.col("_at") > F.col("_rank") - n)


def view_frames(views: DataFrame, depth: DataFrame, n: int = DISPLAY_FRAMES, width: int = SEQ_CHUNK) -> DataFrame:
    """The up to n depth frames a view shows: the newest arrivals when the view was taken."""
    wanted, stored = _blocks(views, depth, n, width)
    return wanted.join(stored, [SESSION, "_block"]).where(_inside(n)).select("_view.*", "frame_id")


SHOWN_SALTS = 8
#: Points of a frame that may travel as one row; of stretches with so many points the cells travel alone, and those with so
#: many are dealt frame by frame.
PACKED, CELLED, LARGE = 1 << 12, 32, 1 << 9
#: Edge of the cells whose boxes are tested before points are joined to views, in metres.
CELL_M = 0.5
CELL_BITS = 21
AXES = ("x", "y", "z")
BOX = [f"_{end}_{c}" for end in ("low", "high") for c in AXES]


def cell_code(edge: float = CELL_M) -> Column:
    """Morton code of a point's cell: the low 21 bits of its cell number on each axis, interleaved."""
    code = F.lit(0).cast("long")
    for axis, c in enumerate(AXES):
        n = F.floor(F.col(c) / edge).cast("long").bitwiseAND((1 << CELL_BITS) - 1)
        # Spreads the bits to every third place, halving the stretches that stay together.
        for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F),
                            (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask).cast("long"))
        code = code.bitwiseOR(F.shiftleft(n, axis))
    return code


def point_boxes(points: DataFrame, edge: float = CELL_M) -> DataFrame:
    """A box per frame and cell around its points; ``_cell`` names the cell."""
    ends = [fn(c).alias(f"_{end}_{c}") for end, fn in (("low", F.min), ("high", F.max)) for c in AXES]
    return points.groupBy(*FRAME, F.coalesce(cell_code(edge), F.lit(0)).alias("_cell")).agg(*ends)


NAN = float("nan")
#: The elements of a matrix that move a point, and the fields of intrinsics, as columns of their own: no value of these is
#: null, which keeps what is generated for each point so short that the JVM compiles it.
MATRIX = [i for i in range(16) if i % 4 < 3]
K = ("fx", "fy", "cx", "cy", "width", "height")
CENTRE, HALF = [f"_centre_{c}" for c in AXES], [f"_half_{c}" for c in AXES]


def _flat(m: Column, k: Column) -> list[Column]:
    """``_m`` and intrinsics as columns; NaN for null, which shows nothing either."""
    return [*[F.coalesce(m[i].cast("double"), F.lit(NAN)).alias(f"_m{i}") for i in MATRIX],
            *[F.coalesce(k[c].cast("double"), F.lit(NAN)).alias(f"_k_{c}") for c in K]]


def _middles() -> list[Column]:
    """Centre and half edges of a box; boxes are widened by more than rounding."""
    out = []
    for c in AXES:
        low, high = F.col(f"_low_{c}"), F.col(f"_high_{c}")
        centre = (low + high) / 2
        out += [F.coalesce(centre.cast("double"), F.lit(NAN)).alias(f"_centre_{c}"),
                F.coalesce(((high - low) / 2 + 1e-6 + 1e-9 * F.abs(centre)).cast("double"), F.lit(NAN)).alias(f"_half_{c}")]
    return out


def _may_see() -> Column:
    """Whether any point of a box can lie in a view (columns of ``_flat`` and ``_middles``).

    The box is turned to the camera: around its centre there, no point is further along an axis than the half edges
    reach. Each side of the frustum is linear in the point, so it is passed if it is at that reach.
    """
    m = {i: F.col(f"_m{i}") for i in MATRIX}
    fx, fy, cx, cy, width, height = (F.col(f"_k_{c}") for c in K)
    right, up, back = ([m[i], m[i + 4], m[i + 8], m[i + 12]] for i in range(3))

    def at(row: list[Column]) -> Column:
        return row[0] * F.col(CENTRE[0]) + row[1] * F.col(CENTRE[1]) + row[2] * F.col(CENTRE[2]) + row[3]

    def reach(row: list[Column]) -> Column:
        return F.abs(row[0]) * F.col(HALF[0]) + F.abs(row[1]) * F.col(HALF[1]) + F.abs(row[2]) * F.col(HALF[2])

    ahead, deep = -at(back), reach(back)
    # Each test is one that NaN passes: a box with such a point may have others.
    seen = (ahead + deep - NEAR >= -1e-6) & (FAR - ahead + deep >= -1e-6)
    for slope, row, edge in ((fx, right, cx), (-fx, right, width - cx), (-fy, up, cy), (fy, up, height - cy)):
        seen = seen & (slope * at(row) + edge * ahead + F.abs(slope) * reach(row) + F.abs(edge) * deep >= -1e-6)
    return seen


def shown_cells(points: DataFrame, shown: DataFrame, edge: float = CELL_M) -> DataFrame:
    """(view, frame, cell) where something may be seen: first the box of the whole frame is tested, then those of its cells.

    ``shown`` has a row per view and frame with ``_m`` (to the camera) and ``image_k``. A frame without points drops out.
    """
    cells = point_boxes(points, edge)
    whole = cells.groupBy(*FRAME).agg(*[(F.min if "low" in c else F.max)(c).alias(c) for c in BOX])
    placed = shown.select("*", *_flat(F.col("_m"), F.col("image_k")))
    near = placed.join(whole.select(*FRAME, *_middles()), list(FRAME)).where(_may_see()).drop(*CENTRE, *HALF)
    reached = near.join(cells.select(*FRAME, "_cell", *_middles()), list(FRAME)).where(_may_see())
    return reached.select(*FRAME, *[c for c in shown.columns if c not in FRAME], "_cell")


def project_points(points: DataFrame, views: DataFrame, depth: DataFrame, n: int = DISPLAY_FRAMES,
                   width: int = SEQ_CHUNK, edge: float = CELL_M) -> DataFrame:
    """H6: points seen per view with pixel position u, v and depth.

    Points (x, y, z in session coordinates) of the frames a view shows are moved to the
    view's camera and kept between the near and far planes and inside the image. Views carry
    ``view_id``, ``pose`` and ``image_k``. Points meet only the views whose frustum their cell reaches.
    They travel as one row per frame, stretch of ``i`` (if there is one) and, in stretches that are not short, cell, with
    the box around them, to the block of frames that a view reads: a view goes once to a block, and to each of its
    stretches and large frames, and never as a pair of view and frame.
    """
    placed_views = with_pose(views, "_inverse", inverse_parts(parts(F.col("pose"))))
    wanted, stored = _blocks(placed_views.select(SESSION, "seq", "view_id", "image_k", pose_matrix(F.col("_inverse")).alias("_m")),
                             depth, n, width)
    # A frame may hold any number of points: they are dealt to stretches.
    salt = chunk_of("i", PACKED) if "i" in points.columns else F.pmod(F.xxhash64(*AXES), F.lit(SHOWN_SALTS)).cast("long")
    others = [c for c in points.columns if c not in FRAME]
    salted = points.withColumn("_salt", F.coalesce(salt, F.lit(0).cast("long"))).withColumns(
        {c: F.coalesce(c, F.lit(NAN).cast(points.schema[c].dataType)) for c in AXES})  # neither is ever seen
    stretches = salted.groupBy(*FRAME, "_salt").agg(F.count("*").alias("_count"))
    dealt = stored.join(stretches, list(FRAME)).withColumn(
        "_lane", F.when(F.col("_count") >= LARGE, F.pmod("_at", F.lit(n)) + 1).otherwise(0))
    ends = [fn(c).alias(f"_{end}_{c}") for end, fn in (("low", F.min), ("high", F.max)) for c in AXES]
    cell = F.when(F.col("_count") >= CELLED, F.coalesce(cell_code(edge), F.lit(0))).otherwise(0).cast("long")
    group = ("_block", "_salt", "_lane")
    packs = (salted.join(dealt, [*FRAME, "_salt"]).groupBy(*FRAME, "_at", *group, cell.alias("_cell"))
             .agg(F.collect_list(F.struct(*others)).alias("_points"), *ends)
             .select(*FRAME, "_at", *group, "_points", *_middles()))
    asked = wanted.join(dealt.select(SESSION, *group).distinct(), [SESSION, "_block"]).select(
        SESSION, *group, "_rank", "_view.seq", "_view.view_id", "_view.image_k", *_flat(F.col("_view._m"), F.col("_view.image_k")))
    reached = asked.join(packs, [SESSION, *group]).where(_inside(n) & _may_see())
    m, k = {i: F.col(f"_m{i}") for i in MATRIX}, {c: F.col(f"_k_{c}") for c in K}
    rows = reached.select(*FRAME, "seq", "view_id", "image_k", *[c for c in reached.columns if c.startswith(("_m", "_k_"))],
                          F.inline("_points").alias(*[f"_p_{c}" for c in others]))
    x, y, z = apply_matrix(m, F.col("_p_x"), F.col("_p_y"), F.col("_p_z"))
    placed = rows.withColumns({"_cx": x, "_cy": y, "depth_m": -z})
    ahead = placed.where((F.col("depth_m") >= NEAR) & (F.col("depth_m") <= FAR))
    pixels = ahead.withColumns({"u": k["cx"] + k["fx"] * F.col("_cx") / F.col("depth_m"),
                                "v": k["cy"] - k["fy"] * F.col("_cy") / F.col("depth_m")})
    return pixels.where((F.col("u") >= 0) & (F.col("u") < k["width"]) & (F.col("v") >= 0) & (F.col("v") < k["height"])).select(
        *FRAME, *[F.col(f"_p_{c}").alias(c) for c in others], "seq", "view_id", "image_k", "depth_m", "u", "v")


def points_per_view(seen: DataFrame) -> DataFrame:
    return seen.groupBy(SESSION, "view_id").agg(F.count("*").alias("points_seen"),
                                                F.min("depth_m").alias("nearest_m"))
