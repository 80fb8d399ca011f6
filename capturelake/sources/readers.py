"""Sources (A1–A9). A capture root holds one directory per session; the session comes from the path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capturelake import schemas
from capturelake.plans.chunks import SESSION
from capturelake.sources import listing
from capturelake.sources.files import open_root
from capturelake.sources.json_ranges import RANGE, elements
from capturelake.sources.ply import RECORD, parse_header

#: Points read at a time, points of small files that leave together, and bytes that hold any header.
POINT_RANGE, POINT_BATCH, HEADER_BYTES = 1 << 20, 1 << 14, 1 << 12
PLANES = ("depth16", "confidence", "y_plane", "u_plane", "v_plane")


def _session(path: Column) -> Column:
    """The directory the file lies in."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, length) of the files with a name pattern below a root."""
    return listing.listed(spark, root, pattern).select(listing.path_of(root).alias("path"), "length")


def read_documents(spark: SparkSession, root: str, schema: str, *patterns: str) -> DataFrame:
    """A row per JSON document below a root: session, file name and the fields of the schema."""
    docs = listing.json_documents(spark, root, schema, *patterns)
    fields = [c for c in docs.columns if c != "place"]
    whole = docs.withColumn("_path", listing.path_of(root))
    return whole.select(_session(F.col("_path")).alias(SESSION), F.regexp_extract("_path", r"([^/]+)$", 1).alias("file_name"),
                        *[F.col(f"`{c}`") for c in fields])


def read_keyframes(spark: SparkSession, root: str) -> DataFrame:
    """A1: every frame_*.json of every session; unreadable documents become all-null rows, which E2 rejects."""
    return read_documents(spark, root, schemas.KEYFRAME, "frame_*.json")


def read_transforms(spark: SparkSession, root: str, lines: bool = False) -> DataFrame:
    """A2: one row per frame of every transforms.json, frame fields flattened.

    A document of another tool is parsed whole, by one task; ``read_transforms_ranges`` reads such documents of any
    size. ``lines`` says that this library wrote the documents: they hold a frame per line and are read line by
    line, in splits of any file.
    """
    if lines:
        return _transforms_by_line(spark, root)
    docs = read_documents(spark, root, schemas.TRANSFORMS, "transforms.json")
    rows = docs.select(SESSION, "camera_model", "coordinate_system", F.explode("frames").alias("f"))
    return rows.select(SESSION, "camera_model", "coordinate_system", "f.*")


def read_transforms_ranges(spark: SparkSession, root: str, size: int = RANGE) -> DataFrame:
    """A2 for transforms.json of any layout and size: byte ranges of a file are read by many tasks. Runs jobs."""
    files = _files(spark, root, "transforms.json")
    cut_out = elements(files, "frames", "camera_model string, coordinate_system string", size)
    return cut_out.select(_session(F.col("path")).alias(SESSION), "root.camera_model", "root.coordinate_system",
                          F.from_json("element", schemas.TRANSFORM_FRAME).alias("f")).select(
        SESSION, "camera_model", "coordinate_system", "f.*")


def _transforms_by_line(spark: SparkSession, root: str) -> DataFrame:
    # The first line ends where the list of frames begins; every range of a file looks there for itself.
    rows = listing.lines(spark, root, "transforms.json", r'"frames":\s*\[\s*$', '{"file_path"')
    root_of = F.concat("head", F.lit("]}"))
    entry = F.from_json(F.regexp_replace("line", r",\s*$", ""), schemas.TRANSFORM_FRAME, {"mode": "PERMISSIVE"})
    return rows.where(F.col("line").startswith('{"file_path"')).select(
        _session(listing.path_of(root)).alias(SESSION),
        *[F.get_json_object(root_of, f"$.{c}").alias(c) for c in ("camera_model", "coordinate_system")], entry.alias("f")).select(
        SESSION, "camera_model", "coordinate_system", "f.*")


def transforms_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions that have a transforms document, with its frame count."""
    docs = read_documents(spark, root, schemas.TRANSFORMS, "transforms.json")
    return docs.select(SESSION, F.size("frames").alias("frame_count"))


def read_trajectory(spark: SparkSession, root: str) -> DataFrame:
    """A3."""
    rows = listing.lines(spark, root, "camera_trajectory.csv").where("NOT start AND trim(line) <> ''")
    return rows.select(listing.path_of(root).alias("_path"), F.from_csv("line", schemas.TRAJECTORY, {"mode": "PERMISSIVE"}).alias("_row")).select(
        _session(F.col("_path")).alias(SESSION), F.regexp_extract("_path", r"([^/]+)$", 1).alias("file_name"), "_row.*")


CLOUD = T.StructType(
    [T.StructField(SESSION, T.StringType()), T.StructField("frame", T.StringType()),
     T.StructField("frame_ts_ns", T.LongType()), T.StructField("i", T.LongType())]
    + [T.StructField(c, T.FloatType()) for c in ("x", "y", "z")]
    + [T.StructField(c, T.ShortType()) for c in ("red", "green", "blue")]
    + [T.StructField("confidence", T.FloatType())])


def read_point_clouds(spark: SparkSession, root: str, records: int = POINT_RANGE) -> DataFrame:
    """A4: point rows of every PLY file, read in ranges of ``records`` points, so that files may have any size."""
    ranges = F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / (records * RECORD.itemsize)))
    files = _files(spark, root, "frame_*.ply").select(
        _session(F.col("path")).alias(SESSION), F.regexp_extract("path", r"([^/]+)\.ply$", 1).alias("frame"), "path",
        F.explode(ranges).alias("range"))

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        """The points of several ranges as one batch."""
        sessions, frames, stamps, firsts, parts = zip(*held)
        counts = [len(p) for p in parts]
        points, at = np.concatenate(parts), pa.array(np.repeat(np.arange(len(parts)), counts))
        columns = [pa.array(sessions, pa.string()).take(at), pa.array(frames, pa.string()).take(at),
                   pa.array(np.repeat(np.array(stamps, dtype=np.int64), counts)),
                   pa.array(np.concatenate([np.arange(a, a + n, dtype=np.int64) for a, n in zip(firsts, counts)]))]
        columns += [pa.array(np.ascontiguousarray(points[c])) for c in "xyz"]
        columns += [pa.array(points[c].astype(np.int16)) for c in ("red", "green", "blue")]
        columns.append(pa.array(np.ascontiguousarray(points["confidence"])))
        return pa.RecordBatch.from_arrays(columns, names=CLOUD.names)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for session, frame, path, part in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                fs, place = open_root(path)
                with fs.open_input_file(place) as source:
                    data = source.read(HEADER_BYTES)
                    start, total, stamp = parse_header(data)
                    count = max(0, min(records, total - part * records))
                    first = start + part * records * RECORD.itemsize
                    data = data[first:first + count * RECORD.itemsize]
                    if len(data) < count * RECORD.itemsize:  # not all in the first read
                        source.seek(first)
                        data = source.read(count * RECORD.itemsize)
                if not count:
                    continue
                held.append((session, frame, stamp, part * records, np.frombuffer(data, dtype=RECORD, count=count)))
                size += count
                if size >= POINT_BATCH:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    return files.mapInArrow(decode, CLOUD)


def read_session_cameras(spark: SparkSession, root: str) -> DataFrame:
    """A5: session_camera.json and session_device.json, absent fields null."""
    return read_documents(spark, root, schemas.SESSION_CAMERA, "session_camera.json", "session_device.json")


def read_images(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Photos with index and timestamp from their names; the bytes are read only on request.

    A photo whose name has no index and timestamp keeps its row, with nulls there.
    """
    files = listing.listed(spark, root, "frame_*.jpg")
    files = (listing.contents(files, root) if content else files).withColumn("path", listing.path_of(root))
    name = r"frame_(\d+)_(\d+)\.jpg$"
    columns = [_session(F.col("path")).alias(SESSION),
               F.regexp_extract("path", name, 1).try_cast("int").alias("capture_index"),
               F.regexp_extract("path", name, 2).try_cast("long").alias("timestamp_ns"), "path", "length"]
    return files.select(*columns, *(["content"] if content else []))


def complete_depth_frames(frames: DataFrame) -> DataFrame:
    """A frame counts only when colour, depth and confidence are all there."""
    return frames.dropna(subset=list(PLANES))


def read_depth_frames(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with one row per depth frame and its binary planes."""
    return complete_depth_frames(spark.read.schema(schemas.DEPTH_FRAMES).parquet(path))


def _table(spark: SparkSession, path: str, schema: str, fmt: str, stream: bool,
           max_files: int | None) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.schema(schema).format(fmt).load(path)


def read_camera_states(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False,
                       max_files: int | None = None) -> DataFrame:
    """A8."""
    return _table(spark, path, schemas.CAMERA_STATES, fmt, stream, max_files)


def read_still_metadata(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False,
                        max_files: int | None = None) -> DataFrame:
    """A8."""
    return _table(spark, path, schemas.STILL_METADATA, fmt, stream, max_files)


def read_poses(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False,
               max_files: int | None = None) -> DataFrame:
    """A9."""
    return _table(spark, path, schemas.POSES, fmt, stream, max_files)
