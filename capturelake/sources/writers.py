"""Sinks (B1–B8).

Every file gets a deterministic final name and is written under a temporary name first, so
a task may run again after a lost executor. Paths are local or URIs that pyarrow can open.
Each writer runs its job and returns the manifest it stored under ``<root>/_manifests``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from capturelake.operators.export import trajectory_lines, transforms_head
from capturelake.plans.chunks import SESSION, chunk_of
from capturelake.sources.files import open_root
from capturelake.sources.listing import tasks
from capturelake.sources.ply import RECORD, header

MANIFEST = "session_id string, file string, items long, bytes long"
POINT_SLAB = 1 << 20
LINE_SLAB = 1 << 17
TRAJECTORY_HEADER = "index,image,point_cloud,image_timestamp_ns,pose_timestamp_ns,tx,ty,tz,qx,qy,qz,qw\n"


def _target(fs: pafs.FileSystem, base: str, session: str, name: str) -> tuple[str, str]:
    """Final and temporary path of a session's file, its directory created."""
    folder = f"{base}/{session}"
    fs.create_dir(folder, recursive=True)
    return f"{folder}/{name}", f"{folder}/.{name}.{uuid.uuid4().hex}"


def _put(fs: pafs.FileSystem, base: str, session: str, name: str, data: bytes) -> None:
    final, temporary = _target(fs, base, session, name)
    with fs.open_output_stream(temporary) as out:
        out.write(data)
    fs.move(temporary, final)


def _store(manifest: DataFrame, root: str, name: str) -> DataFrame:
    where = f"{root}/_manifests/{name}"
    manifest.write.mode("overwrite").parquet(where)
    return manifest.sparkSession.read.schema(MANIFEST).parquet(where)


def write_documents(rows: DataFrame, root: str, label: str) -> DataFrame:
    """One small file per row: session_id, file and content (text or bytes)."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_root(root)
        for pdf in batches:
            sizes = []
            for session, name, content in zip(pdf[SESSION], pdf["file"], pdf["content"]):
                data = content.encode("utf-8") if isinstance(content, str) else bytes(content)
                _put(fs, base, session, name, data)
                sizes.append(len(data))
            yield pd.DataFrame({SESSION: pdf[SESSION], "file": pdf["file"], "items": 1, "bytes": sizes})

    return _store(rows.select(SESSION, "file", "content").mapInPandas(write, MANIFEST), root, label)


def _json(columns: list[str], keep_nulls: bool = True) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false" if keep_nulls else "true"})


def _spread(rows: DataFrame) -> DataFrame:
    """Small rows that each cost a file, dealt to all tasks: by their bytes Spark would give them to a few."""
    return rows.repartition(tasks(rows.sparkSession), SESSION, "file")


def write_keyframes(documents: DataFrame, root: str) -> DataFrame:
    """B2: one JSON document per keyframe, nulls explicit."""
    fields = [c for c in documents.columns if c != SESSION]
    name = F.regexp_replace("image", r"\.jpg$", ".json")
    return write_documents(documents.select(SESSION, name.alias("file"), _json(fields).alias("content")),
                           root, "keyframes")


def write_images(images: DataFrame, root: str) -> DataFrame:
    """The photos of saved keyframes: session_id, image (file name) and content bytes."""
    return write_documents(images.select(SESSION, F.col("image").alias("file"), "content"), root, "images")


def write_manifests(manifests: DataFrame, root: str) -> DataFrame:
    """B5."""
    fields = [c for c in manifests.columns if c != SESSION]
    return write_documents(_spread(manifests.select(SESSION, F.lit("dataset_manifest.json").alias("file"),
                                                    _json(fields).alias("content"))), root, "manifests")


def write_jobs(jobs: DataFrame, root: str) -> DataFrame:
    """Job documents of the sessions that are ready."""
    fields = ["format_version", "status", "requested_at_unix_ms", "frame_count", "transforms", "rgb_pattern",
              "depth_prior_pattern", "camera_convention", "backend", "note"]
    return write_documents(_spread(jobs.where("reason = 'ready'").select(
        SESSION, F.lit("3dgs_job.json").alias("file"), _json(fields).alias("content"))), root, "jobs")


def write_session_cameras(cameras: DataFrame, root: str, name: str = "session_camera.json") -> DataFrame:
    """Session camera documents with explicit nulls."""
    fields = [c for c in cameras.columns if c != SESSION]
    documents = cameras.select(SESSION, F.lit(name).alias("file"), _json(fields).alias("content"))
    return write_documents(_spread(documents), root, "cameras")


def write_point_clouds(points: DataFrame, root: str, slab: int = POINT_SLAB) -> DataFrame:
    """B1: one point file per (session, frame).

    Points: session_id, frame (base name), frame_ts_ns, i, x, y, z, red, green, blue,
    confidence; ``i`` numbers the points of a frame.
    """
    rows = points.select(
        SESSION, F.concat("frame", F.lit(".ply")).alias("file"), F.col("i").alias("position"), "frame_ts_ns",
        *[F.col(c).cast("float").alias(c) for c in ("x", "y", "z")],
        *[F.col(c).cast("int").alias(c) for c in ("red", "green", "blue")], F.col("confidence").cast("float"))

    def encode(pdf: pd.DataFrame) -> bytes:
        records = np.empty(len(pdf), dtype=RECORD)
        for c in RECORD.names:
            records[c] = pdf[c].to_numpy()
        return records.tobytes()

    return _write_slabs(rows, root, "point_clouds", slab, encode, header, b"", b"")


def write_session_files(lines: DataFrame, root: str, name: str, head: str, tail: str, separator: str,
                        slab: int = LINE_SLAB) -> DataFrame:
    """One ordered text file per session from (session_id, position, line); positions are unique."""
    rows = lines.select(SESSION, F.lit(name).alias("file"), F.col("position").cast("long").alias("position"),
                        F.lit(0).cast("long").alias("frame_ts_ns"), "line")
    gap = separator.encode("utf-8")
    return _write_slabs(rows, root, name.split(".")[0], slab, lambda pdf: separator.join(pdf["line"]).encode("utf-8"),
                        lambda stamp, count: head.encode("utf-8"), gap, tail.encode("utf-8"))


def _write_slabs(rows: DataFrame, root: str, label: str, slab: int, encode: Callable[[pd.DataFrame], bytes],
                 head: Callable[[int, int], bytes], separator: bytes, tail: bytes) -> DataFrame:
    """Files of any size from rows (session_id, file, position, frame_ts_ns, ...).

    Rows are clustered by (session, file, slab of positions) and sorted and counted JVM-side;
    a task streams each slab, batch by batch, to a file of its own with head and tail. A
    second step per file renames the only slab, or joins the bytes of several.
    """
    folder = f"{root}/_pieces/{label}-{uuid.uuid4().hex}"
    unit = Window.partitionBy(SESSION, "file", "_slab")
    # Slabs are dealt to all tasks: most hold one small file, which costs more than its bytes.
    slabs = rows.withColumn("_slab", chunk_of("position", slab)).repartition(tasks(rows.sparkSession), SESSION, "file", "_slab")
    ordered = slabs.select(
        "*", F.count("*").over(unit).alias("_count"), F.row_number().over(unit.orderBy("position")).alias("_n"))
    parts = ordered.mapInPandas(
        _piece_writer(folder, encode, head, separator, tail),
        "session_id string, file string, slab long, piece string, items long, stamp long, head long, size long")
    listed = _spread(parts).groupBy(SESSION, "file").agg(
        F.array_sort(F.collect_list(F.struct("slab", "piece", "head", "size"))).alias("parts"),
        F.sum("items").alias("items"), F.min("stamp").alias("stamp"))
    manifest = _store(listed.mapInPandas(_piece_joiner(root, folder, head, separator, tail), MANIFEST), root, label)
    fs, base = open_root(folder)
    if fs.get_file_info(base).type == pafs.FileType.Directory:
        fs.delete_dir(base)
    return manifest


def _piece_writer(folder: str, encode: Callable[[pd.DataFrame], bytes], head: Callable[[int, int], bytes],
                  separator: bytes, tail: bytes) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_root(folder)
        fs.create_dir(base, recursive=True)
        out = piece = start = None
        for pdf in batches:
            done = []
            begins = np.flatnonzero(pdf["_n"].to_numpy() == 1)
            edges = np.unique(np.concatenate([[0], begins, [len(pdf)]]))
            for a, b in zip(edges[:-1], edges[1:]):
                run = pdf.iloc[a:b]
                first = run.iloc[0]
                if first["_n"] == 1:
                    piece = uuid.uuid4().hex
                    start = head(int(first["frame_ts_ns"]), int(first["_count"]))
                    out = fs.open_output_stream(f"{base}/{piece}")
                    out.write(start)
                else:
                    out.write(separator)
                out.write(encode(run))
                if run["_n"].iat[-1] == first["_count"]:
                    out.write(tail)
                    size = out.tell()
                    out.close()
                    done.append((first[SESSION], first["file"], first["_slab"], piece, first["_count"],
                                 first["frame_ts_ns"], len(start), size))
            yield pd.DataFrame(done, columns=[SESSION, "file", "slab", "piece", "items", "stamp", "head", "size"])
    return write


def _piece_joiner(root: str, folder: str, head: Callable[[int, int], bytes], separator: bytes,
                  tail: bytes) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_root(root)
        _, held = open_root(folder)
        for pdf in batches:
            sizes = []
            for session, name, parts, items, stamp in zip(*[pdf[c] for c in (SESSION, "file", "parts", "items", "stamp")]):
                final, temporary = _target(fs, base, session, name)
                source = f"{held}/{parts[0]['piece']}"
                if len(parts) == 1:
                    if fs.get_file_info(source).type == pafs.FileType.File:
                        fs.move(source, final)
                    elif fs.get_file_info(final).size != parts[0]["size"]:
                        # Otherwise an earlier attempt of this task renamed it.
                        raise FileNotFoundError(f"the piece of {session}/{name} is gone and the file does not have its size")
                else:
                    with fs.open_output_stream(temporary) as out:
                        out.write(head(int(stamp), int(items)))
                        for k, part in enumerate(parts):
                            if k:
                                out.write(separator)
                            _copy_body(fs, f"{held}/{part['piece']}", int(part["head"]), len(tail), out)
                        out.write(tail)
                    fs.move(temporary, final)
                sizes.append(fs.get_file_info(final).size)
            yield pd.DataFrame({SESSION: pdf[SESSION], "file": pdf["file"], "items": pdf["items"], "bytes": sizes})
    return join


def _copy_body(fs: pafs.FileSystem, path: str, head: int, tail: int, out: pa.NativeFile) -> None:
    """A piece's bytes between its head and its tail, block by block."""
    left = fs.get_file_info(path).size - head - tail
    with fs.open_input_file(path) as source:
        source.seek(head)
        while left > 0:
            block = source.read(min(left, 1 << 20))
            out.write(block)
            left -= len(block)


def write_trajectory(documents: DataFrame, root: str) -> DataFrame:
    """camera_trajectory.csv per session, ordered by capture index."""
    lines = trajectory_lines(documents).withColumnRenamed("capture_index", "position")
    return write_session_files(lines, root, "camera_trajectory.csv", TRAJECTORY_HEADER, "\n", "\n")


def write_transforms(frames: DataFrame, root: str, source: str = "capturelake") -> DataFrame:
    """Transforms.json per session from ``build_transforms`` rows."""
    lines = frames.select(SESSION, F.col("capture_index").alias("position"), F.to_json("frame").alias("line"))
    head = json.dumps(transforms_head(source))[:-1] + ', "frames": [\n'
    return write_session_files(lines, root, "transforms.json", head, "\n]}\n", ",\n")


PUBLISHED = "session_id string, file string, items long, bytes long, status string"


def publish_datasets(sessions: DataFrame, root: str) -> DataFrame:
    """Marks and renames capture_tmp_X to dataset_X (dataset_X_saved if that exists), per session in its task.

    ``sessions`` has session_id = the directory name; other names stay in place. The status is
    published; already (an earlier attempt renamed it, which a marker in the target proves); taken (both
    targets exist, so the working directory stays, marked); or missing (there is no such directory).
    """
    def publish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_root(root)

        def there(name: str) -> bool:
            return fs.get_file_info(f"{base}/{name}").type == pafs.FileType.Directory

        def came_from(target: str, name: str) -> bool:
            marker = f"{base}/{target}/.published_from"
            if fs.get_file_info(marker).type != pafs.FileType.File:
                return False
            with fs.open_input_file(marker) as held:
                return held.read().decode("utf-8") == name

        def put(path: str, text: str) -> None:
            with fs.open_output_stream(f"{base}/{path}") as out:
                out.write(text.encode("utf-8"))

        for pdf in batches:
            done = []
            for name in pdf[SESSION]:
                plain = name.replace("capture_tmp_", "dataset_", 1) if name.startswith("capture_tmp_") else name
                targets = [plain] if plain == name else [plain, f"{plain}_saved"]
                if there(name):
                    free = [t for t in targets if t == name or not there(t)]
                    final, status = (free[0], "published") if free else (name, "taken")
                    put(f"{name}/.saved", "saved\n")
                    if final != name:
                        put(f"{name}/.published_from", name)
                        fs.move(f"{base}/{name}", f"{base}/{final}")
                else:
                    earlier = [t for t in targets if came_from(t, name)]
                    final, status = (earlier[-1], "already") if earlier else (None, "missing")
                done.append((name, final, int(status != "missing"), 0, status))
            yield pd.DataFrame(done, columns=[SESSION, "file", "items", "bytes", "status"])

    todo = sessions.select(SESSION).distinct().repartition(tasks(sessions.sparkSession), SESSION)
    manifest = todo.mapInPandas(publish, PUBLISHED)
    where = f"{root}/_manifests/published"
    manifest.write.mode("overwrite").parquet(where)
    return manifest.sparkSession.read.schema(PUBLISHED).parquet(where)
