"""Saved photos of a stream as documents, each once.

The stream numbers a session's saved photos in its state (``capture_index``). A micro-batch writes the
documents of the photos that the ledger does not have, under names that follow from index and time, and then one
entry of the ledger, which is written once and never changed. A batch that runs again after its entry finds all its
photos in the ledger and writes nothing; before its entry, it writes the same files again. A new query without the
old checkpoint numbers the same arrivals alike, and what the ledger has is left alone. A document without an
entry does not count: readers go by the ledger.

The ledger is read for the clock range of the batch only, so a batch does not pay for what was committed before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from capturelake.operators.asof import STAMP, match_metadata
from capturelake.operators.export import keyframe_documents, trajectory_lines
from capturelake.plans.assemble import with_poses
from capturelake.plans.chunks import SESSION
from capturelake.policies import DATASET, Policy
from capturelake.sources import readers, writers

LEDGER = "session_id string, timestamp_ns long, capture_index int, image string, line string"


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """(session_id, timestamp_ns, capture_index, image, line) of every committed photo."""
    folder = f"{root}/_ledger"
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(f"{folder}/start")
    return spark.read.schema(LEDGER).parquet(f"{folder}/*")


def described(images: DataFrame, metadata: DataFrame, poses: DataFrame, policy: Policy = DATASET) -> Callable[[DataFrame], DataFrame]:
    """Joins photo, metadata and pose tables to outcome rows, as documents. The tables hold what has arrived so far."""
    def documents(rows: DataFrame) -> DataFrame:
        known = match_metadata(images.join(rows.select(*STAMP).distinct(), STAMP, "left_semi"), metadata).drop("seq")
        full = rows.join(known, STAMP).withColumns({
            "pose_timestamp_ns": F.col("timestamp_ns") + F.col("pose_delta_ns"),
            "depth_timestamp_ns": F.col("timestamp_ns") + F.col("depth_delta_ns")})
        return keyframe_documents(with_poses(full, poses), policy)
    return documents


def commit_batch(batch: DataFrame, batch_id: int, describe: Callable[[DataFrame], DataFrame], root: str) -> None:
    """Writes the documents of the batch's saved photos that are not committed yet, and then their ledger entry."""
    spark = batch.sparkSession
    saved = batch.where("outcome = 'saved'").persist()
    try:
        low, high = saved.agg(F.min("timestamp_ns"), F.max("timestamp_ns")).first()
        if low is None:
            return
        known = ledger(spark, root).where(F.col("timestamp_ns").between(low, high)).select(*STAMP)
        documents = describe(saved.join(known, STAMP, "left_anti")).persist()
        try:
            if documents.isEmpty():
                return
            writers.write_keyframes(documents, root)
            key = documents.select(SESSION, F.col("jpeg_sensor_timestamp_ns").alias("timestamp_ns"), "capture_index", "image")
            entry = key.join(trajectory_lines(documents), [SESSION, "capture_index"]).select(*[c.split(" ")[0] for c in LEDGER.split(", ")])
            # A row for each photo of one micro-batch in one file, so that it is there as a whole or not at all.
            entry.coalesce(1).write.mode("errorifexists").parquet(f"{root}/_ledger/{batch_id:012d}-{uuid.uuid4().hex}")
        finally:
            documents.unpersist()
    finally:
        saved.unpersist()


def stream_write_documents(rows: DataFrame, describe: Callable[[DataFrame], DataFrame], root: str, checkpoint: str) -> StreamingQuery:
    """Documents of the saved photos of ``stream_assemble_keyframes``, each once."""
    return (rows.writeStream.foreachBatch(lambda batch, n: commit_batch(batch, n, describe, root))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def committed_keyframes(spark: SparkSession, root: str) -> DataFrame:
    """The documents that the ledger names, as ``read_keyframes`` gives them."""
    return readers.read_keyframes(spark, root).join(ledger(spark, root).select(SESSION, "image").distinct(), [SESSION, "image"], "left_semi")


def write_committed_trajectory(spark: SparkSession, root: str) -> DataFrame:
    """B3 from the ledger: camera_trajectory.csv of every session, ordered by capture index."""
    lines = ledger(spark, root).select(SESSION, F.col("capture_index").alias("position"), "line").distinct()
    return writers.write_session_files(lines, root, "camera_trajectory.csv", writers.TRAJECTORY_HEADER, "\n", "\n")
