"""Working tables laid out by day, session and time: partitions by date, buckets by session and timestamp.

A query over some days lists and reads only their folders. Rows of equal session and timestamp lie in the same bucket of
every table with the same number of buckets, so tables meet on them without a shuffle. The timestamp is part of the
bucket's key, so a session with a third of all rows is spread over all buckets. The day is no key of a join: Spark
reuses buckets only where a join is on exactly their columns, so each side is given its days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.plans.chunks import SESSION

DAY = "session_date"
KEY = (SESSION, "timestamp_ns")
#: As many files a day; choose them for 128 MB or more each.
BUCKETS = 64


def write_working_table(rows: DataFrame, name: str, path: str, day: Column, buckets: int = BUCKETS) -> DataFrame:
    """Stores rows with session_id and timestamp_ns as table ``name`` below ``path``; ``day`` is a session's date.

    Rows are shuffled once, to the tasks of their buckets, so each bucket of a day is one file. Rows without a
    session, timestamp or day are kept, under null.
    """
    placed = rows.withColumn(DAY, day.cast("date"))
    (placed.repartition(buckets, *KEY).write.format("parquet").mode("overwrite").option("path", path)
     .partitionBy(DAY).bucketBy(buckets, *KEY).sortBy(*KEY).saveAsTable(name))
    return rows.sparkSession.table(name)


def open_working_table(spark: SparkSession, name: str, path: str, schema: str, buckets: int = BUCKETS) -> DataFrame:
    """A table that another session wrote, with its layout; ``schema`` describes the rows that were given to the writer."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}, {DAY} date) USING parquet PARTITIONED BY ({DAY}) "
              f"CLUSTERED BY ({', '.join(KEY)}) SORTED BY ({', '.join(KEY)}) INTO {int(buckets)} BUCKETS "
              f"LOCATION '{path}'")
    spark.catalog.recoverPartitions(name)
    return spark.table(name)


def on_days(table: DataFrame, first: str, last: str) -> DataFrame:
    """Rows of sessions from ``first`` to ``last``, both included; other days' folders are not listed."""
    return table.where(F.col(DAY).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def latest_in_place(table: DataFrame) -> DataFrame:
    """Of rows with one session and timestamp the last arrival (largest seq), without a shuffle."""
    others = [c for c in table.columns if c not in KEY]
    held = table.groupBy(*KEY).agg(F.max_by(F.struct(*others), "seq").alias("_row"))
    return held.select(*KEY, *[F.col("_row")[c].alias(c) for c in others])


def match_in_place(images: DataFrame, metadata: DataFrame) -> DataFrame:
    """D1 over two working tables: images with the metadata of their timestamp as ``meta``, null without one.

    The same rows as ``operators.asof.match_metadata``. Where only some days are wanted give both tables through
    ``on_days``; a session has one day.
    """
    meta = latest_in_place(metadata.drop(DAY))
    packed = meta.select(*KEY, F.struct(*[c for c in meta.columns if c not in KEY]).alias("meta"))
    return latest_in_place(images).join(packed, list(KEY), "left")
