"""Working tables by day and bucket: only asked days are read, tables meet without a shuffle, no session is one bucket."""

from __future__ import annotations

import uuid

import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from capturelake.operators.asof import match_metadata
from capturelake.sources import working

SCHEMA = "session_id string, seq long, timestamp_ns long, iso int"


@pytest.fixture
def laid(spark, tmp_path):
    """Photos and metadata of a hot session and small ones on three days, some again at the same time."""
    mark = uuid.uuid4().hex
    rows = lambda step: spark.range(0, 3000, step).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("session_id"),
        F.col("id").alias("seq"), (F.floor(F.col("id") / 4) * 10**10).alias("timestamp_ns"), (F.col("id") % 50).cast("int").alias("iso"))
    day = F.expr("date_add(DATE'2024-03-01', cast(length(session_id) + ascii(substring(session_id, 2)) AS int) % 3)")
    made = {}
    for name, step in (("images", 1), ("meta", 5)):
        table = working.write_working_table(rows(step), f"{name}_{mark}", f"{tmp_path}/{name}", day, buckets=4)
        made[name] = (rows(step), table, f"{tmp_path}/{name}")
    yield made
    for name in made:
        spark.sql(f"DROP TABLE {name}_{mark}")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_same_rows_as_the_plain_join_and_no_shuffle(spark, laid):
    (images, image_table, _), (meta, meta_table, _) = laid["images"], laid["meta"]
    got = working.match_in_place(image_table, meta_table)
    columns = ("session_id", "seq", "timestamp_ns", "iso", "meta.seq", "meta.iso")
    as_text = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert as_text(got) == as_text(match_metadata(images, meta))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(working.match_in_place(image_table, meta_table))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "Exchange" not in text and "Join" in text


def test_only_the_days_asked_for_are_read(laid):
    table, metadata = laid["images"][1], laid["meta"][1]
    day = working.on_days(table, "2024-03-02", "2024-03-02")
    files = day.inputFiles()
    assert files and all("session_date=2024-03-02" in f for f in files) and len(files) < len(table.inputFiles())
    text = plan(working.match_in_place(day, working.on_days(metadata, "2024-03-02", "2024-03-02")))
    assert text.count("PartitionFilters: [isnotnull(session_date") == 2  # of both tables


def test_a_hot_session_lies_in_all_buckets(laid):
    hot = laid["images"][1].where("session_id = 'hot'").groupBy(F.input_file_name()).count().collect()
    assert len(hot) == 4 and max(r["count"] for r in hot) < 1000


def test_opened_again_by_another_session(spark, laid):
    _, table, path = laid["images"]
    name = f"again_{uuid.uuid4().hex}"
    back = working.open_working_table(spark, name, path, SCHEMA, buckets=4)
    assert rows_of(back, "session_id", "seq", "timestamp_ns") == rows_of(table, "session_id", "seq", "timestamp_ns")
    assert "Exchange" not in plan(back.groupBy(*working.KEY).count())
    spark.sql(f"DROP TABLE {name}")


def test_nulls_and_an_empty_table(spark, tmp_path):
    name = f"nulls_{uuid.uuid4().hex}"
    rows = spark.createDataFrame([("a", 1, 5, 1), (None, 2, None, 2), ("a", 3, None, None)], SCHEMA)
    day = F.when(F.col("session_id") == "a", F.lit("2024-01-01"))
    assert working.write_working_table(rows, name, f"{tmp_path}/n", day, 2).count() == 3
    assert working.write_working_table(rows.limit(0), name, f"{tmp_path}/n", day, 2).count() == 0
    spark.sql(f"DROP TABLE {name}")
