"""Session settings the jobs are written for; nothing here is required at import."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM does not compile methods over 8000 bytes; point arithmetic in one stage exceeds
    # that and would be interpreted, several times slower than operator by operator.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "capturelake", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the cluster; a temporary one only in local mode without one named."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        current = held.get() if held.isDefined() else None
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        current = tempfile.mkdtemp(prefix="capturelake-ckpt-")
        spark.sparkContext.setCheckpointDir(current)
    elif spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(current)
    return current


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the workers, once per context; they need no path to its folder then."""
    context = spark.sparkContext
    if getattr(context, "_capturelake_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    held = os.path.join(tempfile.mkdtemp(prefix="capturelake-zip-"), "capturelake.zip")
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(home)))
    context.addPyFile(held)
    context._capturelake_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """A table several later branches read, computed once and kept in the shared checkpoint folder.

    Runs a job. Without it every branch would plan and compute the table again, and each
    further step would double that.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
