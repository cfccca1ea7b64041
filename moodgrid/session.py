"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # AQE splits the partitions of a hot join key at run time; the operators
    # salt on top of that where a hot key is expected.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "moodgrid", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, skew handling and a UTC clock."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ADAPTIVE, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session, from wherever the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_moodgrid_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = shutil.make_archive(tempfile.mkdtemp(prefix="moodgrid-") + "/moodgrid", "zip", here.parent, here.name)
    context.addPyFile(archive)
    context._moodgrid_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: on a
    cluster a machine-local folder would be lost together with its executor.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
    elif context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="moodgrid-checkpoint-"))
    return df.checkpoint(eager=True)
