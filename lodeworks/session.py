"""Spark session settings and the one way in which lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings of every session this package opens itself.  A session handed in by the caller is left as it is.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "lodeworks", **extra: str) -> SparkSession:
    """A session with ``SETTINGS``; ``extra`` holds further settings with ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: the shared one the cluster names, else (local runs and tests only) one of our own."""
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"lodeworks-checkpoints-{os.getpid()}")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from it: it survives lost executors and is computed once."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder: like :func:`cut`, but compressed and read by column.

    For rows of which later steps need some columns only.  The table goes when the application ends.
    """
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(where.toString())
    return spark.read.schema(df.schema).parquet(where.toString())
