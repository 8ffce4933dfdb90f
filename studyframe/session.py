"""Spark session helpers shared by tests, the bench and the driver entry."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every studyframe job relies on: UTC wall clock for calendar parts,
# adaptive execution for skewed group keys and small result stages.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # whole texts travel in Arrow batches: few rows, and few bytes, make a batch
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "studyframe") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting must name a shared (HDFS/S3/…) folder and is used as is.
    Only a local master without it (as in tests) gets a folder under the local temp dir.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="studyframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf)
    spark.sparkContext.setCheckpointDir(conf)
    return conf


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once a Spark application.

    Workers started elsewhere than in the repository's folder cannot import it otherwise.
    """
    sc = spark.sparkContext
    if getattr(sc, "_studyframe_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    # the driver serves the file for as long as the application runs
    archive = os.path.join(tempfile.mkdtemp(prefix="studyframe-ship-"), "studyframe_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for top, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(archive)
    sc._studyframe_shipped = True


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder, for written intermediate tables."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def materialize(df, name: str = "stage"):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    For frames that several passes read: later passes scan only the columns they
    need instead of recomputing the upstream plan, and the written table survives
    executor loss (unlike a cache).  Column metadata is kept in the Parquet schema.
    """
    spark = df.sparkSession
    path = shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._studyframe_path = path
    return out


def discard(df) -> None:
    """Delete the table behind a frame from ``materialize`` once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._studyframe_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
