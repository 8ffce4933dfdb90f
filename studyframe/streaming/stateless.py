"""Stateless stages on a stream.

Typing (P5–P13), derivation (D1, D3–D8) and cohort flags (C1/C3) are per-row
column expressions, so they run unchanged on a streaming DataFrame.  This module
wires them between a file source and a Parquet sink with a checkpoint location;
nothing here keeps state, so no watermark is needed and a restarted query resumes
from its checkpoint.  Stages that need the whole table (missing flags, duplicate
masks, profiles, tests, models) are batch stages and are not offered here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean, cohort
from ..spec import TaskSpec, split_specs


def clean_rows(df: DataFrame, specs, task: TaskSpec | None = None) -> DataFrame:
    """Type, derive and (optionally) flag cohort membership row by row."""
    out = clean.apply_derived(clean.apply_schema(df, specs), specs)
    if task is not None:
        out = cohort.attach_target(cohort.flag(out, task), task)
    return out


def raw_schema(specs, extra=()) -> T.StructType:
    """All-string schema of the source columns (a file stream needs its schema up front)."""
    source, _ = split_specs(specs)
    names = [s.name for s in source] + [c for c in extra if c not in {s.name for s in source}]
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def start(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, specs,
          task: TaskSpec | None = None, fmt: str = "csv", extra_columns=(), trigger_once: bool = True):
    """Start the streaming query; returns the ``StreamingQuery``.

    ``checkpoint_dir`` must be on shared storage on a cluster (e.g. under the
    session's ``spark.checkpoint.dir``).
    """
    reader = spark.readStream.schema(raw_schema(specs, extra_columns))
    if fmt == "csv":
        reader = reader.option("header", True)
    stream = reader.format(fmt).load(source_dir).withColumn("_src_file", F.col("_metadata.file_path"))
    rows = clean_rows(stream, specs, task)
    writer = (rows.writeStream.format("parquet").option("path", sink_dir)
              .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def run_available(rows: DataFrame, sink_dir: str, checkpoint_dir: str, timeout_s: int = 600) -> None:
    """Process everything available now into a Parquet sink, then stop."""
    q = (rows.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("streaming query did not finish")
    if q.exception() is not None:
        raise q.exception()
