"""Result sinks (S6–S10, G10): Parquet tables partitioned by task, a one-row
manifest of run parameters, and MLlib model persistence."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _task_dir(task: str) -> str:
    return "".join(ch if ch.isalnum() or ch in "-_" else "_" for ch in str(task))


def write_table(df: DataFrame, root: str, task: str, name: str, mode: str = "overwrite") -> str:
    """Write one result table to ``root/task=<task>/<name>`` as Parquet."""
    path = f"{root.rstrip('/')}/task={_task_dir(task)}/{name}"
    df.write.mode(mode).parquet(path)
    return path


def write_tables(tables: dict, root: str, task: str) -> dict:
    """Every named table of a stage, one Parquet folder each."""
    return {name: write_table(df, root, task, name) for name, df in tables.items() if df is not None}


def manifest(spark: SparkSession, params: dict) -> DataFrame:
    """One-row manifest: each parameter as a JSON string, plus the creation time."""
    row = {k: json.dumps(v, default=str) for k, v in sorted(params.items())}
    df = spark.createDataFrame([row]) if row else spark.range(1).drop("id")
    return df.withColumn("created_at", F.current_timestamp())


def write_manifest(spark: SparkSession, params: dict, root: str, task: str) -> str:
    return write_table(manifest(spark, params), root, task, "manifest")


def save_model(model, path: str) -> str:
    """MLlib persistence of a fitted model (a shared path on a cluster)."""
    model.write().overwrite().save(path)
    return path
