"""Predictive runs kept together (S10): comparison, metrics, importances, scores, manifest and model.

A run is written once under ``registry/<task>/<key>`` of the shared folder. The key is made of the
parameters, a fingerprint of the rows and one of the operators' code, so a run is found again only
for the same study of the same data by the same code, in this session or a later one. The manifest is written last: a run without it is not
complete and is not found. Runs of the same key by several writers lie side by side.
"""

from __future__ import annotations

import hashlib
import importlib
import inspect
import json
import pkgutil
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators
from ..session import shared_path
from . import sinks

TABLES = ("comparison", "metrics", "importance", "scored_test")


def fingerprint(df: DataFrame) -> str:
    """Digest of the rows, whatever their order or partitioning, and of the schema; one aggregation."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{df.schema.json()}|{row[0]}|{row[1]}".encode()).hexdigest()


def code_digest() -> str:
    """Digest of the operators' sources: a run made by other code is another run."""
    h = hashlib.sha256()
    for module in sorted(m.name for m in pkgutil.iter_modules(operators.__path__)):
        h.update(inspect.getsource(importlib.import_module(f"{operators.__name__}.{module}")).encode())
    return h.hexdigest()


def key_of(df: DataFrame, params: dict) -> str:
    """Name of a run: what it was made from, with which parameters, by which code."""
    return hashlib.sha256(f"{fingerprint(df)}|{json.dumps(params, sort_keys=True, default=str)}|{code_digest()}".encode()).hexdigest()[:32]


def _home(spark: SparkSession, task: str, key: str) -> str:
    return shared_path(spark, f"registry/{sinks._task_dir(task)}/{key}")


def find(spark: SparkSession, task: str, key: str) -> str | None:
    """Folder of a complete run of that key, or None."""
    home = spark._jvm.org.apache.hadoop.fs.Path(_home(spark, task, key))
    fs = home.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(home):
        return None
    runs = sorted(s.getPath().toString() for s in fs.listStatus(home) if s.isDirectory())
    done = [r for r in runs if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{r}/manifest/_SUCCESS"))]
    return done[0] if done else None


def publish(spark: SparkSession, task: str, key: str, result: dict, params: dict) -> str:
    """Write all parts of a finished ``model.run``; returns the folder."""
    path = f"{_home(spark, task, key)}/{uuid.uuid4().hex}"
    for name in TABLES:
        result[name].write.parquet(f"{path}/{name}")
    sinks.save_model(result["model"], f"{path}/model")
    notes = params | {"task": task, "key": key, "warning": result["warning"], "n_points": result["n_points"], "cv_folds": result["cv_folds"]}
    sinks.manifest(spark, notes).write.parquet(f"{path}/manifest")
    return path


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of a published run (also ``manifest``)."""
    return spark.read.parquet(f"{path}/{name}")


def fitted(path: str) -> PipelineModel:
    """The run's fitted pipeline, ready to score rows with the columns of the study."""
    return PipelineModel.load(f"{path}/model")
