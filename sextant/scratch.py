"""Intermediate tables in the folder that all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder, or a temporary one on a single machine where the setting is missing; that one goes at exit."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="sextant-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession) -> str:
    """A new folder's name; the folder goes when the application ends."""
    path = f"{folder(spark)}/sextant-{uuid.uuid4().hex}"
    target, files = _hadoop(spark, path)
    files.deleteOnExit(target)
    return path


def write(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and reread where an executor is lost. drop deletes it."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by write. Nothing that is still to be run may read them."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path:
            target, files = _hadoop(t.sparkSession, path)
            files.delete(target, True)
