"""Lineage cuts and shared working folders.

Executors may be lost at any time, so intermediate results are cut with a
reliable ``checkpoint()`` in the folder the cluster names in
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach. Only where none is named and all is one process, a temporary one, removed at the end."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="opinionweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
        current = sc.getCheckpointDir()
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise reliably; later steps read the files, not the history."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: later steps read files, not the history."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in any store that Spark reads."""
    at, files = _files(spark, pattern)
    return [f.getPath().toString() for f in files.globStatus(at) or ()]


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    at, files = _files(spark, path)
    files.delete(at, True)
