"""Session helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: set = set()


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Enough for one machine and for shared file systems; elsewhere the package is installed or sent
    with --py-files, and this changes nothing.
    """
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where that setting is absent and all runs in one process a temporary folder is made and
    set; elsewhere its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()  # what later calls see
    return re.sub("^file:/(?!/)", "file:///", base).rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(path, its file system) as Hadoop objects."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return fs.exists(p)


def removed(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)


def work_folder(spark: SparkSession) -> str:
    """This application's folder for tables between steps, in the shared one; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/folioforge-work-{spark.sparkContext.applicationId}"
    if path not in _OWN:
        p, fs = hadoop_path(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _OWN.add(path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the work folder and read again: several readers run it once."""
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folioforge_kept = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``kept`` that nothing reads any more."""
    for df in tables:
        removed(df.sparkSession, df._folioforge_kept)
