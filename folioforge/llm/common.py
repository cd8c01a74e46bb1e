"""Shared folder, written tables and small column helpers for the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reachable


_OWN: set = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where that setting is absent and all runs in one process (tests) a temporary folder is
    made and set; elsewhere its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches: rows hold whole texts, so the default of 10,000 rows is no bound on memory.

    Plans read these settings when they run, so they stay; a session that has its own keeps them.
    """
    reachable(spark)
    own = spark.conf.getAll
    for key, value in (("maxRecordsPerBatch", 500), ("maxBytesPerBatch", 8 << 20)):
        if f"spark.sql.execution.arrow.{key}" not in own:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


def fresh(name: str, taken: list) -> str:
    """``name``, with as many leading underscores as make it a column that ``taken`` does not have."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def column(name: str):
    """The column of exactly this name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def released() -> None:
    """Give memory that Python has freed back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(f):
    """The Arrow stage ``f``, whose worker gives its memory back when a task ends.

    Workers wait for the next task with all that the last one had freed; on an executor with a
    small allowance that adds up.
    """

    def run(batches):
        try:
            yield from f(batches)
        finally:
            released()

    return run


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/folioforge-{spark.sparkContext.applicationId}"
    if path not in _OWN:
        p, fs = _file_system(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _OWN.add(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folioforge_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._folioforge_path)


def clear_written(spark: SparkSession) -> None:
    """Delete all that ``written`` has made for this application; results not yet read are lost."""
    _delete(spark, own_dir(spark))


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _file_system(spark, path)
    fs.delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
