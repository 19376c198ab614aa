"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_dir() -> str:
    """One folder for this process, for sessions without executors elsewhere."""
    path = tempfile.mkdtemp(prefix="spark-tables-")
    atexit.register(shutil.rmtree, path, True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.

    Where the session names none: a temporary folder in local mode, whose
    tasks all run on this machine, else a folder beside the warehouse, if that
    is in a store that all machines share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _local_dir()
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith("file:") or ":" not in warehouse:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share: the warehouse is a local folder of each machine")
    return warehouse + "/checkpoints"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so that an executor lost later costs a re-read of these
    files and not the whole computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of :func:`durable` tables that nothing reads any more.

    Call it when what was made of them has been written: a loop then holds
    its newest tables only.
    """
    for df in tables:
        path = df.__dict__.get("_durable_path")
        if path is not None:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
