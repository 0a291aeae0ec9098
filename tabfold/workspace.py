"""Where intermediate tables go.

Anything written between stages lands in the folder named by ``spark.checkpoint.dir``, which all
executors of a cluster can reach.  Only a local session may fall back to a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", "") or ""
    if configured:
        return configured.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="tabfold-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tabfold/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path nobody has written to yet, inside the shared folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def file_store(path: str) -> tuple[fs.FileSystem, str]:
    """For tasks that read or write files themselves: the file system of a path or address, and the path inside it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def drop_staged(spark: SparkSession) -> bool:
    """Delete what this application has staged; frames that still read it become useless."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(path) and files.delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once and go on from the written table.

    Cuts the lineage, so that a lost executor costs a read and not a rerun, and freezes values
    (row positions, model scores) that a second evaluation could give differently.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
