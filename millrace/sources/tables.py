"""Tables in the folder that driver and executors share: cuts of lineage, and results that outlive a query."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where none is set and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame, path: str | None = None, options: dict | None = None) -> DataFrame:
    """Writes df as a Parquet table, with options of the writer, and reads it again: it is computed once, and Spark knows the size of what follows."""
    spark, schema = df.sparkSession, df.schema
    path = path or f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(schema).parquet(path)


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written whole at a path."""
    at, files = _path(spark, f"{path}/_SUCCESS")
    return files.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at, files = _path(spark, path)
    files.delete(at, True)


def kept_path(spark: SparkSession, name: str, of: str) -> str:
    """Where the table `name` of an input folder is kept for all of the application."""
    key = hashlib.sha256(f"{spark.sparkContext.applicationId}|{of}|{name}".encode()).hexdigest()[:24]
    return f"{shared_folder(spark)}/kept-{key}"


def kept(spark: SparkSession, name: str, of: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` of an input folder: built at the first call, read again by all later ones of the same application."""
    path = kept_path(spark, name, of)
    if not exists(spark, path):
        remove(spark, path)
        return staged(build(), path)
    return spark.read.parquet(path)
