"""Where stages are cut: tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def bounded_batches(df: DataFrame, rows: int = 2_000) -> DataFrame:
    """df; in its session Arrow batches hold `rows` rows at most from now on, since texts make wide rows."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return df


_swept = [0.0]


def sweep(spark: SparkSession, every: float = 5.0) -> None:
    """Has the driver drop shuffle files that nothing refers to any more; Spark does so when its heap is collected, which by
    itself may be long after the disk is full."""
    if time.monotonic() - _swept[0] > every:
        gc.collect()
        spark._jvm.System.gc()
        _swept[0] = time.monotonic()


def staged(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again, so that its lineage ends there."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/millrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    sweep(spark)
    table = spark.read.schema(schema).parquet(path)
    table.staged_at = path
    return table


class Rounds:
    """A staged table that grows by whole rounds; its rows are one scan, however many rounds there are."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.schema = spark, [], None
        self.folder = f"{shared_folder(spark)}/millrace-{uuid.uuid4().hex}"

    def add(self, df: DataFrame) -> DataFrame:
        """Writes a round of rows, and gives them back as a table."""
        self.schema = self.schema or df.schema
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def rows(self) -> DataFrame:
        """All rounds so far."""
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def release(*tables: DataFrame) -> None:
    """Deletes the files of staged tables that nothing reads any more."""
    for table in tables:
        spark, path = table.sparkSession, table.staged_at
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
