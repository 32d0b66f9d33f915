"""Tables in the folder that driver and executors share: what is read twice is computed once, and survives lost executors."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder on a local master (tests); on a cluster an error, as
    executors can't read the driver's own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cloakframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there and the session still lives."""
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended before: nothing to clean with
        pass


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Deletes tables that `written` gave and that nothing reads any more."""
    for df in tables:
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            remove(df.sparkSession, path)


def settled(spark: SparkSession) -> None:
    """Lets go of the shuffle files of queries that have ended: else they stay until the driver happens to collect its garbage."""
    for _ in range(2):  # the first lets go of what holds them, and they are deleted beside the program
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
