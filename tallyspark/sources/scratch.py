"""The folder for tables written between jobs, which driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Each driver process writes into a folder of its own.
_OWN = uuid.uuid4().hex


def shared_folder(spark: SparkSession) -> str:
    """This driver's folder below spark.checkpoint.dir as the cluster names it.

    Only a session whose tasks all run in this process, as in tests, may leave it unset
    and gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tallyspark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/tallyspark-{_OWN}"


def new_folder(spark: SparkSession) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Removes one table that ``written`` wrote and nothing reads any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        remove(df.sparkSession, folder)


def clear(spark: SparkSession) -> None:
    """Removes all that this driver wrote here, once results that read it have been written or are no longer needed."""
    remove(spark, shared_folder(spark))
