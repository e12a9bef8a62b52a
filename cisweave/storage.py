"""Tables in the folder that all executors share, to cut lineage and to hand results over between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a folder of our own only where that is unset (local tests)."""
    at = spark.conf.get(SETTING, None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="cisweave-")
        spark.conf.set(SETTING, at)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cisweave/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all tables that materialise() left in the shared folder; results that still read them are lost."""
    remove(spark, f"{shared_dir(spark)}/cisweave")


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system and path object of a location."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)
