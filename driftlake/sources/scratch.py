"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir.  Only a local session, whose executor is the driver, may lack it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='driftlake-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, files: int | None = None) -> DataFrame:
    """df, computed once and written as a table in the shared folder: later plans start from its files, and know their size.

    files: so many at most, where the caller knows that the rows are few for the session's partitions.  On a local folder Hadoop launches
    processes (chmod) for each file, out of the executor."""
    spark = df.sparkSession
    path = new_path(spark, "kept")
    (df.coalesce(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes what kept() wrote for these, when nothing reads it any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = file.rpartition("/")[0]
            if "/kept-" not in folder:
                raise ValueError(f"{folder} isn't a scratch table")
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
