"""What the operators share in reading tables and in cutting lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftlake.sources.scratch import kept, new_path, shared_dir

__all__ = ["kept", "new_path", "parts", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
