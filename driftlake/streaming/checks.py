"""Streams of check events: the latest state of every key, folded as files arrive.

A stream writes the rows of the keys that a batch changed, as one folder a batch, so what it writes goes with what changed and not with
all keys.  The checkpoint lies beside the state in the caller's folder: a stream that stopped goes on where it was, and a
batch that runs twice gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    """Files as they come; `path` may hold a pattern."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest(events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Per key: how many events, and each value as the last event has it.  For tables and streams alike."""
    at = F.struct(*order)
    return events.groupBy(key).agg(F.count("*").alias("events"), *[F.max_by(v, at).alias(v) for v in values])


def fold(state: DataFrame, path: str, checkpoint: str) -> None:
    """Runs an aggregated stream over all that is there and writes the rows that each batch changed to path/batch=<number>."""

    def put(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={number}")

    state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def newest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The state: of every key the row of the last batch that changed it."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), "batch").alias("last")).select(key, "last.*")


def compact(spark: SparkSession, path: str, key: str, to: str) -> None:
    """The state as one table, for readers that come after many batches."""
    newest(spark, path, key).write.parquet(to)


def run_latest(spark: SparkSession, source: str, schema, folder: str, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The state after all files that are there.  Called again with the same folder it reads new files alone."""
    run = folder.rstrip("/")
    fold(latest(read_events(spark, source, schema), key, order, values), f"{run}/state", f"{run}/checkpoint")
    return newest(spark, f"{run}/state", key)


def pending(requests: DataFrame, verdicts: DataFrame, key: str = "id") -> DataFrame:
    """Requests that no verdict has answered yet."""
    return requests.join(verdicts.select(key).distinct(), key, "left_anti")
