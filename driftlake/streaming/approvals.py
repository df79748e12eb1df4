"""Requests that wait, in a stream's state, for the verdict that answers them.

Events (key, kind, at, order columns) come as files.  A key holds one open request: a newer one takes its place, a verdict after it answers it,
and a verdict without an open request before it is ignored.  What is open lies in the checkpoint, so a stream that stops between
request and verdict goes on when the verdict comes.

Defined cases: rows of other kinds, and those without a key, are ignored; events of one key and batch are taken in the order of (at, number), which
repeated rows share without harm; events of an earlier batch count as earlier.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

REQUEST, VERDICT = "request", "verdict"
OUT = "key string, request long, outcome string, answer long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Approvals(StatefulProcessor):
    """Rows (key, request, outcome, answer): a request that was answered, with the number of its verdict, or superseded, with that of the newer request."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "number long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        waiting = int(self.open.get()[0]) if self.open.exists() else None
        out = []
        events = pd.concat(list(rows)).sort_values(["at", "number"], kind="stable")
        for kind, number in zip(events["kind"], events["number"]):
            number = int(number)
            if waiting is not None and number != waiting:
                out.append((key[0], waiting, "answered" if kind == VERDICT else "superseded", number))
                waiting = None
            if kind == REQUEST:
                waiting = number
        if waiting is None:
            self.open.clear()
        else:
            self.open.update((waiting,))
        yield pd.DataFrame(out, columns=["key", "request", "outcome", "answer"])

    def close(self) -> None:
        pass


def outcomes(events: DataFrame) -> DataFrame:
    """The outcomes of a stream of (key, kind, at, number)."""
    wanted = events.filter(F.col("key").isNotNull() & F.col("kind").isin(REQUEST, VERDICT)).select(F.col("key").cast("string").alias("key"), "kind", "at", F.col("number").cast("long").alias("number"))
    return wanted.groupBy("key").transformWithStateInPandas(Approvals(), OUT, outputMode="Append", timeMode="None")


def run(spark: SparkSession, events: DataFrame, folder: str) -> DataFrame:
    """Everything decided so far: runs the stream over what is there, from where the last run with this folder stopped.  A batch that runs twice writes the
    same folder."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    folder = folder.rstrip("/")

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/outcomes/batch={number}")

    try:
        outcomes(events).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    return spark.read.parquet(f"{folder}/outcomes").drop("batch")
