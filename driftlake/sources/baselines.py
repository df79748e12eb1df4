"""A table of baselines in versions that writers can't spoil for readers, or for each other.

A version's rows lie in a folder of their own.  It comes about when the file of its number is created beside them, which fails if the file is there:
until then nobody sees it, and of two writers who start from one version the second is refused.  What a writer left who
broke off before that is never read.  Readers name a version or take the newest; a version never changes.

Defined cases: a store without versions has no rows to read, and the first commit starts from version 0; rows that repeat an id are an
error of the commit; a commit without changes makes a version, too.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.operators import verdicts


class Conflict(RuntimeError):
    """Another writer has committed since."""


class Baselines:
    """Baselines (key, and other columns) under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "id"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("versions").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}")

    def versions(self) -> list[int]:
        folder = self._path("versions")
        if not self._fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit())

    def _entry(self, version: int) -> dict:
        with_ = self._fs.open(self._path(f"versions/{version:010d}"))
        try:
            return json.loads(bytes(with_.readAllBytes()).decode())
        finally:
            with_.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, or of the newest."""
        there = self.versions()
        if not there or (version is not None and version not in there):
            raise ValueError(f"there is no version {version}" if there else "there is no version yet")
        return self.spark.read.parquet(f"{self.folder}/{self._entry(there[-1] if version is None else version)['data']}")

    def write(self, rows: DataFrame) -> str:
        """Writes a version's rows to a folder that nobody reads yet."""
        data = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{data}")
        if not self.spark.read.parquet(f"{self.folder}/{data}").groupBy(self.key).count().filter("count > 1").isEmpty():
            raise ValueError(f"rows repeat their {self.key}")
        return data

    def publish(self, data: str, base: int) -> int:
        """Makes what write() wrote the version after `base`."""
        there = self.versions()
        if (there[-1] if there else 0) != base:
            raise Conflict(f"version {there[-1] if there else 0} is newer than {base}")
        try:
            out = self._fs.create(self._path(f"versions/{base + 1:010d}"), False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise Conflict(f"version {base + 1} was committed by another writer") from e
            raise
        out.write(bytearray(json.dumps({"data": data, "base": base}).encode()))
        out.close()
        return base + 1

    def commit(self, rows: DataFrame, base: int) -> int:
        return self.publish(self.write(rows), base)

    def promote(self, received: DataFrame, same, mode: str = "new") -> tuple[int, DataFrame]:
        """(the new version, (key, status) of what was received): takes over what snapshot_states adds and updates.  `same` compares columns of the
        received rows with those of the baseline, which are named old_<column>."""
        base, before = self._newest(received)
        old = before.select(self.key, *[F.col(c).alias(f"old_{c}") for c in before.columns if c != self.key])
        states = verdicts.snapshot_states(old, received, same, mode, self.key)
        return self.commit(verdicts.promoted(before, received, states, self.key), base), states

    def decide(self, received: DataFrame, decisions: DataFrame) -> int:
        """Takes over the received rows whose decision (key, decision) is 'approved'; rejected ones and those without a decision leave the baseline as it is."""
        base, before = self._newest(received)
        yes = received.join(decisions.filter("decision = 'approved'").select(self.key).distinct(), self.key, "left_semi").select(*before.columns)
        return self.commit(before.join(yes.select(self.key), self.key, "left_anti").unionByName(yes), base)

    def _newest(self, like: DataFrame) -> tuple[int, DataFrame]:
        there = self.versions()
        return (there[-1], self.read(there[-1])) if there else (0, like.limit(0))
