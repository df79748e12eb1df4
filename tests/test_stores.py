"""Versions of baselines, and requests that wait in a stream's state."""

import datetime as dt

import pytest
from driftlake.sources.baselines import Baselines, Conflict
from driftlake.streaming import approvals
from pyspark.sql import functions as F



def same():
    return F.col("digest") == F.col("old_digest")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_versions(spark, tmp_path):
    store = Baselines(spark, f"file://{tmp_path}/b")
    frame = lambda *r: spark.createDataFrame(list(r), "id int, digest string")
    with pytest.raises(ValueError, match="no version yet"):
        store.read()
    version, states = store.promote(frame((1, "a"), (2, "b")), same())
    assert version == 1 and rows(states) == [(1, "added"), (2, "added")]
    version, states = store.promote(frame((2, "x"), (3, "c")), same())
    assert version == 2 and rows(states) == [(2, "failed"), (3, "added")] and rows(store.read()) == [(1, "a"), (2, "b"), (3, "c")]
    version, states = store.promote(frame((2, "x")), same(), "all")
    assert rows(states) == [(2, "updated")] and rows(store.read()) == [(1, "a"), (2, "x"), (3, "c")]
    decisions = spark.createDataFrame([(1, "approved"), (3, "rejected")], "id int, decision string")
    assert store.decide(frame((1, "z"), (2, "z"), (3, "z")), decisions) == 4
    assert rows(store.read()) == [(1, "z"), (2, "x"), (3, "c")] and rows(store.read(1)) == [(1, "a"), (2, "b")] and store.versions() == [1, 2, 3, 4]
    with pytest.raises(ValueError, match="no version 9"):
        store.read(9)
    with pytest.raises(ValueError, match="repeat"):
        store.commit(frame((1, "a"), (1, "b")), 4)
    assert store.versions() == [1, 2, 3, 4]


def test_a_crash_and_a_second_writer(spark, tmp_path):
    store, other = (Baselines(spark, f"file://{tmp_path}/b") for _ in range(2))
    frame = lambda *r: spark.createDataFrame(list(r), "id int, digest string")
    store.commit(frame((1, "a")), 0)
    data = store.write(frame((1, "lost")))  # the writer stops here
    assert rows(store.read()) == [(1, "a")] and store.versions() == [1]
    assert other.commit(frame((1, "b")), 1) == 2
    with pytest.raises(Conflict, match="newer than 1"):
        store.publish(data, 1)
    store.versions = lambda: [1]  # as seen just before the other writer was done
    with pytest.raises(Conflict, match="another writer"):
        store.publish(data, 1)
    assert rows(other.read()) == [(1, "b")]


def test_requests_outlive_the_stream(spark, tmp_path):
    at = lambda n: dt.datetime(2026, 1, 1, 0, n)
    schema = "key string, kind string, at timestamp, number long"
    source, folder = f"{tmp_path}/in", f"{tmp_path}/run"

    def go(*events):
        spark.createDataFrame(list(events), schema).coalesce(1).write.mode("append").parquet(source)
        return rows(approvals.run(spark, spark.readStream.schema(schema).parquet(source), folder))

    first = go(("a", "request", at(1), 1), ("b", "verdict", at(2), 2), ("b", "request", at(3), 3), ("c", "request", at(4), 4), ("c", "verdict", at(5), 5), (None, "request", at(5), 6), ("a", "other", at(6), 7))
    assert first == [("c", 4, "answered", 5)]
    second = go(("a", "request", at(9), 9), ("b", "verdict", at(1), 10), ("d", "verdict", at(1), 11))  # in a later file, whatever it says of the time
    assert second == [("a", 1, "superseded", 9), ("b", 3, "answered", 10), ("c", 4, "answered", 5)]
    third = go(("a", "verdict", at(12), 12), ("a", "verdict", at(13), 13), ("b", "verdict", at(13), 14))
    assert third == sorted([*second, ("a", 9, "answered", 12)])
