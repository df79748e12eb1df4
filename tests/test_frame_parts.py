"""Frames are dealt into as many parts as their number asks for, so a task's pixels don't grow with the table."""

from driftlake.sources import frames
from pyspark.sql import functions as F


def test_parts_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(frames, "TASK_TILES", 50, raising=False)
    made = frames.frame_pairs(spark, "/root/testdata/sf0.001")  # 500 embeddings
    made.agg(F.count("*")).collect()
    assert made.rdd.getNumPartitions() == 10
