"""Tiles are put together in a stream, without a group of its own for each in Python."""

from driftlake.operators import tiles
from test_tiles import bands


def test_no_group_for_each_tile(spark):
    plan = tiles.cut(bands(spark), lambda w, h: (1, 2), 16)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and plan.count("MapInArrow") == 2


def test_tiles_that_are_measured_twice_are_cut_once(spark, monkeypatch):
    seen, keep = [], getattr(tiles, "kept", None)
    monkeypatch.setattr(tiles, "kept", lambda df: seen.append(df.columns) or keep(df), raising=False)
    tiles.perceptual_ssim(bands(spark), tiles.Perceptual((0.3, 0.7), deviation_weight=1.0), size=16)
    assert len(seen) == 1 and {"x0", "one", "two"} <= set(seen[0])
