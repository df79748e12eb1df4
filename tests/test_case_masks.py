"""Regions meet their masks without one task taking all that name none, or all that name the same."""

from driftlake.sources import cases


def test_masks_are_dealt_out(spark, monkeypatch):
    rows = [(n, 0, None if n % 5 else f"m{n % 3}") for n in range(4000)]
    each = spark.createDataFrame(rows, "case long, nth int, mask_path string")
    masks = spark.createDataFrame([("m0", 1), ("m1", 2), (None, 9), ("other", 3)], "mask_path string, _mask int")
    want = [(n, {"m0": 1, "m1": 2}.get(m)) for n, _, m in rows]
    got = cases._with_masks(each, masks)
    assert sorted((r["case"], r["_mask"]) for r in got.collect()) == want and "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(cases, "MASKS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = cases._with_masks(each, masks)
        assert sorted(got.columns) == ["_mask", "case", "mask_path", "nth"]
        assert sorted((r["case"], r["_mask"]) for r in got.collect()) == want
        sizes = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert max(sizes) < 2000  # of 4000, 3200 of which name no mask
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
