"""The memory of a task that ranks and correlates doesn't grow with the rows."""

from driftlake.operators import evaluation


def _sorted_rows(spark, monkeypatch, n):
    """The most ranges, and whether any plan sorts or joins all rows by value."""
    plans, ranges = [], []
    keep, of = evaluation.kept, evaluation._ranges

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(evaluation, "kept", seen)
    monkeypatch.setattr(evaluation, "_ranges", lambda k: ranges.append(of(k)) or ranges[-1])
    df = spark.range(n).selectExpr("'g' AS g", "double(id * 7919 % 10007) + id / 1e6 AS x", "double(id * 104729 % 10009) + id / 1e6 AS y")
    row = evaluation.correlations(df, "x", "y", "g").first()
    plans.append(evaluation.correlations(df, "x", "y", "g")._jdf.queryExecution().executedPlan().toString())
    assert row["n"] == n
    return max(ranges), [line for p in plans for line in p.splitlines() if "SortMergeJoin" in line and any(v in line for v in ("a#", "b#"))]


def test_ranges_grow_and_no_join_is_by_value(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "BLOCK", 500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        assert _sorted_rows(spark, monkeypatch, 20_000) == (40, [])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
