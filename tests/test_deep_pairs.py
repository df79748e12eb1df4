"""Documents that stand beside each other in a row: as in two tables, and read once."""

from driftlake.operators import structdiff
from driftlake.plans import records

SF = "/root/testdata/sf0.001"
CASES = [
    ('{"a":1,"b":[1,2]}', '{"b":[1,2], "a":1.0}'),
    ("[]", " [ ]"),
    ("{}", "{ }"),
    (" [1]", '{"a":1}'),
    (None, "null"),
    (None, "[1]"),
    ('{"a":{"b":{"c":[{"d":1}]}}}', '\n{"a":{"b":{"c":[{"d":2},null]}}}'),
    ('"x"', "1"),
    ("1", "1.0"),
]


def told(df):
    return sorted((r.key, r.type, str(r.path), r.value, r.old_value) for r in df.collect())


def test_rows_and_tables_agree(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(CASES)]
    pairs = spark.createDataFrame(rows, "key long, old string, new string")
    got = told(structdiff.deep_diff_pairs(pairs))
    assert got == told(structdiff.deep_diff(pairs.selectExpr("key", "old AS doc"), pairs.selectExpr("key", "new AS doc")))
    assert [(k, t, v, o) for k, t, _, v, o in got] == [(3, 2, '{"a":1}', "[1]"), (5, 2, "[1]", "null"), (6, 0, "null", None), (6, 2, "2", "1"), (7, 2, "1", '"x"')]


def test_documents_are_made_once(spark, monkeypatch):
    seen = []
    keep = structdiff.kept
    monkeypatch.setattr(structdiff, "kept", lambda df: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), keep(df))[1])
    records.object_diff_deep(spark, SF)
    assert len(seen) <= 3 and seen[0].count("collect_list") <= 2
