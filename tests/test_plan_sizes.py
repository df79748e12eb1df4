"""Plans stay small: what several steps read is a table, and isn't worked out again in each of them."""

from driftlake.operators import interpreting
from driftlake.plans import registry

SF = "/root/testdata/sf0.001"


def test_interpreting_reads_pixels_from_a_table(spark, monkeypatch):
    seen = []
    keep = interpreting.kept

    def counted(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString().count("embeddings.parquet"))
        return keep(df)

    monkeypatch.setattr(interpreting, "kept", counted)
    registry.QUERIES["interpreted_moves"](spark, SF)
    assert max(seen) <= 4, seen
