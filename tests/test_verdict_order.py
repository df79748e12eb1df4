"""A mean of confidences at the limit of a rule: 0.7 + 0.5 + 0.9 is 2.1, 0.9 + 0.7 + 0.5 a little less."""

from driftlake.operators import verdicts


def test_confidences_are_added_in_the_order_of_regions(spark):
    pairs = spark.createDataFrame([("a", "pixel-diff", 40.0)], "frame string, reason string, diff_percentage double")
    sure = {1: 0.7, 2: 0.5, 3: 0.9}
    got = set()
    for order in ((1, 2, 3), (3, 1, 2), (2, 3, 1), (3, 2, 1)):
        rows = [("a", n, "color-change", 10, "top", sure[n]) for n in order]
        df = spark.createDataFrame(rows, "frame string, region int, change_type string, pixels long, position string, confidence double").coalesce(1)
        got |= {(r.label, r.mean_confidence) for r in verdicts.verdicts(pairs, df).collect()}
    assert got == {("intentional-likely", (0.7 + 0.5 + 0.9) / 3)}
