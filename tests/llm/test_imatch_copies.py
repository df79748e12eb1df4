"""I-Match where copies or near copies make up a third of all rows."""

from driftlake.llm import imatch


def rows(shared):
    """A third of the rows from `shared`, the others each of words of their own and of a few that ten rows have."""
    own = [" ".join([f"own{i}x{j}" for j in range(30)] + [f"ten{i // 10}x{j}" for j in range(30)]) for i in range(80)]
    return [*own, *shared]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_copies_count_once(spark):
    copy = " ".join(f"copied{j}" for j in range(20))
    docs = frame(spark, [*rows([copy] * 40), copy + " and more"])
    hashed = spark.createDataFrame([("copied3",), ("ten2x4",), ("own5x5",)], "t string").selectExpr("t", "xxhash64(t) AS term")
    assert {r.t for r in hashed.join(imatch.lexicon(docs), "term").collect()} == {"copied3", "ten2x4"}


def test_near_copies_are_found(spark):
    near = [" ".join([f"base{j}" for j in range(90)] + [f"last{i}"]) for i in range(40)]
    got = {r.doc_id: r for r in imatch.fingerprints(frame(spark, rows(near))).collect()}
    assert min(got[i].near_edited for i in range(81, 120)) > 0.3 and min(got[i].near_next for i in range(81, 120)) > 0.5
    assert got[80].near_next < 0.2  # followed by a row of other words
    assert max(got[i].near_next for i in range(80) if i % 10 == 0) < 0.2
