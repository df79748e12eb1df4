"""The pipeline's stages on odd rows: nulls anywhere, empty and long texts, repeated ids, ties, columns that clash, empty tables."""

from collections import Counter

import corpus_pipeline
import pytest
from driftlake.llm import mixing, quality_rules
from pyspark.sql import functions as F

PROSE = " ".join(f"Word{i % 97} and{i} of{i * 7 % 31}" for i in range(60))
PASSAGE = " ".join(f"shared{i}" for i in range(45))
ROWS = [
    (None, None, None, None, None),
    (1, "", "en", "web", 0),
    (2, PROSE, "en", "web", 1),
    (2, PROSE, "en", "web", 1),
    (2, PROSE + " other end of it all", "en", "web", 1),
    (2, "x " + PASSAGE + " " + " ".join(f"own{i}" for i in range(60)), None, None, None),
    (None, "y " + PASSAGE + " " + " ".join(f"mine{i}" for i in range(60)), "de", None, 7),
    (None, "z " + PASSAGE + " " + " ".join(f"yours{i}" for i in range(60)), "de", "books", 7),
    (9, " ".join(f"long{i}" for i in range(30000)), "fr", "books", 9),
    (10, "#### " * 80, "en", "web", 3),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, vid long, _id long, size long, batch int, keys array<long>, o0 string, _words int, component long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, [5], "6", 7, 8) for r in ROWS], COLUMNS)


def test_stages_take_odd_rows(spark, docs, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0


def test_stages_take_no_rows(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_passages_go_from_rows_of_equal_and_null_ids(spark, docs):
    out = [r.text for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()]
    assert len(out) == len(ROWS) and not any(t and PASSAGE in t for t in out)


def test_mix_draws_rows_that_share_an_id(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(40)), "s"), (1, " ".join(f"b{i}" for i in range(40)), "s"), (None, " ".join(f"c{i}" for i in range(40)), "s"), (2, "one two", None)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    first = Counter(r.text.split()[0] for r in out)
    assert {"a0", "b0", "c0"} <= set(first)


def test_later_rules_are_not_evaluated(spark):
    broken = quality_rules.Rule("broken", F.raise_error(F.lit("evaluated")).cast("boolean"))
    every = quality_rules.Rule("every", F.lit(True))
    df = spark.createDataFrame([(1, "x")], "id long, text string")
    assert df.select(quality_rules.verdict([every, broken]).alias("v")).first().v == "every"
    with pytest.raises(Exception, match="evaluated"):
        df.select(quality_rules.verdict([broken, every]).alias("v")).collect()


def test_the_order_follows_rejections_and_cost(spark):
    df = spark.createDataFrame([(i, "a b c " * 200) for i in range(400)], "id long, text string")
    costly = quality_rules.Rule("costly", F.size(F.filter(quality_rules.words(F.col("text")), lambda w: w.rlike("(x+x+)+y"))) >= 0)
    cheap = quality_rules.Rule("cheap", F.col("id") >= 0)
    never = quality_rules.Rule("never", F.size(F.filter(quality_rules.words(F.col("text")), lambda w: w.rlike("(x+x+)+y"))) < 0)
    order = [r.name for r in quality_rules.planned(df, [never, costly, cheap])]
    assert order.index("cheap") < order.index("costly") < order.index("never")
