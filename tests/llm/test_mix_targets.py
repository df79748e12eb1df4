"""The pipeline's mix gives every source its target, however many words the corpus has."""

import math
from collections import Counter

import corpus_pipeline
from driftlake.llm import mixing

SIZES = {"a": [9000] * 40, "b": [1], "c": [2, 3, 4], "d": [700, 11], "e": [5000] * 9}


def test_small_sources_meet_their_targets(spark):
    texts = [(" ".join(f"w{i}" for i in range(n)), source) for source, sizes in SIZES.items() for n in sizes]
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(texts)], "doc_id long, text string, source string")
    target = {r[0]: r[1] for r in mixing.mix(docs).join(docs, "doc_id").select("source", "target").distinct().collect()}
    drawn, copies = Counter(), Counter()
    for i, text, source in corpus_pipeline.mix(spark, docs, "").select("doc_id", "text", "source").collect():
        drawn[source] += len(text.split())
        copies[i] += 1
    assert drawn == {s: math.ceil(t) for s, t in target.items()}
    assert max(copies.values()) <= mixing.MAX_EPOCHS
    assert (drawn["b"], drawn["c"], drawn["d"]) == (3, 27, 2133)
