"""On a session of many partitions, near-duplicate detection writes few files; the tokenizer's cache stays small and right."""

import os
import re

import public_tokenizers
import pytest
from driftlake.llm import near_dedup, sentencepiece_bpe
from driftlake.sources import scratch


@pytest.fixture
def many(spark):
    was = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_tables_have_few_files(spark, many, monkeypatch):
    paths, new = [], scratch.new_path
    monkeypatch.setattr(scratch, "new_path", lambda *a: paths.append(new(*a)) or paths[-1])
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(60)) + (" more" if i % 2 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(61)
    got = near_dedup.keep_one(docs).select("doc_id").collect()
    assert sorted(r[0] for r in got) == list(range(0, 400, 2))
    files = [sum(f.endswith(".parquet") for f in os.listdir(re.sub("^file:/*", "/", p))) for p in paths]
    assert paths and max(files) <= 2 * spark.sparkContext.defaultParallelism


def test_cache_is_bounded_and_right(monkeypatch):
    import pyarrow as pa
    import sentencepiece

    monkeypatch.setattr(sentencepiece_bpe, "CACHE", 50)
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, cache = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.Cache()
    for k in range(40):
        texts = [f"the word{k}a{j} of  漢퟿\x00 ▁ and {j % 7}" for j in range(5)]
        got = list(sentencepiece_bpe._encoded(pa.array(texts), path, cache))
        ids = [lib.encode(t) for t in texts]
        assert got == [(len(i), ",".join(map(str, i)), lib.decode(i)) for i in ids]
        assert len(cache.young) + len(cache.old) <= 200 and len(cache.odd) <= 200
