import hashlib
from collections import Counter

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
import sentencepiece
import test_near_dedup
import test_substring_dedup
from driftlake.llm import mixing, quality_rules

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input of every stage, and the result of the last, as pandas frames."""
    docs, frames = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        frames.append(docs.toPandas())
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*frames, docs.toPandas()]


def test_columns_stay(stages):
    assert all(list(f.columns) == ["doc_id", "text", "lang", "source", "n_chars"] for f in stages[:-1])


def rows(frame):
    return sorted(map(tuple, frame.itertuples(index=False)))


def test_quality(stages):
    documents = stages[0]  # noqa: F841  DuckDB reads it by name
    kept = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM ({quality_rules.QUERY_SQL}) WHERE kept").fetchall()}
    assert rows(stages[1]) == rows(stages[0][stages[0].doc_id.isin(kept)])


def test_near_duplicates(stages):
    d = stages[1]
    kept = {r[0] for r in test_near_dedup.brute(list(zip(d.doc_id.tolist(), d.text))) if r[3]}
    assert rows(stages[2]) == rows(d[d.doc_id.isin(kept)])


def test_repeated_passages(stages):
    d = stages[2]
    want = {r[0]: r[4] for r in test_substring_dedup.brute(list(zip(d.doc_id.tolist(), d.text)))}
    assert dict(zip(stages[3].doc_id, stages[3].text)) == want
    assert stages[3].n_chars.tolist() == stages[3].text.str.len().tolist()


def test_mix(stages):
    documents = stages[3]  # noqa: F841
    want = {r[0]: r[1] for r in duckdb.sql(f"SELECT doc_id, taken FROM ({mixing.QUERY_SQL}) WHERE taken > 0").fetchall()}
    got, text = Counter(), dict(zip(documents.doc_id, documents.text))
    for r in stages[4].itertuples():
        got[r.doc_id] += len(r.text.split())
        assert text[r.doc_id].split()[: len(r.text.split())] == r.text.split()
    assert dict(got) == want


def test_tokens(stages):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for r in stages[4].itertuples():
        ids = sp.encode(r.text)
        want[r.doc_id, r.source, r.lang, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert Counter(map(tuple, stages[5][["doc_id", "source", "lang", "n_tokens", "ids_sha256", "decoded_sha256"]].itertuples(index=False))) == want


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages[5])
