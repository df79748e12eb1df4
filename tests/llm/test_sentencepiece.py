import random

import public_tokenizers
import pytest
import sentencepiece
from driftlake.llm.sentencepiece_bpe import Bpe, encode_decode

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return Bpe(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(5)
    yield from ["", " ", "  ", "a", " a", "a ", "\n", "\n\n a\t\t b\r\n", "▁", "x▁y", "\x00z", "aaaaaaaaaaaaaaaaaaaaa", "abababababab" * 9, "=" * 700, " " * 99, "𝄞é‍漢字かな", "hello world" * 50, "<s> </s> <unk> <0x0A>"]
    for alphabet in ("ab ", "etaoin shrdlu\n", "=-# \t", "éèçñß ue", "0123456789., ", "漢字 かなカナ", "aeioust "):
        for n in (1, 5, 30, 300):
            for _ in range(40):
                yield "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
    for _ in range(60):
        yield "".join(chr(rng.choice([rng.randint(1, 0x7F), rng.randint(0x80, 0x7FF), rng.randint(0x800, 0xD7FF), rng.randint(0x10000, 0x10FFFF)])) for _ in range(40))


def test_ids_and_texts_equal_the_library(both):
    mine, lib = both
    all_texts = list(texts())
    got = mine.encode(all_texts)
    for t, ids in zip(all_texts, got):
        want = lib.encode(t)
        assert ids == want, repr(t)
        assert mine.decode(ids) == lib.decode(want), repr(t)


def test_decode_of_any_ids(both):
    mine, lib = both
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.choice([rng.randint(3, 258), rng.randint(0, 31999)]) for _ in range(rng.randint(0, 12))]
        assert mine.decode(ids) == lib.decode(ids), ids


def test_frame(spark, both):
    import hashlib

    _, lib = both
    rows = [(1, "Hello  world\n", "x"), (2, None, "y"), (2, "", "y"), (3, "b" * 3000 + " c", None), (None, "same", "z"), (None, "same", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = encode_decode(df, PATH).collect()
    want = []
    for i, t, _ in rows:
        ids = lib.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert encode_decode(df.limit(0), PATH).count() == 0
    full = encode_decode(df, PATH, ids=True, others=["n_tokens"]).filter("doc_id = 1").collect()[0]
    assert full["decoded"] == "Hello  world\n" and full["ids"] == lib.encode("Hello  world\n")
