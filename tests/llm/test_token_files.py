import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
from driftlake.llm import simple8b, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_any_integers_come_back():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 59, 60, 61, 511, 512, 513, 1024, 5000):
        for top in (0, 1, 9, 300, 50000, 1 << 40, (1 << 60) - 1, 1 << 60, (1 << 64) - 1):
            v = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
            v[rng.integers(0, max(n, 1), n // 7)] = rng.integers(0, (1 << 64) - 1, n // 7, dtype=np.uint64)
            words, per_block = simple8b.encode(v)
            assert (simple8b.decode(words, per_block, n) == v).all() and per_block.sum() == len(words)
            some = len(per_block) // 2  # a reader may begin at any block
            at = int(per_block[:some].sum())
            assert (simple8b.decode(words[at:], per_block[some:], n - some * simple8b.BLOCK) == v[some * simple8b.BLOCK :]).all()


def test_words_take_as_many_as_fit():
    assert [len(simple8b.encode(np.full(60, (1 << w) - 1, np.uint64))[0]) for w in (1, 2, 3, 15, 16, 20, 60)] == [1, 2, 3, 15, 20, 20, 60]
    assert len(simple8b.encode(np.full(3, 1 << 60, np.uint64))[0]) == 6


def texts():
    rng = random.Random(5)
    yield from ["", " ", "Hello, World!!", "don't 'STOP' they'RE it'd,' x'", "<|endoftext|> <|ENDOFTEXT|>,a<|startoftext|>b", "\x1c\x85a b c\x0b\x0cd", "É́ é, ẞ İ ı", "𝄞é‍漢字かな٣", "a\x00b", "x" * 700, "1234,5.6", "...!?,;:", "A.B.C.,", "Größe%%% ÀÉ×÷ß ÿ$$$ Ĳ ſ µª º ABC<|endoftext|> abc<| abc|> x~^_` ÅÅ ÅA"]
    for alphabet in ("ab ,.", "'sStTdDrReE ll", "<|endoftext|> ", "éÈç ́ ß.", "0123456789., ab", "漢字 かなカナ,"):
        for _ in range(60):
            yield "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
    for _ in range(60):
        yield "".join(chr(rng.choice([rng.randint(1, 0x7F), rng.randint(0x80, 0x7FF), rng.randint(0x800, 0xD7FF), rng.randint(0x10000, 0x10FFFF)])) for _ in range(40))


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.mark.parametrize("remembered", [1, 800_000])
def test_ids_equal_the_library(library, monkeypatch, remembered):
    monkeypatch.setattr(token_files, "REMEMBERED", remembered)
    mine, all_texts = token_files.Encoder(PATH), list(texts())
    for i in range(0, len(all_texts), 50):
        some = all_texts[i : i + 50]
        ids, n = mine.encode(pa.array([*some, None]))
        at = 0
        for t, k in zip([*some, ""], n.tolist()):
            assert ids[at : at + k].tolist() == [*library.encode(t, add_special_tokens=False).ids, token_files.END], repr(t)
            at += k


def test_files_come_back(spark, library, monkeypatch):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts(), 3)] + [(2, None, "x", 1), (None, "no id", None, None), (None, "no id", None, None), (7, "again", "y", 2), (10**12, "word " * 30000, "y", 2)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, start int")
    for chunk in (simple8b.BLOCK, token_files.CHUNK):
        monkeypatch.setattr(token_files, "CHUNK", chunk)
        got = sorted(token_files.round_trip(df, PATH).collect(), key=lambda r: r["start"])
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
        want = {}
        for i, t, *_ in rows:
            raw = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
            want.setdefault(i, []).append((len(raw) // 4, zlib.crc32(raw)))
        before, found = 0, {}
        for r in got:
            assert r["start"] == before and bytes(r["ids"])[-4:] == b"\x02\0\0\0"
            before += r["n_tokens"]
            found.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
        assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert token_files.round_trip(df.limit(0), PATH).collect() == []
