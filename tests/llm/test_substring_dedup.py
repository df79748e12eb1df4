import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from driftlake.llm import batches, eliasfano, substring_dedup
from hypothesis import given, settings
from hypothesis import strategies as st


def brute(rows, k=35):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + k]) for w in docs for i in range(len(w) - k + 1))
    out = []
    for (d, text), w in zip(rows, docs):
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone |= set(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if gone else text or ""))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(batches, "BATCH_BYTES", 3000)
    monkeypatch.setattr(batches, "SHARD_CHARS", 9000)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abé漢") for _ in range(rng.randint(1, 5)))
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 60, 200)]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "w " * 40), (4, "v " * 35), (5, "u " * 36), (None, "x"), (6, "a" * 20000)]
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, 3)
            at = rng.randint(0, len(w))
            w[at:at] = p[a : len(p) - rng.randint(0, 3)]
        rows.append((10 + i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(80, rows[40][1]), (80, rows[40][1]), (81, " ".join(passages[3] + passages[4] + passages[3]))]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, batch int").repartition(5)
    got = substring_dedup.dedup(df, texts=True).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert substring_dedup.dedup(df.limit(0)).count() == 0


def test_texts_are_shuffled_once(spark):
    df = spark.range(100).selectExpr("id doc_id", "cast(id as string) text")
    out = substring_dedup.dedup(df)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1)), st.integers(0, 60))
def test_elias_fano_round_trip(values, shift):
    v = np.sort(np.array([x >> shift for x in values], np.uint64))
    raw = eliasfano.encode(v)
    back, used = eliasfano.decode(raw + b"tail")
    assert back.tolist() == v.tolist() and used == len(raw)


def passages_corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 4)))
    shared = [[word() for _ in range(n)] for n in (36, 50, 120)]
    rows = []
    for i in range(50):
        w = [word() for _ in range(rng.randint(5, 60))]
        p = shared[i % 3]
        at = rng.randint(0, len(w))
        rows.append((i, " ".join(w[:at] + p[rng.randint(0, 1) :] + (shared[(i + 1) % 3] if i % 4 == 0 else []) + w[at:])))
    return [*rows, (50, " ".join(shared[2] + ["z"] + shared[2])), (51, None)]


def test_factors_are_copies_of_their_sources(spark, monkeypatch):
    monkeypatch.setattr(batches, "BATCH_BYTES", 1500)
    monkeypatch.setattr(batches, "SHARD_CHARS", 2000)
    rows = passages_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in substring_dedup.dedup(df, factors=True).collect()}
    texts = {d: (t or "").split() for d, t in rows}
    blocks = {}
    for d, r in got.items():
        for i, x in enumerate(texts[d]):
            blocks[r.block, r.block_word + i] = (d, x)
    assert len({b for b, _ in blocks}) > 3
    n = 0
    for d, r in got.items():
        gone = set()
        for f in r.factors:
            own = texts[d][f.start : f.start + f.length]
            source = [blocks[f.source_block, f.source_word + i] for i in range(f.length)]
            assert f.length >= 35 and own == [x for _, x in source] and (f.source_block, f.source_word) != (r.block, r.block_word + f.start)
            assert len({x for x, _ in source}) == 1  # a source lies in one document
            gone |= set(range(f.start, f.start + f.length))
            n += 1
        assert r.n_removed == len(gone)
    assert n > 50


def test_messages_go_through_post_offices(spark, monkeypatch):
    monkeypatch.setattr(batches, "BATCH_BYTES", 1500)
    monkeypatch.setattr(batches, "SHARD_CHARS", 1000)
    monkeypatch.setattr(batches, "FAN", 4)
    monkeypatch.setattr(batches, "BUNDLE", 3)
    rows = passages_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert batches.shards_for(df, "text") > 8
    got = substring_dedup.dedup(df, texts=True).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_no_batch_sends_more_messages_than_its_fan(spark):
    hashes = np.sort(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))
    for shards in (1, 7, 4096, 100_000):
        found = batches.runs(hashes, shards)
        assert [b - a for _, a, b in found] and sum(b - a for _, a, b in found) == len(hashes)
        width = -(-shards // batches.FAN)
        assert len({s // width for s, _, _ in found}) <= batches.FAN


def test_regular_texts_are_told_apart(spark):
    signs = ["".join("ab"[bin(i).count("1") % 2] for i in range(64)), "".join("ba"[bin(i).count("1") % 2] for i in range(64))]
    rows = [(i, " ".join(s)) for i, s in enumerate(signs)] + [(2 + i, " ".join([s * 16] * 20)) for i, s in enumerate(signs)]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), texts=True).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1), st.integers(0, 63), st.lists(st.integers(0, 2**64 - 1)))
def test_elias_fano_is_searched_in_place(values, shift, others):
    v = np.sort(np.array([x >> shift for x in values], np.uint64))
    s = eliasfano.Sequence(memoryview(eliasfano.encode(v)))
    assert len(s) == len(v) and s[np.arange(len(v))].tolist() == v.tolist()
    asked = np.concatenate((v, np.array([x >> shift for x in others], np.uint64)))
    at = s.search(asked, np.zeros(len(asked), np.int64), np.full(len(asked), len(v)))
    assert [(-1 if i < 0 else int(v[i])) for i in at] == [(int(x) if x in v else -1) for x in asked]
    half = s.search(v, np.full(len(v), len(v) // 2), np.full(len(v), len(v)))
    assert all((i >= len(v) // 2) == (x in v[len(v) // 2 :]) for i, x in zip(half, v))


def asked_by(rng, blocks, each, pool):
    """Questions of `each` phrases from each block, drawn from a pool of hashes; high hashes of few values meet by low ones."""
    out = []
    for _ in range(blocks):
        i = np.sort(rng.choice(len(pool), each, replace=False))
        high, low = pool["high"][i] >> np.uint64(8), pool["low"][i]
        out.append(batches.pack(eliasfano.encode(high), low, np.arange(each, dtype=np.uint32)))
    return out


def pool_of(rng, n, values):
    pool = np.empty(n, [("high", np.uint64), ("low", np.uint32)])
    pool["high"], pool["low"] = rng.integers(0, values, n, dtype=np.uint64) << np.uint64(8), rng.permutation(n)
    return np.sort(pool, order=["high", "low"])


def test_a_shard_is_answered_range_by_range(monkeypatch):
    rng = np.random.default_rng(4)
    for values in (1, 5, 2**56):
        pool = pool_of(rng, 900, values)
        numbers, messages = [7 << 32, 3, 1 << 40, 12, 5], asked_by(rng, 5, 200, pool)
        places = {}
        for b, m in zip(numbers, messages):
            high, low, first = batches.unpack(m, bytes, np.uint32, np.uint32)
            for key in zip(eliasfano.decode(high)[0].tolist(), low.tolist(), first.tolist()):
                places.setdefault(key[:2], []).append((b, key[2]))
        for piece in (1, 64, 1 << 20):
            monkeypatch.setattr(substring_dedup, "PIECE", piece)
            for b, m, reply in zip(numbers, messages, substring_dedup.answer(numbers, messages)):
                high, low, first = batches.unpack(m, bytes, np.uint32, np.uint32)
                others = [min(x for x in places[key] if x[0] != b) if len(places[key]) > 1 else None for key in zip(eliasfano.decode(high)[0].tolist(), low.tolist())]
                bits, block, place = batches.unpack(reply, np.uint8, np.int64, np.uint32)
                assert np.unpackbits(bits, count=len(low)).tolist() == [x is not None for x in others]
                assert list(zip(block.tolist(), place.tolist())) == [x for x in others if x is not None]


def traced(f):
    tracemalloc.start()
    f()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_a_shard_takes_little_more_than_its_phrases():
    rng = np.random.default_rng(5)
    messages = asked_by(rng, 60, 20_000, pool_of(rng, 100_000, 2**56))
    peak = traced(lambda: substring_dedup.answer(list(range(60)), messages))
    assert peak < 60 * 20_000 * 60  # 94 bytes a phrase when all were sorted at once, 34 by ranges


def test_kept_words_are_copied_in_steps():
    texts = pa.array([" ".join(f"w{i}x{d}" for i in range(5000)) for d in range(100)])
    docs = pa.table({"id": pa.array(range(100)), "text": texts})
    asked = substring_dedup.ask(35, 1)(docs)
    replies = substring_dedup.answer([0], [asked[0][1]])
    peak = traced(lambda: substring_dedup.finish(35, 1, True)(0, docs, replies))
    assert peak < 20 * texts.nbytes  # 29 when all bytes were copied at once, 14 in steps
