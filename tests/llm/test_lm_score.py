import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from driftlake.llm import batches, lm_score


def brute(rows, discount, prior):
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t in rows]
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1 for d, _ in rows]
    uni, bi = Counter(), defaultdict(Counter)
    for ts, h in zip(toks, held):
        if not h:
            uni.update(ts)
            for a, b in zip([False, *ts], ts):
                bi[a][b] += 1
    n, v = sum(uni.values()), len(uni)
    out = []
    for (d, _), ts, h in zip(rows, toks, held):
        base = score = 0.0
        for a, b in zip([False, *ts], ts):
            p1 = (uni[b] + 0.5) / (n + 0.5 * (v + 1))
            c, t = sum(bi[a].values()), len(bi[a])
            p = max(bi[a][b] - discount, 0) / (c + prior) + ((prior + discount * t) / (c + prior) if c else 1) * p1
            base, score = base + math.log10(p1), score + math.log10(p)
        out.append((d, h, len(ts), sum(uni[t] > 0 for t in ts), n, base, score))
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(batches, "BATCH_BYTES", 500)
    monkeypatch.setattr(batches, "SHARD_CHARS", 1500)
    rng = random.Random(4)
    vocabulary = ["the", "The", "of", "É", "é", "x.", *("w%d" % i for i in range(30))]
    rows = [(1, None), (2, ""), (3, " \n"), (None, "the of"), (4, "q" * 3000), (4, "the"), (4, "the"), (11, "the of the of " * 200)]
    rows += [(10 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    df = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double").repartition(4)
    got = sorted(map(tuple, lm_score.score(df).collect()), key=lambda r: (str(r[0]), r[2], r[5]))
    want = sorted(brute(rows, lm_score.DISCOUNT, lm_score.PRIOR), key=lambda r: (str(r[0]), r[2], r[5]))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], abs=2e-4 * g[2])  # quantised codes
    assert lm_score.score(df.limit(0)).count() == 0


def test_trie_search_stays_in_its_context():
    words = np.array([3, 9, 2**63], np.uint64)
    pointer, successor, counts = np.array([0, 2, 2, 3]), np.array([5, 8, 5], np.uint64), np.array([3, 1, 1])
    raw = lm_score.Trie.build(words, np.array([4, 0, 1]), pointer, successor, counts, 0.5, 1.0)
    t = lm_score.Trie(raw)
    assert t.find(np.array([9, 4, 2**63], np.uint64)).tolist() == [1, -1, 2]
    got = t.follow(np.array([0, 0, 1, 2, 2, -1]), np.array([5, 6, 5, 5, 8, 5], np.uint64))
    p = [2.5 / 5, 0, 0, 0.5 / 2, 0, 0]
    assert [0 if c == lm_score.ZERO else 10 ** (-int(c) / lm_score.STEP) for c in got] == pytest.approx(p, rel=1e-3)


def test_probabilities_sum_to_one():
    words = np.arange(1, 6, dtype=np.uint64)
    count = np.array([5, 4, 3, 2, 1])
    t = lm_score.Trie(lm_score.Trie.build(words, count, np.array([0, 3, 3, 3, 3, 3]), np.array([1, 2, 4], np.uint64), np.array([2, 2, 1]), 0.6, 4.0))
    p1 = np.append(count + 0.5, 0.5) / (15 + 0.5 * 6)
    seen = t.follow(np.zeros(6, int), np.array([1, 2, 3, 4, 5, 6], np.uint64))
    p = np.where(seen < lm_score.ZERO, 10 ** (-seen.astype(float) / lm_score.STEP), 0) + 10 ** (-float(t.back[0]) / lm_score.STEP) * p1
    assert p.sum() == pytest.approx(1, abs=1e-3)


def test_counts_beyond_32_bits():
    """The commonest words' counts of a large corpus come back as they are, from the trie and from a reply."""
    words, counts = np.array([5, 9, 1 << 63], np.uint64), np.array([2**32 + 7, 3, 2**40], np.int64)
    trie = lm_score.Trie(lm_score.Trie.build(words, counts, np.array([0, 1, 1, 2]), np.array([4, 6], np.uint64), np.array([2**33, 1]), 0.5, 1.0))
    at = trie.find(words)
    assert trie.word_count[at].tolist() == counts.tolist()
    assert batches.unpack(batches.pack(trie.word_count[at]), np.uint64)[0].tolist() == counts.tolist()
