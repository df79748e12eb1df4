import random
import zlib
from hashlib import sha256

import pytest
from driftlake.llm import periodic, queries


def brute(x, least=24, times=3):
    n, out = len(x), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and x[j] == x[j + p]:
                j += 1
            size = j + p - i
            if size >= max(least, times * p) and not any(x[i : i + size - q] == x[i + q : i + size] for q in range(1, p)):
                out.append((i, size, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_find_equals_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        k = rng.choice([1, 2, 2, 3, 5])
        x = [rng.randrange(k) for _ in range(rng.randint(0, 90))]
        if rng.random() < 0.6 and x:
            i, b = rng.randrange(len(x)), [rng.randrange(k) for _ in range(rng.randint(1, 9))]
            x[i:i] = (b * 12)[: rng.randint(5, 60)]
        for least, times in ((24, 3), (2, 2), (6, 3)):
            assert periodic.find(x, least, times) == brute(x, least, times), (x, least, times)


def expected(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    drop = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    left = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha256(lines.encode()).hexdigest(), sha256(left).hexdigest(), lines, left.decode()


def texts():
    rng = random.Random(2)
    yield from [None, "", " \n\t ", "a", "a " * 23, "a " * 24, "x " + "a b c d e f g h " * 3 + "a y", "a b c d e f g h i " * 3, "\x0ba\x0ca\x1ca" * 30, "ä ö ü\n" * 40]
    for _ in range(150):
        w = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(1, 150))]
        for _ in range(rng.randint(0, 2)):
            i, p = rng.randrange(len(w)), rng.randint(1, 12)
            w[i:i] = (w[i : i + p] * 9)[: rng.randint(1, 70)]
        yield " ".join(w) + rng.choice(["", "\n", "  "])


@pytest.mark.parametrize("bytes_at_once", [200, 4 << 20])
def test_frame(spark, monkeypatch, bytes_at_once):
    monkeypatch.setattr(periodic, "TEXT_BYTES", bytes_at_once)
    rows = [(i, t, "s", 1) for i, t in enumerate(texts())] + [(None, "a b " * 40, None, None), (5, "a b " * 40, "s", 1), (5, "a b " * 40, "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, length int")
    assert sorted(map(tuple, periodic.runs(df).collect()), key=str) == sorted((expected(i, t) for i, t, *_ in rows), key=str)
    assert periodic.runs(df.limit(0)).collect() == []


def test_whole_table(spark):
    """The query against brute force over a table."""
    sf = "/root/testdata/sf0.001"
    want = [expected(r["doc_id"], " ".join((r["text"] or "").split(" ")))[:8] for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len((r["text"] or "").split()) < 400]
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect()}
    assert want and all(got[w[0]] == w for w in want)
