"""Ranks, correlations and inversions against brute force, with ranges of few rows."""

import math
import random

import numpy as np
import pytest
from driftlake.operators import evaluation, textdiff


def test_inversions():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 60):
        for top in (1, 2, 5, 1000):
            g, v, w = rng.integers(0, 3, n), rng.integers(0, top, n) / 4, rng.integers(1, 5, n)
            want = [sum(int(w[i] * w[j]) for i in range(n) for j in range(i + 1, n) if g[i] == g[j] == k and v[i] > v[j]) for k in range(3)]
            assert evaluation.inversions(g, v, w, 3).tolist() == want


def brute(rows):
    n = len(rows)
    up = down = ta = tb = 0
    for i in range(n):
        for j in range(i):
            da, db = rows[i][0] - rows[j][0], rows[i][1] - rows[j][1]
            up += da * db > 0
            down += da * db < 0
            ta += da == 0
            tb += db == 0
    below = math.sqrt((up + down + ta) * (up + down + tb))
    return (up - down) / below if below else float("nan")


@pytest.mark.parametrize("block", [7, 50_000])
def test_kendall(spark, monkeypatch, block):
    monkeypatch.setattr(evaluation, "BLOCK", block)
    rng = random.Random(6)
    groups = {
        "hot": [(rng.choice([1.0, rng.random()]), rng.choice([2.0, rng.random()])) for _ in range(150)],
        "fine": [(rng.random(), rng.random()) for _ in range(60)],
        "few": [(float(rng.randint(0, 3)), float(rng.randint(0, 3))) for _ in range(40)],
        "flat": [(1.0, rng.random()) for _ in range(5)],
        "two": [(1.0, 2.0), (2.0, 1.0)],
    }
    rows = [(g, a, b) for g, some in groups.items() for a, b in some] + [("fine", None, 1.0), ("fine", float("nan"), 1.0), ("fine", float("inf"), 1.0), (None, 1.0, 1.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: r for r in evaluation.correlations(df, "x", "y", "g").collect()}
    assert set(got) == {"hot", "fine", "few", "flat"}
    for g, r in got.items():
        want = brute(groups[g])
        assert r["n"] == len(groups[g]) and (abs(r["kendall"] - want) < 1e-12 or (want != want and r["kendall"] != r["kendall"]))
    ranks = {(r["g"], r["x"], r["rank"]) for r in evaluation.ranked(df.filter("x IS NOT NULL AND g IS NOT NULL"), "x", "rank", "g").collect()}
    a = sorted(x for x, _ in groups["hot"])
    assert {r for r in ranks if r[0] == "hot"} == {("hot", x, (a.index(x) + 1 + a.index(x) + a.count(x)) / 2) for x in a}


def table(base, other):
    """The whole table of common lengths, walked with the tie rule."""
    n, m = len(base), len(other)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if base[i] == other[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    ins, rem = [], []
    while i < n and j < m:
        if base[i] == other[j]:
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            rem.append(base[i])
            i += 1
        else:
            ins.append(other[j])
            j += 1
    return ins + other[j:], rem + base[i:]


@pytest.mark.parametrize("held", [1, 20, 1 << 20])
def test_words_in_little_memory(monkeypatch, held):
    monkeypatch.setattr(textdiff, "TABLE", held)
    rng = random.Random(9)
    for _ in range(200):
        words = "abcd"[: rng.randint(1, 4)]
        x, y = ([rng.choice(words) for _ in range(rng.randint(0, 18))] for _ in range(2))
        assert textdiff.word_diff(x, y) == table(x, y), (x, y)


def test_long_texts():
    import tracemalloc

    rng = random.Random(3)
    x = [f"w{rng.randint(0, 3000)}" for _ in range(12_000)]
    y = [w for w in x if rng.random() < 0.9]
    tracemalloc.start()
    ins, rem = textdiff.word_diff(x, y)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(x) - len(rem) == len(y) - len(ins) and not ins and most < 40 << 20  # the table would take 518 MB
