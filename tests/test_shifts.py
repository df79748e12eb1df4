"""Moves, fits and similarity over scales by hand and by brute force."""

import math
import random
from functools import lru_cache

import numpy as np
import pytest
from driftlake.operators import evaluation, planes, shifts
from driftlake.operators.textdiff import word_diff


def picture(seed=1, size=64):
    rng = np.random.default_rng(seed)
    base = np.full((size, size), 200.0)
    patch = rng.integers(0, 255, (10, 12)).astype(float)
    return base, patch


def matched(spark, one, two, rows):
    """Candidates among (region, change type, box), and which of them are moves."""
    df = spark.createDataFrame([(0, n, kind, *box) for n, kind, box in rows], "frame int, region int, change_type string, bx int, by int, bw int, bh int")
    pairs = sorted((r.region, r.partner) for r in shifts.candidates(df).collect())
    return shifts.pairs_of(one, two, {n: box for n, _, box in rows}, pairs)


def test_a_moved_patch_is_found(spark):
    base, patch = picture()
    one, two = base.copy(), base.copy()
    one[5:15, 4:16] = patch
    two[40:50, 30:42] = patch
    regions = [(0, "deletion", (4, 5, 12, 10)), (1, "addition", (30, 40, 12, 10)), (2, "addition", (50, 2, 40, 3))]
    found = matched(spark, one, two, regions)
    assert [(a, b) for a, b, _ in found] == [(0, 1)] and found[0][2] == pytest.approx(1)
    assert matched(spark, one, two, [(0, "color-change", (4, 5, 12, 10)), (1, "color-change", (30, 40, 12, 10))]) == []


def test_candidates_equal_all_pairs_that_fit(spark):
    rng = random.Random(4)
    kinds = ["addition", "color-change"]
    rows = [(f, n, rng.choice(kinds), 0, 0, rng.randint(0, 40), rng.choice([0, 1, 2, 10, 18, 19, 100])) for f in range(3) for n in range(40)]
    df = spark.createDataFrame(rows, "frame int, region int, change_type string, bx int, by int, bw int, bh int")
    fits = lambda p, q: all(0.55 <= p[k] / max(1, q[k]) <= 1.82 for k in (5, 6))
    want = {(p[0], p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and fits(p, q) and not p[2] == q[2] == "color-change"}
    got = [tuple(r) for r in shifts.candidates(df).collect()]
    assert set(got) == want and len(got) == len(want) > 100


def test_boxes_that_trail_by_a_few_pixels():
    base, _ = picture(2)
    waves = np.add.outer(np.sin(np.arange(10) / 2), np.cos(np.arange(12) / 2)) * 60 + 120
    one, two = base.copy(), base.copy()
    one[5:15, 4:16] = waves
    two[40:50, 30:42] = waves
    assert shifts.score(one, two, (4, 5, 12, 10), (31, 41, 12, 10)) is not None
    assert shifts.score(one, two, (4, 5, 12, 10), (20, 20, 12, 10)) is None


def test_flat_patches_must_stand_out():
    base, _ = picture()
    one, two = base.copy(), base.copy()
    one[5:15, 5:15] = 20
    two[40:50, 40:50] = 20
    assert shifts.score(one, two, (5, 5, 10, 10), (40, 40, 10, 10)) == 0
    assert shifts.score(base, base, (5, 5, 10, 10), (40, 40, 10, 10)) is None


def test_frames(spark):
    base, patch = picture(3)
    rows, boxes = [], []
    for frame in range(3):
        one, two = base.copy(), base.copy()
        one[5:15, 4:16] = patch
        two[(40 if frame < 2 else 5) : (50 if frame < 2 else 15), 4:16] = patch if frame != 1 else 255 - patch
        rows += [(frame, x, y, *[int(one[y, x])] * 3, *[int(two[y, x])] * 3) for y in range(64) for x in range(64)]
        boxes += [(frame, 0, "deletion", 4, 5, 12, 10), (frame, 1, "addition", 4, 40, 12, 10)]
    px = spark.createDataFrame(rows, "frame int, x int, y int, r1 int, g1 int, b1 int, r2 int, g2 int, b2 int")
    regions = spark.createDataFrame(boxes, "frame int, region int, change_type string, bx int, by int, bw int, bh int")
    found = shifts.shift_pairs(px, regions)
    assert [(r.frame, r.region, r.partner) for r in found.collect()] == [(0, 0, 1)]
    kinds = {(r.frame, r.region): r.change_type for r in shifts.with_shifts(regions, found).collect()}
    assert kinds[0, 0] == kinds[0, 1] == "shift" and kinds[1, 0] == "deletion"
    assert shifts.shift_pairs(px, regions.limit(0)).count() == 0


def test_logistic_fit_finds_a_planted_curve(spark):
    x = np.linspace(-3, 3, 200)
    y = 4 * (0.5 - 1 / (1 + np.exp(2 * (x - 0.4)))) + 0.3 * x + 1
    plcc, rmse = evaluation.logistic_fit(x, y)
    assert plcc > 0.999999 and rmse < 1e-3
    plcc, _ = evaluation.logistic_fit(x, -y)
    assert plcc > 0.999999
    plcc, rmse = evaluation.logistic_fit(x, np.ones_like(x))
    assert math.isnan(plcc) and rmse < 1e-6
    rows = [("a", float(a), float(b)) for a, b in zip(x, y)] + [("a", None, 1.0), ("b", float("nan"), 1.0)]
    got = evaluation.fitted(spark.createDataFrame(rows, "g string, predicted double, rated double"), "g").collect()
    assert [(r.g, r.n) for r in got] == [("a", 200)] and got[0].plcc > 0.999999 and got[0].rmse < 1e-3


def test_fits_from_sums_equal_those_of_whole_groups(spark, monkeypatch):
    """Curves with noise, rising and falling, steep and flat; one constant side has no correlation."""
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for g, (steep, sign, noise) in enumerate([(0.5, 1, 0.1), (3.0, -1, 0.4), (12.0, 1, 0.2), (1.0, 1, 2.0)]):
        x = rng.normal(50, 20, 300)
        y = sign * 5 / (1 + np.exp(-steep * (x - 55) / 20)) + rng.normal(0, noise, 300)
        rows += [(g, float(a), float(b)) for a, b in zip(x, y)]
        want[g] = evaluation.logistic_fit(x, y)
    rows += [(8, float(i), 1.0) for i in range(5)] + [(9, 1.0, float(i)) for i in range(5)] + [(10, None, 2.0)]
    df = spark.createDataFrame(rows, "g int, predicted double, rated double").repartition(7)
    got = {r.g: r for r in evaluation.fitted(df, "g").collect()}
    assert set(got) == {*want, 8, 9}
    for g, (plcc, rmse) in want.items():
        some = 5e-3 if g == 3 else 1e-4  # of mere noise there are many fits, and a steep one may lie between two of those tried
        assert got[g].n == 300 and got[g].plcc >= plcc - some and got[g].rmse <= rmse * (1 + some), (g, got[g], plcc, rmse)
    assert math.isnan(got[8].plcc) and got[8].rmse == 0 and math.isnan(got[9].plcc) and abs(got[9].rmse - 2**0.5) < 1e-9


def slow_same(plane, kernel):
    h, w = plane.shape
    pad = len(kernel) // 2
    fold = lambda i, n: min(n - 1, max(0, -i if i < 0 else 2 * (n - 1) - i if i > n - 1 else i))
    return np.array([[sum(kernel[j] * kernel[i] * plane[fold(y + j - pad, h), fold(x + i - pad, w)] for j in range(len(kernel)) for i in range(len(kernel))) for x in range(w)] for y in range(h)])


def test_filters_reflect_without_repeating_the_edge():
    rng = np.random.default_rng(4)
    for shape in ((5, 7), (2, 9), (12, 12)):
        p = rng.random(shape)
        for kernel in ([0.25, 0.5, 0.25], [0.5, 0.5], [0.1, 0.2, 0.4, 0.2, 0.1]):
            assert np.allclose(planes.smoothed(p, kernel), slow_same(p, kernel))
    p = rng.random((8, 8))
    assert planes.shrunk(p, 2)[1, 1] == pytest.approx(p[1:3, 1:3].mean()) and planes.shrunk(p, 2).shape == (4, 4)
    assert planes.shrunk(rng.random((7, 9)), 2).shape == (3, 4)


def test_scores_over_scales():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (96, 96)).astype(float)
    assert planes.ms_ssim_of(a, a, planes.WEIGHTS[:3]) == pytest.approx(1) and planes.ssim_of(a, a) == pytest.approx(1)
    assert planes.ms_ssim_of(a, a) is None  # five scales want 176 pixels
    assert math.isnan(planes.ms_ssim_of(a, 255 - a, (0.5, 0.5)))
    assert planes.ms_ssim_of(a, 255 - a, (0.5, 0.5), product=False) < 0
    near = np.clip(a + rng.normal(0, 5, a.shape), 0, 255)
    assert 0.9 < planes.ms_ssim_of(a, near, (0.5, 0.5)) < 1
    rgb = [a, a.T, a[::-1]]
    assert planes.perceptual_of(rgb, rgb, planes.Perceptual((0.5, 0.5), chroma_weight=0.5, chroma_halvings=1, deviation_weight=1.0)) == pytest.approx(1)
    assert planes.ssim_of(np.zeros((600, 600)), np.zeros((600, 600))) == pytest.approx(1)


def test_word_differences_are_longest_and_remove_first():
    rng = random.Random(6)

    def best(a, b):
        @lru_cache(None)
        def common(i, j):
            if i == len(a) or j == len(b):
                return 0
            return common(i + 1, j + 1) + 1 if a[i] == b[j] else max(common(i + 1, j), common(i, j + 1))

        ins, rem, i, j = [], [], 0, 0
        while i < len(a) or j < len(b):
            if i < len(a) and j < len(b) and a[i] == b[j]:
                i, j = i + 1, j + 1
            elif j == len(b) or (i < len(a) and common(i + 1, j) >= common(i, j + 1)):
                rem.append(a[i])
                i += 1
            else:
                ins.append(b[j])
                j += 1
        return ins, rem

    for _ in range(200):
        a, b = ([rng.choice("xyz") for _ in range(rng.randint(0, 9))] for _ in range(2))
        assert word_diff(a, b) == best(a, b)
