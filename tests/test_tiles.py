"""Images in tiles against whole images, for sizes and tiles that fit each other badly."""

import numpy as np
import pytest
from driftlake.operators import planes, rasters, tiles

SIZES = [(1, 1), (2, 3), (33, 47), (64, 50), (70, 35)]


def images(seed=3):
    """(frame, width, height, one, two): smooth noise with edits, some of them transparent."""
    rng = np.random.default_rng(seed)
    for frame, (w, h) in enumerate(SIZES):
        one = (rng.integers(0, 40, (h, w, 4)) + 90 * (np.arange(w)[None, :, None] // 7 % 2) + 60 * (np.arange(h)[:, None, None] // 5 % 2)).astype(np.uint8)
        one[..., 3] = np.where(rng.random((h, w)) < 0.1, 120, 255)
        two = one.copy()
        if frame:
            hit = rng.random((h, w)) < 0.3
            two[hit] = np.clip(two[hit].astype(int) + rng.integers(-80, 120, (int(hit.sum()), 4)), 0, 255)
        yield frame, w, h, one, two


def shapes(seed=4):
    """(frame, width, height, one, two): flat shapes, whose edges are soft in the second image."""
    rng = np.random.default_rng(seed)
    for frame, (w, h) in enumerate(SIZES):
        flat = np.repeat(np.repeat(rng.choice([0, 120, 255], (h // 6 + 1, w // 6 + 1)), 6, 0), 6, 1)[:h, :w]
        soft = (2 * flat + np.roll(flat, 1, 0) + np.roll(flat, 1, 1)) // 4
        one, two = (np.stack([p, p, p // 2, np.full_like(p, 255)], 2).astype(np.uint8) for p in (flat, soft))
        one[rng.random((h, w)) < 0.05, 3] = 90
        yield frame, w, h, one, two


def bands(spark, split=5, of=images):
    rows = []
    for frame, w, h, one, two in of():
        rows += [(frame, w, h, y, min(split, h - y), one[y : y + split].tobytes(), two[y : y + split].tobytes()) for y in range(0, h, split)]
    return spark.createDataFrame(rows, f"frame int, {tiles.BAND}")


def gray(p):
    return tiles.gray(np.ascontiguousarray(p).view("<u4")[..., 0])


def scores(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def near(a, b):
    return a == b or (a is not None and b is not None and (abs(a - b) < 1e-9 or (a != a and b != b)))


@pytest.mark.parametrize("size", [16, 37])
def test_counts(spark, size):
    whole = spark.createDataFrame([(f, w, h, a.tobytes(), b.tobytes()) for f, w, h, a, b in shapes()], "frame int, width int, height int, one binary, two binary")
    for plain in (True, False):
        want = scores(rasters.compare(whole, include_aa=plain).drop("reason"))
        assert any(w[2] for w in want.values()) != plain
        assert scores(tiles.compare(bands(spark, of=shapes), include_aa=plain, size=size)) == want
        assert scores(tiles.compare(tiles.whole(whole), include_aa=plain, size=size)) == want


@pytest.mark.parametrize("size", [16, 37])
def test_similarity(spark, size):
    df = bands(spark)
    cases = list(images())
    for weights, product in (((0.3, 0.7), True), ((0.2, 0.3, 0.5), False)):
        got = scores(tiles.ms_ssim(df, weights, product, size=size))
        assert all(near(got[f][0], planes.ms_ssim_of(gray(a), gray(b), weights, product)) for f, *_, a, b in cases), got
        assert got[0] == (None,) and got[3][0] is not None
    for factor in (None, 1, 2, 3):
        got = scores(tiles.ssim(df, factor, size=size))
        assert all(near(got[f][0], planes.ssim_of(gray(a), gray(b), factor)) for f, *_, a, b in cases), (factor, got)
    for halve in (False, True):
        got = scores(tiles.gmsd(df, halve=halve, size=size))
        for f, w, h, a, b in cases:
            a, b = gray(a), gray(b)
            if halve:
                a, b = (p[: h // 2 * 2, : w // 2 * 2].reshape(h // 2, 2, w // 2, 2).mean((1, 3)) for p in (a, b))
            want = None
            if min(a.shape) > 2:
                g, k = tiles.gradient(a), tiles.gradient(b)
                want = float(((2 * g * k + 170) / (g * g + k * k + 170)).std())
            assert near(got[f][0], want), (halve, f, got[f], want)


def test_colour(spark):
    for options in (planes.Perceptual((0.4, 0.6)), planes.Perceptual((0.4, 0.6), chroma_weight=0.5, chroma_halvings=1), planes.Perceptual((0.4, 0.6), False, 0.7, 0, 1.0)):
        got = scores(tiles.perceptual_ssim(bands(spark), options, size=16))
        for f, w, h, a, b in images():
            split = lambda p: [p[..., c].astype(float) for c in range(3)]
            assert near(got[f][0], planes.perceptual_of(split(a), split(b), options)), (options, f, got.get(f))


def test_one_image_in_many_tasks(spark):
    df = bands(spark).filter("frame = 4")
    cut = tiles.cut(df, lambda w, h: (1, 3), 16)
    assert cut.count() == 15 and cut.filter("octet_length(one) <= 4 * 22 * 22").count() == 15


def test_what_cannot_be_cut(spark):
    rows = [(1, 2, 2, 0, 2, None, b"\0" * 16), (2, 2, 2, 0, 2, b"\0" * 12, b"\0" * 16), (3, 0, 0, 0, 0, b"", b"")]
    df = spark.createDataFrame(rows, f"frame int, {tiles.BAND}")
    assert tiles.compare(df).count() == 0 and tiles.compare(df.limit(0)).count() == 0
    missing = spark.createDataFrame([(1, 2, 4, 0, 2, b"\0" * 16, b"\0" * 16)], f"frame int, {tiles.BAND}")
    with pytest.raises(Exception, match="don't make up its 4 lines"):
        tiles.compare(missing).count()


def edits(seed=5):
    """(frame, width, height, one, two): lines and blots that cross tiles, some of them in spirals."""
    rng = np.random.default_rng(seed)
    for frame, (w, h) in enumerate([(1, 1), (61, 43), (80, 80), (33, 70)]):
        one = np.full((h, w, 4), 255, np.uint8)
        two = one.copy()
        for _ in range(w * h // 150):
            x, y, n = rng.integers(0, w), rng.integers(0, h), rng.integers(1, 25)
            if rng.random() < 0.5:
                two[y, x : x + n, :3] = 10
            else:
                two[y : y + n, x, :3] = 10
        yield frame, w, h, one, two


@pytest.mark.parametrize("size", [7, 16, 200])
def test_components_across_tiles(spark, size):
    from driftlake.operators import regions, tiledregions
    from pyspark.sql import functions as F

    pixels, lines = [], []
    for f, w, h, one, two in edits():
        hit = (one != two).any(2)
        pixels += [(f, x, y, bool(hit[y, x])) for y in range(h) for x in range(w)]
        lines += [(f, w, h, y, 1, one[y].tobytes(), two[y].tobytes()) for y in range(h)]
    px = spark.createDataFrame(pixels, "frame int, x int, y int, changed boolean")
    want = sorted(map(tuple, regions.component_boxes(regions.closed(px, 2)).collect()))
    df = spark.createDataFrame(lines, f"frame int, {tiles.BAND}")
    got = tiledregions.component_boxes(df, size=size)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 12
    assert tiledregions.component_boxes(df.filter(F.col("frame") < 0)).count() == 0


def test_closing():
    from driftlake.operators import tiledregions

    rng = np.random.default_rng(1)
    for _ in range(20):
        h, w, r = rng.integers(1, 12, 3)
        m = rng.random((h, w)) < 0.2
        wide = lambda m, fold: np.array([[fold(m[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]) for x in range(w)] for y in range(h)])  # noqa: B023, E731
        assert (tiledregions.closed(m, r) == wide(wide(m, np.any), np.all)).all()


def test_roots(spark):
    import random

    from driftlake.operators.graphs import roots

    rng = random.Random(2)
    edges = [(k, rng.randrange(n), rng.randrange(n)) for k, n in (("a", 60), ("b", 200)) for _ in range(n * 2 // 3)] + [("chain", i, i + 1) for i in range(40)] + [("a", 5, 5)]
    above = {}

    def top(n):
        while above.get(n, n) != n:
            n = above[n]
        return n

    for k, u, v in edges:
        a, b = sorted((top((k, u)), top((k, v))))
        above[b] = a
    want = {(k, n, top((k, n))[1]) for k, u, v in edges for n in (u, v) if top((k, n)) != (k, n)}
    assert set(map(tuple, roots(spark.createDataFrame(edges, "k string, u long, v long"), ["k"]).collect())) == want
