"""Rasters against the row-a-pixel form, with transparency, edges and odd sizes."""

import random

from driftlake.operators import pixeldiff, rasters


def test_same_as_pixels(spark):
    rng = random.Random(8)
    for w, h in ((1, 1), (2, 3), (9, 7)):
        rows = []
        for frame in range(4):
            for y in range(h):
                for x in range(w):
                    one = [rng.choice((0, 60, 61, 200, 255)) for _ in range(3)] + [rng.choice((255, 255, 255, 0, 120))]
                    two = one if rng.random() < 0.5 or frame == 0 else [min(255, max(0, c + rng.choice((-90, -3, 0, 4, 120)))) for c in one]
                    rows.append((frame, x, y, *one, *two))
        px = spark.createDataFrame(rows, "frame int, x int, y int, " + ", ".join(f"{c}{k} int" for k in "12" for c in "rgba"))
        packed = rasters.packed(px)
        for plain in (True, False):
            want = {r.frame: (r.diff_count, r.aa_count) for r in pixeldiff.summary(pixeldiff.with_status(px, w, h, include_aa=plain)).collect()}
            got = {r.frame: r for r in rasters.compare(packed, include_aa=plain).collect()}
            assert {k: (r.diff_count, r.aa_count) for k, r in got.items()} == want
            assert got[0].identical and got[0].pixels == w * h


def test_what_cannot_be_compared(spark):
    rows = [(1, 1, 1, b"\0" * 4, None), (2, 1, 1, b"\0" * 4, b"\0" * 8), (3, 2, 1, b"\0" * 4, b"\0" * 4), (4, 0, 0, b"", b""), (5, 1, 1, b"\xff" * 4, b"\0\0\0\xff")]
    df = spark.createDataFrame(rows, "frame int, width int, height int, one binary, two binary")
    got = {r.frame: (r.diff_count, r.reason) for r in rasters.compare(df).collect()}
    assert got == {1: (None, "missing image"), 2: (None, "image sizes do not match"), 3: (None, "image sizes do not match"), 4: (0, None), 5: (1, None)}
    assert rasters.compare(df.limit(0)).count() == 0
