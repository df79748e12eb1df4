"""Components, merging and morphology against brute force; rules on rows made by hand."""

import numpy as np
from driftlake.operators import interpreting, regions, verdicts
from pyspark.sql import functions as F


def flood(mask):
    label, h, w = np.full(mask.shape, -1), *mask.shape
    for i in np.flatnonzero(mask):
        if label.flat[i] < 0:
            stack = [int(i)]
            while stack:
                y, x = divmod(stack.pop(), w)
                if 0 <= y < h and mask[y, x] and label[y, x] < 0:
                    label[y, x] = i
                    stack += [(y + dy) * w + x + dx for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= x + dx < w and 0 <= y + dy < h]
    return label


def test_components_are_those_of_a_flood():
    rng = np.random.default_rng(7)
    for share in (0.0, 0.3, 0.55, 0.7, 1.0):
        mask = rng.random((23, 31)) < share
        assert (regions.connected(mask) == flood(mask)).all()


def test_a_winding_path_is_one_component():
    mask = np.zeros((21, 21), bool)
    mask[::2] = True
    mask[1::4, -1] = mask[3::4, 0] = True
    assert set(regions.connected(mask)[mask]) == {0}


def test_boxes_merge_only_over_touched_ground():
    near = [[0, 0, 4, 4, 16], [10, 0, 14, 4, 9]]
    assert regions._merged(near, lambda *b: 1.0) == [[0, 0, 14, 4, 25]]
    assert regions._merged(near, lambda *b: 0.1) == near
    assert regions._merged([[0, 0, 4, 4, 16], [17, 0, 20, 4, 9]], lambda *b: 1.0) == [[0, 0, 4, 4, 16], [17, 0, 20, 4, 9]]
    chain = [[0, 0, 2, 2, 4], [28, 0, 30, 2, 3], [14, 0, 16, 2, 2]]
    assert regions._merged(chain, lambda *b: 1.0) == [[0, 0, 30, 2, 9]]


def test_positions_and_verdicts(spark):
    boxes = spark.createDataFrame([(0, 0, 4, 4), (14, 14, 4, 4), (28, 14, 4, 4), (14, 28, 4, 4)], "bx int, by int, bw int, bh int")
    assert [r[0] for r in boxes.select(regions.position(32, 32)).collect()] == ["top-left", "center", "right", "bottom"]
    pairs = spark.createDataFrame([(1, "pixel-diff", 5.0), (2, "layout-diff", 0.0), (3, "pixel-diff", 5.0), (4, "pixel-diff", 0.5), (5, "file-not-exists", None)], "frame int, reason string, diff_percentage double")
    found = spark.createDataFrame(
        [(1, 0, 9, "top", "addition", 0.9), (1, 1, 5, "left", "color-change", 0.8), (3, 0, 9, "top", "color-change", 0.9), (4, 0, 9, "top", "color-change", 0.6)],
        "frame int, region int, pixels long, position string, change_type string, confidence double",
    )
    got = {r["frame"]: (r["label"], r["dominant"], r["top_position"]) for r in verdicts.verdicts(pairs, found).collect()}
    assert got == {1: ("regression-likely", "addition", "top"), 2: ("ambiguous", None, None), 3: ("intentional-likely", "color-change", "top"), 4: ("ambiguous", "color-change", "top"), 5: ("regression-likely", None, None)}
    text = {r["frame"]: r["summary"] for r in verdicts.summaries(pairs.filter("frame = 1"), found).collect()}
    assert text[1] == "Moderate visual change detected (5.00% of image, 2 regions).\nContent added: 1 region (top).\nColors changed: 1 region (left)."


def test_nothing_changed_gives_no_regions(spark):
    px = spark.range(64).select(F.lit(0).alias("frame"), (F.col("id") % 8).cast("int").alias("x"), F.floor(F.col("id") / 8).cast("int").alias("y"), *[F.lit(9).alias(f"{c}{k}") for k in "12" for c in "rgba"], F.lit(0.0).alias("delta"), F.lit(False).alias("changed"))
    assert interpreting.interpret(interpreting.from_differences(px, 8, 8), 8, 8).count() == 0
