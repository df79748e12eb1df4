"""Differences of records and texts against plain Python."""

import json
import random
from difflib import SequenceMatcher

from driftlake.operators import evaluation, structdiff, textdiff
from pyspark.sql import functions as F


def brute(a, b, path=()):
    if isinstance(a, dict) and isinstance(b, dict):
        for k in sorted(a.keys() | b.keys()):
            if k not in b:
                yield 1, (*path, k), None, a[k]
            elif k not in a:
                yield 0, (*path, k), b[k], None
            else:
                yield from brute(a[k], b[k], (*path, k))
    elif isinstance(a, list) and isinstance(b, list):
        for i in range(max(len(a), len(b))):
            if i >= len(b):
                yield 1, (*path, i), None, a[i]
            elif i >= len(a):
                yield 0, (*path, i), b[i], None
            else:
                yield from brute(a[i], b[i], (*path, i))
    elif isinstance(a, bool) != isinstance(b, bool) or a != b:
        yield 2, path, b, a


def some(rng, depth=3):
    kind = rng.randint(0, 7 if depth else 5)
    if kind == 6:
        return {rng.choice("abcd"): some(rng, depth - 1) for _ in range(rng.randint(0, 3))}
    if kind == 7:
        return [some(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return [None, True, 1, 1.0, "x", 0][kind]


def test_deep_diff(spark):
    rng = random.Random(1)
    old, new = [(i, some(rng)) for i in range(150)], [(i, some(rng)) for i in range(150)]
    frame = lambda rows: spark.createDataFrame([(k, json.dumps(v)) for k, v in rows], "key long, doc string")
    got = structdiff.deep_diff(frame(old), frame(new)).collect()
    plain = lambda v: json.dumps(v, sort_keys=True).replace("1.0", "1")
    found = sorted((r.key, r.type, str([p.key if p.idx is None else p.idx for p in r.path]), plain(r.value and json.loads(r.value)), plain(r.old_value and json.loads(r.old_value))) for r in got)
    assert found == sorted((k, t, str(list(p)), plain(v), plain(o)) for (k, a), (_, b) in zip(old, new) for t, p, v, o in brute(a, b))


def test_deep_diff_of_nulls_and_lone_keys(spark):
    old = spark.createDataFrame([(1, None), (2, "{}"), (None, "1")], "key long, doc string")
    new = spark.createDataFrame([(1, "{}"), (3, "[]")], "key long, doc string")
    got = {(r.key, r.type, r.value, r.old_value) for r in structdiff.deep_diff(old, new).collect()}
    assert got == {(1, 2, "{}", "null"), (2, 1, None, "{}"), (3, 0, "[]", None), (None, 1, None, "1")}


def test_word_diff_is_a_longest_one():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 8))] for _ in range(2))
        inserted, removed = textdiff.word_diff(a, b)
        best = {}
        for i in range(len(a), -1, -1):
            for j in range(len(b), -1, -1):
                best[i, j] = 0 if i == len(a) or j == len(b) else best[i + 1, j + 1] + 1 if a[i] == b[j] else max(best[i + 1, j], best[i, j + 1])
        assert len(a) - len(removed) == len(b) - len(inserted) == best[0, 0] >= sum(m.size for m in SequenceMatcher(None, a, b, False).get_matching_blocks())


def test_described(spark):
    rows = [('the word "Nimbus 12" here', 'it says "Nimbus 13" now'), ("white text Save", "white text Save Cancel"), ("same", "same"), ("", "Go")]
    df = textdiff.describe(spark.createDataFrame(rows, "a string, b string").withColumn("c", F.lit("content-change")), "a", "b", "c")
    assert [r.described for r in df.collect()] == [
        'replaced "12" with "13" (region now reads "Nimbus 13")', 'added "cancel"', "content change with no readable text change", 'added "go"',
    ]


def test_greedy_matches(spark):
    box = lambda x: (x, 0, 10, 10)
    kind = "case int, id int, type string, box struct<x:int,y:int,width:int,height:int>"
    truth = spark.createDataFrame([(1, 1, "shift", box(0), True), (1, 2, "addition", box(4), True), (1, 3, "shift", box(90), False), (1, 4, "shift", box(60), True)], kind + ", expected boolean")
    found = spark.createDataFrame([(1, 7, "addition", box(1)), (1, 8, "shift", box(3)), (1, 9, "shift", box(200))], kind)
    matched, missed, extra = evaluation.match_cases(truth, found)
    assert {(r.truth_id, r.found_id, r.same) for r in matched.collect()} == {(1, 8, True), (2, 7, True), (3, None, True)}
    assert [r.id for r in missed.collect()] == [4] and [r.id for r in extra.collect()] == [9]
