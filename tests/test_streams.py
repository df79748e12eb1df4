"""A stream goes on where it stopped; catalogues as files; boxes of masks."""

import json
from xml.etree import ElementTree

from driftlake.operators import catalog, reports
from driftlake.sources import manifests
from driftlake.streaming import checks


def test_resumes(spark, tmp_path):
    schema = "k int, t int, v string"
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    state = lambda: {r.k: (r.events, r.v) for r in checks.run_latest(spark, source, spark.createDataFrame([], schema).schema, folder, "k", ["t"], ["v"]).collect()}
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], schema).coalesce(1).write.parquet(source)
    assert state() == {1: (2, "b"), 2: (1, "c")}
    spark.createDataFrame([(2, 5, "d"), (3, 1, "e")], schema).coalesce(1).write.mode("append").parquet(source)
    assert state() == {1: (2, "b"), 2: (2, "d"), 3: (1, "e")}
    batches = sorted(p.name for p in (tmp_path / "run" / "state").glob("batch=*"))
    assert len(batches) == 2 and spark.read.parquet(str(tmp_path / "run" / "state" / batches[1])).count() == 2  # changed keys alone
    assert state() == {1: (2, "b"), 2: (2, "d"), 3: (1, "e")}


def test_compacted_state_is_the_newest(spark, tmp_path):
    for number, rows in enumerate([[(1, "a"), (2, "b")], [(2, "c")], [(3, None), (1, "d")]]):
        spark.createDataFrame(rows, "k int, v string").write.parquet(str(tmp_path / "state" / f"batch={number}"))
    checks.compact(spark, str(tmp_path / "state"), "k", str(tmp_path / "one"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "one")).collect())) == [(1, "d"), (2, "c"), (3, None)]


def test_junit_report(spark, tmp_path):
    rows = [("b", "fail", '<5% & "off"'), ("a", "pass", None), ("c", "stale-baseline", None)]
    reports.write_junit(spark.createDataFrame(rows, "id string, status string, message string"), str(tmp_path / "junit"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "junit").glob("part-*")))
    suite = ElementTree.fromstring(text.encode()).find("testsuite")
    assert (suite.get("tests"), suite.get("failures")) == ("3", "2") and [c.get("name") for c in suite] == ["a", "b", "c"]
    assert [None if c.find("failure") is None else c.find("failure").get("message") for c in suite] == [None, '<5% & "off"', "stale-baseline"]


def test_manifest_round_trip(spark, tmp_path):
    entries = spark.createDataFrame([("p1", "/a", [".ad"], True), ("p2", "/b?x=1", [], None)], "id string, url string, mask array<string>, full_page boolean")
    path = str(tmp_path / "manifest")
    manifests.save(entries, path)
    assert sorted(map(tuple, manifests.load(spark, path, entries.schema).collect()), key=str) == sorted(map(tuple, entries.collect()), key=str)
    whole = tmp_path / "one.json"
    whole.write_text(json.dumps({"version": 1, "entries": [{"id": "p1", "url": "/a", "mask": [], "full_page": False}]}))
    assert [r.id for r in manifests.load_document(spark, str(whole), entries.schema).collect()] == ["p1"]


def test_boxes_of_masks(spark):
    px = spark.createDataFrame([(1, x, y, 3 <= x <= 5 and y == 2) for x in range(8) for y in range(4)] + [(2, 0, 0, False)], "mask int, x int, y int, inside boolean")
    assert [tuple(r) for r in manifests.mask_boxes(px).collect()] == [(1, 3, 2, 3, 1)]


def test_rated_table(spark, tmp_path):
    (tmp_path / "r.csv").write_text("dist_img,dmos\nI01_02_03.png,4.5\nI07_12_01.png,1.25\nodd.png,1\n")
    got = sorted(tuple(r) for r in manifests.rated_table(spark, str(tmp_path / "r.csv")).select("reference", "distortion", "level", "fold", "rated").collect())
    assert got == [(1, 2, 3, 1, 4.5), (7, 12, 1, 2, 1.25)]


def test_stale_entries(spark):
    e = spark.createDataFrame([("a", "x", "x"), ("b", "x", "y"), ("c", "x", None)], "id string, hash string, captured_hash string")
    assert [r.id for r in catalog.stale(e).collect()] == ["b", "c"]
