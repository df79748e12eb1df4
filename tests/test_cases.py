"""Cases of verification: each kind of bad line, and collated routes."""

from driftlake.operators import catalog
from driftlake.sources import cases

LINES = [
    '{"name": "fine", "img1": "a", "img2": "b", "regions": [{"change_type": "Addition", "bbox": {"x": 1, "y": 2, "width": 3, "height": 4}}, {"id": "k", "change_type": "Mine", "mask_path": "m", "expect_in_output": false, "pair_id": "p"}]}',
    '{"name": "none", "img1": "a", "img2": "b", "tier": "Stress", "regions": []}',
    '{"name": "cut", "img1": "a"',
    '{"img1": "a", "img2": "b", "regions": []}',
    '{"name": "blind", "img1": "a", "regions": []}',
    '{"name": "odd", "img1": "a", "img2": "b", "tier": "x", "regions": []}',
    '{"name": "type", "img1": "a", "img2": "b", "regions": [{"change_type": "Addition", "bbox": {"x": 0, "y": 0, "width": 1, "height": 1}}, {"change_type": "What", "bbox": {"x": 0, "y": 0, "width": 1, "height": 1}}]}',
    '{"name": "flat", "img1": "a", "img2": "b", "regions": [{"change_type": "Addition", "bbox": {"x": 0, "y": 0, "width": 0, "height": 1}}]}',
    '{"name": "lost", "img1": "a", "img2": "b", "regions": [{"change_type": "Addition", "mask_path": "gone"}]}',
    '{"name": "bare", "img1": "a", "img2": "b", "regions": [{"change_type": "Addition"}]}',
    '{"name": "wrong", "img1": "a", "img2": "b", "regions": "none"}',
    "   ",
]


def test_each_kind_of_line(spark, tmp_path):
    (tmp_path / "cases.jsonl").write_text("\n".join(LINES))
    masks = spark.createDataFrame([("m", 5, 6, 7, 8)], "mask string, bx int, by int, bw int, bh int")
    found, regions = cases.read(spark, f"file://{tmp_path}/cases.jsonl", {"Mine": "ColorChange"}, "gate", masks)
    rows = {r.name if not r.name.startswith("line-") else r.error: (r.tier, r.error) for r in found.collect()}
    assert rows.pop("not a case", ("gate", "not a case")) == ("gate", "not a case")
    assert rows["fine"] == ("gate", None) and rows["none"] == ("stress", None)
    assert {k: v[1] for k, v in rows.items() if v[1]}.items() >= {"no name": "no name", "blind": "no image", "odd": "unknown tier x", "type": "unknown change type What", "flat": "box without area", "lost": "no mask gone", "bare": "region without box or mask"}.items()
    assert found.filter("error = 'not a case'").count() == 2 and found.count() == 11
    got = sorted((r.id, r.type, tuple(r.box), r.expected, r.pair_id) for r in regions.collect())
    assert got == [("k", "color-change", (5, 6, 7, 8), False, "p"), ("r0", "addition", (1, 2, 3, 4), True, None)]
    assert {tuple(r) for r in cases.totals(found).collect()} == {("gate", 10, 9, 2), ("stress", 1, 0, 0)}


def test_order_of_routes(spark):
    """Signs before digits before letters; accents count after letters, case last."""
    urls = ["/b", "/B", "/a", "/Á", "/á", "/A", "/az", "/2", "/10", "/_x", "/a-b", "/a/b", "/a.b"]
    pages = spark.createDataFrame([("http://h/", "".join(f'<a href="{u}">x</a>' for u in urls))], "url string, html string")
    start = spark.createDataFrame([("http://h", "/")], "host string, url string")
    got = [r.url for r in catalog.discover(pages, start, 1, None, threshold=None).orderBy("nth").collect()]
    assert got == ["/", "/_x", "/10", "/2", "/a", "/A", "/á", "/Á", "/a-b", "/a.b", "/a/b", "/az", "/b", "/B"]
