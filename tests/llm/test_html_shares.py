"""What a host repeats: equal pages, shares of pages, and pages that only seem to mark their article."""

from driftlake.llm.html_extract import extract

MENU = "<div>" + " ".join(f"menu{i}" for i in range(8)) + "</div>"
QUOTE = "one quoted phrase of seven words here"


def test_open_pages(spark):
    rows = [(i, "http://a.b/", f"{MENU}<p>own text of page {i} " + (QUOTE if i < 2 else "alone") + "</p>") for i in range(20)]
    rows += [(30, "http://c.d/", "<p>a page of seven words all alone</p>"), (31, "http://c.d/", "<p>a page of seven words all alone</p>")]
    rows += [(40 + i, "http://e.f/", f"<!-- <article> -->{MENU}<p>page {i}</p>") for i in range(2)]
    rows += [(50 + i, "http://g.h/", f"<article class=teaser></article>{MENU}<p>page {i}</p>") for i in range(2)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == f"own text of page 0 {QUOTE}" and got[7] == "own text of page 7 alone"
    assert got[30] == got[31] == "a page of seven words all alone"
    assert (got[40], got[41], got[50], got[51]) == ("page 0", "page 1", "page 0", "page 1")
