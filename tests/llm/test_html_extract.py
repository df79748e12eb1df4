import html
import re

import pytest
from driftlake.llm.html_extract import MIN_TOKENS, blocks, extract

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="top">no</header><nav><ul><li><a href="/x">no</a></li></ul></nav><!-- <article>no</article> --><div class="ad">no</div><div id="cookie-notice">no</div>
<article><header><h1>Head &amp; line</h1></header><p><b>One
 two.<br><p>Thr<i>ee</i>&nbsp;&lt;4&gt; &amp five<p>Six</p><aside>no</aside><form><input value="no">no</form><script>if (a<b) no</script>
<section class="comments"><p>no</p></section><div><p>Seven &eacute;&#233;</p></div></article><footer>&copy; no</footer></body></html>"""


def test_one_page():
    got = " ".join(t for k, t in blocks(PAGE) if k == "in")
    assert got == "Head & line One two. Three\xa0<4> & five Six Seven éé"


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "a < b", "<script>x", "<article>", "</p></div>x", "<div class='ad'>x", "&#0;&#xD800;&bogus;&"])
def test_broken_pages(page):
    for kind, text in blocks(page):
        assert text.strip() and kind in ("in", "out", "open")


def test_frame(spark):
    menu = "<div>" + " ".join(f"menu{i}" for i in range(MIN_TOKENS + 2)) + "</div>"
    rows = [
        (1, "http://a.b/1", PAGE, "x"),
        (2, None, None, "x"),
        (3, "http://c.d/1", menu + "<p>own text of three</p>", "x"),
        (4, "http://c.d/2", menu + "<p>other words</p>", "x"),
        (4, "http://c.d/2", menu + "<p>other words</p>", "x"),
        (5, "http://e.f/2", menu + "<p>alone</p>", None),
        (None, "bad url [", "<main>m</main>", "x"),
        (6, "", "<article></article><p>fallback" + "</p>", "x"),
        (7, "http://g.h/", "<article>" + "w " * 100000 + "</article>", "x"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in extract(df).collect()}
    assert extract(df).count() == len(rows)
    assert got[1, "http://a.b/1"][0].startswith("Head & line")
    assert got[2, None] == ("", 0)
    assert got[3, "http://c.d/1"][0] == "own text of three" and got[4, "http://c.d/2"][0] == "other words"
    assert got[5, "http://e.f/2"][0].endswith("menu7 alone")
    assert got[None, "bad url ["] == ("m", 1)
    assert got[7, "http://g.h/"][1] == 199999
    assert extract(df.limit(0)).count() == 0


def test_articles_of_the_pages_table(spark):
    """Every page of the table marks its article; a plain cut at its tags must give the same text."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in rows.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<b>", "")
        want[r.page_id] = re.sub(r"\s+", " ", html.unescape(" ".join(re.split(r"</?(?:p|h1|br)>", inner)))).strip()
    assert {r.page_id: r.text for r in extract(rows).collect()} == want
