"""Chunks of a host decide nothing: what its pages repeat is counted over all of them."""

import random

from driftlake.llm import html_extract
from driftlake.llm.html_extract import extract

MENU = "<div>" + " ".join(f"menu{i}" for i in range(8)) + "</div>"


def texts(spark, rows, chunk, monkeypatch):
    monkeypatch.setattr(html_extract, "CHUNK", chunk)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return sorted((r.page_id, r.text) for r in extract(df).collect())


def test_few_pages_in_doubt_on_a_large_host(spark, monkeypatch):
    rows = [(i, "http://a.b/", f"<article><p>text of page {i}</p></article>") for i in range(200)]
    rows += [(300 + i, "http://a.b/", f"{MENU}<p>words {i}</p>") for i in range(6)] + [(400, "http://a.b/", f"{MENU}<p>words 5</p>")]
    got = texts(spark, rows, 8, monkeypatch)
    assert got == [(i, f"text of page {i}") for i in range(200)] + [(300 + i, f"words {i}") for i in range(6)] + [(400, "words 5")]


def test_chunks_of_any_size_give_the_same_texts(spark, monkeypatch):
    rng = random.Random(4)
    parts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(6, 9))) for _ in range(12)]
    wrap = ["<div>{}</div>", "<p>{}</p>", "<nav>{}</nav>", "<article>{}</article>", '<article>x <div class="share">{}</div></article>']
    rows = []
    for i in range(90):
        host = rng.choice(["http://a.b/", "http://a.b/", "http://c.d/"])
        held = [parts[min(int(rng.expovariate(0.3)), 11)] for _ in range(rng.randint(0, 3))]
        page = "".join(rng.choice(wrap).format(t) for t in held) + f"<p>page {i if i % 9 else 0}</p>"
        rows.append((i, host, page))
    whole = texts(spark, rows, 10**6, monkeypatch)
    assert len(whole) == len(rows) and len({t for _, t in whole}) > 40
    for chunk in (25, 5, 1):
        assert texts(spark, rows, chunk, monkeypatch) == whole
