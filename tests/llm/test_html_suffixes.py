"""The suffix array against plain Python, and what it decides."""

import random

import numpy as np
from driftlake.llm import html_extract
from driftlake.llm.html_extract import extract, repeated, suffix_array
from hypothesis import given, settings
from hypothesis import strategies as st


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffixes_and_prefixes(values):
    order, common = suffix_array(np.array(values))
    want = sorted(range(len(values)), key=lambda i: values[i:])
    assert order.tolist() == want
    for k, (i, j) in enumerate(zip(want, want[1:])):
        n = 0
        while max(i, j) + n < len(values) and values[i + n] == values[j + n]:
            n += 1
        assert common[k + 1] == n


def brute(pages, least, share):
    out = []
    held = {}
    for p, texts in enumerate(pages):
        for t in texts:
            w = t.split()
            for i in range(len(w) - least + 1):
                held.setdefault(tuple(w[i : i + least]), set()).add(p)
    for texts in pages:
        row = []
        for t in texts:
            w = t.split()
            gone = np.zeros(len(w), bool)
            for i in range(len(w) - least + 1):
                if len(held[tuple(w[i : i + least])]) >= max(2, -(-share * len(pages) // 1)):
                    gone[i : i + least] = True
            row.append(gone.tolist())
        out.append(row)
    return out


def test_repeated_substrings():
    rng = random.Random(3)
    menu = "home news sport weather travel about contact"
    for _ in range(20):
        pages = [[" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) + rng.choice(["", " " + menu]) for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(1, 9))]
        assert [[x.tolist() for x in row] for row in repeated(pages, 4, 0.25)] == brute(pages, 4, 0.25)


def test_it_decides_marked_pages_too(spark):
    share = '<div class="share">tell your friends about this page right now</div>'
    rows = [(i, "http://a.b/", f'<article><p>text {i}</p>{share}<p class="header">heading of page {i}</p></article>') for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract(df).collect()}
    assert got == {i: f"text {i} heading of page {i}" for i in range(6)}
    alone = extract(df.limit(1)).first()
    assert alone.text == "text 0 tell your friends about this page right now heading of page 0"


def test_hosts_of_many_pages_are_cut(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "CHUNK", 10)
    menu = "<div>" + " ".join(f"menu{i}" for i in range(8)) + "</div>"
    rows = [(i, "http://a.b/", f"{menu}<p>words {i}</p>") for i in range(100)] + [(200 + i, "http://a.b/", f"{menu}<p>words 5</p>") for i in range(40)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"words {i if i < 200 else 5}" for i, _, _ in rows}
