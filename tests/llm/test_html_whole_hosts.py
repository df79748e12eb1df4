"""All pages of a host go through its suffix array, those included of which markup settles every block."""

from driftlake.llm.html_extract import content, extract, judged

MENU = " ".join(f"menu{i}" for i in range(8))
QUOTE = "one quoted phrase of seven words here"


def test_clear_pages_tell_what_an_unmarked_page_repeats(spark):
    rows = [(i, "http://a.b/", f"<nav>{MENU}</nav><article><p>text {i}. {QUOTE}</p></article>") for i in range(9)]
    rows += [(9, "http://a.b/", f"<div>{MENU}</div><p>text 9. {QUOTE}</p>"), (10, "http://c.d/", f"<div>{MENU}</div><p>alone</p>")]
    rows += rows[:1] + rows[9:10]
    got = [(r.page_id, r.text) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    want = {i: f"text {i}. {QUOTE}" for i in range(10)} | {10: f"{MENU} alone"}
    assert sorted(got) == sorted((i, want[i]) for i, _, _ in rows)


def test_clear_blocks_are_in_the_array():
    pages = [judged(f"<nav>{MENU}</nav><article>a{i}</article>") for i in range(4)] + [judged(f"<div>{MENU}</div><p>b</p>")]
    assert content(*map(list, zip(*pages))) == ["a0", "a1", "a2", "a3", "b"]
    assert content([], []) == [] and content([[]], [[]]) == [""]
