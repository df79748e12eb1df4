"""Elements without text of their own: self-closed, unclosed and closed ones within an article."""

import pytest
from driftlake.llm.html_extract import blocks

HOLLOW = {"template", "svg", "iframe", "select"}


def content(page):
    return " ".join(t for k, t in blocks(page) if k == "in")


@pytest.mark.parametrize("tag", sorted(HOLLOW))
def test_hollow(tag):
    one, closed = f"<{tag} class='x'", f"<{tag}>no</{tag}>"
    assert content(f"<article><p>one</p>{one}/><p>two</p>{closed}<p>three</p></article>") == "one two three"
    assert content(f"<article><p>one {one}></p><p>two</p>{closed}<p>three</p></article>") == "one two three"
    assert content(f"<article><p>one</p>{one}><p>two</p></article><p>no</p>") == "one two"
    assert content(f"<article>{closed}one</article>") == "one"


def test_raw_and_captions():
    assert content("<article>one<script src='x'/>two<style>no</style></article>") == "one two"
    assert content("<article>one<figure><img><figcaption>two</figcaption></figure></article>") == "one two"
    assert content("<article>one<script>no</article>") == "one"


@pytest.mark.parametrize("tag", ["math", "noscript", "object"])
def test_text_within_is_content(tag):
    assert content(f"<article><p>one <{tag}>two</{tag}></p><p>three</p></article>") == "one two three"
    assert content(f"<article><p>one</p><{tag}/><p>two</p></article><p>no</p>") == "one two"


def test_hints_and_unclosed_elements_are_in_doubt():
    kinds = lambda page: [k for k, _ in blocks(page)]
    assert kinds('<article><p class="header">a</p><div class="share-price">b</div><div class="comments">c</div>d</article>') == ["doubt", "doubt", "out", "in"]
    assert kinds("<article><p>a</p><div class=ad>b<p>c</p></article>") == ["in", "doubt", "doubt"]
    assert kinds("<article><p>a</p><div class=ad>b</div><p>c</p></article>") == ["in", "out", "in"]
    assert kinds('<div class="share">a</div><p>b</p>') == ["out", "open"]
