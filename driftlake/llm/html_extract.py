"""Main text of web pages: a suffix array of each host's pages finds what they repeat, and markup confirms what it may take.

A page is cut into blocks (text between tags that are not inline).  Where a page marks its article (an <article> or <main>
tag), blocks within it are content.  Blocks within navigation, headers outside an article, footers, asides, forms,
scripts, styles and elements whose class or id names adverts, comments, notices or sidebars are boilerplate.
In doubt are: all other blocks of pages without a block in an article; within an article, blocks whose class only hints at
boilerplate (a header, sharing, related links, a search), and blocks of a boilerplate element that is never closed.

All pages of a host are dealt into chunks of about CHUNK distinct pages, and all blocks of a chunk's pages go into its suffix array,
whatever their kind.  Token streams are concatenated, their suffixes sorted by prefix doubling, and neighbours' longest common prefixes
read off.  Suffixes that share MIN_TOKENS tokens or more are one run of the array.  A run is boilerplate where SHARE of the host's pages, two
at least, hold it outside a clear article, or SHARE of its pages with blocks in doubt, two at least, hold it in such.  A longer
repeated substring covers its tokens by the suffixes that begin within it.

Pages are counted over all chunks of the host, so chunks decide nothing.  What SHARE of all pages hold, SHARE of the pages hold in one chunk at
least: so an array sends on only the runs that are that frequent in its chunk, with their counts.  A run may be boilerplate if these counts and, for each
chunk that didn't send it, the most pages that it can have there without being sent, are enough; such runs are counted in every chunk.

The check by markup follows: covered tokens go where a block is in doubt; clear blocks of an article stay whole, as the text of an article may be
repeated (quotations, headings that are teasers elsewhere), and clear boilerplate goes even where no other page repeats it.

A host with a third of all pages has as many chunks as its pages need; pages with equal blocks are judged once.  Chunks of a host meet in
sums by run alone, and a run is named by 64 bits within its host.

Defined cases: null and empty html give an empty text; a null URL is a host of its own name ''; pages with equal blocks
count as one page, whatever their ids; repeated rows each give a row.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import math
import re
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.llm import kernels
from driftlake.llm.tables import kept

MIN_TOKENS = 6
SHARE = 0.2  # of a host's pages, two at least: what so many share is boilerplate
CHUNK = 256  # distinct pages of a host in one suffix array
CHUNK_BYTES = 4 << 20  # of their html, about, where pages are large
SEEN = 100_000  # pages that a task remembers, so that it sends a copy's blocks once

ROWS = 1 << 16  # counts of runs in a record batch

IN_ARTICLE, DOUBT, BOILERPLATE = range(3)
COUNTS = ["host", "run", "outside", "doubted", "more_outside", "more_doubted", "chunks"]

RAW = {"script", "style", "textarea", "head"}
HOLLOW = {"template", "svg", "iframe", "select"}  # nothing within them where they close
OUT = {"nav", "footer", "aside", "form", "menu", "dialog", "button"} | HOLLOW
IN = {"article", "main"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SIGNS = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|comments?|disqus|respond|replies|nav\w*|menu\w*|sidebar\w*|foot(?:er)?|masthead|breadcrumbs?|cookies?|consent|notices?|newsletter|subscribe|popup|modal|login)(?:$|[-_\s\d])", re.I)
HINTS = re.compile(r"(?:^|[-_\s])(?:header|share|social|related|search)(?:$|[-_\s\d])", re.I)
TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"[ \t\n\r\f\v]+")


def blocks(page: str) -> list[tuple[str, str]]:
    """(kind, text) in page order; kind is 'in', 'out', 'doubt' (within an article) or 'open' (neither within nor out)."""
    found: list[tuple[str, str]] = []
    held: list[str] = []
    open_tags: list[tuple[str, str, int]] = []  # tag, the kind that holds within it, and, if its class alone put it out of an article, where its blocks begin
    last: dict[str, int] = {}  # where the last close tag of a hollow element begins
    kind, at, n = "open", 0, len(page)

    def flush() -> None:
        if held:
            text = SPACE.sub(" ", "".join(held)).strip(" ")
            held.clear()
            if text:
                found.append((kind, text))

    def end(i: int) -> None:
        """Closes open_tags[i] and what is open within it: of elements without an end of their own, the class is in doubt."""
        for _, _, begin in open_tags[i + 1 :]:
            if begin >= 0:
                found[begin:] = [("doubt" if k == "out" else k, t) for k, t in found[begin:]]
        del open_tags[i:]

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            held.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            held.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if (tag in RAW or tag in HOLLOW) and not m[1] and m[3].endswith("/"):
            flush()
            continue
        if tag in HOLLOW and not m[1]:
            if tag not in last:
                last[tag] = max((c.start() for c in re.finditer(rf"</{tag}\s*>", page, re.I)), default=-1)
            if last[tag] < at:  # never closed
                flush()
                continue
        if tag in RAW and not m[1]:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            flush()
            if close is None and tag == "head":
                continue
            at = close.end() if close else n
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        if m[1]:
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == tag:
                    end(i)
                    break
            kind = open_tags[-1][1] if open_tags else "open"
        elif tag in IN or tag in OUT or tag in ("header", "div", "section", "ul", "ol", "table", "body", "p", "span", "h1", "h2", "h3"):
            if tag in ("p", "h1", "h2", "h3") and open_tags and open_tags[-1][0] in ("p", "h1", "h2", "h3"):
                open_tags.pop()  # paragraphs don't nest
                kind = open_tags[-1][1] if open_tags else "open"
            inner, begin = kind, -1
            if kind != "out":
                signs = " ".join(a or b or c for a, b, c in ATTR.findall(m[3])) if m[3] else ""
                if tag in OUT or (tag == "header" and kind not in ("in", "doubt")):
                    inner = "out"
                elif tag != "body" and signs and SIGNS.search(signs):
                    inner, begin = "out", len(found) if kind == "in" else -1
                elif tag != "body" and signs and HINTS.search(signs):
                    inner = "doubt" if kind in ("in", "doubt") else "out"
                elif tag in IN:
                    inner = "in"
            open_tags.append((tag, inner, begin))
            kind = inner
    flush()
    if open_tags:
        open_tags.insert(0, ("", "open", -1))
        end(0)
    return found


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.coalesce(F.parse_url(F.regexp_replace(F.col(url_col), "[^!-~]|[\\[\\]{}|^`\"<>\\\\]", ""), F.lit("HOST")), F.lit(""))
    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))


def judged(page: str) -> tuple[list[str], list[int]]:
    """The texts of all blocks of a page, and what markup says of each: IN_ARTICLE, DOUBT or BOILERPLATE."""
    found = blocks(page)
    marked = any(k in ("in", "doubt") for k, _ in found)
    kinds = {"in": IN_ARTICLE, "doubt": DOUBT, "open": BOILERPLATE if marked else DOUBT, "out": BOILERPLATE}
    return [t for _, t in found], [kinds[k] for k, _ in found]


def _parsed(pages: DataFrame) -> DataFrame:
    """(id, url, host, page, texts, kinds) of every page; page names the blocks.  Texts and kinds are null where the task has sent those of a copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, bytes]] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                names, texts, kinds = [], [], []
                for page, host in zip(b.column(2), b.column(3).to_pylist()):
                    got = judged(page.as_py() or "")
                    name = hashlib.md5(json.dumps(got).encode()).digest()
                    copy = (host, name) in seen
                    if not copy and len(seen) < SEEN:
                        seen.add((host, name))
                    names.append(name)
                    texts.append(None if copy else got[0])
                    kinds.append(None if copy else got[1])
                cols = [pa.array(names, pa.binary()), pa.array(texts, pa.list_(pa.string())), pa.array(kinds, pa.list_(pa.int8()))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *cols], names=["id", "url", "host", "page", "texts", "kinds"])

    kind = pages.schema["id"].dataType.simpleString()
    return pages.select("id", "url", "html", "host").mapInArrow(run, f"id {kind}, url string, host string, page binary, texts array<string>, kinds array<tinyint>")


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes of tokens, and the longest common prefix of each suffix with the one before it (0 for the first).

    Ranks by the first 1, 2, 4, ... tokens are kept: the order comes from the last, prefixes in common from all of them."""
    n = len(tokens)
    ranks = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while width < n and ranks[-1].max() < n - 1:
        key = ranks[-1] * (n + 1)
        key[: n - width] += ranks[-1][width:] + 1
        ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int64))
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b, common = order[1:].copy(), order[:-1].copy(), np.zeros(max(0, n - 1), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
        step = np.where(same, 1 << level, 0)
        common, a, b = common + step, a + step, b + step
    return order, np.append(0, common)


class Runs(NamedTuple):
    names: np.ndarray  # a hash of the tokens that a run's suffixes share
    outside: np.ndarray  # pages that hold it outside a clear article
    doubted: np.ndarray  # pages that hold it in a block in doubt


def _streams(pages: list[list[str]], least: int, kinds: list[list[int]] | None) -> tuple[kernels.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all blocks, each block's page and kind (in doubt without kinds), and the words that have `least` words to the end of their block."""
    flat = [t for texts in pages for t in texts]
    data, offsets = kernels.column(pa.array(flat, pa.string()))
    w = kernels.words(data, offsets)
    kind = np.array([DOUBT] * len(flat) if kinds is None else [k for x in kinds for k in x], np.int8)
    return w, np.repeat(np.arange(len(pages)), [len(x) for x in pages]), kind, np.flatnonzero(kernels.inside(w.first, least))


def _holders(run: np.ndarray, page: np.ndarray, runs: int) -> np.ndarray:
    """How many pages hold each of so many runs, which begin on these pages."""
    return np.bincount(np.unique(run + page * runs) % runs, minlength=runs) if runs else np.zeros(0, np.int64)


def counted(pages: list[list[str]], least: int = MIN_TOKENS, kinds: list[list[int]] | None = None) -> Runs:
    """The runs of `least` tokens in the suffix array of these pages' blocks, those of one suffix included.  Without kinds all blocks are in doubt."""
    w, page, kind, starts = _streams(pages, least, kinds)
    if not len(starts):
        return Runs(np.zeros(0, np.uint64), *np.zeros((2, 0), np.int64))
    # every block ends in a token of its own, so that no substring goes on into the next
    tokens = np.unique(w.hashes, return_inverse=True)[1].astype(np.int64)
    tokens = np.insert(tokens, w.first[1:], len(tokens) + np.arange(len(page)))
    word = np.full(len(tokens), -1)
    word[starts + np.searchsorted(w.first, starts, "right") - 1] = starts
    order, common = suffix_array(tokens)
    run, word = np.cumsum(common < least), word[order]
    run, word = run[word >= 0], word[word >= 0]
    head = np.append(True, run[1:] != run[:-1])
    run = np.cumsum(head) - 1
    block = np.searchsorted(w.first, word, "right") - 1
    held = [_holders(run[those], page[block[those]], int(run[-1]) + 1) for those in (kind[block] != IN_ARTICLE, kind[block] == DOUBT)]
    return Runs(kernels.windows(w.hashes, least)[word[head]], *held)


def recounted(pages: list[list[str]], names: np.ndarray, least: int = MIN_TOKENS, kinds: list[list[int]] | None = None) -> Runs:
    """The runs of these names, as counted() has them."""
    w, page, kind, starts = _streams(pages, least, kinds)
    names, of = np.unique(names), kernels.windows(w.hashes, least)[starts]
    hit = np.isin(of, names)
    run, block = np.searchsorted(names, of[hit]), np.searchsorted(w.first, starts[hit], "right") - 1
    return Runs(names, *[_holders(run[those], page[block[those]], len(names)) for those in (kind[block] != IN_ARTICLE, kind[block] == DOUBT)])


def shared(runs: Runs, pages: int, doubtful: int, share: float = SHARE) -> np.ndarray:
    """Which runs are boilerplate on a host of so many pages, of which so many have blocks in doubt."""
    enough = lambda of: max(2, math.ceil(share * of))
    return (runs.outside >= enough(pages)) | (runs.doubted >= enough(doubtful))


def covered(pages: list[list[str]], names: np.ndarray, least: int = MIN_TOKENS) -> list[list[np.ndarray]]:
    """For every block of every page, which of its tokens lie in runs of these names."""
    w, _, _, starts = _streams(pages, least, None)
    hit = starts[np.isin(kernels.windows(w.hashes, least)[starts], names)]
    steps = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(steps, hit, 1)
    np.add.at(steps, hit + least, -1)
    inside = np.cumsum(steps[:-1]) > 0
    of = iter([inside[a:b] for a, b in zip(w.first, w.first[1:])])
    return [[next(of) for _ in texts] for texts in pages]


def _doubtful(pages: list, kinds: list[list[int]] | None) -> int:
    return len(pages) if kinds is None else sum(DOUBT in x for x in kinds)


def repeated(pages: list[list[str]], least: int = MIN_TOKENS, share: float = SHARE, kinds: list[list[int]] | None = None) -> list[list[np.ndarray]]:
    """For every block of every page, which of its tokens lie in substrings of `least` tokens or more that recur on other pages.

    Without kinds all blocks are in doubt; what recurs in blocks of an article alone doesn't count."""
    runs = counted(pages, least, kinds)
    return covered(pages, runs.names[shared(runs, len(pages), _doubtful(pages, kinds), share)], least)


def _unique_runs(text: str, covered: np.ndarray) -> str:
    """A block's tokens that no repeated substring covers."""
    if not covered.any():
        return text
    data, offsets = kernels.column(pa.array([text]))
    w = kernels.words(data, offsets, hashed=False)
    return " ".join(bytes(data[s:e]).decode() for s, e in zip(w.starts[~covered], w.ends[~covered]))


def content(pages: list[list[str]], kinds: list[list[int]], names: np.ndarray | None = None) -> list[str]:
    """The texts of pages: what the suffix arrays found on their host (names of runs; none given: these are all of its pages), confirmed by markup."""
    doubt = [[x for x, k in zip(texts, of) if k == DOUBT] for texts, of in zip(pages, kinds)]
    if names is None:
        runs = counted(pages, kinds=kinds)
        names = runs.names[shared(runs, len(pages), _doubtful(pages, kinds))]
    out = []
    for texts, of, cover in zip(pages, kinds, covered(doubt, names)):
        left = iter(map(_unique_runs, (x for x, k in zip(texts, of) if k == DOUBT), cover))
        parts = [x if k == IN_ARTICLE else next(left) for x, k in zip(texts, of) if k != BOILERPLATE]
        out.append(" ".join(p for p in parts if p))
    return out


def _distinct(b: pa.RecordBatch, found: dict[bytes, tuple[list[str], list[int]]]) -> None:
    """Adds what is sent of pages for the first time."""
    for name, texts, kinds in zip(b.column("page").to_pylist(), b.column("texts"), b.column("kinds")):
        if texts.is_valid and name not in found:
            found[name] = texts.as_py(), kinds.as_py()


def _named(b: pa.RecordBatch, names: np.ndarray) -> np.ndarray:
    """The names of runs that came with the chunk, on one of its rows at least."""
    lists = b.column("runs").drop_null()
    return lists[0].values.to_numpy().view(np.uint64) if len(lists) and not len(names) else names


def _most(share: float, of: int) -> int:
    """The greatest number of pages that is less than a share of them."""
    return max(0, math.ceil(share * of - 1e-9) - 1)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a chunk, rows of COUNTS: one without a run (its pages, those in doubt, the most that a run has of each without being sent, the host's
    chunks), then runs that are frequent (where they are: their pages, and less the most without being sent).  A host's only chunk sends what is boilerplate in doubt."""
    found: dict[bytes, tuple[list[str], list[int]]] = {}
    for b in batches:
        host, chunks = b.column("host")[0], b.column("chunks")[0].as_py()
        _distinct(b, found)
    pages, kinds = [t for t, _ in found.values()], [k for _, k in found.values()]
    runs, doubtful = counted(pages, kinds=kinds), _doubtful(pages, kinds)
    outside, doubted = _most(SHARE, len(pages)), _most(SHARE, doubtful)
    yield pa.RecordBatch.from_arrays([pa.array([host.as_py()]), *[pa.array([x], pa.int64()) for x in (None, len(pages), doubtful, outside, doubted, chunks)]], names=COUNTS)
    sent = (runs.doubted > 0) & shared(runs, len(pages), doubtful) if chunks == 1 else (runs.outside > outside) | (runs.doubted > doubted)
    for at in np.split(np.flatnonzero(sent), range(ROWS, int(sent.sum()), ROWS)):
        name, out, doubt = (x[at] for x in runs)
        numbers = (np.where(out > outside, out, 0), np.where(doubt > doubted, doubt, 0), np.where(out > outside, -outside, 0), np.where(doubt > doubted, -doubted, 0))
        yield pa.RecordBatch.from_arrays([pa.repeat(host, len(at)), pa.array(kernels.signed(name)), *[pa.array(x, pa.int64()) for x in numbers], pa.nulls(len(at), pa.int64())], names=COUNTS)


def _recounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, run, outside, doubted, enough_outside, enough_doubted, chunks) of a chunk for the runs that came with it."""
    found: dict[bytes, tuple[list[str], list[int]]] = {}
    names = np.zeros(0, np.uint64)
    for b in batches:
        same = [b.column(c)[0] for c in ("host", "enough_outside", "enough_doubted", "chunks")]
        _distinct(b, found)
        names = _named(b, names)
    runs = recounted([t for t, _ in found.values()], names, kinds=[k for _, k in found.values()])
    host, *others = [pa.repeat(x, len(runs.names)) for x in same]
    yield pa.RecordBatch.from_arrays([host, pa.array(kernels.signed(runs.names)), pa.array(runs.outside, pa.int64()), pa.array(runs.doubted, pa.int64()), *others], names=["host", "run", "outside", "doubted", "enough_outside", "enough_doubted", "chunks"])


def _to_chunks(runs: DataFrame) -> DataFrame:
    """(host, chunk, runs, enough_outside, enough_doubted): for every chunk of a host, its runs."""
    lists = runs.groupBy("host").agg(F.collect_list("run").alias("runs"), *[F.max(c).alias(c) for c in ("enough_outside", "enough_doubted", "chunks")])
    return lists.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "runs", "enough_outside", "enough_doubted").hint("merge")


def _boilerplate(dealt: DataFrame) -> DataFrame:
    """(host, run, enough_outside, enough_doubted, chunks): runs that are boilerplate, and in doubt somewhere."""
    frequent = dealt.groupBy("host", "chunk").applyInArrow(_frequent, "host string, run long, outside long, doubted long, more_outside long, more_doubted long, chunks long")
    sums = frequent.groupBy("host", "run").agg(*[F.sum(c).alias(c) for c in COUNTS[2:6]], F.max("chunks").alias("chunks"))
    enough = lambda of: F.greatest(F.lit(2), F.ceil(F.lit(SHARE) * F.col(of)))
    # both sides of the join use all sums, so that they read one exchange
    hosts = sums.filter("chunks IS NOT NULL AND doubted > 0").select("host", "chunks", enough("outside").alias("enough_outside"), enough("doubted").alias("enough_doubted"), F.col("more_outside").alias("_outside"), F.col("more_doubted").alias("_doubted"))
    runs = sums.filter("chunks IS NULL").select("host", "run", (F.col("outside") + F.col("more_outside")).alias("outside"), (F.col("doubted") + F.col("more_doubted")).alias("doubted"))
    possible = runs.join(hosts, "host").filter("outside + _outside >= enough_outside OR doubted + _doubted >= enough_doubted")
    asked = dealt.join(_to_chunks(possible.select("host", "run", "enough_outside", "enough_doubted", "chunks")), ["host", "chunk"])
    again = asked.withColumn("runs", F.when(F.col("texts").isNotNull(), F.col("runs"))).groupBy("host", "chunk").applyInArrow(
        _recounts, "host string, run long, outside long, doubted long, enough_outside long, enough_doubted long, chunks long"
    )
    whole = again.groupBy("host", "run").agg(F.sum("outside").alias("outside"), F.sum("doubted").alias("doubted"), *[F.max(c).alias(c) for c in ("enough_outside", "enough_doubted", "chunks")])
    return whole.filter("doubted > 0 AND (outside >= enough_outside OR doubted >= enough_doubted)")


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, url, text) of every row of a chunk."""
    rows, names, found, runs = [], [], {}, np.zeros(0, np.uint64)
    for b in batches:
        rows.append(b.select(["id", "url"]))
        names.append(b.column("page").to_pylist())
        _distinct(b, found)
        runs = _named(b, runs)
    texts = pa.array(content([t for t, _ in found.values()], [k for _, k in found.values()], runs), pa.string())
    place = {name: i for i, name in enumerate(found)}
    for part, named in zip(rows, names):
        for at in range(0, part.num_rows, 500):
            b = part.slice(at, 500)
            yield pa.RecordBatch.from_arrays([*b.columns, texts.take(pa.array([place[n] for n in named[at : at + 500]]))], names=["id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """For every row: id_col, url_col, text, n_chars."""
    rows = _pages(pages, id_col, url_col, html_col)
    distinct = F.approx_count_distinct("html")
    sizes = rows.groupBy("host").agg(F.ceil(F.greatest(distinct / CHUNK, distinct * F.avg(F.octet_length("html")) / CHUNK_BYTES)).alias("chunks"))
    large = kept(sizes.filter("chunks > 1"))  # a row for each host with hundreds of pages
    chunks = F.coalesce("chunks", F.lit(1).cast("long"))
    chunk = F.coalesce(F.pmod(F.xxhash64("page"), chunks), F.lit(0)).alias("chunk")
    dealt = _parsed(rows).join(large, "host", "left").select("id", "url", F.coalesce("host", F.lit("")).alias("host"), "page", "texts", "kinds", chunks.alias("chunks"), chunk)
    # dealt by hand and by columns that are never null, so that all three uses are of one exchange, and pages are parsed and dealt once
    dealt = dealt.repartition("host", "chunk")
    kind = rows.schema["id"].dataType.simpleString()
    known = dealt.join(_to_chunks(_boilerplate(dealt)).drop("enough_outside", "enough_doubted"), ["host", "chunk"], "left")
    known = known.withColumn("runs", F.when(F.array_contains("kinds", DOUBT), F.col("runs")))
    out = known.groupBy("host", "chunk").applyInArrow(_settled, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
