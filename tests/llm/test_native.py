"""I-Match, mixing, sharding, quality rules and WARC against plain Python, with nulls, ties, repeats and odd columns."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import compare
import pytest
from driftlake.llm import imatch, mixing, quality_rules, queries, sharding, warc

SF = "/root/testdata/sf0.001"
LONG = "alpha beta gamma delta " * 5000
ROWS = [(i, f"word{i % 7} " * (i % 60) + f"end{i % 11}\nline\nline\n", ["de", "en", None][i % 3], ["web", "books", "code", None, "news"][i % 5]) for i in range(120)]
ROWS += [(200, None, "en", "web"), (201, "", None, None), (202, LONG, "en", "web"), (203, LONG, "fr", "books"), (5, ROWS[5][1], "de", "web"), (5, ROWS[5][1], "de", "web"), (None, "no id at all", "en", "web")]


@pytest.fixture(scope="module")
def docs(spark):
    odd = ", size long, n long, term string, r int, shard int, kept boolean"  # names that the operators use themselves
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4, True) for r in ROWS], "doc_id long, text string, lang string, source string" + odd)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_oracles(spark):
    for name in ("op7_mix_sources", "op9_quality_rules"):
        assert compare.differences(spark, name, queries.QUERIES[name], queries.ORACLE[name], SF) == ""


def test_empty_tables(docs):
    none = docs.filter("false")
    for f in (imatch.fingerprints, mixing.mix, mixing.mixed, sharding.shard, quality_rules.assess, quality_rules.keep):
        assert f(none).count() == 0


def test_imatch_texts_and_likeness(docs):
    got = rows(imatch.fingerprints(docs))
    assert Counter(g["doc_id"] for g in got) == Counter(r[0] for r in ROWS)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    expected = defaultdict(list)
    for (i, text, *_), follow in zip(order, [*order[1:], order[0]]):
        t, u = text or "", follow[1] or ""
        k = len(t) // 3
        expected[i].append((len(t), hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest()))
    found = defaultdict(list)
    for g in got:
        found[g["doc_id"]].append((g["n_chars"], g["edited_sha256"]))
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
        if g["fingerprint"] == g["edited_fingerprint"]:
            assert g["near_edited"] == 1
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    prints = defaultdict(set)
    text_of = {r[0]: r[1] or "" for r in ROWS}
    for g in got:
        prints[text_of[g["doc_id"]]].add(g["fingerprint"])
    assert all(len(v) == 1 for v in prints.values())


def test_imatch_tells_copies_apart(spark):
    got = rows(imatch.fingerprints(spark.read.parquet(f"{SF}/documents.parquet")))
    long = [g for g in got if g["n_chars"] > 600]
    near, far = [g["near_edited"] for g in long], [g["near_next"] for g in long]
    assert sum(near) > 2 * sum(far)


def test_mixing(docs):
    got = rows(mixing.mix(docs))
    assert len(got) == len(ROWS)
    sizes = Counter()
    for _, text, _, source in ROWS:
        sizes[source] += len(words(text))
    by_size = defaultdict(lambda: [0.0, 0])
    for g in got:
        assert 0 <= g["taken"] <= 3 * g["size"]
        by_size[g["source_size"]][0] = g["target"]
        by_size[g["source_size"]][1] += g["taken"]
    assert set(by_size) == set(sizes.values())
    assert math.isclose(sum(t for t, _ in by_size.values()), sum(sizes.values()), rel_tol=1e-9)
    assert all(t <= 3 * n + 1e-6 and abs(t - taken) <= 0.02 * t + 5 for n, (t, taken) in by_size.items())
    assert sorted(map(str, got)) == sorted(map(str, rows(mixing.mix(docs.repartition(7)))))


def test_mixed_draws_what_mix_takes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = {r["doc_id"]: r["taken"] for r in rows(mixing.mix(docs))}
    drawn = Counter()
    for r in mixing.mixed(docs).select("doc_id", "text").collect():
        drawn[r[0]] += len(words(r[1]))
    assert {k: v for k, v in taken.items() if v} == dict(drawn)


def test_sharding(docs):
    got = rows(sharding.shard(docs))
    text_of = {r[0]: r[1] or "" for r in ROWS}
    assert Counter(g["doc_id"] for g in got) == Counter(r[0] for r in ROWS)
    slots = defaultdict(list)
    for g in got:
        t = text_of[g["doc_id"]].encode()
        assert (g["size"], g["text_crc32"], g["law"], g["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        slots[g["shard"]].append(g["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(8))


def test_shards_of_documents_are_near_equal(spark):
    got = rows(sharding.shard(spark.read.parquet(f"{SF}/documents.parquet")))
    sums, largest = Counter(), max(g["size"] for g in got)
    for g in got:
        sums[g["shard"]] += g["size"]
    mean = sum(sums.values()) / 8
    assert len(sums) == 8 and all(abs(v - mean) <= 2 * largest for v in sums.values())


def test_hilbert_neighbours():
    cells = {sharding.hilbert_index((x, y, z), 2): (x, y, z) for x in range(4) for y in range(4) for z in range(4)}
    assert sorted(cells) == list(range(64))
    assert all(sum(abs(a - b) for a, b in zip(cells[i], cells[i + 1])) == 1 for i in range(63))


def test_quality_measures(docs):
    for g in rows(quality_rules.assess(docs)):
        text = next((r[1] for r in ROWS if r[0] == g["doc_id"]), None) or ""
        w = words(text)
        seen = Counter(zip(w, w[1:], w[2:]))
        again = {i + o for i, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for o in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        assert (g["n_words"], g["word_chars"], g["n_repeat_words"], g["n_dup_lines"]) == (len(w), sum(map(len, w)), len(again), len(lines) - len(set(lines)))
        assert g["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (g["base_failed"] and g["kept"])


def test_warc_round_trip(spark, tmp_path):
    html = [("a" * i if i % 4 else None) for i in range(30)] + ["é<p>", "é<p>", ""]
    pages = spark.createDataFrame([(i, None if i % 9 == 0 else f"http://h/{i} x", h, "z") for i, h in enumerate(html)], "page_id long, url string, html string, payload string")
    got = {r["page_id"]: r.asDict() for r in warc.round_trip(pages, path=str(tmp_path / "w")).collect()}
    first = {}
    for i, h in enumerate(html):
        first.setdefault(h or "", i)
    assert set(got) == set(range(len(html)))
    for i, h in enumerate(html):
        data, own = (h or "").encode(), first[h or ""] == i
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if own else ("revisit", first[h or ""]))
        assert not own or bytes(got[i]["payload"]) == data


def test_warc_predicates_reach_the_reader(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "same" if i % 2 else f"own {i}") for i in range(10)], "page_id long, url string, html string")
    warc.archive(pages, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    assert back.filter("warc_type = 'revisit'").count() == 4
    assert [r[0] for r in back.filter("target_uri = 'http://h/4'").select("payload_length").collect()] == [5]
    assert warc.read_warc(spark, str(tmp_path / "w"), payload=False).filter("payload IS NOT NULL").count() == 0


def test_warc_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none, path=str(tmp_path / "none")).count() == 0


def test_warc_reads_wanted_members_alone(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"own {i} " * 50) for i in range(20)], "page_id long, url string, html string").coalesce(2)
    path = tmp_path / "w"
    warc.archive(pages, str(path))
    archives = sorted(p for p in path.iterdir() if p.name.endswith(".warc.gz"))
    assert all((path / (p.name + warc.INDEX)).exists() for p in archives)
    back = {r.target_uri: bytes(r.payload) for r in warc.read_warc(spark, str(path)).collect()}
    assert back == {f"http://h/{i}": (f"own {i} " * 50).encode() for i in range(20)}
    for p in archives:  # what isn't asked for may even be broken
        p.write_bytes(b"\0" * p.stat().st_size)
    assert warc.read_warc(spark, str(path), payload=False).filter("target_uri = 'http://h/4'").count() == 1
    assert warc.read_warc(spark, str(path)).filter("warc_type = 'revisit'").count() == 0


def test_warc_without_an_index(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h/1", "a" * 300_000), (1, "http://h/1", "b"), (None, None, "b")], "page_id long, url string, html string")
    warc.archive(pages, str(tmp_path / "w"))
    for p in (tmp_path / "w").glob("*.idx"):
        p.unlink()
    back = warc.read_warc(spark, str(tmp_path / "w"))
    assert back.count() == 3 and back.filter("length(payload) = 300000").count() == 1
