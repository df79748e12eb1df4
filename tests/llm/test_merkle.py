import random
import zlib
from hashlib import sha256

import compare
import pytest
from driftlake.llm import merkle, queries


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.FIELDS])


def tree(leaves):
    """The root, and for each leaf its runs of siblings with its place, from below."""
    paths, groups = [[] for _ in leaves], [[i] for i in range(len(leaves))]
    while len(leaves) > 1:
        above, merged = [], []
        for k in range(0, len(leaves), 16):
            run = leaves[k : k + 16]
            for place, group in enumerate(groups[k : k + 16]):
                for i in group:
                    paths[i].append((run, place))
            above.append(h(*run))
            merged.append([i for g in groups[k : k + 16] for i in g])
        leaves, groups = above, merged
    return leaves[0], paths


def brute(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        by.setdefault(r["source"], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    grown = [tree([leaf(r) for r in by[s]]) for s in sources]
    root, over = tree([g[0] for g in grown])
    for s, (subroot, paths), top in zip(sources, grown, over):
        for r, path in zip(by[s], paths):
            t = r["text"]
            if t and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
            end = leaf(r | {"text": t})
            for run, place in path + top:
                end = h(*run[:place], end, *run[place + 1 :])
            proof = h(*[d for run, place in path + top for i, d in enumerate(run) if i != place])
            yield r["doc_id"], leaf(r), subroot, root, proof, end, end == root


def rows_of(shape, seed=1):
    rng, out = random.Random(seed), []
    for source, n in shape.items():
        for _ in range(n):
            out.append({"doc_id": len(out) * 7, "source": source, "lang": rng.choice(["en", None]), "n_chars": rng.choice([None, 5]), "text": rng.choice([None, "", "abc", "Größe X", "ÄB" * 50])})
    rng.shuffle(out)
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("shape", [{"a": 1}, {"a": 16}, {"a": 17}, {"a": 700, None: 3, "": 1, "Z": 15, "é": 33}, {f"s{i}": 1 + i % 3 for i in range(300)}], ids=str)
def test_equals_brute_force(spark, shape, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS", 40)  # many ranges, so that frontiers are shuffled
    rows = rows_of(shape)
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_ties_nulls_and_other_columns(spark):
    rows = rows_of({"a": 40, None: 20})
    rows += [rows[0], rows[0], rows[1] | {"text": "other"}, rows[2] | {"doc_id": None}, rows[3] | {"doc_id": None}]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as leaf", "2 as part", "3 as tree")
    key = lambda r: str(tuple(r))
    got = merkle.manifest(df, siblings=True)
    assert sorted(map(tuple, got.drop("siblings").collect()), key=key) == sorted(brute(rows), key=key)
    assert all(sha256(r["siblings"].encode()).hexdigest() == r["proof_sha256"] for r in got.collect())
    assert merkle.manifest(df.limit(0)).collect() == []


def test_sql(spark):
    assert compare.differences(spark, "op12_merkle", queries.op12_merkle, merkle.QUERY_SQL, "/root/testdata/sf0.001") == ""
