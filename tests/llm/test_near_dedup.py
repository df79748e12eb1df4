import random
import re

import numpy as np
from driftlake.llm import kernels, near_dedup
import pyarrow as pa


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), d if not s else least.get(find(i)), d == (d if not s else least.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "a b c d"), (7, "a b c e"), (8, "É b c d e"), (9, "é b c d e"), (None, "x y z"), (10, "A b c  d\n")]
    n = 20
    for _ in range(25):
        base = [word() for _ in range(rng.choice([6, 30, 80, 400, 900]))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 18))):
                w[rng.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n, rows[30][1]), (n, rows[30][1]), (n + 1, "w " * 5000)]
    # copies that are all near the base but often not near each other
    base = [word() for _ in range(300)]
    for k in range(40):
        w = list(base)
        for i in rng.sample(range(300), 8):
            w[i] = word()
        rows.append((2000 + k, " ".join(w)))
    rows.append((3000, " ".join(base)))
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, kept string, vid int")
    got = near_dedup.near_duplicates(df).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    gone = {r[0] for r in got if not r[3] and r[0] is not None}
    assert {r[0] for r in kept.collect()} == {d for d, _ in rows} - gone


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for j in (0.0, 0.3, 0.75, 0.9):
        for n in (60, 3000):
            both = int(2 * n * j / (1 + j))
            x = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            regs = near_dedup.registers([np.unique(x[:n]), np.unique(x[n - both :])])
            errors.append(near_dedup.estimate(regs[0], regs[1], float(n), float(n)) - j)
    assert max(map(abs, errors)) < 0.16


def test_words_are_cut_at_ascii_white_space_only():
    texts = ["a\x0bb\x1cc d  e", None, "", "\t", "é x y"]
    data, offsets = kernels.column(pa.array(texts))
    w = kernels.words(data, offsets)
    found = [[bytes(data[s:e]).decode() for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.first, w.first[1:])]
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    wins = kernels.windows(w.hashes, 2)
    assert len(wins) == len(w.hashes) - 1 and kernels.inside(w.first, 2).tolist() == [True, True, False, True]


def thue_morse(n, a="a", b="b"):
    return [(a, b)[bin(i).count("1") % 2] for i in range(n)]


def test_regular_texts_do_not_collide(spark):
    one, other = "".join(thue_morse(1024)), "".join(thue_morse(1024, "b", "a"))
    rows = [(1, one), (2, other), (3, " ".join(thue_morse(64, "x", "y"))), (4, " ".join(thue_morse(64, "y", "x")))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    data, offsets = kernels.column(pa.array([r[1] for r in rows]))
    w = kernels.words(data, offsets)
    assert len(set(w.hashes.tolist())) == 4
    for k in (2, 8, 32):
        seen = {}
        texts = [bytes(data[s:e]) for s, e in zip(w.starts, w.ends)]
        for i, h in enumerate(kernels.windows(w.hashes, k).tolist()):
            seen.setdefault(h, set()).add(tuple(texts[i : i + k]))
        assert all(len(v) == 1 for v in seen.values())


def test_links_grow_with_the_members(spark, monkeypatch):
    """Near copies of one text that isn't there itself: mostly too far from each other to be linked."""
    rng, counts = random.Random(7), []
    inner = near_dedup.components
    monkeypatch.setattr(near_dedup, "components", lambda edges: counts.append(edges.count()) or inner(edges))
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]

    def family(n):
        for i in range(n):
            w = list(base)
            for k in rng.sample(range(120), 4):
                w[k] = f"n{rng.randrange(10**6)}"
            yield i, " ".join(w)

    most = {}
    for n in (300, 1500):
        counts.clear()
        near_dedup.near_duplicates(spark.createDataFrame(list(family(n)), "doc_id long, text string")).count()
        most[n] = max(counts)
    assert most[1500] <= 6 * most[300] and most[1500] <= 4 * 1500


def test_keep_one_knows_rows_by_id_and_text(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(3, a, 1), (5, a, 1), (5, b, 1), (None, b, 1), (None, "x y", 1), (None, "x y", 1), (None, None, 1), (None, "", 1), (7, "z", 1), (7, "z", 1)]
    got = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _near_x int")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, a, 1), (5, b, 1), (None, "x y", 1), (None, None, 1), (None, "", 1), (7, "z", 1)], key=str)
