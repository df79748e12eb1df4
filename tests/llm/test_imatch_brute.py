import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from driftlake.llm import imatch


def signed(x):
    return struct.unpack("<q", struct.pack("<Q", x))[0]


def name(term):
    return signed(xxhash.xxh64_intdigest(term.encode(), 42))


def terms(text):
    return {name(t) for t in re.split(r"[\x20\x09-\x0D]+", text.lower()) if t}


def digits(values):
    out = 0
    for v in values:
        out ^= v & (1 << 64) - 1
    return f"{out:016x}"


def chosen(term, level, seed):
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), xxhash.xxh64_intdigest(struct.pack("<q", term), 42))
    return (h >> 40) & (4**level - 1) == 0


def fingerprint(text, lexicon):
    own = terms(text)
    known = own & lexicon
    subsets = [(level, seed) for level in imatch.LEVELS for seed in range(imatch.SEEDS)]

    def shown(some):
        picked = [[t for t in some if chosen(t, *s)] for s in subsets]
        return [digits(p) if p else "-" for p in picked]

    return ",".join([digits(own), *(shown(known) if len(known) >= imatch.FEW else "-" * len(subsets)), *shown(own)])


def likeness(a, b):
    if a == b:
        return 1.0
    x, y = a.split(",")[1:], b.split(",")[1:]
    width, step = len(x) // 2, imatch.SEEDS
    known = any(h != "-" for h in x[:width]) and any(h != "-" for h in y[:width])
    x, y = (z[:width] if known else z[width:] for z in (x, y))
    value = None
    for k in range(len(imatch.LEVELS)):
        pairs = [p for p in zip(x[k * step : (k + 1) * step], y[k * step : (k + 1) * step]) if p != ("-", "-")]
        if pairs and (k == 0 or 2 * len(pairs) >= step):
            value = sum(p == q for p, q in pairs) / len(pairs)
    return value or 0.0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_against_brute_force(spark, kind):
    rng = random.Random(5)
    vocabulary = [f"Word{i}" for i in range(80)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(90)]
    rows = [(i * 7, t) for i, t in enumerate(texts)] + [(1000 + i, texts[3]) for i in range(20)] + [(14, texts[2]), (2000, None), (2001, "\n")]
    rows = [(str(i).zfill(5) if kind == "string" else i, t) for i, t in rows]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"doc_id {kind}, text string, r int, md5 string").repartition(3)
    distinct = {t or "" for _, t in rows}
    counts = Counter(t for text in distinct for t in terms(text))
    n = len(distinct)
    lexicon = {t for t, c in counts.items() if max(2, imatch.BAND[0] * n) <= c <= max(2, imatch.BAND[1] * n)}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: r[0], reverse=True)
    want = []
    for (i, text), (_, follow) in zip(order, [*order[1:], order[0]]):
        k = len(text) // 3
        edited = text[: len(text) - k] + follow[:k]
        f, e, g = (fingerprint(t, lexicon) for t in (text, edited, follow))
        want.append((i, len(text), f, e, likeness(f, e), likeness(f, g)))
    got = [(r.doc_id, r.n_chars, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in imatch.fingerprints(df).collect()]
    assert sorted(got) == sorted(want)
