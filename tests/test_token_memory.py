"""A batch of text pairs isn't taken apart as a whole."""

import tracemalloc

import pyarrow as pa
from driftlake.operators import textdiff


def test_pairs_are_taken_apart_a_few_at_a_time():
    words = [f"w{i}" for i in range(120)]
    one = pa.array([words[n % 5 :] for n in range(3000)])
    two = pa.array([words[n % 7 :] if n % 9 else None for n in range(3000)])
    tracemalloc.start()
    (got,) = textdiff.token_diff.func(iter([(one, two)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 3000 and got[3].as_py() == dict(zip(("inserted", "removed"), textdiff.word_diff(words[3:], words[3:])))
    assert got[9].as_py() == {"inserted": [], "removed": words[4:]}
    assert peak < 10_000_000
