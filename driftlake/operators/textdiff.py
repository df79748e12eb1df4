"""Differences of short texts, word by word."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Words that describe a picture rather than stand in it.
FILLER = """the a an is are was were be this that these those it its there here and or but of in on at to with within against around
surrounding into from by for as no not other some also another word words text letter letters character characters number
numbers digit digits phrase label title written writes reads read says displayed displays display shows show showing
shown appears appear reading prominently visible positioned located white black blue red green purple gray grey
background foreground color colors colored colour font style styled bold italic blurred slightly image photo picture
frame scene object objects element elements ui screen page logo icon button large small big left right top bottom
center corner side above below ink company name brand create creating artistic effect design additional""".split()
QUOTED = "[\"“”']([^\"“”']+)[\"“”']"
LONGEST_SHOWN = 60
TABLE = 1 << 20  # common lengths that are held at once
PAIRS = 64  # pairs of texts that are taken apart at once
DIFF = StructType([StructField("inserted", ArrayType(StringType())), StructField("removed", ArrayType(StringType()))])


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def quoted(text: Column) -> Column:
    """The longest quoted span, the first of equally long ones; null without one."""
    spans = F.transform(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)), lambda s: F.regexp_replace(s, "^\\s+|\\s+$", ""))
    best = F.aggregate(spans, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    return F.nullif(best, F.lit(""))


def telling(words: Column) -> Column:
    """Words with a digit, and those that aren't filler."""
    return F.filter(words, lambda w: w.rlike("[0-9]") | ~w.isin(FILLER))


def _lengths(a: np.ndarray, b: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The row of common lengths of a and every rest of b, from the row below a (edge)."""
    m, row = len(b), edge
    for v in a[::-1]:
        step = np.maximum(row[:m], np.where(b == v, row[1:] + 1, 0))
        row = np.append(np.maximum.accumulate(step[::-1])[::-1], 0).astype(np.int32)
    return row


def _walk(a: np.ndarray, b: np.ndarray, i: int, j: int, edge: np.ndarray, took: np.ndarray, put: np.ndarray) -> int:
    """Goes from (i, j) down through the words of a, and returns the place in b where it leaves them; edge is the row of common lengths below a.

    A table of few words is made whole.  Of a larger one the row in the middle is made, the upper half is walked with it as its edge, and
    then the lower half from there, so memory goes with the lengths, and not with their product.  took and put mark the words removed and
    inserted."""
    n, m = len(a), len(b) - j
    if n > 1 and (n + 1) * (m + 1) > TABLE:
        half = n // 2
        at = _walk(a[:half], b, i, j, np.append(edge[:j], _lengths(a[half:], b[j:], edge[j:])), took, put)
        return _walk(a[half:], b, i + half, at, edge, took, put)
    rest = b[j:]
    best = np.empty((n + 1, m + 1), np.int32)
    best[n] = edge[j:]
    for k in range(n - 1, -1, -1):
        best[k] = _lengths(a[k : k + 1], rest, best[k + 1])
    k = l = 0
    while k < n and l < m:
        if a[k] == rest[l]:
            k, l = k + 1, l + 1
        elif best[k + 1, l] >= best[k, l + 1]:
            took[i + k] = True
            k += 1
        else:
            put[j + l] = True
            l += 1
    took[i + k : i + n] = True
    return j + l


def word_diff(base: list[str], other: list[str]) -> tuple[list[str], list[str]]:
    """(inserted, removed) along a longest common subsequence; where two are as long, words are removed first."""
    number = {w: i for i, w in enumerate(dict.fromkeys([*base, *other]))}
    a, b = np.array([number[w] for w in base], np.int32), np.array([number[w] for w in other], np.int32)
    took, put = np.zeros(len(a), bool), np.zeros(len(b), bool)
    end = _walk(a, b, 0, 0, np.zeros(len(b) + 1, np.int32), took, put)
    put[end:] = True
    return [other[i] for i in np.flatnonzero(put)], [base[i] for i in np.flatnonzero(took)]


@F.arrow_udf(DIFF)
def token_diff(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of two arrays of words; a null counts as empty.  Memory goes with a pair's lengths, time with their product: of a batch only PAIRS
    pairs are Python objects at a time."""
    words = pa.list_(pa.string())
    for base, other in parts:
        out = []
        for at in range(0, len(base), PAIRS):
            rows = [word_diff(x or [], y or []) for x, y in zip(base.slice(at, PAIRS).to_pylist(), other.slice(at, PAIRS).to_pylist())]
            out.append(pa.StructArray.from_arrays([pa.array([r[k] for r in rows], words) for k in (0, 1)], names=["inserted", "removed"]))
        yield pa.concat_arrays(out) if out else pa.array([], pa.struct([("inserted", words), ("removed", words)]))


def describe(df: DataFrame, base: str, other: str, change: str) -> DataFrame:
    """Adds `described`: what a region's text became.  Quoted spans are compared where both sides have one."""
    one, two = quoted(F.col(base)), quoted(F.col(other))
    df = df.withColumn("_q1", one).withColumn("_q2", two)
    df = df.withColumn("_d", token_diff(tokens(F.coalesce("_q1", F.col(base))), tokens(F.coalesce("_q2", F.col(other)))))
    clean = F.col("_q1").isNotNull() & F.col("_q2").isNotNull()
    ins = F.when(clean, F.col("_d.inserted")).otherwise(telling(F.col("_d.inserted")))
    rem = F.when(clean, F.col("_d.removed")).otherwise(telling(F.col("_d.removed")))
    now = F.when(F.length("_q2") <= LONGEST_SHOWN, F.concat(F.lit(' (region now reads "'), F.col("_q2"), F.lit('")'))).otherwise("")
    q = lambda w: F.concat(F.lit('"'), F.array_join(w, " "), F.lit('"'))
    more, less = F.size(ins) > 0, F.size(rem) > 0
    said = (
        F.when(more & ~less, F.concat(F.lit("added "), q(ins)))
        .when(less & ~more, F.concat(F.lit("removed "), q(rem)))
        .when(more & less, F.concat(F.lit("replaced "), q(rem), F.lit(" with "), q(ins)))
        .otherwise(F.concat(F.replace(F.col(change), F.lit("-"), F.lit(" ")), F.lit(" with no readable text change")))
    )
    return df.withColumn("described", F.concat(said, now)).drop("_q1", "_q2", "_d")
