"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

A rule is a Boolean Column that is true where a text fails.  ``cascade`` first learns on a sample how long each
rule takes and how often it rejects, then evaluates rules in the order of rejections per second, each only
on texts that the earlier ones let pass (one CASE expression: no shuffle and no further pass).  The order
changes the work, never the verdict: a text is kept if no rule rejects it.

``assess`` shows measures of every text, so rules over these cost next to nothing there and come first; rules that read
the text again (letters, ellipses, bullets) are evaluated on what is left.

Defined cases: a null text has no words and fails the word count; repeated rows are judged alike.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words in repeated 3-word windows
MAX_SYMBOLS = 10  # symbols for 100 words
MAX_DUP_LINES = 50  # per cent of lines
MEAN_WORD = (2, 40)  # code points
MIN_LETTERS = 40  # per cent of words that hold a letter (an ASCII letter or anything beyond ASCII)
MAX_ELLIPSES = 50  # per cent of lines that end in an ellipsis
MAX_BULLETS = 90  # per cent of lines that begin with a bullet
LETTER = r"[A-Za-z]|[^\x00-\x7F]"
ELLIPSIS = r"(\.\.\.|\u2026)[\x20\x09-\x0D]*\z"
BULLET = r"^[\x20\x09-\x0D]*[-*\u2022]"
SAMPLE_ROWS = 1000  # about so many rows make the sample on which costs and rejections are measured
SAMPLE_TASKS = 8


class Rule(NamedTuple):
    name: str
    fails: Column


def once(value: Column, use) -> Column:
    """use(value) with value computed once for a row, however often use mentions it."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def n_symbols(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def n_dup_lines(text: Column) -> Column:
    return once(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows found twice or more.  Windows are sorted by a 64-bit hash and their place, so that equal ones of
    the text come side by side; a run of equal hashes is a repeated window."""

    def covered(starts: Column) -> Column:
        """Words under the windows that start there."""
        step = lambda p: F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(3), F.get(p, i + 1) - x), F.lit(3)))
        return once(F.sort_array(starts), lambda p: F.aggregate(step(p), F.lit(0).cast("long"), lambda a, x: a + x))

    def repeated(s: Column) -> Column:
        twice = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
        return F.filter(F.transform(s, lambda x, k: F.when(twice(x, k), x["i"])), lambda i: i.isNotNull())

    places = F.sequence(F.lit(0), F.size(w) - 3)
    windows = F.transform(places, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.cast("long").alias("i")))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(once(F.sort_array(windows), lambda s: covered(repeated(s))))


def n_repeat_words(text: Column) -> Column:
    return once(words(text), _repeat_words)


def measures(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines)."""
    return F.struct(
        once(
            words(text),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words")),
        ).alias("w"),
        n_symbols(text).alias("n_symbols"),
        once(_lines(text), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )


def _matching(items: Column, pattern: str, fails) -> Column:
    """fails(100 times the items that match, all items)."""
    return once(items, lambda x: fails(F.size(F.filter(x, lambda y: y.rlike(pattern))) * 100, F.size(x)))


def text_rules(text: Column) -> list[Rule]:
    """Rules that read the text itself."""
    return [
        Rule("few_letters", _matching(words(text), LETTER, lambda some, all_: some < all_ * MIN_LETTERS)),
        Rule("ellipses", _matching(_lines(text), ELLIPSIS, lambda some, all_: some > all_ * MAX_ELLIPSES)),
        Rule("bullets", _matching(_lines(text), BULLET, lambda some, all_: some > all_ * MAX_BULLETS)),
    ]


def default_rules(text: Column) -> list[Rule]:
    """Rules over a text column, each computing what it needs itself."""
    n = F.size(words(text))
    chars = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, ""))
    return [
        Rule("few_words", n < MIN_WORDS),
        Rule("symbols", n_symbols(text) * 100 > n * MAX_SYMBOLS),
        Rule("dup_lines", once(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))) * 100 > F.size(x) * MAX_DUP_LINES)),
        Rule("word_length", (chars < n * MEAN_WORD[0]) | (chars > n * MEAN_WORD[1])),
        Rule("repeated_words", once(words(text), lambda w: _repeat_words(w) * 100 > F.size(w) * MAX_REPEATED)),
        *text_rules(text),
    ]


def rules_over_measures() -> list[Rule]:
    """The rules whose measures() are at hand as columns."""
    c = F.col
    return [
        Rule("few_words", c("n_words") < MIN_WORDS),
        Rule("symbols", c("n_symbols") * 100 > c("n_words") * MAX_SYMBOLS),
        Rule("dup_lines", c("n_dup_lines") * 100 > c("n_lines") * MAX_DUP_LINES),
        Rule("word_length", (c("word_chars") < c("n_words") * MEAN_WORD[0]) | (c("word_chars") > c("n_words") * MEAN_WORD[1])),
        Rule("repeated_words", c("n_repeat_words") * 100 > c("n_words") * MAX_REPEATED),
    ]


def planned(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order of rejections per second on a sample of about sample_rows rows, drawn where they are: what it holds
    doesn't grow with docs.  A rule's time is what its job takes beyond one that evaluates no rule."""
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = docs.sample(share, seed=1).repartition(SAMPLE_TASKS).persist()

    def timed(fails: Column) -> tuple[float, int]:
        began = time.perf_counter()
        rejected = sample.agg(F.coalesce(F.sum(F.coalesce(fails, F.lit(False)).cast("int")), F.lit(0))).first()[0]
        return time.perf_counter() - began, rejected

    nothing = F.lit(None).cast("boolean")
    timed(nothing)
    idle = min(timed(nothing)[0] for _ in range(2))
    scored = []
    for rule in rules:
        spent, rejected = min(timed(rule.fails) for _ in range(2))
        scored.append((-(rejected + 0.5) / max(spent - idle, 1e-3), rule))
    sample.unpersist()
    return [rule for _, rule in sorted(scored, key=lambda x: x[0])]


def verdict(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules aren't evaluated."""
    case = F.when(F.coalesce(rules[0].fails, F.lit(False)), F.lit(rules[0].name))
    for rule in rules[1:]:
        case = case.when(F.coalesce(rule.fails, F.lit(False)), F.lit(rule.name))
    return case


def cascade(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS, verdict_col: str = "rejected_by") -> DataFrame:
    """docs with verdict_col: the rule that rejected the row (with several, whichever came first), or null."""
    return docs.withColumn(verdict_col, verdict(planned(docs, rules, sample_rows)))


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that no default rule rejects, with docs' own columns."""
    rules = planned(docs.select(text_col), default_rules(F.col(text_col)))
    return docs.filter(verdict(rules).isNull())


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: its id, the measures, base_failed, kept, and rejected_by."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), measures(F.col(text_col)).alias("m"))
    flat = base.select("_id", "_text", "m.w.n_words", "m.w.word_chars", "m.n_symbols", "m.l.n_dup_lines", "m.w.n_repeat_words", "m.l.n_lines")
    cheap, costly = rules_over_measures(), text_rules(F.col("_text"))
    costly = planned(docs.select(F.col(text_col).alias("_text")), costly)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    return (
        flat.withColumn("rejected_by", verdict([*cheap, *costly]))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & F.col("rejected_by").isNull())
        .drop("_text")
        .withColumnRenamed("_id", id_col)
    )


QUERY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
t3 AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM g),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM t3, (VALUES (0), (1), (2)) v(o) WHERE c > 1 GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
             len(t) - len(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
             len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS lettered,
             len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*\z'))) AS ellipses,
             len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * n_symbols > {MAX_SYMBOLS} * n_words OR 100 * n_dup_lines > {MAX_DUP_LINES} * n_lines
         OR word_chars < {MEAN_WORD[0]} * n_words OR word_chars > {MEAN_WORD[1]} * n_words
         OR 100 * lettered < {MIN_LETTERS} * n_words OR 100 * ellipses > {MAX_ELLIPSES} * n_lines OR 100 * bullets > {MAX_BULLETS} * n_lines) AS kept
FROM f
"""
