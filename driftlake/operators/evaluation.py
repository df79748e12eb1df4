"""Evaluation of detections and metrics: box matching, confusion, F-scores, gates, rank correlation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.sources.scratch import kept

TYPES = ("content-change", "addition", "deletion", "shift", "color-change", "rendering-noise")
IOU = 0.3


def overlap(a: str, b: str) -> tuple[Column, Column]:
    """Width and height (0 or less without overlap) that boxes a and b (structs x, y, width, height) share."""
    side = lambda p, n: F.least(F.col(f"{a}.{p}") + F.col(f"{a}.{n}"), F.col(f"{b}.{p}") + F.col(f"{b}.{n}")) - F.greatest(F.col(f"{a}.{p}"), F.col(f"{b}.{p}"))
    return side("x", "width"), side("y", "height")


def iou(a: str, b: str) -> Column:
    w, h = overlap(a, b)
    both = (w * h).cast("double")
    area = lambda s: (F.col(f"{s}.width") * F.col(f"{s}.height")).cast("double")
    return F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise(both / (area(a) + area(b) - both))


def iou_pairs(truth: DataFrame, found: DataFrame, threshold: float = IOU) -> DataFrame:
    """(case, truth_id, found_id, same, iou) of the boxes of a case that overlap enough.  Inputs: (case, id, type, box)."""
    t = truth.select("case", F.col("id").alias("truth_id"), F.col("type").alias("tt"), F.col("box").alias("tb"))
    p = found.select("case", F.col("id").alias("found_id"), F.col("type").alias("pt"), F.col("box").alias("pb"))
    w, h = overlap("tb", "pb")
    both = t.join(p, "case").filter((w > 0) & (h > 0)).select("case", "truth_id", "found_id", (F.col("tt") == F.col("pt")).alias("same"), iou("tb", "pb").alias("iou"))
    return both.filter(F.col("iou") >= threshold)


def _greedy(pairs: pd.DataFrame) -> pd.DataFrame:
    kept, truths, founds = [], set(), set()
    for row in pairs.sort_values(["same", "iou", "truth_id", "found_id"], ascending=[False, False, True, True], kind="stable").itertuples(index=False):
        if row.truth_id not in truths and row.found_id not in founds:
            truths.add(row.truth_id)
            founds.add(row.found_id)
            kept.append(row)
    return pd.DataFrame(kept, columns=pairs.columns)


def match(pairs: DataFrame) -> DataFrame:
    """One-to-one matches of a case, best first: same type before any other, then by IoU, then by ids.  A group holds the boxes of
    one image."""
    return pairs.groupBy("case").applyInPandas(_greedy, pairs.schema)


def match_cases(truth: DataFrame, found: DataFrame, threshold: float = IOU) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, missed, extra).  A truth box with expected=false that nothing overlaps counts as rightly found (found_id null)."""
    pairs = iou_pairs(truth, found, threshold)
    hit = pairs.select("case", F.col("truth_id").alias("id")).distinct()
    absent = truth.filter("NOT expected").join(hit, ["case", "id"], "left_anti")
    got = match(pairs)
    rightly = absent.select("case", F.col("id").alias("truth_id"), F.lit(None).cast(got.schema["found_id"].dataType).alias("found_id"), F.lit(True).alias("same"), F.lit(1.0).alias("iou"))
    matched = got.unionByName(rightly)
    missed = truth.join(matched.select("case", F.col("truth_id").alias("id")), ["case", "id"], "left_anti")
    extra = found.join(got.select("case", F.col("found_id").alias("id")), ["case", "id"], "left_anti")
    return matched, missed, extra


def confusion(pairs: DataFrame, types: Sequence[str] = TYPES) -> DataFrame:
    """Pivot of (actual, predicted): a row for each actual type, a column for each predicted one and for what was missed."""
    p = pairs.filter("actual IS NOT NULL").withColumn("predicted", F.coalesce("predicted", F.lit("missed")))
    return p.groupBy("actual").pivot("predicted", [*types, "missed"]).count().na.fill(0)


def class_scores(pairs: DataFrame) -> DataFrame:
    """(type, precision, recall, f1, support) of (actual, predicted); null predicted: missed, null actual: a false alarm."""
    each = pairs.select(F.explode(F.array(F.struct(F.col("actual").alias("type"), F.lit(1).alias("a"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("type"), F.lit(0).alias("a"), F.lit(1).alias("p")))).alias("v"), (F.col("actual") == F.col("predicted")).alias("right"))
    sums = each.filter("v.type IS NOT NULL").groupBy("v.type").agg(F.sum("v.a").alias("support"), F.sum("v.p").alias("claimed"), F.sum(F.when(F.col("right"), F.col("v.a")).otherwise(0)).alias("right"))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    out = sums.select("type", ratio(F.col("right"), F.col("claimed")).alias("precision"), ratio(F.col("right"), F.col("support")).alias("recall"), "support")
    both = F.col("precision") + F.col("recall")
    return out.select("type", "precision", "recall", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / both).alias("f1"), "support")


def averaged_f1(scores: DataFrame) -> DataFrame:
    """One row: macro_f1 over types with support, weighted_f1."""
    macro = F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0))
    weighted = F.when(F.sum("support") > 0, F.sum(F.col("f1") * F.col("support")) / F.sum("support")).otherwise(0.0)
    return scores.agg(macro.alias("macro_f1"), weighted.alias("weighted_f1"))


def worst_confusions(pairs: DataFrame, n: int) -> DataFrame:
    wrong = pairs.filter("actual <> predicted").groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    return wrong.orderBy(F.col("n").desc(), "actual", "predicted").limit(n)


def gates(scores: DataFrame, baseline: DataFrame, floors: DataFrame, macro_floor: float | None = None, max_macro_drop: float | None = None) -> DataFrame:
    """One row: passed, reasons (sorted), macro_delta.  floors: (type, floor, max_drop), either null where there is none."""
    now = scores.select("type", "f1").join(floors, "type", "left").join(baseline.select("type", F.col("f1").alias("before")), "type", "left")
    low = F.when(F.col("f1") < F.col("floor"), F.format_string("%s F1 %.3f fell below floor %.3f", "type", "f1", "floor"))
    drop = F.when(F.col("before") - F.col("f1") > F.col("max_drop"), F.format_string("%s F1 drop %.3f exceeded tolerance %.3f", F.col("type"), F.col("before") - F.col("f1"), F.col("max_drop")))
    each = now.select(F.explode(F.filter(F.array(low, drop), lambda x: x.isNotNull())).alias("reason"))
    m, b = averaged_f1(scores).select(F.col("macro_f1").alias("now")), averaged_f1(baseline).select(F.col("macro_f1").alias("then"))
    both = m.join(b, F.lit(True))  # one row each
    total = [F.lit(None).cast("string")]
    if macro_floor is not None:
        total.append(F.when(F.col("now") < macro_floor, F.format_string("macro F1 %.3f fell below floor %.3f", F.col("now"), F.lit(macro_floor))))
    if max_macro_drop is not None:
        total.append(F.when(F.col("then") - F.col("now") > max_macro_drop, F.format_string("macro F1 drop %.3f exceeded tolerance %.3f", F.col("then") - F.col("now"), F.lit(max_macro_drop))))
    listed = each.agg(F.sort_array(F.collect_list("reason")).alias("types"))  # two for each type at most
    out = both.join(listed, F.lit(True)).withColumn("reasons", F.sort_array(F.concat("types", F.filter(F.array(*total), lambda x: x.isNotNull()))))
    return out.select((F.size("reasons") == 0).alias("passed"), F.array_join("reasons", "; ").alias("reasons"), (F.col("now") - F.col("then")).alias("macro_delta"))


BLOCK, BLOCKS = 50_000, 1000  # rows of a range, and how many ranges there are at most: their square bounds the table of pairs of ranges
TASK_ROWS = 250_000  # that one task counts by value


def _ranges(n: int) -> int:
    return max(1, min(BLOCKS, -(-n // BLOCK)))


def _dealt(cells: DataFrame, group: str, order: list[str], ranges: int, part: str, turned: list[str] | None = None) -> DataFrame:
    """Cells (group, order, c, ...) in `ranges` ranges of (group, order), numbered by `part`, one to a task.  Adds of the range's cells of the same group
    the weight of those with a smaller order[0] (below) and with the same (same); and, if `turned` names columns to sort by and then one of values, on
    one cell of each group in the range, the weight of pairs of which the earlier has the greater value (down).

    A task sorts its own range, so its memory goes with BLOCK until there are BLOCKS ranges."""
    added = pa.schema([("below", pa.int64()), ("same", pa.int64()), ("down", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in [group, *order]])

        def coded(t: pa.Table) -> tuple[np.ndarray, int]:
            names = t.column(group).combine_chunks().dictionary_encode()
            return np.asarray(names.indices).astype(np.int64), len(names.dictionary)

        (at, n), v, w = coded(t), t.column(order[0]).to_numpy(), t.column("c").to_numpy()
        new = np.append(True, at[1:] != at[:-1])
        heads = np.flatnonzero(new | np.append(True, v[1:] != v[:-1]))
        sizes = np.diff(np.append(heads, len(v)))
        before = np.cumsum(w) - w
        below = np.repeat(before[heads], sizes) - before[np.flatnonzero(new)][np.cumsum(new) - 1]
        down = np.zeros(len(v), np.int64)
        if turned:
            other = t.sort_by([(c, "ascending") for c in [group, *turned]])  # groups in the same order
            down[new] = inversions(coded(other)[0], other.column(turned[-1]).to_numpy(), other.column("c").to_numpy(), n)
        columns = [*t.columns, *map(pa.array, (below, np.repeat(np.add.reduceat(w, heads), sizes), down))]
        yield from pa.table(columns, names=[*t.column_names, *added.names]).combine_chunks().to_batches()

    ranged = cells.repartitionByRange(ranges, group, *order).withColumn(part, F.spark_partition_id())
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema] + [f"{n} long" for n in added.names])
    return kept(ranged.mapInArrow(run, kinds))


def _placed(dealt: DataFrame, group: str, value: str, part: str, name: str) -> DataFrame:
    """Adds to cells that are dealt by (group, value) the rank of their value (name) and the weight of all cells with it (name_n).

    Only the least and the greatest value of a range may lie in other ranges too; their places come from a table of ranges."""
    per = dealt.groupBy(group, part).agg(F.sum("c").alias("t"), *[f(value).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))], F.min_by("same", value).alias("lo_n"), F.max_by("same", value).alias("hi_n"))
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    per = kept(per.withColumn("start", F.coalesce(F.sum("t").over(earlier), F.lit(0))))
    low = per.select(group, F.col("lo").alias("v"), F.col("start").alias("s"), F.col("lo_n").alias("n"))
    high = per.filter("lo <> hi").select(group, F.col("hi").alias("v"), (F.col("start") + F.col("t") - F.col("hi_n")).alias("s"), F.col("hi_n").alias("n"))
    ends = low.union(high).groupBy(group, "v").agg(F.min("s").alias("s"), F.sum("n").alias("n"))
    for end in ("lo", "hi"):
        per = per.drop(f"{end}_n").join(ends.select(group, F.col("v").alias(end), F.col("s").alias(f"{end}_s"), F.col("n").alias(f"{end}_n")), [group, end])
    per = kept(per.drop("t"))
    of = lambda end, inside: F.when(F.col(value) == F.col("lo"), F.col(f"lo_{end}")).when(F.col(value) == F.col("hi"), F.col(f"hi_{end}")).otherwise(inside)
    out = dealt.join(per, [group, part]).withColumn(f"{name}_n", of("n", F.col("same"))).withColumn(name, of("s", F.col("start") + F.col("below")) + (F.col(f"{name}_n") + 1) / 2)
    return out.select(*dealt.columns, name, f"{name}_n")


def ranked(df: DataFrame, value: str, name: str, group: str | None = None) -> DataFrame:
    """Adds ranks from 1; equal values share their mean rank.

    Counts by value are sorted over ranges: a rank is what lies in ranges before plus a running sum within the range, so neither a value's
    rows nor a group's values meet in one task."""
    keys = [group] if group else []
    by = group or "_all"
    counts = kept(df.groupBy(*keys or [F.lit(0).alias(by)], value).agg(F.count("*").alias("c")))
    places = _placed(_dealt(counts, by, [value], _ranges(counts.count()), "_part"), by, value, "_part", "_rank")
    return df.join(places.select(*keys, value, F.col("_rank").alias(name)), [*keys, value])


def inversions(groups: np.ndarray, values: np.ndarray, weights: np.ndarray, n_groups: int) -> np.ndarray:
    """For each group the weight of pairs of its elements of which the earlier has the greater value.

    Bit by bit of the values' ranks, the highest first: among elements that agree in the higher bits, a set bit before a clear one is such a pair."""
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    bits = int(rank.max()).bit_length() if len(rank) else 0
    total = np.zeros(n_groups, np.int64)
    for bit in range(bits - 1, -1, -1):
        prefix = groups.astype(np.int64) << (bits - bit - 1) | rank >> (bit + 1)
        order = np.argsort(prefix, kind="stable")
        p, w, one = prefix[order], weights[order], (rank[order] >> bit & 1).astype(bool)
        heavy = np.cumsum(w * one)
        head = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        start = np.repeat(np.concatenate(([0], heavy[head[1:] - 1])), np.diff(np.append(head, len(p))))
        np.add.at(total, groups[order][~one], (w * (heavy - start))[~one])
    return total


def _between(group: str):
    """For one group's weights by two kinds of ranges (pa, pb), the weight of pairs of cells in an earlier range of one and a later of the other."""

    def run(t: pa.Table) -> pa.Table:
        p, k = (np.unique(t.column(c).to_numpy(), return_inverse=True)[1] for c in ("pa", "pb"))
        table = np.zeros((p.max() + 1, k.max() + 1), np.int64)
        table[p, k] = t.column("c").to_numpy()
        before = np.zeros_like(table)  # of earlier ranges by a and later ones by b
        before[1:, :-1] = table.cumsum(0)[:-1, ::-1].cumsum(1)[:, ::-1][:, 1:]
        down = Decimal(sum(int((x * y).sum()) for x, y in zip(table, before)))
        return pa.table({group: t.column(group).slice(0, 1), "apart": pa.array([down], pa.decimal128(38, 0))})

    return run


def _counted(rows: DataFrame, group: str, n: int) -> DataFrame:
    """(group, a, b, c): how often each pair of values occurs among n rows.  Batches are counted first, so a frequent pair isn't sent row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = pa.Table.from_batches([b]).group_by([group, "a", "b"]).aggregate([([], "count_all")])
                yield from got.select([group, "a", "b", "count_all"]).rename_columns([group, "a", "b", "c"]).combine_chunks().to_batches()

    kind = f"`{group}` {rows.schema[group].dataType.simpleString()}"
    parts = rows.select(group, "a", "b").mapInArrow(run, f"{kind}, a double, b double, c long")
    return kept(parts.repartition(max(1, -(-n // TASK_ROWS)), group, "a", "b").groupBy(group, "a", "b").agg(F.sum("c").alias("c")))


def correlations(df: DataFrame, a: str, b: str, group: str) -> DataFrame:
    """(group, n, pearson, spearman, kendall) over rows in which both values are finite, for groups of 3 or more; NaN where a side is constant.

    Rows become cells (a, b) with counts, which are cut into ranges of (a, b) and then into ranges of (b, a), with as many ranges as their number asks for.
    Ranks, ties and Kendall's discordant pairs come from them, and no rows are paired: pairs in one range of the former, and those in one of
    the latter but in two of the former, are counted within a task; pairs in different ranges of both come from the table of
    weights by both ranges, which holds BLOCKS squared numbers a group at most."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    zero = lambda c: F.col(c).cast("double") + 0.0  # noqa: E731  not -0
    rows = df.select(group, zero(a).alias("a"), zero(b).alias("b")).filter(fine("a") & fine("b") & F.col(group).isNotNull())
    varies = F.least(*[F.max(c) > F.min(c) for c in ("a", "b")]).alias("varies")
    sizes = kept(rows.groupBy(group).agg(F.count("*").alias("n"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), varies).filter("n >= 3"))
    cells = _counted(rows.join(sizes.select(group), group, "left_semi"), group, sizes.agg(F.sum("n")).first()[0] or 0)
    ranges = _ranges(cells.count())
    one = _placed(_dealt(cells, group, ["a", "b"], ranges, "pa", ["a", "b"]), group, "a", "pa", "ra").drop("below", "same").withColumnRenamed("down", "down_a")
    two = kept(_placed(_dealt(one, group, ["b", "a"], ranges, "pb", ["pa", "b"]), group, "b", "pb", "rb"))
    mean = (F.col("n") + 1) / 2
    sides = {"p": (F.col("a") - F.col("ma"), F.col("b") - F.col("mb")), "s": (F.col("ra") - mean, F.col("rb") - mean)}
    sums = [F.sum(F.col("c") * x * y).alias(k + m) for k, (v, w) in sides.items() for m, x, y in (("xy", v, w), ("xx", v, v), ("yy", w, w))]
    whole = lambda c, name: F.sum(c.cast("decimal(38,0)")).alias(name)
    tied = lambda n, name: whole(F.col("c") * (F.col(n) - 1), name)  # noqa: E731  twice the pairs
    per = two.join(sizes, group).groupBy(group).agg(F.first("n").alias("n"), F.first("varies").alias("varies"), *sums, tied("ra_n", "ta"), tied("rb_n", "tb"), tied("c", "tab"), whole(F.col("down_a") + F.col("down"), "near"))
    kind = f"`{group}` {df.schema[group].dataType.simpleString()}, apart decimal(38,0)"
    apart = two.groupBy(group, "pa", "pb").agg(F.sum("c").alias("c")).groupBy(group).applyInArrow(_between(group), kind)
    out = per.join(apart, group)
    nan = F.lit(float("nan"))
    corr = lambda k: F.when(F.col("varies"), F.coalesce(F.try_divide(F.col(f"{k}xy"), F.sqrt(f"{k}xx") * F.sqrt(f"{k}yy")), nan)).otherwise(nan)
    all_ = F.col("n").cast("double") * (F.col("n") - 1) / 2
    down = F.col("near").cast("double") + F.col("apart").cast("double")
    ta, tb, tab = (F.col(c).cast("double") / 2 for c in ("ta", "tb", "tab"))
    up = all_ - ta - tb + tab - down
    below = F.sqrt((all_ - ta + tab) * (all_ - tb + tab))  # pairs tied on both sides count as ties of either
    return out.select(group, "n", corr("p").alias("pearson"), corr("s").alias("spearman"), F.when(below == 0, nan).otherwise((up - down) / below).alias("kendall"))


def as_quality(value: Column, distance: bool) -> Column:
    """A score's sign turned so that more is better."""
    return -value if distance else value


def outcome_totals(matches: DataFrame, missed: DataFrame, extra: DataFrame) -> DataFrame:
    """One row: matches (case, same), those of another type, misses, extras."""
    one = matches.agg(F.count("*").alias("matched"), F.count_if(~F.col("same")).alias("wrong_type"))
    return one.join(missed.agg(F.count("*").alias("missed")), F.lit(True)).join(extra.agg(F.count("*").alias("extra")), F.lit(True))  # one row each


def flattened(matches: DataFrame, missed: DataFrame, extra: DataFrame) -> DataFrame:
    """(case, kind, truth_id, found_id, iou): a row for each match, miss and extra, as a report of lines wants it."""
    none = lambda like: F.lit(None).cast(like)
    ids = matches.schema["truth_id"].dataType
    return (
        matches.select("case", F.when(F.col("same"), "match").otherwise("confused").alias("kind"), "truth_id", "found_id", "iou")
        .unionByName(missed.select("case", F.lit("missed").alias("kind"), F.col("id").alias("truth_id"), none(ids).alias("found_id"), none("double").alias("iou")))
        .unionByName(extra.select("case", F.lit("extra").alias("kind"), none(ids).alias("truth_id"), F.col("id").alias("found_id"), none("double").alias("iou")))
    )


def large_enough(boxes: DataFrame, least: int) -> DataFrame:
    """Boxes (box) of `least` pixels or more: an evaluation may leave out smaller ones on both sides."""
    return boxes.filter(F.col("box.width") * F.col("box.height") >= least)


def chroma_share(pairs: DataFrame, key: str = "frame") -> DataFrame:
    """(key, chroma_share): how much of an image pair's change is in colour rather than brightness, 0 without any change."""
    y = lambda k: F.col(f"r{k}") * F.lit(0.299) + F.col(f"g{k}") * F.lit(0.587) + F.col(f"b{k}") * F.lit(0.114)
    y1, y2 = y(1), y(2)
    cb = F.abs((F.col("b1") - y1) - (F.col("b2") - y2)) * 0.564
    cr = F.abs((F.col("r1") - y1) - (F.col("r2") - y2)) * 0.713
    luma, chroma = F.sum(F.abs(y1 - y2)), F.sum((cb + cr) * 0.5)
    return pairs.groupBy(key).agg(F.when(luma + chroma > 0, chroma / (luma + chroma)).otherwise(0.0).alias("chroma_share"))


def _curve(b: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A logistic with a linear part, b0 (1/2 - 1/(1 + exp(b1 (x - b2)))) + b3 x + b4, and its derivatives by b."""
    e = 1 / (1 + np.exp(np.clip(b[1] * (x - b[2]), -500, 500)))
    slope = b[0] * e * (1 - e)
    return b[0] * (0.5 - e) + b[3] * x + b[4], np.stack([0.5 - e, slope * (x - b[2]), -slope * b[1], x, np.ones_like(x)], axis=1)


def logistic_fit(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """(Pearson correlation, root mean square error) of y and the best logistic of x, by damped least squares from several steepnesses
    of either sign; without a finite correlation, that of x itself."""
    spread = max(float(x.std()), 1e-9)
    best, least = None, np.inf
    for steep in (0.25, 1.0, 4.0, 16.0, 64.0):
        for sign in (1.0, -1.0):
            b = np.array([y.max() - y.min(), sign * steep / spread, x.mean(), 0.0, y.mean()])
            damp, f, j = 1e-2, *_curve(b, x)
            cost = float(((f - y) ** 2).sum())
            for _ in range(rounds):
                a = j.T @ j
                step = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), j.T @ (y - f), rcond=None)[0]
                g, k = _curve(b + step, x)
                new = float(((g - y) ** 2).sum())
                if new < cost:
                    done = cost - new <= 1e-12 * cost
                    b, f, j, cost, damp = b + step, g, k, new, damp / 3
                    if done:
                        break
                else:
                    damp *= 4
                    if damp > 1e12:
                        break
            if cost < least:
                best, least = f, cost
    pearson = lambda p: float(np.corrcoef(p, y)[0, 1]) if p.std() > 0 and y.std() > 0 else float("nan")
    found = pearson(best)
    return (found if np.isfinite(found) else pearson(x)), float(np.sqrt(((best - y) ** 2).mean()))


GRID, ROUNDS, ZOOM = (19, 121), 9, 2.2  # steepnesses and centres tried at a time, how often, and by how much finer each time
TRIED = 64  # rows whose curves are made at a time, so that they stay in a core's cache
STEEP, FAR = (-3.0, 4.2), (-6.0, 6.0)  # logarithms of steepness, and centres, in standard deviations


def _sums(rows: DataFrame, tried: DataFrame, group: str, grid: list[np.ndarray]) -> DataFrame:
    """(group, at, s, ss, sx, sy): sums over a group's rows of what is tried at place `at` of the grid about the group's best (u, c), the logistic with
    a steepness and a centre, of its square, and of its products with both sides.  Each batch of rows gives one row for each group
    and place."""
    kind = rows.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column(0).dictionary_encode()
            code = np.asarray(coded.indices)
            x, y = b.column(1).to_numpy(), b.column(2).to_numpy()
            owner: list[int] = []
            out: list[np.ndarray] = []
            for g in range(len(coded.dictionary)):
                mine = np.flatnonzero(code == g)
                steep, centre = (b.column(c)[int(mine[0])].as_py() + d for c, d in zip((3, 4), grid))
                half = np.exp(steep) / 2
                sides = np.stack([np.ones(len(mine)), x[mine], y[mine]])
                sums = np.zeros((4, len(half)))
                for lo in range(0, len(mine), TRIED):
                    some = sides[:, lo : lo + TRIED]
                    e = some[1][:, None] - centre
                    e *= half
                    np.tanh(e, out=e)  # twice 1/2 - 1/(1 + exp(2 e))
                    sums[:3] += some @ e
                    sums[3] += np.einsum("ij,ij->j", e, e)
                out.append(sums * [[0.5], [0.5], [0.5], [0.25]])
                owner.append(g)
            places = len(grid[0])
            at = np.tile(np.arange(places, dtype=np.int32), len(owner))
            s, sx, sy, ss = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(np.repeat(owner, places))), pa.array(at), *map(pa.array, (s, ss, sx, sy))], names=[group, "at", "s", "ss", "sx", "sy"])

    joined = rows.join(tried, group).select(group, "x", "y", "u", "c")
    made = joined.mapInArrow(run, f"`{group}` {kind}, at int, s double, ss double, sx double, sy double")
    return made.groupBy(group, "at").agg(*[F.sum(c).alias(c) for c in ("s", "ss", "sx", "sy")])


def _solved(n: float, xy: float, s: np.ndarray) -> tuple[float, float]:
    """(share of y's variance that is left, correlation) of the best a e + b x + c, from sums over n rows of e (s) where x and y have mean 0 and variance 1."""
    e, ee, ex, ey = s / n
    spread = max(ee - e * e, 0.0)
    m, v = np.array([[spread, ex], [ex, 1.0]]), np.array([ey, xy])
    best = np.linalg.lstsq(m, v, rcond=1e-12)[0]
    seen = float(min(1.0, max(0.0, best @ v)))  # the fit's share of the variance is its correlation squared
    return 1 - seen, float(np.sqrt(seen))


def fitted(ratings: DataFrame, group: str) -> DataFrame:
    """(group, n, plcc, rmse) of ratings (group, predicted, rated): the subjective scale is met through a fitted logistic with a linear part.  A group holds one
    metric's ratings of one data set; one whose sides don't both vary has no correlation.

    For a steepness and a centre the rest of the curve is linear, so sums over rows give its best form and how much that leaves.  Many of
    them are tried in one pass, and finer ones about the best in the next; a pass sends sums alone, so a group may have any number of rows."""
    fine = "predicted IS NOT NULL AND rated IS NOT NULL AND NOT isnan(predicted) AND NOT isnan(rated)"
    rows = ratings.select(group, F.col("predicted").cast("double").alias("x"), F.col("rated").cast("double").alias("y")).filter(fine)
    base = rows.groupBy(group).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("dx"), F.stddev_pop("y").alias("dy"))
    base = kept(base)
    scaled = rows.join(base, group).select(group, F.try_divide(F.col("x") - F.col("mx"), F.col("dx")).alias("x"), F.try_divide(F.col("y") - F.col("my"), F.col("dy")).alias("y"))
    scaled = kept(scaled.filter("x IS NOT NULL AND y IS NOT NULL"))
    with_xy = kept(scaled.groupBy(group).agg(F.sum(F.col("x") * F.col("y")).alias("xy")).join(base.select(group, "n"), group))
    kind = ratings.schema[group].dataType.simpleString()
    grid = [m.ravel() for m in np.meshgrid(*[np.linspace(lo, hi, n) for n, (lo, hi) in zip(GRID, (STEEP, FAR))])]
    tried = with_xy.select(group, F.lit(0.0).alias("u"), F.lit(0.0).alias("c"), F.lit(1.0).alias("left"), F.lit(0.0).alias("plcc"))

    def best(grid: list[np.ndarray]):
        def run(t: pa.Table) -> pa.Table:
            row = {n: t.column(n)[0].as_py() for n in t.column_names}
            scores = [_solved(row["n"], row["xy"] / row["n"], s) for s in np.stack([t.column(k).to_numpy() for k in ("s", "ss", "sx", "sy")], 1)]
            k = int(np.argmin([left for left, _ in scores]))
            at = int(t.column("at")[k].as_py())
            left, plcc = min(scores[k], (row["left"], row["plcc"]))
            values = row["u"] + float(grid[0][at]), row["c"] + float(grid[1][at]), left, plcc
            return pa.table({group: t.column(group).slice(0, 1), **{n: pa.array([v], pa.float64()) for n, v in zip(("u", "c", "left", "plcc"), values)}})

        return run

    width = 1.0
    for _ in range(ROUNDS):
        sums = _sums(scaled, tried, group, grid).join(tried, group).join(with_xy, group)
        tried = kept(sums.groupBy(group).applyInArrow(best(grid), f"`{group}` {kind}, u double, c double, left double, plcc double"))
        grid = [m.ravel() for m in np.meshgrid(*[np.linspace(-1, 1, 7) * width * (hi - lo) / (n - 1) for n, (lo, hi) in zip(GRID, (STEEP, FAR))])]
        width /= ZOOM
    nan = F.lit(float("nan"))
    out = base.join(tried.select(group, "left", "plcc"), group, "left")
    return out.select(group, "n", F.coalesce("plcc", nan).alias("plcc"), (F.col("dy") * F.sqrt(F.coalesce("left", F.when(F.col("dy") > 0, 1.0).otherwise(0.0)))).alias("rmse"))


def rated_pairs(names: DataFrame, folds: int = 5, path: str = "path") -> DataFrame:
    """names (path like I07_12_03.png, rating) with reference, distortion, level and fold: all images of a reference share a fold."""
    part = lambda k: F.regexp_extract(path, r"I(\d+)_(\d+)_(\d+)\.[a-z]+$", k).try_cast("int")
    return names.withColumn("reference", part(1)).withColumn("distortion", part(2)).withColumn("level", part(3)).filter("reference IS NOT NULL").withColumn("fold", F.col("reference") % folds)


def polarity(ratings: DataFrame, group: str) -> DataFrame:
    """(group, correlation, declared, holds): does a metric that is declared a distance (distance) fall as ratings rise, and any other rise?"""
    g = ratings.groupBy(group).agg(F.corr("predicted", "rated").alias("correlation"), F.bool_or("distance").alias("declared"))
    return g.withColumn("holds", F.when(F.col("declared"), F.col("correlation") < 0).otherwise(F.col("correlation") > 0))
