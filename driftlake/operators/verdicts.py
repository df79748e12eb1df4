"""Verdicts on compared pairs, thresholds, and the states of snapshots, as groupings and ordered conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlake.operators.pixeldiff import severity
from driftlake.operators.reports import percent_text

# Types in the order of reports, their headings, and what they speak for.
TYPES = {"content-change": "Content changed", "addition": "Content added", "deletion": "Content removed", "shift": "Content shifted", "color-change": "Colors changed", "rendering-noise": "Rendering noise"}
REGRESSIVE, INTENTIONAL, NOISE = ("content-change", "addition", "deletion"), ("color-change", "shift"), ("rendering-noise",)
IMPACT = {"low": "Low-impact", "medium": "Moderate", "high": "Significant"}
SLIGHT = 0.01  # per cent
ACTIONS = {"regression-likely": "investigate", "ambiguous": "investigate", "intentional-likely": "rewrite-if-intended", "noise-likely": "ignore-or-rewrite"}


def _choice(names: dict[str, str], c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[c]


def _plural(n: Column) -> Column:
    return F.when(n == 1, "region").otherwise("regions")


def summaries(pairs: DataFrame, regions: DataFrame, key: str = "frame") -> DataFrame:
    """(key, severity, summary) of pairs (key, diff_percentage): a first line, then a line for each type of change.  The lines' wording is a
    fixed value."""
    types = list(TYPES)
    first = regions.groupBy(key, "change_type", "position").agg(F.min("region").alias("at"), F.count("*").alias("n"))
    lines = first.groupBy(key, "change_type").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "position"))).alias("where"))
    text = F.format_string("%s: %d %s (%s).", _choice(TYPES, F.col("change_type")), F.col("n"), _plural(F.col("n")), F.array_join(F.col("where.position"), ", "))
    order = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("change_type"))
    body = lines.select(key, F.struct(order.alias("o"), text.alias("t")).alias("line"), "n").groupBy(key).agg(F.array_sort(F.collect_list("line")).alias("lines"), F.sum("n").alias("regions"))
    out = pairs.join(body, key, "left").withColumn("severity", severity(F.col("diff_percentage")))
    count = F.coalesce("regions", F.lit(0))
    head = F.format_string("%s visual change detected (%.2f%% of image, %d %s).", _choice(IMPACT, F.col("severity")), "diff_percentage", count, _plural(count))
    return out.select(key, "severity", F.array_join(F.concat(F.array(head), F.coalesce(F.col("lines.t"), F.array().cast("array<string>"))), "\n").alias("summary"))


def verdicts(pairs: DataFrame, regions: DataFrame, key: str = "frame") -> DataFrame:
    """(key, regions, dominant, top_position, mean_confidence, label, action, reasons) of pairs (key, reason, diff_percentage).

    `reason` is 'pixel-diff', 'layout-diff', 'file-not-exists' or null.  The dominant type is the most frequent, the one found
    first among equals; the top position is that of the largest region; confidences are added in the regions' order, so that a mean at a rule's limit doesn't
    depend on the run.  Label and reasons come from the first rule that holds; the reasons'
    wording is a fixed value."""
    kind = F.col("change_type")
    sure = F.array_sort(F.collect_list(F.when(F.col("confidence").isNotNull(), F.struct("region", F.col("confidence").cast("double").alias("c")))))
    stats = regions.groupBy(key).agg(
        F.count("*").alias("regions"),
        F.max_by("position", F.struct("pixels", -F.col("region"))).alias("top_position"),
        (F.aggregate(sure, F.lit(0.0), lambda total, r: total + r["c"]) / F.count("confidence")).alias("mean_confidence"),
        F.bool_and(kind.isin(*NOISE)).alias("all_noise"),
        F.bool_and(kind == "color-change").alias("all_color"),
        F.bool_and(kind.isin(*INTENTIONAL)).alias("all_moved"),
        F.bool_or(kind.isin(*REGRESSIVE)).alias("any_regressive"),
    )
    each = regions.groupBy(key, "change_type").agg(F.count("*").alias("n"), F.min("region").alias("at"))
    counted = F.format_string("%d %s", "n", "change_type")
    found = F.struct("at", counted.alias("t"))
    most = each.groupBy(key).agg(
        F.max_by("change_type", F.struct("n", -F.col("at"))).alias("dominant"),
        F.array_join(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "at", counted.alias("t"))))["t"], ", ").alias("_all"),  # a type each
        F.array_join(F.array_sort(F.collect_list(F.when(kind.isin(*REGRESSIVE), found)))["t"], ", ").alias("_regressive"),
    )
    j = pairs.join(stats, key, "left").join(most, key, "left").withColumn("severity", severity(F.col("diff_percentage")))
    pct, say, n = percent_text(F.col("diff_percentage")), F.format_string, F.col("regions")
    shown = F.coalesce("severity", F.lit("?"))
    rules = [
        (F.col("reason") == "layout-diff", "ambiguous", ["baseline and actual image dimensions differ — page height likely shifted", "could be intentional (content added/removed) or regression (broken layout)"]),
        (F.col("reason") == "file-not-exists", "regression-likely", ["baseline or actual capture is missing from disk"]),
        (n.isNull(), "ambiguous", ["pixels differ but interpret returned no regions"]),
        (F.col("all_noise"), "noise-likely", ["all regions classified as rendering-noise"]),
        ((F.col("diff_percentage") < SLIGHT) & (F.col("severity") == "low"), "noise-likely", [say(f'delta < {SLIGHT}%% (got %s) at "low" severity', pct), "sub-perceptual change - review optional"]),
        (F.col("any_regressive") & F.col("severity").isin("medium", "high"), "regression-likely", [say("severity %s with structural changes (%s)", "severity", "_regressive"), "likely affects content or layout, not just styling"]),
        (F.col("all_color") & (F.col("mean_confidence") > 0.7), "intentional-likely", [say("%d color-change %s with mean confidence > 0.7", n, _plural(n)), "edge structure preserved - looks like a theming / palette change"]),
        (F.col("all_moved") & ~F.col("all_color"), "intentional-likely", ["all regions are shift/color-change - content moved or restyled, structure preserved"]),
        (F.lit(True), "ambiguous", [say('mix of change types (%s) at "%s" severity', "_all", shown), F.concat(pct, F.lit(" of image differs"))]),
    ]
    lines = lambda some: F.array(*[F.lit(r) if isinstance(r, str) else r for r in some])
    j = j.withColumn("_rule", F.coalesce(*[F.when(test, F.struct(F.lit(label).alias("label"), lines(some).alias("reasons"))) for test, label, some in rules]))
    label = F.col("_rule.label")
    return j.select(key, F.coalesce("regions", F.lit(0)).alias("regions"), "dominant", "top_position", F.coalesce("mean_confidence", F.lit(0.0)).alias("mean_confidence"), label.alias("label"), _choice(ACTIONS, label).alias("action"), F.col("_rule.reasons").alias("reasons"))


def passes(method: str, threshold: float = 0.0, kind: str = "pixel") -> Column:
    """Does a comparison (diff_count, diff_percentage, score) stay within its threshold?  Missing values count as 0."""
    score = F.coalesce("score", F.lit(0.0))
    if "ssim" in method:
        return (1 - score) * 100 <= threshold if kind == "percent" else score >= 1 - threshold / 100
    if method == "gmsd":
        return score * 100 <= threshold if kind == "percent" else score <= threshold / 100
    return F.coalesce("diff_percentage" if kind == "percent" else "diff_count", F.lit(0)) <= threshold


def snapshot_id(name: Column) -> Column:
    """A file name of a test's name: letters, digits, dashes and underscores."""
    clean = F.lower(F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9\-_\s]", ""), r"\s+", "-"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("snapshot"))


def snapshot_states(baseline: DataFrame, received: DataFrame, same: Column, mode: str = "new", key: str = "id") -> DataFrame:
    """(key, status) of what was received, over a join of both tables: added, matched, updated, failed.

    `same` compares the joined rows.  'new' adds what is missing, 'all' also takes over what differs, 'none' does neither."""
    if mode not in ("all", "new", "none"):
        raise ValueError(f"mode is all, new or none, not {mode!r}")
    j = received.join(baseline.withColumn("_known", F.lit(True)), key, "left")
    added, differs = ("failed" if mode == "none" else "added"), ("updated" if mode == "all" else "failed")
    return j.select(key, F.when(F.col("_known").isNull(), added).when(same, "matched").otherwise(differs).alias("status"))


def promoted(baseline: DataFrame, received: DataFrame, states: DataFrame, key: str = "id") -> DataFrame:
    """The baseline after a run: added and updated rows replace theirs."""
    taken = received.join(states.filter(F.col("status").isin("added", "updated")).select(key), key, "left_semi")
    return baseline.join(taken.select(key), key, "left_anti").unionByName(taken)
