"""Reports of runs: headlines, records of judgements, reviews, messages and exit codes, as joins, groupings and conditions.

A table of results has (id, url, status, diff_percentage, diff_count, severity, label, headline, action), where label to action
are null for results without a verdict; regions have (id, region, change_type, pixels, position)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a verdict may say, classes of a review, formats by extension and by their first bytes.
LABELS = ("regression-likely", "intentional-likely", "noise-likely", "ambiguous")
ACTIONS = ("investigate", "rewrite-if-intended", "ignore-or-rewrite")
REJECTED = "Confirmed regression during review"
STALE = "captureHash mismatch: entry was edited without re-capturing"
EXTENSIONS = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "qoi": "qoi"}
MAGIC = {"89504E470D0A1A0A": "png", "FFD8FF": "jpeg", "716F6966": "qoi"}
SSIM_LEAST = 0.95


def percent_text(pct: Column) -> Column:
    return F.when(pct.isNull(), "?%").when(pct >= 0.01, F.format_string("%.2f%%", pct)).otherwise(F.format_string("%.3f%%", pct))


def headlines(pairs: DataFrame, regions: DataFrame, key: str = "id") -> DataFrame:
    """(key, headline) of pairs (key, reason, diff_count, diff_percentage, severity): one line that names the regions' types, most frequent
    first (among equals the one found first), and the place of the largest region."""
    each = regions.groupBy(key, "change_type").agg(F.count("*").alias("n"), F.min("region").alias("at"))
    listed = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "at", F.format_string("%d %s", "n", "change_type").alias("t"), "change_type"))).alias("types"), F.sum("n").alias("n"))
    top = regions.groupBy(key).agg(F.max_by("position", F.struct("pixels", -F.col("region"))).alias("position"))
    j = pairs.join(listed, key, "left").join(top, key, "left")
    pct, sev = percent_text(F.col("diff_percentage")), F.coalesce("severity", F.lit("?"))
    where = F.coalesce(F.concat(F.lit(" @ "), "position"), F.lit(""))
    tail = F.concat(where, F.lit(" ("), pct, F.lit(", "), sev, F.lit(")"))
    one = F.concat(F.lit("1 "), F.col("types")[0]["change_type"], tail)
    many = F.concat(F.col("n").cast("string"), F.lit(" regions: "), F.array_join(F.col("types.t"), ", "), tail)
    none = F.concat(F.coalesce(F.format_number("diff_count", 0), F.lit("?")), F.lit(" px ("), pct, F.lit(") - no region analysis"))
    line = F.when(F.col("reason") == "layout-diff", "image dimensions changed").when(F.col("reason") == "file-not-exists", "baseline or actual capture missing")
    return j.select(key, line.when(F.col("n").isNull(), none).when(F.col("n") == 1, one).otherwise(many).alias("headline"))


def signatures(results: DataFrame, regions: DataFrame) -> DataFrame:
    """results with `signature`: what a judgement depends on, whatever the order of the regions."""
    shape = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "change_type", F.col("pixels").cast("string")))), ",")
    j = results.join(regions.groupBy("id").agg(shape.alias("_shape")), "id", "left")
    diff = F.coalesce(F.format_string("%.4f", "diff_percentage"), F.lit("?"))
    diff = F.when(F.col("diff_percentage").isNull(), "?").otherwise(diff)
    shown = F.when(F.coalesce("_shape", F.lit("")) == "", "0").otherwise(F.concat(F.lit("["), "_shape", F.lit("]")))
    text = F.concat("status", F.lit("|diff:"), diff, F.lit("|regions:"), shown, F.lit("|severity:"), F.coalesce("severity", F.lit("?")))
    return j.withColumn("signature", text).drop("_shape")


def judgement_records(signed: DataFrame, entries: DataFrame, prior: DataFrame) -> DataFrame:
    """(id, signature, label, source): a request for every signed result that isn't a pass and has an entry (id), with its verdict.

    A prior record (id, signature, label) keeps its verdict if its signature is the same; else a result that is certain gets its own
    ('auto'), and other verdicts are dropped.  Prior records of other ids go."""
    requests = signed.filter("status <> 'pass'").join(entries.select("id"), "id", "left_semi")
    j = requests.join(prior.select("id", F.col("signature").alias("_signature"), F.col("label").alias("_label")), "id", "left")
    same = F.col("_signature").eqNullSafe(F.col("signature")) & F.col("_label").isNotNull()
    certain = F.col("label").isNotNull() & (F.col("status") != "needs-judgment") & (F.col("label") != "ambiguous")
    label = F.when(same, F.col("_label")).when(certain, F.col("label"))
    return j.select("id", "signature", label.alias("label"), F.when(same, "prior").when(certain, "auto").alias("source"))


def applied(requests: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, outcome) of every request: 'applied', 'invalid' (a label, action or headline that can't be), 'missing'."""
    j = requests.select("id").join(verdicts.select("id", "label", "headline", "action", F.lit(True).alias("_there")), "id", "left")
    good = F.col("label").isin(*LABELS) & F.col("action").isin(*ACTIONS) & F.col("headline").isNotNull()
    return j.select("id", F.when(F.col("_there").isNull(), "missing").when(F.coalesce(good, F.lit(False)), "applied").otherwise("invalid").alias("outcome"))


def slim(results: DataFrame) -> DataFrame:
    """What a reader of the report needs: results that aren't a pass."""
    return results.filter("status <> 'pass'").select("id", "url", "status", "label", "headline", "action")


def review_entries(results: DataFrame) -> DataFrame:
    """Rows of a review: what isn't a clean pass, and what was just approved."""
    shown = results.filter("status <> 'pass' OR review = 'approved'")
    kind = F.when(F.col("label") == "regression-likely", "regression").when(F.col("label") == "ambiguous", "layout-shift").otherwise("intentional-likely")
    return shown.select(
        "id", "url", F.coalesce("diff_percentage", F.lit(0.0)).alias("diff"), kind.alias("classification"), F.coalesce("severity", F.lit("low")).alias("severity"),
        F.coalesce("action", F.lit("investigate")).alias("action"), F.coalesce("headline", "message", "status").alias("summary"),
        F.when(F.col("review").isin("approved", "rejected"), F.col("review")).otherwise("unreviewed").alias("review_status"),
    )


def reviewed(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """results after decisions (id, decision): approved ones pass and lose their difference and verdict, rejected ones fail as
    regressions; the others stay."""
    j = results.drop("review").join(decisions, "id", "left")
    yes, no = F.col("decision") == "approved", F.col("decision") == "rejected"
    cleared = {c: F.when(yes, None).otherwise(F.col(c)) for c in ("diff_percentage", "diff_count")}
    return j.withColumns(
        cleared
        | {
            "status": F.when(yes, "pass").when(no, "fail").otherwise(F.col("status")),
            "label": F.when(no, "regression-likely").when(yes, None).otherwise(F.col("label")),
            "headline": F.when(no, F.coalesce("headline", F.lit(REJECTED))).when(yes, None).otherwise(F.col("headline")),
            "action": F.when(no, "investigate").when(yes, None).otherwise(F.col("action")),
            "review": F.col("decision"),
        }
    ).drop("decision")


def xml_text(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def junit_cases(results: DataFrame, suite: str = "driftlake") -> DataFrame:
    """(id, xml): a test case for each result (id, status, message); a failure unless it is a pass."""
    said = xml_text(F.coalesce("message", "status"))
    head = F.concat(F.lit(f'<testcase classname="{suite}" name="'), xml_text(F.col("id")), F.lit('"'))
    bad = F.concat(head, F.lit('><failure message="'), said, F.lit('" type="'), xml_text(F.col("status")), F.lit('">'), said, F.lit("</failure></testcase>"))
    return results.select("id", F.when(F.col("status") == "pass", F.concat(head, F.lit("/>"))).otherwise(bad).alias("xml"))


def write_junit(results: DataFrame, path: str, suite: str = "driftlake") -> None:
    """A folder of text files that read one after the other are a JUnit report: head, cases in the order of ids, end."""
    counts = results.agg(F.count("*").alias("n"), F.count_if(F.col("status") != "pass").alias("bad"))
    head = counts.select(F.lit(0).alias("part"), F.lit("").alias("id"), F.format_string(f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuites><testsuite name="{suite}" tests="%d" failures="%d">', "n", "bad").alias("xml"))
    foot = counts.select(F.lit(2).alias("part"), F.lit("").alias("id"), F.lit("</testsuite></testsuites>").alias("xml"))
    cases = junit_cases(results, suite).select(F.lit(1).alias("part"), "id", "xml")
    head.unionByName(cases).unionByName(foot).orderBy("part", "id").select("xml").write.text(path)


def capture_results(entries: DataFrame) -> DataFrame:
    """(id, status, message) of entries (id, skip, error, hash, captured_hash, has_baseline, differs): the first that holds of a skip (a
    pass), an error, a stale baseline, a missing baseline, a difference; one bad entry doesn't stop the others."""
    stale = ~F.col("hash").eqNullSafe(F.col("captured_hash"))
    cases = [("skip IS NOT NULL", "pass", F.col("skip")), ("error IS NOT NULL", "fail", F.col("error")), (stale, "stale-baseline", F.lit(STALE)), ("NOT has_baseline", "missing-baseline", F.concat(F.lit("baseline missing at "), "id", F.lit(".png"))), ("differs", "fail", F.lit(None).cast("string"))]
    found = F.coalesce(*[F.when(F.expr(test) if isinstance(test, str) else test, F.struct(F.lit(s).alias("status"), m.alias("message"))) for test, s, m in cases], F.struct(F.lit("pass").alias("status"), F.lit(None).cast("string").alias("message")))
    return entries.select("id", found.alias("f")).select("id", "f.status", "f.message")


def exit_codes(compared: DataFrame) -> DataFrame:
    """compared (method, diff_count, score) with exit_code: 1 for any differing pixel, or for a similarity under SSIM_LEAST."""
    bad = F.when(F.contains("method", F.lit("ssim")), ~(F.col("score") >= SSIM_LEAST)).otherwise(F.col("diff_count") > 0)
    return compared.withColumn("exit_code", F.when(F.coalesce(bad, F.lit(True)), 1).otherwise(0))


def match_message(passed: Column) -> Column:
    """Of a comparison without a snapshot (diff_count or score)."""
    what = F.when(F.col("diff_count").isNotNull(), F.concat(F.col("diff_count").cast("string"), F.lit(" pixels"))).otherwise(F.concat(F.col("score").cast("string"), F.lit(" score")))
    return F.when(passed, "Images match.").otherwise(F.concat(F.lit("Images differ: "), what))


def snapshot_message(passed: Column) -> Column:
    """Of a comparison with a snapshot (method, created, diff_count, diff_percentage, score, threshold, kind, id), a fact a line."""
    row = lambda label, value: F.concat(F.lit("  " + label.ljust(12)), value)
    score = F.coalesce("score", F.lit(0.0))
    similar = [row("SSIM Score", F.format_string("%.4f (1.0 = identical)", score)), row("Difference", F.format_string("%.2f%%", (1 - score) * 100))]
    gradient = [row("GMSD Score", F.format_string("%.4f (0.0 = identical)", score))]
    counted = [row("Difference", F.format_string("%s pixels (%.2f%%)", F.format_number(F.coalesce("diff_count", F.lit(0)), 0), F.coalesce("diff_percentage", F.lit(0.0))))]
    facts = F.when(F.contains("method", F.lit("ssim")), F.array(*similar)).when(F.col("method") == "gmsd", F.array(*gradient)).otherwise(F.array(*counted))
    unit = F.when(F.col("kind") == "percent", "%").otherwise("pixels")
    lines = F.concat(F.array(F.lit("Image snapshot mismatch"), row("Method", F.col("method")), row("Baseline", F.concat("id", F.lit(".png"))), row("Diff", F.concat("id", F.lit(".diff.png")))), facts, F.array(row("Threshold", F.concat_ws(" ", F.col("threshold").cast("string"), unit))))
    return F.when(F.col("created"), F.concat(F.lit("New snapshot created\n  "), "id", F.lit(".png"))).when(passed, "Image matches snapshot").otherwise(F.array_join(lines, "\n"))


def dimension_label(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    """Of two sizes: one if they are equal, else both and how they differ."""
    signed = lambda d: F.when(d > 0, F.concat(F.lit("+"), d.cast("string"))).otherwise(d.cast("string"))
    size = lambda w, h: F.concat_ws("×", w.cast("string"), h.cast("string"))
    return F.when((w1 == w2) & (h1 == h2), size(w1, h1)).otherwise(
        F.concat(F.lit("Dimensions changed: "), size(w1, h1), F.lit(" → "), size(w2, h2), F.lit(" ("), signed(w2 - w1), F.lit("×"), signed(h2 - h1), F.lit(")"))
    )


def top_regions(regions: DataFrame, n: int = 5, key: str = "id") -> DataFrame:
    """The n largest regions of each pair, with their rank; among equals the one found first."""
    w = Window.partitionBy(key).orderBy(F.col("pixels").desc(), "region")
    return regions.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def format_of_path(path: Column) -> Column:
    """Image format by a path's extension, whatever its case; null for others."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    extension = F.lower(F.regexp_extract(name, r"[^/]\.([^./]*)$", 1))
    return F.coalesce(*[F.when(extension == e, f) for e, f in EXTENSIONS.items()])


def format_of_bytes(content: Column) -> Column:
    """Image format by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.coalesce(*[F.when(F.startswith(head, F.lit(m)), f) for m, f in MAGIC.items()])


def file_pairs(files: DataFrame, path: str = "path") -> DataFrame:
    """(name, a, b): files <name>a.png and <name>b.png that are side by side."""
    parts = files.select(F.col(path).alias("path"), F.regexp_extract(path, r"^(.*)([ab])\.png$", 1).alias("name"), F.regexp_extract(path, r"^(.*)([ab])\.png$", 2).alias("side")).filter("side <> ''")
    side = lambda s: parts.filter(F.col("side") == s).select("name", F.col("path").alias(s))
    return side("a").join(side("b"), "name")


def without(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """entries less those of the ids."""
    return entries.join(ids.select("id"), "id", "left_anti")


def invalid_reason(width: Column, height: Column, size1: Column, size2: Column) -> Column:
    """Why two buffers of bytes can't be compared as RGBA images of this size; null if they can."""
    return F.when(width.isNull() | height.isNull() | (width <= 0) | (height <= 0), "empty image").when(size1.isNull() | size2.isNull(), "missing image").when(size1 != size2, "image sizes do not match").when(size1 != width * height * 4, "image data size does not match width and height")
