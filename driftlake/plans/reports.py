"""Queries over derived runs: an order is a checked page, its line items are the regions that changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.operators import catalog, reports
from driftlake.operators.pixeldiff import severity
from driftlake.operators.verdicts import TYPES, passes, verdicts
from driftlake.plans.registry import query

KINDS = list(TYPES)
PLACES = ["top-left", "top", "top-right", "left", "center", "right", "bottom-left", "bottom", "bottom-right"]
_LIST = lambda names: "[" + ", ".join(f"'{x}'" for x in names) + "]"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, url, reason, status, diff_count, diff_percentage, severity, label, headline, action, message, review): every order as a
    checked page; those that pass have no difference."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    fine = F.col("o_orderstatus") == "O"
    count = F.when(~fine, k * 7919 % 100003)
    label = F.when(~fine & (k % 5 != 4), F.element_at(F.array(*map(F.lit, reports.LABELS)), (k % 4 + 1).cast("int")))
    return o.select(
        F.concat(F.lit("o"), k.cast("string")).alias("id"),
        F.concat(F.lit("/orders/"), k.cast("string")).alias("url"),
        F.when(k % 11 == 3, "layout-diff").when(k % 13 == 5, "file-not-exists").otherwise("pixel-diff").alias("reason"),
        F.when(fine, "pass").when(F.col("o_orderstatus") == "F", "fail").otherwise("needs-judgment").alias("status"),
        count.alias("diff_count"),
        (count / 1000.03).alias("diff_percentage"),
        severity(count / 1000.03).alias("severity"),
        label.alias("label"),
        F.when(label.isNotNull(), F.concat(F.lit("seen in "), "o_orderpriority")).alias("headline"),
        F.when(label.isNotNull(), F.element_at(F.array(*map(F.lit, reports.ACTIONS)), (k % 3 + 1).cast("int"))).alias("action"),
        F.when(k % 7 == 2, F.concat(F.lit("<'"), "o_orderpriority", F.lit("\"> & more"))).alias("message"),
        F.when(k % 9 == 1, "approved").when(k % 9 == 2, "rejected").alias("review"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, region, change_type, pixels, position, x, y, width, height)."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    g = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.sum(F.col("l_quantity").cast("long")).alias("pixels"))
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    return g.select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("id"), F.col("l_linenumber").alias("region"), pick(KINDS, F.col("p")).alias("change_type"), "pixels", pick(PLACES, F.col("s")).alias("position"),
        (F.col("p") % 300).alias("x"), (F.col("s") % 200).alias("y"), (F.col("pixels") % 40 + 1).alias("width"), (F.col("p") % 17 + 1).alias("height"),
    )


RUN_SQL = f"""rs AS (SELECT 'o' || o_orderkey AS id, '/orders/' || o_orderkey AS url,
  CASE WHEN o_orderkey % 11 = 3 THEN 'layout-diff' WHEN o_orderkey % 13 = 5 THEN 'file-not-exists' ELSE 'pixel-diff' END AS reason,
  CASE o_orderstatus WHEN 'O' THEN 'pass' WHEN 'F' THEN 'fail' ELSE 'needs-judgment' END AS status, o_orderpriority AS pr, o_orderkey AS k,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderkey * 7919 % 100003 END AS diff_count FROM orders),
rp AS (SELECT *, diff_count / 1000.03::DOUBLE AS diff_percentage, CASE WHEN status <> 'pass' AND k % 5 <> 4 THEN {_LIST(reports.LABELS)}[k % 4 + 1] END AS label,
  CASE WHEN k % 7 = 2 THEN '<''' || pr || '"> & more' END AS message, CASE k % 9 WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' END AS review FROM rs),
run AS (SELECT *, CASE WHEN diff_count IS NULL THEN 'high' WHEN diff_percentage < 1 THEN 'low' WHEN diff_percentage <= 10 THEN 'medium' ELSE 'high' END AS severity,
  CASE WHEN label IS NOT NULL THEN 'seen in ' || pr END AS headline, CASE WHEN label IS NOT NULL THEN {_LIST(reports.ACTIONS)}[k % 3 + 1] END AS action FROM rp),
rg0 AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS pixels FROM lineitem GROUP BY 1, 2),
rg AS (SELECT 'o' || l_orderkey AS id, l_linenumber AS region, {_LIST(KINDS)}[p % 6 + 1] AS change_type, pixels, {_LIST(PLACES)}[s % 9 + 1] AS position,
  p % 300 AS x, s % 200 AS y, pixels % 40 + 1 AS width, p % 17 + 1 AS height FROM rg0)"""
PCT_SQL = "CASE WHEN diff_percentage IS NULL THEN '?%' WHEN diff_percentage >= 0.01 THEN printf('%.2f%%', diff_percentage) ELSE printf('%.3f%%', diff_percentage) END"
HEADLINE_SQL = f"""ty AS (SELECT id, change_type, count(*) AS n, min(region) AS pos FROM rg GROUP BY ALL),
tl AS (SELECT id, CAST(sum(n) AS BIGINT) AS n, string_agg(n || ' ' || change_type, ', ' ORDER BY n DESC, pos) AS listed, arg_min(change_type, pos) AS first FROM ty GROUP BY id),
tp AS (SELECT id, position FROM rg QUALIFY row_number() OVER (PARTITION BY id ORDER BY pixels DESC, region) = 1),
hl AS (SELECT run.id, CASE WHEN reason = 'layout-diff' THEN 'image dimensions changed' WHEN reason = 'file-not-exists' THEN 'baseline or actual capture missing'
  WHEN n IS NULL THEN coalesce(format('{{:,}}', diff_count), '?') || ' px (' || {PCT_SQL} || ') - no region analysis'
  WHEN n = 1 THEN '1 ' || first || ' @ ' || position || ' (' || {PCT_SQL} || ', ' || severity || ')'
  ELSE n || ' regions: ' || listed || ' @ ' || position || ' (' || {PCT_SQL} || ', ' || severity || ')' END AS headline FROM run LEFT JOIN tl USING (id) LEFT JOIN tp USING (id))"""


@query("verdict_reasons", f"""WITH {RUN_SQL}, cf AS (SELECT *, CAST(pixels % 11 AS DOUBLE) / 10 AS confidence FROM rg),
ct AS (SELECT id, change_type, count(*) AS n, min(region) AS pos FROM rg GROUP BY ALL),
cl AS (SELECT id, string_agg(n || ' ' || change_type, ', ' ORDER BY n DESC, pos) AS listed, string_agg(CASE WHEN change_type IN ('content-change', 'addition', 'deletion') THEN n || ' ' || change_type END, ', ' ORDER BY pos) AS hard FROM ct GROUP BY id),
st AS (SELECT id, count(*) AS n, avg(confidence) AS sure, bool_and(change_type = 'rendering-noise') AS noise, bool_and(change_type = 'color-change') AS color, bool_and(change_type IN ('color-change', 'shift')) AS moved, bool_or(change_type IN ('content-change', 'addition', 'deletion')) AS regr FROM cf GROUP BY id),
al AS (SELECT run.*, n, sure, noise, color, moved, regr, listed, hard, {PCT_SQL} AS pct FROM run LEFT JOIN st USING (id) LEFT JOIN cl USING (id)),
lb AS (SELECT *, CASE WHEN reason = 'layout-diff' THEN 1 WHEN reason = 'file-not-exists' THEN 2 WHEN n IS NULL THEN 3 WHEN noise THEN 4 WHEN diff_percentage < 0.01 AND severity = 'low' THEN 5 WHEN regr AND severity IN ('medium', 'high') THEN 6 WHEN color AND sure > 0.7 THEN 7 WHEN moved AND NOT color THEN 8 ELSE 9 END AS rule FROM al WHERE status <> 'pass')
SELECT id, ['ambiguous', 'regression-likely', 'ambiguous', 'noise-likely', 'noise-likely', 'regression-likely', 'intentional-likely', 'intentional-likely', 'ambiguous'][rule] AS label,
CASE rule WHEN 1 THEN 'baseline and actual image dimensions differ — page height likely shifted; could be intentional (content added/removed) or regression (broken layout)' WHEN 2 THEN 'baseline or actual capture is missing from disk' WHEN 3 THEN 'pixels differ but interpret returned no regions'
 WHEN 4 THEN 'all regions classified as rendering-noise' WHEN 5 THEN 'delta < 0.01% (got ' || pct || ') at "low" severity; sub-perceptual change - review optional' WHEN 6 THEN 'severity ' || severity || ' with structural changes (' || hard || '); likely affects content or layout, not just styling'
 WHEN 7 THEN n || ' color-change region' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' with mean confidence > 0.7; edge structure preserved - looks like a theming / palette change' WHEN 8 THEN 'all regions are shift/color-change - content moved or restyled, structure preserved'
 ELSE 'mix of change types (' || listed || ') at "' || severity || '" severity; ' || pct || ' of image differs' END AS reasons FROM lb""")
def verdict_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every failed page's verdict, and why."""
    found = regions(spark, sf_dir).withColumn("confidence", (F.col("pixels") % 11).cast("double") / 10)
    failed = results(spark, sf_dir).filter("status <> 'pass'").select("id", "reason", "diff_percentage")
    return verdicts(failed, found, "id").select("id", "label", F.array_join("reasons", "; ").alias("reasons"))


@query("verdict_headlines", f"WITH {RUN_SQL}, {HEADLINE_SQL} SELECT * FROM hl")
def verdict_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.headlines(results(spark, sf_dir), regions(spark, sf_dir))


SIGNED_SQL = f"""sh AS (SELECT id, string_agg(change_type || ':' || pixels, ',' ORDER BY change_type || ':' || pixels) AS shape FROM rg GROUP BY id),
sg AS (SELECT run.*, status || '|diff:' || CASE WHEN diff_percentage IS NULL THEN '?' ELSE printf('%.4f', diff_percentage) END || '|regions:' || CASE WHEN shape IS NULL THEN '0' ELSE '[' || shape || ']' END || '|severity:' || severity AS signature
  FROM run LEFT JOIN sh USING (id))"""


@query("judgement_signatures", f"WITH {RUN_SQL}, {SIGNED_SQL} SELECT id, signature FROM sg")
def judgement_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.signatures(results(spark, sf_dir), regions(spark, sf_dir)).select("id", "signature")


def _number(c: str = "id"):
    return F.substring(c, 2, 20).cast("long")


# Prior records: every third order's, of which some had another signature, some no verdict, and some are of orders that are no more.
PRIOR_SQL = """pr AS (SELECT CASE WHEN k % 21 = 0 THEN 'gone' || k ELSE id END AS id, CASE WHEN k % 6 = 0 THEN signature || '!' ELSE signature END AS signature, CASE WHEN k % 9 <> 0 THEN 'noise-likely' END AS label FROM sg WHERE k % 3 = 0)"""


@query("judgement_reuse", f"""WITH {RUN_SQL}, {SIGNED_SQL}, {PRIOR_SQL},
j AS (SELECT sg.id, sg.signature, pr.signature = sg.signature AND pr.label IS NOT NULL AS same, pr.label AS old, sg.label AS own, sg.label IS NOT NULL AND status <> 'needs-judgment' AND sg.label <> 'ambiguous' AS certain
  FROM sg LEFT JOIN pr USING (id) WHERE status <> 'pass' AND k % 17 <> 4)
SELECT id, signature, CASE WHEN same THEN old WHEN certain THEN own END AS label, CASE WHEN same THEN 'prior' WHEN certain THEN 'auto' END AS source FROM j""")
def judgement_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = reports.signatures(results(spark, sf_dir), regions(spark, sf_dir))
    k = _number()
    prior = signed.filter(k % 3 == 0).select(
        F.when(k % 21 == 0, F.concat(F.lit("gone"), k.cast("string"))).otherwise(F.col("id")).alias("id"), F.when(k % 6 == 0, F.concat("signature", F.lit("!"))).otherwise(F.col("signature")).alias("signature"), F.when(k % 9 != 0, "noise-likely").alias("label")
    )
    return reports.judgement_records(signed, signed.filter(k % 17 != 4), prior)


@query("judgements_applied", f"""WITH {RUN_SQL}, vd AS (SELECT id, CASE WHEN k % 8 = 1 THEN 'unsure' ELSE label END AS label, CASE WHEN k % 10 <> 7 THEN headline END AS headline, action FROM run WHERE k % 4 <> 3)
SELECT run.id, CASE WHEN vd.id IS NULL THEN 'missing' WHEN vd.label IN ('regression-likely', 'intentional-likely', 'noise-likely', 'ambiguous') AND vd.action IS NOT NULL AND vd.headline IS NOT NULL THEN 'applied' ELSE 'invalid' END AS outcome
FROM run LEFT JOIN vd USING (id) WHERE status <> 'pass'""")
def judgements_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, k = results(spark, sf_dir), _number()
    given = r.filter(k % 4 != 3).select("id", F.when(k % 8 == 1, "unsure").otherwise(F.col("label")).alias("label"), F.when(k % 10 != 7, F.col("headline")).alias("headline"), "action")
    return reports.applied(r.filter("status <> 'pass'"), given)


@query("slim_report", f"WITH {RUN_SQL} SELECT id, url, status, label, headline, action FROM run WHERE status <> 'pass'")
def slim_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.slim(results(spark, sf_dir))


@query("review_entries", f"""WITH {RUN_SQL} SELECT id, url, coalesce(diff_percentage, 0) AS diff, CASE label WHEN 'regression-likely' THEN 'regression' WHEN 'ambiguous' THEN 'layout-shift' ELSE 'intentional-likely' END AS classification,
 severity, coalesce(action, 'investigate') AS action, coalesce(headline, message, status) AS summary, coalesce(review, 'unreviewed') AS review_status FROM run WHERE status <> 'pass' OR review = 'approved'""")
def review_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.review_entries(results(spark, sf_dir))


@query("review_totals", f"""WITH {RUN_SQL}, s AS (SELECT CASE review WHEN 'approved' THEN 'pass' WHEN 'rejected' THEN 'fail' ELSE status END AS status FROM run)
SELECT count(*) AS total, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'needs-judgment') AS pending, count(*) FILTER (status NOT IN ('pass', 'needs-judgment')) AS failed FROM s""")
def review_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's counts after every decision of the review."""
    r = results(spark, sf_dir)
    return catalog.totals(reports.reviewed(r, r.filter("review IS NOT NULL").select("id", F.col("review").alias("decision"))))


@query("review_decided", f"""WITH {RUN_SQL} SELECT id, CASE review WHEN 'approved' THEN 'pass' WHEN 'rejected' THEN 'fail' ELSE status END AS status, CASE WHEN review = 'approved' THEN NULL ELSE diff_percentage END AS diff_percentage,
 CASE review WHEN 'rejected' THEN 'regression-likely' WHEN 'approved' THEN NULL ELSE label END AS label, CASE review WHEN 'rejected' THEN coalesce(headline, '{reports.REJECTED}') WHEN 'approved' THEN NULL ELSE headline END AS headline,
 CASE review WHEN 'rejected' THEN 'investigate' WHEN 'approved' THEN NULL ELSE action END AS action, review FROM run""")
def review_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir)
    return reports.reviewed(r, r.filter("review IS NOT NULL").select("id", F.col("review").alias("decision"))).select("id", "status", "diff_percentage", "label", "headline", "action", "review")


_XML = lambda c: f"""replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')"""


@query("junit_cases", f"""WITH {RUN_SQL} SELECT id, '<testcase classname="driftlake" name="' || id || '"' || CASE WHEN status = 'pass' THEN '/>'
 ELSE '><failure message="' || {_XML('coalesce(message, status)')} || '" type="' || status || '">' || {_XML('coalesce(message, status)')} || '</failure></testcase>' END AS xml FROM run""")
def junit_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.junit_cases(results(spark, sf_dir))


@query("capture_results", f"""WITH {RUN_SQL} SELECT id, CASE WHEN k % 10 = 1 THEN 'pass' WHEN k % 10 = 2 THEN 'fail' WHEN k % 7 = 3 THEN 'stale-baseline' WHEN k % 6 = 5 THEN 'missing-baseline' WHEN diff_count > 50000 THEN 'fail' ELSE 'pass' END AS status,
 CASE WHEN k % 10 = 1 THEN 'not due' WHEN k % 10 = 2 THEN 'timeout' WHEN k % 7 = 3 THEN '{reports.STALE}' WHEN k % 6 = 5 THEN 'baseline missing at ' || id || '.png' END AS message FROM run""")
def capture_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _number()
    e = results(spark, sf_dir).select(
        "id", F.when(k % 10 == 1, "not due").alias("skip"), F.when(k % 10 == 2, "timeout").alias("error"), F.sha2("url", 256).alias("hash"),
        F.when(k % 7 == 3, F.lit(None)).otherwise(F.sha2("url", 256)).alias("captured_hash"), (k % 6 != 5).alias("has_baseline"), (F.col("diff_count") > 50000).alias("differs"),
    )
    return reports.capture_results(e)


METHODS = ["core", "ssim", "msssim", "gmsd"]


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _number()
    method = F.element_at(F.array(*map(F.lit, METHODS)), (k % 4 + 1).cast("int"))
    r = results(spark, sf_dir).select("id", method.alias("method"), (k % 12 == 5).alias("created"), "diff_count", "diff_percentage", F.lit(3.0).alias("threshold"), F.when(k % 3 == 0, "percent").otherwise("pixel").alias("kind"))
    pixels = F.col("method") == "core"
    return r.withColumn("score", F.when(~pixels, (k * 31 % 1013) / 1013.0)).withColumns({c: F.when(pixels, F.coalesce(c, F.lit(0))) for c in ("diff_count", "diff_percentage")})


COMPARED_SQL = f"""cp AS (SELECT id, {_LIST(METHODS)}[k % 4 + 1] AS method, k % 12 = 5 AS created, CASE WHEN k % 3 = 0 THEN 'percent' ELSE 'pixel' END AS kind,
 CASE WHEN k % 4 = 0 THEN coalesce(diff_count, 0) END AS diff_count, CASE WHEN k % 4 = 0 THEN coalesce(diff_percentage, 0) END AS diff_percentage, CASE WHEN k % 4 <> 0 THEN (k * 31 % 1013) / 1013.0::DOUBLE END AS score FROM run),
ps AS (SELECT *, CASE WHEN method LIKE '%ssim' THEN CASE WHEN kind = 'percent' THEN (1 - score) * 100 <= 3 ELSE score >= 1 - 3.0::DOUBLE / 100 END
 WHEN method = 'gmsd' THEN CASE WHEN kind = 'percent' THEN score * 100 <= 3 ELSE score <= 3.0::DOUBLE / 100 END ELSE CASE WHEN kind = 'percent' THEN diff_percentage <= 3 ELSE diff_count <= 3 END END AS pass FROM cp)"""


def _passed():
    test = lambda kind: F.coalesce(*[F.when(F.col("method") == m, passes(m, 3.0, kind)) for m in METHODS])
    return F.when(F.col("kind") == "percent", test("percent")).otherwise(test("pixel"))


@query("exit_codes", f"WITH {RUN_SQL}, {COMPARED_SQL} SELECT id, CASE WHEN method LIKE '%ssim' THEN CASE WHEN score >= {reports.SSIM_LEAST} THEN 0 ELSE 1 END WHEN diff_count > 0 OR diff_count IS NULL THEN 1 ELSE 0 END AS exit_code FROM cp")
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.exit_codes(_compared(spark, sf_dir)).select("id", "exit_code")


@query("match_messages", f"WITH {RUN_SQL}, {COMPARED_SQL} SELECT id, pass, CASE WHEN pass THEN 'Images match.' WHEN diff_count IS NOT NULL THEN 'Images differ: ' || diff_count || ' pixels' ELSE 'Images differ: score' END AS message FROM ps")
def match_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons without a snapshot; scores' digits are left out, as each engine prints doubles its own way."""
    c = _compared(spark, sf_dir).withColumn("pass", _passed())
    return c.select("id", "pass", F.regexp_replace(reports.match_message(F.col("pass")), r"[0-9.E-]+ score$", "score").alias("message"))


@query("snapshot_messages", f"""WITH {RUN_SQL}, {COMPARED_SQL} SELECT id, CASE WHEN created THEN 'New snapshot created' || chr(10) || '  ' || id || '.png' WHEN pass THEN 'Image matches snapshot'
 ELSE concat_ws(chr(10), 'Image snapshot mismatch', '  Method      ' || method, '  Baseline    ' || id || '.png', '  Diff        ' || id || '.diff.png',
  CASE WHEN method LIKE '%ssim' THEN printf('  SSIM Score  %.4f (1.0 = identical)', score) WHEN method = 'gmsd' THEN printf('  GMSD Score  %.4f (0.0 = identical)', score) END,
  CASE WHEN method LIKE '%ssim' THEN printf('  Difference  %.2f%%', (1 - score) * 100) WHEN method = 'core' THEN '  Difference  ' || format('{{:,}}', diff_count) || printf(' pixels (%.2f%%)', diff_percentage) END,
  '  Threshold   3.0 ' || CASE WHEN kind = 'percent' THEN '%' ELSE 'pixels' END) END AS message FROM ps""")
def snapshot_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("id", reports.snapshot_message(_passed()).alias("message"))


@query("region_crops", f"""WITH {RUN_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pixels DESC, region) AS rank FROM rg QUALIFY rank <= 5)
SELECT id, region, rank, greatest(0, x - 16) AS x, greatest(0, y - 16) AS y, greatest(1, least(320, x + width + 16) - greatest(0, x - 16)) AS width, greatest(1, least(240, y + height + 16) - greatest(0, y - 16)) AS height FROM t""")
def region_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest regions of each page, with a margin, within an image of 320 x 240."""
    return reports.top_regions(regions(spark, sf_dir)).select("id", "region", "rank", *catalog.pad_and_clamp(16, 320, 240))


@query("dimension_labels", """WITH d AS (SELECT p_partkey, p_size AS w1, p_partkey % 37 + 1 AS h1, p_size + p_partkey % 3 - 1 AS w2, p_partkey % 37 + 1 + p_partkey % 5 // 2 AS h2 FROM part)
SELECT p_partkey, CASE WHEN w1 = w2 AND h1 = h2 THEN w1 || '×' || h1 ELSE 'Dimensions changed: ' || w1 || '×' || h1 || ' → ' || w2 || '×' || h2 || ' (' || CASE WHEN w2 > w1 THEN '+' ELSE '' END || (w2 - w1) || '×' || CASE WHEN h2 > h1 THEN '+' ELSE '' END || (h2 - h1) || ')' END AS label FROM d""")
def dimension_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, w, h = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey") % 37 + 1
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", reports.dimension_label(w, h, (w + k % 3 - 1).cast("long"), h + F.expr("p_partkey % 5 div 2")).alias("label"))


_EXT = ["png", "JPG", "jpeg", "qoi", "webp", "Png"]
_MAGIC = ["89504E470D0A1A0A0000", "FFD8FFE000104A46", "716F696600000010", "89504E47", "474946383961"]
# fixed values of the formats' first bytes are in operators/reports.py


@query("image_formats", f"""WITH d AS (SELECT page_id, {_LIST(_EXT)}[page_id % 6 + 1] AS ext, {_LIST(_MAGIC)}[page_id % 5 + 1] AS head FROM pages)
SELECT page_id, CASE lower(ext) WHEN 'png' THEN 'png' WHEN 'jpg' THEN 'jpeg' WHEN 'jpeg' THEN 'jpeg' WHEN 'qoi' THEN 'qoi' END AS by_path,
 CASE WHEN head LIKE '89504E470D0A1A0A%' THEN 'png' WHEN head LIKE 'FFD8FF%' THEN 'jpeg' WHEN head LIKE '716F6966%' THEN 'qoi' END AS by_bytes FROM d""")
def image_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % len(names) + 1).cast("int"))
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(F.lit("/shots/v1.2/p"), F.col("page_id").cast("string"), F.lit("."), pick(_EXT)).alias("path"), F.unhex(pick(_MAGIC)).alias("content"))
    return p.select("page_id", reports.format_of_path(F.col("path")).alias("by_path"), reports.format_of_bytes(F.col("content")).alias("by_bytes"))


@query("file_pairs", """WITH f AS (SELECT 'set/' || (page_id // 3) || CASE page_id % 3 WHEN 0 THEN 'a.png' WHEN 1 THEN CASE WHEN page_id % 4 = 0 THEN 'b.jpg' ELSE 'b.png' END ELSE 'c.png' END AS path FROM pages)
SELECT substr(a.path, 1, length(a.path) - 5) AS name, a.path AS a, b.path AS b FROM f a JOIN f b ON a.path LIKE '%a.png' AND b.path = substr(a.path, 1, length(a.path) - 5) || 'b.png'""")
def file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    end = F.when(i % 3 == 0, "a.png").when((i % 3 == 1) & (i % 4 == 0), "b.jpg").when(i % 3 == 1, "b.png").otherwise("c.png")
    return reports.file_pairs(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("set/"), F.expr("page_id div 3").cast("string"), end).alias("path")))


@query("manifest_removed", f"WITH {RUN_SQL} SELECT id, url FROM run WHERE NOT (status = 'fail' AND review = 'approved') OR review IS NULL")
def manifest_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir)
    return reports.without(r.select("id", "url"), r.filter("status = 'fail' AND review = 'approved'"))


@query("pair_validation", """WITH d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 3 THEN 0 ELSE o_orderkey % 50 + 1 END AS w, o_orderkey % 40 + 1 AS h FROM orders),
s AS (SELECT k, w, h, CASE WHEN k % 6 = 4 THEN NULL ELSE w * h * 4 + CASE WHEN k % 7 = 1 THEN 4 ELSE 0 END END AS s1, w * h * 4 + CASE WHEN k % 7 = 1 OR k % 8 = 2 THEN 4 ELSE 0 END AS s2 FROM d)
SELECT k AS o_orderkey, CASE WHEN w <= 0 THEN 'empty image' WHEN s1 IS NULL THEN 'missing image' WHEN s1 <> s2 THEN 'image sizes do not match' WHEN s1 <> w * h * 4 THEN 'image data size does not match width and height' END AS reason FROM s""")
def pair_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    w, h = F.when(k % 10 == 3, 0).otherwise(k % 50 + 1), k % 40 + 1
    one = F.when(k % 6 == 4, None).otherwise(w * h * 4 + F.when(k % 7 == 1, 4).otherwise(0))
    two = w * h * 4 + F.when((k % 7 == 1) | (k % 8 == 2), 4).otherwise(0)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k, reports.invalid_reason(w, h, one, two).alias("reason"))
