"""Queries over catalogues derived from the pages table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.operators import catalog
from driftlake.plans.registry import query

# Routes: the path of every page's URL, each third one with a slash at its end.
ROUTES_SQL = "routes AS (SELECT page_id AS pos, concat(regexp_replace(url, '^[a-z]+://[^/]*', ''), CASE WHEN page_id % 3 = 0 AND NOT contains(url, '?') THEN '/' ELSE '' END) AS url FROM pages)"
NORMAL_SQL = """nr AS (SELECT *, regexp_replace(regexp_extract(url, '^[^?]*'), '/+$', '') AS p0, regexp_extract(url, '^[^?]*\\?([^?]*)', 1) AS q FROM routes),
nu AS (SELECT pos, CASE WHEN p0 = '' THEN '/' ELSE p0 END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url FROM nr),
dr AS (SELECT url, min(pos) AS pos FROM nu GROUP BY url),
pr AS (SELECT *, CASE WHEN regexp_extract(regexp_extract(url, '^[^?]*'), '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(regexp_extract(url, '^[^?]*'), '^(.*)/[^/]*$', 1) END AS parent FROM dr),
rk AS (SELECT *, count(*) OVER (PARTITION BY parent) AS size, row_number() OVER (PARTITION BY parent ORDER BY pos) AS nth FROM pr)"""


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    slash = F.when((F.col("page_id") % 3 == 0) & ~F.contains("url", F.lit("?")), "/").otherwise("")
    return p.select(F.col("page_id").alias("pos"), F.concat(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), slash).alias("url"))


@query("route_dedupe", f"WITH {ROUTES_SQL}, {NORMAL_SQL} SELECT pos, url FROM dr")
def route_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.distinct_routes(routes(spark, sf_dir))


@query("route_collapse", f"WITH {ROUTES_SQL}, {NORMAL_SQL} SELECT pos, url FROM rk WHERE parent = '/' OR size < 5 OR nth <= 2")
def route_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.collapse_templates(catalog.distinct_routes(routes(spark, sf_dir)))[0]


@query("route_collapse_notes", f"WITH {ROUTES_SQL}, {NORMAL_SQL} SELECT DISTINCT parent, size, parent || '/* (' || size || ' → 2)' AS note FROM rk WHERE parent <> '/' AND size >= 5")
def route_collapse_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.collapse_templates(catalog.distinct_routes(routes(spark, sf_dir)))[1]


HREFS = """hr AS (SELECT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS host, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '#.*$', '') AS s0,
       unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1), 1) - 1 AS ord FROM pages),
h2 AS (SELECT *, CASE WHEN s0 = '' THEN '/' ELSE s0 END AS src, regexp_matches(href, '^[a-z]+://') AS abs FROM hr WHERE href <> '' AND NOT href LIKE '#%' AND NOT href LIKE 'mailto:%' AND NOT href LIKE 'tel:%'),
h3 AS (SELECT host, src, ord, regexp_replace(CASE WHEN abs THEN regexp_replace(href, '^[a-z]+://[^/?#]*', '') WHEN href LIKE '/%' THEN href WHEN href LIKE '?%' THEN regexp_extract(src, '^[^?]*') || href
       ELSE regexp_extract(regexp_extract(src, '^[^?]*'), '^(.*)/[^/]*$', 1) || '/' || href END, '#.*$', '') AS d0 FROM h2 WHERE NOT abs OR regexp_extract(href, '^([a-z]+://[^/?#]*)', 1) = host),
lk AS (SELECT host, src, CASE WHEN d0 = '' THEN '/' ELSE d0 END AS dst, CAST(ord AS INT) AS ord FROM h3 WHERE NOT d0 LIKE '/api/%')"""


@query("link_extract", f"WITH {HREFS} SELECT host, src, dst, ord FROM lk")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.links(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("crawl_reach", f"""WITH {HREFS}, st AS (SELECT DISTINCT host, src AS url, 0 AS depth FROM (SELECT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS host, min(CASE WHEN s1 = '' THEN '/' ELSE s1 END) AS src
  FROM (SELECT url, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '#.*$', '') AS s1 FROM pages) GROUP BY 1)),
one AS (SELECT DISTINCT host, dst AS url, 1 AS depth FROM lk JOIN st USING (host) WHERE src = st.url AND (host, dst) NOT IN (SELECT (host, url) FROM st)),
two AS (SELECT DISTINCT host, dst AS url, 2 AS depth FROM lk JOIN one USING (host) WHERE src = one.url AND (host, dst) NOT IN (SELECT (host, url) FROM st UNION ALL SELECT (host, url) FROM one)),
al AS (SELECT * FROM st UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two)
SELECT host, url, depth FROM al QUALIFY row_number() OVER (PARTITION BY host ORDER BY depth, url) <= 50""")
def crawl_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages within two links of each host's first page, at most fifty a host."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    here = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/?#]*", ""), "#.*$", "")
    start = pages.groupBy(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1).alias("host")).agg(F.min(F.when(here == "", "/").otherwise(here)).alias("url"))
    return catalog.reachable(catalog.links(pages), start)


DISCOVERED_SQL = f"""WITH {HREFS}, st AS (SELECT DISTINCT host, src AS url, 0 AS depth FROM (SELECT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS host, min(CASE WHEN s1 = '' THEN '/' ELSE s1 END) AS src
  FROM (SELECT url, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '#.*$', '') AS s1 FROM pages) GROUP BY 1)),
one AS (SELECT DISTINCT host, dst AS url, 1 AS depth FROM lk JOIN st USING (host) WHERE src = st.url AND (host, dst) NOT IN (SELECT (host, url) FROM st)),
al AS (SELECT * FROM st UNION ALL SELECT * FROM one),
nm AS (SELECT host, depth, regexp_replace(regexp_extract(url, '^[^?]*'), '/+$', '') AS p0, regexp_extract(url, '^[^?]*\\?([^?]*)', 1) AS q FROM al)
SELECT host, CASE WHEN p0 = '' THEN '/' ELSE p0 END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url, min(depth) AS depth FROM nm GROUP BY ALL"""


@query("discovered_routes", DISCOVERED_SQL)
def discovered_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every normal path that a host's first page leads to, without a cap."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    here = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/?#]*", ""), "#.*$", "")
    start = pages.groupBy(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1).alias("host")).agg(F.min(F.when(here == "", "/").otherwise(here)).alias("url"))
    return catalog.discovered(pages, start, max_depth=1, max_routes=None)


# The root collation by hand, for the signs that URLs hold: letters and signs first, then accents, then case.
SIGNS = "_-,;:!?.@*/&#%+=~$0123456789abcdefghijklmnopqrstuvwxyz"
PRIMARY = f"translate(replace(lower(strip_accents(url)), 'ß', 'ss'), '{SIGNS}', '{''.join(chr(40 + i) for i in range(len(SIGNS)))}')"
ACCENTS = "regexp_replace(translate(lower(url), 'áéíóúàèìòùâêîôûäëïöüñç', '1111122222333334444456'), '[^1-6]', '0', 'g')"
CASE = "regexp_replace(regexp_replace(url, '[^A-ZÀ-Þ]', '0', 'g'), '[A-ZÀ-Þ]', '1', 'g')"


@query("discover", f"""WITH dc AS ({DISCOVERED_SQL}), pt AS (SELECT *, regexp_extract(regexp_extract(url, '^[^?]*'), '^(.*)/[^/]*$', 1) AS parent FROM dc),
rn AS (SELECT *, count(*) OVER (PARTITION BY host, parent) AS size, row_number() OVER (PARTITION BY host, parent ORDER BY depth, url) AS k FROM pt)
SELECT host, row_number() OVER (PARTITION BY host ORDER BY {PRIMARY}, {ACCENTS}, {CASE}, url) AS nth, url, depth FROM rn WHERE parent = '' OR size < 2 OR k <= 1""")
def discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes one link from each host's first page, one for each parent, in collated order."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    here = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/?#]*", ""), "#.*$", "")
    start = pages.groupBy(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1).alias("host")).agg(F.min(F.when(here == "", "/").otherwise(here)).alias("url"))
    return catalog.discover(pages, start, max_depth=1, max_routes=None, threshold=2, samples=1)


# A manifest: three entries of four are base entries, the fourth is derived from the one before it, or, every fifth time, from one that is gone.
ENTRIES = """CASE WHEN page_id % 4 = 3 THEN concat('p', CAST(page_id - 1 AS STRING), '__menu') ELSE concat('p', CAST(page_id AS STRING)) END AS id,
regexp_replace(url, '^[a-z]+://[^/]*', '') AS url, CASE WHEN page_id % 20 = 3 THEN concat('gone', CAST(page_id AS STRING)) WHEN page_id % 4 = 3 THEN concat('p', CAST(page_id - 1 AS STRING)) END AS parent, page_id % 8 = 3 AS derived"""
ENTRIES_SQL = f"en AS (SELECT {ENTRIES}, page_id, length(html) AS size FROM pages)"
DERIVED = "(coalesce(derived, false) OR (parent IS NOT NULL AND contains(id, '__')))"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr(*[x for x in _split(ENTRIES)])


def _split(columns: str) -> list[str]:
    """The four columns of ENTRIES, apart."""
    id_, rest = columns.split(" AS id,\n")
    url, rest = rest.split(" AS url, ")
    parent, derived = rest.split(" AS parent, ")
    return [f"{id_} AS id", f"{url} AS url", f"{parent} AS parent", derived]


@query("orphans", f"WITH {ENTRIES_SQL} SELECT id, parent FROM en WHERE {DERIVED} AND parent IS NOT NULL AND parent NOT IN (SELECT id FROM en)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.orphans(entries(spark, sf_dir)).select("id", "parent")


@query("children", f"WITH {ENTRIES_SQL} SELECT e.id, c.id AS child FROM en e JOIN en c ON c.parent = e.id")
def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.children(entries(spark, sf_dir))


@query("sub_names", f"WITH {ENTRIES_SQL} SELECT id, {DERIVED} AS derived, CASE WHEN {DERIVED} AND instr(id, '__') > 0 THEN substr(id, instr(id, '__') + 2) END AS sub_name FROM en")
def sub_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("id", catalog.is_derived().alias("derived"), catalog.sub_name().alias("sub_name"))


@query("manifest_upsert", f"WITH {ENTRIES_SQL}, inc AS (SELECT concat('p', CAST(page_id // 3 * 3 AS STRING)) AS id, concat('/new/', CAST(page_id AS STRING)) AS url, page_id AS pos FROM pages), lst AS (SELECT id, arg_max(url, pos) AS url FROM inc GROUP BY id) SELECT id, url FROM en WHERE id NOT IN (SELECT id FROM lst) UNION ALL SELECT id, url FROM lst")
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    incoming = p.select(F.concat(F.lit("p"), F.expr("page_id div 3 * 3").cast("string")).alias("id"), F.concat(F.lit("/new/"), F.col("page_id").cast("string")).alias("url"), F.col("page_id").alias("pos"))
    return catalog.upsert(entries(spark, sf_dir).select("id", "url"), incoming)


@query("capture_fold", f"""WITH {ENTRIES_SQL}, inc AS (SELECT page_id AS pos, CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 4 = 2 THEN concat('p', CAST(page_id AS STRING)) ELSE concat('p', CAST(page_id // 4 * 4 + 2 AS STRING), '__new') END AS id,
 CASE WHEN page_id % 13 = 0 THEN 'x' ELSE '/cap' END AS url, CASE WHEN page_id % 4 <> 2 THEN concat('p', CAST(page_id // 4 * 4 + 2 AS STRING)) END AS parent, page_id % 4 <> 2 AS derived FROM pages),
good AS (SELECT * FROM inc WHERE id IS NOT NULL AND url LIKE '/%'), bs AS (SELECT id FROM good WHERE NOT {DERIVED}),
lft AS (SELECT id, url, parent, derived FROM en WHERE NOT (parent IS NOT NULL AND parent IN (SELECT id FROM bs) AND {DERIVED})), lst AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos DESC) = 1)
SELECT id, url, parent FROM lft WHERE id NOT IN (SELECT id FROM lst) UNION ALL SELECT id, url, parent FROM lst""")
def capture_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    base = F.concat(F.lit("p"), F.expr("CAST(page_id div 4 * 4 + 2 AS STRING)"))
    own, i = F.col("page_id") % 4 == 2, F.col("page_id")
    rows = p.select(
        i.alias("pos"), F.when(i % 11 == 0, None).when(own, F.concat(F.lit("p"), i.cast("string"))).otherwise(F.concat(base, F.lit("__new"))).alias("id"),
        F.when(i % 13 == 0, "x").otherwise("/cap").alias("url"), F.when(~own, base).alias("parent"), (~own).alias("derived"),
    )
    return catalog.fold_captures(entries(spark, sf_dir), rows)[0].select("id", "url", "parent")


HASHED = "concat('{{\"url\":\"', url, '\",\"mask\":[', {mask}, '],\"waitFor\":\"load\",\"fullPage\":', CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'false' END, ',\"subName\":', {sub}, ',\"hooks\":1}}')"
HASHED_SQL = HASHED.format(mask="CASE WHEN page_id % 3 = 0 THEN '\".ad\",\".clock\"' ELSE '' END", sub=f"CASE WHEN {DERIVED} AND instr(id, '__') > 0 THEN concat('\"', substr(id, instr(id, '__') + 2), '\"') ELSE 'null' END")


@query("capture_hashes", f"WITH {ENTRIES_SQL} SELECT id, 'sha256:' || sha256({HASHED_SQL}) AS capture_hash FROM en")
def capture_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    e = p.selectExpr(*_split(ENTRIES), "'load' AS wait_for", "page_id % 2 = 0 AS full_page", "CASE WHEN page_id % 3 = 0 THEN array('.clock', '.ad') ELSE array() END AS mask")
    return e.select("id", catalog.capture_hash().alias("capture_hash"))


STATUS = "CASE WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'signup' THEN 'needs-judgment' WHEN event_type = 'purchase' THEN 'missing-baseline' ELSE 'pass' END"


@query("report_counts", f"SELECT count(*) AS total, count(*) FILTER (s = 'pass') AS passed, count(*) FILTER (s = 'needs-judgment') AS pending, count(*) FILTER (s NOT IN ('pass', 'needs-judgment')) AS failed FROM (SELECT {STATUS} AS s FROM events)")
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.totals(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(STATUS).alias("status")))


@query("report_from_judgements", f"WITH {ENTRIES_SQL}, jd AS (SELECT id, CASE WHEN page_id % 3 = 0 THEN 'fail' ELSE 'needs-judgment' END AS status FROM en WHERE size > 3000) SELECT id, status FROM jd UNION ALL SELECT id, 'pass' FROM en WHERE id NOT IN (SELECT id FROM jd)")
def report_from_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr(*_split(ENTRIES), "page_id", "length(html) AS size")
    judged = p.filter("size > 3000").select("id", F.when(F.col("page_id") % 3 == 0, "fail").otherwise("needs-judgment").alias("status"))
    return catalog.with_passes(p.select("id"), judged)


@query("stale_entries", f"WITH {ENTRIES_SQL} SELECT id FROM en WHERE page_id % 7 = 3 OR page_id % 9 = 4")
def stale_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose capture has another hash, or none."""
    i = F.col("page_id")
    e = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr(*_split(ENTRIES), "page_id").withColumn("hash", F.sha2("url", 256))
    return catalog.stale(e.withColumn("captured_hash", F.when(i % 7 == 3, F.concat("hash", F.lit("0"))).when(i % 9 != 4, F.col("hash")))).select("id")
