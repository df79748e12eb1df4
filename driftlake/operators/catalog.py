"""Catalogues of routes and snapshots: deduplication, sampling, upserts, lookups, links and reachability.

Groups are never gathered: the first rows of a group come from row_number() <= n, for which Spark keeps n rows of a
group in each task before it shuffles, and sizes of groups are counted apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.sources.scratch import kept

THRESHOLD, SAMPLES = 5, 2
MAX_ROUTES, MAX_DEPTH = 50, 2
HOOKS = 1  # version of what a capture does to a page, part of its hash


def path_part(url: Column) -> Column:
    return F.regexp_extract(url, "^[^?]*", 0)


def normal_path(url: Column) -> Column:
    """Without trailing slashes; the query stays."""
    path = F.regexp_replace(path_part(url), "/+$", "")
    query = F.regexp_extract(url, "^[^?]*\\?([^?]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    return F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), query))


def parent_path(url: Column) -> Column:
    up = F.regexp_extract(path_part(url), "^(.*)/[^/]*$", 1)
    return F.when(up == "", "/").otherwise(up)


def first_by(df: DataFrame, key: str, order: str, n: int = 1) -> DataFrame:
    """The first n rows of every key."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= n).drop("_nth")


def distinct_routes(routes: DataFrame, url: str = "url", pos: str = "pos") -> DataFrame:
    """One route for each normal path, the first."""
    return first_by(routes.withColumn(url, normal_path(F.col(url))), url, pos)


def collapse_templates(routes: DataFrame, threshold: int = THRESHOLD, samples: int = SAMPLES, url: str = "url", pos: str = "pos", by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(routes, notes): of `threshold` or more routes under one parent that is not the root the first `samples` stay, with a
    note for each such parent (parent, size, note).  With `by`, parents count apart for each value of these columns."""
    group = [*by, "_parent"]
    named = routes.withColumn("_parent", parent_path(F.col(url)))
    large = named.filter("_parent <> '/'").groupBy(*group).agg(F.count("*").alias("size")).filter(F.col("size") >= threshold)
    small = named.join(large, group, "left_anti")
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(pos))
    sampled = named.filter("_parent <> '/'").withColumn("_nth", nth).filter(F.col("_nth") <= samples).drop("_nth").join(large.select(*group), group, "left_semi")
    note = F.concat("_parent", F.lit("/* ("), F.col("size").cast("string"), F.lit(f" → {samples})"))
    return small.unionByName(sampled).select(routes.columns), large.select(*by, F.col("_parent").alias("parent"), "size", note.alias("note"))


def upsert(entries: DataFrame, incoming: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """Entries with those of the same key replaced; of several that come in the last one wins."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    last = incoming.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth", order)
    return entries.join(last, key, "left_anti").unionByName(last, allowMissingColumns=True)


def fold_captures(entries: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, errors): rows (pos, id, url, parent, derived) are judged one by one; a bad row is an error and changes nothing.
    The children of a base that comes in go first, then bases and children are put in; errors keep their positions."""
    error = F.when(F.coalesce("id", F.lit("")) == "", "id is missing").when(~F.coalesce("url", F.lit("")).startswith("/"), "url must start with /")
    judged = rows.withColumn("error", error)
    good = judged.filter("error IS NULL").drop("error")
    bases = good.filter(~is_derived()).select(F.col("id").alias("parent")).distinct()
    left = entries.join(bases, "parent", "left_anti").unionByName(entries.join(bases, "parent", "left_semi").filter(~is_derived()))
    return upsert(left, good), judged.filter("error IS NOT NULL").select("pos", "id", "error")


def is_derived() -> Column:
    return F.coalesce("derived", F.lit(False)) | (F.col("parent").isNotNull() & F.contains(F.col("id"), F.lit("__")))


def sub_name() -> Column:
    """The part of a derived id after its first __."""
    at = F.instr("id", "__")
    return F.when(is_derived() & (at > 0), F.substring(F.col("id"), at + 2, F.length("id")))


def orphans(entries: DataFrame) -> DataFrame:
    """Derived entries whose parent is not there."""
    return entries.filter(is_derived() & F.col("parent").isNotNull()).join(entries.select(F.col("id").alias("parent")), "parent", "left_anti").select(entries.columns)


def children(entries: DataFrame) -> DataFrame:
    """(id, child): every entry with its children."""
    return entries.select("id").join(entries.select(F.col("parent").alias("id"), F.col("id").alias("child")), "id")


def capture_hash() -> Column:
    """SHA-256 of what decides a capture's pixels (url, mask, wait, full_page, sub name), masks in order."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    mask = F.array_join(F.transform(F.array_sort("mask"), quoted), ",")
    text = F.concat(
        F.lit('{"url":'), quoted(F.col("url")), F.lit(',"mask":['), mask, F.lit('],"waitFor":'), quoted(F.col("wait_for")), F.lit(',"fullPage":'), F.col("full_page").cast("string"),
        F.lit(',"subName":'), F.coalesce(quoted(sub_name()), F.lit("null")), F.lit(f',"hooks":{HOOKS}}}'),
    )
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def totals(results: DataFrame) -> DataFrame:
    """One row: total, passed, failed, pending."""
    passed, pending = F.count_if(F.col("status") == "pass"), F.count_if(F.col("status") == "needs-judgment")
    return results.agg(F.count("*").alias("total"), passed.alias("passed"), pending.alias("pending")).withColumn("failed", F.col("total") - F.col("passed") - F.col("pending"))


def with_passes(entries: DataFrame, judged: DataFrame) -> DataFrame:
    """(id, status): what was judged, and a pass for every entry that was not."""
    passes = entries.join(judged, "id", "left_anti").select("id", F.lit("pass").alias("status"))
    return passes.unionByName(judged.select("id", "status"))


def pad_and_clamp(padding: int, width: int, height: int) -> list[Column]:
    """A box (x, y, width, height) with a margin, within the image."""
    left, top = F.greatest(F.lit(0), F.col("x") - padding), F.greatest(F.lit(0), F.col("y") - padding)
    right, bottom = F.least(F.lit(width), F.col("x") + F.col("width") + padding), F.least(F.lit(height), F.col("y") + F.col("height") + padding)
    return [left.alias("x"), top.alias("y"), F.greatest(F.lit(1), right - left).alias("width"), F.greatest(F.lit(1), bottom - top).alias("height")]


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, src, dst, ord): same-host links of every page, as paths with their queries, in page order; fragments, mail, telephone
    and /api/ targets are left out."""
    base = F.regexp_extract(url, "^([a-z]+://[^/?#]*)", 1)
    here = F.regexp_replace(F.regexp_replace(F.col(url), "^[a-z]+://[^/?#]*", ""), "#.*$", "")
    each = pages.select(base.alias("host"), F.when(here == "", "/").otherwise(here).alias("src"), F.posexplode(F.regexp_extract_all(html, F.lit("<a\\s[^>]*?href=\"([^\"]*)\""), F.lit(1))).alias("ord", "href"))
    each = each.filter("href <> '' AND NOT href LIKE '#%' AND NOT href LIKE 'mailto:%' AND NOT href LIKE 'tel:%'")
    absolute = F.col("href").rlike("^[a-z]+://")
    folder = F.concat(F.regexp_extract(path_part(F.col("src")), "^(.*)/[^/]*$", 1), F.lit("/"))
    target = F.when(absolute, F.regexp_replace("href", "^[a-z]+://[^/?#]*", "")).when(F.col("href").startswith("/"), F.col("href")).when(F.col("href").startswith("?"), F.concat(path_part(F.col("src")), "href")).otherwise(F.concat(folder, "href"))
    target = F.regexp_replace(target, "#.*$", "")
    each = each.filter(~absolute | (F.regexp_extract("href", "^([a-z]+://[^/?#]*)", 1) == F.col("host")))
    return each.select("host", "src", F.when(target == "", "/").otherwise(target).alias("dst"), "ord").filter("NOT dst LIKE '/api/%'")


def reachable(edges: DataFrame, start: DataFrame, max_depth: int = MAX_DEPTH, max_routes: int | None = MAX_ROUTES) -> DataFrame:
    """(host, url, depth): pages within max_depth links of the start (host, url), at most max_routes a host, nearer ones first.  Both caps
    are the crawl's feature; None lifts the second."""
    found = kept(start.select("host", "url").distinct().withColumn("depth", F.lit(0)))
    frontier = found
    for depth in range(1, max_depth + 1):
        near = frontier.select("host", F.col("url").alias("src")).join(edges, ["host", "src"]).select("host", F.col("dst").alias("url")).distinct()
        frontier = kept(near.join(found, ["host", "url"], "left_anti").withColumn("depth", F.lit(depth)))
        found = found.unionByName(frontier)
    if max_routes is None:
        return found
    w = Window.partitionBy("host").orderBy("depth", "url")
    return found.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= max_routes).drop("_nth")


def stale(entries: DataFrame) -> DataFrame:
    """Entries (hash, captured_hash) that were edited since they were captured."""
    return entries.filter(~F.col("hash").eqNullSafe(F.col("captured_hash")))


def discovered(pages: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH, max_routes: int | None = MAX_ROUTES) -> DataFrame:
    """(host, url, depth): what a crawl of each host finds from its start, one route for each normal path, the nearest.  The caps on depth
    and routes are the crawl's feature; None lifts the latter."""
    found = reachable(links(pages), starts, max_depth, max_routes)
    w = Window.partitionBy("host", "url").orderBy("depth")
    return found.withColumn("url", normal_path(F.col("url"))).withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def discover(pages: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH, max_routes: int | None = MAX_ROUTES, threshold: int | None = THRESHOLD, samples: int = SAMPLES) -> DataFrame:
    """(host, nth, url, depth): discovered() routes with large groups under one parent cut to the first few (the nearest, then by URL; with no
    threshold all stay), numbered as people list them: by the root collation, in which case and accents come last."""
    routes = discovered(pages, starts, max_depth, max_routes)
    if threshold is not None:
        routes = collapse_templates(routes.withColumn("_pos", F.struct("depth", "url")), threshold, samples, pos="_pos", by=("host",))[0].drop("_pos")
    listed = F.row_number().over(Window.partitionBy("host").orderBy(F.collate("url", "UNICODE"), "url"))
    return routes.select("host", listed.alias("nth"), "url", "depth")
