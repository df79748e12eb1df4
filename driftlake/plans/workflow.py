"""Queries over streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.plans.registry import query
from driftlake.sources.scratch import new_path
from driftlake.sources.baselines import Baselines
from driftlake.streaming import approvals, checks


@query("latest_state_stream", "SELECT user_id, count(*) AS events, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY user_id")
def latest_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event, folded as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return checks.run_latest(spark, f"{sf_dir}/events.parquet*", schema, new_path(spark, "stream"), "user_id", ["ts", "event_id"], ["event_type", "props"])


@query("pending_requests", "SELECT event_id AS id, user_id FROM events WHERE event_type = 'signup' AND event_id + 1 NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase')")
def pending_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups that the next event doesn't answer with a purchase."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    asked = e.filter("event_type = 'signup'").select(F.col("event_id").alias("id"), "user_id")
    return checks.pending(asked, e.filter("event_type = 'purchase'").select((F.col("event_id") - 1).alias("id")))


APPROVALS_SQL = """ev AS (SELECT user_id AS k, CASE event_type WHEN 'signup' THEN 'request' WHEN 'purchase' THEN 'verdict' END AS kind, ts, event_id FROM events WHERE event_type IN ('signup', 'purchase') AND user_id IS NOT NULL),
nx AS (SELECT k, kind, event_id, lead(kind) OVER w AS then_kind, lead(event_id) OVER w AS then_id FROM ev WINDOW w AS (PARTITION BY k ORDER BY ts, event_id))"""


@query("approval_outcomes", f"WITH {APPROVALS_SQL} SELECT CAST(k AS VARCHAR) AS key, event_id AS request, CASE then_kind WHEN 'verdict' THEN 'answered' ELSE 'superseded' END AS outcome, then_id AS answer FROM nx WHERE kind = 'request' AND then_id IS NOT NULL")
def approval_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sign-up waits for a purchase by the same user, or for a later sign-up that takes its place."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    kind = F.when(F.col("event_type") == "signup", approvals.REQUEST).when(F.col("event_type") == "purchase", approvals.VERDICT)
    events = checks.read_events(spark, f"{sf_dir}/events.parquet*", schema, files_per_batch=1_000_000).select(F.col("user_id").alias("key"), kind.alias("kind"), F.col("ts").alias("at"), F.col("event_id").alias("number"))
    return approvals.run(spark, events, new_path(spark, "approvals"))


@query("baseline_versions", """WITH p0 AS (SELECT page_id AS id, md5(html) AS digest, page_id % 5 = 0 AS edited, page_id % 7 = 0 AS fresh, page_id % 10 = 0 AS good FROM pages)
SELECT 1 AS version, count(*) AS rows, CAST(sum(id) AS BIGINT) AS ids, count(*) FILTER (digest <> was) AS edited FROM (SELECT *, digest AS was FROM p0) WHERE NOT fresh
UNION ALL SELECT 2, count(*), CAST(sum(id) AS BIGINT), 0 FROM p0
UNION ALL SELECT 3, count(*), CAST(sum(id) AS BIGINT), count(*) FILTER (edited AND good) FROM p0""")
def baseline_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after three commits: a first run, one that adds what is new, and one in which every second edited page was approved."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), F.md5("html").alias("digest"))
    store = Baselines(spark, new_path(spark, "baselines"))
    store.promote(pages.filter("id % 7 <> 0"), F.col("digest") == F.col("old_digest"))
    store.promote(pages, F.col("digest") == F.col("old_digest"))
    edited = pages.filter("id % 5 = 0").withColumn("digest", F.concat("digest", F.lit("!")))
    store.decide(edited, edited.select("id", F.when(F.col("id") % 10 == 0, "approved").otherwise("rejected").alias("decision")))
    counts = lambda n: store.read(n).agg(F.lit(n).alias("version"), F.count("*").alias("rows"), F.sum("id").alias("ids"), F.count_if(F.col("digest").endswith("!")).alias("edited"))
    return counts(1).union(counts(2)).union(counts(3))
