"""Streams, run to their end, and their SQL twins over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalens.config import DEFAULTS
from catalens.functions.pricing import price_decision
from catalens.plans.registry import Registry
from catalens.plans.search_queries import CASE_SQL
from catalens.sources.catalog import LOGICAL, logical_sql
from catalens.sources.keyed_table import BatchLog
from catalens.sources.paged import PagedTable
from catalens.streaming import jobs, ordered

R = Registry()
KINDS = ["click", "error", "purchase", "signup", "view"]
#: Events of a user in order, ``n`` from 1, with the time in microseconds.
ORDERED_SQL = "WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch_us(ts) AS t, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


def events(spark, sf_dir):
    return jobs.stream_table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "event_type", F.col("ts").cast("timestamp").alias("at"))


@R.add(
    "stream_rate_limit",
    ORDERED_SQL + ", r AS (SELECT key, event_id, n, [t] AS log, true AS allowed FROM e WHERE n = 1 UNION ALL "
    "SELECT key, event_id, n, CASE WHEN len(kept) < 2 THEN list_append(kept, t) ELSE kept END, len(kept) < 2 FROM (SELECT e.*, list_filter(r.log, lambda x: x >= e.t - 7200000000) AS kept FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)) SELECT key, event_id, allowed FROM r",
)
def stream_rate_limit(spark, sf_dir):
    """Two events in any two hours for each user."""
    return jobs.drain(events(spark, sf_dir), lambda s: ordered.rate_limit(s, limit=2, seconds=7200))


@R.add(
    "stream_lockout",
    ORDERED_SQL + ", r AS (SELECT key, event_id, n, CASE WHEN failed THEN [t] ELSE []::BIGINT[] END AS log, 0::BIGINT AS until, false AS locked FROM e WHERE n = 1 UNION ALL "
    "SELECT key, event_id, n, CASE WHEN t < until THEN log WHEN NOT failed OR len(recent) >= 2 THEN []::BIGINT[] ELSE recent END, CASE WHEN t >= until AND failed AND len(recent) >= 2 THEN t + 86400000000 ELSE until END, t < until "
    "FROM (SELECT e.*, r.log, r.until, list_append(list_filter(r.log, lambda x: e.t - x < 86400000000), e.t) AS recent FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)) SELECT key, event_id, locked FROM r",
)
def stream_lockout(spark, sf_dir):
    """Two errors within a day lock a user for a day."""
    rows = events(spark, sf_dir).withColumn("failed", F.col("event_type") == "error")
    return jobs.drain(rows, lambda s: ordered.lockout(s, failures=2, seconds=86400))


_BEFORE = "(PARTITION BY product_id, source ORDER BY captured_at, order_no, line_no, price_cents)"


@R.add(
    "stream_price_drift",
    logical_sql("price_history").rstrip() + f", lagged AS (SELECT * EXCLUDE (c, u, t), CASE WHEN captured_at - t <= {DEFAULTS.price_history_retention_days} THEN c END AS previous_cents, CASE WHEN captured_at - t <= {DEFAULTS.price_history_retention_days} THEN u END AS previous_currency "
    f"FROM (SELECT *, lag(price_cents) OVER {_BEFORE} AS c, lag(currency) OVER {_BEFORE} AS u, lag(CAST(captured_at AS DATE)) OVER {_BEFORE} AS t FROM (SELECT * REPLACE (CAST(captured_at AS DATE) AS captured_at) FROM price_history))) SELECT {CASE_SQL} AS decision, count(*) AS n FROM lagged GROUP BY 1",
)
def stream_price_drift(spark, sf_dir):
    """What to do about each new price, seen against the last one of at most the retention's age."""
    rows = jobs.stream_table(spark, sf_dir, "lineitem").selectExpr(*LOGICAL["price_history"][1]).withColumn("at", F.col("captured_at").cast("timestamp"))
    found = jobs.drain(rows, ordered.price_drift)
    decision = price_decision(F.col("price_cents"), F.col("currency"), F.col("previous_cents"), F.col("previous_currency"))
    return found.groupBy(decision.alias("decision")).agg(F.count("*").alias("n"))


@R.add(
    "stream_sessions",
    "WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM marked) "
    "SELECT user_id AS key, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS n_{k}" for k in KINDS) + " FROM numbered GROUP BY user_id, nth",
)
def stream_sessions(spark, sf_dir):
    """Each user's sessions, which end after 30 minutes without an event, with their events by type."""
    return jobs.drain(events(spark, sf_dir), lambda s: jobs.sessions(s, "key", "event_type", KINDS))


@R.add(
    "stream_dedup_window",
    logical_sql("audit_log").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", e AS (SELECT action, product_id, id AS event_id, epoch_us(created_at) AS t, row_number() OVER (PARTITION BY action, product_id ORDER BY created_at, id) AS n FROM audit_log WHERE product_id IS NOT NULL), "
    "r AS (SELECT action, product_id, event_id, n, t AS kept_at, true AS kept FROM e WHERE n = 1 UNION ALL SELECT e.action, e.product_id, e.event_id, e.n, CASE WHEN e.t - r.kept_at < 604800000000 THEN r.kept_at ELSE e.t END, e.t - r.kept_at >= 604800000000 FROM r JOIN e ON e.action = r.action AND e.product_id = r.product_id AND e.n = r.n + 1) SELECT action, product_id, event_id FROM r WHERE kept",
)
def stream_dedup_window(spark, sf_dir):
    """Of each action on a product the first, then none for a week."""
    rows = jobs.stream_table(spark, sf_dir, "events").selectExpr(*LOGICAL["audit_log"][1]).filter("product_id IS NOT NULL")
    rows = rows.select("action", "product_id", F.col("id").alias("event_id"), F.col("created_at").cast("timestamp").alias("at"))
    return jobs.drain(rows, lambda s: ordered.first_of_each(s, {"action": "string", "product_id": "string"}, 7 * 86_400))


@R.add("stream_delivered_once", "SELECT user_id AS key, event_id, event_type, ts AS at FROM events")
def stream_delivered_once(spark, sf_dir):
    """A stream that delivers every event twice, each event once."""
    twice = events(spark, sf_dir).unionByName(events(spark, sf_dir))
    return jobs.drain(twice, lambda s: jobs.delivered_once(s, ["key", "event_id", "event_type"]))


@R.add("stream_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, sf_dir):
    """Events of each type by the hour, the last hours included."""
    return jobs.drain(events(spark, sf_dir), lambda s: jobs.windowed_counts(s, "event_type"))


@R.add("scan_stream_pages", "SELECT CAST(p_partkey // 100 AS BIGINT) AS page, count(*) AS n, min(p_partkey) AS first_key, max(p_partkey) AS last_key FROM part GROUP BY 1")
def scan_stream_pages(spark, sf_dir):
    """The catalogue page by page; the last page may be short."""
    spark.dataSource.register(PagedTable)
    pages = spark.readStream.format("paged_table").option("size", 100).load(f"{sf_dir}/part.parquet")
    folder = jobs.work_folder(spark)
    counted = BatchLog(spark, f"{folder}/pages", "page long, n long, first_key long, last_key long")
    counts = lambda rows: rows.groupBy("page").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"), F.max("p_partkey").alias("last_key"))
    jobs.each_batch(pages, lambda batch, n: counted.append(counts(batch), n), f"{folder}/checkpoint")
    return counted.read().groupBy("page").agg(F.sum("n").alias("n"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))
