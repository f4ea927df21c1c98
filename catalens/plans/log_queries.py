"""Queries over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalens.config import DEFAULTS
from catalens.operators import log as L
from catalens.plans.registry import Registry
from catalens.sources.catalog import LOGICAL, logical, logical_sql
from catalens.sources.keyed_table import BatchLog, KeyedTable
from catalens.streaming import jobs
from catalens.streaming.digest import send_digest

R = Registry()
LOG = logical_sql("audit_log")
NOW_SQL = "(SELECT max(created_at) FROM audit_log)"


def log(spark, sf_dir):
    return logical(spark, sf_dir, "audit_log")


def with_now(spark, sf_dir):
    """The log with the newest event's time as the present, so that results are repeatable."""
    rows = log(spark, sf_dir)
    return rows.crossJoin(F.broadcast(rows.agg(F.max("created_at").alias("now"))))  # one row


def section_sql(key: str) -> str:
    sources, actions, part = L.SECTIONS[key]
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs or [])
    tests = [f"source IN ({quoted(sources)})"] * bool(sources) + [f"action IN ({quoted(actions)})"] * bool(actions) + [f"detail ILIKE '%{part}%'"] * bool(part)
    return "coalesce(" + (" AND ".join(tests) or "true") + ", false)"


BRIEF = ["id", "action", "source", "product_id", "detail", "created_at"]
BRIEF_SQL = ", ".join(BRIEF)


@R.add("scan_log", LOG + f"SELECT {BRIEF_SQL}, confidence, dismissed, notified FROM audit_log")
def scan_log(spark, sf_dir):
    return log(spark, sf_dir).select(*BRIEF, "confidence", "dismissed", "notified")


@R.add("filter_not_dismissed", LOG + f"SELECT {BRIEF_SQL} FROM audit_log WHERE dismissed IS NOT TRUE")
def filter_not_dismissed(spark, sf_dir):
    return log(spark, sf_dir).filter(L.not_dismissed()).select(*BRIEF)


@R.add("filter_section", LOG + " UNION ALL ".join(f"SELECT '{s}' AS section, {BRIEF_SQL} FROM audit_log WHERE {section_sql(s)}" for s in ("inbox_orders", "quality_zero_price", "duplicates")))
def filter_section(spark, sf_dir):
    hits = F.filter(F.array(*[F.when(L.section_predicate(s), F.lit(s)) for s in ("inbox_orders", "quality_zero_price", "duplicates")]), lambda s: s.isNotNull())
    return log(spark, sf_dir).select(F.explode(hits).alias("section"), *BRIEF)  # one scan for all sections


@R.add("filter_search", LOG + f"SELECT {BRIEF_SQL} FROM audit_log WHERE product_name ILIKE '%duct 1_%' OR product_code ILIKE '%duct 1_%' OR product_id ILIKE '%duct 1_%'")
def filter_search(spark, sf_dir):
    return L.search(log(spark, sf_dir), "duct 1_").select(*BRIEF)


@R.add("filter_time_range", LOG + f"SELECT id, created_at, created_at >= {NOW_SQL} - INTERVAL 24 HOUR AS last_day FROM audit_log WHERE created_at >= {NOW_SQL} - INTERVAL 7 DAY")
def filter_time_range(spark, sf_dir):
    rows = with_now(spark, sf_dir).filter("created_at >= now - INTERVAL 7 DAYS")
    return rows.select("id", "created_at", F.expr("created_at >= now - INTERVAL 24 HOURS").alias("last_day"))


@R.add("filter_confidence", LOG + "SELECT id, product_id, round(confidence, 6) AS confidence FROM audit_log WHERE action = 'duplicate_flagged' AND dismissed IS NOT TRUE AND confidence >= 0.95 AND product_id IS NOT NULL")
def filter_confidence(spark, sf_dir):
    rows = log(spark, sf_dir).filter((F.col("action") == "duplicate_flagged") & L.not_dismissed() & (F.col("confidence") >= 0.95) & F.col("product_id").isNotNull())
    return rows.select("id", "product_id", F.round("confidence", 6).alias("confidence"))


LABELS_SQL = "labels_dim AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{i}', '{t}', '{o}')" for a, (i, t, o) in L.LABELS.items()) + ") AS t(action, icon, title, tone))"


def labels(spark):
    return spark.createDataFrame([(a, *x) for a, x in L.LABELS.items()], "action string, icon string, title string, tone string")


@R.add(
    "project_humanize",
    LOG.rstrip()
    + f", {LABELS_SQL} SELECT id, l.action, coalesce(icon, 'info') AS icon, coalesce(title, l.action) AS title, coalesce(tone, 'muted') AS tone, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_iso, product_id, product_name, related_product_id AS related_id, "
    "CASE WHEN json_valid(before) THEN before END AS before, CASE WHEN json_valid(after) THEN after END AS after FROM audit_log l LEFT JOIN labels_dim d ON l.action = d.action",
)
def project_humanize(spark, sf_dir):
    rows = L.humanize(log(spark, sf_dir), labels(spark))
    return rows.select("id", "action", "icon", "title", "tone", "created_iso", "product.product_id", "product.product_name", F.col("related.id").alias("related_id"), "before", "after")


@R.add("join_label_dim", LOG.rstrip() + f", {LABELS_SQL} SELECT l.action, coalesce(max(title), l.action) AS title, count(*) AS n FROM audit_log l LEFT JOIN labels_dim d ON l.action = d.action GROUP BY l.action")
def join_label_dim(spark, sf_dir):
    counts = log(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(labels(spark)), "action", "left").select("action", F.coalesce("title", "action").alias("title"), "n")


@R.add("page_log", LOG + f"SELECT {BRIEF_SQL}, (SELECT count(*) FROM audit_log WHERE {section_sql('duplicates')}) AS total, (SELECT count(*) FROM audit_log WHERE {section_sql('duplicates')}) > 45 AS has_more FROM audit_log WHERE {section_sql('duplicates')} ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 20")
def page_log(spark, sf_dir):
    rows = log(spark, sf_dir).filter(L.section_predicate("duplicates"))
    total = rows.agg(F.count("*").alias("total"))
    return L.page(rows, 20, 25).select(*BRIEF).crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > 45)  # one row


@R.add("topn_recent", LOG + f"SELECT {BRIEF_SQL} FROM audit_log ORDER BY created_at DESC, id DESC LIMIT 15")
def topn_recent(spark, sf_dir):
    return L.page(log(spark, sf_dir), 0, 15).select(*BRIEF)


@R.add("latest_one", LOG + "SELECT action, max(created_at) AS last_at FROM audit_log GROUP BY action")
def latest_one(spark, sf_dir):
    return log(spark, sf_dir).groupBy("action").agg(F.max("created_at").alias("last_at"))


@R.add(
    "timeline",
    logical_sql("audit_log", "catalog") + "SELECT a.product_id, a.id, a.action, a.created_at, row_number() OVER (PARTITION BY a.product_id ORDER BY a.created_at, a.id) AS nth, c.enabled AS now_enabled FROM audit_log a LEFT JOIN catalog c ON a.product_id = c.id WHERE a.product_id IN ('1', '9', '10', '17')",
)
def timeline(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = log(spark, sf_dir).filter(F.col("product_id").isin("1", "9", "10", "17")).select("product_id", "id", "action", "created_at")
    now = logical(spark, sf_dir, "catalog").select(F.col("id").alias("product_id"), F.col("enabled").alias("now_enabled"))
    nth = F.row_number().over(Window.partitionBy("product_id").orderBy("created_at", "id")).cast("long")
    return rows.withColumn("nth", nth).join(now, "product_id", "left")


@R.add("agg_section_counts", LOG + " UNION ALL ".join(f"SELECT '{s}' AS section, count(*) AS n FROM audit_log WHERE {section_sql(s)}" for s in L.SECTIONS))
def agg_section_counts(spark, sf_dir):
    return L.section_counts(log(spark, sf_dir))


@R.add("agg_filtered_count", LOG + f"SELECT count(*) FILTER (WHERE {section_sql('duplicates')} AND dismissed IS NOT TRUE) AS open_duplicates, count(*) FILTER (WHERE source IS NULL) AS without_source FROM audit_log")
def agg_filtered_count(spark, sf_dir):
    return log(spark, sf_dir).agg(F.count_if(L.section_predicate("duplicates") & L.not_dismissed()).alias("open_duplicates"), F.count_if(F.col("source").isNull()).alias("without_source"))


def _pending(s: str) -> str:
    return f"count(*) FILTER (WHERE {section_sql(s)} AND dismissed IS NOT TRUE)"


@R.add(
    "agg_health",
    LOG + "SELECT round(count(*) FILTER (WHERE action = 'verify_passed') / nullif(count(*) FILTER (WHERE action IN ('verify_passed', 'downstream_failed')), 0), 6) AS success_rate, count(*) FILTER (WHERE action = 'verify_passed') AS passed, count(*) FILTER (WHERE action = 'downstream_failed') AS failed, "
    f"{_pending('duplicates')} AS pending_duplicates, {_pending('price_changes')} AS pending_prices, {_pending('quality_issues')} AS pending_quality, max(created_at) AS last_event FROM audit_log",
)
def agg_health(spark, sf_dir):
    return L.health(log(spark, sf_dir))


@R.add("agg_status", LOG + f"SELECT count(DISTINCT product_id) AS products, count(*) AS events, count(*) FILTER (WHERE created_at >= {NOW_SQL} - INTERVAL 24 HOUR) AS last_24h, count(*) FILTER (WHERE created_at >= {NOW_SQL} - INTERVAL 7 DAY) AS last_7d, max(created_at) AS last_at FROM audit_log")
def agg_status(spark, sf_dir):
    return with_now(spark, sf_dir).agg(
        F.countDistinct("product_id").alias("products"),
        F.count("*").alias("events"),
        F.count_if(F.expr("created_at >= now - INTERVAL 24 HOURS")).alias("last_24h"),
        F.count_if(F.expr("created_at >= now - INTERVAL 7 DAYS")).alias("last_7d"),
        F.max("created_at").alias("last_at"),
    )


@R.add("agg_count_distinct", LOG + "SELECT count(DISTINCT product_id) AS tracked FROM audit_log")
def agg_count_distinct(spark, sf_dir):
    return log(spark, sf_dir).agg(F.countDistinct("product_id").alias("tracked"))


def _dup_sql() -> str:
    by = ", ".join(f"CAST(coalesce(sum(CASE WHEN ok THEN CAST(list_contains(coalesce(m, []), '{k}') AS BIGINT) ELSE CAST(coalesce(contains(lower(detail), '{k}'), false) AS BIGINT) END), 0) AS BIGINT) AS by_{k}" for k in ("url", "image", "text"))
    avg = ", ".join(f"round(avg(CASE WHEN ok THEN CAST(after ->> '$.per_strategy_scores.{k}' AS DOUBLE) END), 6) AS avg_{k}" for k in ("url", "image", "text"))
    inner = "SELECT *, coalesce(json_valid(after), false) AS ok, CASE WHEN json_valid(after) THEN CAST(after -> '$.matched_by' AS VARCHAR[]) END AS m, coalesce(confidence, 0) AS c FROM audit_log WHERE action IN ('duplicate_disabled', 'duplicate_flagged')"
    return LOG + f"SELECT count(*) AS total, {by}, count(*) FILTER (WHERE c >= 0.99) AS bucket_99, count(*) FILTER (WHERE c >= 0.95 AND c < 0.99) AS bucket_95, count(*) FILTER (WHERE c >= 0.9 AND c < 0.95) AS bucket_90, count(*) FILTER (WHERE c < 0.9) AS bucket_rest, {avg} FROM ({inner})"


@R.add("agg_dup_histogram", _dup_sql())
def agg_dup_histogram(spark, sf_dir):
    return L.duplicate_histogram(log(spark, sf_dir))


@R.add("agg_budget", LOG + f"SELECT used, greatest(0, {DEFAULTS.daily_budget} - used) AS remaining FROM (SELECT count(*) AS used FROM audit_log WHERE source = 'otapi' AND CAST(created_at AS DATE) = (SELECT CAST(max(created_at) AS DATE) FROM audit_log))")
def agg_budget(spark, sf_dir):
    used = F.count_if((F.col("source") == "otapi") & (F.to_date("created_at") == F.to_date("now")))
    return with_now(spark, sf_dir).agg(used.alias("used")).withColumn("remaining", F.greatest(F.lit(0).cast("long"), DEFAULTS.daily_budget - F.col("used")))


FRESH_SQL = f"fresh AS (SELECT * FROM audit_log WHERE created_at >= {NOW_SQL} - INTERVAL 24 HOUR AND NOT coalesce(notified, false))"
DIGEST_SQL = (
    f"{FRESH_SQL}, kinds AS (SELECT action, count(*) AS n FROM fresh GROUP BY action), "
    "line AS (SELECT id, '  - [' || strftime(created_at, '%Y-%m-%d %H:%M') || '] ' || coalesce(action, 'None') || ' product=' || coalesce(product_id, 'None') || ' :: ' || coalesce(detail, 'None') AS line FROM fresh ORDER BY id DESC LIMIT 200), "
    "digest AS (SELECT (SELECT CAST(sum(n) AS BIGINT) FROM kinds) AS total, 'Daily summary' AS subject, 'Activity of the last 24 hours' || chr(10) || '=============================' || chr(10) || 'Total actions: ' || CAST((SELECT sum(n) FROM kinds) AS VARCHAR) || chr(10) || chr(10) || 'By action:' || chr(10) || "
    "(SELECT string_agg('  - ' || action || ': ' || CAST(n AS VARCHAR), chr(10) ORDER BY action) FROM kinds) || chr(10) || chr(10) || 'Detail:' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY id) FROM line) AS body WHERE EXISTS (SELECT 1 FROM fresh))"
)


@R.add("agg_digest", LOG.rstrip() + f", {DIGEST_SQL} SELECT * FROM digest")
def agg_digest(spark, sf_dir):
    return L.digest(L.untold(with_now(spark, sf_dir), F.expr("now - INTERVAL 24 HOURS")))


STATE_SQL = (
    "states AS (SELECT product_id, arg_max(state, id) FILTER (WHERE state IS NOT NULL) AS was_enabled, count(*) AS events FROM (SELECT *, CASE WHEN json_valid(before) THEN TRY_CAST(before ->> '$.enabled' AS BOOLEAN) END AS state FROM audit_log "
    "WHERE action = 'duplicate_disabled' AND product_id IS NOT NULL AND product_id NOT IN ('', '(nuevo)')) GROUP BY product_id)"
)


@R.add("agg_last_known_state", LOG.rstrip() + f", {STATE_SQL} SELECT * FROM states")
def agg_last_known_state(spark, sf_dir):
    return L.last_known_state(log(spark, sf_dir))


@R.add("agg_restore_preview", LOG.rstrip() + f", {STATE_SQL} SELECT count(*) AS would_restore, count(*) FILTER (WHERE was_enabled) AS was_enabled, count(*) FILTER (WHERE NOT was_enabled) AS was_disabled, count(*) FILTER (WHERE was_enabled IS NULL) AS unknown, array_to_string((SELECT list(product_id ORDER BY product_id) FROM (SELECT product_id FROM states ORDER BY product_id LIMIT 20)), ',') AS preview_ids FROM states")
def agg_restore_preview(spark, sf_dir):
    states = L.last_known_state(log(spark, sf_dir))
    counts = states.agg(F.count("*").alias("would_restore"), F.count_if("was_enabled").alias("was_enabled"), F.count_if(~F.col("was_enabled")).alias("was_disabled"), F.count_if(F.col("was_enabled").isNull()).alias("unknown"))
    first = states.orderBy("product_id").limit(20).agg(F.array_join(F.array_sort(F.collect_list("product_id")), ",").alias("preview_ids"))
    return counts.crossJoin(F.broadcast(first))  # one row each


@R.add("agg_bulk_preview", LOG.rstrip() + ", hit AS (SELECT DISTINCT product_id FROM audit_log WHERE action = 'duplicate_flagged' AND dismissed IS NOT TRUE AND confidence >= 0.95 AND product_id IS NOT NULL) SELECT count(*) AS would_disable, array_to_string((SELECT list(product_id ORDER BY product_id) FROM (SELECT product_id FROM hit ORDER BY product_id LIMIT 20)), ',') AS preview_ids FROM hit")
def agg_bulk_preview(spark, sf_dir):
    hit = filter_confidence(spark, sf_dir).select("product_id").distinct()
    first = hit.orderBy("product_id").limit(20).agg(F.array_join(F.array_sort(F.collect_list("product_id")), ",").alias("preview_ids"))
    return hit.agg(F.count("*").alias("would_disable")).crossJoin(F.broadcast(first))  # one row each


@R.add(
    "join_restore_state",
    logical_sql("audit_log", "catalog").rstrip() + f", {STATE_SQL} SELECT s.product_id, was_enabled, c.enabled, CASE WHEN NOT was_enabled THEN 'respect' WHEN c.enabled THEN 'already' WHEN c.enabled IS NULL THEN 'missing' ELSE 'restore' END AS step FROM states s LEFT JOIN catalog c ON s.product_id = c.id",
)
def join_restore_state(spark, sf_dir):
    current = logical(spark, sf_dir, "catalog").select(F.col("id").alias("product_id"), "enabled")
    return L.restore_plan(L.last_known_state(log(spark, sf_dir)), current)


@R.add("join_anti_logged", logical_sql("audit_log", "catalog") + "SELECT id AS product_id, 'quality_issue_found' AS action FROM catalog c WHERE enabled AND NOT EXISTS (SELECT 1 FROM audit_log a WHERE a.action = 'quality_issue_found' AND a.product_id = c.id)")
def join_anti_logged(spark, sf_dir):
    events = logical(spark, sf_dir, "catalog").filter("enabled").select(F.col("id").alias("product_id"), F.lit("quality_issue_found").alias("action"))
    return L.already_logged(events, log(spark, sf_dir).filter("action = 'quality_issue_found'"), ["action", "product_id"])


@R.add("join_already_sent", logical_sql("audit_log", "catalog") + "SELECT c.id, max(a.id) AS log_id FROM catalog c JOIN audit_log a ON a.product_source_url = lower(replace(c.source_url, '?a=1&b=2&spm=x#top', '?spm=1')) WHERE a.dismissed IS NOT TRUE AND a.action = 'verify_passed' GROUP BY c.id")
def join_already_sent(spark, sf_dir):
    sent = log(spark, sf_dir).filter(L.not_dismissed() & (F.col("action") == "verify_passed")).groupBy("product_source_url").agg(F.max("id").alias("log_id"))
    asked = logical(spark, sf_dir, "catalog").select("id", F.lower(F.replace("source_url", F.lit("?a=1&b=2&spm=x#top"), F.lit("?spm=1"))).alias("product_source_url"))
    return asked.join(sent, "product_source_url").groupBy("id").agg(F.max("log_id").alias("log_id"))


def stored_log(spark, sf_dir):
    """A copy of the log that can be changed."""
    rows = log(spark, sf_dir)
    table = KeyedTable(spark, f"{jobs.work_folder(spark)}/log", rows.schema, ["id"], n_buckets=8)
    table.insert(rows)
    return table


@R.add("sink_append_event", LOG + "SELECT id, action, substr(repeat(coalesce(detail, ''), 40), 1, 500) AS detail, substr(repeat(product_name, 30), 1, 200) AS product_name FROM audit_log")
def sink_append_event(spark, sf_dir):
    """Events that arrive as a stream, appended batch by batch and read back."""
    arriving = jobs.stream_table(spark, sf_dir, "events").selectExpr(*LOGICAL["audit_log"][1])
    rows = arriving.select("id", "action", F.repeat(F.coalesce("detail", F.lit("")), F.lit(40)).alias("detail"), F.repeat("product_name", F.lit(30)).alias("product_name"))
    folder = jobs.work_folder(spark)
    written = BatchLog(spark, f"{folder}/log", "id long, action string, detail string, product_name string")
    jobs.each_batch(rows, lambda batch, n: written.append(L.clip_event(batch), n), f"{folder}/checkpoint")
    return written.read()


_OPEN_DUPLICATE = f"{section_sql('duplicates')} AND dismissed IS NOT TRUE"


@R.add("sink_update_flags", LOG + f"SELECT id, CASE WHEN {_OPEN_DUPLICATE} THEN true ELSE dismissed END AS dismissed, CASE WHEN {_OPEN_DUPLICATE} THEN {NOW_SQL} END AS dismissed_at, CASE WHEN id % 100 = 0 THEN 'checked' END AS note, notified OR confidence >= 0.95 IS TRUE AS notified FROM audit_log")
def sink_update_flags(spark, sf_dir):
    """Dismiss a section, note every hundredth event, mark the sure ones as notified: written and read back."""
    rows = with_now(spark, sf_dir).withColumns({"dismissed_at": F.lit(None).cast(dict(log(spark, sf_dir).dtypes)["created_at"]), "note": F.lit(None).cast("string")})
    table = KeyedTable(spark, f"{jobs.work_folder(spark)}/flags", rows.select("id", "dismissed", "dismissed_at", "note", "notified", "now").schema, ["id"], n_buckets=8)
    table.insert(rows)
    table.update(rows.filter(L.section_predicate("duplicates") & L.not_dismissed()), {"dismissed": F.lit(True), "dismissed_at": F.col("now")})
    table.update(rows.filter("id % 100 = 0"), {"note": F.lit(L.clean_note("  checked "))})
    table.update(rows.filter("confidence >= 0.95"), {"notified": F.lit(True)})
    return table.read().drop("now")


def upserted(spark, rows, key, old):
    """A table of one row a key, the newest: first ``old`` rows are put in, then the others."""
    table = KeyedTable(spark, f"{jobs.work_folder(spark)}/cache", rows.schema, [key], n_buckets=8)
    for part in (rows.filter(old), rows.filter(~old)):
        table.upsert(L.newest(part, key, "at"), version="at")
    return table.read()


@R.add("sink_upsert_cache", LOG + "SELECT product_source_url AS url, arg_max(id, struct_pack(a := created_at, b := id)) AS version FROM audit_log WHERE product_source_url IS NOT NULL AND length(product_source_url) <= 1024 GROUP BY product_source_url")
def sink_upsert_cache(spark, sf_dir):
    rows = log(spark, sf_dir).filter("length(product_source_url) <= 1024").select(F.col("product_source_url").alias("url"), F.struct("created_at", "id").alias("at"), F.col("id").alias("version"))
    return upserted(spark, rows, "url", F.col("version") % 2 == 0).select("url", "version")


@R.add("sink_upsert_kv", LOG + "SELECT action AS key, CAST(arg_max(id, struct_pack(a := created_at, b := id)) AS VARCHAR) AS value FROM audit_log GROUP BY action")
def sink_upsert_kv(spark, sf_dir):
    rows = log(spark, sf_dir).select(F.col("action").alias("key"), F.col("id").cast("string").alias("value"), F.struct("created_at", "id").alias("at"))
    return upserted(spark, rows, "key", F.col("at.id") % 3 == 0).select("key", "value")


@R.add("sink_notify", LOG + "SELECT id, replace(replace('[{subject}] {body}', '{subject}', action), '{body}', coalesce(detail, '')) AS message, 'https://hooks.example.com/?t=' || url_encode(action || ' #' || CAST(id AS VARCHAR)) AS hook FROM audit_log WHERE NOT notified")
def sink_notify(spark, sf_dir):
    text = F.replace(F.replace(F.lit("[{subject}] {body}"), F.lit("{subject}"), F.col("action")), F.lit("{body}"), F.coalesce("detail", F.lit("")))
    quoted = F.replace(F.url_encode(F.concat("action", F.lit(" #"), F.col("id").cast("string"))), F.lit("+"), F.lit("%20"))
    return log(spark, sf_dir).filter("NOT notified").select("id", text.alias("message"), F.concat(F.lit("https://hooks.example.com/?t="), quoted).alias("hook"))


@R.add("route_pro", LOG + "SELECT id, coalesce(lower(trim(source)) IN ('b2b-pro', 'admin', 'pro', 'orders-pro'), false) AS pro FROM audit_log")
def route_pro(spark, sf_dir):
    return log(spark, sf_dir).select("id", F.coalesce(F.lower(F.trim("source")).isin("b2b-pro", "admin", "pro", "orders-pro"), F.lit(False)).alias("pro"))


@R.add("stream_daily_budget", LOG + "SELECT id, nth, nth <= 100 AS passes FROM (SELECT id, row_number() OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY created_at, id) AS nth FROM audit_log WHERE source = 'otapi')")
def stream_daily_budget(spark, sf_dir):
    rows = L.within_daily_budget(log(spark, sf_dir).filter("source = 'otapi'"), 100)
    return rows.select("id", F.col("nth").cast("long").alias("nth"), "passes")


@R.add("stream_digest_24h", LOG.rstrip() + f", {DIGEST_SQL} SELECT total, subject, body, 0::BIGINT AS second_run, (SELECT count(*) FROM audit_log WHERE notified OR id IN (SELECT id FROM fresh)) AS notified FROM digest")
def stream_digest_24h(spark, sf_dir):
    """The message of the newest 24 hours; how many messages a second run makes, and how many events are marked now."""
    table = stored_log(spark, sf_dir)
    now, folder = str(log(spark, sf_dir).agg(F.max("created_at")).first()[0]), jobs.work_folder(spark)
    first = send_digest(table, folder, 0, now)
    again = send_digest(table, folder, 1, now).agg(F.count("*").alias("second_run"))
    marked = table.read().agg(F.count_if("notified").alias("notified"))
    return first.crossJoin(F.broadcast(again)).crossJoin(F.broadcast(marked))  # one row each


@R.add("agg_run_summary", LOG + "SELECT CASE WHEN action = 'downstream_failed' THEN 'failed' WHEN action = 'price_flagged' THEN 'alert' WHEN source IS NULL THEN 'skipped' ELSE 'processed' END AS status, count(*) AS n FROM audit_log GROUP BY 1")
def agg_run_summary(spark, sf_dir):
    status = F.when(F.col("action") == "downstream_failed", "failed").when(F.col("action") == "price_flagged", "alert").when(F.col("source").isNull(), "skipped").otherwise("processed")
    return log(spark, sf_dir).groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@R.add("fmt_time", LOG + f"SELECT id, CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN CAST(m AS VARCHAR) || ' min' WHEN m < 1440 THEN CAST(m // 60 AS VARCHAR) || ' h' ELSE strftime(created_at, '%Y-%m-%d') END AS shown FROM (SELECT id, created_at, abs(epoch_ms(date_trunc('second', {NOW_SQL})) // 1000 - epoch_ms(date_trunc('second', created_at)) // 1000) // 60 AS m FROM audit_log)")
def fmt_time(spark, sf_dir):
    from catalens.functions.pricing import fmt_time as shown

    return with_now(spark, sf_dir).select("id", shown(F.col("created_at"), F.col("now")).alias("shown"))
