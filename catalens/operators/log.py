"""Event-log operators: sections, search, paging, statistics, state transitions, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sections of the log: sources, actions and a part of the detail that must all hold (None: any).
SECTIONS: dict[str, tuple[list[str] | None, list[str] | None, str | None]] = {
    "inbox_primary": (["primary"], None, None),
    "inbox_orders": (["orders", "orders-pro"], None, None),
    "duplicates": (None, ["duplicate_disabled", "duplicate_flagged"], None),
    "price_changes": (None, ["price_flagged"], None),
    "sent_downstream": (None, ["verify_passed"], None),
    "downstream_errors": (None, ["downstream_failed"], None),
    "quality_issues": (None, ["quality_issue_found"], None),
    "quality_no_image": (None, ["quality_issue_found"], "no image"),
    "quality_zero_price": (None, ["quality_issue_found"], "price = 0"),
    "pa_variants": (None, ["pa_variant_flagged"], None),
    "bx_no_image": (None, ["bx_no_image_flagged", "bx_no_image_disabled"], None),
    "app_matches": (None, ["app_lookup_match", "app_lookup_suggested"], None),
    "app_requests": (None, ["app_lookup_request_sent", "app_lookup_request_failed", "app_lookup_no_image"], None),
    "all": (None, None, None),
}
#: What a reader sees for an action: icon, title, tone.
LABELS: dict[str, tuple[str, str, str]] = {
    "duplicate_disabled": ("duplicate", "Duplicate disabled in the catalogue", "warning"),
    "duplicate_flagged": ("duplicate", "Already in the catalogue", "warning"),
    "verify_passed": ("send", "New product sent on for enrichment", "info"),
    "downstream_failed": ("alert", "New product, but the next system did not answer", "danger"),
    "price_flagged": ("price", "Price change found", "warning"),
    "quality_issue_found": ("alert", "Product with problems", "warning"),
    "pa_variant_flagged": ("alert", "Variant named PA found", "warning"),
    "bx_no_image_flagged": ("alert", "Product named BX without a picture", "danger"),
    "bx_no_image_disabled": ("duplicate", "Product named BX without a picture disabled", "warning"),
    "app_lookup_match": ("check", "A search found a product of the catalogue", "info"),
    "app_lookup_suggested": ("info", "A search found something alike", "info"),
    "app_lookup_request_sent": ("send", "A search became a request", "warning"),
    "app_lookup_no_image": ("alert", "A link without a picture", "danger"),
}
FALLBACK_ICON, FALLBACK_TONE = "info", "muted"


def section_predicate(key: str | None) -> Column:
    """Whether a row belongs to a section; an unknown section holds every row."""
    sources, actions, part = SECTIONS.get(key, (None, None, None))
    out = F.lit(True)
    if sources:
        out = out & F.col("source").isin(sources)
    if actions:
        out = out & F.col("action").isin(actions)
    if part:
        out = out & F.col("detail").ilike(f"%{part}%")
    return F.coalesce(out, F.lit(False))


def not_dismissed() -> Column:
    return ~F.col("dismissed").eqNullSafe(True)


def search(log: DataFrame, q: str) -> DataFrame:
    """Rows whose product name, code or id contains ``q``, in which % and _ are wildcards."""
    return log.filter(F.col("product_name").ilike(f"%{q}%") | F.col("product_code").ilike(f"%{q}%") | F.col("product_id").ilike(f"%{q}%"))


def page(log: DataFrame, skip: int, limit: int) -> DataFrame:
    """Newest first, ids breaking ties, with 1 to 100 rows a page."""
    return log.orderBy(F.desc("created_at"), F.desc("id")).offset(skip).limit(max(1, min(100, limit)))


def humanize(log: DataFrame, labels: DataFrame) -> DataFrame:
    """Log rows for readers: label, tone, ISO time, product and (where there is one) related product, JSON checked."""
    joined = log.join(F.broadcast(labels), "action", "left")  # one row for each action of a fixed list
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), F.col(c))
    return joined.select(
        "id",
        "action",
        F.coalesce("icon", F.lit(FALLBACK_ICON)).alias("icon"),
        F.coalesce("title", F.col("action")).alias("title"),
        F.coalesce("tone", F.lit(FALLBACK_TONE)).alias("tone"),
        F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("created_iso"),
        F.struct("product_id", "product_name", "product_code").alias("product"),
        F.when(F.col("related_product_id").isNotNull(), F.struct(F.col("related_product_id").alias("id"))).alias("related"),
        valid("before").alias("before"),
        valid("after").alias("after"),
    )


def section_counts(log: DataFrame) -> DataFrame:
    """(section, n) of all sections from one pass over the log."""
    one = log.agg(*[F.count_if(section_predicate(s)).alias(s) for s in SECTIONS])
    return one.unpivot([], list(SECTIONS), "section", "n")


def health(log: DataFrame) -> DataFrame:
    passed, failed = F.count_if(F.col("action") == "verify_passed"), F.count_if(F.col("action") == "downstream_failed")
    pending = lambda s: F.count_if(section_predicate(s) & not_dismissed())
    return log.agg(
        F.round(passed / F.nullif(passed + failed, F.lit(0)), 6).alias("success_rate"),
        passed.alias("passed"),
        failed.alias("failed"),
        pending("duplicates").alias("pending_duplicates"),
        pending("price_changes").alias("pending_prices"),
        pending("quality_issues").alias("pending_quality"),
        F.max("created_at").alias("last_event"),
    )


def duplicate_histogram(log: DataFrame) -> DataFrame:
    """One row: totals, hits of each strategy, confidence buckets and mean scores (zeros count).

    Scores and strategies come from the JSON in ``after``; where that is missing or broken, a
    strategy counts if its name occurs in ``detail``.
    """
    kinds = ["url", "image", "text"]
    parsed = F.from_json("after", "matched_by array<string>, per_strategy_scores map<string,double>")
    rows = log.filter(section_predicate("duplicates")).withColumn("j", F.when(F.try_parse_json("after").isNotNull(), parsed))
    c = F.coalesce("confidence", F.lit(0.0))
    hits = lambda k: F.size(F.filter(F.coalesce("j.matched_by", F.array().cast("array<string>")), lambda s: s == k))
    old = lambda k: F.coalesce(F.lower("detail").contains(k), F.lit(False)).cast("int")
    return rows.agg(
        F.count("*").alias("total"),
        *[F.coalesce(F.sum(F.when(F.col("j").isNotNull(), hits(k)).otherwise(old(k))), F.lit(0)).cast("long").alias(f"by_{k}") for k in kinds],
        F.count_if(c >= 0.99).alias("bucket_99"),
        F.count_if((c >= 0.95) & (c < 0.99)).alias("bucket_95"),
        F.count_if((c >= 0.90) & (c < 0.95)).alias("bucket_90"),
        F.count_if(c < 0.90).alias("bucket_rest"),
        *[F.round(F.avg(F.col("j.per_strategy_scores")[k]), 6).alias(f"avg_{k}") for k in kinds],
    )


def last_known_state(log: DataFrame) -> DataFrame:
    """Per product with a disable event: the last ``enabled`` recorded before it (by id), null if never."""
    state = F.get_json_object("before", "$.enabled").try_cast("boolean")
    rows = log.filter((F.col("action") == "duplicate_disabled") & F.col("product_id").isNotNull() & ~F.col("product_id").isin("", "(nuevo)")).withColumn("state", state)
    return rows.groupBy("product_id").agg(F.max_by("state", F.when(F.col("state").isNotNull(), F.col("id"))).alias("was_enabled"), F.count("*").alias("events"))


def restore_plan(states: DataFrame, current: DataFrame) -> DataFrame:
    """What to do with each disabled product, from its recorded and its current state (product_id, enabled)."""
    now = current.select(F.col("product_id"), F.col("enabled"))
    step = F.when(~F.col("was_enabled"), "respect").when(F.col("enabled"), "already").when(F.col("enabled").isNull(), "missing").otherwise("restore")
    return states.join(now, "product_id", "left").select("product_id", "was_enabled", "enabled", step.alias("step"))


def already_logged(events: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """``events`` without those that the log has under the same keys, dismissed or not; a null key is never logged."""
    return events.join(log.select(*keys).distinct(), keys, "left_anti")


def clip_event(events: DataFrame) -> DataFrame:
    return events.withColumns({"detail": F.substring("detail", 1, 500), "product_name": F.substring("product_name", 1, 200)})


def clean_note(note: str) -> str | None:
    """A note of at most 1000 characters; a blank one is none."""
    return note.strip()[:1000] or None


def newest(rows: DataFrame, key: str, version: str | Column) -> DataFrame:
    """One row for each key, the newest by ``version``."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), version).alias("__row"))
    return best.select(key, *[f"__row.{c}" for c in others])


def upsert_latest(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row for each key, the newest by ``version``; rows of ``new`` win ties."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return newest(both.withColumn("__at", F.struct(version, "__new")), key, "__at").select(*old.columns)


def untold(log: DataFrame, since: Column) -> DataFrame:
    """Events since ``since`` that nobody was told of."""
    return log.filter((F.col("created_at") >= since) & ~F.coalesce("notified", F.lit(False)))


def digest(fresh: DataFrame, max_lines: int = 200) -> DataFrame:
    """One row (total, subject, body) about events, or none: how many of each action, and the last ``max_lines`` by id.

    Each task keeps its own last lines; one row an action and ``max_lines`` rows meet at the end.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    line = F.concat(F.lit("  - ["), F.date_format("created_at", "yyyy-MM-dd HH:mm"), F.lit("] "), text("action"), F.lit(" product="), text("product_id"), F.lit(" :: "), text("detail"))
    joined = lambda rows, shown: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), shown), "\n")
    kinds = fresh.groupBy("action").agg(F.count("*").alias("n"))
    counts = kinds.agg(F.sum("n").alias("total"), joined(F.struct("action", "n"), lambda r: F.concat(F.lit("  - "), r["action"], F.lit(": "), r["n"].cast("string"))).alias("summary"))
    last = fresh.select("id", line.alias("line")).orderBy(F.desc("id")).limit(max_lines)
    lines = last.agg(joined(F.struct("id", "line"), lambda r: r["line"]).alias("lines"))
    body = F.concat(F.lit("Activity of the last 24 hours\n=============================\nTotal actions: "), F.col("total").cast("string"), F.lit("\n\nBy action:\n"), F.col("summary"), F.lit("\n\nDetail:\n"), F.col("lines"))
    return counts.crossJoin(F.broadcast(lines)).filter("total IS NOT NULL").select("total", F.lit("Daily summary").alias("subject"), body.alias("body"))  # one row each


def within_daily_budget(log: DataFrame, limit: int) -> DataFrame:
    """Each event with its number on its UTC day and whether the day's budget lets it pass.

    Rows are numbered within a minute; the minutes' counts (1 440 a day) say how many came before.
    """
    timed = log.withColumns({"day": F.to_date("created_at"), "minute": F.date_trunc("minute", "created_at")})
    earlier = Window.partitionBy("day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = timed.groupBy("day", "minute").count().select("minute", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("earlier"))
    within = F.row_number().over(Window.partitionBy("minute").orderBy("created_at", "id"))
    return timed.withColumn("within", within).join(minutes, "minute").withColumn("nth", F.col("earlier") + F.col("within")).withColumn("passes", F.col("nth") <= limit).drop("minute", "within", "earlier")
