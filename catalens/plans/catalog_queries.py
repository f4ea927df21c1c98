"""Queries over the catalogue: scans, lookups, audits, forms, addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalens.functions import html as H
from catalens.functions import urls as U
from catalens.operators import catalog as C
from catalens.operators import forms, quality
from catalens.plans.registry import Registry
from catalens.sources.catalog import logical, logical_sql

R = Registry()
CAT = logical_sql("catalog")
PRODUCT = "pos, id, coalesce(name, '') AS name, slug, coalesce(description, '') AS description, coalesce(enabled, true) AS enabled, source_url, coalesce(preview_url, asset_url) AS image_url, price_cents, variant_count, product_code, updated_at"
CAT2 = CAT.rstrip() + f", product AS (SELECT {PRODUCT} FROM catalog) "
COLUMNS = ["id", "name", "enabled", "source_url", "image_url", "price_cents", "product_code", "updated_at"]
COLUMNS_SQL = ", ".join(COLUMNS)


def products(spark, sf_dir):
    return C.map_product(logical(spark, sf_dir, "catalog"))


@R.add("scan_catalog_all", CAT2 + f"SELECT {COLUMNS_SQL} FROM product")
def scan_catalog_all(spark, sf_dir):
    return products(spark, sf_dir).select(*COLUMNS)


@R.add("scan_catalog_page", CAT2 + f"SELECT {COLUMNS_SQL} FROM product ORDER BY pos LIMIT 100 OFFSET 100")
def scan_catalog_page(spark, sf_dir):
    return products(spark, sf_dir).orderBy("pos").offset(100).limit(100).select(*COLUMNS)


VARIANTS_SQL = logical_sql("catalog", "variant").rstrip() + f", product AS (SELECT {PRODUCT} FROM catalog), ranked AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY variant_no, sku, price_cents) AS nth FROM variant) "


@R.add("scan_catalog_variants", VARIANTS_SQL + "SELECT p.id, count(r.product_id) AS n_variants, coalesce(string_agg(r.variant_id, ',' ORDER BY nth), '') AS variant_ids FROM product p LEFT JOIN ranked r ON p.id = r.product_id AND nth <= 100 GROUP BY p.id")
def scan_catalog_variants(spark, sf_dir):
    rows = C.with_variants(products(spark, sf_dir), logical(spark, sf_dir, "variant"))
    return rows.select("id", F.size("variants").cast("long").alias("n_variants"), F.array_join(F.transform("variants", lambda v: v["id"]), ",").alias("variant_ids"))


@R.add("point_lookup", VARIANTS_SQL + "SELECT p.id, p.name, p.enabled, count(r.product_id) AS n_variants, min(r.price_cents) AS min_cents FROM product p LEFT JOIN ranked r ON p.id = r.product_id WHERE p.id IN ('9', '10', '17') GROUP BY p.id, p.name, p.enabled")
def point_lookup(spark, sf_dir):
    wanted = products(spark, sf_dir).filter(F.col("id").isin("9", "10", "17"))
    found = logical(spark, sf_dir, "variant").filter(F.col("product_id").isin("9", "10", "17")).groupBy(F.col("product_id").alias("id")).agg(F.count("*").alias("n_variants"), F.min("price_cents").alias("min_cents"))
    return wanted.join(found, "id", "left").select("id", "name", "enabled", F.coalesce("n_variants", F.lit(0).cast("long")).alias("n_variants"), "min_cents")


@R.add("point_enabled", logical_sql("catalog", "audit_log") + "SELECT DISTINCT a.product_id, c.enabled FROM audit_log a LEFT JOIN catalog c ON a.product_id = c.id WHERE a.product_id IS NOT NULL")
def point_enabled(spark, sf_dir):
    asked = logical(spark, sf_dir, "audit_log").filter("product_id IS NOT NULL").select("product_id").distinct()
    return asked.join(logical(spark, sf_dir, "catalog").select(F.col("id").alias("product_id"), "enabled"), "product_id", "left")


@R.add("map_product", CAT + f"SELECT {PRODUCT} FROM catalog")
def map_product(spark, sf_dir):
    return products(spark, sf_dir).select("pos", "id", "name", "slug", "description", "enabled", "source_url", "image_url", "price_cents", "variant_count", "product_code", "updated_at")


@R.add("map_product_full", VARIANTS_SQL + "SELECT c.id, CAST(len(list_distinct(list_filter([c.preview_url, c.asset_url], lambda x: x IS NOT NULL))) AS BIGINT) AS n_assets, coalesce(c.preview_url, c.asset_url) AS featured, r.variant_name AS first_variant, r.price_cents AS first_cents FROM catalog c LEFT JOIN ranked r ON c.id = r.product_id AND r.nth = 1")
def map_product_full(spark, sf_dir):
    rows = C.with_variants(products(spark, sf_dir), logical(spark, sf_dir, "variant"))
    first = F.get("variants", F.lit(0))
    return rows.select("id", F.size("image_urls").cast("long").alias("n_assets"), F.col("image_url").alias("featured"), first["name"].alias("first_variant"), first["price_cents"].alias("first_cents"))


@R.add("product_payload", VARIANTS_SQL + "SELECT c.id, coalesce(r.price_cents, c.price_cents) AS headline_cents, coalesce(r.sku, c.product_code) AS headline_code FROM catalog c LEFT JOIN ranked r ON c.id = r.product_id AND r.nth = 1 WHERE c.enabled")
def product_payload(spark, sf_dir):
    rows = C.with_variants(products(spark, sf_dir).filter("enabled"), logical(spark, sf_dir, "variant"), limit=1)
    first = F.get("variants", F.lit(0))
    return rows.select("id", F.coalesce(first["price_cents"], "price_cents").alias("headline_cents"), F.coalesce(first["sku"], "product_code").alias("headline_code"))


@R.add("safe_int", "SELECT event_id, TRY_CAST(props ->> '$.k' AS BIGINT) AS k, TRY_CAST(event_type AS BIGINT) AS none FROM events")
def safe_int(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.col("event_type").try_cast("bigint").alias("none"))


@R.add("filter_enabled", CAT + "SELECT id FROM catalog WHERE enabled")
def filter_enabled(spark, sf_dir):
    return logical(spark, sf_dir, "catalog").filter("enabled").select("id")


@R.add("filter_changed", CAT + "SELECT id, updated_at FROM catalog WHERE updated_at IS NULL OR updated_at > '2024-01-20T00:00:00'")
def filter_changed(spark, sf_dir):
    return logical(spark, sf_dir, "catalog").filter(F.col("updated_at").isNull() | (F.col("updated_at") > "2024-01-20T00:00:00")).select("id", "updated_at")


@R.add("agg_marker", CAT + "SELECT max(updated_at) AS marker FROM catalog")
def agg_marker(spark, sf_dir):
    return logical(spark, sf_dir, "catalog").agg(F.max("updated_at").alias("marker"))


ISSUES_SQL = "list_filter([CASE WHEN image_url IS NULL OR image_url = '' THEN 'no image' END, CASE WHEN price_cents = 0 THEN 'price = 0' END, CASE WHEN price_cents IS NULL AND variant_count = 0 THEN 'no variants' END, CASE WHEN length(trim(name)) < 3 THEN 'name empty or very short' END, CASE WHEN source_url IS NULL OR source_url = '' THEN 'no supplier link' END], lambda x: x IS NOT NULL)"


@R.add("quality_rules", CAT2 + f"SELECT id, CAST(len({ISSUES_SQL}) AS INTEGER) AS n, array_to_string({ISSUES_SQL}, '|') AS issues FROM product")
def quality_rules(spark, sf_dir):
    issues = quality.quality_issues()
    return products(spark, sf_dir).select("id", F.size(issues).alias("n"), F.array_join(issues, "|").alias("issues"))


PAIR = logical_sql("catalog", "audit_log").rstrip() + f", product AS (SELECT {PRODUCT} FROM catalog) "


@R.add("audit_quality", PAIR + f"SELECT id, name, substr('Problems: ' || array_to_string({ISSUES_SQL}, ', '), 1, 500) AS detail FROM product p WHERE enabled AND len({ISSUES_SQL}) > 0 AND NOT EXISTS (SELECT 1 FROM audit_log a WHERE a.action = 'quality_issue_found' AND a.product_id = p.id)")
def audit_quality(spark, sf_dir):
    return quality.audit_quality(products(spark, sf_dir), logical(spark, sf_dir, "audit_log"))


@R.add(
    "audit_variant_prefix",
    VARIANTS_SQL + "SELECT p.id, n, substr(CAST(n AS VARCHAR) || ' variant(s) named PA: ' || names || CASE WHEN n > 5 THEN ' (and ' || CAST(n - 5 AS VARCHAR) || ' more)' ELSE '' END, 1, 500) AS detail FROM product p JOIN (SELECT product_id, count(*) AS n, string_agg(variant_name, ', ' ORDER BY nth) FILTER (WHERE nth <= 5) AS names FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY variant_no, sku) AS nth FROM variant WHERE upper(trim(variant_name)) LIKE 'PA%') GROUP BY product_id) v ON p.id = v.product_id WHERE p.enabled",
)
def audit_variant_prefix(spark, sf_dir):
    return quality.audit_variant_prefix(products(spark, sf_dir), logical(spark, sf_dir, "variant"))


@R.add("audit_prefix_no_image", PAIR + "SELECT id, 'Name ''' || trim(name) || ''' has no picture' AS detail FROM product p WHERE enabled AND upper(trim(name)) LIKE 'BX%' AND image_url IS NULL AND NOT EXISTS (SELECT 1 FROM audit_log a WHERE a.action = 'bx_no_image_flagged' AND a.product_id = p.id)")
def audit_prefix_no_image(spark, sf_dir):
    return quality.audit_prefix_no_image(products(spark, sf_dir), logical(spark, sf_dir, "audit_log"))


@R.add("project_price_status", logical_sql("catalog", "price_history") + "SELECT c.id, CASE WHEN n IS NULL THEN 'never_checked' WHEN n = 1 THEN 'first' ELSE 'tracked' END AS state, coalesce(n, 0) AS n FROM catalog c LEFT JOIN (SELECT product_id, count(*) AS n FROM price_history GROUP BY product_id) h ON c.id = h.product_id")
def project_price_status(spark, sf_dir):
    n = logical(spark, sf_dir, "price_history").groupBy(F.col("product_id").alias("id")).agg(F.count("*").alias("n"))
    rows = logical(spark, sf_dir, "catalog").select("id").join(n, "id", "left")
    return rows.select("id", F.when(F.col("n").isNull(), "never_checked").when(F.col("n") == 1, "first").otherwise("tracked").alias("state"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@R.add("cap_image_urls", CAT + "SELECT id, array_to_string(list_filter([preview_url, ' ', asset_url, 'x1', 'x2', 'x3', 'x4'], lambda u: u IS NOT NULL AND trim(u) <> '')[1:5], ',') AS urls FROM catalog")
def cap_image_urls(spark, sf_dir):
    urls = F.array("preview_url", F.lit(" "), "asset_url", *[F.lit(f"x{i}") for i in range(1, 5)])
    return logical(spark, sf_dir, "catalog").select("id", F.array_join(forms.cap_image_urls(urls), ",").alias("urls"))


@R.add("topn_images", CAT + "SELECT id, array_to_string(list_filter([coalesce(preview_url, asset_url), CASE WHEN asset_url <> coalesce(preview_url, asset_url) THEN asset_url END], lambda u: u IS NOT NULL)[1:2], ',') AS images FROM catalog")
def topn_images(spark, sf_dir):
    images = F.slice(F.array_distinct(F.array_compact(F.array("image_url", "preview_url", "asset_url"))), 1, 2)
    return products(spark, sf_dir).select("id", F.array_join(images, ",").alias("images"))


CLIENT = "supplier"
CLIENT_SQL = "client AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN '  ' ELSE s_name END AS name, CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'no mail' ELSE 'a' || CAST(s_suppkey AS VARCHAR) || '@b.co' END AS email, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '555' END AS phone, CASE WHEN s_suppkey % 4 = 0 THEN ' ' ELSE 'AR' END AS country FROM supplier)"


def clients(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return rows.selectExpr(
        "s_suppkey",
        "CASE WHEN s_suppkey % 7 = 0 THEN '  ' ELSE s_name END AS name",
        "CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'no mail' ELSE 'a' || CAST(s_suppkey AS STRING) || '@b.co' END AS email",
        "CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '555' END AS phone",
        "CASE WHEN s_suppkey % 4 = 0 THEN ' ' ELSE 'AR' END AS country",
    )


@R.add("missing_fields", f"WITH {CLIENT_SQL} SELECT s_suppkey, array_to_string(list_filter([CASE WHEN trim(name) = '' THEN 'client.name' END, CASE WHEN NOT regexp_matches(coalesce(email, ''), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN 'client.email' END, CASE WHEN trim(phone) = '' THEN 'client.phone' END], lambda x: x IS NOT NULL), ',') AS missing FROM client")
def missing_fields(spark, sf_dir):
    return clients(spark, sf_dir).select("s_suppkey", F.array_join(forms.missing_fields(F.col("name"), F.col("email"), F.col("phone")), ",").alias("missing"))


@R.add("build_form", f"WITH {CLIENT_SQL} SELECT s_suppkey, substr(trim(name), 1, 200) AS client_name, nullif(trim(country), '') AS country, CASE WHEN trim(name) = '' THEN 'Product of other' ELSE trim(name) END AS product_name, substr(repeat('link ', 200), 1, 500) AS reference_link, 'http://a,https://b' AS images FROM client")
def build_form(spark, sf_dir):
    images = forms.form_images(F.array(F.lit("http://a"), F.lit("ftp://x"), F.lit("https://b")))
    title = forms.clip(F.col("name"), forms.LIMITS["name"])
    return clients(spark, sf_dir).select(
        "s_suppkey",
        title.alias("client_name"),
        F.nullif(forms.clip(F.col("country"), forms.LIMITS["country"]), F.lit("")).alias("country"),
        F.when(title == "", "Product of other").otherwise(title).alias("product_name"),
        F.substring(F.repeat(F.lit("link "), F.lit(200)), 1, forms.LIMITS["link"]).alias("reference_link"),
        F.array_join(images, ",").alias("images"),
    )


@R.add("sink_consult_form", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'c' || CAST(event_id AS VARCHAR) WHEN 1 THEN 'i' || CAST(event_id AS VARCHAR) WHEN 2 THEN 'r' || CAST(event_id AS VARCHAR) END AS request_id FROM events")
def sink_consult_form(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("event_id").cast("string").alias("n"))
    body = (
        F.when(F.col("event_id") % 4 == 0, F.format_string('{"consultation_id": "c%s", "id": "x"}', "n"))
        .when(F.col("event_id") % 4 == 1, F.format_string('{"id": "i%s", "data": {"id": "y"}}', "n"))
        .when(F.col("event_id") % 4 == 2, F.format_string('{"data": {"request_id": "r%s"}}', "n"))
        .otherwise('{"broken')
    )
    return rows.select("event_id", forms.first_id(body).alias("request_id"))


@R.add("sink_downstream_job", CAT2 + "SELECT id, '{\"id\":\"' || id || '\",\"name\":\"' || name || '\",\"source\":\"primary\"}' AS payload FROM product WHERE enabled")
def sink_downstream_job(spark, sf_dir):
    return products(spark, sf_dir).filter("enabled").select("id", F.to_json(F.struct("id", "name", F.lit("primary").alias("source"))).alias("payload"))


STATUSES = "CASE event_id % 5 WHEN 0 THEN 'found' WHEN 1 THEN 'site_blocked' WHEN 2 THEN 'indexing' ELSE 'not_found' END"


@R.add("decide_action", f"SELECT event_id, CASE WHEN s = 'found' AND event_id % 10 = 0 THEN 'show_product' WHEN s IN ('site_blocked', 'no_image') THEN 'ask_photo' WHEN s = 'indexing' THEN 'retry_later' WHEN event_id % 3 = 0 THEN 'confirm_product' WHEN event_id % 4 = 0 THEN 'ask_client_data' WHEN event_id % 7 = 0 THEN 'none' ELSE 'none_failed' END AS action FROM (SELECT event_id, {STATUSES} AS s FROM events)")
def decide_action(spark, sf_dir):
    k = F.col("event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(STATUSES).alias("s"))
    return rows.select("event_id", forms.decide_action(F.col("s"), k % 10 == 0, k % 3 == 0, k % 4 == 0, k % 7 == 0).alias("action"))


@R.add("buy_url", CAT + "SELECT id, 'https://shop.example.com/product/' || slug || '-' || coalesce(product_code, '') AS url FROM catalog")
def buy_url(spark, sf_dir):
    return logical(spark, sf_dir, "catalog").select("id", forms.buy_url("https://shop.example.com/", "product/{slug}-{code}", F.col("slug"), F.col("id"), F.col("product_code")).alias("url"))


@R.add("retryable_status", "SELECT o_orderkey, CAST(400 + o_orderkey % 120 AS BIGINT) AS status, (400 + o_orderkey % 120) IN (408, 425, 429, 500, 502, 503, 504) AS retry FROM orders")
def retryable_status(spark, sf_dir):
    status = (400 + F.col("o_orderkey") % 120).cast("long")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", status.alias("status"), forms.retryable_status(status).alias("retry"))


@R.add("setting_resolve", "SELECT s_suppkey, coalesce(v, 0.88) AS value, v IS NOT NULL AS modified FROM (SELECT s_suppkey, CASE WHEN x BETWEEN 0.5 AND 1 THEN x END AS v FROM (SELECT s_suppkey, TRY_CAST(CASE s_suppkey % 4 WHEN 0 THEN '0.9' WHEN 1 THEN 'x' WHEN 2 THEN '7' ELSE NULL END AS DOUBLE) AS x FROM supplier))")
def setting_resolve(spark, sf_dir):
    text = F.when(F.col("s_suppkey") % 4 == 0, "0.9").when(F.col("s_suppkey") % 4 == 1, "x").when(F.col("s_suppkey") % 4 == 2, "7")
    value = text.try_cast("double")
    valid = F.when(value.between(0.5, 1.0), value)
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.coalesce(valid, F.lit(0.88)).alias("value"), valid.isNotNull().alias("modified"))


# ---- addresses -------------------------------------------------------------------------------

TRACKING_SQL = "[" + ", ".join(f"'{t}'" for t in U.TRACKING) + "]"


def normal_url_sql(url: str) -> str:
    low = f"regexp_replace(regexp_replace(lower({url}), '^\\s+|\\s+$', '', 'g'), '#.*$', '')"
    before = f"regexp_replace({low}, '\\?.*$', '')"
    stem = f"regexp_extract({before}, '^((?:[a-z][a-z0-9+.\\-]*:)?(?://[^/]*)?)', 1)"
    part = lambda x: f"url_decode(replace({x}, '+', ' '))"
    pairs = f"list_transform(list_filter(string_split(regexp_extract({low}, '\\?(.*)$', 1), '&'), lambda p: strpos(p, '=') > 0 AND strpos(p, '=') < length(p)), lambda p: struct_pack(k := {part("substr(p, 1, strpos(p, '=') - 1)")}, v := {part("substr(p, strpos(p, '=') + 1)")}))"
    code = lambda x: f"replace(url_encode({x}), '%20', '+')"
    kept = f"list_transform(list_sort(list_filter({pairs}, lambda p: NOT list_contains({TRACKING_SQL}, p.k))), lambda p: {code('p.k')} || '=' || {code('p.v')})"
    return f"CASE WHEN {url} IS NULL OR {url} = '' THEN NULL ELSE {stem} || regexp_replace(substr({before}, length({stem}) + 1), '/+$', '') || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END"


#: What is put to an address: its parameters in other orders, blanks written in two ways, signs, tracking.
EXTRA = "z=~*&b=2&a1=2&a=x%20y&a=x+y&a=1&empty=&=x&q==&%C3%A9=%c3%a9&spm=1"


@R.add("normalize_url", f"SELECT page_id, {normal_url_sql('url')} AS canonical, {normal_url_sql('shout')} AS shouted FROM (SELECT page_id, url, chr(9) || upper(regexp_replace(url, '#.*$', '')) || CASE WHEN strpos(url, '?') > 0 THEN '&' ELSE '?' END || '{EXTRA}' || chr(10) AS shout FROM pages)")
def normalize_url(spark, sf_dir):
    return logical(spark, sf_dir, "page").select("page_id", U.normalize_url(F.col("url")).alias("canonical"), U.normalize_url(F.concat(F.lit("\t"), F.upper(F.regexp_replace("url", "#.*$", "")), F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit(EXTRA + "\n"))).alias("shouted"))


@R.add("url_similarity", f"SELECT page_id, CASE WHEN {normal_url_sql('url')} = {normal_url_sql('(url || chr(35) || chr(120))')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS same FROM pages")
def url_similarity(spark, sf_dir):
    return logical(spark, sf_dir, "page").select("page_id", U.url_similarity(F.col("url"), F.concat("url", F.lit("#x"))).alias("same"))


@R.add("setop_minus_tracking", f"SELECT page_id, array_to_string(list_filter(string_split(regexp_extract(lower(url), '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT list_contains({TRACKING_SQL}, split_part(p, '=', 1))), '&') AS kept FROM pages")
def setop_minus_tracking(spark, sf_dir):
    parameters = F.split(F.regexp_extract(F.lower("url"), r"\?([^#]*)", 1), "&")
    kept = F.filter(parameters, lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).isin(U.TRACKING))
    return logical(spark, sf_dir, "page").select("page_id", F.array_join(kept, "&").alias("kept"))


HOSTS = ["articulo.mercadolibre.com.ar", "www.alibaba.com", "es.aliexpress.com", "detail.1688.com", "x.made-in-china.com", "www.amazon.de", "shop.example.com", "127.0.0.1", "10.1.2.3", "172.20.0.1", "8.8.8.8", "db.internal", "localhost"]
HOST_SQL = "[" + ", ".join(f"'{h}'" for h in HOSTS) + "]"
LINK_SQL = f"link AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'ftp' ELSE 'https' END || '://' || {HOST_SQL}[1 + CAST(page_id % {len(HOSTS)} AS INTEGER)] || CASE WHEN page_id % 2 = 0 THEN ':8080' ELSE '' END || '/a-nice-thing-for-you/MLA-' || CAST(1000000 + page_id AS VARCHAR) || '.JPG?x=1' AS link FROM pages)"


def links(spark, sf_dir):
    hosts = F.array(*[F.lit(h) for h in HOSTS])
    n = F.col("page_id")
    link = F.concat(F.when(n % 5 == 0, "ftp").otherwise("https"), F.lit("://"), F.get(hosts, (n % len(HOSTS)).cast("int")), F.when(n % 2 == 0, ":8080").otherwise(""), F.lit("/a-nice-thing-for-you/MLA-"), (1000000 + n).cast("string"), F.lit(".JPG?x=1"))
    return logical(spark, sf_dir, "page").select("page_id", link.alias("link"))


HOST_OF = "regexp_replace(regexp_extract(link, '^[a-z]+://([^/?#]*)', 1), ':\\d*$', '')"
MARKET_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(h, '{n}')" for n in needles) + f" THEN '{m}'" for m, needles in U.MARKETPLACES) + " ELSE 'other' END"


@R.add("detect_marketplace", f"WITH {LINK_SQL}, hosts AS (SELECT page_id, {HOST_OF} AS h FROM link) SELECT page_id, {MARKET_SQL} AS marketplace FROM hosts")
def detect_marketplace(spark, sf_dir):
    return links(spark, sf_dir).select("page_id", U.detect_marketplace(F.col("link")).alias("marketplace"))


@R.add("url_is_public", f"WITH {LINK_SQL}, hosts AS (SELECT page_id, link, {HOST_OF} AS h FROM link) SELECT page_id, link LIKE 'https:%' AND h NOT IN ('localhost') AND NOT suffix(h, '.internal') AND NOT regexp_matches(h, '^(10|127)\\.\\d+\\.\\d+\\.\\d+$') AND NOT regexp_matches(h, '^172\\.(1[6-9]|2\\d|3[01])\\.\\d+\\.\\d+$') AS public FROM hosts")
def url_is_public(spark, sf_dir):
    return links(spark, sf_dir).select("page_id", U.url_is_public(F.col("link")).alias("public"))


@R.add("looks_like_image", f"WITH {LINK_SQL} SELECT page_id, regexp_matches(lower(regexp_extract(link, '^[a-z]+://[^/]*([^?#]*)', 1)), '\\.(jpe?g|png|webp|gif|bmp|avif)$') AS image FROM link")
def looks_like_image(spark, sf_dir):
    return links(spark, sf_dir).select("page_id", U.looks_like_image(F.col("link")).alias("image"))


@R.add(
    "absolutize_url",
    "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://cdn.example.com/' || CAST(page_id AS VARCHAR) || '.png' WHEN 1 THEN origin || '/img/y.png?v=../' || CAST(page_id AS VARCHAR) WHEN 2 THEN NULL WHEN 3 THEN 'https://h.example.com/z.png' WHEN 4 THEN CASE WHEN folder = origin THEN origin ELSE regexp_replace(folder, '/[^/]*$', '') END || '/up/' || CAST(page_id AS VARCHAR) || '.png' ELSE folder || '/a/' || CAST(page_id AS VARCHAR) || '.png' END AS full_url "
    "FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '') AS folder FROM pages)",
)
def absolutize_url(spark, sf_dir):
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 6
    named = lambda before, after: F.concat(F.lit(before), n, F.lit(after))
    candidate = F.when(k == 0, named("//cdn.example.com/", ".png")).when(k == 1, named("/img/./x/../y.png?v=../", "")).when(k == 2, named("data:image/png;base64,", "")).when(k == 3, " https://h.example.com/z.png ").when(k == 4, named("../up/", ".png")).otherwise(named("a/b/../", ".png"))
    return logical(spark, sf_dir, "page").select("page_id", U.absolutize_url(candidate, F.col("url")).alias("full_url"))


@R.add("setop_url_dedupe", "SELECT page_id, url || ',' || url || '/2' AS urls FROM pages")
def setop_url_dedupe(spark, sf_dir):
    return logical(spark, sf_dir, "page").select("page_id", F.array_join(F.array_distinct(F.array("url", F.concat("url", F.lit("/2")), "url")), ",").alias("urls"))


@R.add("drop_placeholders", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://a/photo.png' ELSE 'https://a/photo.png,https://a/x.png' END AS urls FROM pages")
def drop_placeholders(spark, sf_dir):
    urls = F.array(F.lit("https://a/Logo.png"), F.lit("https://a/photo.png"), F.when(F.col("page_id") % 2 == 0, "https://a/ui/../UI/i.png").otherwise("https://a/x.png"))
    return logical(spark, sf_dir, "page").select("page_id", F.array_join(U.drop_placeholders(urls), ",").alias("urls"))


@R.add("parse_market_url", f"WITH {LINK_SQL} SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'MLA' || CAST(2000000 + page_id AS VARCHAR) WHEN 1 THEN 'MLAU' || CAST(3000000 + page_id AS VARCHAR) ELSE 'MLA' || CAST(1000000 + page_id AS VARCHAR) END AS ref_id, CASE page_id % 3 WHEN 1 THEN 'product' ELSE 'item' END AS kind FROM link")
def parse_market_url(spark, sf_dir):
    n = F.col("page_id")
    link = F.when(n % 3 == 0, F.concat("link", F.lit("&pdp_filters=item_id%3AMLA"), (2000000 + n).cast("string"))).when(n % 3 == 1, F.concat(F.lit("https://m/x/up/mlau"), (3000000 + n).cast("string"), F.lit("?a=1"))).otherwise(F.col("link"))
    ref = U.market_reference(link)
    return links(spark, sf_dir).select("page_id", ref["id"].alias("ref_id"), ref["kind"].alias("kind"))


SITE_SQL = "CASE " + " ".join(f"WHEN suffix(h, '{e}') THEN '{s}'" for e, s in U.SITES) + " ELSE 'MLA' END"


@R.add("site_for_tld", f"WITH {LINK_SQL}, hosts AS (SELECT page_id, {HOST_OF} AS h FROM link) SELECT page_id, {SITE_SQL} AS site FROM hosts")
def site_for_tld(spark, sf_dir):
    return links(spark, sf_dir).select("page_id", U.site_for(F.col("link")).alias("site"))


@R.add("slug_name", "SELECT page_id, 'masajeador ' || CAST(page_id AS VARCHAR) || 'x portatil' AS name FROM pages")
def slug_name(spark, sf_dir):
    link = F.concat(F.lit("https://www.m.com.ar/a-b/Masajeador-"), F.col("page_id").cast("string"), F.lit("x-portatil-mla-123/up/MLAU123456?x-y-z"))
    return logical(spark, sf_dir, "page").select("page_id", U.name_from_slug(link).alias("name"))


@R.add("item_id_1688", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) END AS offer FROM pages")
def item_id_1688(spark, sf_dir):
    link = F.concat(F.when(F.col("page_id") % 2 == 0, "https://detail.1688.com/offer/").otherwise("https://x.com/offer/"), F.col("page_id").cast("string"), F.lit(".html"))
    return logical(spark, sf_dir, "page").select("page_id", U.offer_id(link).alias("offer"))


@R.add("short_url", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') || CASE WHEN length(p) > 30 THEN substr(p, 1, 30) || '…' ELSE p END AS short FROM (SELECT page_id, url, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS p FROM pages)")
def short_url(spark, sf_dir):
    return logical(spark, sf_dir, "page").select("page_id", U.short_url(F.col("url")).alias("short"))


@R.add("unreachable_image", "SELECT page_id, regexp_matches(lower(url), '//([^/]*\\.)?example\\.(com|org|net)') AS unreachable FROM pages")
def unreachable_image(spark, sf_dir):
    return logical(spark, sf_dir, "page").select("page_id", U.unreachable_image(F.col("url")).alias("unreachable"))


@R.add("fetch_source_price", f"WITH {LINK_SQL} SELECT page_id, CASE WHEN regexp_matches(link, 'aliexpress\\.(com|us|ru|es)') THEN 'aliexpress' WHEN regexp_matches(link, 'alibaba\\.com') THEN 'alibaba' WHEN regexp_matches(link, '1688\\.com') THEN '1688' END AS fetcher FROM link")
def fetch_source_price(spark, sf_dir):
    link = F.col("link")
    return links(spark, sf_dir).select("page_id", F.when(link.rlike(r"(?i)aliexpress\.(com|us|ru|es)"), "aliexpress").when(link.rlike(r"(?i)alibaba\.com"), "alibaba").when(link.rlike(r"(?i)1688\.com"), "1688").alias("fetcher"))


@R.add("sink_toggle_enabled", logical_sql("catalog", "audit_log") + "SELECT c.id, c.enabled AS was, false AS target FROM catalog c WHERE c.enabled AND c.id IN (SELECT product_id FROM audit_log WHERE action = 'duplicate_flagged' AND dismissed IS NOT TRUE AND confidence >= 0.95)")
def sink_toggle_enabled(spark, sf_dir):
    """The state to bring products to: those with a sure duplicate are disabled, the others stay."""
    sure = logical(spark, sf_dir, "audit_log").filter("action = 'duplicate_flagged' AND confidence >= 0.95 AND NOT (dismissed <=> true)").select(F.col("product_id").alias("id"))
    return logical(spark, sf_dir, "catalog").filter("enabled").join(sure, "id", "left_semi").select("id", F.col("enabled").alias("was"), F.lit(False).alias("target"))


@R.add("fetch_market_api", logical_sql("catalog", "price_history") + "SELECT c.id, CASE WHEN c.price_cents > 0 THEN 'item' WHEN h.cents IS NOT NULL THEN 'search' ELSE 'none' END AS via, CASE WHEN c.price_cents > 0 THEN c.price_cents ELSE h.cents END AS cents FROM catalog c LEFT JOIN (SELECT product_id, min(price_cents) AS cents FROM price_history WHERE price_cents > 0 GROUP BY product_id) h ON c.id = h.product_id")
def fetch_market_api(spark, sf_dir):
    """A reference resolved against responses at hand: the item's own price first, then the cheapest search result."""
    found = logical(spark, sf_dir, "price_history").filter("price_cents > 0").groupBy(F.col("product_id").alias("id")).agg(F.min("price_cents").alias("cents"))
    rows = logical(spark, sf_dir, "catalog").select("id", F.when(F.col("price_cents") > 0, F.col("price_cents")).alias("own")).join(found, "id", "left")
    return rows.select("id", F.when(F.col("own").isNotNull(), "item").when(F.col("cents").isNotNull(), "search").otherwise("none").alias("via"), F.coalesce("own", "cents").alias("cents"))


#: The links of a page's list, made the cards of a search result; addresses that begin with t have no price, those with a no cents.
ITEM = '<li><a href="([^"]*)">([^<]*)</a></li>'
CARDS_SQL = f"item AS (SELECT page_id, unnest(range(1, 1 + least(5, len(u)))) AS nth, u, t FROM (SELECT page_id, regexp_extract_all(html, '{ITEM}', 1) AS u, regexp_extract_all(html, '{ITEM}', 2) AS t FROM pages))"


@R.add("scrape_competitor", f"WITH {CARDS_SQL} SELECT page_id, trim(t[nth]) AS title, 1000000 + page_id % 1000 * 100 + CASE WHEN u[nth][:2] = '/a' THEN 0 ELSE page_id % 100 END AS price_cents, 'ARS' AS currency, u[nth] AS url FROM item WHERE trim(t[nth]) <> '' AND u[nth][:2] <> '/t'")
def scrape_competitor(spark, sf_dir):
    """The offers of a search result: title, price in cents and address of its first five cards, incomplete ones left out."""
    n = F.col("page_id")
    cents = F.concat(F.lit('<span class="andes-money-amount__cents"> '), (n % 100).cast("string"), F.lit("</span>"))
    price = lambda more: F.concat(F.lit('<span class="andes-money-amount__fraction">10.'), F.lpad((n % 1000).cast("string"), 3, "0"), F.lit("</span>"), more)
    card = lambda begins, more: lambda page: F.regexp_replace(page, F.lit(f'<li><a href="({begins}[^"]*)">([^<]*)</a></li>'), F.concat(F.lit('<li class="x ui-search-layout__item"><h2 class="ui-search-item__title"> <b>$2</b> </h2><a class="ui-search-link y" href="$1">'), more, F.lit("</a></li>")))
    page = card("", price(cents))(card("/a", price(F.lit("")))(card("/t", F.lit(""))(F.col("html"))))
    return logical(spark, sf_dir, "page").select("page_id", F.explode(H.result_cards(page, 5)).alias("card")).select("page_id", "card.*")
