"""Queries over prices, pages and vectors."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalens.config import DEFAULTS
from catalens.functions import html as H
from catalens.functions import pricing as P
from catalens.functions import vectors as V
from catalens.operators import pricing, search
from catalens.plans.registry import Registry
from catalens.sources.catalog import logical, logical_sql
from catalens.sources.keyed_table import BatchLog, KeyedTable
from catalens.streaming.jobs import work_folder

R = Registry()
HISTORY = logical_sql("price_history")
#: The bands of the demonstration: distinct test vectors are never closer than about 0.5.
DEMO = replace(DEFAULTS, embed_match_threshold=0.38, embed_suggest_threshold=0.29, embed_name_rescue_image_floor=0.16)

LAG_SQL = "lagged AS (SELECT *, lag(price_cents) OVER w AS previous_cents, lag(currency) OVER w AS previous_currency FROM price_history WINDOW w AS (PARTITION BY product_id, source ORDER BY captured_at, order_no, line_no, price_cents))"
CASE_SQL = "CASE WHEN previous_cents IS NULL THEN 'first_observation' WHEN coalesce(previous_currency, '') <> '' AND previous_currency <> currency THEN 'skip_currency' WHEN previous_cents <= 0 THEN 'alert_critical' WHEN abs((price_cents - previous_cents) / previous_cents) < 0.05 THEN 'ok' WHEN abs((price_cents - previous_cents) / previous_cents) > 0.3 THEN 'alert_critical' ELSE 'alert' END"
DECIDED_SQL = HISTORY.rstrip() + f", {LAG_SQL}, decided AS (SELECT *, {CASE_SQL} AS decision FROM lagged), drifted AS (SELECT *, CASE WHEN decision IN ('ok', 'alert', 'alert_critical') THEN round((price_cents - previous_cents) / previous_cents, 6) ELSE 0.0::DOUBLE END AS drift FROM decided) "
KEY = ["product_id", "source", "order_no", "line_no"]


def history(spark, sf_dir):
    return logical(spark, sf_dir, "price_history")


@R.add("scan_history", HISTORY + "SELECT product_id, source, price_cents, currency, captured_at FROM price_history")
def scan_history(spark, sf_dir):
    return history(spark, sf_dir).select("product_id", "source", "price_cents", "currency", "captured_at")


@R.add("window_prev_snapshot", HISTORY.rstrip() + f", {LAG_SQL} SELECT product_id, source, captured_at, price_cents, previous_cents, previous_currency FROM lagged WHERE previous_cents IS NOT NULL")
def window_prev_snapshot(spark, sf_dir):
    return pricing.previous_snapshot(history(spark, sf_dir)).filter("previous_cents IS NOT NULL").select("product_id", "source", "captured_at", "price_cents", "previous_cents", "previous_currency")


@R.add("window_price_decision", DECIDED_SQL + "SELECT decision, count(*) AS n, round(avg(drift), 4) AS mean_drift FROM drifted GROUP BY decision")
def window_price_decision(spark, sf_dir):
    return pricing.decide(history(spark, sf_dir)).groupBy("decision").agg(F.count("*").alias("n"), F.round(F.avg("drift"), 4).alias("mean_drift"))


@R.add("price_decision", DECIDED_SQL + "SELECT product_id, source, order_no, line_no, decision, drift FROM drifted")
def price_decision(spark, sf_dir):
    return pricing.decide(history(spark, sf_dir)).select(*KEY, "decision", "drift")


@R.add("price_alert_text", DECIDED_SQL + "SELECT product_id, source, order_no, line_no, printf('%s %s %s: %.2f -> %.2f (%+.1f%%)', CASE decision WHEN 'alert_critical' THEN '[!!]' ELSE '[!]' END, product_id, 'item ' || source, previous_cents / 100, price_cents / 100, (price_cents - previous_cents) / previous_cents * 100) AS text FROM drifted WHERE decision IN ('alert', 'alert_critical')")
def price_alert_text(spark, sf_dir):
    rows = pricing.decide(history(spark, sf_dir)).filter(F.col("decision").isin("alert", "alert_critical"))
    return rows.select(*KEY, P.alert_text(F.col("decision"), F.col("product_id"), F.concat(F.lit("item "), "source"), F.col("previous_cents"), F.col("price_cents")).alias("text"))


@R.add("price_cents", "SELECT p_partkey, CAST(round_even(CAST(p_size AS DOUBLE) / 8 * 100, 0) AS BIGINT) AS cents FROM part")
def price_cents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", P.price_cents(F.col("p_size").cast("double") / 8).alias("cents"))


@R.add("fmt_price", logical_sql("catalog") + "SELECT id, CASE WHEN price_cents IS NULL THEN '-' ELSE printf('%.2f', price_cents / 100) || ' ' || coalesce(product_code, '') END AS shown FROM catalog")
def fmt_price(spark, sf_dir):
    return logical(spark, sf_dir, "catalog").select("id", P.fmt_price(F.col("price_cents"), F.col("product_code")).alias("shown"))


@R.add("agg_cheapest", HISTORY + "SELECT product_id, min(price_cents) FILTER (WHERE price_cents > 0) AS price_cents, arg_min(currency, struct_pack(a := price_cents, b := source, c := currency)) FILTER (WHERE price_cents > 0) AS currency, CASE WHEN count(*) FILTER (WHERE price_cents > 0) > 0 THEN count(*) FILTER (WHERE price_cents > 0) ELSE count(*) END AS n FROM price_history GROUP BY product_id")
def agg_cheapest(spark, sf_dir):
    return pricing.cheapest(history(spark, sf_dir), ["product_id"])


@R.add("sink_delete_old", HISTORY + f"SELECT product_id, source, order_no, line_no FROM price_history WHERE captured_at >= (SELECT max(captured_at) FROM price_history) - INTERVAL {DEFAULTS.price_history_retention_days} DAY")
def sink_delete_old(spark, sf_dir):
    """Prices in folders by month: old months' folders go whole, the month of the cutoff is rewritten, the others stay."""
    rows = history(spark, sf_dir)
    month = F.year("captured_at") * 12 + F.month("captured_at")
    table = KeyedTable(spark, f"{work_folder(spark)}/history", rows.schema, KEY, bucket=month)
    table.insert(rows)
    now = rows.agg(F.max("captured_at")).first()[0]
    pricing.prune(table, now, DEFAULTS.price_history_retention_days)
    return table.read().select(*KEY)


@R.add("stream_retention", HISTORY + f"SELECT source, count(*) AS kept FROM price_history WHERE captured_at >= (SELECT max(captured_at) FROM price_history) - INTERVAL {DEFAULTS.price_history_retention_days} DAY GROUP BY source")
def stream_retention(spark, sf_dir):
    return sink_delete_old(spark, sf_dir).groupBy("source").agg(F.count("*").alias("kept"))


@R.add("sink_append_snapshot", HISTORY + "SELECT product_id, source, max(captured_at) AS captured_at, arg_max(price_cents, struct_pack(a := captured_at, b := order_no, c := line_no, d := price_cents)) AS price_cents FROM price_history GROUP BY product_id, source")
def sink_append_snapshot(spark, sf_dir):
    """The newest price of each product and source, appended as one batch; the batch written again changes nothing."""
    newest = F.max(F.struct(*pricing.ORDER)).alias("x")
    rows = history(spark, sf_dir).groupBy("product_id", "source").agg(newest).select("product_id", "source", "x.captured_at", "x.price_cents")
    written = BatchLog(spark, f"{work_folder(spark)}/snapshots", rows.schema)
    for _ in range(2):
        written.append(rows, 0)
    return written.read()


# ---- pages -----------------------------------------------------------------------------------

OFFER_SQL = "'{\"pictures\": [{\"secure_url\": \"s' || CAST(page_id AS VARCHAR) || '\"}, {\"url\": \"u1\"}, {\"url\": \"u1\"}]}'"


@R.add("text_normalize", r"SELECT page_id, length(lower(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')))) AS n, substr(lower(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))), 1, 80) AS head FROM pages")
def text_normalize(spark, sf_dir):
    from catalens.functions.text import text_normalize as normal

    rows = logical(spark, sf_dir, "page").select("page_id", normal(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n"), F.substring("t", 1, 80).alias("head"))


#: The address, origin and folder of each page, for oracles.
PLACES_SQL = "places AS (SELECT *, CASE WHEN folder = origin THEN origin ELSE regexp_replace(folder, '/[^/]*$', '') END AS up FROM (SELECT *, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '') AS folder, CAST(page_id AS VARCHAR) AS n FROM pages))"


def _with_head(spark, sf_dir, *parts):
    """Pages with tags of their own number put in."""
    return logical(spark, sf_dir, "page").select("page_id", "url", F.concat("html", *parts).alias("html"))


def _numbered(before: str, after: str):
    return F.concat(F.lit(before), F.col("page_id").cast("string"), F.lit(after))


@R.add(
    "html_meta",
    "WITH " + PLACES_SQL + r" SELECT page_id, substr(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), 1, 300) AS title, "
    "'https://a.co/s' || n || '.jpg,' || origin || '/o/' || n || '.jpg,' || CASE WHEN page_id % 2 = 0 THEN 'https://a.co/n.jpg,' ELSE '' END || folder || '/t.png,https://b.co/src.png' AS images, up || '/l' || n || '.gif' AS link FROM places",
)
def html_meta(spark, sf_dir):
    """Titles, meta pictures of all six keys in their order of precedence, and image_src links, whatever the tags' order."""
    n = F.col("page_id")
    head = [
        F.lit('<meta name="twitter:image:src" content="https://b.co/src.png"><meta name=\'twitter:image\' content=\'t.png\'/>'),
        F.when(n % 2 == 0, '<META content="https://a.co/n.jpg" name="og:image">').otherwise('<meta itemprop="image" content="https://no.co/i.jpg">'),
        _numbered('<meta property="og:image" content="/x/../o/', '.jpg">'),
        _numbered('<link rel="preload image_src" href="../l', '.gif">'),
        _numbered('<meta property="og:image:secure_url" content="https://a.co/s', '.jpg"><meta property="og:image:url" content="https://no.co/u.jpg">'),
    ]
    rows = _with_head(spark, sf_dir, *head).select("page_id", H.title(F.col("html")).alias("title"), H.meta_pictures("html", "url").alias("m"))
    return rows.select("page_id", "title", F.array_join("m.images", ",").alias("images"), F.array_join("m.link", ",").alias("link"))


@R.add("html_antibot", "SELECT page_id, " + " OR ".join(f"contains(lower(substr(html, 1, 4000)), '{m}')" for m in H.ANTIBOT) + " AS blocked FROM pages")
def html_antibot(spark, sf_dir):
    return logical(spark, sf_dir, "page").select("page_id", H.antibot(F.col("html")).alias("blocked"))


@R.add("html_cdn_regex", "SELECT page_id, 'https://http2.mlstatic.com/a/' || CAST(page_id AS VARCHAR) || '.jpg,https://i.alicdn.com/b.png' AS pictures FROM pages")
def html_cdn_regex(spark, sf_dir):
    page = F.concat("html", F.lit(' "https://i.alicdn.com/b.png" https://http2.mlstatic.com/a/'), F.col("page_id").cast("string"), F.lit(".jpg https://i.alicdn.com/b.png"))
    return logical(spark, sf_dir, "page").select("page_id", F.array_join(H.server_pictures(page), ",").alias("pictures"))


@R.add("regex_price", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS DOUBLE) + 0.5 WHEN page_id % 3 = 1 THEN CAST(page_id AS DOUBLE) END AS price FROM pages")
def regex_price(spark, sf_dir):
    n = F.col("page_id")
    page = F.when(n % 3 == 0, F.concat("html", F.lit('{"formatedActivityPrice": "US $'), n.cast("string"), F.lit(',5"}'))).when(n % 3 == 1, F.concat("html", F.lit('"priceRange": [ '), n.cast("string"), F.lit(", 99]"))).otherwise(F.col("html"))
    return logical(spark, sf_dir, "page").select("page_id", H.listed_price(page).alias("price"))


@R.add("pictures", "SELECT page_id, 's' || CAST(page_id AS VARCHAR) || ',u1' AS pictures FROM pages")
def pictures(spark, sf_dir):
    body = F.concat(F.lit('{"pictures": [{"secure_url": "s'), F.col("page_id").cast("string"), F.lit('", "url": "x"}, {"url": "u1"}, {"url": "u1"}], "thumbnail": "t"}'))
    parsed = F.from_json(body, "pictures array<struct<secure_url:string,url:string>>, thumbnail string")
    urls = F.array_distinct(F.array_compact(F.transform(parsed["pictures"], lambda p: F.coalesce(F.nullif(p["secure_url"], F.lit("")), p["url"]))))
    chosen = F.when(F.size(urls) > 0, urls).otherwise(F.array_compact(F.array(parsed["thumbnail"])))
    return logical(spark, sf_dir, "page").select("page_id", F.array_join(F.slice(chosen, 1, 6), ",").alias("pictures"))


@R.add("fetch_source_1688", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE page_id * 100 + 25 END AS cents, CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'CNY' END AS currency FROM pages")
def fetch_source_1688(spark, sf_dir):
    n = F.col("page_id")
    body = F.when(n % 4 == 0, "{broken").otherwise(F.concat(F.lit('{"Result": {"Item": {"Price": {"OriginalPrice": '), n.cast("string"), F.lit('.25, "OriginalCurrencyCode": "CNY"}}}}')))
    price = F.from_json(body, "Result struct<Item:struct<Price:struct<OriginalPrice:double,OriginalCurrencyCode:string>>>")["Result"]["Item"]["Price"]
    return logical(spark, sf_dir, "page").select("page_id", P.price_cents(price["OriginalPrice"]).alias("cents"), price["OriginalCurrencyCode"].alias("currency"))


_LD = '<script type="application/ld+json">'


@R.add(
    "extract_page",
    "WITH " + PLACES_SQL + r", plain AS (SELECT *, page_id % 5 AS k, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&quot;?', chr(34), 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g')), 1, 300) AS heading FROM places) "
    "SELECT page_id, CASE k WHEN 0 THEN 'Item ' || n WHEN 1 THEN 'Shared ' || n ELSE heading END AS title, "
    "CASE k WHEN 0 THEN folder || '/p' || n || '.jpg,https://a.co/og.jpg' WHEN 1 THEN origin || '/m/' || n || '.jpg' WHEN 2 THEN 'https://i.alicdn.com/' || n || '.png' ELSE '' END AS images, CASE k WHEN 3 THEN 'blocked' WHEN 4 THEN 'none_found' END AS problem FROM plain",
)
def extract_page(spark, sf_dir):
    """Pages whose pictures are in a product description, in meta tags, on a picture server, behind a robot check, or nowhere."""
    k = F.col("page_id") % 5
    product = _numbered(_LD + '[{"@type": "product", "name": " Item ', ' ", "image": {"contentUrl": "x/../p')
    product = F.concat(product, _numbered("", '.jpg"}}]</script><meta property="og:title" content="no"><meta property="og:image" content="https://a.co/og.jpg">'))
    shared = F.concat(_numbered('<meta property="og:title" content="Shared ', '"><meta name="og:image" content="/logo.png">'), _numbered('<meta property="twitter:image" content="/m/', '.jpg">'))
    head = F.when(k == 0, product).when(k == 1, shared).when(k == 2, _numbered('<script>x("https://i.alicdn.com/', '.png")</script><meta property="og:image" content="https://a.co/banner.png">')).when(k == 3, "<p>Are you a ROBOT?</p>").otherwise("")
    rows = logical(spark, sf_dir, "page").select("page_id", "url", F.concat(head, "html").alias("html")).select("page_id", H.extract_page("html", "url").alias("x"))
    return rows.select("page_id", "x.title", F.array_join("x.images", ",").alias("images"), "x.problem")


def _with_jsonld(spark, sf_dir):
    """The pages with a product description of their own number put in: an address, a list, an object, a graph, a list of blocks."""
    k = F.col("page_id") % 4
    offer = _numbered('"offers": [{"lowPrice": "', '.5"}, {"price": 1}]')
    one = F.concat(F.lit('{"@type": "Product", "image": "/1.jpg", "offers": {"price": '), F.col("page_id").cast("string"), F.lit(', "priceCurrency": "EUR"}}'))
    listed = F.concat(F.lit('{"@type": ["Thing", "PRODUCT"], "image": [{"url": "https://no.co/1.jpg"}, "https://a.co/2.jpg", "3.jpg"], '), offer, F.lit("}"))
    graph = F.concat(F.lit('{"@graph": [{"@type": "product", "image": {"url": "//a.co/g.jpg"}, '), offer, F.lit("}]}"))
    several = F.concat(F.lit('[{"@type": "Offer", "image": "https://no.co/x.jpg"}, {"@type": "Product", "image": {"contentUrl": "../c.jpg"}, '), offer, F.lit("}]"))
    block = F.concat(F.lit(_LD), F.when(k == 0, one).when(k == 1, listed).when(k == 2, graph).otherwise(several), F.lit("</script>"))
    return _with_head(spark, sf_dir, F.lit(_LD + "{broken</script>"), block).select("page_id", H.extract_page("html", "url").alias("x"))


@R.add("html_jsonld", "WITH " + PLACES_SQL + " SELECT page_id, CASE page_id % 4 WHEN 0 THEN origin || '/1.jpg' WHEN 1 THEN 'https://a.co/2.jpg,' || folder || '/3.jpg' WHEN 2 THEN 'https://a.co/g.jpg' ELSE up || '/c.jpg' END AS images FROM places")
def html_jsonld(spark, sf_dir):
    return _with_jsonld(spark, sf_dir).select("page_id", F.array_join("x.images", ",").alias("images"))


@R.add("jsonld_price", "SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN CAST(page_id AS DOUBLE) + 0.5 WHEN page_id <> 0 THEN CAST(page_id AS DOUBLE) END AS price, CASE WHEN page_id % 4 <> 0 THEN 'USD' WHEN page_id <> 0 THEN 'EUR' END AS currency FROM pages")
def jsonld_price(spark, sf_dir):
    return _with_jsonld(spark, sf_dir).select("page_id", "x.price", "x.currency")


@R.add("setop_concat_priority", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://a.co/1.jpg,https://a.co/og.jpg' ELSE 'https://a.co/og.jpg' END AS images FROM pages")
def setop_concat_priority(spark, sf_dir):
    block = F.when(F.col("page_id") % 2 == 0, '<script type="application/ld+json">{"@type": "Product", "image": "https://a.co/1.jpg"}</script>').otherwise("")
    page = F.concat("html", block, F.lit('<meta property="og:image" content="https://a.co/og.jpg"> https://i.alicdn.com/late.png'))
    return logical(spark, sf_dir, "page").select("page_id", H.extract_page(page, F.col("url")).alias("x")).select("page_id", F.array_join("x.images", ",").alias("images"))


# ---- vectors ---------------------------------------------------------------------------------

VEC = logical_sql("vector")


def stored(df):
    """``df`` written to the shared folder and read back."""
    path = f"{work_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def vectors(spark, sf_dir):
    return logical(spark, sf_dir, "vector").withColumnRenamed("embedding", "vector")


def asked(spark, sf_dir):
    """Every twentieth vector as a query."""
    return vectors(spark, sf_dir).filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("product_id").alias("query_product"), F.col("vector").alias("query_vector"))


DOT_SQL = "round(list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))), 6)"
SCORED_SQL = VEC.rstrip() + f", scored AS (SELECT a.vec_id AS query_id, b.product_id, b.image, {DOT_SQL} AS score FROM vector a JOIN vector b ON a.vec_id % 20 = 0 AND a.product_id <> b.product_id), best AS (SELECT query_id, product_id, arg_min(image, struct_pack(s := -score, i := image)) AS image, max(score) AS score FROM scored GROUP BY 1, 2), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM best) "


@R.add("topk_vector", SCORED_SQL + "SELECT query_id, product_id, image, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 3")
def topk_vector(spark, sf_dir):
    return search.topk_vectors(asked(spark, sf_dir), vectors(spark, sf_dir), k=3)


@R.add("agg_image_best", SCORED_SQL + "SELECT query_id, product_id, image, score FROM best")
def agg_image_best(spark, sf_dir):
    """The best picture and score of every product for every query; a product's pictures are gathered first, so that no pair is shuffled."""
    return search.best_pictures(asked(spark, sf_dir), vectors(spark, sf_dir))


def _pairs(spark, sf_dir, wanted: list[str]):
    """Scores of the wanted products for every query, best picture each; the few wanted rows are the small side."""
    some = F.broadcast(vectors(spark, sf_dir).filter(F.col("product_id").isin(wanted)).select("product_id", "image", "vector"))  # two vectors a product
    rows = asked(spark, sf_dir).join(some, F.col("query_product") != F.col("product_id")).withColumn("score", V.cosine(F.col("query_vector"), F.col("vector")))
    best = rows.groupBy("query_id", "product_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "image")).alias("x"), F.max("score").alias("score"))
    return best.select("query_id", "product_id", F.col("x.image").alias("image"), "score")


@R.add("topk_vector_subset", SCORED_SQL + "SELECT query_id, product_id, score FROM best WHERE product_id IN ('7', '11')")
def topk_vector_subset(spark, sf_dir):
    return _pairs(spark, sf_dir, ["7", "11"]).select("query_id", "product_id", "score")


@R.add("argmax_row", SCORED_SQL + "SELECT query_id, product_id, score FROM ranked WHERE rank = 1")
def argmax_row(spark, sf_dir):
    return search.topk_vectors(asked(spark, sf_dir), vectors(spark, sf_dir), k=1).select("query_id", "product_id", "score")


@R.add("join_embed_pairs", VEC + f"SELECT a.product_id, max(greatest(0.0, {DOT_SQL})) AS similarity FROM vector a JOIN vector b ON a.product_id = b.product_id AND a.vec_id < b.vec_id GROUP BY a.product_id")
def join_embed_pairs(spark, sf_dir):
    a, b = vectors(spark, sf_dir).alias("a"), vectors(spark, sf_dir).alias("b")
    pairs = a.join(b, (F.col("a.product_id") == F.col("b.product_id")) & (F.col("a.vec_id") < F.col("b.vec_id")))  # two images a product
    return pairs.groupBy(F.col("a.product_id").alias("product_id")).agg(F.max(F.greatest(F.lit(0.0), V.cosine(F.col("a.vector"), F.col("b.vector")))).alias("similarity"))


@R.add("cosine", VEC + f"SELECT a.vec_id, {DOT_SQL} AS score FROM vector a JOIN vector b ON b.vec_id = a.vec_id + 1")
def cosine(spark, sf_dir):
    b = vectors(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), F.col("vector").alias("other"))
    return vectors(spark, sf_dir).join(b, "vec_id").select("vec_id", V.cosine(F.col("vector"), F.col("other")).alias("score"))


@R.add("vec_normalize", VEC + "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS before, 1.0::DOUBLE AS after FROM vector")
def vec_normalize(spark, sf_dir):
    doubled = F.transform("vector", lambda x: x * 1.0)
    return vectors(spark, sf_dir).select("vec_id", F.round(V.norm(doubled), 4).alias("before"), F.round(V.norm(V.vec_normalize(F.transform("vector", lambda x: x * 3))), 4).alias("after"))


_FLOAT_BITS = "CASE WHEN x = 0 THEN 0 ELSE (CASE WHEN x < 0 THEN 2147483648 ELSE 0 END) + CASE WHEN e < -126 THEN CAST(abs(x) * pow(2.0, 149) AS BIGINT) ELSE (e + 127) * 8388608 + CAST((abs(x) / pow(2.0, e) - 1) * 8388608 AS BIGINT) END END"
_FLOOR_LOG2 = "CASE WHEN x = 0 THEN 0 WHEN pow(2.0, CAST(floor(log2(abs(x))) AS INTEGER)) > abs(x) THEN CAST(floor(log2(abs(x))) AS INTEGER) - 1 WHEN pow(2.0, CAST(floor(log2(abs(x))) AS INTEGER) + 1) <= abs(x) THEN CAST(floor(log2(abs(x))) AS INTEGER) + 1 ELSE CAST(floor(log2(abs(x))) AS INTEGER) END"


@R.add(
    "vec_encode",
    VEC.rstrip() + f", flat AS (SELECT vec_id, i, x, {_FLOOR_LOG2} AS e FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM vector)), "
    f"coded AS (SELECT vec_id, i, {_FLOAT_BITS} AS b FROM flat), "
    "hexed AS (SELECT vec_id, string_agg(printf('%02X%02X%02X%02X', b % 256, b // 256 % 256, b // 65536 % 256, b // 16777216), '' ORDER BY i) AS h FROM coded GROUP BY vec_id) SELECT vec_id, to_base64(unhex(h)) AS text FROM hexed",
)
def vec_encode(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", V.vec_encode("vector").alias("text"))


@R.add("vec_decode", VEC + "SELECT vec_id, 64 AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM vector")
def vec_decode(spark, sf_dir):
    decoded = vec_encode(spark, sf_dir).withColumn("v", V.vec_decode(64)("text"))
    return decoded.select("vec_id", F.size("v").alias("n"), F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("first"))


@R.add("phash_image")
def phash_image(spark, sf_dir):
    """The 64 values of a vector as a picture of 8 by 8 points."""
    return vectors(spark, sf_dir).select("vec_id", V.phash_pixels("vector").alias("phash"))


@R.add("clip_preprocess")
def clip_preprocess(spark, sf_dir):
    """The first 60 values of a vector as a coloured picture of five by four points, prepared for the picture model at its 224 points a side."""
    pixels = F.unhex(F.array_join(F.transform(F.slice("vector", 1, 60), lambda x: F.lpad(F.hex(F.pmod(F.floor(x.cast("double") * 1000), F.lit(256))), 2, "0")), ""))
    pictures = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), pixels.alias("pixels"), F.lit(5).alias("width"), F.lit(4).alias("height"))
    made = V.clip_tensors(pictures).select(F.col("id").alias("vec_id"), F.col("tensor").alias("p"))
    return made.select("vec_id", F.size("p").alias("n"), F.round(F.get("p", F.lit(0)), 4).alias("first"), F.round(F.get("p", F.lit(3 * 224 * 224 - 1)), 4).alias("last"))


SIGN_SQL = "signs AS (SELECT vec_id, product_id, image, list_transform(embedding, lambda x: CAST(x AS DOUBLE) > m) AS bits FROM (SELECT *, (CAST(list_sort(embedding)[32] AS DOUBLE) + CAST(list_sort(embedding)[33] AS DOUBLE)) / 2 AS m FROM vector))"
HAMMING_SQL = "1 - len(list_filter(range(1, 65), lambda i: a.bits[i] <> b.bits[i])) / 64"


@R.add("phash_score", VEC.rstrip() + f", {SIGN_SQL} SELECT a.vec_id, round(greatest(0.0, {HAMMING_SQL}), 6) AS score FROM signs a JOIN signs b ON b.vec_id = a.vec_id + 1")
def phash_score(spark, sf_dir):
    signs = vectors(spark, sf_dir).select("vec_id", V.sign_hash(F.col("vector")).alias("h"))
    other = signs.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("h2"))
    return signs.join(other, "vec_id").select("vec_id", F.round(V.phash_score(F.col("h"), F.col("h2")), 6).alias("score"))


@R.add("join_image_pairs", VEC.rstrip() + f", {SIGN_SQL} SELECT a.product_id, round(max({HAMMING_SQL}), 6) AS similarity FROM signs a JOIN signs b ON CAST(b.product_id AS BIGINT) = CAST(a.product_id AS BIGINT) + 1 GROUP BY a.product_id")
def join_image_pairs(spark, sf_dir):
    signs = vectors(spark, sf_dir).select("product_id", V.sign_hash(F.col("vector")).alias("h"))
    other = signs.select((F.col("product_id").cast("long") - 1).cast("string").alias("product_id"), F.col("h").alias("h2"))
    return signs.join(other, "product_id").groupBy("product_id").agg(F.round(F.max(V.phash_score(F.col("h"), F.col("h2"))), 6).alias("similarity"))


#: Every twentieth vector asks: a third with its own hash, the others with that of the next product's picture, some last bits changed.
ASKED_HASH_SQL = "asked AS (SELECT a.vec_id AS query_id, a.product_id, CASE WHEN a.vec_id % 3 = 0 OR b.vec_id IS NULL THEN a.bits ELSE list_transform(range(1, 65), lambda i: b.bits[i] <> (i > 64 - a.vec_id % 13)) END AS bits FROM signs a LEFT JOIN signs b ON b.vec_id = a.vec_id + 2 WHERE a.vec_id % 20 = 0)"


@R.add("join_phash_scan", VEC.rstrip() + f", {SIGN_SQL}, {ASKED_HASH_SQL} SELECT query_id, product_id, score FROM (SELECT a.query_id, b.product_id, round({HAMMING_SQL}, 6) AS score, row_number() OVER (PARTITION BY a.query_id ORDER BY round({HAMMING_SQL}, 6) DESC, b.product_id) AS nth FROM asked a JOIN signs b ON b.vec_id % 2 = 0 AND CAST(b.product_id AS BIGINT) % 17 <> 0 AND a.product_id <> b.product_id) WHERE nth = 1")
def join_phash_scan(spark, sf_dir):
    """Query pictures against the first picture of every enabled product."""
    signs = stored(vectors(spark, sf_dir).select("vec_id", "product_id", V.sign_hash(F.col("vector")).alias("hash")))
    n = F.col("vec_id")
    other = signs.select((n - 2).alias("vec_id"), F.col("hash").alias("other"))
    changed = F.col("other").bitwiseXOR(F.expr("shiftleft(1L, int(vec_id % 13)) - 1"))
    asks = signs.filter(n % 20 == 0).join(other, "vec_id", "left")
    asks = asks.select(n.alias("query_id"), F.col("product_id").alias("query_product"), F.when((n % 3 == 0) | F.col("other").isNull(), F.col("hash")).otherwise(changed).alias("hash"))
    enabled = F.col("product_id").cast("long") % 17 != 0
    return search.nearest_hashes(asks, signs.filter((n % 2 == 0) & enabled).select("product_id", "hash"), keep=stored)


@R.add("join_price_by_image", SCORED_SQL.rstrip() + ", prices AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_retailprice AS price FROM part) SELECT query_id, r.product_id, price FROM ranked r LEFT JOIN prices p ON r.product_id = p.product_id WHERE rank = 1")
def join_price_by_image(spark, sf_dir):
    prices = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_retailprice").alias("price"))
    return argmax_row(spark, sf_dir).join(prices, "product_id", "left").select("query_id", "product_id", "price")


NAME_SQL = "named AS (SELECT *, CASE WHEN CAST(product_id AS BIGINT) % 5 = 0 THEN NULL ELSE CAST((CAST(product_id AS BIGINT) * 7 + query_id) % 100 AS DOUBLE) / 100 END AS name_score FROM ranked WHERE rank <= 5), winner AS (SELECT *, coalesce(name_score >= 0.72, false) AS confirmed, NOT coalesce(name_score >= 0.72, false) AND coalesce(name_score < 0.3, false) AS vetoed FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(name_score >= 0.72, false) DESC, score DESC, product_id) AS nth FROM named) WHERE nth = 1) "


def _winners(spark, sf_dir):
    top = search.topk_vectors(asked(spark, sf_dir), vectors(spark, sf_dir), k=5)
    p = F.col("product_id").cast("long")
    named = top.withColumn("name_score", F.when(p % 5 != 0, ((p * 7 + F.col("query_id")) % 100).cast("double") / 100))
    return search.best_candidate(named)


@R.add("rank_fuse", SCORED_SQL.rstrip() + f", {NAME_SQL} SELECT query_id, product_id, score, confirmed, vetoed FROM winner")
def rank_fuse(spark, sf_dir):
    return _winners(spark, sf_dir).select("query_id", "product_id", "score", "confirmed", "vetoed")


@R.add("lookup_decision", SCORED_SQL.rstrip() + f", {NAME_SQL} SELECT query_id, CASE WHEN score >= 0.38 AND query_id % 40 <> 0 AND NOT vetoed THEN 'found' WHEN NOT vetoed AND (score >= 0.29 OR (confirmed AND score >= 0.16)) THEN CASE WHEN query_id % 60 = 0 THEN 'rejected' ELSE 'suggestion' END ELSE 'not_found' END AS decision FROM winner")
def lookup_decision(spark, sf_dir):
    q = F.col("query_id")
    decision = search.lookup_decision(F.col("score"), F.col("confirmed"), F.col("vetoed"), q % 40 == 0, q % 60 == 0, DEMO)
    return _winners(spark, sf_dir).select("query_id", decision.alias("decision"))


@R.add("setop_channel_union", SCORED_SQL.rstrip() + ", byname AS (SELECT query_id, CAST(query_id % 7 AS VARCHAR) AS product_id FROM (SELECT DISTINCT query_id FROM ranked)), both_channels AS (SELECT query_id, product_id FROM ranked WHERE rank <= 5 UNION SELECT query_id, product_id FROM byname) SELECT u.query_id, u.product_id, b.score FROM both_channels u JOIN best b ON u.query_id = b.query_id AND u.product_id = b.product_id")
def setop_channel_union(spark, sf_dir):
    pictures_found = search.topk_vectors(asked(spark, sf_dir), vectors(spark, sf_dir), k=5).select("query_id", "product_id", "score")
    wanted = [str(i) for i in range(7)]
    by_name = _pairs(spark, sf_dir, wanted).filter(F.col("product_id") == (F.col("query_id") % 7).cast("string")).select("query_id", "product_id", "score")
    return pictures_found.unionByName(by_name).groupBy("query_id", "product_id").agg(F.max("score").alias("score"))
