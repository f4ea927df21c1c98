"""Readers of the logical tables, derived from the Parquet tables column by column.

Every logical table is a list of expressions in the SQL that Spark and other engines share, so the
same text defines it for the queries and for their oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Logical table -> (Parquet table, expressions).
LOGICAL: dict[str, tuple[str, list[str]]] = {
    "catalog": (
        "part",
        [
            "p_partkey AS pos",
            "CAST(p_partkey AS STRING) AS id",
            "CASE WHEN p_partkey % 41 = 0 THEN ' ' WHEN p_partkey % 55 = 0 THEN 'BX ' || p_name ELSE p_name END AS name",
            "replace(p_name, ' ', '-') AS slug",
            "p_brand || ' ' || p_type AS description",
            "p_partkey % 17 <> 0 AS enabled",
            "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE 'https://Shop' || CAST(CAST(floor(p_partkey / 3) AS BIGINT) % 7 AS STRING) || '.example.com/offer/' || CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING) || CASE p_partkey % 3 WHEN 0 THEN '/' WHEN 1 THEN '?utm_source=feed&b=2&a=1' ELSE '?a=1&b=2&spm=x#top' END END AS source_url",
            "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'https://img.example.com/' || CAST(p_partkey AS STRING) || '.jpg' END AS preview_url",
            "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'https://img.example.com/src/' || CAST(p_partkey AS STRING) || '.jpg' END AS asset_url",
            "CASE WHEN p_partkey % 13 = 0 THEN 0 WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(round(p_retailprice * 100) AS BIGINT) END AS price_cents",
            "p_size % 4 AS variant_count",
            "CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE 'C-' || CAST(p_partkey AS STRING) END AS product_code",
            "CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE '2024-01-' || CASE WHEN p_partkey % 28 < 9 THEN '0' ELSE '' END || CAST(p_partkey % 28 + 1 AS STRING) || 'T00:00:00' END AS updated_at",
        ],
    ),
    "variant": (
        "lineitem",
        [
            "l_partkey AS pos",
            "CAST(l_partkey AS STRING) AS product_id",
            "CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS variant_no",
            "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS variant_id",
            "CASE WHEN l_orderkey % 37 = 0 THEN ' pa-' ELSE 'size ' END || CAST(l_linenumber AS STRING) AS variant_name",
            "'SKU' || CAST(l_suppkey AS STRING) AS sku",
            "CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents",
        ],
    ),
    "price_history": (
        "lineitem",
        [
            "CAST(l_partkey AS STRING) AS product_id",
            "CAST(l_suppkey AS STRING) AS source",
            "CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT) AS price_cents",
            "CASE l_returnflag WHEN 'A' THEN 'CNY' ELSE 'USD' END AS currency",
            "l_shipdate AS captured_at",
            "l_orderkey AS order_no",
            "l_linenumber AS line_no",
        ],
    ),
    "audit_log": (
        "events",
        [
            "event_id AS id",
            "CASE event_id % 14 WHEN 0 THEN 'duplicate_disabled' WHEN 1 THEN 'duplicate_flagged' WHEN 2 THEN 'price_flagged' WHEN 3 THEN 'verify_passed' WHEN 4 THEN 'downstream_failed' WHEN 5 THEN 'quality_issue_found' WHEN 6 THEN 'pa_variant_flagged' WHEN 7 THEN 'bx_no_image_flagged' WHEN 8 THEN 'bx_no_image_disabled' WHEN 9 THEN 'app_lookup_match' WHEN 10 THEN 'app_lookup_suggested' WHEN 11 THEN 'app_lookup_request_sent' WHEN 12 THEN 'app_lookup_no_image' ELSE event_type END AS action",
            "CASE event_id % 6 WHEN 0 THEN 'primary' WHEN 1 THEN 'orders' WHEN 2 THEN 'orders-pro' WHEN 3 THEN 'audit' WHEN 4 THEN NULL ELSE 'otapi' END AS source",
            "CASE WHEN user_id % 19 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS product_id",
            "CASE WHEN event_id % 3 = 0 THEN CAST(user_id + 1 AS STRING) END AS related_product_id",
            "CASE event_id % 4 WHEN 0 THEN 'No Image; price = 0' WHEN 1 THEN 'matched by URL and text' WHEN 2 THEN NULL ELSE 'event ' || event_type END AS detail",
            "CASE WHEN event_id % 9 = 0 THEN '{broken' WHEN event_id % 2 = 0 THEN '{\"enabled\": ' || CASE WHEN event_id % 4 = 0 THEN 'true' ELSE 'false' END || '}' END AS before",
            "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 15 = 0 THEN '{broken' ELSE '{\"k\": ' || CAST(event_id % 100 AS STRING) || ', \"matched_by\": [\"' || CASE event_id % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'text' ELSE 'image' END || '\"], \"per_strategy_scores\": {\"url\": ' || CASE WHEN event_id % 3 = 0 THEN '1.0' ELSE '0.0' END || ', \"text\": 0.' || CAST(event_id % 10 AS STRING) || '}}' END AS after",
            "CASE WHEN event_id % 25 = 0 THEN NULL WHEN event_id % 8 < 4 THEN 0.9 + (event_id % 11) / 110.0 ELSE value / 500 END AS confidence",
            "ts AS created_at",
            "event_id % 10 = 3 AS notified",
            "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 5 = 0 END AS dismissed",
            "'product ' || CAST(user_id AS STRING) AS product_name",
            "'C-' || CAST(user_id AS STRING) AS product_code",
            "CASE WHEN event_id % 12 = 0 THEN NULL ELSE 'https://shop' || CAST(user_id % 7 AS STRING) || '.example.com/offer/' || CAST(user_id AS STRING) || '?spm=1' END AS product_source_url",
        ],
    ),
    "page": ("pages", ["page_id", "url", "html"]),
    "vector": ("embeddings", ["vec_id", "CAST(CAST(floor(vec_id / 2) AS BIGINT) AS STRING) AS product_id", "'img' || CAST(vec_id AS STRING) AS image", "embedding", "label"]),
}


def logical(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, expressions = LOGICAL[name]
    return spark.read.parquet(f"{sf_dir}/{base}.parquet").selectExpr(*expressions)


def logical_sql(*names: str) -> str:
    """The same tables as common table expressions, to put before an oracle's SELECT."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(LOGICAL[n][1])} FROM {LOGICAL[n][0]})" for n in names) + " "
