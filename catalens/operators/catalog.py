"""Catalogue reads: mapping raw records to products, variants, pages and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def map_product(raw: DataFrame) -> DataFrame:
    """Raw records to products: empty text for missing names, the preview or else the asset as picture."""
    return raw.withColumns(
        {
            "name": F.coalesce("name", F.lit("")),
            "description": F.coalesce("description", F.lit("")),
            "enabled": F.coalesce("enabled", F.lit(True)),
            "image_url": F.coalesce("preview_url", "asset_url"),
            "image_urls": F.array_distinct(F.array_compact(F.array("preview_url", "asset_url"))),
        }
    )


def with_variants(products: DataFrame, variants: DataFrame, limit: int = 100) -> DataFrame:
    """Products with at most ``limit`` variants each, in the order of their numbers; ranks cut before gathering."""
    nth = F.row_number().over(Window.partitionBy("product_id").orderBy("variant_no", "sku", "price_cents"))
    kept = variants.withColumn("nth", nth).filter(F.col("nth") <= limit)
    lists = kept.groupBy(F.col("product_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("nth", F.col("variant_id").alias("id"), F.col("variant_name").alias("name"), "sku", "price_cents"))).alias("variants"))
    return products.join(lists, "id", "left").withColumn("variants", F.coalesce("variants", F.array()))
