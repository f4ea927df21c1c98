"""Catalogue audits: rules over products and variants, as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quality_issues() -> Column:
    """The issues of a product, in order, as an array."""
    name = F.coalesce("name", F.lit(""))
    rules = [
        F.when(F.col("image_url").isNull() | (F.col("image_url") == ""), "no image"),
        F.when(F.col("price_cents") == 0, "price = 0"),
        F.when(F.col("price_cents").isNull() & (F.col("variant_count") == 0), "no variants"),
        F.when(F.length(F.trim(name)) < 3, "name empty or very short"),
        F.when(F.col("source_url").isNull() | (F.col("source_url") == ""), "no supplier link"),
    ]
    return F.array_compact(F.array(*rules))


def audit_quality(products: DataFrame, log: DataFrame) -> DataFrame:
    """One event for each enabled product with issues that has none logged yet."""
    logged = log.filter("action = 'quality_issue_found'").select(F.col("product_id").alias("id")).distinct()
    flagged = products.filter("enabled").withColumn("issues", quality_issues()).filter(F.size("issues") > 0)
    detail = F.concat(F.lit("Problems: "), F.array_join("issues", ", "))
    return flagged.join(logged, "id", "left_anti").select("id", "name", F.substring(detail, 1, 500).alias("detail"))


def audit_variant_prefix(products: DataFrame, variants: DataFrame, prefix: str = "PA", shown: int = 5) -> DataFrame:
    """Enabled products with variants whose trimmed name begins with ``prefix``: how many, and the first by number.

    Variants are filtered before they are grouped; of each product only the first ``shown`` names are gathered.
    """
    from pyspark.sql.window import Window

    hit = variants.filter(F.upper(F.trim("variant_name")).startswith(prefix))
    numbered = hit.withColumn("nth", F.row_number().over(Window.partitionBy("product_id").orderBy("variant_no", "sku")))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= shown, F.struct("nth", "variant_name")))), lambda x: x["variant_name"]), ", ")
    found = numbered.groupBy(F.col("product_id").alias("id")).agg(F.count("*").alias("n"), names.alias("names"))
    more = F.when(F.col("n") > shown, F.concat(F.lit(" (and "), (F.col("n") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    detail = F.concat(F.col("n").cast("string"), F.lit(f" variant(s) named {prefix}: "), "names", more)
    return products.filter("enabled").join(found, "id").select("id", "n", F.substring(detail, 1, 500).alias("detail"))


def audit_prefix_no_image(products: DataFrame, log: DataFrame, prefix: str = "BX") -> DataFrame:
    logged = log.filter("action = 'bx_no_image_flagged'").select(F.col("product_id").alias("id")).distinct()
    hit = products.filter(F.col("enabled") & F.upper(F.trim("name")).startswith(prefix) & F.col("image_url").isNull())
    return hit.join(logged, "id", "left_anti").select("id", F.concat(F.lit("Name '"), F.trim("name"), F.lit("' has no picture")).alias("detail"))
