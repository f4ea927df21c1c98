"""Price histories: previous snapshots, drift decisions, cheapest offers, retention."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalens.config import DEFAULTS, Config
from catalens.functions.pricing import price_decision, signed_drift
from catalens.sources.keyed_table import KeyedTable

ORDER = ["captured_at", "order_no", "line_no", "price_cents"]


def previous_snapshot(history: DataFrame) -> DataFrame:
    """Each snapshot with the price and currency before it for the same product and source."""
    before = Window.partitionBy("product_id", "source").orderBy(*ORDER)
    return history.withColumns({"previous_cents": F.lag("price_cents").over(before), "previous_currency": F.lag("currency").over(before)})


def decide(history: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    rows = previous_snapshot(history)
    decision = price_decision(F.col("price_cents"), F.col("currency"), F.col("previous_cents"), F.col("previous_currency"), config)
    rows = rows.withColumn("decision", decision)
    return rows.withColumn("drift", F.round(signed_drift(F.col("decision"), F.col("price_cents"), F.col("previous_cents")), 6))


def cheapest(offers: DataFrame, keys: list[str]) -> DataFrame:
    """The least positive price, its currency (ties: the first source), and how many valid offers there are, else all."""
    valid = F.col("price_cents") > 0
    least = F.min(F.when(valid, F.struct("price_cents", "source", "currency")))
    n = F.when(F.count_if(valid) > 0, F.count_if(valid)).otherwise(F.count("*"))
    return offers.groupBy(*keys).agg(least.alias("x"), n.alias("n")).select(*keys, F.col("x.price_cents").alias("price_cents"), F.col("x.currency").alias("currency"), "n")


def retain(history: DataFrame, now: Column, days: int) -> DataFrame:
    """Rows not older than ``days`` before ``now``; all of them for 0 days."""
    return history if days == 0 else history.filter(F.col("captured_at") >= now - F.make_dt_interval(F.lit(days)))


def prune(history: KeyedTable, now: datetime, days: int) -> list[int]:
    """Delete prices older than ``days`` before ``now`` (0: none) from a table in folders by month (year * 12 + month); returns the folders that changed."""
    if days == 0:
        return []
    cutoff = now - timedelta(days=days)
    return history.delete(F.col("captured_at") < F.lit(cutoff), F.col("bucket") <= cutoff.year * 12 + cutoff.month)
