"""Price functions: cents, drift decisions, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalens.config import DEFAULTS, Config


def price_cents(price: Column) -> Column:
    """Whole cents, halves to even."""
    return F.bround(price * 100).cast("long")


def drift(current: Column, previous: Column) -> Column:
    return (current - previous) / previous


def price_decision(current: Column, currency: Column, previous: Column, previous_currency: Column, config: Config = DEFAULTS) -> Column:
    change = F.abs(drift(current, previous))
    return (
        F.when(previous.isNull(), "first_observation")
        .when((F.coalesce(previous_currency, F.lit("")) != "") & (previous_currency != currency), "skip_currency")
        .when(previous <= 0, "alert_critical")
        .when(change < config.price_drift_threshold, "ok")
        .when(change > config.price_drift_max_auto, "alert_critical")
        .otherwise("alert")
    )


def signed_drift(decision: Column, current: Column, previous: Column) -> Column:
    return F.when(decision.isin("ok", "alert") | ((decision == "alert_critical") & (previous > 0)), drift(current, previous)).otherwise(0.0)


def alert_text(decision: Column, product: Column, name: Column, previous: Column, current: Column) -> Column:
    mark = F.when(decision == "alert_critical", "[!!]").otherwise("[!]")
    return F.format_string("%s %s %s: %.2f -> %.2f (%+.1f%%)", mark, product, F.substring(name, 1, 50), previous / 100, current / 100, drift(current, previous) * 100)


def fmt_price(cents: Column, currency: Column) -> Column:
    return F.when(cents.isNull(), "-").otherwise(F.concat(F.format_string("%.2f", cents / 100), F.lit(" "), F.coalesce(currency, F.lit(""))))


def fmt_time(at: Column, now: Column) -> Column:
    """now, minutes, hours, or the date; times ahead of now count by their distance."""
    minutes = F.floor(F.abs(F.unix_timestamp(now) - F.unix_timestamp(at)) / 60)
    return F.when(minutes < 1, "now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h"))).otherwise(F.date_format(at, "yyyy-MM-dd"))
