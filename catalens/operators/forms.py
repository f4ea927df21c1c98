"""Request forms: required fields, payloads, and what the caller does next."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalens.config import DEFAULTS

EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
#: Longest allowed parts of a request.
LIMITS = {"name": 200, "email": 320, "phone": 50, "country": 100, "quantity": 50, "description": 5000, "link": 500, "notes": 2000}
MAX_FORM_IMAGES = 10
RETRYABLE = [408, 425, 429, 500, 502, 503, 504]


def clip(text: Column, limit: int) -> Column:
    return F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, limit)


def missing_fields(name: Column, email: Column, phone: Column) -> Column:
    """The required fields that are blank or malformed, in order."""
    mail = clip(email, LIMITS["email"])
    return F.array_compact(F.array(F.when(clip(name, LIMITS["name"]) == "", "client.name"), F.when(~mail.rlike(EMAIL), "client.email"), F.when(clip(phone, LIMITS["phone"]) == "", "client.phone")))


def form_images(urls: Column) -> Column:
    return F.slice(F.filter(urls, lambda u: u.startswith("http")), 1, MAX_FORM_IMAGES)


def cap_image_urls(urls: Column) -> Column:
    """The first addresses that are not blank."""
    return F.slice(F.filter(F.coalesce(urls, F.array().cast("array<string>")), lambda u: u.isNotNull() & (F.trim(u) != "")), 1, DEFAULTS.max_image_urls)


def first_id(body: Column) -> Column:
    """A response's identity: the first of three keys, at the top or inside ``data``."""
    keys = ["consultation_id", "request_id", "id"]
    return F.coalesce(*[F.nullif(F.get_json_object(body, f"$.{at}{k}"), F.lit("")) for at in ("", "data.") for k in keys])


def decide_action(status: Column, has_product: Column, has_suggestion: Column, has_missing: Column, sent: Column) -> Column:
    """What the caller does next: show, ask for a photo, retry, confirm, ask for data, or nothing."""
    return (
        F.when((status == "found") & has_product, "show_product")
        .when(status.isin("site_blocked", "no_image"), "ask_photo")
        .when(status == "indexing", "retry_later")
        .when(has_suggestion, "confirm_product")
        .when(has_missing, "ask_client_data")
        .when(sent, "none")
        .otherwise("none_failed")
    )


def buy_url(base: str, template: str, slug: Column, product_id: Column, code: Column) -> Column:
    """The shop's address of a product; null where the shop has no base address."""
    if not base.rstrip("/"):
        return F.lit(None).cast("string")
    path: Column = F.lit(template if template.startswith("/") else "/" + template)
    for name, value in (("slug", slug), ("id", product_id), ("code", code)):
        path = F.replace(path, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return F.concat(F.lit(base.rstrip("/")), path)


def retryable_status(status: Column) -> Column:
    return status.isin(RETRYABLE)
