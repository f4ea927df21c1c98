"""Parameters of the catalogue operators, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    dedup_url_threshold: float = 1.0
    dedup_image_threshold: float = 0.92
    dedup_text_threshold: float = 0.88
    dedup_image_text_gate: float = 0.35
    embed_match_threshold: float = 0.88
    embed_suggest_threshold: float = 0.82
    embed_name_confirm_threshold: float = 0.72
    embed_name_reject_threshold: float = 0.30
    embed_name_rescue_image_floor: float = 0.60
    embed_images_per_product: int = 2
    embed_top_k: int = 5
    name_top_k: int = 5
    max_query_images: int = 4
    price_drift_threshold: float = 0.05
    price_drift_max_auto: float = 0.30
    price_history_retention_days: int = 120
    daily_budget: int = 300
    common_df: int = 60
    max_tokens: int = 12
    max_image_urls: int = 5
    rate_limit_per_window: int = 120
    rate_limit_window_seconds: int = 60
    lockout_failures: int = 5
    lockout_seconds: int = 300


DEFAULTS = Config()
