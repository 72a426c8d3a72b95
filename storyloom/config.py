"""All thresholds in one place; every operator takes them through a Settings value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # text
    max_title: int = 600
    max_summary: int = 1000
    max_body: int = 20_000
    min_title: int = 8
    future_hours: int = 2
    # duplicates
    bands: int = 8
    hamming_max: int = 7
    dedup_window_h: int = 168
    near_dup_jaccard: float = 0.45
    check_members: int = 25
    # stories
    cluster_window_h: int = 72
    w_cosine: float = 0.70
    w_entity: float = 0.30
    assign_threshold: float = 0.30
    merge_threshold: float = 0.26
    centroid_terms: int = 192
    index_terms: int = 64
    query_terms: int = 24
    candidates: int = 60
    entity_cap: int = 96
    entity_limit: int = 40
    bucket_h: int = 48
    # ranking
    half_life_h: float = 8.0
    w_authority: float = 0.45
    w_breadth: float = 0.30
    w_velocity: float = 0.15
    w_relevance: float = 0.10
    syndication: float = 0.35
    velocity_h: int = 1
    authority_norm: float = 12.0
    breadth_norm: float = 25.0
    velocity_norm: float = 10.0
    missing_reliability: float = 0.5
    # feed and upkeep
    resurface_gain: int = 2
    resurface_ratio: float = 1.5
    page_ttl_h: int = 1
    idempotency_ttl_h: int = 24
    retention_days: int = 30
    poll_s: int = 180
    poll_max_s: int = 3600
    breaker_failures: int = 5
    breaker_cooldown_s: int = 300


DEFAULT = Settings()
