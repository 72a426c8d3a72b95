"""Schemas of the records and tables."""

from __future__ import annotations

RAW_ARTICLE = "source_id long, url string, title string, body string, summary string, author string, published_at timestamp_ntz, external_id string, image_url string"
PUSH_INPUT = "source string, url string, title string, body string, summary string, author string, published_at string, external_id string, image_url string, reliability double"
SOURCE = "id long, name string, domain string, feed_url string, kind string, reliability double, language string, enabled boolean, poll_interval_s int, etag string, last_modified string, last_polled_at timestamp_ntz, next_poll_at timestamp_ntz, consecutive_failures int, breaker_open_until timestamp_ntz, created_at timestamp_ntz"
ARTICLE = "id string, source_id long, external_id string, url string, canonical_url string, url_hash string, title string, summary string, body string, author string, language string, image_url string, topics array<string>, entities array<string>, content_hash string, simhash long, minhash array<long>, blocking_key string, published_at timestamp_ntz, fetched_at timestamp_ntz"
PLACED = "id string, status string, reason string, story_id string, dup_of_id string, dup_kind string, similarity double, revision int"
STORY = "id string, language string, blocking_key string, seed_article_id string, centroid map<string,double>, entity_counts map<string,int>, member_count int, topics array<string>, first_seen_at timestamp_ntz, last_activity_at timestamp_ntz, event_time timestamp_ntz, status string, merged_into_id string, version int"
DELIVERY = "user_id string, story_id string, story_version int, delivered_at timestamp_ntz"
PAGE = "user_id string, cursor string, story_ids array<string>, next_cursor string, created_at timestamp_ntz"
AFFINITY = "user_id string, topic string, weight double"
IDEMPOTENCY = "key string, request_fingerprint string, response_json string, created_at timestamp_ntz"

HIDDEN_KINDS = ("exact_url", "exact_content", "near_dup")  # duplicates that tell nothing new
