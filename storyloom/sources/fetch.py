"""Fetching of feeds and APIs as a Python data source: one partition a source, politely.

spark.read.format("storyloom_feeds").option("requests", json) gives (source_id, status, etag, last_modified, body, error)
for a JSON list of {"source_id", "url", "etag", "last_modified"}. parse_feeds and parse_json_api take the bodies on;
record_polls the outcomes.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TIMEOUT_S = 15
MOST_BYTES = 20_000_000  # of one response; a longer one is an error


class TokenBucket:
    """At most `rate` requests a second for each domain, after a burst of `burst`."""

    def __init__(self, rate: float = 2.0, burst: float = 5.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.left: dict[str, tuple[float, float]] = {}

    def take(self, domain: str) -> float:
        """Wait for a turn; returns the seconds waited."""
        now = self.clock()
        tokens, since = self.left.get(domain, (self.burst, now))
        tokens = min(self.burst, tokens + (now - since) * self.rate)
        wait = max(0.0, (1 - tokens) / self.rate)
        if wait:
            self.sleep(wait)
        self.left[domain] = tokens - 1 + wait * self.rate, now + wait
        return wait


def backoff(attempt: int, least: float = 0.5, most: float = 8.0, draw: Callable[[float, float], float] = random.uniform) -> float:
    """Seconds before the next attempt: drawn up to an exponentially growing bound."""
    return draw(0.0, min(most, least * 2**attempt))


def with_retries(call: Callable, attempts: int = 3, sleep: Callable[[float], None] = time.sleep):
    """call(), again after failures of the network; the last failure is raised."""
    for attempt in range(attempts):
        try:
            return call()
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            if attempt == attempts - 1 or isinstance(e, urllib.error.HTTPError) and e.code < 500:
                raise
            sleep(backoff(attempt))


def get(url: str, etag: str | None = None, last_modified: str | None = None) -> tuple[int, str | None, str | None, str | None]:
    """(status, etag, last_modified, body) of a conditional GET; 304 has no body and keeps the validators."""
    request = urllib.request.Request(url, headers={"User-Agent": "storyloom", "Accept-Encoding": "identity"} | ({"If-None-Match": etag} if etag else {}) | ({"If-Modified-Since": last_modified} if last_modified else {}))
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT_S) as r:
            raw = r.read(MOST_BYTES + 1)
            if len(raw) > MOST_BYTES:
                raise ValueError("response too long")
            return r.status or 200, r.headers.get("ETag"), r.headers.get("Last-Modified"), raw.decode(r.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        if e.code == 304:
            return 304, etag, last_modified, None
        raise


class _Request(InputPartition):
    def __init__(self, request: dict):
        self.request = request


class FeedReader(DataSourceReader):
    def __init__(self, requests: list[dict]):
        self.requests = requests

    def partitions(self):
        return [_Request(r) for r in self.requests]

    def read(self, partition) -> Iterator[tuple]:
        if partition is None:  # nothing was asked for
            return
        r, bucket = partition.request, TokenBucket()

        def once():
            bucket.take(urlparse(r["url"]).netloc)
            return get(r["url"], r.get("etag"), r.get("last_modified"))

        try:
            yield (r["source_id"], *with_retries(once), None)
        except Exception as e:  # an outcome: the source's breaker counts it
            yield (r["source_id"], getattr(e, "code", 0), r.get("etag"), r.get("last_modified"), None, f"{type(e).__name__}: {e}"[:500])


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "storyloom_feeds"

    def schema(self) -> str:
        return "source_id long, status int, etag string, last_modified string, body string, error string"

    def reader(self, schema):
        return FeedReader(json.loads(self.options.get("requests", "[]")))


def fetch(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """Responses for due sources (id, feed_url, etag, last_modified); at most as many as apis.due lets through."""
    rows = sources.select(F.col("id").alias("source_id"), F.col("feed_url").alias("url"), "etag", "last_modified").collect()
    spark.dataSource.register(FeedSource)
    return spark.read.format("storyloom_feeds").option("requests", json.dumps([r.asDict() for r in rows])).load()


def outcomes(responses: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, ok, items, etag, last_modified) for apis.record_polls."""
    n = articles.groupBy(F.col("source_id").alias("__id")).agg(F.count(F.lit(1)).alias("items"))
    joined = responses.join(n, F.col("source_id") == F.col("__id"), "left")
    return joined.select(F.col("source_id").alias("id"), F.col("error").isNull().alias("ok"), F.coalesce("items", F.lit(0)).cast("int").alias("items"), "etag", "last_modified")
