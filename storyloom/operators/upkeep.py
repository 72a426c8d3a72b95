"""Table upkeep on immutable files: inserts that ignore conflicts, upserts, revisions, retention, versioned snapshots."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """target plus those rows whose keys it lacks; of rows with equal keys the first by `order` (or all columns)."""
    rest = [c for c in target.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*(order or rest))).alias("__row")) if rest else rows.select(*keys).distinct()
    fresh = first.select(*keys, *([f"__row.{c}" for c in rest])).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def add_counts(target: DataFrame, delta: DataFrame, key: str, value: str) -> DataFrame:
    """Counters added up: what an upsert of running totals comes to."""
    return target.unionByName(delta).groupBy(key).agg(F.sum(value).alias(value))


def get_or_create_sources(registry: DataFrame, pushed: DataFrame, reliability: float = 0.6) -> DataFrame:
    """registry (name, reliability, enabled, kind) plus new names of pushed (source, reliability), not polled."""
    named = pushed.groupBy(F.col("source").alias("name")).agg(F.max("reliability").alias("reliability"))
    new = named.join(registry.select("name"), "name", "left_anti")
    return registry.unionByName(new.select("name", F.coalesce("reliability", F.lit(reliability)).alias("reliability"), F.lit(False).alias("enabled"), F.lit("push").alias("kind")))


def fold_revisions(articles: DataFrame) -> DataFrame:
    """(url_hash, id, revision, replays, first_seen, updated_at, content_hash): arrivals (id, url_hash, content_hash,
    fetched_at) folded by web address. An arrival with the content before it is a replay; any other is a revision."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("url_hash").orderBy("fetched_at", "id")
    before = articles.withColumn("__before", F.lag("content_hash").over(w)).withColumn("__n", F.row_number().over(w))
    changed = (F.col("__n") == 1) | (F.col("content_hash") != F.col("__before"))
    last = F.struct("fetched_at", "id", "content_hash")
    out = before.groupBy("url_hash").agg(F.min(F.struct("fetched_at", "id")).alias("first"), F.count_if(changed).alias("changes"), F.count(F.lit(1)).alias("n"), F.max(last).alias("last"), F.max(F.when(changed, F.col("fetched_at"))).alias("updated_at"))
    return out.select("url_hash", F.col("first.id").alias("id"), F.col("changes").alias("revision"), (F.col("n") - F.col("changes")).alias("replays"), F.col("first.fetched_at").alias("first_seen"), "updated_at", "last.content_hash")


def request_fingerprint(body: dict) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest()


def check_idempotency(stored: DataFrame, key: str, fingerprint: str) -> str | None:
    """The response stored under key, None where there is none; a key that came with another body is an error."""
    row = stored.filter(F.col("key") == key).select("request_fingerprint", "response_json").first()
    if row is None:
        return None
    if row.request_fingerprint != fingerprint:
        raise ValueError("idempotency key was used with another request")
    return row.response_json


def archive(stories: DataFrame, as_of: Column, s: Settings = DEFAULT) -> DataFrame:
    """stories with active ones that have been idle for longer than s.retention_days archived."""
    idle = (F.col("status") == "active") & (F.col("last_activity_at") < as_of - F.expr(f"INTERVAL {s.retention_days} DAYS"))
    return stories.withColumn("status", F.when(idle, "archived").otherwise(F.col("status")))


def expire(table: DataFrame, column: str, hours: int, as_of: Column) -> DataFrame:
    """Rows no older than hours: bands, pages and idempotency keys live that long."""
    return table.filter(F.col(column) >= as_of - F.expr(f"INTERVAL {hours} HOURS"))


class Snapshots:
    """A table as numbered immutable versions; the highest complete one counts, so that a rewrite swaps at once."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(self.path)
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        found = sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())
        return [v for v in found if (lambda f, q: f.exists(q))(*self._fs(f"{self.path}/v={v}/_SUCCESS"))]

    def read(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={known[-1] if version is None else version}")

    def write(self, df: DataFrame, keep: int = 2) -> int:
        """A new version; versions before the last `keep` are deleted."""
        known = self.versions()
        version = (known[-1] if known else 0) + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        for v in [*known, version][:-keep]:
            fs, p = self._fs(f"{self.path}/v={v}")
            fs.delete(p, True)
        return version
