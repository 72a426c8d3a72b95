"""Structured Streaming around the same functions as batches: normalisation, duplicates, counts, sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..operators import normaliser, upkeep


def read_topic(spark: SparkSession, servers: str, topic: str, schema: str, most_per_trigger: int = 100_000) -> DataFrame:
    """Records of a topic as columns (needs the Kafka connector on the class path)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", most_per_trigger).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")


def write_topic(df: DataFrame, servers: str, topic: str, key: str, checkpoint: str):
    """Start writing a stream's rows, as JSON, to a topic under a key (needs the Kafka connector on the class path)."""
    record = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "checkpointLocation": checkpoint, "kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.compression.type": "lz4"}
    return record.writeStream.format("kafka").options(**options).start()


def watched(articles: DataFrame, name: str = "storyloom") -> DataFrame:
    """articles with counters that listeners get with each batch: rows, duplicates by whether they hide, lag in seconds."""
    hidden = F.col("dup_kind").isin("exact_url", "exact_content", "near_dup")
    lag = F.unix_seconds(F.col("fetched_at").cast("timestamp")) - F.unix_seconds(F.col("published_at").cast("timestamp"))
    return articles.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(hidden).alias("hidden"), F.count_if(F.col("dup_kind") == "syndicated").alias("syndicated"), F.max(lag).alias("lag_s"))


def read_folder(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def normalise(raw: DataFrame, family: str = "blake2b", s: Settings = DEFAULT) -> DataFrame:
    """normaliser.normalise on a stream; the future is what lies ahead of the row's own arrival."""
    return normaliser.normalise(raw, F.col("fetched_at"), family, False, s)


def bucket_counts(events: DataFrame, ts: str, keys: list[str], hours: int = DEFAULT.bucket_h, late: str = "72 hours") -> DataFrame:
    """Counts by keys and span of time, with a watermark that lets late rows in."""
    span = F.window(ts, f"{hours} hours")
    return events.withWatermark(ts, late).groupBy(span.alias("span"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("span.start").alias("bucket_start"), *keys, "n")


def _fold_key(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """First content and number of arrivals of a key: a replay, a revision or a first sight."""
    content, revision = state.get if state.exists else (None, 0)
    rows = pd.concat(list(frames)).sort_values(["fetched_at", "id"], kind="stable")
    out = []
    for r in rows.itertuples(index=False):
        status = "created" if content is None else "duplicate" if content == r.content_hash else "updated"
        revision += status != "duplicate"
        content = r.content_hash
        out.append((r.id, key[0], status, revision))
    state.update((content, revision))
    yield pd.DataFrame(out, columns=["id", "url_hash", "status", "revision"])


def fold_by_url(articles: DataFrame) -> DataFrame:
    """(id, url_hash, status, revision) for arrivals (id, url_hash, content_hash, fetched_at): state for each address
    without an end, as addresses stay known for ever."""
    rows = articles.select("id", "url_hash", "content_hash", "fetched_at")
    return rows.groupBy("url_hash").applyInPandasWithState(_fold_key, "id string, url_hash string, status string, revision int", "content string, revision int", "append", "NoTimeout")


def upsert_sink(snapshots: upkeep.Snapshots, keys: list[str]):
    """A foreachBatch function that inserts rows with new keys; a batch that comes again adds nothing."""

    def write(batch: DataFrame, _batch_id: int) -> None:
        snapshots.write(upkeep.insert_ignore(snapshots.read(), batch, keys))

    return write


def run_available(df: DataFrame, checkpoint: str, mode: str = "append", name: str | None = None, sink=None):
    """Run a stream over all that is there, into a memory table or a foreachBatch function, and wait."""
    w = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint)
    q = (w.foreachBatch(sink) if sink else w.format("memory").queryName(name)).start()
    q.awaitTermination()
    return q
