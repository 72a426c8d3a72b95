"""The parquet tables as the engine's tables: documents as articles, events as deliveries and affinities."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.lexicon import TOPICS
from ..operators import dedup
from ..operators.tables import spread, written

EPOCH = datetime(2024, 1, 1)
STEP_S = 97  # between two documents
STORY_RUN = 12  # documents in a row that make a stand-in story


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of(spark: SparkSession, sf_dir: str) -> Column:
    """An hour after the last document was published."""
    last = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] or 0
    return F.lit(EPOCH + timedelta(seconds=STEP_S * last, hours=1)).cast("timestamp_ntz")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"))
    when = F.expr(f"TIMESTAMP_NTZ '{EPOCH:%Y-%m-%d}' + make_dt_interval(0, 0, 0, doc_id * {STEP_S})")
    url = F.concat(F.lit("https://www."), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    return d.select(
        F.col("doc_id").alias("id"), F.substring("source", 4, 9).cast("long").alias("source_id"), "source", F.col("lang").alias("language"), url.alias("url"),
        F.substring(F.split("text", "\n")[0], 1, 600).alias("title"), F.col("text").alias("body"), when.alias("published_at"), when.alias("fetched_at"),
    )


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return articles(spark, sf_dir).select("id", "source_id", "url", "title", "body", none.alias("summary"), none.alias("author"), "published_at", F.col("id").cast("string").alias("external_id"), none.alias("image_url"), "fetched_at")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source").distinct().select(F.substring("source", 4, 9).cast("long").alias("id"), F.col("source").alias("name")).withColumn("reliability", 0.35 + 0.03 * F.col("id"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles without their bodies, with content hash, duplicate kind and a stand-in story: runs of STORY_RUN originals
    of a language. Texts are read and hashed once."""
    a = articles(spark, sf_dir).withColumn("content_hash", tx.content_hash("title", "body")).withColumn("summary", F.substring("body", 1, 400)).drop("body")
    a = dedup.exact_content(written(a, "hashed"))
    run = F.floor(F.coalesce("dup_of_id", "id") / STORY_RUN).cast("long")
    names = F.array(*map(F.lit, TOPICS))
    return a.withColumn("story_id", F.concat(F.lit("s_"), "language", F.lit("_"), run.cast("string"))).withColumn("topics", F.array(F.element_at(names, (F.pmod(run, F.lit(len(TOPICS))) + 1).cast("int"))))


def ledger(spark: SparkSession, sf_dir: str, at: Column) -> DataFrame:
    """Deliveries: an event stands for a story that its user got, up to 20 hours ago."""
    e = table(spark, sf_dir, "events")
    lang = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.pmod("user_id", F.lit(4)) + 1).cast("int"))
    story = F.concat(F.lit("s_"), lang, F.lit("_"), F.pmod("event_id", F.lit(83)).cast("string"))
    ago = F.make_dt_interval(hours=F.pmod("event_id", F.lit(20)).cast("int"))
    return e.select(F.col("user_id").cast("string").alias("user_id"), story.alias("story_id"), F.lit(1).alias("story_version"), (at - ago).alias("delivered_at")).groupBy("user_id", "story_id").agg(F.min("story_version").alias("story_version"), F.min("delivered_at").alias("delivered_at"))


def affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights: events of a user by a stand-in topic, twenty being the most."""
    names = F.array(*map(F.lit, TOPICS))
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user_id"), F.element_at(names, (F.pmod("event_id", F.lit(len(TOPICS))) + 1).cast("int")).alias("topic"))
    return e.groupBy("user_id", "topic").agg(F.least(F.lit(1.0), F.count(F.lit(1)) / 20.0).alias("weight"))
