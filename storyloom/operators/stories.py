"""Stories from placed articles: recount, authority, velocity, representative, sources, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import rank as rk
from ..functions import text as tx
from ..schema import HIDDEN_KINDS


def visible() -> Column:
    """Articles that tell something. Null-safe: an original has no dup_kind."""
    return ~F.coalesce("dup_kind", F.lit("")).isin(*HIDDEN_KINDS)


def _by_source(articles: DataFrame, as_of: Column, s: Settings) -> DataFrame:
    """One row for each story and source, the grain at which sources count."""
    fresh = F.col("fetched_at") >= as_of - F.expr(f"INTERVAL {s.velocity_h} HOURS")
    original = F.col("dup_kind").isNull()
    return articles.groupBy("story_id", "source_id").agg(
        F.bool_or(original).alias("independent"),
        F.bool_or(F.coalesce(F.col("dup_kind") == "syndicated", F.lit(False))).alias("syndicated"),
        F.bool_or(original & fresh).alias("fresh"),
        F.count_if(visible()).alias("visible"),
        F.min("published_at").alias("first_published"),
        F.max("fetched_at").alias("last_fetched"),
    )


def recount(articles: DataFrame, sources: DataFrame, as_of: Column, s: Settings = DEFAULT) -> DataFrame:
    """(story_id, article_count, independent_source_count, syndicated_source_count, authority, velocity, event_time,
    last_activity_at) by one aggregation over stories and sources; a source that has an original doesn't count as
    syndicated; a source without a known reliability counts s.missing_reliability."""
    grain = _by_source(articles, as_of, s).join(sources.select(F.col("id").alias("source_id"), "reliability"), "source_id", "left")
    trust = F.coalesce("reliability", F.lit(s.missing_reliability))
    only_syndicated = F.col("syndicated") & ~F.col("independent")
    return grain.groupBy("story_id").agg(
        F.sum("visible").alias("article_count"),
        F.count_if("independent").alias("independent_source_count"),
        F.count_if(only_syndicated).alias("syndicated_source_count"),
        F.round(F.sum(F.when(F.col("independent"), trust).when(only_syndicated, s.syndication * trust).otherwise(0.0)), 4).alias("authority"),
        F.count_if("fresh").cast("double").alias("velocity"),
        F.min("first_published").alias("event_time"),
        F.max("last_fetched").alias("last_activity_at"),
    )


def representatives(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(story_id, representative_article_id, title, summary): the original of the most reliable source, the earliest of
    those, the one of the smallest id of those."""
    ranked = articles.filter("dup_kind is null").join(sources.select(F.col("id").alias("source_id"), "reliability"), "source_id")
    best = ranked.groupBy("story_id").agg(F.min(F.struct((-F.col("reliability")).alias("r"), "published_at", "id", "title", "summary")).alias("best"))
    return best.select("story_id", F.col("best.id").alias("representative_article_id"), "best.title", "best.summary")


def with_score(stories: DataFrame, as_of: Column, relevance: Column | None = None, s: Settings = DEFAULT) -> DataFrame:
    """stories with `recency` and `score` at as_of; velocity is taken as it stands."""
    recency = rk.recency(as_of, F.col("event_time"), F.col("last_activity_at"), s)
    out = stories.withColumn("recency", recency)
    return out.withColumn("score", rk.score(F.col("authority"), F.col("independent_source_count"), F.col("velocity"), recency, relevance, s))


def refresh(stories: DataFrame, as_of: Column, s: Settings = DEFAULT) -> DataFrame:
    """Active stories of twice the cluster window, scored anew."""
    since = as_of - F.expr(f"INTERVAL {2 * s.cluster_window_h} HOURS")
    return with_score(stories.filter((F.col("status") == "active") & (F.col("last_activity_at") >= since)), as_of, None, s)


def source_lists(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(story_id, sources, source_count): visible sources in the order of their first article, as structs of name,
    reliability and whether that article is an original."""
    shown = articles.filter(visible()).join(sources.select(F.col("id").alias("source_id"), "name", "reliability"), "source_id")
    first = shown.groupBy("story_id", "name").agg(F.min(F.struct("published_at", "id", "reliability", F.col("dup_kind").isNull().alias("independent"))).alias("f"))
    ordered = first.groupBy("story_id").agg(F.sort_array(F.collect_list(F.struct("f.published_at", "f.id", "name", "f.reliability", "f.independent"))).alias("x"))
    listed = F.transform("x", lambda r: F.struct(r["name"].alias("name"), F.round(r["reliability"], 3).alias("reliability"), r["independent"].alias("independent")))
    return ordered.select("story_id", listed.alias("sources"), F.size("x").alias("source_count"))


def article_lists(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(story_id, articles): visible articles by time, with their relation to the story."""
    shown = articles.filter(visible()).join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("__source")), "source_id")
    fields = ["published_at", "id", "title", "canonical_url", F.col("__source").alias("source"), "author", F.coalesce("dup_kind", F.lit("original")).alias("relation"), "similarity"]
    return shown.groupBy("story_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("articles"))


def to_json(stories: DataFrame, lists: DataFrame, articles: DataFrame | None = None) -> DataFrame:
    """(story_id, payload): a story as the JSON that clients get."""
    joined = stories.join(lists, "story_id", "left")
    if articles is not None:
        joined = joined.join(articles, "story_id", "left")
    signals = F.struct(
        F.col("independent_source_count").alias("independent_sources"), F.col("syndicated_source_count").alias("syndicated_sources"),
        F.col("article_count").alias("articles"), F.round("authority", 4).alias("authority"), "velocity", F.round("recency", 4).alias("recency_multiplier"),
    )
    extra = [F.transform("articles", lambda a: a.withField("published_at", tx.iso_z(a["published_at"]))).alias("articles")] if articles is not None else []
    fields = [F.col("story_id").alias("id"), "title", "summary", "topics", "language", F.round("score", 6).alias("score"), signals.alias("signals"), tx.iso_z(F.col("event_time")).alias("event_time"), tx.iso_z(F.col("last_activity_at")).alias("last_activity_at"), "version", "sources", "source_count", *extra]
    return joined.select("story_id", F.to_json(F.struct(*fields)).alias("payload"))


def duplicates_by_kind(articles: DataFrame) -> DataFrame:
    return articles.groupBy("dup_kind").agg(F.count(F.lit(1)).alias("n"))


def stats(articles: DataFrame, stories: DataFrame, sources: DataFrame, as_of: Column, s: Settings = DEFAULT) -> DataFrame:
    """One row of counts: `articles_suppressed` as shown to operators (all duplicates), `articles_hidden` without the
    syndicated ones."""
    since = as_of - F.expr(f"INTERVAL {s.cluster_window_h} HOURS")
    a = articles.agg(F.count(F.lit(1)).alias("articles"), F.count_if(F.col("dup_kind").isNotNull()).alias("articles_suppressed"), F.count_if(~visible()).alias("articles_hidden"))
    b = stories.agg(F.count(F.lit(1)).alias("stories_total"), F.count_if((F.col("status") == "active") & (F.col("last_activity_at") >= since)).alias("stories_active"), F.count_if(F.col("status") == "merged").alias("stories_merged"))
    c = sources.agg(F.count(F.lit(1)).alias("sources"))
    return a.join(b, F.lit(True)).join(c, F.lit(True))  # each a single row
