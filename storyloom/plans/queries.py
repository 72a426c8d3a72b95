"""One query for each operator, over whole tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT as S
from ..functions import fingerprint as fp
from ..functions import rank as rk
from ..functions import text as tx
from ..functions import url as ux
from ..functions import vectors as vx
from ..operators import cluster, dedup, feed, normaliser, stories, upkeep
from ..operators.tables import discard, spread, written
from ..sources import adapters as ad
from ..sources import apis
from ..streaming import jobs

USER = "7"


def _joined(c: str, sep: str = " ") -> "F.Column":
    return F.array_join(c, sep)


# --- text and addresses -----------------------------------------------------------------------------------------------


def q_strip_html(spark, sf):
    t = tx.strip_html("html")
    return spread(ad.table(spark, sf, "pages")).select("page_id", F.md5(t).alias("text_md5"), F.length(t).cast("long").alias("n_chars"))


def _pages(spark, sf):
    url = ux.canonical("url")
    return ad.table(spark, sf, "pages").select("page_id", url.alias("canonical_url"), ux.url_hash(url).alias("url_hash"))


def q_canonical_url(spark, sf):
    return _pages(spark, sf)


def q_url_hash_dups(spark, sf):
    return _pages(spark, sf).groupBy("url_hash").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page")).filter("n > 1")


def q_domain_counts(spark, sf):
    return ad.table(spark, sf, "pages").select(ux.domain("url").alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def _words(spark, sf):
    w = tx.words(tx.normalise(F.concat_ws(" ", tx.strip_html("title"), tx.strip_html("body"))))
    return ad.articles(spark, sf).withColumn("words", w).withColumn("content", tx.content_words(F.col("words")))


def q_normalise_text(spark, sf):
    return ad.articles(spark, sf).select("id", F.md5(tx.normalise("body")).alias("norm_md5"))


def q_tokens(spark, sf):
    return _words(spark, sf).select(F.explode("content").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def q_token_counts(spark, sf):
    return _words(spark, sf).select("id", F.size("words").cast("long").alias("n_words"), F.size("content").cast("long").alias("n_content"))


def q_shingles(spark, sf):
    sh = tx.shingles(F.col("words"), 3)
    return _words(spark, sf).select("id", sh.alias("sh")).select("id", F.size(F.array_distinct("sh")).cast("long").alias("n_distinct"), F.md5(_joined("sh")).alias("shingles_md5"))


def q_language(spark, sf):
    return _words(spark, sf).select("id", tx.language(F.col("words")).alias("detected"))


def q_topics(spark, sf):
    return _words(spark, sf).select("id", F.array_join(tx.topics(F.col("content")), ",").alias("topics"))


def _plain_entities():
    plain = lambda c: F.replace(F.translate(c, tx.FOLD_FROM, tx.FOLD_TO), F.lit("ß"), F.lit("ss"))
    return tx.entities(plain(F.col("title")), plain(F.col("body"))).alias("entities")


def _entities(spark, sf):
    return ad.articles(spark, sf).select("id", "language", _plain_entities())


def q_entities(spark, sf):
    return _entities(spark, sf).select("id", F.size("entities").cast("long").alias("n"), F.array_join("entities", ",").alias("entities"))


def q_blocking_key(spark, sf):
    w = _words(spark, sf).select("id", "published_at", tx.language(F.col("words")).alias("l"), tx.topics(F.col("content")).alias("t"))
    key = tx.blocking_key(F.col("l"), F.col("t"), F.col("published_at"))
    return w.select("id", key.alias("blocking_key"), tx.merge_group(key).alias("merge_group"))


def q_bucket_counts(spark, sf):
    return ad.articles(spark, sf).groupBy(tx.bucket("published_at").alias("bucket"), "language").agg(F.count(F.lit(1)).alias("n"))


def q_normalised_articles(spark, sf):
    n = normaliser.normalise(ad.raw_articles(spark, sf), ad.as_of(spark, sf), family="md5")
    return n.select("id", "url_hash", "content_hash", "language", F.length("title").alias("title_chars"), F.length("summary").alias("summary_chars"), F.length("body").alias("body_chars"))


def q_json_api_parse(spark, sf):
    a = ad.articles(spark, sf)
    item = F.struct(F.col("url").alias("link"), F.col("title").alias("headline"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"), F.col("body").alias("content"), F.col("id").cast("string").alias("id"))
    responses = a.select("source_id", F.to_json(F.struct(F.array(item).alias("results"))).alias("body"))
    p = apis.parse_json_api(responses)
    return p.select(F.col("external_id").cast("long").alias("id"), "source_id", "url", "published_at", F.length("body").alias("body_chars"))


# --- duplicates -------------------------------------------------------------------------------------------------------


def q_content_hash(spark, sf):
    return ad.articles(spark, sf).select("id", "language", tx.content_hash("title", "body").alias("content_hash"))


def q_exact_dups(spark, sf):
    return ad.placed(spark, sf).filter("dup_of_id is not null").select("id", "dup_of_id", "dup_kind")


def q_syndication(spark, sf):
    p = ad.placed(spark, sf).filter("dup_kind = 'syndicated'")
    return p.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


def q_dup_by_kind(spark, sf):
    return stories.duplicates_by_kind(ad.placed(spark, sf)).withColumn("dup_kind", F.coalesce("dup_kind", F.lit("original")))


def _prints(spark, sf, family="md5", whole=False):
    a = ad.articles(spark, sf)
    return a.select("id", "source_id", "published_at", fp.simhash_udf(family, whole)("title", "body").alias("simhash"))


def q_simhash_md5(spark, sf):
    return _prints(spark, sf).select("id", fp.hex64(F.col("simhash")).alias("simhash"))


def q_simhash_blake2b(spark, sf):
    return _prints(spark, sf, "blake2b").select("id", fp.hex64(F.col("simhash")).alias("simhash"))


def q_bands(spark, sf):
    return _prints(spark, sf).select(F.posexplode(fp.band_array(F.col("simhash"))).alias("band", "value")).groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"))


def q_lsh_pairs(spark, sf):
    """Pairs of different fingerprints, each by its smallest id, and copies with the smallest id of theirs."""
    return dedup.lsh_classes(written(_prints(spark, sf, whole=True).select("id", "simhash"), "prints")).select("a", "b", F.col("distance").cast("int").alias("distance"))


def q_near_dups(spark, sf):
    return dedup.near_duplicates(_prints(spark, sf, whole=True)).select("id", "dup_of_id", F.col("distance").cast("int").alias("distance"), "dup_kind", F.round("similarity", 6).alias("similarity"))


def _minhashes(spark, sf, family="md5"):
    a = ad.articles(spark, sf)
    story = F.concat("language", F.lit("_"), F.floor(F.col("id") / 24).cast("string"))
    return a.select("id", "source_id", "published_at", story.alias("story_id"), fp.minhash_udf(family)("title", "body").alias("minhash"))


def q_minhash_md5(spark, sf):
    return _minhashes(spark, sf).select("id", F.md5(fp.minhash_hex(F.col("minhash"))).alias("minhash_md5"))


def q_minhash_blake2b(spark, sf):
    return _minhashes(spark, sf, "blake2b").select("id", fp.minhash_hex(F.col("minhash")).alias("minhash"))


def q_minhash_jaccard(spark, sf):
    m = _minhashes(spark, sf).select("id", "story_id", "minhash")
    other = m.select(F.col("id").alias("b"), F.col("story_id"), F.col("minhash").alias("mb"))
    met = m.join(other, "story_id").filter("id < b")
    return met.select(F.col("id").alias("a"), "b", F.round(fp.minhash_jaccard(F.col("minhash"), F.col("mb")), 6).alias("jaccard")).filter("jaccard > 0")


def q_within_group_dups(spark, sf):
    return dedup.within_group(_minhashes(spark, sf), "story_id").select("id", "dup_of_id", "dup_kind", "similarity")


def q_dup_roots(spark, sf):
    """Chains of near duplicates chased to their roots."""
    near = dedup.near_duplicates(_prints(spark, sf, whole=True)).select("id", "dup_of_id")
    return dedup.to_root(near)


def q_revision_fold(spark, sf):
    arrivals = ad.articles(spark, sf).select(F.concat("language", F.lit(":"), F.pmod("id", F.lit(211)).cast("string")).alias("url_hash"), "id", "fetched_at", F.md5(F.concat("source", F.floor(F.col("id") / 500).cast("string"))).alias("content_hash"))
    return upkeep.fold_revisions(arrivals).select("url_hash", "id", "revision", "replays", "first_seen", "updated_at", "content_hash")


def q_idempotent_upsert(spark, sf):
    e = ad.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    old = e.filter("event_type = 'click'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    new = e.select("user_id", "event_id")
    return upkeep.insert_ignore(old, new, ["user_id"], ["event_id"])


# --- vectors and similarity --------------------------------------------------------------------------------------------


def _term_words(spark, sf):
    return ad.articles(spark, sf).select("id", "language", tx.content_words(tx.words(tx.normalise("title"))).alias("t"), tx.content_words(tx.words(tx.normalise("body"))).alias("b"))


def _counts(spark, sf):
    return vx.term_counts(_term_words(spark, sf), "id", "t", "b")


def _size(spark, sf):
    return ad.table(spark, sf, "documents").count()


def _vectors(spark, sf):
    return vx.tfidf(_counts(spark, sf), _size(spark, sf))


def q_df(spark, sf):
    """Documents by term, counting the terms that a vector keeps."""
    return vx.document_frequencies(_vectors(spark, sf))


def q_idf(spark, sf):
    return vx.document_frequencies(_vectors(spark, sf)).select("term", F.round(vx.idf(F.col("df"), _size(spark, sf)), 6).alias("idf"))


def q_tfidf_top192(spark, sf):
    return _vectors(spark, sf).groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("w"), 6).alias("sum_w"), F.round(F.max("w"), 6).alias("max_w"))


def _story_of():
    return F.concat(F.lit("s_"), "language", F.lit("_"), F.floor(F.col("id") / 12).cast("string")).alias("story_id")


def _index(spark, sf):
    member = ad.articles(spark, sf).select("id", "language", _story_of())
    return _indexed(_vectors(spark, sf).join(member, "id"))


def _indexed(members):
    """Stand-in stories' vectors from (story_id, language, term, w): sums of their members', the heaviest terms, of unit length."""
    summed = members.groupBy("story_id", "language", "term").agg(F.round(F.sum("w"), 9).alias("w"))
    top = vx.top_terms(summed, S.index_terms, "w", "story_id")
    return vx.unit_length(top, "w", "story_id")


def q_term_index(spark, sf):
    return _index(spark, sf).groupBy("story_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("w"), 6).alias("sum_w"))


ALIKE = 0.8  # cosine from which a pair is reported


def q_cosine_pairs(spark, sf):
    """Pairs of documents of a language with a cosine of at least ALIKE; of copies the one of the smallest id."""
    d = ad.table(spark, sf, "documents")
    text = d.groupBy("lang", F.md5("text").alias("h")).agg(F.min("doc_id").alias("id")).select("id", F.col("lang").alias("language"))
    if d.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        counts = written(vx.hashed(vx.counted(_term_words(spark, sf), "id", "t", "b", "language")), "counts")
        common = written(vx.common_terms(counts), "common")
        if common.count() <= vx.VOCABULARY:
            v, rarities = vx.whole_vectors(counts, common, _size(spark, sf))
            v = written(v, "vectors")
            discard(counts, common)
            return vx.similar_wholes(v, rarities, ALIKE, ("language",), text).select("a", "b", F.round("cosine", 5).alias("cosine"))
    v = written(_vectors(spark, sf).join(text, "id"), "vectors")
    return vx.similar_pairs(v, ALIKE, ("language",)).select("a", "b", F.round("cosine", 5).alias("cosine"))


def _whole_vectors(spark, sf):
    """(id, language, terms, w): _vectors() as arrays, written once."""
    d = ad.table(spark, sf, "documents")
    if d.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        counts = written(vx.counted(_term_words(spark, sf), "id", "t", "b", "language"), "counts")
        common = written(vx.common_terms(vx.hashed(counts)), "common")
        fits = common.count() <= vx.VOCABULARY
        v = fits and written(vx.weighed(counts, common, _size(spark, sf)), "vectors")
        discard(counts, common)
        if fits:
            return v
    return written(vx.packed(_vectors(spark, sf), "id").join(ad.articles(spark, sf).select("id", "language"), "id"), "vectors")


def q_candidates(spark, sf):
    v = _whole_vectors(spark, sf).filter("language is not null and size(terms) > 0")
    # A story's vectors travel whole and are summed where they arrive.
    dealt = v.select(_story_of(), "language", "terms", "w").repartition("story_id")
    members = dealt.select("story_id", "language", F.explode(F.arrays_zip("terms", "w")).alias("x")).select("story_id", "language", F.col("x.terms").alias("term"), "x.w")
    index = written(vx.packed(_indexed(members), "story_id", "language"), "index")
    asked = v.withColumn("w", F.transform("w", lambda w: F.round(w, 9))).select("id", "language", *vx.heaviest(S.query_terms))
    c = cluster.candidate_stories(written(asked, "asked"), index)
    return c.groupBy("a").agg(F.count(F.lit(1)).alias("stories"), F.round(F.max("partial"), 5).alias("best"))


def _similar(spark, sf):
    p = written(q_cosine_pairs(spark, sf), "alike")
    ids = written(p.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    # Entities and topics come from whole texts, so only those of a pair's documents are looked at.
    x = _words(spark, sf).join(ids, "id", "left_semi").select("id", "published_at", tx.topics(F.col("content")).alias("topics"), _plain_entities())
    x = written(x, "about")
    y = x.select(F.col("id").alias("b"), F.col("entities").alias("eb"), F.col("published_at").alias("tb"), F.col("topics").alias("pb"))
    return p.join(x.withColumnRenamed("id", "a"), "a").join(y, "b").withColumn("jaccard", vx.jaccard(F.col("entities"), F.col("eb")))


def q_jaccard_entities(spark, sf):
    return _similar(spark, sf).select("a", "b", F.round("jaccard", 6).alias("jaccard")).filter("jaccard > 0")


def q_composite_similarity(spark, sf):
    return _similar(spark, sf).select("a", "b", F.round(vx.composite(F.col("cosine"), F.col("jaccard")), 6).alias("similarity"))


def q_assignment_score(spark, sf):
    score = vx.assignment(vx.composite(F.col("cosine"), F.col("jaccard")), tx.hours_between(F.col("tb"), F.col("published_at")), F.arrays_overlap("topics", "pb"))
    return _similar(spark, sf).select("a", "b", F.round(score, 5).alias("score"))


# --- clustering ---------------------------------------------------------------------------------------------------------


def _article_id():
    return F.concat(F.lit("a_"), F.lpad(F.col("id").cast("string"), 12, "0"))


def _folded(spark, sf):
    arrived = normaliser.normalise_whole(ad.raw_articles(spark, sf), F.col("fetched_at")).withColumn("id", _article_id())
    return cluster.place(arrived, "scalable")


def q_clusters(spark, sf):
    return cluster.placements(_folded(spark, sf))


def q_cluster_states(spark, sf):
    return cluster.stories(_folded(spark, sf)).select("story_id", "language", "blocking_key", "member_count", F.size("centroid").alias("terms"), "event_time", "last_activity_at", "version")


def q_merge_pass(spark, sf):
    folded = _folded(spark, sf)
    source = ad.articles(spark, sf).select(_article_id().alias("id"), "source_id")
    placed = cluster.placements(folded).filter("status = 'created'").join(source, "id")
    n = placed.groupBy("story_id").agg(F.count_distinct("source_id").alias("independent_source_count"))
    return cluster.merge_pass(cluster.stories(folded), n, ad.as_of(spark, sf)).select("story_id", "status", "merged_into_id", "member_count", "version")


# --- stories and ranking --------------------------------------------------------------------------------------------------


def _stories(spark, sf, p=None):
    """Stand-in stories with counts, title and topics; every seventh run is merged into the one before."""
    at = ad.as_of(spark, sf)
    p, src = p or ad.placed(spark, sf), ad.sources(spark, sf)
    counts = stories.recount(p, src, at)
    about = p.groupBy("story_id").agg(F.min("language").alias("language"), F.sort_array(F.first("topics")).alias("topics"))
    run = F.element_at(F.split("story_id", "_"), 3).cast("long")
    merged = F.when(run % 7 == 6, F.concat(F.lit("s_"), "language", F.lit("_"), (run - 1).cast("string")))
    return counts.join(about, "story_id").withColumn("merged_into_id", merged).withColumn("status", F.when(merged.isNotNull(), "merged").otherwise("active")).withColumn("version", F.col("article_count").cast("int"))


def q_recount(spark, sf):
    return stories.recount(ad.placed(spark, sf), ad.sources(spark, sf), ad.as_of(spark, sf)).select("story_id", "article_count", "independent_source_count", "syndicated_source_count")


def q_authority(spark, sf):
    return stories.recount(ad.placed(spark, sf), ad.sources(spark, sf), ad.as_of(spark, sf)).select("story_id", F.round("authority", 3).alias("authority"))


def q_velocity(spark, sf):
    return stories.recount(ad.placed(spark, sf), ad.sources(spark, sf), ad.as_of(spark, sf)).select("story_id", "velocity").filter("velocity > 0")


def q_representative(spark, sf):
    return stories.representatives(ad.placed(spark, sf), ad.sources(spark, sf)).select("story_id", "representative_article_id", F.md5("title").alias("title_md5"))


def q_story_sources(spark, sf):
    lists = stories.source_lists(ad.placed(spark, sf), ad.sources(spark, sf))
    return lists.select("story_id", F.array_join(F.transform("sources", lambda x: F.concat(x["name"], F.when(x["independent"], "+").otherwise("-"))), ",").alias("sources"), F.col("source_count").cast("long").alias("source_count"))


def q_story_json(spark, sf):
    at = ad.as_of(spark, sf)
    p, src = ad.placed(spark, sf), ad.sources(spark, sf)
    full = stories.with_score(_stories(spark, sf, p), at).join(stories.representatives(p, src).select("story_id", "title", "summary"), "story_id", "left")
    shown = p.withColumn("canonical_url", ux.canonical("url")).withColumn("author", F.lit(None).cast("string")).withColumn("similarity", F.when(F.col("dup_kind").isNotNull(), 1.0))
    return stories.to_json(full, stories.source_lists(p, src), stories.article_lists(shown, src))


def q_recency(spark, sf):
    at = ad.as_of(spark, sf)
    return _stories(spark, sf).select("story_id", F.round(rk.recency(at, F.col("event_time"), F.col("last_activity_at")), 6).alias("recency"))


def q_score(spark, sf):
    return stories.with_score(_stories(spark, sf), ad.as_of(spark, sf)).select("story_id", F.round("score", 6).alias("score"))


def q_rank_refresh(spark, sf):
    return stories.refresh(_stories(spark, sf), ad.as_of(spark, sf)).select("story_id", F.round("score", 6).alias("score"))


def q_relevance(spark, sf):
    a = ad.affinity(spark, sf).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("topic", "weight"))).alias("m"))
    wanted = F.array(F.lit("science"), F.lit("sport"))
    return a.select("user_id", F.round(rk.relevance(wanted, F.col("m")), 6).alias("relevance"))


def _scored(spark, sf, p=None):
    return stories.with_score(_stories(spark, sf, p), ad.as_of(spark, sf)).withColumn("score", F.round("score", 6))


def q_top_stories(spark, sf):
    top = feed.top_stories(_scored(spark, sf), ad.as_of(spark, sf), feed.Request(limit=20))
    return top.select("story_id", "score", "independent_source_count", "article_count")


def q_feed_topic(spark, sf):
    return feed.top_stories(_scored(spark, sf), ad.as_of(spark, sf), feed.Request(limit=10, topic="science", language="en", min_sources=2)).select("story_id", "score")


def _page(spark, sf, **kw):
    at = ad.as_of(spark, sf)
    req = feed.Request(user_id=USER, limit=15, **kw)
    p = ad.placed(spark, sf)
    return feed.page(_scored(spark, sf, p), ad.ledger(spark, sf, at), at, req, ad.affinity(spark, sf), p)


def q_feed_page(spark, sf):
    return _page(spark, sf, personalise=False).select("position", "story_id", "score")


def q_feed_keyset(spark, sf):
    return _page(spark, sf, personalise=False, cursor=feed.encode_cursor(0.4, "s_en_40")).select("position", "story_id", "score")


def q_feed_personalised(spark, sf):
    return _page(spark, sf).select("position", "story_id", F.round("rank_score", 6).alias("rank_score"))


def q_resurface(spark, sf):
    at = ad.as_of(spark, sf)
    led = ad.ledger(spark, sf, at).withColumn("delivered_at", F.col("delivered_at") - F.expr("INTERVAL 1 HOUR"))
    p = ad.placed(spark, sf)
    return feed.grown(_scored(spark, sf, p), p, led, USER, at).select("story_id", "independent_source_count", "seen_sources")


def q_replay(spark, sf):
    """A page stored and served again: ids and order."""
    at = ad.as_of(spark, sf)
    s = _scored(spark, sf)
    ids = s.orderBy(F.col("score").desc(), F.col("story_id").desc()).limit(10).agg(F.transform(F.sort_array(F.collect_list(F.struct("score", "story_id")), False), lambda r: r["story_id"]).alias("story_ids"))
    pages = ids.select(F.lit(USER).alias("user_id"), F.lit("c1").alias("cursor"), "story_ids", F.lit(None).cast("string").alias("next_cursor"), at.alias("created_at"))
    return feed.replay(pages, s, USER, "c1").select("position", "story_id")


def q_cursors(spark, sf):
    return _scored(spark, sf).select("story_id", feed.cursor_column(F.col("independent_source_count"), F.col("story_id")).alias("cursor"))


def q_merge_chain(spark, sf):
    s = ad.placed(spark, sf).select("story_id").distinct()
    run = F.element_at(F.split("story_id", "_"), 3).cast("long")
    up = F.when(run % 13 != 0, F.concat(F.array_join(F.slice(F.split("story_id", "_"), 1, 2), "_"), F.lit("_"), (run - 1).cast("string")))
    exists = s.select(F.col("story_id").alias("up"))
    s = s.withColumn("up", up).join(exists, "up", "left_semi").select("story_id", F.col("up").alias("merged_into_id")).unionByName(s.withColumn("up", up).join(exists, "up", "left_anti").select("story_id", F.lit(None).cast("string").alias("merged_into_id")))
    return feed.follow_merges(s)


def q_ledger_forward(spark, sf):
    at = ad.as_of(spark, sf)
    merges = _stories(spark, sf).filter("status = 'merged'").select("story_id", F.col("merged_into_id").alias("into"), F.lit(2).alias("into_version"))
    return feed.forward_deliveries(ad.ledger(spark, sf, at), merges, at).groupBy("story_id").agg(F.count(F.lit(1)).alias("users"))


# --- upkeep ---------------------------------------------------------------------------------------------------------------


def q_retention(spark, sf):
    at = ad.as_of(spark, sf) + F.expr("INTERVAL 30 DAYS") - F.expr("INTERVAL 12 HOURS")
    return upkeep.archive(_stories(spark, sf), at).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def q_expire(spark, sf):
    at = ad.as_of(spark, sf)
    return upkeep.expire(ad.ledger(spark, sf, at), "delivered_at", 10, at).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def q_stats(spark, sf):
    p = ad.placed(spark, sf)
    return stories.stats(p, _stories(spark, sf, p), ad.sources(spark, sf), ad.as_of(spark, sf))


def _polled(spark, sf):
    """Customers stand for polled sources."""
    c = ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return c.withColumn("interval", (60 + F.col("id") % 3000).cast("int")).withColumn("items", (F.col("id") % 3).cast("int")).withColumn("failures", (F.col("id") % 12).cast("int"))


def q_poll_interval(spark, sf):
    return _polled(spark, sf).select("id", apis.after_success(F.col("interval"), F.col("items")).alias("next_interval"))


def q_breaker(spark, sf):
    return _polled(spark, sf).select("id", apis.cooldown(F.col("failures")).alias("cooldown_s")).filter("cooldown_s is not null")


def q_due_sources(spark, sf):
    at = ad.as_of(spark, sf)
    p = _polled(spark, sf).withColumn("enabled", F.col("id") % 5 != 0).withColumn("next_poll_at", F.when(F.col("id") % 4 != 0, at + F.make_dt_interval(mins=(F.col("id") % 120 - 60).cast("int")))).withColumn("breaker_open_until", F.when(F.col("failures") > 9, at + F.expr("INTERVAL 1 HOUR")))
    return apis.due(p, at, 200).select("id")


def q_source_upsert(spark, sf):
    known = ad.sources(spark, sf).filter("id % 2 = 0").select("name", "reliability", F.lit(True).alias("enabled"), F.lit("rss").alias("kind"))
    pushed = ad.table(spark, sf, "documents").select("source", F.lit(None).cast("double").alias("reliability"))
    return upkeep.get_or_create_sources(known, pushed).withColumn("reliability", F.round("reliability", 6))


def q_counter_upsert(spark, sf):
    e = ad.table(spark, sf, "events")
    one, two = (e.filter(F.col("event_id") % 2 == i).groupBy(F.col("event_type").alias("term")).agg(F.count(F.lit(1)).alias("df")) for i in (0, 1))
    return upkeep.add_counts(one, two, "term", "df")


# --- streams ----------------------------------------------------------------------------------------------------------------


def _stream(spark, df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df as a stream of files, and a folder for the checkpoint, both in the shared folder."""
    import uuid

    base = (spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()).rstrip("/")
    path = f"{base}/storyloom-stream-{label}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/in")
    return jobs.read_folder(spark, f"{path}/in", df.schema), path


def q_stream_dedup(spark, sf):
    arrivals = ad.articles(spark, sf).select(F.concat("language", F.lit(":"), F.pmod("id", F.lit(211)).cast("string")).alias("url_hash"), "id", "fetched_at", F.md5(F.concat("source", F.floor(F.col("id") / 500).cast("string"))).alias("content_hash")).withColumn("id", F.col("id").cast("string"))
    # One file, as what a key's fold says depends on the order of arrival.
    stream, path = _stream(spark, arrivals.coalesce(1), "dedup")
    name = "s" + path[-32:]
    jobs.run_available(jobs.fold_by_url(stream), f"{path}/checkpoint", "append", name)
    return spark.table(name).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def q_stream_bucket_counts(spark, sf):
    e = ad.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    stream, path = _stream(spark, e, "counts")
    name = "s" + path[-32:]
    jobs.run_available(jobs.bucket_counts(stream, "ts", ["event_type"]), f"{path}/checkpoint", "complete", name)
    return spark.table(name).select(F.col("bucket_start").cast("timestamp_ntz").alias("bucket_start"), "event_type", "n")


def q_stream_upsert(spark, sf):
    """A stream of events into a versioned table, one row a user."""
    e = ad.table(spark, sf, "events").select("user_id", "event_type").withColumn("event_type", F.lit("seen")).distinct()
    stream, path = _stream(spark, e, "upsert")
    snaps = upkeep.Snapshots(spark, f"{path}/table", "user_id long, event_type string")
    for attempt in ("one", "two"):  # the second run brings everything again
        jobs.run_available(stream, f"{path}/{attempt}", sink=jobs.upsert_sink(snaps, ["user_id"]))
    return snaps.read()


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}
