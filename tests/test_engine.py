"""Operators end to end: the demonstration corpus, duplicates, feeds, upkeep, sources, streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from storyloom import schema
from storyloom.config import Settings
from storyloom.operators import cluster, dedup, feed, normaliser, stories, tables, upkeep
from storyloom.sources import apis
from storyloom.streaming import jobs

from .demo import AS_OF, SOURCES, raw_articles



@pytest.fixture(autouse=True, scope="module")
def _now(spark):
    global NOW  # an expression needs a session
    NOW = F.lit(AS_OF).cast("timestamp_ntz")


@pytest.fixture(scope="module")
def demo(spark, _now):
    """Placed articles, stories after the merge pass, and sources of the demonstration corpus."""
    raw = spark.createDataFrame(raw_articles(), schema.RAW_ARTICLE + ", id string, fetched_at timestamp_ntz")
    arrived = normaliser.normalise(raw, NOW, exact=True).cache()
    folded = cluster.place(arrived, "exact").cache()
    placed = cluster.placements(folded)
    src = spark.createDataFrame([(i, n, r) for i, (n, r) in enumerate(SOURCES)], "id long, name string, reliability double")
    stored = arrived.join(placed.filter("status <> 'rejected' and coalesce(dup_kind, '') <> 'exact_url'").select("id", "story_id", "dup_of_id", "dup_kind", "similarity"), "id")
    first = stories.recount(stored, src, NOW)
    states = cluster.merge_pass(cluster.stories(folded), first, NOW).cache()
    into = feed.follow_merges(states)
    return placed, stored, first, states, stored.join(into, "story_id").drop("story_id").withColumnRenamed("final_id", "story_id"), src


def test_demo_placements(demo):
    placed, stored, first, states, *_ = demo
    kinds = {r.dup_kind: r["count"] for r in placed.groupBy("dup_kind").count().collect()}
    assert kinds == {None: 18, "exact_url": 2, "syndicated": 2} and stored.count() == 20
    assert sorted(r.independent_source_count for r in first.collect()) == [1, 2, 2, 3, 4, 6]
    assert {r.status: r["count"] for r in states.groupBy("status").count().collect()} == {"active": 5, "merged": 1}


def test_demo_ranking(demo):
    *_, states, stored, src = demo
    counts = stories.recount(stored, src, NOW).withColumn("last_activity_at", NOW)
    got = stories.with_score(counts, NOW).orderBy(F.col("score").desc()).collect()
    want = [(0.5671, 6, 0, 4.58, 0.941), (0.5106, 5, 0, 4.51, 0.886), (0.2864, 2, 2, 2.465, 0.738), (0.1895, 3, 0, 2.68, 0.428), (0.0566, 2, 0, 1.78, 0.162)]
    assert [(round(r.score, 4), r.independent_source_count, r.syndicated_source_count, r.authority, round(r.recency, 3)) for r in got] == want
    titles = stories.representatives(stored, src).join(counts, "story_id").orderBy(F.col("authority").desc()).collect()
    assert titles[0].title.startswith("Chipmaker launches AI accelerator") and titles[1].title.startswith("Federal Reserve holds interest rates")


def test_scalable_mode_keeps_the_stories(spark, demo):
    raw = spark.createDataFrame(raw_articles(), schema.RAW_ARTICLE + ", id string, fetched_at timestamp_ntz")
    folded = cluster.place(normaliser.normalise(raw, NOW, exact=True), "scalable")
    assert cluster.placements(folded).count() == 22 and cluster.stories(folded).count() == 6


def test_plans_of_scalable_mode_do_not_grow_with_spans(spark, demo):
    raw = spark.createDataFrame(raw_articles(), schema.RAW_ARTICLE + ", id string, fetched_at timestamp_ntz")
    arrived = normaliser.normalise(raw, NOW).cache()
    tables = []
    for days in (0, 3):
        later = F.make_dt_interval(F.pmod(F.crc32("id"), F.lit(5)).cast("int") * days)
        folded = cluster.place(arrived.withColumn("fetched_at", F.col("fetched_at") + later), "scalable")
        assert cluster.placements(folded).count() == 22
        tables.append(folded._jdf.queryExecution().analyzed().toString().count("Relation ["))
    assert 0 < tables[0] == tables[1]


def test_normaliser_rejects_and_clamps(spark):
    rows = [(1, "https://a.com/1", "Short", "b", None, None, None, None, None), (1, " ", "A title long enough", "b", None, None, None, None, None), (1, "a.com/2", "A title <b>long</b> enough", "", "From the summary", None, AS_OF + timedelta(hours=3), None, None), (1, "a.com/3", "A title long enough", "x" * 30_000, "", None, AS_OF + timedelta(hours=1), None, None)]
    got = normaliser.normalise(spark.createDataFrame(rows, schema.RAW_ARTICLE), NOW).orderBy("url").collect()
    assert [r.canonical_url for r in got] == ["https://a.com/2", "https://a.com/3"]
    assert got[0].body == "From the summary" and got[0].published_at == AS_OF and got[0].title == "A title long enough"
    assert len(got[1].body) == 20_000 and len(got[1].summary) == 400 and got[1].published_at == AS_OF + timedelta(hours=1)


def test_lsh_pairs_are_complete(spark):
    import random

    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 10))) for b in base for _ in range(4)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = {(i, j, d) for j in range(len(values)) for i in range(j) if (d := (values[i] ^ values[j]).bit_count()) <= 7}
    got = dedup.lsh_pairs(spark.createDataFrame(list(enumerate(signed)), "id long, simhash long")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_tables_are_written_in_short_batches(spark):
    sizes = F.pandas_udf(lambda x: x * 0 + len(x), "long")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    got = tables.written(spark.range(0, 5000, 1, 1).select(sizes("id").alias("n")), "batches").agg(F.max("n"), F.count("n")).first()
    assert tuple(got) == (tables.BATCH, 5000) and spark.conf.get(key) == before


@pytest.mark.parametrize("stories_a_task, repeated", [(1 << 16, False), (7, False), (7, True)])
def test_candidate_stories_are_those_of_all_pairs_and_no_row_is_made_of_a_pair(spark, monkeypatch, stories_a_task, repeated):
    import random

    monkeypatch.setattr(cluster, "STORIES", stories_a_task)
    monkeypatch.setattr(cluster, "QUERIES", 5)
    rng = random.Random(4)
    some = lambda n: {t: rng.choice((0.25, 0.5, 0.75)) for t in rng.sample([f"w{i}" for i in range(30)], n)}  # many ties
    asked = [(i, "fr" if i % 5 == 0 else "en", some(rng.randint(1, 4))) for i in range(60)] + [(90, "de", some(3)), (91, "en", {"alone": 1.0}), (92, None, some(3))]
    asked += [(0, "fr", some(2)), (1, "fr", some(2)), (7, "en", asked[7][2])] if repeated else []
    kept = [(f"s_{i}", "fr" if i % 4 == 0 else "en", some(rng.randint(1, 5))) for i in range(50)] + [("s_es", "es", some(4)), ("s_none", None, some(4))]
    frame = lambda rows, name: spark.createDataFrame([(*r[:2], list(r[2]), list(r[2].values())) for r in rows], f"{name}, language string, terms array<string>, w array<double>")
    sums = {}
    for i, x, q in asked:
        for name, y, v in kept:
            if x is not None and x == y and q.keys() & v.keys():
                sums.setdefault(i, {}).setdefault(name, 0.0)
                sums[i][name] += sum(q[t] * v[t] for t in q.keys() & v.keys())
    want = sorted((i, name, round(p, 9)) for i, all_ in sums.items() for name, p in sorted(all_.items(), key=lambda e: (-round(e[1], 9), e[0]))[:6])
    got = cluster.candidate_stories(frame(asked, "id long"), frame(kept, "story_id string"), Settings(candidates=6))
    assert len(want) > 200 and sorted((r.a, r.story_id, round(r.partial, 9)) for r in got.collect()) == want
    assert "term#" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("agree", [1, 2, 3])
def test_near_fingerprints_meet_without_a_broadcast(spark, monkeypatch, agree):
    import random

    monkeypatch.setattr(dedup, "AGREE", ((None, agree),))
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 9))) for b in base for _ in range(4)]
    rows = [(i, i % 3, AS_OF + timedelta(hours=7 * i), v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    classes, near = dedup.lsh_classes(spark.createDataFrame([(r[0], r[3]) for r in rows], "id long, simhash long")), dedup.near_duplicates(spark.createDataFrame(rows, "id long, source_id long, published_at timestamp_ntz, simhash long"))
    # A key's rows are a hundred times those of its table, which a plan's estimate does not see.
    assert "BroadcastExchange" not in near._jdf.queryExecution().executedPlan().toString()
    first = {v: i for i, v in reversed(list(enumerate(values)))}
    want = sorted((first[v], i, 0) for i, v in enumerate(values) if first[v] != i)
    want += sorted((i, j, d) for j in first.values() for i in first.values() if i < j and (d := (values[i] ^ values[j]).bit_count()) <= 7)
    assert sorted(tuple(r) for r in classes.collect()) == sorted(want)
    heads = {}  # the chain of each value: its rows within a week after one before
    for i, v in enumerate(values):
        runs = heads.setdefault(v, [])
        if runs and 7 * (i - runs[-1][-1]) <= 168:
            runs[-1].append(i)
        else:
            runs.append([i])
    chains = [(r[0], r[-1], v) for v, runs in heads.items() for r in runs]
    told = {i: (r[0], 0) for runs in heads.values() for r in runs for i in r[1:]}
    for i, _, v in chains:
        met = [(d, j) for j, last, w in chains if w != v and j < i and 7 * (i - last) <= 168 and (d := (v ^ w).bit_count()) <= 7]
        if met:
            told[i] = min(met)[::-1]
    assert {r.id: (r.dup_of_id, r.distance) for r in near.collect()} == told


def _stories(spark, n=12):
    rows = [(f"s_{i:02}", "active" if i != 5 else "archived", "en" if i % 2 else "fr", ["science" if i % 3 == 0 else "sport"], i % 4 + 1, round(0.9 - (i // 2) / 20, 6), AS_OF - timedelta(hours=i), 1, None) for i in range(n)]
    return spark.createDataFrame(rows, "story_id string, status string, language string, topics array<string>, independent_source_count int, score double, last_activity_at timestamp_ntz, version int, merged_into_id string")


def test_feed_never_repeats_and_replays(spark):
    s = _stories(spark)
    ledger, pages = spark.createDataFrame([], schema.DELIVERY), spark.createDataFrame([], schema.PAGE)
    seen, cursor = [], None
    for _ in range(5):
        req = feed.Request(user_id="u", limit=4, cursor=cursor)
        page = feed.page(s, ledger, NOW, req).cache()
        ids = [r.story_id for r in page.orderBy("position").collect()]
        if cursor:
            before = (cursor, ids)
        seen += ids
        ledger, pages, cursor = feed.commit(page, ledger, pages, NOW, req)
        if cursor is None:
            break
    assert len(seen) == len(set(seen)) == 11 and "s_05" not in seen
    again = feed.replay(pages, s, "u", before[0]).collect()
    assert [r.story_id for r in again] == before[1] and [r.position for r in again] == list(range(1, len(again) + 1))
    assert feed.page(s, ledger, NOW, feed.Request(user_id="u")).count() == 0
    assert feed.page(s, ledger, NOW, feed.Request(user_id="v")).count() == 11
    assert feed.page(s, ledger, NOW, feed.Request(user_id="v", topic="science", language="fr", min_sources=3)).count() == 1
    led, pg = feed.reset_user(ledger, pages, "u")
    assert led.count() == pg.count() == 0


def test_cursors():
    assert feed.decode_cursor(feed.encode_cursor(0.123456789, "s_1")) == (0.12345679, "s_1") and "=" not in feed.encode_cursor(0.1, "s")
    assert feed.decode_cursor("!") is None and feed.decode_cursor("") is None and feed.decode_cursor(None) is None


def test_personal_order_and_affinity(spark):
    s, none = _stories(spark), spark.createDataFrame([], schema.DELIVERY)
    mine = feed.set_affinity(spark.createDataFrame([("u", "old", 0.5), ("v", "sport", 1.0)], schema.AFFINITY), "u", spark.createDataFrame([("science", 7.0), ("x", -1.0)], "topic string, weight double"))
    assert sorted((r.user_id, r.topic, r.weight) for r in mine.collect()) == [("u", "science", 1.0), ("u", "x", 0.0), ("v", "sport", 1.0)]
    got = feed.page(s, none, NOW, feed.Request(user_id="u", limit=6), mine).orderBy("position").collect()
    assert all(r.rank_score == pytest.approx(r.score + (0.1 if r.topics == ["science"] else 0)) for r in got)
    assert got[0].topics == ["science"] and [r.rank_score for r in got] == sorted((r.rank_score for r in got), reverse=True)


def test_resurfacing(spark):
    s = _stories(spark, 2).withColumn("independent_source_count", F.lit(5))
    arts = spark.createDataFrame([("s_00", i, None, AS_OF - timedelta(hours=4 - i)) for i in range(5)] + [("s_01", i, None, AS_OF - timedelta(hours=9)) for i in range(4)], "story_id string, source_id long, dup_kind string, fetched_at timestamp_ntz")
    ledger = spark.createDataFrame([("u", f"s_0{i}", 1, AS_OF - timedelta(hours=2, minutes=30)) for i in range(2)], schema.DELIVERY)
    got = feed.grown(s, arts, ledger, "u", NOW).collect()
    assert [(r.story_id, r.seen_sources) for r in got] == [("s_00", 2)]
    req = feed.Request(user_id="u", resurface=True)
    page = feed.page(s, ledger, NOW, req, None, arts)
    after, _, _ = feed.commit(page, ledger, spark.createDataFrame([], schema.PAGE), NOW, req)
    assert [r.is_update for r in page.collect()] == [True] and {r.story_id: r.delivered_at for r in after.collect()}["s_00"] == AS_OF


def test_merge_chains_and_forwarding(spark):
    rows = [(f"s{i}", f"s{i - 1}" if i else None) for i in range(15)]
    got = {r.story_id: r.final_id for r in feed.follow_merges(spark.createDataFrame(rows, "story_id string, merged_into_id string")).collect()}
    assert all(got[f"s{i}"] == f"s{max(0, i - 10)}" for i in range(15))
    ledger = spark.createDataFrame([("u", "a", 1, AS_OF), ("u", "b", 1, AS_OF), ("v", "b", 1, AS_OF)], schema.DELIVERY)
    merged = feed.forward_deliveries(ledger, spark.createDataFrame([("b", "a", 3)], "story_id string, into string, into_version int"), NOW)
    assert sorted((r.user_id, r.story_id, r.story_version) for r in merged.collect()) == [("u", "a", 1), ("u", "b", 1), ("v", "a", 3), ("v", "b", 1)]


def test_recount_counts_each_source_once(spark, demo):
    src = demo[-1]
    rows = [("s", 0, None), ("s", 0, "syndicated"), ("s", 1, "syndicated"), ("s", 2, "near_dup"), ("s", 77, None)]
    arts = spark.createDataFrame([(*r, AS_OF, AS_OF - timedelta(minutes=5 * i)) for i, r in enumerate(rows)], "story_id string, source_id long, dup_kind string, published_at timestamp_ntz, fetched_at timestamp_ntz")
    r = stories.recount(arts, src, NOW).first()
    assert (r.article_count, r.independent_source_count, r.syndicated_source_count, r.velocity) == (4, 2, 1, 2.0) and r.authority == pytest.approx(0.95 + 0.5 + 0.35 * 0.94)


def test_story_json(demo):
    *_, stored, src = demo
    counts = stories.with_score(stories.recount(stored, src, NOW), NOW).withColumn("topics", F.array(F.lit("x"))).withColumn("language", F.lit("en")).withColumn("version", F.lit(1))
    full = counts.join(stories.representatives(stored, src), "story_id")
    got = [json.loads(r.payload) for r in stories.to_json(full, stories.source_lists(stored, src), stories.article_lists(stored, src)).collect()]
    quake = next(g for g in got if g["title"].startswith("Magnitude"))
    assert [s["name"] for s in quake["sources"]] == ["reuters.com", "aljazeera.com", "theguardian.com", "bbc.co.uk"] and quake["source_count"] == 4
    assert [a["relation"] for a in quake["articles"]] == ["original", "syndicated", "syndicated", "original"] and quake["signals"]["syndicated_sources"] == 2


def test_upserts_and_idempotency(spark, tmp_path):
    t = spark.createDataFrame([("a", 1)], "k string, v int")
    got = upkeep.insert_ignore(t, spark.createDataFrame([("a", 9), ("b", 3), ("b", 2)], "k string, v int"), ["k"])
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 2)]
    assert upkeep.request_fingerprint({"b": 1, "a": 2}) == upkeep.request_fingerprint({"a": 2, "b": 1})
    stored = spark.createDataFrame([("k", "f", "{}", AS_OF)], schema.IDEMPOTENCY)
    assert upkeep.check_idempotency(stored, "k", "f") == "{}" and upkeep.check_idempotency(stored, "z", "f") is None
    with pytest.raises(ValueError):
        upkeep.check_idempotency(stored, "k", "g")
    snaps = upkeep.Snapshots(spark, str(tmp_path / "t"), "k string, v int")
    assert snaps.read().count() == 0 and [snaps.write(t), snaps.write(got), snaps.write(got)] == [1, 2, 3] and snaps.versions() == [2, 3] and snaps.read().count() == 2


def test_revisions_fold(spark):
    rows = [("u", i, AS_OF + timedelta(minutes=i), c) for i, c in enumerate("aabba")]
    r = upkeep.fold_revisions(spark.createDataFrame(rows, "url_hash string, id long, fetched_at timestamp_ntz, content_hash string")).first()
    assert (r.id, r.revision, r.replays, r.content_hash, r.updated_at) == (0, 3, 2, "a", AS_OF + timedelta(minutes=4))


def test_revision_keeps_the_story(spark):
    raws = raw_articles()[:3]
    changed = list(raws[0])
    changed[3] += " Corrected."
    changed[-2:] = "a_99", changed[-1] + timedelta(hours=1)
    raw = spark.createDataFrame([*raws, tuple(changed)], schema.RAW_ARTICLE + ", id string, fetched_at timestamp_ntz")
    by = {r.id: r for r in cluster.placements(cluster.place(normaliser.normalise(raw, NOW), "exact")).collect()}
    assert by["a_99"].status == "updated" and by["a_99"].revision == 2 and by["a_99"].story_id == by["a_00"].story_id


JSON = json.dumps({"results": [{"link": "https://a.com/x", "headline": "A <b>head</b>", "published_at": "2026-01-10T12:00:00Z", "body": "<p>Body &amp; soul</p>", "id": "7", "image": "i.png"}, {"title": "no link"}]})
RSS = """<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:media="http://search.yahoo.com/mrss/"><channel><title>c</title>
<item><title>One &amp; two</title><link>https://a.com/1</link><guid>g1</guid><pubDate>Sat, 10 Jan 2026 12:00:00 +0200</pubDate><description>&lt;p&gt;Short&lt;/p&gt;</description><content:encoded>&lt;p&gt;Long caf&amp;eacute;&lt;/p&gt;</content:encoded><media:content url="m.png"/></item>
<item><title>No link</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Entry</title><link rel="alternate" href="https://a.com/2"/><id>e2</id><updated>2026-01-10T12:00:00Z</updated><summary>Sum</summary></entry></feed>"""


def test_json_and_feeds(spark):
    r = apis.parse_json_api(spark.createDataFrame([(3, JSON), (4, "not json"), (5, "{}")], "source_id long, body string")).collect()
    assert [(x.url, x.title, x.body, x.published_at, x.external_id, x.image_url) for x in r] == [("https://a.com/x", "A head", "Body & soul", datetime(2026, 1, 10, 12), "7", "i.png")]
    f = apis.parse_feeds(spark.createDataFrame([(1, RSS), (2, ATOM), (3, "junk")], "source_id long, body string")).orderBy("url").collect()
    assert [(x.title, x.body, x.summary, x.published_at, x.external_id, x.image_url) for x in f] == [("One & two", "Long café", "Short", datetime(2026, 1, 10, 10), "g1", "m.png"), ("Entry", "Sum", "Sum", datetime(2026, 1, 10, 12), "e2", None)]


def test_pushed_batches(spark):
    good = {"source": "x.com", "url": "https://x.com/1", "title": "Title", "published_at": "2026-01-10T12:00:00Z"}
    known = upkeep.get_or_create_sources(spark.createDataFrame([], "name string, reliability double, enabled boolean, kind string"), apis.pushed(spark, [good]))
    assert tuple(known.first()) == ("x.com", 0.6, False, "push")
    assert apis.from_push(apis.pushed(spark, [good]), spark.createDataFrame([(9, "x.com")], "id long, name string")).first().source_id == 9
    for bad in ([], [good] * 501, [{"source": "x"}], [good | {"reliability": 2.0}]):
        with pytest.raises(ValueError):
            apis.pushed(spark, bad)


def test_fetching(spark):
    """Conditional requests against a server of our own, and a source that is gone."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from storyloom.sources import fetch

    class Feed(BaseHTTPRequestHandler):
        def do_GET(self):
            known = self.headers.get("If-None-Match") == "v1"
            self.send_response(304 if known else 404 if "gone" in self.path else 200)
            self.send_header("ETag", "v1")
            self.end_headers()
            if not known:
                self.wfile.write(RSS.encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Feed)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    src = spark.createDataFrame([(1, f"{base}/a", None, None), (2, f"{base}/b", "v1", None), (3, f"{base}/gone", None, None)], "id long, feed_url string, etag string, last_modified string")
    got = fetch.fetch(spark, src).cache()
    assert sorted((r.source_id, r.status, r.etag, r.body is None, r.error is None) for r in got.collect()) == [(1, 200, "v1", False, True), (2, 304, "v1", True, True), (3, 404, None, True, False)]
    out = fetch.outcomes(got, apis.parse_feeds(got.select("source_id", "body")))
    assert sorted((r.id, r.ok, r.items) for r in out.collect()) == [(1, True, 1), (2, True, 0), (3, False, 0)]
    assert fetch.fetch(spark, src.limit(0)).count() == 0
    server.shutdown()


def test_politeness():
    from storyloom.sources import fetch

    now, waits = [0.0], []
    bucket = fetch.TokenBucket(2.0, 5.0, lambda: now[0], waits.append)
    assert [bucket.take("a") for _ in range(5)] == [0.0] * 5 and bucket.take("a") == pytest.approx(0.5) and bucket.take("b") == 0.0
    assert [fetch.backoff(i, draw=lambda lo, hi: hi) for i in range(6)] == [0.5, 1, 2, 4, 8, 8]
    calls = []

    def fails():
        calls.append(1)
        raise ConnectionError

    with pytest.raises(ConnectionError):
        fetch.with_retries(fails, 3, lambda _: None)
    assert len(calls) == 3


def test_watched_counters(spark, demo):
    from pyspark.sql import Observation

    stored = demo[1]
    seen = Observation("demo")
    n = jobs.watched(stored, seen).count()
    assert n == 20 and seen.get["rows"] == 20 and seen.get["syndicated"] == 2 and seen.get["hidden"] == 0


def test_polling(spark):
    base = (None, None, None, "rss", 0.6, "en", True, 180, None, None, None, None, 4, None, AS_OF)
    src = spark.createDataFrame([(i, *base) for i in range(3)], schema.SOURCE)
    polls = spark.createDataFrame([(0, True, 3, "e", None), (1, False, 0, None, None)], "id long, ok boolean, items int, etag string, last_modified string")
    r = {x.id: x for x in apis.record_polls(src, polls, NOW).collect()}
    assert (r[0].poll_interval_s, r[0].consecutive_failures, r[0].etag, r[0].next_poll_at) == (144, 0, "e", AS_OF + timedelta(seconds=144))
    assert (r[1].consecutive_failures, r[1].breaker_open_until) == (5, AS_OF + timedelta(seconds=300)) and r[2].consecutive_failures == 4
    assert [x.id for x in apis.due(apis.record_polls(src, polls, NOW), NOW).collect()] == [2]
    n = spark.range(1).select(*[apis.cooldown(F.lit(i)).alias(f"c{i}") for i in (4, 5, 6, 8, 30)], apis.after_success(F.lit(3000), F.lit(0)).alias("slow"), apis.after_success(F.lit(61), F.lit(1)).alias("fast")).first()
    assert tuple(n) == (None, 300, 600, 2400, 2400, 3600, 60)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(str(i), f"u{i % 7}", f"c{i // 20}", AS_OF + timedelta(minutes=i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, url_hash string, content_hash string, fetched_at timestamp_ntz").coalesce(1)
    for i in range(3):
        df.filter(f"int(id) % 60 >= {20 * i} and int(id) < {20 * i + 20}").write.parquet(str(tmp_path / f"in/b{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    jobs.run_available(jobs.fold_by_url(stream), str(tmp_path / "c"), "append", "folded")
    got = {r.url_hash: (r.n, r.updates) for r in spark.table("folded").groupBy("url_hash").agg(F.count("*").alias("n"), F.count_if(F.col("status") != "duplicate").alias("updates")).collect()}
    want = {r.url_hash: (r.revision + r.replays, r.revision) for r in upkeep.fold_revisions(df.withColumn("id", F.col("id").cast("long"))).collect()}
    assert got == want


def test_shingles_are_of_the_whole_text(spark, tmp_path):
    from storyloom.plans import queries

    texts = [" ".join(f"w{i}" for i in range(700)) + end for end in ("", " other", " end of it")]
    spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.id: r for r in queries.q_shingles(spark, str(tmp_path)).collect()}
    assert len({r.shingles_md5 for r in got.values()}) == 3
    words = {r.id: r.words for r in queries._words(spark, str(tmp_path)).collect()}
    assert all(got[i].n_distinct == len({tuple(w[k : k + 3]) for k in range(len(w) - 2)}) for i, w in words.items())


@pytest.mark.parametrize("query", ["q_near_dups", "q_dup_roots", "q_lsh_pairs"])
def test_near_copies_are_told_by_whole_texts(spark, tmp_path, query):
    from storyloom.plans import queries

    head = " ".join(f"w{i}" for i in range(700))
    tails = [" ".join(f"{x}{i}" for i in range(3000)) for x in "uuv"]
    rows = [(i, f"{head} {t}" + " end" * (i == 1), "en", "src1", 1) for i, t in enumerate(tails)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = getattr(queries, query)(spark, str(tmp_path)).collect()
    assert [sorted(r[:2]) for r in got] == [[0, 1]]  # the third has the same first words only


def test_whole_reading_agrees_with_the_columns_on_short_texts(spark):
    other = [(1, f"https://a.com/{i}", t, b, None, None, None, None, None, f"b_{i}", AS_OF) for i, (t, b) in enumerate((
        ("<b>NATO and the European Union</b> meet", "Mr. Smith of the United Nations said 1,5 or 7 &amp;amp; 12.50 <i>percent</i>"),
        ("Überraschung für Café de Paris", "Les Élèves ont vu\u00a0la Tour Eiffel und 3 ﬁlms ½ Ａ"), ("A title without a body", None), ("the of and in to", "the of"), ("?!?!?!?!?", "one"),
    ))]
    raw = spark.createDataFrame([*raw_articles(), *other], schema.RAW_ARTICLE + ", id string, fetched_at timestamp_ntz")
    names = ("id", "language", "topics", "entities", "simhash", "minhash", "blocking_key", "url_hash", "content_hash", "terms", "factors")
    plain = normaliser.normalise(raw, NOW, exact=True)
    plain = cluster._slim(plain).select(*names).orderBy("id").collect()
    assert cluster._slim(normaliser.normalise_whole(raw, NOW)).select(*names).orderBy("id").collect() == plain and len(plain) == 27


@pytest.mark.parametrize("query", ["q_clusters", "q_cluster_states"])
def test_articles_are_placed_by_whole_texts(spark, tmp_path, query):
    from storyloom.plans import queries

    head = "The same title of all\n" + " ".join(f"word{i}" for i in range(3000))
    tails = [" ".join(f"{x}{i}" for i in range(9000)) for x in "uuv"]
    rows = [(i, f"{head} {t}", "en", "src1", 1) for i, t in enumerate(tails)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = getattr(queries, query)(spark, str(tmp_path)).collect()
    if query == "q_clusters":  # the third has the same first 20,000 letters only
        assert sorted((r.id[-1], r.status, r.dup_kind) for r in got) == [("0", "created", None), ("1", "duplicate", "exact_content"), ("2", "created", None)]
    else:
        assert sum(r.member_count for r in got) == 2


def test_idle_stories_are_looked_for_again_once_they_are_active():
    import numpy as np
    import pandas as pd

    at, fold = pd.Timestamp(AS_OF), cluster.Fold()
    story = cluster.Story("s_1", "en", "k", "1", [], at, at, at, cluster.Sparse(np.array([3, 5]), np.array([1.0, 2.0]), 9))
    fold.resume(story, at + pd.Timedelta(hours=1))
    assert fold.stories == {"s_1": story} and not fold.by_term
    fold.revive(story, at + pd.Timedelta(hours=2))
    assert set(fold.by_term) == {("en", 3), ("en", 5)} and story.active == at + pd.Timedelta(hours=2)


def test_entry_without_the_other_subpackage():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.catalog.FLAGSHIP in e.queries()
