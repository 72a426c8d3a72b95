"""Text, URL, fingerprint, vector and ranking functions on known cases and properties."""

import math
import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from storyloom.functions import fingerprint as fp
from storyloom.functions import lexicon, rank, text, url, vectors

# Texts that the thresholds are calibrated on.
WIRE = ("Magnitude 6.4 earthquake strikes off the coast of northern Japan", "A magnitude 6.4 earthquake struck off the coast of northern Japan on Friday, the Japan Meteorological Agency said. No tsunami warning was issued and there were no immediate reports of casualties or major damage.")
REWRITTEN = ("6.4 magnitude quake hits off northern Japan coast", "A magnitude 6.4 earthquake struck off the coast of northern Japan on Friday, the Japan Meteorological Agency reported. No tsunami warning was issued and there were no immediate reports of casualties or serious damage.")
SAME_EVENT = ("Strong earthquake shakes northern Japan, no tsunami warning", "Buildings swayed in northern Japan after a strong undersea earthquake, but authorities said there was no tsunami risk. Residents reported shaking lasting nearly a minute.")
OTHER_EVENT = ("Federal Reserve holds interest rates steady as inflation cools", "The Federal Reserve left its benchmark interest rate unchanged on Wednesday, citing easing inflation pressures while signalling it remains cautious about cutting borrowing costs too quickly. Policymakers voted unanimously.")


@pytest.fixture(scope="module")
def one(spark):
    """The value of an expression over one row of named values."""

    def run(make, **values):
        df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in ((k, "array<string>" if isinstance(v, list) else "string") for k, v in values.items())))
        return df.select(make(*[F.col(k) for k in values]).alias("x")).first().x

    return run


def test_lexicon_sizes():
    assert len(set(lexicon.STOPWORDS)) == 122 and len(set(lexicon.TRACKING_PARAMS)) == 36 and len(set(lexicon.ENTITY_NOISE)) == 65
    assert len(lexicon.TOPICS) == 8 and sum(len(set(w)) for w in lexicon.TOPICS.values()) == 114


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTP://Www.Inkwell.Example/Tide/Tables/", "https://inkwell.example/Tide/Tables"), ("inkwell.example", "https://inkwell.example/"),
        ("http://inkwell.example:80//tide///tables", "https://inkwell.example/tide/tables"), ("https://inkwell.example:8443/tide", "https://inkwell.example:8443/tide"),
        ("https://inkwell.example/tide/amp.html", "https://inkwell.example/tide"), ("https://inkwell.example/tide/AMP#low", "https://inkwell.example/tide"),
        ("https://inkwell.example/tide?zone=7&bay=3&utm_medium=mail&FBCLID=99", "https://inkwell.example/tide?bay=3&zone=7"),
        ("https://inkwell.example/tide?note=&name=low%20water", "https://inkwell.example/tide?name=low+water"),
        ("https://reader:pass@inkwell.example:443/tide;page=2", "https://inkwell.example/tide"), ("http://[half", "http://[half"), (" \t", ""), ("", ""), (None, ""),
    ],
)
def test_canonical_url(one, raw, want):
    assert one(url.canonical, u=raw) == want


def test_domain(one):
    assert one(url.domain, u="https://www.bbc.co.uk/news") == "bbc.co.uk" and one(url.domain, u="garbage") == "" and one(url.domain, u=None) == ""


@pytest.mark.parametrize("exact", [False, True])
def test_strip_html_and_normalise(one, exact):
    strip, norm = (lambda f: lambda c: f(c, exact))(text.strip_html), (lambda f: lambda c: f(c, exact))(text.normalise)
    assert one(strip, s="<p>Rates &amp; <b>bonds</b></p>") == "Rates & bonds"
    assert one(strip, s="<div>Real<script>var x=1;</script><STYLE>p{}</STYLE>text</div>") == "Real text"
    assert one(strip, s=None) == "" and one(strip, s="") == ""
    assert one(norm, s="Café RÉSUMÉ") == "cafe resume" and one(norm, s="“quote” – dash’s") == "\"quote\" - dash's" and one(norm, s="a\n\t  b") == "a b"


def test_exact_forms_go_further(one):
    assert one(lambda c: text.strip_html(c, True), s="caf&eacute; &hellip;") == "café …"
    assert one(lambda c: text.normalise(c, True), s="ﬁn Ａ") == "fin a"


def test_tokens_and_shingles(one):
    words = lambda c: text.words(text.normalise(c))
    assert one(lambda c: text.content_words(words(c)), s="The magnitude 6 quake of 2026") == ["magnitude", "quake", "2026"]
    assert one(words, s="The end") == ["the", "end"]
    assert one(text.shingles, t=["a", "b", "c", "d"]) == ["a_b_c", "b_c_d"] and one(text.shingles, t=["a", "b"]) == ["a_b"] and one(text.shingles, t=[]) == []


def test_content_hash(one):
    h = lambda t, b: one(text.content_hash, t=t, b=b)
    assert h("Title", "<b>Body</b> text") == h("TITLE", "Body   text") != h("Title", "other") and len(h("a", "b")) == 40


def test_topics_and_language(one):
    assert "sport" not in one(text.topics, t="final results national election".split())
    assert one(text.topics, t="inflation rates markets economy bank investors".split()) == ["business"]
    assert one(text.topics, t=[]) == ["general"] and one(text.topics, t="chip gpu vote party election".split()) == ["politics", "technology"]
    assert one(text.language, t="the quick brown fox is in the house".split()) == "en" and one(text.language, t=["xyz"]) == "und" and one(text.language, t=[]) == "und"


def test_entities(one):
    e = one(text.entities, t="Magnitude 6.4 earthquake strikes Japan", b="The Japan Meteorological Agency said on Friday. However, NATO and 1,5 or 7.")
    assert {"japan", "#6.4", "japan_meteorological_agency", "nato", "#1.5"} <= set(e) and not {"the", "however", "#7"} & set(e) and e == sorted(e)


def test_times(spark):
    df = spark.createDataFrame([("2026-01-10T12:00:00+02:00",), ("2026-01-10T12:00:00Z",), ("nonsense",)], "s string").select(text.parse_time(F.col("s")).alias("t"))
    times = [r.t for r in df.collect()]
    assert times == [datetime(2026, 1, 10, 10), datetime(2026, 1, 10, 12), None]
    assert df.select(text.bucket("t").alias("b"), text.iso_z(F.col("t")).alias("z")).first() == (10231, "2026-01-10T10:00:00Z")


def popcount(a, b):
    return (a ^ b).bit_count()


def test_simhash_is_calibrated():
    d = [popcount(fp.simhash(*WIRE), fp.simhash(*x)) for x in (WIRE, REWRITTEN, SAME_EVENT, OTHER_EVENT)]
    assert d == [0, 9, 22, 31] and fp.simhash("", "") == 0
    assert [popcount(fp.simhash(*WIRE, "md5"), fp.simhash(*x, "md5")) for x in (REWRITTEN, SAME_EVENT, OTHER_EVENT)] == [13, 34, 32]


def test_whole_simhash_counts_every_word(monkeypatch):
    words = [f"w{i % 1500}" for i in range(2000)] + ["the", "end"]
    weights = Counter()
    for features, w in ((["long", "title"], 1), ([x for x in words if x != "the"], 2), (["_".join(words[i : i + 3]) for i in range(len(words) - 2)], 3)):
        for f in features:
            weights[f] += w
    plain = {}
    for family in fp.PRIME:
        votes = [sum(w if fp.hash64(f, family) >> k & 1 else -w for f, w in weights.items()) for k in range(64)]
        plain[family] = sum(1 << k for k in range(64) if votes[k] > 0)
    for chunk in (fp.CHUNK, 100):
        monkeypatch.setattr(fp, "CHUNK", chunk)
        assert plain == {family: fp.simhash("long title", " ".join(words), family, whole=True) for family in fp.PRIME}
    assert fp.simhash("", "the of", whole=True) == fp.simhash("", "the of") == fp.hash64("the_of", "blake2b")


def test_memos_of_hashes_are_bounded(monkeypatch):
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)]
    plain = [(fp.simhash("", t), fp.minhash("", t)) for t in texts]
    monkeypatch.setattr(fp, "MEMO", 200)
    one, two = {}, {}
    assert [(fp.simhash("", t, memo=one), fp.minhash("", t, memo=two)) for t in texts] == plain
    assert max(len(one), len(two)) <= 200 + 2 * 60


def test_minhash_is_calibrated(spark):
    share = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / 64
    m = [fp.minhash(*x) for x in (WIRE, REWRITTEN, SAME_EVENT, OTHER_EVENT)]
    assert [round(share(m[0], x), 3) for x in m[1:]] == [0.516, 0.016, 0.0] and fp.minhash("", "") == []
    a, b = (F.array(*map(F.lit, x)) for x in m[:2])
    row = spark.range(1).select(fp.minhash_jaccard(a, b).alias("j"), fp.minhash_jaccard(a, F.array().cast("array<long>")).alias("z"), F.length(fp.minhash_hex(a)).alias("n")).first()
    assert (round(row.j, 3), row.z, row.n) == (0.516, 0.0, 512)


def test_affine_maps_are_exact():
    rng = random.Random(1)
    for family, p in fp.PRIME.items():
        import numpy as np

        h = np.array([rng.randrange(p) for _ in range(50)] + [0, p - 1], dtype=np.uint64)
        a, b = fp.permutations(family)
        assert [[(int(x) * int(v) + int(y)) % p for v in h] for x, y in zip(a, b, strict=True)] == fp._affine(h, family).tolist()


def test_columns_of_fingerprints(spark):
    value = fp._signed(fp.simhash(*WIRE))
    row = spark.range(1).select(fp.band_array(F.lit(value)).alias("b"), fp.hex64(F.lit(value)).alias("h"), fp.unhex64(fp.hex64(F.lit(value))).alias("u"), fp.hamming(F.lit(value), F.lit(value ^ 5)).alias("d"), fp.unhex64(F.lit(None).cast("string")).alias("n")).first()
    whole = value & (1 << 64) - 1
    assert row.h == f"{whole:016x}" and row.u == value and row.d == 2 and row.n == 0
    assert row.b == [f"{whole >> 8 * i & 255:02x}" for i in range(8)]


def test_pigeonhole():
    """Any seven flipped bits leave one of eight bands alone."""
    rng = random.Random(3)
    for _ in range(2000):
        v = rng.getrandbits(64)
        w = v
        for bit in rng.sample(range(64), rng.randint(0, 7)):
            w ^= 1 << bit
        assert any(v >> 8 * i & 255 == w >> 8 * i & 255 for i in range(8))


def test_vectors(spark):
    df = spark.createDataFrame([(1, "a", 3.0), (1, "b", 4.0), (1, "c", -0.1), (2, "z", 0.0)], "id long, term string, w double")
    v = {r.term: r.w for r in vectors.unit_length(vectors.top_terms(df, 2)).collect()}
    assert v == {"a": pytest.approx(0.6), "b": pytest.approx(0.8)}
    m = lambda **kw: F.create_map(*[x for k, w in kw.items() for x in (F.lit(k), F.lit(w))])
    row = spark.range(1).select(vectors.cosine(m(a=0.6, b=0.8), m(b=1.0)).alias("c"), vectors.jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))).alias("j"), vectors.jaccard(F.array().cast("array<string>"), F.array(F.lit("a"))).alias("z")).first()
    assert (row.c, row.j, row.z) == (pytest.approx(0.8), 0.5, 0.0)


def test_whole_vectors_find_the_pairs_of_exploded_ones(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i:03}" for i in range(400)]
    docs = [rng.choices(words, k=rng.randint(1, 60)) for _ in range(30)]
    docs += [[w if rng.random() < 0.93 else rng.choice(words) for w in rng.choice(docs)] for _ in range(90)] + [[], None, ["alone"], ["alone", "w001"]]
    rows = [(i, (d or [])[:3] if d is not None else None, d, "en" if i % 9 else "fr") for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "id long, t array<string>, b array<string>, language string").repartition(3).cache()
    want = vectors.term_counts(df, "id", "t", "b")
    got = vectors.counted(df, "id", "t", "b").select("id", F.explode(F.arrays_zip("terms", "tf")).alias("x")).select("id", "x.terms", F.col("x.tf").cast("double"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    language = df.select("id", "language")
    plain = vectors.similar_pairs(vectors.tfidf(want, len(rows)).join(language, "id"), 0.5, ("language",)).collect()
    monkeypatch.setattr(vectors, "GROUP", 20)  # many groups
    counts = vectors.hashed(vectors.counted(df, "id", "t", "b")).join(language, "id")
    v, rarities = vectors.whole_vectors(counts, vectors.common_terms(counts), len(rows))
    v = v.cache()
    found = vectors.similar_wholes(v, rarities, 0.5, ("language",))
    tell = lambda rs: sorted((r.a, r.b, round(r.cosine, 9)) for r in rs)
    assert len(plain) > 50 and tell(found.collect()) == tell(plain)
    some = vectors.similar_wholes(v, rarities, 0.5, ("language",), df.filter("id % 2 = 0"))
    assert tell(some.collect()) == tell([r for r in plain if r.a % 2 == r.b % 2 == 0])
    assert vectors.similar_wholes(v.filter("id < 0"), rarities, 0.5, ("language",)).count() == 0


def test_ranking(spark):
    now, at = F.lit(datetime(2026, 1, 10, 12)), lambda h: F.lit(datetime(2026, 1, 10, 12 - h))
    r = lambda e, a: rank.recency(now, at(e), at(a))
    s = lambda authority, n, v, rec, rel=None: rank.score(F.lit(authority), F.lit(n), F.lit(v), rec, rel)
    row = spark.range(1).select(
        r(8, 8).alias("half"), r(0, 0).alias("new"), rank.recency(at(8), now, now).alias("ahead"), s(4.58, 6, 6.0, F.lit(0.941)).alias("demo"), s(1e9, 10**6, 1e9, F.lit(1.0), F.lit(7.0)).alias("most"),
        (s(1.0, 2, 0.0, F.lit(1.0)) - s(1.0, 1, 0.0, F.lit(1.0))).alias("second"), (s(1.0, 20, 0.0, F.lit(1.0)) - s(1.0, 19, 0.0, F.lit(1.0))).alias("twentieth"),
    ).first()
    assert (row.half, row.new, row.ahead, row.most) == (0.5, 1.0, 1.0, 1.0) and row.second > row.twentieth > 0
    assert row.demo == pytest.approx(0.5671, abs=2e-3)
    assert math.isclose(0.45 + 0.30 + 0.15 + 0.10, 1.0)
