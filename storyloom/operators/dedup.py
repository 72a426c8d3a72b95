"""Duplicate cascade as relational operators: exact address, exact content, near SimHash, MinHash within a group.

Each step works on what the cheaper one left. Candidates come from equi-joins on hashes, parts of fingerprints or groups;
nothing is compared with everything.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Settings
from ..functions import fingerprint as fp
from .tables import written


def kind(same_source: Column, same: str) -> Column:
    """A copy of one's own source tells nothing; another source's copy is syndication."""
    return F.when(same_source, same).otherwise("syndicated")


def by_address(arrivals: DataFrame) -> DataFrame:
    """(id, first_id, changed, revision) of arrivals (id, url_hash, content_hash, fetched_at): the row that came first
    under its address, whether the content differs from the arrival before, and how many contents there were so far."""
    w = Window.partitionBy("url_hash").orderBy("fetched_at", "id")
    marked = arrivals.withColumn("first_id", F.first("id").over(w)).withColumn("changed", F.coalesce(F.lag("content_hash").over(w) != F.col("content_hash"), F.lit(False)))
    return marked.withColumn("revision", 1 + F.sum(F.col("changed").cast("int")).over(w)).select("id", "first_id", "changed", "revision")


def first_by_url(articles: DataFrame) -> DataFrame:
    """The articles that came first under their addresses."""
    history = by_address(articles.select("id", "url_hash", "content_hash", "fetched_at"))
    return articles.join(history.filter("id = first_id").select("id"), "id", "left_semi")


def chains(rows: DataFrame, key: str, s: Settings = DEFAULT) -> DataFrame:
    """rows (id, source_id, published_at, <key>) with `root`, a struct of published_at, id and source_id, and `until`.

    Rows of a key make a chain as long as each was published within s.dedup_window_h hours of one before; root is the
    chain's first row, by published_at and id, and until the last time. Rows are first summed up by day, so that a key with
    a third of all rows costs a task no more than its days.
    """
    day = F.floor(F.unix_seconds(F.col("published_at").cast("timestamp")) / 86_400)
    window = F.expr(f"INTERVAL {s.dedup_window_h} HOURS")
    days = rows.groupBy(key, day.alias("__day")).agg(F.min(F.struct("published_at", "id", "source_id")).alias("head"), F.max("published_at").alias("tail"))
    in_order = Window.partitionBy(key).orderBy("__day")
    starts = F.coalesce(F.col("head.published_at") > F.lag("tail").over(in_order) + window, F.lit(False)).cast("int")
    days = days.withColumn("__starts", starts).withColumn("__chain", F.sum("__starts").over(in_order))
    whole = Window.partitionBy(key, "__chain")
    days = days.select(key, "__day", F.min("head").over(whole).alias("root"), F.max("tail").over(whole).alias("until"))
    return rows.withColumn("__day", day).join(days, [key, "__day"]).drop("__day")


def exact_content(articles: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """articles with dup_of_id and dup_kind: copies of an article of the same content, published within s.dedup_window_h
    hours before, or of a copy of it. The first of such a chain is the original of all."""
    slim = chains(articles.select("id", "source_id", "published_at", "content_hash"), "content_hash", s).filter("id <> root.id")
    found = slim.select(F.col("id").alias("__id"), F.col("root.id").alias("dup_of_id"), kind(F.col("source_id").eqNullSafe(F.col("root.source_id")), "exact_content").alias("dup_kind"))
    return articles.join(found, F.col("id") == F.col("__id"), "left").drop("__id")


# Parts that two near fingerprints agree in at least, by the number of fingerprints that may meet: 8, 14 or 18 bits are
# compared together at 7 bits apart. More parts make smaller buckets and more rows; every choice finds all near ones.
AGREE = ((1 << 15, 1), (1 << 20, 2), (None, 3))


def _agree(many: int) -> int:
    return next(k for most, k in AGREE if most is None or many <= most)


def _parts(agree: int, s: Settings) -> list[int]:
    """Masks of the parts that a fingerprint is cut into: `agree` more than the bits that may differ."""
    n = s.hamming_max + agree
    cuts = [64 * i // n for i in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def keyed(prints: DataFrame, agree: int, s: Settings = DEFAULT, *also: str) -> DataFrame:
    """prints (simhash, ...) with `mask` and `key`, a row for each choice of `agree` parts: near fingerprints that are equal
    in the columns `also` have a key in common, whichever bits differ. A key is a hash, so what meets has to be compared."""
    masks = [_signed(sum(c)) for c in itertools.combinations(_parts(agree, s), agree)]
    out = prints.withColumn("mask", F.explode(F.array(*map(F.lit, masks))))
    return out.withColumn("key", F.xxhash64("mask", F.col("simhash").bitwiseAND(F.col("mask")), *also))


def _first_met(x: Column, y: Column, mask: Column, agree: int, s: Settings) -> Column:
    """Whether mask has the first of the parts that x and y agree in, so that a pair that meets often counts once: they
    differ in every other part below one of mask's."""
    met = x.bitwiseXOR(y).bitwiseAND(mask) == 0
    for p in _parts(agree, s)[:-1]:  # only the last part has the sign
        met &= (x.bitwiseXOR(y).bitwiseAND(F.lit(p)) != 0) | (mask.bitwiseAND(F.lit(p)) != 0) | ((mask >= 0) & (mask < p))
    return met


def lsh_classes(prints: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(a, b, distance) over rows (id, simhash): for each fingerprint its smallest id a with every other id b of it, at a
    distance of 0, and for each pair of fingerprints within s.hamming_max bits their smallest ids, a below b.

    That is every pair of near rows: two are near if their smallest ids are. Copies are never paired with each other.
    """
    groups = written(prints.groupBy("simhash").agg(F.min("id").alias("rep")), "classes")
    members = prints.join(groups, "simhash").filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"))
    agree = _agree(groups.count())
    x, y = (keyed(groups, agree, s).hint("merge").alias(c) for c in "xy")  # exploded rows are many more than their table's size tells
    near = fp.hamming(F.col("x.simhash"), F.col("y.simhash"))
    first = _first_met(F.col("x.simhash"), F.col("y.simhash"), F.col("x.mask"), agree, s)
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (near <= s.hamming_max) & (F.col("x.mask") == F.col("y.mask")) & first)
    return members.unionByName(met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), near.alias("distance")))


def lsh_pairs(prints: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(a, b, distance) for all pairs of rows (id, simhash), a < b, at a Hamming distance of at most s.hamming_max.

    As many rows as there are pairs, the square of a group of copies among them: where copies may be many, use
    lsh_classes(), which says as much.
    """
    prints = written(prints, "prints")
    members = written(prints.join(prints.groupBy("simhash").agg(F.min("id").alias("rep")), "simhash").select("rep", "id"), "members")
    p, q = (members.select(F.col("rep").alias(r), F.col("id").alias(i)) for r, i in (("a", "p"), ("b", "q")))
    across = lsh_classes(prints, s).filter("distance > 0").join(p, "a").join(q, "b").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "distance")
    within = p.join(q, F.col("a") == F.col("b")).filter("p < q").select(F.col("p").alias("a"), F.col("q").alias("b"), F.lit(0).alias("distance"))
    return across.unionByName(within)


def near_duplicates(articles: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(id, dup_of_id, distance, dup_kind, similarity) of articles (id, source_id, published_at, simhash) that come within
    s.dedup_window_h hours after one of a near fingerprint.

    Rows of one fingerprint make chains; all but the first of a chain are copies of it, at distance 0. The first is
    compared with the chains of other fingerprints that began before it and were at most that long ago: the least distance
    counts, then the earliest chain. Candidates meet in equi-joins on parts of the fingerprint and the week; a pair that meets often changes no minimum.
    """
    rows = written(articles.select("id", "source_id", "published_at", "simhash"), "prints")
    placed = written(chains(rows, "simhash", s), "chains")
    copies = placed.filter("id <> root.id").select("id", F.col("root.id").alias("dup_of_id"), F.lit(0).alias("distance"), (F.col("source_id") != F.col("root.source_id")).alias("other"))
    heads = placed.filter("id = root.id").select("id", "source_id", "published_at", "until", "simhash")
    week = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / (3600 * s.dedup_window_h))
    mine = heads.withColumn("week", week(F.col("published_at")))
    known = heads.withColumn("week", F.explode(F.sequence(week(F.col("published_at")), week(F.col("until")) + 1)))
    agree = _agree(known.groupBy("week").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0)
    # Exploded rows are many more than their table's size tells, so that a broadcast of them would not fit.
    x = keyed(mine, agree, s, "week").drop("mask", "week", "until").hint("merge").alias("x")
    y = keyed(known, agree, s, "week").drop("mask", "week").hint("merge").alias("y")
    near = fp.hamming(F.col("x.simhash"), F.col("y.simhash"))
    before = F.struct("y.published_at", "y.id") < F.struct("x.published_at", "x.id")
    lately = F.col("y.until") >= F.col("x.published_at") - F.expr(f"INTERVAL {s.dedup_window_h} HOURS")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (near <= s.hamming_max) & (F.col("x.simhash") != F.col("y.simhash")) & before & lately)
    best = met.groupBy("x.id").agg(F.min(F.struct(near.alias("distance"), F.col("y.published_at"), F.col("y.id").alias("of"), (F.col("x.source_id") != F.col("y.source_id")).alias("other"))).alias("best"))
    found = copies.unionByName(best.select("id", F.col("best.of").alias("dup_of_id"), F.col("best.distance").alias("distance"), F.col("best.other").alias("other")))
    return found.select("id", "dup_of_id", F.col("distance").cast("int").alias("distance"), kind(~F.coalesce("other", F.lit(True)), "near_dup").alias("dup_kind"), (1.0 - F.col("distance") / 64.0).alias("similarity"))


def within_group(articles: DataFrame, group: str, s: Settings = DEFAULT) -> DataFrame:
    """(id, dup_of_id, dup_kind, similarity): MinHash matches with the s.check_members newest earlier members of a group.

    articles has (id, <group>, source_id, published_at, minhash). The newest members before a row come from one ordered
    window over slim rows; the fingerprints, written once, join afterwards.
    """
    flat = written(articles.filter(F.size("minhash") > 0).select("id", group, "source_id", "published_at", "minhash"), "minhashes")
    w = Window.partitionBy(group).orderBy("published_at", "id").rowsBetween(-s.check_members, -1)
    pairs = flat.select("id", F.collect_list("id").over(w).alias("before")).select("id", F.explode("before").alias("other"))
    met = pairs.join(flat.select("id", "source_id", "minhash"), "id").join(flat.select(F.col("id").alias("other"), F.col("source_id").alias("os"), F.col("minhash").alias("om")), "other")
    scored = met.select("id", "other", (F.col("source_id") == F.col("os")).alias("same"), fp.minhash_jaccard(F.col("minhash"), F.col("om")).alias("j")).filter(F.col("j") >= s.near_dup_jaccard)
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("j")).alias("n"), "other", "same")).alias("best"))
    return best.select("id", F.col("best.other").alias("dup_of_id"), kind(F.col("best.same"), "near_dup").alias("dup_kind"), F.round(-F.col("best.n"), 4).alias("similarity"))


def to_root(dups: DataFrame) -> DataFrame:
    """(id, dup_of_id, ...) with dup_of_id chased to an article that is no duplicate, by pointer doubling: as many rounds
    as the logarithm of the longest chain, each written before the next."""
    out, left = written(dups, "chase"), -1
    while left:
        hop = out.select(F.col("id").alias("__mid"), F.col("dup_of_id").alias("__up"))
        joined = out.join(hop, out.dup_of_id == hop["__mid"], "left")
        step = written(joined.withColumn("dup_of_id", F.coalesce("__up", "dup_of_id")).withColumn("__moved", F.col("__up").isNotNull()).drop("__mid", "__up"), "chase")
        left = step.filter("__moved").count()
        out = step.drop("__moved")
    return out
