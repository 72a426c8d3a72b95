"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its share of the target over its share of the corpus. Each document draws its count
of copies from a Poisson distribution of that mean, by inverting the distribution function at a number that a hash of
seed and document gives, is exploded by the count, and goes to a place that another hash gives. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SEED, materialise, small, unit_hash

PART = 64.0  # a larger mean is drawn as a sum of draws with means of at most this
COPIES = 1000  # equal rows without an id that are made again in one part
BROADCAST_SOURCES = 20_000  # sources up to which the table of rates is broadcast


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until the rest is negligible, for a mean of at most PART."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def add(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, add, lambda acc: acc["c"])


def rates(docs: DataFrame, targets: DataFrame | None, source: str, size: Column, total: float | None) -> DataFrame:
    """(source, rate) for each source of docs."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("double").alias("size"))
    if targets is None:
        weighted = sizes.withColumn("weight", F.lit(1.0))
    else:
        t = targets.select(F.col("source").alias("t"), F.col("weight").cast("double").alias("weight"))
        weighted = sizes.join(t, F.col("source").eqNullSafe(F.col("t")), "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    # Sources without anything in them, or without a weight, take no share.
    weighted = materialise(weighted.select("source", "size", F.when(F.col("size") > 0, F.col("weight")).otherwise(0.0).alias("weight")), "sizes")
    whole = weighted.agg(F.sum("size").alias("s"), F.sum("weight").alias("w")).first()
    budget = float(whole.s or 0.0) if total is None else float(total)
    scale = budget / whole.w if whole.w else 0.0
    rate = F.when(F.col("size") > 0, F.col("weight") * scale / F.col("size")).otherwise(0.0)
    return weighted.select("source", rate.alias("rate"))


def mix(docs: DataFrame, targets: DataFrame | None = None, total: float | None = None, seed: int = SEED, id_col: str = "doc_id", source: str = "source", text_col: str = "text") -> DataFrame:
    """docs replicated to target weights and shuffled, with `copy` (from 1) and `copies` (the document's count).

    targets has rows (source, weight); without it all sources weigh the same. Weights are shares of characters; total
    is the characters to aim at, the corpus's own without it. A null source is a source. Null and empty texts have
    size 0 and follow their source's rate; a source of nothing but such, and one without a weight, has rate 0. Rows
    that share an id get the same count; rows without one draw each on its own. All columns are kept; ones named copy or
    copies are replaced. An empty table gives an empty result. The same seed gives the same result on any number of executors.
    """
    kept = [c for c in docs.columns if c not in ("copy", "copies")]
    size = F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    # The rows go along whole, so that no column of theirs clashes with one of the draw.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), F.col(source).alias("source"), F.col(id_col).cast("string").alias("id"), size.alias("size"))
    table = rates(rows, targets, "source", F.col("size"), total)
    table = table.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    table = table.withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts")))
    table = materialise(table.select(F.col("source").alias("of"), "parts", "cdf"), "rates")
    if small(table, BROADCAST_SOURCES):
        table = F.broadcast(table)
    # Rows without an id are told apart by what is in them, and equal ones by their number: counted before the shuffle,
    # then made again in parts of COPIES rows.
    unnamed = rows.filter("id is null").withColumn("key", F.md5(F.to_json("doc"))).groupBy("key").agg(F.first("doc").alias("doc"), F.first("source").alias("source"), F.count(F.lit(1)).alias("n"))
    unnamed = unnamed.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES)))).repartition("key", "part")
    unnamed = unnamed.withColumn("nth", F.explode(F.sequence(F.col("part") * COPIES + 1, F.least("n", (F.col("part") + 1) * COPIES))))
    unnamed = unnamed.select("doc", "source", F.concat_ws("#", F.lit(""), "key", F.col("nth").cast("string")).alias("key"))
    placed = rows.filter("id is not null").select("doc", "source", F.col("id").alias("key")).unionByName(unnamed).join(table, F.col("source").eqNullSafe(F.col("of")))
    draw = lambda j: unit_hash(F.col("key"), j.cast("string"), seed=seed)
    one = lambda j: F.size(F.filter("cdf", lambda c: c <= draw(j)))
    # The usual single draw needs the hash once, not once for each entry.
    single = placed.withColumn("u", draw(F.lit(1)))
    first = F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    more = F.aggregate(F.sequence(F.lit(2), F.col("parts")), F.lit(0), lambda acc, j: acc + one(j))
    counted = single.withColumn("copies", first + F.when(F.col("parts") > 1, more).otherwise(0)).filter("copies > 0")
    out = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    out = out.withColumn("place", F.md5(F.concat_ws(":", F.lit(f"{seed}place"), "key", F.col("copy").cast("string"))))
    return out.repartition("place").sortWithinPartitions("place").select("doc.*", "copy", "copies")
