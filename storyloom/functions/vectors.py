"""Sparse TF-IDF vectors in exploded form (id, term, w), and similarities.

Exploded vectors join and aggregate without Python; map columns serve comparisons of two given rows. Whole vectors, two
arrays a row, take a fraction of the room and need no shuffle to be made, as a document's counts come from its text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Settings


def term_counts(docs: DataFrame, id_col: str, title_words: str, body_words: str) -> DataFrame:
    """(id, term, tf): content words, those of the title counting twice, of the body the first 400."""
    weighted = F.concat(
        F.transform(title_words, lambda t: F.struct(t.alias("term"), F.lit(2.0).alias("n"))),
        F.transform(F.slice(body_words, 1, 400), lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("n"))),
    )
    each = docs.select(F.col(id_col).alias("id"), F.explode(weighted).alias("x"))
    return each.groupBy("id", "x.term").agg(F.sum("x.n").alias("tf"))


def document_frequencies(vectors: DataFrame) -> DataFrame:
    """(term, df) over (id, term, ...)."""
    return vectors.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(df: Column, documents: Column | int) -> Column:
    n = documents if isinstance(documents, Column) else F.lit(documents)
    return F.ln((n + 1.0) / (F.coalesce(df, F.lit(0)) + 1.0)) + 1.0


def top_terms(vectors: DataFrame, k: int, weight: str = "w", key: str = "id") -> DataFrame:
    """The k heaviest terms of each vector; ties go to the smaller term."""
    order = Window.partitionBy(key).orderBy(F.abs(F.col(weight)).desc(), "term")
    return vectors.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= k).drop("__rank")


def unit_length(vectors: DataFrame, weight: str = "w", key: str = "id") -> DataFrame:
    norm = F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(Window.partitionBy(key)))
    return vectors.withColumn("__norm", norm).filter("__norm > 0").withColumn(weight, F.col(weight) / F.col("__norm")).drop("__norm")


def tfidf(counts: DataFrame, documents: int, frequencies: DataFrame | None = None, s: Settings = DEFAULT) -> DataFrame:
    """(id, term, w) of unit length from (id, term, tf), with the s.centroid_terms heaviest terms each."""
    frequencies = document_frequencies(counts) if frequencies is None else frequencies
    weighted = counts.join(frequencies, "term", "left").select("id", "term", ((1.0 + F.ln("tf")) * idf(F.col("df"), documents)).alias("w"))
    return unit_length(top_terms(weighted, s.centroid_terms))


def dot_products(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, cosine) for the pairs of vectors (id, term, w, *keys) that share a term and the keys."""
    x = a.select(F.col("id").alias("a"), "term", F.col("w").alias("wa"), *keys)
    y = b.select(F.col("id").alias("b"), "term", F.col("w").alias("wb"), *keys)
    return x.join(y, ["term", *keys]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def similar_pairs(vectors: DataFrame, threshold: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, cosine) for all pairs of unit vectors (id, term, w, *keys) with equal keys and a cosine of at least threshold.

    Candidates share a term of both vectors' prefixes: terms from the rarest on, until what is left of a vector is shorter
    than threshold. As the order is the same for all, a pair without such a term has all its common terms in one vector's
    rest, and can't reach the threshold. Common words so seldom bring vectors together.
    """
    counted = vectors.join(document_frequencies(vectors).withColumnRenamed("df", "__df"), "term")
    rest = Window.partitionBy("id").orderBy(F.col("__df").desc(), F.col("term").desc())
    head = counted.withColumn("__rest", F.sum(F.col("w") * F.col("w")).over(rest)).filter(F.col("__rest") >= threshold * threshold * (1 - 1e-9))
    x, y = (head.select(F.col("id").alias(c), "term", *keys) for c in "ab")
    met = x.join(y, ["term", *keys]).filter("a < b").select("a", "b").distinct()
    x, y = (vectors.select(F.col("id").alias(c), "term", F.col("w").alias(f"w{c}")) for c in "ab")
    dots = met.join(x, "a").join(y, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return dots.filter(F.round("cosine", 5) >= threshold)


GROUP = 20_000  # pairs that are compared together, more in a larger family
VOCABULARY = 4_000_000  # terms of two documents or more up to which their frequencies are told to every task


def _slices(batches, rows: int = 512):
    """Arrow batches cut into small ones, as numpy takes many times the room of a batch of long texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def counted(docs: DataFrame, id_col: str, title_words: str, body_words: str, *also: str) -> DataFrame:
    """(id, terms, tf, *also): what term_counts() gives, as arrays, the terms ascending. Rows that share an id are
    different."""

    def run(it):
        pa.default_memory_pool().release_unused()  # a worker that ran other steps holds on to their batches
        for batch in _slices(it):
            lists = [batch.column(1), batch.column(2)]
            row = pa.concat_arrays([pc.list_parent_indices(c).cast(pa.int32()) for c in lists])
            words = pa.concat_arrays([pc.list_flatten(c) for c in lists])
            n = np.repeat(np.array([2, 1], dtype=np.int32), [len(pc.list_flatten(c)) for c in lists])
            t = pa.table({"row": row, "term": words, "n": n}).group_by(["row", "term"], use_threads=False).aggregate([("n", "sum")]).sort_by([("row", "ascending"), ("term", "ascending")]).combine_chunks()
            ends = np.cumsum(np.bincount(t["row"].to_numpy(), minlength=batch.num_rows))
            offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
            terms, tf = (t[c].combine_chunks() for c in ("term", "n_sum"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, tf.cast(pa.int32())), *(batch.column(c) for c in also)], names=["id", "terms", "tf", *also])

    cut = docs.select(F.col(id_col).cast("long").alias("id"), F.col(title_words).alias("t"), F.slice(body_words, 1, 400).alias("b"), *also)
    cut = cut.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in "tb"})
    types = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in also)
    return cut.mapInArrow(run, f"id long, terms array<string>, tf array<int>{types}")


def hashed(counts: DataFrame) -> DataFrame:
    """counts with the hashes of the terms, 64 bits, in their place."""
    return counts.withColumn("terms", F.transform("terms", lambda t: F.xxhash64(t)))


def common_terms(counts: DataFrame) -> DataFrame:
    """(term, df) of the hashed terms that more than one row of counts has."""
    return document_frequencies(counts.select(F.explode("terms").alias("term"))).filter("df > 1")


def _weights(tf: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    return (1.0 + np.log(tf)) * rarity


def weighed(counts: DataFrame, common: DataFrame, documents: int, s: Settings = DEFAULT) -> DataFrame:
    """(id, terms, w, ...) from counted(): what tfidf() gives, as arrays, the heaviest terms first. common is common_terms()
    of the hashed counts, at most VOCABULARY rows."""
    known = common.toArrow().combine_chunks().sort_by("term")
    term, df = (known[c].to_numpy() for c in ("term", "df"))
    told = counts.sparkSession.sparkContext.broadcast((term, np.log((documents + 1.0) / (df + 1.0)) + 1.0))
    alone = float(np.log((documents + 1.0) / 2.0) + 1.0)
    others = [c for c in counts.columns if c not in ("id", "terms", "tf")]
    most = s.centroid_terms

    def run(it):
        names, rarities = told.value
        pa.default_memory_pool().release_unused()  # a worker that ran other steps holds on to their batches
        for batch in _slices(it):
            lists = batch.column("terms")
            tf, flat = (pc.list_flatten(batch.column(c)).to_numpy(zero_copy_only=False) for c in ("tf", "hashes"))
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(names, flat), max(len(names) - 1, 0))
            w = _weights(tf, np.where(names[at] == flat, rarities[at], alone) if len(names) else alone)
            by = np.lexsort((-w, row))  # ties go to the smaller term, which comes first
            kept = by[np.arange(len(by)) - np.searchsorted(row[by], row[by]) < most]
            norm = np.sqrt(np.bincount(row[kept], weights=w[kept] ** 2, minlength=batch.num_rows))
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[kept], minlength=batch.num_rows)))).astype(np.int32))
            arrays = [pa.ListArray.from_arrays(offsets, x) for x in (pc.list_flatten(lists).take(pa.array(kept)), pa.array(w[kept] / norm[row[kept]]))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays, *(batch.column(c) for c in others)], names=["id", "terms", "w", *others])

    types = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in counts.schema if f.name in others)
    return counts.withColumn("hashes", F.transform("terms", lambda t: F.xxhash64(t))).mapInArrow(run, f"id long, terms array<string>, w array<double>{types}")


def packed(vectors: DataFrame, *keys: str) -> DataFrame:
    """(*keys, terms, w): vectors (*keys, term, w) as arrays."""
    return vectors.groupBy(*keys).agg(F.collect_list(F.struct("term", "w")).alias("x")).select(*keys, F.col("x.term").alias("terms"), F.col("x.w").alias("w"))


def heaviest(k: int) -> list[Column]:
    """terms and w of the k heaviest terms of whole vectors (terms, w); ties go to the smaller term."""
    each = F.arrays_zip(F.col("terms").alias("term"), F.col("w").alias("w"))
    top = F.slice(F.array_sort(F.transform(each, lambda e: F.struct((-F.abs(e["w"])).alias("n"), e["term"].alias("term"), e["w"].alias("w")))), 1, k)
    return [F.transform(top, lambda e: e["term"]).alias("terms"), F.transform(top, lambda e: e["w"]).alias("w")]


BITS = 256  # of a vector's sketch: the signs of its products with random normal vectors
SIGMAS = 7.5  # standard errors by which sketches may differ more than at the threshold: a pair is lost once in 1e13
_normals: list[np.ndarray] = []


def _sketch(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sketch of a vector of hashed terms, as numbers; a term's normal vector is the sum of two drawn ones."""
    if not _normals:
        rng = np.random.default_rng(20240229)  # fixed value: sketches of all tasks have to agree
        _normals.extend(rng.standard_normal((4096, BITS), dtype=np.float32) for _ in range(2))
    h = terms.view(np.uint64)
    one, two = (h >> np.uint64(8)) & np.uint64(4095), (h >> np.uint64(40)) & np.uint64(4095)
    w = weights.astype(np.float32)
    return np.packbits(w @ _normals[0][one] + w @ _normals[1][two] > 0).view(np.int64)


def _differing(cosine: float) -> int:
    """The most bits by which sketches of vectors of at least this cosine differ."""
    p = np.arccos(cosine) / np.pi
    return int(BITS * p + SIGMAS * np.sqrt(BITS * p * (1 - p)))


def whole_vectors(counts: DataFrame, common: DataFrame, documents: int, s: Settings = DEFAULT):
    """(id, terms, tf, norm, sketch, ...) from hashed counts, with the s.centroid_terms heaviest terms each, less those that no
    other row has, which count for the length only; and what tells the tasks each term's rarity.

    Terms are numbers, rarer ones before others in all vectors. A weight is that of _weights(), over norm; counts and
    numbers take a third of the room of weights. common is common_terms() of at most VOCABULARY rows.
    """
    known = common.toArrow().combine_chunks()
    term, df = (known[c].to_numpy() for c in ("term", "df"))
    rank = np.empty(len(term), dtype=np.int32)
    rank[np.lexsort((term, df))] = np.arange(len(term), dtype=np.int32)
    order = np.argsort(term)
    rarity = np.empty(len(term))
    rarity[rank] = np.log((documents + 1.0) / (df + 1.0)) + 1.0
    rarities = counts.sparkSession.sparkContext.broadcast(rarity)
    told = counts.sparkSession.sparkContext.broadcast((term[order], df[order].astype(np.int32), rank[order]))
    others = [c for c in counts.columns if c not in ("id", "terms", "tf")]
    most = s.centroid_terms

    def run(it):
        names, dfs, ranks = told.value
        for batch in _slices(it):
            lists, factors = batch.column("terms"), batch.column("tf")
            flat, tf = pc.list_flatten(lists).to_numpy(zero_copy_only=False), pc.list_flatten(factors).to_numpy(zero_copy_only=False)
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(names, flat), max(len(names) - 1, 0))
            found = names[at] == flat if len(names) else np.zeros(len(flat), dtype=bool)
            frequency, number = (np.where(found, x[at], other) if len(names) else np.full(len(flat), other) for x, other in ((dfs, 1), (ranks, -1)))
            w = _weights(tf, np.log((documents + 1.0) / (frequency + 1.0)) + 1.0)
            # The heaviest of a row, ties going to the smaller term, which comes first.
            by = np.lexsort((-np.abs(np.round(w, 12)), row))
            place = np.arange(len(by)) - np.searchsorted(row[by], row[by])
            kept = by[place < most]
            norm = np.sqrt(np.bincount(row[kept], weights=w[kept] ** 2, minlength=batch.num_rows))
            kept = kept[np.argsort(row[kept], kind="stable")]
            cuts = np.searchsorted(row[kept], np.arange(batch.num_rows + 1))
            sketches = [_sketch(flat[kept[i:j]], w[kept[i:j]]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            kept = kept[number[kept] >= 0]
            kept = kept[np.lexsort((number[kept], row[kept]))]
            ends = np.cumsum(np.bincount(row[kept], minlength=batch.num_rows))
            offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
            arrays = [batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(number[kept].astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(tf[kept].astype(np.int32))), pa.array(norm), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*arrays, *(batch.column(c) for c in others)], names=["id", "terms", "tf", "norm", "sketch", *others])

    types = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in counts.schema if f.name in others)
    return counts.mapInArrow(run, f"id long, terms array<int>, tf array<int>, norm double, sketch array<long>{types}"), rarities


def similar_wholes(vectors: DataFrame, rarities, threshold: float, keys: tuple[str, ...] = (), among: DataFrame | None = None) -> DataFrame:
    """(a, b, cosine), like similar_pairs(), of whole_vectors() (id, terms, tf, norm, sketch, *keys) and what came with them;
    vectors are read more than once. among (id) are the vectors to be compared, if not all.

    Candidates share a term of both prefixes: terms from the rarest on, until what is left of a vector is shorter than
    threshold. No term that both have comes before the first, so that the product of the lengths from there on bounds the
    cosine; sketches rule out most of the others, which have a rare word in common. Pairs are then dealt out by the smallest candidate of one of them, and a vector travels once to each group that
    needs it: about once for a family of near copies, not once a pair.
    """
    from ..operators.tables import written

    least = threshold - 1e-5  # cosines are rounded to 5 digits

    def prefix(it):
        for batch in _slices(it):
            terms, tf = (batch.column(c) for c in ("terms", "tf"))
            cuts = np.concatenate(([0], np.cumsum(pc.list_value_length(terms).to_numpy())))
            terms, tf = pc.list_flatten(terms).to_numpy(), pc.list_flatten(tf).to_numpy()
            w = _weights(tf, rarities.value[terms]) / np.repeat(batch.column("norm").to_numpy(), np.diff(cuts))
            rest = [np.sqrt(np.cumsum(np.square(w[i:j])[::-1])[::-1]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            size = np.array([int((r >= least).sum()) for r in rest], dtype=np.int64)
            place = np.repeat(cuts[:-1], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            p = pa.StructArray.from_arrays([pa.array(terms[place]), pa.array(np.concatenate(rest)[place])], names=["term", "rest"])
            p = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), p)
            yield pa.RecordBatch.from_arrays([batch.column("id"), p, *(batch.column(c) for c in ("sketch", *keys))], names=["id", "p", "sketch", *keys])

    bits = [f"s{i}" for i in range(BITS // 64)]
    types = "".join(f", `{c}` {vectors.schema[c].dataType.simpleString()}" for c in keys)
    head = vectors.mapInArrow(prefix, f"id long, p array<struct<term:int,rest:double>>, sketch array<long>{types}")
    head = head.select("id", "p", *[F.col("sketch")[i].alias(c) for i, c in enumerate(bits)], *keys)
    head = head if among is None else head.join(among.select("id"), "id", "left_semi")
    head = written(head.select("id", F.explode("p").alias("p"), *bits, *keys).select("id", "p.*", *bits, *keys), "prefixes")
    x, y = (head.select(F.col("id").alias(c), "term", F.col("rest").alias(f"r{c}"), *[F.col(s).alias(c + s) for s in bits], *keys).hint("merge") for c in "ab")
    apart = sum((F.bit_count(F.col("a" + s).bitwiseXOR(F.col("b" + s))) for s in bits[1:]), F.bit_count(F.col("a" + bits[0]).bitwiseXOR(F.col("b" + bits[0]))))
    met = x.join(y, ["term", *keys]).filter((F.col("a") < F.col("b")) & (F.col("ra") * F.col("rb") >= least) & (apart <= _differing(least)))
    met = written(met.select("a", "b").distinct(), "met")
    family = met.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("least"))
    groups = 1 + met.count() // GROUP
    group = F.pmod(F.xxhash64(F.coalesce("least", "a")), F.lit(groups)).cast("int")
    pairs = written(met.join(family, "a", "left").select(group.alias("group"), "a", "b"), "pairs")
    needed = pairs.select(F.col("group").alias("to"), F.explode(F.array("a", "b")).alias("id")).distinct()
    sent = vectors.select("id", "terms", "tf", "norm").join(needed, "id")

    def run(pairs: pa.Table, sent: pa.Table) -> pa.Table:
        sent, pairs = sent.combine_chunks(), pairs.sort_by("a")
        at = {x: i for i, x in enumerate(sent["id"].to_pylist())}
        a, b = pairs["a"].to_pylist(), pairs["b"].to_pylist()
        dots = np.zeros(len(a))
        if at:
            lists = sent["terms"].combine_chunks()
            first = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
            terms, tf = (pc.list_flatten(sent[c].combine_chunks()).to_numpy() for c in ("terms", "tf"))
            w = _weights(tf, rarities.value[terms]) / np.repeat(sent["norm"].to_numpy(), np.diff(first))
            scratch, last = np.zeros(int(terms.max(initial=0)) + 1), None
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                if x != last:
                    if last is not None:
                        scratch[mine] = 0.0
                    span, last = slice(first[at[x]], first[at[x] + 1]), x
                    mine = terms[span]
                    scratch[mine] = w[span]
                span = slice(first[at[y]], first[at[y] + 1])
                dots[i] = scratch[terms[span]] @ w[span]
        return pa.table({"a": pairs["a"], "b": pairs["b"], "cosine": dots})

    dots = pairs.groupBy("group").cogroup(sent.groupBy("to")).applyInArrow(run, "a long, b long, cosine double")
    return dots.filter(F.round("cosine", 5) >= threshold)


def cosine(a: Column, b: Column) -> Column:
    """Of two unit vectors given as maps."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two lists as sets; 0 where either is empty."""
    whole = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / whole).otherwise(F.lit(0.0))


def composite(cosine_part: Column, entity_part: Column, s: Settings = DEFAULT) -> Column:
    return s.w_cosine * cosine_part + s.w_entity * entity_part


def assignment(similarity: Column, hours_apart: Column, share_topic: Column) -> Column:
    """Similarity with a bonus for closeness in time and for a common topic, 1 at most."""
    near = similarity * (1.0 + 0.10 * F.exp(-F.abs(hours_apart) / 12.0))
    return F.least(F.lit(1.0), F.when(share_topic, near * 1.04).otherwise(near))
