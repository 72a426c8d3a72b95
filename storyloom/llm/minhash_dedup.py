"""MinHash near-duplicate detection with odd sketches.

Each distinct shingle set gets BANDS * ROWS MinHash samples. Bands of ROWS samples bring candidates together; the same
samples, folded into a bitmap of parities (an odd sketch), tell by the population count of an XOR how many samples
differ, which rules out candidates far below the threshold; what remains is confirmed on the full shingle sets.

Where a group hangs together, work stays linear: a bucket first compares its members with its smallest one only. Pairs
of members are compared only in buckets whose members then still lie in different components, only across components,
and in the first band they share. Longer odd sketches tell which members of a bucket may link with another one there;
the full sets of these meet in the bucket and are compared in place, so that rows are members or links of a forest, never
pairs. No link between components can be lost this way, as a pair in one component adds nothing to it.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SEED, components, discard, materialise, mix, shingle_set, slices, small

ROWS = 6
BANDS = 48  # at a similarity of 0.8 a pair misses all bands with probability 5e-7
BITS = 1024  # of an odd sketch
MARGIN = 0.13  # how far below the threshold an estimate must lie to rule a pair out: five standard errors
FINE = 2048  # samples of the longer sketches
FINE_BITS = 8192
BLOCK = 2048  # rows of a bucket that are compared with as many others at a time
BROADCAST_IDS = 500_000  # ids up to which the texts they need are found by a broadcast
FINE_MARGIN = 0.05  # five standard errors of the longer sketches
SHINGLES = 1 << 21  # of the sets that a block of full sets holds, about

def _maps(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, count, dtype=np.uint32)


_COARSE_MAPS, _FINE_MAPS = _maps(BANDS * ROWS, SEED + 1), _maps(FINE, SEED + 2)


def minhash(shingles: np.ndarray, maps: tuple[np.ndarray, np.ndarray] = _COARSE_MAPS) -> np.ndarray:
    """One sample for each map of a non-empty set of 64-bit hashes."""
    multiply, flip = (x[:, None] for x in maps)
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(multiply), 0xFFFFFFFF, dtype=np.uint32)
    step = max(32, (1 << 18) // len(out))
    for i in range(0, len(x), step):
        np.minimum(out, ((x[None, i : i + step] * multiply) ^ flip).min(axis=1), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different bands having different keys."""
    parts = samples.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key + parts[:, i])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The parity bitmap of the samples, as bits / 64 numbers."""
    slots = mix(np.arange(len(samples), dtype=np.uint64) + np.uint64(SEED))
    at = (mix(samples.astype(np.uint64) ^ slots) >> np.uint64(20)) % np.uint64(bits)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.int64)


def _flips(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The population counts of the XOR of odd sketches; of signed numbers numpy would count the magnitude's bits."""
    return np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def differing_bits(similarity: float, samples: int = BANDS * ROWS, bits: int = BITS) -> float:
    """The expected population count of the XOR of two odd sketches."""
    flips = 2 * samples * (1 - similarity)
    return bits * (1 - (1 - 2 / bits) ** flips) / 2


def sketches(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, n, digest, bands, odd) for each row: a hash of its text, size and digest of its shingle set, band keys and
    odd sketch."""

    def run(it):
        for batch in slices(it):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            n, digest, bands, odd = [], [], [], []
            for t in texts:
                s = shingle_set(t, words)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if len(s):
                    m = minhash(s)
                    bands.append(band_keys(m))
                    odd.append(odd_sketch(m))
                else:
                    bands.append([])
                    odd.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))], names=["id", "row", "n", "digest", "bands", "odd"])

    return _marked(docs, id_col, text_col).mapInArrow(run, "id long, row long, n long, digest binary, bands array<long>, odd array<long>")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, text): rows that share an id are told apart by a hash of the text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))


def _may_match(threshold: float, a: str = "a", b: str = "b") -> Column:
    """Sizes and odd sketches allow a similarity of threshold."""
    most = math.floor(differing_bits(threshold - MARGIN))
    flips = sum((F.bit_count(F.col(f"{a}.odd")[i].bitwiseXOR(F.col(f"{b}.odd")[i])) for i in range(BITS // 64)), F.lit(0))
    sizes = F.least(f"{a}.n", f"{b}.n") >= F.greatest(f"{a}.n", f"{b}.n") * F.lit(threshold - 1e-9)
    return sizes & (flips <= most)


def _fine_sketches(texts: DataFrame, words: int) -> DataFrame:
    """(node, fine) for rows (node, text)."""

    def run(it):
        for batch in slices(it):
            nodes, fine = [], []
            for node, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                s = shingle_set(t, words)
                if len(s):
                    nodes.append(node)
                    fine.append(odd_sketch(minhash(s, _FINE_MAPS), FINE_BITS))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(fine, pa.list_(pa.int64()))], names=["node", "fine"])

    return texts.select("node", "text").mapInArrow(run, "node long, fine array<long>")


def _tiles(rows: DataFrame) -> DataFrame:
    """Rows (key, m, shingles, band, node, component) of buckets of m rows and so many shingles as (key, i, j, block, ...):
    a bucket of many blocks is dealt into pairs of blocks, so that a task holds two blocks of BLOCK rows and SHINGLES
    shingles at most, or little more."""
    dealt = rows.withColumn("blocks", F.ceil(F.greatest(F.col("m") / F.lit(BLOCK), F.col("shingles") / F.lit(SHINGLES))).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    return dealt.withColumn("tile", F.explode(pairs)).select("key", F.col("tile.i").alias("i"), F.col("tile.j").alias("j"), "block", "band", "node", "component")


def _by_tile(rows: DataFrame, compare, schema: str) -> DataFrame:
    """What compare makes of the rows (key, i, j, ...) of each tile: a function of a table that gives a record batch."""

    def run(it):
        held: list[pa.RecordBatch] = []
        last = None

        def done():
            t = pa.Table.from_batches(held)
            held.clear()
            return [compare(t)] if t.num_rows > 1 else []

        for batch in it:
            marks = list(zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j")), strict=True))
            start = 0
            for at, mark in enumerate(marks):
                if mark != last:
                    if at > start:
                        held.append(batch.slice(start, at - start))
                    if held:
                        yield from done()
                    start, last = at, mark
            held.append(batch.slice(start))
        if held:
            yield from done()

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


def _wide(t: pa.Table, column: str) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return np.asarray(t[column].combine_chunks().flatten()).reshape(t.num_rows, -1)


def _likely(tiles: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(key, band, node, component, n) of the members of a bucket that meet in it, as the first band they share, one of
    another component which they may match by sizes and both odd sketches. nodes has (node, n, bands, odd, fine)."""
    coarse = math.floor(differing_bits(threshold - MARGIN))
    fine = math.floor(differing_bits(threshold - FINE_MARGIN, FINE, FINE_BITS))

    def compare(t: pa.Table) -> pa.RecordBatch:
        wide = {c: _wide(t, c) for c in ("bands", "odd", "fine")}
        component, n, block = (np.asarray(t[c].combine_chunks()) for c in ("component", "n", "block"))
        band, i, j = t["band"][0].as_py(), t["i"][0].as_py(), t["j"][0].as_py()
        rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
        met = np.zeros(t.num_rows, dtype=bool)
        for s in range(0, len(rows), 64):  # a strip of pairs at a time
            r = rows[s : s + 64]
            open_ = component[r][:, None] != component[cols][None]
            if i == j:
                open_ &= r[:, None] < cols[None]
            lo, hi = np.minimum(n[r][:, None], n[cols][None]), np.maximum(n[r][:, None], n[cols][None])
            x, y = np.nonzero(open_ & (lo >= hi * (threshold - 1e-9)))
            x, y = r[x], cols[y]
            for ok in (
                lambda x, y: _flips(wide["odd"][x], wide["odd"][y]) <= coarse,
                lambda x, y: ~(wide["bands"][x, :band] == wide["bands"][y, :band]).any(axis=1),
                lambda x, y: _flips(wide["fine"][x], wide["fine"][y]) <= fine,
            ):
                good = ok(x, y)
                x, y = x[good], y[good]
            met[x] = met[y] = True
        return t.select(names).filter(pa.array(met)).combine_chunks().to_batches()[0] if met.any() else none

    names = ["key", "band", "node", "component", "n"]
    none = pa.RecordBatch.from_arrays([pa.array([], pa.int32() if c == "band" else pa.int64()) for c in names], names=names)
    return _by_tile(tiles.join(nodes, "node"), compare, "key long, band int, node long, component long, n long").distinct()


def _forest(tiles: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links between members of a bucket that connect all that is linked in it beyond its components, found on
    their full shingle sets. Two members are compared in the first band they share, unless links found in the tile already
    connect them, the likeliest first; odd sketches rule others out. nodes has (node, n, bands, odd, text).
    """
    threshold = percent / 100
    coarse = math.floor(differing_bits(threshold - MARGIN))

    def compare(t: pa.Table) -> pa.RecordBatch:
        bands, odd = _wide(t, "bands"), _wide(t, "odd")
        node, label, n, block = (np.array(t[c].combine_chunks()) for c in ("node", "component", "n", "block"))
        band, i, j = t["band"][0].as_py(), t["i"][0].as_py(), t["j"][0].as_py()
        sets = [shingle_set(x.cast(pa.binary()).as_py(), words) for x in t["text"]]
        ends = np.cumsum([0, *map(len, sets)])
        numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]  # of all shingles, end to end
        sets.clear()
        mine = np.zeros(len(numbers), dtype=bool)
        cols = np.flatnonzero(block == j)
        a, b = [], []
        for r in np.flatnonzero(block == i):
            y = cols[cols > r] if i == j else cols
            y = y[(label[y] != label[r]) & (np.minimum(n[y], n[r]) >= np.maximum(n[y], n[r]) * (threshold - 1e-9))]
            y = y[~(bands[y, :band] == bands[r, :band]).any(axis=1)]
            flips = _flips(odd[y], odd[r])
            y = y[np.argsort(flips, kind="stable")][: np.count_nonzero(flips <= coarse)]
            if not len(y):
                continue
            own = numbers[ends[r] : ends[r + 1]]
            mine[own] = True
            for o in y:
                if label[o] != label[r]:
                    both = np.count_nonzero(mine[numbers[ends[o] : ends[o + 1]]])
                    if 100 * both >= percent * (n[o] + n[r] - both):
                        label[label == label[o]] = label[r]
                        a.append(max(node[o], node[r]))
                        b.append(min(node[o], node[r]))
            mine[own] = False
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _by_tile(tiles.join(nodes, "node"), compare, "a long, b long").distinct()


def _texts_of(ids: DataFrame, nodes: DataFrame, texts: DataFrame, own: bool) -> DataFrame:
    """(node, text) of the nodes among ids (node), from texts (id, row, text); ids is read more than once. own says that
    no two rows share an id."""
    wanted = nodes.join(ids, "node", "left_semi").select("node", F.col("id").alias("i"), F.col("row").alias("r"))
    wanted = F.broadcast(wanted) if small(ids, BROADCAST_IDS) else wanted
    if own:
        return texts.join(wanted, F.col("id") == F.col("i")).select("node", "text")
    found = texts.join(wanted, F.col("id").eqNullSafe(F.col("i")) & (F.col("row") == F.col("r"))).select("node", "text")
    return found.dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, texts_of, words: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose full shingle sets have 100 * |intersection| >= percent * |union|; texts_of gives
    the texts (node, text) of nodes (node)."""

    def run(it):
        kept: dict[bytes, np.ndarray] = {}

        def of(t):
            if t not in kept:
                if len(kept) > 64:
                    kept.clear()
                kept[t] = shingle_set(t, words)
            return kept[t]

        for batch in slices(it):
            ta, tb = (batch.column(i).cast(pa.binary()).to_pylist() for i in (2, 3))
            good = []
            for x, y in zip(ta, tb, strict=True):
                x, y = of(x), of(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            out = pa.Table.from_batches([batch]).select([0, 1]).filter(pa.array(good))
            yield from out.to_batches()

    pairs = materialise(pairs, "pairs")
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ids")
    texts = texts_of(ids)
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
    out = materialise(joined.mapInArrow(run, "a long, b long").distinct(), "links")
    discard(pairs, ids)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, row, first) for each row of docs.

    Rows whose sets of `words`-word shingles have a Jaccard similarity of at least percent / 100 are linked;
    component_id is the smallest id reachable over links, kept says whether a row has that id itself.

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing. Rows that share an id
    are compared and placed each by its own text; `row`, a hash of the text, tells them apart. A row with a null id takes
    part by its text; where no row of a component has an id, component_id is null and all are kept. `first` is true for one
    text of each component, that of the smallest id, then of the smallest `row`; null ids come last. Other columns are
    ignored. An empty table gives an empty result.
    """
    threshold = percent / 100
    texts = _marked(docs, id_col, text_col)
    own = texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").isEmpty()
    all_rows = materialise(sketches(docs, words, id_col, text_col), "sketches")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    sets = all_rows.filter("n > 0").groupBy("digest").agg(F.min(rank).alias("least"), F.first(F.struct("n", "bands", "odd")).alias("s"))
    # A number for each distinct set stands for it in links.
    nodes = materialise(sets.select(F.monotonically_increasing_id().alias("node"), "digest", "least.*", "s.*"), "nodes")

    banded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = materialise(banded.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("key", "centre"), "buckets")
    members = materialise(banded.join(buckets, "key"), "members")

    def texts_of(ids: DataFrame) -> DataFrame:
        return _texts_of(ids, nodes, texts, own)

    def confirm(pairs: DataFrame) -> DataFrame:
        """The links among distinct pairs (a, b) of nodes."""
        x, y = (nodes.select(F.col("node").alias(c), F.struct("n", "odd").alias(f"s{c}")) for c in "ab")
        likely = pairs.join(x, "a").join(y, "b").filter(_may_match(threshold, "sa", "sb")).select("a", "b")
        return _confirmed(likely, texts_of, words, percent)

    def still_open(place: DataFrame) -> DataFrame:
        """Members, with their components, of buckets that hold more than one component, and the buckets' sizes."""
        placed = members.join(place, "node", "left").withColumn("component", F.coalesce("component", "node"))
        keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo <> hi").select("key", "m", F.lit(0).alias("shingles"))
        return materialise(placed.select("key", "band", "node", "component").join(keys, "key"), "open")

    def joined(place: DataFrame, links: DataFrame) -> DataFrame:
        """Components with further links."""
        if links.isEmpty():
            return place
        known = place.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        out = components(known.unionByName(links))
        discard(place)
        return out

    links = confirm(members.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct())
    place = components(links)
    discard(links)

    rows = still_open(place)
    wanted = materialise(rows.select("node").distinct(), "ids")
    fine = materialise(_fine_sketches(texts_of(wanted), words), "fine")
    # Half of a band's key tells shared bands well enough: a wrong match has a probability of 1e-8.
    slim = nodes.select("node", "n", F.transform("bands", lambda k: F.shiftright(k, 32).cast("int")).alias("bands"), "odd")
    likely = materialise(_likely(_tiles(rows), slim.join(fine, "node"), threshold), "likely")
    near = materialise(likely.select("node").distinct(), "ids")
    sized = likely.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"))
    links = materialise(_forest(_tiles(likely.join(sized, "key")), slim.join(texts_of(near), "node"), words, percent), "links")
    place = joined(place, links)

    placed = nodes.select("node", "digest", F.struct("none", "id", "row").alias("least")).join(place, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = placed.groupBy("component").agg(F.min("least").alias("best"))
    placed = materialise(placed.join(best, "component").select("digest", "best"), "placed")
    discard(links, likely, near, rows, members, buckets, nodes, fine, wanted, place)
    out = all_rows.filter("n > 0").join(placed, "digest").select("id", "row", "n", F.col("best.id").alias("component"), (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("row") == F.col("best.row"))).alias("first"))
    out = out.unionByName(all_rows.filter("n = 0").select("id", "row", "n", F.col("id").alias("component"), F.lit(True).alias("first")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.col("component").isNull()).alias("kept"), "row", "first")
