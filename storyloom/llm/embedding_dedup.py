"""Euclidean p-stable hashing of embeddings, with exact cosine checks.

Vectors are normalised; equal ones of a label collapse to one with a count. Each of TABLES tables concatenates HASHES
quantised Gaussian projections floor((a.x + b) / WIDTH) into a bucket. All pairs within a bucket are compared in double
precision, block by block, and counted in the first table that brings them together, so nothing is emitted per pair but
a spanning forest of each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SEED, components, discard, materialise, mix, slices

TABLES = 80  # at a cosine of 0.93 a pair shares a bucket with probability 0.99, at 0.95 with 0.9997
HASHES = 10
WIDTH = 1.2
BLOCK = 1024


def projections(dims: int, tables: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Directions (dims x tables * hashes) and offsets, the same for every call."""
    rng = np.random.default_rng([SEED, dims, tables, hashes])
    return rng.standard_normal((dims, tables * hashes)), rng.uniform(0, width, tables * hashes)


def bucket_keys(unit: np.ndarray, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH) -> np.ndarray:
    """A 64-bit bucket for each vector and table."""
    a, b = projections(unit.shape[1], tables, hashes, width)
    cells = np.floor((unit @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(unit), tables, hashes)
    key = np.tile(np.arange(1, tables + 1, dtype=np.uint64), (len(unit), 1))
    for i in range(hashes):
        key = mix(key + cells[:, :, i])
    return key.view(np.int64)


def _read(it):
    """Rows of (id, label, vector) to ones with the vector's bytes and its buckets; unusable vectors have neither."""
    for batch in slices(it, 2048):
        ids, labels, vectors = (batch.column(i) for i in range(3))
        raw, keys = [None] * len(ids), [None] * len(ids)
        by_size: dict[int, list] = {}
        for i, (usable, v) in enumerate(zip(labels.is_valid().to_pylist(), vectors.to_pylist(), strict=True)):
            if not usable or not v or any(x is None for x in v):
                continue
            x = np.asarray(v, dtype=np.float64)
            if np.isfinite(x).all() and x.any():
                by_size.setdefault(len(x), []).append((i, x))
        for rows in by_size.values():
            x = np.array([r[1] for r in rows]) + 0.0  # no negative zeros
            unit = x / np.abs(x).max(axis=1, keepdims=True)
            unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
            for (i, _), row, u, k in zip(rows, x, unit, bucket_keys(unit), strict=True):
                raw[i], keys[i] = u.tobytes(), k
        yield pa.RecordBatch.from_arrays([ids, labels, pa.array(raw, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "label", "unit", "keys"])


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Which of the links (a, b) between n rows a spanning forest needs."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            keep.append(i)
    return keep


def _links(threshold: float, table: int, same: bool, x: tuple, y: tuple) -> tuple[list, list, list]:
    """Columns a, b, links for two blocks of a bucket, each (nodes, copies, unit vectors): link counts of each node, with
    b of -1, and a forest of links, with counts of 0."""
    (nodes_x, m_x, ux), (nodes_y, m_y, uy) = x, y
    if ux.shape[1] != uy.shape[1]:
        return [], [], []
    near = (ux @ uy.T) >= threshold
    if same:
        near = np.triu(near, 1)
    r, c = np.nonzero(near)
    if table and len(r):  # a pair counts in the first table that brings it together
        kx = bucket_keys(ux)[:, :table]
        ky = kx if same else bucket_keys(uy)[:, :table]
        first = np.concatenate([~(kx[r[s : s + 65536]] == ky[c[s : s + 65536]]).any(axis=1) for s in range(0, len(r), 65536)])
        r, c = r[first], c[first]
    if not len(r):
        return [], [], []
    gain_x = np.bincount(r, weights=m_y[c], minlength=len(ux)).astype(np.int64)
    gain_y = np.bincount(c, weights=m_x[r], minlength=len(uy)).astype(np.int64)
    keep = _forest(r, c + (0 if same else len(ux)), len(ux) + len(uy))
    a, links = [*nodes_x[gain_x > 0], *nodes_y[gain_y > 0]], [*gain_x[gain_x > 0], *gain_y[gain_y > 0]]
    b = [-1] * len(a)
    return a + list(nodes_x[r[keep]]), b + list(nodes_y[c[keep]]), links + [0] * len(keep)


def _compare(threshold: float):
    """Tiles, sorted by (label, t, key, i, j, block), to links; a tile has two blocks of a bucket at most."""

    def tile(rows: list[tuple]) -> pa.RecordBatch:
        t, i, j = rows[0][1], rows[0][3], rows[0][4]

        def block(k):
            part = [r for r in rows if r[5] == k]
            size = len(part[0][7]) if part else 0
            part = [r for r in part if len(r[7]) == size]
            return np.array([r[6] for r in part], dtype=np.int64), np.array([r[8] for r in part], dtype=np.int64), np.frombuffer(b"".join(r[7] for r in part)).reshape(len(part), -1) if part else None

        x = block(i)
        y = x if i == j else block(j)
        cols = ([], [], []) if x[2] is None or y[2] is None else _links(threshold, t, i == j, x, y)
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, dtype=np.int64)) for c in cols], names=["a", "b", "links"])

    def run(it):
        held: list[tuple] = []
        for batch in it:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:5] != held[-1][:5]:
                    if len(held) > 1:
                        yield tile(held)
                    held = []
                held.append(row)
        if len(held) > 1:
            yield tile(held)

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Rows with labels that are equal, in their own type, are linked where the cosine of their vectors, in double precision, is at least threshold.
    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without a label, link with
    nothing; vectors of different lengths don't link. Copies count as links of each other. Rows that share an id count
    as different rows. A null id takes part by its vector. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    read = materialise(rows.mapInArrow(_read, f"id long, label {rows.schema['label'].dataType.simpleString()}, unit binary, keys array<long>"), "vectors")
    usable = read.filter("unit is not null")
    distinct = usable.groupBy("label", "unit").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"))
    # A dense number for each distinct vector stands for it in links, as ids may be null or repeated.
    nodes = materialise(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")

    spread = nodes.select("node", "label", F.length("unit").alias("size"), F.posexplode("keys").alias("t", "key"))
    sizes = materialise(spread.groupBy("label", "t", "key", "size").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "buckets")
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    placed = spread.join(sizes, ["label", "t", "key", "size"]).withColumn("blocks", blocks)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    tiles = placed.withColumn("tile", F.explode(others)).select("label", "t", "key", F.col("tile.i").alias("i"), F.col("tile.j").alias("j"), "block", "node")
    tiles = tiles.join(nodes.select("node", "unit", "copies"), "node").select("label", "t", "key", "i", "j", "block", "node", "unit", "copies")
    tiles = tiles.repartition("label", "t", "key", "i", "j").sortWithinPartitions("label", "t", "key", "i", "j", "block")
    found = materialise(tiles.mapInArrow(_compare(threshold), "a long, b long, links long"), "found")

    counts = found.filter("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    place = components(found.filter("b >= 0").select("a", "b"))
    least = nodes.join(place, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = least.groupBy("component").agg(F.min("least").alias("component_id"))
    result = materialise(least.join(smallest, "component").join(counts, "node", "left").select("label", "unit", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "result")
    discard(sizes, found, nodes, place)
    out = read.join(result, ["label", "unit"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))
