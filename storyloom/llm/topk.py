"""Exact top-k inner products over vectors sorted by length.

Candidates are sorted by descending length and stay where they are. Queries pass them in groups of bounded size, each
broadcast to all tasks. A task walks its candidates from the longest on; it leaves out those that the Cauchy-Schwarz
bound |q||v| keeps below a query's k-th best score so far, then those whose partial product over the leading directions
of an SVD rotation plus the bound on the rest stays below. The longest vectors of all come first, for their k-th best
scores are floors everywhere else. Scores are exact integers.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import discard, materialise, session, shared_dir, slices

GROUP_BYTES = 32 << 20  # of the queries that are broadcast together
HEAD = 4096  # longest vectors, about, that give floors
STEP = 512  # candidates that are compared at a time
LENGTHS, WIDEST = 16, 1024  # numbers of components that get a rotation: the most usual ones, up to a width
LEADING = 0.9  # share of the squared length that the leading directions hold
SLACK = 1e-6  # relative; far above what rounding of a bound can amount to
EXACT = 2.0**52  # products below this are exact in double precision
MOST = 2.0**500  # of a component
LONG = (1 << 63) - 1


def quantise(vector, scale: float) -> list[int] | None:
    """floor(scale * x) for each component, MOST at most, or None for a vector that is null or has null or non-finite
    components."""
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(min(max(scale * x, -MOST), MOST)) for x in vector]


def _quantised(scale: float):
    def run(it):
        for batch in slices(it, 2048):
            rows = []
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key is None or v is None or None in v:
                    continue
                x = np.array(v, dtype=np.float64)
                if np.isfinite(x).all():
                    with np.errstate(over="ignore"):
                        x = np.floor(np.clip(scale * x, -MOST, MOST))  # an integer, which a double holds exactly
                    rows.append((key, x.tobytes(), float(np.sqrt((x * x).sum())), len(x)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.float64(), pa.int32()), strict=True)], names=["id", "v", "norm", "dims"])

    return run


def _matrix(parts: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(parts), dtype=np.float64).reshape(len(parts), dims)


def _grams(lengths: dict[int, float]):
    """Sums of v v^T, each v in parts of the longest one, one row for each of the lengths in a task."""

    def run(it):
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            by: dict[int, list] = {}
            for v, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(n, []).append(v)
            for n, rows in by.items():
                x = _matrix(rows, n) / max(lengths[n], 1.0)
                sums[n] = sums.get(n, 0) + x.T @ x
        for n, g in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([g.ravel().tolist()], pa.list_(pa.float64()))], names=["dims", "gram"])

    return run


def _rotations(rows: DataFrame, longest: dict[int, float]) -> dict[int, tuple[np.ndarray, int]]:
    """For each number of components in longest an orthogonal matrix, strongest directions first, and how many lead."""
    total = {n: np.zeros(n * n) for n in longest}
    parts = rows.filter(F.col("dims").isin(*longest)).select("v", "dims").mapInArrow(_grams(longest), "dims int, gram array<double>")
    parts = parts.select("dims", F.posexplode("gram").alias("at", "x")).groupBy("dims", "at").agg(F.sum("x").alias("x"))
    for r in parts.toLocalIterator():  # WIDEST squared numbers for each of LENGTHS lengths, however many vectors there are
        total[r.dims][r.at] = r.x
    out = {}
    for n, g in total.items():
        u, s, _ = np.linalg.svd(g.reshape(n, n))
        out[n] = (u, int(np.searchsorted(np.cumsum(s), LEADING * s.sum())) + 1)
    return out


def _order(score: int) -> bytes | None:
    """What orders scores beyond 64 bits, as unsigned bytes; None for any other."""
    if -LONG - 1 <= score <= LONG:
        return None
    raw = abs(score).to_bytes(256, "big")
    return b"\1" + raw if score > 0 else b"\0" + bytes(255 - b for b in raw)


class Group:
    """Queries of one number of components and their best scores so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int, rotation):
        n = q.shape[1]
        self.ids, self.q, self.k, self.floor = ids, q, k, floors.copy()
        self.u, self.lead = rotation or (None, n)
        self.length = np.sqrt((q * q).sum(axis=1))
        self.rotated = q @ self.u if rotation else q
        self.rest = np.sqrt((self.rotated[:, self.lead :] ** 2).sum(axis=1))
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id)

    def _exact(self, queries: np.ndarray, v: np.ndarray, most: float) -> np.ndarray:
        q = self.q[queries]
        if most < EXACT:
            return np.rint(q @ v.T).astype(np.int64)
        if most < 2.0**62:
            return q.astype(np.int64) @ v.T.astype(np.int64)
        whole = [[int(x) for x in row] for row in v]
        return np.array([[sum(a * b for a, b in zip(map(int, row), w, strict=True)) for w in whole] for row in q], dtype=object).reshape(len(q), len(whole))

    def meet(self, ids: np.ndarray, v: np.ndarray, length: np.ndarray) -> None:
        """Take in candidates, the longest first."""
        order = np.argsort(-length, kind="stable")
        ids, v, length = ids[order], v[order], length[order]
        for s in range(0, len(ids), STEP):
            e = min(s + STEP, len(ids))
            slack = SLACK * self.length * length[s] + 1.0
            alive = np.flatnonzero(self.length * length[s] + slack >= self.floor)
            if not len(alive):
                return
            rotated = v[s:e] @ self.u if self.u is not None else v[s:e]
            rest = np.sqrt((rotated[:, self.lead :] ** 2).sum(axis=1))
            bound = self.rotated[alive, : self.lead] @ rotated[:, : self.lead].T + np.outer(self.rest[alive], rest) + slack[alive, None]
            may = bound >= self.floor[alive, None]
            cols, used = np.flatnonzero(may.any(axis=0)), np.flatnonzero(may.any(axis=1))
            if not len(cols):
                continue
            exact = self._exact(alive[used], v[s:e][cols], float(self.length.max() * length[s]))
            here = ids[s:e][cols]
            for i, r in enumerate(alive[used]):
                good = may[used[i], cols] & (here != self.ids[r])
                scores, found = exact[i, good], here[good]
                if scores.dtype != object and len(scores) > 4 * self.k:  # the best of many: ties go on to the exact order
                    keep = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
                    scores, found = scores[keep], found[keep]
                both = sorted([*self.best[r], *((-int(x), int(y)) for x, y in zip(scores, found, strict=True))])[: self.k]
                self.best[r] = both
                if len(both) == self.k:
                    self.floor[r] = max(self.floor[r], float(-both[-1][0]))


def _search(groups, k: int):
    """groups: a broadcast of (queries, rotations); queries is (ids, matrix, floors) by number of components."""

    def run(it):
        asked, rotations = groups.value
        state = {n: Group(ids, q, floors, k, rotations.get(n)) for n, (ids, q, floors) in asked.items()}
        for batch in it:
            ids, v, norm, dims = (batch.column(c) for c in ("id", "v", "norm", "dims"))
            dims = np.asarray(dims)
            for n in np.unique(dims):
                if int(n) in state:
                    at = np.flatnonzero(dims == n)
                    state[int(n)].meet(np.asarray(ids)[at], _matrix(v.take(pa.array(at)).to_pylist(), int(n)), np.asarray(norm)[at])
        for n, group in state.items():
            least = asked[n][2]
            rows = [(int(q), i, -s) for q, best, f in zip(group.ids, group.best, least, strict=True) for s, i in best if float(-s) >= f]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            scores = [min(max(s, -LONG - 1), LONG) for s in cols[2]]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(scores, pa.int64()), pa.array([_order(s) for s in cols[2]], pa.binary())], names=["query_id", "vec_id", "score", "beyond"])

    return run


def top_inner_products(vectors: DataFrame, queries, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row with all other rows.

    queries is a condition on the id column. Components count as floor(scale * x), within 2^500 either way. Ties go to
    the smaller id. Scores are ranked exactly whatever their size; one that doesn't fit in 64 bits is given as the nearest
    number that does. Vectors that are null or hold null or non-finite components, and rows with a null id, take no part;
    a query meets vectors of its own number of components, vectors without any among them. Of rows that share an id, each
    is a candidate, and none of them meets its own id; as queries they are one, with the best of all. An empty table, or
    no query, gives an empty result. Other columns are ignored.
    """
    spark = session(vectors)
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = materialise(src.mapInArrow(_quantised(scale), "id long, v binary, norm double, dims int"), "quantised")
    usual = rows.filter(F.col("dims").between(1, WIDEST)).groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest"))
    usual = usual.orderBy(F.col("n").desc(), "dims").limit(LENGTHS).collect()
    rotations = _rotations(rows, {r.dims: r.longest for r in usual}) if usual else {}
    order = ("dims", F.col("norm").desc(), "id")
    candidates = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order), "candidates")
    # From which length on a vector is among the longest, by its number of components.
    cut = F.lit(None).cast("double")
    for r in usual:
        share = max(0.0, 1.0 - HEAD / r.n)
        at = rows.filter(F.col("dims") == r.dims).agg(F.percentile_approx("norm", share, 100_000)).first()[0]
        cut = F.when(F.col("dims") == r.dims, F.lit(at)).otherwise(cut)
    head = F.coalesce(F.col("norm") >= cut, F.lit(False))

    asked = rows.withColumnRenamed("id", id_col).filter(queries).withColumnRenamed(id_col, "id").select("id", "v", "dims")
    size = asked.agg(F.sum(F.length("v") + 64)).first()[0] or 0
    groups = -(-size // GROUP_BYTES)
    asked = materialise(asked.withColumn("group", F.pmod(F.monotonically_increasing_id(), F.lit(max(groups, 1)))), "queries")
    schema = "query_id long, vec_id long, score long, beyond binary"
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id"))
    ranked = f"{schema}, rank int"
    out = f"{shared_dir(spark)}/top-{uuid.uuid4().hex}"
    spark.createDataFrame([], ranked).write.parquet(out)
    for g in range(groups):
        by: dict[int, tuple[list, list]] = {}
        for r in asked.filter(F.col("group") == g).collect():  # about GROUP_BYTES
            ids, parts = by.setdefault(r.dims, ([], []))
            ids.append(r.id)
            parts.append(bytes(r.v))
        group = {n: (np.array(ids, dtype=np.int64), _matrix(parts, n), np.full(len(ids), -np.inf)) for n, (ids, parts) in by.items()}
        told = spark.sparkContext.broadcast((group, rotations))
        first = materialise(candidates.filter(head).mapInArrow(_search(told, k), schema), "first")
        best = first.withColumn("rank", rank).filter(F.col("rank") == k).select("query_id", "score").collect()  # a row a query
        floors = {r.query_id: float(r.score) if abs(r.score) < LONG else -np.inf for r in best}
        group = {n: (ids, q, np.array([floors.get(i, -np.inf) for i in ids.tolist()])) for n, (ids, q, _) in group.items()}
        told = spark.sparkContext.broadcast((group, rotations))
        rest = candidates.filter(~head).mapInArrow(_search(told, k), schema)
        both = first.unionByName(rest).withColumn("rank", rank).filter(F.col("rank") <= k)
        both.write.mode("append").parquet(out)
        told.unpersist()
        discard(first)
    discard(rows, asked, candidates)
    return spark.read.schema(ranked).parquet(out).select("query_id", "rank", "vec_id", "score")
