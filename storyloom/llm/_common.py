"""What the operators share: tables in the cluster's shared folder, word hashing, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 20240229


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def slices(batches, rows: int = 256):
    """Arrow batches cut into ones of `rows` rows at most, so that what Python makes of one stays small. Spark bounds the
    bytes of a batch itself."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, which all executors see.

    Only where the driver's own process runs the tasks, as in tests, may the setting be missing: then it is a folder of
    this machine. On a cluster its absence is an error, as tables would end up where other machines don't find them.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.gettempdir()
    return f"{named.rstrip('/')}/storyloom-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here and survives lost executors.

    Tables that a lazy result still reads stay until sweep(); all others are deleted by discard().
    """
    spark = session(df)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._storyloom_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that this application wrote for its operators. Their lazy results can't be read any more."""
    _delete(spark, shared_dir(spark))


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote and nothing reads any more."""
    for df in tables:
        path = getattr(df, "_storyloom_path", None)
        if path:
            _delete(session(df), path)


def small(df: DataFrame, most_rows: int) -> bool:
    """Whether df has at most most_rows rows; reads no more than that."""
    return df.limit(most_rows + 1).count() <= most_rows


def spread(df: DataFrame) -> DataFrame:
    """A table dealt out to all cores where its files make fewer tasks than there are cores, as one small file does; any
    other stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unit_hash(*parts: Column, seed: int) -> Column:
    """A number in [0, 1) from md5, the same in any engine that has md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *parts)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


# --- word hashing ---------------------------------------------------------------------------------------------------

_RNG = np.random.default_rng(SEED)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(name: str, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        base = _BASE if name == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of UTF-8 text: 64 bits, a polynomial over its bytes, scrambled; offsets in bytes."""
    raw = np.frombuffer(text, dtype=np.uint8)
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64), starts, ends
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[raw] * _power("up", len(raw)), dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * _power("down", len(raw))[starts]), starts, ends


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash for each word of UTF-8 text."""
    return words_of(text)[0]


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z lower-cased; a shorter text is one shingle."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    each = word_hashes(text.lower())
    if not len(each):
        return each
    k = min(words, len(each))
    n = len(each) - k + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * _STEP + each[i : i + n]
    return np.unique(mix(out + np.uint64(k)))


# --- connected components -------------------------------------------------------------------------------------------


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of edges (a, b).

    Alternates large-star and small-star steps until nothing changes. A step aggregates before it shuffles and joins on
    plain keys, so that a hub with a third of all edges is split by adaptive execution.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _print(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        step = large.join(lower, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        then = materialise(step.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(now)
        now, was, seen = then, seen, _print(then)
        if seen == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = materialise(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "components")
    discard(now)
    return out


def _print(edges: DataFrame) -> tuple:
    """A fingerprint of a set of edges: its size and two sums of hashes."""
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 20)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))).first()
    return tuple(row)
