"""Compression classifier: how well a text compresses with a dictionary of good texts against one of bad texts.

Two zstandard dictionaries are trained on labelled texts. A text is cut into chunks, so that the dictionaries count over
its whole length. The difference of the two compressed sizes, divided by the plain size, is all that a score depends on:
a rising curve fitted to labelled texts that neither dictionary was trained on turns it into a probability.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialise, session

SAMPLE = 3000  # labelled rows of each class that are learned from at most; half train a dictionary, half calibrate
SAMPLE_BYTES = 16 << 20  # of the texts of a class that train its dictionary: rows in the order drawn, as many as fit whole
DICTIONARY = 1 << 16  # bytes of a dictionary
PIECE = 512  # bytes of the samples that the training is given
CHUNK = 512
LEVEL = 3
SMOOTH = 0.1  # share of the logistic curve in a score, which keeps it rising where the isotonic one is level


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    logistic: tuple[float, float]  # intercept and slope
    curve: tuple[tuple[float, float], ...] = ()  # differences and probabilities of the isotonic curve

    def probability(self, d: np.ndarray) -> np.ndarray:
        """The score of normalised differences."""
        a, b = self.logistic
        smooth = 1 / (1 + np.exp(-np.clip(a + b * d, -30, 30)))
        if not self.curve:
            return smooth
        x, y = np.array(self.curve).T
        return SMOOTH * smooth + (1 - SMOOTH) * np.interp(d, x, y)


def _compressors(model: Model):
    out = []
    for raw in (model.good or b"-", model.bad or b"-"):
        d = zstandard.ZstdCompressionDict(raw)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
        d.precompute_compress(compression_params=params)
        out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
    return out


def difference(text: bytes, compressors) -> float:
    """The normalised difference of the compressed sizes of a whole text: above 0 where the good dictionary helps more."""
    good, bad = (sum(len(c.compress(text[i : i + CHUNK])) for i in range(0, len(text), CHUNK)) for c in compressors)
    return (bad - good) / max(len(text), 1)


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on whole texts; the texts themselves where they are too few or short for that."""
    if sum(map(len, texts)) > 2 * DICTIONARY:
        try:
            return zstandard.train_dictionary(DICTIONARY, [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"\n".join(texts)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope of a weighted logistic regression by Newton's method."""
    x = np.stack((np.ones(len(x)), x), axis=1)
    w, penalty = np.zeros(2), ridge * np.diag([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(2), x.T @ (weight * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, float], ...]:
    """Points of a rising curve: neighbours are pooled until the weighted shares of good ones rise, half a row of either
    class being added to each pool."""
    pools: list[list[float]] = []  # good weight, weight, first, last
    for i in np.lexsort((y, x)):
        pools.append([weight[i] * y[i], weight[i], x[i], x[i]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            good, n, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + good, pools[-1][1] + n, pools[-1][2], last]
    at = [float(first + last) / 2 for _, _, first, last in pools]
    share = np.maximum.accumulate([(good + 0.5) / (n + 1) for good, n, _, _ in pools])
    return tuple(zip(at, share.tolist(), strict=True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from docs (id, text) and labels (id, quality): at most SAMPLE labels a class, in the order of a hash of the
    id, so that what reaches the driver is bounded. Of these every second one trains a dictionary, as long as the texts
    fit in SAMPLE_BYTES whole; the others calibrate.

    Null ids and labels other than 0 and 1 are left out. An id labelled both ways counts as bad, and of rows that share a
    labelled id the smallest text is read; null texts are empty. Without labelled texts of both classes the score is the
    share of good labels (0.5 without any).
    """
    spark = session(docs)
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min("quality").cast("int").alias("quality"))
    counts = {r.quality: r.n for r in usable.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    blank = Model(b"", b"", (math.log(share / (1 - share)), 0.0))
    usable = usable.withColumn("key", F.xxhash64("id", F.lit(11)))
    drawn = [usable.filter(F.col("quality") == q).orderBy("key", "id").limit(SAMPLE).collect() for q in (0, 1)]
    rows = [(r.id, q, i, i % 2) for q in (0, 1) for i, r in enumerate(drawn[q])]
    picked = F.broadcast(spark.createDataFrame(rows, "id long, quality int, nth int, part int"))  # 2 * SAMPLE rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = materialise(texts.join(picked, "id").groupBy("id", "quality", "nth", "part").agg(F.min("text").alias("text")), "labelled")

    chosen = []
    for q in (0, 1):
        left = SAMPLE_BYTES
        for r in sorted(texts.filter((F.col("part") == 0) & (F.col("quality") == q)).select("nth", "id", F.octet_length("text").alias("n")).collect()):
            if r.n <= left:
                left -= r.n
                chosen.append((r.id,))
    built = texts.join(F.broadcast(spark.createDataFrame(chosen, "id long")), "id").select("quality", "nth", "text").collect()  # 2 * SAMPLE_BYTES
    by = {q: [r.text.encode("utf-8", "replace") for r in sorted(built, key=lambda r: r.nth) if r.quality == q] for q in (0, 1)}
    raw = {q: dictionary(t) for q, t in by.items()}
    model = Model(raw[1], raw[0], blank.logistic)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def measured(column):
        import pandas as pd

        tools = _tools(shared.value)
        return pd.Series([difference(t.encode("utf-8", "replace"), tools) for t in column], dtype="float64")

    held = sorted(texts.filter("part = 1").select("quality", measured("text").alias("d")).collect())  # SAMPLE rows of two numbers
    discard(texts)
    drawn_of = {q: sum(r.quality == q for r in held) for q in (0, 1)}
    if not all(drawn_of.values()) or not all(raw.values()):
        return blank
    x, y = np.array([r.d for r in held]), np.array([float(r.quality) for r in held])
    # A row stands for all labels of its class.
    scale = len(held) / sum(counts.values())
    weight = np.array([counts[r.quality] * scale / drawn_of[r.quality] for r in held])
    return Model(model.good, model.bad, logistic(x, y, weight), isotonic(x, y, weight))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column `out`: the probability, from 0 to 1, that the text is of good quality.

    Every whole text is scored. Null and empty texts have a difference of 0. All columns and rows are kept, repeated ones
    with equal scores; a column named like `out` is replaced. An empty table gives an empty result.
    """
    shared = session(docs).sparkContext.broadcast(model)  # two dictionaries: DICTIONARY bytes each, or all labelled texts if shorter

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        tools = _tools(shared.value)
        return pd.Series(shared.value.probability(np.array([difference((t or "").encode("utf-8", "replace"), tools) for t in texts], dtype=np.float64)))

    return docs.withColumn(out, scored(F.col(text_col).cast("string")))


_kept: dict[tuple, list] = {}


def _tools(model: Model):
    """The compressors of a model, made once in a worker."""
    key = hash(model.good), hash(model.bad)
    if key not in _kept:
        _kept.clear()
        _kept[key] = _compressors(model)
    return _kept[key]
