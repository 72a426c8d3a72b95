"""Substring deduplication by hashing lines and windows of words.

A text's units are its lines, of any length, and winnowed windows of WINDOW words wherever they begin: of each GAP
consecutive windows that with the smallest hash is compared, so that two texts that share WINDOW + GAP - 1 words in a row
share a window. Units are normalised (A-Z lower-cased, runs of white space alike) and hashed to 96 bits. Digests are
grouped over the whole corpus; the earliest occurrence, by id and offset, stays, and every later one is a repeat. Repeats
that touch or overlap in a text make one span, with its offsets in the original text. No repeat is left out: a least
length is a filter on the spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialise, mix, session, slices, words_of

WINDOW = 40  # words of a window
GAP = 12  # windows of which one is compared: a shared passage of 51 words has one
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo 2^64."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, 1 << 14), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def _sums(hashes: np.ndarray, base: int):
    """A function of places of first words and numbers of words to hashes of those runs of words."""
    n = len(hashes) + 1
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(hashes * _power(base, n)[1:], dtype=np.uint64)))
    down = _power(pow(base, -1, 1 << 64), n)
    return lambda at, words: mix((total[at + words] - total[at]) * down[at] + words.astype(np.uint64))


def _sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each n consecutive numbers."""
    size = 1
    while size < n:
        step = min(size, n - size)
        x, size = pick(x[: len(x) - step], x[step:]), size + step
    return x


def winnowed(hashes: np.ndarray, gap: int) -> np.ndarray:
    """The places of the numbers that are the smallest of some `gap` consecutive ones."""
    if len(hashes) < gap:
        return np.empty(0, dtype=np.int64)
    edge = np.zeros(gap - 1, dtype=np.uint64)
    return np.flatnonzero(_sliding(np.concatenate((edge, _sliding(hashes, gap, np.minimum), edge)), gap, np.maximum) == hashes)


def units(text: bytes, window: int = WINDOW, gap: int = GAP) -> tuple[np.ndarray, ...]:
    """(start, end, place of the first word, words, digest, check, again) of the lines and windows of UTF-8 text.

    start and end count code points. again says that the text has the unit before, without overlap.
    """
    hashes, starts, ends = words_of(text.lower())
    if not len(hashes):
        return tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64, np.int32, bool))
    raw = np.frombuffer(text, dtype=np.uint8)
    line = np.searchsorted(np.flatnonzero(raw == 10), starts)
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    long, short = (_sums(hashes, b) for b in _BASES)
    at, words = first, np.diff(first, append=len(hashes))
    digest, check = long(at, words) ^ np.uint64(1), short(at, words)  # a line is no window
    if len(hashes) >= window + gap - 1:
        every = np.arange(len(hashes) - window + 1)
        size = np.full(len(every), window)
        h = long(every, size)
        pick = winnowed(h, gap)
        at, words = np.concatenate((at, pick)), np.concatenate((words, size[pick]))
        digest, check = np.concatenate((digest, h[pick])), np.concatenate((check, short(pick, size[pick])))
    _, which, back = np.unique(digest, return_index=True, return_inverse=True)  # the first of each, as places ascend
    again = at >= (at + words)[which][back]
    begin, end = starts[at], ends[at + words - 1]
    if not text.isascii():
        points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        begin, end = points[begin], points[end]
    return begin, end, at, words, digest.view(np.int64), (check >> np.uint64(32)).astype(np.uint32).view(np.int32), again


def _units(window: int, gap: int):
    names = ["id", "row", "start", "end", "at", "words", "digest", "check", "again"]

    def run(it):
        for batch in slices(it, 1024):
            cut = [units(t or b"", window, gap) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            of = pa.array(np.repeat(np.arange(len(cut)), [len(c[0]) for c in cut]))
            cols = [np.concatenate(c) for c in zip(*cut, strict=True)]
            arrays = [pa.array(c, t) for c, t in zip(cols, (*[pa.int32()] * 4, pa.int64(), pa.int32(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *arrays], names=names)

    return run


def removals(docs: DataFrame, window: int = WINDOW, gap: int = GAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, start, length, words, first_doc_id) for each span to remove: all repeats, of one word or more.

    start and length count code points of the original text; first_doc_id tells where the span's first unit stays. Spans
    of a text neither touch nor overlap. Null and empty texts have none. Rows that share an id are different documents,
    in the order of `row`, a hash of the text; rows that share the text as well are one document. Rows with a null id
    rank last, and their spans have a null doc_id. A window that overlaps its own first occurrence stays. Other columns
    are ignored. An empty table gives an empty result.
    """
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    # Units are made twice rather than written: they take more room than the texts.
    found = src.mapInArrow(_units(window, gap), "id long, row long, start int, end int, at int, words int, digest long, check int, again boolean")
    # Ids that are all different rank rows by themselves, in a number that hash aggregation can keep.
    own = src.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").isEmpty()
    found = found.withColumn("rank", F.col("id") if own else F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    first = found.groupBy("digest", "check").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.max("again").alias("any"))
    first = materialise(first.filter((F.col("first") != F.col("last")) | F.col("any")).select("digest", "check", "first"), "firsts")
    repeats = found.join(first, ["digest", "check"]).filter(F.col("again") | (F.col("rank") != F.col("first")))
    where = F.col("first") if own else F.col("first.id")
    repeats = repeats.select("id", "row", "at", "words", "start", "end", where.alias("first"))
    if not own:
        repeats = repeats.distinct()
    # What a text has repeats at most as many times as it has words, so that a window holds one text's units.
    before = Window.partitionBy("id", "row").orderBy("at", F.col("words").desc())
    reach = F.max(F.col("at") + F.col("words")).over(before.rowsBetween(Window.unboundedPreceding, -1))
    marked = repeats.withColumn("new", F.coalesce(F.col("at") > reach, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.groupBy("id", "row", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max(F.col("at") + F.col("words")) - F.min("at")).alias("words"), F.min(F.struct("at", "first")).alias("f"))
    return spans.select(F.col("id").alias("doc_id"), "row", F.col("start").cast("long").alias("start"), (F.col("end") - F.col("start")).cast("long").alias("length"), F.col("words").cast("long").alias("words"), F.col("f.first").alias("first_doc_id"))


def remove(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the spans of removals() cut out of their texts, and `removed`, the spans (start, length) in order.

    Offsets count code points of the original text. Documents without spans keep their text and have a null `removed`; a
    column of that name is replaced. Rows find their spans by id, null ids among them, and text.
    """
    cut = spans.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("removed"))
    text = F.col(text_col).cast("string")
    joined = docs.drop("removed").join(cut, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__row")), "left").drop("__id", "__row")
    keep = F.aggregate(
        "removed",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))).alias("out"), (s["start"] + s["length"]).alias("at")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))),
    )
    return joined.withColumn(text_col, F.when(F.col("removed").isNotNull(), keep).otherwise(text))
