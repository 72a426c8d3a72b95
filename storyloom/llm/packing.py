"""Cost-balanced packing of tokenised documents into sequences.

Each document becomes token ids plus a closing 0. Whole runs of `capacity` ids are sequences of their own; what is left
is packed: pieces in descending order of cost, linear plus quadratic in their length, go to the sequence of lowest cost
that still has room. Where no sequence has room for a whole piece, it is cut at what the emptiest one takes. A shard is
a task's share of the rows; only its last sequence can have padding, so the padding is under one sequence a shard.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import slices

LINEAR, QUADRATIC = 1.0, 1.0 / 1024
SHARD = 1 << 24  # documents' remainders that are packed together at most

# The byte-level pre-tokeniser's pattern for texts of Latin letters; any other text goes to the library whole.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ʯ]+| ?[0-9²³¹¼-¾]+| ?[^\sA-Za-zªµºÀ-ÖØ-öø-ʯ0-9²³¹¼-¾]+|\s+(?!\S)|\s+")
_PLAIN = re.compile(r"[\t\n\r -~¡-ʯ‘-”–—…€]*")
_MEMO = 100_000  # pieces of a generation that a worker remembers; it holds two generations, 30 MB at most of usual words
OUT_BYTES = 1 << 20  # ids of a batch of pieces, at which it is handed over


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes for themselves, the others
    for the letters from U+0100 on, in order."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, as a tokenizers file gives them with add_special_tokens=False.

    Where the file describes a plain byte-level BPE, texts of Latin letters are cut into its pieces here. A piece that was
    seen before is looked up; any other goes to the library's model. Pieces are forgotten a generation at a time, so that
    the usual ones stay. All other texts, and ones that hold a token added to the vocabulary, go to the library whole.
    """

    def __init__(self, path: str, memo: int = _MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        about = json.loads(self.library.to_str())
        pre, model = about["pre_tokenizer"] or {}, about["model"]
        self.by_piece = (
            about["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        )
        self.added = tuple(t["content"] for t in about["added_tokens"])
        self.letters = _byte_letters()
        self.most = memo
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        tokens = self.library.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        return array("I", [t.id for t in tokens]).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_piece or not _PLAIN.fullmatch(text) or any(t in text for t in self.added):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        pieces, young = _PIECES.findall(text), self.young
        out = list(map(young.get, pieces))
        for i in [i for i, x in enumerate(out) if x is None]:
            piece = pieces[i]
            ids = young.get(piece) or self.old.get(piece)
            out[i] = young[piece] = ids or self._piece(piece)
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file: made once, as workers run many tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cost(n: int) -> float:
    """The estimated cost of attending over n tokens."""
    return LINEAR * n + QUADRATIC * n * n


def balance(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(item, start, length, sequence) for each piece of items of less than capacity tokens, in placing order."""
    order = sorted((i for i, n in enumerate(lengths) if n), key=lambda i: (-lengths[i], i))
    count = -(-sum(lengths) // capacity)
    rooms: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]  # by free tokens: a heap of (cost, sequence)
    lowest = np.full(capacity + 1, np.inf)
    rooms[capacity] = [(0.0, s) for s in range(count)]
    if count:
        lowest[capacity] = 0.0
    emptiest = capacity
    out = []
    for item in order:
        start, left = 0, lengths[item]
        while left:
            while not rooms[emptiest]:
                emptiest -= 1
            free = emptiest if left >= emptiest else left + int(lowest[left : emptiest + 1].argmin())
            spent, s = heapq.heappop(rooms[free])
            lowest[free] = rooms[free][0][0] if rooms[free] else np.inf
            n = min(left, free)
            out.append((item, start, n, s))
            start, left, free, spent = start + n, left - n, free - n, spent + cost(n)
            if free:
                heapq.heappush(rooms[free], (spent, s))
                lowest[free] = rooms[free][0][0]
    return out


_OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()), T.StructField("ids", T.BinaryType()),
    ]
)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) for each piece of each row.

    ids holds the piece's ids as little-endian unsigned 32-bit numbers (null unless with_ids). A null or empty text is
    the closing id alone. Repeated rows, and rows that share an id, are packed each on its own; null ids are carried
    along. Other columns are ignored. An empty table gives an empty result.
    """

    def run(it):
        from pyspark import TaskContext

        tool = encoder(tokenizer)
        base = TaskContext.get().partitionId() << 40
        sequences = 0
        rest: list[tuple] = []
        rows: list[tuple] = []
        step = capacity * 4
        most = max(1, OUT_BYTES // step) if with_ids else 4096
        pa.default_memory_pool().release_unused()  # a worker that ran other operators holds on to their batches

        def flush():
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.binary())], names=_OUT.names)

        def packed():
            nonlocal sequences
            offsets: dict[int, int] = {}
            for item, start, n, s in balance([len(r[2]) // 4 for r in rest], capacity):
                key, before, ids, total = rest[item]
                part = ids[4 * start : 4 * (start + n)]
                at = offsets.get(s, 0)
                offsets[s] = at + n
                rows.append((key, before + start, n, zlib.crc32(part), total, base + sequences + s, at, part if with_ids else None))
                if len(rows) >= most:
                    yield flush()
            sequences += len(offsets)
            rest.clear()

        for batch in slices(it):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tool.encode(text or "") + b"\0\0\0\0"
                total, whole = len(ids) // 4, len(ids) // step * step
                for i in range(0, whole, step):
                    part = ids[i : i + step]
                    rows.append((key, i // 4, capacity, zlib.crc32(part), total, base + sequences, 0, part if with_ids else None))
                    sequences += 1
                if len(ids) > whole:
                    rest.append((key, whole // 4, ids[whole:], total))
                if len(rest) >= SHARD // capacity:
                    yield from packed()
                if len(rows) >= most:
                    yield flush()
        yield from packed()
        if rows:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _OUT)
