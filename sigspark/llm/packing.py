"""Sequence packing along a space-filling curve.

Each text is tokenized once; its hashed token counts are projected to few dimensions and their Hilbert key places
similar texts side by side. The texts are range-sorted by (key, id) and their token streams laid end to end along the
curve, so a sequence holds neighbours and only the very last one can be short.

Only keys and lengths are sorted: each range partition adds up its own lengths, the partitions' totals (one row each)
give the starts. Texts with the same key, copies for instance, are dealt by id. Null text: empty, one piece that holds
the end id. Repeated rows are packed each by itself. An empty table gives no pieces.
"""

from __future__ import annotations

import functools
import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.llm.common import arrow_map, field, present, stored

DIMS, BITS, BUCKETS = 4, 15, 256
#: Words of more characters are not remembered.
LONG = 64
#: Signs that stay together after letters; the apostrophe, which may go with letters, is none of them.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> dict[int, int]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones as they are, the others from 256 up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b if b in shown else 256 + hidden.index(b) for b in range(256)}


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space, folds case and never joins across white space or between
    letters and other signs; words are remembered.

    Words of plain letters go straight to the tokenizer's model, all others through the whole tokenizer.
    """

    def __init__(self, path: str, cache: int = 800_000) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.cache, self.known = Tokenizer.from_file(path), cache, {"": b""}
        self.model, self.letters, self.signs = self.tokenizer.model.tokenize, byte_letters(), {}

    def whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def plain(self, word: str) -> bytes:
        """A word of letters below U+0250, which are composed already."""
        if word.isascii():
            form = word.lower()
        else:
            form = word.lower().encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model(form)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def sign(self, signs: str) -> bytes:
        got = self.signs.get(signs)
        if got is None:
            got = self.whole([signs])[0]
            if len(self.signs) < self.cache and len(signs) <= LONG:
                self.signs[signs] = got
        return got

    def learn(self, words: Iterable[str]) -> None:
        """Ids of the words. Letters, and the signs after them, are pieces by themselves; letters are folded first."""
        known, other = self.known, []
        for w in words:
            body = w.rstrip(SIGNS)
            if body.isalpha() and (body.isascii() or max(body) < "\u0250" and "\u0130" not in body):
                got = known.get(body)
                if got is None:
                    small = body.lower()
                    got = known.get(small)
                    if got is None:
                        got = self.plain(small)
                        if len(small) <= LONG:
                            known[small] = got
                known[w] = got if body is w else got + self.sign(w[len(body):])
            else:
                other.append(w)
        known.update(zip(other, self.whole(other), strict=True))

    def encode(self, texts: list[str], end: bytes) -> list[bytes]:
        parted = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        words = set().union(*parted)
        if len(self.known) >= self.cache:                                    # words in use stay
            self.known = {"": b""} | {w: self.known[w] for w in words & self.known.keys()}
        unknown = words.difference(self.known)
        self.learn(unknown)
        get = self.known.__getitem__
        out = [b"".join(map(get, words)) + end for words in parted]
        for w in unknown:
            if len(w) > LONG:
                del self.known[w]
        return out


@functools.lru_cache(maxsize=2)
def tokenizer_of(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of the rows of ``points``, integers under 2 ** ``bits``."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for shift in range(bits - 1, 0, -1):                   # undo the turns of each level, from the coarsest
        low = (1 << shift) - 1
        for i in range(n):
            high = (x[i] >> shift) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap if i else 0
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for shift in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> shift) & 1 == 1, (1 << shift) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for shift in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> shift) & 1
    return key


@functools.lru_cache(maxsize=1)
def axes() -> np.ndarray:
    rows = np.random.default_rng(7).choice([-1.0, 1.0], (BUCKETS, DIMS))
    return (rows / np.sqrt(BUCKETS)).astype(np.float32)


def curve_keys(ids: list[bytes]) -> np.ndarray:
    """Hilbert key of each packed id list's hashed counts."""
    spread = np.zeros((len(ids), BUCKETS), np.float32)
    for row, data in zip(spread, ids, strict=True):
        row += np.bincount((np.frombuffer(data, "<u4") * np.uint32(2654435761)) >> np.uint32(24), minlength=BUCKETS)
    spread /= np.maximum(np.linalg.norm(spread, axis=1, keepdims=True), 1e-12)
    places = np.floor((spread @ axes() + 1) / 2 * ((1 << BITS) - 1))
    return hilbert(places.clip(0, (1 << BITS) - 1))


def tokenized(docs: DataFrame, path: str, text: Column | str, key: str, end_id: int) -> DataFrame:
    """Rows with ``ids`` (packed, end id included), ``doc_tokens`` and the curve key ``curve``."""
    end = np.array([end_id], "<u4").tobytes()

    def make():
        tokenizer = tokenizer_of(path)

        def step(texts: pa.Array):
            ids: list[bytes] = []
            keys = []
            for i in range(0, len(texts), 256):
                part = tokenizer.encode(texts.slice(i, 256).to_pylist(), end)
                ids += part
                keys.append(curve_keys(part))
            return [
                pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array(np.concatenate(keys), pa.int64()),
            ]

        return step

    made = [field("ids", "binary"), field("doc_tokens", "long"), field("curve", "long")]
    return arrow_map(docs, [present(text)], made, make, [key]).withColumn("uid", F.monotonically_increasing_id())


def starts(rows: DataFrame, key: str) -> DataFrame:
    """``uid`` and the place ``at`` of each row's first token in the stream along the curve."""
    source = rows.select("curve", key, "uid", "doc_tokens")
    ordered = source.repartitionByRange("curve", key, "uid").sortWithinPartitions("curve", key, "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            ends = total + np.cumsum(b.column(3).to_numpy())
            sizes = b.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [b.column(2), pa.array(ends - sizes), b.column(3), pa.array(np.full(len(ends), part, np.int32))],
                names=["uid", "within", "doc_tokens", "part"],
            )
            total = int(ends[-1]) if len(ends) else total

    schema = T.StructType([field("uid", "long"), field("within", "long"), field("doc_tokens", "long"), field("part", "int")])
    placed = stored(ordered.mapInArrow(run, schema), "order")
    sums = placed.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    before = sums.select(                                   # a row for each range partition
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"),
    )
    return placed.join(F.broadcast(before), "part").select("uid", (F.col("before") + F.col("within")).alias("at"))


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: Column | str = "text", capacity: int = 2048, end_id: int = 1,
) -> DataFrame:
    """Pieces of all texts: key, ``start`` in the document, ``length``, ``ids`` (packed), ``doc_tokens``,
    ``sequence_id`` and ``offset`` in the sequence. ``tokenizer`` is a path that every worker reads."""
    rows = stored(tokenized(docs, tokenizer, text, key, end_id), "tokens")
    placed = rows.join(starts(rows, key).hint("merge"), "uid").select(key, "ids", "at")     # a row per text: not to be broadcast
    kept = placed.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array([len(i) // 4 for i in b.column(1).to_pylist()], np.int64)
            at = b.column(2).to_numpy()
            first, last = at // capacity, (at + sizes - 1) // capacity
            row = np.repeat(np.arange(len(at)), last - first + 1)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
            begin = np.maximum((first[row] + nth) * capacity, at[row])
            stop = np.minimum((first[row] + nth + 1) * capacity, (at + sizes)[row])
            start, length = begin - at[row], stop - begin
            data = b.column(1).to_pylist()
            pieces = [data[r][4 * s:4 * (s + n)] for r, s, n in zip(row, start, length, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(pieces, pa.binary()),
                    pa.array(sizes[row]), pa.array(begin // capacity), pa.array(begin % capacity),
                ],
                names=[key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    made = [
        field("start", "long"), field("length", "long"), field("ids", "binary"), field("doc_tokens", "long"),
        field("sequence_id", "long"), field("offset", "long"),
    ]
    return placed.mapInArrow(run, T.StructType([kept, *made]))
