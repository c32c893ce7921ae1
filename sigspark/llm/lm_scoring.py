"""Language-model scores from a log-frequency Bloom filter.

Texts are dealt into blocks of some megabytes whose tokens are numbered within the block. Exact unigram counts of the
training texts are added up over words and sent back to every block that holds the word. Bigram counts are added up
over hashes and kept in a Bloom filter: an n-gram with count c is inserted once for each level up to
1 + log_b(c), and reading a count probes level after level until one is missing. Every training bigram enters. The
hash space is cut into slices, as many as the tokens need; a slice's filter has ``spare`` bits for each bit set, so
that it grows with its bigrams. Every block sends its keys to their slices and gets their levels back; no task holds
the whole filter.

p(w | v) = a(v) c(v, w) / c(v) + (1 - a(v)) (c(w) + 1) / (N + V + 1), where a(v) = c(v) / (c(v) + k c(v) ** 0.8) and k
makes the expected number of distinct successors add up to that of all bigrams (Witten-Bell smoothing with a power law
for the successors of a word).

Tokens are lower-cased (A-Z) words and one end token per text, which is also the context of its first word. Null text:
empty, one token. A null key trains. Repeated rows each count. Without training texts every probability is 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from sigspark.llm.common import field, present, stored, words

MADE = [
    field("n_tokens", "long"), field("n_known", "long"), field("train_tokens", "long"), field("base_score", "double"),
    field("score", "double"),
]


@dataclass(frozen=True)
class Settings:
    """``block``: bytes of text in a block; ``filter_bits``: size of a ``Filter`` (``score`` sets it for each slice);
    ``hashes``: bits per level; ``spare``: bits of a slice for each bit that its n-grams set; ``base``: step between
    levels; ``power``: growth of a word's distinct successors with its count; ``shard_words`` and ``shard_bigrams``:
    compressed bytes and entries that one task adds up."""

    block: int = 4 << 20
    filter_bits: int = 1 << 29
    hashes: int = 4
    spare: int = 8
    base: float = 1.5
    power: float = 0.8
    shard_words: int = 4 << 20
    shard_bigrams: int = 2_000_000


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 48-bit keys as differences, byte by byte of their planes."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return squeeze(steps[:, :6].T.tobytes())


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(data), np.uint8).reshape(6, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :6] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Whole numbers byte by byte of their planes: small ones leave the upper planes empty."""
    return squeeze(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expand(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def width_of(shards: int) -> int:
    """Keys that share a slice."""
    return -(-(1 << 48) // shards)


def prime_under(n: int) -> int:
    """Largest prime up to ``n``: then no step between places has a short cycle."""
    return next(p for p in range(n, 1, -1) if all(p % d for d in range(2, math.isqrt(p) + 1)))


def word_hashes(vocabulary: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, vocabulary), np.uint64, len(vocabulary))


def bigram_keys(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A 48-bit key for each token and the one before it; before a text stands the end token, number 0."""
    before = np.concatenate([np.zeros(1, ids.dtype), ids[:-1]])
    key = hashes[before] * np.uint64(0x9E3779B97F4A7C15) + hashes[ids]
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (key ^ (key >> np.uint64(32))) >> np.uint64(16)


def in_blocks(docs: DataFrame, key: str, text: Column | str, held: Column, s: Settings) -> DataFrame:
    """``block``, its keys, held-out flags and token numbers, its vocabulary and training counts (end token first)."""
    source = docs.select(F.col(key), held.alias("held"), present(text).alias("text"))
    names = ["block", "keys", "held", "sizes", "ids", "vocabulary", "trained"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = {b"": 0}
        ids: list[np.ndarray] = []
        kept: list[pa.RecordBatch] = []
        size = 0

        def block() -> pa.RecordBatch:
            whole = pa.Table.from_batches(kept).combine_chunks()
            all_ids = np.concatenate(ids)
            sizes = np.array([len(i) for i in ids], np.int64)
            held_out = whole.column(1).to_numpy()
            train = all_ids[np.repeat(~held_out, sizes)]
            offsets = pa.array([0, len(ids)], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, c) for c in (
                whole.column(0).combine_chunks(), whole.column(1).combine_chunks(), pa.array(sizes))]
            one = [
                pack_numbers(all_ids), squeeze(b" ".join(number)), pack_numbers(np.bincount(train, minlength=len(number))),
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | n], pa.int64()), *lists, *[pa.array([x], pa.binary()) for x in one]], names=names
            )

        for b in batches:
            begin = 0
            for i, t in enumerate(b.column(2).to_pylist()):
                data = t.encode().lower()
                found = [number.setdefault(w, len(number)) for w in words(data)]
                found.append(0)
                ids.append(np.array(found, "<i4"))
                size += len(data) + 64
                if size >= s.block:
                    kept.append(b.select([0, 1]).slice(begin, i + 1 - begin))
                    yield block()
                    begin, n, size, ids, kept, number = i + 1, n + 1, 0, [], [], {b"": 0}
            if begin < b.num_rows:
                kept.append(b.select([0, 1]).slice(begin))
        if ids:
            yield block()

    schema = T.StructType([
        field("block", "long"), T.StructField("keys", T.ArrayType(source.schema[key].dataType)), field("held", "*boolean"),
        field("sizes", "*long"), field("ids", "binary"), field("vocabulary", "binary"), field("trained", "binary"),
    ])
    return source.mapInArrow(run, schema)


def dealt_words(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in a vocabulary shard by shard, and the shard of each; whoever has the vocabulary knows them."""
    shard = (hashes % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, shard[order]


def word_totals(blocks: DataFrame, shards: int, s: Settings) -> DataFrame:
    """``block``, ``shard`` and the training counts of the block's words there, in the order of ``dealt_words``; ``known`` and
    ``spread`` add up to the number of distinct training words and the sum of their counts to the power."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, vocabulary, trained in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tokens = np.array(expand(vocabulary).split(b" "), object)
                counts = unpack_numbers(trained)
                order, shard = dealt_words(word_hashes(tokens.tolist()), shards)
                cuts = np.flatnonzero(np.diff(shard)) + 1
                rows = [
                    (int(n[0]), block, squeeze(b" ".join(tokens[p])), pack_numbers(counts[p]))
                    for n, p in zip(np.split(shard, cuts), np.split(order, cuts), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(),) * 2 + (pa.binary(),) * 2, strict=True)],
                    names=["shard", "block", "words", "counts"],
                )

    def add(rows: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        lists = [expand(w).split(b" ") for w in rows.column("words").to_pylist()]
        for tokens, counts in zip(lists, rows.column("counts").to_pylist(), strict=True):
            for w, c in zip(tokens, unpack_numbers(counts).tolist(), strict=True):
                total[w] = total.get(w, 0) + c
        sums = np.array([c for c in total.values() if c], np.float64)
        first = [True] + [False] * (len(lists) - 1)
        return pa.table({
            "block": rows.column("block"), "shard": rows.column("shard"),
            "totals": pa.array([pack_numbers(np.array([total[w] for w in tokens], "<i8")) for tokens in lists], pa.binary()),
            "known": pa.array([len(sums) * f for f in first], pa.int64()),
            "spread": pa.array([float((sums ** s.power).sum()) * f for f in first], pa.float64()),
        })

    dealt = blocks.select("block", "vocabulary", "trained").mapInArrow(deal, T.StructType([
        field("shard", "long"), field("block", "long"), field("words", "binary"), field("counts", "binary"),
    ]))
    return dealt.groupBy("shard").applyInArrow(add, T.StructType([
        field("block", "long"), field("shard", "long"), field("totals", "binary"), field("known", "long"), field("spread", "double"),
    ]))


def probes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and step of each key's places in its slice."""
    first = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    step = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return first >> np.uint64(8), step >> np.uint64(8) | np.uint64(1)


def place(first: np.ndarray, step: np.ndarray, nth: int, places: int) -> np.ndarray:
    return (first + np.uint64(nth) * step) % np.uint64(places)


def levels_of(counts: np.ndarray, s: Settings) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(s.base) + 1e-9).astype(np.int64)


def bits_for(counts: np.ndarray, s: Settings) -> int:
    """Bits of a slice in which all these n-grams enter."""
    return max(1, -(-int(levels_of(counts, s).sum()) * s.hashes * s.spare // 64)) * 64


def build_slice(keys: np.ndarray, counts: np.ndarray, slice_bits: int, s: Settings) -> np.ndarray:
    """Bits of one slice with all n-grams."""
    (first, step), level = probes(keys), levels_of(counts, s)
    bits, places = np.zeros(slice_bits, bool), prime_under(slice_bits)
    for q in range(1, int(level.max(initial=0)) + 1):
        on = level >= q
        for h in range(s.hashes):
            bits[place(first[on], step[on], (q - 1) * s.hashes + h, places)] = True
    return np.packbits(bits, bitorder="little")


@dataclass
class Filter:
    bits: np.ndarray
    shards: int
    levels: int
    settings: Settings

    def found(self, keys: np.ndarray) -> np.ndarray:
        """Number of the highest level found for each key, 0 if it is not there."""
        s = self.settings
        slice_bits = s.filter_bits // self.shards // 64 * 64
        base = (keys // np.uint64(width_of(self.shards))) * np.uint64(slice_bits)
        places = prime_under(slice_bits)
        first, step = probes(keys)
        out, live, q = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 0
        while len(live) and q < self.levels:
            for h in range(s.hashes):
                bit = base[live] + place(first[live], step[live], q * s.hashes + h, places)
                live = live[self.bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1]
            q += 1
            out[live] = q
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Lower edge of the highest level found for each key, 0 if it is not there."""
        return edges(self.levels, self.settings)[self.found(keys)]


def edges(levels: int, s: Settings) -> np.ndarray:
    """Lower edge of each level, 0 for none."""
    return np.array([0, *(math.ceil(s.base ** q - 1e-9) for q in range(levels))], np.float64)


def bigram_levels(blocks: DataFrame, shards: int, levels: int, s: Settings) -> DataFrame:
    """``block``, ``shard`` and the filter's ``levels`` of the block's distinct keys there, in ascending order;
    ``distinct`` adds up to the number of distinct training bigrams."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, ids, vocabulary, held, sizes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keys = bigram_keys(word_hashes(expand(vocabulary).split(b" ")), unpack_numbers(ids))
                train = np.repeat(~np.array(held, bool), sizes)
                keys, at = np.unique(keys, return_inverse=True)
                counts = np.bincount(at[train], minlength=len(keys))
                cuts = np.searchsorted(keys, np.arange(1, shards, dtype=np.uint64) * np.uint64(width_of(shards)))
                rows = [
                    (i, block, pack_keys(k), pack_numbers(c))
                    for i, (k, c) in enumerate(zip(np.split(keys, cuts), np.split(counts, cuts), strict=True)) if len(k)
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(),) * 2 + (pa.binary(),) * 2, strict=True)],
                        names=["shard", "block", "keys", "counts"],
                    )

    def add(rows: pa.Table) -> pa.Table:
        lists = [unpack_keys(k) for k in rows.column("keys").to_pylist()]
        keys = np.concatenate(lists)
        counts = np.concatenate([unpack_numbers(c) for c in rows.column("counts").to_pylist()])
        order = np.argsort(keys)
        ordered = keys[order]
        first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        heads = np.flatnonzero(first)
        one, sums = ordered[heads], np.add.reduceat(counts[order], heads)
        known = sums > 0
        size = bits_for(sums[known], s)
        model = Filter(build_slice(one[known], sums[known], size, s), 1, levels, replace(s, filter_bits=size))
        got = np.empty(len(keys), np.uint8)
        got[order] = model.found(one)[np.cumsum(first) - 1]
        cuts = np.cumsum([len(k) for k in lists])[:-1]
        return pa.table({
            "block": rows.column("block"), "shard": rows.column("shard"),
            "levels": pa.array([squeeze(x.tobytes()) for x in np.split(got, cuts)], pa.binary()),
            "distinct": pa.array([int(known.sum())] + [0] * (len(lists) - 1), pa.int64()),
        })

    dealt = blocks.select("block", "ids", "vocabulary", "held", "sizes").mapInArrow(deal, T.StructType([
        field("shard", "long"), field("block", "long"), field("keys", "binary"), field("counts", "binary"),
    ]))
    return dealt.groupBy("shard").applyInArrow(add, T.StructType([
        field("block", "long"), field("shard", "long"), field("levels", "binary"), field("distinct", "long"),
    ]))


def score(
    docs: DataFrame, held_out: Column, key: str = "doc_id", text: Column | str = "text", settings: Settings = Settings(),
) -> DataFrame:
    """``key``, ``held_out`` and the scores of every text, learnt from those that are not held out."""
    s = settings
    blocks = stored(in_blocks(docs, key, text, F.coalesce(held_out, F.lit(False)), s), "lm-blocks")
    trained = F.aggregate(
        F.zip_with("held", "sizes", lambda h, n: F.when(h, 0).otherwise(n)), F.lit(0).cast("long"), lambda a, n: a + n)
    size, tokens = blocks.agg(
        F.coalesce(F.sum(F.octet_length("vocabulary")), F.lit(0)), F.coalesce(F.sum(trained), F.lit(0))).first()
    word_shards = max(1, -(-size // s.shard_words))
    totals = stored(word_totals(blocks, word_shards, s), "lm-totals")
    known, spread = totals.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("spread"), F.lit(0.0))).first()
    shards, levels = max(2, -(-tokens // s.shard_bigrams)), 1 + int(math.log(max(tokens, 1)) / math.log(s.base))
    found = stored(bigram_levels(blocks, shards, levels, s), "lm-bigrams")
    rate = found.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0] / max(spread, 1.0)
    gathered = totals.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "totals")))["totals"].alias("totals"))
    answers = found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "levels")))["levels"].alias("levels"))
    edge = edges(levels, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, held, sizes = (b.column(c)[i].values for c in range(3))
                ids, hashes = unpack_numbers(b.column(3)[i].as_py()), word_hashes(expand(b.column(4)[i].as_py()).split(b" "))
                count = np.empty(len(hashes), np.int64)
                count[dealt_words(hashes, word_shards)[0]] = np.concatenate([unpack_numbers(p) for p in b.column(5)[i].as_py()])
                plain = (count + 1) / (tokens + known + 1)
                before = np.concatenate([np.zeros(1, ids.dtype), ids[:-1]])
                context = count[before].astype(np.float64)
                trust = np.where(context > 0, 1 / (1 + rate * np.maximum(context, 1) ** (s.power - 1)), 0)
                _, nth = np.unique(bigram_keys(hashes, ids), return_inverse=True)
                level = np.frombuffer(b"".join(map(expand, b.column(6)[i].as_py())), np.uint8)
                pairs = np.minimum(edge[level][nth], np.minimum(context, count[ids]))
                p = trust * pairs / np.maximum(context, 1) + (1 - trust) * plain[ids]
                n = sizes.to_numpy()
                starts = np.cumsum(n) - n
                sums = [np.add.reduceat(x, starts) for x in ((count > 0).astype(np.int64)[ids], np.log10(plain)[ids], np.log10(p))]
                yield pa.RecordBatch.from_arrays(
                    [keys, held, pa.array(n), pa.array(sums[0]), pa.array(np.full(len(n), tokens, np.int64)),
                     pa.array(sums[1]), pa.array(sums[2])],
                    names=[key, "held_out", *[f.name for f in MADE]],
                )

    rows = blocks.select("keys", "held", "sizes", "ids", "vocabulary", "block").join(gathered, "block").join(answers, "block").drop("block")
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), field("held_out", "boolean"), *MADE])
    return rows.mapInArrow(run, schema)
