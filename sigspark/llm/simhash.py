"""SimHash near-duplicates by pigeonhole blocks.

A text's fingerprint has a bit where over half of its shingles' hashes have it. A fingerprint is split into blocks; of
two fingerprints with at most ``distance`` differing bits, ``agree`` blocks must be equal when there are ``distance +
agree`` blocks or more. Fingerprints are joined on every choice of ``agree`` blocks and the Hamming distance of those
that meet is verified.

Copies are folded first: only distinct fingerprints are compared. Within a block group the comparison keeps a spanning
forest of the links instead of all pairs; large groups are cut into chunks and every pair of chunks is a group of its
own, so no task holds an unbounded group. Components come from alternating star contraction on written tables.

Null or empty text: no shingle, fingerprint zero, linked like any other. Null ids take part; a component of null ids
only has a null id. Repeated rows share their fingerprint and their component.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from sigspark.llm.common import arrow_map, field, present, stored, words


@dataclass(frozen=True)
class Plan:
    """``width``: words of a shingle; ``bits``: a multiple of 64; ``blocks`` / ``agree``: see above; ``rounds``: how
    often the bits are split, each time in another order; ``chunk``: rows of a block group that one task compares. The
    default finds every pair; with ``blocks < distance + agree`` the search is probabilistic and more rounds miss
    fewer."""

    width: int = 3
    bits: int = 64
    distance: int = 3
    blocks: int = 5
    agree: int = 2
    rounds: int = 1
    chunk: int = 4096


def shingle_hashes(text: str, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``width`` lower-cased words, joined by blanks; of the whole if there are fewer."""
    tokens = words(text.encode().lower())
    if not tokens:
        return np.zeros(0, np.uint64)
    data = b" ".join(tokens)
    if len(tokens) <= width:
        return np.array([xxh64_intdigest(data, seed)], np.uint64)
    cuts = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    first = [0, *(cuts[:len(cuts) - width + 1] + 1).tolist()]
    last = [*cuts[width - 1:].tolist(), len(data)]
    return np.array([xxh64_intdigest(data[a:b], seed) for a, b in zip(first, last, strict=True)], np.uint64)


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Another 64 bits for each hash; salt 0 leaves them."""
    if not salt:
        return h
    h = h + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(hashes: np.ndarray, bits: int) -> bytes:
    """Big-endian words of majority bits."""
    out = []
    for salt in range(bits // 64):
        count = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 1 << 14):
            part = mixed(hashes[i:i + (1 << 14)], salt).astype("<u8").view(np.uint8).reshape(-1, 8)
            count += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(np.packbits(2 * count > len(hashes), bitorder="little").tobytes()[::-1])
    return b"".join(out)


def fingerprints(docs: DataFrame, text: Column | str = "text", plan: Plan = Plan(), carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint's bytes."""

    def make():
        def step(texts: pa.Array):
            return [pa.array([fingerprint(shingle_hashes(t, plan.width), plan.bits) for t in texts.to_pylist()], pa.binary())]

        return step

    return arrow_map(docs, [present(text)], [field("fp", "binary")], make, carry)


def block_keys(fps: np.ndarray, plan: Plan) -> np.ndarray:
    """A column of keys for each round and choice of ``agree`` blocks; ``fps`` holds the bits, a row each."""
    edges = np.linspace(0, plan.bits, plan.blocks + 1).round().astype(int)
    size, out = int(np.diff(edges).max()), []
    for turn in range(plan.rounds):
        mixed_bits = fps[:, np.random.default_rng(turn).permutation(plan.bits)] if turn else fps
        values = []
        for a, b in itertools.pairwise(edges):
            weights = 1 << np.arange(b - a, dtype=np.int64)
            values.append(mixed_bits[:, a:b].astype(np.int64) @ weights)
        for chosen in itertools.combinations(range(plan.blocks), plan.agree):
            key = np.full(len(fps), len(out), np.int64)
            for c in chosen:
                key = key << size | values[c]
            out.append(key)
    return np.stack(out, axis=1)


def blocks(fps: DataFrame, plan: Plan) -> DataFrame:
    """``key``, ``fp`` of every distinct fingerprint and choice of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                data = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                keys = block_keys(np.unpackbits(data, axis=1), plan)
                again = np.repeat(np.arange(b.num_rows), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), b.column(0).take(pa.array(again))], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, T.StructType([field("key", "long"), field("fp", "binary")]))


def dealt(keyed: DataFrame, plan: Plan) -> DataFrame:
    """``key``, ``pair``, ``fp``: groups over ``chunk`` rows are cut, and each row goes to every pair of its chunk."""
    sizes = keyed.groupBy("key").count().filter(F.col("count") > plan.chunk)
    cuts = F.ceil(F.col("count") / plan.chunk).cast("int")
    large = stored(sizes.select("key", cuts.alias("cuts")), "large")
    both = keyed.join(large, "key", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    placed = both.select("key", "fp", "cuts", own.alias("own"), other.alias("other"))
    pair = F.least("own", "other") * F.col("cuts") + F.greatest("own", "other")
    return placed.select("key", pair.alias("pair"), "fp")


class Forest:
    """Disjoint sets over the rows of a group."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    def tops(self, rows: np.ndarray) -> np.ndarray:
        top = self.root[rows]
        while not np.array_equal(top, up := self.root[top]):
            top = up
        self.root[rows] = top
        return top

    def join(self, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        """Those of the links that join two sets."""
        apart = self.tops(left) != self.tops(right)
        kept = []
        for a, b in zip(left[apart].tolist(), right[apart].tolist(), strict=True):
            x, y = self.find(a), self.find(b)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                kept.append((a, b))
        return kept


def group_links(group: np.ndarray, fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within groups; ``group`` ascends, ``fps`` has 64-bit words, a row each."""
    forest, out, shift = Forest(len(group)), [], 1
    live = np.arange(len(group))
    while len(live := live[live + shift < len(group)]):
        live = live[group[live] == group[live + shift]]
        for i in range(0, len(live), 1 << 16):
            a = live[i:i + (1 << 16)]
            near = np.bitwise_count(fps[a] ^ fps[a + shift]).sum(1) <= distance
            if near.any():
                out += forest.join(a[near], a[near] + shift)
        shift += 1
    return out


def links(fps: DataFrame, plan: Plan) -> DataFrame:
    """``a``, ``b``: links between distinct fingerprints that give the same components as all pairs in reach."""
    ordered = dealt(blocks(fps, plan), plan).repartition("key", "pair").sortWithinPartitions("key", "pair", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in itertools.chain(batches, [None]):
            if b is not None and b.num_rows:
                rest.append(b)
                if same(b, 0, rest[0], 0) and same(b, b.num_rows - 1, rest[0], 0):
                    continue                                   # one group so far
            if not rest:
                continue
            whole = pa.Table.from_batches(rest).combine_chunks()
            key, pair = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            change = np.concatenate(([0], np.flatnonzero((np.diff(key) != 0) | (np.diff(pair) != 0)) + 1))
            done = len(key) if b is None else int(change[-1])
            group = np.searchsorted(change, np.arange(done), side="right")
            data = whole.column(2).slice(0, done).combine_chunks()
            raw = b"".join(data.to_pylist())
            found = group_links(group, np.frombuffer(raw, np.uint64).reshape(done, -1), plan.distance) if done else []
            if found:
                a, c = (pa.array(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([data.take(a), data.take(c)], names=["a", "b"])
            rest = [x for x in whole.slice(done).to_batches() if x.num_rows]

    got = ordered.mapInArrow(run, T.StructType([field("a", "binary"), field("b", "binary")]))
    return got.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def same(x: pa.RecordBatch, i: int, y: pa.RecordBatch, j: int) -> bool:
    return all(x.column(c)[i].as_py() == y.column(c)[j].as_py() for c in (0, 1))


def contract(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node of each node's component, for all nodes that have an edge (a < b).

    Each round points every node's larger neighbours, then its smaller ones and itself, to the smallest of them; edges
    never grow in number. It ends when a round changes nothing."""
    now, state = stored(edges, "edges"), None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        down = stored(large.distinct(), "large-star")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = least.select("a", F.col("m").alias("b")).union(small).distinct()
        now = stored(stars.select(F.col("b").alias("a"), F.col("a").alias("b")), "small-star")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = seen


def components(docs: DataFrame, key: str = "doc_id", text: Column | str = "text", plan: Plan = Plan(), salts: int = 16) -> DataFrame:
    """``key``, ``fp`` and ``component_id``, the smallest key reachable over links, for every row."""
    rows = stored(fingerprints(docs, text, plan, [key]), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")), "distinct")
    roots = contract(links(distinct, plan))
    nodes = roots.select("node", "root").union(roots.select("root", "root").distinct())
    of = distinct.join(nodes, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("members"))
    named = of.join(ids.filter("members > 1"), "root").select("fp", "component_id")
    dealt_ = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.col(key)), F.lit(salts)).cast("int"))
    return salted.join(dealt_, ["fp", "salt"], "left").select(key, "fp", F.coalesce("component_id", key).alias("component_id"))
