"""MinHash near-duplicates by min-max hashing, links confirmed on the full shingle sets.

Under each permutation of the hashes a set keeps both its minimum and its maximum: two values of a lookup, each of which two sets
share with the chance of their Jaccard similarity. ``rows`` permutations make a band of 2 * ``rows`` values; sets that agree
in all values of one of ``bands`` bands are compared. A pair of similarity s is missed with a chance of (1 - s ** (2 * rows)) ** bands:
by default 6 in 100,000 at 0.8, 2 in 10 million at 0.85.

Texts of equal sets are folded first. No pair becomes a row: the texts of a band's group travel to one task, which builds their sets
again, counts their common shingles by an inverted list and gives back the links that join two components. The first ``first``
bands are compared, then of all bands those groups that are still in several components. A group of more than ``chunk``
texts is dealt into chunks that share about 16 leading texts; if that leaves it in several components, its chunks are
compared pair by pair, so every pair of a band is settled.

A text of fewer words than ``width`` has its whole sequence as one shingle; null text or text without words has none and is linked with
nothing. Very long texts take part whole. Null ids take part; a component of null ids only has a null id, and such a row is kept.
Repeated rows are in one component, and each row whose id is the component's is kept. An empty table gives no rows. Only the id and
the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from sigspark.llm.common import arrow_map, field, present, stored
from sigspark.llm.simhash import Forest, contract, mixed, shingle_hashes


@dataclass(frozen=True)
class Plan:
    """``width``: words of a shingle; ``percent``: least similarity; ``bands``, ``rows``, ``first``, ``chunk``: see above."""

    width: int = 4
    percent: int = 80
    bands: int = 32
    rows: int = 3
    first: int = 4
    chunk: int = 1024


def signature(shingles: np.ndarray, plan: Plan) -> np.ndarray:
    """Minimum and maximum of a set under each permutation, a permutation a row."""
    by = mixed(np.arange(1, plan.bands * plan.rows + 1, dtype=np.uint64), 1)[:, None] | np.uint64(1)
    ends = np.empty((len(by), 2), np.uint64)
    ends[:] = np.iinfo(np.uint64).max, 0
    for i in range(0, len(shingles), 1 << 11):
        turned = shingles[None, i:i + (1 << 11)] * by
        ends[:, 0] = np.minimum(ends[:, 0], turned.min(1))
        ends[:, 1] = np.maximum(ends[:, 1], turned.max(1))
    return ends


def band_keys(shingles: np.ndarray, plan: Plan) -> np.ndarray:
    """A key for each band; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    values = signature(shingles, plan).reshape(plan.bands, -1)
    key = np.arange(plan.bands, dtype=np.uint64)
    for column in values.T:
        key = mixed(key ^ column, 2)
    return key.view(np.int64)


def signed(docs: DataFrame, key: str, text: Column | str, plan: Plan) -> DataFrame:
    """``key``, ``same`` (hash of the text), ``n_shingles``, ``fp`` (digest of the set) and the ``keys`` of its bands."""

    def make():
        def step(texts: pa.Array):
            sets = [np.unique(shingle_hashes(t, plan.width)) for t in texts.to_pylist()]
            return [
                pa.array([len(s) for s in sets], pa.int64()), pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([band_keys(s, plan).tolist() for s in sets], pa.list_(pa.int64())),
            ]

        return step

    source = docs.select(F.col(key), present(text).alias("__t")).withColumn("same", F.xxhash64("__t"))
    return arrow_map(source, [F.col("__t")], [field("n_shingles", "long"), field("fp", "binary"), field("keys", "*long")], make, [key, "same"])


def set_links(sets: list[np.ndarray], known: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of ``percent`` or more that join two components; ``known`` numbers the components found before."""
    forest = Forest(len(sets))
    _, head, own = np.unique(known, return_index=True, return_inverse=True)
    forest.root = head[own].copy()
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(shingle, kind="stable")                        # holders of a shingle, ascending
    holders, begin = owner[order], np.concatenate(([0], np.cumsum(np.bincount(shingle))))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    out, every = [], np.arange(len(sets))
    for i in range(len(sets) - 1):
        tops = forest.tops(every)
        apart = tops != tops[i]
        if not apart[i + 1:].any():
            if not apart.any():
                break
            continue
        mine = shingle[edges[i]:edges[i + 1]]
        n = begin[mine + 1] - begin[mine]
        at = np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        common = np.bincount(holders[at], minlength=len(sets))
        near = apart & (100 * common >= percent * (sizes[i] + sizes - common))
        near[:i + 1] = False
        other = np.flatnonzero(near)
        out += forest.join(np.full(len(other), i), other)
    return out


def compared(members: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """``a``, ``b``: links between the members (``key``, ``part``, ``node``, ``root``) of each group."""
    source = members.join(texts, "node").select("key", "part", "node", "root", "packed")
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))   # by work, not by the few bytes
    ordered = source.repartition(tasks, "key", "part").sortWithinPartitions("key", "part", "node")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for _, group in itertools.groupby(rows(batches), key=lambda r: r[:2]):
            held = list(group)
            if all(r[3] == held[0][3] for r in held):
                continue
            sets = [np.unique(shingle_hashes(expand(r[4]).decode(), plan.width)) for r in held]
            found = set_links(sets, np.array([r[3] for r in held], np.int64), plan.percent)
            if found:
                pairs = [sorted((held[i][2], held[j][2])) for i, j in found]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], names=["a", "b"])

    return ordered.mapInArrow(run, T.StructType([field("a", "long"), field("b", "long")]))


def open_groups(members: DataFrame, plan: Plan) -> DataFrame:
    """``key``, ``n``, ``band`` of the groups in several components; of groups of the same texts one, that of the first band."""
    held = members.groupBy("key").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("texts"), F.first("band").alias("band"),
        F.min("root").alias("low"), F.max("root").alias("high"),
    )
    least = F.min(F.struct("band", "key"))
    return held.filter("low <> high").groupBy("n", "texts").agg(least.alias("x")).select("x.key", "n", "x.band")


def dealt(members: DataFrame, groups: DataFrame, plan: Plan, pairs: bool) -> DataFrame:
    """Members of the groups with ``part``: one for a small group; of a large one its chunks with shared leaders, or all pairs of
    its chunks."""
    cuts = F.ceil(F.col("n") / plan.chunk).cast("int")
    both = members.join(groups.select("key", "n", cuts.alias("cuts")), "key")
    own, every = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"), F.sequence(F.lit(0), F.col("cuts") - 1)
    if pairs:
        placed = both.withColumn("own", own).withColumn("other", F.explode(every))
        part = F.least("own", "other") * F.col("cuts") + F.greatest("own", "other")
    else:
        leads = (F.col("cuts") > 1) & (F.pmod(F.xxhash64("node", F.lit("lead")), F.col("n")) < 16)
        placed, part = both.withColumn("other", F.explode(F.when(leads, every).otherwise(F.array(own)))), F.col("other")
    return placed.select("key", part.alias("part"), "node", "root")


def rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``rows`` with the ``root`` of each node's component."""
    if roots is None:
        return rows.withColumn("root", F.col("node"))
    found = roots.select(F.col("node").alias("__n"), "root")
    return rows.join(found, F.col("node") == F.col("__n"), "left").withColumn("root", F.coalesce("root", "node")).drop("__n")


def set_components(members: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame | None:
    """``node`` and ``root`` of all nodes that have a link; ``members`` holds the ``band``, ``key`` and ``node`` of the shared keys."""
    links, roots = [], None
    early, large = F.col("band") < plan.first, F.col("n") > plan.chunk
    for turn, due in enumerate((early, ~early | large, large)):
        now = rooted(members, roots)
        groups = stored(open_groups(now.filter(early) if turn == 0 else now, plan).filter(due), "groups")
        if groups.isEmpty():
            continue
        links.append(stored(compared(dealt(now, groups, plan, turn == 2), texts, plan).distinct(), "links"))
        roots = contract(reduce(DataFrame.union, links))
    return roots


def components(docs: DataFrame, key: str = "doc_id", text: Column | str = "text", plan: Plan = Plan(), salts: int = 16) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (smallest key reachable over links) and ``kept`` (that key's rows) of every row."""
    rows = stored(signed(docs, key, text, plan), "signatures")
    place = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), "same")
    folded = rows.filter("n_shingles > 0").groupBy("fp").agg(F.min(place).alias("least"), F.count("*").alias("rows"), F.first("keys").alias("keys"))
    distinct = stored(folded.withColumn("node", F.monotonically_increasing_id()), "distinct")
    keyed = distinct.select("node", F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("key").count().filter("count > 1").select("key")
    members = stored(keyed.join(shared, "key"), "members")

    def packed():
        pack = zstandard.ZstdCompressor(level=3).compress
        return lambda t: [pa.array([pack(x.encode()) for x in t.to_pylist()], pa.binary())]

    asked = distinct.join(members.select("node").distinct(), "node", "left_semi")
    asked = asked.select("node", F.col("least.id").alias("__k"), F.col("least.same").alias("__s"))
    marked = docs.select(F.col(key).alias("__id"), present(text).alias("__t")).withColumn("same", F.xxhash64("__t"))
    one = marked.join(asked, F.col("__id").eqNullSafe(F.col("__k")) & (F.col("same") == F.col("__s"))).dropDuplicates(["node"])
    texts = stored(arrow_map(one, [F.col("__t")], [field("packed", "binary")], packed, ["node"]), "texts")

    of = stored(rooted(distinct.select("fp", "node", "least", "rows"), set_components(members, texts, plan)), "roots")
    ids = of.groupBy("root").agg(F.min("least").alias("first"), F.sum("rows").alias("total"))
    named = of.join(ids.filter("total > 1"), "root").select("fp", F.col("first.id").alias("component_id"), F.lit(True).alias("hit"))
    copies = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.col(key), "same"), F.lit(salts)).cast("int"))
    component = F.when(F.col("hit"), F.col("component_id")).otherwise(F.col(key))
    whole = salted.join(copies, ["fp", "salt"], "left").withColumn("component_id", component)
    return whole.select(F.col(key), "n_shingles", "component_id", F.col(key).eqNullSafe(F.col("component_id")).alias("kept"))
