"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` holds, for two moduli, the hash of every prefix of a text; the hash of any span is a difference of two
entries, so equality of spans takes one comparison and the longest common extension of two places a binary search.

A fingerprint is the hash of the whole text and a sketch: the hashes of all spans of ``SPAN`` code points fall into
``SLOTS`` slots, and each slot keeps some bits of its smallest. Two sketches agree in about the share of spans that
the texts have in common (Jaccard). Equal texts have equal fingerprints.

``fingerprint_edits`` pairs each document with the next one in descending id order, the last with the first. Ties of
equal ids are ordered by a hash of the text; null ids come last. Null text: empty. A single document is its own next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.common import arrow_map, field, present

MODULI = ((2147483647, 1103515245), (2147483629, 1220703125))           # primes under 2 ** 31 and bases
SPAN, SLOTS = 8, 64
_LOW = np.uint64((1 << 58) - 1)


class Powers:
    """Powers of a base and of its inverse, extended by doubling."""

    def __init__(self, modulus: int, base: int) -> None:
        self.modulus = np.uint64(modulus)
        self.step = {True: base, False: pow(base, -1, modulus)}
        self.rows = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}

    def get(self, n: int, up: bool) -> np.ndarray:
        row = self.rows[up]
        while len(row) < n:
            more = np.uint64(pow(self.step[up], len(row), int(self.modulus)))
            row = np.concatenate([row, row * more % self.modulus])
        self.rows[up] = row
        return row[:n]


POWERS = tuple(Powers(*m) for m in MODULI)


class PrefixHash:
    def __init__(self, text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.prefix = []
        for powers in POWERS:
            sums = np.cumsum(codes * powers.get(self.n, True) % powers.modulus) % powers.modulus
            self.prefix.append(np.concatenate([np.zeros(1, np.uint64), sums]))

    def spans(self, start: np.ndarray, stop: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of the spans under one modulus."""
        powers, prefix = POWERS[which], self.prefix[which]
        return (prefix[stop] + powers.modulus - prefix[start]) * powers.get(self.n + 1, False)[start] % powers.modulus

    def span(self, start: int, stop: int) -> tuple[int, int]:
        return int(self.spans(start, stop, 0)), int(self.spans(start, stop, 1))

    def extension(self, at: int, other: PrefixHash, there: int) -> int:
        """Code points that the text from ``at`` and the other from ``there`` have in common."""
        low, high = 0, min(self.n - at, other.n - there)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(at, at + middle) == other.span(there, there + middle):
                low = middle
            else:
                high = middle - 1
        return low

    def sketch(self) -> np.ndarray:
        """A number from 1 for each slot, 0 for an empty one."""
        out = np.zeros(SLOTS, np.int64)
        if not self.n:
            return out
        width = min(SPAN, self.n)
        first = POWERS[0]
        prefix = self.prefix[0]
        h = (prefix[width:] + first.modulus - prefix[:-width]) * first.get(self.n + 1 - width, False) % first.modulus
        h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        few = h[(h & _LOW) <= _LOW // np.uint64(len(h) // (SLOTS * 24) + 1)]     # holds every slot's smallest, or is not used
        for part in (few, h):
            part = np.sort(part)
            slot = (part >> np.uint64(58)).astype(np.int64)
            heads = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))[:len(part)]
            if len(heads) == SLOTS or part is h or len(part) == len(h):
                break
        out[slot[heads]] = 1 + (part[heads] % np.uint64(65535)).astype(np.int64)
        return out

    def fingerprint(self) -> str:
        a, b = self.span(0, self.n)
        return f"{a:08x}{b:08x}" + "".join(f"{v:04x}" for v in self.sketch().tolist())


def likeness(one: str, other: str) -> float:
    """Share of slots that agree among those filled in either; 1 for two equal fingerprints."""
    if one == other:
        return 1.0
    a, b = (np.frombuffer(bytes.fromhex(x[16:]), ">u2") for x in (one, other))
    filled = (a > 0) | (b > 0)
    return float(((a == b) & filled).sum() / max(1, filled.sum()))


def fingerprints(docs: DataFrame, text: Column | str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``fingerprint``."""

    def make():
        return lambda texts: [pa.array([PrefixHash(t).fingerprint() for t in texts.to_pylist()], pa.string())]

    return arrow_map(docs, [present(text)], [field("fingerprint", "string")], make, carry)


def dealt(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` (``key``, ``text``) with ``bucket``, a stretch of neighbours in descending (key, hash of the text); and the first row of each
    bucket, labelled with the bucket before it (that of the first bucket with the last).

    Null keys come last; they and tied keys are spread by their hashes. The cut points steer the dealing only; no result depends on them."""
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    same, known = F.xxhash64("text"), F.col(key).isNotNull()
    low = docs.agg(F.min(key)).first()[0]
    share = F.lit(0.5) - same.cast("double") / float(1 << 64)    # 1 for the smallest hash, 0 for the largest
    along = F.coalesce(F.col(key).cast("double"), F.lit(float(low or 0) - 2.0)) + share
    cuts = docs.select(along.alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.1 / n)
    splits = [-np.inf, *(sorted(set(cuts)) or [0.0]), np.inf]
    by = Bucketizer(splits=splits, inputCol="double", outputCol="at", handleInvalid="keep")
    placed = by.transform(docs.withColumn("double", along)).drop("double").withColumn("bucket", F.col("at").cast("int")).drop("at")

    first = F.max(F.struct(known.alias("known"), F.col(key).alias("k"), F.bitwise_not(same).alias("rest")))
    heads = placed.groupBy("bucket").agg(first.alias("head")).collect()               # at most n rows
    order = sorted(heads, key=lambda r: -r["bucket"])
    before = [(r["bucket"], r["head"]["k"], ~r["head"]["rest"], order[i - 1]["bucket"]) for i, r in enumerate(order)]
    schema = f"__at int, __k {docs.schema[key].dataType.simpleString()}, __same long, __to int"
    table = F.broadcast(spark.createDataFrame(before, schema))                        # at most n rows
    hit = (F.col("bucket") == F.col("__at")) & F.col(key).eqNullSafe(F.col("__k")) & (same == F.col("__same"))
    lent = placed.join(table, hit).dropDuplicates(["__at"]).select(*docs.columns, F.col("__to").alias("bucket"))
    return placed, lent


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """Per document: ``n_chars``, its edited text's digest, both fingerprints, their likeness, that to the next document,
    and ``common``, the longest common prefix of text and edited text."""
    own, lent = dealt(docs.select(key, present(text).alias("text")), key)
    rows = fingerprints(own.withColumn("ahead", F.lit(False)).unionByName(lent.withColumn("ahead", F.lit(True))))
    window = Window.partitionBy("bucket").orderBy("ahead", F.col(key).desc_nulls_last(), F.xxhash64("text"))
    following = [F.lead(c).over(window).alias(f"next_{c}") for c in ("text", "fingerprint")]
    paired = rows.select("*", *following).filter("not ahead")
    n = F.length("text")
    kept, tail = F.substr("text", F.lit(1), n - F.floor(n / 3)), F.substr("next_text", F.lit(1), F.floor(n / 3).cast("int"))
    edited = paired.select(
        key, "text", "fingerprint", "next_fingerprint", n.cast("long").alias("n_chars"), F.concat(kept, tail).alias("edited"),
    ).withColumn("edited_sha256", F.sha2("edited", 256))

    def make():
        def step(texts: pa.Array, changed: pa.Array, own: pa.Array, following: pa.Array):
            prints, near, near_next, common = [], [], [], []
            for t, e, f, g in zip(*(x.to_pylist() for x in (texts, changed, own, following)), strict=True):
                there = PrefixHash(e)
                prints.append(there.fingerprint())
                near.append(likeness(f, prints[-1]))
                near_next.append(likeness(f, g))
                common.append(there.extension(0, PrefixHash(t), 0))
            return [pa.array(prints, pa.string()), pa.array(near), pa.array(near_next), pa.array(common, pa.int64())]

        return step

    made = [field("edited_fingerprint", "string"), field("near_edited", "double"), field("near_next", "double"), field("common", "long")]
    inputs = [F.col("text"), F.col("edited"), F.col("fingerprint"), F.col("next_fingerprint")]
    return arrow_map(edited, inputs, made, make, [key, "n_chars", "edited_sha256", "fingerprint"])
