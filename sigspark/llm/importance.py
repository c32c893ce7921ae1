"""Importance resampling towards a target distribution, over hashed word features.

A feature's bucket is the CRC-32 of its bytes modulo the number of buckets. CRC-32 is linear over XOR: a span's checksum
is the XOR of one constant for its length and one contribution per byte, which depends on the byte and on its distance
from the span's end alone. ``PositionTable`` holds these contributions; the bytes of a whole Arrow batch are looked up at once
and XOR-ed by ``bitwise_xor.reduceat`` over the spans. Spans longer than the table are cut into blocks, whose values are
folded pairwise: the left one of a pair is advanced over the bytes that stand behind it.

The texts are hashed once; their buckets (two bytes a feature) are written and read again by the count and by the scores.
Counts are a dense vector per task, added up by bucket; the gains (one number per bucket, a bound set by the caller) are
the only thing that is broadcast. Ranks come from one range sort of (score, id) with a total per range.

Null or empty text, or text without words: no feature, weight 0. A null id hashes as the empty string and comes after all other ids
among ties. Repeated rows each count and each take a rank. Very long texts and very long words take part whole. An empty
table gives no rows, an empty target gives the gains of zero counts. Only the id and the text of the inputs are read, so
other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.llm.common import arrow_map, field, present, stored

POLYNOMIAL = 0xEDB88320
#: Bytes of texts whose contributions are in memory at once.
PIECE = 2 << 20


@dataclass(frozen=True)
class Plan:
    """``longest``: words of the longest feature; ``buckets``; ``percent`` of the rows of at least ``least_words`` words that are
    drawn; ``seed`` of the draw."""

    longest: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: int = 2024


class PositionTable:
    """CRC-32 of many spans of one byte array."""

    def __init__(self, depth: int = 64) -> None:
        first = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            first = (first >> np.uint32(1)) ^ np.where(first & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
        self.depth, rows, length = depth, [first], [np.uint32(0xFFFFFFFF)]
        for _ in range(depth):
            rows.append((rows[-1] >> np.uint32(8)) ^ first[rows[-1] & np.uint32(255)])
            length.append((length[-1] >> np.uint32(8)) ^ first[length[-1] & np.uint32(255)])
        self.table = np.stack(rows[:depth]).ravel()                # contribution of a byte at 256 * distance + byte
        self.constant = np.array(length, np.uint32) ^ np.uint32(0xFFFFFFFF)
        states = np.arange(256, dtype=np.uint32) << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]
        for _ in range(depth):
            states = (states >> np.uint32(8)) ^ first[states & np.uint32(255)]
        self.ahead = states                                        # each byte of a state, ``depth`` zero bytes later

    @staticmethod
    def advance(values: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        out = ahead[0][values & np.uint32(255)]
        for i in range(1, 4):
            out = out ^ ahead[i][values >> np.uint32(8 * i) & np.uint32(255)]
        return out

    def xored(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """XOR of the contributions of each span; spans are not empty and not longer than the table."""
        begin = np.cumsum(sizes) - sizes
        within = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
        far = np.repeat(sizes - 1, sizes) - within
        return np.bitwise_xor.reduceat(self.table[256 * far + data[np.repeat(starts, sizes) + within]], begin)

    def long(self, data: np.ndarray, start: int, size: int) -> np.uint32:
        """Checksum of one long span: its blocks, counted from its end, folded pairwise."""
        edges = np.concatenate(([start], np.arange(start + (size - 1) % self.depth + 1, start + size + 1, self.depth)))
        parts = [
            self.xored(data, edges[i:j], np.diff(edges[i:j + 1]))
            for i in range(0, len(edges) - 1, PIECE // self.depth) for j in [min(i + PIECE // self.depth, len(edges) - 1)]
        ]
        values, ahead, states = np.concatenate(parts), self.ahead, np.array([0xFFFFFFFF], np.uint32)
        short = (size - 1) % self.depth + 1
        for _ in range(short):                                     # the initial state passes the first block byte by byte,
            states = (states >> np.uint32(8)) ^ self.table[states & np.uint32(255)]
        turns, power = (size - short) // self.depth, self.ahead
        while turns:                                               # then all whole blocks by squaring
            states = self.advance(states, power) if turns & 1 else states
            turns, power = turns >> 1, self.advance(power, power)
        while len(values) > 1:
            values = np.concatenate((np.zeros(1, np.uint32), values)) if len(values) % 2 else values
            values = self.advance(values[0::2], ahead) ^ values[1::2]
            ahead = self.advance(ahead, ahead)
        return values[0] ^ states[0] ^ np.uint32(0xFFFFFFFF)

    def checksums(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.uint32)
        short = np.flatnonzero((sizes > 0) & (sizes <= self.depth))
        upto = np.cumsum(sizes[short])
        cuts = np.searchsorted(upto, np.arange(PIECE, (int(upto[-1]) if len(upto) else 0) + PIECE, PIECE), side="right")
        for a, b in zip(np.concatenate(([0], cuts)).tolist(), [*cuts.tolist(), len(short)], strict=True):
            if a < b:
                at = short[a:b]
                out[at] = self.xored(data, starts[at], sizes[at]) ^ self.constant[sizes[at]]
        for i in np.flatnonzero(sizes > self.depth).tolist():
            out[i] = self.long(data, int(starts[i]), int(sizes[i]))
        return out


def word_spans(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of the words (digits, letters, bytes over 127) between the edges of the texts, words per text."""
    signs = np.zeros(256, bool)
    signs[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
    inside = signs[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    head, tail = edges[:-1][np.diff(edges) > 0], edges[1:][np.diff(edges) > 0] - 1
    begins[head], stops[tail] = inside[head], inside[tail]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) - starts + 1, np.diff(np.searchsorted(starts, edges))


def runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, counts: np.ndarray, longest: int) -> tuple[np.ndarray, ...]:
    """Bytes of the words with one blank after each, starts and sizes of all runs of 1 to ``longest`` words, runs per text.

    Runs stand text by text."""
    if longest == 1:
        return data, starts, sizes, counts
    begin = np.cumsum(sizes + 1) - sizes - 1
    clean = np.full(int((sizes + 1).sum()), 32, np.uint8)
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    clean[np.repeat(begin, sizes) + within] = data[np.repeat(starts, sizes) + within]
    owner, ends = np.repeat(np.arange(len(counts)), counts), begin + sizes
    found = []
    for n in range(min(longest, len(starts))):
        ok = np.flatnonzero(owner[n:] == owner[:len(owner) - n])
        found.append((owner[ok], begin[ok], ends[ok + n] - begin[ok]))
    owner, begin, size = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (owner, begin, sizes)
    order = np.argsort(owner, kind="stable")
    return clean, begin[order], size[order], np.bincount(owner, minlength=len(counts))


def features(docs: DataFrame, key: str, text: Column | str, plan: Plan) -> DataFrame:
    """``key``, ``n_words``, ``n_features`` and ``hashed``, the buckets of a text's features (little-endian, 2 or 4 bytes each)."""
    kind = "<u2" if plan.buckets <= 1 << 16 else "<u4"

    def make():
        table = PositionTable()
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32

        def step(texts: pa.Array):
            texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
            edges = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
            held = texts.buffers()[2]
            data = lower[np.frombuffer(held, np.uint8)[edges[0]:edges[-1]]] if held else np.zeros(0, np.uint8)
            starts, sizes, n_words = word_spans(data, edges - edges[0])
            clean, starts, sizes, n = runs(data, starts, sizes, n_words, plan.longest)
            hashed = (table.checksums(clean, starts, sizes) % np.uint32(plan.buckets)).astype(kind)
            stops = np.concatenate(([0], np.cumsum(n))) * hashed.itemsize
            packed = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(n), [None, pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(hashed.tobytes())])
            return [pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), packed.cast(pa.binary())]

        return step

    made = [field("n_words", "long"), field("n_features", "long"), field("hashed", "binary")]
    return arrow_map(docs.select(F.col(key).alias("id"), present(text).alias("__t")), [F.col("__t")], made, make, ["id"])


def buckets_of(column: pa.Array, plan: Plan) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2" if plan.buckets <= 1 << 16 else "<u4")


def bucket_counts(hashed: DataFrame, plan: Plan) -> DataFrame:
    """``bucket`` and ``n``, how many features of the table fall in it; a task sends each bucket once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(plan.buckets, np.int64)
        for b in batches:
            total += np.bincount(buckets_of(b.column(0), plan), minlength=plan.buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["bucket", "n"])

    parts = hashed.select("hashed").mapInArrow(run, T.StructType([field("bucket", "int"), field("n", "long")]))
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, plan: Plan) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's shares in the target and in the source, both with one added to each bucket."""
    s, t = np.zeros(plan.buckets), np.zeros(plan.buckets)
    both = bucket_counts(source, plan).withColumn("of", F.lit(0)).union(bucket_counts(target, plan).withColumn("of", F.lit(1)))
    for r in both.collect():                                       # two rows per bucket at most
        (t if r["of"] else s)[r["bucket"]] = r["n"]
    ratio = (t + 1) * (s.sum() + plan.buckets) / ((s + 1) * (t.sum() + plan.buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def scored(source: DataFrame, gain: np.ndarray, plan: Plan) -> DataFrame:
    """``id``, ``n_words``, ``n_features``, ``weight`` (floored mean gain) and ``score`` (weight plus Gumbel noise of the id)."""
    shared = source.sparkSession.sparkContext.broadcast(gain)

    def make():
        def step(n: pa.Array, hashed: pa.Array):
            n = n.to_numpy()
            upto = np.concatenate(([0], np.cumsum(shared.value[buckets_of(hashed, plan)])))
            ends = np.cumsum(n)
            return [pa.array((upto[ends] - upto[ends - n]) // np.maximum(n, 1), pa.int64())]

        return step

    weighed = arrow_map(source, [F.col("n_features"), F.col("hashed")], [field("weight", "long")], make, ["id", "n_words", "n_features"])
    named = F.concat(F.lit(f"{plan.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, plan: Plan) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3 ... for the drawn rows in descending order of score, null for the others."""
    whole = stored(rows.withColumn("out", F.col("n_words") < plan.least_words).withColumn("uid", F.monotonically_increasing_id()), "scored")
    order = [F.col("out"), F.col("score").desc(), F.col("id").isNull(), F.col("id"), F.col("uid")]
    sorted_ = whole.repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["id", "n_features", "weight", "score", "out"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            place = pa.array(np.arange(seen + 1, seen + b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([*b.columns, place, pa.array(np.full(b.num_rows, part, np.int32))], names=[*names, "place", "part"])
            seen += b.num_rows

    source = sorted_.select(*names)
    schema = T.StructType([*source.schema.fields, field("place", "long"), field("part", "int")])
    placed = stored(source.mapInArrow(run, schema), "placed")
    sums = placed.groupBy("part").agg(F.count("*").alias("rows"), F.count(F.when(~F.col("out"), 1)).alias("n"))
    before = sums.select(                                          # a row for each range
        "part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"),
        F.floor(F.sum("n").over(Window.partitionBy()) * plan.percent / 100).alias("drawn"),
    )
    rank = F.col("before") + F.col("place")
    drawn = ~F.col("out") & (rank <= F.col("drawn"))
    return placed.join(F.broadcast(before), "part").select("id", "n_features", "weight", "score", F.when(drawn, rank).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: Column | str = "text", target_key: str = "item_id",
    plan: Plan = Plan(),
) -> DataFrame:
    """Every row's ``key``, ``n_features``, ``weight``, ``score`` and ``rank`` among the drawn."""
    source = stored(features(docs, key, text, plan), "buckets")
    gain = gains(source, features(target, target_key, text, plan), plan)
    return ranked(scored(source, gain, plan), plan).withColumnRenamed("id", key)


def sql(plan: Plan = Plan()) -> str:
    """The same result in SQL for features of one word, over ``documents`` and ``benchmark``."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = f"regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH steps AS (
  SELECT list(list_reduce(list_concat([n::UBIGINT], range(8)::UBIGINT[]),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, {POLYNOMIAL}::UBIGINT) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)
), d AS (SELECT doc_id, row_number() OVER () AS rid, {lowered} AS ws FROM documents
), dw AS (SELECT rid, unnest(ws) AS w FROM d
), bw AS (SELECT unnest({lowered}) AS w FROM benchmark
), dc AS (SELECT w, count(*) AS n FROM dw GROUP BY w
), bc AS (SELECT w, count(*) AS n FROM bw GROUP BY w
), vocabulary AS (SELECT w FROM dc UNION SELECT w FROM bc
), hashed AS (
  SELECT w, xor(list_reduce(list_concat([4294967295::UBIGINT],
    list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::UBIGINT)),
    lambda c, b: xor(c >> 8, t[(1 + xor(c, b) % 256)::BIGINT])), 4294967295::UBIGINT) % {plan.buckets} AS bucket FROM vocabulary, steps
), s AS (SELECT bucket, sum(n) AS s FROM dc JOIN hashed USING (w) GROUP BY bucket
), t AS (SELECT bucket, sum(n) AS t FROM bc JOIN hashed USING (w) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {plan.buckets})::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {plan.buckets})::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), weights AS (
  SELECT rid, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM dw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY rid
), scores AS (
  SELECT doc_id, rid, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || sha256('{plan.seed}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (rid)
), ranks AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {plan.least_words} ORDER BY score DESC, doc_id NULLS LAST, rid) AS place,
    count(*) FILTER (WHERE n_features >= {plan.least_words}) OVER () AS eligible FROM scores
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= {plan.least_words} AND place <= {plan.percent} * eligible // 100 THEN place END AS rank FROM ranks
"""
