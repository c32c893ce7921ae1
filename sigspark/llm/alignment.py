"""Token alignment of two tokenizers, with corpus-wide counts of aligned id pairs.

Both tokenizers write the same bytes, so a token is a byte range. Offsets where tokens of both end cut the tokens into
groups; two tokens are linked where their ranges overlap. Every piece between two neighbouring token ends (of either) is
one link, so a text has fewer links than tokens.

Pass one tokenizes each text once, packs the ids into blocks of about ``block`` tokens and writes them. The distinct id pairs
of each block go, with their counts, to the shard their hash names. A shard merges its keys lane by lane, builds a minimal perfect hash
over them (levels of bits: keys alone at their place in a level stay, the others go on) and keeps the keys in its order; each lane of
blocks then fills a dense vector of counts at the hashed places, and the lanes' vectors are summed. Pass two aligns the blocks again:
a block's keys are looked up in their shards, each verified against the key at its place, and the counts come back. No task
holds more than one shard; there is one for every 4 million pairs that can differ (fewer than the links, and than the product of the vocabularies).
The highest count per id of the second tokenizer (one number per vocabulary entry) is the only thing broadcast.

Null or empty text, and text that the two tokenizers do not both write back byte for byte: no tokens, zeros, no groups.
Null ids and repeated rows are aligned and counted each by itself. Very long texts are aligned whole. An empty table gives no rows. Only the id and the
text are read, so other columns cannot clash.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigspark.llm.common import field, present, stored
from sigspark.llm.packing import byte_letters
from sigspark.llm.simhash import mixed


@dataclass(frozen=True)
class Plan:
    """``block``: tokens aligned at once; ``shard``: pairs that may share a shard; ``lanes``: groups of blocks that a shard adds
    up apart."""

    block: int = 1_000_000
    shard: int = 1 << 22
    lanes: int = 4


def squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def expand(data: bytes, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


class Tokenizers:
    """A byte-level tokenizer file (``first``) and a piece model (``second``) with the bytes of each of their entries.

    Where the file splits by the ``pattern`` named and its ids rise in the order of its merges, a merge of lowest id is the first of
    the file's merges, and tiktoken, which works by ids, encodes in its place; else the file's own library does."""

    def __init__(self, first: str, second: str, pattern: str | None = None) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own, self.second = Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=second)
        own.encode_special_tokens = True
        letters = {chr(v): k for k, v in byte_letters().items()}
        words = {i: bytes(letters[c] for c in w) if set(w) <= letters.keys() else w.encode() for w, i in own.get_vocab().items()}
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        single = re.compile(r"<0x([0-9A-F]{2})>$")
        self.entries = (
            [words.get(i, b"") for i in range(max(words) + 1)],
            [bytes([int(m[1], 16)]) if (m := single.match(p)) and self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)],
        )
        self.sizes = tuple(np.array([len(w) for w in e], np.int64) for e in self.entries)
        if max(map(len, self.entries)) > 1 << 16:
            raise ValueError("ids are packed in 16 bits")
        file = json.loads(own.to_str())
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        vocabulary = file["model"].get("vocab", {})
        made = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1), -1) for m in file["model"].get("merges", [])]
        bytes_first = len(made) + 256 <= len(vocabulary) and all(len(words[i]) == 1 for i in range(256))
        if (pattern and not file["normalizer"] and {k: (file["pre_tokenizer"] or {}).get(k) for k in plain} == plain
                and bytes_first and made == list(range(256, 256 + len(made)))):
            ranks = {words[i]: i for i in range(256 + len(made))}
            self.encode_first = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            self.encode_first = lambda text: own.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Packed ids of both sides; none for an empty text or one that the two do not write back alike."""
        out = []
        for text, right in zip(texts, self.second.encode(texts, num_threads=1), strict=True):
            data = b" " + text.encode()
            left = self.encode_first(" " + text) if text else []
            same = text and all(b"".join(map(e.__getitem__, ids)) == data for e, ids in zip(self.entries, (left, right), strict=True))
            out.append((np.array(left, "<u2").tobytes(), np.array(right, "<u2").tobytes()) if same else (b"", b""))
        return out


class PerfectHash:
    """Minimal perfect hash of distinct keys: level by level, a key that is alone at its place sets the place's bit."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray]) -> None:
        self.sizes, self.bits = sizes, bits
        before = np.cumsum([0, *[int(b.sum()) for b in bits]])
        self.ranks = [n + np.cumsum(b) - 1 for n, b in zip(before, bits, strict=False)]
        self.n = int(before[-1])

    @classmethod
    def of(cls, keys: np.ndarray, spread: float = 2.0) -> PerfectHash:
        sizes, bits, rest = [], [], keys
        while len(rest):
            size = int(spread * len(rest)) + 1
            place = cls.place(rest, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            rest = rest[~alone[place]]
        return cls(sizes, bits)

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys.astype(np.uint64), level + 2) % np.uint64(size)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """A key's place from 0 to n - 1; that of some other key, or -1, for a key it was not built of."""
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, bits) in enumerate(zip(self.sizes, self.bits, strict=True)):
            place = self.place(keys[rest], level, size)
            hit = bits[place]
            out[rest[hit]] = self.ranks[level][place[hit]]
            rest = rest[~hit]
        return out

    def pack(self) -> tuple[list[int], bytes]:
        return self.sizes, squeeze(np.packbits(np.concatenate(self.bits or [np.zeros(0, bool)])))

    @classmethod
    def unpack(cls, sizes: list[int], data: bytes) -> PerfectHash:
        flat = np.unpackbits(expand(data, "u1"), count=sum(sizes)).astype(bool)
        return cls(sizes, np.split(flat, np.cumsum(sizes)[:-1]) if sizes else [])


class Index:
    """The pairs of a shard: hash, keys in its order, counts."""

    def __init__(self, sizes: list[int], bits: bytes, keys: bytes) -> None:
        self.hash, self.keys = PerfectHash.unpack(sizes, bits), expand(keys)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for a key that the shard does not hold."""
        at = self.hash.index(keys)
        return np.where((at >= 0) & (self.keys[at] == keys), at, -1) if len(self.keys) else at


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys.astype(np.uint64), 1) % np.uint64(shards)).astype(np.int64)


class Labels:
    """Ids as decimal text with each of two signs behind, eight bytes each, to be joined without a loop."""

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray]) -> None:
        text = [f"{i}{sign}".encode() for n, signs in zip(map(len, sizes), (",|", ",;"), strict=True) for i in range(n) for sign in signs]
        self.signed, self.bare = (np.array(t, "S8").view("<u8") for t in (text, [t[:-1] for t in text]))
        self.size, self.first = np.array([len(t) for t in text], np.int64), len(sizes[0])

    def joined(self, codes: np.ndarray, ends: np.ndarray) -> pa.Array:
        """A string for each run of codes up to ``ends``, without its last sign."""
        last = ends[np.diff(ends, prepend=0) > 0] - 1
        wide, size = self.signed[codes], self.size[codes]
        wide[last] = self.bare[codes[last]]
        size[last] -= 1
        edges = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], ends))]
        data = wide.view(np.uint8)
        return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(edges), pa.py_buffer(data[data != 0])).cast(pa.string())


class Alignment:
    """Links and groups of the texts of a block; ``a`` and ``b`` hold their ids, ``na`` and ``nb`` their numbers of ids.

    The token ends of both sides are marked on the block's bytes; what lies before a byte is counted by running sums."""

    def __init__(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, sizes: tuple[np.ndarray, np.ndarray]) -> None:
        self.a, self.b, self.na, self.nb = a.astype(np.int64), b.astype(np.int64), na, nb
        self.ends = [np.cumsum(s[x]) for s, x in zip(sizes, (self.a, self.b), strict=True)]
        n = int(self.ends[0][-1]) + 1 if len(a) else 1
        marks = [np.zeros(n, bool) for _ in self.ends]
        for m, e in zip(marks, self.ends, strict=True):
            m[e] = True
        self.shared, either = marks[0] & marks[1], marks[0] | marks[1]
        cuts = np.flatnonzero(either)                                   # one link ends at each
        left, self.right = ((np.cumsum(m, dtype=np.int32) - m)[cuts] for m in marks)
        self.keys = self.a[left] * len(sizes[1]) + self.b[self.right]
        self.before = np.cumsum(self.shared, dtype=np.int32)            # one group ends at each shared mark
        stops = np.concatenate(([0], self.ends[0]))[np.cumsum(na)]
        self.links = np.diff(np.cumsum(either, dtype=np.int32)[stops].astype(np.int64), prepend=0)
        self.groups = np.diff(self.before[stops].astype(np.int64), prepend=0)

    def written(self, labels: Labels) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        last = [self.shared[e] for e in self.ends]
        of = [self.before[e] - x for e, x in zip(self.ends, last, strict=True)]      # group of each token
        codes = np.zeros(len(self.a) + len(self.b), np.int64)
        groups = int(self.before[-1]) + 1
        upto = [np.cumsum(np.bincount(g, minlength=groups)) for g in of]                 # tokens of a side up to each group
        codes[np.arange(len(self.a)) + (upto[1] - np.bincount(of[1], minlength=groups))[of[0]]] = 2 * self.a + last[0]
        codes[np.arange(len(self.b)) + upto[0][of[1]]] = 2 * (labels.first + self.b) + last[1]
        return labels.joined(codes, np.cumsum(self.na + self.nb))


def in_blocks(docs: DataFrame, key: str, text: Column | str, files: tuple[str, str, str | None], plan: Plan) -> DataFrame:
    """``block``, the ``keys`` of its texts, their ids on both sides (``a``, ``b``, 16 bits each) and how many each has (``na``, ``nb``)."""
    source = docs.select(F.col(key).alias("id"), present(text).alias("text"))
    names = ["block", "keys", "a", "b", "na", "nb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n, part = Tokenizers(*files), 0, TaskContext.get().partitionId()
        held: list[tuple[bytes, bytes]] = []
        ids: list[pa.Array] = []
        size = 0

        def block() -> pa.RecordBatch:
            keys = pa.concat_arrays(ids)
            row = [
                pa.array([part << 32 | n]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                *[pa.array([b"".join([h[i] for h in held])], pa.binary()) for i in (0, 1)],
                *[pa.array([[len(h[i]) // 2 for h in held]], pa.list_(pa.int64())) for i in (0, 1)],
            ]
            return pa.RecordBatch.from_arrays(row, names=names)

        for b in batches:
            for i in range(0, b.num_rows, 64):
                got = both.encode(b.column(1).slice(i, 64).to_pylist())
                held += got
                ids.append(b.column(0).slice(i, 64))
                size += sum(len(x) + len(y) for x, y in got) // 2
                if size >= plan.block:
                    yield block()
                    held, ids, size, n = [], [], 0, n + 1
        if held:
            yield block()

    schema = T.StructType([
        field("block", "long"), T.StructField("keys", T.ArrayType(source.schema["id"].dataType)), field("a", "binary"), field("b", "binary"),
        field("na", "*long"), field("nb", "*long"),
    ])
    return source.mapInArrow(run, schema)


def aligned(row: dict, sizes: tuple[np.ndarray, np.ndarray]) -> Alignment:
    return Alignment(
        np.frombuffer(row["a"], "<u2"), np.frombuffer(row["b"], "<u2"), np.array(row["na"], np.int64), np.array(row["nb"], np.int64), sizes,
    )


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each key among the distinct ones in ascending order, these, how often each occurs."""
    codes, found = pd.factorize(keys)
    order = np.argsort(found)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return place[codes], found[order], np.bincount(codes, minlength=len(found))[order]


def sharded(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct ascending keys by shard, end of each shard in it."""
    shard = shard_of(keys, shards)
    order = np.argsort(shard, kind="stable")
    return order, np.cumsum(np.bincount(shard, minlength=shards))


def pair_counts(blocks: DataFrame, shards: int, sizes: tuple[np.ndarray, np.ndarray], plan: Plan) -> DataFrame:
    """``block``, ``shard``, ``lane``, the block's distinct keys of the shard and their counts there."""
    names = ["block", "shard", "lane", "keys", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, keys, counts = distinct(aligned(row, sizes).keys)
                order, stops = sharded(keys, shards)
                rows = [
                    (row["block"], s, ((row["block"] >> 32) + row["block"]) % plan.lanes, squeeze(keys[order[i:j]]), squeeze(counts[order[i:j]]))
                    for s, (i, j) in enumerate(itertools.pairwise([0, *stops.tolist()])) if i < j
                ]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=names)

    made = [field("block", "long"), field("shard", "int"), field("lane", "int"), field("keys", "binary"), field("counts", "binary")]
    return blocks.select("block", "a", "b", "na", "nb").mapInArrow(run, T.StructType(made))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def merged(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The distinct keys of each group of rows."""
    sorted_ = pairs.select(*by, "keys").repartition(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in itertools.groupby(rows_of(batches), key=lambda r: tuple(r[c] for c in by)):
            whole, waiting, n = np.zeros(0, np.int64), [], 0
            for r in rows:
                waiting.append(expand(r["keys"]))
                n += len(waiting[-1])
                if n > max(1 << 20, len(whole)):
                    whole, waiting, n = np.unique(np.concatenate([whole, *waiting])), [], 0
            whole = np.unique(np.concatenate([whole, *waiting]))
            yield pa.RecordBatch.from_arrays([*[pa.array([g], pa.int32()) for g in group], pa.array([squeeze(whole)], pa.binary())], names=[*by, "keys"])

    return sorted_.mapInArrow(run, T.StructType([*[field(c, "int") for c in by], field("keys", "binary")]))


HASHED = [field("shard", "int"), T.StructField("sizes", T.ArrayType(T.LongType())), field("bits", "binary"), field("keys", "binary")]


def hashes(pairs: DataFrame) -> DataFrame:
    """Minimal perfect hash of each shard, its keys in the hash's order."""
    lanes = merged(pairs, ["shard", "lane"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            keys = expand(r["keys"])
            made = PerfectHash.of(keys)
            sizes, bits = made.pack()
            ordered = np.empty_like(keys)
            ordered[made.index(keys)] = keys
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["shard"]], pa.int32()), pa.array([sizes], pa.list_(pa.int64())), pa.array([bits], pa.binary()), pa.array([squeeze(ordered)], pa.binary())],
                names=[f.name for f in HASHED])

    return merged(lanes, ["shard"]).mapInArrow(run, T.StructType(HASHED))


def beside(index: DataFrame, rows: DataFrame, plan: Plan) -> DataFrame:
    """Rows of each shard and lane in one stream, behind the shard's index."""
    copies = index.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(plan.lanes - 1))))
    both = copies.withColumn("block", F.lit(None).cast("long")).unionByName(rows, allowMissingColumns=True)
    return both.repartition("shard", "lane").sortWithinPartitions("shard", "lane", F.col("block").asc_nulls_first())


def totals(index: DataFrame, pairs: DataFrame, plan: Plan) -> DataFrame:
    """``index`` with ``counts``: a dense vector per lane of blocks, then the sum of the lanes' vectors."""

    def lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, lane), rows in itertools.groupby(rows_of(batches), key=lambda r: (r["shard"], r["lane"])):
            head = next(rows)
            known = Index(head["sizes"], head["bits"], head["keys"])
            total = np.zeros(known.hash.n, np.int64)
            for r in rows:
                total[known.places(expand(r["keys"]))] += expand(r["counts"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([lane], pa.int32()), pa.array([squeeze(total)], pa.binary())], names=["shard", "lane", "counts"])

    made = [field("shard", "int"), field("lane", "int"), field("counts", "binary")]
    vectors = beside(index, pairs, plan).mapInArrow(lanes, T.StructType(made))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in itertools.groupby(rows_of(batches), key=lambda r: r["shard"]):
            total: np.ndarray | int = 0
            for r in rows:
                total = total + expand(r["counts"])
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([squeeze(total)], pa.binary())], names=["shard", "counts"])

    sums = vectors.repartition("shard").sortWithinPartitions("shard", "lane").mapInArrow(add, T.StructType([made[0], made[2]]))
    return index.join(sums, "shard")


def highest(index: DataFrame, vocabulary: int) -> np.ndarray:
    """The highest count of a pair for each id of the second tokenizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(vocabulary, np.int64)
        for r in rows_of(batches):
            np.maximum.at(best, expand(r["keys"]) % vocabulary, expand(r["counts"]))
        at = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(best[at])], names=["id", "n"])

    found = index.select("keys", "counts").mapInArrow(run, T.StructType([field("id", "int"), field("n", "long")]))
    out = np.zeros(vocabulary, np.int64)
    for r in found.groupBy("id").agg(F.max("n").alias("n")).collect():  # a row per vocabulary entry at most
        out[r["id"]] = r["n"]
    return out


def looked_up(index: DataFrame, pairs: DataFrame, plan: Plan) -> DataFrame:
    """``block``, ``shard`` and the corpus-wide counts of the block's keys of the shard (0 for a key it does not hold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, _), rows in itertools.groupby(rows_of(batches), key=lambda r: (r["shard"], r["lane"])):
            head = next(rows)
            known, counts = Index(head["sizes"], head["bits"], head["keys"]), expand(head["counts"])
            for r in rows:
                at = known.places(expand(r["keys"]))
                got = squeeze(np.where(at >= 0, counts[at], 0))
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]]), pa.array([shard], pa.int32()), pa.array([got], pa.binary())], names=["block", "shard", "found"])

    asked = beside(index, pairs.drop("counts"), plan)
    return asked.mapInArrow(run, T.StructType([field("block", "long"), field("shard", "int"), field("found", "binary")]))


ALIGNED = [field(c, "long") for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [field("groups", "string")]


def align(
    docs: DataFrame, first: str, second: str, key: str = "doc_id", text: Column | str = "text", pattern: str | None = None, plan: Plan = Plan(),
) -> DataFrame:
    """Per text: numbers of tokens, groups and links, links of the highest count of their second id (``n_best``), the sum of the
    links' counts, and ``groups``, the aligned ids. ``first`` and ``second`` are tokenizer files that every worker reads, ``pattern`` the
    split of the first, if known."""
    local = Tokenizers(first, second, pattern)
    sizes, vocabulary = local.sizes, len(local.entries[1])
    blocks = stored(in_blocks(docs, key, text, (first, second, pattern), plan), "blocks")
    tokens = blocks.agg(F.sum(F.octet_length("a") + F.octet_length("b")) / 2).first()[0] or 0
    shards = max(1, -(-int(min(tokens, len(local.entries[0]) * vocabulary)) // plan.shard))
    pairs = stored(pair_counts(blocks, shards, sizes, plan), "pairs")
    index = stored(totals(stored(hashes(pairs), "hashes"), pairs, plan), "index")
    best = docs.sparkSession.sparkContext.broadcast(highest(index, vocabulary))
    answers = looked_up(index, pairs, plan).groupBy("block").agg(F.collect_list(F.struct("shard", "found")).alias("answers"))
    joined = blocks.join(answers.hint("merge"), "block", "left").drop("block")
    kept = blocks.schema["keys"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = Labels(sizes)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found = aligned(row, sizes)
                at, keys, _ = distinct(found.keys)
                order, _ = sharded(keys, shards)
                counts = np.zeros(len(keys), np.int64)
                got = sorted(row["answers"] or [], key=lambda x: x["shard"])
                counts[order] = np.concatenate([expand(x["found"]) for x in got] or [counts])
                of = counts[at]
                tops = of == best.value[found.b[found.right]]
                stops = np.cumsum(found.links)
                sums = [np.concatenate(([0], np.cumsum(x)))[stops] for x in (tops, of)]
                values = [found.na, found.nb, found.groups, found.links, *[np.diff(x, prepend=0) for x in sums]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1).flatten(), *[pa.array(v, pa.int64()) for v in values], found.written(labels)],
                    names=[key, *[f.name for f in ALIGNED]],
                )

    return joined.select("keys", "a", "b", "na", "nb", "answers").mapInArrow(run, T.StructType([T.StructField(key, kept), *ALIGNED]))
