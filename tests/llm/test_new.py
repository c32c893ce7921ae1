"""Min-max hashing, importance resampling and token alignment against brute force, and the cases they define."""

import math
import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sigspark.llm import alignment, importance, minmax, queries
from sigspark.llm.common import table
from sigspark.llm.packing import byte_letters

ODD = [
    None, "", " ", "a", "word " * 80, "\n\n", "Ünï çödé 日本 🙂 " * 30, "same line here\n" * 5, "the quick brown fox " * 3000,
    "x" * 5000, "a\tb\r\nc", "same line here\n" * 5, "a  b   c \n d\n\ne ", "<|endoftext|> <s> </s> <0x41>", "a▁b", "\x00nul\x1c x\x85y z", "é" * 3000,
    "tail  ", "　wide  space", "don't we'll I'M 12345 --", "a\t \nb\n \tc",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [rows[4], (None, "null id is a text"), (None, None), (20, ODD[6])]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("n_a", F.lit(2))


def test_position_table_equals_crc32():
    rng, made = np.random.default_rng(1), importance.PositionTable()
    data = rng.integers(0, 256, 3_000_000, dtype=np.uint8)
    sizes = np.array([0, 1, 2, 63, 64, 65, 128, 129, 200, 4097, 100_000, 1_000_001, *rng.integers(0, 300, 500)])
    starts = rng.integers(0, 1_900_000, len(sizes))
    assert made.checksums(data, starts, sizes).tolist() == [zlib.crc32(data[a:a + n]) for a, n in zip(starts, sizes, strict=True)]
    assert importance.PositionTable(3).checksums(data, starts[:10], sizes[:10]).tolist() == [zlib.crc32(data[a:a + n]) for a, n in zip(starts[:10], sizes[:10], strict=True)]


def plain_features(text, longest, buckets):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else 32 for b in data).split(b" ")
    words = [w for w in words if w]
    runs = [b" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r) % buckets for r in runs]


def plain_resample(docs, target, plan):
    made = [(i, *plain_features(t, plan.longest, plan.buckets)) for i, t in docs]
    s, t = Counter(b for _, _, f in made for b in f), Counter(b for x in target for b in plain_features(x, plan.longest, plan.buckets)[1])
    big_s, big_t, out = sum(s.values()), sum(t.values()), []
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + plan.buckets) / ((s[b] + 1) * (big_t + plan.buckets)))) for b in s}
    for i, n, f in made:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha256(f"{plan.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    drawn = sorted((r for r in out if r[4] >= plan.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, [(r[3], r[0]) for r in drawn[:plan.percent * len(drawn) // 100]]


@pytest.mark.parametrize("plan", [importance.Plan(), importance.Plan(longest=3, buckets=100_000, percent=50, least_words=2, seed=1)])
def test_resampling_against_plain_loops(spark, sf001, odd, plan):
    docs = table(spark, sf001, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).repartition(5)
    target = table(spark, sf001, "benchmark")
    got = importance.resample(docs, target, plan=plan).collect()
    want, drawn = plain_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], plan)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=key) == sorted((tuple(r[:4]) for r in want), key=key)
    assert [(r.score, r.doc_id) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_resampling_odd_tables(spark, odd):
    assert importance.resample(odd.limit(0), odd.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    got = importance.resample(odd, spark.createDataFrame([], "item_id long, text string"), plan=importance.Plan(percent=100, least_words=0)).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, odd.count() + 1))


def plain_alignment(docs):
    first, second = Tokenizer.from_file(queries.BYTE_TOKENIZER), sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    first.encode_special_tokens = True
    letters = {chr(v): k for k, v in byte_letters().items()}
    made, count = [], Counter()
    for i, t in docs:
        a = first.encode(" " + t, add_special_tokens=False).ids if t else []
        b = second.encode(t) if t else []
        left = [bytes(letters[c] for c in first.id_to_token(x)) for x in a]
        pieces = [second.id_to_piece(x) for x in b]
        right = [bytes([int(p[3:5], 16)]) if second.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(b, pieces, strict=True)]
        if t and not b"".join(left) == b"".join(right) == b" " + t.encode():
            a, b, left, right = [], [], [], []
        at = lambda ws: list(np.cumsum([len(w) for w in ws]))
        ea, eb = at(left), at(right)
        links, j0 = [], 0
        for x, (s, e) in enumerate(zip([0, *ea], ea, strict=False)):
            while j0 < len(eb) and eb[j0] <= s:
                j0 += 1
            j = j0
            while j < len(eb) and (eb[j - 1] if j else 0) < e:
                links.append((a[x], b[j]))
                j += 1
        groups = []
        for s, e in zip([0, *sorted(set(ea) & set(eb))], sorted(set(ea) & set(eb)), strict=False):
            groups.append([[i for i, y in zip(ids, ends, strict=True) if s < y <= e] for ids, ends in ((a, ea), (b, eb))])
        count.update(links)
        made.append((i, a, b, groups, links))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [
        (i, len(a), len(b), len(g), len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x),
         sha256(";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in g).encode()).hexdigest() if a else "")
        for i, a, b, g, x in made
    ]


def test_alignment_against_plain_loops(spark, sf001, odd):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect() if len(r.text or "") < 20_000]
    docs += [(r.doc_id, r.text) for r in table(spark, sf001, "documents").collect() if len(r.text or "") < 3000]
    rng = random.Random(5)
    docs += [(1000 + i, "".join(rng.choice(" \n\t'sé日🙂aAbB12#$… \x1c ") for _ in range(rng.randrange(60)))) for i in range(300)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumn("groups", F.lit(1))
    got = alignment.align(
        rows, queries.BYTE_TOKENIZER, queries.PIECE_MODEL, pattern=public_tokenizers.PATTERN, plan=alignment.Plan(block=5000, shard=4000, lanes=3)).collect()
    found = [(r.doc_id, *[r[c.name] for c in alignment.ALIGNED[:6]], sha256(r.groups.encode()).hexdigest() if r.n_a else r.groups) for r in got]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(found, key=key) == sorted(plain_alignment(docs), key=key)


def test_alignment_whole_texts_and_query(spark, sf001):
    texts = [r.text or "" for r in table(spark, sf001, "documents").collect()][:40]
    by_ids, by_file = (alignment.Tokenizers(queries.BYTE_TOKENIZER, queries.PIECE_MODEL, p) for p in (public_tokenizers.PATTERN, None))
    assert by_ids.encode_first.__name__ == "encode_ordinary" and by_ids.encode(texts) == by_file.encode(texts)
    got = queries.op13(spark, sf001)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.count() == table(spark, sf001, "documents").count()
    assert alignment.align(table(spark, sf001, "documents").limit(0), queries.BYTE_TOKENIZER, queries.PIECE_MODEL).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 31, 50_000))
    made = alignment.PerfectHash.unpack(*alignment.PerfectHash.of(keys).pack())
    assert np.array_equal(np.sort(made.index(keys)), np.arange(len(keys)))
    ordered = np.empty_like(keys)
    ordered[made.index(keys)] = keys
    index = alignment.Index(*alignment.PerfectHash.of(keys).pack(), alignment.squeeze(ordered))
    assert (index.places(keys) >= 0).all() and (index.places(keys + (1 << 32)) == -1).all()
    assert alignment.PerfectHash.of(keys[:0]).index(keys[:3]).tolist() == [-1] * 3


def shingles(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def plain_components(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in ((i, j) for i in range(len(docs)) for j in range(i)):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if sets[i]:
            top = find(i)
            least[top] = min(least.get(top, math.inf), math.inf if k is None else k)
    out = []
    for i, (k, _) in enumerate(docs):
        c = least[find(i)] if sets[i] else k
        c = None if c == math.inf else c
        out.append((k, len(sets[i]), c, k == c))
    return out


ids_first = lambda r: tuple((x is None, x or 0) for x in r)


def test_minmax_components_against_all_pairs(spark, sf001, odd):
    docs = [(r.doc_id, r.text) for r in table(spark, sf001, "documents").unionByName(odd.withColumnRenamed("doc_id", "d").select(
        (F.col("d") + 10_000).alias("doc_id"), "text"), allowMissingColumns=True).collect()]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumn("fp", F.lit(1)).withColumn("key", F.lit(2))
    got = sorted((tuple(r) for r in minmax.components(rows).collect()), key=ids_first)
    assert got == sorted(plain_components(docs), key=ids_first)
    assert minmax.components(rows.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [8, 1024])
def test_large_groups_keep_every_link(spark, chunk):
    """A group of texts about 0.8 alike, and one that shares most of its words but stays under 0.8: chunks, then pairs of chunks."""
    rng, docs = random.Random(3), []
    for kind, n, own in (("a", 120, 8), ("b", 120, 14)):
        common = [f"{kind}{i}" for i in range(100)]
        docs += [(len(docs) + i, " ".join([*common, *[f"x{rng.randrange(10 ** 9)}" for _ in range(rng.randrange(own - 4, own + 4))]])) for i in range(n)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = minmax.components(rows, plan=minmax.Plan(chunk=chunk)).collect()
    assert sorted((tuple(r) for r in got), key=ids_first) == sorted(plain_components(docs), key=ids_first)


def test_bands_meet_at_the_least_similarity():
    """Pairs at 0.8 that miss every band: 6 in 100,000 by the formula; values agree with the chance of the similarity."""
    rng, plan, met, share = np.random.default_rng(4), minmax.Plan(), 0, []
    for _ in range(400):
        both = rng.integers(0, 1 << 63, 320).astype(np.uint64)
        left, right = (np.concatenate((both, rng.integers(0, 1 << 63, 40).astype(np.uint64))) for _ in range(2))
        met += bool((minmax.band_keys(left, plan) == minmax.band_keys(right, plan)).any())
        share.append((minmax.signature(left, plan) == minmax.signature(right, plan)).mean())
    assert met >= 399 and abs(np.mean(share) - 0.8) < 0.01
