"""The operators against brute force, round trips and the cases every operator defines."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from oracle import compare, connect
from sigspark.llm import bpe, chat, classifier, line_dedup, lm_scoring, packing, quality_rules, queries, simhash, span_hash, warc
from sigspark.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None, "", " ", "a", "word " * 80, "\n\n", "Ünï çödé 日本 🙂 " * 30, "same line here\n" * 5, "the quick brown fox " * 3000,
    "x" * 5000, "a\tb\r\nc", "same line here\n" * 5,
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(ODD)]
    rows += [rows[4], (None, "null id", None, None, None), (20, ODD[6], None, None, 7)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(spark, sf):
    return {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf001, name):
    assert compare(spark, connect(sf001), sf001, name, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_chat_folds_edits_and_regenerations(spark):
    log = [
        (1, 0, 0, "open", "user", "hi"), (1, 1, 1, "open", "assistant", ""), (1, 1, 2, "delta", None, "one"),
        (1, 2, 3, "open", "user", "more"), (1, 1, 4, "regenerate", None, None), (1, 1, 5, "delta", None, "tw"),
        (1, 1, 6, "delta", None, "o\\</turn>"), (1, 0, 7, "edit", None, "hello"), (1, 3, 8, "open", "a:b", None), (2, 0, 0, "open", None, ""),
        (1, 3, 9, "unknown", None, "lost"),
    ]
    events = spark.createDataFrame(log, "conv_id long, message int, seq int, kind string, role string, text string")
    back = {r.conv_id: r for r in chat.parse(chat.render(chat.fold(events))).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", "hello"), ("assistant", "two\\</turn>"), ("a:b", "")]
    assert "".join(back[1].learnt) == "two\\</turn>" and [tuple(t) for t in back[2].turns] == [("", "")]
    assert chat.render(chat.fold(events.limit(0))).count() == 0


def test_chat_repeated_and_null_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None), (1, 1, "assistant", "é" * 300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.render(chat.fold(chat.events_of(turns), message=("turn", "copy")), message=("turn", "copy"))
    back = {r.conv_id: r.turns for r in chat.parse(got).collect()}
    assert [t.text for t in back[1]] == ["a", "a", "é" * 300] and len(back[None]) == 1


def test_warc_selected_records(spark):
    long = "<p>" + "x" * 200
    rows = [(3, "u\n3", long), (1, None, long), (2, "u2", long), (4, "u4", None), (5, "u5", "short"), (6, "u6", "short"), (None, "n", long), (1, "again", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write(pages, roll=100)
    got = sorted(tuple(r) for r in warc.read(index, payloads=False).select("id", "record_type", "refers_to").fillna(-1).collect())
    assert got == [(-1, "revisit", 1), (1, "response", -1), (1, "response", -1), (2, "revisit", 1), (3, "revisit", 1),
                   (4, "response", -1), (5, "response", -1), (6, "response", -1)]
    some = warc.read(index.filter("id in (4, 5)"), gap=0, most=64).collect()
    assert sorted(bytes(r.payload) for r in some) == [b"", b"short"]
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_lm_base_is_exact(spark, sf001):
    docs = texts(spark, sf001)
    tokens = {i: [w.decode() for w in t.encode().lower().split()] + [""] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    count: dict[str, int] = {}
    for i, ws in tokens.items():
        for w in ws if not held[i] else ():
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    rows = queries.op3(spark, sf001).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ws = tokens[r.doc_id]
        assert r.base_score == pytest.approx(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in ws))
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(w in count for w in ws), n, held[r.doc_id])
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_bloom_counts(spark):
    s = lm_scoring.Settings(filter_bits=1 << 19)
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 47, 1500, dtype=np.uint64))
    counts = np.random.default_rng(2).integers(1, 50, 1500)
    assert np.array_equal(lm_scoring.unpack_keys(lm_scoring.pack_keys(keys)), keys)
    bits = lm_scoring.build_slice(keys, counts, s.filter_bits // 2 // 64 * 64, s)
    got = lm_scoring.Filter(np.concatenate([bits, np.zeros_like(bits)]), 2, 12, s).counts(keys)
    low = np.ceil(s.base ** np.floor(np.log(counts) / np.log(s.base) + 1e-9) - 1e-9)
    assert (got >= low).all() and (got == low).mean() > 0.9


def test_bigrams_beyond_one_filter_are_learnt(spark):
    """A filter of 1024 bits, as it stood for all slices, holds 177 of these 20,000 bigrams."""
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 300, 200))) for i in range(100)]
    s = lm_scoring.Settings(block=1 << 14, filter_bits=1 << 10, shard_bigrams=3000)
    got = lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") >= 90, settings=s).collect()
    unigrams, bigrams = Counter(), Counter()
    runs = {i: ["", *t.split(), ""] for i, t in docs}
    for i, run in runs.items():
        if i < 90:
            unigrams.update(run[1:])
            bigrams.update(zip(run, run[1:]))
    total, rate = sum(unigrams.values()), len(bigrams) / sum(c ** s.power for c in unigrams.values())
    agree = 0
    for r in got:
        want = 0.0
        for v, w in zip(runs[r.doc_id], runs[r.doc_id][1:]):
            low = np.ceil(s.base ** np.floor(np.log(bigrams[v, w]) / np.log(s.base) + 1e-9) - 1e-9) if bigrams[v, w] else 0
            trust = 1 / (1 + rate * unigrams[v] ** (s.power - 1))
            want += np.log10(trust * low / unigrams[v] + (1 - trust) * (unigrams[w] + 1) / (total + len(unigrams) + 1))
        agree += abs(r.score - want) < 0.5
    assert len(got) == 100 and agree >= 98


def test_simhash_components(spark, sf001):
    docs = texts(spark, sf001)
    prints = {}
    for i, t in docs.items():
        w = t.encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[k:k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints[i] = sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))
    root = {i: i for i in docs}
    ids = sorted(docs)
    for _ in ids:
        before = dict(root)
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    for r in queries.op5(spark, sf001).collect():
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", root[r.doc_id])


def test_large_block_groups_are_cut(spark):
    rng = np.random.default_rng(3)
    fps = [int(x).to_bytes(8, "big") for x in {int(0) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))}]
    df = spark.createDataFrame([(f,) for f in fps], "fp binary")
    for chunk in (8, 4096):
        roots = simhash.contract(simhash.links(df, simhash.Plan(chunk=chunk)))
        near = np.array([int.from_bytes(f, "big") for f in fps], np.uint64)
        alone = sum(int((np.bitwise_count(near ^ x) <= 3).sum()) == 1 for x in near)
        assert roots.count() + roots.select("root").distinct().count() == len(fps) - alone


@pytest.mark.parametrize(("similarity", "least"), [(0.8, 0.96), (0.85, 0.985), (0.9, 0.998)])
def test_rounds_of_blocks_meet(similarity, least):
    rng, plan = np.random.default_rng(3), corpus_pipeline.NEAR
    flips = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    left = rng.integers(0, 2, (20_000, plan.bits)).astype(np.uint8)
    right = left ^ (rng.random(left.shape) < flips)
    near = (left != right).sum(1) <= plan.distance
    keys = [simhash.block_keys(x[near], plan) for x in (left, right)]
    assert keys[0].shape[1] == plan.blocks * plan.rounds
    assert (keys[0] == keys[1]).any(1).mean() >= least


def test_span_equality_and_extension():
    random.seed(4)
    a = "".join(random.choice("ab é日") for _ in range(300))
    b = a[:170] + "#" + a[171:]
    x, y = span_hash.PrefixHash(a), span_hash.PrefixHash(b)
    for _ in range(200):
        i, j, n = random.randrange(250), random.randrange(250), random.randrange(50)
        assert (x.span(i, i + n) == y.span(j, j + n)) == (a[i:i + n] == b[j:j + n])
    assert x.extension(0, y, 0) == 170 and x.extension(171, y, 171) == 129


def test_edits_follow_descending_ids(spark, odd):
    rows = odd.orderBy("doc_id").collect()
    order = sorted((r for r in rows if r.doc_id is not None), key=lambda r: -r.doc_id) + [r for r in rows if r.doc_id is None]
    got = span_hash.fingerprint_edits(odd).collect()
    assert len(got) == len(rows)
    want = set()
    for i, r in enumerate(order):
        t, u = r.text or "", order[(i + 1) % len(order)].text or ""
        edited = t[:len(t) - len(t) // 3] + u[:len(t) // 3]
        want.add((r.doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in got} == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_rows_without_id_are_spread(spark):
    """A third of the rows has no id, a third one id: both are dealt like any other stretch, one row a bucket is lent."""
    rng = random.Random(2)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"t{rng.randrange(10 ** 9)}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own, lent = span_hash.dealt(docs, "doc_id")
    sizes = own.groupBy("bucket").count().toPandas()
    assert len(sizes) > 8 and sizes["count"].max() < 3 * sizes["count"].mean() and lent.count() == len(sizes)
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [r for r in rows if r[0] is None]
    got = span_hash.fingerprint_edits(docs.withColumn("bucket", F.lit("x")).withColumn("ahead", F.lit(True))).collect()
    assert len(got) == len(order) and span_hash.fingerprint_edits(docs.limit(0)).count() == 0


def test_packing_covers_every_token_once(spark, odd):
    tokenizer = Tokenizer.from_file(queries.WORD_TOKENIZER)
    want = sorted(((r.doc_id is None, r.doc_id or 0), tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in odd.collect())
    pieces = packing.pack(odd, queries.WORD_TOKENIZER, capacity=64).collect()
    stream = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    ends = [s * 64 + o + n for s, o, n in stream]
    assert [s * 64 + o for s, o, _ in stream] == [0, *ends[:-1]] and ends[-1] == sum(len(i) for _, i in want)
    by: dict = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset + p.length <= 64
        by.setdefault(p.doc_id, []).extend(np.frombuffer(p.ids, "<u4").tolist())
    for k in {k for k, _ in want}:
        assert sorted(by[None if k[0] else k[1]]) == sorted(x for j, i in want if j == k for x in i)


def test_packing_tokenizes_a_word_once():
    """Whatever its case and the signs after it."""
    tokenizer, words = Tokenizer.from_file(queries.WORD_TOKENIZER), packing.WordTokenizer(queries.WORD_TOKENIZER)
    few = packing.WordTokenizer(queries.WORD_TOKENIZER, cache=4)
    asked, batches, model, batch = [], [], words.model, words.whole
    words.model, words.whole = lambda form: asked.append(form) or model(form), lambda some: batches.append(list(some)) or batch(some)
    texts = ["Stone, STONE stone.!! été$$$\nÉTÉ. stone,", "it's stone, " + "Long" * 50, "don't. a_b # stone#", ""]
    for _ in range(3):
        for t in texts:
            ids = np.frombuffer(words.encode([t, t], b"")[1], "<u4").tolist()
            assert ids == tokenizer.encode(t, add_special_tokens=False).ids
            assert few.encode([t], b"") == [np.array(ids, "<u4").tobytes()]
    assert asked.count("stone") == 1 and sum(b.count(",") for b in batches) == 1
    assert max(map(len, words.known)) <= packing.LONG


def test_hilbert_is_a_walk():
    points = np.array([[i, j, k] for i in range(8) for j in range(8) for k in range(8)])
    path = points[np.argsort(packing.hilbert(points, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bpe_equals_the_library(spark, odd):
    ranks = bpe.read_ranks(queries.BYTE_RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.round_trip(odd, queries.BYTE_RANKS, public_tokenizers.PATTERN).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    random.seed(5)
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    many = ["".join(random.choice(" \n\t'sé日🙂aAbB12#$…") for _ in range(random.randrange(50))) for _ in range(500)]
    assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(many)] == [library.encode_ordinary(t) for t in many]


def test_bpe_encodes_a_word_once():
    """Whatever the signs after it; new words leave those in use remembered; all lists are decoded at once."""
    ranks, asked = bpe.read_ranks(queries.BYTE_RANKS), []
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, few = bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.Encoder(ranks, public_tokenizers.PATTERN, cache=4)
    piece = encoder.table.piece
    encoder.table.piece = lambda data: asked.append(data) or piece(data)
    texts = [
        "Zanthe a zanthe, zanthe.!! zanthe$$$\nZanthe. zanthe\nZanthe,", "a\n zanthe \nzanthe\n\nzanthe\t\nb", "it's zanthe's", "", "\n", " b",
        "\nb ", "Zanthe, b\u00a0c\u0301 a_b", "a " + "long" * 50 + " b\r\nc", "zanthe zanthe zanthe",
    ]
    for t in texts:
        for each in (encoder, few):
            ids, = each.encode([t])
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
    encoder.encode(texts[:1])
    assert asked.count(b" zanthe") == 1 and asked.count(b",") == 1
    assert encoder.table.decode_all(encoder.encode(texts)).to_pylist() == [t.encode() for t in texts]
    assert encoder.table.decode_all([]).to_pylist() == []


def test_bpe_append_and_edit():
    prefixes = bpe.PrefixTable(bpe.read_ranks(queries.BYTE_RANKS))
    piece, last = b"unbeliev", prefixes.extend(b"unbeliev", [])
    longer, more = prefixes.append(piece, last[:], b"ableness")
    assert more[:8] == last and more == prefixes.extend(longer, [])
    changed, again = prefixes.edit(longer, more[:], 3, 5, b"XYZ")
    assert changed == b"unbXYZievableness" and again == prefixes.extend(changed, []) and prefixes.decode(prefixes.tokens(again)) == changed


def test_classifier_on_held_out(spark, sf01):
    scored = queries.op9(spark, sf01).join(table(spark, sf01, "labels"), "doc_id").filter("held_out")
    right = scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.95


def test_votes_equal_a_plain_loop():
    """Every document against every labelled vector, the nearest ones by cosine, their labels weighted by similarity."""
    rng, s = np.random.default_rng(9), classifier.Settings()
    known = classifier.unit(rng.normal(size=(300, 12)).astype(np.float32))
    model = classifier.Model(np.zeros(0), np.zeros((0, 0)), known, rng.integers(0, 2, 300).astype(np.float32))
    asked = classifier.unit(np.concatenate([rng.normal(size=(60, 12)), known[:5], np.zeros((2, 12))]).astype(np.float32))
    got = classifier.votes(model, asked, s)
    for row, share in zip(asked, got, strict=True):
        near = sorted(((float(row @ k), float(y)) for k, y in zip(known, model.labels, strict=True)), reverse=True)[:s.neighbours]
        weight = [max(c, 0.0) ** s.power for c, _ in near]
        want = sum(w * y for w, (_, y) in zip(weight, near, strict=True)) / sum(weight) if sum(weight) > 0 else float(model.labels.mean())
        assert share == pytest.approx(want, abs=1e-5)


def test_classifier_odd_cases(spark, odd, empty):
    labels = spark.createDataFrame([(4, 0), (8, 1), (None, 1), (9, None)], "doc_id long, quality int")
    rows = classifier.score(odd, classifier.fit(odd, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in classifier.score(odd, classifier.fit(odd, labels.limit(0))).collect()} == {0.5}
    assert classifier.score(empty, None).count() == 0


def test_rules_against_plain_counts(spark, odd):
    wide = odd.withColumn("N_WORDS", F.lit("taken"))
    for r in quality_rules.measure(wide).collect():
        t = r.text or ""
        ws = t.encode().split()
        at = {tuple(ws[i:i + 3]): [] for i in range(len(ws) - 2)}
        for i in range(len(ws) - 2):
            at[tuple(ws[i:i + 3])].append(i)
        again = {i + j for places in at.values() if len(places) > 1 for i in places for j in range(3)}
        lines = t.split("\n")
        dup = sum(1 for i, x in enumerate(lines) if x.strip() and x in lines[:i])
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(ws), len(again), dup)
        assert r.word_chars == sum(len(w.decode()) for w in ws) and r.base_failed == (len(ws) < 50 or 100 * len(again) > 50 * len(ws))
        assert not (r.kept and r.base_failed)


def test_rules_reject_noise_and_keep_prose(spark, sf01):
    random.seed(6)
    noise = " ".join("".join(random.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/") for _ in range(60)) for _ in range(90))
    assert not quality_rules.measure(spark.createDataFrame([(noise,)], "text string")).first().kept
    good = table(spark, sf01, "documents").join(table(spark, sf01, "labels").filter("quality = 1"), "doc_id")
    assert quality_rules.measure(good).filter("not kept and not base_failed").count() == 0


def test_lines_odd_cases(spark, odd, empty):
    long = "\n".join(f"line {i} of a passage with several words in it" for i in range(9))
    docs = odd.unionByName(spark.createDataFrame([(90, "head\n" + long, "", "", 0), (91, long + "\ntail", "", "", 0), (91, long + "\ntail", "", "", 0)], SCHEMA))
    got = line_dedup.strip_repeats(docs).collect()
    assert len(got) == docs.count()
    assert [r.text for r in got if r.doc_id == 91] == ["tail", "tail"] and [r.n_removed for r in got if r.doc_id == 90] == [0]
    assert line_dedup.strip_repeats(empty).count() == 0


def test_pipeline(spark, sf001, odd, empty, tmp_path):
    sent = {r.doc_id for r in corpus_pipeline.run(spark, sf001).collect()}
    docs = table(spark, sf001, "documents")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf001)
        assert kept.columns == docs.columns
    assert sent == {r.doc_id for r in kept.select("doc_id").collect()} and 0 < len(sent) < docs.count()
    for rows in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, rows, sf001).count()
    near = corpus_pipeline.near(spark, odd, sf001).collect()
    assert sorted(r.doc_id for r in near if (r.text or "").strip() == "") == [0]


def test_near_keeps_clean_texts_of_tied_and_null_ids(spark, sf001):
    rng = random.Random(6)
    a, b, c, d = (" ".join(f"{k}{rng.randrange(10 ** 6)}" for _ in range(400)) for k in "abcd")
    rows = [(3, a), (5, b), (5, a + " end"), (5, b), (None, c), (None, d), (None, d + " end"), (7, c + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.text[0]) for r in corpus_pipeline.near(spark, docs, sf001).collect()]
    assert sorted(got, key=str) == [(3, "a"), (5, "b"), (7, "c"), (None, "d")]


def test_near_finds_pairs_from_the_least_similarity_on(spark, sf001):
    """Pairs just over 0.8 in five-word shingles are caught, pairs that share a third of their text are not."""
    rng, rows = random.Random(8), []
    for i in range(200):
        n = (356, 200)[i % 2]                                           # shingles in common: similarity 0.80 or 0.33
        same = [f"w{rng.randrange(10 ** 6)}" for _ in range(n + 4)]
        for side in range(2):
            rows.append((2 * i + side, " ".join(same + [f"x{rng.randrange(10 ** 6)}" for _ in range(400 - n)])))
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = {r.doc_id for r in corpus_pipeline.near(spark, docs, sf001).collect()}
    alike = [i for i in range(0, 400, 2) if len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8]
    assert len(alike) == 100 and sum(i + 1 not in got for i in alike) >= 95
    assert got >= set(sets) - {i + 1 for i in alike}


def test_stages_keep_every_column(spark, sf001):
    """Columns named like results, a name with a dot, a map; null, empty and very long texts; the values stay."""
    rows = [(1, None), (2, ""), (3, "the quick brown fox jumps over the lazy dog " * 2000), (4, "word")]
    docs = table(spark, sf001, "documents").unionByName(
        spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA))
    wide = docs.select(
        "*", F.col("doc_id").alias("score"), F.lit("p").alias("predicted"), F.col("doc_id").alias("n_lines"), F.lit(1).alias("fp"),
        F.lit(2).alias("uid"), F.col("doc_id").alias("a.b"), F.create_map(F.lit("k"), F.col("doc_id")).alias("tags"),
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, sf001)
        assert got.columns == wide.columns and got.count() > 0
        off = "not (score <=> doc_id and n_lines <=> doc_id and `a.b` <=> doc_id and tags['k'] <=> doc_id and predicted = 'p')"
        assert got.filter(off).count() == 0 and got.filter("fp <> 1 or uid <> 2 or n_chars <> length(text)").count() == 0


def test_lm_exchanges_carry_numbers_in_planes_and_no_places(spark):
    numbers = np.array([0, 1, 255, 256, 70_000, 5 << 40, 3] * 50)
    assert np.array_equal(lm_scoring.unpack_numbers(lm_scoring.pack_numbers(numbers)), numbers)
    assert len(lm_scoring.pack_numbers(np.ones(100_000, np.int64))) < 1000
    s = lm_scoring.Settings(block=200)
    docs = spark.createDataFrame([(i, f"one two w{i} one") for i in range(60)], "doc_id long, text string").coalesce(2)
    blocks = lm_scoring.in_blocks(docs, "doc_id", "text", F.col("doc_id") < 0, s)
    totals = lm_scoring.word_totals(blocks, 3, s)
    assert "at" not in totals.columns
    rows = {(r.block, r.shard): lm_scoring.unpack_numbers(r.totals) for r in totals.collect()}
    for b in blocks.collect():
        words = lm_scoring.expand(b.vocabulary).split(b" ")
        places, shard = lm_scoring.dealt_words(lm_scoring.word_hashes(words), 3)
        got = np.concatenate([rows[b.block, n] for n in np.unique(shard)])
        assert [int(c) for c in got] == [{b"": 60, b"one": 120, b"two": 60}.get(words[p], 1) for p in places]
