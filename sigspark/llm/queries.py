"""Registered queries of the operators, and their SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm import (
    alignment, bpe, chat, classifier, importance, line_dedup, lm_scoring, minmax, packing, quality_rules, simhash, span_hash,
    warc,
)
from sigspark.llm.common import remainder, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


@query("op1_event_chat", chat.SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    probe = "\\### Assistant: </turn> ok"
    schema = "conv_id long, turn long, role string, text string"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], schema)
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    message = ("turn", "copy")
    back = chat.parse(chat.render(chat.fold(chat.events_of(turns), message=message), message=message))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = F.array_join("learnt", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op2_warc_index", warc.SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, sf, "pages")), payloads=False)
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_bloom_lm")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf), remainder("doc_id", 7) == 2)


@query("op4_line_winnowing", line_dedup.SQL)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.strip_repeats(documents(spark, sf))


@query("op5_simhash_components")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.components(documents(spark, sf))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query("op6_span_hashes")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return span_hash.fingerprint_edits(documents(spark, sf))


@query("op7_curve_packing")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf), WORD_TOKENIZER)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op8_prefix_bpe")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(documents(spark, sf), BYTE_RANKS, public_tokenizers.PATTERN, carry=["doc_id"]))


@query("op9_neighbour_votes")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").filter(F.coalesce(remainder("doc_id", 5), F.lit(0)) != 0)
    docs = documents(spark, sf)
    scored = classifier.score(docs, classifier.fit(docs, labels), carry=["doc_id"])
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op10_compression_bands")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.measure(documents(spark, sf), carry=["doc_id"])


@query("op11_minmax_components")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return minmax.components(documents(spark, sf))


@query("op12_importance_resampling", importance.sql())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return importance.resample(documents(spark, sf), table(spark, sf, "benchmark"))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    found = alignment.align(documents(spark, sf), BYTE_TOKENIZER, PIECE_MODEL, pattern=public_tokenizers.PATTERN)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
