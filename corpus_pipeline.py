"""Corpus pipeline: quality classifier, quality rules, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet in the shared folder and
reads it as the next stage's documents. All but the last keep every column of their input, whatever its name or type (a
stage carries them in one struct, so none can clash with what it computes). Null texts count as empty; very long texts
take part whole; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm import classifier, line_dedup, packing, quality_rules, simhash
from sigspark.llm.common import remainder, stored, table
from sigspark.llm.queries import WORD_TOKENIZER

#: 54 of 256 bits is three deviations beyond the mean distance (39) of texts whose five-word shingles have a Jaccard
#: similarity of 0.8; 7 splits into 14 blocks of 18 bits let 97 in 100 of the pairs at 0.8 that lie within it meet.
NEAR = simhash.Plan(width=5, bits=256, distance=54, blocks=14, agree=1, rounds=7)


def wrapped(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the whole row as ``__row``."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours of a sample of labelled documents vote for."""
    labels = table(spark, sf_dir, "labels").filter(F.coalesce(remainder("doc_id", 5), F.lit(0)) != 0)
    raw = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classifier.score(wrapped(docs), classifier.fit(raw, labels), carry=["__row"])
    return scored.filter("predicted = 1").select("__row.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word counts and compression bands accept."""
    return quality_rules.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of 50 words or more that stand earlier; ``n_chars``, where there is one, follows the text."""
    cleaned = line_dedup.strip_repeats(wrapped(docs))
    now = {"text": F.col("text"), "n_chars": F.length("text")}
    kinds = dict(docs.dtypes)
    return cleaned.select(*[
        now[c].cast(kinds[c]).alias(c) if c in now else F.col("__row").getField(c).alias(c) for c in docs.columns
    ])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked by fingerprints ``NEAR.distance`` bits apart or less.

    The row of smallest id stays (null last), of tied ids that of the smallest hash of its text, of equal rows any one.
    Rows are told apart by a number written once beside them, not by their ids."""
    numbered = wrapped(docs).withColumn("uid", F.monotonically_increasing_id())
    rows = stored(simhash.fingerprints(numbered, plan=NEAR, carry=["doc_id", "uid", "__row"]), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("__row.text").alias("same"), "uid")
    distinct = stored(rows.groupBy("fp").agg(F.min(place).alias("first")), "distinct")
    roots = simhash.contract(simhash.links(distinct, NEAR))
    of = distinct.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    kept = of.groupBy("root").agg(F.min("first").alias("first")).select("first.uid")
    return rows.join(kept, "uid", "left_semi").select("__row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens along the curve."""
    pieces = packing.pack(docs, WORD_TOKENIZER)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality classifier", quality), ("quality rules", rules), ("line dedup", lines), ("simhash near-dedup", near),
    ("packing", pack),
]
#: The classifier, the compression bands and the curve have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
