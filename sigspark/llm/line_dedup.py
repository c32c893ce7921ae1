"""Repeated runs of lines, by winnowing.

A run is a stretch of whole lines that begins and ends with a line that has a word. A run of ``least_words`` words or
more that also stands at an earlier place (smaller document id, then earlier line) is deleted.

Every line gives a hash. The window of a line is the shortest run of ``least_words`` words from it; of each window the
smallest hash is selected, so any two equal runs of that length share a selected line. Only documents that hold a
selected hash found twice are looked at further: their matches are extended forwards and backwards, which is to say
by the shortest windows that start and that end at each line; together these cover every repeated run. Later
occurrences of a window's content are deleted.

Null text: empty, one line without a word. Rows that repeat both id and text count as one document and keep the same
lines. A null id comes before all others. A document whose lines all go stays with an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest, xxh64_intdigest

from sigspark.llm.common import arrow_map, field, present, salted_join, stored, words


def windows(counts: np.ndarray, least: int) -> np.ndarray:
    """First and last line of the shortest run of ``least`` words from each line that has words."""
    upto = np.cumsum(counts)
    first = np.flatnonzero(counts)
    last = np.searchsorted(upto, upto[first] - counts[first] + least)
    return np.stack([first, last], 1)[last < len(counts)]


def both_ways(counts: np.ndarray, least: int) -> np.ndarray:
    """``windows``, and the shortest runs that end at each line."""
    back = len(counts) - 1 - windows(counts[::-1], least)[:, ::-1]
    return np.unique(np.concatenate([windows(counts, least), back]), axis=0)


def selected(hashes: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Line with the smallest hash (the last of equal ones) in each span."""
    return np.array([b - int(np.argmin(hashes[a:b + 1][::-1])) for a, b in spans.tolist()], np.int64)


def profile(docs: DataFrame, key: str, text: Column | str, least: int) -> DataFrame:
    """Per document: digests and word counts of its lines, the hashes of its selected lines."""

    def make():
        def step(texts: pa.Array):
            digests, counts, chosen = [], [], []
            for t in texts.to_pylist():
                lines = [line.encode() for line in t.split("\n")]
                n = np.array([len(words(line)) for line in lines], np.int64)
                spans = windows(n, least)
                hashes = np.array([xxh64_intdigest(line) for line in lines], np.uint64) if len(spans) else n
                digests.append(b"".join(map(xxh3_128_digest, lines)))
                counts.append(n.astype("<i4").tobytes())
                chosen.append(hashes[np.unique(selected(hashes, spans))].view(np.int64).tolist() if len(spans) else [])
            return [pa.array(digests, pa.binary()), pa.array(counts, pa.binary()), pa.array(chosen, pa.list_(pa.int64()))]

        return step

    source = docs.select(F.col(key), present(text).alias("__t")).withColumn("same", F.xxhash64("__t"))
    made = [field("digests", "binary"), field("counts", "binary"), field("chosen", "*long")]
    return arrow_map(source, [F.col("__t")], made, make, [key, "same"])


def occurrences(candidates: DataFrame, key: str, least: int) -> DataFrame:
    """Windows of the candidates in both directions: ``first``, ``last``, ``content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, first, last, content = [], [], [], []
            for i, (digests, counts) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                for x, y in both_ways(np.frombuffer(counts, "<i4").astype(np.int64), least).tolist():
                    rows.append(i)
                    first.append(x)
                    last.append(y)
                    content.append(xxh3_128_digest(digests[16 * x:16 * (y + 1)]))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(first, pa.int32()), pa.array(last, pa.int32()),
                 pa.array(content, pa.binary())], names=[key, "same", "first", "last", "content"],
            )

    schema = T.StructType([
        candidates.schema[key], field("same", "long"), field("first", "int"), field("last", "int"), field("content", "binary"),
    ])
    return candidates.select(key, "same", "digests", "counts").mapInArrow(run, schema)


def later_runs(docs: DataFrame, key: str, text: Column | str, least: int) -> DataFrame:
    """``key``, ``same`` (hash of the text) and ``runs``: first and last lines of what is to go."""
    lines = stored(profile(docs, key, text, least), "lines")
    places = lines.select(key, "same", F.explode("chosen").alias("hash"))
    twice = places.groupBy("hash").count().filter("count > 1").select("hash", F.lit(True).alias("twice"))
    met = salted_join(places, twice, "hash").filter("twice").select(F.col(key).alias("__k"), F.col("same").alias("__s")).distinct()
    on = F.col(key).eqNullSafe(F.col("__k")) & (F.col("same") == F.col("__s"))
    candidates = lines.dropDuplicates([key, "same"]).join(met, on, "left_semi")
    found = stored(occurrences(candidates, key, least), "windows")
    place = F.struct(key, "same", "first")
    firsts = found.groupBy("content").agg(F.min(place).alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = salted_join(found, firsts, "content").filter(F.col("head").isNotNull() & ~F.col("head").eqNullSafe(place))
    return later.groupBy(key, "same").agg(F.collect_list(F.struct("first", "last")).alias("runs"))


def strip_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 50) -> DataFrame:
    """``docs`` with repeated runs deleted from ``text``, and ``n_lines``, ``n_removed``."""
    runs = later_runs(docs, key, text, least_words).select(F.col(key).alias("__k"), F.col("same").alias("__s"), "runs")
    on = F.col(key).eqNullSafe(F.col("__k")) & (F.xxhash64(present(text)) == F.col("__s"))
    made = [field(text, "string"), field("n_lines", "long"), field("n_removed", "long")]
    keep = [c for c in docs.columns if c.lower() not in {f.name.lower() for f in made}]
    joined = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text)).join(runs, on, "left")

    def make():
        def step(texts: pa.Array, first: pa.Array, last: pa.Array):
            out, total, removed = [], [], []
            for t, a, b in zip(texts.to_pylist(), first.to_pylist(), last.to_pylist(), strict=True):
                lines = t.split("\n")
                gone = np.zeros(len(lines) + 1, np.int64)
                np.add.at(gone, a or [], 1)
                np.add.at(gone, [i + 1 for i in b or []], -1)
                gone = np.cumsum(gone)[:-1] > 0
                out.append("\n".join([line for line, g in zip(lines, gone.tolist(), strict=True) if not g]) if a else t)
                total.append(len(lines))
                removed.append(int(gone.sum()))
            return [pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())]

        return step

    return arrow_map(joined, [present(text), F.col("runs.first"), F.col("runs.last")], made, make, keep)


#: The same result in SQL, over a table ``documents``.
SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents
), c AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY p) AS upto FROM l
), runs AS (
  SELECT a.doc_id, a.p AS first, min(b.p) AS last FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.p >= a.p
    AND b.upto >= a.upto - a.n + 50 WHERE a.n > 0 GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.p) AS first, b.p AS last FROM c b JOIN c a ON a.doc_id = b.doc_id AND b.p >= a.p
    AND b.upto >= a.upto - a.n + 50 WHERE b.n > 0 GROUP BY ALL
), held AS (
  SELECT r.doc_id, r.first, r.last, string_agg(c.line, chr(10) ORDER BY c.p) AS content
  FROM runs r JOIN c ON c.doc_id = r.doc_id AND c.p BETWEEN r.first AND r.last GROUP BY ALL
), later AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, first) AS nth FROM held
), gone AS (
  SELECT DISTINCT c.doc_id, c.p FROM later JOIN c ON c.doc_id = later.doc_id AND c.p BETWEEN later.first AND later.last
  WHERE nth > 1
)
SELECT c.doc_id, count(*) AS n_lines, count(gone.p) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY c.p) FILTER (WHERE gone.p IS NULL), '') AS text
FROM c LEFT JOIN gone ON gone.doc_id = c.doc_id AND gone.p = c.p GROUP BY c.doc_id
"""
