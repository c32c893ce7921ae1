"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes hashed counts of its words and of its word shapes (letters, capitals, digits and repeats run together,
other signs as they are), log-damped and weighted by inverse document frequency. The leading axes of a bounded sample
of labelled texts project the counts to few dimensions. The sample's projected vectors are broadcast (at most
``sample`` x ``dims`` floats); every text is compared with all of them in blocks of exact cosine products, and its
nearest neighbours vote with their similarity.

Null or empty text: the zero vector, whose score is the share of label 1 in the sample. No usable label: 0.5 for all.
Several labels of one document each count. Labels of null are ignored. Only the text is an input of the score.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sigspark.llm.common import arrow_map, field, present, words

MADE = [field("score", "double"), field("predicted", "int")]
_KINDS = bytes(
    97 if 97 <= b < 123 or b > 127 else 65 if 65 <= b < 91 else 48 if 48 <= b < 58 else b for b in range(256)
)


@dataclass(frozen=True)
class Settings:
    """``sample``: most labelled rows that are fitted and broadcast (smallest hash of the key first)."""

    sample: int = 4000
    words: int = 1024
    shapes: int = 256
    dims: int = 48
    neighbours: int = 15
    power: float = 4.0
    cut: float = 0.3
    block: int = 256
    cache: int = 300_000


def shapes(data: bytes) -> list[bytes]:
    """``ERTI!! word x###`` to ``A! a a#``: kinds of characters, runs together; bytes over 127 count as letters."""
    kinds = np.frombuffer(data.translate(_KINDS), np.uint8)
    if not len(kinds):
        return []
    return kinds[np.flatnonzero(np.concatenate(([True], kinds[1:] != kinds[:-1])))].tobytes().split()


class Counter:
    """Hashed counts of texts; the buckets of recent words are remembered."""

    def __init__(self, s: Settings) -> None:
        self.s, self.known, self.forms = s, {}, {}

    def bucket(self, known: dict[bytes, int], word: bytes, first: int, size: int) -> int:
        got = first + xxh64_intdigest(word) % size
        if len(word) <= 64:
            if len(known) >= self.s.cache:
                known.clear()
            known[word] = got
        return got

    def counts(self, data: bytes) -> np.ndarray:
        """Counts per 100 words; the last place has the words that repeat the one before."""
        s, known, forms = self.s, self.known, self.forms
        tokens = words(data.lower())
        out = np.zeros(s.words + s.shapes + 1, np.float32)
        if tokens:
            at = [known.get(w) or self.bucket(known, w, 1, s.words - 1) for w in tokens]
            at += [forms.get(w) or self.bucket(forms, w, s.words, s.shapes) for w in shapes(data)]
            out += np.bincount(at, minlength=len(out))
            out[-1] = sum(map(bytes.__eq__, tokens, tokens[1:]))
        return out / np.float32(max(1, len(tokens))) * 100


@dataclass
class Model:
    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors: latent axes of the counts, then the share of repeated words at double weight."""
        latent = unit(weighted(counts, self.weight) @ self.axes)
        return unit(np.hstack([latent, counts[:, -1:] / 50]))


def weighted(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return unit(np.log1p(counts[:, :-1]) * weight)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: Column | str = "text", label: str = "quality",
    settings: Settings = Settings(),
) -> Model | None:
    """Axes and labelled vectors from at most ``settings.sample`` rows of ``labels``."""
    s = settings
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("__y"))
        .orderBy(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), key, "__y").limit(s.sample)
    )
    rows = docs.select(F.col(key), present(text).alias("__t")).join(F.broadcast(chosen), key)   # at most `sample` rows

    def make():
        counter = Counter(s)

        def step(texts: pa.Array):
            return [pa.array([counter.counts(t.encode()).astype(np.float16).tobytes() for t in texts.to_pylist()], pa.binary())]

        return step

    got = arrow_map(rows, [F.col("__t")], [field("counts", "binary")], make, [key, "__y"]).collect()
    if not got:
        return None
    got.sort(key=lambda r: (r[key], r["__y"], bytes(r["counts"])))
    counts = np.stack([np.frombuffer(r["counts"], np.float16) for r in got]).astype(np.float32)
    weight = np.log((1 + len(got)) / (1 + (counts[:, :-1] > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    spread = weighted(counts, weight)
    axes = np.linalg.eigh(spread.T @ spread)[1][:, ::-1][:, :s.dims]
    model = Model(weight, np.ascontiguousarray(axes), counts[:0], np.array([r["__y"] for r in got], np.float32))
    model.vectors = model.project(counts)
    return model


def votes(model: Model, vectors: np.ndarray, settings: Settings) -> np.ndarray:
    """Similarity-weighted share of label 1 among each vector's nearest neighbours."""
    close = vectors @ model.vectors.T
    k = min(settings.neighbours, close.shape[1])
    at = np.argpartition(-close, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(close, at, 1), 0).astype(np.float64) ** settings.power
    total = weight.sum(1)
    share = (weight * model.labels[at]).sum(1) / np.maximum(total, 1e-300)
    return np.where(total > 0, share, float(model.labels.mean()))


def score(
    df: DataFrame, model: Model | None, text: Column | str = "text", settings: Settings = Settings(),
    carry: Iterable[str] | None = None,
) -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (score at or over the cut)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted, counter = shared.value, Counter(settings)

        def step(texts: pa.Array):
            parts = []
            for i in range(0, len(texts), settings.block):
                block = texts.slice(i, settings.block).to_pylist()
                if fitted is None:
                    parts.append(np.full(len(block), 0.5))
                else:
                    counts = np.stack([counter.counts(t.encode()) for t in block])
                    parts.append(votes(fitted, fitted.project(counts), settings))
            got = np.concatenate(parts).clip(0, 1)
            return [pa.array(got, pa.float64()), pa.array((got >= settings.cut).astype(np.int32), pa.int32())]

        return step

    return arrow_map(df, [present(text)], MADE, make, carry)
