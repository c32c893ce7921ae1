"""Quality rules: word counts and compression bands.

Repetitive text compresses far better than prose of its length, random text far worse. ``measure`` takes the
zstandard ratio (compressed / raw bytes) of the whole text and of fixed chunks, and holds each against the band of
its length. The base rules count words and repeated three-word windows.

Null text: empty. An empty text has no words and fails the base rules. Repeated rows are each measured alone. Input
columns named like a result column are replaced; all others are carried. A text under 128 bytes has no band, as the
frame of the format outweighs the content.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import arrow_map, field, present, words

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: Bytes below which a band holds, lowest and highest ratio of prose.
BANDS = (
    (128, 0.0, 9.0), (256, 0.42, 1.10), (512, 0.38, 0.95), (1024, 0.34, 0.85), (2048, 0.31, 0.78), (4096, 0.28, 0.74),
    (8192, 0.26, 0.71), (16384, 0.24, 0.69), (1 << 62, 0.22, 0.68),
)
MADE = [
    field("n_words", "long"), field("word_chars", "long"), field("n_symbols", "long"), field("n_dup_lines", "long"),
    field("n_repeat_words", "long"), field("ratio", "double"), field("bad_chunk_share", "double"),
    field("base_failed", "boolean"), field("kept", "boolean"),
]


@dataclass(frozen=True)
class Limits:
    """``level`` of the compressor, bytes of a chunk, bands, share of bytes that may lie in chunks out of band."""

    level: int = 3
    chunk: int = 4096
    bands: tuple[tuple[int, float, float], ...] = BANDS
    bad_share: float = 0.25
    least_words: int = 50
    repeat_percent: int = 50


def in_band(size: int, packed: int, bands: tuple[tuple[int, float, float], ...]) -> bool:
    _, low, high = next(b for b in bands if size < b[0])
    return low <= packed / max(size, 1) <= high


def repeated_words(tokens: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(tokens) < 4:
        return 0
    seen: dict[bytes, int] = {}
    code = np.fromiter((seen.setdefault(w, len(seen)) for w in tokens), np.int64, len(tokens))
    pair = code[:-1] * len(seen) + code[1:]
    if len(seen) >= 1 << 20:                                   # keep the product within 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(seen) + code[2:]
    _, at, count = np.unique(window, return_inverse=True, return_counts=True)
    hit = np.zeros(len(tokens) + 1, np.int64)
    starts = np.flatnonzero(count[at] > 1)
    hit[starts] += 1
    ends = np.bincount(starts + 3, minlength=len(hit))[:len(hit)]
    return int((np.cumsum(hit - ends)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(BLANKS):
            seen.add(line)
    return n


def verdict(data: bytes, pack: zstandard.ZstdCompressor, limits: Limits) -> tuple[float, float, bool]:
    """Ratio of the whole, share of bytes in chunks out of band, whether the bands accept the text."""
    size = len(pack.compress(data))
    bad = 0
    if len(data) > limits.chunk:
        for i in range(0, len(data), limits.chunk):
            piece = data[i:i + limits.chunk]
            bad += len(piece) * (not in_band(len(piece), len(pack.compress(piece)), limits.bands))
    share = bad / max(len(data), 1)
    return size / max(len(data), 1), share, in_band(len(data), size, limits.bands) and share <= limits.bad_share


def measure(
    df: DataFrame, text: Column | str = "text", limits: Limits = Limits(), carry: Iterable[str] | None = None,
) -> DataFrame:
    """``df`` with its counts, ratios, ``base_failed`` and ``kept``."""

    def make():
        pack = zstandard.ZstdCompressor(level=limits.level)

        def step(texts: pa.Array):
            out: list[list] = [[] for _ in MADE]
            for t in texts.to_pylist():
                data = t.encode()
                tokens = words(data)
                n, again = len(tokens), repeated_words(tokens)
                ratio, share, good = verdict(data, pack, limits)
                failed = n < limits.least_words or 100 * again > limits.repeat_percent * n
                row = (
                    n, len(t) - sum(map(t.count, BLANKS)), sum(map(t.count, SYMBOLS)), duplicate_lines(t), again,
                    ratio, share, failed, not failed and good,
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
            return [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]

        return step

    return arrow_map(df, [present(text)], MADE, make, carry)


def accepted(df: DataFrame, text: Column | str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows whose text is kept, with their own columns."""
    verdicts = measure(df.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in df.columns])), text, limits, ["__row"])
    return verdicts.filter("kept").select("__row.*")
