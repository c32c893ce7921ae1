"""Byte-level BPE by prefix dynamic programming.

The BPE encoding of every prefix of a piece ends in one certain token. ``last`` holds that token for each prefix of a
piece: the token ``t`` ending at ``i`` for which the prefix before it ends in a token that is compatible with ``t``,
that is, for which BPE leaves the two bytes strings side by side as they are. Following the tokens back from the end
gives the whole encoding; appending bytes adds entries and changes none; an edit keeps the entries before it.

``encode`` splits each text by the tokenizer's pattern and encodes every match by itself. Null text: empty, no ids.
Texts of any length are encoded whole; a piece costs time in proportion to its bytes. Repeated rows are each encoded;
input columns named like a result column are replaced.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import arrow_map, field, present


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token, its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PrefixTable:
    """Last tokens of prefixes under the given ranks. Holds what it learns about pairs of tokens."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {rank: data for data, rank in ranks.items()}
        self.size = {rank: len(data) for data, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.pairs: dict[int, bool] = {}
        self.ends: dict[bytes, tuple[list[bytes], list[bytes]]] = {}
        self.recent: tuple[bytes, list[int]] = (b"", [])

    def halves(self, data: bytes) -> tuple[bytes, bytes]:
        """The two tokens whose merge makes this one: plain BPE, stopped before its last step."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 2:
            _, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def outer(self, data: bytes) -> tuple[list[bytes], list[bytes]]:
        """Tokens that stand at the left edge and at the right edge while this token is built, byte first."""
        got = self.ends.get(data)
        if got is None:
            if len(data) == 1:
                got = ([data], [data])
            else:
                left, right = self.halves(data)
                got = (self.outer(left)[0] + [data], self.outer(right)[1] + [data])
            self.ends[data] = got
        return got

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes gives these two tokens.

        Both sides grow in order of rank; they are apart if no merge across the border is ever due first. Of equal
        ranks the leftmost merge is due first.
        """
        got = self.pairs.get(left << 24 | right)
        if got is not None:
            return got
        ranks, never = self.ranks, 1 << 62
        a, b = self.outer(self.token[left])[1], self.outer(self.token[right])[0]
        i = j = 0
        while True:
            grow_a = ranks[a[i + 1]] if i + 1 < len(a) else never
            grow_b = ranks[b[j + 1]] if j + 1 < len(b) else never
            across = ranks.get(a[i] + b[j], never)
            if across < grow_a and across <= grow_b:
                got = False
                break
            if grow_a == grow_b == never:
                got = True
                break
            if grow_a <= grow_b:
                i += 1
            else:
                j += 1
        self.pairs[left << 24 | right] = got
        return got

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Complete ``last``, which holds the last tokens of the first ``len(last)`` prefixes, for the whole piece."""
        rank, pair, add, longest = self.ranks.get, self.pairs.get, last.append, self.longest
        for end in range(len(last) + 1, len(piece) + 1):
            start = end - 1
            while start >= 0 and end - start <= longest:                      # exactly one token fits
                token = rank(piece[start:end])
                if token is not None:
                    if not start:
                        break
                    before = last[start - 1]
                    ok = pair(before << 24 | token)
                    if ok or ok is None and self.compatible(before, token):
                        break
                start -= 1
            else:
                raise ValueError("the ranks lack a single byte")
            add(token)
        return last

    def shared(self, piece: bytes) -> list[int]:
        """Last tokens of the piece's prefixes, starting from those it shares with the piece before."""
        before, last = self.recent
        n = 0
        for x, y in zip(before, piece):
            if x != y:
                break
            n += 1
        self.recent = piece, self.extend(piece, last[:n])
        return self.recent[1]

    def append(self, piece: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """The piece with bytes appended; earlier entries stay."""
        piece += more
        return piece, self.extend(piece, last)

    def edit(self, piece: bytes, last: list[int], start: int, stop: int, by: bytes) -> tuple[bytes, list[int]]:
        """The piece with ``[start:stop]`` replaced; entries before ``start`` are kept."""
        piece = piece[:start] + by + piece[stop:]
        return piece, self.extend(piece, last[:start])

    def tokens(self, last: list[int]) -> list[int]:
        """Encoding of the piece whose prefixes end in ``last``."""
        out, at, size = [], len(last), self.size
        while at:
            token = last[at - 1]
            out.append(token)
            at -= size[token]
        out.reverse()
        return out

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.tokens(self.shared(data))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    @functools.cached_property
    def entries(self) -> pa.Array:
        """Bytes of each id, null for ids without a token."""
        return pa.array(map(self.token.get, range(max(self.token, default=-1) + 1)), pa.large_binary())

    def decode_all(self, packed: list[bytes]) -> pa.Array:
        """Bytes of each packed id list."""
        ids, ends = np.frombuffer(b"".join(packed), "<u4"), np.cumsum([0, *(len(i) // 4 for i in packed)])
        tokens = self.entries.take(pa.array(ids))
        if tokens.null_count:
            raise KeyError("an id without a token")
        _, places, data = tokens.buffers()
        cuts = np.frombuffer(places, np.int64)[ends]                         # a list's tokens lie side by side
        return pa.Array.from_buffers(pa.large_binary(), len(packed), [None, pa.py_buffer(cuts), data]).cast(pa.binary())


#: Signs that the pattern takes together after letters; the apostrophe, which may go with letters, is none of them.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoder:
    """Texts to packed ids. Words between single blanks or line ends are remembered with their ids.

    A text is cut before its blanks and line ends; the pattern gives the same pieces for " word" and "\\nword" alone as
    inside the text unless other white space meets the cut. Such texts are split whole. A word is held without its blank
    or with its line end; the text's first word as if a line end came before, whose id (one: it is a single byte) is
    taken off again. Letters and the signs after them are pieces by themselves and remembered so.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 400_000) -> None:
        self.table, self.split, self.cache = PrefixTable(ranks), regex.compile(pattern).findall, cache
        self.known: dict[str, bytes | None] = {}
        self.signs: dict[str, bytes] = {"": b""}

    def piece(self, piece: str) -> bytes:
        got = self.known.get(piece[1:]) if piece[0] == " " else None
        return got or packed(self.table.piece(piece.encode()))

    def pieces(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.split(text)))

    def sign(self, signs: str) -> bytes:
        got = self.signs.get(signs)
        if got is None:
            got = packed(self.table.piece(signs.encode()))
            if len(self.signs) < self.cache:                                 # words are short, so are their signs
                self.signs[signs] = got
        return got

    def learn(self, words: Iterable[str]) -> None:
        """Ids of the words, those of letters in sorted order as neighbours share prefixes; None if they touch white space."""
        known, piece = self.known, self.table.piece
        if len(self.table.pairs) >= 2 * self.cache:
            self.table.pairs.clear()
        line = packed(piece(b"\n"))
        letters, ended, mixed = set(), [], []
        for word in words:
            body = word.rstrip(SIGNS)
            bare = body[1:] if body[:1] == "\n" else body
            if bare.isalpha() and (bare.isascii() or max(bare) < "\u0800"):      # one piece
                if body not in known:
                    letters.add(body)
                if body is not word:
                    ended.append((word, body))
            else:
                mixed.append(word)
        for body in sorted(letters):
            known[body] = line + packed(piece(body[1:].encode())) if body[0] == "\n" else packed(piece(b" " + body.encode()))
        for word, body in ended:
            known[word] = known[body] + self.sign(word[len(body):])
        for word in mixed:
            bare = word[1:] if word[:1] == "\n" else word
            clean = bare and not bare[0].isspace() and not bare[-1].isspace()
            known[word] = self.pieces(word if bare is not word else " " + word) if clean else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of a few texts."""
        parted = [f"\n{t.replace('\n', ' \n')}".split(" ") for t in texts]
        words = set().union(*parted)
        if len(self.known) >= self.cache:                                    # words in use stay
            self.known = {w: self.known[w] for w in words & self.known.keys()}
        self.learn(w for w in words.difference(self.known) if len(w) <= 64)
        get, out = self.known.get, []
        for text, part in zip(texts, parted, strict=True):
            ids = [*map(get, part)]
            out.append(self.pieces(text) if None in ids else b"".join(ids)[4:])
        return out


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


@functools.lru_cache(maxsize=2)
def encoder_of(ranks: str, pattern: str) -> Encoder:
    """A worker keeps its encoder from task to task."""
    return Encoder(read_ranks(ranks), pattern)


def encode(
    df: DataFrame, ranks: str, pattern: str, text: Column | str = "text", carry: Iterable[str] | None = None,
) -> DataFrame:
    """``df`` with ``ids`` (little-endian unsigned 32-bit integers) of each text.

    ``ranks`` is the path of the rank file, which every worker reads once."""

    def make():
        encoder = encoder_of(ranks, pattern)

        def step(texts: pa.Array):
            parts = (texts.slice(i, 400).to_pylist() for i in range(0, len(texts), 400))
            return [pa.array([ids for part in parts for ids in encoder.encode(part)], pa.binary())]

        return step

    return arrow_map(df, [present(text)], [field("ids", "binary")], make, carry)


def decode(df: DataFrame, ranks: str, ids: str = "ids", carry: Iterable[str] | None = None) -> DataFrame:
    """``df`` with ``decoded``, the bytes of each packed id list; null ids: no bytes."""

    def make():
        token = {rank: data for data, rank in read_ranks(ranks).items()}

        def step(packed: pa.Array):
            lists = (np.frombuffer(p or b"", "<u4").tolist() for p in packed.to_pylist())
            return [pa.array([b"".join(map(token.__getitem__, x)) for x in lists], pa.binary())]

        return step

    return arrow_map(df, [F.col(ids)], [field("decoded", "binary")], make, carry)


def round_trip(
    df: DataFrame, ranks: str, pattern: str, text: Column | str = "text", carry: Iterable[str] | None = None,
) -> DataFrame:
    """``df`` with ``ids`` and ``decoded``, what the ids decode to, in one pass."""

    def make():
        encoder = encoder_of(ranks, pattern)

        def step(texts: pa.Array):
            ids, back = [], []
            for n in range(0, len(texts), 400):
                part = encoder.encode(texts.slice(n, 400).to_pylist())
                ids += part
                back.append(encoder.table.decode_all(part))
            return [pa.array(ids, pa.binary()), pa.concat_arrays(back)]

        return step

    return arrow_map(df, [present(text)], [field("ids", "binary"), field("decoded", "binary")], make, carry)


def digests(both: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number and digest of the ``ids``, and the digest of what they decode to."""
    return both.select(
        key, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


__all__ = ["Encoder", "PrefixTable", "decode", "digests", "encode", "read_ranks", "round_trip"]
