"""Problem 8: encoding a corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: how this vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 200_000


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


class RankQueue:
    """A priority queue over merge ranks: one bucket of positions per rank, found by a three-level bitmap.

    Taking the least rank is three find-first-set steps, adding is an append and at most
    three bit sets, whatever the number of entries.
    """

    def __init__(self, size: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * (size // 64 + 1)
        self.mid = [0] * (size // 4096 + 1)
        self.high = 0

    def push(self, rank: int, position: int) -> None:
        if bucket := self.buckets.get(rank):
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.high |= 1 << b

    def pop(self) -> tuple[int, list[int]] | None:
        """The least rank and all its positions, left to right."""
        if not self.high:
            return None
        b = (self.high & -self.high).bit_length() - 1
        a = b << 6 | (self.mid[b] & -self.mid[b]).bit_length() - 1
        rank = a << 6 | (self.low[a] & -self.low[a]).bit_length() - 1
        self.low[a] &= self.low[a] - 1
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.high &= ~(1 << b)
        return rank, sorted(self.buckets.pop(rank))


class Encoder:
    """Byte-level BPE over a ranks file (base64 token, rank)."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.split = regex.compile(PATTERN).findall
        self.cache: dict[str, list[int]] = {}
        self.queue = RankQueue(self.size)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token. Parts are a linked list; entries whose parts changed are stale and skipped."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ranks, n, q = self.ranks, len(piece), self.queue
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a position; 0: no part begins there
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                q.push(r, i)
        while (found := q.pop()) is not None:
            rank, positions = found
            for i in positions:
                mid = end[i]
                if not mid or mid >= n or ranks.get(piece[i : end[mid]]) != rank:
                    continue
                j = end[i] = end[mid]
                end[mid] = 0
                if j < n:
                    before[j] = i
                    r = ranks.get(piece[i : end[j]])
                    if r is not None:
                        q.push(r, i)
                if i:
                    h = before[i]
                    r = ranks.get(piece[h:j])
                    if r is not None:
                        q.push(r, h)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of text without special tokens; [] for null and empty texts."""
        ids: list[int] = []
        if not text:
            return ids
        cache = self.cache
        for word in self.split(text):
            got = cache.get(word)
            if got is None:
                got = self.merge(word.encode("utf-8", "surrogatepass"))
                if len(word) < 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[word] = got
            ids += got
        return ids


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(text: Column, path: str | None = None) -> Column:
    """array<int> of token ids; [] for null and empty texts. The vocabulary file is read once per Python worker."""
    where = path or default_path()

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(s: pd.Series) -> pd.Series:
        e = encoder(where).encode
        return pd.Series([e(x) for x in s], dtype=object)

    return ids(text)


def count_tokens(text: Column, path: str | None = None) -> Column:
    """Number of tokens as encode() gives them; 0 for null and empty texts."""
    where = path or default_path()

    @F.pandas_udf(T.LongType())
    def n(s: pd.Series) -> pd.Series:
        e = encoder(where).encode
        return pd.Series([len(e(x)) for x in s], dtype="int64")

    return n(text)
