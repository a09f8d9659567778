"""Byte-level BPE of whole corpora with a public vocabulary.

Each piece of the split pattern starts as a doubly linked list of byte symbols; a priority queue holds the ranks of
adjacent pairs, and entries whose symbols have changed since are skipped when they come up. Pieces repeat, so a worker
keeps the encodings it made; the store is bounded by dropping its oldest half, which costs time, never a result.

Results: null and empty texts give an empty list; blank texts are encoded as they are; special tokens are never made.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Encodings that a worker keeps.
KEPT = 400_000


def default_vocabulary() -> tuple[str, str]:
    """Path of byte_bpe_50k and its split pattern, where the package of public tokenizers is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Encoder(dict):
    """Maps a piece of text to its ids, as bytes of little-endian 32-bit integers."""

    def __init__(self, path: str, pattern: str) -> None:
        super().__init__()
        self.ranks = load_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        #: (left id, right id) -> id of both together, the rank of the merge.
        self.merges: dict[tuple[int, int], int | None] = {}
        self.pieces = regex.compile(pattern).findall

    def merge(self, left: int, right: int) -> int | None:
        pair = (left, right)
        try:
            return self.merges[pair]
        except KeyError:
            found = self.ranks.get(self.tokens[left] + self.tokens[right])
            if len(self.merges) > 2_000_000:
                self.merges.clear()
            self.merges[pair] = found
            return found

    def merged(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        symbol = [self.bytes[b] for b in piece]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merge = self.merge
        queue = [(r, k, symbol[k], symbol[k + 1]) for k in range(n - 1) if (r := merge(symbol[k], symbol[k + 1])) is not None]
        heapify(queue)
        while queue:
            rank, k, left, right = heappop(queue)
            j = after[k]
            if symbol[k] != left or j >= n or symbol[j] != right:
                continue  # stale: one of the two has been merged since
            symbol[k], symbol[j] = rank, -1
            after[k] = nxt = after[j]
            if nxt < n:
                before[nxt] = k
                r = merge(rank, symbol[nxt])
                if r is not None:
                    heappush(queue, (r, k, rank, symbol[nxt]))
            prev = before[k]
            if prev >= 0:
                r = merge(symbol[prev], rank)
                if r is not None:
                    heappush(queue, (r, prev, symbol[prev], rank))
        return [s for s in symbol if s >= 0]

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.merged(piece.encode("utf-8", "replace")), np.int32).tobytes()
        if len(self) >= KEPT:
            for old in list(islice(self, KEPT // 2)):
                del self[old]
        self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text))) if text else b""

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One per worker process and vocabulary."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_column(df: DataFrame, key: str, text: str, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(key, ids ARRAY<INT>): one narrow pass, no shuffle. A row per row of df; repeated keys stay repeated.

    A vocabulary is (path of a .tiktoken file that every executor can read, split pattern).
    """
    path, pattern = vocabulary or default_vocabulary()
    source = df.select(F.col(key), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [encode(t) for t in part.column(1).to_pylist()]
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=ends[1:])
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=[key, "ids"])

    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, ids array<int>")
