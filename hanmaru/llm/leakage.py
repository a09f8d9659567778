"""Evaluation passages inside training text, by suffix arrays of the training shards.

Both sides are lower-cased and reduced to letters and numbers. Each chunk of a shard gets a suffix array of every
``STEP``-th suffix, ordered by its first ``STEP`` characters; every test suffix is binary-searched in it, and each hit
is extended to both sides. A run of at least 2 * STEP characters holds a sampled suffix with at least STEP characters
after it, so for runs from 2 * STEP = 40 on the search is exact, at a twentieth of the suffixes.

The test items are a stated query set: they go to the executors in blocks of a bounded number of characters, ``WAVE``
blocks in one pass over the training texts, which are read, folded and sorted once for all of them. Training texts are
never shuffled; only the (document, item) matches are.

Null, empty and blank texts and items match nothing; repeated documents each match; an item that occurs several times
in a document gives one row with the longest match (the first in the document at equal length).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hanmaru.llm._common import bare, chunks, codes

RUN = 40
STEP = RUN // 2
#: Characters of test items in a block: what one broadcast holds at most, about 20 bytes each.
BLOCK_CHARS = 2_000_000
SHARD_CHARS = 3_000_000
#: Blocks that one pass searches, and how many of them a worker keeps ready; the others are made ready for each shard.
WAVE, READY = 32, 4


def pack(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(5, n) keys: the STEP code units from each position on, four to a word, in lexicographic order.

    Code points beyond the BMP share code units with others; hits are compared in full afterwards.
    """
    unit = (a & np.uint32(0xFFFF)).astype(np.uint64)
    keys = np.zeros((STEP // 4, len(at)), np.uint64)
    for k in range(STEP):
        keys[k // 4] = (keys[k // 4] << np.uint64(16)) | unit[at + k]
    return keys


def joined(texts: list[str], separator: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with a separator before, between and after; the place where each begins."""
    parts: list[np.ndarray] = []
    gap = np.full(RUN, separator, np.uint32)
    starts, at = [], RUN
    for text in texts:
        parts += [gap, codes(text)]
        starts.append(at)
        at += len(parts[-1]) + RUN
    parts += [gap, gap]
    return np.concatenate(parts), np.array(starts, np.int64)


class Shard:
    """Training texts in a row, with the suffix array of every STEP-th suffix."""

    def __init__(self, texts: list[str]) -> None:
        self.codes, self.starts = joined(texts, 2)
        at = np.arange(RUN, len(self.codes) - 2 * RUN, STEP)
        keys = pack(self.codes, at) if len(at) else np.zeros((STEP // 4, 0), np.uint64)
        order = np.lexsort(keys[::-1])
        self.at, self.keys = at[order], keys[:, order]


class Queries:
    """The test suffixes of one block."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        texts = [bare(text) for _, text in items]
        self.ids = np.array([key for key, _ in items], np.int64)
        self.codes, self.starts = joined(texts, 1)
        lengths = np.array([len(t) for t in texts], np.int64)
        spots = [np.arange(s, s + n - STEP + 1) for s, n in zip(self.starts, lengths) if n >= RUN]
        self.at = np.concatenate(spots) if spots else np.zeros(0, np.int64)
        self.keys = pack(self.codes, self.at) if len(self.at) else np.zeros((STEP // 4, 0), np.uint64)

    def search(self, shard: Shard) -> tuple[np.ndarray, ...]:
        """(text number, item id, length, place in text, place in item) of every maximal hit in a shard."""
        nothing = tuple(np.zeros(0, np.int64) for _ in range(5))
        a, starts, at, keys = shard.codes, shard.starts, shard.at, shard.keys
        if not len(at) or not len(self.at):
            return nothing
        lo = np.searchsorted(keys[0], self.keys[0], "left")
        hi = np.searchsorted(keys[0], self.keys[0], "right")
        query = np.flatnonzero(lo < hi)
        lo, hi = lo[query], hi[query]
        for column in range(1, len(keys)):
            lo, hi = bounds(keys[column], self.keys[column][query], lo, hi)
            left = lo < hi
            query, lo, hi = query[left], lo[left], hi[left]
        found: list[tuple[np.ndarray, ...]] = []
        window = np.arange(-STEP + 1, RUN + 1)
        ends = np.cumsum(hi - lo)
        done = 0
        while done < len(query):  # in steps of a bounded number of hits
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + 50_000)))
            part = slice(done, upto)
            count = hi[part] - lo[part]
            p = at[np.repeat(lo[part], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            q = np.repeat(self.at[query[part]], count)
            same = a[p[:, None] + window] == self.codes[q[:, None] + window]
            back = np.argmin(np.c_[same[:, : STEP - 1][:, ::-1], np.zeros(len(p), bool)], axis=1)
            ahead = np.argmin(np.c_[same[:, STEP - 1 :], np.zeros(len(p), bool)], axis=1)
            hit = back + ahead >= RUN
            if hit.any():
                found.append(self.extended(a, starts, p[hit] - back[hit], q[hit] - back[hit]))
            done = upto
        return tuple(np.concatenate(x) for x in zip(*found)) if found else nothing

    def extended(self, a: np.ndarray, starts: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
        """Whole lengths of runs that begin at most STEP - 1 characters before p and q."""
        pair = np.unique(np.c_[p, q], axis=0)
        p, q = pair[:, 0], pair[:, 1]
        length = np.zeros(len(p), np.int64)
        going = np.arange(len(p))
        while len(going):
            same = a[p[going] + length[going]] == self.codes[q[going] + length[going]]
            going = going[same]
            length[going] += 1
        text = np.searchsorted(starts, p, "right") - 1
        item = np.searchsorted(self.starts, q, "right") - 1
        return text, self.ids[item], length, p - starts[text], q - self.starts[item]


def bounds(sorted_keys: np.ndarray, wanted: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of each wanted key in its own range [lo, hi)."""

    def edge(right: bool) -> np.ndarray:
        low, high = lo.copy(), hi.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            key = sorted_keys[np.minimum(middle, len(sorted_keys) - 1)]
            up = open_ & ((key <= wanted) if right else (key < wanted))
            low = np.where(up, middle + 1, low)
            high = np.where(open_ & ~up, middle, high)
        return low

    return edge(False), edge(True)


def blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most BLOCK_CHARS characters (a longer item is a block of its own)."""
    block: list[tuple[int, str]] = []
    total = 0
    rows = items.where(F.length(text) >= RUN).select(F.col(key).cast("long"), F.col(text)).orderBy(key)
    for number, value in rows.toLocalIterator():
        if block and total + len(value) > BLOCK_CHARS:
            yield block
            block, total = [], 0
        block.append((number, value))
        total += len(value)
    if block:
        yield block


def matches(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(doc_id, item_id, length, doc_pos, item_pos): the longest verbatim match of each document and item.

    Positions count in the reduced texts.
    """
    schema = "doc_id long, item_id long, length long, doc_pos long, item_pos long"
    spark = corpus.sparkSession
    source = corpus.where(F.length(text) >= RUN).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    passes = []
    made = blocks(items, item_key, item_text)
    while wave := list(islice(made, WAVE)):
        shared = [spark.sparkContext.broadcast(block) for block in wave]

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ready: dict[int, Queries] = {}
            ids: list[int] = []
            texts: list[str] = []

            def of(k: int) -> Queries:
                if k in ready:
                    return ready[k]
                queries = Queries(shared[k].value)
                if len(ready) < READY:
                    ready[k] = queries
                return queries

            def flush() -> Iterator[pa.RecordBatch]:
                for i, j in chunks(texts, SHARD_CHARS):
                    shard = Shard(texts[i:j])
                    for k in range(len(shared)):
                        number, item, *rest = of(k).search(shard)
                        if len(number):
                            columns = [np.array(ids[i:j], np.int64)[number], item, *rest]
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "item_id", "length", "doc_pos", "item_pos"])
                ids.clear()
                texts.clear()

            size = 0
            for batch in batches:
                for number, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    value = bare(value)
                    if len(value) < RUN or number is None:
                        continue
                    ids.append(number)
                    texts.append(value)
                    size += len(value)
                    if size >= SHARD_CHARS:
                        yield from flush()
                        size = 0
            if texts:
                yield from flush()

        passes.append(source.mapInArrow(run, schema))
    if not passes:
        return spark.createDataFrame([], schema)
    hits = passes[0]
    for more in passes[1:]:
        hits = hits.unionAll(more)
    best = F.max(F.struct("length", (-F.col("doc_pos")).alias("d"), (-F.col("item_pos")).alias("i"))).alias("b")
    return hits.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("b.length").alias("length"), (-F.col("b.d")).alias("doc_pos"), (-F.col("b.i")).alias("item_pos")
    )


def without_leaks(corpus: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """The corpus less the affected documents; rows with a null key stay."""
    return corpus.join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti")
