"""Text that was decoded with the wrong character encoding: finding it and restoring the original.

A token that holds suspicious characters goes back through each channel (the encoding it was read with, the one it was
written in) to a lattice of bytes, in which every replacement character is a wildcard for a lost byte. The characters
that the original encoding allows from each byte on are the edges; where bytes are lost, all syllables of the corpus
that agree with the known bytes are. An exact Viterbi search takes the path of the highest probability under word
frequencies of the whole corpus: a syllable's probability is the share of the words with the letters so far that go on
with it, mixed with that of pairs of syllables; states are the beginnings of corpus words that a path can stand in, and
the last syllable where it has left them all. Nothing is pruned. Counts of beginnings, words and pairs sit in one table
by hash, whose size follows their number (up to 2**24 bytes).

A row is damaged if a token of it has such a path whose syllables the corpus uses, or if a byte stays lost on its best
path, as a replacement character is a lost byte in every lattice. Foreign words, accents and symbols that belong there
have no path: their bytes aren't valid in the original encoding. Null and empty values are never damaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hanmaru.llm._common import chunks, codes, stash

LOST = "�"
FIRST, SYLLABLES = 0xAC00, 11172
#: Bits of the table's places: enough for eight places an entry, MOST_BITS at most. Steps of the logarithm that a place holds.
LEAST_BITS, MOST_BITS, STEPS = 16, 24, 8
#: Weight of word frequencies against pairs, of pairs against single syllables; probability of a word's end outside the vocabulary.
WORDS, PAIRS, END = 0.7, 0.6, 0.3
#: Read as, written as. A cp1252 reader keeps undefined bytes as control characters.
CHANNELS = [
    (reader, writer)
    for writer, readers in (
        ("utf-8", ("cp1252", "cp949", "cp932", "cp1251", "koi8-r", "mac-roman", "cp437", "cp866", "gbk", "big5", "iso8859-15")),
        ("euc-kr", ("cp1252", "koi8-r", "mac-roman", "utf-8", "cp1251", "cp932", "gbk", "big5", "cp437", "cp866", "iso8859-15")),
    )
    for reader in readers
]


def suspicious(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F가-힣]")


@lru_cache(maxsize=65536)
def byte_of(char: str, reader: str) -> bytes | None:
    """The bytes that were read as char; None where the reader never gives it."""
    try:
        return char.encode(reader)
    except UnicodeEncodeError:
        return bytes([ord(char)]) if reader == "cp1252" and ord(char) < 256 else None


def lattice(token: str, reader: str) -> list[int] | None:
    """Byte values, -1 for lost ones; None where the reader can't have given the token."""
    out: list[int] = []
    for char in token:
        if char == LOST:
            out.append(-1)
            continue
        got = byte_of(char, reader)
        if got is None:
            return None
        out.extend(got)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


#: The beginning of every word; the hash of a path that has left the vocabulary.
ROOT, OFF = np.uint64(1), np.uint64(0)
ENDING = SYLLABLES


def longer(h: np.ndarray, syllable: np.ndarray) -> np.ndarray:
    """Hash of a beginning of a word with one more syllable (or the end)."""
    with np.errstate(over="ignore"):
        return mixed(h * np.uint64(0x9E3779B97F4A7C15) + syllable.astype(np.uint64) + np.uint64(1)) | np.uint64(1)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed((a.astype(np.uint64) * np.uint64(SYLLABLES) + b.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(2)) & ~np.uint64(1)


class Model:
    """Counts of syllables, and by hash those of word beginnings, words and pairs of syllables."""

    def __init__(self, single: np.ndarray, n_words: float, table: np.ndarray) -> None:
        self.single, self.n_words, self.table = single, n_words, table
        self.shift = np.uint64(64 - int(np.log2(len(table))))
        self.p_single = (single + 0.05) / (single.sum() + 0.05 * SYLLABLES)
        self.sizes = 2.0 ** (np.arange(256) / STEPS) - 1
        self.used = np.flatnonzero(single > max(3.0, single.sum() * 2e-6))
        self.is_used = np.zeros(SYLLABLES, bool)
        self.is_used[self.used] = True
        points = self.used + FIRST
        self.utf8 = np.stack([0xE0 | points >> 12, 0x80 | points >> 6 & 0x3F, 0x80 | points & 0x3F])
        ks = [chr(p).encode("euc-kr", "ignore") for p in points]
        self.euc = np.array([[b[0], b[1]] if len(b) == 2 else [0, 0] for b in ks], np.int64).reshape(-1, 2).T

    def count(self, h: np.ndarray) -> np.ndarray:
        return self.sizes[self.table[(h >> self.shift).astype(np.int64)]]

    def fits(self, known: list[int], writer: str) -> np.ndarray:
        """Corpus syllables whose bytes agree with the known ones."""
        table = self.utf8 if writer == "utf-8" else self.euc
        ok = np.ones(table.shape[1], bool)
        for row, byte in zip(table, known):
            if byte >= 0:
                ok &= row == byte
        return self.used[ok]

    def step(self, h: np.ndarray, last: np.ndarray, syllables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each syllable in each state, and the hash of the beginning it leads to (OFF: none of the corpus)."""
        h, last, c = h[:, None], last[:, None], syllables[None, :]
        after = PAIRS * self.count(pair(np.maximum(last, 0), c)) / (self.single[np.maximum(last, 0)] + 1) + (1 - PAIRS) * self.p_single[c]
        plain = np.where(last >= 0, np.minimum(after, 1), self.p_single[c])
        nxt = longer(h, c)
        met = np.where(h == OFF, 0, self.count(nxt))
        have = np.where(h == ROOT, self.n_words, self.count(h))
        return np.log(WORDS * np.minimum(1, met / np.maximum(have, 1)) + (1 - WORDS) * plain), np.where(met > 0, nxt, OFF)

    def leave(self, h: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Log probability that a word ends in a state; 0 where none has begun."""
        ends = self.count(longer(h, np.full(len(h), ENDING)))
        share = np.where(h == OFF, 0, np.minimum(1, ends / np.maximum(self.count(h), 1)))
        return np.where(last >= 0, np.log(WORDS * share + (1 - WORDS) * END), 0.0)


def word_entries(a: np.ndarray) -> tuple[np.ndarray, int]:
    """Hashes of the pairs, beginnings and words of a run of code points, as often as they occur; and the number of words."""
    a = a.astype(np.int64) - FIRST
    hangul = (a >= 0) & (a < SYLLABLES)
    both = np.flatnonzero(hangul[1:] & hangul[:-1])
    out = [pair(a[both], a[both + 1])]
    edge = np.diff(np.r_[0, hangul.astype(np.int8), 0])
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = np.full(len(start), ROOT)
    for k in range(int((end - start).max(initial=0))):
        on = np.flatnonzero(start + k < end)
        h[on] = longer(h[on], a[start[on] + k])
        out.append(h[on])
    out.append(longer(h, np.full(len(h), ENDING)))
    return np.concatenate(out), len(start)


def corpus_model(df: DataFrame, text: str) -> Model:
    """Counts over all undamaged rows. What reaches the driver is 11172 numbers and a table of 2**24 bytes at most."""
    single, words = -1, -SYLLABLES - 1  # places below zero: syllables, and the number of words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            for i, j in chunks(values):
                a = codes("\n".join(values[i:j]))
                entries, n = word_entries(a)
                places = np.sort((entries >> np.uint64(64 - MOST_BITS)).astype(np.int64))
                last = np.flatnonzero(np.r_[places[1:] != places[:-1], True]) if len(places) else places
                syllables = a.astype(np.int64) - FIRST
                seen = np.bincount(syllables[(syllables >= 0) & (syllables < SYLLABLES)], minlength=SYLLABLES)
                at = np.flatnonzero(seen)
                place, count = np.concatenate([places[last], single - at, [words]]), np.concatenate([np.diff(np.r_[-1, last]), seen[at], [n]])
                yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(count.astype(np.int64))], names=["place", "n"])

    clean = df.select(F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull() & ~suspicious(F.col("t")))
    counted = stash(clean.mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")))
    bits = max(LEAST_BITS, min(MOST_BITS, int(np.ceil(np.log2(8 * max(1, counted.where("place >= 0").count()))))))
    block = 1 << 14

    def packed(group: pa.Table) -> pa.Table:
        out = np.zeros(block)
        np.add.at(out, group.column("place").to_numpy() % block, group.column("n").to_numpy())
        sizes = np.minimum(np.round(STEPS * np.log2(1 + out)), 255).astype(np.uint8)
        return pa.table({"block": group.column("block").slice(0, 1), "sizes": pa.array([sizes.tobytes()], pa.binary())})

    folded = counted.where("place >= 0").select(F.shiftright("place", MOST_BITS - bits).alias("place"), "n").withColumn("block", F.floor(F.col("place") / block).cast("int"))
    table = np.zeros(1 << bits, np.uint8)
    for k, sizes in folded.groupBy("block").applyInArrow(packed, "block int, sizes binary").collect():
        table[k * block : (k + 1) * block] = np.frombuffer(bytes(sizes), np.uint8)
    counts, n_words = np.zeros(SYLLABLES), 0.0
    for place, n in counted.where("place < 0").collect():  # 11173 rows at most
        if place == words:
            n_words = float(n)
        else:
            counts[single - place] = n
    return Model(counts, n_words, table)


def edges(data: list[int], at: int, writer: str, model: Model) -> Iterator[tuple[int, object, bool]]:
    """(bytes taken, character or array of syllables, whether all its bytes are known) from a place on."""
    first = data[at]
    if 0 <= first < 0x80:
        yield 1, chr(first), True
        return
    width = 3 if writer == "utf-8" else 2
    known = data[at : at + width]
    if len(known) == width and (-1 in known) and max(known) >= 0 and not any(0 <= b < 0x80 for b in known):
        fit = model.fits(known, writer)
        if len(fit):
            yield width, fit, False
    if first < 0:
        return
    for width in (2, 3, 4) if writer == "utf-8" else (2,):
        known = data[at : at + width]
        if len(known) < width or min(known) < 0:
            continue
        try:
            char = bytes(known).decode(writer)
        except UnicodeDecodeError:
            continue
        if len(char) == 1:
            yield width, char, True


def other_cost(char: str) -> float:
    """Log probability of a character that is no syllable."""
    return -2.0 if ord(char) < 0x80 else -6.0 if "‐" <= char <= "⁄" else -12.0


def decode(data: list[int], writer: str, model: Model) -> tuple[str, float, int, int] | None:
    """The best path: its text, log probability, fully known multi-byte characters, and restored ones.

    A lost byte that no edge covers costs much and stays a replacement character. Each place keeps every state that a
    path can be in there: the beginning of a corpus word, or the last syllable of a word that is none.
    """
    if min(data) >= 0:
        try:
            bytes(data).decode(writer)  # without wildcards there is one path, or none
        except UnicodeDecodeError:
            return None
    n = len(data)
    #: (place before, character, whether all its bytes are known) of each step taken.
    steps: list[tuple[int, str, bool]] = [(-1, "", True)]
    #: place -> state -> (score, beginning, last syllable, step)
    best: list[dict[tuple[int, int], tuple[float, int, int, int]]] = [{} for _ in range(n + 1)]
    best[0][int(ROOT), -1] = (0.0, int(ROOT), -1, 0)

    def reach(place: int, score: float, h: int, last: int, before: int, char: str, sure: bool) -> None:
        key = (h, last if h == int(OFF) else -1)
        if key not in best[place] or best[place][key][0] < score:
            steps.append((before, char, sure))
            best[place][key] = (score, h, last, len(steps) - 1)

    for at in range(n):
        if not best[at]:
            continue
        rows = list(best[at].values())
        score, h, last = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.uint64), np.array([r[2] for r in rows])
        left = score + model.leave(h, last)
        top = int(left.argmax())
        for width, char, sure in edges(data, at, writer, model):
            if isinstance(char, str) and not 0 <= ord(char) - FIRST < SYLLABLES:
                reach(at + width, left[top] + other_cost(char), int(ROOT), -1, rows[top][3], char, sure)
                continue
            syllables = np.array([ord(char) - FIRST]) if isinstance(char, str) else char
            gain, nxt = model.step(h, last, syllables)
            total = score[:, None] + gain
            inside = nxt != OFF
            outside = np.where(inside, -np.inf, total)
            for k, row in enumerate(outside.argmax(axis=0)):
                if outside[row, k] > -np.inf:
                    reach(at + width, outside[row, k], int(OFF), int(syllables[k]), rows[row][3], chr(FIRST + int(syllables[k])), sure)
            for row, k in zip(*np.nonzero(inside)):
                reach(at + width, total[row, k], int(nxt[row, k]), int(syllables[k]), rows[row][3], chr(FIRST + int(syllables[k])), sure)
        if data[at] < 0:
            reach(at + 1, left[top] - 25.0, int(ROOT), -1, rows[top][3], LOST, False)
    if not best[n]:
        return None
    rows = list(best[n].values())
    left = np.array([r[0] for r in rows]) + model.leave(np.array([r[1] for r in rows], np.uint64), np.array([r[2] for r in rows]))
    top = int(left.argmax())
    text, known, restored, step = [], 0, 0, rows[top][3]
    while step > 0:
        step, char, sure = steps[step]
        text.append(char)
        known += sure and ord(char) >= 0x80
        restored += not sure and char != LOST
    return "".join(reversed(text)), float(left[top]), known, restored


def plausible(text: str, model: Model, writer: str) -> bool:
    """Whether a decoded token looks written: corpus syllables, or marks and letters that UTF-8 shows beyond doubt."""
    special = [c for c in text if ord(c) >= 0x80 and c != LOST]
    hangul = [ord(c) - FIRST for c in special if FIRST <= ord(c) < FIRST + SYLLABLES]
    if hangul:
        return len(hangul) >= 0.6 * len(special) and float(np.mean(model.is_used[hangul])) >= 0.75
    return writer == "utf-8" and bool(special) and all("‐" <= c <= "⁄" or " " <= c <= "ɏ" or c in "€™" for c in special)


def restore_token(token: str, model: Model) -> tuple[str, str] | None:
    """(restored token, channel) of the most probable channel; None for a token that was read rightly.

    The channel is empty where bytes are lost and no channel restores any of them.
    """
    best: tuple[float, str, str] | None = None
    for reader, writer in CHANNELS:
        if reader == "utf-8" and LOST not in token:
            continue  # a UTF-8 reader loses bytes of nearly every Hangul syllable
        data = lattice(token, reader)
        if data is None or max(data, default=0) < 0x80:
            continue
        got = decode(data, writer, model)
        if got is None or not got[2] + got[3] or not plausible(got[0], model, writer):
            continue
        text, score, known, restored = got
        if not known and LOST not in token:
            continue
        rate = score / max(1, len(text)) - 3.0 * text.count(LOST)
        if best is None or rate > best[0]:
            best = (rate, text, f"{writer} read as {reader}")
    if best is None and LOST in token:  # a wildcard in every lattice, and none has a better path than the loss itself
        return token, ""
    return best and best[1:]


def restore(text: str, model: Model, cache: dict) -> tuple[str, str | None, bool]:
    """(restored text, channel or None, whether the row is damaged). Damage of damage is undone in turn."""
    channel, damaged = None, False
    for _ in range(3):
        out, changed = [], False
        for token in text.split(" "):
            if token.isascii() or not any(ord(c) >= 0x80 and not FIRST <= ord(c) < FIRST + SYLLABLES for c in token):
                out.append(token)
                continue
            if token not in cache:
                if len(cache) > 100_000:
                    cache.clear()
                cache[token] = restore_token(token, model)
            got = cache[token]
            if got:
                changed, damaged, channel = changed or got[0] != token, True, channel or got[1] or None
                out.append(got[0])
            else:
                out.append(token)
        text = " ".join(out)
        if not changed:
            break
    return text, channel, damaged


def restored(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(row_id, text, restored, channel, complete) of the damaged rows; one narrow pass over df.

    complete: nothing stays lost. channel is null where nothing could be restored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(key).cast("long").alias("row_id"), F.col(text).cast("string").alias("text")).where(suspicious(F.col("text")))
    cache: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fixed, channel, damaged = restore(value, shared.value, cache)
                if damaged:
                    out.append((row, value, fixed, channel, LOST not in fixed))
            if out:
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["row_id", "text", "restored", "channel", "complete"])

    return rows.mapInArrow(run, "row_id long, text string, restored string, channel string, complete boolean")
