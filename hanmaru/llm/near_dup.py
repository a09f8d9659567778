"""Similarity join of texts.

Similarity is the Jaccard coefficient of the sets of distinct 3-character sequences. Every pair that reaches the threshold
is found (``candidates``):

1. Rows with the same normalised text become one text; its rows come back at the very end.
2. Sequences are ordered by how many texts hold one of their hash class, rare first. Any order that all texts share will
   do, so a table of fixed size is enough; classes of a single text bring nobody together but keep their places.
3. Two sets that reach the threshold share a number of sequences that follows from their sizes, so the first so many of
   either in that order share as many as asked (``depth``). Texts are in bands of sizes; a prefix is as long as partners
   of the other band ask for.
4. Zones of bands are dealt over parts, and the parts of zones whose sizes can meet form cells. A cell counts common
   sequences of prefixes, and drops pairs whose parity bits differ more than the threshold allows.
5. What is left is verified with its exact similarity.

A cell's memory is bounded; the meetings of frequent sequences and what is sent to the cells grow with the square of the
texts, as the price of missing nothing (figures in the README).

With roles, sequences without both roles bring nobody together, and only texts of role 1 meet texts of role 2.

``prefixed`` gives the prefixes of longer, thinned grams of a former join, which missed some pairs; no query uses it or
the settings but the threshold.

Null texts and texts with fewer than 3 characters after normalisation take part in no pair; null keys neither.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hanmaru.llm._common import chunks, codes, distinct, gram_hashes, mix, stash

#: Texts of up to SHORT / threshold sequences, and those with less than FEW kept grams, have a prefix of 3-character sequences too.
SHORT, FEW = 16, 8


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.8
    gram: int = 12
    thin: int = 3
    shared: int = 4
    bound: int = 24
    common: float = 0.45
    exact: bool = False


def whitespace_normal(text: Column) -> Column:
    """Each run of white space becomes one space; ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def letters_and_numbers(text: Column) -> Column:
    """Lower case, reduced to Unicode letters and numbers."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def windows(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in a row, each one's text, whether a window of q begins there, and where texts begin."""
    a = codes("".join(texts))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(texts)), lengths)
    whole = np.arange(len(a)) + q <= ends[doc]
    return a, doc, whole, ends - lengths


def kept_grams(texts: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the grams that thinning keeps, as often as they occur."""
    a, doc, whole, _ = windows(texts, s.gram)
    h = gram_hashes(a, s.gram)
    keep = whole[: len(h)]
    if s.thin > 1:
        keep = keep & (h % np.uint64(s.thin) == 0)
    return doc[: len(h)][keep], h[keep]


def distinct_postings(owner: np.ndarray, h: np.ndarray, n: int, flag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram) once each, and how many each of n texts has; the lowest bit of a gram is the flag."""
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    first = np.r_[True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    owner, h = owner[first], h[first]
    return owner, (h & ~np.uint64(1)) | np.uint64(flag), np.bincount(owner, minlength=n)


def postings(texts: DataFrame, s: Settings) -> DataFrame:
    """(gram, tid, roles, size, size3): the kept grams of each text and, for short texts, its sequences; how many it has of either."""
    names = ["gram", "tid", "roles", "size", "size3"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tids, roles = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            values = batch.column(1).to_pylist()
            for i, j in chunks(values):
                part = values[i:j]
                owner, h, size = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(j - i, np.int64)) if s.exact else distinct_postings(*kept_grams(part, s), j - i, 0)
                some = np.flatnonzero(s.exact | (np.fromiter(map(len, part), np.int64, j - i) - 2 <= SHORT / s.threshold) | (size < FEW))
                few, h3, n3 = distinct_postings(*kept_grams([part[k] for k in some], Settings(gram=3, thin=1)), len(some), 1)
                size3 = np.zeros(j - i, np.int64)
                size3[some] = n3
                owner, h = np.concatenate([owner, some[few]]), np.concatenate([h, h3])
                columns = [h.view(np.int64), tids[i:j][owner], roles[i:j][owner].astype(np.int8), size[owner].astype(np.int32), size3[owner].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return texts.select("tid", "text", "roles").mapInArrow(run, "gram long, tid long, roles byte, size int, size3 int")


def prefixed(texts: DataFrame, s: Settings, cross: bool) -> DataFrame:
    """(tid, roles, n_shared, prefix): texts with a prefix; prefix is an array of (gram, weight, parts to deal its texts over)."""
    same = Window.partitionBy("gram")
    counted = postings(texts, s).withColumn("df", F.count("*").over(same)).withColumn("met", F.bit_or("roles").over(same))
    alive = counted.where((F.col("df") > 1) & (F.col("met") == 3 if cross else F.lit(True)))
    per = alive.groupBy("tid").agg(F.first("roles").alias("roles"), F.first("size").alias("size"), F.first("size3").alias("size3"), F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))
    short = lambda x: x["gram"].bitwiseAND(F.lit(1)) == 1
    own = lambda keep: F.filter("g", keep)
    columns = per.withColumn("light", own(lambda x: ~short(x) & (x["df"] <= s.bound))).withColumn("heavy", own(lambda x: ~short(x) & (x["df"] > s.bound))).withColumn("brief", own(short))
    need = F.ceil(F.col("size") * s.common).cast("int")
    # Sequences of a single text are the first of their order and take their places in the prefix.
    places = F.col("size3") - F.ceil(F.col("size3") * s.threshold).cast("int") + 1 - (F.col("size3") - F.size("brief"))
    weighted = lambda g, weight: F.transform(g, lambda x: F.struct(x["gram"].alias("gram"), weight(x).cast("int").alias("w"), F.ceil(x["df"] / BLOCK).cast("int").alias("parts")))
    prefix = F.concat(
        weighted("light", lambda x: F.when(x["df"] < 4, 3).otherwise(2)),
        weighted(F.when(F.size("heavy") >= need, F.slice("heavy", F.lit(1), F.size("heavy") - need + s.shared)).otherwise(F.slice("heavy", 1, 0)), lambda x: F.lit(1)),
        weighted(F.slice("brief", F.lit(1), F.greatest(places, F.lit(0))), lambda x: F.lit(s.shared)),
    )
    return columns.select("tid", "roles", F.size("g").alias("n_shared"), prefix.alias("prefix")).where(F.size("prefix") > 0)


#: Rows of one key that meet at a time.
BLOCK = 500


def meetings(rows: DataFrame, key: str, value: str, carried: list[str]) -> DataFrame:
    """(value and carried columns of both sides with a and b behind their names): pairs of rows with the same key, smaller value first.

    rows has a column parts, equal for all rows of a key: the key is dealt over the cells of a triangle with that many
    rows of cells, so that no task has to meet more than a cell of a frequent key.
    """
    dealt = rows.select(key, value, "parts", *carried).withColumn("part", F.pmod(F.xxhash64(F.col(value)), F.col("parts")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other"))
    side = lambda x: cells.select(key, "p", "q", *(F.col(c).alias(f"{c}{x}") for c in (value, "part", *carried)))
    both = side("a").join(side("b"), [key, "p", "q"]).where((F.col(f"{value}a") < F.col(f"{value}b")) & ((F.col("p") == F.col("q")) | (F.col("parta") != F.col("partb"))))
    return both.select(*(f"{c}{x}" for c in (value, *carried) for x in "ab"))


def crossing(cross: bool, a: str, b: str) -> Column:
    """Whether one side has role 1 and the other role 2; always, where roles don't count."""
    if not cross:
        return F.lit(True)
    bit = lambda c, r: F.col(c).bitwiseAND(F.lit(r)) != 0
    return (bit(a, 1) & bit(b, 2)) | (bit(a, 2) & bit(b, 1))


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(ta, tb, similarity) of the pairs of texts that reach the threshold, each computed exactly."""
    side = lambda x: texts.select(F.col("tid").alias(f"t{x}"), F.col("text").alias(f"text_{x}"))
    both = pairs.select("ta", "tb").join(side("a"), "ta").join(side("b"), "tb").select("ta", "tb", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids = np.concatenate([part.column(0).to_numpy(), part.column(1).to_numpy()])
                _, first, number = np.unique(ids, return_index=True, return_inverse=True)
                texts_ = pa.concat_arrays([part.column(2), part.column(3)]).take(pa.array(first)).to_pylist()
                sim = similarities(texts_, number[: part.num_rows], number[part.num_rows :], threshold)
                ok = np.flatnonzero(sim >= threshold)
                if len(ok):
                    part = part.take(pa.array(ok))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sim[ok])], names=["ta", "tb", "similarity"])

    return both.mapInArrow(run, "ta long, tb long, similarity double")


SHADOW = 512


def similarities(texts: list[str], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Jaccard coefficients of the pairs (texts[left], texts[right]); 0 where they are surely below the threshold.

    A text's shadow has one parity bit for each of 512 hash classes of its sequences, so two shadows differ in at most
    as many bits as there are sequences in just one of the texts. That rules most pairs out without a mistake.
    """
    keys, sizes = [], np.zeros(len(texts), np.int64)
    shadows = np.zeros((len(texts), SHADOW // 64), np.uint64)
    for i, j in chunks(texts, 500_000):
        a, doc, whole, _ = windows(texts[i:j], 3)
        at = np.flatnonzero(whole[: max(0, len(a) - 2)])
        key = distinct((doc[at].astype(np.uint64) << np.uint64(40)) | (gram_hashes(a, 3)[at] >> np.uint64(24)))
        owner = (key >> np.uint64(40)).astype(np.int64)
        bits = np.bincount(owner * SHADOW + (key & np.uint64(SHADOW - 1)).astype(np.int64), minlength=(j - i) * SHADOW) & 1
        shadows[i:j] = np.packbits(bits.astype(bool).reshape(j - i, SHADOW), axis=1).view(np.uint64)
        sizes[i:j] = np.bincount(owner, minlength=j - i)
        keys.append(key & np.uint64((1 << 40) - 1))
    grams = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    begin = np.cumsum(sizes) - sizes
    total = sizes[left] + sizes[right]
    apart = np.bitwise_count(shadows[left] ^ shadows[right]).sum(axis=1, dtype=np.int64)
    maybe = np.flatnonzero((total > 0) & (apart * (1 + threshold) <= total * (1 - threshold) + 1e-6))
    sim = np.zeros(len(left))
    for k in range(0, len(maybe), 2048):
        pair = maybe[k : k + 2048]
        both = np.concatenate([tagged(grams, begin[side], sizes[side]) for side in (left[pair], right[pair])])
        both.sort()
        common = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(40)).astype(np.int64), minlength=len(pair))
        sim[pair] = common / (total[pair] - common)
    return sim


def tagged(grams: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The grams of each text of a list, with its place in the list in the upper bits."""
    place = np.repeat(np.arange(len(size)), size)
    return grams[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin, size)] | (place.astype(np.uint64) << np.uint64(40))


def sequences(part: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, 40 bits of a hash) of the distinct 3-character sequences, in order, and how many each text has."""
    doc, h = kept_grams(part, Settings(gram=3, thin=1))
    key = distinct((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    owner = (key >> np.uint64(40)).astype(np.int64)
    return owner, key & np.uint64((1 << 40) - 1), np.bincount(owner, minlength=len(part))


#: Sequences are ordered by how many texts have one of their hash class; the table of all classes is a fixed 16 MB.
CLASSES, SLICE = 1 << 22, 1 << 16
#: Least sizes of the bands; partners' sizes are known within a band. ZONE bands in a row are dealt over cells together.
EDGES = np.unique(np.ceil(1.15 ** np.arange(160)).astype(np.int64))
ZONE = 3
#: Sequences of the texts that are one side of a cell, and meetings of one step of its search.
CELL, STEP = 6_000_000, 250_000
#: Most common sequences that prefixes are asked for; more would make the prefixes of long texts longer and rule out hardly anybody.
MOST = 8


def band(n: np.ndarray) -> np.ndarray:
    """The band of each size."""
    return np.maximum(np.searchsorted(EDGES, n, "right") - 1, 0)


def zone_sizes(zone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest size of a zone."""
    return EDGES[np.minimum(ZONE * zone, len(EDGES) - 1)], EDGES[np.minimum(ZONE * (zone + 1), len(EDGES) - 1)] - 1


def least_common(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """How many sequences two sets of these sizes must share to reach the threshold; never too many."""
    return np.ceil((np.asarray(a) + b) * threshold / (1 + threshold) - 1e-6).astype(np.int64)


def depth(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """How many common sequences the prefixes of such sets are asked for; at most what the sets must share."""
    return np.clip(least_common(a, b, threshold) // 12, 1, MOST)


def prefix_length(n: np.ndarray, least: int, asked: np.ndarray, threshold: float) -> np.ndarray:
    """First sequences of a set of n that hold as many common ones as asked, whatever set of at least this size it meets."""
    return n - least_common(n, np.maximum(least, np.ceil(n * threshold - 1e-6).astype(np.int64)), threshold) + asked


def order_of_classes(texts: DataFrame, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each hash class, rare first, -1 for those that can't meet; sequences by zone), counted over all texts.

    A class of a single text can't meet, nor one without both roles where roles count.
    """
    sides = (1, 2) if cross else (3,)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, zones = np.zeros((len(sides), CLASSES), np.int64), np.zeros(SLICE, np.int64)
        for batch in batches:
            values, roles = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for i, j in chunks(values):
                owner, h, n = sequences(values[i:j])
                class_, has = (h >> np.uint64(18)).astype(np.int64), roles[i:j][owner]
                for k, side in enumerate(sides):
                    count[k] += np.bincount(class_[has & side != 0], minlength=CLASSES)
                zones += np.bincount(band(n) // ZONE, n, minlength=SLICE).astype(np.int64)
        yield sliced([*count.reshape(-1, SLICE), zones])

    def sliced(counts: list[np.ndarray]) -> pa.RecordBatch:
        rows = [(k, at.astype(np.uint16).tobytes(), c[at].tobytes()) for k, c in enumerate(counts) if len(at := np.flatnonzero(c))]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 3, (pa.int32(), pa.binary(), pa.binary()))], names=["slice", "at", "n"])

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for at, n in zip(table.column("at").to_pylist(), table.column("n").to_pylist()):
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int64)
        at = np.flatnonzero(total)
        return pa.table({"slice": table.column("slice").slice(0, 1), "at": pa.array([at.astype(np.uint16).tobytes()], pa.binary()), "n": pa.array([total[at].tobytes()], pa.binary())})

    schema = "slice int, at binary, n binary"
    count = np.zeros((len(sides) * CLASSES // SLICE + 1, SLICE), np.int64)
    for row in texts.select("text", "roles").mapInArrow(run, schema).groupBy("slice").applyInArrow(added, schema).collect():
        count[row["slice"], np.frombuffer(row["at"], np.uint16)] = np.frombuffer(row["n"], np.int64)
    by_side = count[:-1].reshape(len(sides), CLASSES)
    classes_ = by_side.sum(axis=0)
    rank = np.empty(CLASSES, np.int32)
    rank[np.argsort(classes_, kind="stable")] = np.arange(CLASSES, dtype=np.int32)
    rank[(classes_ < 2) | (by_side == 0).any(axis=0)] = -1
    return rank, count[-1]


def parity(owner: np.ndarray, h: np.ndarray, n: int, bits: int) -> np.ndarray:
    """For each of n texts a parity bit for each of so many hash classes of its sequences."""
    odd = np.bincount(owner * bits + (h & np.uint64(bits - 1)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(bool).reshape(n, bits), axis=1).view(np.uint64)


def shadow_bits(size: int) -> int:
    return 1 << max(9, int(np.ceil(np.log2(2.2 * size))))


def spans_of(count: np.ndarray) -> np.ndarray:
    """0 to c - 1 for each count c in a row."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


PARTS = ("tid", "roles", "n", "dead", "held", "ranks", "shadow")
TYPES = (np.int64, np.int8, np.int64, np.int32, np.int32, np.int32, np.uint64)


def cells(texts: DataFrame, threshold: float, cross: bool) -> tuple[DataFrame, int]:
    """(cell, side, arrays), and how many parts of zones there are, of which a cell's number names two: the texts of zones whose sizes can reach the threshold meet in cells, each pair of texts in one.

    A text brings as much of its prefix as partners of the other zone ask for, and its parity bits.
    """
    context = texts.sparkSession.sparkContext
    rank, grams_ = order_of_classes(texts, cross)
    table = context.broadcast(rank)
    zones = np.flatnonzero(grams_)
    parts = {int(z): int(-(-grams_[z] // CELL)) for z in zones}
    first = dict(zip(parts, np.cumsum([0, *parts.values()]).tolist()))
    slots = sum(parts.values())
    low, high = zone_sizes(np.arange(len(EDGES)))
    partners = {z: [y for y in parts if high[min(y, z)] >= threshold * low[max(y, z)]] for z in parts}
    n_cells = sum(parts[z] * parts[y] for z in parts for y in partners[z] if y > z) + sum(p * (p + 1) // 2 for p in parts.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = table.value
        for batch in batches:
            tids, roles = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            values = batch.column(1).to_pylist()
            for i, j in chunks(values):
                owner, h, n = sequences(values[i:j])
                ranks = order[(h >> np.uint64(18)).astype(np.int64)]
                key = np.sort((owner << 23) | (ranks.astype(np.int64) + 1))
                ranks = ((key & ((1 << 23) - 1)) - 1).astype(np.int32)
                begin, dead = np.cumsum(n) - n, np.bincount(owner[np.flatnonzero(key & ((1 << 23) - 1) == 0)], minlength=j - i)
                zone = band(n) // ZONE
                of = np.array([parts[z] for z in zone.tolist()])
                slot = np.array([first[z] for z in zone.tolist()]) + (mix(tids[i:j].astype(np.uint64)) % of.astype(np.uint64)).astype(np.int64)
                for z in np.unique(zone).tolist():
                    mine = np.flatnonzero(zone == z)
                    inside = np.isin(owner, mine)
                    place, mine_h, shadows = np.searchsorted(mine, owner[inside]), h[inside], {}
                    for y in partners[z]:
                        asked = depth(n[mine], np.minimum(high[y], n[mine] / threshold), threshold)
                        held = np.clip(prefix_length(n[mine], low[y], asked, threshold), 0, n[mine]) - dead[mine]
                        held = np.maximum(held, 0)
                        bits = shadow_bits(high[min(y, z)])
                        if bits not in shadows:
                            shadows[bits] = parity(place, mine_h, len(mine), bits)
                        for s in range(first[z], first[z] + parts[z]):
                            k = np.flatnonzero(slot[mine] == s)
                            if not len(k):
                                continue
                            m, c = mine[k], held[k]
                            picked = ranks[np.repeat(begin[m] + dead[m], c) + spans_of(c)]
                            arrays = (tids[i:j][m], roles[i:j][m], n[m], dead[m], c, picked, shadows[bits][k])
                            row = [pa.array([a.astype(t).tobytes()], pa.binary()) for a, t in zip(arrays, TYPES)]
                            others = np.arange(first[y], first[y] + parts[y])
                            for o in others.tolist():
                                yield pa.RecordBatch.from_arrays([pa.array([min(s, o) * slots + max(s, o)], pa.int64()), pa.array([int(s > o)], pa.int8()), *row], names=["cell", "side", *PARTS])

    schema = "cell long, side byte, " + ", ".join(f"{p} binary" for p in PARTS)
    split = texts.select("tid", "text", "roles").mapInArrow(run, schema)
    return split.repartition(max(1, min(n_cells, 2000)), "cell"), slots


def with_role(side: dict, role: int) -> dict:
    """The texts of a side that have the role."""
    has = side["roles"] & role != 0
    return {p: x[np.repeat(has, side["held"]) if p == "ranks" else has] for p, x in side.items()}


def differing(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits of the rows x of a and y of b differ; a row has a multiple of 8 words."""
    bits = a.take(x, axis=0)
    bits ^= b.take(y, axis=0)
    # Eight words' counts of at most 64 lie in eight bytes, which are added in pairs, then four sums at once.
    n, low = np.bitwise_count(bits).view(np.uint64), np.uint64(0x00FF00FF00FF00FF)
    n = (((n & low) + ((n >> np.uint64(8)) & low)) * np.uint64(0x0001000100010001)) >> np.uint64(48)
    return n.sum(axis=1, dtype=np.int64)


def by_bands(side: dict, number: np.ndarray, by_id: bool) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By band (text, number of the sequence, place among the text's sequences) of prefixes, without sequences of no number; in order of texts or of numbers, then texts."""
    id_ = number[side["ranks"]]
    known = np.flatnonzero(id_ >= 0)
    id_ = id_[known]
    doc = np.repeat(np.arange(len(side["n"]), dtype=np.int32), side["held"])[known]
    pos = (spans_of(side["held"].astype(np.int64)) + np.repeat(side["dead"], side["held"]))[known].astype(np.int32)
    of = band(side["n"])[doc]
    # Sorting packed keys is many times as fast as a stable argsort.
    order = np.sort((of << 54) | (id_.astype(np.int64) << 32 if by_id else 0) | np.arange(len(doc))) & ((1 << 32) - 1)
    doc, id_, pos, of = doc[order], id_[order], pos[order], of[order]
    bands = distinct(of)
    ends = np.searchsorted(of, bands, "right").tolist()
    return {b: (doc[i:j], id_[i:j], pos[i:j]) for b, i, j in zip(bands.tolist(), [0, *ends], ends)}


def searched(left: dict, right: dict, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of texts of either side whose prefixes share what they must and whose parity bits allow the threshold."""
    has = np.zeros((2, CLASSES), bool)
    for k, x in enumerate((left, right)):
        has[k, x["ranks"]] = True
    both = has[0] & has[1]
    n_ids = int(np.count_nonzero(both))
    if not n_ids:
        return
    number = np.where(both, np.cumsum(both, dtype=np.int32) - np.int32(1), np.int32(-1))
    side_u, side_v = by_bands(left, number, False), by_bands(right, number, True)
    upper = np.r_[EDGES[1:] - 1, EDGES[-1]]
    size_u, size_v, nv = left["n"], right["n"], len(right["n"])
    counted = np.arange(STEP)
    for u, (doc_u, id_u, pos_u) in side_u.items():
        for v, (doc_v, id_v, pos_v) in side_v.items():
            if (same and v < u) or upper[min(u, v)] < threshold * EDGES[max(u, v)]:
                continue
            asked = int(depth(EDGES[u], EDGES[v], threshold))
            q = np.flatnonzero(pos_v < prefix_length(size_v, EDGES[u], asked, threshold)[doc_v])
            iv, dv = id_v[q], doc_v[q]
            many = np.bincount(iv, minlength=n_ids)
            first = np.cumsum(many) - many
            if same and u == v:
                # Here each meets those behind it only, so that no two meet twice.
                p = np.sort((dv.astype(np.int64) << 32) | np.arange(len(dv))) & ((1 << 32) - 1)
                du, many, first = dv[p], (first + many)[iv[p]] - p - 1, p + 1
            else:
                p = np.flatnonzero(pos_u < prefix_length(size_u, EDGES[v], asked, threshold)[doc_u])
                du, many, first = doc_u[p], many[id_u[p]], first[id_u[p]]
            met = np.flatnonzero(many)
            first, many, du = first[met], many[met], du[met].astype(np.int64)
            ends = np.cumsum(many)
            k = 0
            while k < len(du):
                # Whole texts of about STEP meetings, one at least.
                before = int(ends[k - 1]) if k else 0
                e = int(np.searchsorted(ends, before + STEP, "right"))
                e = len(du) if e >= len(du) else int(np.searchsorted(du, du[e]))
                e = e if e > k else int(np.searchsorted(du, du[k], "right"))
                count, total = many[k:e], int(ends[e - 1]) - before
                at = np.repeat(first[k:e] - (ends[k:e] - count - before), count)
                at += counted[:total] if total <= len(counted) else np.arange(total)
                narrow = (int(du[e - 1] - du[k]) + 1) * nv < 1 << 31
                key = np.repeat(((du[k:e] - du[k]) * nv).astype(np.int32 if narrow else np.int64), count)
                key += dv.take(at, mode="clip")
                key.sort()
                key = key[np.flatnonzero(key[: max(0, total - asked + 1)] == key[asked - 1 :])]
                key = key[np.r_[True, key[1:] != key[:-1]][: len(key)]].astype(np.int64)
                a, b = key // nv + du[k], key % nv
                for s in range(0, len(a), STEP // 8):
                    x, y = a[s : s + STEP // 8], b[s : s + STEP // 8]
                    ok = differing(left["shadow"], x, right["shadow"], y) * (1 + threshold) <= (size_u[x] + size_v[y]) * (1 - threshold) + 1e-6
                    yield x[ok], y[ok]
                k = e


def candidates(texts: DataFrame, s: Settings, cross: bool) -> DataFrame:
    """(ta, tb), ta < tb: pairs of texts to verify, each once; every pair that reaches the threshold is among them."""
    threshold = s.threshold
    dealt, slots = cells(texts, threshold, cross)

    def run(table: pa.Table) -> pa.Table:
        sides = []
        for side in (0, 1):
            rows = table.filter(pa.array(table.column("side").to_numpy() == side))
            x = {p: np.concatenate([np.zeros(0, t), *(np.frombuffer(b, t) for b in rows.column(p).to_pylist())]) for p, t in zip(PARTS, TYPES)}
            x["shadow"] = x["shadow"].reshape(len(x["n"]), -1) if len(x["n"]) else x["shadow"].reshape(0, 1)
            sides.append(x)
        cell = table.column("cell")[0].as_py()
        same = cell // slots == cell % slots
        left, right = (sides[0], sides[0]) if same else sides
        if cross:
            # Texts of both roles may be found either way, or find themselves.
            ways = [(with_role(left, a), with_role(right, b)) for a, b in (((1, 2),) if same else ((1, 2), (2, 1)))]
        else:
            ways = [(left, right)]
        found = [(x["tid"][a], y["tid"][b]) for x, y in ways for a, b in searched(x, y, same and not cross, threshold)]
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        a, b = np.minimum(a, b), np.maximum(a, b)
        if cross:
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = (a != b) & np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
            a, b = a[new], b[new]
        return pa.table({"ta": a, "tb": b})

    return dealt.groupBy("cell").applyInArrow(run, "ta long, tb long")


def links(texts: DataFrame, s: Settings, cross: bool) -> DataFrame:
    """(ta, tb, similarity) of pairs of different texts, ta < tb."""
    return stash(verified(candidates(texts, s, cross), texts, s.threshold))


@dataclass
class Join:
    """rows (id, tid, role): each row and its text; links (ta, tb, similarity) between different texts."""

    rows: DataFrame
    links: DataFrame
    texts: DataFrame


def similarity_join(df: DataFrame, key: str, text: Column, s: Settings, role: Column | None = None) -> Join:
    """Join df with itself. With a role (1, 2 or null), only pairs of a row of role 1 and one of role 2 are looked for."""
    cross = role is not None
    rows = df.select(F.col(key).cast("long").alias("id"), text.alias("text"), (role if cross else F.lit(1)).cast("byte").alias("role"))
    rows = rows.where(F.col("id").isNotNull() & F.col("role").isNotNull() & (F.length("text") >= 3))
    print_ = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2")]
    texts = stash(
        rows.select("id", "role", "text", *print_).groupBy("h1", "h2")
        .agg(F.min("id").alias("tid"), F.first("text").alias("text"), F.bit_or("role").alias("roles"), F.count("*").alias("n"))
    )
    keyed = rows.select("id", "role", *print_).join(texts.select("h1", "h2", "tid"), ["h1", "h2"]).select("id", "tid", "role")
    return Join(keyed, links(texts, s, cross), texts)


#: Copies of a text up to which row_pairs() lists all their pairs; every_pair() lists them however many. Of more, each is listed with the first copy only, and only
#: the first one (of a role) stands for the text in pairs with other texts; classes() has every row either way.
WHOLE = 500


def row_pairs(j: Join, cross: bool = False) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: every pair of rows, copies included (see WHOLE for groups of very many)."""
    many = j.texts.where(F.col("n") > WHOLE).select("tid", F.lit(True).alias("many"))
    first = j.rows.join(many.select("tid"), "tid", "left_semi").groupBy("tid", "role").agg(F.min("id").alias("id")).select("tid", "id", F.lit(True).alias("first"))
    rows = j.rows.join(many, "tid", "left").join(first, ["tid", "id"], "left").withColumn("spokes", F.col("many").isNotNull() & F.col("first").isNull())
    side = lambda x, df: df.select(F.col("tid").alias(f"t{x}"), F.col("id").alias(f"i{x}"), F.col("role").alias(f"r{x}"))
    speaking = rows.where("not spokes")
    repeated = j.texts.where("n > 1").select(F.col("tid").alias("ta"))
    hubs = side("a", speaking).join(repeated, "ta")
    copies = hubs.join(side("b", speaking).withColumnRenamed("tb", "ta"), "ta").where("ia < ib")
    copies = copies.unionByName(hubs.join(side("b", rows.where("spokes")).withColumnRenamed("tb", "ta"), "ta")).withColumn("similarity", F.lit(1.0))
    linked = j.links.join(side("a", speaking), "ta").join(side("b", speaking), "tb")
    columns = ["ia", "ib", "ra", "rb", "similarity"]
    pairs = copies.select(columns).unionAll(linked.select(columns)).where(crossing(cross, "ra", "rb"))
    return pairs.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), "similarity")


def every_pair(j: Join, cross: bool = True) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: every row of role 1, or every row where roles don't count, with every row of role 2 that has its text or a linked one.

    Nothing stands for copies here, so the pairs of a text grow with the product of its rows of either role.
    """
    many = stash(j.texts.where(F.col("n") > BLOCK).select("tid", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")))
    rows = j.rows.join(many, "tid", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int"))
    side = lambda x, role: rows.where(F.col("role") == role if cross else F.lit(True)).select(F.col("tid").alias(f"t{x}"), F.col("part").alias(f"p{x}"), F.col("id").alias(f"i{x}"))
    parts = lambda x: many.select(F.col("tid").alias(f"t{x}"), F.col("parts").alias(f"n{x}"))
    spread = lambda x: F.explode(F.sequence(F.lit(0), F.coalesce(f"n{x}", F.lit(1)) - 1)).alias(f"p{x}")
    edges = (text_edges(j) if cross else j.links).join(parts("a"), "ta", "left").join(parts("b"), "tb", "left")
    edges = edges.select("ta", "tb", "similarity", "nb", spread("a")).select("ta", "tb", "similarity", "pa", spread("b"))
    pairs = edges.join(side("a", 1), ["ta", "pa"]).join(side("b", 2), ["tb", "pb"])
    pairs = pairs.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), "similarity")
    if cross:
        return pairs
    repeated = j.texts.where("n > 1").select("tid", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    copies = meetings(j.rows.join(repeated, "tid"), "tid", "id", [])
    return pairs.unionAll(copies.select(F.col("ida").alias("id_a"), F.col("idb").alias("id_b"), F.lit(1.0).alias("similarity")))


def text_edges(j: Join) -> DataFrame:
    """(ta, tb, similarity): text ta has rows of role 1, tb rows of role 2; a text in both roles meets itself, links go both ways."""
    same = j.texts.where(F.col("roles") == 3).select(F.col("tid").alias("ta"), F.col("tid").alias("tb"), F.lit(1.0).alias("similarity"))
    there = j.links.select("ta", "tb", "similarity")
    back = j.links.select(F.col("tb").alias("ta"), F.col("ta").alias("tb"), "similarity")
    return same.unionAll(there).unionAll(back)


def overlap_counts(j: Join) -> DataFrame:
    """(id, exact, n): rows of role 2 with a partner of role 1: whether one has its very text, and the number of its pairs, none of which is built."""
    training = j.rows.where("role = 1").groupBy(F.col("tid").alias("ta")).agg(F.count("*").alias("rows"))
    met = text_edges(j).join(training, "ta").groupBy(F.col("tb").alias("tid")).agg(F.bool_or(F.col("ta") == F.col("tb")).alias("exact"), F.sum("rows").alias("n"))
    return j.rows.where("role = 2").join(met, "tid").select("id", "exact", "n")


def equal_records(df: DataFrame, key: str, record: Column, role: Column) -> DataFrame:
    """(id): rows of role 2 whose canonical record a row of role 1 has as well, by hashes of the records alone.

    Records of fewer than 3 characters and null ones don't count. Roles meet per record before anything is joined, so a
    record that a third of the rows share is one row of the join's smaller side.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), record.alias("r"), role.cast("byte").alias("role")).where(F.col("id").isNotNull() & F.col("role").isNotNull() & (F.length("r") >= 3))
    keyed = rows.select("id", "role", F.xxhash64("r").alias("h1"), F.xxhash64(F.lit("second"), "r").alias("h2"))
    both = keyed.groupBy("h1", "h2").agg(F.bit_or("role").alias("roles")).where("roles = 3").select("h1", "h2")
    return keyed.where("role = 2").join(both, ["h1", "h2"], "left_semi").select("id")


def classes(j: Join) -> DataFrame:
    """(id, class_id, n_links): one row per row; class_id is the smallest id of its connected versions.

    Labels travel along links and take the label of their label, so long chains take few rounds; copies aren't paired.
    n_links counts other texts linked to the row's text.
    """
    edges = j.links.select(F.col("ta").alias("x"), F.col("tb").alias("y"))
    edges = stash(edges.unionAll(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))))
    labels = stash(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        nxt = labels.join(near, "x").select("x", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("x").alias("label"), F.col("label").alias("far"))
        nxt = stash(nxt.join(jump, "label", "left").select("x", F.coalesce("far", "label").alias("label"), "old"))
        changed = nxt.where("label <> old").limit(1).count()
        labels = nxt.select("x", "label")
        if not changed:
            break
    degree = edges.groupBy("x").agg(F.count("*").alias("n"))
    rows = j.rows.join(labels.withColumnRenamed("x", "tid"), "tid", "left").join(degree.withColumnRenamed("x", "tid"), "tid", "left")
    return rows.select("id", F.coalesce("label", "tid").alias("class_id"), F.coalesce("n", F.lit(0)).alias("n_links"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)
