"""Text cut off by a field limit or in transfer.

Positives are made: intact values are cut at random places, some with the mark that a transfer leaves. A hashed
logistic regression learns, from the closing characters, the punctuation, the last line and the distance to the limit
of the source's field, what tells their ends from ends of intact values; then it scores every record.

Field limits come from all records: a source has a limit of n characters (or bytes) if at least 5 and 2 % of its texts
have exactly that length and at most 5 % are longer; a limit that fewer texts reach isn't seen, and those texts are
judged by their ends alone. The regression is fitted on a sample of at most ``SAMPLE`` records, taken by a
hash of the key; the few that are cut themselves count as intact at first and are left out of the later fits.

Null, empty and blank texts are never truncated. Without any intact text of 20 characters to learn from, every score is 0. Rows of a null source are scored without a limit.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

SAMPLE = 8000
#: Cuts to learn from, at least, if every text is cut at most eight times.
CUTS = 8000
BITS = 17
#: What may follow a break: an ellipsis, a broken character, the beginning of an entity, an escape or a tag.
MARKS = re.compile(r"(?:\s|…|�|&[A-Za-z#0-9]{0,6}|\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?|<[A-Za-z/]{0,6}|\[\.{3}\]?|\((?:더|더보|더보기|계속|생략|중략)?\)?)+$")
HANGUL = re.compile(r"[가-힣]+")
DIGITS = re.compile(r"[0-9]")


def limits(df: DataFrame, source: str, text: str) -> DataFrame:
    """(source, chars, bytes): the field limit of each source, null where it has none."""
    lengths = df.where(F.trim(F.regexp_replace(text, r"\s+", " ")) != "").select(
        F.col(source).alias("source"),
        F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.length(text).alias("n")), F.struct(F.lit("bytes").alias("unit"), F.octet_length(text).alias("n")))).alias("l"),
    )
    counts = lengths.groupBy("source", "l.unit", "l.n").agg(F.count("*").alias("rows"))
    per = Window.partitionBy("source", "unit")
    ahead = per.orderBy("n").rowsBetween(1, Window.unboundedFollowing)
    near = per.orderBy("n").rangeBetween(4, Window.unboundedFollowing)
    marked = counts.select(
        "source", "unit", "n", "rows", F.sum("rows").over(per).alias("all"),
        F.coalesce(F.sum("rows").over(near), F.lit(0)).alias("longer"), F.coalesce(F.max("rows").over(ahead), F.lit(0)).alias("next"),
    )
    spike = (F.col("rows") >= 5) & (F.col("rows") >= 0.02 * F.col("all")) & (F.col("longer") <= 0.05 * F.col("all")) & (F.col("rows") >= 3 * F.col("longer") / 2)
    found = marked.where(spike).groupBy("source", "unit").agg(F.max_by("n", "rows").alias("n"))
    return found.groupBy("source").agg(F.max(F.when(F.col("unit") == "chars", F.col("n"))).alias("chars"), F.max(F.when(F.col("unit") == "bytes", F.col("n"))).alias("bytes"))


def slot(name: str) -> int:
    return crc32(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def features(text: str, off_chars: int | None, off_bytes: int | None) -> list[int]:
    """Slots of the active features. off: length less the limit, None without a limit near by."""
    tail = text[-160:]
    end = MARKS.search(tail)
    mark = end.group() if end else ""
    body = DIGITS.sub("9", tail[: len(tail) - len(mark)] if end else tail)
    line = body.rsplit("\n", 1)[-1]
    words = line.split()
    last = words[-1] if words else ""
    out = ["1"]
    stripped = mark.strip()
    out.append("mark " + (stripped[:2] or ("space" if mark else "none")))
    if "\n" in mark:
        out.append("mark newline")
    for n in (1, 2, 3, 4, 5, 7):
        out.append(f"end{n} " + body[-n:])
    final = body[-1:]
    kind = "hangul" if HANGUL.match(final) else "latin" if final.isascii() and final.isalpha() else "digit" if final == "9" else "other"
    out += [f"kind {kind}", f"kind {kind} mark {bool(stripped)}", f"kind {kind} space {bool(mark)}"]
    stop = bool(re.search(r"[.!?。][\"'”’)\]]*$", body))
    out.append(f"stop {stop} {bool(stripped)}")
    out.append(f"last {last[-12:]}")
    out.append("two " + " ".join(words[-2:])[-24:])
    shape = HANGUL.sub("가", re.sub(r"[A-Za-z]+", "a", line[-40:]))
    out.append("shape " + shape[-12:])
    first = line[:2] if line[:1] in "-#(*[" else "http" if line.startswith("http") else line[:3] if line[1:2] == ":" else "text"
    out += [f"line {first}", f"line {first} words {min(len(words), 4)}", f"line {first} {kind} {stop}"]
    if len(words) <= 4:
        out.append("whole " + HANGUL.sub(lambda m: m.group() if len(m.group()) < 4 else "가", line))
    sentence = re.split(r"(?<=[.!?。])\s", body)[-1]
    opened = sentence.count("(") - sentence.count(")")
    out.append(f"open {np.sign(opened)} {sentence.count(chr(39)) % 2} {sentence.count(chr(34)) % 2} {sentence.count('“') > sentence.count('”')}")
    out.append(f"short {len(sentence.split()) <= 2} {kind} {stop}")
    for unit, off in (("c", off_chars), ("b", off_bytes)):
        if off is not None and -3 <= off <= 3:
            out += [f"at {unit} {off}", f"at {unit} {stop} {kind}", f"at limit {stop}"]
    return [slot(x) for x in out]


def offsets(text: str, chars: int | None, size: int | None) -> tuple[int | None, int | None]:
    return (len(text) - chars if chars else None), (len(text.encode("utf-8", "replace")) - size if size else None)


class Regression:
    """Logistic regression over hashed features, fitted by AdaGrad over the whole sample."""

    def __init__(self) -> None:
        self.weights = np.zeros(1 << BITS, np.float32)
        self.fitted = False

    def fit(self, rows: list[list[int]], labels: np.ndarray, steps: int = 120, rate: float = 0.4, decay: float = 2e-5) -> Regression:
        """Both classes weigh the same; a feature of a single row teaches nothing and is left out."""
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        slots = np.fromiter((s for r in rows for s in r), np.int64, len(owner))
        used, at, seen = np.unique(slots, return_inverse=True, return_counts=True)
        often = (seen >= 3)[at]
        owner, at = owner[often], at[often]
        weight = np.where(labels > 0, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
        w, past = np.zeros(len(used)), np.full(len(used), 1e-6)
        for _ in range(steps):
            error = weight * (labels - 1 / (1 + np.exp(-np.bincount(owner, w[at], len(rows)))))
            slope = np.bincount(at, error[owner], len(used)) - decay * w
            past += slope * slope
            w += rate * slope / np.sqrt(past)
        self.weights[used] = w
        self.fitted = True
        return self

    def score(self, row: list[int]) -> float:
        return float(1 / (1 + np.exp(-self.weights[row].sum(dtype=np.float64)))) if self.fitted else 0.0


def cut(text: str, dice: random.Random) -> str:
    """A damaged end: cut within a sentence, with or without a mark."""
    for _ in range(8):
        upto = dice.randrange(max(1, min(len(text) - 4, 8)), len(text) - 2)
        out = text[:upto]
        if not re.search(r"[.!?。][\"'”’)]*\s*$|\n$", out) and text[upto] not in ".!?\n":
            break
    mark = dice.random()
    if mark < 0.12:
        out = out[:-1] + "…"
    elif mark < 0.2:
        out += "�"
    elif mark < 0.24:
        out += dice.choice([" (더", " (더보기", " (계속"])
    elif mark < 0.31:
        out += dice.choice(["&nb", "&n", "&am", "\\u", "\\", "<b", " <", "<", "&", "&#", "\\u0"])
    return out


def fit(sample: list[tuple[str, int | None, int | None]]) -> Regression:
    """sample: (text, limit in characters, limit in bytes). Texts at their limit are no examples of intact ones."""
    dice = random.Random(17)
    intact = []
    for text, chars, size in sample:
        off = offsets(text, chars, size)
        if len(text) >= 20 and not any(o is not None and -3 <= o <= 3 for o in off):
            intact.append((text, off))
    if not intact:
        return Regression()  # nothing to learn from: every record scores 0
    negative = [features(text, *off) for text, off in intact]
    # A complete text may lack its final stop, or be as long as the limit by chance.
    bare = {k: features(text.rstrip()[:-1], *off) for k, (text, off) in enumerate(intact) if re.search(r"[다요]\.$|[a-z]\.$", text.rstrip()) and dice.random() < 0.25}
    level = {k: features(text, 0, 0) for k, (text, _) in enumerate(intact) if dice.random() < 0.1}
    times = max(1, min(8, CUTS // len(intact)))
    positive: list[list[int]] = []
    from_text: list[int] = []
    for k, (text, _) in enumerate(intact):
        for _ in range(times):
            damaged = cut(text, dice)
            near = dice.choice([0, 0, 0, -1, 1]) if dice.random() < 0.5 else None
            positive.append(features(damaged, near if dice.random() < 0.6 else None, near if dice.random() < 0.4 else None))
            from_text.append(k)

    def trained(kept: list[int], cuts: list[list[int]]) -> Regression:
        rows = [negative[k] for k in kept] + [bare[k] for k in kept if k in bare] + [level[k] for k in kept if k in level] + cuts
        labels = np.zeros(len(rows))
        labels[len(rows) - len(cuts) :] = 1
        return Regression().fit(rows, labels)

    kept = list(range(len(negative)))
    for doubt in (0.5, 0.3):  # each half of the texts is judged by a fit that hasn't seen it
        halves = [trained([k for k in kept if k % 2 == h], [p for p, k in zip(positive, from_text) if k % 2 == h]) for h in (0, 1)]
        kept = [k for k in range(len(negative)) if halves[1 - k % 2].score(negative[k]) < doubt]
    model = trained(kept, positive)
    return model


def scored(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(doc_id, source, score) of every record with a text."""
    spark = df.sparkSession
    known = limits(df, source, text)
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(text).cast("string").alias("text"))
    rows = rows.where(F.length(F.trim(F.regexp_replace("text", r"(?U)\s+", " "))) > 0)
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    part = min(1.0, 0.9 * SAMPLE / max(1, rows.count()))
    with_limits = rows.join(known, "source", "left")
    sample = with_limits.where(spread < int(part * 1_000_000)).select("text", "chars", "bytes", "doc_id").limit(SAMPLE).collect()
    sample.sort(key=lambda r: (r[3] is None, r[3], r[0]))  # the same fit whatever the order of partitions
    shared = spark.sparkContext.broadcast(fit([(r[0], r[1], r[2]) for r in sample]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            values = zip(*(batch.column(k).to_pylist() for k in ("text", "chars", "bytes")))
            scores = [model.score(features(t, *offsets(t, c, b))) for t, c, b in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "source", "score"])

    return with_limits.select("doc_id", "source", "text", "chars", "bytes").mapInArrow(run, "doc_id long, source string, score double")


def report(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(source, n_docs, n_truncated, rate) over records with a text."""
    return scores.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(F.col("score") >= threshold).alias("n_truncated")).withColumn("rate", F.col("n_truncated") / F.col("n_docs"))
