"""Taggers as detectors: a backend per task, windows over long texts, decoding, merging, thresholds."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: A backend takes texts and gives (start, end, label, probability) spans of each; it is built once per task.
Backend = Callable[[list[str]], list[list[tuple[int, int, str, float]]]]
# Probabilities that a type needs.
THRESHOLDS = {"PERSON_NAME": 0.85, "ADDRESS_FULL": 0.80, "ORGANIZATION": 0.75}
PROVINCE = re.compile(r"(?:서울|부산|대구|인천|광주|대전|울산|세종|경기|강원|충청|충북|충남|전라|전북|전남|경상|경북|경남|제주)")


def literal_backend(names: dict[str, float]) -> Callable[[], Backend]:
    """The stand-in for a model: the first occurrence of given names, with given probabilities."""

    def build() -> Backend:
        return lambda texts: [[(t.find(n), t.find(n) + len(n), "PERSON_NAME", p) for n, p in names.items() if n in t] for t in texts]

    return build


def windows(n: int, size: int) -> list[tuple[int, int]]:
    """Windows of a size with half of it as stride, the last one ending at n."""
    out, at = [], 0
    while True:
        out.append((at, min(n, at + size)))
        if at + size >= n:
            return out
        at += max(1, size // 2)


def merged(spans: Iterable[tuple[int, int, str, float]], overlap: float = 0.5) -> list[tuple[int, int, str, float]]:
    """Spans of one label whose intersection is at least half of their union become one, with the mean probability."""
    out: list[tuple[int, int, str, float]] = []
    for s in sorted(spans):
        for k, o in enumerate(out):
            common = min(s[1], o[1]) - max(s[0], o[0])
            if s[2] == o[2] and common > 0 and common / (max(s[1], o[1]) - min(s[0], o[0])) >= overlap:
                out[k] = (min(s[0], o[0]), max(s[1], o[1]), s[2], (s[3] + o[3]) / 2)
                break
        else:
            out.append(s)
    return sorted(out)


def decode(labels: list[str], places: list[tuple[int, int]], probabilities: list[float]) -> list[tuple[int, int, str, float]]:
    """BIO labels of tokens to spans; an I- that continues nothing begins a span."""
    out: list[tuple[int, int, str, float]] = []
    run: list[int] = []

    def close() -> None:
        if run:
            out.append((places[run[0]][0], places[run[-1]][1], labels[run[0]][2:], sum(probabilities[k] for k in run) / len(run)))
            run.clear()

    for k, label in enumerate(labels):
        goes_on = label[:2] == "I-" and run and labels[run[0]][2:] == label[2:]
        if not goes_on:
            close()
        if label != "O":
            run.append(k)
    close()
    return out


def parted(text: str, span: tuple[int, int, str, float]) -> list[tuple[int, int, str, float]]:
    """A name that runs into an address is cut where a province begins; the name loses its particle and a tenth of its probability."""
    a, b, label, p = span
    m = PROVINCE.search(text, a + 2, b) if label == "PERSON_NAME" else None
    if not m:
        return [span]
    name = re.sub(r"(은|는|이|가|의|와|과)?\s*$", "", text[a : m.start()])
    return [(a, a + len(name), label, p * 0.9), (m.start(), b, "ADDRESS_FULL", p)]


def tagged(df: DataFrame, key: str, text: str, backend: Callable[[], Backend], labels: dict[str, str] | None = None, thresholds: dict[str, float] | None = None, size: int = 510) -> DataFrame:
    """(key, start, end, entity, score, confident): spans of a backend over whole texts; low ones stay, marked."""
    limit = THRESHOLDS if thresholds is None else thresholds

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend()
        for batch in batches:
            rows = []
            values = [(k, t) for k, t in zip(batch[key], batch[text]) if t]
            parts = [(n, a, t[a:b]) for n, (_, t) in enumerate(values) for a, b in windows(len(t), size)]
            found: dict[int, list[tuple[int, int, str, float]]] = {}
            for at in range(0, len(parts), 64):
                some = parts[at : at + 64]
                for (n, a, _), spans in zip(some, model([p[2] for p in some])):
                    found.setdefault(n, []).extend((a + s, a + e, (labels or {}).get(x, x), p) for s, e, x, p in spans)
            for n, spans in found.items():
                for span in merged(spans):
                    for s, e, x, p in parted(values[n][1], span):
                        rows.append((values[n][0], s, e, x, p, p >= limit.get(x, 0.0)))
            yield pd.DataFrame(rows, columns=[key, "start", "end", "entity", "score", "confident"])

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, start int, end int, entity string, score double, confident boolean")


def decoded(df: DataFrame, key: str, labels: str) -> DataFrame:
    """(key, start, end, entity): spans of a column of labels, one label a character."""

    def run(batches):  # type: ignore[no-untyped-def]
        for batch in batches:
            out = []
            for k, names in zip(batch[key], batch[labels]):
                names = list(names)
                out += [(k, a, b, entity) for a, b, entity, _ in decode(names, [(j, j + 1) for j in range(len(names))], [1.0] * len(names))]
            yield pd.DataFrame(out, columns=[key, "start", "end", "entity"])

    return df.where(F.col(labels).isNotNull()).select(key, labels).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, start int, end int, entity string")
