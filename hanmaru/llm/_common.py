"""What the operators of this subpackage share: reading, cutting lineage, arrays of code points."""

from __future__ import annotations

import os
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Characters that one NumPy step works on; bounds a worker's memory whatever the batch holds.
CHUNK_CHARS = 1_000_000
CHUNK_TEXTS = 1 << 14


def read(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of at most CHUNK_TEXTS texts of about limit characters; a longer text gets a range of its own."""
    start = total = 0
    for k, text in enumerate(texts):
        if k > start and (total + len(text) > limit or k - start >= CHUNK_TEXTS):
            yield start, k
            start, total = k, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def codes(text: str) -> np.ndarray:
    """Code points; lone surrogates stay what they are."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def distinct(a: np.ndarray) -> np.ndarray:
    """Distinct values in order. (np.unique hashes integers, which takes many times as long.)"""
    a = np.sort(a)
    return a[np.r_[True, a[1:] != a[:-1]]] if len(a) else a


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(a: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each window of q code points."""
    n = len(a) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + a[k : k + n].astype(np.uint64) + np.uint64(1)
    return mix(h)


_LETTERS: np.ndarray | None = None


def letters_and_numbers() -> np.ndarray:
    """For each code point, whether its category is L or N."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def bare(text: str) -> str:
    """Lower case, reduced to letters and numbers (categories L and N)."""
    a = codes(text.lower())
    return a[letters_and_numbers()[a]].tobytes().decode("utf-32-le", "surrogatepass")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of this machine only where none is set and all runs on it."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not (context.master or "").startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "hanmaru-checkpoints")


def stash(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, survives lost executors.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/hanmaru-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
