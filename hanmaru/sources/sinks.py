"""Sinks: audit lines behind a leak scan, insert with deduplication, upsert, partition replacement, sized parts."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# What an audit line must never hold.
LEAKS = {
    "resident_number": r"\d{6}-[1-8]\d{6}", "phone": r"01[016789][- ]?\d{3,4}[- ]?\d{4}", "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}", "card": r"\d{4}[- ]\d{4}[- ]\d{4}[- ]\d{4}", "ipv4": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "licence": r"\d{2}-\d{2}-\d{6}-\d{2}", "business_number": r"\d{3}-\d{2}-\d{5}", "openai_key": r"sk-[A-Za-z0-9]{16}", "github_token": r"gh[po]_[A-Za-z0-9]{16}", "aws_key": r"AKIA[0-9A-Z]{16}",
}


def leaks(text: Column) -> Column:
    """Names of the patterns that a text matches; never the match."""
    found = F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in LEAKS.items()))
    return F.filter(found, lambda x: x.isNotNull())


def audit_lines(events: DataFrame, path: str, skip: tuple[str, ...] = ("value_hash", "key_id")) -> None:
    """Append events as JSON lines, one file a task and 100 000 lines a file; an event that leaks isn't written."""
    texts = [F.col(c) for c, t in events.dtypes if t == "string" and c not in skip]
    safe = events.where(F.size(leaks(F.concat_ws(" ", *texts))) == 0)
    safe.write.mode("append").option("maxRecordsPerFile", 100_000).json(path)


def insert_new(df: DataFrame, path: str, hash_: str) -> DataFrame:
    """Append rows whose hash the table at path doesn't hold yet, the first of each hash; returns what was added."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    new = df.where(F.col(hash_).isNotNull()).dropDuplicates([hash_])
    if there:
        new = new.join(spark.read.parquet(path).select(hash_), hash_, "left_anti").select(*df.columns)
    new.write.mode("append").parquet(path)
    return new


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by order, of both tables; columns of new that old lacks are null."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.groupBy(key).agg(F.max_by(F.struct(*(F.col(c) for c in both.columns if c != key)), F.coalesce(F.col(order).cast("string"), F.lit(""))).alias("r")).select(key, "r.*")


def replace_sources(df: DataFrame, path: str) -> None:
    """Overwrite exactly the sources that df holds; an empty df replaces nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def sized_parts(df: DataFrame, most: int) -> DataFrame:
    """(part, n_rows, n_bytes, lines): rows as JSON lines in parts of at most so many bytes (a longer line is a part).

    Each task numbers its own parts; the largest part, not the largest partition, bounds a row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, part, size, lines = TaskContext.get().partitionId(), 1, 0, []

        def full() -> pd.DataFrame:
            return pd.DataFrame([(f"{task:05d}-{part:03d}", len(lines), size, "".join(lines))], columns=["part", "n_rows", "n_bytes", "lines"])

        for batch in batches:
            for record in batch.to_dict("records"):
                line = json.dumps(record, ensure_ascii=False, default=str) + "\n"
                n = len(line.encode())
                if lines and size + n > most:
                    yield full()
                    part, size, lines = part + 1, 0, []
                lines.append(line)
                size += n
        if lines:
            yield full()

    return df.mapInPandas(run, "part string, n_rows long, n_bytes long, lines string")


def shows_nothing(payload: Column, values: Column) -> Column:
    """The payload; an error, which doesn't show it, if one of the values occurs in it."""
    return F.when(F.exists(F.coalesce(values, F.array().cast("array<string>")), lambda v: (F.length(v) > 0) & payload.contains(v)), F.raise_error(F.lit("a detected value would be stored")).cast("string")).otherwise(payload)


def drop_days(spark: SparkSession, path: str, before: str) -> list[str]:
    """Remove the partitions day=... of a table that lie before a day; returns their names. Later and other folders stay."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    days = [s.getPath() for s in system.listStatus(place) if s.getPath().getName().startswith("day=")]
    old = [d for d in days if d.getName()[4:] < before]
    for d in old:
        system.delete(d, True)
    return sorted(d.getName() for d in old)


def report(metrics: dict[str, DataFrame], path: str, most: int = 1000) -> None:
    """Small tables of metrics as JSON lines (name, row) and as one Markdown page below path; at most so many rows of each are shown on the page."""
    spark = next(iter(metrics.values())).sparkSession
    lines, page = [], []
    for name, df in metrics.items():
        lines.append(df.select(F.lit(name).alias("name"), F.to_json(F.struct("*")).alias("row")))
        rows = df.limit(most).collect()
        page += [f"# {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in rows), ""]
    reduce(DataFrame.unionAll, lines).write.mode("overwrite").json(f"{path}/json")
    spark.createDataFrame([("\n".join(page),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/page")
