"""Streams of records: deduplication in event time, masking of each micro-batch, first-wins insert."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from hanmaru.functions.text import content_hash
from hanmaru.operators.spans import guarded
from hanmaru.sources.sinks import insert_new


def parquet_stream(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stream over root/name.parquet, which may be one file or a folder of them."""
    static = spark.read.parquet(f"{root}/{name}.parquet")
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet")
    folder = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    reader = spark.readStream.schema(static.schema)
    return reader.parquet(f"{root}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(root)


def deduplicated(stream: DataFrame, text: str, time: str, delay: str = "7 days") -> DataFrame:
    """Rows whose normalised text hasn't been seen within the delay; state is dropped behind the watermark. Rows without a time go."""
    return stream.where(F.col(time).isNotNull()).withColumn("_h", content_hash(F.col(text))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["_h"]).drop("_h")


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Write what the stream holds now into a new table below folder and read it."""
    place = f"{folder}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{place}/state").option("path", f"{place}/data").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/data")


def masked_stream(stream: DataFrame, text: str) -> DataFrame:
    """Masking is row by row, so it is the same on a stream."""
    return guarded(stream, text).drop("spans")


def insert_stream(stream: DataFrame, text: str, path: str, state: str) -> None:
    """Append each micro-batch's rows whose hash the table doesn't hold: first wins, over the table's whole life."""

    def add(batch: DataFrame, _: int) -> None:
        insert_new(batch.withColumn("content_hash", content_hash(F.col(text))), path, "content_hash")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Rows by event-time window and key; rows later than the delay are left out."""
    return stream.where(F.col(time).isNotNull()).withWatermark(time, delay).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
