"""Readers of record files: delimited, JSON lines, text lines, zipped JSON, reviewed cases, seeds."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hanmaru.functions.text import squash

ENCODINGS = ("utf-8-sig", "cp949", "euc-kr")
PRESETS = {"csv": "*.{csv,tsv}", "jsonl": "*.{jsonl,ndjson}", "text": "*.txt", "zip_json": "*.zip"}


def decoded(data: bytes) -> str:
    """UTF-8 with or without mark, else the Korean code pages, else UTF-8 with replacement."""
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")


def delimited(spark: SparkSession, path: str, columns: list[str] | None = None, key: str | None = None) -> DataFrame:
    """(path, row, id, fields): CSV or TSV files of any of the encodings, delimiter by the first 8 KiB of each.

    Each file is one task's work; large ones of one known encoding belong into spark.read.csv. Unknown columns give all.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"]):
                text = decoded(content)
                try:
                    dialect = csv.Sniffer().sniff(text[:8192], delimiters=",\t|;")
                except csv.Error:
                    dialect = csv.excel
                rows = []
                for n, record in enumerate(csv.DictReader(io.StringIO(text), dialect=dialect)):
                    wanted = [c for c in (columns or ()) if c in record] or [c for c in record if c is not None]
                    fields = {c: record[c] for c in wanted if record[c] is not None and str(record[c]).strip()}
                    rows.append((where, n, record.get(key) if key else None, fields))
                yield pd.DataFrame(rows, columns=["path", "row", "id", "fields"])

    return files(spark, path, PRESETS["csv"]).mapInPandas(run, "path string, row long, id string, fields map<string,string>")


def json_lines(spark: SparkSession, path: str, pattern: str = PRESETS["jsonl"]) -> DataFrame:
    """(fields): objects as text fields without nulls; a line that is no JSON becomes its field text; other JSON goes."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("path")).where("line <> ''")

    @F.pandas_udf("map<string,string>")
    def parse(column: pd.Series) -> pd.Series:
        def one(line: str) -> dict | None:
            try:
                value = json.loads(line)
            except ValueError:
                return {"text": line}
            if not isinstance(value, dict):
                return None
            return {str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in value.items() if v is not None}

        return column.map(one)

    return lines.select("path", parse("line").alias("fields")).where("fields is not null")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", PRESETS["text"]).text(path).select(F.trim("value").alias("text"), F.col("_metadata.file_path").alias("path")).where("text <> ''")


def records(spark: SparkSession, path: str, preset: str, columns: list[str] | None = None, key: str | None = None) -> DataFrame:
    """(path, row_index, fields): rows of all files of a kind, numbered over the files in order of their names.

    Rows are numbered within each file where they are read; only the files' sizes, one row a file, are added up.
    """
    if preset == "csv":
        rows = delimited(spark, path, columns, key).select("path", "row", "fields")
    else:
        lines = json_lines(spark, path) if preset == "jsonl" else text_lines(spark, path).select("path", F.create_map(F.lit("text"), F.col("text")).alias("fields"))
        rows = lines.select("path", F.monotonically_increasing_id().alias("_at"), "fields")
        rows = rows.withColumn("row", F.row_number().over(Window.partitionBy("path").orderBy("_at")) - 1).drop("_at")
    sizes = rows.groupBy("path").agg(F.count("*").alias("n"))
    before = sizes.select("path", F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, "path").select("path", (F.col("before") + F.col("row")).alias("row_index"), "fields")


def zipped_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, title, subtitle, content) of every object under SJML.text; broken members are skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"]):
                rows: list[tuple] = []
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in sorted(archive.namelist()):
                        try:
                            found = json.loads(decoded(archive.read(name)))["SJML"]["text"]
                        except (ValueError, KeyError, TypeError, zipfile.BadZipFile):
                            continue
                        stack = [found]
                        while stack:
                            x = stack.pop()
                            if isinstance(x, list):
                                stack.extend(reversed(x))
                            elif isinstance(x, dict):
                                rows.append((where, name, *(None if x.get(k) is None else str(x[k]) for k in ("title", "subtitle", "content"))))
                yield pd.DataFrame(rows, columns=["path", "member", "title", "subtitle", "content"])

    return files(spark, path, PRESETS["zip_json"]).mapInPandas(run, "path string, member string, title string, subtitle string, content string")


def composed(df: DataFrame, fields: list[str]) -> DataFrame:
    """Adds text ("name: value" lines of the fields that hold something) and, for each field, where its value stands."""
    parts = F.filter(F.array(*(F.struct(F.lit(f).alias("name"), squash(F.col(f).cast("string")).alias("value")) for f in fields)), lambda p: F.coalesce(p["value"], F.lit("")) != "")
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p["name"]) + F.length(p["value"]) + 3).alias("at"),
        F.concat(acc["out"], F.array(F.struct(p["name"].alias("name"), (acc["at"] + F.length(p["name"]) + 2).alias("start"), (acc["at"] + F.length(p["name"]) + 2 + F.length(p["value"])).alias("end")))).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<name:string,start:int,end:int>>").alias("out"))
    text = F.concat_ws("", F.transform("_parts", lambda p: F.concat(p["name"], F.lit(": "), p["value"], F.lit("\n"))))
    return df.withColumn("_parts", parts).withColumn("text", text).withColumn("fields", F.aggregate("_parts", start, step, lambda acc: acc["out"])).drop("_parts")


def reviewed_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of JSON lines; a label outside its text stops the read without showing the text."""
    schema = "id string, text string, expected_masked_text string, labels array<struct<start:int,end:int,entity_type:string,risk_level:string,suffix:string>>, tags array<string>"
    rows = spark.read.schema(schema).json(path)
    bad = F.exists(F.coalesce("labels", F.array().cast("array<struct<start:int,end:int,entity_type:string,risk_level:string,suffix:string>>")), lambda x: (x["start"] < 0) | (x["start"] >= x["end"]) | (x["end"] > F.length("text")))
    return rows.withColumn("text", F.when(bad, F.raise_error(F.concat(F.lit("label outside the text of case "), F.col("id")))).otherwise(F.col("text")))


# Fields of address lines by layout: name, place; which must hold something; how many there are at least.
LAYOUTS = {
    "road": ({"sido": 2, "sigungu": 3, "emd": 4, "ri": 5, "road_name": 10, "postcode": 16}, (12, 13), ("sido", "sigungu", "road_name"), 17),
    "lot": ({"sido": 2, "sigungu": 3, "emd": 4, "ri": 5, "is_mountain": 6}, (7, 8), ("sido", "sigungu", "emd"), 9),
    "road_english": ({"sido_en": 2, "sigungu_en": 3, "emd_en": 4, "road_name_en": 7, "postcode": 11}, (9, 10), ("sido_en", "sigungu_en", "road_name_en"), 12),
    "full_english": ({"sido_en": 1, "sigungu_en": 2, "emd_en": 3, "road_name_en": 9, "postcode": 14}, (11, 12), ("sido_en", "sigungu_en", "road_name_en"), 15),
}


def postal(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """Pipe-separated address lines of a layout: its fields and building_no, the main number with the sub number behind a dash.

    Lines that are too short, lack a needed field or have no main number go.
    """
    places, (main, sub), needed, least = LAYOUTS[layout]
    cells = F.split("value", r"\|", -1)
    cell = lambda k: F.nullif(F.trim(F.try_element_at(cells, F.lit(k + 1))), F.lit(""))
    number = lambda k: F.nullif(F.regexp_replace(cell(k), "^0+", ""), F.lit(""))
    rows = spark.read.text(path).where(F.size(cells) >= least)
    whole = F.concat(number(main), F.coalesce(F.concat(F.lit("-"), number(sub)), F.lit("")))
    read = rows.select(*(cell(k).alias(n) for n, k in places.items()), whole.alias("building_no"))
    return read.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*needed, "building_no"))))


def inspected(df: DataFrame) -> DataFrame:
    """(column, type, n_rows, n_filled) of a table; never a value of it."""
    counts = df.agg(F.count("*").alias("_n"), *(F.count(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(df.columns)))
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("_n").alias("n_rows"), F.col(f"c{k}").alias("n_filled")) for k, (c, t) in enumerate(df.dtypes)]
    return counts.select(F.inline(F.array(*rows)))


def seed_parts(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of JSON-line files named by paths with wildcards, with the path of each; a file that several of them name is read once."""
    jvm = spark.sparkContext._jvm
    first = jvm.org.apache.hadoop.fs.Path(paths[0])
    system = first.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    named = sorted({s.getPath().toString() for p in paths for s in system.globStatus(jvm.org.apache.hadoop.fs.Path(p)) or []})
    return spark.read.schema(schema).json(named).select("*", F.col("_metadata.file_path").alias("path"))


def inspected_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding, columns, n_rows, presets) of each file that a preset can read; never a value of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for where, content in zip(batch["path"], batch["content"]):
                kind = where.rsplit(".", 1)[-1].lower()
                encoding = next((e for e in ENCODINGS if readable(content, e)), "utf-8")
                lines = [x for x in decoded(content).splitlines() if x.strip()]
                if kind in ("csv", "tsv"):
                    rows.append((where, encoding, re.split("[,\t|;]", lines[0]) if lines else [], max(0, len(lines) - 1), ["csv"]))
                elif kind in ("jsonl", "ndjson"):
                    names = next((list(x) for x in map(json_object, lines) if x is not None), [])
                    rows.append((where, encoding, names, len(lines), ["jsonl", "text"]))
                elif kind == "txt":
                    rows.append((where, encoding, [], len(lines), ["text"]))
            yield pd.DataFrame(rows, columns=["path", "encoding", "columns", "n_rows", "presets"])

    return files(spark, path, "*").mapInPandas(run, "path string, encoding string, columns array<string>, n_rows int, presets array<string>")


def readable(data: bytes, encoding: str) -> bool:
    try:
        data.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def json_object(line: str) -> dict | None:
    try:
        value = json.loads(line)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None
