"""Queries of the corpus store, sampling and labels."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hanmaru.functions.lists import SURNAMES
from hanmaru.functions.text import content_hash, squash
from hanmaru.operators import corpus as C, tagging
from hanmaru.plans.normalisation import SQUASH
from hanmaru.sources import readers, sinks
from hanmaru.sources.readers import composed, inspected
from hanmaru.sources.tables import shared_folder, table
from hanmaru.streaming import ingest

LICENCES = ["CC-BY", "CC0"]


def folder(spark: SparkSession) -> str:
    """A new folder where all executors can write; it goes when the application ends."""
    path = f"{shared_folder(spark)}/hanmaru-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame) -> DataFrame:
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def examples(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return table(spark, root, "ner_examples", *(columns or ("id", "source", "license", "split_hint", "sentence")))


def split_rows(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    rows = examples(spark, root).withColumn("split", C.split_name(F.col("split_hint")))
    return rows.where("split = 'train'").drop("split"), rows.where("split in ('val', 'test')").drop("split")


def first_wins(spark: SparkSession, root: str) -> DataFrame:
    return C.first_wins(examples(spark, root, "id", "source", "sentence"), content_hash(F.col("sentence")), "id")


def insert_counts(spark: SparkSession, root: str) -> DataFrame:
    rows = examples(spark, root, "id", "source", "sentence", "tokens", "labels", "label_names")
    return C.insert_counts(rows, content_hash(F.col("sentence")), C.example_valid())


def bio_valid(spark: SparkSession, root: str) -> DataFrame:
    rows = examples(spark, root, "id", "tokens", "labels", "label_names")
    return rows.select("id", F.coalesce(C.example_valid(), F.lit(False)).alias("ok"))


def gazetteer_insert(spark: SparkSession, root: str) -> DataFrame:
    """Entries trimmed, blanks skipped, one of each type and value: the one with the smallest id."""
    rows = table(spark, root, "gazetteers", "id", "entity_type", "entry_value").withColumn("value", F.trim("entry_value")).where("value <> '' and entity_type is not null")
    return rows.groupBy("entity_type", "value").agg(F.min("id").alias("id"))


def weak_insert(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "weak_examples", "id", "label_names").where("label_names is not null")
    tags = F.array_sort(F.array_distinct(F.transform(F.filter("label_names", lambda x: x != "O"), lambda x: F.substring(x, 3, 99))))
    return rows.select("id", F.array_join(tags, ",").alias("tag_set"), F.size(F.filter("label_names", lambda x: x.startswith("B-"))).alias("n_spans"))


def leakage_semi(spark: SparkSession, root: str) -> DataFrame:
    train, held = split_rows(spark, root)
    return C.leaked(train, held, "sentence").select("id", "source")


def leakage_by_source(spark: SparkSession, root: str) -> DataFrame:
    return leakage_semi(spark, root).groupBy("source").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def export(spark: SparkSession, root: str) -> DataFrame:
    train, held = split_rows(spark, root)
    return C.exported(train, LICENCES, C.leaked(train, held, "sentence"), "sentence").select("id", "source", "license")


def corpus_stats(spark: SparkSession, root: str) -> DataFrame:
    rows = examples(spark, root, "source", "license", "n_entities")
    return rows.cube("source", "license").agg(F.count("*").alias("n"), F.sum("n_entities").alias("n_entities"), F.grouping_id().alias("level"))


def tag_counts(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "weak_examples", "source", "label_names").select("source", F.explode("label_names").alias("l")).where("l like 'B-%'")
    return rows.groupBy("source", F.substring("l", 3, 99).alias("tag")).agg(F.count("*").alias("n"))


def bio_spans(spark: SparkSession, root: str) -> DataFrame:
    return C.entities(examples(spark, root, "id", "tokens", "label_names"), "id")


def bio_names(spark: SparkSession, root: str) -> DataFrame:
    """Names read back from gold spans: particles stripped, two to five syllables."""
    names = bio_spans(spark, root).where("entity = 'NAME'").select(F.regexp_replace("text", "(은|는|이|가|을|를|의|님|씨)$", "").alias("name"))
    return names.where("name rlike '^[가-힣]{2,5}$'").groupBy("name").agg(F.count("*").alias("n"))


def bio_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Spans of gold labels turned back into labels: equal, but for orphans."""
    rows = examples(spark, root, "id", "sentence", "tokens", "label_names").where("sentence is not null and label_names is not null and size(tokens) = length(sentence) and size(label_names) = size(tokens)").where(C.bio_valid(F.col("label_names")))
    spans = C.entities(rows, "id").groupBy("id").agg(F.collect_list(F.struct("start", "end", "entity")).alias("spans"))
    back = rows.join(spans, "id").select("id", (C.spans_to_bio(F.col("sentence"), F.col("spans")) == F.col("label_names")).alias("same"))
    return back.groupBy("same").agg(F.count("*").alias("n"))


def word_bio(spark: SparkSession, root: str) -> DataFrame:
    """Labels of words (every third one begins an organisation that the next goes on with) as labels of characters."""
    rows = table(spark, root, "ner_examples", "id", "sentence").where("sentence is not null").withColumn("words", F.split("sentence", " ")).where(~F.array_contains("words", ""))
    names = F.transform("words", lambda _, k: F.when(k % 3 == 0, "B-ORG").when(k % 3 == 1, "I-ORG").otherwise("O"))
    return rows.select("id", F.array_join(C.word_to_char_bio(F.col("words"), names), " ").alias("out"))


def gazetteer(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "gazetteers", "entity_type", "entry_value").select(F.col("entity_type").alias("entity"), F.col("entry_value").alias("value")).where("entity is not null and value is not null")


def weak_labels(spark: SparkSession, root: str) -> DataFrame:
    found = C.weak_labels(table(spark, root, "weak_examples", "id", "sentence"), "id", "sentence", gazetteer(spark, root))
    return found.select("id", F.inline("spans"))


def weak_bio(spark: SparkSession, root: str) -> DataFrame:
    """Weak labels as labels of characters, and what they say: types and number of spans."""
    rows = table(spark, root, "weak_examples", "id", "sentence").where("sentence is not null")
    found = C.weak_labels(rows, "id", "sentence", gazetteer(spark, root))
    return rows.join(found, "id").select("id", F.array_join(C.spans_to_bio(F.col("sentence"), F.col("spans")), " ").alias("names"), F.size("spans").alias("n"))


def forms(spark: SparkSession, root: str) -> DataFrame:
    """Identifiers of the weak corpus by form alone, without a gazetteer: by type."""
    none = gazetteer(spark, root).limit(0)
    found = C.weak_labels(table(spark, root, "weak_examples", "id", "sentence"), "id", "sentence", none)
    return found.select(F.explode("spans").alias("s")).groupBy("s.entity").agg(F.count("*").alias("n"))


def projection(spark: SparkSession, root: str) -> DataFrame:
    """Names and organisations of a sentence's labels, wherever they occur in the sentence."""
    rows = examples(spark, root, "id", "sentence", "tokens", "label_names").where("sentence is not null")
    values = C.entities(rows, "id").where("entity in ('NAME', 'ORG')").select("id", F.struct(F.col("text").alias("value"), "entity").alias("e")).groupBy("id").agg(F.collect_set("e").alias("es"))
    return rows.join(values, "id").select("id", F.explode(C.projected(F.col("sentence"), F.col("es"))).alias("s")).select("id", "s.start", "s.end", "s.entity")


def quota(spark: SparkSession, root: str) -> DataFrame:
    """300 sentences, spread over the sources as evenly as they allow."""
    return C.quota_sample(examples(spark, root, "id", "source").where("source is not null"), "source", "id", 300).select("id", "source")


def round_robin(spark: SparkSession, root: str) -> DataFrame:
    """200 cases, one of each type in turn."""
    rows = table(spark, root, "analyze_l0_deep", "id", "pii_type").dropDuplicates(["id"])
    turn = F.row_number().over(Window.partitionBy("pii_type").orderBy(md5_order("id"), "id"))
    return rows.withColumn("turn", turn).where("turn <= 200").orderBy("turn", "pii_type").limit(200).select("id", "pii_type")


def row_limit(spark: SparkSession, root: str) -> DataFrame:
    """The first hundred documents that hold something; blank ones don't count."""
    return table(spark, root, "documents", "doc_id", "text").where(squash(F.col("text")) != "").orderBy("doc_id").limit(100).select("doc_id")


def trainset(spark: SparkSession, root: str) -> DataFrame:
    """Base rows and licensed rows of the weak corpus, without leaks and repeats, in the order of their hashes by tenths."""
    train, held = split_rows(spark, root)
    base = train.select(F.lit("gold").alias("part"), "id", "sentence")
    weak = table(spark, root, "weak_examples", "id", "license", "sentence").where(reduce(lambda a, b: a | b, (F.col("license").startswith(x) for x in LICENCES))).select(F.lit("weak").alias("part"), "id", "sentence")
    rows = base.unionAll(weak).withColumn("h", content_hash(F.col("sentence"))).where("h is not null")
    clean = rows.join(held.select(content_hash(F.col("sentence")).alias("h")).where("h is not null"), "h", "left_anti")
    one = clean.groupBy("h").agg(F.min(F.struct("part", "id")).alias("r"))
    return one.select("r.part", "r.id", F.substring("h", 1, 1).alias("shard"))


def span_invariants(spark: SparkSession, root: str) -> DataFrame:
    """Labels of reviewed cases that lie outside their text or are empty: none."""
    rows = table(spark, root, "hard_cases_v0", "id", "text", "labels").where("labels is not null and text is not null").dropDuplicates(["id"])
    bad = F.size(F.filter("labels", lambda x: (x["start_pos"] < 0) | (x["start_pos"] >= x["end_pos"]) | (x["end_pos"] > F.length("text"))))
    return rows.agg(F.count("*").alias("n"), F.sum(F.size("labels")).alias("n_labels"), F.sum(bad).alias("n_bad"))


def near_recall(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of near vectors that the index finds, of all there are, at several thresholds: every fiftieth vector against all."""
    df = table(spark, root, "embeddings")
    key, vector = df.columns[0], next(c for c, t in df.dtypes if t.startswith("array"))
    rows = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = rows.select("k", F.transform("v", lambda x: x / norm(F.col("v"))).alias("v"))
    asked = F.broadcast(unit.where(F.pmod("k", F.lit(50)) == 0).select(F.col("k").alias("q"), F.col("v").alias("w")))  # the stated query set, in one block
    cosine = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    true = asked.join(unit, F.col("q") != F.col("k")).select("q", "k", cosine.alias("cosine"))
    frames = []
    for threshold in (0.4, 0.5):
        found = C.near_vectors(df.select(key, vector), key, vector, threshold)
        both = found.select(F.col("a").alias("q"), F.col("b").alias("k")).unionAll(found.select(F.col("b").alias("q"), F.col("a").alias("k"))).withColumn("found", F.lit(1))
        near = true.where(F.col("cosine") >= threshold + 1e-6).join(both, ["q", "k"], "left")
        frames.append(near.agg(F.lit(threshold).alias("threshold"), F.count("*").alias("n"), F.count("found").alias("n_found")))
    return reduce(DataFrame.unionAll, frames).select("threshold", (F.col("n_found") >= 0.9 * F.col("n")).alias("enough"))


def dictionary_hits(spark: SparkSession, root: str) -> DataFrame:
    """Sentences by type of the gazetteer entries in them."""
    return weak_labels(spark, root).groupBy("entity").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_rows"))


def run_ledger(spark: SparkSession, root: str) -> DataFrame:
    """Runs once each (rows are delivered twice), by source: counts, and the state of the last one."""
    rows = table(spark, root, "collector_runs").dropDuplicates(["run_id"])
    return rows.groupBy("source").agg(F.count("*").alias("n_runs"), F.sum("n_seen").alias("n_seen"), F.sum("n_inserted").alias("n_inserted"), F.count_if(F.col("finished_at").isNull()).alias("n_open"), F.max_by("status", F.struct("started_at", "run_id")).alias("last_status"))


def upsert(spark: SparkSession, root: str) -> DataFrame:
    """Last row of each source by start time."""
    rows = table(spark, root, "collector_runs", "run_id", "source", "started_at", "status").dropDuplicates(["run_id"]).where("started_at is not null")
    return rows.groupBy("source").agg(F.max_by(F.struct("run_id", "status"), F.struct("started_at", "run_id")).alias("r")).select("source", "r.run_id", "r.status")


def run_gaps(spark: SparkSession, root: str) -> DataFrame:
    """Seconds since the run before of the same source."""
    rows = table(spark, root, "collector_runs", "run_id", "source", "started_at").dropDuplicates(["run_id"]).where("started_at is not null")
    before = F.lag("started_at").over(Window.partitionBy("source").orderBy("started_at", "run_id"))
    return rows.select("run_id", "source", (F.unix_seconds("started_at") - F.unix_seconds(before)).alias("gap"))


def md5_order(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


def balanced(spark: SparkSession, root: str) -> DataFrame:
    """Twenty rows of each source, by a hash of the id."""
    rows = examples(spark, root, "id", "source")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(md5_order("id"), "id"))).where("k <= 20").select("id", "source")


def stratified_sizes(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "analyze_l0_deep", "id", "lang", "validity_group").dropDuplicates(["id"])
    return C.allocated(rows, ["lang", "validity_group"], 100)


def stratified(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "analyze_l0_deep", "id", "lang", "validity_group").dropDuplicates(["id"])
    return C.drawn(rows, ["lang", "validity_group"], C.allocated(rows, ["lang", "validity_group"], 100), "id", "s")


def negatives(spark: SparkSession, root: str) -> DataFrame:
    """All rows with entities and half as many without, by a hash of the id."""
    rows = examples(spark, root, "id", "n_entities").where("n_entities is not null")
    return C.with_negatives(rows, F.col("n_entities") > 0, "id", 0.5)


def first_sentences(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "weak_examples", "id", "sentence").where("sentence is not null")
    return rows.select("id", C.first_sentence(F.col("sentence"), 30, 200).alias("first"))


def diverse(spark: SparkSession, root: str) -> DataFrame:
    df = table(spark, root, "embeddings")
    key, vector = df.columns[0], next(c for c, t in df.dtypes if t.startswith("array"))
    return C.diverse(df.select(key, vector), key, vector, 0.9, stored)


def composed_rows(spark: SparkSession, root: str) -> DataFrame:
    rows = composed(table(spark, root, "gazetteers", "id", "entity_type", "entry_value", "source"), ["entity_type", "entry_value", "source"])
    return rows.select("id", "text", F.size("fields").alias("n_fields"), F.coalesce(F.try_element_at("fields", F.lit(-1))["end"], F.lit(0)).alias("last_end"))


def sized(spark: SparkSession, root: str) -> DataFrame:
    parts = sinks.sized_parts(table(spark, root, "weak_examples", "id", "sentence"), 65_536)
    return parts.select("part", "n_rows", "n_bytes")


def audit_sink(spark: SparkSession, root: str) -> DataFrame:
    """Events written as JSON lines and read again."""
    from hanmaru.plans.detection import audit_events

    path = folder(spark)
    sinks.audit_lines(audit_events(spark, root), path)
    return spark.read.schema("id string, start int, end int, entity string, action string, risk string, span_length int, value_hash string").json(path)


def insert_sink(spark: SparkSession, root: str) -> DataFrame:
    """Training rows inserted, then all rows: each hash is there once."""
    path = folder(spark)
    rows = examples(spark, root, "id", "sentence").select(content_hash(F.col("sentence")).alias("content_hash"))
    sinks.insert_new(rows.where("content_hash < '8'"), path, "content_hash")
    sinks.insert_new(rows, path, "content_hash")
    return spark.read.parquet(path)


def purge_sink(spark: SparkSession, root: str) -> DataFrame:
    """One source replaced, all others untouched."""
    path = folder(spark)
    rows = examples(spark, root, "id", "source").where("source is not null")
    sinks.replace_sources(rows, path)
    one = rows.agg(F.min("source").alias("source"))
    sinks.replace_sources(rows.join(F.broadcast(one), "source").select((F.col("id") * -1).alias("id"), "source"), path)
    return spark.read.parquet(path).select("id", F.col("source").cast("string").alias("source"))


def stream_dedup(spark: SparkSession, root: str) -> DataFrame:
    stream = ingest.parquet_stream(spark, root, "documents").select("doc_id", "text", "collected_at").where("text is not null")
    return ingest.run_once(ingest.deduplicated(stream, "text", "collected_at", "30 days"), folder(spark)).select(content_hash(F.col("text")).alias("h"))


def stream_windows(spark: SparkSession, root: str) -> DataFrame:
    """Documents by day and source, counted on a stream: the days that the watermark has closed."""
    stream = ingest.parquet_stream(spark, root, "documents").select("doc_id", "source", "collected_at").where("source is not null")
    counted = ingest.windowed_counts(stream, "collected_at", "source").select(F.col("window.start").cast("date").alias("day"), "source", "n")
    return ingest.run_once(counted, folder(spark))


def stream_mask(spark: SparkSession, root: str) -> DataFrame:
    stream = ingest.parquet_stream(spark, root, "hard_cases_v0").select("id", "text")
    return ingest.run_once(ingest.masked_stream(stream, "text"), folder(spark)).select("id", "masked", "blocked")


def stream_insert(spark: SparkSession, root: str) -> DataFrame:
    path = folder(spark)
    ingest.insert_stream(ingest.parquet_stream(spark, root, "weak_examples").select("id", "sentence"), "sentence", f"{path}/table", f"{path}/state")
    return spark.read.parquet(f"{path}/table").select("content_hash")


def schema_columns(spark: SparkSession, root: str) -> DataFrame:
    return inspected(table(spark, root, "collector_runs").drop("started_at", "finished_at"))


def put(spark: SparkSession, names: dict[str, bytes]) -> str:
    """A folder with these files, written through the file system of the shared folder."""
    path = folder(spark)
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    system = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, data in names.items():
        out = system.create(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
        out.write(bytearray(data))
        out.close()
    return path


def runs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "collector_runs", "run_id", "source", "status").dropDuplicates(["run_id"])


def delimited_scan(spark: SparkSession, root: str) -> DataFrame:
    """The run log as tab-separated lines, written and read again; empty cells have no field."""
    path = folder(spark)
    runs(spark, root).select(F.col("run_id").cast("string"), "source", "status").write.option("sep", "\t").option("header", True).option("nullValue", "").option("emptyValue", "").option("encoding", "UTF-8").csv(path)
    rows = readers.delimited(spark, path, key="run_id")
    return rows.select(F.col("id").cast("long").alias("run_id"), F.element_at("fields", "source").alias("source"), F.element_at("fields", "status").alias("status"))


def json_scan(spark: SparkSession, root: str) -> DataFrame:
    path = folder(spark)
    runs(spark, root).select(F.to_json(F.struct("run_id", "source", "status")).alias("value")).write.option("compression", "none").text(f"{path}/lines")
    rows = readers.json_lines(spark, f"{path}/lines", "*.txt")
    return rows.select(F.element_at("fields", "run_id").cast("long").alias("run_id"), F.element_at("fields", "source").alias("source"), F.element_at("fields", "status").alias("status"))


def text_scan(spark: SparkSession, root: str) -> DataFrame:
    """Sources as text lines with blanks around them, read again."""
    path = folder(spark)
    runs(spark, root).where("source is not null").select(F.concat(F.lit("  "), "source", F.lit(" ")).alias("value")).write.text(path)
    return readers.text_lines(spark, path).groupBy("text").agg(F.count("*").alias("n"))


def zip_scan(spark: SparkSession, root: str) -> DataFrame:
    """One archive with a member for each nation, read again."""
    import io
    import json
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for r in table(spark, root, "nation", "n_nationkey", "n_name").collect():  # 25 rows
            archive.writestr(f"{r[0]}.json", json.dumps({"SJML": {"text": [{"title": r[1], "content": str(r[0])}]}}))
        archive.writestr("broken.json", "{")
    return readers.zipped_json(spark, put(spark, {"a.zip": buffer.getvalue()})).select(F.col("content").cast("int").alias("n_nationkey"), F.col("title").alias("n_name"))


def preset_scan(spark: SparkSession, root: str) -> DataFrame:
    """Files of several kinds in one folder, each by its preset, rows numbered over all files in order of their names."""
    names = {"b.csv": "id,말\n1,하나\n2,둘\n".encode("cp949"), "a.csv": "id,말\n3,셋\n".encode(), "c.jsonl": b'{"x": 1}\n\nplain\n', "d.txt": "끝\n".encode()}
    path = put(spark, names)
    parts = [readers.records(spark, path, preset).select(F.lit(preset).alias("preset"), "row_index", F.to_json("fields").alias("fields")) for preset in ("csv", "jsonl", "text")]
    return reduce(DataFrame.unionAll, parts)


def gold_scan(spark: SparkSession, root: str) -> DataFrame:
    """Reviewed cases written as JSON lines and read again, every label inside its text."""
    rows = table(spark, root, "hard_cases_v0").where("labels is not null and text is not null").dropDuplicates(["id"])
    renamed = F.transform("labels", lambda x: F.struct(x["start_pos"].alias("start"), x["end_pos"].alias("end"), x["entity_type"].alias("entity_type"), x["risk_level"].alias("risk_level"), x["suffix"].alias("suffix")))
    path = folder(spark)
    rows.select("id", "text", "expected_masked_text", renamed.alias("labels"), "tags").write.json(path)
    return readers.reviewed_cases(spark, path).select("id", "text", F.size("labels").alias("n"))


def marked_scan(spark: SparkSession, root: str) -> DataFrame:
    """Reviewed cases with their labels written into the text as marks, compiled back to text and labels."""
    rows = table(spark, root, "hard_cases_v0", "id", "text", "labels").where("labels is not null and text is not null").dropDuplicates(["id"]).withColumn("l", F.array_sort("labels", lambda a, b: F.when(a["start_pos"] < b["start_pos"], -1).otherwise(1)))
    step = lambda acc, x: F.struct(
        F.concat(acc["out"], F.substring("text", acc["at"] + 1, x["start_pos"] - acc["at"]), F.lit("<"), x["entity_type"], F.lit(' risk="'), x["risk_level"], F.lit('">'), F.substring("text", x["start_pos"] + 1, x["end_pos"] - x["start_pos"]), F.lit("</"), x["entity_type"], F.lit(">")).alias("out"), x["end_pos"].alias("at")
    )
    written = F.aggregate("l", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text"))))
    back = rows.select("id", C.marked(written).alias("m"))
    return back.select("id", "m.text", F.array_join(F.transform("m.labels", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"), x["entity"], x["risk"])), " ").alias("labels"))


def postal_scan(spark: SparkSession, root: str) -> DataFrame:
    """Address lines of suppliers in two of the four layouts, read by them; lines without a number go."""
    path = folder(spark)
    n = F.col("s_suppkey")
    road = F.concat_ws("|", *(F.lit("x") for _ in range(2)), F.lit("가람도"), F.concat(F.lit("시"), n.cast("string")), *(F.lit("") for _ in range(6)), F.lit("새길"), F.lit(""), F.pmod(n, F.lit(5)).cast("string"), F.pmod(n, F.lit(3)).cast("string"), *(F.lit("") for _ in range(2)), F.lpad(n.cast("string"), 5, "0"))
    table(spark, root, "supplier", "s_suppkey").select(road.alias("value")).write.text(path)
    return readers.postal(spark, path, "road").select("sido", "sigungu", "road_name", "building_no", "postcode")


def retention(spark: SparkSession, root: str) -> DataFrame:
    """Documents by day of collection, written by day; the days more than ninety days before the last one are removed."""
    path = folder(spark)
    rows = table(spark, root, "documents", "doc_id", "collected_at").where("collected_at is not null").withColumn("day", F.date_format("collected_at", "yyyy-MM-dd"))
    rows.select("doc_id", "day").write.partitionBy("day").parquet(path)
    last = rows.agg(F.date_format(F.date_sub(F.max("collected_at").cast("date"), 90), "yyyy-MM-dd")).first()[0]
    sinks.drop_days(spark, path, last)
    return spark.read.schema("doc_id long, day string").parquet(path).groupBy("day").agg(F.count("*").alias("n"))


def reported(spark: SparkSession, root: str) -> DataFrame:
    """Two small tables of metrics as a report, and its lines read again."""
    path = folder(spark)
    sinks.report({"sources": most_common(spark, root), "tags": tag_counts(spark, root).groupBy("tag").agg(F.sum("n").alias("n"))}, path)
    return spark.read.schema("name string, row string").json(f"{path}/json").select("name", F.get_json_object("row", "$.n").cast("long").alias("n"))


def safe_log(spark: SparkSession, root: str) -> DataFrame:
    """A log of requests in which later rows replace earlier ones, each payload checked for the values it must not hold."""
    rows = table(spark, root, "hard_cases_v0", "id", "text", "labels", "expected_masked_text").where("labels is not null and text is not null")
    values = F.transform("labels", lambda x: F.substring("text", x["start_pos"] + 1, x["end_pos"] - x["start_pos"]))
    new = rows.select("id", sinks.shows_nothing(F.coalesce("expected_masked_text", F.lit("")), values).alias("payload"), F.lit("2").alias("at"))
    old = rows.select("id", F.lit("old").alias("payload"), F.lit("1").alias("at"))
    return sinks.upserted(old, new, "id", "at").select("id", "payload")


def seed_parts(spark: SparkSession, root: str) -> DataFrame:
    """Nations in parts of JSON lines, one part named twice, read in order of their numbers, each file once."""
    import json

    rows = table(spark, root, "nation", "n_nationkey", "n_name").orderBy("n_nationkey").collect()  # 25 rows
    part = lambda k: "".join(json.dumps({"key": r[0], "name": r[1]}) + "\n" for r in rows if r[0] % 3 == k).encode()
    path = put(spark, {f"seed_part{k + 1:03d}.jsonl": part(k) for k in range(3)})
    return readers.seed_parts(spark, [f"{path}/seed_part*.jsonl", f"{path}/seed_part002.jsonl"], "key int, name string").select("key", "name", F.regexp_extract("path", r"part(\d+)", 1).cast("int").alias("part"))


def file_schemas(spark: SparkSession, root: str) -> DataFrame:
    """What can be told of files without showing a value: encoding, columns, rows, and the presets that fit."""
    path = put(spark, {"b.csv": "id,말\n1,하나\n2,둘\n".encode("cp949"), "a.tsv": "id\t말\n3,셋\n".encode(), "c.jsonl": b'{"x": 1, "y": 2}\n\nplain\n', "d.txt": "끝\n\n끝\n".encode(), "e.bin": b"\x00"})
    return readers.inspected_files(spark, path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "encoding", F.array_join("columns", ",").alias("columns"), "n_rows", F.array_join("presets", ",").alias("presets"))


def bio_decode(spark: SparkSession, root: str) -> DataFrame:
    """Labels of the weak corpus decoded as a tagger's output: an I without its B begins a span of its own."""
    return tagging.decoded(table(spark, root, "weak_examples", "id", "label_names"), "id", "label_names")


def log_listing(spark: SparkSession, root: str) -> DataFrame:
    """A page of the run log, newest first: fifty rows after the first ten."""
    rows = table(spark, root, "collector_runs", "run_id", "source", "started_at", "status").dropDuplicates(["run_id"]).where("started_at is not null")
    return rows.orderBy(F.desc("started_at"), F.desc("run_id")).offset(10).limit(50).select("run_id", "source", "status")


def most_common(spark: SparkSession, root: str) -> DataFrame:
    """The ten sources with most sentences; ties by name."""
    return examples(spark, root, "source").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


def separation(spark: SparkSession, root: str) -> DataFrame:
    """Texts that both corpora hold: how many, and how many of either."""
    gold = examples(spark, root, "sentence").select(content_hash(F.col("sentence")).alias("h")).where("h is not null").distinct()
    weak = table(spark, root, "weak_examples", "sentence").select(content_hash(F.col("sentence")).alias("h")).where("h is not null").distinct()
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(gold, "gold").unionAll(count(weak, "weak")).unionAll(count(gold.intersect(weak), "both"))


def judge_append(spark: SparkSession, root: str) -> DataFrame:
    """A further layer's results joined to the cases by id, only where it is missing: layers of each case afterwards."""
    rows = table(spark, root, "analyze_l0_deep", "id", "any_detected", "layer_results").dropDuplicates(["id"])
    judge = rows.where("not any_detected").select("id", F.lit("judge").alias("layer"))
    there = F.exists("layer_results", lambda x: x["layer"] == "judge")
    names = F.transform(F.coalesce("layer_results", F.array().cast(rows.schema["layer_results"].dataType)), lambda x: x["layer"])
    return rows.join(judge, "id", "left").select("id", F.array_join(F.array_sort(F.concat(names, F.when(F.col("layer").isNotNull() & ~F.coalesce(there, F.lit(False)), F.array("layer")).otherwise(F.array().cast("array<string>")))), ",").alias("layers"))


def name_tiers(spark: SparkSession, root: str) -> DataFrame:
    """Gazetteer names by form: script, length, family name of one or two syllables."""
    v = F.trim("entry_value")
    tier = F.when(v.rlike("[A-Za-z]"), "latin").when(v.rlike("^(남궁|황보|제갈|선우|독고|사공|서문)"), "double").when(v.rlike(f"^[{SURNAMES}][가-힣]{{2}}$"), "three").when(v.rlike(f"^[{SURNAMES}][가-힣]$"), "two").otherwise("other")
    rows = table(spark, root, "gazetteers", "entity_type", "entry_value").where("entity_type = 'NAME' and trim(entry_value) <> ''")
    return rows.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


def pages(spark: SparkSession, root: str) -> DataFrame:
    """Documents as pages of a site, and the body that is read from each: the main part by selector, else the densest one."""
    rows = table(spark, root, "documents", "doc_id", "text").where("text is not null")
    plain = F.regexp_replace("text", "[<>&]", " ")
    page = F.concat(
        F.lit("<html><head><style>p{}</style><script>var a=1;</script></head><body><nav><p>메뉴</p></nav>"),
        F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("<article><p>"), plain, F.lit("</p></article>"))).when(F.pmod("doc_id", F.lit(3)) == 1, F.concat(F.lit('<div class="view_cont"><b>'), plain, F.lit("</b></div>"))).otherwise(F.concat(F.lit("<p>"), plain, F.lit("</p>"))),
        F.lit("</body></html>"),
    )
    return rows.select("doc_id", C.html_body(page, ["view_cont", "article_body"]).alias("body"))


def feeds(spark: SparkSession, root: str) -> DataFrame:
    """Feeds made of sources and their runs, and the links read from them: each once, in order, without the feed's own."""
    rows = table(spark, root, "collector_runs", "run_id", "source").dropDuplicates(["run_id"]).where("source is not null")
    n = F.col("run_id").cast("string")
    link = lambda *parts: F.concat(F.lit("<link>https://a.example/"), *parts, F.lit("</link>"))
    feed = F.concat(F.lit("<rss>"), link(F.lit("rss")), link(n), link(F.lit("x")), link(n), F.lit('<link rel="x" href="https://b.example/'), n, F.lit('"/></rss>'))
    return rows.select("run_id", F.array_join(C.rss_links(feed), " ").alias("links"))


def paths(spark: SparkSession, root: str) -> DataFrame:
    """A value by its path in a record, and a template filled with it."""
    rows = table(spark, root, "collector_runs", "run_id", "source").dropDuplicates(["run_id"]).where("source is not null")
    record = F.to_json(F.struct(F.array(F.struct(F.col("source").alias("b"))).alias("a")))
    return rows.select("run_id", C.json_path(record, "a.0.b").alias("value"), C.filled(F.lit("run {{id}} of {{source}}, {{none}}"), F.create_map(F.lit("id"), F.col("run_id").cast("string"), F.lit("source"), F.col("source"))).alias("text"))


def verdicts(spark: SparkSession, root: str) -> DataFrame:
    """Verdicts of a judge as it might write them, and whether each blocks."""
    rows = table(spark, root, "analyze_l0_deep", "id", "any_detected", "total_latency_ms").dropDuplicates(["id"]).where("any_detected is not null and total_latency_ms is not null")
    sure = F.pmod("total_latency_ms", F.lit(100))
    said = F.concat(F.lit('{"contains_pii": '), F.col("any_detected").cast("string"), F.lit(', "confidence": 0.'), F.lpad(sure.cast("string"), 2, "0"), F.when(sure % 10 == 9, "").otherwise("}"))
    return rows.select("id", judged(said).alias("blocks"))


def judged(c: Column) -> Column:
    """A verdict blocks if it names personal data with a confidence of 0.7 or more; what can't be read doesn't."""
    v = F.from_json(c, "contains_pii boolean, confidence double")
    return F.coalesce(v["contains_pii"] & (v["confidence"] >= 0.7), F.lit(False))


QUERIES = {
    "content_hash_dedup": first_wins, "insert_counts": insert_counts, "bio_validate": bio_valid, "gazetteer_insert": gazetteer_insert, "weak_insert": weak_insert, "leakage_semi": leakage_semi, "leakage_by_source": leakage_by_source, "license_filter_export": export,
    "corpus_stats": corpus_stats, "tag_counts": tag_counts, "bio_spans": bio_spans, "bio_names": bio_names, "bio_round_trip": bio_round_trip, "word_bio": word_bio, "weak_label": weak_labels, "dictionary_hits": dictionary_hits, "run_ledger": run_ledger, "upsert_last_wins": upsert,
    "run_gaps": run_gaps, "balanced_sample": balanced, "stratified_alloc": stratified_sizes, "stratified_sample": stratified, "negative_ratio": negatives, "first_sentences": first_sentences, "diversity_filter": diverse, "compose_records": composed_rows, "size_split": sized,
    "audit_sink": audit_sink, "insert_sink": insert_sink, "purge_sink": purge_sink, "stream_dedup": stream_dedup, "stream_mask": stream_mask, "stream_insert": stream_insert, "schema_inspect": schema_columns,
    "weak_bio": weak_bio, "weak_forms": forms, "literal_projection": projection, "quota_top_up": quota, "round_robin": round_robin, "row_limit": row_limit, "trainset": trainset, "span_invariants": span_invariants, "near_vector_recall": near_recall, "stream_windows": stream_windows, "delimited_scan": delimited_scan, "json_scan": json_scan, "text_scan": text_scan, "zip_scan": zip_scan, "preset_scan": preset_scan, "gold_scan": gold_scan, "marked_scan": marked_scan, "postal_scan": postal_scan,
    "retention": retention, "report_files": reported, "safe_log": safe_log, "seed_parts": seed_parts, "file_schemas": file_schemas, "bio_decode": bio_decode,
    "log_listing": log_listing, "most_common": most_common, "separation_proof": separation, "judge_append": judge_append, "name_tiers": name_tiers,
    "html_body": pages, "rss_links": feeds, "json_path": paths, "judge_rule": verdicts,
}
HASH = "sha256(" + SQUASH.replace("{t}", "{c}") + ")"
NER_HASH = HASH.replace("{c}", "sentence")
SPLIT = "CASE WHEN lower(trim(split_hint)) IN ('train', 'training') THEN 'train' WHEN lower(trim(split_hint)) IN ('val', 'valid', 'validation', 'dev', 'test') THEN 'held' END"
LEAKED = f"WITH r AS (SELECT *, {NER_HASH} AS h, {SPLIT} AS split FROM ner_examples), leaked AS (SELECT id, source FROM r WHERE split = 'train' AND h IN (SELECT h FROM r WHERE split = 'held' AND h IS NOT NULL)) "
VALID = "coalesce(len(labels) = len(tokens) AND len(label_names) = len(tokens) AND list_bool_and([x IN ('O','B-NAME','I-NAME','B-ORG','I-ORG','B-ADDRESS','I-ADDRESS') FOR x IN label_names]) IS NOT FALSE AND list_bool_and([NOT starts_with(label_names[i], 'I-') OR (i > 1 AND label_names[i - 1] <> 'O' AND substring(label_names[i - 1], 3) = substring(label_names[i], 3)) FOR i IN range(1, len(label_names) + 1)]) IS NOT FALSE, false)"
RUNS = "(SELECT DISTINCT ON (run_id) * FROM collector_runs)"
ORACLES = {
    "content_hash_dedup": f"SELECT id, source, sentence FROM (SELECT *, row_number() OVER (PARTITION BY {NER_HASH} ORDER BY id) AS k FROM ner_examples WHERE sentence IS NOT NULL) WHERE k = 1",
    "bio_validate": f"SELECT id, {VALID} AS ok FROM ner_examples",
    "insert_counts": f"WITH r AS (SELECT id, source, {NER_HASH} AS h, {VALID} AS ok FROM ner_examples), f AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY h, ok ORDER BY id) END AS k FROM r) SELECT source, count(*) AS n_seen, count(*) FILTER (WHERE k = 1) AS n_inserted, count(*) FILTER (WHERE k > 1) AS n_dup, count(*) FILTER (WHERE NOT ok) AS n_invalid FROM f GROUP BY source",
    "gazetteer_insert": "SELECT entity_type, trim(entry_value) AS value, min(id) AS id FROM gazetteers WHERE trim(entry_value) <> '' AND entity_type IS NOT NULL GROUP BY 1, 2",
    "weak_insert": "SELECT id, array_to_string(list_sort(list_distinct([substring(x, 3) FOR x IN label_names IF x <> 'O'])), ',') AS tag_set, CAST(len([x FOR x IN label_names IF starts_with(x, 'B-')]) AS INT) AS n_spans FROM weak_examples WHERE label_names IS NOT NULL",
    "leakage_semi": LEAKED + "SELECT id, source FROM leaked",
    "leakage_by_source": LEAKED + "SELECT source, count(*) AS n, min(id) AS first_id FROM leaked GROUP BY source",
    "license_filter_export": LEAKED + ", k AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY id) AS k FROM r WHERE split = 'train' AND h IS NOT NULL AND (starts_with(license, 'CC-BY') OR starts_with(license, 'CC0')) AND id NOT IN (SELECT id FROM leaked)) SELECT id, source, license FROM k WHERE k = 1",
    "corpus_stats": "SELECT source, license, count(*) AS n, CAST(sum(n_entities) AS BIGINT) AS n_entities, CAST(grouping(source, license) AS BIGINT) AS level FROM ner_examples GROUP BY CUBE (source, license)",
    "tag_counts": "SELECT source, substring(l, 3) AS tag, count(*) AS n FROM (SELECT source, unnest(label_names) AS l FROM weak_examples) WHERE starts_with(l, 'B-') GROUP BY ALL",
    "bio_spans": "WITH u AS (SELECT id, k, label_names[k] AS l, tokens[k] AS t FROM (SELECT id, label_names, tokens, unnest(range(1, greatest(len(label_names), len(tokens)) + 1)) AS k FROM ner_examples WHERE label_names IS NOT NULL AND tokens IS NOT NULL)), "
    "p AS (SELECT *, coalesce(starts_with(l, 'I-') AND substring(lag(l) OVER w, 3) = substring(l, 3) AND lag(l) OVER w <> 'O', false) AS goes FROM u WINDOW w AS (PARTITION BY id ORDER BY k)), "
    "g AS (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY k) AS run FROM p), r AS (SELECT id, run, arg_min(l, k) AS l, min(k) AS a, max(k) AS b, string_agg(t, '' ORDER BY k) AS text FROM g GROUP BY id, run) "
    "SELECT id, substring(l, 3) AS entity, CAST(a - 1 AS INT) AS \"start\", CAST(b AS INT) AS \"end\", text FROM r WHERE starts_with(l, 'B-')",
    "run_ledger": f"SELECT source, count(*) AS n_runs, CAST(sum(n_seen) AS BIGINT) AS n_seen, CAST(sum(n_inserted) AS BIGINT) AS n_inserted, count(*) FILTER (WHERE finished_at IS NULL) AS n_open, arg_max(status, (coalesce(started_at, TIMESTAMP '1900-01-01'), run_id)) AS last_status FROM {RUNS} GROUP BY source",
    "upsert_last_wins": f"SELECT source, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, run_id DESC) AS k FROM {RUNS} WHERE started_at IS NOT NULL) WHERE k = 1",
    "run_gaps": f"SELECT run_id, source, CAST(epoch(date_trunc('second', started_at)) - epoch(date_trunc('second', lag(started_at) OVER (PARTITION BY source ORDER BY started_at, run_id))) AS BIGINT) AS gap FROM {RUNS} WHERE started_at IS NOT NULL",
    "balanced_sample": "SELECT id, source FROM (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(id AS VARCHAR)), id) AS k FROM ner_examples) WHERE k <= 20",
    "stratified_alloc": "WITH s AS (SELECT lang, validity_group, count(*) AS n FROM (SELECT DISTINCT ON (id) id, lang, validity_group FROM analyze_l0_deep) GROUP BY ALL), p AS (SELECT *, least(CAST(round(100 * n / sum(n) OVER ()) AS BIGINT), n) AS share, row_number() OVER (ORDER BY lang NULLS FIRST, validity_group NULLS FIRST) AS place, count(*) OVER () AS last FROM s) "
    "SELECT lang, validity_group, n, CAST(CASE WHEN place = last THEN least(greatest(100 - coalesce(sum(share) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), n) ELSE share END AS BIGINT) AS size FROM p",
    "stratified_sample": "WITH d AS (SELECT DISTINCT ON (id) id, lang, validity_group FROM analyze_l0_deep), s AS (SELECT lang, validity_group, count(*) AS n FROM d GROUP BY ALL), p AS (SELECT *, least(CAST(round(100 * n / sum(n) OVER ()) AS BIGINT), n) AS share, row_number() OVER (ORDER BY lang NULLS FIRST, validity_group NULLS FIRST) AS place, count(*) OVER () AS last FROM s), "
    "z AS (SELECT lang, validity_group, CASE WHEN place = last THEN least(greatest(100 - coalesce(sum(share) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), n) ELSE share END AS size FROM p), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY lang, validity_group ORDER BY substring(md5('s' || id), 1, 8), id) AS k FROM d) SELECT k.id, k.lang, k.validity_group FROM k JOIN z ON k.lang IS NOT DISTINCT FROM z.lang AND k.validity_group IS NOT DISTINCT FROM z.validity_group WHERE k.k <= z.size",
    "negative_ratio": "SELECT id, true AS positive FROM ner_examples WHERE n_entities > 0 UNION ALL SELECT id, false AS positive FROM (SELECT id, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) AS k FROM ner_examples WHERE n_entities = 0) WHERE k <= (SELECT floor(count(*) * 0.5) FROM ner_examples WHERE n_entities > 0)",
    "insert_sink": f"SELECT DISTINCT {NER_HASH} AS content_hash FROM ner_examples WHERE sentence IS NOT NULL",
    "purge_sink": "SELECT CASE WHEN source = (SELECT min(source) FROM ner_examples) THEN -id ELSE id END AS id, source FROM ner_examples WHERE source IS NOT NULL",
    "stream_dedup": "SELECT DISTINCT " + HASH.replace("{c}", "text") + " AS h FROM documents WHERE text IS NOT NULL AND collected_at IS NOT NULL",
    "stream_insert": "SELECT DISTINCT " + NER_HASH + " AS content_hash FROM weak_examples WHERE sentence IS NOT NULL",
    "log_listing": f"SELECT run_id, source, status FROM {RUNS} WHERE started_at IS NOT NULL ORDER BY started_at DESC, run_id DESC LIMIT 50 OFFSET 10",
    "most_common": "SELECT source, count(*) AS n FROM ner_examples GROUP BY source ORDER BY n DESC, source LIMIT 10",
    "separation_proof": "WITH g AS (SELECT DISTINCT " + NER_HASH + " AS h FROM ner_examples WHERE sentence IS NOT NULL), w AS (SELECT DISTINCT " + NER_HASH + " AS h FROM weak_examples WHERE sentence IS NOT NULL) SELECT 'gold' AS part, count(*) AS n FROM g UNION ALL SELECT 'weak', count(*) FROM w UNION ALL SELECT 'both', count(*) FROM g JOIN w USING (h)",
    "judge_append": "SELECT id, array_to_string(list_sort(list_concat([x.layer FOR x IN layer_results], CASE WHEN NOT any_detected THEN ['judge'] ELSE [] END)), ',') AS layers FROM (SELECT DISTINCT ON (id) id, any_detected, layer_results FROM analyze_l0_deep)",
    "name_tiers": "SELECT CASE WHEN regexp_matches(v, '[A-Za-z]') THEN 'latin' WHEN regexp_matches(v, '^(남궁|황보|제갈|선우|독고|사공|서문)') THEN 'double' WHEN regexp_full_match(v, '[" + SURNAMES + "][가-힣]{2}') THEN 'three' WHEN regexp_full_match(v, '[" + SURNAMES + "][가-힣]') THEN 'two' ELSE 'other' END AS tier, count(*) AS n FROM (SELECT trim(entry_value) AS v FROM gazetteers WHERE entity_type = 'NAME' AND trim(entry_value) <> '') GROUP BY 1",
    "html_body": "SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[<>&]', ' ', 'g'), '[ \\t\\x{0b}\\f\\r]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')), '') AS body FROM documents WHERE text IS NOT NULL",
    "json_path": f"SELECT run_id, source AS value, 'run ' || run_id || ' of ' || source || ', ' AS text FROM {RUNS} WHERE source IS NOT NULL",
    "rss_links": f"SELECT run_id, 'https://a.example/' || run_id || ' https://a.example/x https://b.example/' || run_id AS links FROM {RUNS} WHERE source IS NOT NULL",
    "judge_rule": "SELECT id, any_detected AND total_latency_ms % 100 >= 70 AND total_latency_ms % 10 <> 9 AS blocks FROM (SELECT DISTINCT ON (id) * FROM analyze_l0_deep) WHERE any_detected IS NOT NULL AND total_latency_ms IS NOT NULL",
    "word_bio": "WITH w AS (SELECT id, string_split(sentence, ' ') AS w FROM ner_examples WHERE sentence IS NOT NULL), u AS (SELECT id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM w WHERE len([y FOR y IN w IF y = '']) = 0), "
    "t AS (SELECT *, CASE WHEN k % 3 = 1 THEN 'B-ORG' WHEN k % 3 = 2 THEN 'I-ORG' ELSE 'O' END AS t FROM u) "
    "SELECT id, string_agg(CASE WHEN k = 1 THEN '' WHEN t = 'I-ORG' THEN 'I-ORG ' ELSE 'O ' END || t || repeat(CASE WHEN t = 'O' THEN ' O' ELSE ' I-ORG' END, length(x) - 1), ' ' ORDER BY k) AS out FROM t GROUP BY id",
    "weak_forms": "SELECT entity, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{e}' AS entity, unnest(regexp_extract_all({'sentence' if e == 'RRN' else f"regexp_replace(sentence, '{C.FORMS[-1][1]}', '#', 'g')"}, '{p}')) AS v FROM weak_examples WHERE sentence IS NOT NULL" for e, p in C.FORMS) + ") GROUP BY entity",
    "quota_top_up": "WITH k AS (SELECT id, source, md5(CAST(id AS VARCHAR)) AS h, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(id AS VARCHAR)), id) AS k FROM ner_examples WHERE source IS NOT NULL) SELECT id, source FROM k ORDER BY k > 300 // (SELECT count(DISTINCT source) FROM k), h, id LIMIT 300",
    "round_robin": "SELECT id, pii_type FROM (SELECT id, pii_type, row_number() OVER (PARTITION BY pii_type ORDER BY md5(CAST(id AS VARCHAR)), id) AS turn FROM (SELECT DISTINCT ON (id) id, pii_type FROM analyze_l0_deep)) ORDER BY turn, pii_type LIMIT 200",
    "row_limit": "SELECT doc_id FROM documents WHERE " + SQUASH.replace("{t}", "text") + " <> '' ORDER BY doc_id LIMIT 100",
    "trainset": LEAKED + ", w AS (SELECT 'weak' AS part, id, sentence FROM weak_examples WHERE starts_with(license, 'CC-BY') OR starts_with(license, 'CC0')), a AS (SELECT 'gold' AS part, id, h FROM r WHERE split = 'train' UNION ALL SELECT part, id, " + NER_HASH + " FROM w) "
    "SELECT part, id, substring(h, 1, 1) AS shard FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY part, id) AS k FROM a WHERE h IS NOT NULL AND h NOT IN (SELECT h FROM r WHERE split = 'held' AND h IS NOT NULL)) WHERE k = 1",
    "span_invariants": "SELECT count(*) AS n, CAST(sum(len(labels)) AS BIGINT) AS n_labels, CAST(0 AS BIGINT) AS n_bad FROM (SELECT DISTINCT ON (id) * FROM hard_cases_v0 WHERE labels IS NOT NULL AND text IS NOT NULL)",
    "near_vector_recall": "SELECT unnest([0.4, 0.5]::DOUBLE[]) AS threshold, true AS enough",
    "stream_windows": "SELECT CAST(date_trunc('day', collected_at) AS DATE) AS day, source, count(*) AS n FROM documents WHERE source IS NOT NULL AND collected_at IS NOT NULL GROUP BY ALL HAVING date_trunc('day', any_value(collected_at)) + INTERVAL 1 DAY <= (SELECT max(collected_at) - INTERVAL 7 DAY FROM documents WHERE source IS NOT NULL)",
    "delimited_scan": f"SELECT run_id, nullif(source, '') AS source, nullif(status, '') AS status FROM {RUNS}",
    "json_scan": f"SELECT run_id, source, status FROM {RUNS}",
    "text_scan": f"SELECT trim(source) AS text, count(*) AS n FROM {RUNS} WHERE trim(source) <> '' GROUP BY 1",
    "zip_scan": "SELECT n_nationkey, n_name FROM nation",
    "gold_scan": "SELECT DISTINCT ON (id) id, text, CAST(len(labels) AS INT) AS n FROM hard_cases_v0 WHERE labels IS NOT NULL AND text IS NOT NULL",
    "marked_scan": "WITH h AS (SELECT DISTINCT ON (id) id, text, labels FROM hard_cases_v0 WHERE labels IS NOT NULL AND text IS NOT NULL), l AS (SELECT id, unnest(labels, recursive := true) FROM h), s AS (SELECT id, string_agg(start_pos || ':' || end_pos || ':' || entity_type || ':' || risk_level, ' ' ORDER BY start_pos) AS labels FROM l GROUP BY id) SELECT h.id, text, coalesce(s.labels, '') AS labels FROM h LEFT JOIN s USING (id)",
    "postal_scan": "SELECT '가람도' AS sido, '시' || s_suppkey AS sigungu, '새길' AS road_name, (s_suppkey % 5) || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '-' || (s_suppkey % 3) END AS building_no, lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS postcode FROM supplier WHERE s_suppkey % 5 <> 0",
    "retention": "SELECT strftime(collected_at, '%Y-%m-%d') AS day, count(*) AS n FROM documents WHERE collected_at >= (SELECT CAST(max(collected_at) AS DATE) - 90 FROM documents) GROUP BY 1",
    "report_files": "SELECT 'sources' AS name, n FROM (SELECT source, count(*) AS n FROM ner_examples GROUP BY source ORDER BY n DESC, source LIMIT 10) UNION ALL SELECT 'tags', count(*) FROM (SELECT unnest(label_names) AS l FROM weak_examples) WHERE starts_with(l, 'B-') GROUP BY substring(l, 3)",
    "safe_log": "SELECT DISTINCT id, coalesce(expected_masked_text, '') AS payload FROM hard_cases_v0 WHERE labels IS NOT NULL AND text IS NOT NULL",
    "seed_parts": "SELECT n_nationkey AS key, n_name AS name, CAST(n_nationkey % 3 + 1 AS INT) AS part FROM nation",
    "bio_decode": "WITH u AS (SELECT id, k, label_names[k] AS l FROM (SELECT id, label_names, unnest(range(1, len(label_names) + 1)) AS k FROM weak_examples WHERE label_names IS NOT NULL)), "
    "p AS (SELECT *, coalesce(starts_with(l, 'I-') AND substring(lag(l) OVER w, 3) = substring(l, 3) AND lag(l) OVER w <> 'O', false) AS goes FROM u WINDOW w AS (PARTITION BY id ORDER BY k)), g AS (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY k) AS run FROM p) "
    "SELECT id, CAST(min(k) - 1 AS INT) AS \"start\", CAST(max(k) AS INT) AS \"end\", substring(any_value(l), 3) AS entity FROM g WHERE l <> 'O' GROUP BY id, run",
}
NAMED = VALID[len("coalesce(len(labels) = len(tokens) AND len(label_names) = len(tokens) AND ") : -len(", false)")]
FIELDS = ("entity_type", "entry_value", "source")
LINES = [f"CASE WHEN coalesce({SQUASH.replace('{t}', c)}, '') <> '' THEN '{c}: ' || {SQUASH.replace('{t}', c)} || chr(10) ELSE '' END" for c in FIELDS]
ORACLES |= {
    "compose_records": f"WITH l AS (SELECT id, [{', '.join(LINES)}] AS l FROM gazetteers) SELECT id, array_to_string(l, '') AS text, CAST(len([x FOR x IN l IF x <> '']) AS INT) AS n_fields, CAST(greatest(length(array_to_string(l, '')) - 1, 0) AS INT) AS last_end FROM l",
    "schema_inspect": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS n_rows, count({c}) AS n_filled FROM collector_runs" for c, t in (("run_id", "bigint"), ("source", "string"), ("status", "string"), ("license", "string"), ("n_seen", "bigint"), ("n_inserted", "bigint"), ("n_dup", "bigint"), ("n_invalid", "bigint"), ("error", "string"))),
    "first_sentences": f"WITH p AS (SELECT id, [x FOR x IN [{SQUASH.replace('{t}', 'y')} FOR y IN string_split(regexp_replace(sentence, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))] IF length(x) BETWEEN 30 AND 200] AS p FROM weak_examples WHERE sentence IS NOT NULL) SELECT id, p[1] AS first FROM p",
    "bio_names": f"WITH s AS ({ORACLES['bio_spans']}), n AS (SELECT regexp_replace(text, '(은|는|이|가|을|를|의|님|씨)$', '') AS name FROM s WHERE entity = 'NAME') SELECT name, count(*) AS n FROM n WHERE regexp_full_match(name, '[가-힣]{{2,5}}') GROUP BY name",
    "bio_round_trip": f"SELECT true AS same, count(*) AS n FROM ner_examples WHERE sentence IS NOT NULL AND label_names IS NOT NULL AND len(tokens) = length(sentence) AND len(label_names) = len(tokens) AND coalesce({NAMED}, false) AND list_bool_or([starts_with(x, 'B-') FOR x IN label_names])",
}
