"""Queries of the subpackage, over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hanmaru.llm import bpe, encoding, leakage, lookalike, near_dup, pii, truncation
from hanmaru.llm._common import read


#: Sentences have about a hundred 3-character sequences, bodies three times as many.
VERSIONS = {
    "ner_examples": near_dup.Settings(threshold=0.5, thin=3, shared=4),
    "weak_examples": near_dup.Settings(threshold=0.5, thin=9, shared=4),
}
OVERLAPS = near_dup.Settings(threshold=0.6, thin=2, shared=3)


def versions(spark: SparkSession, root: str, name: str) -> near_dup.Join:
    return near_dup.similarity_join(read(spark, root, name, "id", "sentence"), "id", near_dup.whitespace_normal(F.col("sentence")), VERSIONS[name])


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return near_dup.union_all([near_dup.every_pair(versions(spark, root, t), cross=False).select(F.lit(t).alias("tbl"), "id_a", "id_b") for t in VERSIONS])


def p1_classes(spark: SparkSession, root: str) -> DataFrame:
    """One row per row of either table: the class of its versions and its number of links."""
    return near_dup.union_all([near_dup.classes(versions(spark, root, t)).select(F.lit(t).alias("tbl"), "id", "class_id", "n_links") for t in VERSIONS])


def split_role(hint: str) -> Column:
    """1 for training, 2 for evaluation, null for anything else."""
    name = F.lower(F.trim(F.col(hint)))
    return F.when(name.isin("train", "training"), 1).when(name.isin("val", "valid", "validation", "dev", "test"), 2)


def overlaps(spark: SparkSession, root: str) -> near_dup.Join:
    rows = read(spark, root, "ner_examples", "id", "sentence", "split_hint")
    return near_dup.similarity_join(rows, "id", near_dup.letters_and_numbers(F.col("sentence")), OVERLAPS, split_role("split_hint"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return near_dup.every_pair(overlaps(spark, root)).select("id_a", "id_b")


def p2_report(spark: SparkSession, root: str) -> DataFrame:
    """Overlaps by evaluation split and source: evaluation rows that have one, exact ones among them, and pairs."""
    rows = read(spark, root, "ner_examples", "id", "split_hint", "source")
    split = F.lower(F.trim("split_hint"))
    split = F.when(split.isin("val", "valid", "validation", "dev"), "val").otherwise("test")
    held_out = rows.where(split_role("split_hint") == 2).select(F.col("id").alias("eval_id"), split.alias("split"), "source")
    best = near_dup.overlap_counts(overlaps(spark, root)).withColumnRenamed("id", "eval_id")
    return (
        held_out.join(best, "eval_id", "left").groupBy("split", "source")
        .agg(
            F.count("*").alias("n_rows"), F.count("n").alias("n_overlapping"), F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact")).alias("n_near"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs")
        )
    )


def p2_exact(spark: SparkSession, root: str) -> DataFrame:
    """The exact half of the report: evaluation rows by split and source whose canonical record is in training as well."""
    rows = read(spark, root, "ner_examples", "id", "sentence", "split_hint", "source")
    found = near_dup.equal_records(rows, "id", near_dup.letters_and_numbers(F.col("sentence")), split_role("split_hint"))
    split = F.lower(F.trim("split_hint"))
    split = F.when(split.isin("val", "valid", "validation", "dev"), "val").otherwise("test")
    return rows.join(found, "id", "left_semi").groupBy(split.alias("split"), "source").agg(F.count("*").alias("n_exact"))


def p3_restored(spark: SparkSession, root: str) -> DataFrame:
    """Every damaged row with its restored text; statistics come from all undamaged sentences."""
    sentences = read(spark, root, "ner_examples", "id", "sentence")
    surnames = read(spark, root, "korean_surnames", "row_id", "surname")
    model = encoding.corpus_model(sentences.select("sentence").unionAll(surnames.select("surname")), "sentence")
    return near_dup.union_all([
        encoding.restored(df, key, text, model).withColumn("tbl", F.lit(tbl))
        for tbl, df, key, text in (("ner_examples", sentences, "id", "sentence"), ("korean_surnames", surnames, "row_id", "surname"))
    ])


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return p3_restored(spark, root).select("tbl", "row_id")


LOOKS = (("analyze_l0_deep", "mutated"), ("hard_cases_v0", "text"))


def looks(spark: SparkSession, root: str) -> DataFrame:
    return near_dup.union_all([read(spark, root, t, "id", c).select(F.lit(t).alias("tbl"), "id", F.col(c).alias("looks")) for t, c in LOOKS])


def p4_canonical(spark: SparkSession, root: str) -> DataFrame:
    """Every text of both tables in its consistent form, under one vocabulary."""
    return lookalike.canonical(looks(spark, root), "id", "looks", "tbl")


def p4_spellings(spark: SparkSession, root: str) -> DataFrame:
    """Tokens that had to be decided: how many by a word and by the table, and how many are spelt otherwise than the table has it."""
    found = lookalike.spellings(looks(spark, root).where("looks is not null").select(F.col("looks").alias("text")))
    return found.groupBy("word").agg(F.count("*").alias("n"), F.count_if(F.col("canonical") != lookalike.by_table(F.col("token"))).alias("n_unlike_table"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return lookalike.alike(looks(spark, root), "id", "looks", "tbl")


TEXTS = (("ner_examples", "sentence"), ("weak_examples", "sentence"), ("hard_cases_v0", "text"))


def p5_spotted(spark: SparkSession, root: str) -> DataFrame:
    cases = read(spark, root, "hard_cases_v0", "id", "text", "labels")
    field = pii.trained(cases)
    frames = []
    for tbl, text in TEXTS:
        df = cases.where("labels is null") if tbl == "hard_cases_v0" else read(spark, root, tbl, "id", text)
        frames.append(pii.found(df, "id", text, field).withColumn("tbl", F.lit(tbl)))
    return near_dup.union_all(frames)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return p5_spotted(spark, root).select("tbl", "row_key", F.explode("spans").alias("s")).select("tbl", "row_key", "s.pii_type", "s.pos_from", "s.pos_to").distinct()


def p5_masked(spark: SparkSession, root: str) -> DataFrame:
    """The texts in which something was found, with typed placeholders in its stead."""
    return pii.masked(p5_spotted(spark, root), "tbl")


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return bpe.encode_column(read(spark, root, "documents", "doc_id", "text"), "doc_id", "text")


def p7_longest(spark: SparkSession, root: str) -> DataFrame:
    """The longest verbatim match of each document and item, with its places."""
    return leakage.matches(read(spark, root, "documents", "doc_id", "text"), "doc_id", "text", read(spark, root, "eval_items", "item_id", "text"), "item_id", "text")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return p7_longest(spark, root).select("doc_id", "item_id")


def p7_clean(spark: SparkSession, root: str) -> DataFrame:
    """The documents that are left when the affected ones are removed."""
    return leakage.without_leaks(read(spark, root, "documents", "doc_id", "source"), "doc_id", p7_longest(spark, root))


def p8_scored(spark: SparkSession, root: str) -> DataFrame:
    return truncation.scored(read(spark, root, "documents", "doc_id", "text", "source"), "doc_id", "text", "source")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return p8_scored(spark, root).where("score >= 0.5").select("doc_id")


def p8_report(spark: SparkSession, root: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.report(p8_scored(spark, root))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p2_exact": p2_exact,
    "p3_found": p3_found,
    "p3_restored": p3_restored,
    "p4_found": p4_found,
    "p4_canonical": p4_canonical,
    "p4_spellings": p4_spellings,
    "p5_found": p5_found,
    "p5_masked": p5_masked,
    "p6_ids": p6_ids,
    "p7_longest": p7_longest,
    "p7_found": p7_found,
    "p7_clean": p7_clean,
    "p8_found": p8_found,
    "p8_scored": p8_scored,
    "p8_report": p8_report,
}
BARE = "regexp_replace(lower({c}), '[^\\p{L}\\p{N}]', '', 'g')"


def form_sql(column: str) -> str:
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F) if chr(c) not in lookalike.HYPHENS)
    narrow = "".join(chr(ord(c) - 0xFEE0) for c in wide)
    letters = "".join(lookalike.SHAPES)
    from_ = lookalike.SPACES + lookalike.HYPHENS + letters + wide
    to = " " * len(lookalike.SPACES) + "-" * len(lookalike.HYPHENS) + "".join(lookalike.SHAPES.values()) + narrow
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return f"nfc_normalize(translate({column}, {quote(from_ + lookalike.IGNORABLE)}, {quote(to)}))"


def looks_sql(table: str, column: str) -> str:
    form = form_sql(column)
    return f"SELECT '{table}' AS tbl, a.id AS key_a, b.id AS key_b FROM (SELECT DISTINCT id, {column} AS t, {form} AS f FROM {table} WHERE {column} IS NOT NULL) a JOIN (SELECT DISTINCT id, {column} AS t, {form} AS f FROM {table} WHERE {column} IS NOT NULL) b ON a.f = b.f AND a.id < b.id AND a.t <> b.t"


RUNS_SQL = "SELECT DISTINCT {k}, substring(t, CAST(i AS INT), 40) AS g FROM (SELECT {k}, t, unnest(range(1, length(t) - 38)) AS i FROM (SELECT {k}, " + BARE.replace("{c}", "text") + " AS t FROM {n} WHERE text IS NOT NULL) WHERE length(t) >= 40)"
P7_SQL = "SELECT DISTINCT doc_id, item_id FROM (" + RUNS_SQL.replace("{k}", "doc_id").replace("{n}", "documents") + ") d JOIN (" + RUNS_SQL.replace("{k}", "item_id").replace("{n}", "eval_items") + ") e ON d.g = e.g"
HINT_SQL = "lower(trim(split_hint))"
ORACLES: dict[str, str] = {
    "p2_exact": f"WITH r AS (SELECT id, source, {HINT_SQL} AS s, {BARE.replace('{c}', 'sentence')} AS t FROM ner_examples WHERE sentence IS NOT NULL) SELECT CASE WHEN s = 'test' THEN 'test' ELSE 'val' END AS split, source, count(*) AS n_exact FROM r "
    "WHERE s IN ('val', 'valid', 'validation', 'dev', 'test') AND length(t) >= 3 AND t IN (SELECT t FROM r WHERE s IN ('train', 'training')) GROUP BY 1, 2",
    "p7_clean": f"SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({P7_SQL}))",
    "p4_found": " UNION ALL ".join(looks_sql(t, c) for t, c in LOOKS),
    "p4_canonical": " UNION ALL ".join(f"SELECT '{t}' AS tbl, id AS key, {c} AS text, {form_sql(c)} AS canonical FROM {t}" for t, c in LOOKS),
    "p7_found": P7_SQL,
}
