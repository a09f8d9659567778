"""Queries of screening and tagging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hanmaru.functions.lists import HONORIFICS, PARTICLES
from hanmaru.operators import screen, spans as S, tagging
from hanmaru.plans.normalisation import quoted
from hanmaru.sources.tables import spread, table


def texts(spark: SparkSession, root: str) -> DataFrame:
    return spread(table(spark, root, "analyze_l0_deep", "id", "mutated").where("mutated is not null").distinct())


def normalised(spark: SparkSession, root: str) -> DataFrame:
    return screen.normalised(texts(spark, root), "mutated").select("id", "normalised")


def explained(spark: SparkSession, root: str) -> DataFrame:
    """How many texts each step of the chain changes."""
    done = screen.normalised(texts(spark, root), "mutated", explain=True)
    return done.select(F.explode("steps").alias("s")).groupBy("s.step").agg(F.count("*").alias("n"))


def screened(spark: SparkSession, root: str) -> DataFrame:
    return screen.screened(texts(spark, root), "mutated").select("id", F.size("findings").alias("n"), "action", "output")


def kinds(spark: SparkSession, root: str) -> DataFrame:
    done = screen.screened(texts(spark, root), "mutated", mode="block")
    return done.select(F.explode("findings").alias("f")).groupBy("f.kind").agg(F.count("*").alias("n"), F.round(F.avg("f.confidence"), 3).alias("confidence"))


def keyword_hits(spark: SparkSession, root: str) -> DataFrame:
    """Findings of the screening words in documents, by kind and word."""
    rows = spread(table(spark, root, "documents", "doc_id", "text").where("text is not null"))
    found = rows.select(F.explode(F.filter(screen.findings(F.col("text")), lambda f: f["confidence"].isin(0.9, 0.7))).alias("f"))
    return found.groupBy("f.kind", F.col("f.value").alias("word")).agg(F.count("*").alias("n"), F.count_if(F.col("f.confidence") == 0.9).alias("n_in_context"))


def tags(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "hard_cases_v0", "id", "text").distinct()
    return tagging.tagged(rows, "id", "text", tagging.literal_backend({"이하나": 0.85, "김민수": 0.85, "상담원": 0.65}))


def address_merge(spark: SparkSession, root: str) -> DataFrame:
    """Addresses of documents after neighbouring fragments were joined."""
    rows = spread(table(spark, root, "documents", "doc_id", "text"))
    return S.guarded(rows, detectors=["address"]).select("doc_id", F.inline("spans")).select("doc_id", "start", "end", "entity", "text")


def bodies(spark: SparkSession, root: str) -> DataFrame:
    """Every distinct word of the sentences without the particles at its end, as a name and as anything else."""
    words = table(spark, root, "ner_examples", "sentence").select(F.explode(F.split("sentence", "[^가-힣]+")).alias("word")).where("word <> ''").distinct()
    return words.select("word", S.without_suffix(F.col("word"), True).alias("name"), S.without_suffix(F.col("word")).alias("other"))


QUERIES = {
    "screen_normalise": normalised, "screen_explain": explained, "screen_process": screened, "screen_kinds": kinds, "screen_keywords": keyword_hits, "ner_tags": tags, "address_merge": address_merge,
    "boundary_suffix": bodies,
}


def bodies_sql(endings) -> str:  # type: ignore[no-untyped-def]
    """Four times the longest ending taken from the end, one character left."""
    out, alternatives = "word", "|".join(sorted(endings, key=len, reverse=True))
    for _ in range(4):
        out = f"regexp_replace({out}, '^(.+?)(?:{alternatives})$', '\\1')"
    return out


def keyword_sql() -> str:
    rows = [(kind, word, context) for kind, (context, words) in screen.KEYWORDS.items() for word in words]
    listed = ", ".join(f"({quoted(k)}, {quoted(w)}, [{', '.join(map(quoted, c))}])" for k, w, c in rows)
    return (
        f"WITH k AS (SELECT * FROM (VALUES {listed}) t(kind, word, context)), "
        "h AS (SELECT doc_id, kind, word, list_bool_or([contains(text, c) FOR c IN context]) AS near FROM documents JOIN k ON contains(text, word)) "
        "SELECT kind, word, count(*) AS n, count(*) FILTER (WHERE near) AS n_in_context FROM h WHERE near OR length(word) > 2 GROUP BY kind, word"
    )


ORACLES = {
    "screen_keywords": keyword_sql(),
    "boundary_suffix": "WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(sentence, '[^가-힣]+')) AS word FROM ner_examples) WHERE word <> '') "
    f"SELECT word, CASE WHEN length({bodies_sql([*PARTICLES, *HONORIFICS])}) >= 2 THEN {bodies_sql([*PARTICLES, *HONORIFICS])} ELSE word END AS name, {bodies_sql(PARTICLES)} AS other FROM w",
}
