"""Queries of generators and mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hanmaru.functions import validate as V
from hanmaru.functions.text import CIRCLED
from hanmaru.operators import generate as G, screen
from hanmaru.plans.normalisation import check_sum, checked, sql_checked
from hanmaru.sources.tables import table

IDS = "(SELECT unnest(range((SELECT count(*) FROM supplier))) AS id)"


def draw_sql(seed: str, below: int) -> str:
    """The number that generate.draw() takes from the hash of a seed and an id."""
    return f"(CAST('0x' || substring(md5('{seed}:' || id), 1, 12) AS BIGINT) % {below})"


def generated(make):  # type: ignore[no-untyped-def]
    """(id, value): numbers with check digits, one for each supplier."""

    def run(spark: SparkSession, root: str) -> DataFrame:
        return make(spark, table(spark, root, "supplier", "s_suppkey").count())

    return run


def values(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "analyze_l0_deep", "pii_type", "pii_value").where("pii_value is not null").distinct()


def mutated(spark: SparkSession, root: str) -> DataFrame:
    """All mutations of all values, one row for each type, mutation and text."""
    rows = values(spark, root).select("pii_type", "pii_value", F.explode(G.mutations(F.col("pii_value"))).alias("m"))
    return rows.select("pii_type", "m.name", "m.level", "m.text").distinct()


def mutation_counts(spark: SparkSession, root: str) -> DataFrame:
    return mutated(spark, root).groupBy("name", "level").agg(F.count("*").alias("n"))


def simple_mutations(spark: SparkSession, root: str) -> DataFrame:
    return mutated(spark, root).where("name in ('fullwidth', 'circled', 'kr_digits', 'no_dash', 'dots', 'soft_hyphen', 'homoglyph', 'emoji', 'combining')").select("pii_type", "name", "text").distinct()


#: What the types of the analysis table are called in a sentence.
LABELS = {"rrn": "주민등록번호", "phone": "전화번호", "email": "이메일", "name": "이름"}


def sentences(spark: SparkSession, root: str) -> DataFrame:
    """Values in sentences, and all that becomes of these; one row for each type, mutation and text."""
    label = F.element_at(F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair)), F.col("pii_type"))
    rows = values(spark, root).where(F.col("pii_type").isin(*LABELS)).select("pii_type", F.explode(G.sentence_mutations(label, F.col("pii_value"))).alias("m"))
    return rows.select("pii_type", "m.name", "m.level", "m.text").distinct()


def sentences_sql() -> str:
    case = lambda table: "CASE l " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"
    foreign = lambda lang: case({k: v[lang] for k, v in G.FOREIGN.items() if lang in v})
    plain = "l || '는 ' || v || '입니다'"
    forms = [
        ("plain", 0, plain), ("abbreviation", 4, f"{case(G.SHORT)} || '는 ' || v || '입니다'"), ("code_switch", 4, f"{case(G.SWITCHED)} || '는 ' || v || '{G.SWITCHED['입니다']}'"), *((f"ml_{x}", 4, f"{foreign(x)} || '는 ' || v || '입니다'") for x in ("ja", "zh", "de", "fr")),
        ("ending", 4, f"l || '는 ' || v || '{G.ENDINGS['입니다']}'"), ("particle", 4, f"l || '{G.ENDINGS['는']} ' || v || '입니다'"), ("prefixed", 5, f"'시스템 점검 중입니다 ==== ' || {plain}"), ("json", 5, "'{\"' || l || '\":\"' || v || '\"}'"), ("record", 5, "'고객 조회 결과: ' || l || ' ' || v"),
    ]
    labels = "CASE pii_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " END"
    base = f"WITH d AS (SELECT DISTINCT pii_type, pii_value AS v, {labels} AS l FROM analyze_l0_deep WHERE pii_value IS NOT NULL) "
    return base + "SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT pii_type, '{name}' AS name, {level} AS level, {text} AS text FROM d WHERE l IS NOT NULL" for name, level, text in forms) + ") WHERE text IS NOT NULL"


def words() -> dict[str, list[str]]:
    return {fact: list(screen.KEYWORDS[fact][1]) for fact in G.FACTS}


def all_kinds(spark: SparkSession, root: str) -> DataFrame:
    """A value of every kind for every supplier."""
    return G.generated(table(spark, root, "supplier", "s_suppkey"), "s_suppkey", words())


def all_kinds_sql() -> str:
    """The same values, piece by piece."""

    def one(kind: str, k: int, what: str, of) -> str:  # type: ignore[no-untyped-def]
        seed = f"{kind}{k}"
        if what == "text":
            return "'" + of.replace("'", "''") + "'"
        if what == "number":
            return f"CAST({draw_sql(seed, of[1] - of[0] + 1)} + {of[0]} AS VARCHAR)"
        if what == "choice":
            return "[" + ", ".join(f"'{x}'" for x in of) + f"][CAST({draw_sql(seed, len(of))} AS INT) + 1]"
        stuff = " || ".join(f"md5('{seed}.{j}:' || id)" for j in range(-(-of // 32)))
        return f"substring(translate({stuff}, 'abcdef', '012345'), 1, {of})" if what == "digits" else f"substring({stuff}, 1, {of})"

    value = lambda kind, form: " || ".join(one(kind, k, what, of) for k, (what, of) in enumerate(G.pieces_of(form)))
    forms = {**G.FORMS, **{fact: "{" + "|".join(w) + "}" for fact, w in words().items()}}
    values = {kind: value(kind, form) for kind, form in forms.items()}
    body = value("device", "{#14}")
    luhn = f"list_sum([CASE WHEN i % 2 = 0 THEN CAST(substring(b, CAST(14 - i AS INT), 1) AS INT) * 2 - CASE WHEN CAST(substring(b, CAST(14 - i AS INT), 1) AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST(substring(b, CAST(14 - i AS INT), 1) AS INT) END FOR i IN range(0, 14)])"
    values["device"] = f"'IMEI: ' || b || CAST(CAST((10 - {luhn} % 10) % 10 AS INT) AS VARCHAR)"
    weigh = " + ".join(f"{w} * CASE WHEN instr('{G.VEHICLE_LETTERS}', substring(v, {k + 1}, 1)) > 0 THEN (instr('{G.VEHICLE_LETTERS}', substring(v, {k + 1}, 1)) - 1) % 10 + 1 ELSE CAST(substring(v, {k + 1}, 1) AS INT) END" for k, w in enumerate(G.VEHICLE_WEIGHTS))
    values["vin"] = f"substring(v, 1, 8) || CASE WHEN ({weigh}) % 11 = 10 THEN 'X' ELSE CAST(({weigh}) % 11 AS VARCHAR) END || substring(v, 10, 8)"
    area = f"({draw_sql('ssn0', 898)} + 1)"
    values["ssn"] = f"lpad(CAST(CASE WHEN {area} >= 666 THEN {area} + 1 ELSE {area} END AS VARCHAR), 3, '0') || '-' || lpad(CAST({draw_sql('ssn1', 99)} + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST({draw_sql('ssn2', 9999)} + 1 AS VARCHAR), 4, '0')"
    base = f"WITH s AS (SELECT s_suppkey AS id, upper(substring(md5('vin:' || s_suppkey), 1, 17)) AS v FROM supplier), b AS (SELECT *, {body} AS b FROM s) "
    return base + " UNION ALL ".join(f"SELECT id AS s_suppkey, '{kind}' AS kind, {v} AS value FROM b" for kind, v in values.items())


QUERIES = {
    "generate_resident": generated(G.resident_numbers), "generate_business": generated(G.business_numbers), "generate_card": generated(G.card_numbers),
    "generate_all": all_kinds, "mutation_explode": mutated, "mutation_sentences": sentences, "mutation_counts": mutation_counts, "mutation_simple": simple_mutations, "partial_mask": checked(G.partly_masked),
}
SIMPLE = {
    "fullwidth": ("translate(v, '" + G.ASCII_ALNUM + "', '" + G.WIDE_ALNUM + "')", "regexp_matches(v, '[0-9]')"), "circled": ("translate(v, '0123456789', '" + CIRCLED + "')", "regexp_matches(v, '[0-9]')"), "kr_digits": ("translate(v, '0123456789', '" + G.READINGS + "')", "regexp_matches(v, '[0-9]')"),
    "no_dash": ("replace(v, '-', '')", "contains(v, '-')"), "dots": ("replace(v, '-', '.')", "contains(v, '-')"), "soft_hyphen": ("array_to_string([substring(v, CAST(i AS INT), 1) FOR i IN range(1, length(v) + 1)], chr(173))", "length(v) > 0"),
    "homoglyph": ("translate(v, '0123456789', '" + G.BOLD + "')", "regexp_matches(v, '[0-9]')"), "combining": ("regexp_replace(v, '([0-9])', '\\1' || chr(769), 'g')", "regexp_matches(v, '[0-9]')"),
    "emoji": ("array_to_string([substring(v, CAST(i AS INT), 1) || CASE WHEN i % 3 = 0 THEN '🔒' ELSE '' END FOR i IN range(1, length(v) + 1)], '')", "length(v) > 2"),
}
ORACLES = {
    "mutation_sentences": sentences_sql(),
    "generate_all": all_kinds_sql(),
    "generate_resident": f"WITH b AS (SELECT id, strftime(day, '%y%m%d') || CAST(CASE WHEN year(day) < 2000 THEN 1 ELSE 3 END + {draw_sql('rc', 2)} AS VARCHAR) || lpad(CAST({draw_sql('rs', 100000)} AS VARCHAR), 5, '0') AS b FROM (SELECT id, DATE '1940-01-01' + CAST({draw_sql('rd', 29000)} AS INT) AS day FROM {IDS})) "
    f"SELECT id, substring(b, 1, 6) || '-' || substring(b, 7, 6) || CAST((11 - ({check_sum(V.RESIDENT_WEIGHTS).format(d='b')}) % 11) % 10 AS VARCHAR) AS value FROM b",
    "generate_business": f"WITH b AS (SELECT id, lpad(CAST({draw_sql('b', 900_000_000)} + 100000000 AS VARCHAR), 9, '0') AS b FROM {IDS}), t AS (SELECT *, {check_sum(V.BUSINESS_WEIGHTS[:8]).format(d='b')} + CAST(substring(b, 9, 1) AS INT) * 5 // 10 + CAST(substring(b, 9, 1) AS INT) * 5 % 10 AS t FROM b) "
    "SELECT id, substring(b, 1, 3) || '-' || substring(b, 4, 2) || '-' || substring(b, 6, 4) || CAST((10 - t % 10) % 10 AS VARCHAR) AS value FROM t",
    "generate_card": f"WITH b AS (SELECT id, '4' || lpad(CAST({draw_sql('k', 10**12)} AS VARCHAR), 14, '0') AS b FROM {IDS}), t AS (SELECT *, list_sum([CASE WHEN i % 2 = 0 THEN CAST(substring(b, CAST(i AS INT), 1) AS INT) ELSE CAST(substring(b, CAST(i AS INT), 1) AS INT) * 2 - CASE WHEN CAST(substring(b, CAST(i AS INT), 1) AS INT) > 4 THEN 9 ELSE 0 END END FOR i IN range(1, 16)]) AS t FROM b) "
    "SELECT id, b || CAST(CAST((10 - t % 10) % 10 AS INT) AS VARCHAR) AS value FROM t",
    "mutation_simple": "WITH d AS (SELECT DISTINCT pii_type, pii_value AS v FROM analyze_l0_deep WHERE pii_value IS NOT NULL) SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT pii_type, '{name}' AS name, {made} AS text FROM d WHERE {ok}" for name, (made, ok) in SIMPLE.items()) + ")",
    # The digits but the last four, by what stands behind them, as the SQL knows no look-ahead.
    "partial_mask": sql_checked("CASE WHEN regexp_full_match(value, '\\d{2,3}-\\d{3,4}-\\d{4}') THEN regexp_replace(value, '^(\\d{2,3})-(\\d{3,4})-(\\d{4})$', '\\1-****-\\3') WHEN contains(value, '@') THEN regexp_replace(value, '^(.{1,2})[^@]*(@.*)$', '\\1***\\2') "
    "ELSE array_to_string([CASE WHEN regexp_matches(substring(value, CAST(i AS INT), 1), '[0-9]') AND length(regexp_replace(substring(value, CAST(i AS INT) + 1), '[^0-9]', '', 'g')) >= 4 THEN '*' ELSE substring(value, CAST(i AS INT), 1) END FOR i IN range(1, length(value) + 1)], '') END"),
}
