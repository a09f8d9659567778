"""Queries of text normalisation and validators."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hanmaru.functions import text as T, validate as V
from hanmaru.sources.tables import table

KEY = b"example-key"


def over(name: str, key: str, text: str, make) -> object:  # type: ignore[no-untyped-def]
    """A query that applies an expression to a text column of distinct keys: (key, out)."""

    def run(spark: SparkSession, root: str) -> DataFrame:
        rows = table(spark, root, name, key, text).where(F.col(text).isNotNull()).distinct()
        return rows.select(F.col(key).cast("string").alias("key"), make(F.col(text)).alias("out"))

    return run


#: Identifiers, right and wrong ones, made of the key k of a supplier. The expressions mean the same in Spark and DuckDB.
MADE = (
    "CAST(k * 37 % 300 AS STRING) || '.' || CAST(k % 256 AS STRING) || '.0.' || CAST(k * 7 % 260 AS STRING)",
    "CASE k % 4 WHEN 0 THEN '10.' WHEN 1 THEN '172.' WHEN 2 THEN '192.168.' ELSE '8.8.' END || CAST(k % 40 AS STRING) || CASE k % 4 WHEN 2 THEN '' WHEN 3 THEN '' ELSE '.1' END || '.9'",
    "'00:1B:' || substring(md5(CAST(k AS STRING)), 1, 2) || ':' || substring(md5(CAST(k AS STRING)), 3, 2) || CASE k % 3 WHEN 0 THEN '-' ELSE ':' END || 'aa:' || substring(md5(CAST(k AS STRING)), 5, 2)",
    "'00-1b-44-11-3a-' || substring(md5(CAST(k AS STRING)), 1, 2)",
    "substring(lpad(CAST(k * 7919 % 1000000007 AS STRING), 10, '1'), 1, 3) || '-' || substring(lpad(CAST(k * 7919 % 1000000007 AS STRING), 10, '1'), 4, 2) || '-' || substring(lpad(CAST(k * 7919 % 1000000007 AS STRING), 10, '1'), 6, 5)",
    "lpad(CAST(k % 100 AS STRING), 2, '0') || lpad(CAST(k % 14 AS STRING), 2, '0') || lpad(CAST(k % 33 AS STRING), 2, '0') || '-' || CAST(k % 10 AS STRING) || lpad(CAST(k * 1301 % 1000000 AS STRING), 6, '0')",
    "'4' || lpad(CAST(k * 104729 % 1000000007 AS STRING), 15, '2')",
    "'110-' || lpad(CAST(k % 1000 AS STRING), 3, '0') || '-' || lpad(CAST(k * 31 AS STRING), 6, '0')",
    "CASE k % 2 WHEN 0 THEN '3333-' ELSE '3434-' END || lpad(CAST(k % 100 AS STRING), 2, '0') || '-' || lpad(CAST(k * 31 AS STRING), 7, '0')",
    "'sk-' || substring(md5(CAST(k AS STRING)), 1, CAST(10 + k % 20 AS INT))",
    "'sk-Aa0' || substring(md5(CAST(k AS STRING)), 1, CAST(16 + k % 10 AS INT))",
    "CASE k % 5 WHEN 0 THEN '010' WHEN 1 THEN '02' WHEN 2 THEN '031' WHEN 3 THEN '050' ELSE '016' END || '-' || CAST(100 + k AS STRING) || '-' || lpad(CAST(k AS STRING), 4, '0')",
    "CASE k % 4 WHEN 0 THEN 'a.b+' ELSE '' END || 'x' || CAST(k AS STRING) || CASE k % 3 WHEN 0 THEN '@@' ELSE '@' END || CASE k % 5 WHEN 0 THEN '-' ELSE 'm' END || 'ail.co' || CASE k % 7 WHEN 0 THEN '1' ELSE 'm' END",
)
VALUES_SQL = "(SELECT DISTINCT pii_value AS value FROM analyze_l0_deep WHERE pii_value IS NOT NULL UNION SELECT value FROM (SELECT unnest([" + ", ".join(MADE) + "]) AS value FROM (SELECT s_suppkey AS k FROM supplier)))"


def checked(make) -> object:  # type: ignore[no-untyped-def]
    """A query over all values of the analysis table and all made identifiers: (value, out)."""

    def run(spark: SparkSession, root: str) -> DataFrame:
        found = table(spark, root, "analyze_l0_deep", "pii_value").where("pii_value is not null").select(F.col("pii_value").alias("value"))
        made = table(spark, root, "supplier", "s_suppkey").withColumnRenamed("s_suppkey", "k").select(F.explode(F.array(*map(F.expr, MADE))).alias("value"))
        return found.unionAll(made).distinct().select("value", make(F.col("value")).alias("out"))

    return run


def sql_checked(expression: str) -> str:
    return f"SELECT value, {expression} AS out FROM {VALUES_SQL}"


#: Entries of the gazetteer, by their id; what is written before them depends on it.
ENTRIES = "(SELECT id, trim(entry_value) AS entry FROM gazetteers WHERE trim(entry_value) <> '')"


def written(spelt: list[str], make) -> object:  # type: ignore[no-untyped-def]
    """A query over all entries of the gazetteer, each behind one of the given spellings by turns: (id, out)."""

    def run(spark: SparkSession, root: str) -> DataFrame:
        rows = table(spark, root, "gazetteers", "id", "entry_value").select("id", F.trim("entry_value").alias("entry")).where("entry <> ''")
        before = F.element_at(F.array(*map(F.lit, spelt)), (F.pmod("id", F.lit(len(spelt))) + 1).cast("int"))
        return rows.select("id", make(F.concat(before, F.lit(" "), F.col("entry"))).alias("out"))

    return run


def sql_written(read: list[str]) -> str:
    """The same entries behind what the spellings stand for."""
    return f"SELECT id, [{', '.join(map(quoted, read))}][CAST(id % {len(read)} AS INT) + 1] || ' ' || entry AS out FROM {ENTRIES}"


def spelt_out(text: str | None) -> str | None:
    """Syllables as single letters."""
    if text is None:
        return None
    single = {conjoining: letter for forms in T.CONJOINING for letter, conjoining in forms.items()}
    return "".join(single.get(c, c) for c in unicodedata.normalize("NFD", text))


def letters_back(spark: SparkSession, root: str) -> DataFrame:
    """Entries spelt out in letters and composed again."""
    rows = table(spark, root, "gazetteers", "id", "entry_value").where("entry_value is not null")
    return rows.select("id", T.arrow(T.compose_letters)(T.arrow(spelt_out)(F.col("entry_value"))).alias("out"))


def numerals_back(spark: SparkSession, root: str) -> DataFrame:
    """Numbers written in words behind a label, and read again."""
    rows = table(spark, root, "analyze_l0_deep", "pii_value").where("pii_value rlike '^[0-9]+(-[0-9]+)*$'").distinct()
    return rows.select("pii_value", T.arrow(T.restore_numerals)(F.concat(F.lit("전화 "), F.translate("pii_value", "0123456789", "공일이삼사오육칠팔구"), F.lit("입니다"))).alias("out"))


def row_ids(spark: SparkSession, root: str) -> DataFrame:
    """Short keyed hashes that stand for rows: of the id, or of the place and text where there is none."""
    rows = table(spark, root, "documents", "doc_id", "text")
    return rows.select("doc_id", T.row_id(F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("doc_id").cast("string")), F.col("doc_id"), F.coalesce("text", F.lit("")), KEY).alias("out"))


def sealed(spark: SparkSession, root: str) -> DataFrame:
    """Entries sealed under a password and the row's id, and opened again; whether the sealed bytes differ from the entry."""
    rows = table(spark, root, "gazetteers", "id", "entry_value").where("entry_value is not null")
    key = T.password_key("example", b"example-salt")
    box = T.sealed(F.col("entry_value"), key, F.col("id").cast("string"))
    return rows.select("id", T.opened(box, key, F.col("id").cast("string")).alias("out"), (~box.contains(F.col("entry_value"))).alias("hidden"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_over(name: str, key: str, text: str, expression: str) -> str:
    return f"SELECT CAST({key} AS VARCHAR) AS key, {expression} AS out FROM (SELECT DISTINCT {key}, {text} AS t FROM {name} WHERE {text} IS NOT NULL)"


def sentence_counts(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents", "doc_id", "text").where("text is not null")
    parts = rows.select("doc_id", T.sentences(F.col("text")).alias("s"))
    return parts.select("doc_id", F.size("s").alias("n"), F.aggregate("s", F.lit(0), lambda a, x: a + x["end"] - x["start"]).alias("chars"))


def word_counts(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents", "doc_id", "text").where("text is not null")
    parts = rows.select("doc_id", T.words(F.col("text")).alias("w"))
    return parts.select("doc_id", F.size("w").alias("n"), F.coalesce(F.try_element_at("w", F.lit(-1))["end"], F.lit(0)).alias("last_end"))


def folded_offsets(spark: SparkSession, root: str) -> DataFrame:
    """Places of folded characters point back into the stored text: lengths of both and the last place."""
    rows = table(spark, root, "analyze_l0_deep", "id", "mutated").where("mutated is not null").distinct()
    return rows.select("id", F.length("mutated").alias("n_stored"), T.char_fold_map(F.col("mutated")).alias("m")).select("id", "n_stored", F.length("m.text").alias("n_folded"), F.array_max("m.ends").alias("last_end"))


def identifiers(spark: SparkSession, root: str) -> DataFrame:
    """Every distinct value under every validator."""
    v = F.col("pii_value")
    rows = table(spark, root, "analyze_l0_deep", "pii_value").where("pii_value is not null").distinct()
    return rows.select(
        v.alias("value"), V.resident(v).alias("rrn"), V.resident(v, foreign=True).alias("frn"), V.resident(v, "strict").alias("rrn_strict"), V.phone_class(v).alias("phone"), V.email(v).alias("email"), V.card(v).alias("card"), V.business(v).alias("business"), V.bank_layout(v).alias("bank"),
    )


def identifier_counts(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "analyze_l0_deep", "id", "pii_type", "pii_value").dropDuplicates(["id"])
    v = F.col("pii_value")
    return rows.groupBy("pii_type").agg(F.count_if(V.resident(v)).alias("n_rrn"), F.count_if(V.resident(v, foreign=True)).alias("n_frn"), F.count_if(V.phone_class(v).isNotNull()).alias("n_phone"), F.count_if(V.email(v)).alias("n_email"), F.count_if(V.card(v)).alias("n_card"))


DROP = "translate({t}, '" + T.INVISIBLE + "', '')"
FOLD = "translate({t}, '" + T.FULLWIDTH + T.CIRCLED + T.NEGATIVE_CIRCLED + "".join(T.MATH) + "', '" + "0123456789" * 8 + "')"
DIGITS = "regexp_replace(" + FOLD.format(t="value") + ", '[^0-9]', '', 'g')"
SQUASH = "trim(regexp_replace({t}, '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+', ' ', 'g'))"


def nested_pattern(start: str, pairs: list[tuple[str, str, str]]) -> str:
    for pattern, to, flags in pairs:
        start = f"regexp_replace({start}, {quoted(pattern)}, {quoted(to)}, {quoted(flags)})"
    return start


def check_sum(weights: tuple[int, ...]) -> str:
    return " + ".join(f"{w} * CAST(substring({{d}}, {k + 1}, 1) AS INT)" for k, w in enumerate(weights))


def born(d: str, foreign: bool) -> str:
    c = f"substring({d}, 7, 1)"
    century = f"CASE WHEN {c} IN ('5','6') THEN '19' WHEN {c} IN ('7','8') THEN '20' END" if foreign else f"CASE WHEN {c} IN ('9','0') THEN '18' WHEN {c} IN ('1','2') THEN '19' WHEN {c} IN ('3','4') THEN '20' END"
    return f"(regexp_full_match({d}, '\\d{{13}}') AND NOT regexp_full_match({d}, '0+|1+|2+|3+|4+|5+|6+|7+|8+|9+|1234567890123') AND try_strptime({century} || substring({d}, 1, 6), '%Y%m%d') IS NOT NULL)"


LUHN = "(regexp_full_match({d}, '\\d{{13,19}}') AND NOT regexp_full_match({d}, '0+|1+|2+|3+|4+|5+|6+|7+|8+|9+|1234567890123|1234567890123456') AND (list_sum([CASE WHEN i % 2 = 0 THEN CAST(substring(reverse({d}), CAST(i AS INT), 1) AS INT) * 2 - CASE WHEN CAST(substring(reverse({d}), CAST(i AS INT), 1) AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST(substring(reverse({d}), CAST(i AS INT), 1) AS INT) END FOR i IN range(1, length({d}) + 1)]) % 10 = 0))"
PHONE = "CASE WHEN regexp_full_match({d}, '010\\d{{8}}|01[16789]\\d{{7,8}}') THEN 'PHONE_MOBILE' WHEN regexp_full_match({d}, '02\\d{{7,8}}|0(3[1-3]|4[1-4]|5[1-5]|6[1-4])\\d{{7,8}}') THEN 'PHONE_LANDLINE' END"
EMAIL = "(length({v}) <= 254 AND length(split_part({v}, '@', 1)) BETWEEN 1 AND 64 AND length({v}) - length(replace({v}, '@', '')) = 1 AND regexp_full_match(split_part({v}, '@', 2), '([^-.]|[^-.][^.]{{0,61}}[^-.])(\\.([^-.]|[^-.][^.]{{0,61}}[^-.]))*\\.[A-Za-z]{{2,63}}'))"
PRIVATE = "(0|10|127|22[4-9]|23\\d|24\\d|25[0-5])\\..*|172\\.(1[6-9]|2\\d|3[01])\\..*|192\\.168\\..*|169\\.254\\..*|192\\.0\\.[02]\\..*|198\\.1[89]\\..*|198\\.51\\.100\\..*|203\\.0\\.113\\..*"
OCTET = "(0|[1-9]\\d?|1\\d\\d|2[0-4]\\d|25[0-5])"

BUSINESS = "CASE WHEN regexp_full_match({d}, '\\d{{10}}') AND NOT regexp_full_match({d}, '0+|1+') THEN (10 - ({s} + CAST(substring({d}, 9, 1) AS INT) * 5 // 10 + (CAST(substring({d}, 9, 1) AS INT) * 5) % 10) % 10) % 10 = CAST(substring({d}, 10, 1) AS INT) ELSE false END".format(d=DIGITS, s=check_sum(V.BUSINESS_WEIGHTS[:8]).format(d=DIGITS))
CHECKED = f"(11 - ({check_sum(V.RESIDENT_WEIGHTS).format(d=DIGITS)}) % 11) % 10 = CAST(substring({DIGITS}, 13, 1) AS INT)"

QUERIES = {
    "strip_invisible": over("analyze_l0_deep", "id", "mutated", T.strip_invisible),
    "fold_dashes": over("analyze_l0_deep", "id", "mutated", T.fold_dashes),
    "translate_digits": over("analyze_l0_deep", "id", "mutated", T.fold_digits),
    "content_hash": over("ner_examples", "id", "sentence", T.content_hash),
    "squash_spaces": over("weak_examples", "id", "sentence", T.squash),
    "hmac_digest": over("gazetteers", "id", "entry_value", lambda c: T.hmac_sha256(c, KEY, "k1")),
    "digit_compact": over("hard_cases_v0", "id", "text", T.compact_digits),
    "digit_space_compact": over("hard_cases_v0", "id", "text", T.compact_digit_spaces),
    "collapse_digit_spaces": over("hard_cases_v0", "id", "text", T.collapse_digit_spaces),
    "char_fold": over("analyze_l0_deep", "id", "mutated", T.arrow(T.char_fold)),
    "char_fold_offsets": folded_offsets,
    "strip_marks": over("analyze_l0_deep", "id", "mutated", T.arrow(T.strip_marks)),
    "compose_letters": letters_back,
    "restore_numerals": numerals_back,
    "row_ids": row_ids,
    "sealed_values": sealed,
    "choseong_restore": written(list(T.CHOSEONG), lambda c: T.replace_once(c, T.CHOSEONG)),
    "disguise_restore": written(list(T.DISGUISED), lambda c: T.replace_once(c, T.DISGUISED)),
    "roman_restore": written([k.upper() for k in T.ROMANISED], T.restore_romanised),
    "keyword_join": written(["  ".join(k) for k in T.KEYWORDS], T.join_keywords),
    "separator_normalise": over("hard_cases_v0", "id", "text", T.separators),
    "particle_choice": over("gazetteers", "id", "entry_value", lambda c: T.particle_after(c, "은", "는")),
    "sentence_split": sentence_counts,
    "eojeol_split": word_counts,
    "identifiers_validate": identifiers,
    "identifier_counts": identifier_counts,
    "rrn_validate": checked(V.resident),
    "frn_validate": checked(lambda c: V.resident(c, foreign=True)),
    "rrn_checksum": checked(lambda c: F.when(V.digits(c).rlike(r"^\d{13}$"), V.resident_check(V.digits(c)))),
    "phone_validate": checked(V.phone_class),
    "email_validate": checked(V.email),
    "card_validate": checked(V.card),
    "bizno_validate": checked(V.business),
    "bank_profile": checked(V.bank_layout),
    "mac_validate": checked(V.mac),
    "ipv4_classify": checked(V.ipv4_class),
    "secret_entropy": checked(lambda c: F.round(V.entropy(c), 6)),
    "secret_validate": checked(V.secret),
}
INNER, OUTER = bytes(b ^ 0x36 for b in KEY.ljust(64, b"\0")).hex(), bytes(b ^ 0x5C for b in KEY.ljust(64, b"\0")).hex()
ORACLES = {
    "strip_invisible": sql_over("analyze_l0_deep", "id", "mutated", DROP.format(t="t")),
    "fold_dashes": sql_over("analyze_l0_deep", "id", "mutated", f"translate(t, '{T.DASHES}', '{'-' * len(T.DASHES)}')"),
    "translate_digits": sql_over("analyze_l0_deep", "id", "mutated", FOLD.format(t="t")),
    # Twice, as the SQL knows no look-around and a digit can stand between two runs.
    "strip_marks": sql_over("analyze_l0_deep", "id", "mutated", "nfc_normalize(strip_accents(t))"),
    "digit_compact": sql_over("hard_cases_v0", "id", "text", nested_pattern("t", [("([0-9])[-./_\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+([0-9])", "\\1\\2", "g")] * 2)),
    "collapse_digit_spaces": sql_over("hard_cases_v0", "id", "text", nested_pattern("t", [("([0-9])\\s+([0-9])", "\\1\\2", "g")] * 2 + [("([0-9])\\s*-\\s*([0-9])", "\\1-\\2", "g")] * 2)),
    "content_hash": sql_over("ner_examples", "id", "sentence", "sha256(" + SQUASH.replace("{t}", "t") + ")"),
    "squash_spaces": sql_over("weak_examples", "id", "sentence", SQUASH.replace("{t}", "t")),
    "hmac_digest": sql_over("gazetteers", "id", "entry_value", "'hmac-sha256:k1:' || sha256(unhex('" + bytes(b ^ 0x5C for b in KEY.ljust(64, b"\0")).hex() + "') || unhex(sha256(unhex('" + bytes(b ^ 0x36 for b in KEY.ljust(64, b"\0")).hex() + "') || encode(t))))"),
    "compose_letters": "SELECT id, entry_value AS out FROM gazetteers WHERE entry_value IS NOT NULL",
    "restore_numerals": "SELECT DISTINCT pii_value, '전화 ' || pii_value || '입니다' AS out FROM analyze_l0_deep WHERE regexp_full_match(pii_value, '[0-9]+(-[0-9]+)*')",
    "row_ids": "SELECT doc_id, substring(sha256(unhex('" + OUTER + "') || unhex(sha256(unhex('" + INNER + "') || encode(CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE doc_id || ':' || coalesce(text, '') END)))), 1, 24) AS out FROM documents",
    "sealed_values": "SELECT id, entry_value AS out, true AS hidden FROM gazetteers WHERE entry_value IS NOT NULL",
    "choseong_restore": sql_written(list(T.CHOSEONG.values())),
    "disguise_restore": sql_written(list(T.DISGUISED.values())),
    "roman_restore": sql_written(list(T.ROMANISED.values())),
    "keyword_join": sql_written(list(T.KEYWORDS)),
    "separator_normalise": sql_over("hard_cases_v0", "id", "text", nested_pattern("t", [("(\\d{6})[\\s.·]+(\\d{7})", "\\1-\\2", "g"), ("(\\d{3})[\\s.·]+(\\d{4})[\\s.·]+(\\d{4})", "\\1-\\2-\\3", "g"), ("(\\d{4})[\\s.·]+(\\d{4})[\\s.·]+(\\d{4})[\\s.·]+(\\d{4})", "\\1-\\2-\\3-\\4", "g"), ("(^|[^0-9A-Za-z_가-힣])(\\d{6})(\\d{7})($|[^0-9A-Za-z_가-힣])", "\\1\\2-\\3\\4", "g")])),
    "particle_choice": sql_over("gazetteers", "id", "entry_value", "CASE WHEN (((unicode(right(t, 1)) - 44032) % 28) + 28) % 28 > 0 THEN '은' ELSE '는' END"),
    "sentence_split": "SELECT doc_id, CAST(len(s) AS INT) AS n, CAST(coalesce(list_sum([length(x) FOR x IN s]), 0) AS INT) AS chars FROM (SELECT doc_id, regexp_extract_all(text, '[^\\s\\x{0b}\\x{85}\\p{Z}.!?。！？][^.!?。！？\\n]*[.!?。！？\\n]?|[.!?。！？]') AS s FROM documents WHERE text IS NOT NULL)",
    "eojeol_split": "SELECT doc_id, CAST(len(w) AS INT) AS n, CASE WHEN len(w) > 0 THEN CAST(length(regexp_replace(text, '[\\s\\x{0b}\\x{85}\\p{Z}]+$', '')) AS INT) ELSE 0 END AS last_end FROM (SELECT doc_id, text, regexp_extract_all(text, '[^\\s\\x{0b}\\x{85}\\p{Z}]+') AS w FROM documents WHERE text IS NOT NULL)",
    "identifier_counts": "SELECT pii_type, count(*) FILTER (WHERE " + born("d", False) + ") AS n_rrn, count(*) FILTER (WHERE " + born("d", True) + ") AS n_frn, count(*) FILTER (WHERE (" + PHONE.format(d="d") + ") IS NOT NULL) AS n_phone, count(*) FILTER (WHERE " + EMAIL.format(v="pii_value") + ") AS n_email, count(*) FILTER (WHERE " + LUHN.format(d="d") + ") AS n_card FROM (SELECT DISTINCT id, pii_type, pii_value, regexp_replace(" + FOLD.format(t="pii_value") + ", '[^0-9]', '', 'g') AS d FROM analyze_l0_deep) GROUP BY pii_type",
    "rrn_validate": sql_checked(born(DIGITS, False)),
    "frn_validate": sql_checked(born(DIGITS, True)),
    "rrn_checksum": sql_checked(f"CASE WHEN regexp_full_match({DIGITS}, '\\d{{13}}') THEN (11 - ({check_sum(V.RESIDENT_WEIGHTS).format(d=DIGITS)}) % 11) % 10 = CAST(substring({DIGITS}, 13, 1) AS INT) END"),
    "phone_validate": sql_checked(PHONE.format(d=DIGITS)),
    "email_validate": sql_checked(EMAIL.format(v="value")),
    "card_validate": sql_checked(LUHN.format(d=DIGITS)),
    "mac_validate": sql_checked("CASE WHEN regexp_full_match(value, '([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}|([0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}') THEN lower(replace(value, '-', ':')) END"),
    "ipv4_classify": sql_checked(f"CASE WHEN NOT regexp_full_match(value, '({OCTET}\\.){{3}}{OCTET}') THEN NULL WHEN regexp_full_match(value, '{PRIVATE}') THEN 'private' ELSE 'public' END"),
    "secret_entropy": f"SELECT value, round(-sum(p * log2(p)), 6) AS out FROM (SELECT value, c, count(*) / length(value) AS p FROM (SELECT value, unnest(string_split(value, '')) AS c FROM {VALUES_SQL}) GROUP BY value, c) GROUP BY value",
    "bizno_validate": sql_checked(BUSINESS),
}


def bank_sql(value: str = "value") -> str:
    plain = f"replace(trim({value}), ' ', '')"
    cases = []
    for bank, segments, prefixes in V.BANKS:
        first = "(" + "|".join(prefixes) + ")" if prefixes else "\\d{%d}" % segments[0]
        rest = ["\\d{%d}" % n for n in segments[1:]]
        cases.append(f"WHEN regexp_full_match({plain}, '{'-'.join([first, *rest])}|{''.join([first, *rest])}') THEN '{bank}:{'_'.join(map(str, segments))}'")
    return f"CASE WHEN length(regexp_replace({plain}, '[^0-9]', '', 'g')) NOT BETWEEN 9 AND 16 THEN NULL {' '.join(cases)} END"


ORACLES["bank_profile"] = sql_checked(bank_sql())
ORACLES["identifiers_validate"] = (
    f"SELECT value, {born(DIGITS, False)} AS rrn, {born(DIGITS, True)} AS frn, CASE WHEN {born(DIGITS, False)} THEN {CHECKED} ELSE false END AS rrn_strict, {PHONE.format(d=DIGITS)} AS phone, {EMAIL.format(v='value')} AS email, {LUHN.format(d=DIGITS)} AS card, {BUSINESS} AS business, {bank_sql()} AS bank "
    "FROM (SELECT DISTINCT pii_value AS value FROM analyze_l0_deep WHERE pii_value IS NOT NULL)"
)
