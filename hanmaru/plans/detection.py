"""Queries of detectors, spans and masking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hanmaru.functions import text as T, validate as V
from hanmaru.functions.lists import FAMILY, LABELS
from hanmaru.operators import detect as D, spans as S
from hanmaru.plans.normalisation import EMAIL, LUHN, PHONE, bank_sql, born, quoted
from hanmaru.sources.sinks import LEAKS, leaks
from hanmaru.sources.readers import composed
from hanmaru.sources.tables import spread, table

KEY = b"example-key"


def documents(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents", "doc_id", "text", "source", "lang")


def mask_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every document with its number of spans and its masked text."""
    return S.guarded(spread(documents(spark, root).select("doc_id", "text"))).select("doc_id", F.size("spans").alias("n_spans"), "blocked", "masked")


def cases(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "hard_cases_v0", "id", "text").where("text is not null").distinct()


def case_spans(spark: SparkSession, root: str) -> DataFrame:
    return S.guarded(cases(spark, root)).select("id", F.explode("spans").alias("s")).select("id", "s.start", "s.end", "s.entity", "s.score", "s.suffix", "s.sentence", "s.composite", "s.risk", "s.action")


#: The tables whose texts the detectors search, each with its key and text.
TEXTS = (("ner_examples", "id", "sentence"), ("hard_cases_v0", "id", "text"), ("analyze_l0_deep", "id", "mutated"))


def searched(spark: SparkSession, root: str) -> DataFrame:
    """(tbl, key, text): distinct rows with a text."""
    frames = [table(spark, root, t, k, c).select(F.lit(t).alias("tbl"), F.col(k).cast("string").alias("key"), F.col(c).alias("text")) for t, k, c in TEXTS]
    return reduce(DataFrame.unionAll, frames).where("text is not null").distinct()


def spans_of(name: str, variants: bool = True):  # type: ignore[no-untyped-def]
    def run(spark: SparkSession, root: str) -> DataFrame:
        found = searched(spark, root).select("tbl", "key", F.explode(D.candidates(F.col("text"), [name], variants)).alias("s"))
        return found.select("tbl", "key", "s.start", "s.end", "s.entity", "s.text", "s.score")

    return run


def variant_set(spark: SparkSession, root: str) -> DataFrame:
    """Variants of the texts by kind, and how many of them have as many characters as their text."""
    rows = searched(spark, root).select("text", F.explode(T.variants(F.col("text"))).alias("v"))
    return rows.groupBy("v.name").agg(F.count("*").alias("n"), F.count_if(F.length("v.text") == F.length("text")).alias("n_as_long"))


def variant_places(spark: SparkSession, root: str) -> DataFrame:
    """Syllables of folded texts led back to their places: how many there are, and how many stand on another syllable (none)."""
    rows = searched(spark, root).select("tbl", "text", F.explode(T.variants(F.col("text"))).alias("v")).where("v.name = 'folded'")
    here = lambda k: F.substring("v.text", k + 1, F.lit(1))
    there = lambda k: T.let(T.original_span(F.col("v.runs"), k, k + 1), lambda p: F.substring("text", p["start"] + 1, p["end"] - p["start"]))
    syllables = F.filter(F.sequence(F.lit(0), F.length("v.text") - 1), lambda k: here(k).rlike("[가-힣]"))
    wrong = F.filter(syllables, lambda k: T.let(there(k), lambda t: t.rlike("^[가-힣]$") & (t != here(k))))
    return rows.where(F.length("v.text") > 0).groupBy("tbl").agg(F.sum(F.size(syllables)).alias("n"), F.sum(F.size(wrong)).alias("n_wrong"))


#: Detectors of what the tables of texts don't hold; they search texts made of the keys of suppliers.
RARE = ("network", "business", "document", "labelled", "secret")


def made_parts(key: Column) -> list[tuple[str | None, Column]]:
    """(type, piece) of a text with an identifier of each rare type; pieces without a type part them."""
    n = key.cast("string")
    wide = lambda k: F.lpad(n, k, "0")
    ninth = F.substring(wide(9), 9, 1).cast("int") * 5
    total = V.weighted(wide(9), V.BUSINESS_WEIGHTS[:8]) + F.floor(ninth / 10).cast("int") + F.pmod(ninth, F.lit(10))
    business = F.concat(F.substring(wide(9), 1, 3), F.lit("-"), F.substring(wide(9), 4, 2), F.lit("-"), F.substring(wide(9), 6, 4), F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))
    text = lambda t: (None, F.lit(t))
    return [
        text("서버 "), ("IP_ADDRESS", F.concat(F.lit("8.8."), F.pmod(key, F.lit(200)).cast("string"), F.lit(".7"))), text(" 안쪽 "), ("IP_ADDRESS", F.concat(F.lit("10.0.0."), F.pmod(key, F.lit(250)).cast("string"))),
        text(" 새 주소 "), ("IP_ADDRESS", F.concat(F.lit("2a00:1450:"), F.lower(F.hex(F.pmod(key, F.lit(4096)) + 1)), F.lit("::8888"))), text(" 장비 "), ("MAC_ADDRESS", F.concat(F.lit("00:1b:44:11:3a:"), F.lower(F.lpad(F.hex(F.pmod(key, F.lit(256))), 2, "0")))),
        text(" 사업자등록번호: "), ("BUSINESS_REG_NO", business), text(" 여권번호: "), ("PASSPORT", F.concat(F.lit("M"), wide(8))), text(" 운전면허번호: "), ("DRIVER_LICENSE", F.concat(F.lit("11-22-"), wide(6), F.lit("-33"))), text(" 법인등록번호 "), ("CORPORATE_REG_NO", F.concat(F.lit("110111-"), wide(7))),
        text(" 환자번호: "), ("MEDICAL_RECORD_NO", F.concat(F.lit("MR-2024-"), wide(6))), text(" 생년월일: "), ("DOB", F.concat(F.lit("19"), F.lpad(F.pmod(key, F.lit(90)).cast("string"), 2, "0"), F.lit("-03-05"))), text(" 기기번호: "), ("DEVICE_ID", F.concat(F.lit("device-ab"), wide(8))),
        text(" 차량번호: "), ("VEHICLE_REG_NO", F.concat(F.lit("12가"), wide(4))), text(" 열쇠 "), ("API_KEY_SECRET", F.concat(F.lit("sk-aB3dE5fG7hJ9kL2m"), n)), text(" 끝 "), (None, wide(8)),
    ]


def made_texts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("key"), F.concat(*(piece for _, piece in made_parts(F.col("s_suppkey")))).alias("text"))


def rare_detectors(spark: SparkSession, root: str) -> DataFrame:
    """What the detectors of rare identifiers find in texts that hold one of each type and a number without a label."""
    found = made_texts(spark, root).select("key", F.explode(D.candidates(F.col("text"), list(RARE))).alias("s"))
    return found.select("key", "s.start", "s.end", "s.entity", "s.text")


def pattern_only(spark: SparkSession, root: str) -> DataFrame:
    """What patterns alone find, by type: the base line for the validators."""
    found = searched(spark, root).select("tbl", F.explode(D.by_pattern(F.col("text"))).alias("s"))
    return found.groupBy("tbl", "s.entity").agg(F.count("*").alias("n"))


def entity_counts(spark: SparkSession, root: str) -> DataFrame:
    found = documents(spark, root).select("lang", F.explode(D.candidates(F.col("text"), list(D.STRUCTURED))).alias("s"))
    return found.groupBy("lang", "s.entity").agg(F.count("*").alias("n"))


def email_documents(spark: SparkSession, root: str) -> DataFrame:
    """Addresses of the sentences of ner_examples as they are, and where they stand; weak_examples isn't read."""
    texts = table(spark, root, "ner_examples", "id", "sentence").select("id", F.col("sentence").alias("text")).where("text is not null")
    return texts.select("id", F.explode(D.candidates(F.col("text"), ["email"], variants=False)).alias("s")).select("id", F.col("s.text").alias("address"), "s.start")


def audit_events(spark: SparkSession, root: str) -> DataFrame:
    return S.audit(S.guarded(cases(spark, root)), "id", KEY)


def leak_scan(spark: SparkSession, root: str) -> DataFrame:
    """Which patterns occur in texts, by name."""
    rows = table(spark, root, "weak_examples", "id", "sentence").where("sentence is not null")
    return rows.select("id", F.explode(leaks(F.col("sentence"))).alias("pattern"))


def islands(spark: SparkSession, root: str) -> DataFrame:
    """Components of overlapping intervals: each found e-mail address or number widened by forty characters to both sides."""
    wide = located(spark, root).select("doc_id", F.greatest(F.col("start") - 40, F.lit(0)).alias("start"), (F.col("end") + 40).alias("end"))
    return S.islands(wide).groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def located(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, start, end, value): runs of three or more digits of documents."""
    return documents(spark, root).where("text is not null").select("doc_id", F.explode(T.pieces(F.col("text"), "[0-9]{3,}")).alias("p")).select("doc_id", "p.start", "p.end", F.col("p.text").alias("value"))


def numbering(spark: SparkSession, root: str) -> DataFrame:
    """Placeholder numbers of reviewed values: families count in order of first appearance, equal values share a number."""
    rows = reviewed(spark, root)
    family = S.mapped(F.col("l.entity_type"), FAMILY, F.col("l.entity_type"))
    spans = rows.select("id", "text", F.explode("labels").alias("l")).select("id", F.col("l.start_pos").alias("start"), family.alias("family"), F.substring("text", F.col("l.start_pos") + 1, F.col("l.end_pos") - F.col("l.start_pos")).alias("value"))
    first = F.min("start").over(Window.partitionBy("id", "family", "value"))
    return spans.withColumn("first", first).select("id", "start", F.concat_ws("_", "family", F.dense_rank().over(Window.partitionBy("id", "family").orderBy("first")).cast("string")).alias("token"))


def reviewed(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "hard_cases_v0", "id", "text", "labels", "expected_masked_text").where("labels is not null and text is not null").dropDuplicates(["id"])


def mask_reviewed(spark: SparkSession, root: str) -> DataFrame:
    """Reviewed cases masked by their labels: placeholders and splicing alone, the finding apart."""
    span = lambda l: F.struct(l["start_pos"].alias("start"), l["end_pos"].alias("end"), F.substring("text", l["start_pos"] + 1, l["end_pos"] - l["start_pos"]).alias("text"), l["entity_type"].alias("entity"), F.lit("MASK").alias("action"), F.lit("label_mask").alias("method"))
    spans = F.array_sort(F.transform("labels", span), lambda a, b: D.compare([(a["start"], b["start"], 1)]))
    return reviewed(spark, root).withColumn("spans", spans).select("id", S.masked(F.col("text"), F.col("spans")).alias("masked"))


def redacted(spark: SparkSession, root: str) -> DataFrame:
    """Reviewed cases with every label redacted in full, or hashed: the lengths that are left."""
    span = lambda method: lambda l: F.struct(l["start_pos"].alias("start"), l["end_pos"].alias("end"), F.substring("text", l["start_pos"] + 1, l["end_pos"] - l["start_pos"]).alias("text"), l["entity_type"].alias("entity"), F.lit("MASK").alias("action"), F.lit(method).alias("method"))
    spans = lambda method: F.array_sort(F.transform("labels", span(method)), lambda a, b: D.compare([(a["start"], b["start"], 1)]))
    out = lambda method: S.masked(F.col("text"), spans(method))
    return reviewed(spark, root).select("id", out("full_redact").alias("redacted"), F.length(out("hmac_hash")).alias("n_hashed"))


def stages(spark: SparkSession, root: str) -> DataFrame:
    """How many spans are left after each stage of the pipeline."""
    done = S.guarded(cases(spark, root), trace=True)
    return done.select(F.explode("trace").alias("t")).groupBy("t.stage").agg(F.sum("t.n").alias("n"))


def reasons(spark: SparkSession, root: str) -> DataFrame:
    """Reason codes of the decided spans, by type and action."""
    done = S.guarded(cases(spark, root)).select(F.explode("spans").alias("s"))
    return done.select("s.entity", "s.action", F.explode("s.reasons").alias("reason")).groupBy("entity", "action", "reason").agg(F.count("*").alias("n"))


def public_spans(spark: SparkSession, root: str) -> DataFrame:
    return S.public(S.guarded(cases(spark, root)), "id").select("id", F.explode("spans").alias("s")).select("id", "s.start", "s.end", "s.entity", "s.action", "s.value_hash")


def hashed(spark: SparkSession, root: str) -> DataFrame:
    """Texts for the audit log: every span is a keyed hash."""
    return S.guarded(cases(spark, root), target="audit_log").select("id", "masked", F.size("spans").alias("n"))


def outgoing(spark: SparkSession, root: str) -> DataFrame:
    return S.outgoing(cases(spark, root), "text").select("id", "shown", "blocked")


def storable(spark: SparkSession, root: str) -> DataFrame:
    """Masked texts without any found value, and how many values are left in them: none."""
    done = S.guarded(cases(spark, root)).withColumn("safe", S.storable(F.col("masked"), F.col("text"), F.col("spans")))
    return done.where("safe is not null").select("id", F.size(F.filter("spans", lambda s: F.col("safe").contains(s["text"]))).alias("n_left"))


def summaries(spark: SparkSession, root: str) -> DataFrame:
    """Gazetteer records composed of three fields, and what is found in each field."""
    rows = composed(table(spark, root, "gazetteers", "id", "entity_type", "entry_value", "source"), ["entity_type", "entry_value", "source"])
    done = S.guarded(rows, detectors=list(D.STRUCTURED))
    return done.select("id", S.field_summary(F.col("fields"), F.col("spans")).alias("summary"))


def masked_conversations(spark: SparkSession, root: str) -> DataFrame:
    """Messages masked one by one; a conversation (a source's sentences of a day) is blocked if a message of it is."""
    rows = table(spark, root, "ner_examples", "id", "source", "sentence", "collected_at").where("sentence is not null")
    done = S.guarded(rows.select("source", F.col("collected_at").cast("date").alias("day"), "id", F.col("sentence").alias("text")))
    return done.groupBy("source", "day").agg(F.count("*").alias("n_messages"), F.bool_or("blocked").alias("blocked"), F.count_if(F.col("masked") != F.col("text")).alias("n_masked"))


RAW = ("registration", "phone", "card", "account")
QUERIES = {
    "mask_documents": mask_documents, "case_spans": case_spans, "entity_counts_by_lang": entity_counts, "email_spans": email_documents, "audit_events": audit_events, "leak_scan": leak_scan, "overlap_islands": islands,
    "placeholder_numbering": numbering, "chat_mask": masked_conversations, **{f"{name}_detector": spans_of(name) for name in (*D.STRUCTURED, *D.DICTIONARY) if name not in RARE}, **{f"{name}_plain": spans_of(name, False) for name in RAW},
    "variant_set": variant_set, "variant_places": variant_places, "pattern_only": pattern_only, "rare_detectors": rare_detectors, "mask_reviewed": mask_reviewed, "mask_redacted": redacted, "span_stages": stages, "span_reasons": reasons, "public_spans": public_spans, "mask_hashed": hashed,
    "mask_outgoing": outgoing, "mask_storable": storable, "field_summary": summaries,
}
MAIL = "[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
LABELLED = "WITH h AS (SELECT DISTINCT ON (id) * FROM hard_cases_v0 WHERE labels IS NOT NULL AND text IS NOT NULL), l AS (SELECT id, text, unnest(labels, recursive := true) FROM h), "
FAMILIES = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILY.items()) + " ELSE entity_type END"
SEARCHED = " UNION ".join(f"SELECT '{t}' AS tbl, CAST({k} AS VARCHAR) AS key, {c} AS t FROM {t} WHERE {c} IS NOT NULL" for t, k, c in TEXTS)


def scan_sql(pattern: str, not_before: str, behind: str, entity: str, score: str) -> str:
    """Matches of a pattern at every place, from left to right without overlaps, under the conditions of a detector.

    The SQL knows no look-around: what must not stand before is looked at in the text, what may stand behind is captured.
    """
    return (
        f"WITH x AS ({SEARCHED}), p AS (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM x WHERE regexp_matches(t, '[0-9]')), "
        f"m AS (SELECT tbl, key, t, i, regexp_extract(substring(t, CAST(i AS INT)), '^({pattern})({behind}|$)', 1) AS v FROM p WHERE i = 1 OR NOT regexp_matches(substring(t, CAST(i - 1 AS INT), 1), '{not_before}')), "
        "k AS (SELECT * FROM (SELECT *, max(i + length(v)) OVER (PARTITION BY tbl, key, t ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM m WHERE v <> '') WHERE upto IS NULL OR i >= upto), "
        "d AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM k), "
        f"e AS (SELECT *, {entity} AS entity FROM d) "
        f"SELECT tbl, key, CAST(i - 1 AS INT) AS \"start\", CAST(i - 1 + length(v) AS INT) AS \"end\", entity, v AS text, CAST({score} AS DOUBLE) AS score FROM e WHERE entity IS NOT NULL"
    )


def before_sql(group: str) -> str:
    """Whether a label of a group stands right before place i."""
    n = D.WINDOW.get(group, 64)
    terms = "|".join("\\s*".join(w for w in term.split()) for term in sorted(LABELS[group], key=len, reverse=True))
    return f"regexp_matches(substring(t, CAST(greatest(i - {n}, 1) AS INT), CAST(least(i - 1, {n}) AS INT)), '(?i)(?:{terms})\\s*(?::|#|-|은|는|이|가)?\\s*$')"


def account_field_sql() -> str:
    terms = "|".join("\\s*".join(w for w in term.split()) for term in LABELS["account"])
    return f"regexp_matches(regexp_extract(substring(t, CAST(greatest(i - 64, 1) AS INT), CAST(least(i - 1, 64) AS INT)), '[^\\n\\r,;.|]*$'), '(?i)(?:{terms})')"


def made_sql() -> str:
    """The identifiers of made_parts() and where each must be found."""
    wide = lambda n: f"lpad(CAST(k AS VARCHAR), {n}, '0')"
    digit = lambda i: f"CAST(substring({wide(9)}, {i}, 1) AS INT)"
    total = " + ".join(f"{w} * {digit(i + 1)}" for i, w in enumerate(V.BUSINESS_WEIGHTS[:8])) + f" + {digit(9)} * 5 // 10 + {digit(9)} * 5 % 10"
    pieces = [
        "'서버 '", ("IP_ADDRESS", "'8.8.' || k % 200 || '.7'"), "' 안쪽 '", ("IP_ADDRESS", "'10.0.0.' || k % 250"), "' 새 주소 '", ("IP_ADDRESS", "'2a00:1450:' || lower(to_hex(k % 4096 + 1)) || '::8888'"), "' 장비 '", ("MAC_ADDRESS", "'00:1b:44:11:3a:' || lpad(lower(to_hex(k % 256)), 2, '0')"),
        "' 사업자등록번호: '", ("BUSINESS_REG_NO", f"substring({wide(9)}, 1, 3) || '-' || substring({wide(9)}, 4, 2) || '-' || substring({wide(9)}, 6, 4) || (10 - ({total}) % 10) % 10"), "' 여권번호: '", ("PASSPORT", f"'M' || {wide(8)}"), "' 운전면허번호: '", ("DRIVER_LICENSE", f"'11-22-' || {wide(6)} || '-33'"),
        "' 법인등록번호 '", ("CORPORATE_REG_NO", f"'110111-' || {wide(7)}"), "' 환자번호: '", ("MEDICAL_RECORD_NO", f"'MR-2024-' || {wide(6)}"), "' 생년월일: '", ("DOB", "'19' || lpad(CAST(k % 90 AS VARCHAR), 2, '0') || '-03-05'"), "' 기기번호: '", ("DEVICE_ID", f"'device-ab' || {wide(8)}"),
        "' 차량번호: '", ("VEHICLE_REG_NO", f"'12가' || {wide(4)}"), "' 열쇠 '", ("API_KEY_SECRET", "'sk-aB3dE5fG7hJ9kL2m' || k"),
    ]
    out, before = [], []
    for piece in pieces:
        value = piece if isinstance(piece, str) else piece[1]
        if not isinstance(piece, str):
            at = " + ".join(f"length({b})" for b in before)
            # A number without a check digit fails its validator, whatever stands before it.
            valid = " AND NOT regexp_full_match(regexp_replace(" + value + ", '[^0-9]', '', 'g'), '0*')" if piece[0] == "BUSINESS_REG_NO" else ""
            if piece[0] == "MEDICAL_RECORD_NO":  # its ten digits may pass the check of business numbers
                d = f"('2024' || {wide(6)})"
                n = lambda i: f"CAST(substring({d}, {i}, 1) AS INT)"
                sum_ = " + ".join(f"{w} * {n(i + 1)}" for i, w in enumerate(V.BUSINESS_WEIGHTS[:8])) + f" + {n(9)} * 5 // 10 + {n(9)} * 5 % 10"
                out.append(f"SELECT k, CAST({at} + 3 AS INT), CAST({at} + 14 AS INT), 'BUSINESS_REG_NO', '2024-' || {wide(6)} FROM s WHERE (10 - ({sum_}) % 10) % 10 = {n(10)}")
            out.append(f"SELECT k AS key, CAST({at} AS INT) AS \"start\", CAST({at} + length({value}) AS INT) AS \"end\", '{piece[0]}' AS entity, {value} AS text FROM s WHERE true{valid}")
        before.append(value)
    return "WITH s AS (SELECT s_suppkey AS k FROM supplier) " + " UNION ALL ".join(out)


PHONE_KIND = PHONE.format(d="d")
ORACLES = {
    "rare_detectors": made_sql(),
    "email_spans": f"WITH m AS (SELECT id, sentence, unnest(regexp_extract_all(sentence, '{MAIL}')) AS address, generate_subscripts(regexp_extract_all(sentence, '{MAIL}'), 1) AS k FROM ner_examples WHERE sentence IS NOT NULL), "
    f"b AS (SELECT id, address, k, sum(length(address)) OVER (PARTITION BY id ORDER BY k) - length(address) AS before, string_split_regex(sentence, '{MAIL}') AS parts FROM m) "
    f"SELECT id, address, CAST(before + list_sum([length(x) FOR x IN parts[1:k]]) AS INT) AS start FROM b WHERE {EMAIL.format(v='address')}",
    "leak_scan": " UNION ALL ".join(f"SELECT id, '{name}' AS pattern FROM weak_examples WHERE regexp_matches(sentence, {quoted(p)})" for name, p in LEAKS.items()),
    "overlap_islands": "WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '[0-9]{3,}') AS v, string_split_regex(text, '[0-9]{3,}') AS g FROM documents WHERE text IS NOT NULL), "
    "u AS (SELECT doc_id, v, g, unnest(range(1, len(v) + 1)) AS k FROM p WHERE len(v) > 0), s AS (SELECT doc_id, list_sum([length(x) FOR x IN g[1:k]]) + coalesce(list_sum([length(x) FOR x IN v[1:k - 1]]), 0) AS a, length(v[k]) AS n FROM u), "
    "w AS (SELECT doc_id, greatest(a - 40, 0) AS \"start\", a + n + 40 AS \"end\" FROM s), o AS (SELECT *, CASE WHEN \"start\" < max(\"end\") OVER (PARTITION BY doc_id ORDER BY \"start\", \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM w), "
    "i AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY \"start\", \"end\" ROWS UNBOUNDED PRECEDING) AS island FROM o) SELECT doc_id, CAST(island AS BIGINT) AS island, CAST(min(\"start\") AS INT) AS \"start\", CAST(max(\"end\") AS INT) AS \"end\", count(*) AS n FROM i GROUP BY doc_id, island",
    "placeholder_numbering": LABELLED + f"v AS (SELECT id, start_pos AS \"start\", {FAMILIES} AS family, substring(text, start_pos + 1, end_pos - start_pos) AS value FROM l), f AS (SELECT *, min(\"start\") OVER (PARTITION BY id, family, value) AS first FROM v) "
    "SELECT id, \"start\", family || '_' || dense_rank() OVER (PARTITION BY id, family ORDER BY first) AS token FROM f",
    "mask_reviewed": "SELECT DISTINCT ON (id) id, expected_masked_text AS masked FROM hard_cases_v0 WHERE labels IS NOT NULL AND text IS NOT NULL",
    "mask_redacted": LABELLED + "o AS (SELECT id, text, start_pos AS a, end_pos AS b, coalesce(lag(end_pos) OVER (PARTITION BY id ORDER BY start_pos), 0) AS upto FROM l), "
    f"r AS (SELECT id, any_value(text) AS text, string_agg(substring(text, CAST(upto AS INT) + 1, a - upto) || '{S.REDACTED}', '' ORDER BY a) AS head, max(b) AS last, CAST(sum(b - a) AS BIGINT) AS n, count(*) AS k FROM o GROUP BY id) "
    f"SELECT h.id, coalesce(head || substring(h.text, CAST(last AS INT) + 1), h.text) AS redacted, CAST(length(h.text) - coalesce(n, 0) + coalesce(k, 0) * {len('hmac-sha256:' + S.KEY_ID + ':') + 64} AS INT) AS n_hashed FROM h LEFT JOIN r USING (id)",
    "registration_plain": scan_sql("[0-9]{6}\\s*-?\\s*[0-9]{7}", "[0-9]", "[^0-9]", f"CASE WHEN {before_sql('corporate')} AND NOT {before_sql('personal')} THEN NULL WHEN {born('d', False)} THEN 'RRN' WHEN {born('d', True)} THEN 'FRN' END", "0.98"),
    "phone_plain": scan_sql("0[0-9]{1,2}[\\s-]?[0-9]{3,4}[\\s-]?[0-9]{4}", "[0-9]", "[^0-9]", f"CASE WHEN NOT {before_sql('order')} THEN {PHONE_KIND} END", "CASE entity WHEN 'PHONE_MOBILE' THEN 0.94 ELSE 0.9 END"),
    "card_plain": scan_sql("(?:[0-9][\\s-]?){13,19}", "[0-9]", "[^0-9]", f"CASE WHEN {LUHN.format(d='d')} AND NOT ({before_sql('corporate')} OR {before_sql('business')} OR {before_sql('order')} OR {account_field_sql()}) THEN 'CREDIT_CARD' END", "0.96"),
    "account_plain": scan_sql("[0-9]{2,6}(?:[- ][0-9]{1,7}){1,4}", "[0-9]", "[^0-9]", f"CASE WHEN regexp_matches(v, '[- ]') AND ({bank_sql('v')}) IS NOT NULL AND ({PHONE_KIND}) IS NULL AND NOT {before_sql('order')} THEN 'BANK_ACCOUNT' END", "0.42"),
}
