"""Queries of evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hanmaru.operators import detect as D, evaluate as E, spans as S, tagging
from hanmaru.plans.normalisation import FOLD
from hanmaru.sources.tables import table

LAYER, OTHERS = "layer0", ("ner_span", "cloud_dlp", "prompt_guard")


def results(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "analyze_l0_deep", "id", "pii_type", "pii_value", "mutation_level", "mutation_name", "mutated", "lang", "validity_group", "any_detected", "detected_by", "layer_results", "total_latency_ms")


def cases(spark: SparkSession, root: str) -> DataFrame:
    return E.classified(results(spark, root))


def classify_cases(spark: SparkSession, root: str) -> DataFrame:
    return cases(spark, root).select("id", "outcome")


def miss_table(spark: SparkSession, root: str) -> DataFrame:
    """Bypassed cases by mutation and level, most first."""
    missed = cases(spark, root).where("outcome = 'BYPASS'")
    return missed.groupBy("mutation_name", "mutation_level").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "mutation_name", "mutation_level")


def ablation(spark: SparkSession, root: str) -> DataFrame:
    """Share of TRUE outcomes as layers are added one after the other."""
    rows = results(spark, root).dropDuplicates(["id"])
    layers = [LAYER, *OTHERS]
    true = lambda names: E.outcome(F.col("layer_results"), F.col("pii_value"), F.col("mutated"), names) == "TRUE"
    counted = rows.agg(F.count("*").alias("n"), *(F.count_if(true(layers[: k + 1])).alias(f"c{k}") for k in range(len(layers))))
    stages = F.array(*(F.struct(F.lit(k + 1).alias("n_layers"), F.lit("+".join(layers[: k + 1])).alias("layers"), F.round(100 * F.col(f"c{k}") / F.col("n"), 2).alias("true_rate")) for k in range(len(layers))))
    return counted.select(F.inline(stages))


def smart_skip(spark: SparkSession, root: str) -> DataFrame:
    """If the last layer were asked only where the others miss: calls needed, cases recovered, calls saved."""
    rows = results(spark, root).dropDuplicates(["id"])
    true = lambda names: E.outcome(F.col("layer_results"), F.col("pii_value"), F.col("mutated"), names) == "TRUE"
    first, last = true([LAYER, "ner_span", "cloud_dlp"]), true(["prompt_guard"])
    return rows.agg(F.count("*").alias("n"), F.count_if(~first).alias("needed"), F.count_if(~first & last).alias("recovered"), F.round(100 * F.count_if(first) / F.count("*"), 2).alias("saved"))


def nearest_rank_latency(spark: SparkSession, root: str) -> DataFrame:
    """Nearest-rank quantiles per layer. Latencies are counted first, so no layer's values gather in one array."""
    from pyspark.sql import Window

    rows = results(spark, root).dropDuplicates(["id"]).select(F.explode("layer_results").alias("x")).select("x.layer", "x.latency_ms").where("latency_ms is not null")
    counts = rows.groupBy("layer", "latency_ms").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("layer").orderBy("latency_ms"))
    ranked = counts.withColumn("upto", upto).withColumn("total", F.sum("n").over(Window.partitionBy("layer")))
    at = lambda q: F.min(F.when(F.col("upto") > F.bround(F.lit(q) * (F.col("total") - 1), 0), F.col("latency_ms")))
    return ranked.groupBy("layer").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


def target_hits(spark: SparkSession, root: str) -> DataFrame:
    """Per layer name: cases it is said to have detected, and among them those whose value is gone."""
    rows = cases(spark, root).select("outcome", F.explode("detected_by").alias("layer"))
    return rows.groupBy("layer").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "TRUE").alias("n_true"))


def text_lengths(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "documents", "source", "lang", "text").where("text is not null")
    return rows.groupBy("source", "lang").agg(F.count("*").alias("n"), F.min(F.length("text")).alias("least"), F.max(F.length("text")).alias("most"), F.round(F.avg(F.length("text")), 2).alias("mean"))


def gold(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "hard_cases_v0", "id", "text", "expected_masked_text", "labels", "tags").where("labels is not null and text is not null").dropDuplicates(["id"])
    kind = lambda x: F.struct(x["start_pos"].alias("start"), x["end_pos"].alias("end"), x["entity_type"].alias("entity"), x["risk_level"].alias("risk"), x["suffix"].alias("suffix"))
    return rows.withColumn("gold", F.transform("labels", kind)).withColumn("ambiguous", F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, E.AMBIGUOUS))))


def plain(spans: str, acting: bool = False) -> Column:
    """Places and types of spans, of those that are acted on if asked for."""
    some = F.filter(spans, lambda s: s["action"] != "PASS") if acting else F.col(spans)
    return F.transform(some, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity"].alias("entity")))


def judged(spark: SparkSession, root: str) -> DataFrame:
    return E.judged_matches(S.guarded(gold(spark, root)), "id", "gold", "spans", "tags", "ambiguous")


def entity_prf(spark: SparkSession, root: str) -> DataFrame:
    done = S.guarded(gold(spark, root)).select("id", "gold", plain("spans").alias("predicted"))
    return E.entity_metrics(E.matched(done, "id", "gold", "predicted"))


def actionable_prf(spark: SparkSession, root: str) -> DataFrame:
    """As entity_prf, but only spans that are acted on count."""
    done = S.guarded(gold(spark, root)).select("id", "gold", plain("spans", True).alias("predicted"))
    return E.entity_metrics(E.matched(done, "id", "gold", "predicted"))


def failure_rows(spark: SparkSession, root: str) -> DataFrame:
    """What went wrong and how, without text or places."""
    return judged(spark, root).where("failure is not null").select("id", "failure", "entity", "kind", (F.col("end") - F.col("start")).alias("span_length"))


def high_risk(spark: SparkSession, root: str) -> DataFrame:
    """Recall of labels of either high risk, of all predictions and of those that are acted on."""
    rows = judged(spark, root).where("kind <> 'spurious' and risk in ('P0', 'P1')")
    hit = F.col("kind") != "miss"
    return rows.groupBy("risk").agg(F.count("*").alias("n"), F.round(E.recall(hit, F.lit(True)), 4).alias("recall"), F.round(E.recall(hit & F.col("action").isin(*E.ACTING), F.lit(True)), 4).alias("acting_recall"))


def residual_risk(spark: SparkSession, root: str) -> DataFrame:
    """By type: labels missed, found but let pass, and predictions without a label that are acted on."""
    acted = F.col("action").isin(*E.ACTING)
    return judged(spark, root).groupBy("entity").agg(
        F.count_if(F.col("kind") == "miss").alias("n_missed"), F.count_if(F.col("kind").isin("exact", "partial") & ~acted).alias("n_passed"), F.count_if((F.col("kind") == "spurious") & acted).alias("n_surplus"), F.count_if(F.col("kind") == "partial").alias("n_wrong_bounds"),
    )


def gate_table(spark: SparkSession, root: str) -> DataFrame:
    done = S.guarded(gold(spark, root))
    bad = F.size(F.filter("spans", lambda s: F.substring("text", s["start"] + 1, s["end"] - s["start"]) != s["text"]))
    raw = F.size(F.filter("spans", lambda s: s["action"].isin(*E.ACTING) & F.exists(s["reasons"], lambda r: r.contains(s["text"]))))
    cases_ = done.select("ambiguous", raw.alias("n_raw"), bad.alias("n_invalid"))
    return E.gates(E.gate_values(judged(spark, root), cases_), E.GATES)


def bucket_report(spark: SparkSession, root: str) -> DataFrame:
    """Counts of matches by tag of the case, and over all (null tag)."""
    rows = judged(spark, root).withColumn("tag", F.explode_outer(F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))))
    count = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return rows.groupBy("tag").agg(F.countDistinct("id").alias("n_cases"), count("exact", "partial").alias("tp"), count("miss").alias("fn"), count("spurious").alias("fp"))


def ablation_stages(spark: SparkSession, root: str) -> DataFrame:
    """Precision, recall and F1 over all types as stages are added: patterns, validators, dictionaries, boundaries, tagger, context."""
    rows, text = gold(spark, root).select("id", "text", "gold"), F.col("text")
    tagger = tagging.tagged(rows.select("id", "text"), "id", "text", tagging.literal_backend(LITERALS)).groupBy("id").agg(F.collect_list(F.struct("start", "end", "entity", "score")).alias("tags_"))
    rows = rows.join(tagger, "id", "left")
    extra = F.transform(F.coalesce("tags_", F.array().cast("array<struct<start:int,end:int,entity:string,score:double>>")), lambda x: F.struct(
        x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), F.substring("text", x["start"].cast("int") + 1, (x["end"] - x["start"]).cast("int")).alias("text"), x["entity"].alias("entity"), x["score"].alias("score"), F.lit("tagger").alias("detector")
    )).cast(D.SPAN)
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity"].alias("entity")))
    steps = rows.withColumn("a", D.by_pattern(text)).withColumn("b", D.candidates(text, list(D.STRUCTURED))).withColumn("c", D.candidates(text)).withColumn("d", S.corrected(text, F.col("c")))
    steps = steps.withColumn("e", S.corrected(text, D.fold(F.concat("c", extra)))).withColumn("f", S.scored(text, F.col("e"))).withColumn("f", S.resolved(S.suppressed(F.col("f"))))
    stages = [("A", "patterns", "a"), ("B", "validators", "b"), ("C", "dictionaries", "c"), ("D", "boundaries", "d"), ("E", "tagger", "e"), ("F", "context", "f")]
    found = steps.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("stage"), F.lit(name).alias("adds"), E.matches(F.col("gold"), bare(F.col(c))).alias("m")) for k, name, c in stages))).alias("x")).select("x.stage", "x.adds", F.explode("x.m").alias("m"))
    hit, miss, wrong = (F.count_if(F.col("m.kind").isin(*k)) for k in (("exact", "partial"), ("miss",), ("spurious",)))
    counts = found.groupBy("stage", "adds").agg(hit.alias("tp"), wrong.alias("fp"), miss.alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", F.round(p, 4)).withColumn("recall", F.round(r, 4)).withColumn("f1", F.round(ratio(2 * p * r, p + r), 4))


LITERALS = {"이하나": 0.85, "김민수": 0.85, "상담원": 0.65}


def name_actions(spark: SparkSession, root: str) -> DataFrame:
    """What is done about names: candidates, how many match a label, by action, risk and the reason of the decision."""
    rows = judged(spark, root).where("entity = 'PERSON_NAME'")
    return rows.groupBy("kind", F.coalesce("action", F.lit("none")).alias("action")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_cases"))


def detector_shares(spark: SparkSession, root: str) -> DataFrame:
    """What each detector gives over all cases: spans, cases, and of the spans those that are acted on."""
    rows = table(spark, root, "hard_cases_v0", "id", "text").where("text is not null").distinct()
    found = S.guarded(rows).select("id", F.explode("spans").alias("s")).select("id", "s.action", F.explode(F.split("s.detector", ",")).alias("detector"))
    return found.groupBy("detector").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_cases"), F.count_if(F.col("action") != "PASS").alias("n_acting"))


def safety(spark: SparkSession, root: str) -> DataFrame:
    """Values that would show: in public spans, audit events, masked texts and their stored forms. All counts must be 0."""
    rows = table(spark, root, "hard_cases_v0", "id", "text").where("text is not null").distinct()
    done = S.guarded(rows)
    acted = F.transform(F.filter("spans", lambda s: s["action"].isin(*E.ACTING)), lambda s: s["text"])
    shows = lambda df, text: df.agg(F.coalesce(F.sum(F.size(F.filter("values", lambda v: (F.length(v) > 0) & text.contains(v)))), F.lit(0)).alias("n"))
    kept = done.withColumn("values", acted)
    public = S.public(done, "id").select("id", F.to_json("spans").alias("shown")).join(kept.select("id", "values"), "id")
    events = S.audit(done, "id").select("id", F.to_json(F.struct("id", "entity", "action", "risk", "detector", "reasons", "value_hash")).alias("shown")).join(kept.select("id", "values"), "id")
    stored = kept.where("masked is not null").withColumn("shown", S.storable(F.col("masked"), F.col("text"), F.col("spans")))
    parts = [("public", public), ("audit", events), ("stored", stored)]
    return reduce(DataFrame.unionAll, [shows(df, F.col("shown")).select(F.lit(name).alias("part"), "n") for name, df in parts])


def exact_mask_rate(spark: SparkSession, root: str) -> DataFrame:
    done = S.guarded(gold(spark, root)).where("expected_masked_text is not null")
    return done.agg(F.count("*").alias("n"), F.count_if(F.col("masked") == F.col("expected_masked_text")).alias("n_equal"))


def layer_ablation(spark: SparkSession, root: str) -> DataFrame:
    """TRUE rates of the other layers alone and with the first one, over all and by slice."""
    rows = results(spark, root).dropDuplicates(["id"])
    true = lambda names: (E.outcome(F.col("layer_results"), F.col("pii_value"), F.col("mutated"), names) == "TRUE").cast("int")
    rows.select("lang", "validity_group", "mutation_level", "pii_type", true(OTHERS).alias("alone"), true([LAYER, *OTHERS]).alias("together")).createOrReplaceTempView("hanmaru_ablation")
    keys = ", ".join(E.SLICES)
    return spark.sql(f"SELECT grouping_id({keys}) AS slice, {keys}, count(*) AS n, round(100 * avg(alone), 2) AS alone, round(100 * avg(together), 2) AS together FROM hanmaru_ablation GROUP BY GROUPING SETS ((), {', '.join(f'({x})' for x in E.SLICES)}, (lang, validity_group))")


def layers_together(spark: SparkSession, root: str) -> DataFrame:
    """Cases that all layers have answered without an error, joined by id: how many by the pattern of those that neutralised the value."""
    rows = results(spark, root).dropDuplicates(["id"]).select("id", "pii_value", "mutated", F.explode(E.usable(F.col("layer_results"))).alias("x"))
    hits = rows.groupBy("id", F.col("x.layer").alias("layer")).agg(F.max(E.neutralised(F.col("x"), F.col("pii_value"), F.col("mutated")).cast("int")).alias("hit"))
    frames = [hits.where(F.col("layer") == name).select("id", F.coalesce("hit", F.lit(0)).cast("string").alias(f"h{k}")) for k, name in enumerate((LAYER, *OTHERS))]
    joined = reduce(lambda a, b: a.join(b, "id"), frames)
    return joined.groupBy(F.concat(*(f"h{k}" for k in range(4))).alias("pattern")).agg(F.count("*").alias("n"))


def end_to_end(spark: SparkSession, root: str) -> DataFrame:
    """Latency over all layers, of the cases in which every layer has one."""
    rows = results(spark, root).dropDuplicates(["id"]).select("id", F.explode("layer_results").alias("x")).where("x.latency_ms is not null")
    total = rows.groupBy("id").agg(F.sum("x.latency_ms").alias("ms"), F.countDistinct("x.layer").alias("n")).where(F.col("n") == 1 + len(OTHERS))
    q = lambda p: F.percentile("ms", F.lit(p)).cast("int")
    return total.agg(F.count("*").alias("n"), F.min("ms").alias("least"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.max("ms").alias("most"), F.round(F.avg("ms"), 1).alias("mean"))


def folded_survivors(spark: SparkSession, root: str) -> DataFrame:
    """Layer outputs in which the value still stands: as it is, and with digits folded."""
    rows = results(spark, root).dropDuplicates(["id"]).select("pii_value", F.explode("layer_results").alias("x")).where("x.output is not null and pii_value is not null")
    there = lambda folded: F.count_if(E.still_there(F.col("pii_value"), F.col("x.output"), folded))
    return rows.groupBy(F.col("x.layer").alias("layer")).agg(F.count("*").alias("n"), there(False).alias("n_there"), there(True).alias("n_folded"))


def test_statistics(spark: SparkSession, root: str) -> DataFrame:
    """The paired test of two sets of layers with its p value."""
    return E.mcnemar(results(spark, root), OTHERS, [LAYER, *OTHERS[:1]]).withColumn("p", F.round(E.tail_probability(F.col("chi2")), 6))


def fuzzer_stats(spark: SparkSession, root: str) -> DataFrame:
    """Cases by each of six groupings, in one pass."""
    rows = results(spark, root).dropDuplicates(["id"]).join(table(spark, root, "analyze_l0_deep", "id", "name_tier").dropDuplicates(["id"]), "id")
    keys = ("pii_type", "mutation_level", "mutation_name", "lang", "name_tier", "validity_group")
    kinds = F.array(*(F.struct(F.lit(k).alias("grouping"), F.col(k).cast("string").alias("value")) for k in keys))
    return rows.select(F.explode(kinds).alias("x")).groupBy("x.grouping", "x.value").agg(F.count("*").alias("n"))


def gold_counts(spark: SparkSession, root: str) -> DataFrame:
    rows = gold(spark, root).select("id", F.explode("labels").alias("l"))
    return rows.groupBy(F.col("l.entity_type").alias("entity"), F.col("l.risk_level").alias("risk")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_cases"))


def count_maps(spark: SparkSession, root: str) -> DataFrame:
    """Counts of layers that detected, kept as maps per mutation and merged again over all."""
    rows = results(spark, root).dropDuplicates(["id"]).select(F.coalesce("mutation_name", F.lit("none")).alias("m"), F.explode("detected_by").alias("layer"))
    maps = rows.groupBy("m", "layer").agg(F.count("*").alias("n")).groupBy("m").agg(F.map_from_entries(F.collect_list(F.struct("layer", "n"))).alias("counts"))
    return maps.select(F.explode("counts").alias("layer", "n")).groupBy("layer").agg(F.sum("n").alias("n"))


def clean_findings(spark: SparkSession, root: str) -> DataFrame:
    """What the detectors of identifiers find in public documents, by type: documents and findings."""
    found = table(spark, root, "documents", "doc_id", "text").select("doc_id", F.explode(D.candidates(F.col("text"), list(D.STRUCTURED))).alias("s"))
    return found.groupBy("s.entity").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n"))


QUERIES = {
    "classify_cases": classify_cases, "slice_grouping_sets": lambda s, d: E.sliced(cases(s, d)), "hardest_types": lambda s, d: E.hardest(cases(s, d)), "miss_table": miss_table, "layer_catch": lambda s, d: E.by_layer(results(s, d)),
    "l0_contribution": lambda s, d: E.contribution(results(s, d), LAYER, OTHERS), "mcnemar_chi2": lambda s, d: E.mcnemar(results(s, d), OTHERS, [LAYER, *OTHERS[:1]]), "latency_percentiles": lambda s, d: E.latency(results(s, d)),
    "nearest_rank": nearest_rank_latency, "ablation_union": ablation, "smart_skip": smart_skip, "target_hits": target_hits, "text_lengths": text_lengths, "entity_prf": entity_prf, "actionable_prf": actionable_prf, "failure_rows": failure_rows,
    "release_gates": gate_table, "gold_counts": gold_counts, "exact_mask_rate": exact_mask_rate, "count_maps": count_maps, "high_risk_recall": high_risk, "residual_risk": residual_risk, "bucket_report": bucket_report, "ablation_stages": ablation_stages, "name_actions": name_actions, "detector_shares": detector_shares, "safety_counts": safety, "layer_ablation": layer_ablation, "layers_together": layers_together, "latency_end_to_end": end_to_end, "survivors_folded": folded_survivors, "mcnemar_p": test_statistics, "fuzzer_stats": fuzzer_stats, "clean_findings": clean_findings,
}

#: One row per case and usable layer result: whether it neutralises the value, and whether it changes the text.
BASE = """WITH d AS (SELECT id, any_value(pii_type) AS pii_type, any_value(pii_value) AS v, any_value(mutation_level) AS mutation_level, any_value(mutation_name) AS mutation_name, any_value(mutated) AS t, any_value(lang) AS lang,
 any_value(validity_group) AS validity_group, any_value(detected_by) AS detected_by, any_value(layer_results) AS lr FROM analyze_l0_deep GROUP BY id),
x AS (SELECT id, v, coalesce(t, '') AS t, unnest(lr) AS r FROM d),
y AS (SELECT id, r.layer AS layer, r.action AS action, r.detected AS detected, r.latency_ms AS latency_ms, coalesce(r.error, '') <> '' OR coalesce(r.action, '') = 'ERROR' AS failed, coalesce(r.output, '') AS o, t, v,
 regexp_replace(v, '[^0-9]', '', 'g') AS dg, regexp_replace(coalesce(r.output, ''), '[^0-9]', '', 'g') AS og FROM x),
z AS (SELECT *, o <> '' AND o <> t AS changed, o = '[BLOCKED]' OR (o <> '' AND o <> t AND NOT coalesce(v <> '' AND (contains(o, v) OR (length(dg) >= 6 AND contains(og, dg))), false)) AS hit FROM y),
c AS (SELECT d.*, CASE WHEN EXISTS (SELECT 1 FROM z WHERE z.id = d.id AND NOT failed AND hit) THEN 'TRUE' WHEN EXISTS (SELECT 1 FROM z WHERE z.id = d.id AND NOT failed AND changed) THEN 'FALSE' ELSE 'BYPASS' END AS outcome FROM d)
"""


def true_of(*layers: str) -> str:
    return "EXISTS (SELECT 1 FROM z WHERE z.id = d.id AND NOT failed AND hit AND layer IN (" + ", ".join(f"'{x}'" for x in layers) + "))"


def there_sql(value: str, text: str) -> str:
    digits = lambda c: f"regexp_replace({c}, '[^0-9]', '', 'g')"
    return f"{value} <> '' AND {text} <> '' AND (contains({text}, {value}) OR (length({digits(value)}) >= 6 AND contains({digits(text)}, {digits(value)})))"


COUNTS = "count(*) AS n, count(*) FILTER (WHERE outcome = 'TRUE') AS n_true, count(*) FILTER (WHERE outcome = 'FALSE') AS n_false, count(*) FILTER (WHERE outcome = 'BYPASS') AS n_bypass, round(100 * count(*) FILTER (WHERE outcome = 'TRUE') / count(*), 2) AS true_rate"
ORACLES = {
    "classify_cases": BASE + "SELECT id, outcome FROM c",
    "slice_grouping_sets": BASE + f"SELECT CAST(grouping(lang, validity_group, mutation_level, pii_type) AS BIGINT) AS slice, lang, validity_group, mutation_level, pii_type, {COUNTS} FROM c GROUP BY GROUPING SETS ((), (lang), (validity_group), (mutation_level), (pii_type), (lang, validity_group))",
    "hardest_types": BASE + f"SELECT pii_type, {COUNTS}, round(100 * count(*) FILTER (WHERE outcome <> 'TRUE') / count(*), 2) AS bypass_rate FROM c GROUP BY pii_type HAVING count(*) >= 30 ORDER BY bypass_rate DESC, pii_type LIMIT 20",
    "miss_table": BASE + "SELECT mutation_name, mutation_level, count(*) AS n FROM c WHERE outcome = 'BYPASS' GROUP BY ALL",
    "layer_catch": BASE + "SELECT layer, count(*) AS n, count(*) FILTER (WHERE failed) AS errors, round(100 * count(*) FILTER (WHERE NOT failed AND detected) / count(*), 2) AS change_rate, round(100 * count(*) FILTER (WHERE NOT failed AND hit) / count(*), 2) AS neutralise_rate, round(avg(latency_ms) FILTER (WHERE NOT failed), 1) AS mean_latency FROM z GROUP BY layer",
    "l0_contribution": BASE + f"SELECT count(*) FILTER (WHERE {true_of(LAYER)} AND NOT {true_of(*OTHERS)}) AS solo, count(*) FILTER (WHERE {true_of(LAYER)} AND {true_of(*OTHERS)}) AS redundant, (SELECT count(*) FROM z WHERE layer = '{LAYER}' AND NOT failed AND action IN ('BLOCK', 'MASK')) AS actions, "
    f"(SELECT count(*) FROM z WHERE layer = '{LAYER}' AND NOT failed AND action = 'BLOCK') AS blocks, (SELECT count(*) FROM z WHERE layer = '{LAYER}' AND failed) AS errors FROM d",
    "mcnemar_chi2": BASE + f", k AS (SELECT count(*) FILTER (WHERE {true_of(*OTHERS)} AND NOT {true_of(LAYER, OTHERS[0])}) AS b, count(*) FILTER (WHERE NOT {true_of(*OTHERS)} AND {true_of(LAYER, OTHERS[0])}) AS c FROM d) SELECT b, c, round(CASE WHEN b + c > 0 THEN power(abs(b - c) - 1, 2) / (b + c) END, 3) AS chi2 FROM k",
    "latency_percentiles": BASE + "SELECT layer, count(*) AS n, min(latency_ms) AS least, CAST(trunc(quantile_cont(latency_ms, 0.5)) AS INT) AS p50, CAST(trunc(quantile_cont(latency_ms, 0.95)) AS INT) AS p95, CAST(trunc(quantile_cont(latency_ms, 0.99)) AS INT) AS p99, max(latency_ms) AS most, round(avg(latency_ms), 1) AS mean, round(stddev_pop(latency_ms), 3) AS deviation FROM y WHERE latency_ms IS NOT NULL GROUP BY layer",
    "nearest_rank": BASE + ", o AS (SELECT layer, list_sort(list(latency_ms)) AS l FROM y WHERE latency_ms IS NOT NULL GROUP BY layer) SELECT layer, l[CAST(round_even(0.5 * (len(l) - 1), 0) AS INT) + 1] AS p50, l[CAST(round_even(0.95 * (len(l) - 1), 0) AS INT) + 1] AS p95 FROM o",
    "ablation_union": BASE + " UNION ALL ".join(f"SELECT {k + 1} AS n_layers, '{'+'.join((LAYER, *OTHERS)[: k + 1])}' AS layers, round(100 * count(*) FILTER (WHERE {true_of(*(LAYER, *OTHERS)[: k + 1])}) / count(*), 2) AS true_rate FROM d" for k in range(4)),
    "smart_skip": BASE + f"SELECT count(*) AS n, count(*) FILTER (WHERE NOT {true_of(LAYER, 'ner_span', 'cloud_dlp')}) AS needed, count(*) FILTER (WHERE NOT {true_of(LAYER, 'ner_span', 'cloud_dlp')} AND {true_of('prompt_guard')}) AS recovered, round(100 * count(*) FILTER (WHERE {true_of(LAYER, 'ner_span', 'cloud_dlp')}) / count(*), 2) AS saved FROM d",
    "target_hits": BASE + "SELECT layer, count(*) AS n, count(*) FILTER (WHERE outcome = 'TRUE') AS n_true FROM (SELECT outcome, unnest(detected_by) AS layer FROM c) GROUP BY layer",
    "text_lengths": "SELECT source, lang, count(*) AS n, min(length(text)) AS least, max(length(text)) AS most, round(avg(length(text)), 2) AS mean FROM documents WHERE text IS NOT NULL GROUP BY source, lang",
    "gold_counts": "SELECT l.entity_type AS entity, l.risk_level AS risk, count(*) AS n, count(DISTINCT id) AS n_cases FROM (SELECT id, unnest(labels) AS l FROM (SELECT DISTINCT ON (id) id, labels FROM hard_cases_v0 WHERE labels IS NOT NULL AND text IS NOT NULL)) GROUP BY ALL",
    "count_maps": "SELECT layer, count(*) AS n FROM (SELECT unnest(detected_by) AS layer FROM (SELECT DISTINCT ON (id) id, detected_by FROM analyze_l0_deep)) GROUP BY layer",
    "safety_counts": "SELECT unnest(['public', 'audit', 'stored']) AS part, CAST(0 AS BIGINT) AS n",
    "layer_ablation": BASE + f", f AS (SELECT *, {true_of(*OTHERS)} AS a, {true_of(LAYER, *OTHERS)} AS b FROM d) SELECT CAST(grouping(lang, validity_group, mutation_level, pii_type) AS BIGINT) AS slice, lang, validity_group, mutation_level, pii_type, count(*) AS n, round(100 * avg(CAST(a AS INT)), 2) AS alone, round(100 * avg(CAST(b AS INT)), 2) AS together FROM f GROUP BY GROUPING SETS ((), (lang), (validity_group), (mutation_level), (pii_type), (lang, validity_group))",
    "layers_together": BASE + ", h AS (SELECT id, layer, max(CAST(coalesce(hit, false) AS INT)) AS hit FROM z WHERE NOT failed GROUP BY id, layer) SELECT " + " || ".join(f"h{k}.hit" for k in range(4)) + " AS pattern, count(*) AS n FROM h h0 JOIN h h1 USING (id) JOIN h h2 USING (id) JOIN h h3 USING (id) WHERE " + " AND ".join(f"h{k}.layer = '{x}'" for k, x in enumerate((LAYER, *OTHERS))) + " GROUP BY 1",
    "latency_end_to_end": BASE + ", e AS (SELECT id, sum(latency_ms) AS ms FROM y WHERE latency_ms IS NOT NULL GROUP BY id HAVING count(DISTINCT layer) = 4) SELECT count(*) AS n, CAST(min(ms) AS BIGINT) AS least, CAST(trunc(quantile_cont(ms, 0.5)) AS INT) AS p50, CAST(trunc(quantile_cont(ms, 0.95)) AS INT) AS p95, CAST(max(ms) AS BIGINT) AS most, round(avg(ms), 1) AS mean FROM e",
    "survivors_folded": BASE + f", s AS (SELECT x.r.layer AS layer, v, x.r.output AS o, {FOLD.format(t='v')} AS fv, {FOLD.format(t='x.r.output')} AS fo FROM x WHERE x.r.output IS NOT NULL AND v IS NOT NULL) SELECT layer, count(*) AS n, count(*) FILTER (WHERE {there_sql('v', 'o')}) AS n_there, count(*) FILTER (WHERE {there_sql('fv', 'fo')}) AS n_folded FROM s GROUP BY layer",
    "fuzzer_stats": "WITH d AS (SELECT DISTINCT ON (id) * FROM analyze_l0_deep) " + " UNION ALL ".join(f"SELECT '{k}' AS grouping, CAST({k} AS VARCHAR) AS value, count(*) AS n FROM d GROUP BY 2" for k in ("pii_type", "mutation_level", "mutation_name", "lang", "name_tier", "validity_group")),
}
