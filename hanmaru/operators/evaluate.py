"""Evaluation of detectors and layers: outcomes, slices, paired tests, quantiles, span matching."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from hanmaru.functions.text import fold_digits, let

SLICES = ("lang", "validity_group", "mutation_level", "pii_type")


def still_there(value: Column, text: Column, folded: bool = False) -> Column:
    """Whether a value survives in a text: as it is, or its six or more digits among the text's digits.

    folded: full-width, circled and mathematical digits of both count as plain ones.
    """
    if folded:
        value, text = fold_digits(value), fold_digits(text)
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.coalesce((value != "") & (text != "") & (text.contains(value) | ((F.length(digits) >= 6) & F.regexp_replace(text, "[^0-9]", "").contains(digits))), F.lit(False))


def usable(layers: Column, names: Sequence[str] | None = None) -> Column:
    """Results without an error, of the named layers."""
    of = lambda x: x["layer"].isin(*names) if names else F.lit(True)
    return F.filter(layers, lambda x: of(x) & (F.coalesce(x["error"], F.lit("")) == "") & (F.coalesce(x["action"], F.lit("")) != "ERROR"))


def neutralised(x: Column, value: Column, text: Column) -> Column:
    """Whether one layer's output differs from the text and no longer holds the value. A null output is no change."""
    out = F.coalesce(x["output"], F.lit(""))
    return (out == "[BLOCKED]") | ((out != "") & (out != F.coalesce(text, F.lit(""))) & ~still_there(value, out))


def outcome(layers: Column, value: Column, text: Column, names: Sequence[str] | None = None) -> Column:
    """TRUE: a layer neutralised the value; FALSE: one changed the text and left the value; else BYPASS."""
    ok = usable(layers, names)
    hit = F.exists(ok, lambda x: neutralised(x, value, text))
    out = lambda x: F.coalesce(x["output"], F.lit(""))
    touched = F.exists(ok, lambda x: (out(x) != "") & (out(x) != F.coalesce(text, F.lit(""))))
    return F.when(F.coalesce(hit, F.lit(False)), "TRUE").when(F.coalesce(touched, F.lit(False)), "FALSE").otherwise("BYPASS")


def classified(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Cases once each (whole rows are delivered twice) with their outcome."""
    return df.dropDuplicates(["id"]).withColumn("outcome", outcome(F.col("layer_results"), F.col("pii_value"), F.col("mutated"), names))


def rates() -> list[Column]:
    n = F.count("*")
    per = lambda c: F.round(100 * c / n, 2)
    true, false, bypass = (F.count_if(F.col("outcome") == k) for k in ("TRUE", "FALSE", "BYPASS"))
    return [n.alias("n"), true.alias("n_true"), false.alias("n_false"), bypass.alias("n_bypass"), per(true).alias("true_rate"), per(false + bypass).alias("bypass_rate")]


def sliced(cases: DataFrame) -> DataFrame:
    """All slices in one pass: everything, each dimension, and language by validity."""
    keys = ", ".join(SLICES)
    cases.createOrReplaceTempView("hanmaru_cases")
    sets = f"(), {', '.join(f'({s})' for s in SLICES)}, (lang, validity_group)"
    return cases.sparkSession.sql(
        f"""SELECT grouping_id({keys}) AS slice, lang, validity_group, mutation_level, pii_type, count(*) AS n, count_if(outcome = 'TRUE') AS n_true,
        count_if(outcome = 'FALSE') AS n_false, count_if(outcome = 'BYPASS') AS n_bypass, round(100 * count_if(outcome = 'TRUE') / count(*), 2) AS true_rate
        FROM hanmaru_cases GROUP BY GROUPING SETS ({sets})"""
    )


def hardest(cases: DataFrame, least: int = 30, k: int = 20) -> DataFrame:
    """The k types with at least so many cases that are missed most; ties by name."""
    return cases.groupBy("pii_type").agg(*rates()).where(F.col("n") >= least).orderBy(F.desc("bypass_rate"), "pii_type").limit(k)


def by_layer(df: DataFrame) -> DataFrame:
    """For each layer: results, errors, change and neutralisation rates, mean latency of those without error."""
    rows = df.dropDuplicates(["id"]).select("pii_value", "mutated", F.explode("layer_results").alias("x"))
    failed = (F.coalesce(F.col("x.error"), F.lit("")) != "") | (F.coalesce(F.col("x.action"), F.lit("")) == "ERROR")
    rows = rows.withColumn("failed", failed).withColumn("hit", ~F.col("failed") & neutralised(F.col("x"), F.col("pii_value"), F.col("mutated")))
    n = F.count("*")
    return rows.groupBy(F.col("x.layer").alias("layer")).agg(
        n.alias("n"), F.count_if("failed").alias("errors"), F.round(100 * F.count_if(~F.col("failed") & F.col("x.detected")) / n, 2).alias("change_rate"),
        F.round(100 * F.count_if("hit") / n, 2).alias("neutralise_rate"), F.round(F.avg(F.when(~F.col("failed"), F.col("x.latency_ms"))), 1).alias("mean_latency"),
    )


def contribution(df: DataFrame, layer: str, others: Sequence[str]) -> DataFrame:
    """What one layer adds to others: cases only it neutralises, cases both do, its actions, blocks and errors."""
    cases = df.dropDuplicates(["id"])
    alone = outcome(F.col("layer_results"), F.col("pii_value"), F.col("mutated"), [layer]) == "TRUE"
    rest = outcome(F.col("layer_results"), F.col("pii_value"), F.col("mutated"), others) == "TRUE"
    own = F.filter(usable(F.col("layer_results"), [layer]), lambda x: x["action"].isin("BLOCK", "MASK"))
    errors = F.filter(F.col("layer_results"), lambda x: (x["layer"] == layer) & ((F.coalesce(x["error"], F.lit("")) != "") | (F.coalesce(x["action"], F.lit("")) == "ERROR")))
    total = lambda c: F.coalesce(F.sum(F.greatest(F.size(c), F.lit(0))), F.lit(0))
    return cases.agg(
        F.count_if(alone & ~rest).alias("solo"), F.count_if(alone & rest).alias("redundant"), total(own).alias("actions"), total(F.filter(own, lambda x: x["action"] == "BLOCK")).alias("blocks"), total(errors).alias("errors")
    )


def mcnemar(df: DataFrame, first: Sequence[str], second: Sequence[str]) -> DataFrame:
    """Discordant counts b (only the first set of layers) and c, and the chi-square with continuity correction."""
    is_true = lambda names: outcome(F.col("layer_results"), F.col("pii_value"), F.col("mutated"), names) == "TRUE"
    counted = df.dropDuplicates(["id"]).agg(F.count_if(is_true(first) & ~is_true(second)).alias("b"), F.count_if(~is_true(first) & is_true(second)).alias("c"))
    chi = F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2)) / (F.col("b") + F.col("c"))
    return counted.select("b", "c", F.round(F.when(F.col("b") + F.col("c") > 0, chi), 3).alias("chi2"))


def latency(df: DataFrame) -> DataFrame:
    """Per layer: extent, interpolated quantiles (cut to whole milliseconds), mean and population deviation."""
    rows = df.dropDuplicates(["id"]).select(F.explode("layer_results").alias("x")).select("x.layer", "x.latency_ms").where("latency_ms is not null")
    q = lambda p: F.percentile("latency_ms", F.lit(p)).cast("int")
    return rows.groupBy("layer").agg(
        F.count("*").alias("n"), F.min("latency_ms").alias("least"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.max("latency_ms").alias("most"),
        F.round(F.avg("latency_ms"), 1).alias("mean"), F.round(F.stddev_pop("latency_ms"), 3).alias("deviation"),
    )


def nearest_rank(values: Column, q: float) -> Column:
    """The element at rank round(q * (n - 1)), halves to even, of an array."""
    ordered = F.array_sort(values)
    return F.try_element_at(ordered, (F.bround(F.lit(q) * (F.size(ordered) - 1), 0) + 1).cast("int"))


SPANS = "array<struct<start:int,end:int,entity:string>>"
MATCH = "struct<kind:string,entity:string,start:int,end:int,label:int,prediction:int>"


def common(a: Column, b: Column) -> Column:
    """Characters that two spans share; not above zero where they don't meet."""
    return F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])


def matches(gold: Column, predicted: Column, threshold: float = 0.5) -> Column:
    """ARRAY<MATCH>: each label as exact, partial or miss, then each prediction that is left as spurious.

    A label takes a free prediction of its type: the first one with its places, else the last one that overlaps it by
    the threshold, measured against the longer of both. Labels choose in their order; a null array is an empty one.
    label and prediction are places in the arrays, from 0; null where there is none.
    """
    length = lambda x: x["end"] - x["start"]
    equal = lambda g, p: (g["start"] == p["start"]) & (g["end"] == p["end"])
    enough = lambda g, p: (common(g, p) > 0) & (common(g, p) >= threshold * F.greatest(length(g), length(p)))
    nowhere = F.lit(None).cast("int")
    row = lambda kind, x, label, prediction: F.struct(kind.alias("kind"), x["entity"].alias("entity"), x["start"].alias("start"), x["end"].alias("end"), label.alias("label"), prediction.alias("prediction"))
    state = f"struct<taken:array<int>,out:array<{MATCH}>>"
    places = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["entity"].alias("entity"))).cast(SPANS)
    numbered = lambda c: F.transform(F.coalesce(places(c), F.array().cast(SPANS)), lambda x, k: F.struct(k.alias("k"), x.alias("x")))

    def fold(labels: Column, predictions: Column) -> Column:
        def step(acc: Column, g: Column) -> Column:
            free = F.filter(predictions, lambda n: (n["x"]["entity"] == g["x"]["entity"]) & (equal(g["x"], n["x"]) | enough(g["x"], n["x"])) & ~F.array_contains(acc["taken"], n["k"]))
            # Exact ones before partial ones; of the former the first, of the latter the last.
            ranked = F.transform(free, lambda n: F.struct(equal(g["x"], n["x"]).alias("exact"), F.when(equal(g["x"], n["x"]), -n["k"]).otherwise(n["k"]).alias("rank"), n["k"].alias("k")))
            return let(F.array_max(ranked), lambda best: F.struct(
                F.when(best.isNull(), acc["taken"]).otherwise(F.concat(acc["taken"], F.array(best["k"]))).alias("taken"),
                F.concat(acc["out"], F.array(row(F.when(best.isNull(), "miss").when(best["exact"], "exact").otherwise("partial"), g["x"], g["k"], best["k"]))).alias("out"),
            ).cast(state))

        rest = lambda acc: F.transform(F.filter(predictions, lambda n: ~F.array_contains(acc["taken"], n["k"])), lambda n: row(F.lit("spurious"), n["x"], nowhere, n["k"]))
        start = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast(f"array<{MATCH}>").alias("out")).cast(state)
        return F.aggregate(labels, start, step, lambda acc: F.concat(acc["out"], rest(acc).cast(f"array<{MATCH}>")))

    return let(numbered(gold), lambda labels: let(numbered(predicted), lambda predictions: fold(labels, predictions)))


def matched(df: DataFrame, key: str, gold: str, predicted: str, *keep: str) -> DataFrame:
    """(key, columns to keep, kind, entity, start, end, label, prediction): a row for each label and each prediction without one.

    gold and predicted are arrays of (start, end, entity).
    """
    return df.select(key, *keep, F.inline(matches(F.col(gold), F.col(predicted))))


def failure(kind: Column, entity: Column, start: Column, end: Column, gold: Column) -> Column:
    """FN, FP, TYPE_CONFUSION (a label of another type lies there) or OVERDETECTION (one of the type does); null for a match."""
    here = F.struct(start.alias("start"), end.alias("end"))
    meeting = F.filter(F.coalesce(gold.cast(SPANS), F.array().cast(SPANS)), lambda g: common(g, here) > 0)
    return F.when(kind == "miss", "FN").when(
        kind == "spurious", F.when(F.exists(meeting, lambda g: g["entity"] != entity), "TYPE_CONFUSION").when(F.size(meeting) > 0, "OVERDETECTION").otherwise("FP")
    )


ACTING = ("MASK", "HASH", "BLOCK")
# Types whose recall a release needs, tags of cases in which names are ambiguous, thresholds.
STRUCTURED_RISKS = (
    "RRN", "FRN", "PASSPORT", "DRIVER_LICENSE", "PHONE_MOBILE", "PHONE_LANDLINE", "EMAIL", "CREDIT_CARD", "BANK_ACCOUNT", "BUSINESS_REG_NO", "CORPORATE_REG_NO", "VEHICLE_REG_NO", "MEDICAL_RECORD_NO",
)
AMBIGUOUS = ("hard_negative", "ambiguous_name", "weather_context")
GATES = {
    "high_risk_structured_recall": (">=", 0.99), "phone_email_recall": (">=", 0.98), "josa_boundary_accuracy": (">=", 0.95), "exact_span_match_rate": (">=", 0.90), "name_ambiguity_fp_rate": ("<=", 0.0),
    "raw_values_shown": ("==", 0.0), "invalid_offsets": ("==", 0.0),
}


def judged_matches(df: DataFrame, key: str, gold: str, spans: str, *keep: str) -> DataFrame:
    """matched() with what is known of either side: risk and suffix of the label, action of the prediction, and how it failed.

    gold: array of (start, end, entity, risk, suffix); spans: of decided spans.
    """
    plain = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["entity"].alias("entity")))
    rows = df.select(key, *keep, gold, spans, F.inline(matches(plain(F.col(gold)), plain(F.col(spans)))))
    return rows.select(
        key, *keep, "kind", "entity", "start", "end", F.get(gold, F.col("label"))["risk"].alias("risk"), F.get(gold, F.col("label"))["suffix"].alias("suffix"), F.get(spans, F.col("prediction"))["action"].alias("action"),
        failure(F.col("kind"), F.col("entity"), F.col("start"), F.col("end"), plain(F.col(gold))).alias("failure"),
    )


def recall(found: Column, of: Column) -> Column:
    """Share of rows of a kind that are found; null if there is none."""
    return F.try_divide(F.count_if(of & found).cast("double"), F.count_if(of))


def gate_values(judged: DataFrame, cases: DataFrame) -> DataFrame:
    """(gate, value) of a release: ratios of judged matches, null where nothing counts; cases: (tags, n_raw, n_invalid) of each case."""
    label, hit = F.col("kind") != "spurious", F.col("kind").isin("exact", "partial")
    acting = hit & F.col("action").isin(*ACTING)
    values = judged.agg(
        recall(acting, label & F.col("risk").isin("P0", "P1") & F.col("entity").isin(*STRUCTURED_RISKS)).alias("high_risk_structured_recall"),
        recall(acting, label & F.col("entity").isin("PHONE_MOBILE", "PHONE_LANDLINE", "EMAIL")).alias("phone_email_recall"),
        recall(F.col("kind") == "exact", label & (F.coalesce("suffix", F.lit("")) != "")).alias("josa_boundary_accuracy"), recall(F.col("kind") == "exact", label).alias("exact_span_match_rate"),
        F.count_if(F.col("ambiguous") & (F.col("kind") == "spurious") & (F.col("entity") == "PERSON_NAME") & F.col("action").isin(*ACTING)).alias("n_wrong"),
    )
    counts = cases.agg(F.count_if("ambiguous").alias("n_ambiguous"), F.sum("n_raw").cast("double").alias("raw_values_shown"), F.sum("n_invalid").cast("double").alias("invalid_offsets"))
    both = values.crossJoin(counts).withColumn("name_ambiguity_fp_rate", F.try_divide(F.col("n_wrong").cast("double"), F.col("n_ambiguous")))  # one row each
    return both.select(F.inline(F.array(*(F.struct(F.lit(g).alias("gate"), F.col(g).alias("value")) for g in GATES))))


def tail_probability(chi2: Column) -> Column:
    """P value of a chi-square with one degree of freedom."""

    @F.pandas_udf("double")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: math.erfc(math.sqrt(x / 2)), na_action="ignore")

    return run(chi2)


def entity_metrics(matches: DataFrame) -> DataFrame:
    """Precision, recall and F1 by type and over all (null type); a partial match is a hit with a wrong boundary."""
    hit = F.count_if(F.col("kind").isin("exact", "partial"))
    fp, fn, exact = F.count_if(F.col("kind") == "spurious"), F.count_if(F.col("kind") == "miss"), F.count_if(F.col("kind") == "exact")
    counts = matches.rollup("entity").agg(hit.alias("tp"), exact.alias("exact"), fp.alias("fp"), fn.alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", F.round(p, 4)).withColumn("recall", F.round(r, 4)).withColumn("f1", F.round(ratio(2 * p * r, p + r), 4)).withColumn("boundary", F.round(ratio(F.col("exact"), F.col("tp")), 4))


def gates(metrics: DataFrame, thresholds: dict[str, tuple[str, float]]) -> DataFrame:
    """(gate, value, status) of a table (gate, value): pass, fail, or skipped for a null value."""
    rows = [(g, op, t) for g, (op, t) in thresholds.items()]
    wanted = metrics.sparkSession.createDataFrame(rows, "gate string, op string, limit double")
    ok = F.when(F.col("op") == ">=", F.col("value") >= F.col("limit")).when(F.col("op") == "<=", F.col("value") <= F.col("limit")).otherwise(F.col("value") == F.col("limit"))
    status = F.when(F.col("value").isNull(), "skipped").when(ok, "pass").otherwise("fail")
    return wanted.join(metrics, "gate", "left").select("gate", "value", status.alias("status"), F.concat(F.lit("gate."), "gate", F.lit("."), status).alias("reason"))
