"""Operators of the corpus store: deduplication, leakage, export, sampling, labels, weak labelling, diversity."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from hanmaru.functions.text import content_hash, let, squash
from hanmaru.functions.validate import bio_valid

LABELS = ("O", "B-NAME", "I-NAME", "B-ORG", "I-ORG", "B-ADDRESS", "I-ADDRESS")


def split_name(hint: Column) -> Column:
    """train, val, test, or unknown."""
    name = F.lower(F.trim(hint))
    return F.when(name.isin("train", "training"), "train").when(name.isin("val", "valid", "validation", "dev"), "val").when(name == "test", "test").otherwise("unknown")


def first_wins(df: DataFrame, hash_: Column, order: str, existing: DataFrame | None = None) -> DataFrame:
    """One row for each hash, the one that comes first; hashes that exist already are left out. Null hashes go.

    min_by aggregates before the shuffle, so a hash that a third of the rows share costs one row per task.
    """
    keyed = df.withColumn("_h", hash_).where("_h is not null")
    one = keyed.groupBy("_h").agg(F.min_by(F.struct(*(F.col(c) for c in df.columns)), order).alias("r"))
    if existing is not None:
        one = one.join(existing.select(F.col(existing.columns[0]).alias("_h")), "_h", "left_anti")
    return one.select("r.*")


def insert_counts(df: DataFrame, hash_: Column, valid: Column) -> DataFrame:
    """(n_seen, n_inserted, n_dup, n_invalid) by source, the first row of a hash anywhere being the inserted one."""
    rows = df.select("id", "source", hash_.alias("h"), F.coalesce(valid, F.lit(False)).alias("ok"))
    first = rows.where("ok").groupBy("h").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    joined = rows.join(first, "id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("n_seen"), F.count_if("first").alias("n_inserted"), F.count_if(F.col("ok") & F.col("first").isNull()).alias("n_dup"), F.count_if(~F.col("ok")).alias("n_invalid"))


def example_valid() -> Column:
    """The contract of an example: tokens, labels and names of one length, known names, no orphan I-."""
    n = F.size("tokens")
    return (F.size("labels") == n) & (F.size("label_names") == n) & F.forall("label_names", lambda x: x.isin(*LABELS)) & bio_valid(F.col("label_names"))


def leaked(train: DataFrame, held_out: DataFrame, text: str) -> DataFrame:
    """Training rows whose normalised text also stands in the held-out rows."""
    hashes = held_out.select(content_hash(F.col(text)).alias("_h")).where("_h is not null").distinct()
    return train.withColumn("_h", content_hash(F.col(text))).join(hashes, "_h", "left_semi").drop("_h")


def exported(df: DataFrame, licences: list[str], leaks: DataFrame, text: str) -> DataFrame:
    """Rows of the given licences (by prefix) that aren't leaked, one for each normalised text."""
    kept = df.where(F.array_contains(F.transform(F.array(*map(F.lit, licences)), lambda p: F.col("license").startswith(p)), True))
    kept = kept.join(leaks.select("id"), "id", "left_anti")
    return first_wins(kept, content_hash(F.col(text)), "id")


def entities(df: DataFrame, key: str) -> DataFrame:
    """(key, entity, start, end, text): the spans of BIO names over character tokens; an orphan I- opens none."""
    empty = F.array().cast("array<struct<entity:string,start:int,end:int,text:string>>")
    rows = F.arrays_zip(F.col("label_names").alias("l"), F.col("tokens").alias("t"))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc["out"], F.lit(-1))
        begins = x["l"].startswith("B-")
        goes_on = x["l"].startswith("I-") & (last["entity"] == F.substring(x["l"], 3, 99)) & (last["end"] == acc["at"])
        opened = F.concat(acc["out"], F.array(F.struct(F.substring(x["l"], 3, 99).alias("entity"), acc["at"].alias("start"), (acc["at"] + 1).alias("end"), x["t"].alias("text"))))
        longer = F.concat(F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.struct(last["entity"].alias("entity"), last["start"].alias("start"), (acc["at"] + 1).alias("end"), F.concat(last["text"], x["t"]).alias("text"))))
        return F.struct((acc["at"] + 1).alias("at"), F.when(begins, opened).when(F.coalesce(goes_on, F.lit(False)), longer).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return df.where("label_names is not null and tokens is not null").select(key, F.inline(folded))


def spans_to_bio(text: Column, spans: Column) -> Column:
    """BIO names of the characters; longer spans first, a span that meets a taken character is left out."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["end"] - a["start"] > b["end"] - b["start"], -1).when(a["end"] - a["start"] < b["end"] - b["start"], 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    kept = F.aggregate(ordered, F.slice(ordered, F.lit(1), F.lit(0)), lambda acc, s: F.when(F.exists(acc, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), acc).otherwise(F.concat(acc, F.array(s))))

    def name(k: Column) -> Column:
        hit = F.try_element_at(F.filter(kept, lambda s: (s["start"] <= k) & (k < s["end"])), F.lit(1))
        return F.when(hit.isNull(), "O").otherwise(F.concat(F.when(hit["start"] == k, "B-").otherwise("I-"), hit["entity"]))

    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.length(text) - 1), name)).otherwise(F.array().cast("array<string>"))


def word_to_char_bio(words: Column, names: Column) -> Column:
    """BIO names of the characters of words joined by single blanks; blanks are O unless a name runs on."""
    pairs = F.arrays_zip(words.alias("w"), names.alias("n"))
    inner = lambda n: F.when(n == "O", "O").otherwise(F.concat(F.lit("I-"), F.substring(n, 3, 99)))
    chars = F.transform(pairs, lambda p, k: F.concat(F.when(k > 0, F.array(F.when(p["n"].startswith("I-"), p["n"]).otherwise("O"))).otherwise(F.array().cast("array<string>")), F.array(p["n"]), F.array_repeat(inner(p["n"]), F.length(p["w"]) - 1)))
    return F.flatten(chars)


def allocated(df: DataFrame, keys: list[str], target: int) -> DataFrame:
    """Sizes of a proportional sample: each stratum its rounded share, the last one (by name) what is left, none beyond its rows."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(1))
    order = everything.orderBy(*(F.asc_nulls_first(k) for k in keys))
    share = F.least(F.round(F.lit(target) * F.col("n") / F.sum("n").over(everything)), F.col("n")).cast("long")
    planned = sizes.withColumn("share", share).withColumn("place", F.row_number().over(order)).withColumn("last", F.max("place").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    before = F.coalesce(F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return planned.withColumn("before", before).select(*keys, "n", F.when(F.col("place") == F.col("last"), F.least(F.greatest(target - F.col("before"), F.lit(0)), F.col("n"))).otherwise(F.col("share")).alias("size"))


def drawn(df: DataFrame, keys: list[str], sizes: DataFrame, key: str, seed: str) -> DataFrame:
    """The sample: rows of each stratum in the order of a seeded hash of their key.

    Only rows whose hash lies below a bound that surely holds enough are ranked, so no stratum is sorted whole.
    """
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    match = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = df.withColumn("_draw", draw).alias("a").join(sizes.alias("b"), match).select("a.*", "b.n", "b.size")
    bound = (F.col("size") / F.col("n") + 6 * F.sqrt(F.col("size") + 1) / F.col("n")) * 2**32
    likely = joined.where((F.col("_draw") <= bound) | (F.col("n") <= 1000))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_draw", key))
    return likely.withColumn("_rank", rank).where("_rank <= size").drop("_draw", "_rank", "n", "size")


def with_negatives(df: DataFrame, positive: Column, key: str, ratio: float) -> DataFrame:
    """(key, positive): all positive rows and the first ratio times as many others in the order of their key's hash.

    Others are counted by the first 16 bits of their hash; those below the class in which the number is reached are
    taken, and only that class is ranked, so no task sorts more than a class.
    """
    rows = df.select(key, F.coalesce(positive, F.lit(False)).alias("positive"), F.md5(F.col(key).cast("string")).alias("h"))
    kinds = rows.groupBy("positive", F.when(~F.col("positive"), F.substring("h", 1, 4)).alias("kind")).agg(F.count("*").alias("n"))  # 65537 rows at most
    wanted = kinds.agg(F.floor(F.coalesce(F.sum(F.when(F.col("positive"), F.col("n"))), F.lit(0)) * ratio).alias("wanted"))
    upto = F.coalesce(F.sum("n").over(Window.orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = kinds.where("not positive").select("kind", "n", upto.alias("before")).crossJoin(wanted).where("before < wanted")
    others = rows.where("not positive").withColumn("kind", F.substring("h", 1, 4)).join(F.broadcast(classes), "kind")
    whole = others.where("before + n <= wanted").select(key, "positive")
    border = others.where("before + n > wanted").withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy("h", key))).where("before + k <= wanted").select(key, "positive")
    return rows.where("positive").select(key, "positive").unionAll(whole).unionAll(border)


def first_sentence(text: Column, least: int, most: int) -> Column:
    """The first sentence whose length lies between least and most."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: squash(s))
    return F.try_element_at(F.filter(parts, lambda s: F.length(s).between(least, most)), F.lit(1))


#: Terms up to which an automaton of all of them goes to every task; more meet the texts in a join.
TERMS = 200_000
#: Places of the filter of term beginnings that goes to every task in that case.
BEGINNINGS = 1 << 18
AFTER_NAME = set("은는이가을를의도에와과로만께야아랑님씨입인")
# Identifiers that are labelled by their form.
FORMS = (("PHONE", r"01[016789][-\s]?\d{3,4}[-\s]?\d{4}"), ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), ("RRN", r"\d{6}[-\s]?[1-4]\d{6}"))
HITS = "array<struct<start:int,end:int,entity:string>>"


def guarded(text: str, s: int, e: int, entity: str) -> bool:
    """Whether a term stands by itself: Latin terms between non-letters, names at a word's start before a particle."""
    before, after = text[s - 1 : s], text[e : e + 1]
    if text[s:e].isascii() and any(c.isalnum() for c in text[s:e]) and (before.isalnum() or after.isalnum()):
        return False
    hangul = lambda c: "가" <= c <= "힣"
    return not (entity == "NAME" and ((before and hangul(before)) or (after and hangul(after) and after not in AFTER_NAME)))


def by_form(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), entity) for entity, pattern in FORMS for m in re.finditer(pattern, text, re.ASCII)]


def longest_first(found: Column) -> Column:
    """The hits that a greedy choice keeps, the longest first, then by start and type; none overlaps another."""
    key = lambda x: F.struct((x["start"] - x["end"]).alias("a"), x["start"].alias("b"), x["entity"].alias("c"), x["end"].alias("d"))
    ordered = F.transform(F.array_sort(F.array_distinct(F.transform(found, key))), lambda k: F.struct(k["b"].alias("start"), k["d"].alias("end"), k["c"].alias("entity"))).cast(HITS)
    meets = lambda acc, x: F.exists(acc, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    kept = F.aggregate(ordered, F.array().cast(HITS), lambda acc, x: F.when(meets(acc, x), acc).otherwise(F.concat(acc, F.array(x)).cast(HITS)))
    return F.array_sort(kept)


def weak_labels(df: DataFrame, key: str, text: str, terms: DataFrame, forms: bool = True) -> DataFrame:
    """(key, spans): occurrences of gazetteer terms and of identifiers by their form, longest first without overlaps.

    terms: (entity, value); terms of one character and blank ones are left out. Rows of df have distinct keys. Up to TERMS
    terms, one pass with an Aho-Corasick automaton finds them; more are joined with the texts by their first two
    characters, behind a filter of fixed size, and none of them goes through the driver. The result is the same.
    """
    clean = terms.select("entity", F.trim("value").alias("value")).where("length(value) >= 2").distinct()
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col(text).isNotNull())
    few = clean.limit(TERMS + 1).collect()
    found = by_automaton(rows, few, forms) if len(few) <= TERMS else by_join(rows, clean, forms)
    return found.select(F.col("_key").alias(key), longest_first(F.col("hits")).alias("spans"))


def by_automaton(rows: DataFrame, terms: list, forms: bool) -> DataFrame:
    """(_key, hits) of rows with a hit."""
    shared = rows.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in terms])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        by_term: dict[str, list[str]] = {}
        for entity, value in shared.value:
            by_term.setdefault(value, []).append(entity)
        for value, kinds in by_term.items():
            automaton.add_word(value, (len(value), kinds))
        if by_term:
            automaton.make_automaton()
        for batch in batches:
            out = []
            for k, t in zip(batch["_key"], batch["_text"]):
                found = [(end + 1 - n, end + 1, kind) for end, (n, kinds) in (automaton.iter(t) if by_term else ()) for kind in kinds if guarded(t, end + 1 - n, end + 1, kind)]
                found += by_form(t) if forms else []
                if found:
                    out.append((k, [{"start": s, "end": e, "entity": kind} for s, e, kind in found]))
            yield pd.DataFrame(out, columns=["_key", "hits"])

    return rows.mapInPandas(run, f"_key {rows.schema['_key'].dataType.simpleString()}, hits {HITS}")


def by_join(rows: DataFrame, terms: DataFrame, forms: bool) -> DataFrame:
    """(_key, hits): places of texts where some term may begin are joined with the terms that begin so."""
    slot = F.pmod(F.xxhash64(F.substring("value", 1, 2)), F.lit(BEGINNINGS))
    begun = terms.select(slot.cast("int").alias("slot")).distinct().collect()  # at most BEGINNINGS numbers
    longest = terms.agg(F.max(F.length("value"))).first()[0] or 2
    filled = np.zeros(BEGINNINGS, bool)
    filled[[r[0] for r in begun]] = True
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(filled))
    # The hash of the two characters is Spark's own, so the places are made in the plan and filtered in batches.
    places = rows.select("_key", "_text", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_text") - 1, F.lit(1))), lambda i: F.substring(F.col("_text"), i, F.lit(2)))).alias("at", "begin"))
    places = places.withColumn("slot", F.pmod(F.xxhash64("begin"), F.lit(BEGINNINGS)).cast("int"))

    @F.pandas_udf("boolean")
    def maybe(column: pd.Series) -> pd.Series:
        return pd.Series(np.unpackbits(shared.value).astype(bool)[column.to_numpy()])

    around = F.substring("_text", F.greatest(F.col("at"), F.lit(1)), F.lit(int(longest) + 2))  # from the character before it on
    likely = places.where(maybe("slot")).select("_key", "at", "begin", around.alias("around"), F.when(F.col("at") > 0, 1).otherwise(0).alias("skip"))
    met = likely.join(terms.withColumn("begin", F.substring("value", 1, 2)), "begin").where(F.substring(F.col("around"), F.col("skip") + 1, F.length("value")) == F.col("value"))

    @F.pandas_udf("boolean")
    def alone(around: pd.Series, skip: pd.Series, value: pd.Series, entity: pd.Series) -> pd.Series:
        return pd.Series([guarded(a, s, s + len(v), e) for a, s, v, e in zip(around, skip, value, entity)], dtype=bool)

    @F.pandas_udf(HITS)
    def formed(text: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e, "entity": k} for s, e, k in by_form(t)] for t in text], dtype=object)

    hits = met.where(alone("around", "skip", "value", "entity")).select("_key", F.struct(F.col("at").alias("start"), (F.col("at") + F.length("value")).alias("end"), "entity").alias("hit"))
    if forms:
        hits = hits.unionAll(rows.select("_key", F.explode(formed("_text")).alias("hit")))
    return hits.groupBy("_key").agg(F.collect_list("hit").cast(HITS).alias("hits"))


def projected(text: Column, entities: Column) -> Column:
    """HITS: every occurrence of the given values in a text, from left to right; values that don't occur give none.

    entities: ARRAY<STRUCT<value, entity>>. Longer occurrences win over those they overlap.
    """
    def one(e: Column) -> Column:
        parts = F.split(text, F.concat(F.lit("\\Q"), e["value"], F.lit("\\E")), -1)
        step = lambda acc, p: F.struct((acc["at"] + F.length(p) + F.length(e["value"])).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(p))).alias("out"))
        starts = F.aggregate(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])
        return F.transform(starts, lambda s: F.struct(s.alias("start"), (s + F.length(e["value"])).alias("end"), e["entity"].alias("entity")))

    return longest_first(F.flatten(F.transform(F.filter(entities, lambda e: F.length(e["value"]) > 0), one)))


def quota_sample(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """n rows, as many of each group as its equal share allows, the rest from groups that have more; by the hash of the key."""
    groups = df.select(group).distinct().count()
    share = max(1, n // max(1, groups))
    ranked = df.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("_h", key)))
    # Rows within their share first, then surplus; no group can give more than n rows, so at most groups * n rows are ranked.
    return ranked.where(F.col("_k") <= n).orderBy((F.col("_k") > share).cast("int"), "_h", key).limit(n).drop("_h", "_k")


#: Vectors that a bucket should hold, limits of its planes, share of pairs at the threshold that may be missed.
FILL, LEAST_PLANES, MOST_PLANES, MISSED = 16, 6, 24, 0.005


def lsh_shape(n: int, threshold: float) -> tuple[int, int]:
    """(planes, tables): planes so that buckets stay small however many vectors there are, tables so that few pairs are missed."""
    planes = int(np.clip(np.ceil(np.log2(max(2, n) / FILL)), LEAST_PLANES, MOST_PLANES))
    alike = (1 - np.arccos(min(1.0, threshold)) / np.pi) ** planes
    return planes, max(1, int(np.ceil(np.log(MISSED) / np.log1p(-min(alike, 1 - 1e-9)))))


def near_vectors(df: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """(a, b), a < b: pairs of vectors with a cosine of at least the threshold.

    Candidates share the signs of all random planes of one of several tables; how many there are of either follows from
    the number of vectors and the threshold (see lsh_shape), so that a pair right at the threshold is missed once in 200
    and buckets don't grow. Each candidate is verified exactly. Null and empty vectors take no part.
    """
    planes_, tables_ = lsh_shape(df.count(), threshold)
    kind = df.schema[key].dataType.simpleString()

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = None
        for batch in batches:
            if not len(batch):
                continue
            m = np.stack(batch["v"].to_numpy()).astype(np.float32)
            planes = np.random.default_rng(5).standard_normal((m.shape[1], tables_ * planes_)).astype(np.float32) if planes is None else planes
            bits = ((m @ planes) > 0).reshape(len(m), tables_, planes_) @ (1 << np.arange(planes_, dtype=np.int64))
            yield pd.DataFrame({"k": np.repeat(batch["k"].to_numpy(), tables_), "bucket": (bits + (np.arange(tables_, dtype=np.int64) << planes_)).ravel()})

    vectors = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias("k"), F.col(vector).cast("array<float>").alias("v"))
    buckets = vectors.mapInPandas(sign, f"k {kind}, bucket long")
    a, b = buckets.select(F.col("k").alias("a"), "bucket"), buckets.select(F.col("k").alias("b"), "bucket")
    pairs = a.join(b, "bucket").where("a < b").select("a", "b").distinct()
    both = pairs.join(vectors.select(F.col("k").alias("a"), F.col("v").alias("va")), "a").join(vectors.select(F.col("k").alias("b"), F.col("v").alias("vb")), "b")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda acc, p: acc + p)
    return both.where(dot(F.col("va"), F.col("vb")) >= threshold * F.sqrt(dot(F.col("va"), F.col("va")) * dot(F.col("vb"), F.col("vb")))).select("a", "b")


def diverse(df: DataFrame, key: str, vector: str, threshold: float, cut) -> DataFrame:  # type: ignore[no-untyped-def]
    """Keys that a greedy pass in key order keeps: those without a kept earlier neighbour.

    Rounds decide many keys at once: a key all of whose earlier neighbours are dropped is kept, a key with a kept
    earlier neighbour is dropped. The result is the greedy one; cut(df) writes a frame and reads it again.
    """
    edges = cut(near_vectors(df, key, vector, threshold))
    state = cut(df.select(F.col(key).alias("k"), F.lit(None).cast("boolean").alias("kept")))
    while True:
        earlier = edges.join(state.select(F.col("k").alias("a"), "kept"), "a").groupBy(F.col("b").alias("k")).agg(F.max("kept").alias("any_kept"), F.count_if(F.col("kept").isNull()).alias("open"))
        decided = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("any_kept"), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = cut(state.join(earlier, "k", "left").select("k", decided.alias("kept")))
        if not state.where("kept is null").limit(1).count():
            return state.where("kept").select(F.col("k").alias(key))


def html_body(html: Column, selectors: Sequence[str] = (), most: int = 100_000) -> Column:
    """Text of a page's main part: the first element whose class is one of the selectors, else the article, else the paragraphs.

    Where there is no paragraph either, all text counts. Scripts, styles and navigation are dropped, then tags; blanks
    are squeezed, blank lines go. An element ends at its first closing tag, so selectors should name innermost ones.
    """
    clean = F.regexp_replace(html, r"(?is)<(script|style|noscript|nav)[^>]*>.*?</\1\s*>", " ")
    picks = []
    for name in selectors:
        picks.append(lambda c, name=name: F.regexp_extract(c, rf'(?is)<(\w+)[^>]*class="[^"]*\b{name}\b[^"]*"[^>]*>(.*?)</\1\s*>', 2))
    picks.append(lambda c: F.regexp_extract(c, r"(?is)<article[^>]*>(.*?)</article\s*>", 1))
    picks.append(lambda c: F.array_join(F.regexp_extract_all(c, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>"), F.lit(1)), "\n"))
    main = let(clean, lambda c: F.coalesce(*(F.nullif(pick(c), F.lit("")) for pick in picks), c))
    text = F.regexp_replace(main, r"(?s)<[^>]+>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\x0B\f\r]+", " "), r" ?\n[ \n]*", "\n")
    return F.nullif(F.trim(F.substring(F.trim(F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")), 1, most)), F.lit(""))


def json_path(record: Column, path: str) -> Column:
    """The value at a path such as a.0.b in a JSON text; null if there is none."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.get_json_object(record, "$" + steps)


def filled(template: Column, values: Column) -> Column:
    """{{name}} in a template replaced by the value of the name, by nothing if it has none."""
    parts = F.arrays_zip(F.split(template, r"\{\{\w+\}\}", -1).alias("g"), F.regexp_extract_all(template, F.lit(r"\{\{(\w+)\}\}"), F.lit(1)).alias("n"))
    return F.array_join(F.transform(parts, lambda p: F.concat(p["g"], F.coalesce(F.element_at(values, p["n"]), F.lit("")))), "")


def rss_links(xml: Column, limit: int = 15) -> Column:
    """Links of a feed in order, each once, without those that name the feed itself."""
    plain = F.regexp_extract_all(xml, F.lit(r"<link>\s*(https?://[^<\s]+)\s*</link>"), F.lit(1))
    quoted = F.regexp_extract_all(xml, F.lit(r'<link[^>]+href="(https?://[^"]+)"'), F.lit(1))
    return F.slice(F.filter(F.array_distinct(F.concat(plain, quoted)), lambda u: ~F.lower(u).contains("rss")), 1, limit)


MARK = r'(?s)<([A-Z_]+)((?:\s+\w+="[^"]*")*)>(.*?)</\1>'


def marked(text: Column) -> Column:
    """STRUCT<text, labels>: text with <TYPE risk=".." suffix="..">value</TYPE> marks, compiled to clean text and labels.

    Nested, open and unknown marks are errors, which don't show the text. Null stays null.
    """
    parts = F.arrays_zip(F.split(text, MARK, -1).alias("g"), *(F.regexp_extract_all(text, F.lit(MARK), F.lit(k)).alias(n) for k, n in ((1, "type"), (2, "attributes"), (3, "value"))))
    attribute = lambda p, name: F.nullif(F.regexp_extract(p["attributes"], f'{name}="([^"]*)"', 1), F.lit(""))
    kind = "struct<text:string,labels:array<struct<start:int,end:int,entity:string,risk:string,suffix:string>>>"

    def step(acc: Column, p: Column) -> Column:
        start = F.length(acc["text"]) + F.length(p["g"])
        label = F.struct(start.alias("start"), (start + F.length(p["value"])).alias("end"), p["type"].alias("entity"), attribute(p, "risk").alias("risk"), attribute(p, "suffix").alias("suffix"))
        return F.struct(F.concat(acc["text"], p["g"], F.coalesce(p["value"], F.lit(""))).alias("text"), F.when(p["type"].isNull(), acc["labels"]).otherwise(F.concat(acc["labels"], F.array(label))).alias("labels")).cast(kind)

    start = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<start:int,end:int,entity:string,risk:string,suffix:string>>").alias("labels")).cast(kind)
    done = let(F.aggregate(parts, start, step), lambda d: F.when(d["text"].rlike(r"</?[A-Z_]{3,}[ >]") | F.exists(d["labels"], lambda x: x["end"] <= x["start"]), F.raise_error(F.lit("a mark is nested, open or empty")).cast(kind)).otherwise(d))
    return F.when(text.isNotNull(), done)
