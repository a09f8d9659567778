"""From candidates to masked text: boundaries, context, overlaps, decisions, placeholders, and what may leave the system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hanmaru.functions.lists import BANKS, COMPOSITES, FAMILY, FIELD_TERMS, HONORIFICS, NEGATIVE, PARTICLES, PRIORITY, RISK, TITLES
from hanmaru.functions.text import hmac_sha256, let, literal, sentences
from hanmaru.operators.detect import candidates, compare, either

BASE = ("start", "end", "text", "entity", "score", "detector")
FIELDS = "start:int,end:int,text:string,entity:string,score:double,detector:string,suffix:string,sentence:int,composite:boolean,risk:string,reasons:array<string>"
#: A span in its context; with the decision about it.
SEEN, FULL = f"array<struct<{FIELDS}>>", f"array<struct<{FIELDS},action:string,method:string>>"
ADDRESSES = ("ADDRESS_FULL", "ADDRESS_UNIT")
PHONES = ("PHONE_MOBILE", "PHONE_LANDLINE")
# Types whose ends are corrected, what may stand behind a particle, how an address may end.
RULED = ("PERSON_NAME", "ADDRESS_FULL", "ADDRESS_UNIT", "ORGANIZATION", "SCHOOL", "HOSPITAL", "PHONE_MOBILE", "PHONE_LANDLINE", "EMAIL", "BANK_ACCOUNT", "RRN", "FRN", "CREDIT_CARD")
BREAKS = ".,!?;:)]}\"'、。，，？！…/\\|"
TERMINALS = ("로", "길", "번지", "동", "호", "읍", "면", "리", "구", "군", "시", "도")
# Scores from which a decision falls, the token of a full redaction.
P0_MASK, P1_MASK, P1_CONTEXT, P2_CONTEXT, P3_CONTEXT = 0.55, 0.75, 0.55, 0.75, 0.90
REDACTED = "[REDACTED]"
#: The decisions that an output target or a profile takes for a type, the target's first.
OVERRIDES = {"strict": {"API_KEY_SECRET": "block", "RRN": "full_redact", "FRN": "full_redact"}, "external_output": {"API_KEY_SECRET": "block"}}
BLOCKED_BY_TARGET = {"external_output": ("API_KEY_SECRET",)}
TARGETS = ("llm_input", "external_output", "audit_log")
SECRET, KEY_ID = b"local-only-key", "local"


def mapped(key: Column, table: dict[str, str], default: Column) -> Column:
    """table[key], else default."""
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.element_at(pairs, key), default)


def only(*pairs: tuple[Column, str]) -> Column:
    """The codes whose condition holds, in order."""
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in pairs)), lambda x: x.isNotNull())


def changed(s: Column, names: tuple[str, ...], **new: Column) -> Column:
    return F.struct(*(new.get(n, s[n]).alias(n) for n in (*names, *(k for k in new if k not in names))))


ENDINGS, PERSON_ENDINGS = f"(?s)(?<=.){either(PARTICLES)}$", f"(?s)(?<=.){either([*PARTICLES, *HONORIFICS])}$"


def parted(value: Column, person: Column, rounds: int = 4) -> Column:
    """STRUCT<body, suffix>: particles taken from the end one by one, the longest first; one character stays."""
    kind = "struct<body:string,suffix:string>"

    def step(acc: Column, _: Column) -> Column:
        end = F.when(person, F.regexp_extract(acc["body"], PERSON_ENDINGS, 0)).otherwise(F.regexp_extract(acc["body"], ENDINGS, 0))
        return let(end, lambda e: F.struct(F.substring(acc["body"], F.lit(1), F.length(acc["body"]) - F.length(e)).alias("body"), F.concat(e, acc["suffix"]).alias("suffix")).cast(kind))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(value.alias("body"), F.lit("").alias("suffix")).cast(kind), step)


def without_suffix(value: Column, person: bool = False, rounds: int = 4) -> Column:
    """The value without its particles, if two characters of a person's name, one of anything else, are left."""
    return let(parted(value, F.lit(person), rounds), lambda p: F.when(F.length(p["body"]) >= (2 if person else 1), p["body"]).otherwise(value))


def suffix_after(text: Column, end: Column, entity: Column) -> Column:
    """The run of particles right behind a span, each as long as can be, if a break follows it; else null."""
    behind = F.substring(text, end + 1, F.lit(24))
    stop = f"(?=[\\s{''.join(map(literal, BREAKS))}]|$)"
    person = F.regexp_extract(behind, f"(?U)^((?>{either([*PARTICLES, *HONORIFICS])})++){stop}", 1)
    other = F.regexp_extract(behind, f"(?U)^((?>{either(PARTICLES)})++){stop}", 1)
    return F.nullif(F.when(entity == "PERSON_NAME", person).otherwise(other), F.lit(""))


def corrected(text: Column, found: Column) -> Column:
    """Ends put right, by the first rule that fits: particles inside go; half a word behind an address goes; particles behind are noted.

    Adds suffix and reasons; types without rules stay as they are.
    """

    def one(s: Column) -> Column:
        person, address = s["entity"] == "PERSON_NAME", s["entity"].isin(*ADDRESSES)
        loose = F.regexp_extract(s["text"], r"(?s)^(.*\S)\s+[가-힣]$", 1)  # an address and one more syllable
        clipped = address & (loose != "") & (loose.rlike(r"\d") | loose.rlike(f"(?:{'|'.join(TERMINALS)})$")) & F.substring(text, s["end"] + 1, F.lit(1)).rlike("[가-힣]")

        def by(p: Column) -> Column:
            inside = (p["suffix"] != "") & ~(person & (F.length(p["body"]) < 2)) & ~(address & (p["suffix"] == "로") & s["detector"].contains("dictionary.address.road"))
            body = F.when(inside, p["body"]).when(clipped, loose).otherwise(s["text"])
            behind = suffix_after(text, s["end"], s["entity"])
            return let(
                F.struct(inside.alias("inside"), body.alias("body"), F.when(inside, p["suffix"]).when(~clipped, behind).alias("suffix")),
                lambda c: changed(
                    s, BASE, end=s["start"] + F.length(c["body"]), text=c["body"], suffix=c["suffix"],
                    reasons=only((c["inside"], "boundary.suffix_trim"), (~c["inside"] & clipped, "boundary.address_partial_word_trim"), (~c["inside"] & ~clipped & c["suffix"].isNotNull(), "boundary.suffix_lookahead")),
                ),
            )

        plain = changed(s, BASE, suffix=F.lit(None).cast("string"), reasons=F.array().cast("array<string>"))
        kind = "struct<start:int,end:int,text:string,entity:string,score:double,detector:string,suffix:string,reasons:array<string>>"
        return F.when(s["entity"].isin(*RULED), let(parted(s["text"], person), by).cast(kind)).otherwise(plain.cast(kind))

    return F.transform(found, one)


def terms(where: Column, group: tuple[str, ...]) -> Column:
    return where.rlike("|".join(map(literal, group)))


def scored(text: Column, found: Column) -> Column:
    """Adds sentence, composite and risk; boosts and penalties of the sentence change the score (0 to 1) and are named in reasons."""

    def number(parts: Column, start: Column) -> Column:
        return F.greatest(F.size(F.filter(parts, lambda p: p["start"] <= start)) - 1, F.lit(0))

    def surroundings(parts: Column, placed: Column, s: Column) -> Column:
        others = F.filter(placed, lambda o: (o["n"] == s["n"]) & ((o["s"]["start"] != s["s"]["start"]) | (o["s"]["end"] != s["s"]["end"]) | (o["s"]["entity"] != s["s"]["entity"])))
        sentence = F.get(parts, s["n"])
        at = s["s"]["start"] - sentence["start"]
        return F.struct(
            s["s"].alias("s"), s["n"].alias("n"), F.coalesce(sentence["text"], F.lit("")).alias("sentence"),
            F.coalesce(F.concat(F.substring(sentence["text"], F.lit(1), at), F.lit(" "), F.substring(sentence["text"], F.greatest(at, F.lit(0)) + s["s"]["end"] - s["s"]["start"] + 1, F.length(sentence["text"]))), F.lit("")).alias("around"),
            F.substring(text, F.greatest(s["s"]["start"] - 23, F.lit(1)), F.least(s["s"]["start"], F.lit(24))).alias("left"), F.substring(text, s["s"]["end"] + 1, F.lit(8)).alias("right"),
            F.array_distinct(F.transform(others, lambda o: o["s"]["entity"])).alias("types"),
        )

    def one(c: Column) -> Column:
        s, sentence, types = c["s"], c["sentence"], c["types"]
        is_ = lambda *kinds: s["entity"].isin(*kinds)
        person, phone, address = is_("PERSON_NAME"), is_(*PHONES), is_(*ADDRESSES)
        meets = lambda *kinds: F.arrays_overlap(types, F.array(*map(F.lit, kinds)))
        rules = [
            (person & terms(c["left"], FIELD_TERMS["name"]), 0.25, "boost.field_label_name"), (person & terms(c["right"], (*HONORIFICS, *TITLES)), 0.15, "boost.title_after_name"),
            (person & meets(*PHONES), 0.20, "boost.phone_cooccur_for_person"), (person & meets(*ADDRESSES), 0.15, "boost.address_cooccur_for_person"),
            (phone & terms(sentence, FIELD_TERMS["phone"]) & ~terms(sentence, NEGATIVE["example"]), 0.15, "boost.field_label_phone"), (address & terms(sentence, FIELD_TERMS["address"]), 0.20, "boost.field_label_address"),
            (is_("ADDRESS_FULL") & s["text"].rlike("동|호|번지|로|길"), 0.20, "boost.full_address_detail"), (is_("ORGANIZATION") & terms(sentence, FIELD_TERMS["organization"]), 0.25, "boost.organization_affiliation_context"),
            (is_("BANK_ACCOUNT") & terms(sentence, FIELD_TERMS["account"]), 0.30, "boost.field_label_account"), (is_("BANK_ACCOUNT") & terms(sentence, BANKS), 0.25, "boost.bank_cooccur"),
            (is_("MEDICAL_RECORD_NO", "HOSPITAL") & terms(sentence, FIELD_TERMS["medical"]), 0.20, "boost.medical_label"),
            (person & s["text"].isin(*NEGATIVE["example"]), -0.35, "penalty.example_keyword_for_person"), (person & terms(sentence, NEGATIVE["weather"]), -0.35, "penalty.weather_context_for_person"),
            ((person | address) & terms(sentence, NEGATIVE["code"]), -0.20, "penalty.code_or_log_context"), (person & terms(sentence, NEGATIVE["business"]), -0.25, "penalty.organization_not_person"),
            (person & terms(sentence, NEGATIVE["abstract"]), -0.20, "penalty.abstract_value_context_for_person"), (phone & terms(sentence, NEGATIVE["public"]), -0.25, "penalty.public_phone_context"),
            (is_("IP_ADDRESS") & s["text"].rlike(r"^(?:10\.|127\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)"), -0.25, "penalty.private_ip"), (terms(c["around"], NEGATIVE["example"]), -0.15, "penalty.example_context"),
        ]
        hits = F.filter(F.array(*(F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(w).alias("w"), F.lit(f"context.{code}").alias("code"))) for on, w, code in rules)), lambda h: h.isNotNull())
        peers = lambda rule: F.array(*(F.lit(t) for t in sorted(rule)))
        first = F.coalesce(*(F.when(F.array_contains(peers(r), s["entity"]) & (F.size(F.array_except(peers(r), F.concat(types, F.array(s["entity"])))) == 0), F.array_except(peers(r), F.array(s["entity"]))) for r in COMPOSITES))

        def done(h: Column) -> Column:
            total = F.aggregate(h["hits"], s["score"], lambda acc, x: acc + x["w"])
            codes = F.concat(s["reasons"], F.transform(h["hits"], lambda x: x["code"]), F.coalesce(F.transform(h["first"], lambda t: F.concat(F.lit("context.composite."), t)), F.array().cast("array<string>")))
            return changed(
                s, BASE, score=F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 6), suffix=s["suffix"], sentence=c["n"], composite=h["first"].isNotNull(), risk=mapped(s["entity"], RISK, F.lit("P3")), reasons=codes,
            ).cast(f"struct<{FIELDS}>")

        return let(F.struct(hits.alias("hits"), first.alias("first")), done)

    placed = lambda x: F.transform(x["found"], lambda s: F.struct(number(x["parts"], s["start"]).alias("n"), s.alias("s")))
    all_of = lambda x, there: F.transform(there, lambda s: let(surroundings(x["parts"], there, s), one))
    return let(F.struct(sentences(text).alias("parts"), found.alias("found")), lambda x: let(placed(x), lambda there: all_of(x, there)))


def suppressed(found: Column) -> Column:
    """Names strictly inside a longer organisation, school or hospital go."""
    inside = lambda o, s: o["entity"].isin("ORGANIZATION", "SCHOOL", "HOSPITAL") & (o["start"] <= s["start"]) & (s["end"] <= o["end"]) & (o["end"] - o["start"] > s["end"] - s["start"])
    return let(found, lambda all_: F.filter(all_, lambda s: (s["entity"] != "PERSON_NAME") | ~F.exists(all_, lambda o: inside(o, s))))


def resolved(found: Column) -> Column:
    """Greedy choice without overlaps: by priority of the type, length, score, start; the result in text order.

    Spans that won against another one say so in their reasons.
    """
    rank = {e: f"{k:02d}" for k, e in enumerate(PRIORITY)}
    key = lambda s: mapped(s["entity"], rank, F.lit("99"))
    ordered = F.array_sort(found, lambda a, b: compare([(key(a), key(b), 1), (a["end"] - a["start"], b["end"] - b["start"], -1), (a["score"], b["score"], -1), (a["start"], b["start"], 1)]))
    meet = lambda k, s: (k["start"] < s["end"]) & (s["start"] < k["end"])
    won = lambda o, s: F.size(F.filter(o, lambda k: meet(k, s))) > 1
    names = tuple(x.split(":")[0] for x in FIELDS.split(","))

    def kept(o: Column) -> Column:
        chosen = F.aggregate(o, F.slice(o, F.lit(1), F.lit(0)), lambda acc, s: F.when(F.exists(acc, lambda k: meet(k, s)), acc).otherwise(F.concat(acc, F.array(s))))
        return F.transform(chosen, lambda s: changed(s, names, reasons=F.concat(s["reasons"], only((won(o, s), "resolver.overlap.kept")))).cast(f"struct<{FIELDS}>"))

    return F.array_sort(let(ordered, kept), lambda a, b: compare([(a["start"], b["start"], 1)]))


def escalated(found: Column) -> Column:
    """Spans whose sentence holds all types of a composite rule: P2 and P3 become P1."""
    names = tuple(x.split(":")[0] for x in FIELDS.split(","))

    def one(all_: Column, s: Column) -> Column:
        types = F.transform(F.filter(all_, lambda o: o["sentence"] == s["sentence"]), lambda o: o["entity"])

        def by(here: Column) -> Column:
            member = F.lit(False)
            for rule in COMPOSITES:
                array = F.array(*map(F.lit, rule))
                member = member | (F.array_contains(array, s["entity"]) & (F.size(F.array_except(array, here)) == 0))
            raised = s["risk"].isin("P2", "P3")
            return let(member, lambda m: changed(
                s, names, composite=s["composite"] | m, risk=F.when(m & raised, "P1").otherwise(s["risk"]),
                reasons=F.concat(s["reasons"], only((m & raised, "resolver.composite.upgrade:P1"), (m & ~raised, "resolver.composite.match"))),
            ).cast(f"struct<{FIELDS}>"))

        return let(F.array_distinct(types), by)

    return let(found, lambda all_: F.transform(all_, lambda s: one(all_, s)))


def joined_fragments(text: Column, found: Column) -> Column:
    """Neighbouring addresses with nothing but white space between them become one full address; other spans stay between.

    found is in text order without overlaps, of SEEN; so is the result.
    """
    kind = f"array<struct<{FIELDS}>>"

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        both = F.struct(
            last["start"].alias("start"), s["end"].alias("end"), F.substring(text, last["start"] + 1, s["end"] - last["start"]).alias("text"), F.lit("ADDRESS_FULL").alias("entity"), F.greatest(last["score"], s["score"]).alias("score"),
            F.array_join(F.array_union(F.split(last["detector"], ","), F.split(s["detector"], ",")), ",").alias("detector"), F.coalesce(s["suffix"], last["suffix"]).alias("suffix"), last["sentence"].alias("sentence"),
            (last["composite"] | s["composite"]).alias("composite"), F.lit(RISK["ADDRESS_FULL"]).alias("risk"), F.array_union(F.array_union(last["reasons"], s["reasons"]), F.array(F.lit("resolver.address.fragment_merge"))).alias("reasons"),
        )
        gap = F.substring(text, last["end"] + 1, s["start"] - last["end"])
        meets = F.coalesce(last["entity"].isin(*ADDRESSES) & s["entity"].isin(*ADDRESSES) & gap.rlike(r"^\s*$"), F.lit(False))
        return F.when(meets, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both).cast(kind))).otherwise(F.concat(acc, F.array(s).cast(kind)))

    return F.aggregate(found, F.array().cast(kind), step)


def decided(found: Column, target: str = "llm_input", profile: str = "strict") -> Column:
    """Adds action (BLOCK, MASK, HASH, PASS) and method: the first line of the decision list that holds, named in reasons."""
    if target not in TARGETS or profile not in OVERRIDES:
        raise ValueError(f"unknown target or profile: {target}, {profile}")
    override = OVERRIDES[profile] | OVERRIDES.get(target, {})
    of = lambda method: [e for e, m in override.items() if m == method]
    names = tuple(x.split(":")[0] for x in FIELDS.split(","))

    def lines(s: Column) -> list[tuple[Column, str, str, str]]:
        has = lambda *starts: F.exists(s["reasons"], lambda r: r.rlike("^context\\.(?:" + "|".join(map(literal, starts)) + ")"))
        boosted, example = has("boost."), has("penalty.example_context", "penalty.example_keyword_for_person")
        strong = s["composite"] | has("boost.", "composite.")
        contact = s["entity"].isin(*PHONES, "EMAIL") & ((example & ~boosted) | (s["entity"].isin(*PHONES) & has("penalty.public_phone_context")))
        doubtful = has("penalty.weather_context_for_person", "penalty.organization_not_person", "penalty.example_context", "penalty.example_keyword_for_person", "penalty.code_or_log_context")
        nobody = (s["entity"] == "PERSON_NAME") & ~boosted & (example | (~s["composite"] & doubtful))
        risk = lambda level, least: (s["risk"] == level) & (s["score"] >= least)
        return [
            (s["entity"].isin(*BLOCKED_BY_TARGET.get(target, ())), "BLOCK", "block", "policy.target.block_entity"), (s["entity"].isin(*of("block")), "BLOCK", "block", "policy.override.block"),
            (s["entity"].isin(*of("full_redact")), "MASK", "full_redact", "policy.override.full_redact"), (s["entity"] == "API_KEY_SECRET", "BLOCK", "block", "policy.entity.api_key_secret"),
            (contact | nobody, "PASS", "pass", "policy.negative_context.pass"), (risk("P0", P0_MASK), "MASK", "full_redact", "policy.risk.p0_full_redact"), (s["risk"] == "P0", "PASS", "pass", "policy.risk.p0_below_threshold"),
            (s["composite"], "MASK", "label_mask", "policy.composite.mask"), (risk("P1", P1_MASK), "MASK", "label_mask", "policy.risk.p1_threshold"), (risk("P1", P1_CONTEXT) & strong, "MASK", "label_mask", "policy.risk.p1_context"),
            (s["risk"] == "P1", "PASS", "pass", "policy.risk.p1_below_threshold"), (risk("P2", P2_CONTEXT) & strong, "MASK", "label_mask", "policy.risk.p2_context"), (s["risk"] == "P2", "PASS", "pass", "policy.risk.p2_no_context"),
            (risk("P3", P3_CONTEXT) & strong, "MASK", "label_mask", "policy.risk.p3_context"), (F.lit(True), "PASS", "pass", "policy.risk.p3_no_context"),
        ]

    def decision(s: Column) -> Column:
        if target == "audit_log":
            return F.struct(F.lit("HASH").alias("action"), F.lit("hmac_hash").alias("method"), F.array(F.lit("policy.target.audit_log"), F.lit("policy.method.hmac_hash")).alias("why"))
        return F.coalesce(*(F.when(on, F.struct(F.lit(action).alias("action"), F.lit(method).alias("method"), F.array(F.lit(why)).alias("why"))) for on, action, method, why in lines(s)))

    kind = f"struct<{FIELDS},action:string,method:string>"
    return F.transform(found, lambda s: let(decision(s), lambda d: changed(s, names, reasons=F.concat(s["reasons"], d["why"]), action=d["action"], method=d["method"]).cast(kind)))


def masked(text: Column, found: Column, secret: bytes = SECRET, key_id: str = KEY_ID) -> Column:
    """Spliced text; null if a span blocks. Equal values of a family share a number, in order of appearance.

    Full redactions have one token for all, hashes a keyed hash of the value. Overlapping spans are an error.
    """
    family = lambda s: mapped(s["entity"], FAMILY, s["entity"])
    acting = F.filter(found, lambda s: s["action"].isin("MASK", "HASH"))
    named = lambda s: F.struct(family(s).alias("f"), s["text"].alias("t"))

    def token(distinct: Column, s: Column) -> Column:
        upto = F.slice(distinct, F.lit(1), F.greatest(F.array_position(distinct, named(s)).cast("int"), F.lit(1)))
        label = F.concat(F.lit("["), family(s), F.lit("_"), F.size(F.filter(upto, lambda u: u["f"] == family(s))).cast("string"), F.lit("]"))
        return F.when(s["method"] == "full_redact", REDACTED).when(s["method"] == "hmac_hash", hmac_sha256(s["text"], secret, key_id)).otherwise(label)

    def splice(acting: Column, distinct: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        between = lambda acc, s: F.when(s["start"] < acc["at"], F.raise_error(F.lit("overlapping spans can't be masked")).cast("string")).otherwise(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]))
        step = lambda acc, s: F.struct(F.concat(acc["out"], between(acc, s), token(distinct, s)).alias("out"), s["end"].alias("at"))
        return F.aggregate(acting, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))

    labelled = lambda a: F.array_distinct(F.transform(F.filter(a, lambda s: s["method"] == "label_mask"), named))
    spliced = let(acting, lambda a: F.when(F.size(a) == 0, text).otherwise(let(labelled(a), lambda d: splice(a, d))))
    return F.when(F.exists(found, lambda s: s["action"] == "BLOCK"), F.lit(None).cast("string")).otherwise(spliced)


def guarded(df: DataFrame, text: str = "text", target: str = "llm_input", detectors: list[str] | None = None, trace: bool = False) -> DataFrame:
    """df with spans, masked and blocked; with trace also the number of spans after each stage. One narrow pass.

    Each step is a column of its own, so none is computed twice. Null text gives null, empty text no span.
    """
    t = F.col(text)
    stages = [
        ("candidates", lambda _: candidates(t, detectors)), ("boundary", lambda s: corrected(t, s)), ("context", lambda s: scored(t, s)), ("overlap", lambda s: resolved(suppressed(s))),
        ("composite", lambda s: escalated(joined_fragments(t, s))), ("policy", lambda s: decided(s, target)),
    ]
    steps, counts = df, []
    for name, stage in stages:
        steps = steps.withColumn("spans", stage(F.col("spans") if name != "candidates" else None))
        if trace:
            steps = steps.withColumn(f"_n_{name}", F.size("spans"))
            counts.append(F.struct(F.lit(name).alias("stage"), F.col(f"_n_{name}").alias("n")))
    steps = steps.withColumn("masked", masked(t, F.col("spans"))).withColumn("blocked", F.exists("spans", lambda s: s["action"] == "BLOCK"))
    return steps.withColumn("trace", F.array(*counts)).drop(*(f"_n_{name}" for name, _ in stages)) if trace else steps


def public(guarded_df: DataFrame, *keys: str, secret: bytes = SECRET, key_id: str = KEY_ID) -> DataFrame:
    """(keys, spans): what may be shown: no value, a keyed hash for spans that are acted on."""
    shown = lambda s: F.struct(
        *(s[c].alias(c) for c in ("start", "end", "entity", "score", "detector", "suffix", "composite", "risk", "reasons", "action")), F.when(s["action"] != "PASS", hmac_sha256(s["text"], secret, key_id)).alias("value_hash")
    )
    return guarded_df.select(*keys, F.transform("spans", shown).alias("spans"))


def audit(guarded_df: DataFrame, key: str, secret: bytes = SECRET, key_id: str = "k1", target: str = "llm_input", profile: str = "strict") -> DataFrame:
    """One event for each acting span: place, type, action, why, and a keyed hash, never the value.

    An event that would show the value (in its key, say) is dropped, the others stay.
    """
    events = guarded_df.select(key, F.explode("spans").alias("s")).where("s.action <> 'PASS'")
    fields = [key, *(f"s.{c}" for c in ("start", "end", "entity", "action", "risk", "score", "detector", "suffix", "reasons", "composite", "method"))]
    made = events.select(
        *fields, (F.col("s.end") - F.col("s.start")).alias("span_length"), hmac_sha256(F.col("s.text"), secret, key_id).alias("value_hash"), F.lit(profile).alias("profile"), F.lit(target).alias("target"), F.lit(False).alias("raw_value_logged"),
        F.col("s.text").alias("_value"),
    )
    shown = F.concat_ws("\n", *(F.col(c).cast("string") for c in (key, "suffix", "detector")), F.array_join("reasons", "\n"))
    return made.where(~shown.contains(F.col("_value"))).drop("_value")


def storable(masked_text: Column, text: Column, found: Column) -> Column:
    """Masked text in which no found value stands any more, wherever else it occurred."""
    return F.when(masked_text.isNotNull(), F.aggregate(found, masked_text, lambda out, s: F.when(F.length(s["text"]) > 0, F.replace(out, s["text"], F.concat(F.lit("[UNSTORED_"), s["entity"], F.lit("]")))).otherwise(out)))


def field_summary(fields: Column, found: Column) -> Column:
    """A line for each field of a composed record: types and actions of the spans in it, or its length.

    fields: ARRAY<STRUCT<name, start, end>>.
    """
    def line(f: Column) -> Column:
        inside = F.transform(F.filter(found, lambda s: (s["start"] < f["end"]) & (f["start"] < s["end"])), lambda s: F.concat(F.lit("["), s["entity"], F.lit(":"), s["action"], F.lit("]")))
        return F.concat(f["name"], F.lit(": "), F.when(F.size(inside) > 0, F.array_join(inside, " ")).otherwise(F.concat(F.lit("[NO_DETECTED_PII len="), (f["end"] - f["start"]).cast("string"), F.lit("]"))))

    return F.when(F.size(fields) > 0, F.array_join(F.transform(fields, line), "\n")).otherwise(F.lit("[NO_FIELDS]"))


OUTPUT_BLOCKED = "The response was withheld because it holds a secret."


def outgoing(df: DataFrame, text: str, arguments: bool = False) -> DataFrame:
    """Adds shown: a text on its way out, masked; a blocked one gives a fixed message, or {} for arguments of a call."""
    done = guarded(df, text, "external_output")
    return done.withColumn("shown", F.when(F.col("blocked"), "{}" if arguments else OUTPUT_BLOCKED).otherwise(F.col("masked")))


def islands(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds island: overlapping intervals of a document share a number; gaps of any size part them."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("opens", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)).withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")
