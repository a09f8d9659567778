"""Detectors: each turns a text column into an array of candidate spans, inside the row.

One Arrow pass scans a batch of texts and their variants with compiled patterns and notes the labels that stand before a
match; validators are column expressions over the few matches that are left. (The same patterns as nested array
expressions, which the JVM interprets, took ten times as long.)
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

from hanmaru.functions import validate as V
from hanmaru.functions.lists import COMPANIES, GIVEN_NAMES, HONORIFICS, HOSPITALS, LABELS, PARTICLES, RELATIONS, ROADS, SCHOOLS, SCORES, SURNAMES, UNITS
from hanmaru.functions.text import let, literal, variants_of

#: start, end: half open, in code points of the stored text.
SPAN = "array<struct<start:int,end:int,text:string,entity:string,score:double,detector:string>>"


def either(terms: Iterable[str]) -> str:
    """An alternation, longest first; blanks in a term match any white space."""
    return "(?:" + "|".join(r"\s*".join(map(literal, t.split())) for t in sorted(terms, key=len, reverse=True)) + ")"


AFTER = f"(?=(?:{either([*PARTICLES, *HONORIFICS])})*(?:[^가-힣]|$))"
#: A number behind a road or unit, with house, building, room and floor as far as they follow.
TRAILER = r"\s*\d{1,4}(?:\s*-\s*\d{1,4})?(?:\s*번지)?(?:\s+\d{1,3}\s*동)?(?:\s+\d{1,4}\s*호)?(?:\s+\d{1,3}\s*층)?"
SEPARATOR = r"\s*(?::|#|-|=|은|는|이|가)?\s*"
# Patterns by rule. A group v, where there is one, is the value.
PATTERNS = {
    "registration": r"(?<!\d)\d{6}\s*-?\s*\d{7}(?!\d)",
    "phone": r"(?<!\d)0\d{1,2}[\s-]?\d{3,4}[\s-]?\d{4}(?!\d)",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "network.ipv4": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d)(?!\.\d)",
    "network.ipv6": r"(?<![A-Fa-f0-9:])(?:[A-Fa-f0-9]{0,4}:){2,}[A-Fa-f0-9:]{0,4}(?![A-Fa-f0-9:])",
    "network.mac": r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f])",
    "credit_card": r"(?<!\d)(?:\d[\s-]?){13,19}(?!\d)",
    "business_reg_no": r"(?<!\d)\d{3}-?\d{2}-?\d{5}(?!\d)",
    "passport": r"(?i)(?<![A-Z0-9])[A-Z]\d{8}(?![A-Z0-9])",
    "driver_license": r"(?<!\d)\d{2}-\d{2}-\d{6}-\d{2}(?!\d)",
    "corporate_reg_no": r"(?<!\d)(?:110111|110114|110115|110121|134511)-?\d{7}(?!\d)",
    "medical_record_no": f"(?i){either(LABELS['record'])}{SEPARATOR}(?P<v>MR-\\d{{4}}-\\d{{6}})",
    "dob": f"(?i){either(['생년월일', '생일', '출생일', 'DOB', 'date of birth'])}{SEPARATOR}(?P<v>(?:19|20)\\d{{2}}\\s*년\\s*\\d{{1,2}}\\s*월\\s*\\d{{1,2}}\\s*일|(?:19|20)\\d{{2}}-\\d{{2}}-\\d{{2}})",
    "device_id": f"(?i){either(['기기번호', '단말기 ID', '디바이스 ID', 'device id'])}{SEPARATOR}(?P<v>device-[A-Za-z0-9-]{{8,}})",
    "vehicle_reg_no": f"(?i){either(['차량번호', '차량 등록번호', 'vehicle no'])}{SEPARATOR}(?P<v>\\d{{2,3}}[가-힣]\\d{{4}})",
    "bank_account": r"(?<!\d)\d{2,6}(?:[- ]\d{1,7}){1,4}(?!\d)",
    "secret": r"(?<![A-Za-z0-9_=-])(?:sk-[A-Za-z0-9_=-]{16,}|gh[po]_[A-Za-z0-9]{16,}|xox[bp]-[A-Za-z0-9-]{16,}|AKIA[0-9A-Z]{16})(?![A-Za-z0-9_=-])",
    "address": f"{either(UNITS)}{AFTER}(?:\\s+{either(UNITS)}{AFTER})*(?:\\s*{either(ROADS)}(?:{TRAILER})?)?",
    "address.road": f"(?<![가-힣]){either(ROADS)}{TRAILER}",
    "address.room": rf"(?<!\d)(?:\d{{1,3}}\s*동\s+)?\d{{1,4}}\s*호(?!\d)(?=(?:{either(PARTICLES)})*(?:[^가-힣]|$))",
    "school": f"[가-힣A-Za-z0-9]+{either(SCHOOLS)}(?=(?:{either(PARTICLES)})*(?:[^가-힣A-Za-z0-9]|$))",
    "hospital": f"[가-힣A-Za-z0-9]+{either(HOSPITALS)}(?=(?:{either(PARTICLES)})*(?:[^가-힣A-Za-z0-9]|$))",
    "organization": f"[가-힣A-Za-z0-9]+{either(COMPANIES)}(?=(?:{either(PARTICLES)})*(?:[^가-힣A-Za-z0-9]|$))",
    "relation": either(RELATIONS),
    "full_name": f"(?<![가-힣])[{SURNAMES}]{either(GIVEN_NAMES)}{AFTER}",
    "given_name": f"(?<![가-힣]){either(n for n in GIVEN_NAMES if len(n) > 1)}{AFTER}",
}
#: Detectors: the rules of each. What an earlier rule of a dictionary has found hides what a later one finds inside it.
STRUCTURED = {
    "registration": ("registration",), "phone": ("phone",), "email": ("email",), "network": ("network.ipv4", "network.ipv6", "network.mac"), "card": ("credit_card",), "business": ("business_reg_no",),
    "document": ("passport", "driver_license", "corporate_reg_no"), "labelled": ("medical_record_no", "dob", "device_id", "vehicle_reg_no"), "account": ("bank_account",), "secret": ("secret",),
}
DICTIONARY = {"address": ("address", "address.road", "address.room"), "affiliation": ("school", "hospital", "organization"), "relation": ("relation",), "name": ("full_name", "given_name")}
WINDOW = {"order": 32}


@lru_cache(maxsize=None)
def compiled(rule: str) -> re.Pattern:
    return re.compile(PATTERNS[rule], re.ASCII)


@lru_cache(maxsize=None)
def label_before(group: str) -> re.Pattern:
    """A label of a group right before a place."""
    return re.compile("(?i)" + either(LABELS[group]) + r"\s*(?::|#|-|은|는|이|가)?\s*$", re.ASCII)


@lru_cache(maxsize=None)
def label_anywhere(group: str) -> re.Pattern:
    return re.compile("(?i)" + either(LABELS[group]))


#: The labels that matter to a rule; account also counts where it occurs since the last separator.
MINDED = {
    "registration": ("corporate", "personal"), "phone": ("order",), "credit_card": ("corporate", "business", "order", "account"), "business_reg_no": ("order", "account", "business", "record"),
    "passport": ("passport",), "driver_license": ("licence",), "bank_account": ("order",),
}


def labels_of(text: str, start: int, groups: tuple[str, ...]) -> list[str]:
    out = []
    for group in groups:
        before = text[max(0, start - WINDOW.get(group, 64)) : start]
        if group == "account":
            found = label_anywhere(group).search(re.split(r"[\n\r,;.|]", before)[-1])
        else:
            found = label_before(group).search(before)
        if found:
            out.append(group)
    return out


#: What a text must hold for a rule to be tried.
NEEDS: dict[str, Callable[[str], object]] = {
    **dict.fromkeys((r for d in STRUCTURED.values() for r in d), re.compile(r"\d").search), "email": lambda t: "@" in t, "secret": re.compile("sk-|gh[po]_|xox|AKIA").search, "network.ipv6": lambda t: t.count(":") > 1, "network.mac": re.compile("[:-]").search,
    "address.road": re.compile(r"\d").search, "address.room": lambda t: "호" in t,
    "school": re.compile(either(SCHOOLS)).search, "hospital": re.compile(either(HOSPITALS)).search, "organization": re.compile(either(COMPANIES)).search,
}


def matches(text: str, rules: Iterable[str]) -> Iterator[tuple[str, int, int, str, list[str]]]:
    """(rule, start, end, value, labels) of one spelling of a text."""
    for rule in rules:
        need = NEEDS.get(rule)
        if need and not need(text):
            continue
        for m in compiled(rule).finditer(text):
            start, end = m.span("v") if "v" in m.re.groupindex else m.span()
            value, labels = text[start:end], labels_of(text, start, MINDED.get(rule, ()))
            if rule == "network.ipv6":
                try:
                    ip = ipaddress.IPv6Address(value)
                except ValueError:
                    continue
                labels = ["private"] if ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast else []
            yield rule, start, end, value, labels


FOUND = "array<struct<rule:string,start:int,end:int,value:string,labels:array<string>>>"


def scan(text: Column, detectors: list[str], others: bool) -> Column:
    """All matches of the rules of these detectors in a text and, if asked for, its variants; in order of spelling and detector."""
    structured, dictionary = [d for d in detectors if d in STRUCTURED], [d for d in detectors if d in DICTIONARY]

    def of_spelling(spelling: str, named: list[str], starts: list[int] | None, ends: list[int] | None) -> Iterator[dict]:
        for detector in named:
            taken: list[tuple[int, int]] = []
            for rule in (STRUCTURED | DICTIONARY)[detector]:
                new = []
                for _, a, b, value, labels in matches(spelling, (rule,)):
                    if detector in DICTIONARY and any(x <= a and b <= y for x, y in taken):
                        continue
                    new.append((a, b))
                    if starts is not None and ends is not None:
                        a, b = min(starts[a:b]), max(ends[a:b])
                    yield {"rule": rule, "start": a, "end": b, "value": value, "labels": labels}
                taken += new

    def all_of(value: str | None) -> list[dict] | None:
        if value is None:
            return None
        out = list(of_spelling(value, detectors, None, None))
        if others:
            for name, spelling, starts, ends in variants_of(value):
                out += of_spelling(spelling, structured + (dictionary if name == "folded" else []), starts, ends)
        return out

    @F.pandas_udf(FOUND)
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([all_of(t) for t in column], dtype=object)

    return run(text)


def decision(m: Column) -> list[tuple[str, Column | str, Column | float]]:
    """(rule, type or null for a match that fails its validator, score)."""
    v = m["value"]
    has = lambda *groups: F.arrays_overlap(m["labels"], F.array(*map(F.lit, groups)))
    kept = lambda ok, entity: F.when(ok, entity)
    phone = V.phone_class(v)
    private = F.when(V.ipv4_class(v) == "private", SCORES["IP_PRIVATE"]).otherwise(SCORES["IP_PUBLIC"])
    full = v.rlike(f"{either(ROADS)}{TRAILER}$")
    return [
        ("registration", F.when(has("corporate") & ~has("personal"), None).when(V.resident(v), "RRN").when(V.resident(v, foreign=True), "FRN"), SCORES["RRN"]),
        ("phone", F.when(~has("order"), phone), F.when(phone == "PHONE_MOBILE", SCORES["PHONE_MOBILE"]).otherwise(SCORES["PHONE_LANDLINE"])),
        ("email", kept(V.email(v), "EMAIL"), SCORES["EMAIL"]),
        ("network.ipv4", kept(V.ipv4_class(v).isNotNull(), "IP_ADDRESS"), private),
        ("network.ipv6", "IP_ADDRESS", F.when(has("private"), SCORES["IP_PRIVATE"]).otherwise(SCORES["IP_PUBLIC"])),
        ("network.mac", kept(V.mac(v).isNotNull(), "MAC_ADDRESS"), SCORES["MAC_ADDRESS"]),
        ("credit_card", kept(V.card(v) & ~has("corporate", "business", "order", "account"), "CREDIT_CARD"), SCORES["CREDIT_CARD"]),
        ("business_reg_no", kept(V.business(v) & phone.isNull() & ~has("order", "record") & (~has("account") | has("business")), "BUSINESS_REG_NO"), SCORES["BUSINESS_REG_NO"]),
        ("passport", kept(has("passport"), "PASSPORT"), SCORES["PASSPORT"]),
        ("driver_license", kept(has("licence"), "DRIVER_LICENSE"), SCORES["DRIVER_LICENSE"]),
        ("corporate_reg_no", "CORPORATE_REG_NO", SCORES["CORPORATE_REG_NO"]),
        ("medical_record_no", "MEDICAL_RECORD_NO", SCORES["MEDICAL_RECORD_NO"]),
        ("dob", "DOB", SCORES["DOB"]),
        ("device_id", "DEVICE_ID", SCORES["DEVICE_ID"]),
        ("vehicle_reg_no", "VEHICLE_REG_NO", SCORES["VEHICLE_REG_NO"]),
        ("bank_account", kept(v.rlike("[- ]") & V.bank_layout(v).isNotNull() & phone.isNull() & ~has("order"), "BANK_ACCOUNT"), SCORES["BANK_ACCOUNT"]),
        ("secret", kept(V.secret(v), "API_KEY_SECRET"), SCORES["API_KEY_SECRET"]),
        ("address", F.when(full, "ADDRESS_FULL").otherwise("ADDRESS_UNIT"), F.when(full, SCORES["road"]).otherwise(SCORES["unit"])),
        ("address.road", "ADDRESS_FULL", SCORES["road"]),
        ("address.room", "ADDRESS_UNIT", SCORES["apartment"]),
        ("school", "SCHOOL", SCORES["school"]),
        ("hospital", "HOSPITAL", SCORES["hospital"]),
        ("organization", "ORGANIZATION", SCORES["organization"]),
        ("relation", "FAMILY_RELATION", SCORES["relation"]),
        ("full_name", "PERSON_NAME", SCORES["full"]),
        ("given_name", "PERSON_NAME", SCORES["given"]),
    ]


def candidates(text: Column, detectors: Iterable[str] | None = None, variants: bool = True) -> Column:
    """All candidates of the named detectors (all by default), duplicates folded, by start, end and type.

    The text is scanned as it is, then its variants, whose spans go back to the offsets of the text: structured values in
    all of them, words of the dictionaries in the folded text. A detector that isn't named isn't part of the plan. Null
    text gives null, empty text an empty array.
    """
    known = STRUCTURED | DICTIONARY
    named = list(detectors or known)
    unknown = set(named) - set(known)
    if unknown:
        raise ValueError(f"unknown detectors: {', '.join(sorted(unknown))}")
    used = {rule for name in named for rule in known[name]}

    def build(m: Column) -> Column:
        made = lambda entity, score: F.struct((F.lit(entity) if isinstance(entity, str) else entity).alias("e"), (F.lit(score) if isinstance(score, float) else score).cast("double").alias("s"))
        decided = F.coalesce(*(F.when(m["rule"] == rule, made(entity, score)) for rule, entity, score in decision(m) if rule in used))
        origin = F.when(m["rule"].isin([r for d in STRUCTURED.values() for r in d]), "regex.").otherwise("dictionary.")
        place = F.substring(text, m["start"] + 1, m["end"] - m["start"])
        return let(decided, lambda d: F.struct(m["start"].alias("start"), m["end"].alias("end"), place.alias("text"), d["e"].alias("entity"), d["s"].alias("score"), F.concat(origin, m["rule"]).alias("detector")))

    return let(scan(text, named, variants), lambda found: fold(F.filter(F.transform(found, build), lambda s: s["entity"].isNotNull()).cast(SPAN)))


#: Types that patterns alone would give, without validators, labels and variants.
PATTERN_ONLY = {
    "registration": ("RRN", "RRN"), "phone": ("PHONE_MOBILE", "PHONE_MOBILE"), "email": ("EMAIL", "EMAIL"), "network.ipv4": ("IP_ADDRESS", "IP_PUBLIC"), "network.mac": ("MAC_ADDRESS", "MAC_ADDRESS"),
    "credit_card": ("CREDIT_CARD", "CARD_PATTERN"), "business_reg_no": ("BUSINESS_REG_NO", "BUSINESS_PATTERN"), "bank_account": ("BANK_ACCOUNT", "BANK_ACCOUNT"), "secret": ("API_KEY_SECRET", "API_KEY_SECRET"),
}


def by_pattern(text: Column) -> Column:
    """Candidates of patterns alone, as a base line; a registration number counts as that of a resident and of a foreigner."""
    names = [d for d, rules in STRUCTURED.items() if set(rules) & set(PATTERN_ONLY)]
    pairs = F.create_map(*(F.lit(x) for r, (e, s) in PATTERN_ONLY.items() for x in (r, f"{e}")))
    scores = F.create_map(*(x for r, (e, s) in PATTERN_ONLY.items() for x in (F.lit(r), F.lit(SCORES[s]))))
    one = lambda m, entity: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("text"), entity.alias("entity"), F.element_at(scores, m["rule"]).alias("score"), F.concat(F.lit("pattern."), m["rule"]).alias("detector"))
    kept = lambda found: F.filter(found, lambda m: m["rule"].isin(*PATTERN_ONLY))
    both = lambda found: F.concat(F.transform(kept(found), lambda m: one(m, F.element_at(pairs, m["rule"]))), F.transform(F.filter(found, lambda m: m["rule"] == "registration"), lambda m: one(m, F.lit("FRN"))))
    return let(scan(text, names, False), lambda found: both(found).cast(SPAN))


def fold(found: Column) -> Column:
    """One span for each start, end and type, with its best score and the names of all its detectors, joined by commas."""
    ordered = F.array_sort(found, lambda a, b: compare([(a["start"], b["start"], 1), (a["end"], b["end"], 1), (a["entity"], b["entity"], 1), (a["score"], b["score"], -1), (a["detector"], b["detector"], 1)]))

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        same = F.coalesce((last["start"] == s["start"]) & (last["end"] == s["end"]) & (last["entity"] == s["entity"]), F.lit(False))
        names = F.when(F.array_contains(F.split(last["detector"], ","), s["detector"]), last["detector"]).otherwise(F.concat(last["detector"], F.lit(","), s["detector"]))
        both = F.struct(*(last[c].alias(c) for c in ("start", "end", "text", "entity", "score")), names.alias("detector"))
        return F.when(same, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both).cast(SPAN))).otherwise(F.concat(acc, F.array(s).cast(SPAN)))

    return F.aggregate(ordered, F.array().cast(SPAN), step)


def compare(keys: list[tuple[Column, Column, int]]) -> Column:
    """A comparator over several keys; the third says whether small (1) or large (-1) comes first."""
    out = F.lit(0)
    for a, b, way in reversed(keys):
        out = F.when(a < b, F.lit(-way)).when(a > b, F.lit(way)).otherwise(out)
    return out
