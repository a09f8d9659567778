"""Validators of identifiers as column expressions: true, false, or null for a null value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hanmaru.functions.text import fold_digits

# Weights of check digits.
RESIDENT_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)
BUSINESS_WEIGHTS = (1, 3, 7, 1, 3, 7, 1, 3, 5)
# Account layouts by bank: digits of each segment, and prefixes of the first where only some are valid.
BANKS = (
    ("국민은행", (6, 2, 6), ()), ("국민은행", (3, 2, 4, 3), ()), ("신한은행", (3, 3, 6), ()), ("우리은행", (3, 6, 2, 3), ()), ("우리은행", (4, 3, 6), ()),
    ("하나은행", (3, 6, 5), ()), ("하나은행", (3, 2, 5, 1), ()), ("농협은행", (3, 2, 6), ()), ("농협은행", (3, 4, 4, 2), ()), ("기업은행", (3, 6, 2, 3), ()),
    ("카카오뱅크", (4, 2, 7), ("3333", "7979", "7942", "7777")), ("토스뱅크", (4, 4, 4), ("1000", "1001")), ("케이뱅크", (3, 3, 6), ()), ("케이뱅크", (4, 4, 4), ("1001", "1020")),
)


def digits(value: Column) -> Column:
    return F.regexp_replace(fold_digits(value), r"\D", "")


def digit(value: Column, k: int) -> Column:
    """The k-th digit (from 0) as a number."""
    return F.substring(value, k + 1, 1).try_cast("int")


def weighted(value: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for k, w in enumerate(weights):
        total = total + digit(value, k) * w
    return total


def placeholder(d: Column) -> Column:
    """Empty, one digit repeated, or a plain run."""
    return (d == "") | d.rlike(r"^(\d)\1*$") | d.isin("1234567890123", "1234567890123456")


def birth_date(d: Column, foreign: bool) -> Column:
    """Date of yymmdd with the century of the seventh digit; null if there is no such day."""
    century = digit(d, 6)
    if foreign:
        year = F.when(century.isin(5, 6), "19").when(century.isin(7, 8), "20")
    else:
        year = F.when(century.isin(9, 0), "18").when(century.isin(1, 2), "19").when(century.isin(3, 4), "20")
    return F.try_to_date(F.concat(year, F.substring(d, 1, 6)), "yyyyMMdd")


def resident_check(d: Column) -> Column:
    return F.pmod(11 - F.pmod(weighted(d, RESIDENT_WEIGHTS), F.lit(11)), F.lit(10)) == digit(d, 12)


def resident(value: Column, mode: str = "off", foreign: bool = False) -> Column:
    """13 digits with a real birth date; mode strict also wants the check digit."""
    d = digits(value)
    ok = d.rlike(r"^\d{13}$") & ~placeholder(d) & birth_date(d, foreign).isNotNull()
    return F.when(value.isNotNull(), ok & resident_check(d) if mode == "strict" else ok)


def phone_class(value: Column) -> Column:
    """PHONE_MOBILE, PHONE_LANDLINE or null."""
    d = digits(value)
    return F.when(d.rlike(r"^(?:010\d{8}|01[16789]\d{7,8})$"), "PHONE_MOBILE").when(d.rlike(r"^(?:02\d{7,8}|0(?:3[1-3]|4[1-4]|5[1-5]|6[1-4])\d{7,8})$"), "PHONE_LANDLINE")


def email(value: Column) -> Column:
    """At most 254 characters, 64 before the sign, labels of at most 63 without outer dashes, letters at the end."""
    host = F.substring_index(value, "@", -1)
    local = F.substring_index(value, "@", 1)
    labels = F.split(host, r"\.", -1)
    return (
        (F.length(value) <= 254) & (F.length(local).between(1, 64)) & (F.length(F.regexp_replace(value, "[^@]", "")) == 1) & (F.size(labels) >= 2)
        & F.forall(labels, lambda x: F.length(x).between(1, 63) & ~x.startswith("-") & ~x.endswith("-")) & F.element_at(labels, -1).rlike(r"^[A-Za-z]{2,}$")
    )


def card(value: Column) -> Column:
    d = digits(value)
    # luhn_check wants digits only; anything else is false before it is asked.
    return F.when(d.rlike(r"^\d{13,19}$") & ~placeholder(d), F.call_function("luhn_check", d)).otherwise(F.when(value.isNotNull(), False))


def business(value: Column) -> Column:
    """Ten digits whose check digit holds; the ninth product carries."""
    d = digits(value)
    ninth = digit(d, 8) * BUSINESS_WEIGHTS[8]
    total = weighted(d, BUSINESS_WEIGHTS[:8]) + F.floor(ninth / 10).cast("int") + F.pmod(ninth, F.lit(10))
    return d.rlike(r"^\d{10}$") & ~placeholder(d) & (F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)) == digit(d, 9))


def bank_layout(value: Column) -> Column:
    """bank:6_2_6 of the first layout that fits a dashed or bare account number; null if none does."""
    plain = F.replace(F.trim(value), F.lit(" "), F.lit(""))
    size = F.length(F.regexp_replace(plain, r"\D", ""))
    out = None
    for bank, segments, prefixes in BANKS:
        first = "(?:" + "|".join(prefixes) + f")" if prefixes else r"\d{%d}" % segments[0]
        rest = [r"\d{%d}" % n for n in segments[1:]]
        fits = plain.rlike("^" + "-".join([first, *rest]) + "$") | plain.rlike("^" + "".join([first, *rest]) + "$")
        label = f"{bank}:{'_'.join(map(str, segments))}"
        out = F.when(fits, label) if out is None else out.when(fits, label)
    return F.when(size.between(9, 16) & ~placeholder(F.regexp_replace(plain, r"\D", "")), out)


def ipv4_class(value: Column) -> Column:
    """private, public, or null for what is no address."""
    octets = F.split(value, r"\.")
    part = [octets[k].cast("int") for k in range(4)]
    valid = value.rlike(r"^(?:(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])\.){3}(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])$")
    private = (
        part[0].isin(0, 10, 127) | (part[0] >= 224) | ((part[0] == 172) & part[1].between(16, 31)) | ((part[0] == 192) & (part[1] == 168)) | ((part[0] == 169) & (part[1] == 254))
        | ((part[0] == 192) & (part[1] == 0) & part[2].isin(0, 2)) | ((part[0] == 198) & part[1].isin(18, 19)) | ((part[0] == 198) & (part[1] == 51) & (part[2] == 100)) | ((part[0] == 203) & (part[1] == 0) & (part[2] == 113))
    )
    return F.when(valid & private, "private").when(valid, "public")


def mac(value: Column) -> Column:
    """Lower case with colons; null unless six pairs are joined by one kind of sign."""
    return F.when(value.rlike(r"^[0-9A-Fa-f]{2}([:-])[0-9A-Fa-f]{2}(?:\1[0-9A-Fa-f]{2}){4}$"), F.lower(F.replace(value, F.lit("-"), F.lit(":"))))


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(value, "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def secret(value: Column) -> Column:
    """A known prefix, 20 characters, two classes of characters and an entropy of 3 bits behind the prefix."""
    tail = F.when(value.startswith("AKIA"), F.substring(value, 5, 10_000)).otherwise(F.regexp_replace(value, r"^(?:sk-|gh[po]_|xox[bp]-)", ""))
    classes = sum((tail.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[_=-]")), F.lit(0))
    return value.rlike(r"^(?:sk-|gh[po]_|xox[bp]-|AKIA)[A-Za-z0-9_=-]+$") & (F.length(value) >= 20) & (classes >= 2) & (entropy(tail) >= 3.0)


def bio_valid(names: Column) -> Column:
    """Every I- label continues a B- or I- label of its type."""
    before = lambda k: F.when(k == 0, "O").otherwise(F.get(names, k - 1))
    pairs = F.transform(names, lambda n, k: F.struct(before(k).alias("a"), n.alias("b")))
    return F.forall(pairs, lambda p: ~p["b"].startswith("I-") | (F.substring(p["a"], 3, 99) == F.substring(p["b"], 3, 99)) & (p["a"] != "O"))
