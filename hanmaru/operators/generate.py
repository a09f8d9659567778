"""Synthetic identifiers with valid check digits, and mutations of values; all from hashes, so runs repeat."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hanmaru.functions.text import CIRCLED, replace_once
from hanmaru.functions.validate import BUSINESS_WEIGHTS, RESIDENT_WEIGHTS, weighted

ASCII_ALNUM = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
WIDE_ALNUM = "".join(chr(ord(c) + 0xFEE0) for c in ASCII_ALNUM)
# Readings of digits, Chinese and Latin spellings of family names, short forms.
READINGS = "공일이삼사오육칠팔구"
HANJA = dict(zip("김이박최정강조윤장임한오신홍류", "金李朴崔鄭姜趙尹張林韓吳申洪柳"))
ROMAN = {"김": "Kim", "이": "Lee", "박": "Park", "최": "Choi", "정": "Jung", "강": "Kang", "조": "Cho", "윤": "Yoon", "장": "Jang", "임": "Lim", "한": "Han", "오": "Oh", "신": "Shin", "홍": "Hong", "류": "Ryu"}
LEADS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"


def draw(seed: str, key: Column, below: int) -> Column:
    """A number in 0..below-1 from the hash of a seed and a key."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit(":"), key.cast("string"))), 1, 12), 16, 10).cast("long"), F.lit(below))


def padded(number: Column, n: int) -> Column:
    return F.lpad(number.cast("string"), n, "0")


def resident_numbers(spark: SparkSession, n: int, seed: str = "r") -> DataFrame:
    """(id, value): birth date, century digit, serial and check digit."""
    ids = spark.range(n)
    day = F.date_add(F.lit("1940-01-01").cast("date"), draw(seed + "d", F.col("id"), 29000).cast("int"))
    century = F.when(F.year(day) < 2000, F.lit(1)).otherwise(3) + draw(seed + "c", F.col("id"), 2).cast("int")
    body = F.concat(F.date_format(day, "yyMMdd"), century.cast("string"), padded(draw(seed + "s", F.col("id"), 100000), 5))
    check = F.pmod(11 - F.pmod(weighted(F.col("body"), RESIDENT_WEIGHTS), F.lit(11)), F.lit(10))
    rows = ids.select("id", body.alias("body"))
    return rows.select("id", F.concat(F.substring("body", 1, 6), F.lit("-"), F.substring("body", 7, 6), check.cast("string")).alias("value"))


def business_numbers(spark: SparkSession, n: int, seed: str = "b") -> DataFrame:
    rows = spark.range(n).select("id", padded(draw(seed, F.col("id"), 900_000_000) + 100_000_000, 9).alias("body"))
    ninth = F.substring("body", 9, 1).cast("int") * 5
    total = weighted(F.col("body"), BUSINESS_WEIGHTS[:8]) + F.floor(ninth / 10).cast("int") + F.pmod(ninth, F.lit(10))
    return rows.select("id", F.concat_ws("-", F.substring("body", 1, 3), F.substring("body", 4, 2), F.concat(F.substring("body", 6, 4), F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))).alias("value"))


def card_numbers(spark: SparkSession, n: int, seed: str = "k") -> DataFrame:
    """Sixteen digits that pass the Luhn test."""
    rows = spark.range(n).select("id", F.concat(F.lit("4"), padded(draw(seed, F.col("id"), 10**12), 14)).alias("body"))
    total = F.lit(0)
    for k in range(15):
        d = F.substring("body", k + 1, 1).cast("int")
        total = total + (d if k % 2 else F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))
    return rows.select("id", F.concat("body", F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")).alias("value"))


def each(text: Column, change) -> Column:  # type: ignore[no-untyped-def]
    return F.array_join(F.transform(F.split(text, ""), change), "")


def initial(c: Column) -> Column:
    """The initial consonant of a syllable; other characters as they are."""
    code = F.ascii(c)
    return F.when(code.between(0xAC00, 0xD7A3), F.substring(F.lit(LEADS), F.floor((code - 0xAC00) / 588).cast("int") + 1, F.lit(1))).otherwise(c)


# Letters of syllables, bold digits, short and foreign forms of labels, endings and what may stand for them.
VOWELS, TAILS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ", "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
BOLD = "𝟎𝟏𝟐𝟑𝟒𝟓𝟔𝟕𝟖𝟗"
SHORT = {"주민등록번호": "주번", "전화번호": "전번", "계좌번호": "계번", "신용카드": "카드", "이메일": "메일", "비밀번호": "비번"}
SWITCHED = {"주민등록번호": "resident registration number", "전화번호": "phone number", "계좌번호": "account number", "이메일": "email", "비밀번호": "password", "입니다": "is"}
FOREIGN = {
    "주민등록번호": {"ja": "住民登録番号", "zh": "居民登记号码", "de": "Einwohnernummer"}, "전화번호": {"ja": "電話番号", "zh": "电话号码", "de": "Telefonnummer"}, "이메일": {"ja": "メール", "zh": "电子邮件", "fr": "e-mail"}, "이름": {"ja": "名前", "zh": "姓名", "de": "Name"},
}
ENDINGS = {"입니다": "이에요", "는": "이란"}


def letters(c: Column) -> Column:
    """The letters of a syllable; other characters as they are."""
    code = F.ascii(c) - 0xAC00
    at = lambda table, k: F.substring(F.lit(table), k.cast("int"), F.lit(1))
    tail = F.pmod(code, F.lit(28))
    spelt = F.concat(at(LEADS, F.floor(code / 588) + 1), at(VOWELS, F.floor(F.pmod(code, F.lit(588)) / 28) + 1), F.when(tail > 0, at(TAILS, tail)).otherwise(""))
    return F.when(code.between(0, 11171), spelt).otherwise(c)


def bold(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]$"), F.element_at(F.array(*map(F.lit, BOLD)), c.try_cast("int") + 1)).otherwise(c)


def sentence_mutations(label: Column, value: Column) -> Column:
    """ARRAY<STRUCT<name, level, text>> of "label는 value입니다" and what becomes of it: short and foreign labels, other endings, contexts."""
    plain = F.concat(label, F.lit("는 "), value, F.lit("입니다"))
    forms = [
        ("plain", 0, plain, F.lit(True)), ("abbreviation", 4, replace_once(plain, SHORT), label.isin(*SHORT)), ("code_switch", 4, replace_once(plain, SWITCHED), label.isin(*SWITCHED)),
        *((f"ml_{lang}", 4, F.concat(mapped_label(label, lang), F.lit("는 "), value, F.lit("입니다")), mapped_label(label, lang).isNotNull()) for lang in ("ja", "zh", "de", "fr")),
        ("ending", 4, F.concat(label, F.lit("는 "), value, F.lit(ENDINGS["입니다"])), F.lit(True)), ("particle", 4, F.concat(label, F.lit(ENDINGS["는"]), F.lit(" "), value, F.lit("입니다")), F.lit(True)),
        ("prefixed", 5, F.concat(F.lit("시스템 점검 중입니다 ==== "), plain), F.lit(True)), ("json", 5, F.concat(F.lit('{"'), label, F.lit('":"'), value, F.lit('"}')), F.lit(True)), ("record", 5, F.concat(F.lit("고객 조회 결과: "), label, F.lit(" "), value), F.lit(True)),
    ]
    made = F.array(*(F.when(ok, F.struct(F.lit(name).alias("name"), F.lit(level).alias("level"), text.alias("text"))) for name, level, text, ok in forms))
    return F.filter(made, lambda m: m.isNotNull() & m["text"].isNotNull())


def mapped_label(label: Column, language: str) -> Column:
    table = {k: v[language] for k, v in FOREIGN.items() if language in v}
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), label)


def family(text: Column, table: dict[str, str], gap: str) -> Column:
    spelt = F.element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), F.substring(text, 1, 1))
    return F.when(spelt.isNotNull(), F.concat(spelt, F.lit(gap), F.substring(text, 2, 1000)))


def mutations(value: Column) -> Column:
    """ARRAY<STRUCT<name, level, text>> of the mutations that apply: those of digits need digits, dash forms a dash."""
    has_digit, has_dash = value.rlike("[0-9]"), value.contains("-")
    forms = [
        ("original", 0, value, F.lit(True)),
        ("fullwidth", 2, F.translate(value, ASCII_ALNUM, WIDE_ALNUM), has_digit),
        ("circled", 2, F.translate(value, "0123456789", CIRCLED), has_digit),
        ("zwsp", 1, each(value, lambda c: F.concat(c, F.lit("​"))), F.length(value) > 0),
        ("soft_hyphen", 1, F.array_join(F.split(value, ""), "­"), F.length(value) > 0),
        ("space_digits", 1, F.array_join(F.split(value, ""), " "), has_digit),
        ("kr_digits", 3, F.translate(value, "0123456789", READINGS), has_digit),
        ("no_dash", 1, F.replace(value, F.lit("-"), F.lit("")), has_dash),
        ("dots", 1, F.replace(value, F.lit("-"), F.lit(".")), has_dash),
        ("choseong", 3, each(value, initial), value.rlike("[가-힣]")),
        ("jamo", 3, each(value, letters), value.rlike("[가-힣]")),
        ("homoglyph", 2, each(value, bold), has_digit),
        ("emoji", 2, F.array_join(F.transform(F.split(value, ""), lambda c, k: F.when(k % 3 == 2, F.concat(c, F.lit("🔒"))).otherwise(c)), ""), F.length(value) > 2),
        ("combining", 2, F.regexp_replace(value, "([0-9])", "$1\u0301"), has_digit),
        ("hanja", 3, family(value, HANJA, ""), value.rlike("^[가-힣]{2,4}$")),
        ("romanize", 3, family(value, ROMAN, " "), value.rlike("^[가-힣]{2,4}$")),
    ]
    made = F.array(*(F.when(ok, F.struct(F.lit(name).alias("name"), F.lit(level).alias("level"), text.alias("text"))) for name, level, text, ok in forms))
    return F.filter(made, lambda m: m.isNotNull() & m["text"].isNotNull())


def partly_masked(value: Column) -> Column:
    """Phone numbers keep their ends, mail addresses two letters of the name, other digits all but the last four."""
    phone = F.regexp_replace(value, r"^(\d{2,3})-(\d{3,4})-(\d{4})$", "$1-****-$3")
    mail = F.regexp_replace(value, r"^(.{1,2})[^@]*(@.*)$", "$1***$2")
    return F.when(value.rlike(r"^\d{2,3}-\d{3,4}-\d{4}$"), phone).when(value.contains("@"), mail).otherwise(F.regexp_replace(value, r"\d(?=(?:\D*\d){4})", "*"))


# Forms of identifiers and facts. {a-b} is a number, {#n} n digits, {@n} n hex digits, {x|y} a choice.
FORMS = {
    "dob": "{1940-2005}년 {1-12}월 {1-28}일", "passport": "{M|S|R|G}{#8}", "driver": "{11-28}-{10-99}-{#6}-{10-99}", "age": "{18-85}", "gender": "{남성|여성|남|여}", "nationality": "{대한민국|한국|미국|일본|중국}", "marital": "{기혼|미혼|이혼|사별}",
    "blood": "{A형|B형|O형|AB형} {Rh+|Rh-}", "biometric": "FINGERPRINT-{2020-2026}-{@8}", "face_id": "FACE-ID-{#8}", "phone": "{010|011|016|017|019}-{1000-9999}-{#4}", "landline": "{02|031|032|051|053|042|062}-{100-9999}-{#4}", "work_phone": "{02|031}-{100-999}-{#4} 내선 {100-999}",
    "fax": "02-{100-999}-{#4}", "email": "{user|admin|info|desk}{#4}@{mail|post|web}.example", "emergency": "비상연락처: 010-{1000-9999}-{#4} ({배우자|부모|형제})", "cvv": "{100-999}", "expiry": "{01|02|03|04|05|06|07|08|09|10|11|12}/{26-32}", "salary": "{2800-12000}만원",
    "stock": "{삼성|미래에셋|키움}증권 {#5}-{#2}-{#6}", "crypto": "0x{@40}", "iban": "{DE|FR|GB}{10-99}{#18}", "swift": "{KOEX|HNBN|SHBK|NACF}KRSE", "credit_score": "NICE 신용점수 {300-900}점", "loan": "{주택담보|신용|전세자금}대출 {1000-50000}만원", "health_ins": "{#8}-{10-99}", "body": "{150-195}cm, {40-120}kg",
    "medical_rec": "MRN-{2018-2026}-{#6}", "username": "{kim|lee|park}_{#4}", "password": "{Blue|Green|Red}{#4}!", "ip": "{1-223}.{0-255}.{0-255}.{1-254}", "mac": "{@2}:{@2}:{@2}:{@2}:{@2}:{@2}", "url": "https://{a|b}.example/user/{#5}", "social": "{카카오ID: |인스타: @}user{#5}", "aws_key": "AKIA{#16}",
    "session": "SESSION_{@24}", "jwt": "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.{@32}", "emp_id": "{EMP|사번}-{2018-2026}-{#4}", "hire_date": "{2010-2025}년 {1-12}월 {1-28}일 입사", "work_email": "{kim|lee|park}.{#3}@{samsung|lg|kakao}.com", "insurance4": "{국민연금|건강보험|고용보험|산재보험}: {#4}-{#6}",
    "retirement": "퇴직금 {500-50000}만원 ({2015-2025}년 기준)", "student_id": "{2018-2026}{#5}", "gpa": "{2-4}.{0-4}/4.5", "grad_year": "{2018-2026}년 {2|8}월 졸업", "plate": "{10-99}{가|나|다|라|마}{#4}", "vehicle_reg": "{서울|부산|대구|인천} {2020-2026}-{#6}", "car_ins": "{삼성화재|현대해상|DB손해보험} AUTO-{2020-2026}-{#8}",
    "military": "{20-26}-7{#7}", "crime": "{2020-2025}고단{#4} {벌금형|징역형|집행유예|무죄}", "court": "{2020-2026}가합{#5}", "immigration": "{2024-2026}-0{1-9}-{10-28} {인천→도쿄|인천→LA|김포→하네다} 출국", "visa": "{F-4|E-7|D-10|F-2|H-1}-{#8}", "voter": "선거인번호 {#6}-{#4}", "property": "{#4}-{2020-2026}-{#6}",
    "family": "부: 김{대|영|철|민}수({1955-1975}), 모: 이{영|미|정}희({1955-1975})", "gps": "3{7-8}.{#4}°N, 12{6-9}.{#4}°E", "parcel": "{CJ대한통운|한진택배|로젠택배} 6{#12}", "flight": "{KE|OZ|7C|LJ}{100-999} {ICN→NRT|ICN→JFK|GMP→HND}", "ins_policy": "{삼성생명|한화생명|교보생명} {L|H|A}-{2020-2026}-{#7}",
    "political": "{○○당|△△당} 당원번호 {2020-2026}-{#5}", "cctv": "CAM-{B1|B2|1F|2F|주차장}-{#3}", "voice": "녹취록 ({2026-2026}.{1-12}.{1-28})", "transaction": "{카드승인|계좌이체|자동이체} ({편의점|마트|카페}) {1000-99000}원", "account": "110-{#3}-{#6}", "address": "가람시 나루구 {새|큰|긴}길 {1-300}",
    "work_addr": "가람시 {새|큰}로 {1-300} {3-20}층", "surgery": "{2018-2025}.{10-12} {위절제술|관절경수술|백내장수술}", "disability": "{지체|시각|청각|지적}장애 {1-6}급", "prescription": "{메트포르민|아스피린|암로디핀} {5-500}mg", "degree": "{전자공학과|경영학과|심리학과} {학사|석사|박사}", "course_grade": "{운영체제|알고리즘|인공지능} {A+|A|B+|B|C}",
    "hospital": "{내과|외과|안과|피부과} {김|이|박|최}○○ 교수", "ssh": "ssh-rsa AAAAB3NzaC1yc2E{@32} user@host", "aws_secret": "s{@32}{#7}",
}
#: Facts that are words of the screening lists of the same kind.
FACTS = ("diagnosis", "allergy", "mental", "religion", "orientation", "school", "job_title", "company", "dept")
PIECE = re.compile(r"\{([^}]*)\}")


def pieces_of(form: str) -> list[tuple[str, object]]:
    """("text", t), ("number", (a, b)), ("digits", n), ("hex", n) and ("choice", [..]) of a form, in order."""
    out: list[tuple[str, object]] = []
    at = 0
    for m in PIECE.finditer(form):
        if m.start() > at:
            out.append(("text", form[at : m.start()]))
        inner = m.group(1)
        if inner[0] in "#@":
            out.append(("digits" if inner[0] == "#" else "hex", int(inner[1:])))
        elif re.fullmatch(r"\d+-\d+", inner):
            a, b = inner.split("-")
            out.append(("number", (int(a), int(b))))
        else:
            out.append(("choice", inner.split("|")))
        at = m.end()
    return out + ([("text", form[at:])] if at < len(form) else [])


def shaped(form: str, kind: str, key: Column) -> Column:
    """A value of a form; the same for the same kind and key."""

    def one(k: int, what: str, of) -> Column:  # type: ignore[no-untyped-def]
        seed = f"{kind}{k}"
        if what == "text":
            return F.lit(of)
        if what == "number":
            return (draw(seed, key, of[1] - of[0] + 1) + of[0]).cast("string")
        if what == "choice":
            return F.element_at(F.array(*map(F.lit, of)), (draw(seed, key, len(of)) + 1).cast("int"))
        stuff = F.concat(*(F.md5(F.concat(F.lit(f"{seed}.{j}:"), key.cast("string"))) for j in range(-(-of // 32))))
        return F.substring(F.translate(stuff, "abcdef", "012345") if what == "digits" else stuff, 1, of)

    return F.concat(*(one(k, what, of) for k, (what, of) in enumerate(pieces_of(form))))


def luhn_digit(body: Column, n: int) -> Column:
    """The digit that completes n digits to a number that passes the Luhn test."""
    total = F.lit(0)
    for k in range(n):
        d = F.substring(body, n - k, 1).cast("int")
        total = total + (F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2) if k % 2 == 0 else d)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


# Letters of vehicle numbers, weights of their places.
VEHICLE_LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZ"
VEHICLE_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)


def vehicle_number(body: Column) -> Column:
    """A vehicle number of 17 characters with its check digit in the ninth place. Letters count 1 to 10 by turns."""
    total = F.lit(0)
    for k, w in enumerate(VEHICLE_WEIGHTS):
        c = F.substring(body, k + 1, 1)
        place = F.call_function("instr", F.lit(VEHICLE_LETTERS), c)
        total = total + w * F.when(place > 0, F.pmod(place - 1, F.lit(10)) + 1).otherwise(F.coalesce(c.try_cast("int"), F.lit(0)))
    rest = F.pmod(total, F.lit(11))
    return F.concat(F.substring(body, 1, 8), F.when(rest == 10, "X").otherwise(rest.cast("string")), F.substring(body, 10, 8))


def generated(keys: DataFrame, key: str, words: dict[str, Sequence[str]]) -> DataFrame:
    """(key, kind, value): a value of every kind for every key; words gives those of FACTS."""
    k = F.col(key)
    forms = {**FORMS, **{fact: "{" + "|".join(words[fact]) + "}" for fact in FACTS}}
    values = {kind: shaped(form, kind, k) for kind, form in forms.items()}
    imei = shaped("{#14}", "device", k)
    values["device"] = F.concat(F.lit("IMEI: "), imei, luhn_digit(imei, 14))
    letters = F.upper(F.translate(F.substring(F.md5(F.concat(F.lit("vin:"), k.cast("string"))), 1, 17), "0123456789abcdef", "0123456789ABCDEF"))
    values["vin"] = vehicle_number(letters)
    area = draw("ssn0", k, 898) + 1
    values["ssn"] = F.concat_ws("-", padded(F.when(area >= 666, area + 1).otherwise(area), 3), padded(draw("ssn1", k, 99) + 1, 2), padded(draw("ssn2", k, 9999) + 1, 4))
    return keys.select(key, F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), v.alias("value")) for kind, v in values.items()))).alias("x")).select(key, "x.kind", "x.value")
