"""Personal information inside free text: a linear-chain conditional random field over word shapes.

A text is folded first (widths, look-alike letters, circled digits, invisible and decomposed characters; every folded
character knows its place in the stored text), then split into words: address-like and number-like pieces are words of
their own. The field sees, for each word and its two neighbours on either side, the word, its shape, its ends, what a
particle leaves of it, and pairs of neighbouring shapes, all hashed. It is trained on a small labelled table: reviewed
cases, at most ``REVIEWED`` of them, each several times with values of its types from other reviewed cases, and the
marked sentences below, which share no wording with the tables (though their kinds were chosen with errors on them in
view, see README) and keep the field sane where hardly anything is reviewed.
It is decoded by Viterbi in NumPy batches; a word's contributions are computed once per worker. Spans are then trimmed
of particles, titles and punctuation.

Null and empty texts hold nothing. Repeated rows give the same spans; p5_found lists each once.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hanmaru.llm.lookalike import IGNORABLE, shape

REVIEWED = 1500
BITS = 17
TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
LABELS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))
OF_ENTITY = {
    "PERSON_NAME": "NAME", "ADDRESS_FULL": "ADDRESS", "PHONE_MOBILE": "PHONE", "PHONE_LANDLINE": "PHONE", "EMAIL": "EMAIL",
    "RRN": "ID_NUMBER", "FRN": "ID_NUMBER", "PASSPORT": "ID_NUMBER", "DRIVER_LICENSE": "ID_NUMBER",
}
# Family names, numerals and particles of Korean.
SURNAMES = "김이박최정강조윤장임한오서신권황안송류홍전고문손양배백허남심노하곽성차주우구민유나진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국어은편용경봉사부"
DOUBLE = ("남궁", "황보", "제갈", "선우", "독고", "사공", "서문", "동방", "어금", "망절")
NUMERALS = "공영일이삼사오육칠팔구"
PARTICLES = (
    "이라고합니다", "이라고", "입니다만", "입니다", "입니까", "이었습니다", "였습니다", "이시며", "님께서는", "님께서", "님에게", "님께", "님은", "님이", "님의", "님",
    "씨에게", "씨께", "씨는", "씨가", "씨의", "씨", "에게서", "에게", "께서는", "께서", "께", "한테", "이며", "이고", "이나", "이랑", "으로", "에서", "까지", "부터", "라고",
    "은", "는", "이", "가", "을", "를", "의", "과", "와", "로", "에", "도", "만", "랑", "나", "며", "고",
)
CLEAR = {"는", "를", "의", "과", "와", "에", "께", "만", "랑", "며"}

MAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*\s?(?:@|\(at\)|\[at\]|\{at\}|\(골뱅이\)|골뱅이)\s?[A-Za-z0-9-]+(?:\s?\.\s?[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
ID = r"(?<![\d-])\d{6}\s?[- ]?\s?\d{7}(?![\d-])|(?<![\d-])\d{2}-\d{2}-\d{6}-\d{2}(?![\d-])|(?<![A-Za-z\d])[A-Z](?:\d{8}|\d{3}[A-Z]\d{4})(?![A-Za-z\d])"
PHONE = (
    r"(?<![\d-])(?:\+\s?82[-. )]{0,2}\(?0?\d{1,2}|\(\+82\)\s?0?\d{1,2}|\(0\d{1,2}\)|0\d{1,2})[-. )]{0,2}\d{3,4}[-. ]{0,2}\d{4}(?![\d-])"
    r"|(?<![가-힣])[공영일이삼사오육칠팔구]{2,3}[-. ]?[공영일이삼사오육칠팔구]{3,4}[-. ]?[공영일이삼사오육칠팔구]{4}|(?<![\d-])1[568]\d{2}-\d{4}(?![\d-])"
)
WORD = re.compile(rf"{MAIL}|{ID}|{PHONE}|\d+(?:[-.,:]\d+)*|[가-힣]+|[A-Za-z]+(?:[-'][A-Za-z]+)*|\S", re.S)
MAILS, IDS, PHONES = (re.compile(x).fullmatch for x in (MAIL, ID, PHONE))
PLAIN = re.compile(r"[\x00-\x7F가-힣]*")

# Marked sentences: types in braces mark what is to be found.
MARKED = (
    "자료는 {EMAIL} 주소로 보내시면 됩니다.", "답장은 {EMAIL} 앞으로 주셔도 좋아요.", "제 메일 {EMAIL}을 한번 봐 주세요.", "Send the form to {EMAIL} before Friday.", "{EMAIL} bounced twice today.", "아이디 {EMAIL}, 비밀번호 초기화 바람.",
    "급한 일은 {PHONE}에 전화하세요.", "대표 {PHONE}, 팩스 {PHONE}.", "통화가 되는 곳은 {PHONE} 뿐입니다.", "Call {PHONE} for help.", "{PHONE}로 온 통화를 놓쳤다.", "호출은 {PHONE}!", "집 {PHONE}, 손전화 {PHONE}",
    "외국인등록번호 {ID_NUMBER}로 조회가 됩니다.", "여권 {ID_NUMBER} 사본을 붙였습니다.", "운전면허 {ID_NUMBER} 갱신 대상", "주민등록번호는 {ID_NUMBER} 이고 유효합니다.", "{ID_NUMBER}는 이미 쓰인 번호예요.", "Passport {ID_NUMBER} expires soon.", "{NAME} [{ID_NUMBER}] 본인 맞음",
    "사무실을 {ADDRESS}로 옮겼습니다.", "현장은 {ADDRESS} 건너편입니다.", "등기상 소재지 {ADDRESS}", "The office moved to {ADDRESS} last year.", "{ADDRESS}에서 내려 주세요.", "우편물은 {ADDRESS} 우편함에 있다.", "집은 {ADDRESS}, 직장은 {ADDRESS}입니다.",
    "{NAME} 변호사가 변론을 맡았다.", "{NAME} 씨와 길게 통화했다.", "어제는 {NAME}의 생일이었다.", "대표이사 {NAME}", "{NAME}, {NAME} 두 사람만 남았다.", "Dr. {NAME} signed it.", "심사는 {NAME}가 했다.", "심사는 {NAME}이 했다.", "{NAME} 선수에게 졌다.", "감독 {NAME}, 주연 {NAME}", "{NAME}님, 반갑습니다.", "Regards, {NAME}",
    "{NAME} {TITLE}에게 물었다.", "{NAME} {TITLE}이 결재했다.", "{NAME} {TITLE}와 의논한 다음", "회의에 {NAME} {TITLE}도 왔다.", "이 일은 {NAME} {TITLE}께 맡기자.", "{NAME} {TITLE}님, 감사합니다.", "{TITLE} {NAME}", "{TITLE}: {NAME}", "오늘 당직 {TITLE}는 {NAME}입니다.", "저는 {NAME}입니다.", "{NAME}이라고 합니다.", "이분이 {NAME}입니다.", "{NAME}과 {NAME}는 친구다.", "{NAME}와 {NAME}의 합의", "{NAME}은 아직 젊다.", "{NAME}는 말이 없었다.", "성명 {NAME}", "이름: {NAME}, 나이 41", "수령인: {NAME}", "환자 {NAME} 퇴원", "보호자: {NAME} (인)",
    "I met {NAME} on Monday.", "{NAME} wrote the summary.", "Please ask {NAME} about it.", "Signed by {NAME}, {PHONE}", "Deliver to {NAME} at {ADDRESS}.", "Mr. {NAME} lives at {ADDRESS}.", "비상시 {PHONE}, 야간 {PHONE}", "{EMAIL}이나 {PHONE} 가운데 편한 쪽으로",
    "글쓴이 {NAME} ({EMAIL})", "{NAME} / {PHONE} / {ADDRESS}", "{NAME}: {PHONE}, {EMAIL}", "책임자 {NAME}({PHONE})에게 물어보세요.",
)
UNMARKED = (
    "배송 조회 번호 5021-3344-7788로 확인됩니다.", "국제표준도서번호 978-89-364-7188-4 소설", "모두 1,250,000원을 냈다.", "판올림 2.4.11 안내", "2023년 5월 3일 오후 3시 30분에 모입니다.", "제15조 2항을 고쳤다.", "일련번호 483920-7741203인 장비", "사건번호 2021-3310-4471", "품번 55-120-3391",
    "이번 주말에 한국어 강의가 열린다.", "신청서를 정리한 뒤 고객 만족을 조사했다.", "문의 사항은 없고 안내만 남았다.", "강변 일대와 남해 바다까지 차가 막혔다.", "전기 요금과 수도 요금을 함께 냈다.", "임시 주차권은 조금 뒤에 나온다.", "서점에서 책을 사고 지하철로 돌아왔다.", "오전 회의는 3층 대회의실에서 한다.", "@notice 채널에 공지를 올렸다.",
    "In Boston, the weekly report was late.", "Our Denver branch reopened under new rules.", "Under Roman law the contract was void.", "At Oxford, most students vote in June.", "From Milan the train runs hourly.", "The Berlin office hired two clerks.", "Near Sydney Harbor it rained for days.", "Central Bank raised rates again.", "By Thursday the Nordic team had won.", "A Venetian mirror hung in the Spring Hotel lobby.", "For Harvard Library this was routine.",
    "The library closed early, so the meeting moved to Monday.", "Version 3.2.1 of the Harbor guide was printed in May.", "장소는 하늘공원 근처, 시간은 아침이다.", "김치와 이불, 박수와 정성, 최고의 조건을 장만했다.", "유리한 조항은 남기고 불리한 부분은 고쳤다.", "주문번호 20230503-1182 접수", "정원이 차서 신입 회원은 받지 않는다.", "민원 봉사실이 한산했다.",
)
TITLES = ("과장", "팀장", "부장", "대리", "교수", "기사", "간호사", "원장", "주임", "학생", "환자", "고객", "선생님", "박사", "감독", "사장", "위원장", "주무관", "상담원", "담당자", "신청인", "작성자", "예약자")
SYLLABLES = "민준서연지우현수영진호석태경은혜미선정희성재윤도하린규빈찬솔나라별"
LATIN = ("min", "jun", "seo", "yeon", "ji", "woo", "hyun", "su", "jin", "ho", "tae", "eun", "hye", "mi", "sun", "na", "ra", "do", "ha", "rin")
ROMAN = ("Kim", "Lee", "Park", "Choi", "Jung", "Kang", "Cho", "Yoon", "Jang", "Lim", "Han", "Oh", "Seo", "Shin", "Kwon", "Hwang", "Ahn", "Song", "Ryu", "Hong", "Jeon")


class Writer:
    """Fills the marked sentences."""

    def __init__(self, seed: int) -> None:
        self.dice = random.Random(seed)

    def pick(self, options):  # type: ignore[no-untyped-def]
        return options[self.dice.randrange(len(options))]

    def digits(self, pattern: str) -> str:
        return "".join(str(self.dice.randrange(10)) if c == "9" else c for c in pattern)

    def latin(self, n: int) -> str:
        return "".join(self.pick(LATIN) for _ in range(n))

    def word(self, n: int) -> str:
        return "".join(self.pick(SYLLABLES) for _ in range(n))

    def value(self, kind: str) -> str:
        if kind == "TITLE":
            return self.pick(TITLES)
        if kind == "NAME":
            form = self.dice.random()
            if form < 0.66:
                return (self.pick(DOUBLE) if form < 0.04 else self.pick(SURNAMES[:60])) + self.word(1 if form > 0.6 else 2)
            if form < 0.78:
                return f"{self.pick(DOUBLE if form < 0.67 else SURNAMES[:60])} {self.word(2)}"
            given = self.latin(1).capitalize() + ("-" if self.dice.random() < 0.4 else "") + self.latin(1)
            return f"{self.pick(ROMAN)} {given}" if self.dice.random() < 0.65 else f"{given} {self.pick(ROMAN)}"
        if kind == "EMAIL":
            local = self.latin(1) + self.pick((".", "_", "-", "")) + self.latin(2) + self.pick(("", self.digits("99"), self.digits("999")))
            local = local.capitalize() if self.dice.random() < 0.2 else local
            return local + self.pick(("@", "@", "@", "@", "(at)", " @ ", "[at]")) + self.latin(2) + self.pick((".example", ".test", ".or.kr", ".com"))
        if kind == "PHONE":
            if self.dice.random() < 0.06:
                return "-".join("".join(self.pick(NUMERALS) for _ in range(n)) for n in (3, 4, 4))
            forms = ("010-9999-9999",) * 5 + ("010 9999 9999", "0109999 9999".replace(" ", ""), "010.9999.9999", "(010)9999-9999", "+82-10-9999-9999", "+82 10-9999-9999", "02-999-9999", "031-999-9999", "070-9999-9999", "0629999999", "(02)999-9999")
            return self.digits(self.pick(forms))
        if kind == "ID_NUMBER":
            born = f"{self.dice.randrange(100):02d}{self.dice.randrange(1, 13):02d}{self.dice.randrange(1, 29):02d}"
            return self.pick((born + "-" + self.digits("2999999"), born + "-" + self.digits("1999999"), born + self.digits("3999999"), born + " " + self.digits("4999999"), self.digits("M99999999"), self.digits("91-99-999999-99")))
        if self.dice.random() < 0.12:
            return f"{self.dice.randrange(1, 260)}, {self.latin(2).capitalize()}-{self.pick(('ro', 'gil', 'daero'))}, {self.latin(2).capitalize()}-gu, {self.latin(2).capitalize()}-si"
        units = [self.word(2) + "도"] * (self.dice.random() < 0.4) + [self.word(2) + "시"] + [self.word(2) + "구"] * (self.dice.random() < 0.7)
        number = self.pick((self.digits("99-99"), self.digits("199"), self.digits("19-9"), self.digits("199-9"), self.digits("99"), self.digits("9")))
        if self.dice.random() < 0.5:
            units += [self.word(2) + self.pick(("로", "길", "대로"))] + [self.digits("19") + "번길"] * (self.dice.random() < 0.3) + [number]
        else:
            units += [self.word(2) + "동", number + self.pick(("", "번지"))]
        out = " ".join(units)
        return out + (self.pick((" ", ", ")) + self.digits("109") + "동 " + self.digits("1999") + "호" if self.dice.random() < 0.6 else "")

    def sentence(self, form: str) -> tuple[str, list[tuple[int, int, str]]]:
        """A marked sentence filled, before, behind or between sentences without marks, or alone."""
        other = lambda: self.pick(UNMARKED) + " " if self.dice.random() < 0.4 else ""
        out, spans = other(), []
        for piece in re.split(r"(\{\w+\})", form):
            if piece[:1] == "{":
                value = self.value(piece[1:-1])
                if piece != "{TITLE}":
                    spans.append((len(out), len(out) + len(value), piece[1:-1]))
                out += value
            else:
                out += piece
        return out + " " + other(), spans


    def anywhere(self, kind: str) -> tuple[str, list[tuple[int, int, str]]]:
        """A value between any two words, or alone: what can be told without its neighbours."""
        words = self.pick(UNMARKED).split(" ") if self.dice.random() < 0.85 else []
        at, value = self.dice.randrange(len(words) + 1), self.value(kind)
        before = "".join(w + " " for w in words[:at])
        behind = self.pick(("", "", "은", "를", "로", ",", ".", ")")) + "".join(" " + w for w in words[at:])
        return before + value + behind, [(len(before), len(before) + len(value), kind)]


Labelled = list[tuple[str, list[tuple[int, int, str]]]]


def exchanged(labelled: Labelled, times: int, seed: int = 5) -> Labelled:
    """Each labelled text so many times more, its values exchanged for others of the type that end alike.

    Values end alike if they are of one script and the same particles may follow them.
    """
    like = lambda kind, value: (kind, value[-1].isascii(), (ord(value[-1]) - 0xAC00) % 28 > 0)
    stock: dict[tuple, list[str]] = {}
    for text, spans_ in labelled:
        for a, b, kind in spans_:
            stock.setdefault(like(kind, text[a:b]), []).append(text[a:b])
    dice, out = random.Random(seed), []
    for text, spans_ in labelled:
        for _ in range(times):
            new, at, marks = "", 0, []
            for a, b, kind in sorted(spans_):
                if a < at or a >= b:
                    continue
                options = stock[like(kind, text[a:b])]
                value = options[dice.randrange(len(options))]
                new += text[at:a]
                marks.append((len(new), len(new) + len(value), kind))
                new += value
                at = b
            out.append((new + text[at:], marks))
    return out


def fold(text: str) -> tuple[str, list[int] | None, list[int] | None]:
    """Folded text; start and end in the stored text of each of its characters (None: they are the same)."""
    if PLAIN.fullmatch(text):
        return text, None, None
    out: list[str] = []
    start: list[int] = []
    end: list[int] = []
    for k, char in enumerate(text):
        if char in IGNORABLE:
            continue
        last = ord(out[-1]) if out else 0
        point = ord(char)
        if 0x1161 <= point <= 0x1175 and 0x1100 <= last <= 0x1112:
            out[-1], end[-1] = chr(0xAC00 + ((last - 0x1100) * 21 + point - 0x1161) * 28), k + 1
        elif 0x11A8 <= point <= 0x11C2 and 0xAC00 <= last <= 0xD7A3 and (last - 0xAC00) % 28 == 0:
            out[-1], end[-1] = chr(last + point - 0x11A7), k + 1
        elif out and unicodedata.combining(char):
            end[-1] = k + 1
        else:
            char = shape(char)
            if 0x2460 <= ord(char) <= 0x2468 or char == "⓪":
                char = str(unicodedata.digit(char))
            elif char in "‒–—−":
                char = "-"
            out.append(char)
            start.append(k)
            end.append(k + 1)
    return "".join(out), start, end


def slots_of(hashes: np.ndarray) -> np.ndarray:
    """(words, 5 offsets, features) slots of feature hashes; 0 stays 0, no feature."""
    k = np.uint64(0x9E3779B97F4A7C15)
    h = (hashes.astype(np.uint64)[:, None, :] + (np.arange(1, 6, dtype=np.uint64) << np.uint64(33))[None, :, None]) * k
    return np.where(hashes[:, None, :] == 0, 0, (h >> np.uint64(64 - BITS)).astype(np.int64))


PARTICLE_SET, LONGEST = frozenset(PARTICLES), max(map(len, PARTICLES))


def core(word: str) -> tuple[str, str]:
    """A Hangul word without its particle, and the particle."""
    for n in range(min(LONGEST, len(word) - 2), 0, -1):
        if word[-n:] in PARTICLE_SET:
            return word[:-n], word[-n:]
    return word, ""


N_FEATURES = 15


def number_like(word: str) -> tuple[list[str], str]:
    """Features of a word with digits or an at-sign, by what it looks like only; and its shape."""
    at = re.search(r"\s?(?:@|[(\[{]at[)\]}]|\(?골뱅이\)?)\s?", word)
    if at:
        return ["v@", f"v@ {at.group()}", "v@ " + word.rsplit(".", 1)[-1].lower(), "v@ " + re.sub(r"[A-Za-z]+", "a", re.sub(r"\d+", "9", word))], "@"
    shape_ = re.sub("[A-Z]", "A", re.sub(f"[{NUMERALS}]", "공", re.sub(r"\d", "9", word)))
    digits = re.sub(r"\D", "", word)
    born = len(digits) == 13 and "01" <= digits[2:4] <= "12" and "01" <= digits[4:6] <= "31"
    lead = digits[:2] if digits[:1] == "0" else digits[:1]
    kind = f"n{word[0] if word[0] in '(+' else ''}{lead if len(digits) > 8 and lead[:1] == '0' else ''} {min(len(digits), 14)}" + ("k" if "공" in shape_ else "")
    return ["v", "v " + shape_, f"v {shape_} {digits[:3]}", f"vl {lead} {len(digits)}", f"vb {born} {digits[6:7] if born else ''}", f"vn {len(word)}", f"vs {word[0] if not digits[:1] else ''} {len(digits)}"], kind


def describe(word: str) -> tuple[list[str], str]:
    """Features of a word, and its shape."""
    if "가" <= word[0] <= "힣" and not PHONES(word):
        body, particle = core(word)
        family = body[0] in SURNAMES or body[:2] in DOUBLE
        kind = f"h{min(len(word), 6)}"
        size = min(len(body), 5)
        return [
            "h", "w " + word, "c " + body, "p " + particle, "f " + word[0], "l1 " + word[-1], "l2 " + word[-2:], "l3 " + word[-3:], f"n {min(len(word), 7)}",
            f"s {family} {size}", f"s {family} {size} {particle}", f"b1 {body[-1]} {len(body) > 2}", "f2 " + word[:2], f"s2 {word[0] in SURNAMES} {len(word)}",
        ], kind + ("s" if family and len(body) in (2, 3, 4) else "")
    if word[0].isdigit() or word[0] in "(+" and len(word) > 1 or MAILS(word) or IDS(word) or PHONES(word):
        return number_like(word)
    if word[0].isascii() and word[0].isalpha():
        tail = word.rsplit("-", 1)[-1] if "-" in word else ""
        kind = "a" + ("C" if word[0].isupper() else "c") + ("-" + tail if tail in ("ro", "gil", "daero", "gu", "si", "do", "dong", "gun") else "-" if tail else "")
        return ["a", "w " + word.lower(), kind, f"{kind} {min(len(word), 8)}", f"roman {word in ROMAN}", f"l3 {word[-3:]}", f"l2 {word[-2:]}"], kind
    return ["o", "o " + word], "o" + word


class Words(dict):
    """Numbers the distinct words of a worker and keeps the hashes of their features, shapes and spellings."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[int] | None] = []
        self.shapes: list[int] = []
        self.texts: list[int] = []

    def __missing__(self, word: str) -> int:
        features, kind = describe(word)
        row = [crc32(f.encode("utf-8", "surrogatepass")) for f in features]
        self[word] = number = len(self.rows)
        self.rows.append(row + [0] * (N_FEATURES - len(row)))
        self.shapes.append(crc32(kind.encode()))
        self.texts.append(crc32(word.encode("utf-8", "surrogatepass")))
        return number


def split(text: str, words: Words) -> tuple[list[int], list[int], list[int], list[bool]]:
    """Numbers, starts and ends of the words of a folded text, and whether a space precedes."""
    found = [m.span() for m in WORD.finditer(text)]
    number = [words[text[a:b]] for a, b in found]
    start, end = [a for a, _ in found], [b for _, b in found]
    spaced = [a == 0 or text[a - 1].isspace() for a in start]
    return number, start, end, spaced


def pairs(shapes: np.ndarray, texts: np.ndarray, spaced: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Slots of features of neighbouring words; arrays are (sequences, positions), 0 where a sequence has ended."""

    def moved(a: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(a)
        if by > 0:
            out[:, by:] = a[:, :-by]
        else:
            out[:, :by] = a[:, -by:]
        return out

    s, w = np.where(mask, shapes, 0).astype(np.uint64), np.where(mask, texts, 0).astype(np.uint64)
    sp = (spaced & mask).astype(np.uint64)
    before, after, before2 = moved(s, 1), moved(s, -1), moved(s, 2)
    k = np.uint64(0x9E3779B97F4A7C15)
    out = [(s * k + before) * k + sp, (s * k + after) * k + moved(sp, -1) + np.uint64(3), (moved(w, 1) * k + s) * k + np.uint64(5), (moved(w, -1) * k + s) * k + np.uint64(7), ((before * k + s) * k + after) * k + np.uint64(11), ((before2 * k + before) * k + s) * k + np.uint64(13), (moved(w, 2) * k + s) * k + np.uint64(17), (w * k + sp) * k + np.uint64(19)]
    slots = np.stack([(x * k) >> np.uint64(64 - BITS) for x in out], axis=2).astype(np.int64)
    return slots


class Field:
    """Weights of emissions (2**17 slots by label) and transitions."""

    def __init__(self) -> None:
        self.emit = np.zeros((1 << BITS, len(LABELS)), np.float32)
        self.move = np.zeros((len(LABELS) + 1, len(LABELS)), np.float32)  # the last row: the start

    def forbidden(self) -> np.ndarray:
        out = self.move.copy()
        for j, b in enumerate(LABELS):
            if b[0] == "I":
                for i, a in enumerate((*LABELS, "start")):
                    if a[2:] != b[2:] or a == "O":
                        out[i, j] = -1e4
        return out

    def viterbi(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of (sequences, positions)."""
        move = self.forbidden()
        n, steps, _ = emissions.shape
        score = emissions[:, 0] + move[-1]
        back = np.zeros((steps, n, len(LABELS)), np.int8)
        for t in range(1, steps):
            total = score[:, :, None] + move[None, :-1]
            back[t] = total.argmax(axis=1)
            new = np.take_along_axis(total, back[t][:, None].astype(np.int64), axis=1)[:, 0] + emissions[:, t]
            score = np.where((t < lengths)[:, None], new, score)
        out = np.zeros((n, steps), np.int8)
        now = score.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            out[:, t] = np.where(t < lengths, now, 0)
            if t:
                now = np.where(t < lengths, back[t][np.arange(n), now], now)
        return out


def padded(rows: list[list], kind: type, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), kind)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def batch_slots(split_rows: list, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, mask, lengths, pair slots) of sequences, padded."""
    lengths = np.array([len(r[0]) for r in split_rows])
    width = int(lengths.max())
    numbers = padded([r[0] for r in split_rows], np.int64, width)
    mask = np.arange(width) < lengths[:, None]
    shapes, texts = np.array(words.shapes, np.int64), np.array(words.texts, np.int64)
    return numbers, mask, lengths, pairs(shapes[numbers], texts[numbers], padded([r[3] for r in split_rows], bool, width), mask)


def fit(labelled: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 7, rate: float = 0.25, seed: int = 3) -> Field:
    """Train by AdaGrad on the conditional likelihood."""
    field, words, dice = Field(), Words(), random.Random(seed)
    rows = []
    for text, spans in labelled:
        folded, start, _ = fold(text)
        got = split(folded, words)
        if not got[0]:
            continue
        at = [start[s] if start else s for s in got[1]]
        gold = [0] * len(at)
        for a, b, kind in spans:
            inside = [k for k, s in enumerate(at) if a <= s < b]
            for n, k in enumerate(inside):
                gold[k] = LABELS.index(("I-" if n else "B-") + kind)
        rows.append((got, gold))
    past_e, past_m = np.full(field.emit.shape, 1e-4, np.float32), np.full(field.move.shape, 1e-4, np.float32)
    table = slots_of(np.array(words.rows, np.uint32))
    size = len(LABELS)
    for _ in range(epochs):
        dice.shuffle(rows)
        for k in range(0, len(rows), 48):
            part = rows[k : k + 48]
            numbers, mask, lengths, pair = batch_slots([r[0] for r in part], words)
            n, width = numbers.shape
            gold = padded([r[1] for r in part], np.int64, width)
            slots = [pair]
            for o in range(5):
                by = o - 2
                shifted = np.zeros((n, width, N_FEATURES), np.int64)
                lo, hi = max(0, -by), width - max(0, by)
                shifted[:, lo:hi] = np.where(mask[:, lo + by : hi + by, None], table[numbers[:, lo + by : hi + by], o], 0)
                slots.append(shifted)
            slots_ = np.concatenate(slots, axis=2)
            flat = slots_[mask]
            weights = field.emit[flat]
            weights[flat == 0] = 0
            emissions = np.zeros((n, width, size))
            emissions[mask] = weights.sum(axis=1)
            move = field.forbidden().astype(np.float64)
            alpha = np.zeros((n, width, size))
            beta = np.zeros((n, width, size))
            alpha[:, 0] = emissions[:, 0] + move[-1]
            for t in range(1, width):
                alpha[:, t] = np.where(mask[:, t, None], logsum(alpha[:, t - 1, :, None] + move[:-1]) + emissions[:, t], alpha[:, t - 1])
            for t in range(width - 2, -1, -1):
                nxt = move[None, :-1] + (emissions[:, t + 1] + beta[:, t + 1])[:, None]
                beta[:, t] = np.where(mask[:, t + 1, None], logsum(nxt.transpose(0, 2, 1)), 0)
            norm = np.logaddexp.reduce(alpha[:, -1], axis=1)
            marginal = np.exp(np.minimum(alpha + beta - norm[:, None, None], 0)) * mask[:, :, None]
            slope = -marginal
            np.put_along_axis(slope, gold[:, :, None], np.take_along_axis(slope, gold[:, :, None], 2) + 1, 2)
            slope_flat = slope[mask].astype(np.float32)
            used, at = np.unique(flat, return_inverse=True)
            g = np.zeros((len(used), size), np.float32)
            np.add.at(g, at.reshape(flat.shape), slope_flat[:, None, :])
            g = g / len(part) - 2e-5 * field.emit[used]
            g[used == 0] = 0
            past_e[used] += g * g
            field.emit[used] += rate * g / np.sqrt(past_e[used])
            gm = np.zeros(field.move.shape)
            gm[-1] += slope[:, 0].sum(axis=0)
            for t in range(1, width):
                on = mask[:, t]
                if not on.any():
                    break
                both = np.exp(np.minimum(alpha[on, t - 1, :, None] + move[None, :-1] + (emissions[on, t] + beta[on, t])[:, None] - norm[on, None, None], 0))
                gm[:-1] -= both.sum(axis=0)
                np.add.at(gm, (gold[on, t - 1], gold[on, t]), 1)
            gm = (gm / len(part)).astype(np.float32)
            past_m += gm * gm
            field.move += rate * gm / np.sqrt(past_m)
    return field


def logsum(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials over the second axis."""
    top = x.max(axis=1, keepdims=True)
    return top[:, 0] + np.log(np.exp(x - top).sum(axis=1))


class Finder:
    """Decodes texts with a trained field; keeps what each distinct word contributes."""

    KEPT = 150_000

    def __init__(self, field: Field) -> None:
        self.field = field
        self.field.emit[0] = 0
        move = field.forbidden()
        self.most_gained = max(0.0, float((move[:-1] - move[0, 0]).max()), float((move[-1] - move[-1, 0]).max()))
        self.clear()

    def clear(self) -> None:
        self.words = Words()
        self.given = np.zeros((0, 5, len(LABELS)), np.float32)

    def contributions(self) -> np.ndarray:
        have = len(self.given)
        new = self.words.rows[have:]
        if new:
            added = [self.field.emit[slots_of(np.array(new[k : k + 4096], np.uint32))].sum(axis=2) for k in range(0, len(new), 4096)]
            self.given = np.concatenate([self.given, *added])
            for k in range(have, len(self.words.rows)):
                self.words.rows[k] = None
        return self.given

    def find(self, texts: Iterable[str]) -> list[list[tuple[str, int, int]]]:
        """(type, start, end) of each text, in its stored characters."""
        folded = [fold(t) for t in texts]
        if len(self.words) > self.KEPT:
            self.clear()
        parts = [split(f[0], self.words) for f in folded]
        given = self.contributions()
        out: list[list[tuple[str, int, int]]] = [[] for _ in parts]
        order = sorted((k for k in range(len(parts)) if parts[k][0]), key=lambda k: len(parts[k][0]))
        at = 0
        while at < len(order):  # batches of texts of about the same number of words, bounded in size
            upto, longest = at + 1, len(parts[order[at]][0])
            while upto < len(order) and upto - at < 256 and len(parts[order[upto]][0]) * (upto - at) < 12_000 and len(parts[order[upto]][0]) <= longest * 1.3 + 4:
                upto += 1
            some = order[at:upto]
            numbers, mask, lengths, pair = batch_slots_fast([parts[k] for k in some], self.words)
            emissions = np.zeros((*numbers.shape, len(LABELS)), np.float32)
            for k in range(pair.shape[2]):
                emissions += self.field.emit[pair[:, :, k]]
            width = numbers.shape[1]
            for o in range(5):
                by = o - 2
                lo, hi = max(0, -by), width - max(0, by)
                if lo < hi:
                    emissions[:, lo:hi] += given[numbers[:, lo + by : hi + by], o] * mask[:, lo + by : hi + by, None]
            # A span of n words changes n + 1 transitions, each by at most most_gained, so texts whose words all lose more than twice that need no search.
            gain = emissions[:, :, 1:].max(axis=2) - emissions[:, :, 0]
            worth = np.flatnonzero((mask & (gain >= -2 * self.most_gained)).any(axis=1))
            if len(worth):
                labels = self.field.viterbi(emissions[worth], lengths[worth])
                for row in np.flatnonzero(labels.any(axis=1)):
                    k = some[worth[row]]
                    out[k] = spans(folded[k], parts[k], labels[row])
            at = upto
        return out


def batch_slots_fast(split_rows: list, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(r[0]) for r in split_rows])
    width = int(lengths.max())
    numbers = padded([r[0] for r in split_rows], np.int64, width)
    mask = np.arange(width) < lengths[:, None]
    used, back = np.unique(numbers, return_inverse=True)
    back = back.reshape(numbers.shape)
    shapes = np.array([words.shapes[k] for k in used.tolist()], np.int64)
    texts = np.array([words.texts[k] for k in used.tolist()], np.int64)
    return numbers, mask, lengths, pairs(shapes[back], texts[back], padded([r[3] for r in split_rows], bool, width), mask)


def spans(folded: tuple, part: tuple, labels: np.ndarray) -> list[tuple[str, int, int]]:
    text, start, end = folded
    _, begins, ends, _ = part
    out = []
    k = 0
    while k < len(begins):
        if labels[k] == 0:
            k += 1
            continue
        kind = LABELS[labels[k]][2:]
        j = k + 1
        while j < len(begins) and LABELS[labels[j]] == "I-" + kind:
            j += 1
        got = trimmed(kind, text, begins[k], ends[j - 1])
        if got and kind == "NAME" and particle_expected(text, *got):
            got = got[0], got[1] - 1
        if got:
            a, b = got
            out.append((kind, start[a] if start else a, end[b - 1] if end else b))
        k = j
    return out


#: A road, village or quarter with a number behind it, or its Latin form with the number before.
PLACE = re.compile(r"[가-힣A-Za-z0-9 ,.()\u00b7-]*[가-힣](?:로|길|동|리|가|읍|면)\s*\d[가-힣A-Za-z0-9 ,.()-]*|\d+(?:-\d+)?,? [A-Za-z][A-Za-z -]*-(?:ro|gil|daero|dong|ri|ga)\b[A-Za-z0-9 ,.-]*")
UNITS = re.compile(r"\d(번지|번길|동|호실|호|층|가)")


def trimmed(kind: str, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The value itself: particles, titles, labels and punctuation around it are dropped; None if nothing fits."""
    value = text[a:b]
    if kind in ("EMAIL", "PHONE", "ID_NUMBER"):
        m = re.search({"EMAIL": MAIL, "PHONE": PHONE, "ID_NUMBER": ID}[kind], value)
        return (a + m.start(), a + m.end()) if m else None
    if kind == "ADDRESS":
        if not re.search(r"\d", value):
            return None
        if re.match(r"\d+(?:-\d+)?,", value) and re.search(r"[A-Za-z]", value):
            m = re.match(r"[\dA-Za-z,.\-# ]*[A-Za-z]", value)
        else:
            ends = [m.end() for m in UNITS.finditer(value)] + [m.end() for m in re.finditer(r"\d+(?:-\d+)?", value)]
            m = re.match(r".{%d}" % max(ends), value, re.S)
        if not m:
            return None
        b = a + m.end()
        while a < b and not (text[a].isalnum()):
            a += 1
        return (a, b) if 5 <= b - a <= 100 and PLACE.fullmatch(text[a:b]) else None
    m = re.fullmatch(r"\W*([가-힣]+)(?:\s+([가-힣]+))?.*", value, re.S)
    if m:
        first, second = m.group(1), m.group(2)
        if second and len(first) <= 2 and (first in SURNAMES or first in DOUBLE):
            return a + m.start(1), a + m.start(2) + name_length(second, 0, 2)
        n = name_length(first, 2 if first[:2] in DOUBLE else 1, 3 if first[:2] not in DOUBLE else 4)
        return (a + m.start(1), a + m.start(1) + n) if n >= 2 else None
    m = re.search(r"[A-Za-z]+(?:-[A-Za-z]+)?(?:\s+[A-Za-z]+(?:-[A-Za-z]+)?){1,2}", value)
    return (a + m.start(), a + m.end()) if m else None


# What may follow a name without a particle.
FOLLOWS = re.compile(r"\s*(?:[(),.:;/'\"\]]|$|고객|교수|대리|주무관|학생|환자|과장|팀장|부장|차장|사원|기사|선생|씨|님|전화|번호|연락처|휴대|주소|이메일|at\b|or\b|and\b|(?!함께)[가-힣]*께)")


def particle_expected(text: str, a: int, b: int) -> bool:
    """Whether the last syllable must be the particle, as nothing that can follow a bare name comes behind it."""
    name = text[a:b]
    if name[-1] not in "은이가" or text[b : b + 1].strip():
        return False
    given = len(name.rsplit(" ", 1)[1]) if " " in name else len(name) - (2 if name[:2] in DOUBLE else 1)
    closed = (ord(name[-2]) - 0xAC00) % 28 > 0
    return given >= 2 and closed == (name[-1] != "가") and not FOLLOWS.match(text, b)


def name_length(word: str, family: int, most: int) -> int:
    """Characters of word that are a name with a family name of so many characters, without the particle behind it."""
    if len(word) > most:
        for n in (most, most - 1):
            rest = word[n:]
            if rest in PARTICLES or core("가나" + rest)[1] == rest or any(rest.startswith(p) for p in ("님", "씨", "입니다", "에게", "께")):
                return n
        return most
    closed = len(word) > 1 and (ord(word[-2]) - 0xAC00) % 28 > 0
    if len(word) == most and len(word) - family >= 2 and word[-1] in CLEAR and not (word[-1] in "과는를와" and closed != (word[-1] == "과")):
        return len(word) - 1
    return len(word)


_FINDERS: dict[int, Finder] = {}


def labelled_rows(cases: DataFrame) -> Labelled:
    """Reviewed cases, at most REVIEWED of them in the order of their hashed ids."""
    rows = cases.where(F.col("labels").isNotNull() & F.col("text").isNotNull()).select("id", "text", "labels").dropDuplicates(["id"])
    some = rows.orderBy(F.xxhash64("id"), "id").limit(REVIEWED).collect()
    return [(r[1], [(x["start_pos"], x["end_pos"], OF_ENTITY[x["entity_type"]]) for x in r[2] if x["entity_type"] in OF_ENTITY]) for r in some]


#: Sentences that are made of the reviewed cases in all, of each marked one and of each reviewed case, and values put anywhere, by type.
MADE, FILLS, MOST, ANYWHERE = 3000, 6, 8, 60
_FIELDS: dict[int, Field] = {}


def trained(cases: DataFrame) -> Field:
    """The field of these cases; the same cases are learned once in a session."""
    reviewed = labelled_rows(cases)
    key = hash(repr(reviewed))
    if key not in _FIELDS:
        _FIELDS.clear()
        _FIELDS[key] = fit(learned_from(reviewed))
    return _FIELDS[key]


def learned_from(reviewed: Labelled) -> Labelled:
    writer = Writer(11)
    made = exchanged(reviewed, max(0, min(MOST, MADE // max(1, len(reviewed)) - 1)))
    loose = [writer.anywhere(kind) for kind in ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS") for _ in range(ANYWHERE)]
    return reviewed + made + [writer.sentence(form) for form in MARKED for _ in range(FILLS)] + loose + [(text, []) for text in UNMARKED for _ in range(2)]


def found(df: DataFrame, key: str, text: str, field: Field) -> DataFrame:
    """(row_key, text, spans) of the rows in which something was found; one narrow pass."""
    shared = df.sparkSession.sparkContext.broadcast(field)
    rows = df.select(F.col(key).cast("string").alias("row_key"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0)
    kind = pa.list_(pa.struct([("pii_type", pa.string()), ("pos_from", pa.int64()), ("pos_to", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _FINDERS.get(0)
        if finder is None or finder.source is not shared.value:
            finder = Finder(shared.value)
            finder.source = shared.value
            _FINDERS[0] = finder
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                got = finder.find(part.column(1).to_pylist())
                some = [k for k, x in enumerate(got) if x]
                if some:
                    part = part.take(pa.array(some))
                    values = [[{"pii_type": t, "pos_from": a, "pos_to": b} for t, a, b in got[k]] for k in some]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(values, kind)], names=["row_key", "text", "spans"])

    return rows.mapInArrow(run, "row_key string, text string, spans array<struct<pii_type string, pos_from long, pos_to long>>")


def masked(spotted: DataFrame, *keep: str) -> DataFrame:
    """(row_key, masked, columns to keep): each span replaced by its typed placeholder, everything else kept."""
    step = lambda acc, s: F.struct(
        F.concat(acc["out"], F.substring("text", acc["at"] + 1, s["pos_from"].cast("int") - acc["at"]), F.lit("["), s["pii_type"], F.lit("]")).alias("out"), s["pos_to"].cast("int").alias("at")
    )
    done = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text"))))
    return spotted.select("row_key", done.alias("masked"), *keep)
