"""Screening and tagging against plain Python."""

import re

from pyspark.sql import functions as F

from hanmaru.functions import text as T
from hanmaru.operators import screen, spans as S, tagging

TEXTS = ["당뇨병 진단, 연봉 5000만원, 010-1234-5678", "밀 알레르기와 개", "개와 밀", "A형 과목 수학 A+ 끝", "", None, "eyJabcdefghijk.abcdefghijk 192.168.0.1", "카드 1234-5678-9012-3456 우울증 우울증"]


def plain(text):
    out = []
    for kind, pattern in screen.PATTERNS.items():
        out += [(kind, m.group(), m.start(), m.end(), 0.95) for m in re.finditer(pattern.replace("(?U)", ""), text)]
    for kind, (context, words) in screen.KEYWORDS.items():
        near = any(c in text for c in context)
        out += [(kind, w, text.index(w), text.index(w) + len(w), 0.9 if near else 0.7) for w in words if w and w in text and (len(w) > 2 or near)]
        if kind in screen.VALUES:
            out += [(kind, m.group(), m.start(), m.end(), 0.85) for m in re.finditer(screen.VALUES[kind].replace("(?U)", ""), text)]
    return list({(f[0], f[1], f[2]): f for f in reversed(out)}.values())


def test_findings_equal_a_scan(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    for r in df.select("id", screen.findings(F.col("t")).alias("f")).collect():
        if TEXTS[r.id] is None:
            assert r.f is None
        else:
            assert sorted(tuple(x) for x in r.f) == sorted(plain(TEXTS[r.id]))


def test_decisions(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    rows = {r.id: r for r in screen.screened(df, "t").collect()}
    assert rows[2].action == "PASS" and rows[2].output == "개와 밀" and rows[5].action == "PASS" and rows[5].output is None
    assert rows[7].output == "카드 <CARD> <MENTAL> 우울증" or "<CARD>" in rows[7].output
    assert {r.action for r in screen.screened(df, "t", "block").collect()} == {"PASS", "BLOCK"}


def test_the_chain_can_be_switched(spark):
    df = spark.createDataFrame([("ㅎㅏㄴㄱㅡㄹ ①②③ 주 소",)], "t string")
    assert screen.normalised(df, "t").first().normalised == "한글 123 주소"
    assert screen.normalised(df, "t", off=("letters", "compatible", "digits", "keyword_spaces")).first().normalised == "ㅎㅏㄴㄱㅡㄹ ①②③ 주 소"
    assert [s.step for s in screen.normalised(df, "t", explain=True).first().steps] == ["letters", "compatible", "keyword_spaces"]


def test_windows_cover_and_merge(spark):
    assert tagging.windows(10, 4) == [(0, 4), (2, 6), (4, 8), (6, 10)] and tagging.windows(3, 4) == [(0, 3)]
    assert tagging.merged([(0, 4, "A", 0.8), (1, 4, "A", 0.6), (0, 4, "B", 0.5)]) == [(0, 4, "A", 0.7), (0, 4, "B", 0.5)]
    assert tagging.decode(["B-A", "I-A", "O", "I-B", "B-B"], [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)], [1.0, 0.5, 0, 0.4, 0.2]) == [(0, 2, "A", 0.75), (3, 4, "B", 0.4), (4, 5, "B", 0.2)]
    assert tagging.parted("김민수는 서울시 강남구", (0, 12, "PERSON_NAME", 1.0)) == [(0, 3, "PERSON_NAME", 0.9), (5, 12, "ADDRESS_FULL", 1.0)]
    df = spark.createDataFrame([(1, "x" * 700 + "김민수"), (2, None), (3, "")], "id int, text string")
    rows = tagging.tagged(df, "id", "text", tagging.literal_backend({"김민수": 0.8})).collect()
    assert [(r.id, r.start, r.end, r.confident) for r in rows] == [(1, 700, 703, False)]


def test_fragments_join_over_blanks(spark):
    text = "서울 종로 12 끝"
    rows = [(a, b, text[a:b], e, s, d, None, 0, False, "P2", [r]) for a, b, e, s, d, r in ((0, 2, "ADDRESS_UNIT", 0.4, "d", "x"), (3, 8, "ADDRESS_FULL", 0.6, "e", "y"), (9, 10, "X", 0.1, "d", "z"))]
    df = spark.createDataFrame([(text, rows)], "t string, f " + S.SEEN)
    got = df.select(S.joined_fragments(F.col("t"), F.col("f")).alias("f")).first().f
    assert [(s.start, s.end, s.entity, s.text, s.score, s.detector) for s in got] == [(0, 8, "ADDRESS_FULL", "서울 종로 12", 0.6, "d,e"), (9, 10, "X", "끝", 0.1, "d")]
    assert got[0].reasons == ["x", "y", "resolver.address.fragment_merge"] and got[0].risk == "P1"


def test_suffixes_go_one_by_one(spark):
    df = spark.createDataFrame([("김민수에게서",), ("은는",), (None,)], "t string")
    assert [r[0] for r in df.select(S.without_suffix(F.col("t"), True)).collect()] == ["김민수", "은는", None]
    assert T.literal("a.b|c") == r"a\.b\|c"
