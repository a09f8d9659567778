"""Detectors, resolution, masking."""

import re

import pytest
from pyspark.sql import functions as F

from hanmaru.operators import detect as D, spans as S

TEXT = "고객명 김민수님 연락처는 010-1234-5678입니다. 이메일 a.b@c.example, 주민번호 900101-1234567"


def run(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r for r in S.guarded(df, **options).orderBy("id").collect()]


def test_text_is_masked_with_numbered_placeholders(spark):
    row = run(spark, [TEXT])[0]
    assert row.masked == "고객명 [PERSON_1]님 연락처는 [PHONE_1]입니다. 이메일 [EMAIL_1], 주민번호 [REDACTED]"
    assert all(TEXT[s.start : s.end] == s.text for s in row.spans)
    assert [s.suffix for s in row.spans] == ["님", "입니다", None, None]


def test_equal_values_share_a_number(spark):
    assert run(spark, ["a@b.example c@d.example a@b.example"])[0].masked == "[EMAIL_1] [EMAIL_2] [EMAIL_1]"


def test_null_empty_and_long_texts(spark):
    rows = run(spark, [None, "", "가나다 " * 20_000 + "a@b.example"])
    assert rows[0].masked is None and rows[0].spans is None
    assert rows[1].masked == "" and rows[1].spans == []
    assert rows[2].masked.endswith("[EMAIL_1]")


def test_secrets_block_the_text(spark):
    row = run(spark, ["키 sk-abcDEF0123456789xyz_ 끝"])[0]
    assert row.blocked and row.masked is None


def test_labels_decide(spark):
    kinds = lambda t: {s.entity for s in run(spark, [t], detectors=["document", "registration", "phone"])[0].spans}
    assert kinds("여권번호: M12345678") == {"PASSPORT"}
    assert kinds("문서 M12345678") == set()
    assert kinds("법인등록번호 900101-1234567") == set()
    assert kinds("주문번호: 010-1234-5678") == set()


def test_unknown_detectors_are_refused():
    with pytest.raises(ValueError):
        D.candidates(F.lit("x"), ["nothing"])


def test_cards_keep_their_trailing_separator(spark):
    found = run(spark, ["카드 4111 1111 1111 1111 끝"], detectors=["card"])[0].spans
    assert [s.text for s in found] == ["4111 1111 1111 1111 "]


def test_addresses_chain(spark):
    found = run(spark, ["서울특별시 강남구 테헤란로 123 101동 1203호 그리고 역삼동에서"], detectors=["address"])[0].spans
    assert [(s.entity, s.text) for s in found] == [("ADDRESS_FULL", "서울특별시 강남구 테헤란로 123 101동 1203호"), ("ADDRESS_UNIT", "역삼동")]


def test_resolution_leaves_no_overlap(spark):
    rows = run(spark, [TEXT, "서울대학교병원 김민수 010-1234-5678 900101-1234567 4111111111111111", "김민수병원"])
    for row in rows:
        ends = sorted((s.start, s.end) for s in row.spans)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_emails_equal_a_scan(spark):
    texts = ["x a@b.example,c@d.co y", "a@b", "..a@b.com", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: [s.text for s in (r.e or [])] for r in df.select("id", D.candidates(F.col("text"), ["email"], variants=False).alias("e")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == [m.group() for m in re.finditer(r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", t or "")]


SPELT = [
    ("연락처 ０１０－１２３４－５６７８ 끝", "phone", "０１０－１２３４－５６７８"), ("연락처 010\u200b-12\u200b34-5678\u200b 끝", "phone", "010\u200b-12\u200b34-5678"), ("메일 a\u200bb＠c.example로", "email", "a\u200bb＠c.example"), ("연락처 010–1234–5678", "phone", "010–1234–5678"),
    ("연락처: 공일공-일이삼사-오육칠팔입니다", "phone", "공일공-일이삼사-오육칠팔"), ("번호 0 1 0 1 2 3 4 5 6 7 8", "phone", "0 1 0 1 2 3 4 5 6 7 8"), ("여 권 번호 ＭM12345678 여권번호 Ｍ12345678", "document", "Ｍ12345678"), ("고객명 김민\u200b수님", "name", "김민\u200b수"), ("키 ①⑨②.168.0.1", "network", "①⑨②.168.0.1"),
]


def test_variants_are_scanned_and_spans_stand_in_the_text(spark):
    for detector in {d for _, d, _ in SPELT}:
        chosen = [(t, v) for t, d, v in SPELT if d == detector]
        for row, (text, value) in zip(run(spark, [t for t, _ in chosen], detectors=[detector]), chosen):
            assert [(s.text, s.start) for s in row.spans] == [(value, text.index(value))], text
    masked = [r.masked for r in run(spark, [SPELT[0][0], SPELT[1][0]])]
    assert masked == ["연락처 [PHONE_1] 끝", "연락처 [PHONE_1]\u200b 끝"]


def test_audit_never_holds_the_value(spark):
    df = spark.createDataFrame([(1, TEXT)], "id int, text string")
    for row in S.audit(S.guarded(df), "id", b"k").collect():
        assert "김민수" not in str(row) and "010-1234" not in str(row) and row.value_hash.startswith("hmac-sha256:k1:")


def test_islands(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 8, 9)], "doc_id int, start int, end int")
    assert sorted((r.start, r.island) for r in S.islands(df).collect()) == [(0, 1), (3, 1), (8, 2)]


def decided(spark, text, **options):
    return {s.text: (s.action, s.method, [r for r in s.reasons if r.startswith("policy")]) for s in run(spark, [text], **options)[0].spans}


def test_decisions_follow_the_list(spark):
    assert decided(spark, "주민번호 900101-1234567") == {"900101-1234567": ("MASK", "full_redact", ["policy.override.full_redact"])}
    assert decided(spark, "카드 4111-1111-1111-1111,")["4111-1111-1111-1111"] == ("MASK", "full_redact", ["policy.risk.p0_full_redact"])
    assert decided(spark, "전화번호 010-1234-5678")["010-1234-5678"] == ("MASK", "label_mask", ["policy.risk.p1_threshold"])
    assert decided(spark, "대표번호 02-123-4567")["02-123-4567"] == ("PASS", "pass", ["policy.negative_context.pass"])
    assert decided(spark, "예시 a@b.example")["a@b.example"] == ("PASS", "pass", ["policy.negative_context.pass"])
    assert decided(spark, "김민수 010-1234-5678")["김민수"] == ("MASK", "label_mask", ["policy.composite.mask"])
    assert decided(spark, "외삼촌")["외삼촌"] == ("PASS", "pass", ["policy.risk.p2_no_context"])
    assert decided(spark, "키 sk-abcDEF0123456789xyz_")["sk-abcDEF0123456789xyz_"] == ("BLOCK", "block", ["policy.override.block"])
    assert decided(spark, "키 sk-abcDEF0123456789xyz_", target="external_output")["sk-abcDEF0123456789xyz_"][2] == ["policy.target.block_entity"]
    with pytest.raises(ValueError):
        S.decided(F.lit(None), "elsewhere")


def test_an_audit_target_gets_hashes(spark):
    row = run(spark, ["메일 a@b.example 끝"], target="audit_log")[0]
    digest = __import__("hmac").new(S.SECRET, b"a@b.example", "sha256").hexdigest()
    assert row.masked == f"메일 hmac-sha256:{S.KEY_ID}:{digest} 끝" and not row.blocked


def test_outgoing_texts(spark):
    df = spark.createDataFrame([(1, "전화번호 010-1234-5678"), (2, "키 sk-abcDEF0123456789xyz_"), (3, None), (4, "")], "id int, t string")
    assert [r.shown for r in S.outgoing(df, "t").orderBy("id").collect()] == ["전화번호 [PHONE_1]", S.OUTPUT_BLOCKED, None, ""]
    assert S.outgoing(df, "t", arguments=True).where("id = 2").first().shown == "{}"


def test_ends_are_put_right(spark):
    texts = ["김민수에게서 왔다", "연락처 010-1234-5678로, 끝", "서울 강남구청", "테헤란로", "김민수한", None]
    found = [[(0, 6, "PERSON_NAME")], [(4, 17, "PHONE_MOBILE")], [(0, 6, "ADDRESS_UNIT")], [(0, 4, "ADDRESS_FULL")], [(0, 3, "PERSON_NAME")], None]
    rows = [(k, t, f and [(a, b, t[a:b], e, 0.5, "dictionary.address.road" if t == "테헤란로" else "d") for a, b, e in f]) for k, (t, f) in enumerate(zip(texts, found))]
    df = spark.createDataFrame(rows, "id int, t string, f " + D.SPAN)
    got = [r.c and [(s.text, s.suffix, s.reasons) for s in r.c] for r in df.orderBy("id").select(S.corrected(F.col("t"), F.col("f")).alias("c")).collect()]
    assert got == [
        [("김민수", "에게서", ["boundary.suffix_trim"])], [("010-1234-5678", "로", ["boundary.suffix_lookahead"])], [("서울 강남구", None, [])], [("테헤란로", None, [])], [("김민수", None, [])], None,
    ]
    half = spark.createDataFrame([("서울 종로구 강남", [(0, 8, "서울 종로구 강", "ADDRESS_UNIT", 0.5, "d")])], "t string, f " + D.SPAN)
    assert [(s.text, s.reasons) for s in half.select(S.corrected(F.col("t"), F.col("f")).alias("c")).first().c] == [("서울 종로구", ["boundary.address_partial_word_trim"])]


def test_detectors_of_a_span_are_joined(spark):
    rows = [(0, 2, "ab", "X", 0.4, "a"), (0, 2, "ab", "X", 0.9, "b"), (0, 2, "ab", "Y", 0.1, "c"), (0, 2, "ab", "X", 0.4, "a")]
    df = spark.createDataFrame([(rows,)], "f " + D.SPAN)
    assert [tuple(s) for s in df.select(D.fold(F.col("f")).alias("g")).first().g] == [(0, 2, "ab", "X", 0.9, "b,a"), (0, 2, "ab", "Y", 0.1, "c")]


def test_addresses_of_the_sixth_version(spark):
    texts = ["새 주소 2001:4860:4860::8888 끝", "안 fe80::1 끝", "12:30:45", "::", "a:b:c:d:e:f:1:2:3"]
    rows = run(spark, texts, detectors=["network"])
    assert [[(s.text, "context.penalty.private_ip" in s.reasons) for s in r.spans] for r in rows][:3] == [[("2001:4860:4860::8888", False)], [("fe80::1", False)], []]


def test_nothing_found_is_stored(spark):
    text = "메일 a@b.example, 다시 a@b.example"
    df = spark.createDataFrame([(text, "앞 a@b.example 뒤", [(3, 14, "a@b.example", "EMAIL")])], "t string, m string, s array<struct<start:int,end:int,text:string,entity:string>>")
    assert df.select(S.storable(F.col("m"), F.col("t"), F.col("s"))).first()[0] == "앞 [UNSTORED_EMAIL] 뒤"


def test_fields_are_summed_up(spark):
    df = spark.createDataFrame([([("a", 0, 5), ("b", 7, 9)], [(1, 3, "EMAIL", "MASK")]), ([], [])], "f array<struct<name:string,start:int,end:int>>, s array<struct<start:int,end:int,entity:string,action:string>>")
    assert [r[0] for r in df.select(S.field_summary(F.col("f"), F.col("s"))).collect()] == ["a: [EMAIL:MASK]\nb: [NO_DETECTED_PII len=2]", "[NO_FIELDS]"]


def test_overlapping_spans_are_an_error(spark):
    df = spark.createDataFrame([("abcdef", [(0, 3, "abc", "X", "MASK", "label_mask"), (2, 4, "cd", "X", "MASK", "label_mask")])], "t string, s array<struct<start:int,end:int,text:string,entity:string,action:string,method:string>>")
    with pytest.raises(Exception, match="overlapping"):
        df.select(S.masked(F.col("t"), F.col("s"))).collect()
