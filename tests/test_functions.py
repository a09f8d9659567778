"""Text functions and validators against plain Python."""

import hashlib
import hmac
import re

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from hanmaru.functions import text as T, validate as V


def column(spark, values, make):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[1] for r in sorted(df.select("k", make(F.col("v"))).collect())]


def test_pieces_give_code_point_offsets(spark):
    texts = ["a12b345", "😀12 한글34", "", None, "12", "no digits", "1" * 5000 + " x " + "2" * 10]
    got = column(spark, texts, lambda c: T.pieces(c, r"\d+"))
    for text, found in zip(texts, got):
        if text is None:
            assert found is None
        else:
            assert [(p["start"], p["end"], p["text"]) for p in found] == [(*m.span(), m.group()) for m in re.finditer(r"\d+", text)]


def test_sentences_end_at_each_terminator(spark):
    got = column(spark, ["하나. 둘!  셋", "3.14", "...", "", None], T.sentences)
    assert [[p["text"] for p in x] if x is not None else None for x in got] == [["하나.", "둘!", "셋"], ["3.", "14"], [".", ".", "."], [], None]


def test_hmac_equals_the_library(spark):
    values = ["", "김민수", "x" * 300, None]
    for key in (b"k", b"k" * 100):
        got = column(spark, values, lambda c: T.hmac_sha256(c, key, "id"))
        assert got == [v and f"hmac-sha256:id:{hmac.new(key, v.encode(), hashlib.sha256).hexdigest()}" if v else (None if v is None else f"hmac-sha256:id:{hmac.new(key, b'', hashlib.sha256).hexdigest()}") for v in values]


def test_digits_of_all_shapes_fold(spark):
    assert column(spark, ["０１２③④❺𝟎𝟙𝟡x", None], T.fold_digits) == ["012345019x", None]


def test_compaction_looks_across_separators(spark):
    assert column(spark, ["010 - 12", "1- 2", "a - 1", "1 2 3"], T.compact_digits) == ["01012", "12", "a - 1", "123"]
    assert column(spark, ["1 2", "1 -2", "a 1"], T.compact_digit_spaces) == ["12", "1-2", "a 1"]


def test_letters_compose():
    assert [T.compose_letters(x) for x in ("ㅎㅏㄴㄱㅡㄹ", "ㄱㅏㄴㅏ", "ㅂㅏㄺ", "한", None)] == ["한글", "가나", "밝", "한", None]


def test_numerals_need_context():
    assert T.restore_numerals("전화 공일공-일이") == "전화 010-12"
    assert T.restore_numerals("공일공-일이") == "공일공-일이"
    assert T.restore_numerals(None) is None


@given(st.text(max_size=40))
def test_char_fold_is_stable(text):
    once = T.char_fold(text)
    assert T.char_fold(once) == T.char_fold(T.char_fold(once))


def test_folded_offsets_restore(spark):
    df = spark.createDataFrame([("a​①②㎏",), (None,), ("",)], "v string").select(T.char_fold_map(F.col("v")).alias("m"))
    rows = [r.m for r in df.collect()]
    assert rows[0]["text"] == "a12kg" and list(rows[0]["starts"]) == [0, 2, 3, 4, 4]
    span = df.limit(1).select(T.restore_span(F.col("m.starts"), F.col("m.ends"), F.lit(1), F.lit(4))).first()[0]
    assert (span["start"], span["end"]) == (2, 5)


def luhn(d):
    total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d)))
    return total % 10 == 0


@pytest.mark.parametrize("value", ["4111111111111111", "4111111111111112", "1111111111111111", "5500000000000004", "", "12"])
def test_card(spark, value):
    d = re.sub(r"\D", "", value)
    assert column(spark, [value], V.card) == [13 <= len(d) <= 19 and len(set(d)) > 1 and luhn(d)]


def test_resident_needs_a_real_day(spark):
    assert column(spark, ["900101-1234567", "900230-1234567", "900101-5234567", None, "", "x"], V.resident) == [True, False, False, None, False, False]
    assert column(spark, ["900101-5234567"], lambda c: V.resident(c, foreign=True)) == [True]


def test_addresses_and_secrets(spark):
    assert column(spark, ["10.0.0.1", "8.8.8.8", "256.1.1.1", None], V.ipv4_class) == ["private", "public", None, None]
    assert column(spark, ["AA:bb:CC:dd:EE:ff", "AA:bb-CC:dd:EE:ff"], V.mac) == ["aa:bb:cc:dd:ee:ff", None]
    assert column(spark, ["sk-abcDEF0123456789xyz_", "ghp_aaaaaaaaaaaaaaaaaaaa", "password"], V.secret) == [True, False, False]


def test_bio(spark):
    df = spark.createDataFrame([(["B-X", "I-X", "O"],), (["I-X"],), (["B-X", "I-Y"],), ([],), (None,)], "l array<string>")
    assert [r[0] for r in df.select(V.bio_valid(F.col("l"))).collect()] == [True, False, False, True, None]
