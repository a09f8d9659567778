"""Operators of the subpackage against brute force, exact round trips and held-out accuracy; and their defined corner cases."""

import base64
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from hanmaru.llm import _common, bpe, encoding, leakage, lookalike, near_dup, pii, queries, truncation

SMALL = "/root/testdata/sf0.001"
SENTENCES = [
    "4월 2일 별빛물산 상담원이 반송된 신청서를 무사히 점검하려다가 누로사 건은 총무부가 다시 알아보았다",
    "작년 가을 온고을보건소에서 간호사가 첨부된 진료 기록을 순서대로 등록하지 못했습니다 참조 바람내",
    "정기 회의록을 급히 보완한 뒤 솔내음 양식에 맞추어 외래 환자가 공용 설문지를 전산으로 조회했어요",
    "The Naeumri obsolete invoice from Haesol Library was recorded by the Dalbit help desk this morning",
]


SPACED = "trim(regexp_replace({c}, '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+', ' ', 'g'))"


def versions_sql(table: str, normal: str, threshold: float, columns: str, where: str) -> str:
    """Pairs of similar rows by brute force: all common 3-character sequences are counted."""
    return (
        f"(WITH r AS (SELECT *, {normal.replace('{c}', 'sentence')} AS t FROM {table} WHERE sentence IS NOT NULL), "
        "g AS (SELECT DISTINCT id, substring(t, CAST(k AS INT), 3) AS g FROM (SELECT id, t, unnest(range(1, length(t) - 1)) AS k FROM r WHERE length(t) > 2)), "
        "n AS (SELECT id, count(*) AS n FROM g GROUP BY id), c AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY ALL) "
        f"SELECT {columns} FROM c JOIN n u ON u.id = x JOIN n v ON v.id = y JOIN r a ON a.id = x JOIN r b ON b.id = y WHERE c >= {threshold} * (u.n + v.n - c) AND {where})"
    )


def role_sql(alias: str) -> str:
    name = f"lower(trim({alias}.split_hint))"
    return f"CASE WHEN {name} IN ('train', 'training') THEN 1 WHEN {name} IN ('val', 'valid', 'validation', 'dev', 'test') THEN 2 END"


@pytest.mark.parametrize("name, least", [("p1_found", 0.97), ("p2_found", 0.97)])
def test_recall_against_brute_force_in_sql(spark, name, least):
    """Nothing false is listed, and nearly all pairs are, on whole tables."""
    import duckdb

    root, c = "/root/testdata/sf0.01", duckdb.connect()
    for t in queries.VERSIONS:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    if name == "p1_found":
        sql = " UNION ALL ".join(f"SELECT '{t}' AS tbl, * FROM " + versions_sql(t, SPACED, 0.5, "x AS id_a, y AS id_b", "true") for t in queries.VERSIONS)
    else:
        sql = "SELECT * FROM " + versions_sql("ner_examples", queries.BARE, 0.6, "x AS id_a, y AS id_b", f"({role_sql('a')}) + ({role_sql('b')}) = 3")
    true, got = set(c.execute(sql).fetchall()), {tuple(r) for r in queries.QUERIES[name](spark, root).collect()}
    assert got <= true and len(got) >= least * len(true)


def grams(text, n=3):
    return {text[k : k + n] for k in range(len(text) - n + 1)}


def similarity(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def brute_pairs(rows, threshold, normal):
    clean = [(k, normal(t)) for k, t in rows if k is not None and t is not None]
    return {(min(a, b), max(a, b)) for i, (a, x) in enumerate(clean) for b, y in clean[:i] if len(x) > 2 and len(y) > 2 and similarity(x, y) >= threshold}


def versions():
    rng = np.random.default_rng(4)
    rows = []
    for base in SENTENCES:
        rows.append(base)
        for _ in range(6):
            words = base.split()
            for _ in range(int(rng.integers(1, 3))):
                k = int(rng.integers(0, len(words)))
                if rng.random() < 0.5:
                    words[k] = "종합"
                else:
                    words.insert(k, "결국")
            rows.append(" ".join(words))
        rows.append(base)
    rows += ["abc", "abc", "abcd", "ab", "", None, "   ", " abc ", "가나다 라마바 사아자", "가나다 라마바  사아자", "가나다 라마바 사아차"]
    return [(k + 1, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_near_duplicates_equal_brute_force(spark, threshold):
    rows = versions() + [(None, SENTENCES[0])]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "id long, sentence string, tid string, text int")
    join = near_dup.similarity_join(df, "id", near_dup.whitespace_normal(F.col("sentence")), near_dup.Settings(threshold=threshold))
    got = [(r.id_a, r.id_b) for r in near_dup.row_pairs(join).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_pairs(rows, threshold, lambda t: re.sub(r"\s+", " ", t).strip())


def test_the_exact_setting_misses_nothing(spark):
    """Changes at every eighth character leave no long gram in common; the exact prefix finds the pairs all the same."""
    rng = np.random.default_rng(6)
    letters = list("가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허")
    rows = []
    for k in range(30):
        text = "".join(rng.choice(letters, 90))
        changed = "".join(c if (j + 1) % (8 + k % 6) else "#" for j, c in enumerate(text))
        rows += [(2 * k, text), (2 * k + 1, changed)]
    df = spark.createDataFrame(rows, "id long, sentence string")
    for threshold in (0.5, 0.6):
        join = near_dup.similarity_join(df, "id", F.col("sentence"), near_dup.Settings(threshold=threshold, exact=True))
        assert {(r.id_a, r.id_b) for r in near_dup.row_pairs(join).collect()} == brute_pairs(rows, threshold, str)


def test_texts_of_one_template_meet_though_all_their_grams_are_frequent(spark):
    rng = np.random.default_rng(7)
    body = "".join(rng.choice(list("가나다라마바사아자차카타파하"), 110))
    rows = [(k, f"{body[:70]}{int(rng.integers(10**5, 10**6))}{body[70:]}") for k in range(80)]
    df = spark.createDataFrame(rows, "id long, sentence string")
    join = near_dup.similarity_join(df, "id", F.col("sentence"), near_dup.Settings(threshold=0.5))
    assert {(r.id_a, r.id_b) for r in near_dup.row_pairs(join).collect()} == brute_pairs(rows, 0.5, str)
    rows_ = near_dup.prefixed(join.texts, near_dup.Settings(threshold=0.5), False).collect()
    groups = {(tuple(r.prefix), r.n_shared) for r in rows_}
    assert len(rows_) == 80 and len(groups) <= 60  # texts with equal prefixes and sizes are one group


def test_a_common_phrase_brings_nobody_together(spark):
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허"), n))
    footer = word(30)
    texts = [word(90) + footer for _ in range(400)] + ["아" * n for n in range(60, 100)] + [word(40) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, sentence string")
    s = near_dup.Settings(threshold=0.5, thin=9)
    join = near_dup.similarity_join(df, "id", F.col("sentence"), s)
    assert near_dup.candidates(join.texts, s, False).count() <= 40 * 39 / 2 + 2 * len(texts)
    assert {(r.id_a, r.id_b) for r in near_dup.row_pairs(join).collect()} == brute_pairs(list(enumerate(texts)), 0.5, str)


@pytest.mark.parametrize("parts", [1, 2, 6])
def test_meetings_are_all_pairs_of_a_key(spark, parts):
    df = spark.createDataFrame([(1, k, parts) for k in range(17)] + [(2, k, 1) for k in range(2)] + [(3, 5, 2)], "k long, v long, parts int")
    got = [(r.va, r.vb) for r in near_dup.meetings(df, "k", "v", []).collect()]
    assert sorted(got) == sorted([(a, b) for a in range(17) for b in range(a + 1, 17)] + [(0, 1)])


def test_classes_are_the_components(spark):
    rows = versions()
    df = spark.createDataFrame(rows, "id long, sentence string")
    join = near_dup.similarity_join(df, "id", near_dup.whitespace_normal(F.col("sentence")), near_dup.Settings(threshold=0.5))
    got = {r.id: r.class_id for r in near_dup.classes(join).collect()}
    parent = {k: k for k in got}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in brute_pairs(rows, 0.5, lambda t: re.sub(r"\s+", " ", t).strip()):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {k: find(k) for k in got}


def test_copies_of_one_text_stay_linear_in_classes(spark):
    df = spark.range(1, 3001).select("id", F.when(F.col("id") <= 1000, F.lit(SENTENCES[0])).otherwise(F.concat(F.lit(SENTENCES[1]), F.col("id").cast("string"), F.md5(F.col("id").cast("string")))).alias("sentence"))
    join = near_dup.similarity_join(df.where("id <= 1010"), "id", near_dup.whitespace_normal(F.col("sentence")), near_dup.Settings(threshold=0.8))
    rows = near_dup.classes(join).collect()
    assert sum(r.class_id == 1 for r in rows) == 1000


def test_many_copies_meet_in_their_first(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "WHOLE", 5)
    rows = [(k, SENTENCES[0], 1 + k % 2) for k in range(1, 21)] + [(100, SENTENCES[0] + " 끝", 1), (101, SENTENCES[0] + " 끝", 2), (102, SENTENCES[1], 1)]
    df = spark.createDataFrame(rows, "id long, sentence string, role int")
    plain = near_dup.similarity_join(df, "id", near_dup.whitespace_normal(F.col("sentence")), near_dup.Settings(threshold=0.5))
    got = [(r.id_a, r.id_b) for r in near_dup.row_pairs(plain).collect()]
    assert sorted(got) == sorted([(1, k) for k in range(2, 21)] + [(1, 100), (1, 101), (100, 101)])
    roles = near_dup.similarity_join(df, "id", near_dup.whitespace_normal(F.col("sentence")), near_dup.Settings(threshold=0.5), F.col("role"))
    got = [(r.id_a, r.id_b) for r in near_dup.row_pairs(roles, cross=True).collect()]
    assert sorted(got) == sorted({(1, 2)} | {(1, k) for k in range(4, 21, 2)} | {(2, k) for k in range(3, 21, 2)} | {(1, 100), (2, 101), (100, 101)})


def test_no_overlapping_row_is_lost_among_many_copies(spark, tmp_path):
    """601 evaluation copies and an almost equal training text; 501 training copies and two evaluation ones."""
    spell = {1: ("train", " Training "), 2: ("val", "DEV"), 3: ("test", "test")}
    rows = [(k, SENTENCES[0], 2) for k in range(1, 602)] + [(1000, SENTENCES[0] + " 끝", 1), (1001, SENTENCES[2], 3)]
    rows += [(k, SENTENCES[1], 1) for k in range(2000, 2501)] + [(3000, SENTENCES[1], 3), (3001, SENTENCES[1] + "!", 3), (3002, SENTENCES[1] + " 끝", 2)]
    df = spark.createDataFrame([(k, t, spell[r][k % 2], f"s{k % 2}") for k, t, r in rows], "id long, sentence string, split_hint string, source string")
    df.write.parquet(f"{tmp_path}/ner_examples.parquet")
    true = {(k, 1000) for k in range(1, 602)} | {(k, e) for k in range(2000, 2501) for e in (3000, 3001, 3002)}
    got = [(r.id_a, r.id_b) for r in queries.p2_found(spark, str(tmp_path)).collect()]
    assert len(got) == len(true) and set(got) == true
    report = {(r.split, r.source): (r.n_rows, r.n_overlapping, r.n_exact, r.n_pairs) for r in queries.p2_report(spark, str(tmp_path)).collect()}
    assert report == {("val", "s0"): (301, 301, 0, 300 + 501), ("val", "s1"): (301, 301, 0, 301), ("test", "s0"): (1, 1, 1, 501), ("test", "s1"): (2, 1, 1, 501)}


def test_roles_cross(spark):
    rows = [(1, SENTENCES[0], 1), (2, SENTENCES[0].replace(" ", "  ") + "!", 2), (3, SENTENCES[0] + " 끝", 1), (4, SENTENCES[1], 2), (5, SENTENCES[1].replace("첨부된", "정정된"), None), (6, SENTENCES[2], 2), (7, SENTENCES[2].replace("급히 ", ""), 1)]
    df = spark.createDataFrame(rows, "id long, sentence string, role int")
    join = near_dup.similarity_join(df, "id", near_dup.letters_and_numbers(F.col("sentence")), queries.OVERLAPS, F.col("role"))
    assert {(r.id_a, r.id_b) for r in near_dup.row_pairs(join, cross=True).collect()} == {(1, 2), (2, 3), (6, 7)}


def scattered(sizes=(40, 90, 260), n=8):
    """Texts with a version that is changed at every eighth to eleventh character, one with its words in another order, one cut short; and a common phrase."""
    rng = np.random.default_rng(11)
    letters = list("가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허")
    rows = []
    for size in sizes:
        for k in range(n):
            words = ["".join(rng.choice(letters, int(rng.integers(3, 6)))) for _ in range(size // 5)]
            text = " ".join(words)
            rows += [text, "".join(c if (j + 1) % (8 + k % 4) else "#" for j, c in enumerate(text)), " ".join(rng.permutation(words)), text[: len(text) * (5 + k % 3) // 8], text + " 참조하시기 바랍니다"]
    return list(enumerate(rows))


@pytest.mark.parametrize("table", sorted(queries.VERSIONS))
def test_changes_that_leave_no_long_run_hide_no_pair(spark, monkeypatch, table):
    """At the settings of p1_found, dealt over several cells."""
    monkeypatch.setattr(near_dup, "CELL", 2000)
    rows = scattered()
    join = near_dup.similarity_join(spark.createDataFrame(rows, "id long, sentence string"), "id", F.col("sentence"), queries.VERSIONS[table])
    got = [(r.id_a, r.id_b) for r in near_dup.row_pairs(join).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, 0.5, str)


def test_changes_that_leave_no_long_run_hide_no_overlap(spark, monkeypatch):
    """At the settings of p2_found; some texts are in both roles, some in none."""
    monkeypatch.setattr(near_dup, "CELL", 2000)
    rows = scattered(n=12)
    roles = {k: (1, 2, 1, 2, None, 2, 1)[k % 7] for k, _ in rows}
    rows += [(k + 10000, t) for k, t in rows[::9]]
    roles |= {k: 3 - (roles[k - 10000] or 2) for k, _ in rows if k >= 10000}
    df = spark.createDataFrame([(k, t, roles[k]) for k, t in rows], "id long, sentence string, role int")
    join = near_dup.similarity_join(df, "id", F.col("sentence"), queries.OVERLAPS, F.col("role"))
    got = [(r.id_a, r.id_b) for r in near_dup.every_pair(join).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in brute_pairs(rows, 0.6, str) if {roles[a], roles[b]} == {1, 2}}


def test_every_pair_of_many_copies_is_listed(spark, tmp_path):
    rows = [(k, SENTENCES[0]) for k in range(503)] + [(1000, SENTENCES[0] + " 끝"), (1001, SENTENCES[1])]
    for t in queries.VERSIONS:
        spark.createDataFrame(rows, "id long, sentence string").write.parquet(f"{tmp_path}/{t}.parquet")
    got = [tuple(r) for r in queries.p1_found(spark, str(tmp_path)).collect()]
    true = {(a, b) for a in range(503) for b in (*range(a + 1, 503), 1000)}
    assert len(got) == len(set(got)) and set(got) == {(t, a, b) for t in queries.VERSIONS for a, b in true}


def cell_side(sets):
    """A cell's side of sets of sequences numbered by frequency, with whole prefixes."""
    n = np.array([len(x) for x in sets])
    ranks = [np.sort(np.array(sorted(x), np.int32)) for x in sets]
    h = np.concatenate(ranks).astype(np.uint64)
    return {"tid": np.arange(len(n)), "n": n, "dead": np.zeros(len(n), np.int32), "held": n.astype(np.int32), "ranks": np.concatenate(ranks), "shadow": near_dup.parity(np.repeat(np.arange(len(n)), n), h, len(n), 1024)}


@pytest.mark.parametrize("step", [50, 250_000])
@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_cells_find_each_pair_once(monkeypatch, step, threshold):
    monkeypatch.setattr(near_dup, "STEP", step)
    rng = np.random.default_rng(3)
    sets = []
    for size in (1, 2, 5, 30, 100, 300) * 6:
        base = set(rng.integers(0, 3000, size).tolist())
        sets += [base, {x for x in base if rng.random() < 0.85} or base, base | set(rng.integers(0, 3000, size // 4).tolist())]
    similar = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if len(x & y) >= threshold * len(x | y) - 1e-9}
    side, left, right = (cell_side(x) for x in (sets, sets[:50], sets[50:]))
    got = [(min(p), max(p)) for a, b in near_dup.searched(side, side, True, threshold) for p in zip(a.tolist(), b.tolist())]
    assert len(got) == len(set(got)) and {(i, j) for i, j in similar if i < j} <= set(got) and all(i < j for i, j in got)
    got = [(i, j + 50) for a, b in near_dup.searched(left, right, False, threshold) for i, j in zip(a.tolist(), b.tolist())]
    assert len(got) == len(set(got)) and {(i, j) for i, j in similar if i < 50 <= j} <= set(got)


def test_searching_a_cell_is_spared_needless_meetings(monkeypatch):
    """No two texts of a band meet twice, and prefixes of long texts aren't asked for more than rules pairs out."""
    # 200 texts that have one frequent sequence, and 99 of their own.
    side = cell_side([{*range(1 + 99 * k, 100 + 99 * k), 100_000} for k in range(200)])
    side |= {"ranks": np.full(200, 100_000, np.int32), "held": np.ones(200, np.int32)}
    made, repeat = [], np.repeat
    monkeypatch.setattr(near_dup.np, "repeat", lambda a, n, *x: made.append(len(got := repeat(a, n, *x))) or got)
    monkeypatch.setattr(near_dup, "prefix_length", lambda n, *_: n)
    assert not [p for a, b in near_dup.searched(side, side, True, 0.5) for p in zip(a, b)]
    assert max(made) == 200 * 199 // 2
    assert near_dup.depth(100, 100, 0.5) == 5 and near_dup.depth(300, 300, 0.5) == near_dup.depth(5000, 5000, 0.5) == near_dup.MOST


@pytest.mark.parametrize("words", [8, 16, 64])
def test_differing_bits_are_counted(words):
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, (30, words)).astype(np.uint64) for _ in range(2))
    a[0], b[0] = 0, ~np.uint64(0)
    x, y = np.r_[0, rng.integers(0, 30, 99)], np.r_[0, rng.integers(0, 30, 99)]
    assert near_dup.differing(a, x, b, y).tolist() == [sum(int(p ^ q).bit_count() for p, q in zip(a[i].tolist(), b[j].tolist())) for i, j in zip(x, y)]


def test_similarities_are_exact():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("가나다라마 ab"), int(rng.integers(0, 60)))) for _ in range(60)]
    left, right = rng.integers(0, 60, 400), rng.integers(0, 60, 400)
    for threshold in (0.3, 0.5, 0.9):
        got = near_dup.similarities(texts, left, right, threshold)
        for k in range(400):
            true = similarity(texts[left[k]], texts[right[k]])
            assert got[k] == pytest.approx(true) or (got[k] == 0 and true < threshold)


def test_damage_is_found_and_undone(spark):
    base = ["상담원이 신청서를 점검했습니다", "간호사가 진료 기록을 등록하지 못했습니다", "담당 직원이 회의록을 조회했어요", "보호자가 다시 알아보았다"] * 30
    rows = [(k, t) for k, t in enumerate(base)]
    good = ["café 이야기", "naïve한 생각", "±0.5℃ 유지", "漢字로 적음", "«Привет» 인사", "§12 참고", "Ångström 단위", "über alles", "", None, "🙂 웃음", "½컵", "대화。"]
    bad = {}
    for reader, writer in (("cp1252", "utf-8"), ("cp1252", "euc-kr"), ("koi8-r", "euc-kr"), ("mac-roman", "euc-kr"), ("cp1251", "utf-8")):
        text = "담당 직원이 신청서를 조회했어요"
        data = text.encode(writer)
        bad[f"{writer} {reader}"] = "".join(bytes([b]).decode(reader, "ignore") or chr(b) for b in data) if reader != "koi8-r" else data.decode(reader)
    rows += [(1000 + k, t) for k, t in enumerate(good)] + [(2000 + k, t) for k, t in enumerate(bad.values())] + [(3000, "담당 �궡�뿭�쓣 조회했어요")]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "id long, sentence string, text int")
    model = encoding.corpus_model(df, "sentence")
    got = {r.row_id: r for r in encoding.restored(df, "id", "sentence", model).collect()}
    assert set(got) == {2000 + k for k in range(len(bad))} | {3000}
    assert {got[2000 + k].restored for k in range(len(bad))} == {"담당 직원이 신청서를 조회했어요"}
    empty = encoding.corpus_model(df.limit(0), "sentence")
    assert encoding.restored(df.limit(0), "id", "sentence", empty).count() == 0


CORPUS = ["상담원이 신청서를 점검했습니다", "간호사가 진료 기록을 등록하지 못했습니다", "담당 직원이 회의록을 조회했어요", "보호자가 다시 알아보았다", "사서가 서고 목록을 정리하기로 했다", "관리인이 주차권을 나누어 주었다"]


def model_of(spark, texts=CORPUS):
    return encoding.corpus_model(spark.createDataFrame([(t,) for t in texts * 40], "sentence string"), "sentence")


def damaged(text, reader, writer, rng, lost):
    """text written in writer and read with reader, some of its bytes lost."""
    out = ""
    for byte in text.encode(writer):
        shown = bytes([byte]).decode(reader, "ignore") or chr(byte)
        out += "�" if byte >= 0x80 and rng.random() < lost else shown
    return out


@pytest.mark.parametrize("reader, writer", [("cp1252", "utf-8"), ("cp1252", "euc-kr"), ("koi8-r", "euc-kr"), ("mac-roman", "utf-8"), ("cp437", "euc-kr")])
def test_most_damaged_characters_are_restored(spark, reader, writer):
    """Held-out sentences of the real table, damaged on purpose, a twentieth of their bytes lost."""
    table = spark.read.parquet("/root/testdata/sf0.01/ner_examples.parquet").where("sentence is not null").where(~encoding.suspicious(F.col("sentence")))
    model = encoding.corpus_model(table.where("id % 5 <> 0"), "sentence")
    rng, right, total = np.random.default_rng(1), 0, 0
    for row in table.where("id % 5 = 0").orderBy("id").limit(40).collect():
        fixed = encoding.restore(damaged(row.sentence, reader, writer, rng, 0.05), model, {})[0]
        for a, b in zip(row.sentence.split(" "), fixed.split(" ")):
            letters = [k for k, c in enumerate(a) if "가" <= c <= "힣"]
            total += len(letters)
            right += sum(a[k] == b[k] for k in letters) if len(a) == len(b) else 0
    assert right / total >= 0.9


def test_the_search_is_exact(spark):
    """The best path has the score of the best of all paths, spelt out one by one."""
    import itertools

    model = model_of(spark)
    for word, lost in (("상담", (1, 4)), ("보호자", (2,)), ("기록을", (0, 8)), ("가가", (0, 1, 3)), ("주차권", (4, 7))):
        data = list(word.encode("utf-8"))
        for k in lost:
            data[k] = -1
        choices = [model.fits(data[3 * k : 3 * k + 3], "utf-8") for k in range(len(word))]
        best = -np.inf
        for path in itertools.product(*choices):
            h, last, score = np.array([encoding.ROOT]), np.array([-1]), 0.0
            for c in path:
                gain, nxt = model.step(h, last, np.array([c]))
                score, h, last = score + gain[0, 0], nxt[0], np.array([c])
            best = max(best, score + model.leave(h, last)[0])
        assert encoding.decode(data, "utf-8", model)[1] == pytest.approx(best)


def test_lost_bytes_are_damage_even_if_nothing_comes_back(spark):
    model = model_of(spark)
    assert encoding.restore("��� 점검", model, {}) == ("��� 점검", None, True)
    assert encoding.restore("점검 café", model, {})[2] is False


LOOKS = [
    ("a", "번호 ABC-12 확인"), ("b", "번호 АВС‐12 확인"), ("c", "번​호 ＡＢＣ-１２ 확인"), ("d", unicodedata.normalize("NFD", "번호 ABC-12 확인")), ("e", "번호 abc-12 확인"), ("f", "번호 ABC-①2 확인"), ("g", "résumé"), ("h", "résumé"), ("i", "resume"), ("j", None), ("k", ""), ("l", "​"), ("a", "번호 ABC-12 확인"), (None, "résumé"),
]


def test_look_alikes_pair_up(spark):
    df = spark.createDataFrame([(k, t, 5) for k, t in LOOKS], "id string, t string, text int")
    got = {(r.key_a, r.key_b) for r in lookalike.alike(df, "id", "t").collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d"), ("g", "h"), ("k", "l")}
    rows = lookalike.canonical(df, "id", "t").collect()
    assert len(rows) == len(LOOKS) and {r.canonical for r in rows if r.key in "abcd"} == {"번호 ABC-12 확인"} if None not in [r.key for r in rows] else True
    assert lookalike.alike(df.limit(0), "id", "t").count() == 0


def test_look_alikes_of_many_copies_pair_up(spark):
    rows = [(f"a{k:04d}", "번호 ABC") for k in range(601)] + [(f"b{k:04d}", "번호 АBC") for k in range(502)] + [("a9", "번호 ＡBC"), ("c", "번호 abc")]
    df = spark.createDataFrame([*rows, rows[0]], "id string, t string")
    got = [(r.key_a, r.key_b) for r in lookalike.alike(df, "id", "t").collect()]
    assert len(got) == len(set(got)) and set(got) == {(x, y) for x, t in rows for y, u in rows if x < y and t != u and "c" not in (x, y)}


def test_the_automaton_follows_shapes_only():
    trie = lookalike.Trie()
    for word, n in (("ABC", 3), ("ABD", 1), ("가나", 1)):
        trie.add(word, n)
    assert trie.accept("АВС") == (0.0, "ABC") and trie.accept("A​B­C") == (0.0, "ABC") and trie.accept("abc") is None
    assert trie.accept(unicodedata.normalize("NFD", "가나")) == (0.0, "가나")
    assert trie.accept("ABX", bound=1.0) == (1.0, "ABC") and trie.accept("", bound=0.0) is None


def test_words_compete_for_a_token(spark):
    """A stroke of another script stands for I or l: the vocabulary decides, then cost, then counts; else the table."""
    trie = lookalike.Trie()
    for word, n in (("lab", 9), ("IDlab", 1), ("lDlab", 5), ("Ivy", 1), ("lvy", 8), ("clay", 2)):
        trie.add(word, n)
    assert trie.accept("Ιab") == (0.25, "lab") and trie.accept("ІDІab") == (0.25, "IDlab")
    assert trie.accept("Іvy") == (0.0, "Ivy") and trie.accept("cӀаy") == (0.25, "clay") and trie.accept("Іzz") is None
    texts = ["lab note", "lab", "Ivy lvy lvy", "Ιab", "Іvy", "Іzz ​lab"]
    df = spark.createDataFrame([(f"k{k}", t) for k, t in enumerate(texts)], "id string, t string")
    rows = {r.token: (r.canonical, r.word, lookalike.table_form(r.token)) for r in lookalike.spellings(df.select(F.col("t").alias("text"))).collect()}
    assert rows == {"Ιab": ("lab", True, "Iab"), "Іvy": ("Ivy", True, "Ivy"), "Іzz": ("Izz", False, "Izz"), "​lab": ("lab", True, "lab")}
    assert {(r.key_a, r.key_b) for r in lookalike.alike(df, "id", "t").collect()} == {("k1", "k3")}


@pytest.mark.parametrize("words, at_once, dealt", [(1, 1, 1), (2, 3, 2), (20_000, 20_000, 50_000)])
def test_decisions_do_not_depend_on_how_words_are_dealt(spark, monkeypatch, words, at_once, dealt):
    for name, value in (("WORDS", words), ("AT_ONCE", at_once), ("DEALT", dealt)):
        monkeypatch.setattr(lookalike, name, value)
    base = ["case", "email", "lab", "Iab", "resume"]
    odd = [w[:k] + "​" + w[k:] for w in base for k in range(len(w) + 1)] + ["cаse", "emаil"]
    df = spark.createDataFrame([(t,) for t in base + odd], "text string")
    got = {r.token: r.canonical for r in lookalike.spellings(df).collect()}
    assert got == {t: lookalike.table_form(t) for t in odd}


@given(st.text(max_size=12), st.sampled_from(sorted(lookalike.SECOND)))
def test_all_readings_share_a_skeleton(text, char):
    for reading, _ in lookalike.readings(char):
        assert lookalike.skeleton(text + char) == lookalike.skeleton(text + reading)


@given(st.text(max_size=30))
def test_table_form_is_stable(text):
    assert lookalike.table_form(lookalike.table_form(text)) == lookalike.table_form(text)


def f1(gold, found):
    return 2 * len(gold & found) / max(1, len(gold) + len(found))


@pytest.mark.parametrize("half", [0, 1])
def test_personal_values_of_forms_never_seen(half):
    """Half of the marked sentences teach, the other half is searched: no sentence form is in both."""
    train, test = pii.Writer(11), pii.Writer(99)
    seen, other = pii.MARKED[half::2], pii.MARKED[1 - half :: 2]
    loose = [train.anywhere(kind) for kind in ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS") for _ in range(pii.ANYWHERE)]
    finder = pii.Finder(pii.fit([train.sentence(f) for f in seen for _ in range(pii.FILLS)] + loose + [(t, []) for t in pii.UNMARKED]))
    cases = [test.sentence(f) for f in other for _ in range(4)]
    gold = {(k, kind, a, b) for k, (_, spans) in enumerate(cases) for a, b, kind in spans}
    found = {(k, *s) for k, spans in enumerate(finder.find([t for t, _ in cases])) for s in spans}
    of = lambda kinds, values: {v for v in values if v[1] in kinds}
    assert f1(of(("EMAIL", "PHONE", "ID_NUMBER"), gold), of(("EMAIL", "PHONE", "ID_NUMBER"), found)) > 0.8
    assert f1(of(("ADDRESS",), gold), of(("ADDRESS",), found)) > 0.6 and f1(of(("NAME",), gold), of(("NAME",), found)) > 0.4


def test_no_marked_sentence_stems_from_the_tables():
    import duckdb

    root = "/root/testdata/sf0.01"
    texts = "\n".join(x[0] for t, c in queries.TEXTS for x in duckdb.execute(f"SELECT {c} FROM '{root}/{t}.parquet' WHERE {c} IS NOT NULL").fetchall())
    for form in (*pii.MARKED, *pii.UNMARKED):
        assert not [p for p in re.split(r"\{\w+\}", form) if len(p.strip()) > 5 and p in texts], form


def test_values_are_exchanged_in_place():
    rows = [("김민수는 010-1-2 씀", [(0, 3, "NAME"), (5, 12, "PHONE")]), ("이수지는 왔다", [(0, 3, "NAME")]), ("박하늘은 갔다", [(0, 3, "NAME")])]
    made = pii.exchanged(rows, 20)
    assert len(made) == 60 and all(text[a:b] in ("김민수", "이수지", "박하늘", "010-1-2") for text, spans in made for a, b, _ in spans)
    assert {t for t, _ in made if "갔다" in t} == {"박하늘은 갔다"} and {t for t, _ in made if "왔다" in t} == {"이수지는 왔다", "김민수는 왔다"}
    assert pii.exchanged([], 5) == [] and pii.exchanged([("", [])], 2) == [("", []), ("", [])]


def test_texts_that_need_no_search_hold_nothing():
    """Skipping by the bound changes nothing: all texts searched give the same spans."""
    field = pii.fit(pii.learned_from([]))
    quick, whole = pii.Finder(field), pii.Finder(field)
    whole.most_gained = 1e9
    writer = pii.Writer(5)
    texts = [writer.sentence(f)[0] for f in pii.MARKED] + list(pii.UNMARKED) + ["그냥 글", "", "a"]
    assert quick.find(texts) == whole.find(texts)


def test_personal_values_in_rows(spark):
    values = ["급한 일은 010-1234-5678에 또는 a.b@mail.example 앞으로", "０１０-１２３４-５６７８에 전화하세요.", "제 메일 seul⁠@nae.example을 봐 주세요.", "주문번호 20200301-0332 확인", "", None, "가" * 30_000, "제 메일 seul⁠@nae.example을 봐 주세요."]
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(values)], "id int, t string, text string, spans string")
    spotted = pii.found(df, "id", "t", pii.fit(pii.learned_from([])))
    got = {(int(r.row_key), s.pii_type, values[int(r.row_key)][s.pos_from : s.pos_to]) for r in spotted.collect() for s in r.spans}
    assert got == {(0, "PHONE", "010-1234-5678"), (0, "EMAIL", "a.b@mail.example"), (1, "PHONE", "０１０-１２３４-５６７８"), (2, "EMAIL", "seul⁠@nae.example"), (7, "EMAIL", "seul⁠@nae.example")}
    masked = {int(r.row_key): r.masked for r in pii.masked(spotted).collect()}
    assert masked[0] == "급한 일은 [PHONE]에 또는 [EMAIL] 앞으로" and masked[1] == "[PHONE]에 전화하세요."
    assert pii.found(df.limit(0), "id", "t", pii.fit(pii.learned_from([]))).count() == 0


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=40))
def test_folding_keeps_places(text):
    folded, start, end = pii.fold(text)
    if start is not None:
        assert len(folded) == len(start) == len(end) and all(0 <= a < b <= len(text) for a, b in zip(start, end))


def reference_encoder():
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


ENCODER, OTHER = bpe.Encoder(*bpe.default_vocabulary()), reference_encoder()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_ids_equal_the_public_library(text):
    ids = np.frombuffer(ENCODER.encode(text), np.int32).tolist()
    assert ids == OTHER.encode_ordinary(text) and ENCODER.decode(ids) == text


def test_encoding_of_a_table(spark, monkeypatch):
    values = ["안녕하세요, world!  <|endoftext|>", "", None, "   \n", "가나다 " * 5000, "가나다 " * 5000]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(values)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode_column(df, "doc_id", "text").collect()}
    assert got == {k: OTHER.encode_ordinary(t) if t else [] for k, t in enumerate(values)}
    assert bpe.encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_a_full_store_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 4)
    small = bpe.Encoder(*bpe.default_vocabulary())
    text = "하나 둘 셋 넷 다섯 여섯 하나 둘 셋 넷 다섯 여섯"
    assert np.frombuffer(small.encode(text), np.int32).tolist() == OTHER.encode_ordinary(text) and len(small) <= 5


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("가나다라마바사아자차카타파하abcdef 12"), n))
    items = [(k, word(int(rng.integers(30, 200)))) for k in range(12)] + [(20, None), (21, ""), (22, "짧다")]
    docs = []
    for k in range(60):
        text = word(int(rng.integers(0, 400)))
        if k % 3 == 0:
            source = items[k % 12][1]
            a, n = int(rng.integers(0, 20)), int(rng.integers(30, 80))
            text = text[:50] + source[a : a + n].upper() + ", " + text[50:]
        docs.append((k, text))
    docs += [(100, None), (101, ""), (102, items[0][1]), (103, items[0][1] + " " + items[0][1])]
    reduced = {k: _common.bare(t) for k, t in docs if t}
    runs = {k: {b[i : i + 40] for i in range(len(b) - 39)} for k, t in items if t for b in [_common.bare(t)]}
    expected = {(d, i) for d, b in reduced.items() for i, r in runs.items() if any(b[p : p + 40] in r for p in range(len(b) - 39))}
    corpus = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, item_id int")
    held = spark.createDataFrame(items, "item_id long, text string")
    for block, wave, ready in ((2_000_000, 32, 4), (300, 32, 1), (300, 2, 0)):
        for name, value in (("BLOCK_CHARS", block), ("WAVE", wave), ("READY", ready)):
            monkeypatch.setattr(leakage, name, value)
        rows = leakage.matches(corpus, "doc_id", "text", held, "item_id", "text").collect()
        assert {(r.doc_id, r.item_id) for r in rows} == expected and len(rows) == len(expected)
        for r in rows:
            mine, theirs = reduced[r.doc_id], _common.bare(dict(items)[r.item_id])
            assert r.length >= 40 and mine[r.doc_pos : r.doc_pos + r.length] == theirs[r.item_pos : r.item_pos + r.length]
    left = leakage.without_leaks(corpus, "doc_id", leakage.matches(corpus, "doc_id", "text", held, "item_id", "text"))
    assert {r.doc_id for r in left.collect()} == {k for k, _ in docs} - {d for d, _ in expected}
    assert leakage.matches(corpus, "doc_id", "text", held.limit(0), "item_id", "text").count() == 0


def test_truncation_on_made_cuts(spark):
    rng = np.random.default_rng(3)
    pick = lambda options: options[int(rng.integers(0, len(options)))]
    who, when = ("조합원", "주민 대표", "시설 담당", "구청 직원", "교장", "입찰 업체", "방문객", "의사"), ("지난봄", "어제 아침", "3월 4일", "퇴근 무렵", "장날", "올해 초")
    what, did = ("도로 공사 일정", "급식 예산", "주차 요금표", "회의 기록", "수도 요금 고지서", "예방 접종 명단", "동네 소식지"), ("꼼꼼히 살폈습니다", "다시 나누어 주었다", "미루기로 했다", "모두에게 알렸습니다", "고쳐 적었다", "받아들이지 않았습니다")
    sentences = [f"{pick(when)} {pick(who)}이 {pick(what)}를 {pick(did)}." for _ in range(2000)]
    complete = [" ".join(pick(sentences) for _ in range(6)) + tail for tail in ("", "", "", " 감사합니다.", "\n이상 끝", "\n#별빛 #신청서") for _ in range(120)]
    rng = np.random.default_rng(1)
    cut = []
    while len(cut) < 80:
        text = complete[int(rng.integers(0, len(complete)))].split("\n")[0]
        k = int(rng.integers(30, len(text) - 10))
        if text[k - 1].isalnum() and text[k].isalnum():
            cut.append(text[:k] + ("…" if rng.random() < 0.2 else ""))
    rows = [(k, t, "s") for k, t in enumerate(complete)] + [(10_000 + k, t, "s") for k, t in enumerate(cut)] + [(20_000, None, "s"), (20_001, "", "s"), (20_002, " \n", None), (20_003, complete[0], None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, chars int, bytes int")
    scores = {r.doc_id: r.score for r in truncation.scored(df, "doc_id", "text", "source").collect()}
    assert not {20_000, 20_001, 20_002} & set(scores) and 20_003 in scores
    flagged = {k for k, s in scores.items() if s >= 0.5}
    real = {10_000 + k for k in range(len(cut))}
    assert len(flagged & real) / len(real) > 0.85 and len(flagged - real) < 30
    assert truncation.scored(df.limit(0), "doc_id", "text", "source").count() == 0


def test_field_limits_are_found(spark):
    rows = [("a", "x" * 100) for _ in range(40)] + [("a", "x" * int(n)) for n in np.random.default_rng(0).integers(20, 99, 200)] + [("b", "x" * int(n)) for n in range(20, 220)] + [("c", "가" * 50) for _ in range(30)] + [(None, "x")]
    got = {r.source: (r.chars, r.bytes) for r in truncation.limits(spark.createDataFrame(rows, "source string, text string"), "source", "text").collect()}
    assert got["a"] == (100, 100) and "b" not in got and got["c"] == (50, 150)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_on_the_smallest_tables(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    rows = df.collect()
    assert df.columns and (not name.endswith("_found") or len(rows) == len(set(rows)))
