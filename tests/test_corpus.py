"""Corpus store, evaluation, generators, sources, sinks and streams."""

import json
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hanmaru.functions import validate as V
from hanmaru.operators import corpus as C, evaluate as E, generate as G
from hanmaru.plans.corpus import stored
from hanmaru.sources import readers, sinks
from hanmaru.streaming import ingest


def test_first_row_of_a_hash_wins(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None)], "id int, h string")
    assert sorted(C.first_wins(df, F.col("h"), "id").collect()) == [(1, "a"), (2, "b")]
    old = spark.createDataFrame([("a",)], "x string")
    assert C.first_wins(df, F.col("h"), "id", old).collect() == [(2, "b")]


def test_entities_and_back(spark):
    rows = [(1, list("김민수 왔다"), ["B-NAME", "I-NAME", "I-NAME", "O", "O", "O"]), (2, list("ab"), ["I-NAME", "O"]), (3, [], []), (4, None, None), (5, list("xy"), ["B-A", "B-A"])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>, label_names array<string>")
    got = C.entities(df, "id").orderBy("id", "start").collect()
    assert [tuple(r) for r in got] == [(1, "NAME", 0, 3, "김민수"), (5, "A", 0, 1, "x"), (5, "A", 1, 2, "y")]
    back = spark.createDataFrame([("김민수 왔다", [(0, 3, "NAME"), (1, 2, "X")])], "t string, s array<struct<start:int,end:int,entity:string>>")
    assert back.select(C.spans_to_bio(F.col("t"), F.col("s"))).first()[0] == ["B-NAME", "I-NAME", "I-NAME", "O", "O", "O"]


def test_weak_labels_equal_brute_force(spark, monkeypatch):
    terms = [("ORG", "별물산"), ("NAME", "김민수"), ("ORG", "SG"), ("ADDRESS", "별물"), ("ORG", " "), ("NAME", "가")]
    texts = ["별물산의 김민수가 ESG와 SG를", "정김민수 김민수학원", "", None, "별물", "김민수 010-1234-5678 a@b.co 900101-1234567 별물산", "별", "x" * 3000 + "별물산"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "id int, text string, value string")
    t = spark.createDataFrame(terms, "entity string, value string")

    def brute(text):
        found = [(i, i + len(v), e) for e, v in terms if len(v.strip()) > 1 for i in range(len(text)) if text.startswith(v, i) and C.guarded(text, i, i + len(v), e)]
        taken, out = set(), []
        for s, e, kind in sorted(set(found + C.by_form(text)), key=lambda x: (x[0] - x[1], x[0], x[2])):
            if taken.isdisjoint(range(s, e)):
                taken.update(range(s, e))
                out.append((s, e, kind))
        return sorted(out)

    for block in (200_000, 2):  # by automaton, by join
        monkeypatch.setattr(C, "TERMS", block)
        got = {r.id: [(s.start, s.end, s.entity) for s in r.spans] for r in C.weak_labels(df, "id", "text", t).collect()}
        assert got == {k: brute(x) for k, x in enumerate(texts) if x and brute(x)}


def test_diversity_equals_the_greedy_pass(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((12, 32))
    m = np.concatenate([base, base + 0.05 * rng.standard_normal(base.shape), base + 0.05 * rng.standard_normal(base.shape)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    kept = []
    for k, v in enumerate(m):
        if not kept or float((m[kept] @ v).max()) < 0.9:
            kept.append(k)
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m)] + [(99, None)], "id int, v array<float>")
    got = sorted(r.id for r in C.diverse(df, "id", "v", 0.9, stored).collect())
    assert got == [*kept, 99]
    empty = C.diverse(df.limit(0), "id", "v", 0.9, stored)
    assert empty.count() == 0


def test_sampling_sizes_hold(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 7 == 0, "b").otherwise(None).alias("k"))
    sizes = C.allocated(df, ["k"], 500)
    got = Counter(r.k for r in C.drawn(df, ["k"], sizes, "id", "s").collect())
    assert got == {r.k: r.size for r in sizes.collect()} and sum(got.values()) == 500


def test_matching_takes_equal_spans_first(spark):
    n = lambda *spans: [(a, b, "N") for a, b in spans]
    cases = [
        (n((0, 4)), n((0, 3), (0, 4)), ["exact", "spurious"]), (n((0, 4)), n((0, 2), (1, 4)), ["partial", "spurious"]), (n((0, 4)), [(0, 4, "X")], ["miss", "spurious"]), ([], [], []), (None, n((1, 2)), ["spurious"]), (n((1, 2)), None, ["miss"]),
        (n((0, 4), (0, 4)), n((0, 4)), ["exact", "miss"]), (n((0, 4), (0, 4)), n((0, 4), (0, 4)), ["exact", "exact"]), (n((0, 10)), n((0, 5), (5, 10), (0, 4)), ["partial", "spurious", "spurious"]), (n((0, 10)), n((0, 4)), ["miss", "spurious"]),
    ]
    kind = "array<struct<start:int,end:int,entity:string>>"
    df = spark.createDataFrame([(k, g, p) for k, (g, p, _) in enumerate(cases)], f"id int, g {kind}, p {kind}")
    got = df.orderBy("id").select(E.matches(F.col("g"), F.col("p")).alias("m")).collect()
    assert [[x.kind for x in r.m] for r in got] == [kinds for _, _, kinds in cases]
    taken = [(x.kind, x.start) for x in got[8].m]
    assert taken == [("partial", 0), ("spurious", 0), ("spurious", 0)] and len(E.matched(df, "id", "g", "p").collect()) == sum(len(k) for *_, k in cases)


def test_metrics_and_gates(spark):
    m = spark.createDataFrame([(1, "exact", "A"), (1, "miss", "A"), (2, "spurious", "B")], "id int, kind string, entity string")
    rows = {r.entity: r for r in E.entity_metrics(m).collect()}
    assert rows["A"].precision == 1 and rows["A"].recall == 0.5 and rows["B"].precision == 0 and rows[None].f1 == 0.5
    values = spark.createDataFrame([("x", 0.5), ("y", None)], "gate string, value double")
    got = {r.gate: r.status for r in E.gates(values, {"x": (">=", 0.4), "y": ("<=", 1.0), "z": ("==", 0.0)}).collect()}
    assert got == {"x": "pass", "y": "skipped", "z": "skipped"}


def test_nearest_rank_rounds_to_even(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6],), ([],)], "v array<int>")
    assert [r[0] for r in df.select(E.nearest_rank(F.col("v"), 0.5)).collect()] == [3, None]


def test_generated_numbers_are_valid(spark):
    assert G.resident_numbers(spark, 300).where(V.resident(F.col("value"), "strict")).count() == 300
    assert G.business_numbers(spark, 300).where(V.business(F.col("value"))).count() == 300
    assert G.card_numbers(spark, 300).where(V.card(F.col("value"))).count() == 300


def test_mutations_apply_where_they_can(spark):
    df = spark.createDataFrame([("010-12",), ("김민수",), ("",), (None,)], "v string")
    got = [{m.name: m.text for m in (r[0] or [])} for r in df.select(G.mutations(F.col("v"))).collect()]
    assert got[0]["circled"] == "⓪①⓪-①②" and got[0]["no_dash"] == "01012" and "hanja" not in got[0]
    assert got[1]["choseong"] == "ㄱㅁㅅ" and got[1]["hanja"] == "金민수" and got[1]["romanize"] == "Kim 민수"
    assert got[2] == {"original": ""} and got[3] == {}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("이름;글\n김;안녕\n이;\n".encode("cp949"))
    (tmp_path / "b.tsv").write_text("이름\t글\n박\t하나\n", encoding="utf-8")
    rows = sorted((r.id, dict(r.fields)) for r in readers.delimited(spark, str(tmp_path), ["글"], "이름").collect())
    assert rows == [("김", {"글": "안녕"}), ("박", {"글": "하나"}), ("이", {})]
    (tmp_path / "c.jsonl").write_text('{"a": 1, "b": null}\nbroken\n[1]\n\n', encoding="utf-8")
    assert sorted(json.dumps(r.fields) for r in readers.json_lines(spark, str(tmp_path)).collect()) == ['{"a": "1"}', '{"text": "broken"}']
    (tmp_path / "d.txt").write_text(" x \n\ny\n", encoding="utf-8")
    assert sorted(r.text for r in readers.text_lines(spark, str(tmp_path)).collect()) == ["x", "y"]
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("1.json", json.dumps({"SJML": {"text": [[{"title": "t", "content": "c"}]]}}))
        z.writestr("2.json", "no")
    assert [(r.title, r.subtitle, r.content) for r in readers.zipped_json(spark, str(tmp_path)).collect()] == [("t", None, "c")]


def test_composed_fields_stand_where_they_say(spark):
    df = spark.createDataFrame([(" a  b ", None, "c")], "x string, y string, z string")
    row = readers.composed(df, ["x", "y", "z"]).first()
    assert row.text == "x: a b\nz: c\n" and [row.text[f.start : f.end] for f in row.fields] == ["a b", "c"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "h string, n int")
    sinks.insert_new(df.where("n < 3"), str(tmp_path / "t"), "h")
    sinks.insert_new(df, str(tmp_path / "t"), "h")
    assert sorted(r.h for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "b"]
    events = spark.createDataFrame([("1", "ok", "x@y.example"), ("2", "see a@b.example", "z")], "id string, note string, value_hash string")
    sinks.audit_lines(events, str(tmp_path / "audit"))
    assert [r.id for r in spark.read.json(str(tmp_path / "audit")).collect()] == ["1"]
    parts = sinks.sized_parts(spark.range(100).coalesce(1), 100).collect()
    assert sum(p.n_rows for p in parts) == 100 and all(p.n_bytes <= 100 for p in parts)
    old, new = spark.createDataFrame([("k", 1, "x")], "key string, at int, v string"), spark.createDataFrame([("k", 2, "y"), ("l", 1, "z")], "key string, at int, v string")
    assert sorted((r.key, r.v) for r in sinks.upserted(old, new, "key", "at").collect()) == [("k", "y"), ("l", "z")]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, None), (4, "c")], "id int, text string").withColumn("at", F.current_timestamp())
    (tmp_path / "in").mkdir()
    rows.write.parquet(str(tmp_path / "in" / "t.parquet"))
    stream = ingest.parquet_stream(spark, str(tmp_path / "in"), "t")
    assert ingest.run_once(ingest.deduplicated(stream, "text", "at"), str(tmp_path / "w")).where("text is not null").count() == 2
    ingest.insert_stream(ingest.parquet_stream(spark, str(tmp_path / "in"), "t"), "text", str(tmp_path / "table"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_pages_and_marks(spark):
    df = spark.createDataFrame([("<p>a <b>b</b></p>\n\n<script>x</script><p>c</p>",), ("",), (None,)], "h string")
    assert [r[0] for r in df.select(C.html_body(F.col("h"))).collect()] == ["a b\nc", None, None]
    marks = spark.createDataFrame([(1, 'x <NAME risk="P1" suffix="님">김</NAME>님 <ORG>별</ORG>'), (2, "없음"), (3, None), (4, "")], "id int, t string")
    got = [r.m for r in marks.orderBy("id").select(C.marked(F.col("t")).alias("m")).collect()]
    assert got[0].text == "x 김님 별" and [tuple(x) for x in got[0].labels] == [(2, 3, "NAME", "P1", "님"), (5, 6, "ORG", None, None)]
    assert (got[1].text, got[1].labels) == ("없음", []) and got[2] is None and got[3].text == ""
    for broken in ("<NAME>김", "<NAME><ORG>김</ORG></NAME>", "<NAME></NAME>"):
        with pytest.raises(Exception, match="a mark is"):
            spark.createDataFrame([(broken,)], "t string").select(C.marked(F.col("t"))).collect()


def test_negatives_are_the_first_by_hash(spark):
    import hashlib

    df = spark.createDataFrame([(k, k % 5 == 0 if k % 11 else None) for k in range(3000)], "id int, p boolean")
    for ratio in (0.0, 0.5, 1.7, 50.0):
        rows = C.with_negatives(df, F.col("p"), "id", ratio).collect()
        positive = {k for k in range(3000) if k % 5 == 0 and k % 11}
        others = sorted(set(range(3000)) - positive, key=lambda k: (hashlib.md5(str(k).encode()).hexdigest(), k))
        assert {r.id for r in rows if r.positive} == positive and len(rows) == len({r.id for r in rows})
        assert {r.id for r in rows if not r.positive} == set(others[: int(len(positive) * ratio)])
    assert C.with_negatives(df.limit(0), F.col("p"), "id", 1.0).count() == 0


def test_the_index_of_vectors_misses_few(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((1500, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.905 * a + np.sqrt(1 - 0.905**2) * side  # pairs right at the threshold
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(np.concatenate([a, b]))], "id int, v array<float>")
    got = {(r.a, r.b) for r in C.near_vectors(df, "id", "v", 0.9).collect()}
    assert sum((k, k + 1500) in got for k in range(1500)) >= 0.985 * 1500
    assert C.lsh_shape(10**9, 0.9)[0] == 24 and C.lsh_shape(1, 0.9)[0] == C.LEAST_PLANES


def test_values_are_projected_on_all_places(spark):
    df = spark.createDataFrame([("김민수와 김민수 민수 a.b a+b", [("김민수", "NAME"), ("민수", "NAME"), ("a.b", "ORG"), ("없음", "ORG"), ("", "ORG")]), ("", []), (None, None)], "t string, e array<struct<value:string,entity:string>>")
    got = [r.p and [(s.start, s.end) for s in r.p] for r in df.select(C.projected(F.col("t"), F.col("e")).alias("p")).collect()]
    assert got[0] == [(0, 3), (5, 8), (9, 11), (12, 15)] and got[1] == [] and not got[2]


def test_page_bodies(spark):
    pages = ['<p>x</p><div class="a main b">집 <b>밖</b></div>', "<article><p>하나</p></article><p>둘</p>", "<p>하나</p><div>둘</div><p>셋</p>", "<div>둘</div>", "<script>1</script>", None]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, h string")
    assert [r[0] for r in df.orderBy("id").select(C.html_body(F.col("h"), ["main"])).collect()] == ["집 밖", "하나", "하나\n셋", "둘", None, None]


def test_sealed_values_open_only_with_their_key_and_row(spark):
    from hanmaru.functions import text as T

    key, other = T.password_key("a", b"salt", 1000), T.password_key("b", b"salt", 1000)
    df = spark.createDataFrame([(1, "값 a"), (2, ""), (3, None)], "id int, v string").withColumn("box", T.sealed(F.col("v"), key, F.col("id").cast("string")))
    opened = lambda k, bound: [r[0] for r in df.orderBy("id").select(T.opened(F.col("box"), k, bound)).collect()]
    assert opened(key, F.col("id").cast("string")) == ["값 a", "", None] and opened(other, F.col("id").cast("string")) == [None] * 3 and opened(key, F.lit("9")) == [None] * 3


def test_failures_are_told_apart(spark):
    rows = [("miss", "A", 0, 2, []), ("spurious", "A", 0, 2, [(5, 6, "A")]), ("spurious", "A", 0, 2, [(1, 6, "B")]), ("spurious", "A", 0, 2, [(1, 6, "A")]), ("exact", "A", 0, 2, [(0, 2, "A")])]
    df = spark.createDataFrame(rows, "kind string, entity string, start int, end int, g array<struct<start:int,end:int,entity:string>>")
    assert [r[0] for r in df.select(E.failure(*(F.col(c) for c in ("kind", "entity", "start", "end", "g")))).collect()] == ["FN", "FP", "TYPE_CONFUSION", "OVERDETECTION", None]


def test_p_values(spark):
    df = spark.createDataFrame([(0.0,), (3.841458820694124,), (None,)], "x double")
    got = [r[0] for r in df.select(E.tail_probability(F.col("x"))).collect()]
    assert got[0] == 1 and abs(got[1] - 0.05) < 1e-9 and got[2] is None
