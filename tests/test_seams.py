"""Ports, tracers, runs, readers: what the catalogue's SQL does not reach."""

import json

from passagelake.operators import answers, evaluate, questions, search
from passagelake.operators import sync
from passagelake.operators.sync import Index
from passagelake.functions.text import rstrip, tokens, word_count
from passagelake.ports import AgreeingJudge, HashEmbedder, NoTracer, QuotingCompleter, TableTracer
from passagelake.sources import files, spans


def passages(spark):
    rows = [(1, 1, "a", "pilot", "5", ["5-1"], ["H"], "theory", "First line.\nmore"), (2, 1, "b", "pilot", "6", ["6-2"], ["H"], "theory", "Other.")]
    return spark.createDataFrame(rows, "query_id long, rank long, id string, source string, unit string, pages array<string>, heading_path array<string>, content_type string, text string")


class Moody(QuotingCompleter):
    def __init__(self, bad):
        self.bad = bad

    def complete(self, system, user):
        if self.bad in user:
            raise TimeoutError("too slow")
        return super().complete(system, user)


def test_a_run_goes_on_after_errors(spark, tmp_path):
    items = spark.createDataFrame([(1, "one?"), (2, "two?"), (3, "no passage?")], "id long, question string")
    path = f"file://{tmp_path}/run"
    first = questions.run_batch(items, passages(spark), Moody("two?"), path).first()
    assert (first.grounded, first.refused, first.failed, first.total) == (1, 1, 1, 3)
    held = {r.id: r for r in questions.latest(files.read_run(spark, path)).collect()}
    assert held[2].error == "TimeoutError: too slow" and held[2].answer is None and held[1].error is None
    second = questions.run_batch(items, passages(spark), Moody("one?"), path).first()  # item 1 is not asked again
    assert (second.grounded, second.refused, second.failed, second.total) == (2, 1, 0, 3)
    sent = {r.id: json.loads(r.payload) for r in questions.payload(questions.latest(files.read_run(spark, path))).collect()}
    assert sent[1]["citations"] == [{"source": "pilot", "unit": "5", "page": 1}] and sent[1]["error"] is None and sent[3]["answer"] == answers.REFUSAL


def ablated(spark, **more):
    vectors = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0])], "id long, parent_id long, embedding array<double>")
    parents = spark.createDataFrame([(1, "pilot", "5", ["5-1"], ["H"], "theory", "wing lift"), (2, "pilot", "6", ["6-1"], ["H"], "theory", "tow rope")], "id long, source string, unit string, pages array<string>, heading_path array<string>, content_type string, text string")
    items = spark.createDataFrame([(1, "lift", "answer", ""), (2, "rope", "refuse", "")], "item_id long, question string, expected_behavior string, expected_answer string")
    gold = spark.createDataFrame([(1, "pilot", "5", 1)], "item_id long, source string, unit string, page int")
    queries = spark.createDataFrame([(1, "lift", [1.0, 0.1]), (2, "rope", [0.1, 1.0])], "query_id long, text string, embedding array<double>")
    return evaluate.ablation(items, gold, queries, vectors, parents.select("id", "text"), parents, QuotingCompleter(), AgreeingJudge(), **more)


def test_the_ablation_tells_tracer_and_caller(spark, tmp_path):
    seen = []
    curve = {r.step: r for r in ablated(spark, tracer=TableTracer(f"file://{tmp_path}/trace"), on_item=lambda r: seen.append((r.step, r.item_id))).collect()}
    assert set(seen) == {(s, i) for s in search.STEPS for i in (1, 2)}
    assert curve["vector"].recall == 1.0 and curve["vector"].refusal == 0.5 and curve["vector"].faithful == 1.0
    traced = spark.read.parquet(f"file://{tmp_path}/trace")
    assert {r.step for r in traced.select("step").distinct().collect()} == set(search.STEPS) and traced.filter("seconds < 0").count() == 0
    assert traced.filter("metric = 'recall'").count() == 3  # one item has gold
    assert NoTracer().start("x") is None and NoTracer().end("x", traced) is None


def test_queries_are_embedded_as_queries(spark):
    class Kinds(HashEmbedder):
        def embed(self, texts, kind="document"):
            assert kind == "query"
            return super().embed(texts, kind)

    vectors = spark.createDataFrame([(i, i, HashEmbedder().embed([t])[0]) for i, t in enumerate(["wing lift", "tow rope"])], "id long, parent_id long, embedding array<float>")
    parents = spark.createDataFrame([(0, "wing lift"), (1, "tow rope")], "id long, text string")
    asked = spark.createDataFrame([(7, "rope")], "query_id long, text string")
    got = search.retrieve("vector", vectors, parents, asked, parents, p=1, embedder=Kinds()).first()
    assert got.parent_id == 1


def test_boxes_of_pages(spark):
    class Two:
        def boxes(self, content):
            return [(0, 1.0, 2.0, 3.0, 4.0), (1, 5.0, 5.0, 5.0, 9.0), (1, 0.0, 0.0, 9.0, 9.0)]

    got = spans.extracted_boxes(spark.createDataFrame([("p", b"x")], "path string, content binary"), Two(), "pilot").collect()
    assert [(r.source, r.page_idx, r.box_no, r.x1) for r in got] == [("pilot", 0, 0, 3.0), ("pilot", 1, 2, 9.0)]


def test_settings(spark, tmp_path):
    (tmp_path / ".env").write_text("# a comment\nA=1\n\nexport B = \"two words\"\nC='x=y'\nnothing\nA=3\n")
    assert files.read_settings(spark, f"file://{tmp_path}/.env") == {"A": "3", "B": "two words", "C": "x=y"}


def test_white_space_and_words(spark):
    df = spark.createDataFrame([("a b c", "ends.\t ", "It's o'clock at 1.5 or 10,000; e.g. x_y _ 3rd, don’t U.S. end."), ("", "", "")], "a string, b string, c string")
    first, second = df.select(word_count(df.a).alias("n"), rstrip(df.b).alias("r"), tokens(df.c).alias("t")).collect()
    assert first.n == 3 and first.r == "ends." and second.n == 0 and second.t == []
    assert first.t == ["it's", "o'clock", "at", "1.5", "or", "10,000", "e.g", "x_y", "3rd", "don’t", "u.s", "end"]


def test_filters_compare_in_lower_case(spark):
    df = spark.createDataFrame([("Child", "THEORY"), ("child", "aim"), ("parent", "theory")], "kind string, content_type string")
    assert df.filter(search.token_filter("CHILD", ["Theory"])).count() == 1 and df.filter(search.token_filter(content_types=["theory"])).count() == 2 and df.filter(search.token_filter()).count() == 3


def test_an_index_of_deltas(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sync, "DELTAS", 2)
    index, want = Index(spark, f"file://{tmp_path}/index"), {}
    for v in range(7):
        rows = [(f"k{(v * 3 + i) % 11}", v) for i in range(3)]
        gone = f"k{(v * 5 + 4) % 11}"
        want.update(rows)
        if gone not in dict(rows):
            want.pop(gone, None)
        docs = spark.createDataFrame(rows, "id string, n int")
        index.write(docs, spark.createDataFrame([(r[0],) for r in rows] + [(gone,)], "id string"))
        assert {r.id: r.n for r in index.read().collect()} == want
    assert [v for v, _ in index._versions()] == [4, 5, 6, 7, 8, 9, 10][-len(index._versions()):] and index._versions()[0][0] > 1


def test_an_ablation_searches_once_a_channel(spark, monkeypatch):
    from passagelake.plans import seams

    asked = []
    for name in ("knn", "bm25"):
        real = getattr(search, name)
        monkeypatch.setattr(search, name, lambda *a, _name=name, _real=real, **k: asked.append(_name) or _real(*a, **k))
    got = seams.ablation_seam(spark, "/root/testdata/sf0.001")
    assert asked == ["knn", "bm25"] and [r.step for r in got.orderBy("pos").collect()] == list(search.STEPS)
