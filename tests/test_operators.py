import json
import random

import pytest
from pyspark.sql import functions as F

from passagelake.functions.text import tokens
from passagelake.operators import answers, evaluate, questions, search, sync, textcheck
from passagelake.ports import AgreeingJudge, HashEmbedder, OverlapReranker, QuotingCompleter
from passagelake.sources import files
from passagelake.sources.definitions import DEFINITIONS, vector_definition
from passagelake.streaming import incremental


def test_plan_is_empty_when_nothing_changed(spark):
    r = spark.createDataFrame([("a", "1", 0), ("b", "2", 1)], "id string, content_hash string, pos int")
    assert sync.plan_sync(r, r.drop("pos")).count() == 0
    held = spark.createDataFrame([("b", "x"), ("c", "3")], "id string, content_hash string")
    assert {(x.id, x.action) for x in sync.plan_sync(r, held).collect()} == {("a", "insert"), ("b", "update"), ("c", "delete")}


RECORD = "id string, kind string, content_hash string, embedding_text string, parent_id string, pos int"


def test_ingest_converges_and_a_failed_embedder_changes_nothing(spark, tmp_path):
    index = sync.Index(spark, f"file://{tmp_path}/i")
    rows = spark.createDataFrame([("p", "parent", "1", None, None, 0), ("p:c1", "child", "2", "t", "p", 1)], RECORD)
    got = sync.ingest(rows, index, HashEmbedder(4), DEFINITIONS).first()
    assert (got.inserted, got.updated, got.deleted, got.embedded) == (2, 0, 0, 1)
    got = sync.ingest(rows, index, HashEmbedder(4), DEFINITIONS).first()
    assert (got.inserted, got.updated, got.deleted, got.embedded) == (0, 0, 0, 0) and index.version() == 1
    docs = {r.id: r for r in index.read().collect()}
    assert len(docs["p:c1"].embedding) == 4 and docs["p"].embedding is None and docs["p"].parent_id is None

    class Short(HashEmbedder):
        def embed(self, texts, kind="document"):
            return []

    version = index.version()
    with pytest.raises(Exception):
        sync.ingest(rows.withColumn("content_hash", F.lit("9")), index, Short(4))
    assert index.version() == version
    with pytest.raises(ValueError):
        sync.ingest(rows.limit(0), index, HashEmbedder(4))
    with pytest.raises(ValueError):
        index.ensure("chunks_vector", "vector", vector_definition(3))


def test_a_sync_replaces_what_a_failed_write_left(spark, tmp_path):
    index = sync.Index(spark, f"file://{tmp_path}/i")
    rows = spark.createDataFrame([("p", "parent", "1", None, None, 0)], RECORD)
    for left, fresh, version in (("00000001/base", "1", 1), ("00000002/documents", "2", 2)):
        rows.write.parquet(f"{tmp_path}/i/versions/{left}")
        (tmp_path / "i" / "versions" / left / "_SUCCESS").unlink()
        sync.ingest(rows.withColumn("content_hash", F.lit(fresh)), index, HashEmbedder(4))
        assert index.version() == version and [r.content_hash for r in index.hashes().collect()] == [fresh]


def test_definitions_compare_without_order():
    a = {"fields": [{"type": "filter", "path": "x"}, {"type": "vector", "path": "e", "similarity": "cosine", "numDimensions": 3}]}
    b = {"fields": list(reversed(a["fields"]))}
    assert sync.canonical("vector", a) == sync.canonical("vector", b)


def test_stream_ingest(spark, tmp_path):
    unit = '---\nsource: pilot\nunit: "1"\nunit_name: X\nrevision: "1.0"\n---\n## A\n<!-- content_type: theory -->\nText.\n'
    spark.createDataFrame([("u", unit)], "path string, content string").write.parquet(f"{tmp_path}/in")
    index = sync.Index(spark, f"file://{tmp_path}/i")
    stream = spark.readStream.schema("path string, content string").parquet(f"{tmp_path}/in")
    incremental.ingest_stream(stream, index, HashEmbedder(4), f"{tmp_path}/c").awaitTermination(120)
    assert {r.id for r in index.read().collect()} == {"pilot:1:a", "pilot:1:a:c1"}


def test_expand_keeps_the_best_child_first(spark):
    hits = spark.createDataFrame([(1, i + 1, p) for i, p in enumerate("ABAC")], "query_id int, rank int, parent_id string")
    assert [r.parent_id for r in search.expand(hits).orderBy("rank").collect()] == ["A", "B", "C"]


def test_knn_skips_what_has_no_direction(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, 1.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.id for r in search.knn(v, q).orderBy("rank").collect()] == [1, 5]
    assert search.knn(v, q.limit(0)).count() == 0 and search.knn(v.limit(0), q).count() == 0


def test_search_in_blocks_is_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha {'beta ' * (i % 3)} t{i % 5}") for i in range(60)] + [(99, None)], "id long, text string")
    q = spark.createDataFrame([(i, f"beta t{i}") for i in range(5)], "query_id long, text string")
    whole = sorted(map(tuple, search.bm25(docs, q, 7).collect()))
    monkeypatch.setattr(search, "WORD_BLOCK", 2)
    assert sorted(map(tuple, search.bm25(docs, q, 7).collect())) == whole


def test_rerank_port(spark):
    c = spark.createDataFrame([(1, p, i + 1, t) for i, (p, t) in enumerate([("A", "x"), ("B", "red kite"), ("C", "kite")])], "query_id int, parent_id string, rank long, text string")
    q = spark.createDataFrame([(1, "red kite")], "query_id int, text string")
    for how in (None, OverlapReranker()):
        assert [r.parent_id for r in search.rerank(c, q, 2, how).orderBy("rank").collect()] == ["B", "C"]


PASSAGES = "query_id int, rank int, id string, source string, unit string, pages array<string>, heading_path array<string>, content_type string, text string"
GOOD = {"source": "pilot", "unit": "5", "page": 1}


def decide(spark, reply, n=1):
    passages = spark.createDataFrame([(1, 1, "p", "pilot", "5", ["5-1", "6-2"], ["A"], "theory", "Body.")], PASSAGES)
    replies = spark.createDataFrame([(1, reply if isinstance(reply, str) else json.dumps(reply), n)], "query_id int, completion string, n_passages long")
    return answers.decide(replies, passages).first()


@pytest.mark.parametrize(
    "reply, ok",
    [
        ({"grounded": True, "answer": "Yes", "citations": [GOOD]}, True),
        ({"grounded": 1, "answer": "Yes", "citations": [GOOD | {"unit": 5}]}, True),
        ({"grounded": "yes", "answer": "Yes", "citations": [GOOD]}, True),
        ("```json\n" + json.dumps({"grounded": True, "answer": "Yes", "citations": [GOOD]}) + "\n```", True),
        ({"grounded": 0, "answer": "Yes", "citations": [GOOD]}, False),
        ({"grounded": "", "answer": "Yes", "citations": [GOOD]}, False),
        ({"grounded": True, "answer": " ", "citations": [GOOD]}, False),
        ({"grounded": True, "answer": "Yes", "citations": []}, False),
        ({"grounded": True, "answer": "Yes", "citations": "x"}, False),
        ({"grounded": True, "answer": "Yes", "citations": [GOOD | {"page": True}]}, False),
        ({"grounded": True, "answer": "Yes", "citations": [GOOD | {"page": "1"}]}, False),
        ({"grounded": True, "answer": "Yes", "citations": [GOOD | {"page": 1.0}]}, False),
        ({"grounded": True, "answer": "Yes", "citations": [GOOD | {"page": 0}]}, False),
        ({"grounded": True, "answer": "Yes", "citations": [GOOD | {"page": 2}]}, False),
        ({"grounded": True, "answer": "Yes", "citations": [GOOD, GOOD | {"source": " "}]}, False),
        ({"grounded": True, "answer": "Yes", "citations": [GOOD | {"unit": None}]}, False),
        ("nonsense", False),
        ("[1]", False),
        ("", False),
    ],
)
def test_refuse_or_cite(spark, reply, ok):
    got = decide(spark, reply)
    assert got.grounded == ok and (got.answer == answers.REFUSAL) == (not ok) and bool(got.citations) == ok


def test_without_passages_nobody_is_asked(spark):
    class Never:
        def complete(self, system, user):
            raise AssertionError

    q = spark.createDataFrame([(1, "why?")], "query_id int, question string")
    got = answers.answer(q, spark.createDataFrame([], PASSAGES), Never()).first()
    assert not got.grounded
    passages = spark.createDataFrame([(1, 1, "p", "pilot", "5", ["5-1"], ["A"], "theory", "Body.")], PASSAGES)
    got = answers.answer(q, passages, QuotingCompleter()).first()
    assert got.grounded and got.answer == "Body." and got.citations[0].page == 1


def test_means_are_zero_or_null(spark):
    facts = spark.createDataFrame([("vector", 1, None, True, None, None, None)], "step string, item_id int, recall double, refusal boolean, faithful boolean, grounded_ok boolean, correct boolean")
    got = evaluate.curve(facts).first()
    assert (got.recall, got.refusal, got.faithful) == (0.0, 1.0, None)
    report = json.loads(evaluate.report_json(evaluate.curve(facts), 1, 10).first().report)
    assert report["points"][0]["step"] == "vector" and report["points"][0]["faithful"] is None


def test_judges_are_asked_for_grounded_answers_only(spark):
    rows = [(1, True, "answer", "a", "c", "p", "e"), (2, False, "answer", "a", "c", "p", "e"), (3, True, "refuse", "a", "c", "p", "e")]
    facts = spark.createDataFrame(rows, "item_id int, result_grounded boolean, expected_behavior string, answer string, cited string, passages string, expected_answer string")
    got = {r.item_id: (r.faithful, r.grounded_ok, r.correct) for r in evaluate.judged(facts, AgreeingJudge()).collect()}
    assert got == {1: (True, True, True), 2: (None, None, None), 3: (None, None, None)}


@pytest.mark.parametrize("text, want", [('{"correct": true, "rationale": "ok"}', (True, "ok")), ('{"correct": 1}', (False, evaluate.UNREADABLE)), ("x", (False, evaluate.UNREADABLE)), ('{"correct": false, "rationale": 3}', (False, ""))])
def test_verdicts(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(evaluate.verdict(F.col("t"), ("correct",)).alias("v")).first().v
    assert tuple(got) == want


def test_questions(spark):
    md = '---\nunit: "3"\n---\n## Q\n<!-- content_type: self_check -->\nIntro.\n1. What is\n   lift?\na. First part\nA. a choice\n- Why?\n## Next\n2. Not me\n'
    df = spark.createDataFrame([("x/unit-03.md", md), ("x/unit-04.md", "## Q\n<!-- content_type: self_check -->\nQ1. One?\n")], "path string, content string")
    got = {r.id: r.question for r in questions.mine(questions.sections(df)).collect()}
    assert got == {"self_check-pilot-3-01": "What is lift? a. First part", "self_check-pilot-3-02": "Why?", "self_check-pilot-4-01": "One?"}


def test_run_state(spark, tmp_path):
    path = f"file://{tmp_path}/run"
    assert files.read_run(spark, path) is None
    items = spark.createDataFrame([("a",), ("b",)], "id string")
    files.append_run(spark.createDataFrame([("a", "yes", None, True), ("b", None, "lost", None)], "id string, answer string, error string, grounded boolean"), path)
    done = files.read_run(spark, path)
    assert [r.id for r in questions.remaining(items, done).collect()] == ["b"]
    assert tuple(questions.run_counts(done).first()) == (1, 0, 1, 2)


def test_items_are_read_strictly(spark, tmp_path):
    item = {"id": "a", "question": "q", "expected_behavior": "answer", "expected_answer": "x", "citations": [{"source": "pilot", "unit": 5, "page": 2}], "choices": ["x", "y"]}
    (tmp_path / "g.json").write_text(json.dumps({"items": [item]}))
    got = files.read_items(spark, f"file://{tmp_path}/g.json").first()
    assert got.citations[0].unit == "5" and got.citations[0].page == 2
    for wrong in ({"page": True}, {"page": 0}, {"source": ""}, {"unit": None}):
        (tmp_path / "b.json").write_text(json.dumps({"items": [item | {"citations": [item["citations"][0] | wrong]}]}))
        with pytest.raises(Exception):
            files.read_items(spark, f"file://{tmp_path}/b.json").collect()


def test_item_rules(spark):
    rows = [("a", "q", "answer", "x; y", ["x", "y"]), ("a", "", "maybe", "z", ["x"])]
    df = spark.createDataFrame(rows, "id string, question string, expected_behavior string, expected_answer string, choices array<string>")
    assert {r.rule for r in textcheck.item_breaches(df).collect()} == {"id repeats", "no question", "unknown behaviour", "answer is no choice"}


def test_json_lines_keep_nulls(spark, tmp_path):
    files.write_json_lines(spark.createDataFrame([("a", None)], "id string, t string"), f"file://{tmp_path}/j")
    assert '{"id":"a","t":null}' in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))


def test_turns_keep_all_their_lines(spark):
    """A user's turn is free text: lines like choices, headings, comments, parts and numbers stay, as the SQL has them."""
    turns = [(1, 0, "Why?\nY. Because.\n# Not a heading\n<!-- nor this -->"), (1, 1, "said"), (1, 2, "a. First\n\nmore"), (2, 0, "A. Only\tthis "), (3, 0, "- 1. dash"), (4, 0, "\n\t"), (4, 2, None)]
    rows = spark.createDataFrame([(c, t, "assistant" if x == "said" else "user", x) for c, t, x in turns], "conv_id long, turn long, role string, text string")
    got = {(r.unit, r.n): r.question for r in questions.mine(questions.turn_sections(rows)).collect()}
    assert got == {("1", 1): "Why? Y. Because. # Not a heading <!-- nor this -->", ("1", 2): "a. First more", ("2", 1): "A. Only this", ("3", 1): "- 1. dash"}


def test_searches_take_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a b"), (2, [0.0, 1.0], "b")], "id long, embedding array<double>, text string")
    asked = rows.withColumnRenamed("id", "query_id")
    try:
        for find in (search.knn, search.bm25):
            spark.conf.set(key, "10000")
            assert {r.id for r in find(rows, asked.filter("query_id = 1"), 1).collect()} == {1}
            assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, was)


def test_a_reranker_gets_all_rows_of_a_query_at_once(spark):
    """Below a join by query that an adaptive plan makes a broadcast, a query's rows lie in several tasks; each gave its own best."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 400, 1, 8).select((F.col("id") % 20).alias("query_id"), F.col("id").alias("parent_id"), F.floor(F.col("id") / 20 + 1).alias("rank"), F.when(F.col("id") >= 340, "red kite").otherwise(F.repeat(F.lit("x "), 50)).alias("text"))
        asked = spark.range(20).select(F.col("id").alias("query_id"), F.lit("red kite").alias("text"))
        got = search.rerank(rows, asked, 2, OverlapReranker()).select("query_id", "parent_id", "rank").collect()
        assert sorted(map(tuple, got)) == [(q, 340 + q + 20 * (n - 1), n) for q in range(20) for n in (1, 2)]
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_fetching_parents_does_not_move_their_texts(spark):
    ranks = spark.createDataFrame([(1, "b", 1), (1, "none", 2), (2, "b", 1)], "query_id int, parent_id string, rank long")
    parents = spark.range(100).select(F.col("id").cast("string").alias("id"), F.repeat(F.lit("t"), 9).alias("text")).union(spark.createDataFrame([("b", "body")], "id string, text string"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = search.fetch(ranks, parents)
        assert sorted((r.query_id, r.parent_id, r.rank, r.text) for r in got.collect()) == [(1, "b", 1, "body"), (2, "b", 1, "body")]
        assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_bm25_writes_places_and_counts_not_words(spark, monkeypatch):
    made = []
    real = search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, name: made.append((name, df.dtypes)) or real(df, name))
    docs = spark.createDataFrame([(1, "a b a"), (2, "c d"), (3, None), (4, "")], "id long, text string")
    asked = spark.createDataFrame([(7, "A d"), (8, "c a"), (9, "nothing")], "query_id long, text string")
    one = sorted(map(tuple, search.bm25(docs, asked).collect()))
    assert [(q, i) for q, i, *_ in one] == [(7, 1), (7, 2), (8, 1), (8, 2)]
    assert made and all("string" not in kind for _, dtypes in made for _, kind in dtypes)
    monkeypatch.setattr(search, "QUERY_BLOCK", 1)
    assert sorted(map(tuple, search.bm25(docs, asked).collect())) == one


def test_the_analyzer_in_java_is_the_analyzer(spark):
    rng = random.Random(5)
    signs = "aZé1٣½_.,:;'’·- 語カあ́⺀\U00020000#"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(2000)] + ["a" * 100_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    assert [r.t for r in rows.select("t", tokens(F.col("t")).alias("w")).collect() if r.w != search.analyze(r.t)] == []
