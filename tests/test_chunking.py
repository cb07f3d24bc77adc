import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagelake.operators import chunking
from passagelake.operators.listsplit import split_list

FRONT = '---\nsource: pilot\nunit: "7"\nunit_name: Turns\nrevision: "1.0"\n---\n# Unit 7\n\n'


def chunks(spark, body, **how):
    df = spark.createDataFrame([("u", FRONT + body)], "path string, content string")
    return [r.asDict() for r in chunking.chunk_units(df, **how).orderBy("owner", "ordinal").collect()]


def test_tree_ids_pages_and_types(spark):
    got = chunks(spark, "<!-- page: 7-1 -->\n## Key messages\n<!-- content_type: key_messages -->\n\nFirst.\n<!-- page: 7-2 -->\nstill first.\n\nSecond.\n### Detail\nInner.\n## Key messages\n<!-- content_type: theory -->\nAgain.\n")
    by_id = {r["id"]: r for r in got}
    assert list(by_id) == ["pilot:7:key-messages", "pilot:7:key-messages:c1", "pilot:7:key-messages:c2", "pilot:7:key-messages:detail", "pilot:7:key-messages:detail:c1", "pilot:7:key-messages-2", "pilot:7:key-messages-2:c1"]
    parent = by_id["pilot:7:key-messages"]
    assert parent["text"] == "First.\nstill first.\n\nSecond." and parent["pages"] == ["7-1", "7-2"] and parent["embedding_text"] is None
    detail = by_id["pilot:7:key-messages:detail"]
    assert detail["content_type"] == "key_messages" and detail["heading_path"] == ["Key messages", "Detail"]
    prefix = "Pilot Guide, Unit 7 — Turns, revision 1.0 > Key messages > Detail [key_messages]"
    assert detail["content_hash"] == hashlib.sha256(f"{prefix}\n\nInner.".encode()).hexdigest()
    assert by_id["pilot:7:key-messages:detail:c1"]["embedding_text"] == f"{prefix}\n\nInner."


def test_lists_and_introductions(spark):
    body = "## A\n<!-- content_type: theory -->\nIt goes so:\n\n- one\n\n  - nested\nruns on\n- two.\n\nProse.\n\n1. First.\n- new list\n- more\n"
    texts = [r["text"] for r in chunks(spark, body) if r["kind"] == "child"]
    assert texts == ["It goes so:\n\n- one\n\n  - nested\nruns on\n- two.", "Prose.", "1. First.", "- new list\n- more"]


def test_page_that_comes_back_is_listed_again(spark):
    got = chunks(spark, "## A\n<!-- content_type: theory -->\n<!-- page: 7-1 -->\na\n<!-- page: 7-2 -->\nb\n<!-- page: 7-1 -->\nc\n")
    assert got[0]["pages"] == ["7-1", "7-2", "7-1"]


FAULTS = [
    ("## A\n<!-- content_type: nothing -->\nx\n", "unknown content type"),
    ("<!-- content_type: theory -->\n## A\nx\n", "content type outside a section"),
    ("## A\nx\n<!-- content_type: theory -->\n", "content type after body"),
    ("## A\n<!-- content_type: theory -->\n# B\n", "title below a section"),
    ("### A\n", "sub-heading without section"),
    ("early\n", "body before the first section"),
    ("## A\nx\n", "no content type"),
    ("## \ue000\n<!-- content_type: theory -->\nx\n", "empty slug with body"),
    ("## \ue000\n<!-- content_type: theory -->\n### B\n", "heading under an empty slug"),
    ("## A\n<!-- content_type: theory -->\nx\n## A 2\n<!-- content_type: theory -->\n## A\n<!-- content_type: theory -->\n", "repeated id"),
]


def test_faults_are_found(spark):
    df = spark.createDataFrame([(str(i), FRONT + body) for i, (body, _) in enumerate(FAULTS)], "path string, content string")
    found = {(r.path, r.rule) for r in chunking.violations(df).collect()}
    assert {(str(i), rule) for i, (_, rule) in enumerate(FAULTS)} <= found
    with pytest.raises(ValueError):
        chunking.chunk_units(df)
    assert chunking.chunk_units(df, strict=False).count() == 0


def test_frontmatter_faults(spark):
    df = spark.createDataFrame([("a", "# x\n"), ("b", "---\nsource: x\n"), ("c", "---\nsource: x\n---\n## A\n"), ("d", None)], "path string, content string")
    found = {(r.path, r.rule) for r in chunking.violations(df).collect()}
    assert {("a", "no frontmatter"), ("b", "unterminated frontmatter"), ("c", "missing frontmatter key"), ("d", "no frontmatter")} <= found


def test_no_units(spark):
    df = spark.createDataFrame([], "path string, content string")
    assert chunking.chunk_units(df).count() == 0


words = st.integers(0, 12).map(lambda n: " ".join("w" * n))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["- ", "1. ", "  - ", "plain ", "  x "]), words), min_size=1, max_size=25))
def test_split_keeps_lines_and_limit(items):
    entries = [(f"{mark}{text}", i) for i, (mark, text) in enumerate(items)]
    limit = 12
    pieces = split_list(entries, limit)
    assert {e[1] for p in pieces for e in p} == {e[1] for e in entries}
    firsts = [e[1] for p in pieces for e in p]
    assert [x for i, x in enumerate(firsts) if x not in firsts[:i]] == sorted(set(firsts))
    for p in pieces:
        assert sum(len(e[0].split()) for e in p) <= limit or len(p) <= 2


def test_split_prefers_items_then_nested_items():
    line = lambda mark, n: (mark + "w " * (n - 1), mark, n)
    entries = [line("- ", 4), line("- ", 4), line("- ", 4), line("- ", 2), line("  - ", 5), line("  - ", 5)]
    assert [[e[2] for e in p] for p in split_list(entries, 9)] == [[4, 4], [4], [2, 5], [2, 5]]


def test_lists_go_to_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        rows = spark.range(3).select(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct(F.lit("- a b").alias("line"), F.lit("1").alias("page"), F.lit(False).alias("blank"))).alias("body"))
        got = [len(r.p) for r in rows.select(chunking.split_pieces("body", 6).alias("p")).collect()]
        assert got == [2, 2, 2] and int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, was)


def test_children_are_made_on_one_path(spark):
    """Lists over the limit and all else come of one reading of the lines; a union would group them twice."""
    lined = spark.createDataFrame([("p", 1, i, f"- w{i} " + "x " * 300, "1", False, 1 + i // 4, "list" if i < 4 else "para") for i in range(6)], "path string, owner int, pos int, line string, page string, blank boolean, block int, kind string")
    got = chunking.children(lined)
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted((r.ordinal, r.kind, r.text.count("- w")) for r in got.collect())
    assert rows == [(1, "list", 1), (2, "list", 1), (3, "list", 1), (4, "list", 1), (5, "para", 2)]


def test_shortcuts_of_line_patterns_change_nothing(spark):
    from pyspark.sql import functions as F

    from passagelake.functions import text as t

    odd = ["", " ", "a", "a ", "a ", " ", "é", "é ", "a\r\n", "a\rb\r", "\n", "a\n\n", "\r", "x　\t", "a~", "a\x7f", "a\x00"]
    odd += ["- a", "  - a", "1. a", "12. a", "1.a", "a. b", "a B", "a b", "ab. c", "\t2. x", "-a", "", "\x0b- a", "١. a"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(odd)], "i int, s string").repartition(2)
    full = F.split(F.regexp_replace(F.regexp_replace("s", r"\r\n?", "\n"), r"\n\z", ""), "\n")
    begin = F.substring("s", 1, 2).rlike(chunking.LIST_BEGIN) & F.col("s").rlike(chunking.LIST_LINE)
    got = rows.select("s", (t.lines(F.col("s")) == full).alias("lines"), (t.rstrip(F.col("s")) == F.regexp_replace("s", f"[{t.SPACE}]+$", "")).alias("rstrip"), (begin == F.col("s").rlike(chunking.LIST_LINE)).alias("list"))
    assert [tuple(r) for r in got.filter("not (lines and rstrip and list)").collect()] == []


def test_words_of_lists_are_counted_in_python_and_only_lines_go_there(spark):
    """Counting words by a pattern was nine tenths of list_split_nested; whole lines went to Python and back."""
    from passagelake.functions import text as t

    odd = ["- a b", "  - c\u2003d\x85e\x1ff\u3000", "    \xa0", "\u200bg \x00h~ é\u1680語", "- i", "", "j k\x0bl"]
    rows = spark.createDataFrame([(odd,), (None,), ([],)], "l array<string>").repartition(1)
    body = F.transform("l", lambda x: F.struct(x.alias("line"), F.lit("1").alias("page"), F.lit(False).alias("blank")))
    got = rows.select("l", chunking.split_places("l", 4).alias("places"), chunking.split_pieces(body, 4).alias("pieces"), F.transform("l", t.word_count).alias("words"), chunking.words_of(body).alias("all"))
    for r in got.collect():
        if r.l is None:
            assert r.places is None and r.pieces is None
            continue
        assert r.words == [len(x.split()) for x in r.l] and r.all == sum(r.words)
        assert [[x.line for x in p] for p in r.pieces] == [[r.l[i] for i in p["at"]] for p in r.places] == [[e[0] for e in p] for p in split_list([(x,) for x in r.l], 4)]
        assert [p.words for p in r.places] == [sum(r.words[i] for i in p["at"]) for p in r.places]
    from passagelake.plans import chunks

    for query in (chunks.list_split_nested, chunks.list_split_500):
        assert "regexp_extract_all" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
