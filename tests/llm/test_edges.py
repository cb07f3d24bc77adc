"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

from passagelake.llm import chat, decontaminate, langid, mixing, quality, secretscan, simhash, tokens, warc, winnow

LONG = " ".join(f"word{i % 997}" for i in range(60_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35),
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35),
    (1, "another text with the same id", "en", None, None),
    (2, "alpha beta gamma delta epsilon zeta", None, "b", 35),
    (None, "no id at all in here my friends", "de", "a", 31),
    (None, None, None, None, None),
    (3, "", "fr", "b", 0),
    (4, " \n\t ", "fr", "b", 4),
    (5, None, "fr", "b", None),
    (6, LONG, "en", "c", len(LONG)),
    (7, "123 456 !!", "en", "c", 10),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["row", "key", "nth", "size", "fp", "label", "bucket", "_part", "_score", "target", "p", "part", "marks", "_p", "lang_pred", "score", "said", "node", "bands", "s", "place"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "beta gamma delta epsilon zeta"), (2, None), (3, ""), (4, "two words"), (None, "another text with the same id")], "item_id long, text string")


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


def test_decontamination(spark, docs, benchmark):
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert got == {(1, 1), (2, 1), (1, None)}
    kept = decontaminate.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns and ids(kept) == [3, 4, 5, 6, 7, None, None]
    assert decontaminate.find_leaks(docs.limit(0), benchmark).count() == 0
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0 and decontaminate.decontaminated(docs, benchmark.limit(0)).count() == len(ROWS)


def test_decontamination_in_blocks(spark, docs, benchmark):
    assert len(list(decontaminate.item_blocks(benchmark, block_words=5))) > 1


def test_simhash(spark, docs):
    got = simhash.simhash_components(docs)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[2] == {1} and by[3] == by[4] == by[5] == {3} and by[None] >= {3}
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert ids(kept) == [1, 1, 3, 6, 7, None]
    assert simhash.simhash_components(docs.limit(0)).count() == 0 and simhash.dedup(docs.limit(0)).count() == 0


def test_mixing(spark, docs):
    got = mixing.mix_counts(docs)
    assert got.count() == len(ROWS)
    assert all(0 <= r.taken <= 2 * r.size for r in got.collect())
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = out.filter("doc_id = 6").select(F.sum(mixing.words(F.col("text")))).first()[0] or 0
    assert words == got.filter("doc_id = 6").first().taken
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, mixing.mix_counts(docs).collect()), key=str)
    assert mixing.mix_counts(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_tokens(spark, docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = tokens.encoded(docs, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [1, 1, 1, 2, 3, 4, 5, 6, 7, None, None]
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens >= 1
        at += r.n_tokens
    assert [r.n_tokens for r in got if r.doc_id in (3, 5)] == [1, 1]
    assert tokens.encoded(docs.limit(0), path).count() == 0


def test_language(spark, docs):
    model = langid.train(docs, F.lit(True))
    got = langid.predicted(docs.select("doc_id", "text", *CLASH), model).collect()
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5, 7)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    nothing = langid.train(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.predicted(docs.select("doc_id", "text"), nothing).collect()} == {"und"}
    assert langid.predicted(docs.limit(0).select("doc_id", "text"), model).count() == 0


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (6, 0), (None, 1), (7, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert all(0 <= r._score <= 1 for r in quality.scored(docs.select("doc_id", "text"), model).collect())
    assert quality.accepted(docs, model, threshold=0.0).columns == docs.columns
    empty = quality.train(docs, labels.limit(0))
    assert {r._score for r in quality.scored(docs.select("doc_id", "text"), empty).collect()} == {0.5}
    assert quality.accepted(docs.limit(0), model).count() == 0


def test_secrets(spark, docs):
    got = secretscan.find_secrets(docs)
    assert got.count() == len(ROWS) and not any(r.spans for r in got.collect())
    key = "9f86d081884c7d659a2feaa0c55ad015"
    more = docs.unionByName(docs.limit(2).withColumn("doc_id", F.lit(99).cast("long")).withColumn("text", F.lit(f"{LONG} token = '{key}' and {key}{key} {'x1' * 40000}")))
    spans = [r.base for r in secretscan.find_secrets(more).collect() if r.doc_id == 99]
    assert len(spans) == 2 and spans[0] == spans[1] and [s.kind for s in spans[0]] == ["assign", "hex", "hex"]
    assert secretscan.find_secrets(docs.limit(0)).count() == 0


def test_winnowing(spark, docs):
    got = winnow.compared(docs).collect()
    assert len(got) == len(ROWS)
    texts = {r.text: r.marks for r in got}
    assert texts[""] == [] and texts[" \n\t "] == [] and len(texts[LONG]) > 1000 and len(texts["123 456 !!"]) == 1
    assert winnow.compared(docs.limit(0)).count() == 0


def test_winnowing_of_hot_ids(spark):
    """One id with most rows, rows without an id, and equal rows: each row is there once and follows its order."""
    rows = [(7, f"text number {i % 40} of many words in a row here") for i in range(120)] + [(None, "no id")] * 30 + [(i, f"plain {i}") for i in range(10)]
    got = winnow.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    first = [r for r in got if r.doc_id == 9][0]
    assert all(r.edited == r.text[: len(r.text) - len(r.text) // 2] + first.text[: len(r.text) // 2] for r in got if r.doc_id is None)
    assert winnow.compared(spark.createDataFrame([(None, "a b"), (None, "c")], "doc_id long, text string")).count() == 2


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, turns string, n string, at string, example string"
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (1, 1, "assistant", None), (None, 0, "user", "x"), (2, 0, "assistant", "y"), (3, 0, "system", "only")]
    df = spark.createDataFrame([(*r, "c", "c", "c", "c") for r in rows], schema)
    got = {r.conv_id: r for r in chat.read_back(chat.examples(df)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("", ""), ("user", "a"), ("user", "a"), ("assistant", "")]
    assert got[2].loss_text == "y" and got[3].loss_text == "" and len(got[None].turns) == 1
    alone = chat.read_back(chat.examples(spark.createDataFrame([(None, i % 2, "assistant", f"t{i % 3}") for i in range(30)], "conv_id long, turn long, role string, text string"))).collect()
    assert len(alone) == 30 and all(len(r.turns) == 1 for r in alone)
    long = chat.read_back(chat.examples(spark.createDataFrame([(1, 0, "user", LONG), (1, 1, "assistant", LONG + "<|end|>\n")], "conv_id long, turn long, role string, text string"))).first()
    assert long.loss_text == LONG + "<|end|>\n" and [t.text for t in long.turns] == [LONG, LONG + "<|end|>\n"]
    assert chat.examples(df.limit(0)).count() == 0


def test_warc(spark):
    z = "z" * 150
    rows = [(3, "http://a.example/x", z), (1, "http://b.example/x", z), (1, "http://b.example/x", z), (None, None, z), (7, "http://b.example/x", "short"), (8, "line\nbreak", "short"), (9, None, None), (10, "", ""), (11, "http://long.example/", LONG), (12, "http://long.example/", LONG)]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], "page_id long, url string, html string, digest string, first string")
    root = warc.scratch_path(spark, "warc-edges")
    got = warc.read_archives(warc.build_index(warc.write_archives(df, root), f"{root}/index")).collect()
    assert len(got) == len(rows)
    assert {(r.page_id, r.type, r.refers_to) for r in got if r.payload_bytes == 150} == {(1, "response", None), (3, "revisit", 1), (None, "revisit", 1)}
    assert {r.type for r in got if r.payload_bytes < 100} == {"response"}
    assert {(r.page_id, r.type) for r in got if r.payload_bytes == len(LONG)} == {(11, "response"), (12, "revisit")}
    none = warc.write_archives(df.limit(0), f"{root}/none")
    assert none.count() == 0 and warc.read_archives(warc.build_index(none, f"{root}/none/index")).count() == 0


def test_many_of_one_key(spark):
    """A hot source, one fingerprint and one payload for a third of the rows."""
    base = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the very same words over again").otherwise(F.concat_ws(" ", F.sha1(F.col("id").cast("string")), F.md5(F.col("id").cast("string")), F.lit("tail"))).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"), F.lit(1).cast("long").alias("n_chars"))
    assert simhash.dedup(base).count() == 2001
    assert mixing.mix_counts(base).groupBy("source").agg((F.sum("taken") - F.floor(F.first("target"))).alias("d")).filter("d <> 0").count() == 0


def test_rows_without_an_id_have_keys_of_their_own(spark):
    """Equal sizes, no ids: the ranges part the rows, and the cut takes one row in part, not all of them."""
    base = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.md5(F.col("id").cast("string")), F.lit(" x")).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    rows, _ = mixing.mix_plan(base)
    assert rows.select("key").distinct().count() == 1000
    counts = mixing.mix_counts(base)
    assert counts.groupBy("source").agg((F.sum("taken") - F.floor(F.first("target"))).alias("d")).filter("d <> 0").count() == 0
    assert counts.filter("taken % size <> 0").count() <= 2


def test_decontamination_of_short_and_unspaced_items(spark):
    passage = "今天天气很好我们一起去公园散步然后回家吃饭休息"
    items = [(1, "Who was she?"), (2, "forty-two"), (3, passage), (4, "วันนี้อากาศดีมากเราไปเดินเล่นกัน"), (5, "?!"), (6, "吃饭。"), (7, "a b c d")]
    rows = [
        (1, "They asked: who was she, then?"),
        (2, "they asked who was he, she"),
        (3, "It is fortytwo."),
        (4, "It is fortytwofold"),
        (5, "前言。" + passage[:9] + "，" + passage[9:] + "！后记"),
        (6, passage[:5] + "他" + passage[6:15] + passage[16:]),
        (7, passage[:8] + passage[15:]),
        (8, "เขาพูดว่าวันนี้อากาศดีมากเราไปเดินเล่นกันนะ"),
        (9, "a b c"),
        (10, "x a b c d a b c d"),
    ]
    got = {(r.doc_id, r.item_id): (r.edits, r.end_word) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 1), (3, 2), (5, 3), (6, 3), (8, 4), (5, 6), (6, 6), (7, 6), (10, 7)}
    assert got[6, 3][0] == 2 and got[5, 3][0] == 0 and got[10, 7] == (0, 5)
