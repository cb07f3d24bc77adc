"""The pipeline's stages, each on what its predecessor kept."""

from pyspark.sql import functions as F

import corpus_pipeline
from passagelake.llm import decontaminate, mixing

FOLDER = "/root/testdata/sf0.001"


def kept(docs):
    """The smallest id of each group of texts that five-word shingles' similarities of 0.8 or more link."""
    ids, sets = docs.doc_id.tolist(), []
    for t in docs.text:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    like = lambda a, b: not a and not b or len(a & b) >= 0.8 * len(a | b)
    links = [(i, j) for i in range(len(ids)) for j in range(i) if like(sets[i], sets[j])]
    label = list(ids)
    while True:
        was = list(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
        if label == was:
            return set(label)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, FOLDER)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before.toPandas(), docs.toPandas()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas().set_index("doc_id").quality
    before, after = seen["quality"]
    gone = set(before.doc_id) - set(after.doc_id)
    known = [d for d in before.doc_id if d in labels.index]
    assert sum((d in gone) == (labels[d] == 0) for d in known) >= 0.9 * len(known)
    before, after = seen["near_duplicates"]
    assert sorted(after.doc_id) == sorted(kept(before))
    before, after = seen["decontamination"]
    items = [" ".join(t.split()) for t in spark.read.parquet(f"{FOLDER}/benchmark.parquet").toPandas().text]
    held = {d for d, t in zip(before.doc_id, before.text) if any(i in " ".join(t.split()) for i in items)}
    assert held and set(before.doc_id) - set(after.doc_id) >= held
    assert {r.doc_id for r in decontaminate.find_leaks(spark.createDataFrame(before), spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()} == set(before.doc_id) - set(after.doc_id)
    before, after = seen["mixing"]
    taken = {r.doc_id: r.taken for r in mixing.mix_counts(spark.createDataFrame(before)).collect()}
    size = lambda t: len(t.split()) if t else 0
    assert after.assign(w=after.text.map(size)).groupby("doc_id").w.sum().to_dict() == {d: n for d, n in taken.items() if n}
    before, after = seen["tokens"]
    assert len(after) == len(before) and after.n_tokens.sum() == (after.start + after.n_tokens).max()


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


ODD = [
    (None, None, None, None, None, "x", 0.5, None),
    (None, None, None, None, None, "x", 0.5, None),
    (1_000_001, "", "en", "src0", 0, "x", 0.5, "a"),
    (1_000_002, " \t\n", "en", None, 3, None, 0.5, "b"),
    (1_000_003, "a few plain words that stand here for no other reason than to be read", "en", "src1", 70, "x", 0.5, "c"),
    (1_000_003, "a few plain words that stand here for no other reason than to be read", "en", "src1", 70, "x", 0.5, "c"),
    (None, "another text without an id, of the same kind as all the other texts here", None, "src2", None, "x", None, "d"),
    (1_000_004, " ".join(f"word{i % 997} of number {i}" for i in range(20_000)), "en", "src2", 400_000, "x", 0.5, "e"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score double, label string"


def test_stages_on_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("*", "'k' as key", "1.5 as score", "lang as label")
    docs = docs.unionByName(spark.createDataFrame(ODD, SCHEMA).withColumn("score", F.col("score").cast("decimal(2,1)")))
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        alone = stage(spark, docs, FOLDER)
        alone.write.parquet(f"{tmp_path}/{name}")
        seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "tokens":
            assert seen[name].columns == columns
    wordless = "text is null or not text rlike '[^ \\t\\n]'"
    near = seen["near_duplicates"]
    assert near.filter(wordless).count() == 1 and near.filter("doc_id = 1000003").count() == 1 and near.filter("doc_id = 1000004").count() == 1
    assert seen["decontamination"].filter(wordless).count() == docs.filter(wordless).count()
    assert seen["decontamination"].filter("doc_id >= 1000000 or doc_id is null").count() == len(ODD)
    long = docs.filter("doc_id = 1000004").first().text
    assert {r.text for r in near.filter("doc_id = 1000004").collect()} == {long}
    tokens = seen["tokens"]
    assert tokens.count() == docs.count() and tokens.filter("doc_id = 1000001").first().n_tokens == 1
    assert tokens.agg(F.sum("n_tokens")).first()[0] == tokens.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0]


def test_stages_on_an_empty_table(spark):
    none = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, FOLDER).count() == 0, name
