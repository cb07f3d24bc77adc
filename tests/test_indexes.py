"""Written indexes: pruned reads, segments and tombstones, merges, failed writes; approximate kNN's recall."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagelake.operators import search, textindex
from passagelake.operators.textindex import TextIndex
from passagelake.operators.vectorindex import VectorIndex
from passagelake.scratch import freed, scratch_path

WORDS = [f"w{i}" for i in range(300)]


def corpus(spark, n=1200, seed=0):
    r = np.random.default_rng(seed)
    rows = [(f"d{i:05d}", " ".join(WORDS[min(299, int(x))] for x in r.exponential(30, r.integers(1, 60)))) for i in range(n)]
    return spark.createDataFrame(rows + [("none", None), ("empty", "")], "id string, text string")


def hits(df):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())


def close(a, b):
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert np.allclose([x[3] for x in a], [x[3] for x in b], atol=2e-6)


def files_read(df):
    """How many files the scans of a plan without exchanges have read, by their metrics."""
    df.collect()
    leaves, total = df._jdf.queryExecution().executedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        total += leaves.apply(i).metrics().apply("numFiles").value()
    return total


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "w1 w40 w7"), (2, "w250 W250 w299"), (3, "nothing here"), (4, "w0"), (5, None), (6, "")], "query_id long, text string")


def test_bm25_index_is_a_full_scan(spark, queries):
    docs = corpus(spark)
    index = TextIndex(spark, scratch_path(spark, "t"))
    index.write(docs)
    for n in (1, 10, 70):
        close(hits(index.search(queries, n)), hits(search.bm25(docs, queries, n)))
    some = docs.filter(F.col("id") > "d00600").select("id")
    got = {r.id for r in index.search(queries, 10, some).collect()}
    assert got and got <= {r.id for r in some.collect()}
    assert index.search(queries.limit(0)).count() == 0


def test_bm25_reads_its_terms_folders_and_best_windows(spark):
    index = TextIndex(spark, scratch_path(spark, "t"))
    index.write(corpus(spark))
    one = spark.createDataFrame([(1, "w90")], "query_id long, text string")
    part = index.query_terms(one).first().part
    assert files_read(index.read("blocks", F.col("part").isin([part]))) == 1
    assert files_read(index.read("blocks")) > 20
    assert index.search(one).count() > 0


def test_segments_and_tombstones(spark, queries):
    docs = corpus(spark)
    index = TextIndex(spark, scratch_path(spark, "t"))
    index.write(docs)
    base = set(index.read("blocks").inputFiles())
    changed = docs.filter("id like '%3'").withColumn("text", F.concat("text", F.lit(" w250 w1 w1")))
    gone = docs.filter("id like '%7'").select("id")
    index.write(changed, gone)
    index.write(spark.createDataFrame([("new", "w250 w299"), ("d00013", "w299 w250 w7")], "id string, text string"), spark.createDataFrame([("d00023",), ("absent",)], "id string"))
    assert base <= set(index.read("blocks").inputFiles())  # nothing was rewritten
    ids = changed.select("id").union(gone)
    now = docs.join(ids, "id", "left_anti").union(changed.filter("id not in ('d00013', 'd00023')")).union(spark.createDataFrame([("new", "w250 w299"), ("d00013", "w299 w250 w7")], "id string, text string"))
    want = hits(search.bm25(now, queries, 70))
    close(hits(index.search(queries, 70)), want)
    index.merge([r.segment for r in index.live()][1:])
    assert len(index.live()) == 2 and index.read("dead").count() > 0
    close(hits(index.search(queries, 70)), want)
    index.merge([r.segment for r in index.live()])
    assert len(index.live()) == 1 and index.read("dead").count() == 0
    close(hits(index.search(queries, 70)), want)
    assert {r.id for r in index.documents().collect()} == {r.id for r in now.filter("text is not null").collect()}


def test_a_failed_write_leaves_the_version(spark, queries):
    docs = corpus(spark, 50)
    index = TextIndex(spark, scratch_path(spark, "t"))
    index.write(docs)
    want = hits(index.search(queries))
    bad = docs.withColumn("text", F.when(F.col("id") > "d00030", F.raise_error(F.lit("lost")).cast("string")).otherwise("x"))
    with pytest.raises(Exception, match="lost"):
        index.write(bad)
    assert hits(index.search(queries)) == want
    index.write(docs.limit(0), docs.select("id"))
    assert index.search(queries).count() == 0


def clustered(spark, n=4000, d=16, groups=40, seed=1):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(groups, d)) * 4
    rows = [(i, (centers[i % groups] + r.normal(size=d)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows + [(-1, None), (-2, [0.0] * d), (-3, [1.0]), (-4, [float("nan")] + [1.0] * (d - 1))], "id long, embedding array<double>")


def test_ivf_recall_and_pruned_scan(spark):
    vectors = clustered(spark)
    asked = vectors.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    index = VectorIndex(spark, scratch_path(spark, "v"))
    index.train(vectors, n=10)
    index.write(vectors)
    _, probes = index.centroids()
    exact = {(r.query_id, r.id): r.score for r in search.knn(vectors, asked, 10).collect()}
    found = {(r.query_id, r.id): r.score for r in index.search(asked, 10).collect()}
    assert len(exact.keys() & found.keys()) >= 0.9 * len(exact)
    assert all(abs(exact[k] - found[k]) < 2e-6 for k in exact.keys() & found.keys())
    centers, _ = index.centroids()
    assert probes < len(centers) / 4
    assert files_read(index.read("lists", F.col("list").isin([0, 1]))) == 2 < files_read(index.read("lists"))
    none = vectors.limit(0).select(F.col("id").alias("query_id"), "embedding")
    assert index.search(none, 10).count() == 0


def test_ivf_is_sure_of_each_query(spark):
    """Centroids of clustered vectors, rows without structure: what was measured in training does not hold for them."""
    r = np.random.default_rng(5)
    index = VectorIndex(spark, scratch_path(spark, "v"))
    index.train(clustered(spark), n=10)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(3000, 16)))], "id long, embedding array<double>")
    index.write(rows.filter("id % 2 = 0"))
    index.write(rows.filter("id % 2 = 1"))
    asked = rows.filter("id % 60 = 0").select(F.col("id").alias("query_id"), "embedding")
    exact, found = ({(q, i) for q, _, i, _ in hits(df)} for df in (search.knn(rows, asked, 10), index.search(asked, 10)))
    assert len(found) == len(exact)
    for q in {q for q, _ in exact}:
        assert len([x for x in exact & found if x[0] == q]) >= 9


def test_ivf_segments(spark):
    vectors = clustered(spark, 600)
    index = VectorIndex(spark, scratch_path(spark, "v"))
    index.train(vectors, lists=8)
    index.write(vectors.filter("id < 500"))
    turned = vectors.filter("id % 5 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    index.write(turned, vectors.filter("id % 7 = 3 and id % 5 <> 0").select("id"))
    now = vectors.filter("id < 500 and id % 5 <> 0 and id % 7 <> 3").union(turned)
    asked = vectors.filter("id % 50 = 1").select(F.col("id").alias("query_id"), "embedding")
    want = hits(search.knn(now, asked, 20))
    close(hits(index.search(asked, 20, probes=8)), want)
    index.merge([r.segment for r in index.live()])
    close(hits(index.search(asked, 20, probes=8)), want)
    few = now.filter("id % 3 = 0").select("id")
    close(hits(index.search(asked, 20, few, probes=8)), hits(search.knn(now.filter("id % 3 = 0"), asked, 20)))


def test_untrained_on_nothing(spark):
    none = clustered(spark, 10).limit(0)
    index = VectorIndex(spark, scratch_path(spark, "v"))
    index.train(none)
    index.write(none)
    assert index.search(none.select(F.col("id").alias("query_id"), "embedding")).count() == 0


def test_merged_segments_go_after_the_next_commit(spark, queries):
    docs = corpus(spark, 300)
    index = TextIndex(spark, scratch_path(spark, "t"))
    for i in range(2):
        index.write(docs.filter(F.crc32(F.col("id").cast("binary")) % 2 == i))
    want, before = hits(search.bm25(docs, queries, 70)), index.search(queries, 70)
    index.merge([1, 2])
    close(hits(before), want)  # the version before stays readable
    assert index._segments() == [1, 2, 3]
    index.write(docs.limit(0), docs.filter("id = 'd00007'").select("id"))
    assert index._segments() == [3, 4] and index._numbers("manifests") == [3, 4]
    close(hits(index.search(queries, 70)), hits(search.bm25(docs.filter("id <> 'd00007'"), queries, 70)))


def test_blocks_are_dealt_packed():
    """Batches that part a window, several shares: each posting comes back once, in the block of its term and window."""
    r = np.random.default_rng(2)
    rows = sorted((int(r.integers(0, 6)), f"d{i:03d}", int(r.integers(1, 90)), {f"w{x}é": int(r.integers(1, 1 << 20)) for x in r.integers(0, 40, r.integers(0, 20))}) for i in range(300))
    table = pa.table({"id": [x[1] for x in rows], "window": pa.array([x[0] for x in rows], pa.int32()), "length": pa.array([x[2] for x in rows], pa.int32()), "terms": pa.array([list(x[3]) for x in rows], pa.list_(pa.string())), "counts": pa.array([list(x[3].values()) for x in rows], pa.list_(pa.int32()))})
    packed = list(textindex._packed_blocks(iter(table.to_batches(max_chunksize=70)), 64))
    assert {b.num_rows for b in packed} == {1}
    blocks = [b for x in textindex._blocks(iter(packed)) for b in x.to_pylist()]
    assert len({(b["term"], b["window"]) for b in blocks}) == len(blocks)
    assert all(b["part"] == zlib.crc32(b["term"].encode()) % textindex.PARTS and b["n"] == len(b["ids"]) and b["most"] == max(b["tfs"]) and b["least"] == min(b["lengths"]) and b["ids"] == sorted(b["ids"]) for b in blocks)
    got = sorted((b["window"], i, length, b["term"], tf) for b in blocks for i, tf, length in zip(b["ids"], b["tfs"], b["lengths"]))
    assert got == sorted((w, i, n, t, tf) for w, i, n, terms in rows for t, tf in terms.items())


def test_freed_shuffles(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    with pytest.raises(ValueError), freed(spark):
        assert spark.conf.get(key) == "true"
        raise ValueError
    assert spark.conf.get(key) == was == "false"


def test_a_folder_holds_its_windows_whole(spark):
    for many in (0, 1, 257, 8192, 8193, 300_000):
        n = textindex._windows(many)
        assert n * textindex.WINDOW >= many and (n % textindex.BUCKETS == 0 or textindex.BUCKETS % n == 0)
    index = TextIndex(spark, scratch_path(spark, "t"))
    index.write(spark.range(9000).select("id", F.concat(F.lit("w"), F.col("id") % 7).alias("text")))
    assert index.read("documents").groupBy("window").agg(F.count_distinct("bucket").alias("n")).filter("n > 1").count() == 0
    assert index.read("blocks").agg(F.sum("n")).first()[0] == 9000
