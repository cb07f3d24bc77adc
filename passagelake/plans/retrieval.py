"""Retrieval queries over embeddings, documents and benchmark, with their SQL.

Vectors are asked by every row whose id is divisible by 50; texts by every benchmark item. A vector's
label stands for its parent, as an id, and for its content type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SINGLE, TOKEN, tokens
from ..operators import search

N, P = search.CHILDREN, search.PARENTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("long").alias("parent_id"))


def _asked(spark, d):
    return _vectors(spark, d).filter(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), "embedding")


def _texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def knn_cosine_topk(spark, d):
    return search.knn(_vectors(spark, d), _asked(spark, d))


def knn_filtered(spark, d):
    return search.knn(_vectors(spark, d), _asked(spark, d), where=F.col("parent_id") < 7)


def expand_parents(spark, d):
    return search.expand(search.knn(_vectors(spark, d), _asked(spark, d)), _vectors(spark, d), P)


def _parents(spark, d):
    return _vectors(spark, d).groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"), F.min("id").alias("first_child"))


def parent_fetch(spark, d):
    return search.fetch(expand_parents(spark, d), _parents(spark, d).filter("id <> 3"))


def tokenize_jargon(spark, d):
    t = tokens(F.col("text"))
    return _texts(spark, d).select(F.col("id").alias("doc_id"), F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"), F.sha2(F.array_join(t, " "), 256).alias("tokens_sha256"))


def tokenize_unspaced(spark, d):
    """Words of texts in which some letters are ideographs, hiragana or katakana: the first two stand alone, the third runs on."""
    mixed = _texts(spark, d).withColumn("text", F.translate("text", "aeou", "語あカー"))
    t = tokens(F.col("text"))
    return mixed.select(F.col("id").alias("doc_id"), F.size(t).cast("long").alias("n_tokens"), F.sha2(F.array_join(t, " "), 256).alias("tokens_sha256"))


def term_stats(spark, d):
    return search.term_statistics(_texts(spark, d))


def bm25_topk(spark, d):
    return search.bm25(_texts(spark, d), _items(spark, d))


def _item_vectors(spark, d):
    """An item's query vector is the vector with its id."""
    items = _items(spark, d).select("query_id", "text")
    return items.join(_vectors(spark, d).select(F.col("id").alias("query_id"), "embedding"), "query_id")


def rrf_fusion(spark, d):
    return search.fuse(search.knn(_vectors(spark, d), _item_vectors(spark, d).select("query_id", "embedding")), search.bm25(_texts(spark, d), _items(spark, d)))


def _source_parents(spark, d):
    """Documents as parents of the vectors with their ids, for whole retrieval steps."""
    return _texts(spark, d)


def _children(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.floor(F.col("vec_id") / 2).alias("parent_id"))


def _step(step):
    def run(spark, d):
        out = search.retrieve(step, _children(spark, d), _texts(spark, d), _item_vectors(spark, d), _source_parents(spark, d))
        return out.select("query_id", "parent_id", "best_child", "rank", F.sha2("text", 256).alias("text_sha256"))

    return run


QUERIES = {
    "knn_cosine_topk": knn_cosine_topk,
    "knn_filtered": knn_filtered,
    "expand_parents": expand_parents,
    "parent_fetch": parent_fetch,
    "tokenize_jargon": tokenize_jargon,
    "tokenize_unspaced": tokenize_unspaced,
    "term_stats": term_stats,
    "bm25_topk": bm25_topk,
    "rrf_fusion": rrf_fusion,
    "vector_retrieve": _step("vector"),
    "hybrid_retrieve": _step("hybrid"),
    "hybrid_rerank": _step("hybrid_rerank"),
}

TOKENS = f"regexp_extract_all(lower(text), '{TOKEN.replace(chr(39), 2 * chr(39))}')"


def _knn_sql(queries: str, name: str, where: str = "true") -> str:
    return f"""{name}_s AS (
  SELECT q.query_id, e.vec_id AS id, round(list_cosine_similarity(q.qe, e.embedding::DOUBLE[]), 6) + 0.0 AS score
  FROM {queries} q, embeddings e WHERE {where}
), {name} AS (
  SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_s) WHERE rank <= {N}
)"""


_ASKED = "asked AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 50 = 0)"
_ITEM_VECTORS = "iv AS (SELECT b.item_id AS query_id, b.text, e.embedding::DOUBLE[] AS qe FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)"
_KNN = f"WITH {_ASKED}, {_knn_sql('asked', 'hits')}"
_EXPAND = f"""{_KNN}, best AS (
  SELECT h.query_id, CAST(e.label AS BIGINT) AS parent_id, min(h.rank) AS best_child FROM hits h JOIN embeddings e ON e.vec_id = h.id GROUP BY ALL
), parents AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_child, parent_id) AS rank FROM best
)"""


def _bm25_sql(source: str) -> str:
    return f"""tok AS (SELECT doc_id AS id, unnest({TOKENS}) AS term FROM documents WHERE text IS NOT NULL),
dl AS (SELECT doc_id AS id, len({TOKENS}) AS n FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS many, sum(n) / count(*) AS mean FROM dl),
qt AS (SELECT DISTINCT query_id, unnest({TOKENS}) AS term FROM {source}),
tf AS (SELECT id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bs AS (
  SELECT qt.query_id, tf.id, round(sum(ln(1 + (st.many - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * dl.n / st.mean))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (id), st GROUP BY ALL
),
bm AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bs) WHERE rank <= {N})"""


def _fuse_sql(a: str, b: str) -> str:
    return f"""fs AS (
  SELECT query_id, id, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS score
  FROM {a} a FULL JOIN {b} b USING (query_id, id)
), fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fs) WHERE rank <= {N})"""


_ITEMS = "items AS (SELECT item_id AS query_id, text FROM benchmark)"


def _step_sql(hits: str) -> str:
    return f"""best AS (SELECT h.query_id, e.vec_id // 2 AS parent_id, min(h.rank) AS best_child FROM {hits} h JOIN embeddings e ON e.vec_id = h.id GROUP BY ALL),
ex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_child, parent_id) AS rank FROM best)"""


_STEP_OUT = "SELECT ex.query_id, ex.parent_id, ex.best_child, ex.rank, sha256(d.text) AS text_sha256 FROM ex JOIN documents d ON d.doc_id = ex.parent_id WHERE ex.rank <= 10"
_HYBRID = f"WITH {_ITEMS}, {_ITEM_VECTORS}, {_knn_sql('iv', 'vec')}, {_bm25_sql('iv')}, {_fuse_sql('vec', 'bm')}, {_step_sql('fused')}"

ORACLES = {
    "knn_cosine_topk": f"{_KNN} SELECT * FROM hits",
    "knn_filtered": f"WITH {_ASKED}, {_knn_sql('asked', 'hits', 'e.label < 7')} SELECT * FROM hits",
    "expand_parents": f"{_EXPAND} SELECT * FROM parents WHERE rank <= {P}",
    "parent_fetch": f"""{_EXPAND}, dim AS (SELECT CAST(label AS BIGINT) AS parent_id, count(*) AS children, min(vec_id) AS first_child FROM embeddings WHERE label <> 3 GROUP BY ALL)
SELECT p.*, d.children, d.first_child FROM parents p JOIN dim d USING (parent_id) WHERE p.rank <= {P}""",
    "tokenize_jargon": f"SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({TOKENS})) AS BIGINT) AS n_terms, sha256(array_to_string({TOKENS}, ' ')) AS tokens_sha256 FROM documents",
    "tokenize_unspaced": f"""WITH m AS (SELECT doc_id, regexp_replace(translate(text, 'aeou', '語あカー'), '([{SINGLE}])', ' \\1 ', 'g') AS text FROM documents)
SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS n_tokens, sha256(array_to_string({TOKENS}, ' ')) AS tokens_sha256 FROM m""",
    "term_stats": f"WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS tf FROM c GROUP BY term",
    "bm25_topk": f"WITH {_ITEMS}, {_bm25_sql('items')} SELECT * FROM bm",
    "rrf_fusion": f"WITH {_ITEMS}, {_ITEM_VECTORS}, {_knn_sql('iv', 'vec')}, {_bm25_sql('items')}, {_fuse_sql('vec', 'bm')} SELECT * FROM fused",
    "vector_retrieve": f"WITH {_ITEM_VECTORS}, {_knn_sql('iv', 'vec')}, {_step_sql('vec')} {_STEP_OUT}",
    "hybrid_retrieve": f"{_HYBRID} {_STEP_OUT}",
    "hybrid_rerank": f"""{_HYBRID}, ov AS (
  SELECT ex.query_id, ex.parent_id, ex.best_child, ex.rank AS was, sha256(d.text) AS text_sha256,
         len(list_intersect(list_distinct({TOKENS.replace('text', 'iv.text')}), list_distinct({TOKENS.replace('text', 'd.text')}))) AS overlap
  FROM ex JOIN documents d ON d.doc_id = ex.parent_id JOIN iv USING (query_id)
), rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, was) AS rank FROM ov)
SELECT query_id, parent_id, best_child, rank, text_sha256 FROM rr WHERE rank <= 10""",
}
