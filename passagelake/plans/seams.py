"""Whole seams over documents, embeddings and benchmark: answers, the ablation, filters, query embedding, resumable runs.

An item's query vector is the vector with its id; a vector's parent is the document with half its id. Every document
has two pages. The completer refuses questions of odd length.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import answers, evaluate, questions, search
from ..ports import AgreeingJudge, QuotingCompleter
from ..scratch import scratch_path
from . import retrieval as R
from .retrieval import table


class LetterEmbedder:
    """How often each of a to z stands in a text."""

    def embed(self, texts: list[str], kind: str) -> list[list[float]]:
        return [[float((t or "").lower().count(chr(97 + i))) for i in range(26)] for t in texts]


class ParityCompleter(QuotingCompleter):
    def complete(self, system: str, user: str) -> str:
        if len(user.partition("\n\nQuestion: ")[2]) % 2:
            return json.dumps({"grounded": False})
        return super().complete(system, user)


class FailingCompleter(ParityCompleter):
    """Fails on questions that hold a z, as a service may."""

    def complete(self, system: str, user: str) -> str:
        if "z" in user.partition("\n\nQuestion: ")[2]:
            raise RuntimeError("no reply")
        return super().complete(system, user)


def _parents(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    unit = F.col("doc_id").cast("string")
    return docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("none")).alias("source"), unit.alias("unit"), F.array(F.concat(unit, F.lit("-1")), F.concat(unit, F.lit("-2"))).alias("pages"), F.array(F.lit("About")).alias("heading_path"), F.lit("theory").alias("content_type"), "text")


def _given(spark, d):
    return {"vectors": R._children(spark, d), "texts": R._texts(spark, d), "parents": _parents(spark, d)}


def _flat(out):
    c = F.try_element_at("citations", F.lit(1))
    return out.select("query_id", "grounded", F.sha2("answer", 256).alias("answer_sha256"), F.size("citations").cast("long").alias("n_citations"), c["source"].alias("source"), c["unit"].alias("unit"), c["page"].cast("long").alias("page"))


def answer_seam(spark, d):
    return _flat(answers.ask("hybrid", R._item_vectors(spark, d), completer=ParityCompleter(), **_given(spark, d)))


def _items(spark, d):
    b = table(spark, d, "benchmark")
    return b.select(F.col("item_id"), F.col("text").alias("question"), F.when(F.col("item_id") % 5 == 0, "refuse").otherwise("answer").alias("expected_behavior"), F.lit("").alias("expected_answer"))


def _gold(spark, d):
    """Two items in three ask for the first page of their own vector's parent, others for a page that is not there."""
    docs = _parents(spark, d).select(F.col("id").alias("doc"), "source", "unit")
    return table(spark, d, "benchmark").select("item_id", F.floor(F.col("item_id") / 2).alias("doc"), F.when(F.col("item_id") % 3 == 0, 9).otherwise(1).alias("page")).join(docs, "doc").select("item_id", "source", "unit", "page")


def ablation_seam(spark, d):
    return evaluate.ablation(_items(spark, d), _gold(spark, d), R._item_vectors(spark, d), completer=ParityCompleter(), judge=AgreeingJudge(), **_given(spark, d)).withColumn("pos", F.col("pos").cast("long"))


def knn_token_filter(spark, d):
    """Only children whose content type is one of two, all written in mixed case."""
    kind = F.when(F.col("parent_id") % 2 == 0, "Child").otherwise("PARENT")
    types = F.element_at(F.array(*[F.lit(x) for x in ("Theory", "BRIEFING", "aim")]), (F.col("parent_id") % 3 + 1).cast("int"))
    rows = R._vectors(spark, d).withColumn("kind", kind).withColumn("content_type", types)
    return search.knn(rows, R._asked(spark, d), where=search.token_filter("CHILD", ["theory", "Briefing"]))


def query_embedding(spark, d):
    got = search.query_vectors(R._items(spark, d), LetterEmbedder())
    return got.select("query_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("embedding"))


def resumable_run(spark, d):
    """Items answered over their own vector's parent as the passage, in two calls; the first has a failing service."""
    path = scratch_path(spark, "run")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    passages = items.select(F.col("id").alias("query_id"), F.floor(F.col("id") / 2).alias("doc"), F.lit(1).cast("long").alias("rank")).join(_parents(spark, d).withColumnRenamed("id", "doc"), "doc").withColumnRenamed("doc", "id")
    first = questions.run_batch(items, passages, FailingCompleter(), path).select(F.lit(1).cast("long").alias("call"), "*")
    first = spark.createDataFrame(first.collect(), first.schema)  # one row, as it was after the first call
    return first.unionByName(questions.run_batch(items, passages, ParityCompleter(), path).select(F.lit(2).cast("long").alias("call"), "*"))


QUERIES = {q.__name__: q for q in (answer_seam, ablation_seam, knn_token_filter, query_embedding, resumable_run)}

_DOCS = "pd AS (SELECT doc_id, coalesce(source, 'none') AS source, text FROM documents WHERE text IS NOT NULL)"


def _passages(name: str, ranks: str) -> str:
    return f"""{name} AS (SELECT x.query_id, x.rank, pd.* FROM ({ranks}) x JOIN pd ON pd.doc_id = x.parent_id)"""


_EX = f"WITH {R._ITEMS}, {R._ITEM_VECTORS}, {R._knn_sql('iv', 'vec')}, {R._bm25_sql('iv')}, {R._fuse_sql('vec', 'bm')}, {_DOCS}"
_RANKS = "SELECT query_id, parent_id, row_number() OVER (PARTITION BY query_id ORDER BY best_child, parent_id) AS rank FROM (SELECT h.query_id, e.vec_id // 2 AS parent_id, min(h.rank) AS best_child FROM {hits} h JOIN embeddings e ON e.vec_id = h.id GROUP BY ALL)"


def _step(step: str, hits: str) -> str:
    """The step's passages, as CTEs; the last is p_<step>."""
    ranks = f"SELECT * FROM ({_RANKS.format(hits=hits)}) WHERE rank <= {R.P}"
    if step == "hybrid_rerank":
        over = f"len(list_intersect(list_distinct({R.TOKENS.replace('text', 'iv.text')}), list_distinct({R.TOKENS.replace('text', 'pd.text')})))"
        ranks = f"SELECT * FROM (SELECT query_id, parent_id, row_number() OVER (PARTITION BY query_id ORDER BY {over} DESC, r.rank) AS rank FROM ({_RANKS.format(hits=hits)}) r JOIN pd ON pd.doc_id = r.parent_id JOIN iv USING (query_id)) WHERE rank <= {R.P}"
    return _passages(f"p_{step}", ranks)


def _scored(step: str) -> str:
    return f"""f_{step} AS (
  SELECT '{step}' AS step, iv.query_id AS item_id, CASE WHEN g.item_id IS NOT NULL THEN CASE WHEN g.page = 1 AND bool_or(coalesce(p.doc_id = g.doc, false)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS recall,
    count(p.doc_id) > 0 AND length(iv.text) % 2 = 0 AS ok, iv.query_id % 5 = 0 AS refuse
  FROM iv LEFT JOIN p_{step} p ON p.query_id = iv.query_id LEFT JOIN gold g ON g.item_id = iv.query_id GROUP BY iv.query_id, iv.text, g.item_id, g.page, g.doc
)"""


ORACLES = {
    "answer_seam": f"""{_EX}, {_step('hybrid', 'fused')}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM p_hybrid) WHERE k = 1),
a AS (SELECT iv.query_id, one.source, CAST(one.doc_id AS VARCHAR) AS unit, one.query_id IS NOT NULL AND length(iv.text) % 2 = 0 AS grounded, trim(string_split(regexp_replace(one.text, '^\\s+', ''), chr(10))[1]) AS line FROM iv LEFT JOIN one USING (query_id))
SELECT query_id, grounded, sha256(CASE WHEN grounded THEN line ELSE '{answers.REFUSAL}' END) AS answer_sha256, CAST(grounded::INT AS BIGINT) AS n_citations, CASE WHEN grounded THEN source END AS source, CASE WHEN grounded THEN unit END AS unit, CASE WHEN grounded THEN 1::BIGINT END AS page FROM a""",
    "ablation_seam": f"""{_EX}, {_step('vector', 'vec')}, {_step('hybrid', 'fused')}, {_step('hybrid_rerank', 'fused')},
gold AS (SELECT b.item_id, b.item_id // 2 AS doc, CASE WHEN b.item_id % 3 = 0 THEN 9 ELSE 1 END AS page FROM benchmark b JOIN pd ON pd.doc_id = b.item_id // 2),
{_scored('vector')}, {_scored('hybrid')}, {_scored('hybrid_rerank')}, every AS (SELECT * FROM f_vector UNION ALL SELECT * FROM f_hybrid UNION ALL SELECT * FROM f_hybrid_rerank)
SELECT step, coalesce(avg(recall), 0) AS recall, avg(CASE WHEN refuse THEN NOT ok ELSE ok END::INT::DOUBLE) AS refusal,
  avg(CASE WHEN ok AND NOT refuse THEN 1.0::DOUBLE END) AS faithful, avg(CASE WHEN ok AND NOT refuse THEN 1.0::DOUBLE END) AS grounded, avg(CASE WHEN ok AND NOT refuse THEN 1.0::DOUBLE END) AS correct,
  CASE step WHEN 'vector' THEN 1::BIGINT WHEN 'hybrid' THEN 2::BIGINT ELSE 3::BIGINT END AS pos FROM every GROUP BY step""",
    "knn_token_filter": f"WITH {R._ASKED}, {R._knn_sql('asked', 'hits', 'e.label % 2 = 0 AND e.label % 3 < 2')} SELECT * FROM hits",
    "query_embedding": "SELECT item_id AS query_id, array_to_string(list_transform(range(26), lambda i: CAST(length(text) - length(replace(lower(text), chr(CAST(97 + i AS INTEGER)), '')) AS VARCHAR)), ',') AS embedding FROM benchmark",
    "resumable_run": f"""WITH {_DOCS}, a AS (SELECT b.item_id, length(b.text) % 2 = 0 AND pd.doc_id IS NOT NULL AS ok, b.text LIKE '%z%' AND pd.doc_id IS NOT NULL AS failed FROM benchmark b LEFT JOIN pd ON pd.doc_id = b.item_id // 2)
SELECT 1::BIGINT AS call, count(*) FILTER (WHERE ok AND NOT failed) AS grounded, count(*) FILTER (WHERE NOT ok AND NOT failed) AS refused, count(*) FILTER (WHERE failed) AS failed, count(*) AS total FROM a
UNION ALL SELECT 2, count(*) FILTER (WHERE ok), count(*) FILTER (WHERE NOT ok), 0, count(*) FROM a""",
}
