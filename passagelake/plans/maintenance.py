"""Sync, answer, evaluation, question and consistency queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import answers, evaluate, questions, search, sync, textcheck
from ..ports import HashEmbedder
from ..scratch import scratch_path
from .retrieval import _EXPAND, _asked, _vectors, table

#: Replies of each kind that a reader must tell apart.
REPLIES = [
    '{"grounded": true, "answer": "Yes", "citations": [{"source": "S", "unit": "U", "page": P}]}',
    '```json\n{"grounded": 1, "answer": "Yes", "citations": [{"source": "S", "unit": "U", "page": P}]}\n```',
    '{"grounded": true, "answer": " ", "citations": [{"source": "S", "unit": "U", "page": P}]}',
    '{"grounded": true, "answer": "Yes", "citations": [{"source": "S", "unit": "U", "page": true}]}',
    '{"grounded": true, "answer": "Yes", "citations": [{"source": "S", "unit": "U", "page": 999}]}',
    '{"grounded": true, "answer": "Yes", "citations": []}',
    '{"grounded": false}',
    "not json",
    '[1]',
    '{"grounded": "yes", "answer": "Yes", "citations": [{"source": "S", "unit": "U", "page": P}, {"source": " ", "unit": "U", "page": P}]}',
]


def _snapshot(spark, d) -> DataFrame:
    """The documents as child records in order."""
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("pos"))


def _indexed(spark, d) -> DataFrame:
    """An older state: some rows missing, some with another text, some that are gone since."""
    docs = table(spark, d, "documents")
    held = docs.filter("doc_id % 7 <> 0").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("content_hash"))
    return held.unionByName(docs.filter("doc_id % 11 = 0").select(F.concat(F.lit("gone-"), F.col("doc_id").cast("string")).alias("id"), F.lit("x").alias("content_hash")))


def sync_plan(spark, d):
    return sync.plan_sync(_snapshot(spark, d), _indexed(spark, d)).select("id", "action")


def sync_report(spark, d):
    return sync.report(sync.plan_sync(_snapshot(spark, d), _indexed(spark, d)))


def _records(docs: DataFrame) -> DataFrame:
    child = F.col("doc_id") % 3 != 0
    text = F.col("text")
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.when(child, "child").otherwise("parent").alias("kind"), "source", text, F.sha2("text", 256).alias("content_hash"), F.when(child, text).alias("embedding_text"), F.when(child, F.lit("p")).alias("parent_id"), F.col("doc_id").alias("pos"))


def sync_apply(spark, d):
    """Two ingests, the older state first; the index that is left."""
    index = sync.Index(spark, scratch_path(spark, "index"))
    docs = table(spark, d, "documents").filter("text is not null")
    old = docs.filter("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    gone = docs.filter("doc_id % 11 = 0").withColumn("doc_id", -F.col("doc_id") - 1)
    sync.ingest(_records(old.unionByName(gone)), index, HashEmbedder(8))
    sync.ingest(_records(docs), index, HashEmbedder(8))
    return index.read().select("id", "kind", "content_hash", (F.size("embedding") == 8).alias("embedded"), "parent_id")


def content_hash(spark, d):
    from ..functions.text import content_hash as hashed

    docs = table(spark, d, "documents")
    return docs.select("doc_id", hashed(F.concat(F.col("source"), F.lit(" > "), F.col("lang")), F.col("text")).alias("content_hash"))


def _passages(spark, d) -> DataFrame:
    """A conversation's turns as passages: unit is the role's place, pages the turn and one token of another unit."""
    c = table(spark, d, "conversations")
    unit = F.when(F.col("role") == "user", "1").when(F.col("role") == "assistant", "2A").otherwise("3")
    page = F.concat(unit, F.lit("-"), (F.col("turn") + 1).cast("string"))
    return c.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.lit("guide").alias("source"), unit.alias("unit"), F.array(page, F.lit("9-9")).alias("pages"), F.array("role").alias("heading_path"), F.lit("theory").alias("content_type"), F.coalesce("text", F.lit("")).alias("text"))


def citation_keys(spark, d):
    return answers.citation_keys(_passages(spark, d)).select("query_id", "source", "unit", F.col("page").cast("long"))


def _replies(spark, d) -> DataFrame:
    """A reply for each conversation, of a kind by its id; S, U and P become its first passage's."""
    first = _passages(spark, d).groupBy("query_id").agg(F.min_by("unit", "rank").alias("u"), F.min("rank").alias("r"), F.count("*").alias("n_passages"))
    kind = F.element_at(F.array(*[F.lit(r) for r in REPLIES]), (F.pmod("query_id", F.lit(len(REPLIES))) + 1).cast("int"))
    text = F.replace(F.replace(F.replace(kind, F.lit('"S"'), F.lit('"guide"')), F.lit('"U"'), F.concat(F.lit('"'), "u", F.lit('"'))), F.lit('"page": P'), F.concat(F.lit('"page": '), F.col("r").cast("string")))
    return first.select("query_id", text.alias("completion"), F.when(F.col("query_id") % 13 == 12, 0).otherwise(F.col("n_passages")).alias("n_passages"))


def completion_parse(spark, d):
    v = answers.json_object(F.col("completion"))
    rows = _replies(spark, d).withColumn("v", v)
    return rows.select("query_id", F.col("v").isNotNull().alias("is_object"), F.size(F.coalesce(answers.citations(F.col("v")), F.array().cast(answers.CITATION))).cast("long").alias("n_citations"))


def citation_supported(spark, d):
    read = _replies(spark, d).withColumn("citations", answers.citations(answers.json_object(F.col("completion"))))
    return answers.unsupported(read, answers.citation_keys(_passages(spark, d))).select("query_id", "source", "unit", F.col("page").cast("long"))


def refuse_or_cite(spark, d):
    return answers.decide(_replies(spark, d), _passages(spark, d)).select("query_id", "grounded", "answer", F.size("citations").cast("long").alias("n_citations"))


def answer_prompts(spark, d):
    q = table(spark, d, "conversations").filter("turn = 0").select(F.col("conv_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("question"))
    return answers.prompts(q, _passages(spark, d)).select("query_id", F.sha2("prompt", 256).alias("prompt_sha256"), "n_passages")


def _steps(spark, d) -> DataFrame:
    """Each item's parents by step: the vector channel, the same by id, and the first alone."""
    ranks = search.expand(search.knn(_vectors(spark, d), _asked(spark, d)), _vectors(spark, d))
    base = ranks.select(F.col("query_id").alias("item_id"), "rank", F.col("parent_id").alias("unit"))
    by_id = base.withColumn("rank", F.col("unit") + 1)
    return base.withColumn("step", F.lit("vector")).unionByName(by_id.withColumn("step", F.lit("hybrid"))).unionByName(base.filter("rank = 1").withColumn("step", F.lit("hybrid_rerank")))


def _gold(spark, d) -> DataFrame:
    own = _vectors(spark, d).filter(F.col("id") % 50 == 0)
    return own.filter("id % 150 <> 0").select(F.col("id").alias("item_id"), F.lit("guide").alias("source"), F.col("parent_id").alias("unit"), F.lit(1).alias("page"))


def recall_at_k(spark, d):
    rows = _steps(spark, d).filter("step = 'vector'").select("item_id", "rank", F.lit("guide").alias("source"), "unit", F.lit(1).alias("page"))
    return evaluate.recall_at_k(rows, _gold(spark, d), 3)


def _facts(spark, d) -> DataFrame:
    steps = _steps(spark, d)
    items = _vectors(spark, d).filter(F.col("id") % 50 == 0).select(F.col("id").alias("item_id"), "parent_id")
    keyed = steps.select("step", F.concat_ws(":", "step", F.col("item_id").cast("string")).alias("key"), "item_id", "rank", F.lit("guide").alias("source"), "unit", F.lit(1).alias("page"))
    names = F.explode(F.array(*[F.lit(s) for s in search.STEPS]))
    gold = _gold(spark, d).withColumn("step", names).withColumn("key", F.concat_ws(":", "step", F.col("item_id").cast("string")))
    recall = evaluate.recall_at_k(keyed.drop("item_id").withColumnRenamed("key", "item_id"), gold.drop("item_id").withColumnRenamed("key", "item_id"), 2).withColumnRenamed("item_id", "key")
    every = items.withColumn("step", names).withColumn("key", F.concat_ws(":", "step", F.col("item_id").cast("string"))).join(recall, "key", "left")
    expected = F.when(F.col("item_id") % 100 == 0, "answer").otherwise("refuse")
    grounded = F.col("parent_id") % 2 == 0
    said = F.when(grounded, "Yes").otherwise(answers.REFUSAL)
    cited = F.when(grounded, F.array(F.struct(F.lit("guide").alias("source")))).otherwise(F.array().cast("array<struct<source:string>>"))
    scored = every.withColumn("refusal", evaluate.refusal_score(grounded, said, cited, expected))
    judge = grounded & (expected == "answer")
    return scored.withColumn("faithful", F.when(judge, F.col("parent_id") % 4 == 0)).withColumn("grounded", F.when(judge, F.col("parent_id") > 2)).withColumn("correct", F.when(judge & (F.col("step") != "vector"), F.col("parent_id") < 8))


def refusal_score(spark, d):
    return _facts(spark, d).select("step", "item_id", "refusal")


def ablation_curve(spark, d):
    out = evaluate.curve(_facts(spark, d).withColumnRenamed("grounded", "grounded_ok"))
    return out.select(F.col("pos").cast("long"), "step", *[F.round(m, 9).alias(m) for m in evaluate.METRICS])


def metrics_unpivot(spark, d):
    return evaluate.long_metrics(_facts(spark, d))


def question_mining(spark, d):
    return questions.mine(questions.turn_sections(table(spark, d, "conversations"))).select("id", F.col("n").cast("long"), F.sha2("question", 256).alias("question_sha256"))


def resume_antijoin(spark, d):
    c = table(spark, d, "conversations").filter("role = 'user'").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    done = table(spark, d, "conversations").filter("role = 'user'").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.when(F.col("conv_id") % 3 == 0, F.lit("said")).alias("answer"))
    return questions.remaining(c, done).select("id")


def token_multiset_loss(spark, d):
    """Tokens of documents that their first half has fewer of."""
    docs = table(spark, d, "documents")
    half = docs.select(F.expr("left(text, cast(char_length(text) / 2 as int))").alias("text"))
    return textcheck.lost_tokens(docs.select("text"), half).select("token", "lost")


def running_lines(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    return textcheck.running_lines(docs, least=2, share=0.01).select("doc", F.sha2("line", 256).alias("line_sha256"), "pages")


def fixture_invariants(spark, d):
    return textcheck.breaches(
        {
            "document id repeats": textcheck.repeated(table(spark, d, "documents"), "doc_id"),
            "label without document": table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id", "left_anti").select(F.col("doc_id").cast("string").alias("key")),
            "quality out of domain": table(spark, d, "labels").filter("quality not in (0, 1) or quality is null").select(F.col("doc_id").cast("string").alias("key")),
            "characters differ": table(spark, d, "documents").filter("n_chars <> char_length(text)").select(F.col("doc_id").cast("string").alias("key")),
            "toxic": table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("key")),
        }
    )


QUERIES = {
    "sync_plan": sync_plan,
    "sync_report": sync_report,
    "sync_apply": sync_apply,
    "content_hash": content_hash,
    "citation_keys": citation_keys,
    "completion_parse": completion_parse,
    "citation_supported": citation_supported,
    "refuse_or_cite": refuse_or_cite,
    "answer_prompts": answer_prompts,
    "recall_at_k": recall_at_k,
    "refusal_score": refusal_score,
    "ablation_curve": ablation_curve,
    "metrics_unpivot": metrics_unpivot,
    "question_mining": question_mining,
    "resume_antijoin": resume_antijoin,
    "token_multiset_loss": token_multiset_loss,
    "running_lines": running_lines,
    "fixture_invariants": fixture_invariants,
}

_PLAN = """new AS (SELECT CAST(doc_id AS VARCHAR) AS id, sha256(text) AS fresh FROM documents),
old AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 5 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS held FROM documents WHERE doc_id % 7 <> 0
  UNION ALL SELECT 'gone-' || doc_id, 'x' FROM documents WHERE doc_id % 11 = 0
), plan AS (
  SELECT id, CASE WHEN old.id IS NULL THEN 'insert' WHEN new.id IS NULL THEN 'delete' WHEN fresh IS DISTINCT FROM held THEN 'update' END AS action FROM new FULL JOIN old USING (id)
)"""
_PASS = """pas AS (
  SELECT conv_id AS query_id, turn + 1 AS rank, conv_id || ':' || turn AS id, role, coalesce(text, '') AS text,
    CASE role WHEN 'user' THEN '1' WHEN 'assistant' THEN '2A' ELSE '3' END AS unit FROM conversations
)"""
_quoted = ", ".join("'" + r.replace("'", "''") + "'" for r in REPLIES)
_REPLY = f"""{_PASS}, fi AS (SELECT query_id, arg_min(unit, rank) AS u, min(rank) AS r, count(*) AS n FROM pas GROUP BY 1),
rep AS (
  SELECT query_id, u, r, query_id % {len(REPLIES)} AS kind, CASE WHEN query_id % 13 = 12 THEN 0 ELSE n END AS n_passages,
    trim(regexp_replace(regexp_replace(replace(replace(replace([{_quoted}][query_id % {len(REPLIES)} + 1], '"S"', '"guide"'), '"U"', '"' || u || '"'), '"page": P', '"page": ' || r), '^```[A-Za-z]*\\s*', ''), '\\s*```$', '')) AS t FROM fi
), js AS (SELECT *, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t) = 'OBJECT' THEN CAST(t AS JSON) END END AS v FROM rep),
ci AS (SELECT query_id, unnest(CAST(v->'$.citations' AS JSON[])) AS c FROM js WHERE json_type(v->'$.citations') = 'ARRAY'),
cg AS (
  SELECT query_id, c->>'$.source' AS source, c->>'$.unit' AS unit, TRY_CAST(c->>'$.page' AS BIGINT) AS page,
    coalesce(json_type(c->'$.source') = 'VARCHAR' AND trim(c->>'$.source') <> '' AND json_type(c->'$.unit') <> 'NULL' AND json_type(c->'$.page') IN ('UBIGINT', 'BIGINT') AND TRY_CAST(c->>'$.page' AS BIGINT) >= 1, false) AS good FROM ci
), ok AS (SELECT query_id, bool_and(good) AS good, count(*) AS n FROM cg GROUP BY 1),
uns AS (
  SELECT cg.* FROM cg JOIN ok USING (query_id) WHERE ok.good AND NOT EXISTS (SELECT 1 FROM pas WHERE pas.query_id = cg.query_id AND cg.source = 'guide' AND pas.unit = cg.unit AND pas.rank = cg.page)
)"""
_FACTS = f"""{_EXPAND}, st AS (
  SELECT query_id AS item_id, rank, parent_id AS unit, 'vector' AS step FROM parents UNION ALL SELECT query_id, parent_id + 1, parent_id, 'hybrid' FROM parents
  UNION ALL SELECT query_id, rank, parent_id, 'hybrid_rerank' FROM parents WHERE rank = 1
), it AS (SELECT vec_id AS item_id, CAST(label AS BIGINT) AS parent_id, unnest(['vector', 'hybrid', 'hybrid_rerank']) AS step FROM embeddings WHERE vec_id % 50 = 0),
fa AS (
  SELECT it.step, it.item_id, CASE WHEN it.item_id % 150 <> 0 THEN CASE WHEN EXISTS (SELECT 1 FROM st WHERE st.step = it.step AND st.item_id = it.item_id AND st.unit = it.parent_id AND st.rank <= 2) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS recall,
    CASE WHEN it.item_id % 100 = 0 THEN parent_id % 2 = 0 ELSE parent_id % 2 <> 0 END AS refusal,
    CASE WHEN parent_id % 2 = 0 AND it.item_id % 100 = 0 THEN parent_id % 4 = 0 END AS faithful,
    CASE WHEN parent_id % 2 = 0 AND it.item_id % 100 = 0 THEN parent_id > 2 END AS grounded,
    CASE WHEN parent_id % 2 = 0 AND it.item_id % 100 = 0 AND it.step <> 'vector' THEN parent_id < 8 END AS correct FROM it
)"""
_TOK = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: length(x) > 2)"

ORACLES = {
    "sync_plan": f"WITH {_PLAN} SELECT * FROM plan WHERE action IS NOT NULL",
    "sync_report": f"WITH {_PLAN} SELECT count(*) FILTER (WHERE action = 'insert') AS inserted, count(*) FILTER (WHERE action = 'update') AS updated, count(*) FILTER (WHERE action = 'delete') AS deleted FROM plan",
    "sync_apply": "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 <> 0 THEN 'child' ELSE 'parent' END AS kind, sha256(text) AS content_hash, CASE WHEN doc_id % 3 <> 0 THEN true END AS embedded, CASE WHEN doc_id % 3 <> 0 THEN 'p' END AS parent_id FROM documents WHERE text IS NOT NULL",
    "content_hash": "SELECT doc_id, sha256(source || ' > ' || lang || chr(10) || chr(10) || text) AS content_hash FROM documents",
    "citation_keys": f"WITH {_PASS} SELECT DISTINCT query_id, 'guide' AS source, unit, rank AS page FROM pas",
    "completion_parse": f"WITH {_REPLY} SELECT js.query_id, v IS NOT NULL AS is_object, CASE WHEN ok.good THEN ok.n ELSE 0 END AS n_citations FROM js LEFT JOIN ok USING (query_id)",
    "citation_supported": f"WITH {_REPLY} SELECT query_id, source, unit, page FROM uns",
    "refuse_or_cite": f"""WITH {_REPLY}, de AS (
  SELECT js.query_id, n_passages > 0 AND coalesce((v->'$.grounded') NOT IN ('false', 'null', '0', '""'), false) AND coalesce(trim(v->>'$.answer') <> '', false) AND coalesce(ok.good, false) AND js.query_id NOT IN (SELECT query_id FROM uns) AS grounded, v, ok.n
  FROM js LEFT JOIN ok USING (query_id))
SELECT query_id, grounded, CASE WHEN grounded THEN trim(v->>'$.answer') ELSE '{answers.REFUSAL}' END AS answer, CASE WHEN grounded THEN n ELSE 0 END AS n_citations FROM de""",
    "answer_prompts": f"""WITH {_PASS}, bk AS (
  SELECT query_id, string_agg('[' || rank || '] id=' || id || ' source=guide unit=' || unit || ' pages=[' || unit || '-' || rank || ', 9-9] heading=' || role || ' content_type=theory' || chr(10) || CASE WHEN trim(text) = '' THEN '(none)' ELSE text END, chr(10) || chr(10) ORDER BY rank) AS b, count(*) AS n FROM pas GROUP BY 1)
SELECT c.conv_id AS query_id, sha256('Passages:' || chr(10) || bk.b || chr(10) || chr(10) || 'Question: ' || coalesce(c.text, '')) AS prompt_sha256, bk.n AS n_passages FROM conversations c JOIN bk ON bk.query_id = c.conv_id WHERE c.turn = 0""",
    "recall_at_k": f"{_EXPAND}, g AS (SELECT vec_id AS item_id, label FROM embeddings WHERE vec_id % 50 = 0 AND vec_id % 150 <> 0) SELECT item_id, CASE WHEN EXISTS (SELECT 1 FROM parents p WHERE p.query_id = g.item_id AND p.parent_id = g.label AND p.rank <= 3) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recall FROM g",
    "refusal_score": f"{_FACTS} SELECT step, item_id, refusal FROM fa",
    "ablation_curve": f"{_FACTS} SELECT CAST(list_position(['vector', 'hybrid', 'hybrid_rerank'], step) AS BIGINT) AS pos, step, round(coalesce(avg(recall), 0), 9) AS recall, round(avg(refusal::INT), 9) AS refusal, round(avg(faithful::INT), 9) AS faithful, round(avg(grounded::INT), 9) AS grounded, round(avg(correct::INT), 9) AS correct FROM fa GROUP BY step",
    "metrics_unpivot": f"{_FACTS}, wide AS (SELECT step, item_id, recall, refusal::INT::DOUBLE AS refusal, faithful::INT::DOUBLE AS faithful, grounded::INT::DOUBLE AS grounded, correct::INT::DOUBLE AS correct FROM fa) SELECT * FROM (UNPIVOT wide ON recall, refusal, faithful, grounded, correct INTO NAME metric VALUE value)",
    "resume_antijoin": "SELECT conv_id || '-' || turn AS id FROM conversations WHERE role = 'user' AND conv_id % 3 <> 0",
    "question_mining": r"""WITH l AS (
  SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS j FROM conversations WHERE role = 'user'
), g AS (
  SELECT conv_id, turn, sum((trim(line) <> '' AND j = 1)::INT) OVER (PARTITION BY conv_id ORDER BY turn, j) AS q, turn * 100000 + j AS pos, trim(line) AS line FROM l
), t AS (
  SELECT conv_id, q, trim(regexp_replace(string_agg(line, ' ' ORDER BY pos), '\s+', ' ', 'g')) AS question FROM g WHERE line <> '' AND q > 0 GROUP BY ALL
)
SELECT 'self_check-conversation-' || conv_id || '-' || CASE WHEN n < 10 THEN '0' || n ELSE '' || n END AS id, n, sha256(question) AS question_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY q) AS n FROM t)""",
    "token_multiset_loss": f"""WITH a AS (SELECT unnest({_TOK.format('text')}) AS token FROM documents), b AS (SELECT unnest({_TOK.format('left(text, CAST(floor(length(text) / 2) AS INT))')}) AS token FROM documents),
x AS (SELECT token, count(*) AS n FROM a GROUP BY 1), y AS (SELECT token, count(*) AS m FROM b GROUP BY 1)
SELECT token, n - coalesce(m, 0) AS lost FROM x LEFT JOIN y USING (token) WHERE n > coalesce(m, 0)""",
    "running_lines": r"""WITH l AS (SELECT DISTINCT source AS doc, doc_id AS page, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), n AS (SELECT source AS doc, count(DISTINCT doc_id) AS many FROM documents GROUP BY 1)
SELECT doc, sha256(line) AS line_sha256, count(*) AS pages FROM l JOIN n USING (doc) WHERE line <> '' AND many >= 3 GROUP BY doc, line, many HAVING count(*) >= greatest(2, round_even(0.01 * many, 0))""",
    "fixture_invariants": """SELECT 'toxic' AS rule, CAST(doc_id AS VARCHAR) AS key FROM labels WHERE toxic = 1
UNION ALL SELECT 'characters differ', CAST(doc_id AS VARCHAR) FROM documents WHERE n_chars <> length(text)
UNION ALL SELECT 'label without document', CAST(doc_id AS VARCHAR) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'quality out of domain', CAST(doc_id AS VARCHAR) FROM labels WHERE quality NOT IN (0, 1) OR quality IS NULL
UNION ALL SELECT 'document id repeats', CAST(doc_id AS VARCHAR) FROM documents GROUP BY doc_id HAVING count(*) > 1""",
}
