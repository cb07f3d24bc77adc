"""Files, reports, definitions and small seams over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import word_count
from ..operators import evaluate, questions, search, textcheck
from ..operators.sync import Index
from ..ports import OverlapReranker
from ..scratch import scratch_path
from ..sources import files
from ..sources.definitions import DEFINITIONS, vector_definition
from . import chunks
from . import retrieval as R
from .retrieval import table


def plain_markdown(spark, d):
    """Documents as Markdown, with frontmatter and comments of one and of several lines, made plain again."""
    text = F.concat(F.lit("---\nsource: a\nunit: "), F.col("doc_id").cast("string"), F.lit("\n---\n<!-- page: 1 -->\n"), F.coalesce("text", F.lit("")), F.lit("\n<!-- two\nlines -->end"))
    got = textcheck.plain(text)
    return table(spark, d, "documents").select("doc_id", F.sha2(got, 256).alias("plain_sha256"), F.length(got).cast("long").alias("chars"))


def unit_from_path(spark, d):
    """A unit's name and source, from frontmatter, where there is any, else from the file's name."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    n = k.cast("string")
    front = F.when(k % 4 == 0, F.concat(F.lit('---\nsource: pilot\nunit: "'), n, F.lit('B"\n---\ntext'))).when(k % 4 == 1, F.concat(F.lit("---\nunit: "), n, F.lit("  \nsource: trainer\n---\n"))).otherwise("no frontmatter, unit: 5")
    path = F.when(k % 4 == 3, F.concat(F.lit("a/b/notes-"), n, F.lit(".md"))).otherwise(F.concat(F.lit("a/unit-0"), n, F.lit("A.md")))
    return p.select(k.alias("part"), questions.unit_of(front, path).alias("unit"), questions.source_of(front).alias("source"))


def section_lines(spark, d):
    """Lines of the self-check sections of one source's units."""
    own = table(spark, d, "documents").filter("text is not null").agg(F.min("source")).first()[0]
    found = questions.sections(chunks.units(spark, d), "self_check", own)
    return found.select("unit", F.length("line").cast("long").alias("chars"), word_count(F.col("line")).alias("words")).groupBy("unit").agg(F.count("*").alias("lines"), F.sum("chars").alias("chars"), F.sum("words").alias("words"))


def questions_collected(spark, d):
    """The questions of one source's units, begun by numbers and dashes, in one call."""
    own = table(spark, d, "documents").filter("text is not null").agg(F.min("source")).first()[0]
    found = questions.collected(chunks.units(spark, d), own)
    return found.select("id", "unit", F.col("n").cast("long"), F.sha2("question", 256).alias("question_sha256"))


def _replies(spark, d):
    """A judge's replies by the item's number: good ones, in a fence or not, and wrong ones."""
    i = F.col("item_id")
    yes = F.when(i % 2 == 0, "true").otherwise("false")
    good = F.concat(F.lit('{"faithful": '), yes, F.lit(', "grounded": true, "rationale": "r'), i.cast("string"), F.lit('"}'))
    reply = F.when(i % 7 == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(i % 7 == 1, F.concat(F.lit("Well: "), good)).when(i % 7 == 2, '{"faithful": "true", "grounded": true}').when(i % 7 == 3, '{"faithful": true}').when(i % 7 == 4, F.concat(F.lit('{"faithful": '), yes, F.lit(', "grounded": false, "rationale": 5}'))).otherwise(good)
    return table(spark, d, "benchmark").select("item_id", reply.alias("reply"))


def verdict_parse(spark, d):
    v = evaluate.verdict(F.col("reply"), ("faithful", "grounded"))
    return _replies(spark, d).select("item_id", v["faithful"].alias("faithful"), v["grounded"].alias("grounded"), v["rationale"].alias("rationale"))


def _items_file(spark, d) -> str:
    """The benchmark as an evaluation file, written by Spark as one object."""
    b = table(spark, d, "benchmark")
    cite = F.struct(F.lit("pilot").alias("source"), F.col("item_id").cast("int").alias("unit"), F.lit(3).alias("page"))
    item = F.struct(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("question"), F.when(F.col("item_id") % 4 == 0, "refuse").otherwise("answer").alias("expected_behavior"), F.lit("yes").alias("expected_answer"), F.when(F.col("item_id") % 2 == 0, F.array(cite)).otherwise(F.array().cast("array<struct<source:string,unit:int,page:int>>")).alias("citations"), F.lit("theory").alias("category"), F.array(F.lit("no"), F.lit("yes")).alias("choices"))
    whole = b.agg(F.array_sort(F.collect_list(F.struct("item_id", item.alias("i")))).alias("l")).select(F.to_json(F.struct(F.lit(1).alias("version"), F.transform("l", lambda x: x["i"]).alias("items"))).alias("value"))
    path = scratch_path(spark, "items")
    whole.write.text(path)
    return path


def golden_items(spark, d):
    """An evaluation file read back, its first 25 items."""
    rows = files.first_items(files.read_items(spark, _items_file(spark, d)), 25)
    c = F.try_element_at("citations", F.lit(1))
    return rows.select(F.col("pos").cast("long"), "id", F.sha2("question", 256).alias("question_sha256"), "expected_behavior", "expected_answer", F.size("citations").cast("long").alias("n_citations"), c["source"].alias("source"), c["unit"].alias("unit"), c["page"].cast("long").alias("page"), "category", F.array_join("choices", ";").alias("choices"))


def json_lines(spark, d):
    """Nations as JSON lines, with nulls, read back as text."""
    n = table(spark, d, "nation")
    rows = n.select(F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_name")).alias("name"), F.array(F.col("n_regionkey"), F.lit(7)).alias("keys"))
    path = scratch_path(spark, "lines")
    files.write_json_lines(rows, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def _points(spark, d):
    """Facts of the three steps over the benchmark, with exact means."""
    i = F.col("item_id")
    steps = F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.lit(n).alias("n")) for n, s in enumerate(search.STEPS)]))
    b = table(spark, d, "benchmark").select(F.col("item_id"), steps.alias("s")).select("item_id", "s.*")
    return b.select("step", "item_id", ((i + F.col("n")) % 2).cast("double").alias("recall"), (i % 2 == 0).alias("refusal"), F.when(F.col("n") > 0, i % 2 == 1).alias("faithful"), F.lit(None).cast("boolean").alias("grounded_ok"), F.lit(True).alias("correct"))


def report_json(spark, d):
    return evaluate.report_json(evaluate.curve(_points(spark, d)), 40, 10)


def progress_lines(spark, d):
    rows = _points(spark, d).withColumnRenamed("grounded_ok", "grounded").withColumn("recall", F.when(F.col("item_id") % 5 > 0, F.col("recall")))
    return rows.select(evaluate.progress_line().alias("line"))


def index_definitions(spark, d):
    """Search definitions of every third label's vectors, their length read from the table: new, again, in another order, with the
    next label's number added to the length, without a definition; and the text definition, new and again."""
    index, out = Index(spark, scratch_path(spark, "definitions")), []
    lengths = table(spark, d, "embeddings").filter("label % 3 = 0").groupBy("label").agg(F.max(F.size("embedding")).alias("n")).orderBy("label").collect()  # a row a label
    kind, text = DEFINITIONS["chunks_search"]
    asked = [("new", "chunks_search", kind, text), ("again", "chunks_search", kind, text), ("none", "chunks_search", kind, None)]
    for r in lengths:
        own, turned = vector_definition(r.n), vector_definition(r.n)
        turned["fields"] = turned["fields"][::-1]
        asked += [(step, f"vectors_{r.label}", "vector", x) for step, x in (("new", own), ("again", own), ("turned", turned), ("other", vector_definition(r.n + r.label + 1)))]
    for step, name, kind, definition in asked:
        try:
            outcome = "made" if index.ensure(name, kind, definition) else "kept"
        except ValueError:
            outcome = "refused"
        out.append((step, name, outcome))
    held = index.definitions()
    out += [("length", n, str(x["definition"]["fields"][0]["numDimensions"])) for n, x in held.items() if x["kind"] == "vector"]
    return spark.createDataFrame(out, "step string, name string, outcome string")


def index_lookup(spark, d):
    """Point look-ups in an index that was written as a base and two deltas."""
    index = Index(spark, scratch_path(spark, "lookup"))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.col("doc_id").alias("n"))
    index.write(docs, docs)
    third = docs.filter("n % 3 = 0")
    index.write(third.withColumn("content_hash", F.lit("new")), third)
    index.write(docs.limit(0), docs.filter("n % 5 = 0"))
    asked = docs.filter("n % 2 = 0").select("id").unionAll(docs.select("id").filter("id = 4")).unionAll(spark.createDataFrame([("none",)], "id string"))
    return index.lookup(asked, ["content_hash"])


def rerank_port(spark, d):
    """Whole hybrid retrieval with a reranker behind its port."""
    out = search.retrieve("hybrid_rerank", R._children(spark, d), R._texts(spark, d), R._item_vectors(spark, d), R._texts(spark, d), reranker=OverlapReranker())
    return out.select("query_id", "parent_id", "rank")


def rerank_sql(spark, d):
    """The reranker called in SQL, as a table function over the hybrid channel's parents."""
    items = R._item_vectors(spark, d)
    found = search.retrieve("hybrid", R._children(spark, d), R._texts(spark, d), items, R._texts(spark, d), p=search.CHILDREN)
    found.join(items.select("query_id", F.col("text").alias("_query")), "query_id").createOrReplaceTempView("rerank_candidates")
    spark.udtf.register("rerank_passages", search.rerank_function(OverlapReranker()))
    return spark.sql("SELECT query_id, parent_id, rank FROM rerank_passages(TABLE(rerank_candidates))")


QUERIES = {q.__name__: q for q in (plain_markdown, unit_from_path, section_lines, questions_collected, verdict_parse, golden_items, json_lines, report_json, progress_lines, index_definitions, index_lookup, rerank_port, rerank_sql)}

_WORDS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"
_FACTS = """fa AS (
  SELECT s.step, s.n, item_id, CAST((item_id + s.n) % 2 AS DOUBLE) AS recall, item_id % 2 = 0 AS refusal, CASE WHEN s.n > 0 THEN item_id % 2 = 1 END AS faithful FROM benchmark, (VALUES ('vector', 0), ('hybrid', 1), ('hybrid_rerank', 2)) s(step, n)
)"""

ORACLES = {
    "plain_markdown": "SELECT doc_id, sha256(p) AS plain_sha256, length(p) AS chars FROM (SELECT doc_id, ' ' || chr(10) || coalesce(text, '') || chr(10) || ' end' AS p FROM documents)",
    "unit_from_path": """SELECT p_partkey AS part, CASE p_partkey % 4 WHEN 0 THEN p_partkey || 'B' WHEN 1 THEN p_partkey || '' WHEN 2 THEN p_partkey || 'A' ELSE '0' END AS unit, CASE p_partkey % 4 WHEN 0 THEN 'pilot' WHEN 1 THEN 'trainer' ELSE '' END AS source FROM part""",
    "section_lines": f"""WITH {chunks.LINES}, tn AS (
  SELECT *, CASE WHEN type_mark IS NOT NULL THEN type_mark WHEN starts_with(line, '## ') THEN '' END AS turn FROM cl
), kd AS (SELECT *, last_value(turn IGNORE NULLS) OVER (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS kind FROM tn)
SELECT path AS unit, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars, CAST(sum(len(regexp_extract_all(line, '\\S+'))) AS BIGINT) AS words FROM kd
WHERE kind = 'self_check' AND turn IS NULL AND source = (SELECT min(source) FROM documents WHERE text IS NOT NULL) GROUP BY path""",
    "verdict_parse": f"""SELECT item_id, CASE WHEN item_id % 7 IN (1, 2, 3) THEN false ELSE item_id % 2 = 0 END AS faithful, CASE WHEN item_id % 7 IN (1, 2, 3, 4) THEN false ELSE true END AS grounded,
  CASE WHEN item_id % 7 IN (1, 2, 3) THEN '{evaluate.UNREADABLE}' WHEN item_id % 7 = 4 THEN '' ELSE 'r' || item_id END AS rationale FROM benchmark""",
    "golden_items": """SELECT pos, 'q' || item_id AS id, sha256(text) AS question_sha256, CASE WHEN item_id % 4 = 0 THEN 'refuse' ELSE 'answer' END AS expected_behavior, 'yes' AS expected_answer, CAST(item_id % 2 = 0 AS BIGINT) AS n_citations,
  CASE WHEN item_id % 2 = 0 THEN 'pilot' END AS source, CASE WHEN item_id % 2 = 0 THEN CAST(item_id AS VARCHAR) END AS unit, CASE WHEN item_id % 2 = 0 THEN 3::BIGINT END AS page, 'theory' AS category, 'no;yes' AS choices
FROM (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM benchmark) WHERE pos < 25""",
    "json_lines": """SELECT '{"id":' || n_nationkey || ',"name":' || CASE WHEN n_nationkey % 3 > 0 THEN '"' || n_name || '"' ELSE 'null' END || ',"keys":[' || n_regionkey || ',7]}' AS line FROM nation""",
    "report_json": f"""WITH {_FACTS}, c AS (SELECT step, n, avg(recall) AS recall, avg(refusal::INT) AS refusal, avg(faithful::INT) AS faithful FROM fa GROUP BY step, n)
SELECT '{{"items":40,"k":10,"points":[' || string_agg('{{"step":"' || step || '","recall":' || recall || ',"refusal":' || refusal || ',"faithful":' || coalesce(CAST(faithful AS VARCHAR), 'null') || ',"grounded":null,"correct":1.0}}', ',' ORDER BY n) || ']}}' AS report FROM c""",
    "progress_lines": f"WITH {_FACTS} SELECT step || ' ' || item_id || ' ' || CASE WHEN item_id % 5 > 0 THEN printf('%.2f', recall) ELSE '—' END || CASE WHEN refusal THEN ' ✓' ELSE ' ✗' END || CASE WHEN faithful IS NULL THEN ' —' WHEN faithful THEN ' ✓' ELSE ' ✗' END || ' — ✓' AS line FROM fa",
    "index_definitions": """SELECT * FROM (VALUES ('new', 'chunks_search', 'made'), ('again', 'chunks_search', 'kept'), ('none', 'chunks_search', 'refused')) t(step, name, outcome)
UNION ALL SELECT s.step, 'vectors_' || label, s.outcome FROM (SELECT DISTINCT label FROM embeddings WHERE label % 3 = 0), (VALUES ('new', 'made'), ('again', 'kept'), ('turned', 'kept'), ('other', 'refused')) s(step, outcome)
UNION ALL SELECT 'length', 'vectors_' || label, CAST(max(len(embedding)) AS VARCHAR) FROM embeddings WHERE label % 3 = 0 GROUP BY label""",
    "index_lookup": "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE sha256(coalesce(text, '')) END AS content_hash FROM documents WHERE doc_id % 2 = 0 AND doc_id % 5 <> 0",
    "rerank_port": f"""{R._HYBRID}, ov AS (
  SELECT ex.query_id, ex.parent_id, ex.rank AS was, len(list_intersect({_WORDS.format('iv.text')}, {_WORDS.format('d.text')})) AS overlap FROM ex JOIN documents d ON d.doc_id = ex.parent_id JOIN iv USING (query_id)
), rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, was) AS rank FROM ov) SELECT query_id, parent_id, rank FROM rr WHERE rank <= {R.P}""",
}
_START = questions.START
ORACLES["questions_collected"] = rf"""WITH {chunks.LINES}, ta AS (
  SELECT path, source, pos, line, CASE WHEN type_mark IS NOT NULL THEN type_mark WHEN starts_with(line, '## ') THEN '' END AS turn FROM ln
), tb AS (SELECT *, last_value(turn IGNORE NULLS) OVER (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS kind FROM ta),
tc AS (SELECT path, source, pos, trim(line) AS x FROM tb WHERE kind = 'self_check' AND turn IS NULL AND source = (SELECT min(source) FROM documents WHERE text IS NOT NULL)),
tq AS (SELECT *, regexp_matches(x, '{_START}') AND NOT regexp_matches(x, '^[a-z]\.\s') AS b FROM tc WHERE x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '<!--') AND NOT regexp_matches(x, '^[A-Z]\.\s')),
tr AS (SELECT *, sum(b::INT) OVER (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS q FROM tq),
ts AS (SELECT path, source, q, trim(regexp_replace(string_agg(CASE WHEN b THEN regexp_replace(x, '{_START}', '') ELSE x END, ' ' ORDER BY pos), '\s+', ' ', 'g')) AS question FROM tr WHERE q > 0 GROUP BY ALL),
tn AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY q) AS n FROM ts WHERE question <> '')
SELECT 'self_check-' || source || '-' || path || '-' || CASE WHEN n < 10 THEN '0' || n ELSE '' || n END AS id, path AS unit, n, sha256(question) AS question_sha256 FROM tn"""
ORACLES["rerank_sql"] = ORACLES["rerank_port"]
