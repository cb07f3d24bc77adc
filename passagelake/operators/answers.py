"""Refuse-or-cite answers: prompts, strict reading of completions, citation checks, the decision."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialize
from .search import retrieve

#: The answer that stands for every refusal.
REFUSAL = "The passages do not support an answer."
SYSTEM = "Answer only from the passages. Reply with one JSON object: grounded (true or false), answer, citations (source, unit, page). Cite every page used. If the passages do not answer, reply {\"grounded\": false}."
CITATION = "array<struct<source:string,unit:string,page:int>>"


def passage_block(nth: Column) -> Column:
    """One numbered passage of a prompt."""
    return F.concat(F.lit("["), nth.cast("string"), F.lit("] id="), "id", F.lit(" source="), "source", F.lit(" unit="), "unit", F.lit(" pages=["), F.array_join("pages", ", "), F.lit("] heading="), F.array_join("heading_path", " > "), F.lit(" content_type="), "content_type", F.lit("\n"), F.when(F.trim("text") == "", "(none)").otherwise(F.col("text")))


def prompts(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """questions (query_id, question), passages (query_id, rank, id, ...) -> (query_id, prompt, n_passages); a
    question without passages has a prompt that says so."""
    each = passages.select("query_id", "rank", passage_block(F.col("rank")).alias("block"))
    whole = each.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    text = F.coalesce(F.array_join(F.transform("b", lambda x: x["block"]), "\n\n"), F.lit("(none)"))
    return questions.join(whole, "query_id", "left").select("query_id", F.concat(F.lit("Passages:\n"), text, F.lit("\n\nQuestion: "), "question").alias("prompt"), F.coalesce(F.size("b"), F.lit(0)).cast("long").alias("n_passages"))


def completed(rows: DataFrame, completer, system: str = SYSTEM, prompt: str = "prompt", out: str = "completion") -> DataFrame:
    """rows with the completer's reply; filter first, as every row given is asked."""

    @F.pandas_udf(T.StringType())
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([completer.complete(system, p) for p in b], dtype=object)

    return rows.withColumn(out, ask(F.col(prompt)))


def completed_each(rows: DataFrame, completer, system: str = SYSTEM, prompt: str = "prompt") -> DataFrame:
    """rows with `completion` and `error`: an item whose request fails has the error's text and no completion, and
    stops no other."""

    @F.pandas_udf(T.StructType([T.StructField("completion", T.StringType()), T.StructField("error", T.StringType())]))
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b:
                try:
                    out.append((completer.complete(system, p), None))
                except Exception as e:  # whatever the service raises is this item's outcome
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["completion", "error"])

    return rows.withColumn("_r", ask(F.col(prompt))).select(*rows.columns, "_r.completion", "_r.error")


def json_object(text: Column) -> Column:
    """The JSON object in a reply, with or without a code fence, as a variant; null for anything else."""
    bare = F.regexp_replace(F.regexp_replace(F.btrim(text, F.lit(" \t\r\n")), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")
    value = F.try_parse_json(bare)
    return F.when(F.schema_of_variant(value).startswith("OBJECT<"), value)


def truthy(value: Column) -> Column:
    """Whether a variant counts as true: not null, false, zero, empty text, empty list or empty object."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    text = F.coalesce(F.to_json(value), F.lit("null"))
    return (kind != "VOID") & ~text.isin("null", "false", "0", "0.0", '""', "[]", "{}", "-0.0", "0E0")


def citations(value: Column) -> Column:
    """A reply's citations, strictly read; null if any is wrong or there is none.

    Each must be an object with a source that is text and not blank, a unit that is not null (a number is read as
    text) and a page that is a whole number above 0; true is not a number here.
    """
    every = F.try_variant_get(value, "$.citations", "array<variant>")
    return F.when(every.isNotNull() & (F.size(every) > 0) & F.forall(every, good_citation), F.transform(every, citation))


def _field(c: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(c, f"$.{name}", kind)


def good_citation(c: Column) -> Column:
    """Whether a variant is a whole citation."""
    kind = lambda f: F.coalesce(F.schema_of_variant(_field(c, f, "variant")), F.lit("VOID"))
    source = (kind("source") == "STRING") & (F.trim(_field(c, "source", "string")) != "")
    page = (kind("page") == "BIGINT") & (_field(c, "page", "bigint") >= 1)
    return F.coalesce(F.schema_of_variant(c).startswith("OBJECT<") & source & (kind("unit") != "VOID") & page, F.lit(False))


def citation(c: Column) -> Column:
    return F.struct(_field(c, "source", "string").alias("source"), _field(c, "unit", "string").alias("unit"), _field(c, "page", "int").alias("page"))


def citation_keys(passages: DataFrame) -> DataFrame:
    """(query_id, source, unit, page) that a question's passages allow; page tokens of another unit don't count."""
    each = passages.select("query_id", "source", "unit", F.explode("pages").alias("token"))
    prefix, page = F.regexp_extract("token", r"^(.+)-(\d+)$", 1), F.regexp_extract("token", r"^(.+)-(\d+)$", 2)
    return each.filter(prefix == F.col("unit")).select("query_id", "source", "unit", page.try_cast("int").alias("page")).filter("page is not null").distinct()


def unsupported(cited: DataFrame, allowed: DataFrame) -> DataFrame:
    """cited (query_id, citations) -> the citations that no passage supports (query_id, source, unit, page)."""
    each = cited.select("query_id", F.explode("citations").alias("c")).select("query_id", "c.source", "c.unit", "c.page")
    return each.join(allowed, ["query_id", "source", "unit", "page"], "left_anti")


def decide(replies: DataFrame, passages: DataFrame) -> DataFrame:
    """replies (query_id, completion, n_passages) -> (query_id, grounded, answer, citations).

    Refuses without passages, where the reply doesn't claim ground (loosely read), has a blank answer, has a wrong or no
    citation, or cites what the passages don't support.
    """
    read = replies.withColumn("v", json_object(F.col("completion")))
    read = read.withColumn("said", F.coalesce(truthy(F.try_variant_get("v", "$.grounded", "variant")), F.lit(False)))
    text = F.when(F.schema_of_variant(F.try_variant_get("v", "$.answer", "variant")) == "STRING", F.try_variant_get("v", "$.answer", "string"))
    read = read.withColumn("text", text).withColumn("citations", citations(F.col("v")))
    wrong = unsupported(read, citation_keys(passages)).select("query_id").distinct().withColumn("wrong", F.lit(True))
    both = read.join(wrong, "query_id", "left")
    ok = (F.col("n_passages") > 0) & F.col("said") & F.coalesce(F.trim("text") != "", F.lit(False)) & F.col("citations").isNotNull() & F.col("wrong").isNull()
    return both.select("query_id", ok.alias("grounded"), F.when(ok, F.trim("text")).otherwise(REFUSAL).alias("answer"), F.when(ok, F.col("citations")).otherwise(F.array().cast(CITATION)).alias("citations"))


def answer(questions: DataFrame, passages: DataFrame, completer) -> DataFrame:
    """Ask the completer about every question that has passages, and decide."""
    asked = prompts(questions, passages)
    replies = completed(asked.filter("n_passages > 0"), completer)
    silent = asked.filter("n_passages = 0").withColumn("completion", F.lit(None).cast("string"))
    return decide(replies.unionByName(silent), passages)


def retrieved_passages(step: str, questions: DataFrame, vectors: DataFrame, texts: DataFrame, parents: DataFrame, **how) -> DataFrame:
    """questions (query_id, text, and embedding unless `embedder` is given) -> passages (query_id, rank, id and the
    parents' columns), by one retrieval step; `how` goes to search.retrieve."""
    found = retrieve(step, vectors, texts, questions, parents, **how)
    return materialize(found.withColumnRenamed("parent_id", "id"), "answer-passages")


def ask(step: str, questions: DataFrame, vectors: DataFrame, texts: DataFrame, parents: DataFrame, completer, **how) -> DataFrame:
    """Retrieve, then answer: (query_id, grounded, answer, citations), a row a question."""
    passages = retrieved_passages(step, questions, vectors, texts, parents, **how)
    return answer(questions.select("query_id", F.col("text").alias("question")), passages, completer)
