"""Consistency checks: what a text lost, lines that run through pages, rules of fixtures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain(markdown: Column) -> Column:
    """Markdown without frontmatter and comments."""
    return F.regexp_replace(F.regexp_replace(markdown, r"(?s)\A---\n.*?\n---\n", ""), r"(?s)<!--.*?-->", " ")


def check_tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9 of three characters or more."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: F.length(x) > 2)


def token_counts(texts: DataFrame) -> DataFrame:
    return texts.select(F.explode(check_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def lost_tokens(before: DataFrame, after: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Tokens (text columns on both sides) that the second has fewer of: (token, lost), without those allowed (token)."""
    both = token_counts(before).join(token_counts(after).withColumnRenamed("n", "m"), "token", "left")
    out = both.select("token", (F.col("n") - F.coalesce("m", F.lit(0))).alias("lost")).filter("lost > 0")
    return out if allowed is None else out.join(allowed.select("token").distinct(), "token", "left_anti")


def running_lines(pages: DataFrame, least: int = 2, share: float = 0.6) -> DataFrame:
    """pages (doc, page, text) -> (doc, line, pages): lines on at least `share` of a document's pages, and at least
    `least`, where it has three pages or more."""
    each = pages.select("doc", "page", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line")).filter("line <> ''").distinct()
    counts = each.groupBy("doc", "line").agg(F.count("*").alias("pages"))
    sizes = pages.groupBy("doc").agg(F.countDistinct("page").alias("many"))
    joined = counts.join(sizes, "doc").filter("many >= 3")
    return joined.filter(F.col("pages") >= F.greatest(F.lit(float(least)), F.bround(F.col("many") * F.lit(share), 0))).select("doc", "line", "pages")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(key).cast("string").alias("key"))


def breaches(rules: dict[str, DataFrame]) -> DataFrame:
    """Rules, each a table (key) of the rows that break it -> (rule, key)."""
    parts = [rows.select(F.lit(name).alias("rule"), "key") for name, rows in rules.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def item_breaches(items: DataFrame) -> DataFrame:
    """Rules of evaluation items (id, question, expected_behavior, expected_answer, choices): unique ids, a question,
    a known behaviour, an expected answer among the choices (several joined by `; `)."""
    key = F.col("id").cast("string").alias("key")
    parts = F.split("expected_answer", "; ")
    return breaches(
        {
            "id repeats": repeated(items, "id"),
            "no question": items.filter(F.coalesce(F.trim("question"), F.lit("")) == "").select(key),
            "unknown behaviour": items.filter(~F.coalesce(F.col("expected_behavior").isin("answer", "refuse", "correct", "decline"), F.lit(False))).select(key),
            "answer is no choice": items.filter(F.col("choices").isNotNull() & ~F.array_contains("choices", F.col("expected_answer")) & (F.size(F.array_except(parts, F.col("choices"))) > 0)).select(key),
        }
    )
