"""File sources and sinks: Markdown trees, evaluation items, JSON lines, run state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import unit_number, unit_variant
from ..operators.answers import citation, good_citation
from ..scratch import materialize
from .tree import read_tree, write_tree


def read_markdown_tree(spark: SparkSession, root: str, sources: list[str] | None = None) -> DataFrame:
    """Every unit-*.md below root, or below some sources' folders, -> (path, content)."""
    return read_tree(spark, root, sources).select("path", "content")


def unit_file(source, unit_id):
    """The file of a unit below a tree's root: number padded to two digits, then the variant."""
    return F.concat(source, F.lit("/unit-"), F.when(F.length(unit_number(unit_id)) < 2, F.lpad(unit_number(unit_id), 2, "0")).otherwise(unit_number(unit_id)), unit_variant(unit_id), F.lit(".md"))


def write_markdown_tree(units: DataFrame, root: str) -> DataFrame:
    """units (source, unit_id, content, error) -> the report (source, unit_id, path, error); the files of all units with content are
    written by the executors, byte for byte, and committed together, under names that a rerun replaces."""
    held = materialize(units.select("source", "unit_id", unit_file(F.col("source"), F.col("unit_id")).alias("path"), "content", "error"), "units")
    write_tree(held.filter("content is not null"), root)
    return held.select("source", "unit_id", F.when(F.col("content").isNotNull(), F.col("path")).alias("path"), "error")


def report(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(written, skipped)."""
    return outcomes.filter("error is null"), outcomes.filter("error is not null")


_CITATION = T.ArrayType(T.StructType([T.StructField("source", T.StringType()), T.StructField("unit", T.StringType()), T.StructField("page", T.IntegerType())]))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items of a JSON file {items: [...]}, strictly read: an item with a citation that isn't an object with a
    source, a unit (a number is read as text) and a whole page above 0, or without its keys, is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    each = raw.select(F.posexplode(F.variant_get("v", "$.items", "array<variant>")).alias("pos", "i"))
    text = lambda k: F.try_variant_get("i", f"$.{k}", "string")
    need = lambda k: F.coalesce(text(k), F.raise_error(F.concat(F.lit(f"item without {k}: "), F.to_json("i"))).cast("string"))
    cites = F.coalesce(F.try_variant_get("i", "$.citations", "array<variant>"), F.array().cast("array<variant>"))
    checked = F.when(F.forall(cites, good_citation), F.transform(cites, citation)).otherwise(F.raise_error(F.concat(F.lit("wrong citation: "), F.to_json("i"))).cast(_CITATION))
    terms = F.coalesce(F.try_variant_get("i", "$.verified_absent_terms", "array<string>"), F.array().cast("array<string>"))
    return each.select("pos", need("id").alias("id"), need("question").alias("question"), need("expected_behavior").alias("expected_behavior"), F.coalesce(text("expected_answer"), F.lit("")).alias("expected_answer"), checked.alias("citations"), *[text(k).alias(k) for k in ("category", "content_type", "difficulty")], terms.alias("verified_absent_terms"), F.try_variant_get("i", "$.choices", "array<string>").alias("choices"))


def read_settings(spark: SparkSession, path: str) -> dict[str, str]:
    """KEY=VALUE lines of a small file: blank lines, comments and lines without = are left out, quotes around a value go,
    a key given twice keeps its last value."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).open(jpath)  # Spark's readers pass over hidden files
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    out = {}
    for line in text.splitlines():
        key, is_pair, value = line.strip().partition("=")
        if is_pair and not key.startswith("#"):
            value = value.strip()
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
            out[key.removeprefix("export ").strip()] = value[1:-1] if quoted else value
    return out


def first_items(items: DataFrame, n: int) -> DataFrame:
    """The first n items of a file: the limit is the feature."""
    return items.orderBy("pos").limit(n)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """A JSON object a row; nulls are written."""
    rows.write.option("ignoreNullFields", "false").json(path)


def append_run(results: DataFrame, path: str) -> None:
    """Add results (id, ..., answer, error) to a run's state; a rerun reads them and leaves what is done."""
    results.write.mode("append").parquet(path)


def read_run(spark: SparkSession, path: str) -> DataFrame | None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath) else None

