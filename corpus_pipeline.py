"""The corpus pipeline: documents -> token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; each result is
written as Parquet and read again as the next stage's docs. All but the last return the columns of
documents, and others that docs may have, whatever their names.

Nulls may stand in any column. A text of any length is used whole. A row without a text counts as one without words: it is scored like
any other, is a near-duplicate of other wordless rows, holds no benchmark item, has size 0 in the mix and one token, the end
mark. Rows without an id, and repeated rows, are rows like others; of repeated ones near_duplicates keeps one. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagelake.llm import decontaminate, mixing, quality, simhash, tokens
from passagelake.llm.common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    return simhash.dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents, dropped, repeated or cut to its share of the mix."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in Arrow files; returns where each document lies in them."""
    import public_tokenizers

    return tokens.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: SQL can express neither the classifier nor the tokenizer: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
