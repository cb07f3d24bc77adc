"""Incremental ingest as a stream: an extension, each micro-batch of changed units brings the index forward.

A batch holds whole units. Their chunks replace what the index has of them; other units stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_units
from ..operators.sync import Index, apply_plan, plan_sync


def sync_units(units: DataFrame, index: Index, embedder) -> None:
    """Bring the index to the given units; units not given are left alone."""
    records = chunk_units(units).withColumnRenamed("ordinal", "pos")
    own = records.select("source", "unit").distinct()
    held = index.read()
    hashes = index.hashes() if held is None else held.join(own, ["source", "unit"], "left_semi").select("id", "content_hash")
    apply_plan(records.drop("path", "owner"), index, plan_sync(records, hashes), embedder)


def ingest_stream(units: DataFrame, index: Index, embedder, checkpoint: str) -> StreamingQuery:
    """units: a streaming table (path, content). Reruns of a batch converge, as the plan goes by hash."""

    def step(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sync_units(batch, index, embedder)

    return units.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
