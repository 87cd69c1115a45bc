"""Idempotent incremental upserts of a stream of sightings, by micro-batches.

Each micro-batch writes the merge state of its own sightings as one plain Parquet folder named by its batch id, so a batch that is
replayed after a failure writes the same folder again and counts once. States commute: whatever the order in which sightings come,
the order that they carry decides, and a late batch can't win over newer sightings. Nothing that is stored is rewritten by a batch.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from factfold.operators.merge import merge_state, merge_states, settled


def upsert_stream(stream: DataFrame, at: str, keys: list[str], rules: Mapping[str, str], seq: list[str], checkpoint: str) -> StreamingQuery:
    """Add each micro-batch to the states below ``at``; one stream per folder. seq must not tie within a key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_state(batch, keys, rules, seq).write.mode("overwrite").parquet(f"{at}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, at: str, keys: list[str], rules: Mapping[str, str]) -> DataFrame:
    """The merged rows of all batches below ``at``."""
    return settled(merge_states(spark.read.parquet(at), keys, rules), keys, rules)


def compact(spark: SparkSession, at: str, to: str, keys: list[str], rules: Mapping[str, str]) -> None:
    """The states below ``at`` as one folder below another place, for a stream that goes on there."""
    merge_states(spark.read.parquet(at), keys, rules).write.parquet(f"{to}/batch=-1")
