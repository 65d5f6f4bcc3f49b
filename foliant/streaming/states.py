"""Latest import state, running metrics and slow-operation alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators.telemetry import flag_slow, operation_stats
from .runner import latest_per_key, run_to_table

CANCELLED = "cancelled"


def latest_state_stream(events: DataFrame) -> DataFrame:
    """Streaming (id, stage, progress, completed, total, ts, event_id) to the last state per key.

    An aggregation with a partial step: a document with very many events does not hold up one
    task. State is one row per (document, stage).
    """
    newest = F.max_by(F.struct("progress", "completed", "total"), F.struct("ts", "event_id"))
    return (
        events.groupBy("id", "stage")
        .agg(newest.alias("s"), F.max(F.struct("ts", "event_id")).alias("at"))
        .select("id", "stage", "s.*", "at")
    )


def current_states(emitted: DataFrame, stages: list[tuple[str, str]]) -> DataFrame:
    """All stages of every document seen, untouched ones as they start.

    A document whose last event cancels it is gone.
    """
    last = latest_per_key(emitted, ["id", "stage"])
    overall = last.groupBy("id").agg(F.max_by("progress", "at").alias("_last"))
    every = overall.where(F.col("_last") != CANCELLED).select(
        "id",
        F.explode(F.create_map(*[F.lit(x) for s in stages for x in s])).alias("stage", "_start"),
    )
    return every.join(last.drop("at"), ["id", "stage"], "left").withColumn(
        "progress", F.coalesce("progress", "_start")
    ).drop("_start")


def stream_latest_state(
    events: DataFrame, stages: list[tuple[str, str]] = L.IMPORT_STAGES
) -> DataFrame:
    return current_states(run_to_table(latest_state_stream(events), "update"), stages)


def stream_operation_stats(metrics: DataFrame) -> DataFrame:
    """Running statistics per operation; the last emitted row of each counts."""
    return latest_per_key(run_to_table(operation_stats(metrics), "update"), ["operation"])


def stream_slow_alerts(metrics: DataFrame) -> DataFrame:
    """Slow operations as they arrive."""
    return run_to_table(flag_slow(metrics).where("slow"), "append").drop("batch_id")
