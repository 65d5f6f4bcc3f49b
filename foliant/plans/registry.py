"""The table of named queries."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]

RUNS: dict[str, Run] = {}
ORACLES: dict[str, str] = {}

SUBJECTS = [
    "retrieval", "files", "extraction", "chunking", "embedding",
    "memo", "catalog", "conversations", "titles", "telemetry", "streams",
]


def query(sql: str | None = None):
    """Registers a function under its own name; ``sql`` is the DuckDB equivalent."""

    def register(run: Run) -> Run:
        if run.__name__ in RUNS:
            raise ValueError(f"query {run.__name__} is registered twice")
        RUNS[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


def load() -> None:
    for subject in SUBJECTS:
        import_module(f"{__package__}.{subject}")
