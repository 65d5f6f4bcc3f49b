"""Expressions and helpers that several corpus operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from string import ascii_lowercase, ascii_uppercase
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 512
# text that a Python worker turns into arrays at once
BLOCK_BYTES = 1 << 20


def bounded_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Asks for Arrow batches that stay small when every text is long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def worker_memory(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task under ``name``; made where it has none.

    Functions come to a task with globals of their own, so this is held by a module of the worker.
    """
    held = sys.modules.setdefault("_foliant_worker_memory", ModuleType("_foliant_worker_memory")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def text_blocks(texts: list[str | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts (null as empty) in blocks of about ``limit`` characters, with the first index."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or "")
        size += len(held[-1])
        if size >= limit:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def lower_ascii(c: Column) -> Column:
    """A to Z in lower case, every other character as it is."""
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def whole(c: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns that tell rows apart also where a doc_id is null or occurs with other texts."""
    return [
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"),
        F.xxhash64(F.col(text)).alias("_hash"),
    ]


def keyed(docs: DataFrame) -> tuple[DataFrame, str, Column, Column]:
    """The rows with their key in one struct column, its name, and its two parts."""
    name = unused(docs, "_key")
    parts = F.col(f"{name}._id"), F.col(f"{name}._hash")
    return docs.withColumn(name, F.struct(*row_key())), name, *parts


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
