"""Batch ingest: validated texts to chunks, vectors, and a report per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..session import materialise
from .chunk import CHUNK_SIZE, OVERLAP, chunk_documents
from .embed import Model, embed_distinct, embedding_gate


def ingest(
    docs: DataFrame, model: Model | None = None, size: int = CHUNK_SIZE, overlap: int = OVERLAP
) -> tuple[DataFrame, DataFrame]:
    """(chunks with vectors, embedding verdict per document) for ``docs(doc_id, text)``.

    Chunks and vectors are each written once to the shared folder: both are read twice.
    """
    chunks = materialise(chunk_documents(docs, size, overlap), "chunks")
    return embedding_gate(materialise(embed_distinct(chunks, "text", model), "vectors"))


def ingest_report(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, error, extraction_method, has_formatting, has_tables) and the stored chunks.

    A document with an error is failed and counts no chunks.
    """
    made = chunks.groupBy("doc_id").agg(F.count("*").alias("_made"))
    failed = F.col("error").isNotNull()
    n = F.when(failed, 0).otherwise(F.coalesce("_made", F.lit(0)))
    return docs.join(made, "doc_id", "left").select(
        "doc_id",
        F.when(failed, "failed").otherwise("completed").alias("status"),
        n.cast("long").alias("chunks_created"),
        F.when(failed, F.concat(F.lit("Extraction failed: "), "error"))
        .when(n == 0, "No content to process")
        .otherwise(F.concat(F.lit("Successfully processed "), n, F.lit(" chunks"))).alias("message"),
        F.coalesce("extraction_method", F.lit("standard")).alias("extraction_method"),
        F.coalesce("has_formatting", F.lit(False)).alias("has_formatting"),
        F.coalesce("has_tables", F.lit(False)).alias("has_tables"),
    )


def stored_only(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of documents that did not fail: failed ones leave nothing behind."""
    return chunks.join(docs.where("error IS NOT NULL").select("doc_id"), "doc_id", "left_anti")


def with_content(docs: DataFrame) -> DataFrame:
    return docs.where(~is_blank(F.col("text")))
