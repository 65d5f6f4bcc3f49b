"""Table sinks: the chunk table and JSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import lookup

DOC_BUCKETS = 64


def stored_chunk_id(doc_id: Column, position: Column, text: Column) -> Column:
    """``{doc}_chunk_{i}_{8 hex}``, the hex from the text so that a rerun gives the same id."""
    return F.concat(
        doc_id.cast("string"), F.lit("_chunk_"), position.cast("string"), F.lit("_"),
        F.left(F.sha2(text, 256), F.lit(8)),
    )


def stored_chunks(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks joined to their vectors by chunk id; chunks without a vector are left out."""
    with_vector = vectors.where("embedding IS NOT NULL").select("chunk_id", "embedding")
    return (
        chunks.drop("embedding")
        .join(with_vector, "chunk_id")
        .withColumn("chunk_id", stored_chunk_id(F.col("doc_id"), F.col("position"), F.col("text")))
        .withColumn("doc_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(DOC_BUCKETS)).cast("int"))
    )


def write_chunks(stored: DataFrame, path: str, version: int = 0) -> None:
    """Writes one version of the documents' chunks; below it one folder per bucket of documents.

    Rows are dealt by (bucket, chunk id), not by document, so that one large document or
    bucket is written by several tasks. Writing a version again replaces it.
    """
    (
        stored.repartition("doc_bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(16)))
        .write.partitionBy("doc_bucket")
        .mode("overwrite")
        .parquet(f"{path}/version={version}")
    )


def current_chunks(table: DataFrame) -> DataFrame:
    """The chunks of each document's latest version: a re-ingested document replaces its chunks."""
    latest = table.groupBy("doc_id").agg(F.max("version").alias("_latest"))
    return (
        lookup(table, latest, ["doc_id"], "inner")
        .where("version = _latest")
        .drop("_latest", "version")
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return current_chunks(spark.read.option("basePath", path).parquet(f"{path}/version=*"))


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def import_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
