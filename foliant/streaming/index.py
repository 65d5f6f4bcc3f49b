"""Incremental ingest and the incrementally kept search index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import lookup
from ..functions.text import strip
from ..operators.chunk import chunk_documents
from ..operators.embed import Model, embed, embedding_gate, text_key, texts_to_embed
from ..operators.ingest import ingest_report, stored_only
from ..operators.messages import CHAT
from ..operators.validate import extension, validate_files
from ..session import materialise, shared_dir
from ..sources.files import text_docs
from .runner import run_batches

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New files below a folder."""
    name = F.element_at(F.split("path", "/"), -1)
    return (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("maxFilesPerTrigger", max_files)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(
            F.sha2("path", 256).alias("doc_id"), name.alias("name"), extension(name).alias("ext"),
            F.col("length").alias("size"), F.lit("text/plain").alias("mime"), "content",
        )
    )


def stream_ingest(files: DataFrame, model: Model | None = None) -> tuple[DataFrame, DataFrame]:
    """Streaming (doc_id, name, ext, size, mime, content) to (stored chunks, reports).

    Per micro-batch: validate, read the text, chunk, embed only texts without a vector from an
    earlier batch, store. Each batch writes folders of its own number, so a batch that runs
    again after a failure replaces what it wrote.
    """
    spark = files.sparkSession
    root = shared_dir(spark, "ingest")
    vector_schema = "text_key string, embedding array<float>, batch_id long"

    def earlier_vectors(batch_id: int) -> DataFrame:
        if batch_id == 0:
            return spark.createDataFrame([], vector_schema)
        return (
            spark.read.schema(vector_schema)
            .option("basePath", f"{root}/vectors")
            .parquet(f"{root}/vectors/batch_id=*")
            .where(F.col("batch_id") < batch_id)
        )

    def step(batch: DataFrame, batch_id: int) -> None:
        checked = text_docs(validate_files(batch))
        # read by the chunks, the stored rows and the report: files are validated once
        docs = checked.select(
            "doc_id", "text",
            F.nullif(F.array_join("errors", "; "), F.lit("")).alias("error"),
            F.lit(None).cast("string").alias("extraction_method"),
            F.lit(False).alias("has_formatting"), F.lit(False).alias("has_tables"),
        )
        docs = materialise(docs, "batch-docs")
        readable = docs.where((F.col("error").isNull()) & (strip(F.col("text")) != ""))
        chunks = materialise(chunk_documents(readable.select("doc_id", "text")), "batch-chunks")
        stored = earlier_vectors(batch_id)
        new = embed(texts_to_embed(chunks, stored), "text", model).select("text_key", "embedding")
        new.where("embedding IS NOT NULL").write.mode("overwrite").parquet(
            f"{root}/vectors/batch_id={batch_id}"
        )
        known = earlier_vectors(batch_id).select("text_key", "embedding").unionByName(
            spark.read.parquet(f"{root}/vectors/batch_id={batch_id}")
        )
        vectored = lookup(chunks.withColumn("text_key", text_key(F.col("text"))), known, ["text_key"])
        kept, _ = embedding_gate(vectored)
        target = f"{root}/chunks/batch_id={batch_id}"
        stored_only(docs, kept).write.mode("overwrite").parquet(target)
        ingest_report(docs, spark.read.parquet(target)).write.mode("overwrite").parquet(
            f"{root}/reports/batch_id={batch_id}"
        )

    run_batches(files, step)
    read = spark.read.option("basePath", f"{root}/chunks").parquet(f"{root}/chunks/batch_id=*")
    reports = spark.read.option("basePath", f"{root}/reports").parquet(f"{root}/reports/batch_id=*")
    return read.drop("batch_id"), reports.drop("batch_id")


def stream_search_index(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Streaming changes to the search index: (chats, messages) as they stand.

    ``changes``: kind (message, title, remove), course_id, chat_id, at, seq, content, title.
    The index is a log that batches append to; reading folds it, so a change never rewrites
    what is stored. A removed chat loses everything before its removal.
    """
    spark = changes.sparkSession
    root = shared_dir(spark, "search-index")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")

    run_batches(changes, step)
    return fold_index(spark.read.option("basePath", root).parquet(f"{root}/batch_id=*"))


def fold_index(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chats, messages) after all changes in the log."""
    state = log.groupBy(*CHAT).agg(
        F.max(F.when(F.col("kind") == "remove", F.col("at"))).alias("removed_at"),
        F.max_by("title", F.when(F.col("kind") == "title", F.col("at"))).alias("title"),
        F.max(F.when(F.col("kind") != "remove", F.col("at"))).alias("last_indexed"),
    )
    alive = state.where("removed_at IS NULL OR last_indexed > removed_at")
    messages = lookup(
        log.where("kind = 'message'"), alive.select(*CHAT, "removed_at"), CHAT, "inner"
    ).where("removed_at IS NULL OR at > removed_at")
    return alive.drop("removed_at"), messages.select(*CHAT, "seq", "content")
