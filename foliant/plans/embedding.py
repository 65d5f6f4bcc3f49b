"""Embedding and ingest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunk as C
from ..operators import embed as M
from ..operators import ingest as G
from ..operators import retrieve as R
from ..session import materialise
from . import inputs as I
from .chunking import packed_sql
from .registry import query

KEY = f"md5({I.strip_sql('lower(text)')})"
STORED = f"stored AS (SELECT DISTINCT {KEY} AS text_key FROM documents WHERE lang = 'en')"


def stored(spark, sf):
    """Vectors kept from an earlier run: those of the English documents."""
    english = I.texts(spark, sf, "documents").where("lang = 'en'")
    return M.embed(M.distinct_texts(english)).select("text_key", "embedding")


@query(
    f"""SELECT doc_id, CASE WHEN {I.strip_sql("text")} <> '' THEN 64 END AS dimension,
    CASE WHEN {I.strip_sql("text")} <> '' THEN 1.0::DOUBLE END AS length FROM documents"""
)
def embedded_documents(spark, sf):
    """A vector per document, by the offline model."""
    return M.embed(I.texts(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dimension"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 3).alias("length"),
    )


@query(
    f"""WITH k AS (SELECT doc_id, {KEY} AS text_key FROM documents),
    u AS (SELECT text_key, count(*) AS uses FROM k GROUP BY text_key)
    SELECT doc_id, k.text_key, true AS has_vector FROM k JOIN u ON u.text_key = k.text_key"""
)
def distinct_embeddings(spark, sf):
    """One model call per distinct text, fanned out to all rows."""
    out = M.embed_distinct(I.texts(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text_key", F.col("embedding").isNotNull().alias("has_vector"))


@query(f"SELECT {KEY} AS text_key, count(*) AS uses FROM documents GROUP BY 1")
def distinct_text_keys(spark, sf):
    """The distinct texts."""
    return M.distinct_texts(I.texts(spark, sf, "documents")).select("text_key", "uses")


@query(
    f"""WITH {STORED} SELECT {KEY} AS text_key, count(*) AS uses FROM documents
    WHERE {KEY} NOT IN (SELECT text_key FROM stored) GROUP BY 1"""
)
def texts_without_vector(spark, sf):
    """Texts that an incremental run has to embed."""
    return M.texts_to_embed(I.texts(spark, sf, "documents"), stored(spark, sf)).select(
        "text_key", "uses"
    )


@query(f"SELECT DISTINCT {KEY} AS text_key FROM documents")
def incremental_vectors(spark, sf):
    """The vector table after an incremental run."""
    return M.embed_incremental(I.texts(spark, sf, "documents"), stored(spark, sf)).select("text_key")


GATED = """c AS (SELECT source AS doc_id, doc_id AS chunk_id,
  n_chars % 100 >= (substr(source, 4)::INT * 4) AS embedded FROM documents),
v AS (SELECT doc_id, count(*) AS chunks, count(*) FILTER (NOT embedded) AS failures,
        count(*) FILTER (NOT embedded) / count(*) <= 0.5 AS passed FROM c GROUP BY doc_id)"""


def _gated(spark, sf):
    number = F.substring("source", 4, 3).cast("int")
    return M.embedding_gate(
        I.texts(spark, sf, "documents").select(
            F.col("source").alias("doc_id"),
            F.col("doc_id").alias("chunk_id"),
            F.when(F.col("n_chars") % 100 >= number * 4, F.array(F.lit(1.0))).alias("embedding"),
        )
    )


@query(f"WITH {GATED} SELECT * FROM v")
def embedding_verdicts(spark, sf):
    """Failure rate per document; here a source stands for a document."""
    return _gated(spark, sf)[1]


@query(f"WITH {GATED} SELECT c.doc_id, c.chunk_id FROM c JOIN v ON v.doc_id = c.doc_id WHERE passed AND embedded")
def embedded_chunks_kept(spark, sf):
    """Chunks that go on."""
    return _gated(spark, sf)[0].select("doc_id", "chunk_id")


@query("SELECT len(embedding) AS dimension, count(*) AS n FROM embeddings GROUP BY 1")
def vector_dimensions(spark, sf):
    """E5: vector lengths."""
    return M.check_dimension(I.table(spark, sf, "embeddings"))


@query(
    f"""WITH {STORED}, k AS (SELECT {KEY} AS text_key, count(*) AS uses FROM documents GROUP BY 1)
    SELECT sum(uses)::BIGINT AS requests, (sum(uses) - count(*) FILTER (s.text_key IS NULL))::BIGINT AS hits,
      count(*) FILTER (s.text_key IS NULL) AS misses,
      round((sum(uses) - count(*) FILTER (s.text_key IS NULL)) / sum(uses) * 100, 6) AS hit_rate
    FROM k LEFT JOIN stored s ON s.text_key = k.text_key"""
)
def vector_reuse(spark, sf):
    """How often a vector is reused."""
    out = M.reuse_stats(I.texts(spark, sf, "documents"), stored(spark, sf))
    return out.withColumn("hit_rate", F.round("hit_rate", 6))


def ingest_docs(spark, sf):
    """Documents with the outcome of their extraction; toxic ones count as failed."""
    d = I.texts(spark, sf, "documents").join(I.table(spark, sf, "labels"), "doc_id", "left")
    return d.select(
        "doc_id",
        F.when(F.col("n_chars") % 10 == 0, "  ").otherwise(F.col("text")).alias("text"),
        F.when(F.col("toxic") == 1, "unreadable").alias("error"),
        F.when(F.col("lang") == "de", "ocr").alias("extraction_method"),
        F.lit(None).cast("boolean").alias("has_formatting"),
        (F.col("quality") == 1).alias("has_tables"),
    )


@query(
    """SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN lang = 'de' THEN 'ocr' ELSE 'standard' END AS extraction_method,
       coalesce(quality = 1, false) AS has_tables,
       CASE WHEN toxic = 1 THEN 'Extraction failed: unreadable'
            WHEN n_chars % 10 = 0 THEN 'No content to process' ELSE 'Successfully processed' END AS outcome,
       coalesce(toxic = 1, false) OR n_chars % 10 = 0 AS no_chunks
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
)
def ingest_reports(spark, sf):
    """Status, message and chunk count per document."""
    docs = ingest_docs(spark, sf)
    chunks = C.chunk_documents(G.with_content(docs).select("doc_id", "text"))
    report = G.ingest_report(docs, G.stored_only(docs, chunks))
    outcome = F.regexp_replace("message", "^(Successfully processed) .*$", "$1")
    return report.select(
        "doc_id", "status", "extraction_method", "has_tables",
        outcome.alias("outcome"), (F.col("chunks_created") == 0).alias("no_chunks"),
    )


@query(
    f"""WITH RECURSIVE {packed_sql(C.CHUNK_SIZE, C.OVERLAP)} SELECT doc_id || '_chunk_' || piece AS chunk_id, doc_id,
      {I.tokens_sql("text")} AS tokens, 64 AS dimension FROM chunked"""
)
def ingested_chunks(spark, sf):
    """Documents to chunks with vectors in one job."""
    kept, _ = G.ingest(I.texts(spark, sf, "documents").select("doc_id", "text"))
    return kept.select("chunk_id", "doc_id", "tokens", F.size("embedding").alias("dimension"))


@query()
def answered_passages(spark, sf):
    """R19 end to end: benchmark passages as questions over the chunked, embedded documents."""
    kept, _ = G.ingest(I.texts(spark, sf, "documents").select("doc_id", "text"))
    asked = M.embed(
        I.table(spark, sf, "benchmark").select(
            F.col("item_id").alias("query_id"), F.col("text").alias("query")
        ),
        "query",
        out="qvec",
    ).select(
        "*",
        F.lit(None).cast("int").alias("top_k"),
        F.lit("thinking").alias("mode"),
        F.lit(None).cast("double").alias("threshold"),
    )
    chunks = materialise(kept.select("chunk_id", "doc_id", "text", "embedding"), "index")
    found = R.retrieve(asked, chunks)
    return found.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))
