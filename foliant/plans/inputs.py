"""The driver's tables seen as the operators' inputs, in Spark and as SQL common tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A text table for heavy per-row work."""
    return spread(table(spark, sf, name))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A stored vector with the text of the document of the same number."""
    e, d = table(spark, sf, "embeddings"), table(spark, sf, "documents")
    return e.join(d, e.vec_id == d.doc_id).select(
        F.col("vec_id").alias("chunk_id"),
        F.concat(F.lit("d"), "label").alias("doc_id"),
        "embedding",
        "text",
        F.col("source").alias("filename"),
        F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("Title "), "vec_id")).alias("documentTitle"),
        F.when(F.col("lang") != "en", F.col("lang")).alias("courseId"),
        F.when(F.col("n_chars") % 2 == 0, F.col("source")).otherwise("").alias("chatId"),
    )


CHUNKS = """chunks AS (
  SELECT e.vec_id AS chunk_id, 'd' || e.label AS doc_id, e.embedding::DOUBLE[] AS embedding, d.text,
         d.source AS filename,
         CASE WHEN d.n_chars % 3 = 0 THEN 'Title ' || e.vec_id END AS documentTitle,
         CASE WHEN d.lang <> 'en' THEN d.lang END AS courseId,
         CASE WHEN d.n_chars % 2 = 0 THEN d.source ELSE '' END AS chatId
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)"""


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored vector asked as a query, in all three modes and at two thresholds."""
    label = F.col("label")
    mode = F.when(label % 3 == 0, "files").when(label % 3 == 1, "coding").otherwise("thinking")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.concat(F.lit("vector "), "vec_id").alias("query"),
        F.col("embedding").alias("qvec"),
        F.lit(None).cast("int").alias("top_k"),
        mode.alias("mode"),
        F.when(label % 2 == 0, 0.15).otherwise(0.5).alias("threshold"),
        F.array(
            F.concat(F.lit("d"), (label + 3) % 10), F.concat(F.lit("d"), label)
        ).alias("document_ids"),
    )


QUERIES = """queries AS (
  SELECT vec_id AS query_id, 'vector ' || vec_id AS query, embedding::DOUBLE[] AS qvec,
         CASE label % 3 WHEN 0 THEN 10 WHEN 1 THEN 8 ELSE 6 END AS top_k,
         CASE label % 3 WHEN 0 THEN 'files' WHEN 1 THEN 'coding' ELSE 'thinking' END AS mode,
         CASE WHEN label % 2 = 0 THEN 0.15 ELSE 0.5 END AS threshold,
         ['d' || (label + 3) % 10, 'd' || label] AS document_ids
  FROM embeddings)"""

# the n nearest of every query, n = 12..50 by top_k
CANDIDATES = """cand AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT q.query_id, c.chunk_id, q.top_k, q.mode, q.threshold,
               round(list_cosine_similarity(q.qvec, c.embedding), 9) AS score
        FROM queries q, chunks c)
  QUALIFY rank <= least(greatest(2 * top_k, 12), 50))"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as a message log: user turns are human, all others bot."""
    return table(spark, sf, "conversations").select(
        F.concat(F.lit("course"), F.col("conv_id") % 5).alias("course_id"),
        F.col("conv_id").alias("chat_id"),
        F.col("turn").alias("seq"),
        F.when(F.col("role") == "user", "human").otherwise("bot").alias("sender"),
        F.col("text").alias("content"),
        F.concat(F.lit('["'), "role", F.lit('"]')).alias("citations"),
    )


MESSAGES = """messages AS (
  SELECT 'course' || conv_id % 5 AS course_id, conv_id AS chat_id, turn AS seq,
         CASE WHEN role = 'user' THEN 'human' ELSE 'bot' END AS sender, text AS content,
         '["' || role || '"]' AS citations
  FROM conversations)"""

# whitespace, as in foliant.functions.text, for RE2 and for trim()
WS_RE = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NOT_WS_RE = WS_RE.replace("[", "[^", 1)
WS_SQL = " || ".join(
    ["' '"]
    + [
        f"chr({c})"
        for c in [*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
        + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    ]
)


def strip_sql(c: str) -> str:
    return f"trim({c}, {WS_SQL})"


def tokens_sql(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{NOT_WS_RE}+'))"


def words_sql(c: str) -> str:
    return f"regexp_extract_all({c}, '{NOT_WS_RE}+')"


def sentences_sql(c: str) -> str:
    """List of sentences: a marker goes in after each sentence-ending full stop."""
    marked = f"string_split(regexp_replace({c}, '\\.({WS_RE}+[A-Z])', '.' || chr(1) || '\\1', 'g'), chr(1))"
    return (
        f"list_filter(list_transform({marked}, lambda s: {strip_sql('s')}), "
        f"lambda s: s <> '' AND s <> '.')"
    )
