"""Catalog and chunk table queries: documents as the catalog, their lines as chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as G
from . import files as PF
from . import inputs as I
from .registry import query

CATALOG = """catalog AS (
  SELECT d.doc_id AS id, 'f' || d.doc_id || '.txt' AS filename, 'Title ' || d.doc_id || ' ' || lang AS title,
    n_chars AS fileSize, d.doc_id % 50 AS uploadDate, sha256(text) AS contentHash, source AS courseId, lang AS chatId,
    CASE WHEN toxic = 1 THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN toxic = 1 THEN 'unreadable' END AS errorMessage, quality::BIGINT AS pageCount
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
CHUNKS = """chunks AS (
  SELECT doc_id, doc_id || '_' || generate_subscripts(l, 1) - 1 AS chunk_id
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE n_chars % 5 <> 0))"""
INCOMING = """incoming AS (
  SELECT item_id AS file_id, sha256(text) AS contentHash, 'src' || item_id % 20 AS courseId FROM benchmark
  UNION ALL SELECT 1000000 + doc_id, sha256(text), 'src' || doc_id % 20 FROM documents)"""


def catalog(spark, sf):
    d, labels = I.table(spark, sf, "documents"), I.table(spark, sf, "labels")
    failed = F.col("toxic") == 1
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("f"), "doc_id", F.lit(".txt")).alias("filename"),
        F.concat(F.lit("Title "), "doc_id", F.lit(" "), "lang").alias("title"),
        F.col("n_chars").alias("fileSize"),
        (F.col("doc_id") % 50).alias("uploadDate"),
        F.sha2("text", 256).alias("contentHash"),
        F.col("source").alias("courseId"),
        F.col("lang").alias("chatId"),
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(failed, "unreadable").alias("errorMessage"),
        F.col("quality").cast("long").alias("pageCount"),
    )


def chunks(spark, sf):
    """Lines as chunks; documents whose length is a multiple of five have none."""
    d = I.table(spark, sf, "documents").where("n_chars % 5 <> 0")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select(
        "doc_id", F.concat_ws("_", "doc_id", "i").alias("chunk_id"), "text"
    )


def incoming(spark, sf):
    b, d = I.table(spark, sf, "benchmark"), I.table(spark, sf, "documents")
    return b.select(
        F.col("item_id").alias("file_id"), F.sha2("text", 256).alias("contentHash"),
        F.concat(F.lit("src"), F.col("item_id") % 20).alias("courseId"),
    ).unionByName(
        d.select(
            (F.col("doc_id") + 1000000).alias("file_id"), F.sha2("text", 256).alias("contentHash"),
            F.concat(F.lit("src"), F.col("doc_id") % 20).alias("courseId"),
        )
    )


def low_quality(spark, sf):
    """Documents asked to be deleted: those labelled poor, and pages' ids that may not exist."""
    labels = I.table(spark, sf, "labels").where("quality = 0").select("doc_id")
    return labels.unionByName(I.table(spark, sf, "pages").select((F.col("page_id") * 7).alias("doc_id")))


DOOMED = """doomed AS (SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT page_id * 7 FROM pages)"""


@query(
    f"""WITH {CHUNKS}, {DOOMED} SELECT d.doc_id, count(c.chunk_id) AS chunks_deleted, count(c.chunk_id) > 0 AS found
    FROM doomed d LEFT JOIN chunks c ON c.doc_id = d.doc_id GROUP BY d.doc_id"""
)
def deleted_documents(spark, sf):
    """G1: chunks deleted per requested document."""
    return G.delete_documents(chunks(spark, sf), low_quality(spark, sf))[1]


@query(
    f"""WITH {CHUNKS}, {DOOMED} SELECT doc_id, chunk_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM doomed)"""
)
def chunks_after_delete(spark, sf):
    """G1: the chunk table after deleting documents."""
    left, _ = G.delete_documents(chunks(spark, sf), low_quality(spark, sf))
    return left.select("doc_id", "chunk_id")


@query(
    f"""WITH {CHUNKS} SELECT doc_id, chunk_id FROM chunks
    WHERE chunk_id NOT IN (SELECT doc_id || '_' || doc_id % 4 FROM labels)"""
)
def chunks_deleted_by_id(spark, sf):
    """Delete single chunks."""
    ids = I.table(spark, sf, "labels").select(
        F.concat_ws("_", "doc_id", F.col("doc_id") % 4).alias("chunk_id")
    )
    return G.delete_chunks(chunks(spark, sf), ids).select("doc_id", "chunk_id")


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_id FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels)")
def chunks_by_document(spark, sf):
    """All chunks of requested documents."""
    return G.chunks_of(chunks(spark, sf), I.table(spark, sf, "labels")).select("doc_id", "chunk_id")


@query(f"WITH {CHUNKS} SELECT doc_id, count(*) AS chunk_count FROM chunks GROUP BY doc_id")
def chunk_counts(spark, sf):
    """Chunks per document."""
    return G.count_chunks(chunks(spark, sf))


@query(
    f"""WITH {CHUNKS} SELECT l.doc_id, count(c.chunk_id) AS chunk_count, count(c.chunk_id) > 0 AS present
    FROM labels l LEFT JOIN chunks c ON c.doc_id = l.doc_id GROUP BY l.doc_id"""
)
def verified_documents(spark, sf):
    """Do requested documents have chunks?"""
    return G.verify_documents(I.table(spark, sf, "labels").select("doc_id"), chunks(spark, sf))


UPDATES = """updates AS (
  SELECT event_id // 7 AS id, event_id AS version, CASE WHEN event_type = 'error' THEN 'failed'
      WHEN event_type = 'view' THEN 'processing' END AS status,
    CASE WHEN event_type = 'error' THEN 'code ' || user_id END AS errorMessage,
    CASE WHEN event_type = 'click' THEN event_id END AS pageCount FROM events)"""


@query(
    f"""WITH {CATALOG}, {UPDATES}, l AS (SELECT id,
      arg_max(status, version) FILTER (status IS NOT NULL) AS status,
      arg_max(errorMessage, version) FILTER (errorMessage IS NOT NULL) AS errorMessage,
      arg_max(pageCount, version) FILTER (pageCount IS NOT NULL) AS pageCount FROM updates GROUP BY id)
    SELECT coalesce(c.id, l.id) AS id, filename, coalesce(l.status, c.status) AS status,
      coalesce(l.errorMessage, c.errorMessage) AS errorMessage, coalesce(l.pageCount, c.pageCount) AS pageCount
    FROM catalog c FULL JOIN l ON l.id = c.id"""
)
def upserted_catalog(spark, sf):
    """Insert or update by id, null fields keep their value. Seven updates an id, so ids grow with the events."""
    t = F.col("event_type")
    updates = I.table(spark, sf, "events").select(
        F.expr("event_id div 7").alias("id"),
        F.col("event_id").alias("version"),
        F.when(t == "error", "failed").when(t == "view", "processing").alias("status"),
        F.when(t == "error", F.concat(F.lit("code "), "user_id")).alias("errorMessage"),
        F.when(t == "click", F.col("event_id")).alias("pageCount"),
    )
    return G.upsert_catalog(catalog(spark, sf), updates).select(
        "id", "filename", "status", "errorMessage", "pageCount"
    )


@query(
    f"""WITH {CATALOG} SELECT id, title, status FROM catalog
    WHERE courseId = 'src3' AND status = 'completed' AND contains(lower(title), ' en')"""
)
def catalog_entries(spark, sf):
    """Lookup by course, status and part of the title."""
    found = G.catalog_lookup(
        catalog(spark, sf), title_contains=" EN", courseId="src3", status="completed"
    )
    return found.select("id", "title", "status")


def _duplicates_sql(keys: list[str], where: str) -> str:
    on = " AND ".join(f"f.{k} = i.{k}" for k in keys)
    return f"""WITH {CATALOG}, {INCOMING}, f AS (
      SELECT {", ".join(keys)}, arg_min(id, uploadDate * 100000000 + id) AS id,
             arg_min(filename, uploadDate * 100000000 + id) AS filename FROM catalog GROUP BY ALL)
    SELECT i.file_id, f.id IS NOT NULL AS is_duplicate, f.id AS existing_id, CASE WHEN f.id IS NULL
      THEN 'Document is unique' ELSE 'This document already exists{where} as "' || f.filename || '"' END AS message
    FROM incoming i LEFT JOIN f ON {on}"""


@query(_duplicates_sql(["contentHash"], ""))
def incoming_duplicates(spark, sf):
    """Incoming files already in the catalog."""
    return G.check_duplicates(incoming(spark, sf), catalog(spark, sf)).select(
        "file_id", "is_duplicate", "existing_id", "message"
    )


@query(_duplicates_sql(["contentHash", "courseId"], " in this course"))
def incoming_duplicates_in_course(spark, sf):
    """The same within a course."""
    return G.check_duplicates(incoming(spark, sf), catalog(spark, sf), within_course=True).select(
        "file_id", "is_duplicate", "existing_id", "message"
    )


@query(
    """SELECT doc_id AS id, contentHash, group_size, first_id FROM (
      SELECT doc_id, sha256(text) AS contentHash, count(*) OVER (PARTITION BY text) AS group_size,
             min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) WHERE group_size > 1"""
)
def duplicate_documents(spark, sf):
    """Members of groups with equal content."""
    return G.duplicate_groups(catalog(spark, sf)).select("id", "contentHash", "group_size", "first_id")


@query(
    f"""WITH {CATALOG}, g AS (SELECT contentHash, count(*) AS n, arg_min(fileSize, id) AS size FROM catalog GROUP BY 1)
    SELECT sum(n)::BIGINT AS total_documents, count(*) AS unique_documents, count(*) FILTER (n > 1) AS duplicate_groups,
      sum(n - 1)::BIGINT AS total_duplicates, sum((n - 1) * size)::BIGINT AS wasted_space FROM g"""
)
def duplicate_statistics(spark, sf):
    """Copies and the space they take."""
    return G.duplicate_stats(catalog(spark, sf))


@query(
    f"""WITH {CATALOG} SELECT courseId, count(*) AS documents, sum(fileSize)::BIGINT AS total_size,
      {PF.size_sql("sum(fileSize)")} AS total_size_text FROM catalog GROUP BY courseId"""
)
def storage_statistics(spark, sf):
    """Documents and bytes per course."""
    return G.storage_stats(catalog(spark, sf), ["courseId"])


@query(
    """SELECT name FROM (SELECT page_id * 9 || '.txt.enc' AS name FROM pages)
    WHERE split_part(name, '.', 1)::BIGINT NOT IN (SELECT doc_id FROM documents)"""
)
def orphaned_files(spark, sf):
    """Stored files without a catalog row."""
    names = I.table(spark, sf, "pages").select(
        F.concat(F.col("page_id") * 9, F.lit(".txt.enc")).alias("name")
    )
    return G.orphan_files(names, catalog(spark, sf))


@query(
    f"""WITH {CATALOG}, {CHUNKS} SELECT c.id AS doc_id, count(k.chunk_id) AS chunks_deleted, count(k.chunk_id) > 0 AS found
    FROM catalog c LEFT JOIN chunks k ON k.doc_id = c.id WHERE status = 'failed' GROUP BY c.id"""
)
def purged_failures(spark, sf):
    """Failed documents and their chunks."""
    return G.purge_failed(catalog(spark, sf), chunks(spark, sf))[1]


@query(
    f"""WITH {CATALOG}, {CHUNKS} SELECT c.id AS doc_id, count(k.chunk_id) AS chunks_deleted, count(k.chunk_id) > 0 AS found
    FROM catalog c LEFT JOIN chunks k ON k.doc_id = c.id WHERE courseId = 'src7' GROUP BY c.id"""
)
def course_deletion(spark, sf):
    """Documents of a course and their chunks."""
    return G.cascade_delete(catalog(spark, sf), chunks(spark, sf), F.col("courseId") == "src7")[2]


@query(
    f"""WITH {CATALOG}, {CHUNKS} SELECT doc_id, count(*) AS n FROM chunks
    WHERE doc_id NOT IN (SELECT id FROM catalog WHERE chatId = 'fr') GROUP BY doc_id"""
)
def chunks_after_chat_deletion(spark, sf):
    """The chunk table after deleting a chat's documents."""
    _, left, _ = G.cascade_delete(catalog(spark, sf), chunks(spark, sf), F.col("chatId") == "fr")
    return left.groupBy("doc_id").agg(F.count("*").alias("n"))
