"""File scan, validation and JSON source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..operators import validate as V
from ..session import shared_dir
from ..sources import files as SF
from ..sources import json_logs as SJ
from ..sources import tables as ST
from . import inputs as I
from .registry import query

FILES = """files AS (
  SELECT 'in/f' || doc_id || (CASE n_chars % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.PPTX'
           WHEN 3 THEN '.epub' WHEN 4 THEN '.txt' WHEN 5 THEN '.md' WHEN 6 THEN '.exe' ELSE '' END) AS path,
         text, strlen(text) AS size,
         CASE n_chars % 3 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/pdf' END AS mime
  FROM documents
  UNION ALL SELECT 'web/p' || page_id || '.txt', html, strlen(html), 'text/html' FROM pages),
named AS (SELECT *, split_part(path, '/', 2) AS name,
                 lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS ext FROM files)"""


def files(spark, sf):
    """Documents and pages as files with mixed extensions."""
    n = F.col("n_chars") % 8
    ext = F.lit("")
    for i, e in enumerate([".pdf", ".docx", ".PPTX", ".epub", ".txt", ".md", ".exe"]):
        ext = F.when(n == i, e).otherwise(ext)
    mime = F.when(F.col("n_chars") % 3 == 0, "text/plain").when(
        F.col("n_chars") % 3 == 1, "application/pdf"
    )
    docs = I.table(spark, sf, "documents").select(
        F.concat(F.lit("in/f"), "doc_id", ext).alias("path"), "text", mime.alias("mime")
    )
    web = I.table(spark, sf, "pages").select(
        F.concat(F.lit("web/p"), "page_id", F.lit(".txt")).alias("path"),
        F.col("html").alias("text"),
        F.lit("text/html").alias("mime"),
    )
    name = F.element_at(F.split("path", "/"), -1)
    return docs.unionByName(web).select(
        "path", "mime", "text",
        name.alias("name"),
        V.extension(name).alias("ext"),
        F.octet_length("text").alias("size"),
        F.col("text").cast("binary").alias("content"),
    )


SUSPICIOUS_SQL = " OR ".join(
    f"contains(text, '{p}')" for p in L.SUSPICIOUS_PATTERNS
)
EXPECTED_SQL = "CASE ext " + " ".join(
    f"WHEN '{e}' THEN {m!r}" for e, m in L.EXPECTED_MIME.items()
) + " END"
MIME_OK_SQL = f"coalesce(list_contains({EXPECTED_SQL}, coalesce(mime, '{L.DEFAULT_MIME}')), true)"
ALLOWED_SQL = "ext IN (" + ", ".join(f"'{e}'" for e in L.ALLOWED_EXTENSIONS) + ")"


def size_sql(c: str) -> str:
    steps = " ".join(
        f"WHEN {c} / {1024**i}.0 < 1024 THEN printf('%.1f {u}', ({c} / {1024**i}.0)::DOUBLE)"
        for i, u in enumerate(["B", "KB", "MB", "GB"])
    )
    return f"CASE {steps} ELSE printf('%.1f TB', ({c} / {1024**4}.0)::DOUBLE) END"


@query(
    f"""SELECT doc_id, len(string_split(text, chr(10))) AS line_count,
    {I.tokens_sql("text")} AS word_count, len(text) AS char_count FROM documents"""
)
def text_measures(spark, sf):
    """Bytes to text with line, word and character counts."""
    docs = I.texts(spark, sf, "documents").select(
        "doc_id", F.col("text").cast("binary").alias("content")
    )
    return SF.text_docs(docs).select("doc_id", "line_count", "word_count", "char_count")


@query(
    """SELECT conv_id::VARCHAR AS course_id, turn::VARCHAR AS chat_id,
       generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq,
       CASE WHEN role = 'user' THEN 'human' ELSE 'bot' END AS sender,
       unnest(string_split(text, chr(10))) AS content,
       '[{"text":"' || role || '","documentTitle":"t' || turn || '"}]' AS citations,
       't' || turn AS document_ids, '2024-01-01T00:00:00Z' AS timestamp FROM conversations"""
)
def chat_files(spark, sf):
    """S3: chat files to message rows; each turn is written as one file, a line per message."""
    sender = F.when(F.col("role") == "user", "human").otherwise("bot")
    title = F.concat(F.lit("t"), "turn")
    cited = F.array(F.struct(F.col("role").alias("text"), title.alias("documentTitle")))
    lines = F.transform(
        F.split("text", "\n"),
        lambda x: F.struct(
            x.alias("content"), sender.alias("sender"), cited.alias("citations"),
            F.array(title).alias("documentIds"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
        ),
    )
    raw = I.table(spark, sf, "conversations").select(
        F.concat(F.lit("d/courses/"), "conv_id", F.lit("/chats/"), "turn", F.lit(".json")).alias("path"),
        F.to_json(F.struct(lines.alias("messages"))).alias("json"),
    )
    return SJ.parse_chat_files(raw).withColumn("document_ids", F.array_join("document_ids", ","))


@query(
    """SELECT 'c' || conv_id AS course_id, turn::VARCHAR AS chat_id, left(text, 20) AS title,
       CASE WHEN role = 'user' THEN 'general' ELSE 'document-based' END AS chat_type,
       CASE WHEN role = 'user' THEN 'doc' || turn ELSE '' END AS documents FROM conversations"""
)
def chat_catalog(spark, sf):
    """Chat catalogs with the defaults for files that lack type and documents."""
    user = F.col("role") == "user"
    chat = F.struct(
        F.col("turn").cast("string").alias("id"),
        F.left("text", F.lit(20)).alias("title"),
        F.lit("2024-01-01T00:00:00Z").alias("latestActivity"),
        F.when(user, "general").alias("chatType"),
        F.when(user, F.array(F.concat(F.lit("doc"), "turn"))).alias("documentIds"),
    )
    raw = I.table(spark, sf, "conversations").select(
        F.concat(F.lit("courses/c"), "conv_id", F.lit("/chats.json")).alias("path"),
        F.to_json(F.struct(F.array(chat).alias("chats"))).alias("json"),
    )
    return SJ.parse_chat_catalog(raw).select(
        "course_id", "chat_id", "title", "chat_type",
        F.array_join("document_ids", ",").alias("documents"),
    )


def log_lines(spark, sf):
    """Events as JSON log lines with one extra field."""
    t = F.col("event_type")
    return I.table(spark, sf, "events").select(
        F.to_json(
            F.struct(
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
                F.when(t == "error", "ERROR").otherwise("INFO").alias("level"),
                F.concat(F.lit("app."), t).alias("logger"),
                F.concat(t, F.lit(" by "), "user_id").alias("message"),
                t.alias("module"),
                F.lit("run").alias("function"),
                F.col("event_id").alias("line"),
                F.get_json_object("props", "$.k").alias("k"),
            )
        ).alias("value")
    )


@query(
    """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
       CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, event_type AS module,
       event_id::INT AS line, event_type || ' by ' || user_id AS message,
       props->>'$.k' AS k FROM events"""
)
def json_logs(spark, sf):
    """JSON log lines to columns, other fields into a map."""
    return SJ.parse_json_logs(log_lines(spark, sf)).select(
        "timestamp", "level", "module", "line", "message", F.col("extras")["k"].alias("k")
    )


def token_lines(spark, sf):
    """Conversation words as stream lines: both JSON shapes, some blank or broken."""
    w = I.texts(spark, sf, "conversations").select(
        "conv_id", "turn", F.posexplode(X.words(F.col("text"))).alias("seq", "word")
    )
    token = F.concat("word", F.lit(" "))
    kind = F.col("seq") % 11
    return w.select(
        "conv_id", "turn", "seq",
        F.when(kind == 9, "  ")
        .when(kind == 10, "{broken")
        .when(kind % 2 == 0, F.to_json(F.struct(F.struct(token.alias("content")).alias("message"))))
        .otherwise(F.to_json(F.struct(token.alias("response"), F.lit(False).alias("done"))))
        .alias("line"),
    )


TOKENS = f"""tokens AS (
  SELECT conv_id, turn, seq, word || ' ' AS token FROM (
    SELECT conv_id, turn, generate_subscripts(w, 1) - 1 AS seq, unnest(w) AS word
    FROM (SELECT conv_id, turn, {I.words_sql("text")} AS w FROM conversations))
  WHERE seq % 11 < 9)"""


@query(f"WITH {TOKENS} SELECT conv_id, turn, seq, token FROM tokens")
def token_stream(spark, sf):
    """Newline-delimited JSON token lines to tokens."""
    return SJ.parse_token_stream(token_lines(spark, sf)).select("conv_id", "turn", "seq", "token")


@query(
    """SELECT 'd' || e.label AS doc_id, count(*) AS n,
       min('d' || e.label || '_chunk_' || e.vec_id || '_' || left(sha256(d.text), 8)) AS first_id
       FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id GROUP BY 1"""
)
def stored_chunk_table(spark, sf):
    """Chunk table written twice to the shared folder; reading gives the latest version."""
    c = I.chunks(spark, sf).withColumn("position", F.col("chunk_id"))
    path = shared_dir(spark, "chunks")
    stored = ST.stored_chunks(c, c.select("chunk_id", "embedding"))
    ST.write_chunks(stored, path, version=1)
    ST.write_chunks(stored, path, version=2)
    return ST.read_chunks(spark, path).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min("chunk_id").alias("first_id")
    )


@query(f"WITH {I.MESSAGES} SELECT course_id, chat_id, seq, sender, content, citations FROM messages")
def exported_history(spark, sf):
    """JSON export of the message log and reload."""
    m = I.messages(spark, sf)
    path = shared_dir(spark, "export")
    ST.export_json(m, path)
    return ST.import_json(spark, path, m.schema)


@query(f"WITH {FILES} SELECT path, ext, {ALLOWED_SQL} AS allowed FROM named")
def allowed_extensions(spark, sf):
    """V1: extension on the allow list."""
    return files(spark, sf).select("path", "ext", V.ext_allowed(F.col("ext")).alias("allowed"))


@query(f"WITH {FILES} SELECT path, size, size <= 2000 AS size_ok FROM named")
def allowed_sizes(spark, sf):
    """V2: size limit (2000 bytes here, 100 MiB by default)."""
    return files(spark, sf).select(
        "path", "size", V.size_allowed(F.col("size"), 2000).alias("size_ok")
    )


@query(f"WITH {FILES} SELECT path, {MIME_OK_SQL} AS mime_ok FROM named")
def consistent_mime(spark, sf):
    """V3: guessed MIME type fits the extension."""
    return V.mime_consistent(files(spark, sf)).select("path", "mime_ok")


@query(f"WITH {FILES} SELECT path, ({SUSPICIOUS_SQL}) AS suspicious FROM named")
def suspicious_files(spark, sf):
    """V4: suspicious patterns anywhere in the content."""
    return files(spark, sf).select(
        "path", V.suspicious_content(F.col("content")).alias("suspicious")
    )


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hashes(spark, sf):
    """V5: SHA-256 of the content."""
    return I.table(spark, sf, "documents").select(
        "doc_id", X.content_hash(F.col("text")).alias("content_hash")
    )


@query(
    f"""WITH {FILES}, e AS (SELECT *, list_filter([
      CASE WHEN NOT {ALLOWED_SQL} THEN 'Unsupported file type: ' || ext || '. Allowed types: {", ".join(sorted(L.ALLOWED_EXTENSIONS))}' END,
      CASE WHEN size > 9000 THEN 'File size (' || {size_sql("size")} || ') exceeds maximum allowed size (8.8 KB)' END,
      CASE WHEN {SUSPICIOUS_SQL} THEN 'File contains suspicious content patterns. This file may be malicious and cannot be processed.' END
      ], lambda x: x IS NOT NULL) AS errors FROM named)
    SELECT path, len(errors) = 0 AS is_valid, list_aggregate(errors, 'string_agg', ' / ') AS errors,
      CASE WHEN {MIME_OK_SQL} THEN '' ELSE 'MIME type (' || coalesce(mime, '{L.DEFAULT_MIME}')
           || ') does not match file extension (' || ext || ')' END AS warnings,
      sha256(text) AS content_hash FROM e"""
)
def validated_files(spark, sf):
    """V6: all checks together (9000-byte limit here)."""
    v = V.validate_files(files(spark, sf), max_size=9000)
    return v.select(
        "path", "is_valid", "content_hash",
        F.nullif(F.array_join("errors", " / "), F.lit("")).alias("errors"),
        F.array_join("warnings", " / ").alias("warnings"),
    )


@query(
    f"""WITH {FILES} SELECT path,
      CASE WHEN ext IN ('.pdf', '.docx', '.pptx', '.epub', '.txt') THEN substr(ext, 2) ELSE 'other' END AS doc_type,
      CASE WHEN ext <> '' AND ends_with(name, ext) THEN left(name, len(name) - len(ext)) ELSE name END AS title
    FROM named"""
)
def document_types(spark, sf):
    """V8: document type and title from the file name."""
    return files(spark, sf).select(
        "path", V.doc_type(F.col("ext")).alias("doc_type"), V.title_of(F.col("path")).alias("title")
    )


OCR_FILES = """ocr_files AS (SELECT o_orderkey AS file_id, o_totalprice / 9000 AS size_mb,
  (o_custkey % 700)::INT AS pages FROM orders)"""


def ocr_files(spark, sf):
    """Orders as scans: price as size, customer number as page count."""
    return I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("file_id"),
        (F.col("o_totalprice") / 9000).alias("size_mb"),
        (F.col("o_custkey") % 700).cast("int").alias("pages"),
    )


@query(
    f"""WITH {OCR_FILES} SELECT file_id, CASE
      WHEN size_mb > 50 THEN printf('File is too large for OCR processing (%.1fMB). Maximum supported size is 50.0MB. Please use a smaller file or split the PDF into smaller parts.', size_mb)
      WHEN pages > 500 THEN printf('PDF has too many pages for OCR processing (%d pages). Maximum supported is 500 pages. Please split the PDF into smaller parts.', pages)
      END AS reason FROM ocr_files"""
)
def ocr_admission(spark, sf):
    """V9: why a scan is refused."""
    return ocr_files(spark, sf).select(
        "file_id", V.ocr_admissible(F.col("size_mb"), F.col("pages")).alias("reason")
    )


@query(
    f"""WITH {FILES} SELECT route, count(*) AS n, sum(size)::BIGINT AS bytes FROM (
      SELECT size, CASE WHEN ext = '.pdf' THEN 'pdf' WHEN ext IN ('.doc', '.docx') THEN 'docx'
        WHEN ext IN ('.ppt', '.pptx') THEN 'pptx' WHEN ext = '.epub' THEN 'epub'
        WHEN ext IN ('.txt', '.text', '.md') THEN 'text' ELSE 'unsupported' END AS route FROM named)
    GROUP BY route"""
)
def routed_files(spark, sf):
    """Files and bytes per extractor."""
    return (
        files(spark, sf)
        .groupBy(V.route(F.col("ext")).alias("route"))
        .agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    )
