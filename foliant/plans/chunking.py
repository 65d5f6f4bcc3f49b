"""Chunking queries over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunk as C
from . import inputs as I
from .registry import query

SIZE, OVER = C.CHUNK_SIZE, C.OVERLAP


def packed_sql(size: int, overlap: int, source: str = "documents") -> str:
    """CTEs up to ``packed(doc_id, hi, lo, sub, text)``: greedy packing as a walk over sentences."""
    return f"""sent AS MATERIALIZED (
      SELECT doc_id, i, s, {I.tokens_sql("s")} AS n FROM (
        SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS s
        FROM (SELECT doc_id, {I.sentences_sql("text")} AS l FROM {source}))),
    cum AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS before FROM sent),
    -- the earliest sentence that a chunk starting at i may carry over
    carry AS MATERIALIZED (
      SELECT a.doc_id, a.i, a.s, a.n, a.before, coalesce(min(b.i), a.i) AS carry
      FROM cum a LEFT JOIN cum b ON b.doc_id = a.doc_id AND b.i < a.i AND a.before - b.before <= {overlap}
      GROUP BY a.doc_id, a.i, a.s, a.n, a.before),
    walk AS (
      SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS start, NULL::BIGINT AS flush_from, NULL::BIGINT AS flush_to,
             false AS long FROM {source}
      UNION ALL
      SELECT w.doc_id, w.i + 1,
        CASE WHEN c.n > {size} THEN c.i + 1
             WHEN c.before - f.before + c.n > {size} AND w.start < c.i THEN greatest(w.start, c.carry) ELSE w.start END,
        CASE WHEN w.start < c.i AND (c.n > {size} OR c.before - f.before + c.n > {size}) THEN w.start END,
        CASE WHEN w.start < c.i AND (c.n > {size} OR c.before - f.before + c.n > {size}) THEN c.i END,
        c.n > {size}
      FROM walk w JOIN carry c ON c.doc_id = w.doc_id AND c.i = w.i
      LEFT JOIN cum f ON f.doc_id = w.doc_id AND f.i = w.start),
    ranges AS (
      SELECT doc_id, flush_from AS a, flush_to AS b FROM walk WHERE flush_from IS NOT NULL
      UNION ALL SELECT doc_id, i - 1, i FROM walk WHERE long
      UNION ALL SELECT doc_id, start, i FROM (SELECT doc_id, arg_max(start, i) AS start, max(i) AS i FROM walk GROUP BY doc_id)
        WHERE start < i),
    whole AS (
      SELECT r.doc_id, r.a, r.b, string_agg(s.s, ' ' ORDER BY s.i) AS text, max(s.n) AS n
      FROM ranges r JOIN sent s ON s.doc_id = r.doc_id AND s.i >= r.a AND s.i < r.b GROUP BY ALL),
    packed AS (
      SELECT doc_id, b AS hi, a AS lo, 0 AS sub, text FROM whole WHERE n <= {size}
      UNION ALL
      SELECT doc_id, b, a, k, array_to_string(w[k * {size - overlap} + 1 : k * {size - overlap} + {size}], ' ')
      FROM (SELECT doc_id, a, b, {I.words_sql("text")} AS w,
                   unnest(range(0, ceil((n - {size}) / {size - overlap})::BIGINT + 1)) AS k
            FROM whole WHERE n > {size})),
    chunked AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY hi, lo, sub) - 1 AS piece, text FROM packed)"""


@query(f"SELECT doc_id, {I.tokens_sql('text')} AS tokens FROM documents")
def token_counts(spark, sf):
    """Whitespace word count."""
    return I.texts(spark, sf, "documents").select("doc_id", X.count_tokens(F.col("text")).alias("tokens"))


@query(
    f"""SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS sentence
    FROM (SELECT doc_id, {I.sentences_sql("text")} AS l FROM documents)"""
)
def sentences(spark, sf):
    """Sentences of every document."""
    return I.texts(spark, sf, "documents").select(
        "doc_id", F.posexplode(X.split_sentences(F.col("text"))).alias("pos", "sentence")
    )


@query(f"WITH RECURSIVE {packed_sql(SIZE, OVER)} SELECT doc_id, piece, text FROM chunked")
def packed_sentences(spark, sf):
    """Greedy packing with carried sentences, default sizes."""
    return C.pack_sentences(I.texts(spark, sf, "documents"), ["doc_id"])


@query(f"WITH RECURSIVE {packed_sql(60, 20)} SELECT doc_id, piece, text FROM chunked")
def tightly_packed_sentences(spark, sf):
    """Small chunks, where carrying and long sentences happen often."""
    return C.pack_sentences(I.texts(spark, sf, "documents"), ["doc_id"], size=60, overlap=20)


@query(
    f"""SELECT doc_id, k AS pos, CASE WHEN len(w) <= 100 THEN text ELSE array_to_string(w[k * 80 + 1 : k * 80 + 100], ' ') END AS piece
    FROM (SELECT doc_id, text, w, unnest(range(0, greatest(ceil((len(w) - 100) / 80), 0)::BIGINT + 1)) AS k
          FROM (SELECT doc_id, text, {I.words_sql("text")} AS w FROM documents))"""
)
def word_windows(spark, sf):
    """C4: word windows of 100 stepping 80 over whole texts."""
    return I.texts(spark, sf, "documents").select(
        "doc_id", F.posexplode(X.word_windows(F.col("text"), 100, 20)).alias("pos", "piece")
    )


def structured(spark, sf):
    """Documents with every fourth line turned into a list item, table row or fence line."""
    parts = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when(i % 8 == 3, F.concat(F.lit("- "), x))
        .when(i % 8 == 5, F.concat(F.lit("| "), x, F.lit(" |")))
        .when(i % 16 == 7, F.concat(F.lit("```"), x))
        .otherwise(x),
    )
    return I.texts(spark, sf, "documents").select("doc_id", F.array_join(parts, "\n").alias("text"))


# line kinds, then a walk that carries the kind of the open block from line to line
BLOCKS_SQL = f"""line AS MATERIALIZED (
  SELECT doc_id, i, line, CASE WHEN starts_with({I.strip_sql("line")}, '|') THEN 'table'
      WHEN starts_with({I.strip_sql("line")}, '```') THEN 'code'
      WHEN regexp_matches(line, '^{I.WS_RE}*([-*•]|\\d+\\.){I.WS_RE}') THEN 'list' ELSE 'text' END AS kind,
    contains(line, '|') AS bar, {I.strip_sql("line")} = '' AS blank
  FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (
    SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 8 = 3 THEN '- ' || x
      WHEN (i - 1) % 8 = 5 THEN '| ' || x || ' |' WHEN (i - 1) % 16 = 7 THEN '```' || x ELSE x END) AS l FROM documents))),
ahead AS MATERIALIZED (SELECT *, lead(kind) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM line),
walk AS (
  SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS b, 'text' AS kind, false AS closed FROM documents
  UNION ALL
  SELECT l.doc_id, l.i, CASE WHEN stays THEN w.b ELSE w.b + 1 END, CASE WHEN stays THEN w.kind ELSE l.kind END,
    stays AND w.kind = 'code' AND l.kind = 'code'
  FROM walk w JOIN ahead l ON l.doc_id = w.doc_id AND l.i = w.i + 1,
  LATERAL (SELECT w.b > 0 AND CASE w.kind WHEN 'table' THEN l.bar WHEN 'code' THEN NOT w.closed
    WHEN 'list' THEN l.kind = 'list' OR (l.blank AND l.after = 'list') ELSE l.kind = 'text' END AS stays)),
block AS (
  SELECT w.doc_id, w.b, any_value(w.kind) AS type, string_agg(l.line, chr(10) ORDER BY l.i) AS raw
  FROM walk w JOIN line l ON l.doc_id = w.doc_id AND l.i = w.i GROUP BY w.doc_id, w.b),
kept AS (SELECT doc_id, b, type, CASE WHEN type = 'text' THEN {I.strip_sql("raw")} ELSE raw END AS content FROM block)"""


@query(
    f"""WITH RECURSIVE {BLOCKS_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS block, type,
      md5(content) AS content_md5 FROM kept WHERE content <> ''"""
)
def text_blocks(spark, sf):
    """Tables, code, lists and text in order."""
    return C.segment_blocks(structured(spark, sf)).select(
        "doc_id", "block", "type", F.md5("content").alias("content_md5")
    )


@query(
    f"""WITH RECURSIVE {BLOCKS_SQL.replace("walk AS", "block_walk AS").replace("FROM walk w", "FROM block_walk w")},
    sized AS MATERIALIZED (SELECT doc_id AS doc, b, type, content, type IN ('table', 'code')
        OR (type = 'list' AND {I.tokens_sql("content")} <= {SIZE * C.LIST_SLACK}) AS whole FROM kept WHERE content <> ''),
    unit AS MATERIALIZED (SELECT doc || '#' || b AS doc_id, content AS text FROM sized WHERE NOT whole),
    {packed_sql(SIZE, OVER, "unit")},
    pieces AS (
      SELECT doc, b, 0 AS piece, type, content AS text FROM sized WHERE whole
      UNION ALL SELECT s.doc, s.b, c.piece, s.type, c.text FROM sized s JOIN chunked c ON c.doc_id = s.doc || '#' || s.b)
    SELECT doc || '_chunk_' || row_number() OVER (PARTITION BY doc ORDER BY b, piece) - 1 AS chunk_id, type AS structure_type,
      {I.tokens_sql("text")} AS tokens, CASE WHEN type = 'text' THEN len({I.sentences_sql("text")}) END AS sentence_count,
      md5(text) AS text_md5 FROM pieces"""
)
def structured_chunks(spark, sf):
    """Chunks of documents with structure."""
    return C.chunk_documents(structured(spark, sf)).select(
        "chunk_id", "structure_type", "tokens", "sentence_count", F.md5("text").alias("text_md5")
    )


@query(
    f"""WITH RECURSIVE {packed_sql(SIZE, OVER)} SELECT doc_id || '_chunk_' || piece AS chunk_id, doc_id, piece AS position,
      'text' AS structure_type, {I.tokens_sql("text")} AS tokens, md5(text) AS text_md5 FROM chunked"""
)
def document_chunks(spark, sf):
    """Chunks of the documents as they are."""
    return C.chunk_documents(I.texts(spark, sf, "documents")).select(
        "chunk_id", "doc_id", "position", "structure_type", "tokens", F.md5("text").alias("text_md5")
    )


@query()
def character_pieces(spark, sf):
    """Recursive character splitting, 500 with 50 overlap."""
    return C.recursive_char_split(I.texts(spark, sf, "documents"))


@query(
    """SELECT doc_id, 'src' AS filename, doc_id::VARCHAR AS position, len(text)::VARCHAR AS tokens,
       CASE WHEN n_chars % 2 = 0 THEN 'special' ELSE 'generic' END AS chunk_type, NULL AS page,
       lang AS course, source AS extra, 'text' AS structure, 'false' AS has_table,
       CASE WHEN n_chars % 2 = 0 THEN 13 ELSE 12 END AS entries FROM documents"""
)
def chunk_metadata_fields(spark, sf):
    """Metadata of a chunk: own fields first, then the document's."""
    d = I.texts(spark, sf, "documents")
    even = F.col("n_chars") % 2 == 0
    base = F.create_map(
        F.lit("filename"), F.lit("src"), F.lit("courseId"), F.col("lang"),
        F.lit("source"), F.col("source"), F.lit("position"), F.lit("ignored"),
    )
    special = F.map_concat(base, F.create_map(F.lit("chunk_type"), F.lit("special"), F.lit("docType"), F.lit("txt")))
    chunks = d.select(
        "doc_id",
        F.col("doc_id").alias("position"),
        F.length("text").alias("tokens"),
        F.lit("text").alias("structure_type"),
        F.lit(2).alias("sentence_count"),
        *[F.lit(False).alias(f"has_{k}") for k in ("table", "list", "code")],
        F.when(even, special).otherwise(base).alias("doc_metadata"),
    )
    m = F.col("metadata")
    return C.chunk_metadata(chunks).select(
        "doc_id", m["filename"].alias("filename"), m["position"].alias("position"),
        m["tokens"].alias("tokens"), m["chunk_type"].alias("chunk_type"), m["page"].alias("page"),
        m["courseId"].alias("course"), m["source"].alias("extra"),
        m["structure_type"].alias("structure"), m["has_table"].alias("has_table"),
        F.size(m).alias("entries"),
    )
