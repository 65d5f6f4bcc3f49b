"""Retrieval queries over the stored vectors and their documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..operators import retrieve as R
from ..operators.knn import cosine, knn
from . import inputs as I
from .registry import query

CODE_SQL = " OR ".join(
    [f"contains(text, '{k}')" for k in L.CODE_FENCES]
    + [f"contains(lower(text), '{k}')" for k in L.CODE_KEYWORDS]
    + [
        "(len(string_split(text, chr(10))) > 3 AND len(list_filter(string_split(text, chr(10)), "
        "lambda l: starts_with(l, '    ') OR starts_with(l, chr(9)))) "
        "/ len(string_split(text, chr(10))) > 0.3)"
    ]
)
HITS_SQL = " + ".join(f"contains(lower(text), '{k}')::INT" for k in L.CONCEPT_KEYWORDS)
BOOST_SQL = (
    f"CASE WHEN mode = 'coding' AND ({CODE_SQL}) THEN 1.2::DOUBLE "
    f"WHEN mode = 'thinking' AND ({HITS_SQL}) >= 2 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END"
)


GRAMS_SQL = f"""gram AS MATERIALIZED (
  SELECT DISTINCT chunk_id, substr(t, i::INT, 3) AS g
  FROM (SELECT chunk_id, t, unnest(range(1, len(t) - 1)) AS i
        FROM (SELECT chunk_id, {I.strip_sql("lower(text)")} AS t FROM chunks))),
sizes AS MATERIALIZED (SELECT chunk_id, count(*) AS n FROM gram GROUP BY chunk_id)"""

# walk each query's candidates in order, keeping those not near an earlier kept one
KEPT_SQL = """pairs AS MATERIALIZED (
  SELECT a.query_id, a.rank, b.rank AS earlier, a.chunk_id AS ca, b.chunk_id AS cb,
         na.n AS na, nb.n AS nb
  FROM scored a JOIN scored b ON b.query_id = a.query_id AND b.rank < a.rank
  JOIN sizes na ON na.chunk_id = a.chunk_id JOIN sizes nb ON nb.chunk_id = b.chunk_id
  WHERE least(na.n, nb.n) / greatest(na.n, nb.n) > 0.92),
shared AS MATERIALIZED (
  SELECT p.ca, p.cb, count(*) AS both
  FROM (SELECT DISTINCT ca, cb FROM pairs) p
  JOIN gram x ON x.chunk_id = p.ca JOIN gram y ON y.chunk_id = p.cb AND y.g = x.g
  GROUP BY p.ca, p.cb),
alike AS (
  SELECT p.query_id, p.rank, list(p.earlier) AS near
  FROM pairs p JOIN shared s ON s.ca = p.ca AND s.cb = p.cb
  WHERE s.both / (p.na + p.nb - s.both) > 0.92 GROUP BY p.query_id, p.rank),
near AS MATERIALIZED (
  SELECT s.query_id, s.rank, coalesce(m.near, []) AS near
  FROM scored s LEFT JOIN alike m ON m.query_id = s.query_id AND m.rank = s.rank),
walk AS (
  SELECT query_id, 0::BIGINT AS rank, []::BIGINT[] AS kept FROM scored WHERE rank = 1
  UNION ALL
  SELECT w.query_id, w.rank + 1,
         CASE WHEN list_has_any(w.kept, n.near) THEN w.kept ELSE list_append(w.kept, n.rank) END
  FROM walk w JOIN near n ON n.query_id = w.query_id AND n.rank = w.rank + 1),
kept AS (
  SELECT s.* FROM scored s
  JOIN (SELECT query_id, arg_max(kept, rank) AS kept FROM walk GROUP BY query_id) k
    ON k.query_id = s.query_id AND list_contains(k.kept, s.rank))"""

FINAL_SQL = f"""final AS (
  SELECT query_id, chunk_id, top_k, score * {BOOST_SQL} AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY score * {BOOST_SQL} DESC, chunk_id) AS place
  FROM (SELECT k.*, c.text FROM kept k JOIN chunks c ON c.chunk_id = k.chunk_id)
  QUALIFY place <= top_k)"""

SEARCH_SQL = f"""WITH RECURSIVE {I.CHUNKS}, {I.QUERIES}, {I.CANDIDATES},
scored AS MATERIALIZED (SELECT * FROM cand WHERE score >= threshold), {GRAMS_SQL}, {KEPT_SQL}, {FINAL_SQL}"""


def _out(df, *extra):
    return df.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", *extra)


@query(
    f"""WITH {I.CHUNKS}, {I.QUERIES}, {I.CANDIDATES}
    SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM cand
    WHERE rank <= 10 AND score >= 0.15"""
)
def nearest_chunks(spark, sf):
    """Exact cosine top 10 above the default threshold, every vector as a query."""
    found = knn(I.vector_queries(spark, sf), I.chunks(spark, sf), n=10)
    return _out(found.where(F.col("score") >= L.DEFAULT_THRESHOLD))


@query(
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)
       AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def cosine_of_neighbours(spark, sf):
    """Cosine similarity of every vector and the next one."""
    e = I.table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select(
        "vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity")
    )


@query(
    f"""WITH {I.CHUNKS}, {I.QUERIES}, {I.CANDIDATES}
    SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM cand"""
)
def candidate_search(spark, sf):
    """R2: candidates per query, twice the wanted count within 12..50."""
    q = R.apply_mode_config(I.vector_queries(spark, sf))
    return _out(knn(q, I.chunks(spark, sf)))


@query(
    f"""WITH {I.CHUNKS}, {I.QUERIES}, {I.CANDIDATES}
    SELECT query_id, chunk_id, round(score, 6) AS score FROM cand WHERE score >= threshold"""
)
def above_threshold(spark, sf):
    """Candidates at or above their query's threshold."""
    q = R.apply_mode_config(I.vector_queries(spark, sf))
    found = knn(q, I.chunks(spark, sf)).join(q.select("query_id", "threshold"), "query_id")
    return R.threshold_filter(found).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score")
    )


@query(
    f"""WITH {I.CHUNKS}
    SELECT doc_id, count(*) AS n, min(chunk_id) AS first_chunk FROM chunks
    WHERE filename = 'src3' GROUP BY doc_id"""
)
def metadata_filtered_chunks(spark, sf):
    """Equality on chunk metadata before anything else."""
    kept = R.metadata_filter(I.chunks(spark, sf), filename="src3")
    return kept.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min("chunk_id").alias("first_chunk")
    )


@query(
    f"""WITH t AS (SELECT conv_id, turn,
      list_distinct(list_transform(range(1, len(s) - 1), lambda i: substr(s, i, 3))) AS g
      FROM (SELECT conv_id, turn, {I.strip_sql("lower(text)")} AS s FROM conversations))
    SELECT a.conv_id, a.turn, CASE WHEN len(a.g) = 0 OR len(b.g) = 0 THEN 0.0 ELSE round(
      len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) END
      AS similarity
    FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1"""
)
def turn_similarity(spark, sf):
    """Trigram Jaccard of every turn with the turn before it."""
    t = I.texts(spark, sf, "conversations").select(
        "conv_id", "turn", X.trigrams(F.col("text")).alias("g")
    )
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("g").alias("h"))
    return t.join(before, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(X.jaccard(F.col("g"), F.col("h")), 6).alias("similarity")
    )


@query(f"SELECT doc_id, ({CODE_SQL}) AS has_code FROM documents")
def code_documents(spark, sf):
    """Does the text look like code?"""
    return I.table(spark, sf, "documents").select(
        "doc_id", X.contains_code(F.col("text")).alias("has_code")
    )


@query(
    f"""SELECT doc_id, {HITS_SQL} AS concept_hits, ({HITS_SQL}) >= 2 AS conceptual
    FROM documents"""
)
def conceptual_documents(spark, sf):
    """At least two concept words as substrings."""
    return I.table(spark, sf, "documents").select(
        "doc_id",
        X.concept_hits(F.col("text")).alias("concept_hits"),
        X.is_conceptual(F.col("text")).alias("conceptual"),
    )


@query(
    f"""WITH {I.CHUNKS}, {I.QUERIES}, {I.CANDIDATES}
    SELECT query_id, chunk_id, round(score * {BOOST_SQL}, 6) AS score
    FROM (SELECT cand.*, c.text FROM cand JOIN chunks c ON c.chunk_id = cand.chunk_id)"""
)
def mode_boosted(spark, sf):
    """Code texts count more in coding mode, conceptual texts in thinking mode."""
    q = R.apply_mode_config(I.vector_queries(spark, sf))
    c = I.chunks(spark, sf)
    found = R.with_text(knn(q, c), q, c)
    return R.boosted(found).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"{SEARCH_SQL} SELECT query_id, chunk_id, rank AS candidate_rank FROM kept")
def without_near_duplicates(spark, sf):
    """Greedy near-duplicate removal among each query's candidates."""
    q = R.apply_mode_config(I.vector_queries(spark, sf))
    c = I.chunks(spark, sf)
    found = R.threshold_filter(R.with_text(knn(q, c), q, c))
    return R.remove_near_dups(found).select(
        "query_id", "chunk_id", F.col("rank").alias("candidate_rank")
    )


@query(f"{SEARCH_SQL} SELECT query_id, chunk_id, round(score, 6) AS score, place AS rank FROM final")
def retrieve_chunks(spark, sf):
    """The whole search for every query."""
    return _out(R.retrieve(I.vector_queries(spark, sf), I.chunks(spark, sf)))


@query(
    f"""{SEARCH_SQL},
    f AS (SELECT query_id, count(*) AS returned, avg(score) AS avg_final_score FROM final GROUP BY query_id),
    k AS (SELECT query_id, count(*) AS after_dedup FROM kept GROUP BY query_id)
    SELECT c.query_id, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score,
           round(avg(score), 6) AS avg_score, count(*) AS candidates,
           count(*) FILTER (score >= threshold) AS above_threshold,
           coalesce(any_value(k.after_dedup), 0) AS after_dedup,
           coalesce(any_value(f.returned), 0) AS returned,
           round(any_value(f.avg_final_score), 6) AS avg_final_score
    FROM cand c LEFT JOIN k ON k.query_id = c.query_id LEFT JOIN f ON f.query_id = c.query_id
    GROUP BY c.query_id"""
)
def retrieval_statistics(spark, sf):
    """Scores and row counts after each stage."""
    s = R.retrieval_stats(I.vector_queries(spark, sf), I.chunks(spark, sf))
    for c in ("min_score", "max_score", "avg_score", "avg_final_score"):
        s = s.withColumn(c, F.round(c, 6))
    return s


@query(
    f"""WITH RECURSIVE {I.CHUNKS}, {I.QUERIES},
    named AS (SELECT query_id AS asked, top_k, mode, threshold, qvec, unnest(document_ids) AS doc_id,
                     generate_subscripts(document_ids, 1) - 1 AS doc_order FROM queries),
    cand AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
      FROM (SELECT n.asked || '/' || n.doc_id AS query_id, n.asked, n.doc_id, n.doc_order, n.top_k, n.mode,
                   n.threshold, c.chunk_id, round(list_cosine_similarity(n.qvec, c.embedding), 9) AS score
            FROM named n JOIN chunks c ON c.doc_id = n.doc_id)
      QUALIFY rank <= least(greatest(2 * top_k, 12), 50)),
    scored AS MATERIALIZED (SELECT * FROM cand WHERE score >= threshold), {GRAMS_SQL}, {KEPT_SQL},
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS place
      FROM (SELECT k.* EXCLUDE (rank), score * {BOOST_SQL} AS s
            FROM kept k JOIN (SELECT chunk_id, text FROM chunks) c USING (chunk_id))
      QUALIFY place <= top_k)
    SELECT asked AS query_id, chunk_id, doc_id, round(s, 6) AS score,
           row_number() OVER (PARTITION BY asked ORDER BY s DESC, doc_order, chunk_id) AS rank
    FROM ranked QUALIFY rank <= top_k"""
)
def retrieve_by_document(spark, sf):
    """One search per named document without its near duplicates, merged per query."""
    found = R.retrieve_multi_doc(I.vector_queries(spark, sf), I.chunks(spark, sf))
    return _out(found, "doc_id")


@query(
    f"""WITH {I.CHUNKS}, e AS (
      SELECT chunk_id AS query_id, * FROM chunks
      WHERE (courseId IS NULL OR courseId = 'fr') AND (chatId = '' OR chatId = 'src3'))
    SELECT query_id, chunk_id, coalesce(documentTitle, filename, 'Unknown') AS document_title,
           doc_id AS document_id, coalesce(courseId, 'fr') AS course_id,
           coalesce(nullif(chatId, ''), 'src3') AS chat_id, len(text) AS chars
    FROM e"""
)
def scoped_excerpts(spark, sf):
    """Chunks as excerpts visible in one course and chat."""
    hits = I.chunks(spark, sf).withColumn("query_id", F.col("chunk_id"))
    return R.to_excerpts(hits, "fr", "src3").select(
        "query_id",
        "chunk_id",
        F.col("documentTitle").alias("document_title"),
        F.col("documentId").alias("document_id"),
        F.col("courseId").alias("course_id"),
        F.col("chatId").alias("chat_id"),
        F.length("text").alias("chars"),
    )


ASKED_SQL = """asked AS (
  SELECT event_id AS query_id, CASE WHEN event_type = 'click' THEN '  ' ELSE event_type || ' ' || user_id END AS query,
         (floor(value))::INT AS top_k, round(value / 10, 2) AS threshold,
         CASE event_type WHEN 'view' THEN 'coding' WHEN 'error' THEN 'thinking' WHEN 'signup' THEN 'files' END AS mode
  FROM events)"""


def asked(spark, sf):
    """Events as questions: blank ones, and counts and thresholds in and out of range."""
    t = F.col("event_type")
    return I.table(spark, sf, "events").select(
        F.col("event_id").alias("query_id"),
        F.when(t == "click", "  ").otherwise(F.concat_ws(" ", t, "user_id")).alias("query"),
        F.floor("value").cast("int").alias("top_k"),
        F.round(F.col("value") / 10, 2).alias("threshold"),
        F.when(t == "view", "coding").when(t == "error", "thinking").when(t == "signup", "files")
        .alias("mode"),
    )


@query(
    f"""WITH {ASKED_SQL}
    SELECT query_id, CASE WHEN trim(query) = '' THEN 'query is empty'
      WHEN top_k < 1 OR top_k > 50 THEN 'top_k must be 1..50'
      WHEN threshold < 0 OR threshold > 1 THEN 'threshold must be 0..1' END AS reject_reason
    FROM asked"""
)
def rejected_queries(spark, sf):
    """Every query with the first rule it breaks."""
    return R.validate_queries(asked(spark, sf)).select("query_id", "reject_reason")


@query(
    f"""WITH {ASKED_SQL}
    SELECT query_id, coalesce(mode, 'files') AS mode,
           coalesce(nullif(top_k, 0), CASE mode WHEN 'coding' THEN 8 WHEN 'thinking' THEN 6 ELSE 10 END) AS top_k,
           CASE mode WHEN 'coding' THEN 0.5 WHEN 'thinking' THEN 0.7 ELSE 0.3 END::DOUBLE AS temperature,
           CASE mode WHEN 'coding' THEN 'concise' WHEN 'thinking' THEN 'exploratory' ELSE 'detailed' END
             AS context_strategy
    FROM asked"""
)
def configured_queries(spark, sf):
    """Mode defaults for what a query leaves open."""
    q = asked(spark, sf).withColumn("top_k", F.nullif("top_k", F.lit(0)))
    return R.apply_mode_config(q).select(
        "query_id", "mode", "top_k", "temperature", "context_strategy"
    )
