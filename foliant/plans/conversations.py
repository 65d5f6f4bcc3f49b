"""Conversation queries: chat = conversation, position = turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..operators import messages as M
from . import files as PF
from . import inputs as I
from .registry import query

MSG = ["course_id", "chat_id", "seq"]
REPEATED = f"""{I.MESSAGES}, repeated AS (
  SELECT * FROM messages UNION ALL
  SELECT course_id, chat_id, seq + 1000, sender, content,
         CASE WHEN seq % 4 = 1 THEN '[]' ELSE citations END FROM messages)"""


def repeated(spark, sf):
    """Every message a second time, every other bot one with other citations."""
    m = I.messages(spark, sf)
    again = m.withColumn(
        "citations", F.when(F.col("seq") % 4 == 1, "[]").otherwise(F.col("citations"))
    ).withColumn("seq", F.col("seq") + 1000)
    return m.unionByName(again)


@query(
    f"""WITH {REPEATED} SELECT course_id, chat_id, seq, sender, content FROM repeated
    QUALIFY row_number() OVER (PARTITION BY course_id, chat_id, sender, content,
      CASE WHEN sender = 'bot' THEN citations END ORDER BY seq) = 1"""
)
def deduplicated_messages(spark, sf):
    """M1: repeated messages dropped."""
    return M.dedup_messages(repeated(spark, sf)).select(*MSG, "sender", "content")


@query(
    f"""WITH {I.MESSAGES} SELECT course_id, chat_id, seq FROM messages
    QUALIFY row_number() OVER (PARTITION BY course_id, chat_id ORDER BY seq DESC) BETWEEN 2 AND 4"""
)
def messages_from_end(spark, sf):
    """M2: three messages before the newest one."""
    return M.page_newest_first(I.messages(spark, sf), limit=3, offset=1).select(*MSG)


@query(
    f"""WITH {I.MESSAGES} SELECT course_id, chat_id, seq FROM messages
    QUALIFY row_number() OVER (PARTITION BY course_id, chat_id ORDER BY seq DESC) BETWEEN 2 AND 5001"""
)
def messages_from_end_deep(spark, sf):
    """M2: a page deeper than the pruned rank limit, numbered block by block."""
    return M.page_newest_first(I.messages(spark, sf), limit=5000, offset=1).select(*MSG)


@query(
    f"""WITH {I.MESSAGES}, n AS (SELECT *, row_number() OVER (PARTITION BY course_id, chat_id ORDER BY seq) AS r,
      count(*) OVER (PARTITION BY course_id, chat_id) AS total_messages FROM messages)
    SELECT course_id, chat_id, seq, total_messages, ceil(total_messages / 3)::BIGINT AS total_pages,
      2 < ceil(total_messages / 3) AS has_next, true AS has_prev FROM n WHERE r BETWEEN 4 AND 6"""
)
def second_page(spark, sf):
    """M3: page two of three messages."""
    return M.paginate(I.messages(spark, sf), page=2, page_size=3).select(
        *MSG, "total_messages", "total_pages", "has_next", "has_prev"
    )


@query(
    f"""WITH {I.MESSAGES} SELECT course_id, chat_id, count(*) AS messages, count(*) FILTER (sender = 'human') AS human,
    count(*) FILTER (sender = 'bot') AS bot FROM messages GROUP BY ALL"""
)
def message_counts(spark, sf):
    """M4: messages per chat and sender."""
    return M.message_counts(I.messages(spark, sf))


@query(
    f"""WITH {I.MESSAGES} SELECT course_id, chat_id, seq, row_number() OVER (PARTITION BY course_id, chat_id
    ORDER BY seq DESC) AS age FROM messages QUALIFY age <= 3"""
)
def recent_messages(spark, sf):
    """M5: the last three messages of every chat."""
    return M.recent_messages(I.messages(spark, sf), 3).select(*MSG, "age")


def window_sql(last, budget, cost, skip=False, drop=False):
    return f"""aged AS (SELECT *, {cost} AS cost,
        row_number() OVER (PARTITION BY course_id, chat_id ORDER BY seq DESC) AS age FROM messages),
    summed AS (SELECT *, sum(cost) OVER (PARTITION BY course_id, chat_id ORDER BY age)::BIGINT AS used
      FROM aged WHERE age <= {last + skip} AND ({not skip} OR age > 1)),
    win AS (SELECT * FROM summed WHERE {"true" if budget is None else f"used <= {budget}"} AND ({not drop} OR age > 1))"""


def _context(name: str, tight: int | None = None):
    last, budget, cost, skip, drop = M.context_profile(name)

    def run(spark, sf):
        w = M.context_window(I.messages(spark, sf), last, tight or budget, cost, skip, drop)
        return w.select(*MSG, "age", "used")

    return run


@query(
    f"WITH {I.MESSAGES}, {window_sql(8, 4096, 'len(content) // 4')} SELECT course_id, chat_id, seq, age, used FROM win"
)
def context_history(spark, sf):
    """M6: eight messages, 4096 tokens."""
    return _context("history")(spark, sf)


@query(
    f"WITH {I.MESSAGES}, {window_sql(20, 300, 'ceil(len(content) / 4)', skip=True)} SELECT course_id, chat_id, seq, age, used FROM win"
)
def context_optimized(spark, sf):
    """M6: twenty messages before the newest, a tight 300 tokens."""
    return _context("optimized", 300)(spark, sf)


@query(
    f"WITH {I.MESSAGES}, {window_sql(6, 1500, 'len(content)', drop=True)} SELECT course_id, chat_id, seq, age, used FROM win"
)
def context_direct(spark, sf):
    """M6: six messages, the newest counted but left out, a tight 1500 characters."""
    return _context("direct", 1500)(spark, sf)


@query(
    f"WITH {I.MESSAGES}, {window_sql(8, None, '0')} SELECT course_id, chat_id, seq, age, used FROM win"
)
def context_plain(spark, sf):
    """M6: eight messages without a budget."""
    return _context("plain")(spark, sf)


@query(
    f"""WITH {I.MESSAGES}, {window_sql(8, 400, 'len(content) // 4')},
    u AS (SELECT course_id, chat_id, count(*) AS n, sum(cost)::BIGINT AS t FROM win GROUP BY ALL)
    SELECT m.course_id, m.chat_id, coalesce(any_value(u.n), 0) AS message_count, count(*) AS total_messages,
      coalesce(any_value(u.t), 0) AS tokens_used, 400 - coalesce(any_value(u.t), 0) AS tokens_remaining,
      round(coalesce(any_value(u.t), 0) / 400 * 100, 6) AS usage_percent, coalesce(any_value(u.t), 0) > 320 AS near_limit
    FROM messages m LEFT JOIN u ON u.chat_id = m.chat_id GROUP BY m.course_id, m.chat_id"""
)
def context_usage(spark, sf):
    """M7: how full the window is (400 tokens here)."""
    m = I.messages(spark, sf)
    last, _, cost, *_ = M.context_profile("history")
    out = M.context_usage(m, M.context_window(m, last, 400, cost), 400)
    return out.withColumn("usage_percent", F.round("usage_percent", 6))


@query(f"WITH {I.MESSAGES} SELECT course_id, chat_id, seq FROM messages WHERE contains(lower(content), 'tion')")
def found_messages(spark, sf):
    """M8: substring search, any case."""
    return M.search_messages(I.messages(spark, sf), "TION").select(*MSG)


SEARCH = f"""q AS (
  SELECT item_id AS query_id, text AS query FROM benchmark
  UNION ALL SELECT DISTINCT 100000 + substr(source, 4)::BIGINT, ' S' || substr(source, 2) || ' ' FROM documents
  UNION ALL SELECT 200000, '  ' FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)),
needles AS (SELECT *, {I.strip_sql("lower(query)")} AS needle FROM q WHERE trim(query) <> ''),
chats AS (SELECT lang AS course_id, source AS chat_id, CASE WHEN source = 'src5' THEN 'Src1' ELSE 'About ' || source END AS title,
  max(doc_id) AS latest_activity FROM documents GROUP BY ALL),
hits AS (
  SELECT n.query_id, d.lang AS course_id, d.source AS chat_id,
    arg_min(CASE WHEN s > 1 THEN '...' ELSE '' END || substr(text, s, e - s + 1) || CASE WHEN e < len(text) THEN '...' ELSE '' END, doc_id) AS snippet
  FROM (SELECT n.query_id, d.*, greatest(strpos(lower(text), needle) - 50, 1) AS s,
               least(strpos(lower(text), needle) + len(needle) + 49, len(text)) AS e
        FROM needles n JOIN documents d ON contains(lower(d.text), n.needle)) d JOIN needles n ON n.query_id = d.query_id
  GROUP BY ALL),
titled AS (SELECT n.query_id, c.course_id, c.chat_id, lower(c.title) = n.needle AS exact
  FROM needles n JOIN chats c ON contains(lower(c.title), n.needle))"""


@query(
    f"""WITH {SEARCH} SELECT query_id, course_id, chat_id, c.title, CASE WHEN t.exact THEN 'exact-title'
      WHEN t.exact IS NOT NULL THEN 'partial-title' ELSE 'content' END AS match_type,
      CASE WHEN t.exact IS NOT NULL THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS score, snippet,
      left(snippet, strpos(lower(snippet), n.needle) - 1) AS before,
      substr(snippet, strpos(lower(snippet), n.needle), len(n.query)) AS match,
      substr(snippet, strpos(lower(snippet), n.needle) + len(n.query)) AS after
    FROM titled t FULL JOIN hits h USING (query_id, course_id, chat_id)
    JOIN chats c USING (course_id, chat_id) JOIN needles n USING (query_id)"""
)
def chat_search(spark, sf):
    """M9: passages and names searched in all chats; here documents are messages, sources chats."""
    d, b = I.texts(spark, sf, "documents"), I.table(spark, sf, "benchmark")
    names = d.select("source").distinct().select(
        (F.substring("source", 4, 9).cast("long") + 100000).alias("query_id"),
        F.concat(F.lit(" S"), F.substring("source", 2, 9), F.lit(" ")).alias("query"),
    )
    asked = b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    blank = b.agg(F.min("item_id")).select(F.lit(200000).cast("long").alias("query_id"), F.lit("  ").alias("query"))
    chats = d.groupBy(F.col("lang").alias("course_id"), F.col("source").alias("chat_id")).agg(
        F.max("doc_id").alias("latest_activity")
    ).withColumn(
        "title",
        F.when(F.col("chat_id") == "src5", "Src1").otherwise(F.concat(F.lit("About "), "chat_id")),
    )
    messages = d.select(
        F.col("lang").alias("course_id"), F.col("source").alias("chat_id"),
        F.col("doc_id").alias("seq"), F.col("text").alias("content"),
    )
    found = M.search_chats(asked.unionByName(names).unionByName(blank), chats, messages)
    return found.select(
        "query_id", "course_id", "chat_id", "title", "match_type", "score", "snippet", "before", "match", "after"
    )


@query(
    f"""WITH {I.MESSAGES} SELECT course_id, count(DISTINCT chat_id) AS chats, max(chat_id) AS last_indexed, count(*) AS messages
    FROM messages GROUP BY course_id"""
)
def search_index(spark, sf):
    """Size of the search index per course."""
    m = I.messages(spark, sf)
    chats = m.groupBy("course_id", "chat_id").agg(F.max("chat_id").alias("latest_activity"))
    return M.search_index_stats(m, chats)


REFERENCE_RE = r"\b(" + "|".join(L.REFERENCE_TERMS) + r")\b"


@query(
    f"""WITH {I.MESSAGES} SELECT course_id, chat_id, seq, regexp_matches(lower(content), '{REFERENCE_RE}') AS refers
    FROM messages"""
)
def context_references(spark, sf):
    """Messages that refer back."""
    return I.messages(spark, sf).select(*MSG, X.has_reference(F.col("content")).alias("refers"))


@query(
    f"""WITH {I.MESSAGES}, n AS (SELECT course_id, chat_id, arg_max(content, seq) AS c, count(*) - 1 AS prior FROM messages GROUP BY ALL)
    SELECT course_id, chat_id, prior, regexp_matches(lower(c), '{REFERENCE_RE}') AS refers,
      prior >= 2 AND regexp_matches(lower(c), '{REFERENCE_RE}') AS needed FROM n"""
)
def contextualisation(spark, sf):
    """Chats whose newest message needs its context."""
    return M.needs_contextualisation(I.messages(spark, sf))


SOURCES = """sources AS (
  SELECT c.conv_id AS query_id, c.turn + 1 AS rank, d.text, d.source AS filename,
    CASE WHEN turn % 2 = 1 THEN turn END AS page, CASE WHEN turn % 3 = 0 THEN d.lang ELSE '' END AS heading
  FROM conversations c JOIN documents d ON d.doc_id = c.conv_id * 3 + c.turn)"""


def sources(spark, sf):
    """Documents as the ranked sources of a conversation's question."""
    c, d = I.table(spark, sf, "conversations"), I.table(spark, sf, "documents")
    turn = F.col("turn")
    return c.select("conv_id", "turn", (F.col("conv_id") * 3 + turn).alias("doc_id")).join(
        d, "doc_id"
    ).select(
        F.col("conv_id").alias("query_id"), (turn + 1).alias("rank"), "text",
        F.col("source").alias("filename"), F.when(turn % 2 == 1, turn).alias("page"),
        F.when(turn % 3 == 0, F.col("lang")).otherwise("").alias("heading"),
    )


def modes(spark):
    """Short system texts; the caller supplies the real ones."""
    return spark.createDataFrame(
        [("files", "Answer from the files."), ("coding", "Teach code."), ("thinking", "Ask back.")],
        "mode string, system_prompt string",
    )


MODE_SQL = """CASE conv_id % 3 WHEN 0 THEN 'files' WHEN 1 THEN 'coding' ELSE 'thinking' END"""
SYSTEM_SQL = "CASE {m} WHEN 'files' THEN 'Answer from the files.' WHEN 'coding' THEN 'Teach code.' ELSE 'Ask back.' END"


def _mode():
    k = F.col("conv_id") % 3
    return F.when(k == 0, "files").when(k == 1, "coding").otherwise("thinking")


def questions(spark, sf):
    """The last user turn of every conversation."""
    c = I.table(spark, sf, "conversations")
    return (
        c.where("role = 'user'")
        .groupBy("conv_id")
        .agg(F.max_by("text", "turn").alias("query"))
        .select(
            F.col("conv_id").alias("query_id"),
            "query",
            _mode().alias("mode"),
            F.concat(F.lit("course"), F.col("conv_id") % 5).alias("course_id"),
            F.col("conv_id").alias("chat_id"),
        )
    )


@query(
    f"""WITH {I.MESSAGES}, {SOURCES},
    q AS (SELECT conv_id, arg_max(text, turn) AS query, {MODE_SQL} AS mode FROM conversations WHERE role = 'user' GROUP BY conv_id),
    ctx AS (SELECT query_id, string_agg('Source ' || rank || ' [' || filename || ' - ' ||
        CASE WHEN page IS NULL THEN 'N/A' ELSE 'Page ' || page END || ']' ||
        CASE WHEN heading <> '' THEN ' (' || heading || ')' ELSE '' END || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS ctx
      FROM sources GROUP BY query_id),
    h AS (SELECT chat_id, string_agg(CASE WHEN sender = 'human' THEN 'User: ' ELSE 'Assistant: ' END || content, chr(10) ORDER BY seq) AS h
      FROM (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY seq DESC) <= 8) GROUP BY chat_id)
    SELECT conv_id AS query_id, concat_ws(chr(10) || chr(10), '# System Instructions' || chr(10) || {SYSTEM_SQL.format(m="mode")},
      '# Retrieved Context' || chr(10) || chr(10) || ctx, '# Conversation History' || chr(10) || h,
      '# Current Question' || chr(10) || 'User: ' || query || chr(10) || chr(10) || 'Assistant:') AS prompt
    FROM q LEFT JOIN ctx ON ctx.query_id = q.conv_id LEFT JOIN h ON h.chat_id = q.conv_id"""
)
def prompts(spark, sf):
    """Prompts with sources and history."""
    return M.build_prompts(questions(spark, sf), sources(spark, sf), I.messages(spark, sf), modes(spark))


@query(
    f"""WITH {SOURCES}, ctx AS (SELECT query_id, string_agg('[Document ' || n || ': ' || filename || ']' || chr(10) || text,
        chr(10) || chr(10) ORDER BY n) AS context
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM sources) GROUP BY query_id),
    q AS (SELECT conv_id, arg_max(text, turn) AS message, {MODE_SQL} AS mode FROM conversations WHERE role = 'user' GROUP BY conv_id)
    SELECT conv_id AS query_id, CASE WHEN context IS NOT NULL
      THEN (CASE mode WHEN 'coding' THEN 'C+ ' ELSE 'D+ ' END) || context || ' ? ' || message
      ELSE (CASE mode WHEN 'coding' THEN 'C- ' ELSE 'D- ' END) || message END AS prompt
    FROM q LEFT JOIN ctx ON ctx.query_id = q.conv_id"""
)
def templated_prompts(spark, sf):
    """Context block in the mode's template; modes without one use the default."""
    templates = spark.createDataFrame(
        [("coding", "C+ {context} ? {question}", "C- {message}", "C"),
         ("default", "D+ {context} ? {question}", "D- {message}", "D")],
        "mode string, with_context string, without_context string, base string",
    )
    blocks = M.build_context_block(sources(spark, sf).withColumnRenamed("filename", "document_title"))
    q = questions(spark, sf).select(
        "query_id", "mode", F.lit(None).cast("string").alias("question"), F.col("query").alias("message")
    )
    return M.apply_templates(q, blocks, templates)


@query(
    f"""WITH {I.MESSAGES}, {window_sql(6, 4000, 'len(content)', drop=True)},
    e AS (SELECT chat_id, string_agg((CASE WHEN sender = 'human' THEN 'user' ELSE 'assistant' END) || '>' || content, '|' ORDER BY seq) AS e
      FROM win GROUP BY chat_id),
    n AS (SELECT course_id, chat_id, arg_max(content, seq) AS now FROM messages GROUP BY ALL)
    SELECT n.course_id, n.chat_id, concat_ws('|', 'system>Be brief.', e, 'user>' || now) AS payload
    FROM n LEFT JOIN e ON e.chat_id = n.chat_id"""
)
def chat_payloads(spark, sf):
    """Role and content lists for the model."""
    m = I.messages(spark, sf)
    last, budget, cost, skip, drop = M.context_profile("direct")
    window = M.context_window(m, last, budget, cost, skip, drop)
    current = m.groupBy("course_id", "chat_id").agg(F.max_by("content", "seq").alias("content"))
    p = current.select("course_id", "chat_id", F.lit("Be brief.").alias("prompt"))
    out = M.build_chat_payload(p, window, current)
    turn = F.transform("messages", lambda x: F.concat_ws(">", x["role"], x["content"]))
    return out.select("course_id", "chat_id", F.array_join(turn, "|").alias("payload"))


@query(
    """SELECT doc_id, replace(replace(text, '{', '{{'), '}', '}}') AS escaped FROM documents"""
)
def escaped_texts(spark, sf):
    """Braces doubled for templating."""
    return I.table(spark, sf, "documents").select(
        "doc_id", M.escape_braces(F.col("text")).alias("escaped")
    )


@query(
    f"""WITH {PF.TOKENS}, r AS (SELECT *, sum(len(token)) OVER (PARTITION BY conv_id ORDER BY turn * 100000 + seq)::BIGINT AS upto FROM tokens),
    k AS (SELECT conv_id, string_agg(token, '' ORDER BY turn * 100000 + seq) AS t, max(upto) AS n FROM r
      WHERE upto - len(token) <= 1000 GROUP BY conv_id)
    SELECT conv_id, n > 1000 AS truncated, t || CASE WHEN conv_id % 4 = 0 THEN chr(10) || chr(10) || '[Response was cut off due to timeout]'
      WHEN n > 1000 THEN chr(10) || chr(10) || '[Response was truncated due to length limit]' ELSE '' END AS answer
    FROM k WHERE trim(t) <> ''"""
)
def assembled_responses(spark, sf):
    """Token streams to stored answers (1000 characters here)."""
    from ..sources.json_logs import parse_token_stream

    tokens = parse_token_stream(PF.token_lines(spark, sf)).select(
        "conv_id", (F.col("turn") * 100000 + F.col("seq")).alias("seq"), "token"
    )
    return M.assemble_response(tokens, ["conv_id"], F.col("conv_id") % 4 == 0, limit=1000)
