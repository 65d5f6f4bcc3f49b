"""Chat title and chat table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import chats as T
from . import inputs as I
from .registry import query

FIRST = """first AS (SELECT conv_id, arg_min(text, turn) AS message FROM conversations WHERE role = 'user' GROUP BY conv_id)"""


def first_turns(spark, sf):
    return (
        I.table(spark, sf, "conversations")
        .where("role = 'user'")
        .groupBy("conv_id")
        .agg(F.min_by("text", "turn").alias("message"))
    )


# the same cleaning, spelled in RE2
def _clean_sql(c: str) -> str:
    for pattern, replacement in T.CLEANING:
        p = pattern.replace("'", "''").replace("(?s)```.*?```", "(?s)```.*?```")
        c = f"regexp_replace({c}, '{p}', '{replacement}', 'g')"
    return I.strip_sql(c)


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in L.STOP_WORDS) + "]"


def _limit_sql(c: str) -> str:
    w = f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')"
    content = (
        f"list_filter({w}, lambda x: NOT list_contains({STOP_SQL}, lower(regexp_replace(x, '[^\\w''-]', '', 'g'))))[:6]"
    )
    return f"""CASE WHEN len({w}) <= 6 THEN {c} ELSE array_to_string(list_concat({content},
      list_filter(list_filter({w}, lambda x, i: list_position({w}, x) = i), lambda x: NOT list_contains({content}, x)))[:6], ' ') END"""


def _short_sql(c: str) -> str:
    return f"len(regexp_split_to_array({c}, '\\s+')) <= 6"


def _title_case_sql(c: str) -> str:
    up = "lambda x: replace(upper(left(x, 1)), 'ẞ', 'SS') || substr(x, 2)"
    return I.strip_sql(f"array_to_string(list_transform(regexp_split_to_array({c}, '\\s+'), {up}), ' ')")


FALLBACK = f"""WITH {FIRST},
told AS (SELECT conv_id, {I.strip_sql("coalesce(message, '')")} AS text FROM first),
lined AS (SELECT *, regexp_split_to_array(text, '\\r?\\n')[1] AS line FROM told),
parts AS (SELECT *, len(line) <= 60 AND {_short_sql("line")} AS fits,
  {I.strip_sql("coalesce(nullif(regexp_extract(text, '(?s)[^.?!]*[.?!]'), ''), line)")} AS sentence,
  nullif({I.strip_sql("regexp_split_to_array(text, '[,;:\\-–—]')[1]")}, '') AS phrase,
  list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM lined),
content AS (SELECT *, list_filter(list_transform(w, lambda x: regexp_replace(x, '[^\\w''-]', '', 'g')),
  lambda x: NOT list_contains({STOP_SQL}, lower(x))) AS kept FROM parts),
based AS (SELECT conv_id, text, fits, CASE WHEN fits THEN line WHEN {_short_sql("sentence")} THEN sentence ELSE
  coalesce(phrase, array_to_string((CASE WHEN len(kept) > 0 THEN kept ELSE w END)[:6], ' ')) END AS base FROM content),
clean AS (SELECT conv_id, text, fits, {_clean_sql("base")} AS c FROM based),
limited AS (SELECT conv_id, text, fits, CASE WHEN fits THEN c ELSE {_limit_sql("c")} END AS c FROM clean),
headed AS (SELECT *, {I.strip_sql("regexp_replace(regexp_replace(" + I.strip_sql("left(c, 60)") + ", '(?s) [^ ]*$', ''), '[.,;:!?-]+$', '')")} AS head
  FROM limited),
cut AS (SELECT conv_id, text, fits, CASE WHEN fits OR len(c) <= 60 THEN c WHEN head <> '' THEN head || '...' END AS c FROM headed),
cased AS (SELECT conv_id, text, fits, {_title_case_sql("c")} AS t FROM cut)
SELECT conv_id, CASE WHEN text = '' THEN 'New Chat' WHEN fits THEN t ELSE coalesce(nullif(t, ''), 'New Chat') END AS title FROM cased"""


@query(FALLBACK)
def fallback_titles(spark, sf):
    """A title from the first message alone."""
    return first_turns(spark, sf).select("conv_id", T.fallback_title(F.col("message")).alias("title"))


@query(
    f"""WITH {FIRST} SELECT conv_id, {I.strip_sql("left(message, 50)")} || CASE WHEN len(message) > 50 THEN '...' ELSE '' END AS title
    FROM first"""
)
def simple_titles(spark, sf):
    """The plain 50-character title."""
    return first_turns(spark, sf).select("conv_id", T.simple_title(F.col("message")).alias("title"))


def replies(spark, sf):
    """Model replies: numbered lines of a turn, or its comma parts after an empty line."""
    c = I.texts(spark, sf, "conversations")
    lines = F.array_join(
        F.transform(
            F.split("text", r"\. "), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". Title: **"), x, F.lit("**"))
        ),
        "\n",
    )
    return c.select("conv_id", "turn", "text", F.when(F.col("turn") % 2 == 0, lines).otherwise(F.concat(F.lit("> "), "text")).alias("reply"))


CANDIDATES = f"""replies AS (
  SELECT conv_id, turn, text, CASE WHEN turn % 2 = 0 THEN array_to_string(list_transform(string_split(text, '. '),
      lambda x, i: i || '. Title: **' || x || '**'), chr(10)) ELSE '> ' || text END AS reply FROM conversations),
line AS (
  SELECT conv_id, turn, text, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (
    SELECT conv_id, turn, text, string_split({I.strip_sql("reply")}, chr(10)) AS l FROM replies)),
cleaned AS (
  SELECT conv_id, turn, text, i, {_clean_sql(I.strip_sql("regexp_replace(regexp_replace(" + I.strip_sql("line") + ", '^\\d+\\.\\s*', ''), '(?i)^(Title|Titles)\\s*[:\\-–—]\\s*', '')"))} AS c FROM line),
three AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM cleaned WHERE c <> '' QUALIFY n <= 3),
uniq AS (SELECT conv_id, turn, text, c, min(n) AS n FROM three GROUP BY ALL),
again AS (SELECT conv_id, turn, text, n, {_clean_sql("c")} AS c FROM uniq),
limited AS (SELECT conv_id, turn, text, n, {_limit_sql("c")} AS c FROM again),
cut AS (
  SELECT *, left(c, 61) AS head, len(left(c, 61)) - strpos(reverse(left(c, 61)), ' ') AS space FROM limited),
short AS (
  SELECT conv_id, turn, text, n, CASE WHEN len(c) <= 60 THEN c ELSE
    nullif({I.strip_sql("regexp_replace(CASE WHEN contains(head, ' ') AND space > 36 THEN left(head, space::INT) ELSE left(head, 60) END, '[.,;:!?-]+$', '')")}, '') || '...' END AS c
  FROM cut),
candidates AS (
  SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n) AS n,
    {I.strip_sql("array_to_string(list_transform(regexp_split_to_array(c, '\\s+'), lambda x: replace(upper(left(x, 1)), 'ẞ', 'SS') || substr(x, 2)), ' ')")} AS title
  FROM short WHERE c IS NOT NULL)"""


@query(f"WITH {CANDIDATES} SELECT conv_id, turn, n - 1 AS pos, title FROM candidates")
def title_candidates(spark, sf):
    """Up to three titles from a model's reply."""
    c = T.parse_title_candidates(F.col("reply"))
    return replies(spark, sf).select("conv_id", "turn", F.posexplode(c).alias("pos", "title"))


@query(
    f"""WITH {CANDIDATES}, told AS (SELECT *, list_filter(regexp_split_to_array(title, '\\s+'), lambda x: x <> '') AS w,
      regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+') AS m FROM candidates),
    scored AS (SELECT conv_id, turn, n, title, round(CASE WHEN len(title) BETWEEN 10 AND 45 THEN 2.0 WHEN len(title) < 10 THEN 0.5 ELSE 1.0 END
      - CASE WHEN regexp_matches(lower(title), '{L.GENERIC_TITLE}') THEN 5.0 ELSE 0.0 END
      + 2.0 * len(list_filter(list_transform(w, lambda x: lower(regexp_replace(x, '[^a-zA-Z0-9]', '', 'g'))),
          lambda x: x <> '' AND NOT list_contains({STOP_SQL}, x) AND list_contains(m, x)))
      + greatest(0.0, (6 - len(w)) * 0.3), 6) AS s FROM told)
    SELECT conv_id, turn, arg_max(title, s * 10 - n) AS title FROM scored GROUP BY ALL"""
)
def chosen_titles(spark, sf):
    """The best candidate."""
    c = replies(spark, sf).withColumn("c", T.parse_title_candidates(F.col("reply")))
    return c.where(F.size("c") > 0).select("conv_id", "turn", T.choose_title(F.col("c"), F.col("text")).alias("title"))


def chat_table(spark, sf):
    k = F.col("conv_id")
    return (
        I.table(spark, sf, "conversations")
        .groupBy("conv_id")
        .agg(F.max("turn").alias("last"))
        .select(
            F.concat(F.lit("course"), k % 5).alias("course_id"),
            k.alias("chat_id"),
            F.when(k % 2 == 0, L.NEW_CHAT).otherwise(F.concat(F.lit("Chat "), k)).alias("title"),
            F.when(k % 3 != 0, F.array(F.concat(F.lit("d"), k % 7), F.lit("d1"))).alias("document_ids"),
        )
    )


@query(
    f"""WITH {FIRST}, c AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT 'course' || c.conv_id % 5 AS course_id, c.conv_id AS chat_id, CASE WHEN c.conv_id % 2 = 0
      THEN coalesce(left(message, 20), 'New Chat') ELSE 'Chat ' || c.conv_id END AS title
    FROM c LEFT JOIN first f ON f.conv_id = c.conv_id"""
)
def titled_chats(spark, sf):
    """Only chats with the stock title take a new one."""
    new = first_turns(spark, sf).select(
        F.concat(F.lit("course"), F.col("conv_id") % 5).alias("course_id"),
        F.col("conv_id").alias("chat_id"),
        F.left("message", F.lit(20)).alias("title"),
    )
    return T.title_new_chats(chat_table(spark, sf), new).select("course_id", "chat_id", "title")


@query("SELECT event_type AS course_id, user_id AS chat_id, epoch_us(max(ts)) AS latest_us FROM events GROUP BY ALL")
def chat_activity(spark, sf):
    """Latest activity per chat, newest first; users as chats."""
    a = I.table(spark, sf, "events").select(
        F.col("event_type").alias("course_id"),
        F.col("user_id").alias("chat_id"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    return T.chat_activity(a).select(
        "course_id", "chat_id", F.unix_micros("latest_activity").alias("latest_us")
    )


@query(
    """WITH c AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 3 <> 0 THEN ['d' || conv_id % 7, 'd1'] END AS docs FROM conversations),
    u AS (SELECT conv_id, docs, list_concat(coalesce(docs, []), ['d2', 'd3']) AS all_docs FROM c)
    SELECT conv_id AS chat_id, CASE WHEN conv_id % 2 = 1 THEN array_to_string(docs, ',')
      ELSE array_to_string(list_filter(all_docs, lambda x, i: list_position(all_docs, x) = i), ',') END AS documents FROM u"""
)
def chat_documents_added(spark, sf):
    """Documents attached to chats, first-seen order, no repeats."""
    c = chat_table(spark, sf)
    added = c.where("chat_id % 2 = 0").select(
        "course_id", "chat_id", F.array(F.lit("d2"), F.lit("d3")).alias("document_ids")
    )
    return T.add_documents(c, added).select("chat_id", F.array_join("document_ids", ",").alias("documents"))


@query(
    """WITH c AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 3 <> 0 THEN ['d' || conv_id % 7, 'd1'] END AS docs FROM conversations)
    SELECT conv_id AS chat_id, array_to_string(CASE WHEN conv_id % 5 = 0 THEN list_filter(docs, lambda x: x <> 'd1') ELSE docs END, ',')
      AS documents FROM c"""
)
def chat_documents_removed(spark, sf):
    """A document detached from some chats."""
    c = chat_table(spark, sf)
    gone = c.where("chat_id % 5 = 0").select("course_id", "chat_id", F.lit("d1").alias("doc_id"))
    return T.remove_document(c, gone).select("chat_id", F.array_join("document_ids", ",").alias("documents"))


@query(
    f"""WITH n AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN left(text, 30) WHEN 2 THEN '  '
        ELSE ' Chat (' || conv_id || ') ' END AS name FROM conversations)
    SELECT conv_id, turn, CASE WHEN {I.strip_sql("name")} = '' THEN 'Chat name cannot be empty'
      WHEN len({I.strip_sql("name")}) > 50 THEN 'Chat name cannot exceed 50 characters'
      WHEN NOT regexp_matches({I.strip_sql("name")}, '{L.CHAT_NAME_PATTERN}') THEN 'Chat name contains invalid characters' END AS error
    FROM n"""
)
def chat_name_errors(spark, sf):
    """Chat names with what is wrong with them."""
    k = F.col("turn") % 4
    name = (
        F.when(k == 0, F.col("text")).when(k == 1, F.left("text", F.lit(30))).when(k == 2, "  ")
        .otherwise(F.concat(F.lit(" Chat ("), "conv_id", F.lit(") ")))
    )
    return I.table(spark, sf, "conversations").select(
        "conv_id", "turn", T.chat_name_error(name).alias("error")
    )
