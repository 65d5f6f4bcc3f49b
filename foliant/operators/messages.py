"""Message log operators: dedup, paging, context windows, search, prompts, responses.

``messages`` has course_id, chat_id, seq, sender (human or bot), content, citations.
Chats can be very long, so no operator orders a whole chat in one task: rank limits are pruned
before the shuffle, and numbering and running sums go block by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..functions.ordered import GROUP_LIMIT, row_positions, running_total, top_n
from ..functions.substrings import find_substrings

CHAT = ["course_id", "chat_id"]


def newest_first() -> list[Column]:
    return [F.desc("seq")]


def dedup_messages(messages: DataFrame) -> DataFrame:
    """First of equal messages per chat; bot messages must also have equal citations."""
    same = [*CHAT, "sender", "content"]
    other = [c for c in messages.columns if c not in (*same, "seq")]
    cited = F.when(F.col("sender") == "bot", F.col("citations"))
    return (
        messages.withColumn("_cited", cited)
        .groupBy(*same, "_cited")
        .agg(F.min("seq").alias("seq"), *[F.min_by(c, "seq").alias(c) for c in other])
        .select(*messages.columns)
    )


def page_newest_first(messages: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Per chat the ``limit`` messages before the newest ``offset``."""
    if limit + offset <= GROUP_LIMIT:
        found = top_n(messages, CHAT, newest_first(), limit + offset, "_from_end")
    else:
        found = row_positions(messages, CHAT, "seq").withColumn(
            "_from_end", F.col("total") - F.col("position") + 1
        ).drop("position", "total")
    return found.where(
        (F.col("_from_end") > offset) & (F.col("_from_end") <= offset + limit)
    ).drop("_from_end")


def paginate(messages: DataFrame, page: int = 1, page_size: int = 50) -> DataFrame:
    """One page per chat, oldest first, with the paging facts."""
    pages = F.ceil(F.col("total") / page_size)
    return (
        row_positions(messages, CHAT, "seq")
        .where(F.col("position").between((page - 1) * page_size + 1, page * page_size))
        .withColumn("total_pages", pages)
        .withColumn("has_next", F.lit(page) < pages)
        .withColumn("has_prev", F.lit(page > 1))
        .withColumnRenamed("total", "total_messages")
        .drop("position")
    )


def message_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy(*CHAT).agg(
        F.count("*").alias("messages"),
        F.count_if(F.col("sender") == "human").alias("human"),
        F.count_if(F.col("sender") == "bot").alias("bot"),
    )


def recent_messages(messages: DataFrame, n: int = 8) -> DataFrame:
    return top_n(messages, CHAT, newest_first(), n, "age")


# name -> (messages, budget or None, cost of a content, newest message left out: before / after)
def context_profile(name: str) -> tuple[int, int | None, Column, bool, bool]:
    chars = F.length("content")
    return {
        "history": (8, 4096, F.floor(chars / 4), False, False),
        "optimized": (20, 2000, F.ceil(chars / 4), True, False),
        "direct": (6, 4000, chars, False, True),
        "plain": (8, None, F.lit(0), False, False),
    }[name]


def context_window(
    messages: DataFrame,
    last: int,
    budget: int | None,
    cost: Column,
    skip_newest: bool = False,
    drop_newest: bool = False,
) -> DataFrame:
    """The newest messages per chat whose summed cost stays within the budget.

    ``skip_newest`` leaves the newest message out from the start, ``drop_newest`` only after it
    has used its part of the budget. Costs are not negative, so stopping at the first overflow
    is the same as a limit on the running sum.
    """
    kept = top_n(messages, CHAT, newest_first(), last + skip_newest, "age")
    if skip_newest:
        kept = kept.where("age > 1")
    w = Window.partitionBy(*CHAT).orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("cost", cost.cast("long")).withColumn("used", F.sum("cost").over(w))
    if budget is not None:
        kept = kept.where(F.col("used") <= budget)
    return kept.where("age > 1") if drop_newest else kept


def context_usage(messages: DataFrame, window: DataFrame, budget: int) -> DataFrame:
    """Per chat: messages and tokens in the window, what remains, and whether it is nearly full."""
    used = window.groupBy(*CHAT).agg(
        F.count("*").alias("message_count"), F.sum("cost").alias("tokens_used")
    )
    total = messages.groupBy(*CHAT).agg(F.count("*").alias("total_messages"))
    tokens = F.coalesce("tokens_used", F.lit(0))
    return total.join(used, CHAT, "left").select(
        *CHAT,
        F.coalesce("message_count", F.lit(0)).alias("message_count"),
        "total_messages",
        tokens.alias("tokens_used"),
        (F.lit(budget) - tokens).alias("tokens_remaining"),
        (tokens / budget * 100).alias("usage_percent"),
        (tokens > budget * 0.8).alias("near_limit"),
    )


def search_messages(messages: DataFrame, text: str) -> DataFrame:
    return messages.where(F.lower("content").contains(text.lower()))


def search_chats(queries: DataFrame, chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Chats whose title or content has the query: (query_id, query), chats with title, messages.

    The snippet comes from the first matching message, 50 characters each way; it is also
    returned split around the match.
    """
    needle = X.strip(F.lower("query"))
    q = queries.withColumn("needle", needle).where(F.col("needle") != "")
    titles = find_substrings(
        q, chats.select(*CHAT, "title", F.lower("title").alias("haystack")), CHAT
    ).select("query_id", *CHAT, F.col("haystack").eqNullSafe(F.col("needle")).alias("exact"))
    hits = find_substrings(
        q,
        messages.select(*CHAT, "seq", "content", F.lower("content").alias("haystack")),
        [*CHAT, "seq"],
    )
    at = F.position("needle", "haystack")
    start = F.greatest(at - 50, F.lit(1))
    end = F.least(at + F.length("needle") + 49, F.length("content"))  # 1-based, inclusive
    snippet = F.concat(
        F.when(start > 1, "...").otherwise(""),
        F.substring("content", start, end - start + 1),
        F.when(end < F.length("content"), "...").otherwise(""),
    )
    content = (
        hits.withColumn("snippet", snippet)
        .groupBy("query_id", *CHAT)
        .agg(F.min_by("snippet", "seq").alias("snippet"))
    )
    title_hit = F.col("exact").isNotNull()
    spot = F.position("needle", F.lower("snippet"))
    width = F.length("query")
    found = (
        titles.join(content, ["query_id", *CHAT], "full")
        .join(chats.select(*CHAT, "title", "latest_activity"), CHAT)
        .join(q.select("query_id", "query", "needle"), "query_id")
    )
    return found.select(
        "query_id", *CHAT, "title", "latest_activity",
        F.when(F.col("exact"), "exact-title").when(title_hit, "partial-title").otherwise("content")
        .alias("match_type"),
        F.when(title_hit, 1.0).otherwise(0.8).alias("score"),
        "snippet",
        F.when(spot > 0, F.left("snippet", spot - 1)).alias("before"),
        F.when(spot > 0, F.substring("snippet", spot, width)).alias("match"),
        F.when(spot > 0, F.substring("snippet", spot + width, F.length("snippet"))).alias("after"),
    ).orderBy("query_id", F.desc("score"), F.desc("latest_activity"), *CHAT)


def search_index_stats(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """Per course: chats, messages, last change."""
    m = messages.groupBy("course_id").agg(F.count("*").alias("messages"))
    c = chats.groupBy("course_id").agg(
        F.count("*").alias("chats"), F.max("latest_activity").alias("last_indexed")
    )
    return c.join(m, "course_id", "left").fillna(0, ["messages"])


def needs_contextualisation(messages: DataFrame) -> DataFrame:
    """The newest message per chat: does it refer back, and is there enough to refer to?"""
    newest = messages.groupBy(*CHAT).agg(
        F.max_by("content", "seq").alias("content"), (F.count("*") - 1).alias("prior")
    )
    refers = X.has_reference(F.col("content"))
    return newest.select(
        *CHAT, "prior", refers.alias("refers"), ((F.col("prior") >= 2) & refers).alias("needed")
    )


def build_prompts(
    queries: DataFrame, sources: DataFrame, history: DataFrame, system_prompts: DataFrame, last: int = 8
) -> DataFrame:
    """One prompt per query: system text, numbered sources, recent history, question.

    ``queries``: query_id, query, mode and the chat it belongs to; ``sources``: query_id, rank,
    text, filename, page, heading; ``system_prompts``: mode, system_prompt (a handful of rows).
    """
    page = F.coalesce(F.concat(F.lit("Page "), "page"), F.lit("N/A"))
    heading = F.when(F.col("heading") != "", F.concat(F.lit(" ("), "heading", F.lit(")")))
    entry = F.concat(
        F.lit("Source "), "rank", F.lit(" ["), "filename", F.lit(" - "), page, F.lit("]"),
        F.coalesce(heading, F.lit("")), F.lit(":\n"), "text",
    )
    context = (
        sources.withColumn("entry", entry)
        .groupBy("query_id")
        .agg(F.expr("listagg(entry, '\\n\\n') within group (order by rank)").alias("context"))
    )
    label = F.when(F.col("sender") == "human", "User: ").otherwise("Assistant: ")
    recent = (
        recent_messages(history, last)
        .withColumn("line", F.concat(label, "content"))
        .groupBy(*CHAT)
        .agg(F.expr("listagg(line, '\\n') within group (order by seq)").alias("recent"))
    )
    prompt = F.concat_ws(
        "\n\n",
        F.concat(F.lit("# System Instructions\n"), "system_prompt"),
        F.concat(F.lit("# Retrieved Context\n\n"), "context"),
        F.concat(F.lit("# Conversation History\n"), "recent"),
        F.concat(F.lit("# Current Question\nUser: "), "query", F.lit("\n\nAssistant:")),
    )
    return (
        queries.join(system_prompts, "mode", "left")
        .join(context, "query_id", "left")
        .join(recent, CHAT, "left")
        .select("query_id", prompt.alias("prompt"))
    )


def build_context_block(excerpts: DataFrame) -> DataFrame:
    """(query_id, rank, document_title, text), at most 50 per query, to each query's context text."""
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    entry = F.concat(
        F.lit("[Document "), "_n", F.lit(": "), "document_title", F.lit("]\n"), "text"
    )
    return (
        excerpts.withColumn("_n", number)
        .withColumn("entry", entry)
        .groupBy("query_id")
        .agg(F.expr("listagg(entry, '\\n\\n') within group (order by _n)").alias("context"))
    )


def apply_templates(queries: DataFrame, contexts: DataFrame, templates: DataFrame) -> DataFrame:
    """The mode's template with or without context, or its base text.

    ``queries``: query_id, mode, question, message; ``templates``: mode, with_context,
    without_context, base, with the places ``{context}``, ``{question}`` and ``{message}``.
    """
    joined = queries.join(contexts, "query_id", "left")
    known = templates.select("mode", F.col("mode").alias("_known"))
    joined = (
        joined.join(known, "mode", "left")
        .withColumn("mode", F.coalesce("_known", F.lit("default")))
        .join(templates, "mode")
    )
    question = F.coalesce("question", "message")
    filled = F.replace(
        F.replace(F.col("with_context"), F.lit("{question}"), question), F.lit("{context}"), F.col("context")
    )
    return joined.select(
        "query_id",
        F.when((F.col("context") != "") & (question != ""), filled)
        .when(F.col("message") != "", F.replace("without_context", F.lit("{message}"), F.col("message")))
        .otherwise(F.col("base")).alias("prompt"),
    )


def escape_braces(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def build_chat_payload(
    prompts: DataFrame, window: DataFrame, current: DataFrame, escape: bool = False
) -> DataFrame:
    """Role/content list per chat: system prompt, earlier messages, current message.

    ``window`` is a context window without the current message, so a list stays short.
    """
    text = escape_braces(F.col("content")) if escape else F.col("content")
    role = F.when(F.col("sender") == "human", "user").otherwise("assistant")
    turn = F.struct("seq", F.struct(role.alias("role"), text.alias("content")).alias("m"))
    earlier = window.groupBy(*CHAT).agg(
        F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["m"]).alias("earlier")
    )
    shape = "array<struct<role:string,content:string>>"

    def one(role: str, c: str) -> Column:
        return F.array(F.struct(F.lit(role).alias("role"), F.col(c).alias("content")))

    return (
        prompts.join(current.select(*CHAT, F.col("content").alias("_now")), CHAT)
        .join(earlier, CHAT, "left")
        .select(
            *CHAT,
            F.concat(
                one("system", "prompt"),
                F.coalesce("earlier", F.array().cast(shape)),
                one("user", "_now"),
            ).alias("messages"),
        )
    )


def assemble_response(
    tokens: DataFrame, keys: list[str], aborted: Column | None = None, limit: int | None = None
) -> DataFrame:
    """(keys…, seq, token) to the stored answer.

    The token that takes the answer over the limit, if there is one, is the last; a note follows. Running
    lengths are summed block by block, so tokens beyond the limit are dropped without ordering
    them. Blank answers are not stored.
    """
    t = running_total(tokens, keys, "seq", F.length("token"), "_upto", block=4096)
    over = F.col("_chars") > limit if limit is not None else F.lit(False)
    kept = t if limit is None else t.where(F.col("_upto") - F.length("token") <= limit)
    flag = F.max(aborted) if aborted is not None else F.lit(False)
    answers = kept.groupBy(*keys).agg(
        F.expr("listagg(token, '') within group (order by seq)").alias("_text"),
        F.max("_upto").alias("_chars"),
        flag.alias("_aborted"),
    )
    note = (
        F.when(F.col("_aborted"), L.TIMEOUT_NOTE)
        .when(over, L.TRUNCATED_NOTE)
        .otherwise("")
    )
    return answers.where(~X.is_blank(F.col("_text"))).select(
        *keys, F.concat("_text", note).alias("answer"), over.alias("truncated")
    )
