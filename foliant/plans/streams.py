"""Streaming queries: stored tables replayed as micro-batches, results read from the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.json_logs import parse_token_stream
from ..streaming import index as SI
from ..streaming import keyed as SK
from ..streaming import states as SS
from ..streaming.runner import replay
from . import files as PF
from . import inputs as I
from . import memo as PM
from . import telemetry as PT
from .registry import ORACLES, query

HOUR = 3_600_000_000
# the events table spans thirty days, any of which may arrive last
MONTH = 31 * SK.DAY


def arrival(id_col: str):
    """An order that has nothing to do with time."""
    return F.crc32(F.col(id_col).cast("string")).alias("arrival")


@query(
    f"""WITH {PF.FILES}, named_ok AS (SELECT path, text, {PF.ALLOWED_SQL} AND NOT ({PF.SUSPICIOUS_SQL}) AS ok FROM named)
    SELECT path AS name, CASE WHEN ok THEN 'completed' ELSE 'failed' END AS status,
      ok AND {I.strip_sql("text")} <> '' AS has_chunks FROM named_ok"""
)
def stream_ingest(spark, sf):
    """Files validated, chunked and embedded batch by batch."""
    f = PF.files(spark, sf).select(
        F.col("path").alias("doc_id"), "name", "ext", "size", "mime", "content",
        F.pmod(F.crc32("path"), F.lit(1000)).alias("arrival"),
    )
    _, reports = SI.stream_ingest(replay(f, "arrival", parts=2).drop("arrival"))
    return reports.select(
        F.col("doc_id").alias("name"), "status", (F.col("chunks_created") > 0).alias("has_chunks")
    )


@query(
    f"""WITH {PT.STATES}, seen AS (SELECT DISTINCT id FROM states)
    SELECT s.id, g.stage, coalesce(l.progress, CASE g.stage WHEN 'Initialize' THEN 'Finished' ELSE 'Not Started' END) AS progress
    FROM seen s CROSS JOIN (SELECT unnest(['Initialize', 'Parse', 'Split', 'Embed', 'Save Excerpts']) AS stage) g
    LEFT JOIN latest l ON l.id = s.id AND l.stage = g.stage"""
)
def stream_import_states(spark, sf):
    """Latest state of every stage of every document."""
    events = replay(PT.states(spark, sf), "event_id")
    return SS.stream_latest_state(events).select("id", "stage", "progress")


@query(
    """WITH m AS (SELECT conv_id, turn, text, conv_id * 100 + turn AS pos, role FROM conversations),
    gone AS (SELECT conv_id, max(pos) AS removed_at FROM m WHERE role = 'system' GROUP BY conv_id)
    SELECT m.conv_id AS chat_id, turn AS seq, len(text) AS chars FROM m LEFT JOIN gone g ON g.conv_id = m.conv_id
    WHERE role <> 'system' AND (removed_at IS NULL OR pos > removed_at)"""
)
def stream_search_index(spark, sf):
    """Appended messages, renames and removals; system turns stand for removals."""
    c = I.table(spark, sf, "conversations")
    at = F.col("conv_id") * 100 + F.col("turn")
    changes = c.select(
        F.when(F.col("role") == "system", "remove").otherwise("message").alias("kind"),
        (F.col("conv_id") % 5).alias("course_id"), F.col("conv_id").alias("chat_id"),
        at.alias("at"), F.col("turn").alias("seq"), F.col("text").alias("content"),
        F.lit(None).cast("string").alias("title"),
    )
    _, messages = SI.stream_search_index(replay(changes, "at"))
    return messages.select("chat_id", "seq", F.length("content").alias("chars"))


@query(
    f"""WITH {PF.TOKENS}, t AS (SELECT conv_id, turn, string_agg(token, '' ORDER BY seq) AS answer FROM tokens GROUP BY ALL),
    s AS (SELECT * FROM t WHERE turn > coalesce((SELECT max(turn) FROM conversations c WHERE c.conv_id = t.conv_id AND role = 'system'), -1))
    SELECT conv_id, string_agg(answer, '' ORDER BY turn) AS answer FROM s GROUP BY conv_id"""
)
def stream_partial_answers(spark, sf):
    """T4: answers growing token by token; the end of a system turn clears them."""
    c = I.table(spark, sf, "conversations")
    tokens = parse_token_stream(PF.token_lines(spark, sf)).select(
        "conv_id", (F.col("turn") * 1000000 + F.col("seq")).alias("seq"), "token"
    )
    clear = c.where("role = 'system'").select(
        "conv_id", (F.col("turn") * 1000000 + 999999).alias("seq"), F.lit("").alias("token")
    )
    return SK.stream_partial_message(replay(tokens.unionByName(clear), "seq", parts=4), "conv_id")


@query()
def stream_memo_hits(spark, sf):
    """T5: questions answered from a result of the last six hours, though they arrive in no order."""
    q = PM.asked(spark, sf).select("memo_key", "query_id", "asked_at", arrival("query_id"))
    return SK.stream_memo(replay(q, "arrival").drop("arrival"), ttl=6 * 3600, late=MONTH)


@query()
def stream_throttled_events(spark, sf):
    """Progress events at least an hour after the last forwarded one, though they arrive in no order."""
    e = I.table(spark, sf, "events").select(
        "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), arrival("event_id")
    )
    e = replay(e, "arrival").drop("arrival")
    out = SK.stream_throttle(e, "event_type", "event_id", "ts", HOUR, late=MONTH)
    return out.select("event_id", "forwarded")


@query()
def stream_operation_stats(spark, sf):
    """Running statistics per operation."""
    m = PT.metrics(spark, sf)
    return SS.stream_operation_stats(replay(m, "metric_id")).withColumn("avg_ms", F.round("avg_ms", 6))


@query(f"WITH {PT.METRICS} SELECT metric_id, operation FROM metrics WHERE coalesce(duration_ms > {PT.THRESHOLD_SQL}, false)")
def stream_slow_alerts(spark, sf):
    """Slow operations as they arrive."""
    return SS.stream_slow_alerts(replay(PT.metrics(spark, sf), "metric_id")).select("metric_id", "operation")


# the streams give what the batch operators give
ORACLES["stream_memo_hits"] = ORACLES["memo_replay"]
ORACLES["stream_throttled_events"] = ORACLES["throttled_events"]
ORACLES["stream_operation_stats"] = ORACLES["operation_statistics"]
