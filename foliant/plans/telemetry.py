"""Telemetry queries over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import telemetry as O
from ..sources.json_logs import parse_json_logs
from . import files as PF
from . import inputs as I
from .registry import query

OPERATIONS = list(L.SLOW_THRESHOLDS_MS)
NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in OPERATIONS) + "]"
METRICS = f"""metrics AS (
  SELECT event_id AS metric_id, ts AS start_ts, value * 20 AS duration_ms,
    CASE event_type WHEN 'view' THEN {NAMES_SQL}[user_id % 7 + 1] WHEN 'click' THEN upper({NAMES_SQL}[user_id % 7 + 1]) || ':part'
      ELSE event_type END AS operation FROM events)"""


def metrics(spark, sf):
    names = F.element_at(F.array(*map(F.lit, OPERATIONS)), (F.col("user_id") % 7 + 1).cast("int"))
    t = F.col("event_type")
    return I.table(spark, sf, "events").select(
        F.col("event_id").alias("metric_id"),
        F.col("ts").cast("timestamp").alias("start_ts"),
        (F.col("value") * 20).alias("duration_ms"),
        F.when(t == "view", names).when(t == "click", F.concat(F.upper(names), F.lit(":part")))
        .otherwise(t).alias("operation"),
    )


@query(
    f"""WITH {METRICS} SELECT operation, count(*) AS n, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms,
    round(avg(duration_ms), 6) AS avg_ms FROM metrics GROUP BY operation"""
)
def operation_statistics(spark, sf):
    """O1: durations per operation."""
    return O.operation_stats(metrics(spark, sf)).withColumn("avg_ms", F.round("avg_ms", 6))


THRESHOLD_SQL = (
    "coalesce(CASE operation "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.SLOW_THRESHOLDS_MS.items())
    + " END, CASE "
    + " ".join(
        f"WHEN contains(lower(operation), '{k.lower()}') THEN {v}" for k, v in L.SLOW_THRESHOLDS_MS.items()
    )
    + " END)::DOUBLE"
)


@query(
    f"""WITH {METRICS} SELECT metric_id, operation, {THRESHOLD_SQL} AS threshold_ms,
    coalesce(duration_ms > {THRESHOLD_SQL}, false) AS slow FROM metrics"""
)
def slow_operations(spark, sf):
    """O2: operations over their threshold."""
    return O.flag_slow(metrics(spark, sf)).select("metric_id", "operation", "threshold_ms", "slow")


@query(f"WITH {METRICS} SELECT metric_id, operation FROM metrics ORDER BY start_ts DESC, metric_id DESC LIMIT 100")
def latest_metrics(spark, sf):
    """O3: the newest hundred metrics."""
    return O.last_n_metrics(metrics(spark, sf)).select("metric_id", "operation")


# needles of all rule tables, so that every rule and every clash of rules occurs
WORDS = sorted(
    {n for needles, _ in L.ERROR_TYPES + L.UPLOAD_ERRORS for n in needles}
    | {*L.UNRECOVERABLE, *L.RETRYABLE, *L.NOT_RETRYABLE, "Error:", "at ", "chroma", "embedding", "ollama"}
)
WORDS_SQL = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
TYPES = [*L.HTTP_TYPES, "ChromaDBError", "KeyError"]
TYPES_SQL = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
ERRORS = f"""errors AS (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN {WORDS_SQL}[event_id % {len(WORDS)} + 1] ELSE 'job ' || user_id END
    || CASE WHEN event_id % 2 = 0 THEN ' ' || upper({WORDS_SQL}[user_id % {len(WORDS)} + 1]) ELSE ' stopped' END
    || CASE WHEN event_id % 5 = 0 THEN repeat('. And more', 10) ELSE '' END AS message,
    {TYPES_SQL}[event_id % {len(TYPES)} + 1] AS error_type FROM events)"""


def errors(spark, sf):
    def pick(values, by):
        return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))

    e = F.col("event_id")
    message = F.concat(
        F.when(e % 3 == 0, pick(WORDS, "event_id")).otherwise(F.concat(F.lit("job "), "user_id")),
        F.when(e % 2 == 0, F.concat(F.lit(" "), F.upper(pick(WORDS, "user_id")))).otherwise(" stopped"),
        F.when(e % 5 == 0, F.repeat(F.lit(". And more"), F.lit(10))).otherwise(""),
    )
    return I.table(spark, sf, "events").select(
        "event_id", message.alias("message"), pick(TYPES, "event_id").alias("error_type")
    )


def any_sql(c: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{n}')" for n in needles) + ")"


def rules_sql(c: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_sql(c, n)} THEN '{v}'" for n, v in rules) + f" ELSE {default} END"


@query(
    f"""WITH {ERRORS} SELECT event_id, {rules_sql("lower(message)", L.ERROR_TYPES, "'UNKNOWN'")} AS error_class FROM errors"""
)
def error_classes(spark, sf):
    """Error type by message, first rule wins."""
    return errors(spark, sf).select("event_id", O.classify_error(F.col("message")).alias("error_class"))


@query(
    f"""WITH {ERRORS} SELECT event_id, NOT {any_sql("lower(message)", L.UNRECOVERABLE)} AS recoverable,
    {any_sql("lower(message)", L.RETRYABLE)} OR NOT {any_sql("lower(message)", L.NOT_RETRYABLE)} AS retryable FROM errors"""
)
def error_recovery(spark, sf):
    """May the operation recover, should it be retried?"""
    m = F.col("message")
    return errors(spark, sf).select(
        "event_id", O.recoverable(m).alias("recoverable"), O.retryable(m).alias("retryable")
    )


def _http_sql(column: int) -> str:
    def value(row):
        v = row[column]
        if isinstance(v, int):
            return str(v)
        return "'" + v.replace("{}", "' || message || '") + "'"

    cases = [
        f"WHEN contains(lower(message), '{n}')"
        + (f" OR contains(lower(error_type), '{t}')" if t else "")
        + f" THEN {value(rest)}"
        for n, t, *rest in L.HTTP_NEEDLES
    ] + [f"WHEN error_type = '{k}' THEN {value(v)}" for k, v in L.HTTP_TYPES.items()]
    return "CASE " + " ".join(cases) + f" ELSE {value(L.HTTP_FALLBACK)} END"


@query(
    f"""WITH {ERRORS} SELECT event_id, {_http_sql(0)} AS category, {_http_sql(1)} AS status, {_http_sql(2)} AS user_message FROM errors"""
)
def http_errors(spark, sf):
    """Category, status and message of server errors."""
    return (
        errors(spark, sf)
        .withColumn("h", O.http_status(F.col("message"), F.col("error_type")))
        .select("event_id", "h.category", "h.status", "h.user_message")
    )


@query(
    f"""WITH {ERRORS} SELECT event_id, {rules_sql("message", L.UPLOAD_ERRORS,
      f"CASE WHEN len(message) < 100 AND NOT {any_sql('message', ['Error:', 'at '])} THEN message ELSE '{L.UPLOAD_ERROR_FALLBACK}' END")}
      AS friendly FROM errors"""
)
def upload_errors(spark, sf):
    """Readable upload errors."""
    return errors(spark, sf).select(
        "event_id", O.friendly_upload_error(F.col("message")).alias("friendly")
    )


@query(
    """WITH p AS (SELECT event_id, user_id AS current, CASE WHEN event_type = 'error' THEN 0 ELSE 100 END AS total,
      value * 40 AS elapsed_s FROM events),
    e AS (SELECT *, CASE WHEN total > 0 THEN current / total * 100 ELSE 0 END AS percentage,
      CASE WHEN current > 0 AND current < total AND elapsed_s > 0 THEN (total - current) / (current / elapsed_s) END AS eta FROM p)
    SELECT event_id, round(percentage, 6) AS percentage, round(eta, 4) AS eta_s,
      CASE WHEN current < total THEN 'in_progress' ELSE 'complete' END AS status,
      CASE WHEN eta IS NULL THEN 'Unknown' WHEN eta < 1 THEN '< 1s' WHEN eta < 60 THEN floor(eta)::BIGINT || 's'
        WHEN floor(eta / 60) < 60 THEN floor(eta / 60)::BIGINT || 'm ' || floor(eta % 60)::BIGINT || 's'
        ELSE floor(eta / 3600)::BIGINT || 'h ' || (floor(eta / 60)::BIGINT % 60) || 'm' END AS remaining FROM e"""
)
def progress_estimates(spark, sf):
    """Percentage, time left and its text."""
    p = I.table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("current"),
        F.when(F.col("event_type") == "error", 0).otherwise(100).alias("total"),
        (F.col("value") * 40).alias("elapsed_s"),
    )
    return O.progress_eta(p).select(
        "event_id", F.round("percentage", 6).alias("percentage"), F.round("eta_s", 4).alias("eta_s"),
        "status", "remaining",
    )


@query(
    """SELECT CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, 'app.' || event_type AS logger,
    event_type AS module, count(*) AS n, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS latest FROM events GROUP BY ALL"""
)
def log_summary(spark, sf):
    """Log records by level, logger and module."""
    return O.log_summary(parse_json_logs(PF.log_lines(spark, sf)))


STATES = """states AS (
  SELECT event_id, user_id AS id, ['Parse', 'Split', 'Embed', 'Save Excerpts'][event_id % 4 + 1] AS stage, ts,
    CASE event_type WHEN 'view' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'in-progress' END AS progress
  FROM events),
latest AS (SELECT id, stage, arg_max(progress, ts) AS progress FROM states GROUP BY ALL)"""


def states(spark, sf):
    t = F.col("event_type")
    stage = F.element_at(
        F.array(*map(F.lit, ["Parse", "Split", "Embed", "Save Excerpts"])), (F.col("event_id") % 4 + 1).cast("int")
    )
    return I.table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("id"), stage.alias("stage"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(t == "view", "pending").when(t == "purchase", "completed").when(t == "error", "failed")
        .otherwise("in-progress").alias("progress"),
        F.col("event_id").alias("completed"), F.lit(100).cast("long").alias("total"),
    )


@query(f"WITH {STATES} SELECT stage, progress, count(*) AS documents FROM latest GROUP BY ALL")
def import_stages(spark, sf):
    """Documents per import stage and progress."""
    return O.import_stage_summary(states(spark, sf))


@query(
    f"""WITH {STATES} SELECT id, count(*) FILTER (progress <> 'completed') AS open_stages FROM latest GROUP BY id
    HAVING count(*) FILTER (progress <> 'completed') > 0"""
)
def importing_documents(spark, sf):
    """Documents still being imported."""
    return O.importing_documents(states(spark, sf))
