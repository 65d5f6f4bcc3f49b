"""Operation metrics, error rules, progress and import state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import case_first, contains_any


def operation_stats(metrics: DataFrame) -> DataFrame:
    """(operation, duration_ms) to count, min, max and mean per operation."""
    return metrics.groupBy("operation").agg(
        F.count("*").alias("n"),
        F.min("duration_ms").alias("min_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.avg("duration_ms").alias("avg_ms"),
    )


def slow_threshold(operation: Column, thresholds: dict[str, float] | None = None) -> Column:
    """Threshold of the exact name, else of the first declared key the lower-cased name contains."""
    table = thresholds or L.SLOW_THRESHOLDS_MS
    exact = F.element_at(
        F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))]), operation
    )
    part = F.coalesce(
        *[F.when(F.lower(operation).contains(k.lower()), F.lit(float(v))) for k, v in table.items()]
    )
    return F.coalesce(exact, part)


def flag_slow(metrics: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Adds ``threshold_ms`` (null for unwatched operations) and ``slow``."""
    return metrics.withColumn(
        "threshold_ms", slow_threshold(F.col("operation"), thresholds)
    ).withColumn("slow", F.coalesce(F.col("duration_ms") > F.col("threshold_ms"), F.lit(False)))


def last_n_metrics(metrics: DataFrame, n: int = 100) -> DataFrame:
    """The newest ``n`` metrics overall."""
    return metrics.orderBy(F.desc("start_ts"), F.desc("metric_id")).limit(n)


def classify_error(message: Column) -> Column:
    return case_first(F.lower(message), L.ERROR_TYPES, "UNKNOWN")


def recoverable(message: Column) -> Column:
    return ~contains_any(F.lower(message), L.UNRECOVERABLE)


def retryable(message: Column) -> Column:
    """Retry words win over the words that forbid a retry; anything else is retried."""
    m = F.lower(message)
    return contains_any(m, L.RETRYABLE) | ~contains_any(m, L.NOT_RETRYABLE)


def http_status(message: Column, error_type: Column) -> Column:
    """(category, status, user_message) of a server error."""
    low, kind = F.lower(message), F.lower(error_type)

    def result(category: str, status: int, text: Column) -> Column:
        return F.struct(
            F.lit(category).alias("category"), F.lit(status).alias("status"), text.alias("user_message")
        )

    out = None
    for needle, type_needle, category, status, text in L.HTTP_NEEDLES:
        hit = low.contains(needle)
        if type_needle:
            hit = hit | kind.contains(type_needle)
        value = result(category, status, F.lit(text))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    for name, (category, status, text) in L.HTTP_TYPES.items():
        filled = F.replace(F.lit(text), F.lit("{}"), message)
        out = out.when(error_type == name, result(category, status, filled))
    category, status, text = L.HTTP_FALLBACK
    return out.otherwise(result(category, status, F.lit(text)))


def friendly_upload_error(message: Column) -> Column:
    """A readable text: first matching rule, else the message itself when short and plain."""
    plain = (F.length(message) < 100) & ~contains_any(message, ["Error:", "at "])
    return case_first(
        message, L.UPLOAD_ERRORS, F.when(plain, message).otherwise(L.UPLOAD_ERROR_FALLBACK)
    )


def format_remaining(seconds: Column) -> Column:
    """``2m 30s`` style; ``Unknown`` for null."""
    s = F.floor(seconds)
    m = F.floor(seconds / 60)
    return (
        F.when(seconds.isNull(), "Unknown")
        .when(seconds < 1, "< 1s")
        .when(seconds < 60, F.concat(s, F.lit("s")))
        .when(m < 60, F.concat(m, F.lit("m "), F.floor(seconds % 60), F.lit("s")))
        .otherwise(F.concat(F.floor(m / 60), F.lit("h "), m % 60, F.lit("m")))
    )


def progress_eta(progress: DataFrame) -> DataFrame:
    """(current, total, elapsed_s) to percentage, time left and status."""
    cur, total, spent = F.col("current"), F.col("total"), F.col("elapsed_s")
    eta = F.when((cur > 0) & (cur < total) & (spent > 0), (total - cur) / (cur / spent))
    return (
        progress.withColumn("percentage", F.when(total > 0, cur / total * 100).otherwise(0.0))
        .withColumn("eta_s", eta)
        .withColumn("status", F.when(cur < total, "in_progress").otherwise("complete"))
        .withColumn("remaining", format_remaining(eta))
    )


def log_summary(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level", "logger", "module").agg(
        F.count("*").alias("n"), F.max("timestamp").alias("latest")
    )


def latest_states(events: DataFrame) -> DataFrame:
    """(id, stage, progress, ts, event_id) to the last progress of every (document, stage)."""
    last = F.max_by(F.struct("progress", "completed", "total"), F.struct("ts", "event_id"))
    return events.groupBy("id", "stage").agg(last.alias("s")).select("id", "stage", "s.*")


def import_stage_summary(events: DataFrame) -> DataFrame:
    """Documents per stage and progress."""
    return latest_states(events).groupBy("stage", "progress").agg(F.count("*").alias("documents"))


def importing_documents(events: DataFrame, done: str = "completed") -> DataFrame:
    """Documents with a stage that is not done."""
    return latest_states(events).groupBy("id").agg(
        F.count_if(F.col("progress") != done).alias("open_stages")
    ).where("open_stages > 0")
